"""Corpus operators: filters, joins, de-duplication, statistics and table mutations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def blank(c: str | Column) -> Column:
    """Null for null and empty strings."""
    return F.nullif(F.col(c) if isinstance(c, str) else c, F.lit(""))


def display_name() -> Column:
    return F.coalesce(blank("canonical_name"), blank("raw_title"), F.concat_ws(":", "source", "source_product_id"))


def by_ids(df: DataFrame, column: str, ids: Sequence | None) -> DataFrame:
    """An id list; null or empty means no filter."""
    return df.where(F.col(column).isin(*ids)) if ids else df


def usable(reviews: DataFrame) -> DataFrame:
    return reviews.where(F.col("excluded_reason").isNull() & ~F.col("is_spam"))


def kept(reviews: DataFrame) -> DataFrame:
    return usable(reviews).where(~F.col("is_duplicate"))


def pending(reviews: DataFrame, force: bool = False, limit: int | None = None) -> DataFrame:
    """Usable reviews not analysed yet, most helpful first."""
    rows = usable(reviews)
    if not force:
        rows = rows.where("processed_at IS NULL")
    rows = rows.orderBy(F.desc_nulls_last("helpful_votes"), "id")
    return rows.limit(limit) if limit else rows


def analysed(reviews: DataFrame, state: bool | None = True) -> DataFrame:
    if state is None:
        return reviews
    return reviews.where(F.col("processed_at").isNotNull() if state else F.col("processed_at").isNull())


def rating_between(reviews: DataFrame, low: float | None = None, high: float | None = None) -> DataFrame:
    if low is not None:
        reviews = reviews.where(F.col("rating") >= low)
    return reviews.where(F.col("rating") <= high) if high is not None else reviews


def matching(products: DataFrame, q: str, columns: Sequence[str]) -> DataFrame:
    """Case-insensitive substring in any column; % and _ in ``q`` stay wildcards."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.col(c).ilike(f"%{q}%"), F.lit(False))
    return products.where(hit)


def page(df: DataFrame, limit: int, offset: int = 0, key: str = "id") -> DataFrame:
    return df.orderBy(key).offset(offset).limit(limit)


def first_seen(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The first row of each key in arrival order (not ``dropDuplicates``, whose choice is free)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def cap_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], most: int) -> DataFrame:
    """The first ``most`` rows of each key: Spark prunes each partition before the shuffle (window group limit)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).drop("_r")


def union_distinct_reviews(inline: DataFrame, paged: DataFrame) -> DataFrame:
    """Inline before paginated reviews, one for each id (else the body's first 120 characters)."""
    both = inline.withColumn("_from", F.lit(0)).unionByName(paged.withColumn("_from", F.lit(1)))
    keyed = both.withColumn("_key", F.coalesce(blank("source_review_id"), F.substring("body", 1, 120)))
    return first_seen(keyed, ["_key"], ["_from", "position"]).drop("_from", "_key")


def new_reviews(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Incoming reviews whose (product, hash) is not stored, first of each."""
    unique = first_seen(incoming, ["product_id", "content_hash"], ["arrival"])
    return unique.join(stored.select("product_id", "content_hash"), ["product_id", "content_hash"], "left_anti")


def upsert_products(stored: DataFrame, incoming: DataFrame, keys: Sequence[str], text: Sequence[str], numbers: Sequence[str]) -> DataFrame:
    """A new non-empty text or non-null number replaces the stored value; unknown keys are added.

    Rows of one key in a batch are merged first, a later non-empty value before an earlier one (in row order).
    """
    values = [F.nullif(F.col(c), F.lit("")).alias(c) for c in text] + [F.col(c) for c in numbers]
    ordered = incoming.select(*keys, *values, F.monotonically_increasing_id().alias("_n"))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_n"))).alias(c)
    merged = ordered.groupBy(*keys).agg(*(last(c) for c in (*text, *numbers)))
    old, new = stored.alias("o"), merged.alias("n")
    match = F.lit(True)
    for k in keys:
        match = match & (F.col(f"o.{k}") == F.col(f"n.{k}"))
    joined = old.join(new, match, "full_outer")
    columns = [F.coalesce(f"n.{k}", f"o.{k}").alias(k) for k in keys]
    columns += [F.coalesce(F.nullif(F.col(f"n.{c}"), F.lit("")), F.col(f"o.{c}")).alias(c) for c in text]
    columns += [F.coalesce(f"n.{c}", f"o.{c}").alias(c) for c in numbers]
    return joined.select(*columns)


def cascade_delete(children: DataFrame, gone: DataFrame, key: str = "product_id") -> DataFrame:
    return children.join(gone.select(key).distinct(), key, "left_anti")


def decision() -> Column:
    return F.when(F.col("is_spam"), F.lit("spam")).when(F.col("is_duplicate"), F.lit("duplicate")).when(F.col("excluded_reason").isNotNull(), F.col("excluded_reason")).otherwise(F.lit("kept"))


def exclusion_breakdown(reviews: DataFrame) -> DataFrame:
    excluded = reviews.where(F.col("excluded_reason").isNotNull() | F.col("is_spam"))
    return excluded.groupBy(F.coalesce("excluded_reason", F.lit("spam")).alias("reason")).agg(F.count("*").alias("n"))


def funnel(products: DataFrame, reviews: DataFrame, scores: DataFrame) -> DataFrame:
    """Conditional counts of every stage as ``stage, n`` rows, one pass a table."""
    p = products.agg(F.count("*").alias("products")).select(F.explode(F.create_map(F.lit("products"), "products")).alias("stage", "n"))
    r = reviews.agg(
        F.count("*").alias("a"),
        F.count_if("is_spam").alias("b"),
        F.count_if("is_duplicate").alias("c"),
        F.count_if(~F.col("is_spam") & ~F.col("is_duplicate") & F.col("excluded_reason").isNull()).alias("d"),
        F.count_if(F.col("processed_at").isNotNull()).alias("e"),
    )
    r = r.select(F.explode(F.create_map(F.lit("reviews"), "a", F.lit("spam"), "b", F.lit("duplicates"), "c", F.lit("kept"), "d", F.lit("analysed"), "e")).alias("stage", "n"))
    s = scores.agg(F.countDistinct("product_id").alias("a"), F.count("*").alias("b")).select(F.explode(F.create_map(F.lit("scored_products"), "a", F.lit("scores"), "b")).alias("stage", "n"))
    return p.unionAll(r).unionAll(s)


def brand_distribution(products: DataFrame) -> DataFrame:
    return products.groupBy("brand").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "brand")


def review_counts(reviews: DataFrame) -> DataFrame:
    return reviews.groupBy("product_id").agg(F.count("*").alias("total"), F.count_if(F.col("processed_at").isNotNull() & F.col("excluded_reason").isNull()).alias("analysed"))


def nested_review(reviews: DataFrame, sentences: DataFrame, mentions: DataFrame) -> DataFrame:
    """Reviews with their sentences in order, each with its aspects; sentences without aspects are kept.

    Rows meet by key before they are gathered: lists gathered ahead of a shuffle shrink nothing, and their sorts spill
    into many files whose read buffers fill the heap.  The numbers of partitions are given, since adaptive execution
    would make few large ones of them.
    """
    parts = int(mentions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = lambda rows, key: rows.repartition(parts, key)
    per_sentence = by(mentions, "sentence_id").groupBy("sentence_id").agg(F.array_sort(F.collect_list(F.struct("aspect", "sentiment"))).alias("aspects"))
    none = F.array().cast("array<struct<aspect:string,sentiment:string>>")
    joined = by(sentences, "sentence_id").join(per_sentence, "sentence_id", "left").withColumn("aspects", F.coalesce("aspects", none))
    nested = by(joined, "review_id").groupBy("review_id").agg(F.array_sort(F.collect_list(F.struct("position", "text", "aspects"))).alias("sentences"))
    return reviews.join(nested, "review_id", "left")
