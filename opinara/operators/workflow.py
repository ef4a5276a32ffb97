"""The staged workflow around the engine: listings, candidates, selections, stored records, packs and status."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opinara.operators import corpus

# --- listings ----------------------------------------------------------------------------------------------


def description(specs: Column, bullets: Column) -> Column:
    """The description among the specifications, else the first bullet, else null."""
    filled = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.coalesce(filled(F.try_element_at(specs, F.lit("description"))), filled(F.get(bullets, F.lit(0))))


def preview(text: Column, most: int) -> Column:
    return F.substring(text, 1, most)


def price_text(price: Column, currency: Column) -> Column:
    return F.when(price.isNotNull(), F.concat_ws(" ", currency, F.format_number(price, 2))).otherwise(F.lit("n/a"))


def stars(rating: Column) -> Column:
    """A rating as full and empty stars."""
    full = F.round(rating).cast("int")
    return F.when(rating.isNotNull(), F.concat(F.repeat(F.lit("★"), full), F.repeat(F.lit("☆"), 5 - full))).otherwise(F.lit(""))


def product_list(products: DataFrame, prices: DataFrame, reviews: DataFrame) -> DataFrame:
    """Every product with its latest price and its review counts (zero where it has none)."""
    latest = prices.select("product_id", F.col("price").alias("latest_price"), "currency")
    counts = corpus.review_counts(reviews)
    joined = products.join(latest, "product_id", "left").join(counts, "product_id", "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("total", "analysed")})


def with_features(listed: DataFrame, features: DataFrame) -> DataFrame:
    """A list with the wide feature row of each product that has one."""
    return listed.join(features, "product_id", "left")


def audit_rows(reviews: DataFrame, products: DataFrame) -> DataFrame:
    """Reviews with their product's brand and name and the decision on them; reviews without a product stay."""
    named = products.select("product_id", "brand", F.col("name").alias("product_name"))
    return reviews.join(named, "product_id", "left").withColumn("decision", corpus.decision())


# --- candidates and selections -----------------------------------------------------------------------------


def candidate_rows(products: DataFrame) -> DataFrame:
    """What the candidate table shows, the most and best rated first."""
    rows = products.select(
        F.col("source_product_id").alias("parent_asin"),
        F.coalesce(corpus.blank("canonical_name"), F.col("raw_title")).alias("product_name"),
        F.coalesce(corpus.blank("brand"), F.lit("Unknown")).alias("brand"),
        F.coalesce("model", F.lit("")).alias("model"),
        F.col("site_rating").alias("average_rating"),
        F.col("site_rating_count").alias("rating_number"),
        "price",
    )
    return rows.orderBy(F.desc_nulls_last("rating_number"), F.desc_nulls_last("average_rating"), "parent_asin")


def most_rated(products: DataFrame, most: int = 0, key: str = "source_product_id") -> DataFrame:
    """Products by rating count (none counts as zero), at most ``most`` of them (0: all)."""
    rows = products.orderBy(F.desc(F.coalesce("site_rating_count", F.lit(0))), key)
    return rows.limit(most) if most else rows


def selected(candidates: DataFrame, selection: DataFrame, key: str = "parent_asin") -> DataFrame:
    """The records of the selected candidates; ids are compared in upper case without blanks."""
    wanted = selection.select(F.upper(F.trim(key)).alias("_wanted")).where("_wanted <> ''").distinct()
    return candidates.join(wanted, F.upper(F.trim(candidates[key])) == F.col("_wanted"), "left_semi")


def targets(explicit: DataFrame, found: DataFrame, key: str = "asin", order: str = "position") -> DataFrame:
    """Explicit ids before found ones, each id once at its first place."""
    both = explicit.select(F.upper(F.trim(key)).alias(key), F.lit(0).alias("_from"), order).unionAll(found.select(F.upper(F.trim(key)).alias(key), F.lit(1).alias("_from"), order))
    first = both.groupBy(key).agg(F.min(F.struct("_from", order)).alias("at"))
    return first.select(key, F.col("at._from").alias("source"), F.col(f"at.{order}").alias(order)).orderBy("source", order, key)


def merged_counts(*counters: DataFrame, key: str = "key", value: str = "n") -> DataFrame:
    """Counters added up by key."""
    whole = counters[0].select(key, value)
    for other in counters[1:]:
        whole = whole.unionAll(other.select(key, value))
    return whole.groupBy(key).agg(F.sum(value).alias(value))


# --- stored records ----------------------------------------------------------------------------------------


def price_appends(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming observations that differ from the one before them: the latest stored, or an earlier incoming one.

    Price, currency and availability are compared null-safe; observations without a price are skipped.
    """
    columns = ("product_id", "observed_at", "price", "currency", "availability")
    newest = stored.groupBy("product_id").agg(F.max(F.struct("observed_at", "price", "currency", "availability")).alias("s"))
    newest = newest.select("product_id", *(F.col(f"s.{c}").alias(c) for c in columns[1:]), F.lit(0).alias("_new"))
    fresh = incoming.where("price IS NOT NULL").select(*columns, F.lit(1).alias("_new"))
    order = Window.partitionBy("product_id").orderBy("_new", "observed_at", "price", "currency", "availability")
    seen = newest.unionAll(fresh).withColumn("_r", F.row_number().over(order))
    same = F.col("_r") > 1
    for c in columns[2:]:
        seen = seen.withColumn(f"_{c}", F.lag(c).over(order))
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return seen.where((F.col("_new") == 1) & ~same).select(*columns)


def patched(stored: DataFrame, patch: DataFrame, key: str = "id") -> DataFrame:
    """``stored`` with the non-null fields of ``patch``; unknown ids of the patch are new rows."""
    last = patch.groupBy(key).agg(*(F.last(c, ignorenulls=True).alias(c) for c in patch.columns if c != key))
    fields = [c for c in stored.columns if c != key]
    change = last.select(F.col(key), *(F.col(c).alias(f"_new_{c}") for c in fields if c in patch.columns))
    joined = stored.join(change, key, "full_outer")
    return joined.select(key, *(F.coalesce(f"_new_{c}", c).alias(c) if c in patch.columns else F.col(c) for c in fields))


def newest(rows: DataFrame, time: str = "created_at", most: int = 50, key: str = "id", **equal: str | None) -> DataFrame:
    """The newest rows, of those that have the given values (None: any)."""
    for column, value in equal.items():
        if value is not None:
            rows = rows.where(F.col(column) == value)
    return rows.orderBy(F.desc(time), F.desc(key)).limit(most)


def evolved(table: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """The table with every column it lacks, as nulls of the given type."""
    return table.withColumns({name: F.lit(None).cast(kind) for name, kind in columns.items() if name not in table.columns})


def without_reviews(tables: Mapping[str, DataFrame], reviews: DataFrame) -> dict[str, DataFrame]:
    """Sentences and mentions without those of the given reviews, which are to be analysed again."""
    return {name: corpus.cascade_delete(df, reviews, "review_id") for name, df in tables.items()}


def ingest_counters(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """One row: reviews inserted, duplicate (in the batch or stored) and excluded, over one batch.

    A review is a duplicate whatever its verdict; excluded ones are inserted, too.
    """
    known = stored.select("product_id", "content_hash").distinct().withColumn("_known", F.lit(True))
    first = Window.partitionBy("product_id", "content_hash").orderBy("arrival")
    rows = incoming.withColumn("_r", F.row_number().over(first)).join(known, ["product_id", "content_hash"], "left")
    new = (F.col("_r") == 1) & F.col("_known").isNull()
    return rows.agg(F.count_if(new).alias("inserted"), F.count_if(~new).alias("duplicate"), F.count_if(new & F.col("excluded_reason").isNotNull()).alias("excluded"))


def stage_counts(products: DataFrame, reviews: DataFrame, sentences: DataFrame, mentions: DataFrame, scores: DataFrame) -> DataFrame:
    """``stage, n``: rows of every stage of the store."""
    one = lambda df, name, count: df.agg(count.alias("n")).select(F.lit(name).alias("stage"), "n")
    fine = F.col("excluded_reason").isNull() & ~F.col("is_spam")
    parts = [
        one(products, "products", F.count("*")),
        one(reviews, "reviews", F.count("*")),
        one(reviews, "reviews_usable", F.count_if(fine)),
        one(reviews, "reviews_analysed", F.count_if(F.col("processed_at").isNotNull())),
        one(sentences, "sentences", F.count("*")),
        one(mentions, "aspect_rows", F.count("*")),
        one(scores, "scored_products", F.countDistinct("product_id")),
    ]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionAll(part)
    return whole


# --- packs -------------------------------------------------------------------------------------------------

#: Columns of the export tables, in order, and what they are sorted by; a column that a table lacks is null.
EXPORTS = {
    "products": (("product_id", "source", "brand", "model", "name", "site_rating", "site_rating_count", "price", "product_url"), ("product_id",)),
    "reviews": (("review_id", "product_id", "source_review_id", "rating", "review_date", "verified", "helpful_votes", "language", "is_spam", "excluded_reason", "title", "cleaned_body", "processed_at"), ("review_id",)),
    "sentences": (("sentence_id", "review_id", "product_id", "position", "text", "word_count"), ("review_id", "position")),
    "mentions": (("product_id", "review_id", "sentence_id", "aspect", "sentiment", "confidence", "opinion_term", "method", "model_name"), ("review_id", "sentence_id", "aspect")),
    "scores": (("product_id", "aspect", "positive_count", "negative_count", "neutral_count", "mention_count", "raw_score", "score", "confidence"), ("product_id", "aspect")),
}


def export_table(name: str, table: DataFrame) -> DataFrame:
    """The export's columns of a table in their order, sorted."""
    columns, order = EXPORTS[name]
    shown = evolved(table, dict.fromkeys(columns, "string")).select(*columns)
    return shown.orderBy(*order)


def evidence(reviews: DataFrame, products: DataFrame, sentences: DataFrame, mentions: DataFrame, scores: DataFrame, ranking: DataFrame | None = None, most: int = 300) -> dict[str, DataFrame]:
    """The evidence pack: one table a step of the method, by file name."""
    audit = audit_rows(reviews, products)
    text = [preview(F.col(c), most).alias(c) for c in ("title", "body", "cleaned_body") if c in audit.columns]
    plain = [c for c in audit.columns if c not in ("title", "body", "cleaned_body")]
    shown = audit.select(*plain, *text)
    pack = {
        "01_products": products.orderBy("product_id"),
        "02_reviews_raw": shown.drop("cleaned_body").orderBy("review_id"),
        "03_reviews_preprocessed": shown.orderBy("review_id"),
        "04_reviews_kept": shown.where("decision = 'kept'").orderBy("review_id"),
        "05_exclusions": audit.groupBy("decision").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "decision"),
        "06_sentences": sentences.orderBy("review_id", "position"),
        "07_mentions": mentions.orderBy("review_id", "aspect"),
        "08_aspect_sentiments": mentions.groupBy("aspect", "sentiment").agg(F.count("*").alias("n")).orderBy("aspect", "sentiment"),
        "09_scores": scores.orderBy("product_id", "aspect"),
    }
    return pack if ranking is None else pack | {"10_ranking": ranking.orderBy("rank")}


def required(table: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The table, which must have the columns."""
    if lacking := [c for c in columns if c not in table.columns]:
        raise ValueError(f"columns {lacking} are missing")
    return table


def pair_match(labelled: DataFrame) -> DataFrame:
    """``pairs, rate``: rows with a gold aspect, and the share of them whose aspect and sentiment are both right."""
    name = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    told = labelled.where(name(F.col("gold_aspect")) != "")
    right = (name(F.col("gold_aspect")) == name(F.col("aspect"))) & F.coalesce(F.col("gold") == F.col("predicted"), F.lit(False))
    return told.agg(F.count("*").alias("pairs"), F.round(F.avg(right.cast("int")), 4).alias("rate"))


def gold_template(mentions: DataFrame, sentences: DataFrame | None = None) -> DataFrame:
    """Rows for a person to label: the mention, its sentence, and empty columns for the true sentiment and notes.

    Mentions that bring their ``sentence_text`` are written as they come; for others it is looked up in ``sentences``.
    """
    told = mentions if sentences is None else mentions.join(sentences.select("sentence_id", F.col("text").alias("sentence_text")), "sentence_id")
    return told.select("sentence_id", "sentence_text", "aspect", F.col("sentiment").alias("predicted_sentiment"), "method", F.lit("").alias("gold_sentiment"), F.col("aspect").alias("gold_aspect"), F.lit("").alias("notes"))


def feedback_rows(requests: DataFrame) -> DataFrame:
    """Feedback as it is stored, from ``session_id, satisfaction, comment, ranking_method, ratings``.

    ``ratings`` is an array of ``(product_id, satisfaction)``.  The overall satisfaction is the one given, else the
    mean of the ratings rounded half to even, within 1 to 5; requests with neither are left out.
    """
    filled = lambda c: F.nullif(F.trim(c), F.lit(""))
    ratings = F.coalesce("ratings", F.array().cast("array<struct<product_id:bigint,satisfaction:int>>"))
    total = F.aggregate(ratings, F.lit(0), lambda a, r: a + r["satisfaction"])
    mean = F.when(F.size(ratings) > 0, F.bround(total / F.size(ratings), 0).cast("int"))
    overall = F.coalesce(F.col("satisfaction"), F.least(F.lit(5), F.greatest(F.lit(1), mean)))
    rows = requests.select(
        filled("session_id").alias("session_id"),
        F.when(F.col("satisfaction").isNotNull() | (F.size(ratings) > 0), overall).alias("satisfaction"),
        filled("comment").alias("comment"),
        F.coalesce(filled("ranking_method"), F.lit("weighted")).alias("ranking_method"),
        F.when(F.size(ratings) > 0, F.transform(ratings, lambda r: r["product_id"])).alias("top_products"),
        F.when(F.size(ratings) > 0, ratings).alias("ratings"),
    )
    return rows.where("satisfaction IS NOT NULL")
