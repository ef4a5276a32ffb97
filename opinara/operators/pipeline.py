"""The batch DAG: clean, de-duplicate, segment, annotate, score; and its table mutations."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import partial

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opinara.config import EngineConfig
from opinara.functions import annotating, cleaning, segmenting
from opinara.functions.taxonomy import taxonomy
from opinara.operators import corpus, scores


@dataclass(frozen=True)
class Analysis:
    """Lazy tables of one run."""

    reviews: DataFrame
    sentences: DataFrame
    mentions: DataFrame | None
    scores: DataFrame | None


def clean_reviews(reviews: DataFrame, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """Step 1 over ``review_id, product_id, title, body, arrival``; excluded reviews stay, equal hashes keep the first."""
    checked = cleaning.preprocess(reviews, min_chars=cfg.min_review_chars, language=cfg.language_filter)
    return corpus.first_seen(checked, ["product_id", "content_hash"], ["arrival"]).withColumn("is_duplicate", F.lit(False))


def analyse(cleaned: DataFrame, cfg: EngineConfig = EngineConfig(), make: Callable[[], annotating.Engine] | None = None, stop_after: str = "scores") -> Analysis:
    """Steps 2-6 over cleaned reviews.  ``stop_after``: sentences, mentions or scores."""
    kept = corpus.usable(cleaned).select("review_id", "product_id", "cleaned_body")
    rows = segmenting.sentence_rows(kept, least=cfg.min_sentence_chars, most=cfg.max_sentence_chars)
    if stop_after == "sentences":
        return Analysis(cleaned, rows, None, None)
    make = make or partial(annotating.engine, cfg.engine, taxonomy=taxonomy(cfg.aspect_set))
    mentions = annotating.mention_rows(rows, make=make)
    made = scores.aspect_scores(mentions, cfg) if stop_after == "scores" else None
    return Analysis(cleaned, rows, mentions, made)


def unprocessed(reviews: DataFrame, processed: DataFrame) -> DataFrame:
    """Reviews that no earlier run has handled."""
    return reviews.join(processed.select("review_id"), "review_id", "left_anti")


def select_products(reviews: DataFrame, products: DataFrame, min_reviews: int = 0, most: int = 0) -> DataFrame:
    """Products with enough reviews in the file, the most reviewed and best rated first."""
    counts = reviews.groupBy("source_product_id").agg(F.count("*").alias("_reviews"))
    rows = products.join(counts, "source_product_id", "left")
    if min_reviews:
        rows = rows.where(F.coalesce("_reviews", F.lit(0)) >= min_reviews)
    rows = rows.drop("_reviews")
    return rows.orderBy(F.desc_nulls_last("site_rating_count"), F.desc_nulls_last("site_rating"), "source_product_id").limit(most) if most else rows


def enriched(products: DataFrame, reviews: DataFrame) -> DataFrame:
    """Products with raw and usable review counts; products without a usable review go."""
    counts = reviews.groupBy("source_product_id").agg(F.count("*").alias("review_count_raw"), F.count_if("usable").alias("review_count_usable"))
    return products.join(counts, "source_product_id").where("review_count_usable > 0")


def manifest(products: DataFrame, reviews: DataFrame) -> DataFrame:
    """One row: products, reviews, usable reviews."""
    return products.agg(F.count("*").alias("products")).crossJoin(F.broadcast(reviews.agg(F.count("*").alias("reviews"), F.count_if("usable").alias("usable"))))


def gold_sample(mentions: DataFrame, n: int = 200, seed: int = 42) -> DataFrame:
    """About n rows, a third of each sentiment, chosen by hash (the same on every run)."""
    order = F.md5(F.concat_ws("|", "sentence_id", "aspect", F.lit(seed)).cast("binary"))
    per = Window.partitionBy("sentiment").orderBy(order, "sentence_id", "aspect")
    picked = mentions.withColumn("_r", F.row_number().over(per)).where(F.col("_r") <= max(1, n // 3)).drop("_r")
    return picked.orderBy(order, "sentence_id", "aspect").limit(n)


def walkthrough(reviews: DataFrame, sentences: DataFrame, mentions: DataFrame, made: DataFrame, most_sentences: int = 8, most_labels: int = 12) -> DataFrame:
    """The review with most labels (smallest id of a tie), its sentences, labels and its product's scores."""
    top = mentions.groupBy("review_id").agg(F.count("*").alias("labels")).orderBy(F.desc("labels"), "review_id").limit(1)
    lines = sentences.join(F.broadcast(top), "review_id").groupBy("review_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("position", "text"))), 1, most_sentences).alias("sentences"))
    labels = mentions.join(F.broadcast(top), "review_id").groupBy("review_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("position", "aspect", "sentiment", "confidence"))), 1, most_labels).alias("opinions"))
    product = made.groupBy("product_id").agg(F.array_sort(F.collect_list(F.struct("aspect", "score", "mention_count"))).alias("scores"))
    return reviews.join(F.broadcast(top), "review_id").join(lines, "review_id").join(labels, "review_id").join(product, "product_id", "left")


def purge(tables: dict[str, DataFrame], gone: DataFrame, key: str = "product_id") -> dict[str, DataFrame]:
    """Every table without the rows of deleted products."""
    return {name: corpus.cascade_delete(df, gone, key) for name, df in tables.items()}


def weights_preset(name: str, allowed: Sequence[str]) -> dict[str, float]:
    """Named starting weights; an unknown name is the balanced one."""
    # Importance 0 to 5 by preset; empty means equal.
    presets = {
        "balanced": {},
        "photography": {"camera": 5.0, "display": 4.0, "performance": 3.0, "battery": 3.0},
        "battery life": {"battery": 5.0, "performance": 3.0, "price": 3.0},
        "gaming": {"performance": 5.0, "display": 4.0, "battery": 4.0},
        "best value": {"affordability": 5.0, "price": 4.0, "battery": 3.0, "performance": 3.0},
    }
    return presets.get(name.strip().lower()) or dict.fromkeys(allowed, 1.0)
