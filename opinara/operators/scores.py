"""Aspect scores: counts, ratios, shrinkage, confidence (Step 6), and prices.

Input ``mentions``: ``product_id, aspect, sentiment`` (more columns are ignored).  One map-side combined
aggregation reduces the mentions; everything after works on one row per product and aspect.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opinara.config import EngineConfig

SENTIMENTS = ("positive", "negative", "neutral")


def sentiment_counts(mentions: DataFrame) -> DataFrame:
    """``product_id, aspect, sentiment, n`` for the three known sentiments."""
    return mentions.where(F.col("sentiment").isin(*SENTIMENTS)).groupBy("product_id", "aspect", "sentiment").agg(F.count("*").alias("n"))


def aspect_counts(mentions: DataFrame) -> DataFrame:
    """One row per product and aspect with a zero-filled count per sentiment."""
    per = [F.count_if(F.col("sentiment") == s).alias(f"{s}_count") for s in SENTIMENTS]
    return mentions.where(F.col("sentiment").isin(*SENTIMENTS)).groupBy("product_id", "aspect").agg(*per, F.count("*").alias("mention_count"))


def with_ratio(counts: DataFrame, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    ratio = (F.col("positive_count") + F.lit(cfg.neutral_weight) * F.col("neutral_count")) / F.col("mention_count")
    return counts.withColumn("ratio", ratio)


def corpus_means(ratios: DataFrame) -> DataFrame:
    """Unweighted mean over products of the unrounded ratios, per aspect."""
    return ratios.groupBy("aspect").agg(F.avg("ratio").alias("corpus_mean"), F.count("*").alias("products"))


def aspect_scores(mentions: DataFrame, cfg: EngineConfig = EngineConfig(), products: DataFrame | None = None) -> DataFrame:
    """Raw and shrunken score and confidence of every mentioned (product, aspect); absent pairs have no row.

    ``products`` restricts the rows returned; the means stay those of the whole corpus.
    """
    ratios = with_ratio(aspect_counts(mentions), cfg)
    strength = max(0.0, cfg.shrinkage_strength)
    # one row an aspect: Spark broadcasts it by its measured size
    joined = ratios.join(corpus_means(ratios).select("aspect", "corpus_mean"), "aspect")
    if products is not None:
        joined = joined.join(products.select("product_id").distinct(), "product_id", "left_semi")
    n = F.col("mention_count")
    shrunk = (n * F.col("ratio") + strength * F.coalesce("corpus_mean", F.lit(cfg.neutral_prior))) / (n + F.lit(strength))
    return joined.select(
        "product_id",
        "aspect",
        *(f"{s}_count" for s in SENTIMENTS),
        "mention_count",
        F.round("ratio", 4).alias("raw_score"),
        F.round(shrunk, 4).alias("score"),
        F.round(n / (n + F.lit(cfg.min_mentions_for_score)), 4).alias("confidence"),
    )


def dominant_method(mentions: DataFrame) -> DataFrame:
    """The most frequent annotation method of each product; ties go to the smaller name."""
    counts = mentions.groupBy("product_id", "method").agg(F.count("*").alias("n"))
    best = Window.partitionBy("product_id").orderBy(F.desc("n"), "method")
    return counts.withColumn("r", F.row_number().over(best)).where("r = 1").select("product_id", "method", "n")


def pivot_sentiments(mentions: DataFrame) -> DataFrame:
    """Aspect by sentiment, zero-filled."""
    return mentions.groupBy("aspect").pivot("sentiment", list(SENTIMENTS)).count().fillna(0, list(SENTIMENTS))


def aspect_evidence(scores: DataFrame) -> DataFrame:
    """Per aspect: products with a score, all mentions, mean score."""
    return scores.groupBy("aspect").agg(F.count("score").alias("products"), F.sum("mention_count").alias("mentions"), F.round(F.avg("score"), 3).alias("mean_score"))


def latest_prices(prices: DataFrame) -> DataFrame:
    """Latest non-null price per product; of one time, the larger price, then currency."""
    order = Window.partitionBy("product_id").orderBy(F.desc("observed_at"), F.desc("price"), F.desc_nulls_last("currency"))
    return prices.where("price IS NOT NULL").withColumn("r", F.row_number().over(order)).where("r = 1").select("product_id", "price", "currency", "observed_at")


def price_changes(prices: DataFrame) -> DataFrame:
    """Observations that differ from the one before (price, currency or availability, null-safe)."""
    order = Window.partitionBy("product_id").orderBy("observed_at", "price", "currency", "availability")
    seen = prices.where("price IS NOT NULL")
    for c in ("price", "currency", "availability"):
        seen = seen.withColumn(f"_{c}", F.lag(c).over(order))
    seen = seen.withColumn("_n", F.row_number().over(order))
    same = F.col("price").eqNullSafe(F.col("_price")) & F.col("currency").eqNullSafe(F.col("_currency")) & F.col("availability").eqNullSafe(F.col("_availability"))
    return seen.where((F.col("_n") == 1) | ~same).select("product_id", "observed_at", "price", "currency", "availability")


def affordability(prices: DataFrame) -> DataFrame:
    """Min-max position of a price within its currency, 1.0 the cheapest.

    A currency with one product has no value; equal prices all get 1.0; a null currency is its own group.
    """
    bounds = prices.groupBy("currency").agg(F.min("price").alias("lo"), F.max("price").alias("hi"), F.count("*").alias("n"))
    joined = prices.alias("p").join(bounds.alias("b"), F.col("p.currency").eqNullSafe(F.col("b.currency")))
    span = F.col("hi") - F.col("lo")
    value = F.when(F.col("n") < 2, None).when(span < 1e-9, F.lit(1.0)).otherwise(F.round((F.col("hi") - F.col("price")) / span, 4))
    return joined.select("product_id", F.col("p.currency").alias("currency"), "price", value.alias("affordability"))
