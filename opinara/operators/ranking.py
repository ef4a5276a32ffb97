"""Feature vectors and recommendation: imputation, coverage, strengths, explanation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opinara.config import EngineConfig

AFFORDABILITY = "affordability"


def normalised_weights(raw: Mapping[str, float] | None, allowed: Sequence[str]) -> dict[str, float]:
    """Known aspects with positive weight, scaled to one; none left means equal weights."""
    known = [*allowed, AFFORDABILITY]
    kept: dict[str, float] = {}
    for key, value in (raw or {}).items():
        name = key.strip().lower()
        if name in known and value and value > 0:
            kept[name] = float(value)
    if not kept:
        kept = dict.fromkeys(allowed, 1.0)
    total = sum(kept.values())
    return {a: w / total for a, w in kept.items()}


def feature_vectors(products: DataFrame, scores: DataFrame, affordability: DataFrame | None = None, review_counts: DataFrame | None = None) -> DataFrame:
    """Long vectors ``product_id, aspect, score, mention_count`` of all products; affordability is an aspect of no mentions."""
    rows = scores.select("product_id", "aspect", "score", "mention_count")
    if affordability is not None:
        rows = rows.unionByName(affordability.where("affordability IS NOT NULL").select("product_id", F.lit(AFFORDABILITY).alias("aspect"), F.col("affordability").alias("score"), F.lit(0).cast("long").alias("mention_count")))
    return rows.join(products.select("product_id"), "product_id", "left_semi")


def wide_features(products: DataFrame, scores: DataFrame, aspects: Sequence[str], affordability: DataFrame) -> DataFrame:
    """One row per product: score and mentions of each aspect, and affordability."""
    made = scores.groupBy("product_id").agg(
        *(F.max(F.when(F.col("aspect") == a, F.col("score"))).alias(a) for a in aspects),
        *(F.coalesce(F.max(F.when(F.col("aspect") == a, F.col("mention_count"))), F.lit(0)).alias(f"{a}_mentions") for a in aspects),
    )
    out = products.select("product_id").join(made, "product_id", "left").join(affordability.select("product_id", AFFORDABILITY), "product_id", "left")
    return out.fillna(0, [f"{a}_mentions" for a in aspects])


def candidates(products: DataFrame, brands: Sequence[str] = (), min_reviews: int = 0, budget_min: float | None = None, budget_max: float | None = None) -> DataFrame:
    """Filters of a request; a missing price fails any active budget."""
    out = products
    if brands:
        out = out.where(F.lower(F.trim("brand")).isin(*{b.strip().lower() for b in brands}))
    if min_reviews:
        out = out.where(F.col("review_count") >= min_reviews)
    if budget_min is not None:
        out = out.where(F.col("price") >= budget_min)
    if budget_max is not None:
        out = out.where(F.col("price") <= budget_max)
    return out


def breakdown(chosen: DataFrame, vectors: DataFrame, weights: Mapping[str, float]) -> DataFrame:
    """One row per candidate and weighted aspect: score (imputed where missing), contribution, mentions.

    A missing score takes the mean over the candidates that have one, else 0.5.
    """
    spark = chosen.sparkSession
    table = spark.createDataFrame([(a, float(w), k) for k, (a, w) in enumerate(weights.items())], "aspect string, weight double, ord int")
    own = vectors.join(F.broadcast(table.select("aspect")), "aspect", "left_semi").join(chosen.select("product_id"), "product_id", "left_semi")
    means = table.join(own.groupBy("aspect").agg(F.avg("score").alias("mean")), "aspect", "left").select("aspect", "weight", "ord", F.coalesce("mean", F.lit(0.5)).alias("mean"))
    # a few weights for every candidate: the grid is bounded by (candidates x weights)
    grid = chosen.select("product_id").withColumn("w", F.explode(F.array(*(F.struct(F.lit(a).alias("aspect")) for a in weights)))).select("product_id", "w.aspect")
    joined = grid.join(F.broadcast(means), "aspect").join(own, ["product_id", "aspect"], "left")
    score = F.coalesce("score", "mean")
    return joined.select(
        "product_id",
        "aspect",
        "ord",
        "weight",
        score.alias("score"),
        (F.col("weight") * score).alias("contribution"),
        F.coalesce("mention_count", F.lit(0)).alias("mention_count"),
        F.col("score").isNull().alias("imputed"),
    )


def weighted_scores(parts: DataFrame) -> DataFrame:
    return parts.groupBy("product_id").agg(
        F.round(F.sum("contribution"), 4).alias("final_score"),
        F.round(F.sum(F.when(~F.col("imputed"), F.col("weight")).otherwise(0.0)), 4).alias("coverage"),
    )


def ranked(scored: DataFrame, keys: Sequence[Column], top_k: int) -> DataFrame:
    """The first ``top_k`` rows by ``keys`` with their rank (a top-k, then a window over k rows)."""
    top = scored.orderBy(*keys).limit(top_k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*keys)))


def recommend(products: DataFrame, vectors: DataFrame, allowed: Sequence[str], weights: Mapping[str, float] | None = None, method: str = "weighted", top_k: int = 10, brands: Sequence[str] = (), min_reviews: int = 0, budget_min: float | None = None, budget_max: float | None = None) -> DataFrame:
    """Ranked products.  ``products`` has product_id, brand, price, review_count, site_rating, site_rating_count."""
    chosen = candidates(products, brands, min_reviews, budget_min, budget_max)
    scored = chosen.join(weighted_scores(breakdown(chosen, vectors, normalised_weights(weights, allowed))), "product_id")
    if method == "star_rating":
        star = F.round(F.coalesce((F.col("site_rating") - 1) / 4, F.lit(0.0)), 4)
        scored = scored.withColumn("final_score", star)
        keys = [F.desc(F.col("site_rating").isNotNull()), F.desc(F.coalesce("site_rating", F.lit(0.0))), F.desc(F.coalesce("site_rating_count", F.lit(0))), F.desc("review_count"), F.asc("product_id")]
    else:
        keys = [F.desc("final_score"), F.desc("coverage"), F.desc("review_count"), F.asc("product_id")]
    return ranked(scored, keys, top_k).select("rank", "product_id", "final_score", "coverage")


def strengths_and_weaknesses(parts: DataFrame, cfg: EngineConfig = EngineConfig(), top: int = 3) -> DataFrame:
    """Per product: up to three strong and weak aspects that it is mentioned for.

    A score of exactly 0.0 is never a weakness (kept behaviour).
    """
    item = F.struct(F.col("score"), F.col("ord"), F.col("aspect"))
    mentioned = F.col("mention_count") > 0
    strong = F.collect_list(F.when(mentioned & ~F.col("imputed") & (F.col("score") >= cfg.strength_cut), item))
    weak = F.collect_list(F.when(mentioned & ~F.col("imputed") & (F.col("score") <= cfg.weakness_cut) & (F.col("score") != 0), item))
    got = parts.groupBy("product_id").agg(strong.alias("s"), weak.alias("w"))
    # an array of structs sorts by score, then weight order
    best = F.transform(F.slice(F.array_sort(F.transform("s", lambda x: F.struct((-x["score"]).alias("k"), x["ord"].alias("o"), x["aspect"].alias("a")))), 1, top), lambda x: x["a"])
    worst = F.transform(F.slice(F.array_sort(F.transform("w", lambda x: F.struct(x["score"].alias("k"), x["ord"].alias("o"), x["aspect"].alias("a")))), 1, top), lambda x: x["a"])
    return got.select("product_id", F.array_join(best, ", ").alias("strengths"), F.array_join(worst, ", ").alias("weaknesses"))


def percent(score: Column) -> Column:
    return F.coalesce(F.concat(F.bround(score * 100, 0).cast("int").cast("string"), F.lit("%")), F.lit("n/a"))


def explanation(parts: DataFrame, top: int = 3) -> DataFrame:
    """A sentence per product from its three largest contributions."""
    said = F.concat(F.col("aspect"), F.lit(" "), percent(F.col("score")))
    got = parts.groupBy("product_id").agg(F.array_sort(F.collect_list(F.struct((-F.round("contribution", 10)).alias("k"), F.col("ord"), said.alias("t")))).alias("p"))
    return got.select("product_id", F.concat(F.lit("Ranked for "), F.array_join(F.transform(F.slice("p", 1, top), lambda x: x["t"]), ", "), F.lit(".")).alias("explanation"))
