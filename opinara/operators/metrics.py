"""Quality measures: star agreement, NDCG, Spearman, feedback statistics, gold labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opinara.config import EngineConfig


def star_agreement_rows(mentions: DataFrame, ratings: DataFrame, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """Per rated review: polarity from its mentions, its label, the stars' label.

    ``mentions``: review_id, sentiment; ``ratings``: review_id, rating.
    """
    counts = mentions.groupBy("review_id").agg(F.count_if(F.col("sentiment") == "positive").alias("pos"), F.count_if(F.col("sentiment") == "neutral").alias("neu"), F.count("*").alias("n"))
    score = (F.col("pos") + F.lit(cfg.neutral_weight) * F.col("neu")) / F.col("n")
    joined = counts.join(ratings.where("rating IS NOT NULL"), "review_id").withColumn("absa", score)
    said = F.when(F.col("absa") > cfg.agree_high, "positive").when(F.col("absa") < cfg.agree_low, "negative").otherwise("neutral")
    star = F.when(F.col("rating") >= 4, "positive").when(F.col("rating") <= 2, "negative").otherwise("neutral")
    return joined.select("review_id", "rating", "absa", said.alias("absa_label"), star.alias("star_label"))


def star_agreement(rows: DataFrame) -> DataFrame:
    error = F.abs(F.col("absa") - (F.col("rating") - 1) / 4)
    return rows.agg(
        F.count("*").alias("reviews"),
        F.round(F.avg((F.col("absa_label") == F.col("star_label")).cast("int")), 4).alias("agreement"),
        F.round(F.avg(error), 4).alias("mae"),
    )


def star_agreement_by_rating(rows: DataFrame) -> DataFrame:
    """Buckets round half to even."""
    return rows.groupBy(F.bround("rating", 0).cast("int").alias("stars")).agg(F.count("*").alias("reviews"), F.round(F.avg("absa"), 4).alias("mean_absa"))


def rated_items(feedback: DataFrame) -> DataFrame:
    """One row per rated item of a session: ``session_id, rank, satisfaction`` (items lacking either are dropped)."""
    item = F.explode("phone_ratings").alias("i")
    return feedback.select("session_id", item).select("session_id", F.col("i.rank").alias("rank"), F.col("i.satisfaction").alias("satisfaction")).where("rank IS NOT NULL AND satisfaction IS NOT NULL")


def ndcg_at_k(items: DataFrame, k: int = 3) -> DataFrame:
    """``session_id, ndcg`` with gain 2^rel - 1 and discount log2(position + 1); ideal order over the full list."""
    system = Window.partitionBy("session_id").orderBy("rank", F.desc("satisfaction"))
    ideal = Window.partitionBy("session_id").orderBy(F.desc("satisfaction"))
    gain = F.pow(F.lit(2.0), F.col("satisfaction")) - 1
    placed = items.withColumn("i", F.row_number().over(system)).withColumn("j", F.row_number().over(ideal))
    part = lambda c: F.sum(F.when(F.col(c) <= k, gain / F.log2(F.col(c) + F.lit(1.0))).otherwise(0.0))
    sums = placed.groupBy("session_id").agg(part("i").alias("dcg"), part("j").alias("idcg"))
    return sums.select("session_id", F.round(F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg")).otherwise(0.0), 4).alias("ndcg"))


def spearman(items: DataFrame, min_items: int = 3) -> DataFrame:
    """``session_id, spearman``: system ranks against average ranks of satisfaction (higher is better).

    Null with fewer than ``min_items`` items or without variance.
    """
    by_value = Window.partitionBy("session_id").orderBy(F.desc("satisfaction"))
    ties = Window.partitionBy("session_id", "satisfaction")
    ranks = items.withColumn("avg_rank", F.rank().over(by_value) + (F.count("*").over(ties) - 1) / 2)
    x, y = F.col("rank").cast("double"), F.col("avg_rank").cast("double")
    sums = {"n": F.count("*"), "sx": F.sum(x), "sy": F.sum(y), "xy": F.sum(x * y), "xx": F.sum(x * x), "yy": F.sum(y * y)}
    got = ranks.groupBy("session_id").agg(*(v.alias(k) for k, v in sums.items()))
    # ranks are multiples of a half, so these sums are exact and a zero variance is exactly zero
    spread = (F.col("n") * F.col("xx") - F.col("sx") ** 2) * (F.col("n") * F.col("yy") - F.col("sy") ** 2)
    c = F.try_divide(F.col("n") * F.col("xy") - F.col("sx") * F.col("sy"), F.sqrt(spread))
    return got.select("session_id", F.when(F.col("n") >= min_items, F.round(c, 4) + 0.0).alias("spearman"))  # minus zero is zero


def session_satisfaction(items: DataFrame) -> DataFrame:
    """Mean satisfaction rounded half to even, within 1..5."""
    mean = F.bround(F.avg("satisfaction"), 0)
    return items.groupBy("session_id").agg(F.least(F.lit(5), F.greatest(F.lit(1), mean.cast("int"))).alias("satisfaction"))


def satisfaction_distribution(items: DataFrame) -> DataFrame:
    """Counts for 1..5, zero-filled."""
    grid = items.sparkSession.range(1, 6).select(F.col("id").cast("int").alias("satisfaction"))
    counts = items.groupBy(F.col("satisfaction").cast("int").alias("satisfaction")).agg(F.count("*").alias("n"))
    return grid.join(counts, "satisfaction", "left").select("satisfaction", F.coalesce("n", F.lit(0)).alias("n"))


def satisfaction_by_rank(items: DataFrame) -> DataFrame:
    return items.groupBy("rank").agg(F.count("*").alias("n"), F.round(F.avg("satisfaction"), 3).alias("mean_satisfaction"))


def feedback_summary(items: DataFrame) -> DataFrame:
    top = F.col("rank") == 1
    return items.agg(
        F.count("*").alias("ratings"),
        F.round(F.avg("satisfaction"), 3).alias("mean_satisfaction"),
        F.round(F.avg(F.when(top, F.col("satisfaction"))), 3).alias("top1_mean"),
        F.round(F.avg((F.col("satisfaction") >= 4).cast("int")), 4).alias("share_satisfied"),
    )


def session_stats(items: DataFrame, high: int = 4) -> DataFrame:
    """Per session: rated items, their mean (2 places) and how many are rated ``high`` or more."""
    return items.groupBy("session_id").agg(F.count("*").alias("items"), F.round(F.avg("satisfaction"), 2).alias("mean"), F.count_if(F.col("satisfaction") >= high).alias("high"))


def ranking_quality(ndcg: DataFrame, rho: DataFrame) -> DataFrame:
    """One row over all sessions: mean NDCG and Spearman (4 places), the sessions behind them, and the band of the former."""
    mean = ndcg.agg(F.round(F.avg("ndcg"), 4).alias("mean_ndcg"), F.count("ndcg").alias("ndcg_sessions"))
    other = rho.agg(F.round(F.avg("spearman"), 4).alias("mean_spearman"), F.count("spearman").alias("spearman_sessions"))
    band = F.when(F.col("mean_ndcg") >= 0.85, "strong").when(F.col("mean_ndcg") >= 0.6, "moderate").when(F.col("mean_ndcg").isNotNull(), "weak").otherwise("none yet")
    return mean.crossJoin(F.broadcast(other)).withColumn("note", band)


def method_slices(sessions: DataFrame, ndcg: DataFrame) -> DataFrame:
    """``sessions``: session_id, ranking_method, satisfaction.  A null method counts as weighted."""
    joined = sessions.join(ndcg, "session_id", "left")
    return joined.groupBy(F.coalesce("ranking_method", F.lit("weighted")).alias("method")).agg(F.count("*").alias("sessions"), F.round(F.avg("satisfaction"), 3).alias("mean_satisfaction"), F.round(F.avg("ndcg"), 4).alias("mean_ndcg"))


def verdict(mean):
    """Band of a mean satisfaction."""
    return F.when(mean >= 4, "satisfied").when(mean >= 3, "mixed").when(mean.isNotNull(), "dissatisfied")


def confusion(labelled: DataFrame, classes: Sequence[str]) -> DataFrame:
    """``gold, predicted, n`` over the full grid of classes; other labels are skipped."""
    spark = labelled.sparkSession
    grid = spark.createDataFrame([(g, p) for g in classes for p in classes], "gold string, predicted string")
    counts = labelled.where(F.col("gold").isin(*classes) & F.col("predicted").isin(*classes)).groupBy("gold", "predicted").agg(F.count("*").alias("n"))
    return grid.join(counts, ["gold", "predicted"], "left").select("gold", "predicted", F.coalesce("n", F.lit(0)).alias("n"))


def precision_recall(matrix: DataFrame) -> DataFrame:
    """Per class: precision, recall, F1 (4 places, 0 for an empty denominator), support."""
    hit = F.col("gold") == F.col("predicted")
    by_gold = matrix.groupBy(F.col("gold").alias("label")).agg(F.sum("n").alias("support"), F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("tp"))
    by_said = matrix.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("said"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    got = by_gold.join(by_said, "label")
    p, r = ratio(F.col("tp"), F.col("said")), ratio(F.col("tp"), F.col("support"))
    f1 = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    return got.select("label", F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(f1, 4).alias("f1"), "support")


def macro_f1(per_class: DataFrame, matrix: DataFrame) -> DataFrame:
    """Mean of the rounded F1s, and accuracy."""
    accuracy = matrix.agg(F.round(F.sum(F.when(F.col("gold") == F.col("predicted"), F.col("n")).otherwise(0)) / F.sum("n"), 4).alias("accuracy"))
    return per_class.agg(F.round(F.avg("f1"), 4).alias("macro_f1")).crossJoin(F.broadcast(accuracy))
