"""Live reviews to scores: a file stream, idempotent ingest, stage tables, recomputed scores.

Each micro-batch is cleaned, freed of (product, hash) pairs that are stored already, segmented and annotated;
its rows are appended under the batch's number, so a batch that is run again replaces its own output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from opinara.config import EngineConfig
from opinara.functions import annotating
from opinara.operators import pipeline, scores

SCHEMA = "review_id long, product_id long, title string, body string, rating double, arrival timestamp"


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], schema)
    return spark.read.parquet(path)


#: The stored keys lie in so many folders by hash: a batch reads those that its own keys fall into.
BUCKETS = 64


def ingest_batch(batch: DataFrame, number: int, store: str, cfg: EngineConfig = EngineConfig(), make: Callable[[], annotating.Engine] | None = None) -> None:
    spark = batch.sparkSession
    staged = f"{store}/staged/batch={number}"
    pipeline.clean_reviews(batch, cfg).withColumn("bucket", F.pmod(F.xxhash64("product_id", "content_hash"), F.lit(BUCKETS)).cast("int")).write.mode("overwrite").parquet(staged)
    cleaned = spark.read.parquet(staged)
    touched = [r["bucket"] for r in cleaned.select("bucket").distinct().collect()]  # at most BUCKETS
    known = _stored(spark, f"{store}/keys", "product_id long, content_hash string, batch long, bucket int")
    known = known.where((F.col("batch") != number) & F.col("bucket").isin(*touched)).select("product_id", "content_hash")
    fresh = cleaned.join(known, ["product_id", "content_hash"], "left_anti")
    fresh.drop("bucket").write.mode("overwrite").parquet(f"{store}/reviews/batch={number}")
    stored = spark.read.parquet(f"{store}/reviews/batch={number}")
    keys = stored.select("product_id", "content_hash", F.pmod(F.xxhash64("product_id", "content_hash"), F.lit(BUCKETS)).cast("int").alias("bucket"))
    keys.write.mode("overwrite").partitionBy("bucket").parquet(f"{store}/keys/batch={number}")
    made = pipeline.analyse(stored, cfg, make, stop_after="mentions")
    made.mentions.write.mode("overwrite").parquet(f"{store}/mentions/batch={number}")


def start(spark: SparkSession, source: str, store: str, cfg: EngineConfig = EngineConfig(), files_per_trigger: int = 100, make: Callable[[], annotating.Engine] | None = None) -> StreamingQuery:
    """Process what is there (``availableNow``); run again for what has arrived since."""
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).json(source)
    writer = stream.writeStream.foreachBatch(lambda df, n: ingest_batch(df, n, store, cfg, make))
    return writer.option("checkpointLocation", f"{store}/_checkpoint").trigger(availableNow=True).start()


def current_scores(spark: SparkSession, store: str, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """Scores over all mentions stored so far."""
    return scores.aspect_scores(spark.read.parquet(f"{store}/mentions"), cfg)


def mention_windows(mentions: DataFrame, every: str = "1 day", late: str = "2 days", at: str = "arrival") -> DataFrame:
    """Sentiment counts per window of event time, for streams (watermarked) and tables alike."""
    rows = mentions.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return rows.groupBy(F.window(at, every).alias("w"), "aspect", "sentiment").agg(F.count("*").alias("n")).select("w.start", "aspect", "sentiment", "n")
