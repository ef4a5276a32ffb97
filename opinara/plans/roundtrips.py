"""Readers, sinks and streams: tables are written in a file format and read back by the engine's readers.

The files go below ``spark.checkpoint.dir``; only a local session without it uses a temporary folder.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinara.config import EngineConfig
from opinara.plans import relational, textual, views, workflow
from opinara.sources import files, sinks
from opinara.streaming import reviews as stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def _folder(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="opinara-files-")
    return f"{root.rstrip('/')}/files-{uuid.uuid4().hex}"


_QUOTED = "'He said \"no\", twice' || chr(10) || 'line ' || o_orderkey"


def _quoted():
    return F.concat(F.lit('He said "no", twice\nline '), F.col("o_orderkey").cast("string"))


@query(f"SELECT 'K' || o_custkey AS asin, {_QUOTED} AS review_comment, CASE WHEN o_orderkey % 3 > 0 THEN 'T' || o_orderkey END AS review_title, CAST(o_custkey AS DOUBLE) / 2 AS product_avg_rating, CAST(NULL AS VARCHAR) AS availability FROM orders")
def review_csv_scan(spark, sf_dir):
    path = _folder(spark)
    k = F.col("o_orderkey").cast("string")
    rows = views.table(spark, sf_dir, "orders").select(
        _quoted().alias("review_comment"), F.lit("x").alias("further"), F.concat(F.lit("K"), F.col("o_custkey").cast("string")).alias("asin"), F.lit("P").alias("product_title"), F.when(F.col("o_orderkey") % 3 > 0, F.concat(F.lit("T"), k)).alias("review_title"), (F.col("o_custkey") / 2).alias("product_avg_rating")
    )
    rows.write.option("header", True).option("escape", '"').csv(path)
    return files.review_csv(spark, path).select("asin", "review_comment", "review_title", "product_avg_rating", "availability")


@query("SELECT 'K' || o_custkey AS asin, epoch_ms(o_orderdate) AS timestamp, CASE WHEN o_orderkey % 2 = 0 THEN 'é \"' || o_orderkey END AS text, o_orderkey % 3 = 0 AS verified_purchase FROM orders")
def review_jsonl_scan(spark, sf_dir):
    path = _folder(spark)
    k = F.col("o_orderkey")
    rows = views.table(spark, sf_dir, "orders").select(
        F.concat(F.lit("K"), F.col("o_custkey").cast("string")).alias("asin"), (F.unix_timestamp(F.col("o_orderdate").cast("timestamp")) * 1000).alias("timestamp"), F.when(k % 2 == 0, F.concat(F.lit('é "'), k.cast("string"))).alias("text"), (k % 3 == 0).alias("verified_purchase"), F.lit(1).alias("further")
    )
    sinks.jsonl(rows, path)
    return files.review_jsonl(spark, path).select("asin", "timestamp", "text", "verified_purchase")


@query("SELECT 'A' || p_partkey AS parent_asin, p_name AS title, CAST(p_size AS BIGINT) AS rating_number, 'b' || p_size AS bullet FROM part")
def metadata_scan(spark, sf_dir):
    path = _folder(spark)
    rows = views.table(spark, sf_dir, "part").select(F.concat(F.lit("A"), F.col("p_partkey").cast("string")).alias("parent_asin"), F.col("p_name").alias("title"), F.col("p_size").cast("long").alias("rating_number"), F.array(F.concat(F.lit("b"), F.col("p_size").cast("string"))).alias("features"))
    rows.write.parquet(path)
    return files.metadata(spark, path).select("parent_asin", "title", "rating_number", F.col("features")[0].alias("bullet"))


@query("SELECT 'A' || p_partkey AS id, count(o_orderkey) AS reviews FROM part LEFT JOIN orders ON o_custkey = p_partkey GROUP BY 1")
def corpus_folder_scan(spark, sf_dir):
    folder = _folder(spark)
    name = lambda c: F.concat(F.lit("A"), F.col(c).cast("string"))
    sinks.jsonl(views.table(spark, sf_dir, "part").select(name("p_partkey").alias("source_product_id"), F.col("p_name").alias("raw_title")), f"{folder}/phones.jsonl")
    sinks.jsonl(views.table(spark, sf_dir, "orders").select(name("o_custkey").alias("parent_asin"), F.lit("b").alias("body")), f"{folder}/reviews.jsonl")
    phones, reviews = files.corpus_folder(spark, folder)
    return phones.select(F.col("source_product_id").alias("id")).join(reviews.select(F.col("parent_asin").alias("id"), F.lit(1).alias("one")), "id", "left").groupBy("id").agg(F.count("one").alias("reviews"))


@query(f"WITH {workflow._CANDIDATES} SELECT parent_asin, product_name, rating_number FROM candidates")
def candidate_scan(spark, sf_dir):
    path = _folder(spark)
    assert files.candidates(spark, path + "/none.csv").isEmpty()  # an absent file is an empty table
    workflow.workflow.candidate_rows(workflow._catalogue(spark, sf_dir)).write.option("header", True).option("escape", '"').csv(path)
    return files.candidates(spark, path).select("parent_asin", "product_name", "rating_number")


@query("SELECT 'A' || (o_custkey % 50) AS parent_asin, arg_max(o_orderkey, o_orderkey) AS value FROM orders GROUP BY 1")
def last_record_scan(spark, sf_dir):
    path = _folder(spark)
    rows = views.table(spark, sf_dir, "orders").select(F.concat(F.lit("A"), F.col("o_custkey") % 50).alias("parent_asin"), F.col("o_orderkey").alias("value"))
    sinks.jsonl(rows.orderBy("value"), path)
    return files.last_records(spark, path, "parent_asin string, value long")


@query("SELECT doc_id AS sentence_id, CASE WHEN quality = 1 THEN 'positive' ELSE 'negative' END AS gold_sentiment FROM labels WHERE doc_id % 3 > 0")
def gold_label_scan(spark, sf_dir):
    path = _folder(spark)
    k = F.col("doc_id")
    sign = F.when(F.col("quality") == 1, "positive").otherwise("negative")
    rows = views.table(spark, sf_dir, "labels").select(k.alias("sentence_id"), F.lit("battery").alias("aspect"), F.lit("positive").alias("predicted_sentiment"), F.when(k % 3 > 0, sign).when(k % 2 == 0, F.lit("  ")).alias("gold_sentiment"))
    rows.write.option("header", True).csv(path)
    return files.gold_labels(spark, path).select("sentence_id", "gold_sentiment")


@query("SELECT 'orders' AS name, count(*) AS n FROM orders")
def report_scan(spark, sf_dir):
    path = _folder(spark)
    assert files.small_json(spark, path) is None  # an absent report
    sinks.report(spark, {"name": "orders", "n": views.table(spark, sf_dir, "orders").count()}, path)
    found = files.small_json(spark, path)
    return spark.createDataFrame([(found["name"], found["n"])], "name string, n long")


@query("SELECT p_partkey AS product_id, p_name || ', \"x\"' AS name, p_partkey % 2 = 0 AS flag FROM part")
def export_scan(spark, sf_dir):
    """A pack is written as CSV and read back by a plain reader."""
    rows = views.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("product_id"), F.concat("p_name", F.lit(', "x"')).alias("name"), (F.col("p_partkey") % 2 == 0).alias("flag"))
    path = sinks.pack({"parts": rows}, _folder(spark))["parts"]
    back = spark.read.option("header", True).csv(path)
    assert back.columns[0].lstrip("\ufeff") == "product_id"
    return back.toDF("product_id", "name", "flag").select(F.col("product_id").cast("long"), "name", F.col("flag").cast("boolean"))


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'P' UNION ALL SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'O'")
def table_sinks(spark, sf_dir):
    """A table that was replaced, then appended to."""
    path = _folder(spark)
    orders = views.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    sinks.append(orders, path)
    sinks.replace(spark.read.parquet(path).where("o_orderstatus <> 'P'"), path)
    sinks.append(orders.where("o_orderstatus = 'O'"), path)
    return spark.read.parquet(path)


_ARRIVED = f"""WITH reviews AS ({views.REVIEWS}), texts AS ({textual.REVIEW_TEXTS}), firsts AS (SELECT min(review_id) AS review_id FROM texts GROUP BY product_id, body),
  {textual._SENTENCES.replace('mentions AS (', 'told AS (', 1)}, mentions AS (SELECT * FROM told WHERE review_id IN (SELECT review_id FROM firsts))"""


def _streamed(spark: SparkSession, sf_dir: str) -> str:
    """The synthetic reviews as files of a stream, in two arrivals of which the second repeats a part of the first."""
    folder = _folder(spark)
    rows = textual.review_texts(spark, sf_dir).select("review_id", "product_id", F.lit("").alias("title"), "body", "rating", F.timestamp_seconds(F.col("review_id") + 1_700_000_000).alias("arrival"))
    cfg = EngineConfig(language_filter=None)
    middle = rows.agg(F.max("review_id")).first()[0] // 2
    for part in (rows.where(F.col("review_id") <= middle), rows.where((F.col("review_id") > middle) | (F.col("review_id") % 10 == 0))):
        part.write.mode("append").json(f"{folder}/in")
        stream.start(spark, f"{folder}/in", f"{folder}/store", cfg).awaitTermination()
    return f"{folder}/store"


@query(f"{_ARRIVED}, {relational._SCORES} SELECT * FROM scores")
def stream_scores(spark, sf_dir):
    return stream.current_scores(spark, _streamed(spark, sf_dir))


@query(
    f"""{_ARRIVED} SELECT strftime(to_timestamp(review_id + 1700000000) AT TIME ZONE 'UTC', '%Y-%m-%d') AS day, aspect, sentiment, count(*) AS n FROM mentions GROUP BY 1, 2, 3"""
)
def mention_windows(spark, sf_dir):
    mentions = textual.QUERIES["absa_lexicon"](spark, sf_dir)
    firsts = textual.review_texts(spark, sf_dir).groupBy("product_id", "body").agg(F.min("review_id").alias("review_id")).select("review_id")
    at = mentions.join(firsts, "review_id", "left_semi").withColumn("arrival", F.timestamp_seconds(F.col("review_id") + 1_700_000_000))
    return stream.mention_windows(at).select(F.date_format("start", "yyyy-MM-dd").alias("day"), "aspect", "sentiment", "n")


@query(f"{_ARRIVED} SELECT count(*) AS mentions, count(DISTINCT review_id) AS reviews FROM mentions")
def stream_is_idempotent(spark, sf_dir):
    """A batch that is run again replaces its own output."""
    store = _streamed(spark, sf_dir)
    again = spark.read.parquet(f"{store}/reviews").where("batch = 0").drop("batch", "cleaned_body", "content_hash", "language", "is_spam", "excluded_reason", "usable", "is_duplicate")
    stream.ingest_batch(again, 0, store, EngineConfig(language_filter=None))
    return spark.read.parquet(f"{store}/mentions").agg(F.count("*").alias("mentions"), F.countDistinct("review_id").alias("reviews"))
