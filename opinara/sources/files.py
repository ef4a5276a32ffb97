"""File readers with explicit schemas (nothing is inferred from the data)."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REVIEW_CSV = (
    "asin string, product_title string, product_name string, brand string, price string, currency string, image_url string, product_url string, product_avg_rating double, reviews_count double, availability string, "
    "seller_name string, categories string, description string, scraped_at string, review_number string, reviewer string, review_rating string, review_title string, review_comment string, review_date string, verified_purchase string"
)
REVIEW_CSV_REQUIRED = ("asin", "product_title", "review_comment")
METADATA = "parent_asin string, title string, average_rating double, rating_number bigint, price string, features array<string>, categories array<string>, details string, images struct<hi_res:array<string>,large:array<string>,thumb:array<string>,variant:array<string>>"
REVIEW_JSONL = "parent_asin string, asin string, user_id string, timestamp bigint, title string, text string, rating double, verified_purchase boolean, helpful_vote int"
PHONES_JSONL = (
    "source string, source_product_id string, product_url string, raw_title string, brand string, model string, canonical_name string, image_url string, site_rating double, site_rating_count bigint, price double, currency string, "
    "specs_raw map<string,string>, feature_bullets array<string>, normalized_specs struct<ram_gb:double,storage_gb:double,display_inches:double,battery_mah:int,rear_camera_mp:double,refresh_rate_hz:int,chipset:string,operating_system:string,release_year:int>, "
    "categories array<string>, review_count_raw int, review_count_usable int"
)
REVIEWS_JSONL = (
    "parent_asin string, source_review_id string, title string, body string, cleaned_body string, content_hash string, rating double, review_date string, reviewer_name string, verified_purchase boolean, helpful_votes int, "
    "language string, is_spam boolean, excluded_reason string, usable boolean"
)
CANDIDATES = "parent_asin string, product_name string, brand string, model string, average_rating double, rating_number bigint, price double"
GOLD = "aspect_sentiment_id bigint, sentence_id bigint, sentence_text string, aspect string, predicted_sentiment string, method string, gold_sentiment string, gold_aspect string, notes string"


def require(columns, needed) -> None:
    missing = [c for c in needed if c not in columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def read_csv(spark: SparkSession, path: str, schema: str, required=(), multi_line: bool = True) -> DataFrame:
    """A CSV by column name; columns that the file lacks are null, its further columns are ignored.

    Quoted cells may hold line breaks, so a file is read by one task; without ``multi_line`` (no cell holds any)
    large files are split.
    """
    options = {"header": True, "multiLine": multi_line, "escape": '"'}
    present = spark.read.options(**options).csv(path).columns  # the header line only
    require(present, required)
    text = spark.read.options(**options).schema(", ".join(f"`{c}` string" for c in present)).csv(path)
    kinds = spark.createDataFrame([], schema).dtypes
    return text.select(*((F.col(f"`{c}`").try_cast(t) if c in present else F.lit(None).cast(t)).alias(c) for c, t in kinds))


def review_csv(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    return read_csv(spark, path, REVIEW_CSV, REVIEW_CSV_REQUIRED, multi_line).withColumn("row_id", F.monotonically_increasing_id())


def metadata(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(METADATA).parquet(path)


def review_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """One record a line; a malformed line fails the read."""
    return spark.read.schema(REVIEW_JSONL).option("mode", "FAILFAST").json(path)


def corpus_folder(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.schema(PHONES_JSONL).json(f"{folder}/phones.jsonl"), spark.read.schema(REVIEWS_JSONL).json(f"{folder}/reviews.jsonl")


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """The candidate table; without a file an empty one."""
    return read_csv(spark, path, CANDIDATES) if _exists(spark, path) else spark.createDataFrame([], CANDIDATES)


def last_records(spark: SparkSession, path: str, schema: str, key: str = "parent_asin") -> DataFrame:
    """JSON lines by key, of which the last line wins; in a folder that of the last file by name.

    Files and their blocks are read in any order, so a line's place is its file, its block and its turn in the block.
    """
    from pyspark.sql import Window

    lines = spark.read.schema(schema).json(path)
    at = lines.metadataColumn("_metadata")
    rows = lines.select("*", at["file_path"].alias("_f"), at["file_block_start"].alias("_b"), F.monotonically_increasing_id().alias("_n"))
    last = Window.partitionBy(key).orderBy(F.desc("_f"), F.desc("_b"), F.desc("_n"))
    return rows.withColumn("_r", F.row_number().over(last)).where("_r = 1").drop("_f", "_b", "_n", "_r")


def gold_labels(spark: SparkSession, path: str) -> DataFrame:
    rows = read_csv(spark, path, GOLD, ("aspect", "predicted_sentiment", "gold_sentiment"))
    return rows.where(F.trim("gold_sentiment") != "")


def small_json(spark: SparkSession, path: str):
    """A one-object file such as a manifest; None where it is missing or unreadable."""
    try:
        rows = spark.read.text(path, wholetext=True).collect()  # one file, one row
        return json.loads(rows[0][0]) if rows else None
    except Exception:  # an absent or broken file counts as none
        return None
