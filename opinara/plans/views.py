"""Review-shaped views of the standard tables, as DataFrames and as the same SQL for DuckDB.

The tables have no reviews: labels come from line items, products from parts, review heads from orders,
feedback sessions from events and gold labels from ``labels``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ASPECTS = ("battery", "camera", "display", "performance", "design", "price")
#: Weights of the headline ranking.
WEIGHTS = {"camera": 0.2, "battery": 0.2, "display": 0.15, "performance": 0.15, "design": 0.1, "price": 0.2}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """A table of fewer files than cores dealt over all cores, for work that costs more than moving the rows.

    A file of one row group is read by one task, however large; a table of many files stays as it lies.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if len(df.inputFiles()) < cores else df


def _pick(values, index):
    """``values[index]`` as a literal array lookup."""
    return F.element_at(F.array(*(F.lit(v) for v in values)), (index + 1).cast("int"))


def _sql_list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_partkey").alias("product_id"),
        F.col("l_orderkey").alias("review_id"),
        _pick(ASPECTS, F.col("l_linenumber") % 6).alias("aspect"),
        F.when(F.col("l_returnflag") == "A", "positive").when(F.col("l_returnflag") == "R", "negative").otherwise("neutral").alias("sentiment"),
        F.when(F.col("l_linestatus") == "O", "lexicon").otherwise("annotator").alias("method"),
    )


MENTIONS = f"""SELECT l_partkey AS product_id, l_orderkey AS review_id, {_sql_list(ASPECTS)}[1 + l_linenumber % 6] AS aspect,
  CASE l_returnflag WHEN 'A' THEN 'positive' WHEN 'R' THEN 'negative' ELSE 'neutral' END AS sentiment,
  CASE WHEN l_linestatus = 'O' THEN 'lexicon' ELSE 'annotator' END AS method FROM lineitem"""


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_partkey").alias("product_id"),
        F.col("l_shipdate").alias("observed_at"),
        F.col("l_extendedprice").alias("price"),
        _pick(("USD", "EUR", "INR"), F.col("l_suppkey") % 3).alias("currency"),
        F.when(F.col("l_linestatus") == "O", "In Stock").otherwise("Out of Stock").alias("availability"),
    )


PRICES = """SELECT l_partkey AS product_id, l_shipdate AS observed_at, l_extendedprice AS price, ['USD', 'EUR', 'INR'][1 + l_suppkey % 3] AS currency,
  CASE WHEN l_linestatus = 'O' THEN 'In Stock' ELSE 'Out of Stock' END AS availability FROM lineitem"""


def part_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("product_id"), F.col("p_retailprice").alias("price"), F.col("p_type").alias("currency"))


PART_PRICES = "SELECT p_partkey AS product_id, p_retailprice AS price, p_type AS currency FROM part"


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review heads: ids, product, rating, state."""
    n = F.broadcast(table(spark, sf_dir, "part").agg(F.count("*").alias("n")))  # one row
    k = F.col("o_orderkey")
    return (
        table(spark, sf_dir, "orders")
        .crossJoin(n)
        .select(
            k.alias("review_id"),
            (k % F.col("n")).alias("product_id"),
            (1 + (k * 7) % 5).cast("double").alias("rating"),
            (F.col("o_custkey") % 40).cast("int").alias("helpful_votes"),
            (k % 17 == 0).alias("is_spam"),
            (k % 23 == 0).alias("is_duplicate"),
            F.when(k % 11 == 0, F.lit("too_short")).when(k % 13 == 0, F.lit("language_filtered")).alias("excluded_reason"),
            F.when(F.col("o_orderstatus") != "O", F.col("o_orderdate")).alias("processed_at"),
        )
    )


REVIEWS = """SELECT o_orderkey AS review_id, o_orderkey % (SELECT count(*) FROM part) AS product_id, CAST(1 + (o_orderkey * 7) % 5 AS DOUBLE) AS rating,
  CAST(o_custkey % 40 AS INTEGER) AS helpful_votes, o_orderkey % 17 = 0 AS is_spam, o_orderkey % 23 = 0 AS is_duplicate,
  CASE WHEN o_orderkey % 11 = 0 THEN 'too_short' WHEN o_orderkey % 13 = 0 THEN 'language_filtered' END AS excluded_reason,
  CASE WHEN o_orderstatus <> 'O' THEN o_orderdate END AS processed_at FROM orders"""


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with their review count and star rating."""
    counts = reviews(spark, sf_dir).groupBy("product_id").agg(F.count("*").alias("review_count"), F.round(F.avg("rating"), 4).alias("site_rating"))
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("product_id"), F.col("p_brand").alias("brand"), F.col("p_name").alias("name"), F.col("p_type").alias("type"), F.col("p_retailprice").alias("price"), F.col("p_size").alias("size"))
    return p.join(counts, "product_id", "left").withColumn("review_count", F.coalesce("review_count", F.lit(0))).withColumn("site_rating_count", F.col("review_count"))


PRODUCTS = """SELECT p.p_partkey AS product_id, p.p_brand AS brand, p.p_name AS name, p.p_type AS type, p.p_retailprice AS price, p.p_size AS size,
  coalesce(c.review_count, 0) AS review_count, c.site_rating AS site_rating, coalesce(c.review_count, 0) AS site_rating_count
  FROM part p LEFT JOIN (SELECT product_id, count(*) AS review_count, round(avg(rating), 4) AS site_rating FROM reviews GROUP BY 1) c ON c.product_id = p.p_partkey"""


def feedback_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rated items: a session is a user's day, ranks follow the event ids."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events")
    session = F.concat_ws("-", F.col("user_id").cast("string"), F.date_format("ts", "yyyyMMdd"))
    rows = e.select(session.alias("session_id"), "event_id", (1 + F.col("event_id") % 5).cast("int").alias("satisfaction"), "event_type")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("session_id").orderBy("event_id")))


ITEMS = """SELECT CAST(user_id AS VARCHAR) || '-' || strftime(ts, '%Y%m%d') AS session_id, event_id, CAST(1 + event_id % 5 AS INTEGER) AS satisfaction, event_type,
  row_number() OVER (PARTITION BY CAST(user_id AS VARCHAR) || '-' || strftime(ts, '%Y%m%d') ORDER BY event_id) AS rank FROM events"""


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "labels")
    return x.select(
        F.when(F.col("quality") == 1, "positive").otherwise("negative").alias("gold"),
        F.when(F.col("toxic") == 1, "negative").when(F.col("doc_id") % 3 == 0, "neutral").otherwise("positive").alias("predicted"),
    )


GOLD = """SELECT CASE WHEN quality = 1 THEN 'positive' ELSE 'negative' END AS gold,
  CASE WHEN toxic = 1 THEN 'negative' WHEN doc_id % 3 = 0 THEN 'neutral' ELSE 'positive' END AS predicted FROM labels"""


def with_views(sql: str, **named: str) -> str:
    """Prefix ``sql`` with the views it names."""
    known = {"mentions": MENTIONS, "prices": PRICES, "part_prices": PART_PRICES, "reviews": REVIEWS, "products": PRODUCTS, "items": ITEMS, "gold": GOLD} | named
    import re

    def closure(text: str, found: dict[str, None]) -> None:
        for name, body in known.items():
            if re.search(rf"\b{name}\b", text) and name not in found:
                closure(body.replace(f" AS {name}", ""), found)
                found[name] = None

    used: dict[str, None] = {}
    closure(sql, used)
    return "WITH " + ", ".join(f"{n} AS ({known[n]})" for n in used) + " " + sql if used else sql
