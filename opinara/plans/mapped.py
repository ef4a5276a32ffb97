"""Row mappers, small parsers and corpus selections over whole tables, with inputs written from their columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinara.functions import parsing, products, taxonomy
from opinara.operators import corpus, metrics, pipeline
from opinara.plans import views, workflow
from opinara.plans.parsed import _MAKER_SQL, _asin, _ASIN_SQL, _maker, _style
from opinara.plans.views import with_views
from opinara.sources import files, mappers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def _shaped(rows: DataFrame, schema: str) -> DataFrame:
    """``rows`` with every column of a file's schema, null where they lack it."""
    kinds = rows.sparkSession.createDataFrame([], schema).dtypes
    kept = [c for c in rows.columns if c not in dict(kinds)]
    return rows.select(*((F.col(c).cast(t) if c in rows.columns else F.lit(None).cast(t)).alias(c) for c, t in kinds), *kept)


_NO_COLOUR = "trim(regexp_replace(regexp_replace(p_name, '(?i)\\b(black|white|blue|green|red|gold|silver|grey|gray|purple|pink|yellow|orange)\\b', ' ', 'g'), '\\s+', ' ', 'g'))"


@query(
    f"""SELECT {_ASIN_SQL} AS source_product_id, {_MAKER_SQL} || ' ' || p_name || ', 128GB' AS raw_title, {_MAKER_SQL} AS brand, {_NO_COLOUR} AS model, {_MAKER_SQL} || ' ' || {_NO_COLOUR} AS canonical_name, round(CAST(p_retailprice AS DOUBLE), 2) AS price,
  CASE WHEN p_partkey % 2 = 0 THEN 'EUR' ELSE 'USD' END AS currency, CASE p_partkey % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 END AS categories FROM part"""
)
def csv_product_rows(spark, sf_dir):
    k = F.col("p_partkey")
    title = F.concat(_maker(), F.lit(" "), "p_name", F.lit(", 128GB"))
    first = views.table(spark, sf_dir, "part").select(
        F.concat(F.lit(" "), F.lower(_asin())).alias("asin"),
        F.when(k % 4 > 0, title).alias("product_title"),
        title.alias("product_name"),
        F.when(k % 2 == 0, F.lit("Tmobile")).otherwise(_maker()).alias("brand"),
        F.concat(F.lit("$"), F.format_number(F.col("p_retailprice").cast("double"), 2)).alias("price"),
        F.when(k % 2 == 0, F.lit(" eur")).otherwise(F.lit(" ")).alias("currency"),
        _style(k, "['A', 'B']", "Phones", " ").alias("categories"),
        (k * 2).alias("row_id"),
    )
    second = first.withColumns({"asin": F.upper(F.trim("asin")), "product_title": F.lit("later row"), "product_name": F.lit("later row"), "row_id": F.col("row_id") + 1})
    made = mappers.csv_products(_shaped(second.unionAll(first), files.REVIEW_CSV))
    return made.select("source_product_id", "raw_title", "brand", "model", "canonical_name", "price", "currency", F.when(F.col("categories").isNotNull(), F.size("categories")).alias("categories"))


_VERIFIED = "CASE o_orderkey % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true END"


@query(
    f"""SELECT 'K' || o_custkey AS source_product_id, left('K' || o_custkey || ':' || o_orderkey || CASE WHEN o_orderkey % 5 > 0 THEN ':name ' || o_custkey ELSE '' END, 120) AS source_review_id, CASE WHEN o_orderkey % 3 > 0 THEN 'T' || o_orderkey END AS title, 'Body ' || o_orderkey AS body,
  CAST(1 + o_orderkey % 5 AS DOUBLE) AS rating, strftime(o_orderdate, '%Y-%m-%d') AS day, CASE WHEN o_orderkey % 5 > 0 THEN 'name ' || o_custkey END AS reviewer_name, {_VERIFIED} AS verified_purchase FROM orders WHERE o_orderkey % 7 > 0"""
)
def csv_review_rows(spark, sf_dir):
    k, customer = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    rows = views.table(spark, sf_dir, "orders").select(
        F.concat(F.lit(" k"), customer).alias("asin"),
        k.cast("string").alias("review_number"),
        F.when(k % 5 > 0, F.concat(F.lit("name "), customer)).alias("reviewer"),
        F.when(k % 3 > 0, F.concat(F.lit(" T"), k.cast("string"))).otherwise(F.lit(" ")).alias("review_title"),
        F.when(k % 7 > 0, F.concat(F.lit("Body "), k.cast("string"), F.lit(" "))).otherwise(F.lit(" ")).alias("review_comment"),
        (1 + k % 5).cast("string").alias("review_rating"),
        F.date_format("o_orderdate", "MMMM d, yyyy").alias("review_date"),
        _style(k, "Verified", "no", "TRUE", "maybe").alias("verified_purchase"),
        k.alias("row_id"),
    )
    made = mappers.csv_reviews(_shaped(rows, files.REVIEW_CSV))
    return made.select("source_product_id", "source_review_id", "title", "body", "rating", F.date_format("review_date", "yyyy-MM-dd").alias("day"), "reviewer_name", "verified_purchase")


@query(
    f"""SELECT {_ASIN_SQL} AS source_product_id, p_name || ' phone' AS raw_title, {_MAKER_SQL} AS brand, 'Model ' || p_size AS model, CASE p_partkey % 4 WHEN 0 THEN 'hi' WHEN 1 THEN 'large' WHEN 2 THEN 'thumb' END AS image_url,
  CASE WHEN p_partkey % 3 > 0 THEN round(CAST(p_retailprice AS DOUBLE), 2) END AS price, CASE WHEN p_partkey % 3 > 0 THEN 'USD' END AS currency, CAST(p_size AS BIGINT) AS site_rating_count FROM part WHERE p_partkey % 9 > 0"""
)
def metadata_rows(spark, sf_dir):
    k = F.col("p_partkey")
    image = lambda at, name: F.when(k % 4 == at, F.array(F.lit(None).cast("string"), F.lit(""), F.lit(name)))
    rows = views.table(spark, sf_dir, "part").select(
        _asin().alias("parent_asin"),
        F.when(k % 9 > 0, F.concat(F.lit(" "), "p_name", F.lit(" phone "))).otherwise(F.lit(" ")).alias("title"),
        F.col("p_size").cast("long").alias("rating_number"),
        F.when(k % 3 > 0, F.format_number(F.col("p_retailprice").cast("double"), 2)).otherwise(F.lit("—")).alias("price"),
        F.concat(F.lit('{"Brand": "'), _maker(), F.lit('", "Model Name": "Model '), F.col("p_size").cast("string"), F.lit('"}')).alias("details"),
        F.struct(image(0, "hi").alias("hi_res"), image(1, "large").alias("large"), image(2, "thumb").alias("thumb"), F.lit(None).cast("array<string>").alias("variant")).alias("images"),
    )
    made = mappers.metadata_products(_shaped(rows, files.METADATA))
    return made.select("source_product_id", "raw_title", "brand", "model", "image_url", "price", "currency", "site_rating_count")


@query(
    """SELECT coalesce(CASE WHEN o_orderkey % 2 = 0 THEN 'P' || o_custkey END, 'A' || o_custkey) AS source_product_id, CASE WHEN o_orderkey % 3 > 0 THEN 'T' END AS title, 'text ' || o_orderkey AS body, strftime(o_orderdate, '%Y-%m-%d') AS day,
  coalesce(CASE WHEN o_orderkey % 2 = 0 THEN 'P' || o_custkey END, 'A' || o_custkey) || ':U' || o_custkey || ':' || CASE WHEN o_orderkey % 2 = 0 THEN epoch_ms(o_orderdate) ELSE epoch_ms(o_orderdate) // 1000 END AS source_review_id FROM orders WHERE o_orderkey % 6 > 0"""
)
def jsonl_review_rows(spark, sf_dir):
    k, customer = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    seconds = F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))
    rows = views.table(spark, sf_dir, "orders").select(
        F.when(k % 2 == 0, F.concat(F.lit("P"), customer)).otherwise(F.lit("")).alias("parent_asin"),
        F.concat(F.lit("A"), customer).alias("asin"),
        F.concat(F.lit("U"), customer).alias("user_id"),
        F.when(k % 2 == 0, seconds * 1000).otherwise(seconds).alias("timestamp"),
        F.when(k % 3 > 0, F.lit(" T ")).otherwise(F.lit("")).alias("title"),
        F.when(k % 6 > 0, F.concat(F.lit("text "), k.cast("string"), F.lit(" "))).otherwise(F.lit("  ")).alias("text"),
    )
    made = mappers.jsonl_reviews(_shaped(rows, files.REVIEW_JSONL))
    return made.select("source_product_id", "title", "body", F.date_format("review_date", "yyyy-MM-dd").alias("day"), "source_review_id")


@query(
    f"""SELECT o_orderkey, {_VERIFIED} AS verified, CASE WHEN o_orderkey % 3 < 2 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day, CASE o_orderkey % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 END AS items, length(left(repeat('x', CAST(o_orderkey % 200 AS INTEGER)) || ':' || o_custkey, 120)) AS id_length,
  CASE WHEN o_orderkey % 4 > 0 THEN round(CAST(o_orderkey % 4 AS DOUBLE) / (10 + o_orderkey % 4) * 100, 2) END AS discount, CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 5 = 4 THEN 'satisfied' WHEN o_orderkey % 5 = 3 THEN 'mixed' ELSE 'dissatisfied' END AS verdict FROM orders"""
)
def small_parsers(spark, sf_dir):
    k = F.col("o_orderkey")
    iso = F.when(k % 3 == 0, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(k % 3 == 1, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.lit("soon"))
    return views.table(spark, sf_dir, "orders").select(
        "o_orderkey",
        parsing.parse_verified(_style(k, "Verified", "no", "TRUE", "maybe")).alias("verified"),
        F.date_format(parsing.parse_iso(iso), "yyyy-MM-dd").alias("day"),
        F.size(parsing.parse_categories(_style(k, '["a", "b"]', "plain", ""))).alias("_items"),
        F.length(parsing.surrogate_id(F.repeat(F.lit("x"), (k % 200).cast("int")), F.col("o_custkey").cast("string"))).cast("long").alias("id_length"),
        parsing.discount_percent(F.lit(10.0), 10.0 + (k % 4)).alias("discount"),
        metrics.verdict(F.when(k % 5 > 0, k % 5)).alias("verdict"),
    ).select("o_orderkey", "verified", "day", F.when(F.col("_items") > 0, F.col("_items")).alias("items"), "id_length", "discount", "verdict")


@query(f"WITH {workflow._CATALOGUE} SELECT source_product_id, coalesce(nullif(canonical_name, ''), nullif(raw_title, ''), 'demo:' || source_product_id) AS shown FROM (SELECT * REPLACE (CASE WHEN site_rating_count IS NULL THEN '' ELSE raw_title END AS raw_title) FROM catalogue)")
def display_names(spark, sf_dir):
    rows = workflow._catalogue(spark, sf_dir).withColumns({"source": F.lit("demo"), "raw_title": F.when(F.col("site_rating_count").isNull(), F.lit("")).otherwise(F.col("raw_title"))})
    return rows.select("source_product_id", corpus.display_name().alias("shown"))


@query(with_views("SELECT 'all' AS state, count(*) AS n FROM reviews UNION ALL SELECT 'analysed', count(*) FROM reviews WHERE processed_at IS NOT NULL UNION ALL SELECT 'open', count(*) FROM reviews WHERE processed_at IS NULL"))
def analysed_states(spark, sf_dir):
    reviews = views.reviews(spark, sf_dir)
    count = lambda name, state: corpus.analysed(reviews, state).agg(F.count("*").alias("n")).select(F.lit(name).alias("state"), "n")
    return count("all", None).unionAll(count("analysed", True)).unionAll(count("open", False))


_FILE_REVIEWS = "file_reviews AS (SELECT 'B' || lpad(CAST(o_custkey % (SELECT count(*) FROM part) AS VARCHAR), 9, '0') AS source_product_id, o_orderkey % 3 = 0 AS usable FROM orders WHERE o_orderkey % 2 = 0)"


def _file_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = views.table(spark, sf_dir, "part").agg(F.count("*").alias("n"))  # one row
    rows = views.table(spark, sf_dir, "orders").where("o_orderkey % 2 = 0").crossJoin(F.broadcast(n))
    return rows.select(F.concat(F.lit("B"), F.lpad((F.col("o_custkey") % F.col("n")).cast("string"), 9, "0")).alias("source_product_id"), (F.col("o_orderkey") % 3 == 0).alias("usable"))


@query(
    f"""WITH {workflow._CATALOGUE}, {_FILE_REVIEWS}, c AS (SELECT source_product_id, count(*) AS n FROM file_reviews GROUP BY 1) SELECT source_product_id, site_rating_count, site_rating FROM catalogue JOIN c USING (source_product_id) WHERE n >= 3
  ORDER BY site_rating_count DESC NULLS LAST, site_rating DESC NULLS LAST, source_product_id LIMIT 60"""
)
def product_selection(spark, sf_dir):
    chosen = pipeline.select_products(_file_reviews(spark, sf_dir), workflow._catalogue(spark, sf_dir), min_reviews=3, most=60)
    return chosen.select("source_product_id", "site_rating_count", "site_rating")


@query(f"WITH {workflow._CATALOGUE}, {_FILE_REVIEWS}, c AS (SELECT source_product_id, count(*) AS review_count_raw, count(*) FILTER (usable) AS review_count_usable FROM file_reviews GROUP BY 1) SELECT source_product_id, review_count_raw, review_count_usable FROM catalogue JOIN c USING (source_product_id) WHERE review_count_usable > 0")
def enriched_products(spark, sf_dir):
    return pipeline.enriched(workflow._catalogue(spark, sf_dir), _file_reviews(spark, sf_dir)).select("source_product_id", "review_count_raw", "review_count_usable")


@query(f"WITH {workflow._CATALOGUE}, {_FILE_REVIEWS} SELECT (SELECT count(*) FROM catalogue) AS products, count(*) AS reviews, count(*) FILTER (usable) AS usable FROM file_reviews")
def corpus_manifest(spark, sf_dir):
    return pipeline.manifest(workflow._catalogue(spark, sf_dir), _file_reviews(spark, sf_dir))


@query(f"WITH {workflow._CATALOGUE} SELECT source_product_id, site_rating_count IS NULL OR site_rating_count >= 20 AS counted, regexp_matches(lower(concat_ws(' ', brand, raw_title)), 'brand#1|widget') AS branded, CAST(substr(source_product_id, 2) AS BIGINT) % 2 = 0 AS valid FROM catalogue")
def listing_filters(spark, sf_dir):
    rows = workflow._catalogue(spark, sf_dir)
    asin = F.when(F.substring("source_product_id", 2, 9).cast("long") % 2 == 0, F.concat(F.lit(" "), F.lower("source_product_id"))).otherwise(F.concat("source_product_id", F.lit("-")))
    return rows.select(
        "source_product_id",
        products.min_count(F.col("site_rating_count"), 20).alias("counted"),
        products.brand_or_title(F.col("brand"), F.col("raw_title"), [" Brand#1", "WIDGET"]).alias("branded"),
        products.valid_asin(asin).alias("valid"),
    )


@query(with_views("SELECT aspect, count(*) AS mentions FROM mentions WHERE aspect IN ('battery', 'camera', 'display', 'performance', 'design', 'price') AND product_id % 3 = 0 GROUP BY 1"))
def allowed_mentions(spark, sf_dir):
    chosen = corpus.by_ids(views.mentions(spark, sf_dir).withColumn("rest", F.col("product_id") % 3), "rest", [0])
    return chosen.where(F.col("aspect").isin(*taxonomy.taxonomy("core").aspects)).groupBy("aspect").agg(F.count("*").alias("mentions"))
