"""Workflow queries: listings, candidates, stored records, counters, packs and rating quality."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinara.operators import metrics, scores, workflow
from opinara.plans import relational, textual, views
from opinara.plans.views import with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


@query(
    with_views(
        """SELECT p.product_id, p.name, l.price AS latest_price, l.currency, coalesce(c.total, 0) AS total, coalesce(c.analysed, 0) AS analysed FROM products p
  LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY observed_at DESC, price DESC, currency DESC NULLS LAST) AS r FROM prices WHERE price IS NOT NULL) WHERE r = 1) l ON l.product_id = p.product_id
  LEFT JOIN (SELECT product_id, count(*) AS total, count(*) FILTER (processed_at IS NOT NULL AND excluded_reason IS NULL) AS analysed FROM reviews GROUP BY 1) c ON c.product_id = p.product_id"""
    )
)
def product_list(spark, sf_dir):
    listed = workflow.product_list(views.products(spark, sf_dir), scores.latest_prices(views.prices(spark, sf_dir)), views.reviews(spark, sf_dir))
    return listed.select("product_id", "name", "latest_price", "currency", "total", "analysed")


@query(
    """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN trim(p_type) ELSE CASE p_partkey % 3 WHEN 0 THEN p_name END END AS description, substr(p_name, 1, 5) AS preview,
  CASE WHEN p_partkey % 5 = 0 THEN 'n/a' ELSE 'USD ' || format('{:,.2f}', round(CAST(p_retailprice AS DOUBLE), 2)) END AS price_text, CASE WHEN p_partkey % 7 = 0 THEN '' ELSE repeat('★', p_size % 6) || repeat('☆', 5 - p_size % 6) END AS stars FROM part"""
)
def product_display(spark, sf_dir):
    k, none = F.col("p_partkey"), F.lit(None)
    text = "map<string,string>"
    specs = F.when(k % 4 == 0, F.create_map(F.lit("description"), F.concat(F.lit(" "), "p_type", F.lit(" ")))).when(k % 4 == 1, F.create_map(F.lit("description"), F.lit(" "))).when(k % 4 == 2, F.create_map(F.lit("color"), F.lit("red"))).otherwise(none.cast(text))
    bullets = F.when(k % 3 == 0, F.array(F.concat("p_name", F.lit(" ")))).when(k % 3 == 1, F.array().cast("array<string>"))
    price = F.when(k % 5 != 0, F.round(F.col("p_retailprice").cast("double"), 2))
    rating = F.when(k % 7 != 0, F.col("p_size") % 6 + F.lit(0.2))
    return views.table(spark, sf_dir, "part").select(
        "p_partkey", workflow.description(specs, bullets).alias("description"), workflow.preview(F.col("p_name"), 5).alias("preview"), workflow.price_text(price, F.lit("USD")).alias("price_text"), workflow.stars(rating).alias("stars")
    )


_DECISION = "CASE WHEN is_spam THEN 'spam' WHEN is_duplicate THEN 'duplicate' WHEN excluded_reason IS NOT NULL THEN excluded_reason ELSE 'kept' END"


@query(with_views(f"SELECT r.review_id, r.product_id, p.brand, p.name AS product_name, {_DECISION} AS decision FROM reviews r LEFT JOIN (SELECT * FROM products WHERE product_id % 5 > 0) p ON p.product_id = r.product_id"))
def review_audit(spark, sf_dir):
    some = views.products(spark, sf_dir).where("product_id % 5 > 0")
    return workflow.audit_rows(views.reviews(spark, sf_dir), some).select("review_id", "product_id", "brand", "product_name", "decision")


def _catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products as stored records: some without a name, brand, model or rating."""
    p = views.table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    return p.select(
        F.concat(F.lit("B"), F.lpad(k.cast("string"), 9, "0")).alias("source_product_id"),
        F.when(k % 3 == 0, F.lit("")).otherwise(F.col("p_name")).alias("canonical_name"),
        F.concat(F.lit("raw "), "p_name").alias("raw_title"),
        F.when(k % 4 == 0, F.lit(None)).otherwise(F.col("p_brand")).alias("brand"),
        F.when(k % 5 == 0, F.lit(None)).otherwise(F.col("p_type")).alias("model"),
        F.when(k % 6 > 0, (F.col("p_size") % 50) / 10).alias("site_rating"),
        F.when(k % 7 > 0, F.col("p_size").cast("long")).alias("site_rating_count"),
        F.col("p_retailprice").cast("double").alias("price"),
    )


_CATALOGUE = """catalogue AS (SELECT 'B' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS source_product_id, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_name END AS canonical_name, 'raw ' || p_name AS raw_title, CASE WHEN p_partkey % 4 > 0 THEN p_brand END AS brand,
  CASE WHEN p_partkey % 5 > 0 THEN p_type END AS model, CASE WHEN p_partkey % 6 > 0 THEN (p_size % 50) / 10 END AS site_rating, CASE WHEN p_partkey % 7 > 0 THEN CAST(p_size AS BIGINT) END AS site_rating_count, CAST(p_retailprice AS DOUBLE) AS price FROM part)"""
_CANDIDATES = _CATALOGUE + ", candidates AS (SELECT source_product_id AS parent_asin, coalesce(nullif(canonical_name, ''), raw_title) AS product_name, coalesce(nullif(brand, ''), 'Unknown') AS brand, coalesce(model, '') AS model, site_rating AS average_rating, site_rating_count AS rating_number, price FROM catalogue)"


@query(f"WITH {_CANDIDATES} SELECT *, row_number() OVER (ORDER BY rating_number DESC NULLS LAST, average_rating DESC NULLS LAST, parent_asin) AS place FROM candidates ORDER BY place LIMIT 100")
def candidate_table(spark, sf_dir):
    """The first hundred candidates, in order."""
    from pyspark.sql import Window

    order = (F.desc_nulls_last("rating_number"), F.desc_nulls_last("average_rating"), "parent_asin")
    return workflow.candidate_rows(_catalogue(spark, sf_dir)).limit(100).withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("long"))  # a hundred rows


@query(f"WITH {_CATALOGUE} SELECT source_product_id, site_rating_count FROM catalogue ORDER BY coalesce(site_rating_count, 0) DESC, source_product_id LIMIT 40")
def most_rated_products(spark, sf_dir):
    return workflow.most_rated(_catalogue(spark, sf_dir), 40).select("source_product_id", "site_rating_count")


@query(f"WITH {_CANDIDATES} SELECT parent_asin, product_name FROM candidates WHERE parent_asin IN (SELECT 'B' || lpad(CAST(l_partkey AS VARCHAR), 9, '0') FROM lineitem WHERE l_quantity > 45)")
def selected_candidates(spark, sf_dir):
    chosen = views.table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.concat(F.lit(" b"), F.lpad(F.col("l_partkey").cast("string"), 9, "0")).alias("parent_asin"))
    candidates = workflow.candidate_rows(_catalogue(spark, sf_dir))
    return workflow.selected(candidates, chosen).select("parent_asin", "product_name")


@query(
    """WITH a AS (SELECT 'K' || (l_partkey % 97) AS asin, 0 AS source, l_orderkey * 10 + l_linenumber AS position FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT 'K' || (o_custkey % 131) AS asin, 1 AS source, o_orderkey AS position FROM orders),
  u AS (SELECT * FROM a UNION ALL SELECT * FROM b) SELECT asin, min(source) AS source, arg_min(position, source * 1000000000000 + position) AS position FROM u GROUP BY 1"""
)
def scrape_targets(spark, sf_dir):
    a = views.table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.concat(F.lit("k"), F.col("l_partkey") % 97).alias("asin"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("position"))
    b = views.table(spark, sf_dir, "orders").select(F.concat(F.lit(" K"), F.col("o_custkey") % 131).alias("asin"), F.col("o_orderkey").alias("position"))
    return workflow.targets(a, b)


@query("SELECT key, CAST(sum(n) AS BIGINT) AS n FROM (SELECT l_returnflag AS key, count(*) AS n FROM lineitem GROUP BY 1 UNION ALL SELECT o_orderstatus, count(*) FROM orders GROUP BY 1) GROUP BY 1")
def merged_counters(spark, sf_dir):
    one = views.table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("key")).agg(F.count("*").alias("n"))
    other = views.table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("key")).agg(F.count("*").alias("n"))
    return workflow.merged_counts(one, other)


_OBSERVED = "observed AS (SELECT l_partkey AS product_id, l_shipdate AS observed_at, l_orderkey * 10 + l_linenumber AS tie, CASE WHEN l_linenumber % 4 > 0 THEN CAST(l_suppkey % 3 AS DOUBLE) END AS price, 'USD' AS currency, CAST(NULL AS VARCHAR) AS availability, l_returnflag <> 'N' AS old FROM lineitem)"


@query(
    f"""WITH {_OBSERVED}, latest AS (SELECT product_id, observed_at, price, 0 AS fresh FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY observed_at DESC, price DESC NULLS LAST) AS r FROM observed WHERE old) WHERE r = 1),
  seen AS (SELECT * FROM latest UNION ALL SELECT product_id, observed_at, price, 1 FROM observed WHERE NOT old AND price IS NOT NULL),
  lagged AS (SELECT *, lag(price) OVER w AS before, row_number() OVER w AS r FROM seen WINDOW w AS (PARTITION BY product_id ORDER BY fresh, observed_at, price)) SELECT product_id, observed_at, price FROM lagged WHERE fresh = 1 AND (r = 1 OR price IS DISTINCT FROM before)"""
)
def price_appends(spark, sf_dir):
    li = views.table(spark, sf_dir, "lineitem")
    rows = li.select(
        F.col("l_partkey").alias("product_id"), F.col("l_shipdate").alias("observed_at"), F.when(F.col("l_linenumber") % 4 > 0, (F.col("l_suppkey") % 3).cast("double")).alias("price"), F.lit("USD").alias("currency"), F.lit(None).cast("string").alias("availability"), "l_returnflag"
    )
    return workflow.price_appends(rows.where("l_returnflag <> 'N'"), rows.where("l_returnflag = 'N'")).select("product_id", "observed_at", "price")


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'done' ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 6 = 0 THEN 100.0 ELSE CAST(o_custkey AS DOUBLE) END AS progress FROM orders")
def patched_jobs(spark, sf_dir):
    k = F.col("o_orderkey")
    stored = views.table(spark, sf_dir, "orders").select(k.alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_custkey").cast("double").alias("progress"))
    patch = views.table(spark, sf_dir, "orders").where("o_orderkey % 3 = 0").select(k.alias("id"), F.lit("done").alias("status"), F.when(k % 6 == 0, F.lit(100.0)).alias("progress"))
    return workflow.patched(stored, patch)


@query("SELECT o_orderkey AS id, o_orderstatus AS status, o_orderdate AS created_at FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 25")
def newest_jobs(spark, sf_dir):
    jobs = views.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("created_at"), F.col("o_orderpriority").alias("job_type"))
    return workflow.newest(jobs, most=25, status="F", job_type=None).select("id", "status", "created_at")


@query("SELECT o_orderkey, o_orderstatus, CAST(NULL AS VARCHAR) AS ranking_method, CAST(NULL AS DOUBLE) AS score FROM orders")
def evolved_table(spark, sf_dir):
    rows = views.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return workflow.evolved(rows, {"o_orderstatus": "string", "ranking_method": "string", "score": "double"})


@query("SELECT l_orderkey AS review_id, l_linenumber AS position FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def forced_reviews(spark, sf_dir):
    sentences = views.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("review_id"), F.col("l_linenumber").alias("position"))
    again = views.table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("review_id"))
    return workflow.without_reviews({"sentences": sentences}, again)["sentences"]


_HASHED = "hashed AS (SELECT o_orderkey AS arrival, o_custkey % 50 AS product_id, CAST(o_orderkey % 17 AS VARCHAR) AS content_hash, CASE WHEN o_orderkey % 11 = 0 THEN 'too_short' END AS excluded_reason, o_orderstatus = 'F' AS old FROM orders)"


@query(
    f"""WITH {_HASHED}, marked AS (SELECT *, row_number() OVER (PARTITION BY product_id, content_hash ORDER BY arrival) = 1 AND NOT EXISTS (SELECT 1 FROM hashed h WHERE h.old AND h.product_id = x.product_id AND h.content_hash = x.content_hash) AS new FROM hashed x WHERE NOT old)
  SELECT count(*) FILTER (new) AS inserted, count(*) FILTER (NOT new) AS duplicate, count(*) FILTER (new AND excluded_reason IS NOT NULL) AS excluded FROM marked"""
)
def ingest_counters(spark, sf_dir):
    k = F.col("o_orderkey")
    rows = views.table(spark, sf_dir, "orders").select(k.alias("arrival"), (F.col("o_custkey") % 50).alias("product_id"), (k % 17).cast("string").alias("content_hash"), F.when(k % 11 == 0, "too_short").alias("excluded_reason"), (F.col("o_orderstatus") == "F").alias("old"))
    return workflow.ingest_counters(rows.where("NOT old"), rows.where("old"))


@query(
    textual._judged(
        """, counts(stage, n) AS (SELECT 'products', count(*) FROM part UNION ALL SELECT 'reviews', count(*) FROM reviews UNION ALL SELECT 'reviews_usable', count(*) FROM reviews WHERE excluded_reason IS NULL AND NOT is_spam
  UNION ALL SELECT 'reviews_analysed', count(*) FROM reviews WHERE processed_at IS NOT NULL UNION ALL SELECT 'sentences', count(*) FROM sentences UNION ALL SELECT 'aspect_rows', count(*) FROM mentions UNION ALL SELECT 'scored_products', count(DISTINCT product_id) FROM mentions) SELECT stage, n FROM counts"""
    )
)
def stage_counts(spark, sf_dir):
    sentences = textual._sentences(spark, sf_dir)
    mentions = textual.QUERIES["absa_lexicon"](spark, sf_dir)
    return workflow.stage_counts(views.table(spark, sf_dir, "part"), views.reviews(spark, sf_dir), sentences, mentions, scores.aspect_scores(mentions))


@query(with_views("SELECT session_id, count(*) AS items, round(avg(satisfaction), 2) AS mean, count(*) FILTER (satisfaction >= 4) AS high FROM items GROUP BY 1"))
def session_stats(spark, sf_dir):
    return metrics.session_stats(views.feedback_items(spark, sf_dir))


@query(
    f"""WITH n AS ({relational.ORACLES['ndcg_sessions']}), s AS ({relational.ORACLES['spearman_sessions']}), a AS (SELECT round(avg(ndcg), 4) AS mean_ndcg, count(ndcg) AS ndcg_sessions FROM n), b AS (SELECT round(avg(spearman), 4) AS mean_spearman, count(spearman) AS spearman_sessions FROM s)
  SELECT *, CASE WHEN mean_ndcg >= 0.85 THEN 'strong' WHEN mean_ndcg >= 0.6 THEN 'moderate' WHEN mean_ndcg IS NOT NULL THEN 'weak' ELSE 'none yet' END AS note FROM a, b"""
)
def ranking_quality(spark, sf_dir):
    items = views.feedback_items(spark, sf_dir)
    return metrics.ranking_quality(metrics.ndcg_at_k(items), metrics.spearman(items))


@query(
    """WITH g AS (SELECT CASE WHEN doc_id % 3 > 0 THEN ['battery', 'camera'][1 + doc_id % 2] END AS gold_aspect, ['battery', 'camera'][1 + doc_id % 5 % 2] AS aspect, quality = 1 AS gold, toxic = 0 AS predicted FROM labels)
  SELECT count(*) AS pairs, round(avg(CASE WHEN gold_aspect = aspect AND gold = predicted THEN 1 ELSE 0 END), 4) AS rate FROM g WHERE gold_aspect IS NOT NULL"""
)
def gold_pairs(spark, sf_dir):
    k = F.col("doc_id")
    name = lambda at: F.when(at == 0, "battery").otherwise("camera")
    sign = lambda c: F.when(c, "positive").otherwise("negative")
    rows = views.table(spark, sf_dir, "labels").select(
        F.when(k % 3 > 0, F.initcap(name(k % 2))).otherwise(F.lit(" ")).alias("gold_aspect"), name(k % 5 % 2).alias("aspect"), sign(F.col("quality") == 1).alias("gold"), sign(F.col("toxic") == 0).alias("predicted")
    )
    return workflow.pair_match(rows)


@query(relational._also(relational._SCORES, "SELECT product_id, aspect, positive_count, negative_count, neutral_count, mention_count, raw_score, score, confidence FROM scores"))
def export_scores(spark, sf_dir):
    return workflow.export_table("scores", scores.aspect_scores(views.mentions(spark, sf_dir)))


@query(with_views("SELECT product_id, review_id, CAST(NULL AS VARCHAR) AS sentence_id, aspect, sentiment, CAST(NULL AS VARCHAR) AS confidence, CAST(NULL AS VARCHAR) AS opinion_term, method, CAST(NULL AS VARCHAR) AS model_name FROM mentions"))
def export_mentions(spark, sf_dir):
    return workflow.export_table("mentions", views.mentions(spark, sf_dir))


def _evidence(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    mentions = textual.QUERIES["absa_lexicon"](spark, sf_dir)
    return workflow.evidence(views.reviews(spark, sf_dir), views.products(spark, sf_dir), textual._sentences(spark, sf_dir), mentions, scores.aspect_scores(mentions))


@query(with_views(f"SELECT {_DECISION} AS decision, count(*) AS n FROM reviews GROUP BY 1"))
def evidence_exclusions(spark, sf_dir):
    return _evidence(spark, sf_dir)["05_exclusions"]


@query(textual._judged("SELECT aspect, sentiment, count(*) AS n FROM mentions GROUP BY 1, 2"))
def evidence_sentiments(spark, sf_dir):
    return _evidence(spark, sf_dir)["08_aspect_sentiments"]


@query(with_views(f"SELECT r.review_id, p.name AS product_name FROM reviews r LEFT JOIN products p ON p.product_id = r.product_id WHERE {_DECISION} = 'kept'"))
def evidence_kept(spark, sf_dir):
    return _evidence(spark, sf_dir)["04_reviews_kept"].select("review_id", "product_name")


@query(textual._judged("SELECT review_id * 1000 + position AS sentence_id, text AS sentence_text, aspect, sentiment AS predicted_sentiment, '' AS gold_sentiment, aspect AS gold_aspect FROM sentences JOIN mentions USING (review_id, product_id, position)"))
def gold_template(spark, sf_dir):
    rows = textual._sentences(spark, sf_dir).withColumn("sentence_id", F.col("review_id") * 1000 + F.col("position"))
    from opinara.functions import annotating

    # the text travels with its mentions: no join sorts all sentences a second time
    made = workflow.gold_template(annotating.mention_rows(rows.withColumn("sentence_text", F.col("text"))))
    return made.drop("method", "notes")


@query(
    """WITH r AS (SELECT CAST(user_id AS VARCHAR) AS session_id, CASE WHEN user_id % 5 = 0 THEN 4 END AS given, round_even(avg(1 + event_id % 5), 0) AS mean, user_id % 7 = 0 AS bare, count(*) AS n FROM events GROUP BY user_id)
  SELECT session_id, CAST(coalesce(given, mean) AS INTEGER) AS satisfaction, CASE WHEN CAST(session_id AS BIGINT) % 3 = 0 THEN 'star_rating' ELSE 'weighted' END AS ranking_method, CASE WHEN bare THEN NULL ELSE n END AS rated FROM r WHERE given IS NOT NULL OR NOT bare"""
)
def feedback_insert(spark, sf_dir):
    e = views.table(spark, sf_dir, "events")
    ratings = e.groupBy("user_id").agg(F.collect_list(F.struct(F.col("event_id").alias("product_id"), (1 + F.col("event_id") % 5).cast("int").alias("satisfaction"))).alias("ratings"))
    k = F.col("user_id")
    requests = ratings.select(
        F.concat(F.lit(" "), k.cast("string")).alias("session_id"),
        F.when(k % 5 == 0, F.lit(4)).alias("satisfaction"),
        F.lit("  ").alias("comment"),
        F.when(k % 3 == 0, F.lit("star_rating ")).when(k % 3 == 1, F.lit(" ")).alias("ranking_method"),
        F.when(k % 7 > 0, F.col("ratings")).alias("ratings"),
    )
    made = workflow.feedback_rows(requests)
    return made.select("session_id", "satisfaction", "ranking_method", F.when(F.col("ratings").isNotNull(), F.size("ratings")).cast("long").alias("rated"))


@query("SELECT page_id, page_id % 4 = 0 OR page_id % 4 = 1 AS sign_in, page_id % 3 = 0 AS robot FROM pages")
def challenge_pages(spark, sf_dir):
    from opinara.sources import pages

    k = F.col("page_id")
    url = F.when(k % 4 == 0, F.concat("url", F.lit("/ap/signin"))).otherwise(F.col("url"))
    mark = F.when(k % 4 == 1, F.lit("<form>Sign In <div id=\"authportal-x\">")).otherwise(F.lit("<p>sign in</p>"))
    html = F.concat(mark, F.when(k % 3 == 0, F.lit("<h4>Robot Check</h4>")).otherwise(F.lit("")), "html")
    return views.table(spark, sf_dir, "pages").select("page_id", pages.asks_to_sign_in(url, html).alias("sign_in"), pages.asks_for_a_person(html).alias("robot"))
