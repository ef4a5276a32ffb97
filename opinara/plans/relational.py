"""Relational queries: scores, prices, features, ranking, statistics, feedback, gold labels."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinara.operators import corpus, metrics, ranking, scores
from opinara.plans import views
from opinara.plans.views import ASPECTS, WEIGHTS, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- scores ------------------------------------------------------------------------------------------------

_COUNTS = """counts AS (SELECT product_id, aspect, count(*) FILTER (sentiment = 'positive') AS positive_count, count(*) FILTER (sentiment = 'negative') AS negative_count,
  count(*) FILTER (sentiment = 'neutral') AS neutral_count, count(*) AS mention_count FROM mentions GROUP BY 1, 2)"""
_RATIOS = _COUNTS + ", ratios AS (SELECT *, (positive_count + 0.5 * neutral_count) / mention_count AS ratio FROM counts)"
_SCORES = (
    _RATIOS
    + """, means AS (SELECT aspect, avg(ratio) AS corpus_mean FROM ratios GROUP BY 1),
  scores AS (SELECT product_id, aspect, positive_count, negative_count, neutral_count, mention_count, round(ratio, 4) AS raw_score,
  round((mention_count * ratio + 5.0 * corpus_mean) / (mention_count + 5.0), 4) AS score, round(mention_count / (mention_count + 3.0), 4) AS confidence
  FROM ratios JOIN means USING (aspect))"""
)


def _also(ctes: str, sql: str) -> str:
    """A statement over the shared views plus the CTEs of this module."""
    full = with_views(ctes + " " + sql)
    head, tail = full.split(ctes, 1)
    return head.rstrip() + ", " + ctes + " " + tail


@query(with_views("SELECT product_id, aspect, sentiment, count(*) AS n FROM mentions GROUP BY 1, 2, 3"))
def aspect_counts(spark, sf_dir):
    return scores.sentiment_counts(views.mentions(spark, sf_dir))


@query(_also(_COUNTS, "SELECT * FROM counts"))
def aspect_counts_wide(spark, sf_dir):
    return scores.aspect_counts(views.mentions(spark, sf_dir))


@query(with_views("SELECT aspect, count(*) FILTER (sentiment = 'positive') AS positive, count(*) FILTER (sentiment = 'negative') AS negative, count(*) FILTER (sentiment = 'neutral') AS neutral FROM mentions GROUP BY 1"))
def aspect_pivot(spark, sf_dir):
    return scores.pivot_sentiments(views.mentions(spark, sf_dir))


@query(_also(_SCORES, "SELECT * FROM scores"))
def aspect_scores(spark, sf_dir):
    return scores.aspect_scores(views.mentions(spark, sf_dir))


@query(_also(_RATIOS, "SELECT aspect, round(avg(ratio), 6) AS corpus_mean, count(*) AS products FROM ratios GROUP BY 1"))
def aspect_corpus_mean(spark, sf_dir):
    means = scores.corpus_means(scores.with_ratio(scores.aspect_counts(views.mentions(spark, sf_dir))))
    return means.withColumn("corpus_mean", F.round("corpus_mean", 6))


@query(_also(_SCORES, "SELECT aspect, count(score) AS products, CAST(sum(mention_count) AS BIGINT) AS mentions, round(avg(score), 3) AS mean_score FROM scores GROUP BY 1"))
def aspect_evidence(spark, sf_dir):
    return scores.aspect_evidence(aspect_scores(spark, sf_dir))


@query(with_views("SELECT product_id, method, n FROM (SELECT product_id, method, count(*) AS n, row_number() OVER (PARTITION BY product_id ORDER BY count(*) DESC, method) AS r FROM mentions GROUP BY 1, 2) WHERE r = 1"))
def dominant_method(spark, sf_dir):
    return scores.dominant_method(views.mentions(spark, sf_dir))


@query(with_views("SELECT method, count(*) AS n FROM mentions GROUP BY 1"))
def method_breakdown(spark, sf_dir):
    return views.mentions(spark, sf_dir).groupBy("method").agg(F.count("*").alias("n"))


# --- prices ------------------------------------------------------------------------------------------------


@query(with_views("SELECT product_id, price, currency, observed_at FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY observed_at DESC, price DESC, currency DESC NULLS LAST) AS r FROM prices) WHERE r = 1"))
def latest_price(spark, sf_dir):
    return scores.latest_prices(views.prices(spark, sf_dir))


@query(
    with_views(
        """SELECT product_id, observed_at, price, currency, availability FROM (SELECT *, row_number() OVER w AS n, lag(price) OVER w AS p, lag(currency) OVER w AS c, lag(availability) OVER w AS a
  FROM prices WINDOW w AS (PARTITION BY product_id ORDER BY observed_at, price, currency, availability))
  WHERE n = 1 OR price IS DISTINCT FROM p OR currency IS DISTINCT FROM c OR availability IS DISTINCT FROM a"""
    )
)
def price_changes(spark, sf_dir):
    return scores.price_changes(views.prices(spark, sf_dir))


_AFFORDABILITY = """bounds AS (SELECT currency, min(price) AS lo, max(price) AS hi, count(*) AS n FROM part_prices GROUP BY 1),
  affordable AS (SELECT product_id, p.currency AS currency, price, CASE WHEN n < 2 THEN NULL WHEN hi - lo < 1e-9 THEN 1.0 ELSE round((hi - price) / (hi - lo), 4) END AS affordability
  FROM part_prices p JOIN bounds b ON p.currency IS NOT DISTINCT FROM b.currency)"""


@query(_also(_AFFORDABILITY, "SELECT * FROM affordable"))
def affordability(spark, sf_dir):
    return scores.affordability(views.part_prices(spark, sf_dir))


@query(with_views("SELECT coalesce(currency, 'unknown') AS currency, count(DISTINCT product_id) AS products FROM prices GROUP BY 1"))
def distinct_products_per_currency(spark, sf_dir):
    return views.prices(spark, sf_dir).groupBy(F.coalesce("currency", F.lit("unknown")).alias("currency")).agg(F.countDistinct("product_id").alias("products"))


@query(with_views("SELECT product_id, observed_at, price FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY observed_at DESC, price DESC, currency DESC) AS r FROM prices) WHERE r <= 50"))
def price_history(spark, sf_dir):
    order = [F.desc("observed_at"), F.desc("price"), F.desc("currency")]
    return corpus.cap_per_key(views.prices(spark, sf_dir), ["product_id"], order, 50).select("product_id", "observed_at", "price")


# --- features and ranking ----------------------------------------------------------------------------------

_SHARED = _SCORES + ", " + _AFFORDABILITY


def _products_vectors(spark, sf_dir):
    products = views.products(spark, sf_dir)
    vectors = ranking.feature_vectors(products, aspect_scores(spark, sf_dir), affordability(spark, sf_dir))
    return products, vectors


@query(
    _also(
        _SHARED,
        "SELECT p.product_id, "
        + ", ".join(f"max(score) FILTER (aspect = '{a}') AS {a}, coalesce(max(mention_count) FILTER (aspect = '{a}'), 0) AS {a}_mentions" for a in ASPECTS)
        + ", any_value(affordability) AS affordability FROM products p LEFT JOIN scores s USING (product_id) LEFT JOIN affordable f ON f.product_id = p.product_id GROUP BY 1",
    )
)
def feature_vectors_wide(spark, sf_dir):
    return ranking.wide_features(views.products(spark, sf_dir), aspect_scores(spark, sf_dir), ASPECTS, affordability(spark, sf_dir))


def _ranking_ctes(where: str = "TRUE") -> str:
    weights = ", ".join(f"('{a}', CAST({w} AS DOUBLE), {k})" for k, (a, w) in enumerate(ranking.normalised_weights(WEIGHTS, ASPECTS).items()))
    return (
        _SHARED
        + f""", chosen AS (SELECT * FROM products WHERE {where}), weights(aspect, weight, ord) AS (VALUES {weights}),
  vectors AS (SELECT product_id, aspect, score, mention_count FROM scores UNION ALL SELECT product_id, 'affordability', affordability, 0 FROM affordable WHERE affordability IS NOT NULL),
  fills AS (SELECT w.aspect, any_value(w.weight) AS weight, any_value(w.ord) AS ord, coalesce(avg(v.score), 0.5) AS mean FROM weights w
    LEFT JOIN (SELECT * FROM vectors SEMI JOIN chosen USING (product_id)) v ON v.aspect = w.aspect GROUP BY 1),
  parts AS (SELECT c.product_id, m.aspect, m.ord, m.weight, coalesce(v.score, m.mean) AS score, m.weight * coalesce(v.score, m.mean) AS contribution, coalesce(v.mention_count, 0) AS mention_count, v.score IS NULL AS imputed
    FROM chosen c CROSS JOIN fills m LEFT JOIN vectors v ON v.product_id = c.product_id AND v.aspect = m.aspect),
  totals AS (SELECT product_id, round(sum(contribution), 4) AS final_score, round(sum(CASE WHEN imputed THEN 0.0 ELSE weight END), 4) AS coverage FROM parts GROUP BY 1)"""
    )


def _rank_sql(where: str = "TRUE", star: bool = False, top: int = 10) -> str:
    keys = "t.final_score DESC, t.coverage DESC, c.review_count DESC, c.product_id"
    final = "t.final_score"
    if star:
        keys = "c.site_rating IS NOT NULL DESC, coalesce(c.site_rating, 0) DESC, coalesce(c.site_rating_count, 0) DESC, c.review_count DESC, c.product_id"
        final = "round(coalesce((c.site_rating - 1) / 4, 0.0), 4)"
    return _also(_ranking_ctes(where), f"SELECT row_number() OVER (ORDER BY {keys}) AS rank, c.product_id, {final} AS final_score, t.coverage FROM chosen c JOIN totals t USING (product_id) ORDER BY {keys} LIMIT {top}")


@query(_rank_sql())
def recommend_weighted(spark, sf_dir):
    products, vectors = _products_vectors(spark, sf_dir)
    return ranking.recommend(products, vectors, ASPECTS, WEIGHTS)


@query(_rank_sql(star=True))
def recommend_star(spark, sf_dir):
    products, vectors = _products_vectors(spark, sf_dir)
    return ranking.recommend(products, vectors, ASPECTS, WEIGHTS, method="star_rating")


@query(_rank_sql("lower(trim(brand)) IN ('brand#1', 'brand#2', 'brand#3', 'brand#11', 'brand#12') AND review_count >= 2 AND price >= 900 AND price <= 1500", top=20))
def recommend_filtered(spark, sf_dir):
    products, vectors = _products_vectors(spark, sf_dir)
    brands = ["Brand#1", "Brand#2 ", "brand#3", "Brand#11", "Brand#12"]
    return ranking.recommend(products, vectors, ASPECTS, WEIGHTS, top_k=20, brands=brands, min_reviews=2, budget_min=900, budget_max=1500)


def _parts(spark, sf_dir):
    products, vectors = _products_vectors(spark, sf_dir)
    return ranking.breakdown(products, vectors, ranking.normalised_weights(WEIGHTS, ASPECTS))


@query(_also(_ranking_ctes(), "SELECT product_id, aspect, round(score, 4) AS score, round(contribution, 6) AS contribution, mention_count, imputed FROM parts"))
def recommend_breakdown(spark, sf_dir):
    return _parts(spark, sf_dir).select("product_id", "aspect", F.round("score", 4).alias("score"), F.round("contribution", 6).alias("contribution"), "mention_count", "imputed")


_TOP3 = "coalesce(array_to_string((list(aspect ORDER BY {order}, ord) FILTER (mention_count > 0 AND NOT imputed AND {cut}))[1:3], ', '), '')"


@query(
    _also(
        _ranking_ctes(),
        f"SELECT product_id, {_TOP3.format(order='score DESC', cut='score >= 0.70')} AS strengths, {_TOP3.format(order='score', cut='score <= 0.45 AND score <> 0')} AS weaknesses FROM parts GROUP BY 1",
    )
)
def strengths_weaknesses(spark, sf_dir):
    return ranking.strengths_and_weaknesses(_parts(spark, sf_dir))


@query(
    _also(
        _ranking_ctes(),
        "SELECT product_id, 'Ranked for ' || array_to_string((list(aspect || ' ' || CAST(CAST(round_even(score * 100, 0) AS INTEGER) AS VARCHAR) || '%' ORDER BY round(contribution, 10) DESC, ord))[1:3], ', ') || '.' AS explanation FROM parts GROUP BY 1",
    )
)
def explanation(spark, sf_dir):
    return ranking.explanation(_parts(spark, sf_dir))


# --- agreement and feedback --------------------------------------------------------------------------------

_AGREE = """c AS (SELECT review_id, count(*) FILTER (sentiment = 'positive') AS pos, count(*) FILTER (sentiment = 'neutral') AS neu, count(*) AS n FROM mentions GROUP BY 1),
  agree AS (SELECT c.review_id, r.rating, (pos + 0.5 * neu) / n AS absa FROM c JOIN reviews r ON r.review_id = c.review_id WHERE r.rating IS NOT NULL),
  marked AS (SELECT *, CASE WHEN absa > 0.6 THEN 'positive' WHEN absa < 0.4 THEN 'negative' ELSE 'neutral' END AS absa_label, CASE WHEN rating >= 4 THEN 'positive' WHEN rating <= 2 THEN 'negative' ELSE 'neutral' END AS star_label FROM agree)"""


def _agreement(spark, sf_dir):
    return metrics.star_agreement_rows(views.mentions(spark, sf_dir), views.reviews(spark, sf_dir).select("review_id", "rating"))


@query(_also(_AGREE, "SELECT count(*) AS reviews, round(avg(CAST(absa_label = star_label AS INTEGER)), 4) AS agreement, round(avg(abs(absa - (rating - 1) / 4)), 4) AS mae FROM marked"))
def star_agreement(spark, sf_dir):
    return metrics.star_agreement(_agreement(spark, sf_dir))


@query(_also(_AGREE, "SELECT CAST(round_even(rating, 0) AS INTEGER) AS stars, count(*) AS reviews, round(avg(absa), 4) AS mean_absa FROM marked GROUP BY 1"))
def star_agreement_by_rating(spark, sf_dir):
    return metrics.star_agreement_by_rating(_agreement(spark, sf_dir))


_NDCG = """placed AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY rank, satisfaction DESC) AS i, row_number() OVER (PARTITION BY session_id ORDER BY satisfaction DESC) AS j FROM items),
  sums AS (SELECT session_id, sum(CASE WHEN i <= 3 THEN (pow(2.0, satisfaction) - 1) / log2(i + 1.0) ELSE 0 END) AS dcg, sum(CASE WHEN j <= 3 THEN (pow(2.0, satisfaction) - 1) / log2(j + 1.0) ELSE 0 END) AS idcg FROM placed GROUP BY 1),
  ndcg AS (SELECT session_id, round(CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0.0 END, 4) AS ndcg FROM sums)"""


@query(_also(_NDCG, "SELECT * FROM ndcg"))
def ndcg_sessions(spark, sf_dir):
    return metrics.ndcg_at_k(views.feedback_items(spark, sf_dir))


@query(
    with_views(
        """SELECT session_id, CASE WHEN count(*) < 3 OR min(rank) = max(rank) OR min(a) = max(a) THEN NULL ELSE round(corr(CAST(rank AS DOUBLE), CAST(a AS DOUBLE)), 4) + 0.0 END AS spearman FROM
  (SELECT *, rank() OVER (PARTITION BY session_id ORDER BY satisfaction DESC) + (count(*) OVER (PARTITION BY session_id, satisfaction) - 1) / 2 AS a FROM items) GROUP BY 1"""
    )
)
def spearman_sessions(spark, sf_dir):
    return metrics.spearman(views.feedback_items(spark, sf_dir))


@query(with_views("SELECT CAST(g.i AS INTEGER) AS satisfaction, count(items.event_id) AS n FROM range(1, 6) g(i) LEFT JOIN items ON items.satisfaction = g.i GROUP BY 1"))
def feedback_distribution(spark, sf_dir):
    return metrics.satisfaction_distribution(views.feedback_items(spark, sf_dir))


@query(with_views("SELECT rank, count(*) AS n, round(avg(satisfaction), 3) AS mean_satisfaction FROM items GROUP BY 1"))
def satisfaction_by_rank(spark, sf_dir):
    return metrics.satisfaction_by_rank(views.feedback_items(spark, sf_dir))


@query(with_views("SELECT count(*) AS ratings, round(avg(satisfaction), 3) AS mean_satisfaction, round(avg(satisfaction) FILTER (rank = 1), 3) AS top1_mean, round(avg(CAST(satisfaction >= 4 AS INTEGER)), 4) AS share_satisfied FROM items"))
def feedback_summary(spark, sf_dir):
    return metrics.feedback_summary(views.feedback_items(spark, sf_dir))


@query(with_views("SELECT session_id, CAST(least(5, greatest(1, round_even(avg(satisfaction), 0))) AS INTEGER) AS satisfaction FROM items GROUP BY 1"))
def session_satisfaction(spark, sf_dir):
    return metrics.session_satisfaction(views.feedback_items(spark, sf_dir))


@query(
    _also(
        _NDCG
        + """, s AS (SELECT session_id, CASE WHEN min(event_type) = 'click' THEN 'star_rating' END AS ranking_method, CAST(least(5, greatest(1, round_even(avg(satisfaction), 0))) AS INTEGER) AS satisfaction FROM items GROUP BY 1)""",
        "SELECT coalesce(ranking_method, 'weighted') AS method, count(*) AS sessions, round(avg(satisfaction), 3) AS mean_satisfaction, round(avg(ndcg), 4) AS mean_ndcg FROM s LEFT JOIN ndcg USING (session_id) GROUP BY 1",
    )
)
def method_slices(spark, sf_dir):
    items = views.feedback_items(spark, sf_dir)
    method = items.groupBy("session_id").agg(F.when(F.min("event_type") == "click", "star_rating").alias("ranking_method"))
    return metrics.method_slices(metrics.session_satisfaction(items).join(method, "session_id"), metrics.ndcg_at_k(items))


_CLASSES = ("positive", "negative", "neutral")
_CONFUSION = """grid AS (SELECT g.c AS gold, p.c AS predicted FROM (VALUES ('positive'), ('negative'), ('neutral')) g(c), (VALUES ('positive'), ('negative'), ('neutral')) p(c)),
  matrix AS (SELECT grid.gold, grid.predicted, count(x.gold) AS n FROM grid LEFT JOIN (SELECT * FROM gold) x ON x.gold = grid.gold AND x.predicted = grid.predicted GROUP BY 1, 2),
  sums AS (SELECT c AS label, sum(n) FILTER (gold = c) AS support, sum(n) FILTER (predicted = c) AS said, sum(n) FILTER (gold = c AND predicted = c) AS tp FROM matrix, (VALUES ('positive'), ('negative'), ('neutral')) k(c) GROUP BY 1),
  rates AS (SELECT label, support, CASE WHEN said > 0 THEN tp / said ELSE 0.0 END AS p, CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS r FROM sums),
  prf AS (SELECT label, round(p, 4) AS precision, round(r, 4) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 4) AS f1, CAST(support AS BIGINT) AS support FROM rates)"""


@query(_also(_CONFUSION, "SELECT * FROM matrix"))
def confusion_matrix(spark, sf_dir):
    return metrics.confusion(views.gold(spark, sf_dir), _CLASSES)


@query(_also(_CONFUSION, "SELECT * FROM prf"))
def prf_by_class(spark, sf_dir):
    return metrics.precision_recall(confusion_matrix(spark, sf_dir))


@query(_also(_CONFUSION, "SELECT round(avg(f1), 4) AS macro_f1, (SELECT round(sum(n) FILTER (gold = predicted) / sum(n), 4) FROM matrix) AS accuracy FROM prf"))
def macro_f1(spark, sf_dir):
    matrix = confusion_matrix(spark, sf_dir)
    return metrics.macro_f1(metrics.precision_recall(matrix), matrix)


# --- corpus ------------------------------------------------------------------------------------------------


@query(with_views("SELECT coalesce(excluded_reason, 'spam') AS reason, count(*) AS n FROM reviews WHERE excluded_reason IS NOT NULL OR is_spam GROUP BY 1"))
def exclusion_breakdown(spark, sf_dir):
    return corpus.exclusion_breakdown(views.reviews(spark, sf_dir))


@query(with_views("SELECT CASE WHEN is_spam THEN 'spam' WHEN is_duplicate THEN 'duplicate' WHEN excluded_reason IS NOT NULL THEN excluded_reason ELSE 'kept' END AS decision, count(*) AS n FROM reviews GROUP BY 1"))
def review_decisions(spark, sf_dir):
    return views.reviews(spark, sf_dir).groupBy(corpus.decision().alias("decision")).agg(F.count("*").alias("n"))


@query("SELECT p_brand AS brand, count(*) AS n FROM part GROUP BY 1")
def brand_distribution(spark, sf_dir):
    return corpus.brand_distribution(views.products(spark, sf_dir))


@query(
    _also(
        _SCORES,
        """SELECT 'products' AS stage, count(*) AS n FROM products UNION ALL SELECT 'reviews', count(*) FROM reviews UNION ALL SELECT 'spam', count(*) FROM reviews WHERE is_spam
  UNION ALL SELECT 'duplicates', count(*) FROM reviews WHERE is_duplicate UNION ALL SELECT 'kept', count(*) FROM reviews WHERE NOT is_spam AND NOT is_duplicate AND excluded_reason IS NULL
  UNION ALL SELECT 'analysed', count(*) FROM reviews WHERE processed_at IS NOT NULL UNION ALL SELECT 'scored_products', count(DISTINCT product_id) FROM scores UNION ALL SELECT 'scores', count(*) FROM scores""",
    )
)
def funnel(spark, sf_dir):
    return corpus.funnel(views.products(spark, sf_dir), views.reviews(spark, sf_dir), aspect_scores(spark, sf_dir))


@query(with_views("SELECT product_id, count(*) AS total, count(*) FILTER (processed_at IS NOT NULL AND excluded_reason IS NULL) AS analysed FROM reviews GROUP BY 1"))
def review_counts(spark, sf_dir):
    return corpus.review_counts(views.reviews(spark, sf_dir))


@query(with_views("SELECT review_id, product_id, helpful_votes FROM reviews WHERE excluded_reason IS NULL AND NOT is_spam AND processed_at IS NULL ORDER BY helpful_votes DESC NULLS LAST, review_id LIMIT 100"))
def top_reviews_helpful(spark, sf_dir):
    rows = views.reviews(spark, sf_dir).withColumnRenamed("review_id", "id")
    return corpus.pending(rows, limit=100).select(F.col("id").alias("review_id"), "product_id", "helpful_votes")


@query(with_views("SELECT review_id, product_id, rating FROM reviews WHERE excluded_reason IS NULL AND NOT is_spam AND rating >= 2 AND rating <= 4 ORDER BY review_id LIMIT 50 OFFSET 100"))
def reviews_page(spark, sf_dir):
    rows = corpus.rating_between(corpus.usable(views.reviews(spark, sf_dir)), 2, 4)
    return corpus.page(rows, 50, 100, "review_id").select("review_id", "product_id", "rating")


@query("SELECT p_partkey AS product_id, p_name AS name, p_brand AS brand FROM part WHERE p_name ILIKE '%a%' OR p_brand ILIKE '%a%' OR p_type ILIKE '%a%' ORDER BY p_partkey LIMIT 50 OFFSET 10")
def list_products_page(spark, sf_dir):
    p = views.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("product_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_type").alias("type"))
    return corpus.page(corpus.matching(p, "a", ["name", "brand", "type"]), 50, 10, "product_id").select("product_id", "name", "brand")


@query("SELECT p_partkey AS product_id, p_brand AS brand FROM part WHERE p_brand ILIKE 'bRaNd#1_'")
def brand_ilike(spark, sf_dir):
    p = views.table(spark, sf_dir, "part")
    return p.where(F.col("p_brand").ilike("bRaNd#1_")).select(F.col("p_partkey").alias("product_id"), F.col("p_brand").alias("brand"))


@query(_also(_SCORES, "SELECT product_id, brand FROM products SEMI JOIN scores USING (product_id)"))
def has_scores_semi(spark, sf_dir):
    return views.products(spark, sf_dir).join(aspect_scores(spark, sf_dir).select("product_id"), "product_id", "left_semi").select("product_id", "brand")


@query(with_views("SELECT m.product_id, m.aspect, r.rating, count(*) AS n FROM mentions m JOIN reviews r ON r.review_id = m.review_id WHERE m.aspect = 'camera' AND m.sentiment = 'negative' GROUP BY 1, 2, 3"))
def opinions_by_rating(spark, sf_dir):
    wanted = views.mentions(spark, sf_dir).where((F.col("aspect") == F.lower(F.trim(F.lit(" Camera ")))) & (F.col("sentiment") == "negative"))
    return wanted.join(views.reviews(spark, sf_dir).select("review_id", "rating"), "review_id").groupBy("product_id", "aspect", "rating").agg(F.count("*").alias("n"))


@query(with_views("SELECT product_id, review_id, rating FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY review_id) AS k FROM reviews WHERE NOT is_duplicate) WHERE k <= 3"))
def cap_per_product(spark, sf_dir):
    return corpus.cap_per_key(views.reviews(spark, sf_dir).where(~F.col("is_duplicate")), ["product_id"], ["review_id"], 3).select("product_id", "review_id", "rating")


@query(
    with_views(
        """SELECT source_review_id, position FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY f, position) AS r FROM (SELECT *, coalesce(nullif(source_review_id, ''), substr(body, 1, 120)) AS k FROM
  (SELECT 'R' || (review_id % 5000) AS source_review_id, 'b' || review_id AS body, review_id AS position, 0 AS f FROM reviews WHERE rating >= 4 UNION ALL SELECT CASE WHEN review_id % 3 = 0 THEN '' ELSE 'R' || (review_id % 7000) END, 'b' || review_id, review_id, 1 FROM reviews WHERE rating < 4))) WHERE r = 1"""
    )
)
def union_distinct_reviews(spark, sf_dir):
    k = F.col("review_id")
    rows = views.reviews(spark, sf_dir)
    inline = rows.where("rating >= 4").select(F.concat(F.lit("R"), (k % 5000).cast("string")).alias("source_review_id"), F.concat(F.lit("b"), k.cast("string")).alias("body"), k.alias("position"))
    other = F.when(k % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("R"), (k % 7000).cast("string")))
    paged = rows.where("rating < 4").select(other.alias("source_review_id"), F.concat(F.lit("b"), k.cast("string")).alias("body"), k.alias("position"))
    return corpus.union_distinct_reviews(inline, paged).select("source_review_id", "position")


@query("SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1, 2")
def json_props(spark, sf_dir):
    e = views.table(spark, sf_dir, "events")
    return e.groupBy("event_type", F.from_json("props", "k bigint")["k"].alias("k")).agg(F.count("*").alias("n"))


@query(with_views("SELECT 'reviews' AS k, count(*) AS v FROM reviews UNION ALL SELECT 'reviews_usable', count(*) FROM reviews WHERE excluded_reason IS NULL AND NOT is_spam UNION ALL SELECT 'products', count(*) FROM part UNION ALL SELECT 'mentions', count(*) FROM mentions UNION ALL SELECT 'sentiment:' || sentiment, count(*) FROM mentions GROUP BY sentiment UNION ALL SELECT 'aspect:' || aspect, count(*) FROM mentions GROUP BY aspect"))
def corpus_stats_long(spark, sf_dir):
    m, r = views.mentions(spark, sf_dir), views.reviews(spark, sf_dir)
    one = lambda name, df: df.agg(F.count("*").alias("v")).select(F.lit(name).alias("k"), "v")
    by = lambda name: m.groupBy(F.concat(F.lit(name + ":"), F.col(name)).alias("k")).agg(F.count("*").alias("v"))
    return one("reviews", r).unionAll(one("reviews_usable", corpus.usable(r))).unionAll(one("products", views.table(spark, sf_dir, "part"))).unionAll(one("mentions", m)).unionAll(by("sentiment")).unionAll(by("aspect"))


# --- mutations, previews, wide forms -----------------------------------------------------------------------


@query(_also(_ranking_ctes(), "SELECT product_id, " + ", ".join(f"round(max(score) FILTER (aspect = '{a}'), 4) AS {a}_score, max(weight) FILTER (aspect = '{a}') AS {a}_weight, round(max(contribution) FILTER (aspect = '{a}'), 6) AS {a}_contribution" for a in ASPECTS) + " FROM parts GROUP BY 1"))
def ranking_wide(spark, sf_dir):
    at = lambda a, c: F.max(F.when(F.col("aspect") == a, F.col(c)))
    columns = [c for a in ASPECTS for c in (F.round(at(a, "score"), 4).alias(f"{a}_score"), at(a, "weight").alias(f"{a}_weight"), F.round(at(a, "contribution"), 6).alias(f"{a}_contribution"))]
    return _parts(spark, sf_dir).groupBy("product_id").agg(*columns)


@query(
    """WITH o AS (SELECT p_partkey AS id, p_name AS title, p_retailprice AS price FROM part WHERE p_partkey % 3 <> 0),
  n AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN '' ELSE 'new ' || p_name END AS title, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_retailprice + 1 END AS price FROM part WHERE p_partkey % 4 <> 1)
  SELECT coalesce(n.id, o.id) AS id, coalesce(nullif(n.title, ''), o.title) AS title, coalesce(n.price, o.price) AS price FROM o FULL OUTER JOIN n ON o.id = n.id"""
)
def upsert_products(spark, sf_dir):
    p = views.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_retailprice").alias("price"))
    fresh = p.where("id % 4 <> 1").select("id", F.when(F.col("id") % 2 == 0, "").otherwise(F.concat(F.lit("new "), "title")).alias("title"), F.when(F.col("id") % 5 != 0, F.col("price") + 1).alias("price"))
    return corpus.upsert_products(p.where("id % 3 <> 0"), fresh, ["id"], ["title"], ["price"])


@query(
    with_views(
        """SELECT product_id, content_hash, arrival FROM (SELECT *, row_number() OVER (PARTITION BY product_id, content_hash ORDER BY arrival) AS r FROM (SELECT product_id, CAST(review_id % 7 AS VARCHAR) AS content_hash, review_id AS arrival FROM reviews WHERE rating < 5)) i
  WHERE r = 1 AND NOT EXISTS (SELECT 1 FROM reviews s WHERE s.rating = 5 AND s.product_id = i.product_id AND CAST(s.review_id % 7 AS VARCHAR) = i.content_hash)"""
    )
)
def new_reviews(spark, sf_dir):
    rows = views.reviews(spark, sf_dir).select("product_id", (F.col("review_id") % 7).cast("string").alias("content_hash"), F.col("review_id").alias("arrival"), "rating")
    return corpus.new_reviews(rows.where("rating < 5"), rows.where("rating = 5")).select("product_id", "content_hash", "arrival")


@query(with_views("SELECT review_id, product_id FROM reviews WHERE product_id NOT IN (SELECT p_partkey FROM part WHERE p_size < 10)"))
def cascade_delete(spark, sf_dir):
    gone = views.table(spark, sf_dir, "part").where("p_size < 10").select(F.col("p_partkey").alias("product_id"))
    return corpus.cascade_delete(views.reviews(spark, sf_dir).select("review_id", "product_id"), gone)


@query(with_views("SELECT product_id, name, brand FROM products WHERE brand = 'Brand#12' AND regexp_matches(lower(name), 'a|e') AND review_count >= 3 AND coalesce(site_rating, 0) >= 2.0"))
def filter_candidates(spark, sf_dir):
    from opinara.functions import products

    rows = views.products(spark, sf_dir).withColumnsRenamed({"name": "product_name", "review_count": "rating_number", "site_rating": "average_rating"})
    return products.filter_candidates(rows, "Brand#12", "A|E", 3, 2.0).select("product_id", F.col("product_name").alias("name"), "brand")


@query(with_views("(SELECT review_id, 'kept' AS state FROM reviews WHERE excluded_reason IS NULL AND NOT is_spam AND NOT is_duplicate ORDER BY review_id LIMIT 20) UNION ALL (SELECT review_id, 'dropped' FROM reviews WHERE excluded_reason IS NOT NULL OR is_spam OR is_duplicate ORDER BY review_id LIMIT 20)"))
def decision_preview(spark, sf_dir):
    rows = views.reviews(spark, sf_dir).withColumn("keep", corpus.decision() == "kept")
    part = lambda keep, state: rows.where(F.col("keep") == keep).orderBy("review_id").limit(20).select("review_id", F.lit(state).alias("state"))
    return part(True, "kept").unionAll(part(False, "dropped"))


@query(with_views("SELECT count(*) AS total FROM reviews WHERE excluded_reason IS NULL AND NOT is_spam AND product_id IN (1, 2, 3, 5, 8)"))
def page_total(spark, sf_dir):
    return corpus.by_ids(corpus.usable(views.reviews(spark, sf_dir)), "product_id", [1, 2, 3, 5, 8]).agg(F.count("*").alias("total"))


@query(with_views("SELECT r.rating, p.brand, count(*) AS n FROM mentions m JOIN reviews r ON r.review_id = m.review_id JOIN products p ON p.product_id = m.product_id WHERE r.processed_at IS NOT NULL GROUP BY 1, 2"))
def mentions_by_brand_and_rating(spark, sf_dir):
    seen = corpus.analysed(views.reviews(spark, sf_dir)).select("review_id", "rating")
    brands = views.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("product_id"), F.col("p_brand").alias("brand"))
    return views.mentions(spark, sf_dir).join(seen, "review_id").join(brands, "product_id").groupBy("rating", "brand").agg(F.count("*").alias("n"))
