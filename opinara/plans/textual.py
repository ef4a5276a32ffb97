"""Text queries: cleaning, quality gate, language, sentences, aspects, parsing, product filters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinara.functions import annotating, cleaning, segmenting
from opinara.functions.taxonomy import Taxonomy
from opinara.operators import corpus, scores
from opinara.plans import relational, views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


#: Sentences of the synthetic reviews: three are picked per order by its key.
OPENERS = ("The battery lasts all day and charges very fast.", "Battery drains quickly, not good at all.", "The camera takes sharp and vivid photos.", "Photos look grainy in low light.", "The screen is bright and the colors are stunning.")
MIDDLES = ("Performance is smooth, but the phone heats up while gaming.", "It hangs and the apps are sluggish.", "The design feels premium however the weight is heavy.", "Great value for money.", "Overpriced, not worth it.", "Delivery came on a Tuesday.", "I use it for work.")
CLOSERS = ("Really happy with the display.", "It dies by lunchtime.", "Nice.")


def review_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Synthetic reviews over orders: review_id, product_id, rating, body."""
    k = F.col("review_id")
    pick = lambda values, at: F.element_at(F.array(*(F.lit(v) for v in values)), (at + 1).cast("int"))
    body = F.concat_ws(" ", pick(OPENERS, k % len(OPENERS)), pick(MIDDLES, (k * 3) % len(MIDDLES)), pick(CLOSERS, (k * 5) % len(CLOSERS)))
    return views.reviews(spark, sf_dir).select("review_id", "product_id", "rating", body.alias("body"))


def _sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


REVIEW_TEXTS = f"""SELECT review_id, product_id, rating, {_sql_list(OPENERS)}[1 + review_id % {len(OPENERS)}] || ' ' || {_sql_list(MIDDLES)}[1 + (review_id * 3) % {len(MIDDLES)}] || ' ' || {_sql_list(CLOSERS)}[1 + (review_id * 5) % {len(CLOSERS)}] AS body FROM reviews"""


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.spread(views.table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), "doc_id")


_CANONICAL = "trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'))"


@query(f"SELECT doc_id, sha256({_CANONICAL}) AS content_hash FROM documents")
def content_hashes(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", cleaning.content_hash(F.col("text")).alias("content_hash"))


@query(f"SELECT doc_id, h AS content_hash FROM (SELECT doc_id, sha256({_CANONICAL}) AS h, row_number() OVER (PARTITION BY sha256({_CANONICAL}) ORDER BY doc_id) AS r FROM documents) WHERE r = 1")
def dedupe_hash(spark, sf_dir):
    # smallest id of a hash: an aggregation, so a hash of many copies is combined before the shuffle
    hashed = content_hashes(spark, sf_dir)
    return hashed.groupBy("content_hash").agg(F.min("doc_id").alias("doc_id"))


@query(f"SELECT h AS content_hash, count(*) AS n, min(doc_id) AS first_id FROM (SELECT doc_id, sha256({_CANONICAL}) AS h FROM documents) GROUP BY 1 HAVING count(*) > 1")
def hash_collisions(spark, sf_dir):
    return content_hashes(spark, sf_dir).groupBy("content_hash").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


_WORDS = "(SELECT list_distinct(regexp_extract_all(lower(text), '[a-z'']+')))"
_ENGLISH = "['the','and','is','it','this','for','with','but','very','good','phone','battery','camera','not','was','have','great','you']"
_LANG = f"CASE WHEN length(text) > 0 AND length(regexp_replace(lower(text), '[^a-z]', '', 'g')) > 0 AND length(regexp_replace(lower(text), '[^a-z]', '', 'g')) >= 0.4 * length(lower(text)) AND len(list_intersect({_WORDS}, {_ENGLISH})) >= 2 THEN 'en' END"


@query(f"SELECT doc_id, {_LANG} AS language FROM documents")
def heuristic_language(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", cleaning.heuristic_language(F.col("text")).alias("language"))


@query(f"SELECT lang, coalesce({_LANG}, 'unknown') AS said, count(*) AS n FROM documents GROUP BY 1, 2")
def language_vs_label(spark, sf_dir):
    said = F.coalesce(cleaning.heuristic_language(F.col("text")), F.lit("unknown"))
    return _documents(spark, sf_dir).groupBy("lang", said.alias("said")).agg(F.count("*").alias("n"))


def _clean_sql(text: str) -> str:
    """The cleaning rules for DuckDB, whose expressions have no back references: runs are cut letter by letter."""
    out = f"regexp_replace(coalesce({text}, ''), '<[^>]+>', ' ', 'g')"
    for reference, letter in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        out = f"replace({out}, '{reference}', '{letter}')"
    out = f"regexp_replace({out}, '[\\x{{200B}}-\\x{{200F}}\\x{{2028}}\\x{{2029}}\\x{{FEFF}}\\x{{00AD}}]', '', 'g')"
    for pattern in (r"https?://\S+|www\.\S+", r"\S+@\S+\.\S+", *(f"(?i){p}" for p, _ in cleaning._BOILERPLATE)):
        out = f"regexp_replace({out}, '{pattern}', ' ', 'g')"
    out = f"translate({out}, '’‘“”–—', '''''\"\"--')"
    letters = _sql_list([*(chr(c) for c in range(33, 127)), *" éèêàçäöüßñóíáúÉÈ"])
    out = f"list_reduce(list_prepend({out}, {letters}), lambda t, c: CASE WHEN contains(t, repeat(c, 4)) THEN regexp_replace(t, '(' || regexp_escape(c) || '){{4,}}', replace(c || c, '\\', '\\\\'), 'g') ELSE t END)"
    for mark in "!?.,":
        out = f"regexp_replace({out}, '[{mark}]{{2,}}', '{mark}', 'g')"
    return f"trim(regexp_replace({out}, '\\s+', ' ', 'g'))"


_CLEANED = f"cleaned AS (SELECT doc_id, trim(text) AS raw, {_clean_sql('text')} AS t FROM documents)"


@query(f"WITH {_CLEANED} SELECT doc_id, t AS cleaned FROM cleaned")
def clean_text_full(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", cleaning.normalise_text(F.col("text")).alias("cleaned"))


_GATE = f"""WITH {_CLEANED}, a AS (SELECT *, regexp_replace(lower(t), '^[ .!?]+|[ .!?]+$', '', 'g') AS low, lower(regexp_replace(raw, '\\s+', '', 'g')) AS dense, len(regexp_extract_all(raw, '\\p{{L}}')) AS letters FROM cleaned),
  b AS (SELECT *, regexp_extract_all(low, '[a-z'']+') AS words FROM a),
  c AS (SELECT *, CASE WHEN t = '' THEN NULL WHEN list_contains({_sql_list(cleaning._GENERIC)}, low) THEN 'generic_only' WHEN length(dense) >= 12 AND len(list_distinct(string_split(dense, ''))) <= 2 THEN 'repeated_chars'
    WHEN letters > 25 AND len(regexp_extract_all(raw, '\\p{{Lu}}')) > 0.8 * letters THEN 'all_caps' WHEN len(words) = 0 THEN 'no_alpha_content'
    WHEN len(words) >= 6 AND len(list_distinct(words)) < 0.3 * len(words) THEN 'low_lexical_diversity' WHEN len(regexp_extract_all(t, '\\p{{L}}')) < 0.45 * length(t) THEN 'low_alpha_ratio'
    WHEN len(regexp_extract_all(t, 'https?://\\S+|www\\.\\S+')) >= 2 THEN 'link_spam' END AS spam FROM b),
  d AS (SELECT *, CASE WHEN t <> '' AND spam IS NULL AND length(t) >= 15 THEN {_LANG.replace('text', 't')} END AS language FROM c),
  e AS (SELECT *, CASE WHEN t = '' THEN 'empty' WHEN spam IS NOT NULL THEN spam WHEN length(t) < 15 THEN 'too_short' WHEN language IS NULL THEN 'language_filtered' END AS excluded_reason FROM d)"""


@query(f"{_GATE} SELECT doc_id, sha256({_CANONICAL.replace('text', 't')}) AS content_hash, language, spam IS NOT NULL AS is_spam, excluded_reason, excluded_reason IS NULL AND t <> '' AS usable FROM e")
def quality_gate(spark, sf_dir):
    checked = cleaning.preprocess(_documents(spark, sf_dir).withColumnRenamed("text", "body"), title=None)
    return checked.select("doc_id", "content_hash", "language", "is_spam", "excluded_reason", "usable")


@query(f"{_GATE} SELECT coalesce(excluded_reason, 'kept') AS reason, count(*) AS n FROM e GROUP BY 1")
def quality_reasons(spark, sf_dir):
    return quality_gate(spark, sf_dir).groupBy(F.coalesce("excluded_reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query("SELECT CASE WHEN length(text) = 0 THEN 'empty' WHEN length(text) < 15 THEN 'short' ELSE 'long' END AS size, count(*) AS n FROM documents GROUP BY 1")
def text_sizes(spark, sf_dir):
    size = F.when(F.length("text") == 0, "empty").when(F.length("text") < 15, "short").otherwise("long")
    return _documents(spark, sf_dir).groupBy(size.alias("size")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, len(regexp_extract_all(text, '[\\p{L}\\p{N}\\p{M}_]([\\p{L}\\p{N}\\p{M}_'']*[\\p{L}\\p{N}\\p{M}_])?')) AS words FROM documents")
def word_count(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", segmenting.word_count(F.col("text")).cast("long").alias("words"))


def _split_sql(text: str) -> str:
    """Sentences by punctuation: dots of abbreviations and decimals are put out of the way, boundaries become newlines."""
    out = text
    for short in segmenting.ABBREVIATIONS:
        out = f"regexp_replace({out}, '(?i)(^|[^\\p{{L}}\\p{{N}}_]){short.replace('.', chr(92) + '.')}', '\\1{short.replace('.', '․')}', 'g')"
    for _ in range(2):
        out = f"regexp_replace({out}, '(\\p{{Nd}})\\.(\\p{{Nd}})', '\\1․\\2', 'g')"
    out = f"""regexp_replace({out}, '([.!?…])[)"''”]*\\s+([A-Z0-9“"''(])', '\\1\n\\2', 'g')"""
    return f"list_filter(list_transform(string_split(replace({out}, '․', '.'), '\n'), lambda x: trim(x)), lambda x: x <> '')"


@query(f"WITH {_CLEANED}, split AS (SELECT doc_id, {_split_sql('t')} AS s FROM cleaned) SELECT doc_id, len(s) AS sentences, md5(array_to_string(s, '|')) AS digest FROM split")
def sentence_split(spark, sf_dir):
    cleaned = _documents(spark, sf_dir).select("doc_id", cleaning.normalise_text(F.col("text")).alias("t"))
    found = cleaned.select("doc_id", segmenting.split_sentences(F.col("t")).alias("s"))
    return found.select("doc_id", F.size("s").cast("long").alias("sentences"), F.md5(F.array_join("s", "|").cast("binary")).alias("digest"))


def _merged_sql(sentences: str, most: int = 320) -> str:
    """Cutting and merging as folds over a list, whose states are texts: finished sentences by line, what waits behind \\r."""
    line = "regexp_extract({}, '[^\\n]*$')"
    pieces = f"list_filter(list_transform(string_split_regex(x, '(?i)\\s*(?:,\\s*)?\\b(?:but|however|although|though|whereas|yet)\\b\\s*'), lambda y: trim(y)), lambda y: y <> '')"
    commas = "list_filter(list_transform(string_split(x, ','), lambda y: trim(y)), lambda y: y <> '')"
    joined = f"list_reduce(CASE WHEN len({pieces}) >= 2 THEN {pieces} ELSE {commas} END, lambda a, b: a || CASE WHEN length({line.format('a')}) + 2 + length(b) <= {most} THEN ', ' ELSE '\n' END || b)"
    short = f"flatten(list_transform({sentences}, lambda x: CASE WHEN length(x) <= {most} THEN [x] ELSE string_split({joined}, '\n') END))"
    done, whole = "split_part(a, '\r', 1)", "ltrim(split_part(a, '\r', 2) || ' ' || b)"
    fits = f"{done} <> '' AND length({line.format(done)}) + 1 + length({whole}) <= {most}"
    fragment = f"(length({whole}) < 15 OR len(regexp_extract_all({whole}, '\\S+')) < 3)"
    step = f"CASE WHEN NOT {fragment} THEN ltrim({done} || '\n' || {whole}, '\n') || '\r' WHEN {fits} THEN {done} || ' ' || {whole} || '\r' ELSE {done} || '\r' || {whole} END"
    return f"list_reduce(list_prepend('\r', list_filter({short}, lambda x: length(x) >= 3)), lambda a, b: {step})"


@query(
    f"""WITH {_CLEANED}, folded AS (SELECT doc_id, {_merged_sql(_split_sql('t'))} AS a FROM cleaned), parts AS (SELECT doc_id, split_part(a, '\r', 1) AS done, split_part(a, '\r', 2) AS rest FROM folded),
  ended AS (SELECT doc_id, string_split(CASE WHEN rest = '' THEN done WHEN done <> '' AND length(regexp_extract(done, '[^\n]*$')) + 1 + length(rest) <= 320 THEN done || ' ' || rest ELSE ltrim(done || '\n' || rest, '\n') END, '\n') AS s FROM parts),
  rows AS (SELECT doc_id, unnest(list_filter(s, lambda x: length(x) >= 3)) AS text, generate_subscripts(list_filter(s, lambda x: length(x) >= 3), 1) - 1 AS position FROM ended)
  SELECT doc_id, CAST(position AS INTEGER) AS position, length(text) AS char_count, len(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}\\p{{M}}_]([\\p{{L}}\\p{{N}}\\p{{M}}_'']*[\\p{{L}}\\p{{N}}\\p{{M}}_])?')) AS word_count, md5(text) AS digest FROM rows"""
)
def sentences_full(spark, sf_dir):
    cleaned = _documents(spark, sf_dir).select("doc_id", cleaning.normalise_text(F.col("text")).alias("cleaned_body"))
    rows = segmenting.sentence_rows(cleaned)
    return rows.select("doc_id", "position", F.col("char_count").cast("long"), F.col("word_count").cast("long"), F.md5(F.col("text").cast("binary")).alias("digest"))


def _sentences(spark, sf_dir):
    return segmenting.sentence_rows(review_texts(spark, sf_dir).withColumnRenamed("body", "cleaned_body"))


#: What the lexicon rules say of each sentence that the synthetic reviews can hold (the closer "Nice." joins the sentence before).
_JUDGED = (
    ("The battery lasts all day and charges very fast.", "battery", "positive", 0.95, "fast"),
    ("The battery lasts all day and charges very fast.", "performance", "positive", 0.95, "fast"),
    ("Battery drains quickly, not good at all.", "battery", "negative", 0.92, "drains"),
    ("The camera takes sharp and vivid photos.", "camera", "positive", 0.95, "vivid"),
    ("Photos look grainy in low light.", "camera", "negative", 0.86, "grainy"),
    ("Photos look grainy in low light.", "design", "negative", 0.86, "grainy"),
    ("The screen is bright and the colors are stunning.", "display", "positive", 0.95, "stunning"),
    ("Performance is smooth, but the phone heats up while gaming.", "performance", "positive", 0.883, "smooth"),
    ("Performance is smooth, but the phone heats up while gaming. Nice.", "performance", "positive", 0.883, "smooth"),
    ("It hangs and the apps are sluggish.", "performance", "negative", 0.95, "sluggish"),
    ("It hangs and the apps are sluggish. Nice.", "performance", "negative", 0.773, "sluggish"),
    ("The design feels premium however the weight is heavy.", "design", "positive", 0.815, "premium"),
    ("The design feels premium however the weight is heavy. Nice.", "design", "positive", 0.815, "premium"),
    ("Great value for money.", "price", "positive", 0.95, "value for money"),
    ("Great value for money. Nice.", "price", "positive", 0.95, "value for money"),
    ("Overpriced, not worth it.", "price", "negative", 0.95, "not worth"),
    ("Overpriced, not worth it. Nice.", "price", "negative", 0.812, "not worth"),
    ("Really happy with the display.", "display", "positive", 0.939, "happy"),
    ("It dies by lunchtime.", "battery", "negative", 0.86, "dies"),
)
_PICKS = ", ".join(f"{_sql_list(v)}[1 + (review_id * {m}) % {len(v)}] AS {n}" for n, v, m in (("opener", OPENERS, 1), ("middle", MIDDLES, 3), ("closer", CLOSERS, 5)))
_SENTENCES = f"""picks AS (SELECT review_id, product_id, {_PICKS} FROM reviews),
  sentences AS (SELECT review_id, product_id, 0 AS position, opener AS text FROM picks UNION ALL SELECT review_id, product_id, 1, CASE WHEN closer = 'Nice.' THEN middle || ' Nice.' ELSE middle END FROM picks
    UNION ALL SELECT review_id, product_id, 2, closer FROM picks WHERE closer <> 'Nice.'),
  judged(text, aspect, sentiment, confidence, opinion_term) AS (VALUES {", ".join(f"('{t}', '{a}', '{s}', {c}, '{o}')" for t, a, s, c, o in _JUDGED)}),
  mentions AS (SELECT review_id, product_id, position, aspect, sentiment, CAST(confidence AS DOUBLE) AS confidence, opinion_term FROM sentences JOIN judged USING (text))"""


def _judged(sql: str) -> str:
    """A statement over the synthetic reviews' sentences and mentions."""
    return f"WITH reviews AS ({views.REVIEWS}), {_SENTENCES} {sql}"


@query(_judged("SELECT review_id, product_id, position, aspect, sentiment, confidence, opinion_term FROM mentions"))
def absa_lexicon(spark, sf_dir):
    return annotating.mention_rows(_sentences(spark, sf_dir)).select("review_id", "product_id", "position", "aspect", "sentiment", "confidence", "opinion_term")


@query(_judged(f", {relational._SCORES} SELECT * FROM scores"))
def absa_product_scores(spark, sf_dir):
    return scores.aspect_scores(annotating.mention_rows(_sentences(spark, sf_dir)))


@query(_judged("SELECT review_id, count(DISTINCT position) AS sentences, count(aspect) AS mentions FROM sentences LEFT JOIN mentions USING (review_id, product_id, position) GROUP BY 1"))
def review_nested(spark, sf_dir):
    rows = _sentences(spark, sf_dir).withColumn("sentence_id", F.col("review_id") * 1000 + F.col("position"))
    mentions = annotating.mention_rows(rows).select("sentence_id", "aspect", "sentiment")
    nested = corpus.nested_review(review_texts(spark, sf_dir).select("review_id"), rows.select("review_id", "sentence_id", "position", "text"), mentions)
    return nested.select("review_id", F.size("sentences").cast("long").alias("sentences"), F.aggregate("sentences", F.lit(0).cast("long"), lambda a, s: a + F.size(s["aspects"])).alias("mentions"))


@query(_judged("SELECT review_id, position, length(text) AS char_count, len(regexp_extract_all(text, '[A-Za-z]+')) AS word_count FROM sentences"))
def sentence_positions(spark, sf_dir):
    return _sentences(spark, sf_dir).select("review_id", "position", F.col("char_count").cast("long"), F.col("word_count").cast("long"))


def _aspect_pattern(aspect: str) -> str:
    words = sorted(Taxonomy().keywords[aspect], key=len, reverse=True)
    return "|".join(w.replace("'", "''") for w in words)


@query(
    views.with_views(
        "SELECT review_id, " + ", ".join(f"regexp_matches(lower(body), '(^|\\W)({_aspect_pattern(a)})($|\\W)') AS {a}" for a in views.ASPECTS) + " FROM review_texts",
        review_texts=REVIEW_TEXTS,
    )
)
def aspect_mentions(spark, sf_dir):
    has = lambda a: F.regexp_like("body", F.lit(rf"(?iU)(?<!\w)({'|'.join(sorted(Taxonomy().keywords[a], key=len, reverse=True))})(?!\w)"))
    return review_texts(spark, sf_dir).select("review_id", *(has(a).alias(a) for a in views.ASPECTS))


@query(
    _judged(
        """, m AS (SELECT review_id * 1000 + position AS sentence_id, aspect, sentiment, md5(concat_ws('|', review_id * 1000 + position, aspect, 42)) AS h FROM mentions),
  r AS (SELECT *, row_number() OVER (PARTITION BY sentiment ORDER BY h, sentence_id, aspect) AS k FROM m) SELECT sentence_id, aspect, sentiment FROM r WHERE k <= 66 ORDER BY h, sentence_id, aspect LIMIT 200"""
    )
)
def gold_sample(spark, sf_dir):
    from opinara.operators import pipeline

    rows = _sentences(spark, sf_dir).withColumn("sentence_id", F.col("review_id") * 1000 + F.col("position"))
    return pipeline.gold_sample(annotating.mention_rows(rows)).select("sentence_id", "aspect", "sentiment")


@query(
    _judged(
        """, top AS (SELECT review_id, count(*) AS labels FROM mentions GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1)
  SELECT review_id, (SELECT any_value(product_id) FROM reviews r WHERE r.review_id = top.review_id) AS product_id, labels, (SELECT least(8, count(*)) FROM sentences s WHERE s.review_id = top.review_id) AS sentences, least(12, labels) AS opinions FROM top"""
    )
)
def walkthrough(spark, sf_dir):
    from opinara.operators import pipeline

    rows = _sentences(spark, sf_dir)
    mentions = annotating.mention_rows(rows)
    told = pipeline.walkthrough(review_texts(spark, sf_dir).select("review_id", "product_id"), rows, mentions, scores.aspect_scores(mentions))
    return told.select("review_id", "product_id", "labels", F.size("sentences").cast("long").alias("sentences"), F.size("opinions").cast("long").alias("opinions"))
