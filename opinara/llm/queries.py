"""The queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinara.llm import embedding_dedup, fingerprints, html_template, mixing, near_dedup, packing, token_store, toxicity, url_filter, warc

RULES = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    model = url_filter.train_from(url_filter.labelled_by_rules(pages, RULES))
    return url_filter.judge(pages, RULES, model)


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.neighbour_fingerprints(_table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole rows, in the order of the mixture."""
    out = mixing.with_slots(_table(spark, sf_dir, "documents")).orderBy("_position")
    return out.withColumnsRenamed({c: c.removeprefix("_") for c in mixing.ADDED})


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_template.main_text(_table(spark, sf_dir, "pages"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_duplicates(_table(spark, sf_dir, "embeddings"))


def op7_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.read_tokens(token_store.write_tokens(_table(spark, sf_dir, "documents")))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_warc(warc.write_warc(_table(spark, sf_dir, "pages")))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train_from(docs, _table(spark, sf_dir, "labels")))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_url_filter, op2_fingerprints, op3_mixing, op4_html_text, op5_near_dedup, op6_embedding_dedup, op7_token_ids, op8_warc, op9_packing, op10_toxicity)
    return {f.__name__: f for f in ops} | {"pipeline": pipeline}


_REACH = """reach(n, c) AS (SELECT n, n FROM nodes UNION SELECT l.b, r.c FROM reach r JOIN links l ON l.a = r.n),
  names AS (SELECT n, min(c) AS component_id FROM reach GROUP BY 1)"""

_NEAR = (
    r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
  s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')] ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS h FROM w),
  sizes AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
  common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.h = y.h AND x.doc_id <> y.doc_id GROUP BY 1, 2),
  links AS (SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * k >= 75 * (p.n + q.n - k)),
  nodes AS (SELECT doc_id AS n FROM documents), """
    + _REACH
    + " SELECT d.doc_id, coalesce(z.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept FROM documents d JOIN names c ON c.n = d.doc_id LEFT JOIN sizes z ON z.doc_id = d.doc_id"
)

_VECTORS = (
    """WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  u AS (SELECT * FROM v WHERE list_dot_product(e, e) > 0),
  links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
  nodes AS (SELECT vec_id AS n FROM embeddings), counts AS (SELECT a, count(*) AS k FROM links GROUP BY 1), """
    + _REACH
    + " SELECT n AS vec_id, coalesce(k, 0) AS n_links, component_id, n = component_id AS kept FROM names LEFT JOIN counts ON a = n"
)

_WARC = """WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages), h AS (SELECT page_id, octet_length(encode(t)) AS payload_bytes, sha1(t) AS x, max(page_id) OVER (PARTITION BY t) AS top FROM p)
  SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(x || '00', CAST(1 + (5 * i) // 4 AS INTEGER), 3) AS INTEGER) >> CAST(7 - (5 * i) % 4 AS INTEGER)) & 31 AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id < top THEN top END AS refers_to FROM h"""


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that SQL can express; the others are compared with brute force in the tests."""
    return {"op5_near_dedup": _NEAR, "op6_embedding_dedup": _VECTORS, "op8_warc": _WARC}
