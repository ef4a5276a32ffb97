"""Document fingerprints (operator 2): MinHash with universal hash permutations over word shingles.

A fingerprint keeps eight bits of the minimum of each of ``PERMUTATIONS`` multiply-add permutations.  All
permutations of a batch of documents run as numpy passes over one flat array of shingle hashes.

* ``fingerprints`` adds a fingerprint to every document (no shuffle);
* ``neighbour_fingerprints`` also compares each document with the next one and with its edited text; it
  deals the table by id range, in one shuffle, and streams each range in order;
* ``near_documents`` joins signature bands in Spark and verifies Jaccard on the full sets.

Null and empty texts have the all-zero fingerprint, which is like (1.0) another empty text's and unlike (0.0)
any other.  Repeated rows and ids are treated row by row; rows with a null id come last in the order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara.llm import near_dedup, shingles, store
from opinara.llm.ordering import id_ranges

PERMUTATIONS = 128
_U = np.uint64
_LOWEST = -(2**63)


def _coefficients(count: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = np.arange(1, 2 * count + 1, dtype=_U) * _U(0x8CB92BA72F3D8DD7)
    mixed = shingles.mix(seeds)
    return mixed[:count] | _U(1), mixed[count:]


def minhash(flat: np.ndarray, counts: np.ndarray, permutations: int = PERMUTATIONS) -> np.ndarray:
    """Minima (documents x permutations, uint64) of ``a * x + b mod 2**64``; an empty set's are all ones."""
    out = np.full((len(counts), permutations), np.iinfo(_U).max, dtype=_U)
    some = counts > 0
    if not some.any():
        return out
    starts = (np.cumsum(counts) - counts)[some]
    a, b = _coefficients(permutations)
    value = np.empty_like(flat)
    minima = np.empty((permutations, len(starts)), dtype=_U)
    for p in range(permutations):
        np.multiply(flat, a[p], out=value)
        np.add(value, b[p], out=value)
        minima[p] = np.minimum.reduceat(value, starts)
    out[some] = minima.T
    return out


def digest(signatures: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Eight bits of each minimum; zero throughout for an empty set."""
    small = (shingles.mix(signatures) & _U(255)).astype(np.uint8)
    small[counts == 0] = 0
    return small


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity (0 to 1) of fingerprints, row by row."""
    agree = np.maximum(0.0, ((a == b).mean(axis=1) - 1 / 256) / (1 - 1 / 256))
    empty_a, empty_b = ~a.any(axis=1), ~b.any(axis=1)
    return np.where(empty_a | empty_b, (empty_a & empty_b).astype(float), agree)


def of_texts(texts: list[str | None], words: int = shingles.WORDS) -> np.ndarray:
    """Fingerprints (texts x PERMUTATIONS, uint8)."""
    raw, offsets = shingles.from_texts(texts)
    out = np.zeros((len(texts), PERMUTATIONS), dtype=np.uint8)
    for a, b in shingles.chunks(offsets):
        flat, counts = shingles.shingle_hashes(raw, offsets[a : b + 1], words)
        out[a:b] = digest(minhash(flat, counts), counts)
    return out


def edited(text: str, following: str) -> str:
    """The last third of ``text`` replaced by as much of the start of ``following``."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def _hex(rows: np.ndarray) -> list[str]:
    return [r.tobytes().hex() for r in rows]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id long, fingerprint string`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_hex(of_texts(batch.column(1).to_pylist())), pa.string())], names=["doc_id", "fingerprint"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fingerprint string")


_NEIGHBOURS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
#: Texts of one step of the stream: at most so many rows and code points (a longer text makes a step alone).
STEP_ROWS, STEP_CHARS = 256, 2_000_000


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by range, in descending id order, the range's follower (``context``) last."""

    def result(ids: list, texts: list[str], follower: str) -> pa.RecordBatch:
        # fingerprints of the texts and the follower, then of the edited texts
        changed = [edited(t, f) for t, f in zip(texts, [*texts[1:], follower], strict=True)]
        own, new = of_texts([*texts, follower]), of_texts(changed)
        columns = [
            pa.array(ids, pa.int64()),
            pa.array([len(t) for t in texts], pa.int64()),
            pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed], pa.string()),
            pa.array(_hex(own[:-1]), pa.string()),
            pa.array(_hex(new), pa.string()),
            pa.array(likeness(own[:-1], new)),
            pa.array(likeness(own[:-1], own[1:])),
        ]
        return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _NEIGHBOURS.split(", ")])

    ids: list = []
    texts: list[str] = []
    held, closed = 0, None
    for batch in batches:
        for i, text, where, context in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            text = text or ""
            if where == closed:  # further rows of the follower's id
                continue
            if texts and (context or len(texts) >= STEP_ROWS or held >= STEP_CHARS):
                yield result(ids, texts, text)
                ids, texts, held = [], [], 0
            if context:
                closed = where
            else:
                ids.append(i)
                texts.append(text)
                held += len(text)
    if texts:
        raise AssertionError("a range of documents came without its follower")


def neighbour_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document beside its successor in descending id order (after the last: the first).

    Returns ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``.
    Rows of one id are ordered by text; a table of one row is its own successor; an empty table gives none.
    """
    spark = docs.sparkSession
    n = store.partitions(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ranges = id_ranges(rows, "doc_id", n)
    keyed = rows.select("doc_id", "text", F.coalesce("doc_id", F.lit(_LOWEST)).alias("key"), ranges.column("doc_id").alias("own"))
    tops = {r["own"]: r["top"] for r in keyed.groupBy("own").agg(F.max("key").alias("top")).collect()}  # <= n rows
    used = sorted(tops)
    follows = {a: b for a, b in zip(used, [*used[1:], *used[:1]], strict=True)}
    literal = lambda of, kind: F.split(F.lit(",".join(str(of.get(c, "")) for c in range(n))), ",").cast("array<string>")
    top = F.element_at(literal(tops, "bigint"), F.col("own") + 1)
    to = F.element_at(literal(follows, "int"), F.col("own") + 1).cast("int")
    here = F.struct(F.col("own").alias("to"), F.lit(False).alias("context"))
    there = F.struct(to.alias("to"), F.lit(True).alias("context"))
    dealt = keyed.withColumn("go", F.explode(F.when(F.col("key").cast("string") == top, F.array(here, there)).otherwise(F.array(here))))
    dealt = dealt.select("doc_id", "text", F.col("go.to").alias("to"), F.col("go.context").alias("context"), "key")
    ordered = dealt.repartitionById(n, F.col("to")).sortWithinPartitions("to", "context", F.desc("key"), "text")
    return ordered.select("doc_id", "text", "to", "context").mapInArrow(_neighbours, _NEIGHBOURS)


def near_documents(docs: DataFrame, **options) -> DataFrame:
    """Near-duplicate classes from banded universal-hash signatures, every link verified by Jaccard."""

    def sign(flat: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return minhash(flat, counts, near_dedup.SLOTS).view(np.float64)

    return near_dedup.near_duplicates(docs, signer=sign, **options)
