"""Embedding near-dedup (operator 6): int8 tile products with rigorous error bounds.

A unit vector ``u`` is stored as ``s * q + e`` with int8 ``q``; ``|e|`` is measured, not assumed.  For two
vectors ``|u.v - s_u s_v q_u.q_v| <= |e_u| (1 + |e_v|) + |e_v|``, so a pair whose quantised product plus that
bound (and a float allowance) stays below the threshold cannot reach it; only the others are recomputed in
double precision from the original components.

Equal vectors of a label collapse first (map-side combined).  The distinct vectors of a label are dealt to
blocks of about ``BLOCK`` rows by hash and every pair of blocks is one tile: a label that holds a third of all
rows becomes many tiles of bounded size.  A tile returns one row for each vector that has a link in it (its
links and the smallest vector of its local component), never the pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara.llm import store
from opinara.llm.components import connected_components

THRESHOLD = 0.93
BLOCK = 1024
#: Allowance for rounding in the quantised products and bounds (many times what doubles need).
FLOAT_SLACK = 1e-6


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(q int8, scale, |error|)`` of unit vectors (rows)."""
    scale = np.abs(unit).max(axis=1) / 127
    q = np.rint(unit / scale[:, None]).astype(np.int8)
    error = np.sqrt(((unit - q * scale[:, None]) ** 2).sum(axis=1))
    return q, scale, error


def _quantised_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products (float32 holds every partial sum below 2**24)."""
    kind = np.float32 if a.shape[1] * 127 * 127 < 1 << 24 else np.float64
    return a.astype(kind) @ b.astype(kind).T


def linked_pairs(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD, same: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of all pairs with cosine >= threshold (``same``: a is b, pairs i < j once)."""
    norms = [np.sqrt((x * x).sum(axis=1)) for x in (a, b)]
    (qa, sa, ea), (qb, sb, eb) = (quantise(x / n[:, None]) for x, n in zip((a, b), norms, strict=True))
    found_i, found_j = [], []
    for at in range(0, len(a), 512):
        rows = slice(at, at + 512)
        product = _quantised_product(qa[rows], qb).astype(np.float64) * sa[rows, None] * sb[None, :]
        bound = ea[rows, None] * (1 + eb[None, :]) + eb[None, :] + FLOAT_SLACK
        i, j = np.nonzero(product + bound >= threshold)
        i = i + at
        if same:
            upper = i < j
            i, j = i[upper], j[upper]
        for part in range(0, len(i), 1 << 16):  # full precision, a bounded number of pairs at a time
            x, y = i[part : part + (1 << 16)], j[part : part + (1 << 16)]
            cosine = (a[x] * b[y]).sum(axis=1) / (norms[0][x] * norms[1][y])
            keep = cosine >= threshold
            found_i.append(x[keep])
            found_j.append(y[keep])
    none = np.empty(0, dtype=np.int64)
    return (np.concatenate(found_i), np.concatenate(found_j)) if found_i else (none, none)


def smallest_reachable(i: np.ndarray, j: np.ndarray, names: np.ndarray) -> np.ndarray:
    """For every node of the graph with edges ``i - j``: the smallest name reachable (vectorised)."""
    top = names.copy()
    while len(i):
        low = np.minimum(top[i], top[j])
        new = top.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        if (new == top).all():
            break
        top = new
    return top


def _vector_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors as bytes of doubles and a key of their content; unusable ones have a null key."""
    for batch in batches:
        keys, data = [], []
        for components in batch.column(2).to_pylist():
            ok = components is not None and len(components) > 0 and None not in components
            vector = np.asarray(components, dtype=np.float64) + 0.0 if ok else np.empty(0)
            if not ok or not np.isfinite(vector).all() or not vector.any():
                keys.append(None)
                data.append(None)
                continue
            size = int(np.frexp(np.abs(vector).max())[1])
            if abs(size) > 100:  # the cosine does not depend on it, but squares would leave the range of doubles
                vector = np.ldexp(vector, -size)
            raw = vector.astype("<f8").tobytes()
            keys.append(hashlib.sha256(raw).digest()[:20])
            single = vector.astype("<f4")
            data.append(single.tobytes() + b"\0" if (single == vector).all() else raw)  # the odd length marks floats
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array(data, pa.binary())], names=["vec_id", "label", "key", "data"])


def _vectors(data: list[bytes]) -> np.ndarray:
    return np.stack([np.frombuffer(d[:-1], "<f4").astype(np.float64) if len(d) % 2 else np.frombuffer(d, "<f8") for d in data])


def _tile(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        rep = table.column("rep").to_numpy()
        side = table.column("side").to_numpy()
        copies = table.column("copies").to_numpy()
        data = table.column("data").to_pylist()
        width = np.array([(len(d) - 1) * 2 if len(d) % 2 else len(d) for d in data])
        links, top = np.zeros(len(rep), dtype=np.int64), rep.copy()
        for dim in np.unique(width):  # vectors of different dimension have no cosine
            left, right = np.flatnonzero((side <= 0) & (width == dim)), np.flatnonzero((side >= 0) & (width == dim))
            if not len(left) or not len(right):
                continue
            same = bool((side == 0).all())
            a = _vectors([data[k] for k in left])
            b = a if same else _vectors([data[k] for k in right])
            i, j = linked_pairs(a, b, threshold, same)
            i, j = left[i], right[j]
            np.add.at(links, i, copies[j])
            np.add.at(links, j, copies[i])
            top = np.minimum(top, smallest_reachable(i, j, rep))
        some = np.flatnonzero(links)
        return pa.table({"rep": pa.array(rep[some], pa.int64()), "links": pa.array(links[some], pa.int64()), "top": pa.array(top[some], pa.int64())})

    return run


def embedding_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per vector: ``vec_id long, n_links long, component_id long, kept boolean``.

    Only vectors of equal, non-null label are compared.  Null, empty, zero or non-finite vectors and those with
    null components link with nothing; so do vectors of different dimension.  Repeated rows are links of each
    other (each id should be unique; a repeated id's rows then share a component).  A null id is kept, without a
    component.  An empty table gives an empty result.  Other columns are ignored.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).alias("v"))
    coded = store.materialise(rows.mapInArrow(_vector_batches, "vec_id long, label string, key binary, data binary"), "vectors")
    usable = coded.where("key IS NOT NULL AND label IS NOT NULL AND vec_id IS NOT NULL")
    classes = usable.groupBy("label", "key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    classes = store.materialise(classes, "vector-classes")
    blocks = classes.groupBy("label").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / F.lit(BLOCK))).cast("int").alias("blocks"))
    distinct = usable.join(classes.select("rep", "copies", F.col("label").alias("l"), F.col("key").alias("k")), F.col("vec_id") == F.col("rep")).where("label = l AND key = k").dropDuplicates(["label", "key"])
    dealt = distinct.join(blocks, "label").select("label", "rep", "copies", "data", "blocks", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int").alias("own"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiles = dealt.select("label", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), F.signum(F.col("own") - F.col("other")).cast("int").alias("side"), "rep", "copies", "data")
    found = tiles.groupBy("label", "lo", "hi").applyInArrow(_tile(threshold), "rep long, links long, top long")
    found = store.materialise(found, "vector-links")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    groups = connected_components(found.select("rep", "top"))
    of_class = classes.join(links, "rep", "left").join(groups.withColumnRenamed("node", "rep"), "rep", "left")
    of_class = of_class.select("label", "key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    alone = coded.where("NOT (key IS NOT NULL AND label IS NOT NULL AND vec_id IS NOT NULL)").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    result = usable.select("vec_id", "label", "key").join(of_class, ["label", "key"]).select("vec_id", "n_links", "component_id").unionAll(alone)
    return result.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
