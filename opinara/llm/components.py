"""Connected components of an edge table without collecting it.

Partitions first contract their own edges with a union-find (a spanning forest replaces them, so a dense
cluster shrinks to one row a node); large-star and small-star rounds then go on across
partitions until the edges are settled or few enough for one task.  Each round is a map-side combined minimum and one equi-join that adaptive execution may split, so one huge
component does not land in one task.  Every round is written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara.llm import store

MOST_ROUNDS = 60
#: Once so few edges are left they are finished by one task (16 bytes an edge): a bounded group on any input.
LOCAL_EDGES = 1 << 20


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union-find over edges ``a[i] - b[i]``: the nodes, and the smallest node of each one's component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = list(range(len(nodes)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(at[: len(a)].tolist(), at[len(a) :].tolist(), strict=True):
        x, y = find(x), find(y)
        if x != y:  # nodes are ascending, so the smaller index is the smaller node
            parent[max(x, y)] = min(x, y)
    return nodes, nodes[[find(x) for x in range(len(nodes))]] if len(nodes) else nodes


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        nodes, root = roots(batch.column(0).to_numpy(), batch.column(1).to_numpy())
        child = nodes != root
        yield pa.RecordBatch.from_arrays([pa.array(nodes[child]), pa.array(root[child])], names=["u", "v"])


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if held:
        nodes, root = roots(*(np.concatenate(c) for c in zip(*held, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(root)], names=["node", "component"])


def connected_components(edges: DataFrame) -> DataFrame:
    """``node long, component long`` (smallest node reachable) for every node of ``edges`` (two long columns).

    Self-loops and repeated edges are allowed; an empty table has no nodes.
    """
    a, b = edges.columns[:2]
    pairs = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v")
    now = store.materialise(pairs.mapInArrow(_contract, "u long, v long"), "cc-0", thin=True)
    for turn in range(1, MOST_ROUNDS):
        if now.count() <= LOCAL_EDGES:
            return store.materialise(now.coalesce(1).mapInArrow(_finish, "node long, component long"), "cc-end")
        # large star: every larger neighbour of u hangs on the smallest of u and its neighbours
        both = now.select("u", "v").unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        large = both.join(least, both.u == least.w).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = store.materialise(large.distinct(), f"cc-{turn}l")
        # small star: u and its smaller neighbours hang on the smallest of them (edges now point downwards)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low.select(F.col("u").alias("w"), "m"), large.u == F.col("w"))
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(low.select("u", F.col("m").alias("v")))
        after = store.materialise(small.where("u <> v").distinct(), f"cc-{turn}s")
        settled = _checksum(after) == _checksum(now)
        now = after
        if settled:
            break
    else:
        raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
    top = now.groupBy("u").agg(F.min("v").alias("component"))
    heads = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct().join(top.select(F.col("u").alias("node")), "node", "left_anti")
    return top.select(F.col("u").alias("node"), "component").unionAll(heads)


def _checksum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
