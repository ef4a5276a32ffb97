"""MinHash near-dedup (operator 5): SuperMinHash signatures, banding, exact verification, components.

SuperMinHash gives every set element a random permutation of the signature's slots (Fisher-Yates, drawn
from the element's hash); the slot drawn in round ``j`` competes with a value in ``[j, j + 1)``, so once all
slots hold a value below ``j + 1`` later rounds cannot matter and the document stops early.  Slots of one
element thus carry different ranks, which makes estimates less variable than independent minima.

Plan for one table of ``n`` documents:

* documents with equal shingle sets collapse to their smallest id (map-side combined, hot copies are cheap);
* a bucket (band value) compares its members' signatures with three of them (smallest id, smallest and largest
  hash), never all with all.  Pairs that agree loosely (``LOOSE``) make *clusters*: families of copies, whatever their size;
* a cluster is cut into blocks of about ``BLOCK`` documents.  Each block meets the first block in one task, where all
  pairs are looked at in memory, most alike first, and only what is not yet connected is confirmed on the full
  shingle sets.  In large clusters the documents outside the main component then meet every block, so no pair of
  different components stays untested: first by their signatures, then with the texts of those that may have a link;
* members of one bucket in different clusters are compared pair by pair, after large buckets are split by further
  slots (``_small_buckets``).

A pair is confirmed on full sets unless its signature estimate lies ``SLACK`` (about five standard deviations) below the
threshold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara.llm import shingles, store
from opinara.llm.components import connected_components

SLOTS = 256
BANDS = 51
ROWS = 5
THRESHOLD = 75
#: How far below the threshold (percent) a signature estimate may lie and still be verified.
SLACK = 14
#: Signature agreement (percent) from which bucket members belong to one cluster; documents of a block.
LOOSE, BLOCK = 25, 512
#: Members of a bucket that are compared pair by pair; larger buckets are split by further slots (sub-bands of each level).
HOT, SUB_BANDS, SUB_ROWS, LEVELS = 64, 6, 3, 4
#: Set elements whose permutations are drawn at once (256 bytes each).
SLICE = 1 << 17

_U = np.uint64


def super_minhash(flat: np.ndarray, counts: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """Signatures (documents x slots, float64) of sets given end to end; an empty set's are infinite.

    Equal sets have equal signatures; the share of equal slots estimates the Jaccard similarity.  A signature is a
    minimum over the elements, so sets are taken in slices of at most ``SLICE`` elements: memory is bounded.
    """
    out = np.full((len(counts), slots), np.inf)
    ends = np.cumsum(counts)
    doc = at = 0
    while at < len(flat):
        doc = int(np.searchsorted(ends, at, "right"))
        last = int(np.searchsorted(ends, at + SLICE, "right"))  # documents that end within the slice
        stop = int(ends[last - 1]) if last > doc else min(int(ends[doc]), at + SLICE)
        own = slice(doc, max(last, doc + 1))
        sizes = np.minimum(ends[own], stop) - np.maximum(ends[own] - counts[own], at)
        out[own] = np.minimum(out[own], _slice_minhash(flat[at:stop], sizes, slots))
        at = stop
    return out


def _slice_minhash(flat: np.ndarray, counts: np.ndarray, slots: int) -> np.ndarray:
    docs = len(counts)
    out = np.full((docs, slots), np.inf)
    if not len(flat):
        return out
    table = out.reshape(-1)
    owner = np.repeat(np.arange(docs), counts)
    x = flat
    kind = np.uint8 if slots <= 256 else np.uint16
    places = np.empty((len(flat), slots), dtype=kind)
    places[:] = np.arange(slots, dtype=kind)
    for j in range(slots):
        draw = shingles.mix(x + _U((j + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1)))
        k = j + ((draw >> _U(40)) % _U(slots - j)).astype(np.int64)
        rows = np.arange(len(x))
        slot = places[rows, k].astype(np.int64)
        places[rows, k] = places[:, j]
        value = j + (draw & _U((1 << 40) - 1)).astype(np.float64) * 2.0**-40
        np.minimum.at(table, owner * slots + slot, value)
        open_docs = (out >= j + 1).any(axis=1)  # early stop: a later round only has values from j + 1 on
        left = open_docs[owner]
        if not left.any():
            break
        if not left.all():
            x, owner, places = x[left], owner[left], places[left]
    return out


def band_keys(signatures: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key a band (documents x bands); the band's number is part of its key."""
    bits = np.ascontiguousarray(signatures).view(_U)[:, : bands * rows].reshape(len(signatures), bands, rows)
    key = np.broadcast_to(shingles.mix(np.arange(1, bands + 1, dtype=_U)), bits.shape[:2]).copy()
    for r in range(rows):
        key = shingles.mix(key ^ (bits[:, :, r] * shingles._PLACE[r]))
    return key.view(np.int64)


def short_signatures(signatures: np.ndarray) -> np.ndarray:
    """Eight bits of each slot."""
    return (shingles.mix(np.ascontiguousarray(signatures).view(_U)) & _U(255)).astype(np.uint8)


def estimated_percent(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity in percent from eight-bit signatures, corrected for chance agreement."""
    agree = (a == b).mean(axis=1)
    return 100 * (agree - 1 / 256) / (1 - 1 / 256)


def _binary(rows: np.ndarray) -> pa.Array:
    width = rows.shape[1] * rows.itemsize
    at = pa.py_buffer((np.arange(len(rows) + 1, dtype=np.int32) * width).tobytes())
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, at, pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def _set_key_batches(words: int, signer):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = shingles.string_buffers(batch.column(1))
            for a, b in shingles.chunks(offsets):
                flat, counts = shingles.shingle_hashes(raw, offsets[a : b + 1], words)
                keys = shingles.set_keys(flat, counts)
                sig = signer(flat, counts)
                bands = band_keys(sig)
                list_at = pa.array(np.arange(len(counts) + 1, dtype=np.int32) * BANDS)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array(counts),
                        pa.array(keys.view(np.int64)[:, 0], mask=counts == 0),
                        pa.array(keys.view(np.int64)[:, 1], mask=counts == 0),
                        _binary(short_signatures(sig)),
                        pa.ListArray.from_arrays(list_at, pa.array(bands.reshape(-1))),
                    ],
                    names=["doc_id", "n_shingles", "k1", "k2", "sig", "bands"],
                )

    return run


def _estimate_batches(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint8).reshape(batch.num_rows, SLOTS) for c in (2, 3))
            yield batch.select([0, 1]).filter(pa.array(estimated_percent(a, b) >= least))

    return run


def _sets_of(column, words: int) -> list[np.ndarray]:
    raw, offsets = shingles.string_buffers(column)
    rows: list[np.ndarray] = []
    for i, j in shingles.chunks(offsets):
        flat, counts = shingles.shingle_hashes(raw, offsets[i : j + 1], words)
        rows += np.split(flat, np.cumsum(counts)[:-1])
    return rows


def link_block(ids: np.ndarray, sets: list[np.ndarray], groups: np.ndarray, threshold: int, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Confirmed links that connect documents of different groups: a spanning forest, not all pairs.

    Pairs are tried most alike first and only while their documents are unconnected.  ``wanted`` marks documents
    of which a pair needs at least one.
    """
    counts = np.array([len(s) for s in sets])
    small = short_signatures(super_minhash(np.concatenate(sets) if sets else np.empty(0, _U), counts))
    where = {g: k for k, g in reversed(list(enumerate(groups.tolist())))}
    parent = [where[g] for g in groups.tolist()]

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    left, right, alike = [], [], []
    for i in range(len(ids) - 1):
        agree = (small[i + 1 :] == small[i]).sum(axis=1) / SLOTS
        estimate = 100 * (agree - 1 / 256) / (1 - 1 / 256)
        sizes = counts[i + 1 :]
        fits = 100 * np.minimum(sizes, counts[i]) >= threshold * np.maximum(sizes, counts[i])
        fits &= (estimate >= threshold - SLACK) & (groups[i + 1 :] != groups[i])
        if wanted is not None and not wanted[i]:
            fits &= wanted[i + 1 :]
        j = np.flatnonzero(fits)
        left.append(np.full(len(j), i))
        right.append(j + i + 1)
        alike.append(estimate[j])
    if not left:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    left, right, alike = (np.concatenate(x) for x in (left, right, alike))
    out_a, out_b = [], []
    for k in np.argsort(-alike, kind="stable").tolist():
        i, j = int(left[k]), int(right[k])
        x, y = find(i), find(j)
        if x == y:
            continue
        common, union = shingles.jaccard_counts(sets[i], sets[j])
        if union and 100 * common >= threshold * union:
            parent[max(x, y)] = min(x, y)
            out_a.append(ids[i])
            out_b.append(ids[j])
    return np.array(out_a, dtype=np.int64), np.array(out_b, dtype=np.int64)


def _link_tile(words: int, threshold: int):
    def run(table: pa.Table) -> pa.Table:
        if table.num_rows < 2:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        table = table.combine_chunks()
        ids, groups = table.column("rep").to_numpy(), table.column("comp").to_numpy()
        wanted = table.column("wanted").to_numpy(zero_copy_only=False).astype(bool)
        a, b = link_block(ids, _sets_of(table.column("load"), words), groups, threshold, None if wanted.all() else wanted)
        if table.num_rows >= 64:
            store.trim()
        return pa.table({"a": pa.array(a), "b": pa.array(b)})

    return run


def _verify_batches(words: int, threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in range(0, batch.num_rows, 256):  # bounded memory for pairs of long texts
                part = batch.slice(piece, 256)
                sizes = [shingles.jaccard_counts(x, y) for x, y in zip(_sets_of(part.column(2), words), _sets_of(part.column(3), words), strict=True)]
                yield part.select([0, 1]).filter(pa.array([100 * i >= threshold * u and u > 0 for i, u in sizes], type=pa.bool_()))

    return run


def _alike(pairs: DataFrame, signatures: DataFrame, least: float) -> DataFrame:
    """The distinct pairs whose signatures agree to at least ``least`` percent, as a table."""
    sig = signatures.select("rep", "sig")
    joined = pairs.distinct().join(sig.select(F.col("rep").alias("a"), F.col("sig").alias("sa")), "a").join(sig.select(F.col("rep").alias("b"), F.col("sig").alias("sb")), "b")
    return store.materialise(joined.select("a", "b", "sa", "sb").mapInArrow(_estimate_batches(least), "a long, b long"), "near-pairs")


def _texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    return docs.join(ids.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi").select(F.col("doc_id").alias("rep"), "text")


def _likely_tile(threshold: int):
    """The documents of a tile that may have a link there, by their signatures alone."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        n = table.num_rows
        small = np.frombuffer(b"".join(table.column("load").to_pylist()), dtype=np.uint8).reshape(n, SLOTS)
        groups = table.column("comp").to_numpy()
        wanted = table.column("wanted").to_numpy(zero_copy_only=False).astype(bool)
        least = (threshold - SLACK) / 100 * (1 - 1 / 256) + 1 / 256
        likely = np.zeros(n, dtype=bool)
        for i in range(n - 1):
            fits = ((small[i + 1 :] == small[i]).sum(axis=1) >= least * SLOTS) & (groups[i + 1 :] != groups[i])
            if not wanted[i]:
                fits &= wanted[i + 1 :]
            likely[i] |= fits.any()
            likely[i + 1 :] |= fits
        return pa.table({"rep": pa.array(table.column("rep").to_numpy()[likely], pa.int64())})

    return run


def _meetings(apart: DataFrame, loads: DataFrame):
    """Documents (``rep, cluster, comp, main``) dealt to tiles, each with its load (``rep, load``).

    Documents outside the main component of their cluster meet it block by block, and each other part by part.
    """
    wanted = F.col("comp") != F.col("main")
    sizes = apart.groupBy("cluster").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks"), F.greatest(F.lit(1), F.ceil(F.count_if(wanted) / F.lit(BLOCK))).cast("int").alias("parts"))
    rows = apart.join(sizes, "cluster").join(loads, "rep")
    block, part = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"), F.pmod(F.xxhash64("rep", F.lit(1)), F.col("parts")).cast("int")
    all_blocks, all_parts = F.sequence(F.lit(0), F.col("blocks") - 1), F.sequence(F.lit(0), F.col("parts") - 1)
    # a document's places: (tile, part); tiles below zero are for pairs of parts
    main = F.transform(all_parts, lambda k: F.struct(block.alias("tile"), k.alias("part")))
    others = F.transform(all_parts, lambda k: F.struct((-1 - F.least(part, k)).alias("tile"), F.greatest(part, k).alias("part")))
    outside = F.concat(F.transform(all_blocks, lambda k: F.struct(k.alias("tile"), part.alias("part"))), others)
    placed = rows.withColumn("at", F.explode(F.when(wanted, outside).otherwise(main)))
    return placed.select("cluster", "at.tile", "at.part", "rep", "comp", wanted.alias("wanted"), "load").groupBy("cluster", "tile", "part")


def _cluster_links(members: DataFrame, signatures: DataFrame, texts: DataFrame, words: int, threshold: int) -> DataFrame:
    """Links that connect the documents (``rep, cluster``) of every cluster."""
    work = _link_tile(words, threshold)
    sizes = members.groupBy("cluster").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks"))
    placed = members.join(sizes, "cluster").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    # the first block goes to every task of its cluster, the others to their own
    dealt = placed.join(texts, "rep").withColumn("tile", F.explode(F.when(F.col("own") == 0, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("own"))))
    first = dealt.select("cluster", "tile", "rep", F.col("rep").alias("comp"), F.lit(True).alias("wanted"), F.col("text").alias("load")).groupBy("cluster", "tile").applyInArrow(work, "a long, b long")
    links = store.materialise(first, "near-links")
    large = store.materialise(placed.where("blocks > 1"), "near-large", thin=True)
    if large.isEmpty():
        return links
    grouped = connected_components(links).withColumnRenamed("node", "rep")
    named = large.join(grouped, "rep", "left").select("rep", "cluster", F.coalesce("component", "rep").alias("comp"))
    per = named.groupBy("cluster", "comp").agg(F.count("*").alias("n"))
    main = per.groupBy("cluster").agg(F.max(F.struct("n", "comp"))["comp"].alias("main"), F.sum("n").alias("all"), F.max("n").alias("most"))
    apart = store.materialise(named.join(main.where("most < all").select("cluster", "main"), "cluster"), "near-apart", thin=True)
    if apart.isEmpty():
        return links
    # signatures say who may have a link to another component; only those texts are dealt
    likely = _meetings(apart, signatures.select("rep", F.col("sig").alias("load"))).applyInArrow(_likely_tile(threshold), "rep long")
    apart = store.materialise(apart.join(store.materialise(likely, "near-likely").distinct(), "rep", "left_semi"), "near-apart", thin=True)
    if apart.isEmpty():
        return links
    second = _meetings(apart, texts.select("rep", F.col("text").alias("load"))).applyInArrow(work, "a long, b long")
    return links.unionAll(store.materialise(second, "near-links"))


def _small_buckets(named: DataFrame, reps: DataFrame) -> DataFrame:
    """The members (``key, rep, cluster``) of buckets that hold several clusters, in buckets of at most HOT members.

    Documents that share a long passage may meet in one bucket by the thousand although they are unlike.  Such a
    bucket is split by SUB_BANDS keys of SUB_ROWS further slots each: two documents at the threshold lose a bucket
    with probability 0.04 and all their (about twelve) buckets with 2e-6, unlike ones part.  What is still larger
    after LEVELS splits is kept whole.
    """
    found = None
    for level in range(LEVELS + 1):
        sizes = named.groupBy("key").agg(F.count("*").alias("n"), F.min("cluster").alias("lo"), F.max("cluster").alias("hi")).where("lo < hi")
        sizes = store.materialise(sizes.select("key", "n"), "near-buckets")
        keep = sizes if level == LEVELS else sizes.where(F.col("n") <= HOT)
        part = named.join(keep.select("key"), "key")
        found = part if found is None else found.unionAll(part)
        hot = sizes.where(F.col("n") > HOT)
        if level == LEVELS or hot.isEmpty():
            return found
        rows = named.join(hot.select("key"), "key").join(reps.select("rep", "sig"), "rep").withColumn("band", F.explode(F.sequence(F.lit(0), F.lit(SUB_BANDS - 1))))
        place = lambda i: F.pmod(F.xxhash64("key", "band", F.lit(i)), F.lit(SLOTS)).cast("int") + 1
        picked = [F.substr("sig", place(i), F.lit(1)) for i in range(SUB_ROWS)]
        named = store.materialise(rows.select(F.xxhash64("key", "band", *picked).alias("key"), "rep", "cluster"), "near-split")


def near_duplicates(docs: DataFrame, words: int = shingles.WORDS, threshold: int = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", signer=super_minhash) -> DataFrame:
    """One row per document: ``doc_id long, n_shingles long, component_id long, kept boolean``.

    Documents are linked when ``100 * |intersection| >= threshold * |union|`` of their word-shingle sets.
    Null and empty texts have an empty set and are linked with nothing; rows with equal sets are one class;
    ids should be unique (repeated rows of one id and text give repeated rows); rows with a null id keep a null component and are kept.
    ``signer`` makes the signatures of a batch of sets (documents x SLOTS).  Other columns are ignored, whatever their names.  An empty table gives an empty result.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, n_shingles long, k1 long, k2 long, sig binary, bands array<long>"
    sets = store.materialise(source.mapInArrow(store.trimmed(_set_key_batches(words, signer)), schema), "near-sets")
    known = sets.where("doc_id IS NOT NULL AND n_shingles > 0")
    classes = known.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"))
    classes = store.materialise(classes, "near-classes")
    # one row for each distinct set: that of its smallest id (a repeated id's rows are equal or of other classes)
    reps = known.select("doc_id", "k1", "k2", "sig", "bands").join(
        classes.select(F.col("rep").alias("doc_id"), F.col("k1").alias("j1"), F.col("k2").alias("j2")), "doc_id"
    ).where("k1 = j1 AND k2 = j2").select(F.col("doc_id").alias("rep"), "sig", "bands")
    reps = store.materialise(reps, "near-reps")
    rows = reps.select("rep", F.explode("bands").alias("key"))
    # only buckets that hold several sets matter from here on; each gets three centres, by an order that all
    # buckets share: the buckets of one family mostly choose the same few
    at = F.struct(F.xxhash64("rep").alias("h"), "rep")
    crowded = rows.groupBy("key").agg(F.min("rep").alias("c0"), F.max("rep").alias("top"), F.min(at)["rep"].alias("c1"), F.max(at)["rep"].alias("c2")).where("c0 < top")
    members = store.materialise(rows.join(crowded.drop("top"), "key"), "near-members")
    centred = members.select("rep", F.explode(F.array_distinct(F.array("c0", "c1", "c2"))).alias("centre")).where("rep <> centre")
    loose = _alike(centred.select(F.least("rep", "centre").alias("a"), F.greatest("rep", "centre").alias("b")), reps, LOOSE)
    clusters = connected_components(loose).select(F.col("node").alias("rep"), F.col("component").alias("cluster"))
    texts = source.where("doc_id IS NOT NULL")
    near_texts = store.materialise(_texts_of(texts, clusters), "near-texts")
    links = _cluster_links(clusters, reps, near_texts, words, threshold)

    named = members.select("key", "rep").join(clusters, "rep", "left").select("key", "rep", F.coalesce("cluster", "rep").alias("cluster"))
    apart = _small_buckets(store.materialise(named, "near-named"), reps)
    right = apart.select("key", F.col("rep").alias("rep2"), F.col("cluster").alias("cluster2"))
    across = apart.join(right, "key").where("rep < rep2 AND cluster <> cluster2").select(F.col("rep").alias("a"), F.col("rep2").alias("b"))
    across = _alike(across, reps, threshold - SLACK)
    if not across.isEmpty():
        wanted = across.select(F.col("a").alias("rep")).unionAll(across.select(F.col("b").alias("rep")))
        told = store.materialise(_texts_of(texts, wanted), "near-texts")
        full = across.join(told.select(F.col("rep").alias("a"), F.col("text").alias("ta")), "a").join(told.select(F.col("rep").alias("b"), F.col("text").alias("tb")), "b")
        links = links.unionAll(store.materialise(full.select("a", "b", "ta", "tb").mapInArrow(_verify_batches(words, threshold), "a long, b long"), "near-links"))
    grouped = connected_components(links)
    of_class = classes.join(grouped.withColumnRenamed("node", "rep"), "rep", "left").select("k1", "k2", F.coalesce("component", "rep").alias("component_id"))
    return (
        sets.select("doc_id", "n_shingles", "k1", "k2")
        .join(of_class, ["k1", "k2"], "left")
        .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """``docs`` (all columns) without the documents that near-duplicate a smaller id; repeated ids keep one row each.

    Rows with a null id stay.
    """
    name = "_dropped"
    while name in docs.columns:
        name += "_"
    drop = near_duplicates(docs, **options).where("NOT kept").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(drop, docs[options.get("id_col", "doc_id")].cast("long") == drop[name], "left_anti")
