"""Token-id output (operator 7): id ranges written as Re-Pair grammars, readable document by document.

A file is a row of sections, each with its own grammar and readable alone; a section holds the ids of consecutive
documents (ascending id).  Re-Pair replaces the most frequent pairs of
neighbouring symbols by nonterminals until no pair occurs LEAST_COUNT times; a pair never spans two documents, so a
document is a run of symbols and is decoded alone.  Pairs whose counts share a power of four are replaced in one
vectorised step, the more frequent first where they overlap, and all counts are current when a step begins.

Section layout (little-endian, parts in this order):

    magic "OPRP0002" | header length u32 | header JSON
    rules   u32 x 2 x rules      left and right symbol of nonterminal first_rule + i (symbols of earlier steps only)
    lengths u32 x rules          ids that a nonterminal expands to
    ids     i64 x docs, present u8 x docs (0: null id), first symbol u64 x (docs + 1), n_ids u64 x docs
    symbols u16 or u32 x symbols
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opinara.llm import store
from opinara.llm.ordering import id_ranges
from opinara.llm.tokens import default_tokenizer, encoder, forget

END_ID = 1
#: Ids of one section (its arrays stay in a core's cache; a longer document has one of its own), and of one file.
SECTION_IDS, FILE_IDS = 1 << 18, 1 << 24
#: A rule takes 12 bytes and a use saves a symbol of 2 or 4: pairs that occur 6 times at least pay.  Those between
#: 6 and 16 times shorten files by 4 % and take a fifth of the time, so they are left.
LEAST_COUNT = 16
_MAGIC = b"OPRP0002"
_BUCKET_BITS, _SYMBOL_BITS = 18, 22
_NONE = np.iinfo(np.int64).max
#: ``k`` with ``4**(k - 1) <= count < 4**k`` (the largest pairs share the last one).
_SIZE = ((np.frexp(np.arange((1 << 20) + 1))[1] + 1) // 2).astype(np.int8)
_U = np.uint64


class _Pool:
    """Places of pairs that wait for their turn, by the power of four below their pair's count."""

    def __init__(self):
        self.waiting: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

    def add(self, codes: np.ndarray, places: np.ndarray, counts: np.ndarray) -> None:
        if not len(places):
            return
        size = _SIZE[np.minimum(counts, len(_SIZE) - 1)]
        for k in np.flatnonzero(np.bincount(size)).tolist():
            own = np.flatnonzero(size == k)
            self.waiting.setdefault(k, []).append((places[own], codes[own]))

    def largest(self) -> tuple[int, np.ndarray, np.ndarray] | None:
        if not self.waiting:
            return None
        k = max(self.waiting)
        places, codes = zip(*self.waiting.pop(k), strict=True)
        return k, np.concatenate(places), np.concatenate(codes)


def _grouped(codes: np.ndarray, places: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes that occur ``least`` times and their places, by code and place; and how often each row's code occurs."""
    bits = max(1, int(places.max()).bit_length()) if len(places) else 1
    if len(codes) and int(codes.max()).bit_length() + bits <= 64:  # one sort of packed words
        packed = np.sort(codes << np.uint64(bits) | places.astype(np.uint64))
        codes, places = packed >> np.uint64(bits), (packed & np.uint64((1 << bits) - 1)).astype(np.int32)
    else:
        order = np.lexsort((places, codes))
        codes, places = codes[order], places[order]
    return _runs(codes, places, least)


def _runs(codes: np.ndarray, places: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``_grouped`` of rows whose equal codes lie together."""
    begins = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.empty(0, np.int64)
    sizes = np.diff(np.append(begins, len(codes))).astype(np.int32)
    counts = np.repeat(sizes, sizes)
    enough = counts >= least
    return codes[enough], places[enough], counts[enough]


def _apart(places: np.ndarray, after: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Which of the occurrences (ascending places, each with the next symbol's place) may be replaced together.

    Of two that share a symbol the pair of smaller rank wins; of a run of one pair every second one, from the left.
    """
    n = len(places)
    touch = np.zeros(n + 1, dtype=bool)  # shares a symbol with the occurrence before
    touch[1:n] = after[:-1] == places[1:]
    same = touch[:n].copy()
    same[1:] &= rank[1:] == rank[:-1]
    begins = np.flatnonzero(~same)
    taken = np.zeros(n, dtype=bool)
    open_ = (np.arange(n) - np.repeat(begins, np.diff(np.append(begins, n)))) % 2 == 0
    at = np.flatnonzero(open_)
    while len(at):
        left = np.where(touch[at] & (at > 0) & open_[at - 1], rank[at - 1], _NONE)
        right = np.where(touch[at + 1] & open_[np.minimum(at + 1, n - 1)], rank[np.minimum(at + 1, n - 1)], _NONE)
        won = at[(rank[at] < left) & (rank[at] < right)]
        taken[won] = True
        open_[won] = False
        open_[won[touch[won]] - 1] = False
        open_[won[touch[won + 1]] + 1] = False
        at = at[open_[at]]
    return taken


def compress(ids: np.ndarray, last: np.ndarray, first_rule: int, least: int = LEAST_COUNT) -> tuple[np.ndarray, list[int], np.ndarray, np.ndarray]:
    """Re-Pair over ``ids``; ``last`` marks final symbols of documents.

    Returns the rules (n x 2), how many each step made, the symbols left and their ``last`` marks.  Pairs take
    their turns by falling count: a step replaces all pairs whose count lies between one power of four and the next,
    the more frequent of two overlapping ones first.  Counts are kept current (a pair's places come into being
    when the later of its symbols does, and are checked again when its turn comes), and steps go on until no pair
    occurs ``least`` times.
    """
    n = len(ids)
    symbols, last = ids.astype(np.uint32), last.copy()
    after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
    alive, fresh = np.ones(n, dtype=bool), np.zeros(n, dtype=bool)
    pool, rules, steps, made = _Pool(), [], [], 0

    def admit(places: np.ndarray) -> None:
        places = places[~last[places]]
        codes = symbols[places].astype(_U) << _U(_SYMBOL_BITS) | symbols[after[places]]
        bits = min(_BUCKET_BITS, max(8, len(codes).bit_length() + 1))
        bucket = ((codes * _U(0x9E3779B97F4A7C15)) >> _U(64 - bits)).astype(np.int32)
        crowded = (np.bincount(bucket) >= least)[bucket]
        pool.add(*_grouped(codes[crowded], places[crowded], least))

    admit(np.arange(n))
    while (turn := pool.largest()) is not None:
        size, places, codes = turn
        # places whose symbols have changed since are gone
        ok = alive[places] & ~last[places]
        places, codes = places[ok], codes[ok]
        ok = (symbols[places].astype(_U) << _U(_SYMBOL_BITS) | symbols[after[places]]) == codes
        codes, places, counts = _runs(codes[ok], places[ok], least)
        now = counts >= 1 << (2 * (size - 1))
        if not now.all():
            pool.add(codes[~now], places[~now], counts[~now])
            codes, places, counts = codes[now], places[now], counts[now]
        if not len(places):
            continue
        begins = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
        order = np.empty(len(begins), dtype=np.int64)
        order[np.argsort(-counts[begins], kind="stable")] = np.arange(len(begins))
        rank = np.repeat(order, np.diff(np.append(begins, len(codes))))
        packed = np.sort(places.astype(np.int64) << _SYMBOL_BITS | rank)  # a step has fewer pairs than there can be symbols
        at, kind = packed >> _SYMBOL_BITS, packed & ((1 << _SYMBOL_BITS) - 1)
        taken = _apart(at, after[at], kind)
        at, kind = at[taken], kind[taken]
        used = np.bincount(kind, minlength=len(begins))
        # a pair that lost its places to more frequent ones waits with those that are left
        lost = ~(used >= least)[rank]
        fewer = np.minimum(counts[lost], (1 << (2 * (size - 1))) - 1)
        again = fewer >= least
        pool.add(codes[lost][again], places[lost][again], fewer[again])
        kept = np.flatnonzero(used >= least)
        number = np.full(len(begins), -1, dtype=np.int64)
        number[kept] = np.arange(len(kept))
        own = number[kind] >= 0
        at, kind = at[own], number[kind[own]]
        if not len(at):
            continue
        pair = codes[begins][np.argsort(order)][kept]
        rules.append(np.stack([pair >> _U(_SYMBOL_BITS), pair & _U((1 << _SYMBOL_BITS) - 1)], axis=1).astype(np.uint32))
        steps.append(len(kept))
        second = after[at]
        symbols[at] = first_rule + made + kind
        last[at] = last[second]
        alive[second] = False
        after[at] = after[second]
        inner = after[at] < n
        before[after[at][inner]] = at[inner]
        made += len(kept)
        fresh[at] = True
        ahead = before[at]
        ahead = ahead[ahead >= 0]
        admit(np.concatenate([at, ahead[~fresh[ahead]]]))
        fresh[at] = False
    return np.concatenate(rules) if rules else np.empty((0, 2), np.uint32), steps, symbols[alive], last[alive]


def rule_lengths(rules: np.ndarray, steps: list[int], first_rule: int) -> np.ndarray:
    """How many ids each rule expands to; a step's rules are built of earlier symbols only."""
    out, at = np.ones(first_rule + len(rules), dtype=np.int64), 0
    for made in steps:
        a, b = rules[at : at + made].T
        out[first_rule + at : first_rule + at + made] = out[a] + out[b]
        at += made
    return out[first_rule:]


def _spans(flat: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``flat[begin : begin + size]`` of every row, end to end."""
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(begin - (ends - size), size) + np.arange(total)]


def expansions(rules: np.ndarray, lengths: np.ndarray, steps: list[int], first_rule: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(flat, begin, size)``: symbol ``s`` stands for ``flat[begin[s] : begin[s] + size[s]]``; ids for themselves."""
    size = np.concatenate([np.ones(first_rule, np.int64), lengths.astype(np.int64)])
    begin = np.concatenate([[0], np.cumsum(size)[:-1]])
    flat = np.empty(int(size.sum()), dtype="<u4")
    flat[:first_rule] = np.arange(first_rule)
    at = 0
    for made in steps:
        both = rules[at : at + made].reshape(-1)
        got = _spans(flat, begin[both], size[both])
        where = begin[first_rule + at]
        flat[where : where + len(got)] = got
        at += made
    return flat, begin, size


def encode_file(doc_ids: list[int | None], documents: list[np.ndarray], first_rule: int) -> bytes:
    """One section's bytes from its documents' ids (each at least one id long)."""
    counts = np.array([len(d) for d in documents], dtype=np.uint64)
    ids = np.concatenate(documents).astype(np.uint32)
    last = np.zeros(len(ids), dtype=bool)
    last[np.cumsum(counts).astype(np.int64) - 1] = True
    rules, steps, symbols, last = compress(ids, last, first_rule)
    first = np.concatenate([[0], np.flatnonzero(last) + 1]).astype("<u8")
    lengths = rule_lengths(rules, steps, first_rule)
    kind = "<u2" if first_rule + len(rules) <= 1 << 16 else "<u4"
    header = json.dumps({"docs": len(documents), "rules": len(rules), "symbols": len(symbols), "first_rule": first_rule, "kind": kind, "ids": int(counts.sum()), "steps": steps}).encode()
    return b"".join(
        [
            _MAGIC,
            len(header).to_bytes(4, "little"),
            header,
            rules.astype("<u4").tobytes(),
            lengths.astype("<u4").tobytes(),
            np.array([d or 0 for d in doc_ids], dtype="<i8").tobytes(),
            np.array([d is not None for d in doc_ids], dtype=np.uint8).tobytes(),
            first.tobytes(),
            counts.astype("<u8").tobytes(),
            symbols.astype(kind).tobytes(),
        ]
    )


class TokenFile:
    """Random access to one section's documents."""

    def __init__(self, data: bytes):
        if data[:8] != _MAGIC:
            raise ValueError("not a token file")
        at = 12 + int.from_bytes(data[8:12], "little")
        self.header = h = json.loads(data[12:at])

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, dtype=kind, count=n, offset=at)
            at += out.nbytes
            return out

        self.rules = take("<u4", 2 * h["rules"]).reshape(-1, 2)
        self.lengths = take("<u4", h["rules"])
        ids, present = take("<i8", h["docs"]), take("u1", h["docs"])
        self.doc_ids = [int(i) if p else None for i, p in zip(ids, present, strict=True)]
        self.first, self.counts = take("<u8", h["docs"] + 1).astype(np.int64), take("<u8", h["docs"]).astype(np.int64)
        self.symbols = take(h["kind"], h["symbols"])
        self._flat, self._begin, self._size = expansions(self.rules, self.lengths, h["steps"], h["first_rule"])

    def _expand(self, symbols: np.ndarray) -> np.ndarray:
        return _spans(self._flat, self._begin[symbols], self._size[symbols])

    def document(self, k: int) -> np.ndarray:
        """Ids of the section's k-th document, from its own symbols."""
        return self._expand(self.symbols[self.first[k] : self.first[k + 1]])

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        ids = self._expand(self.symbols)
        at = np.concatenate([[0], np.cumsum(self.counts)])
        for k, doc in enumerate(self.doc_ids):
            yield doc, ids[at[k] : at[k + 1]]


def _token_batches(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        end = np.array([end_id], dtype=enc.dtype).tobytes()
        for batch in batches:
            texts = batch.column(1)
            for a in range(0, batch.num_rows, 512):
                ids = [enc.coded(t) + end for t in texts.slice(a, 512).to_pylist()]
                rest = [batch.column(c).slice(a, 512) for c in (0, 2)]
                yield pa.RecordBatch.from_arrays([rest[0], pa.array(ids, pa.binary()), rest[1]], names=["doc_id", "ids", "shard"])

    return run


_INDEX = "shard int, seq int, path string, offset long, size long, docs long, ids long"
_INDEX_TYPES = (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64())


def _file_batches(folder: str, first_rule: int, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        width = np.dtype(kind).itemsize
        docs: list = []
        ids: list[np.ndarray] = []
        sections: list[bytes] = []
        rows: list[tuple] = []
        held, shard, seq, size, filled = 0, None, 0, 0, 0

        def section() -> None:
            nonlocal docs, ids, held, seq, size, filled
            data = encode_file(docs, ids, first_rule)
            rows.append((shard, seq, size, len(data), len(docs), held))
            sections.append(data)
            size, filled = size + len(data), filled + held
            docs, ids, held, seq = [], [], 0, seq + 1

        def close() -> pa.RecordBatch:
            nonlocal sections, rows, size, filled
            uri = f"{folder}/part-{shard:06d}-{rows[0][1]:06d}.rp"
            store.publish(uri, b"".join(sections))
            columns = zip(*((r[0], r[1], uri, *r[2:]) for r in rows), strict=True)
            sections, rows, size, filled = [], [], 0, 0
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _INDEX_TYPES, strict=True)], names=[c.split()[0] for c in _INDEX.split(", ")])

        for batch in batches:
            _, at, data = batch.column(1).buffers()
            at = np.frombuffer(at, np.int32)[batch.column(1).offset :].tolist()
            for k, (doc, where) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                own = np.frombuffer(data, kind, (at[k + 1] - at[k]) // width, at[k])
                if docs and (where != shard or held + len(own) > SECTION_IDS):
                    section()
                if rows and (where != shard or filled >= FILE_IDS):
                    yield close()
                if where != shard:
                    shard, seq = where, 0
                docs.append(doc)
                ids.append(own)
                held += len(own)
        if docs:
            section()
        if rows:
            yield close()

    return run


def write_tokens(docs: DataFrame, folder: str | None = None, tokenizer: str | None = None, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the ids of all documents in ascending id order (null ids first; ties by ids) and return the index.

    The index has one row a section: ``shard, seq, path, offset, size, docs, ids, start`` (``offset`` and ``size`` in
    bytes of the file; ``start``: ids in all sections before).
    Null and empty texts have only the end id.  An empty table writes nothing.  Other columns are ignored.
    """
    spark = docs.sparkSession
    path, folder = tokenizer or default_tokenizer(), folder or store.scratch(spark, "tokens")
    enc = encoder(path)
    n = store.partitions(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ranges = id_ranges(rows, "doc_id", n)
    coded = rows.select("doc_id", "text", ranges.column("doc_id").alias("shard")).mapInArrow(_token_batches(path, end_id), "doc_id long, ids binary, shard int")
    ordered = coded.repartitionById(n, F.col("shard")).sortWithinPartitions("shard", "doc_id", "ids")
    files = ordered.select("doc_id", "ids", "shard").mapInArrow(store.trimmed(_file_batches(folder, enc.tokenizer.get_vocab_size(with_added_tokens=True), enc.dtype.str)), _INDEX)
    files = store.materialise(files, "token-index")
    totals = {r["shard"]: r["t"] for r in files.groupBy("shard").agg(F.sum("ids").alias("t")).collect()}  # <= n rows
    before, offsets = 0, []
    for s in range(n):
        offsets.append(before)
        before += totals.get(s, 0)
    base = F.element_at(F.split(F.lit(",".join(map(str, offsets))), ",").cast("array<bigint>"), F.col("shard") + 1)
    earlier = Window.partitionBy("shard").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("start", base + F.coalesce(F.sum("ids").over(earlier), F.lit(0)))


def _document_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, offset, size, start in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
            out: list[tuple] = []
            for doc, ids in TokenFile(store.fetch(path, offset, size)).documents():
                out.append((doc, start, len(ids), zlib.crc32(ids)))
                start += len(ids)
            columns = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_tokens(index: DataFrame) -> DataFrame:
    """Decode every section of an index: ``doc_id, start, n_tokens, ids_crc32`` (crc of the ids as u32, unsigned)."""
    n = store.partitions(index.sparkSession)
    dealt = index.select("path", "offset", "size", "start", "shard").repartitionById(n, F.col("shard"))
    return dealt.select("path", "offset", "size", "start").mapInArrow(store.trimmed(_document_batches), "doc_id long, start long, n_tokens long, ids_crc32 long")
