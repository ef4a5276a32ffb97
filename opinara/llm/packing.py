"""Best-fit packing (operator 9): bin completion over the histogram of piece lengths.

Pieces have at most ``capacity`` different lengths, so the packing is planned on a histogram whose size does
not depend on the corpus: a *pattern* is a multiset of lengths that fills one sequence, used as often as its
scarcest length allows.  Patterns come from branch and bound over all sequences: the largest length left opens one,
its undominated fillings (no length left out could replace members of its sum, or of less where there is room) are
enumerated with the least waste first, earlier choices are taken back when a branch's waste rules out an
improvement, and best-fit decreasing is the incumbent.

Pieces take their places by rank within their length.  Ranks come from windows over (id range, length) and
thin per-range counts, so a length that a third of all documents share is dealt over all ranges.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from opinara.llm import store
from opinara.llm.ordering import id_ranges
from opinara.llm.tokens import default_tokenizer, encoder

CAPACITY = 2048
END_ID = 0
#: Work of one search for a plan (a filling that is looked at counts 1, a sequence that is opened 10; None: no limit);
#: the best packing found stands when it is used up.
BRANCHES = 60_000

#: A pattern: how many sequences use it, and its lengths, largest first.
Pattern = tuple[int, tuple[int, ...]]


def _best_fit_completion(left: dict[int, int], lengths: list[int], room: int) -> list[int]:
    """Repeatedly the largest length that fits."""
    chosen: list[int] = []
    used: dict[int, int] = {}
    for x in lengths:
        while x <= room and left[x] - used.get(x, 0) > 0:
            used[x] = used.get(x, 0) + 1
            chosen.append(x)
            room -= x
        if room == 0:
            break
    return chosen


def best_fit_decreasing(histogram: dict[int, int], capacity: int) -> list[Pattern]:
    """The incumbent: the largest length left opens a sequence, which is completed by best fit."""
    left = {x: c for x, c in histogram.items() if c > 0}
    lengths = sorted(left, reverse=True)
    out: list[Pattern] = []
    while lengths:
        first = lengths[0]
        left[first] -= 1
        members = (first, *_best_fit_completion(left, [x for x in lengths if left[x] > 0 and x <= capacity - first], capacity - first))
        left[first] += 1
        out.append((_use(left, members), members))
        lengths = [x for x in lengths if left[x] > 0]
    return out


def _use(left: dict[int, int], members: tuple[int, ...], most: int | None = None) -> int:
    """Take a pattern from ``left`` as often as its scarcest length allows (and ``most``)."""
    need = Counter(members)
    times = min(left[x] // c for x, c in need.items())
    times = times if most is None else min(times, most)
    for x, c in need.items():
        left[x] -= c * times
    return times


def lower_bound(histogram: dict[int, int], capacity: int) -> int:
    """Sequences that any packing needs: by total length, and by pieces too long to share (every cut at half or below)."""
    size = np.zeros(capacity + 1, dtype=np.int64)
    for x, c in histogram.items():
        size[x] = c
    count, total = np.cumsum(size), np.cumsum(size * np.arange(capacity + 1))
    best = -(-int(total[-1]) // capacity)
    for k in range(1, capacity // 2 + 1):  # pieces of k to half go into the space that larger ones leave
        alone = int(count[-1] - count[capacity - k])
        half = int(count[capacity - k] - count[capacity // 2])
        space = half * capacity - int(total[capacity - k] - total[capacity // 2])
        small = int(total[capacity // 2] - total[k - 1])
        best = max(best, alone + half + max(0, -(-(small - space) // capacity)))
    return best


def _sums(left: dict[int, int], lengths: list[int], room: int) -> list[int]:
    """For every position: the sums up to ``room`` that the lengths from there on can make, as the bits of a number."""
    mask = (2 << room) - 1
    out = [1] * (len(lengths) + 1)
    for i in range(len(lengths) - 1, -1, -1):
        bits, x, count, step = out[i + 1], lengths[i], min(left[lengths[i]], room // lengths[i]), 1
        while count > 0:  # counts by doubling
            step = min(step, count)
            bits |= bits << (x * step) & mask
            count -= step
            step *= 2
        out[i] = bits
    return out


def dominated(members: list[int], left: dict[int, int], lengths: list[int], waste: int) -> bool:
    """Whether a length left out could replace members of its size or a little less: that filling leaves others more.

    ``waste`` is the room that the filling leaves.  One member is replaced by a larger length only, two or more
    also by one of their sum.
    """
    one = several = 0
    for x in members:
        several |= (one | several) << x
        one |= 1 << x
    used = Counter(members)
    free = 0
    for x in lengths:
        if left[x] > used.get(x, 0):
            free |= 1 << x
    return any(free & ((several << more) | (one << more if more else 0)) for more in range(waste + 1))


def fillings(left: dict[int, int], lengths: list[int], room: int, allowed: int) -> Iterator[list[int] | None]:
    """The undominated fillings of ``room`` from the lengths left (descending list, counts), least waste first.

    Fillings that leave more than ``allowed`` are not looked for.

    None stands for a dominated filling, so that a search can count what it looks at.

    A single length that fits exactly dominates every other filling.  Sums that cannot be made are never entered.
    """
    if left.get(room, 0) > 0:
        yield [room]
        return
    pairs = [[x, room - x] for x in lengths if x >= room - x > 0 and left.get(room - x, 0) > (x == room - x)]
    yield from pairs
    sums = _sums(left, lengths, room)

    def exactly(i: int, sum_: int, chosen: list[int]) -> Iterator[list[int]]:
        if not sum_:
            yield list(chosen)
            return
        for k in range(i, len(lengths)):
            x = lengths[k]
            if not sums[k] >> sum_ & 1:
                return
            if x > sum_:
                continue
            for take in range(min(left[x], sum_ // x), 0, -1):
                if sums[k + 1] >> (sum_ - x * take) & 1:
                    yield from exactly(k + 1, sum_ - x * take, chosen + [x] * take)

    for waste in range(min(room, allowed) + 1):
        if sums[0] >> (room - waste) & 1:
            for members in exactly(0, room - waste, []):
                fresh = (waste or len(members) != 2) and not dominated(members, left, lengths, waste)
                yield members if fresh else None


def plan(histogram: dict[int, int], capacity: int = CAPACITY, branches: int | None = BRANCHES) -> list[Pattern]:
    """Patterns that use every piece once; never more sequences than best-fit decreasing, the first incumbent.

    Depth-first branch and bound: the largest length left opens a sequence, its undominated fillings are tried in
    turn, each at once for as many sequences as its counts allow, then for one only; a branch is cut when its
    waste rules out an improvement.  The search returns when its packing meets the lower bound, when everything
    is tried, or after work of ``branches`` (None: no limit, a proven optimum) with the best packing found.
    """
    incumbent = best_fit_decreasing(histogram, capacity)
    best, most = incumbent, sum(t for t, _ in incumbent)  # the first descent may equal the incumbent
    bound, total = lower_bound(histogram, capacity), sum(x * c for x, c in histogram.items())
    left = {x: c for x, c in histogram.items() if c > 0}
    trail: list[Pattern] = []
    wasted, work, done = 0, 0, object()

    def options() -> Iterator[tuple[int, tuple[int, ...], int]]:
        nonlocal work
        lengths = sorted((x for x, c in left.items() if c > 0), reverse=True)
        work += 10
        first = lengths[0]
        left[first] -= 1
        rest = [x for x in lengths if left[x] > 0 and x <= capacity - first]
        found = fillings(left, rest, capacity - first, most * capacity - total - wasted)
        while True:
            work += 1
            members = next(found, done)  # the filling is chosen without the opening piece
            while members is None and (branches is None or work < branches):
                work += 1
                members = next(found, done)
            left[first] += 1
            if members is done or members is None:
                return
            full = (first, *members)
            waste = capacity - sum(full)
            spare = most * capacity - total - wasted
            if waste > spare:
                return
            times = min(left[x] // c for x, c in Counter(full).items())
            if waste:
                times = min(times, spare // waste)
            yield times, full, waste
            if times > 1:
                yield 1, full, waste
            left[first] -= 1

    frames = [options()] if left else []
    while frames and (branches is None or work < branches):
        step = next(frames[-1], None)
        if step is None:
            frames.pop()
            if trail:
                times, members = trail.pop()
                for x, c in Counter(members).items():
                    left[x] += c * times
                wasted -= times * (capacity - sum(members))
            continue
        times, members, waste = step
        for x, c in Counter(members).items():
            left[x] -= c * times
        trail.append((times, members))
        wasted += times * waste
        if any(left.values()):
            frames.append(options())
            continue
        best, most = list(trail), sum(t for t, _ in trail) - 1
        if most < bound:
            break
        frames.append(iter(()))  # its end takes the last step back
    return best


def places(patterns: list[Pattern]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length, segments of its ranks: (first rank, first sequence, members a sequence, offset arrays)."""
    table: dict[int, list[tuple]] = {}
    ranks: dict[int, int] = {}
    base = 0
    for times, members in patterns:
        at, slots = 0, {}
        for x in members:
            slots.setdefault(x, []).append(at)
            at += x
        for x, offsets in slots.items():
            table.setdefault(x, []).append((ranks.get(x, 0), base, tuple(offsets)))
            ranks[x] = ranks.get(x, 0) + times * len(offsets)
        base += times
    return table


def _piece_batches(path: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        end = np.array([end_id], dtype="<u4")
        for batch in batches:
            out: list[tuple] = []
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                for doc, text, own, turn in zip(*(part.column(c).to_pylist() for c in range(4)), strict=True):
                    ids = np.concatenate([enc.ids(text).astype("<u4"), end])
                    for piece, start in enumerate(range(0, len(ids), capacity)):
                        cut = ids[start : start + capacity]
                        out.append((doc, piece, start, len(cut), zlib.crc32(cut.tobytes()), own, turn))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            columns = list(zip(*out, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=_PIECE_NAMES)

    return run


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, own int, turn long"
_PIECE_NAMES = [c.split()[0] for c in _PIECES.split(", ")]
_PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
_PLACED = f"{_PACKED}, turn long"


def _place_batches(table: dict[int, list[tuple]], capacity: int, full_base: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = {x: np.array([s[0] for s in rows]) for x, rows in table.items()}
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(6).to_numpy()
            sequence, offset = np.empty(len(length), np.int64), np.zeros(len(length), np.int64)
            full = length == capacity
            sequence[full] = full_base + rank[full]
            for x in np.unique(length[~full]):
                at = np.flatnonzero(length == x)
                which = np.searchsorted(starts[x], rank[at], "right") - 1
                for s in np.unique(which):
                    first, base, offsets = table[x][s]
                    rows = at[which == s]
                    k = rank[rows] - first
                    sequence[rows] = base + k // len(offsets)
                    offset[rows] = np.array(offsets)[k % len(offsets)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(5)), pa.array(sequence), pa.array(offset), batch.column(5)], names=[c.split()[0] for c in _PLACED.split(", ")])

    return run


def _numbered(spark: SparkSession, packed: DataFrame, n: int) -> DataFrame:
    """``packed`` with its sequences numbered by the turn of their first piece."""
    packed = store.materialise(packed, "packed")
    first = store.materialise(packed.groupBy("sequence_id").agg(F.min("turn").alias("first")), "sequences", thin=True)
    ranges = id_ranges(first, "first", n)
    first = first.withColumn("own", ranges.column("first"))
    earlier = Window.orderBy("own").rowsBetween(Window.unboundedPreceding, -1)
    # a row a range: at most n rows in one task
    before = first.groupBy("own").agg(F.count("*").alias("c")).select("own", F.coalesce(F.sum("c").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("own").orderBy("first", "sequence_id")
    first = first.withColumn("inside", F.row_number().over(inside) - 1).join(F.broadcast(before), "own")
    first = first.select("sequence_id", (F.col("inside") + F.col("before")).cast("long").alias("number"))
    names = [c.split()[0] for c in _PACKED.split(", ")]
    return packed.join(first, "sequence_id").select(*(F.col("number").alias(c) if c == "sequence_id" else c for c in names))


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", turn_col: str | None = None) -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` ids; only longer ones are cut.

    Returns ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.  Null and empty texts are the end
    id alone; repeated rows and ids are packed as often as they occur; a null id is kept as null.  An empty
    table gives an empty result.  Other columns are ignored.  Pieces of one length take their places in the order
    of ``turn_col`` (ids where it is None); with it, sequences are numbered by the turn of their first piece.
    """
    spark = docs.sparkSession
    n = store.partitions(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(turn_col or id_col).cast("long").alias("turn"))
    ranges = id_ranges(rows, "turn", n)
    pieces = rows.select("doc_id", "text", ranges.column("turn").alias("own"), "turn").mapInArrow(store.trimmed(_piece_batches(tokenizer or default_tokenizer(), capacity, end_id)), _PIECES)
    pieces = store.materialise(pieces, "pieces")
    # the histogram has at most ``capacity`` rows whatever the corpus
    histogram = {r["length"]: r["c"] for r in pieces.groupBy("length").agg(F.count("*").alias("c")).collect()}
    histogram.pop(capacity, 0)
    patterns = plan(histogram, capacity)
    table, full_base = places(patterns), sum(t for t, _ in patterns)
    # rank within a length: rows before in the same range, plus all rows of lower ranges (n x capacity counts)
    counts = pieces.groupBy("length", "own").agg(F.count("*").alias("c"))
    earlier = Window.partitionBy("length").orderBy("own").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("length", "own", F.coalesce(F.sum("c").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("own", "length").orderBy("turn", "piece", "ids_crc32")
    ranked = pieces.withColumn("inside", F.row_number().over(inside) - 1).join(before, ["length", "own"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "turn", (F.col("inside") + F.col("before")).alias("rank"))
    packed = ranked.mapInArrow(_place_batches(table, capacity, full_base), _PLACED)
    return _numbered(spark, packed, n) if turn_col else packed.drop("turn")
