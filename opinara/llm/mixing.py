"""Mixing sources to target weights (operator 3): Pfair scheduling, earliest deadline first.

Sources are cut into blocks of ``block_docs`` documents in id order.  With an exact target weight ``w`` (a fraction
of all slots), block ``k`` of a source is released at ``floor(k / w)`` and due at ``ceil((k + 1) / w)``.  Weights are
rational numbers with a common denominator ``Q``, so after ``Q`` slots every source stands exactly at its share and
the schedule repeats: earliest-deadline-first is run once over one period (a plan of ``Q`` rows that does not depend
on the corpus) and every block finds its slot by a join with that plan.  In every prefix of slots a source has its
share to within less than one block, however long the mixture is, until it has no blocks left; its later slots
stay empty and the other sources go on, so no document is lost.

The path over documents is DataFrame operations only.
"""

from __future__ import annotations

import heapq
import json
import math
from collections.abc import Mapping
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opinara.llm import store
from opinara.llm.ordering import id_ranges

#: Slots of a period without target weights (raised to eight for each source where there are many), documents of a block.
SLOTS, BLOCK_DOCS = 1000, 16
#: The plan of a period has at most so many rows; weights with a larger common denominator are refused.
MOST_SLOTS = 1 << 18
#: A plan for more sources than this is refused: sources are named corpora, not single hosts.
MOST_SOURCES = 20_000
#: Without target weights a source weighs its row count to this power.
TEMPERATURE = 0.5
ADDED = ("_block", "_slot", "_release", "_deadline", "_position")


def whole_slots(weights: Mapping[str, float], slots: int = SLOTS) -> dict[str, int]:
    """Weights as whole slots that sum to the period, at least one each, by largest remainder."""
    slots = max(slots, 8 * len(weights))
    total = sum(weights.values())
    spare = slots - len(weights)
    exact = {s: spare * w / total for s, w in weights.items()}
    out = {s: 1 + int(e) for s, e in exact.items()}
    for s in sorted(weights, key=lambda s: (int(exact[s]) - exact[s], s))[: slots - sum(out.values())]:
        out[s] += 1
    return out


def _exact(weight: float | Fraction) -> Fraction:
    """The number as it is written: 0.1 is a tenth, and 1 / 3 a third."""
    plain = Fraction(weight).limit_denominator(1000)
    return plain if abs(plain - Fraction(weight)) < Fraction(1, 10**15) else Fraction(str(weight))


def exact_slots(weights: Mapping[str, float | Fraction]) -> dict[str, int]:
    """The weights as whole numbers in their own proportions, without rounding; they sum to the period."""
    fractions = {s: _exact(w) for s, w in weights.items()}
    scale = math.lcm(*(f.denominator for f in fractions.values()))
    whole = {s: int(f * scale) for s, f in fractions.items()}
    common = math.gcd(*whole.values())
    return {s: w // common for s, w in whole.items()}


def release(k: int, p: int, slots: int) -> int:
    return k * slots // p


def deadline(k: int, p: int, slots: int) -> int:
    return -(-(k + 1) * slots // p)


def schedule(shares: Mapping[str, int]) -> list[tuple[str, int]]:
    """``(source, block)`` of every slot of one period: among released blocks, the earliest deadline."""
    slots = sum(shares.values())
    waiting = sorted((release(k, p, slots), deadline(k, p, slots), s, k) for s, p in shares.items() for k in range(p))
    ready: list[tuple[int, str, int]] = []
    out, at = [], 0
    for t in range(slots):
        while at < len(waiting) and waiting[at][0] <= t:
            _, due, s, k = waiting[at]
            heapq.heappush(ready, (due, s, k))
            at += 1
        due, s, k = heapq.heappop(ready)
        if due <= t:
            raise AssertionError("a block missed its deadline")
        out.append((s, k))
    return out


def target_slots(counts: Mapping[str, int], weights: Mapping[str, float | Fraction] | None, slots: int = SLOTS) -> dict[str, int]:
    """Slots of each source in a period: exact proportions of ``weights``, or shares of the row counts.

    Where ``weights`` is None a source's target is its share of the row counts to the power TEMPERATURE in whole
    slots of the period, one at least.  A source that ``weights`` does not name has the smallest named weight.
    """
    if not counts:
        return {}
    if weights is None:
        return whole_slots({s: float(n) ** TEMPERATURE for s, n in counts.items()}, slots)
    if not weights or any(w <= 0 for w in weights.values()):
        raise ValueError("weights must be positive")
    least = min(weights.values())
    shares = exact_slots({s: weights.get(s, least) for s in counts})
    if sum(shares.values()) > MOST_SLOTS:
        raise ValueError(f"the weights repeat after {sum(shares.values())} slots; round them to a common denominator of at most {MOST_SLOTS}")
    return shares


def _key(source_col: str) -> Column:
    """A null source is a source of its own."""
    return F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("null"))


def with_slots(docs: DataFrame, weights: Mapping[str | None, float | Fraction] | None = None, slots: int = SLOTS, block_docs: int = BLOCK_DOCS, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """``docs`` (all columns, whatever their names) with ``_block``, ``_slot``, ``_release``, ``_deadline``, ``_position``.

    ``weights``: positive target weights by source, see ``target_slots``.  The added columns are longs;
    ``_position`` orders the whole mixture and is distinct for every row.  Null ids come first in their source;
    repeated rows take places side by side.  An empty table gives an empty result.  A table that already has one
    of the added names is refused.
    """
    if clash := set(ADDED) & set(docs.columns):
        raise ValueError(f"columns {sorted(clash)} are added here")
    spark = docs.sparkSession
    # the row is kept as one value: no name of its columns can meet a name of the plan
    keyed = docs.select(F.struct("*").alias("row"), _key(source_col).alias("key"), F.col(id_col).cast("long").alias("id"))
    counts = keyed.groupBy("key").agg(F.count("*").alias("n")).limit(MOST_SOURCES + 1).collect()  # <= MOST_SOURCES + 1 rows
    if len(counts) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    named = None if weights is None else {("null" if s is None else f"={s}"): w for s, w in weights.items()}
    shares = target_slots({r["key"]: r["n"] for r in counts}, named, slots)
    period = sum(shares.values())
    number = {s: i for i, s in enumerate(shares)}
    # the plan as a table: which source each slot of the period belongs to, and the how manieth it is of that source
    order = ",".join(str(number[s]) for s, _ in schedule(shares))
    table = spark.range(1).select(F.posexplode(F.split(F.lit(order), ",")).alias("t", "n")).where("n <> ''").select(F.col("t").cast("long"), F.col("n").cast("int"))
    table = table.withColumn("k", F.row_number().over(Window.partitionBy("n").orderBy("t")) - 1)
    rows = json.dumps([{"key": s, "number": number[s], "per": p} for s, p in shares.items()])
    share = spark.range(1).select(F.inline(F.from_json(F.lit(rows), "array<struct<key: string, number: int, per: long>>")))

    # rank within a source: places inside (source, id range), plus the source's rows of lower ranges
    n = store.partitions(spark)
    ranges = id_ranges(docs, id_col, n)
    cut = keyed.withColumn("own", ranges.column(F.col("id")))
    sizes = cut.groupBy("key", "own").agg(F.count("*").alias("rows"))
    earlier = Window.partitionBy("key").orderBy("own").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("key", "own", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("key", "own").orderBy("id")
    ranked = cut.withColumn("inside", F.row_number().over(inside) - 1).join(before, ["key", "own"])
    ranked = ranked.withColumn("rank", F.col("before") + F.col("inside")).withColumn("block", F.floor(F.col("rank") / block_docs))
    # the plan has a row a slot and the shares a row a source: at most MOST_SLOTS (8 * MOST_SOURCES) and MOST_SOURCES
    ranked = ranked.join(F.broadcast(share), "key")
    placed = ranked.join(F.broadcast(table), (F.col("number") == F.col("n")) & (F.col("block") % F.col("per") == F.col("k")))
    turn = F.floor(F.col("block") / F.col("per")) * F.lit(period)
    slot = turn + F.col("t")
    due = F.call_function("div", (F.col("k") + 1) * period + F.col("per") - 1, F.col("per"))
    return placed.select(
        "row.*",
        F.col("block").alias("_block"),
        slot.alias("_slot"),
        (turn + F.call_function("div", F.col("k") * period, F.col("per"))).alias("_release"),
        (turn + due).alias("_deadline"),
        (slot * block_docs + F.col("rank") % block_docs).alias("_position"),
    )


def mixed(docs: DataFrame, **options) -> DataFrame:
    """``docs`` (all rows, all columns) in the order of the mixture."""
    return with_slots(docs, **options).orderBy("_position").select(*docs.columns)
