"""Cutting a table into contiguous id ranges without a global sort or a single-task window.

``IdRanges`` lays a fixed grid of equal-width cells over the ids, counts rows per cell (a thin, map-side
combined aggregation with at most ``CELLS_PER_RANGE * n`` rows) and joins neighbouring cells into ``n``
ranges of near-equal row counts.  The row -> range map is an array literal, so it costs one lookup per row.
Rows with a null id form the lowest positions (range 0).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELLS_PER_RANGE = 32


def _cell(value: Column, low: int, width: int) -> Column:
    """Integer division in decimals: ids may span all 64 bits."""
    return F.call_function("div", value.cast("decimal(20,0)") - F.lit(low).cast("decimal(20,0)"), F.lit(width).cast("decimal(20,0)")).cast("int")


@dataclass(frozen=True)
class IdRanges:
    n: int
    low: int
    width: int
    owner: tuple[int, ...]

    def column(self, id_col: str | Column) -> Column:
        """The range (0 .. n-1) of a row; ascending with the id."""
        value = F.col(id_col) if isinstance(id_col, str) else id_col
        cell = _cell(value, self.low, self.width)
        # an array that is built once per task: a long literal list would bloat the generated code
        table = F.split(F.lit(",".join(map(str, self.owner))), ",").cast("array<int>")
        return F.when(value.isNull(), F.lit(0)).otherwise(F.element_at(table, cell + 1)).cast("int")


def id_ranges(df: DataFrame, id_col: str, n: int) -> IdRanges:
    ids = df.select(F.col(id_col).cast("long").alias("i")).where("i IS NOT NULL")
    low, high = ids.agg(F.min("i"), F.max("i")).first()
    if low is None:
        return IdRanges(n, 0, 1, (0,))
    cells = max(1, n * CELLS_PER_RANGE)
    width = -(-(high - low + 1) // cells)
    cell = _cell(F.col("i"), low, width)
    rows = {r["c"]: r["k"] for r in ids.groupBy(cell.alias("c")).agg(F.count("*").alias("k")).collect()}  # <= cells
    used = (high - low) // width + 1
    total, seen, owner = sum(rows.values()), 0, []
    for c in range(used):
        owner.append(min(n - 1, seen * n // total))
        seen += rows.get(c, 0)
    return IdRanges(n, low, width, tuple(owner))
