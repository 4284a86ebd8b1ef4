"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INFINITY = float("inf")
#: A table with a row for each cell, file or the like is broadcast only up to this many rows.
BROADCAST_ROWS = 400_000


def join_small(df: DataFrame, small: DataFrame, keys: list[str], how: str = "inner", rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join with a table of one row per key: by broadcast if a count shows at most `rows` of them, else by a shuffle."""
    few = small.count() <= rows
    return df.join(F.broadcast(small) if few else small, keys, how)


def finite(c: Column) -> Column:
    """True for numbers that are neither null, NaN nor infinite."""
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(INFINITY))


def measured(c: Column) -> Column:
    """The column with NaN as null, so that aggregates skip it."""
    return F.when(~F.isnan(c), c)


def clamp(c: Column, lo: Column, hi: Column) -> Column:
    """The column held between two bounds; null stays null, which `greatest` and `least` alone would pass over."""
    return F.when(c.isNotNull(), F.greatest(lo, F.least(hi, c)))


def segment_rows(df, x: str, ys: list[str], keys: list[str], step: float, origin: float, index: str = "grid_idx"):
    """Linear interpolation of `ys` at origin + k * step, for every whole k inside the range of `x`.

    Each row spans the segment to the next larger x and is exploded into the grid indices it covers, so there is no range
    join: a point on a knot belongs to the segment that starts there, the last knot to itself.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(x)
    nxt = [F.lead(c).over(w).alias(f"__next_{c}") for c in (x, *ys)]
    lo = F.ceil((F.col(x) - F.lit(origin)) / F.lit(step))
    hi = F.ceil((F.col(f"__next_{x}") - F.lit(origin)) / F.lit(step)) - 1
    last = F.col(f"__next_{x}").isNull()
    own = F.when(lo * F.lit(step) + F.lit(origin) == F.col(x), F.array(lo))
    inside = F.when(last, own).when(hi >= lo, F.sequence(lo, hi))
    seg = df.select(*keys, x, *ys, *nxt).withColumn(index, F.explode(inside))
    at = F.col(index) * F.lit(step) + F.lit(origin)
    share = F.when(F.col(f"__next_{x}").isNull(), F.lit(0.0)).otherwise((at - F.col(x)) / (F.col(f"__next_{x}") - F.col(x)))
    value = lambda y: F.col(y) + share * F.coalesce(F.col(f"__next_{y}") - F.col(y), F.lit(0.0))
    return seg.select(*keys, index, at.alias("grid_x"), *[value(y).alias(y) for y in ys])
