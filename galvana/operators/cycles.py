"""Cycles and half-cycles from the sign of the current."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.columns import join_small
from .config import Parsing

#: Seconds of a cell's time that one window takes.
CHUNK_S = 86400.0


def in_time():
    """Rows of a cell in time order."""
    return Window.partitionBy("cell_id").orderBy("time", "row_id")


def sign(cfg: Parsing = Parsing()) -> Column:
    """1 charging, -1 discharging, 0 at rest."""
    i, rest = F.col("current"), F.lit(cfg.rest_current_threshold_a)
    return F.when(i > rest, 1).when(i < -rest, -1).otherwise(0)


def _chunked(samples: DataFrame, cfg: Parsing, chunk_s: float) -> DataFrame:
    """Phase, and the number of cycles begun so far, of each row, from chunks of a cell's time.

    Windows run within (cell, chunk), so the samples of one cell are spread over many tasks. A chunk is summed up by its
    first and last movement and the cycles begun inside it; those few rows per cell are carried forward and joined back.
    """
    chunk = Window.partitionBy("cell_id", "__chunk").orderBy("time", "row_id")
    so_far, before = chunk.rowsBetween(Window.unboundedPreceding, 0), chunk.rowsBetween(Window.unboundedPreceding, -1)
    rows = samples.withColumns({"__chunk": F.floor(F.col("time") / chunk_s), "__moved": F.when(sign(cfg) != 0, sign(cfg))})
    last = F.last("__moved", ignorenulls=True)
    rows = rows.withColumns({"__local": last.over(so_far), "__last": last.over(before)})
    rows = rows.withColumn("__begins", ((F.col("__moved") == 1) & F.coalesce(F.col("__last") == -1, F.lit(False))).cast("int"))
    rows = rows.withColumn("__begun", F.sum(F.coalesce("__begins", F.lit(0))).over(so_far))
    place = F.when(F.col("__moved").isNotNull(), F.struct("time", "row_id"))
    ends = rows.groupBy("cell_id", "__chunk").agg(
        F.min_by("__moved", place).alias("__first"), F.max_by("__moved", place).alias("__end"), F.sum(F.coalesce("__begins", F.lit(0))).alias("__inside")
    )
    earlier = Window.partitionBy("cell_id").orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("__carry", F.coalesce(F.last("__end", ignorenulls=True).over(earlier), F.lit(0)))
    ends = ends.withColumn("__opens", F.coalesce((F.col("__carry") == -1) & (F.col("__first") == 1), F.lit(False)).cast("int"))
    offset = F.coalesce(F.sum(F.col("__inside") + F.col("__opens")).over(earlier), F.lit(0))
    ends = ends.select("cell_id", "__chunk", "__carry", "__opens", offset.alias("__offset"))
    opened = F.when(F.col("__local").isNotNull(), F.col("__opens")).otherwise(0)  # once the chunk has moved
    return rows.join(ends, ["cell_id", "__chunk"]).withColumns(
        {"phase": F.coalesce("__local", "__carry"), "__cycle": (F.col("__offset") + F.col("__begun") + opened).cast("int")}
    )


_OWN = ("__chunk", "__moved", "__local", "__last", "__begins", "__begun", "__carry", "__opens", "__offset")


def with_phase(samples: DataFrame, cfg: Parsing = Parsing(), chunk_s: float = CHUNK_S) -> DataFrame:
    """phase: the sign, carried through rests from the last row that moved; 0 before the first."""
    return _chunked(samples, cfg, chunk_s).drop(*_OWN, "__cycle")


def with_cycles(samples: DataFrame, cfg: Parsing = Parsing(), chunk_s: float = CHUNK_S) -> DataFrame:
    """phase and cycle_index; a cycle begins where a discharge is followed by a charge.

    A cycle_index that comes with the data is trusted, cell by cell, if it has no null, never falls in time and has more
    than one value; the phase of such a cell is the plain sign, so rests belong to no half-cycle.
    """
    found = _chunked(samples, cfg, chunk_s)
    if "cycle_index" not in samples.columns:
        return found.withColumnRenamed("__cycle", "cycle_index").drop(*_OWN)
    given = F.col("cycle_index").cast("int")
    chunk = Window.partitionBy("cell_id", "__chunk").orderBy("time", "row_id")
    falls = F.coalesce((given < F.lag(given).over(chunk)).cast("int"), F.lit(0))
    place = F.struct("time", "row_id")
    ends = found.withColumn("__falls", falls).groupBy("cell_id", "__chunk").agg(
        F.min_by(given, place).alias("first"), F.max_by(given, place).alias("last"), F.sum("__falls").alias("falls"), F.sum(given.isNull().cast("int")).alias("nulls"),
        F.min(given).alias("lo"), F.max(given).alias("hi"),
    )
    across = F.coalesce((F.col("first") < F.lag("last").over(Window.partitionBy("cell_id").orderBy("__chunk"))).cast("int"), F.lit(0))
    trust = ends.withColumn("across", across).groupBy("cell_id").agg(
        ((F.sum(F.col("falls") + F.col("across") + F.col("nulls")) == 0) & (F.min("lo") < F.max("hi"))).alias("__trusted")
    )
    return (
        join_small(found, trust, ["cell_id"])
        .withColumn("cycle_index", F.when(F.col("__trusted"), given).otherwise(F.col("__cycle")))
        .withColumn("phase", F.when(F.col("__trusted"), sign(cfg)).otherwise(F.col("phase")))
        .drop(*_OWN, "__cycle", "__trusted")
    )


def with_place(samples: DataFrame, chunk_s: float = CHUNK_S) -> DataFrame:
    """`samples` with `place`, a row's number in its cell from 0, in time order. Rows are numbered within chunks of a
    cell's time, and the chunks' sizes are summed up before them."""
    rows = samples.withColumn("__chunk", F.floor(F.col("time") / chunk_s))
    local = F.row_number().over(Window.partitionBy("cell_id", "__chunk").orderBy("time", "row_id"))
    sizes = rows.groupBy("cell_id", "__chunk").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("cell_id").orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("cell_id", "__chunk", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    placed = rows.withColumn("__nth", local).join(starts, ["cell_id", "__chunk"])
    return placed.withColumn("place", F.col("__start") + F.col("__nth") - 1).drop("__chunk", "__nth", "__start")


def over_blocks(samples: DataFrame, reach: int, columns: dict[str, Callable[[WindowSpec], Column]], block: int = 4096) -> DataFrame:
    """`samples` with columns of windows that reach at most `reach` rows either way in a cell's time order.

    The windows run within blocks of a cell's rows, each with copies of the `reach` rows beyond its ends, so a cell that
    holds a third of all rows is still spread over many tasks."""
    if reach >= block:
        raise ValueError(f"blocks of {block} rows are too short for a reach of {reach}")
    at, own = F.pmod(F.col("place"), F.lit(block)), F.floor(F.col("place") / block)
    entry = lambda b, guest: F.struct(b.alias("block"), F.lit(guest).alias("guest"))
    lent = F.array_compact(F.array(entry(own, False), F.when((at < reach) & (own > 0), entry(own - 1, True)), F.when(at >= block - reach, entry(own + 1, True))))
    rows = with_place(samples).withColumn("__in", F.explode(lent))
    w = Window.partitionBy("cell_id", "__in.block").orderBy("place")
    return rows.withColumns({name: f(w) for name, f in columns.items()}).where("not __in.guest").drop("__in", "place")


def half_cycle(samples: DataFrame, half: str) -> DataFrame:
    return samples.where(F.col("phase") == (1 if half == "charge" else -1))


def cycle_meta(samples: DataFrame, nominal_capacity_ah: float | str | None, cfg: Parsing = Parsing()) -> DataFrame:
    """One row per (cell, cycle): size, duration, voltages, capacities of the halves, C-rate, flags.

    The nominal capacity is a number for all cells or the name of a column that holds each cell's own.

    A half's capacity is the largest absolute capacity measured, or else the trapezoid of its absolute current. The halves
    are integrated within one window per (cell, cycle, phase), and everything is one aggregation after that.
    """
    half = Window.partitionBy("cell_id", "cycle_index", "phase").orderBy("time", "row_id")
    amps = F.abs("current")
    area = (amps + F.lag(amps).over(half)) / 2 * (F.col("time") - F.lag("time").over(half)) / 3600
    capacity = F.abs("capacity") if "capacity" in samples.columns else F.lit(None).cast("double")
    rows = samples.withColumns({"__amps": amps, "__area": area, "__capacity": capacity})
    of = lambda p, c: F.when(F.col("phase") == p, F.col(c))
    half_capacity = lambda p: F.coalesce(F.max(of(p, "__capacity")), F.sum(of(p, "__area")), F.lit(0.0))
    nominal = F.max(nominal_capacity_ah) if isinstance(nominal_capacity_ah, str) else F.lit(nominal_capacity_ah).cast("double")
    active = F.avg(F.when(F.col("__amps") > 0, F.col("__amps")))
    rate = F.when(nominal > 0, F.coalesce(active / nominal, F.lit(0.0)))
    meta = rows.groupBy("cell_id", "cycle_index").agg(
        F.count("*").alias("n_points"),
        (F.max("time") - F.min("time")).alias("duration_s"),
        F.min("voltage").alias("voltage_min"),
        F.max("voltage").alias("voltage_max"),
        (F.max("voltage") - F.min("voltage")).alias("voltage_range"),
        half_capacity(1).alias("charge_capacity_ah"),
        half_capacity(-1).alias("discharge_capacity_ah"),
        rate.alias("c_rate_est"),
    )
    fast = F.coalesce(F.col("c_rate_est") >= cfg.fast_charge_c_rate, F.lit(False))
    few = F.col("n_points") < cfg.min_points_per_cycle
    flags = F.array_compact(
        F.array(
            F.when(few, F.format_string(f"too_few_points(%d<{cfg.min_points_per_cycle})", "n_points")),
            F.when(F.col("c_rate_est").isNull(), F.lit("c_rate_unknown_no_nominal_capacity")),
            F.when(fast, F.format_string("fast_charge_rejected(C=%.2f)", "c_rate_est")),
        )
    )
    suitable = F.coalesce(F.col("c_rate_est") <= cfg.ica_max_c_rate, F.lit(False))
    return meta.withColumns({"ica_suitable": suitable, "fast_charge": fast, "flags": flags})


def ica_cycles(meta: DataFrame) -> DataFrame:
    return meta.where("ica_suitable")


def flagged(meta: DataFrame) -> DataFrame:
    return meta.where(F.size("flags") > 0)


def pick_for_ica(meta: DataFrame, research: float = 0.10, fallback: float = 0.20) -> DataFrame:
    """Per cell the cycle of lowest C-rate within the research limit, or else within the fallback limit."""
    rank = F.when(F.col("c_rate_est") <= research, 0).when(F.col("c_rate_est") <= fallback, 1)
    best = Window.partitionBy("cell_id").orderBy("__rank", "c_rate_est", "cycle_index")
    return (
        meta.withColumn("__rank", rank).where("__rank IS NOT NULL")
        .withColumn("__nth", F.row_number().over(best)).where("__nth = 1")
        .select("cell_id", "cycle_index", "c_rate_est", (F.col("__rank") == 0).alias("research_grade"))
    )
