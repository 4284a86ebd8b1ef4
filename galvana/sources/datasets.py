"""Nested laboratory datasets as samples: batches of cells by JSON, and the half-cycles of periodic characterisations."""

from __future__ import annotations

import io
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .mat import read_halves, read_mat
from .readers import registry

_NUMBERS = T.ArrayType(T.DoubleType())
#: By field; a map, since the names t and T differ only in case.
_CYCLE = T.MapType(T.StringType(), _NUMBERS)
_CELL = T.StructType(
    [
        T.StructField("barcode", T.StringType()), T.StructField("cathode", T.StringType()), T.StructField("charge_policy", T.StringType()),
        T.StructField("summary", T.StructType([T.StructField("QDischarge", _NUMBERS), T.StructField("cycle", _NUMBERS)])),
        T.StructField("cycles", T.MapType(T.StringType(), _CYCLE)),
    ]
)
TIME_UNITS = {"s": 1.0, "min": 60.0, "h": 3600.0}


def read_batch(spark: SparkSession, path: str, time_unit: str = "min") -> DataFrame:
    """Samples of a batch of cells: JSON lines of {cell_id: cell}, arrays per cycle.

    The capacity is the charge one while charging and else the discharge one; soh is a cycle's discharge capacity over the
    cell's first; cycles whose key isn't a number or that lack time, voltage or current are left out, and a temperature
    that is never there is null.
    """
    raw = spark.read.schema(T.StructType([T.StructField("value", T.StringType())])).text(path)
    return _samples(raw.select(F.explode(F.from_json("value", T.MapType(T.StringType(), _CELL))).alias("cell_id", "cell")), time_unit)


def _samples(cells: DataFrame, time_unit: str) -> DataFrame:
    """Samples of (cell_id, cell: _CELL)."""
    if time_unit not in TIME_UNITS:
        raise ValueError(f"time unit {time_unit!r}; known: {sorted(TIME_UNITS)}")
    first = F.col("cell.summary.QDischarge")[0]
    health = F.map_from_arrays(F.transform("cell.summary.cycle", lambda c: c.cast("int")), F.transform("cell.summary.QDischarge", lambda q: q / first))
    cycles = cells.select("cell_id", health.alias("health"), F.col("cell.charge_policy").alias("protocol"), F.explode("cell.cycles").alias("key", "c"))
    cycles = cycles.withColumn("cycle_index", F.col("key").try_cast("int")).where("cycle_index IS NOT NULL AND c['t'] IS NOT NULL AND c['V'] IS NOT NULL AND c['I'] IS NOT NULL")
    none = F.array().cast("array<double>")  # a field that a cycle lacks is null at every point
    points = cycles.select(
        "cell_id", "cycle_index", "protocol", F.try_element_at("health", F.col("cycle_index")).alias("soh"),
        F.posexplode(F.arrays_zip(*[F.coalesce(F.col("c")[n], none).alias(f"x{k}") for k, n in enumerate(("t", "V", "I", "Qc", "Qd", "T"))])).alias("pos", "p"),
    )
    order = F.col("cycle_index").cast("long") * F.lit(1 << 32) + F.col("pos")
    return points.select(
        "cell_id", order.alias("row_id"), (F.col("p.x0") * TIME_UNITS[time_unit]).alias("time"), F.col("p.x1").alias("voltage"), F.col("p.x2").alias("current"),
        F.when(F.col("p.x2") >= 0, F.col("p.x3")).otherwise(F.col("p.x4")).alias("capacity"), "cycle_index", F.col("p.x5").alias("temperature"), "soh", "protocol",
    )


#: What a pickle of plain data and numpy arrays may name.
_ADMITTED = {
    ("numpy", "ndarray"), ("numpy", "dtype"), ("numpy", "float64"), ("numpy.core.multiarray", "_reconstruct"), ("numpy.core.multiarray", "scalar"),
    ("numpy._core.multiarray", "_reconstruct"), ("numpy._core.multiarray", "scalar"), ("numpy._core.numeric", "_frombuffer"), ("numpy.core.numeric", "_frombuffer"),
    ("collections", "OrderedDict"), ("_codecs", "encode"),
}


class _Plain(pickle.Unpickler):
    """Unpickles numbers, strings, containers and numpy arrays; anything else that a pickle names is refused unseen."""

    def find_class(self, module: str, name: str):
        if (module, name) not in _ADMITTED:
            raise pickle.UnpicklingError(f"the pickle names {module}.{name}, which isn't plain data")
        return super().find_class(module, name)


def _numbers(x) -> list[float] | None:
    if x is None or isinstance(x, (str, bytes, dict)):
        return None
    a = np.asarray(x)
    return a.astype(float).ravel().tolist() if a.dtype.kind in "fiub" else None


def _cell_row(key: str, cell: dict) -> dict:
    """A pickled cell in the shape of _CELL; fields that aren't there are null."""
    text = lambda *names: next((str(cell[n]) for n in names if cell.get(n)), None)
    summary = cell.get("summary") or {}
    first = lambda *names: next((v for n in names if (v := _numbers(summary.get(n))) is not None), None)
    cycles = [(str(k), [(f, v) for f in ("t", "V", "I", "Qc", "Qd", "T") if (v := _numbers(c.get(f))) is not None]) for k, c in (cell.get("cycles") or {}).items() if isinstance(c, dict)]
    return {
        "cell_id": text("barcode") or key,
        "cell": {
            "barcode": text("barcode"), "cathode": text("cathode"), "charge_policy": text("charge_policy", "charge_protocol"),
            "summary": {"QDischarge": first("QDischarge", "Qd"), "cycle": first("cycle", "cycles")}, "cycles": cycles,
        },
    }


def read_pickled_batch(spark: SparkSession, path: str, time_unit: str = "min") -> DataFrame:
    """The same of pickled batches, a dict or list of cells: one task for each file, which gives a row for each cell. Only
    plain data are unpickled (`_Plain`); a pickle that names any other class or function is an error, and nothing of it runs."""
    schema = T.StructType([T.StructField("cell_id", T.StringType()), T.StructField("cell", _CELL)])
    arrow = spark.createDataFrame([], schema).toArrow().schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                found = _Plain(io.BytesIO(content.as_buffer()), encoding="latin1").load()
                if not isinstance(found, (dict, list)):
                    raise ValueError(f"a batch is a dict or a list of cells, not {type(found).__name__}")
                for key, cell in found.items() if isinstance(found, dict) else enumerate(found):
                    if isinstance(cell, dict):
                        yield pa.RecordBatch.from_pylist([_cell_row(str(key), cell)], arrow)

    return _samples(spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, schema), time_unit)


#: The kinds of half-cycles of a characterisation, by preference.
HALF_PREFERENCE = ("OCVdc", "C1dc", "OCVch", "C1ch")


def preferred_halves(halves: DataFrame) -> DataFrame:
    """Of (cell_id, cycle_index, kind, ...) the half-cycle of the most preferred kind with at least ten points."""
    rank = F.array_position(F.array(*[F.lit(k) for k in HALF_PREFERENCE]), F.col("kind"))
    sized = halves.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy("cell_id", "cycle_index", "kind"))).where("__n >= 10").withColumn("__rank", rank).where("__rank > 0")
    return sized.withColumn("__best", F.min("__rank").over(Window.partitionBy("cell_id", "cycle_index"))).where("__rank = __best").drop("__n", "__rank", "__best")


def downsampled(df: DataFrame, points: int = 1500, keys: tuple[str, ...] = ("cell_id", "cycle_index")) -> DataFrame:
    """At most `points` rows of each group, evenly spaced by position, ends included; half-way positions round to even."""
    w = Window.partitionBy(*keys)
    placed = df.withColumns({"__i": F.row_number().over(w.orderBy("time", "row_id")) - 1, "__n": F.count(F.lit(1)).over(w)})
    # position i is kept if it is the rounded place of some k: k = i * (points - 1) / (n - 1), looked up around it
    step = (F.col("__n") - 1) / F.lit(float(points - 1))
    k = F.floor(F.col("__i") / step)
    hit = lambda j: (j >= 0) & (j <= points - 1) & (F.bround(j * step, 0) == F.col("__i"))
    return placed.where((F.col("__n") <= points) | hit(k) | hit(k + 1)).drop("__i", "__n")


def joined_cycles(halves: DataFrame) -> DataFrame:
    """Samples from half-cycles of (cell_id, cycle_index, row_id, time: days, q: mAh, voltage, temperature).

    Each half-cycle starts where the one before ended, one second later; the current is the slope of charge over hours.
    """
    half = Window.partitionBy("cell_id", "cycle_index")
    rows = halves.withColumn("__t", (F.col("time") - F.min("time").over(half)) * 86400.0).withColumn("capacity", F.col("q") / 1000)
    spans = rows.groupBy("cell_id", "cycle_index").agg((F.max("__t") + 1).alias("__span"))
    before = Window.partitionBy("cell_id").orderBy("cycle_index").rowsBetween(Window.unboundedPreceding, -1)
    starts = spans.withColumn("__start", F.coalesce(F.sum("__span").over(before), F.lit(0.0))).drop("__span")
    order = half.orderBy("__t", "row_id")

    def slope(c: str):
        here, last, nxt = F.col(c), F.lag(c).over(order), F.lead(c).over(order)
        return F.coalesce((nxt - last) / 2, nxt - here, here - last)

    hours = slope("__t") / 3600
    rows = rows.withColumn("current", F.when(F.abs(hours) > 1e-12, slope("capacity") / hours).otherwise(0.0))
    return rows.join(starts, ["cell_id", "cycle_index"]).withColumn("time", F.col("__t") + F.col("__start")).drop("__t", "__start", "q")


registry.register("batch", read_batch, (".jsonl",))
registry.register("pickled_batch", read_pickled_batch, (".pkl", ".pickle"))


def converted_mat(spark: SparkSession, path: str, points: int = 1500) -> DataFrame:
    """Samples of the cells of a file of half-cycles: of each cycle the preferred half-cycle, at most `points` of its rows,
    one cycle after another. Written by cell (`sinks.write_csv` after `partitionBy`), it is what a cycler would export."""
    return joined_cycles(downsampled(preferred_halves(read_halves(spark, path)), points)).drop("kind")


registry.register("mat", read_mat, (".mat",))
