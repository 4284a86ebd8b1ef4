"""Difference curves against a cell's reference cycle, and their ten statistical features."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import clamp, finite, join_small
from . import folds
from .config import FEATURE_COLS, LEAKING, LEGACY_NAMES, METADATA_COLS, Features


#: References, a curve for each cell, are broadcast up to this many.
BROADCAST_CURVES = 20_000


def exploded(curves: DataFrame, column: str = "q_smooth") -> DataFrame:
    """(cell_id, cycle_index, grid_idx, q) of curves held as arrays."""
    return curves.select("cell_id", "cycle_index", F.posexplode(column).alias("grid_idx", "q"))


def reference_cycles(curves: DataFrame, rank: int = 1, ok: str = "ok") -> DataFrame:
    """(cell_id, ref_cycle_index): the rank-th valid cycle of each cell that has as many."""
    w = Window.partitionBy("cell_id").orderBy("cycle_index")
    valid = curves.where(F.col(ok)).withColumn("__nth", F.row_number().over(w))
    return valid.where(F.col("__nth") == rank).select("cell_id", F.col("cycle_index").alias("ref_cycle_index"))


def delta_curves(points: DataFrame, references: DataFrame) -> DataFrame:
    """(cell_id, cycle_index, grid_idx, ref_cycle_index, dq): each cycle minus its cell's reference, point by point."""
    of_reference = points.join(references, "cell_id").where(F.col("cycle_index") == F.col("ref_cycle_index"))
    of_reference = of_reference.select("cell_id", "ref_cycle_index", "grid_idx", F.col("q").alias("q_ref"))
    return points.join(of_reference, ["cell_id", "grid_idx"]).select(
        "cell_id", "cycle_index", "grid_idx", "ref_cycle_index", (F.col("q") - F.col("q_ref")).alias("dq")
    )


def clipped(delta: DataFrame, sigma: float = 5.0, column: str = "dq", keys=("cell_id", "cycle_index")) -> DataFrame:
    """Values held within sigma population deviations of the group's mean; NaN and infinities become null."""
    w = Window.partitionBy(*keys)
    good = delta.withColumn(column, F.when(finite(F.col(column)), F.col(column)))
    mean, sd = F.avg(column).over(w), F.stddev_pop(column).over(w)
    return good.withColumn(column, F.when(sd > 0, clamp(F.col(column), mean - sigma * sd, mean + sigma * sd)).otherwise(F.col(column)))


def _area(x: Column, dv: float) -> Column:
    """Trapezoids of unit steps over the values that are there, in grid order, times the step."""
    idx = F.when(x.isNotNull(), F.col("grid_idx"))
    return (F.sum(x) - (F.min_by(x, idx) + F.max_by(x, idx)) / 2) * dv


def curve_features(delta: DataFrame, dv: float = 0.005, keys=("cell_id", "cycle_index"), least: int = 10) -> DataFrame:
    """The ten features of each curve given point by point; null where fewer than `least` points are finite.

    Moments are population moments: variance, skewness and excess kurtosis; a constant curve has null for the last two.
    One hash aggregation with partial sums.
    """
    x = F.col("dq")
    n, sd = F.count(x), F.stddev_pop(x)
    made = {
        "dqv_variance": F.var_pop(x),
        "dqv_log_variance": F.log(F.var_pop(x) + 1e-30),
        "dqv_skewness": F.when(sd > 0, F.skewness(x)),
        "dqv_kurtosis": F.when(sd > 0, F.kurtosis(x)),
        "dqv_integral_abs": _area(F.abs(x), dv),
        "dqv_max_deviation": F.max(F.abs(x)),
        "dqv_min": F.min(x),
        "dqv_max": F.max(x),
        "dqv_mean": F.avg(x),
        "dqv_rms": F.sqrt(F.avg(x * x)),
    }
    check_no_leakage(list(made))
    out = delta.groupBy(*keys).agg(n.alias("n_finite"), *[F.when(n >= least, c).alias(name) for name, c in made.items()])
    any_value = F.coalesce(*[F.col(name) for name in made]).isNotNull()
    return out.withColumn("extraction_ok", any_value)


def check_no_leakage(names: list[str]) -> None:
    leaked = sorted(set(names) & set(LEAKING))
    if leaked:
        raise ValueError(f"features that tell the state of health: {leaked}")


#: Features that a chemistry adds, by name: functions of the finite values of a difference curve, an array in grid order,
#: and the grid step. `register_chemistry` adds to them.
CHEMISTRIES: dict[str, dict[str, Callable[[Column, float], Column]]] = {}


def register_chemistry(name: str, extra: dict[str, Callable[[Column, float], Column]]) -> None:
    check_no_leakage(list(extra))
    CHEMISTRIES[name.lower()] = extra


def _total(a: Column, f: Callable[[Column], Column]) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + f(x))


def _array_area(a: Column, f: Callable[[Column], Column], dv: float) -> Column:
    """Trapezoids of unit steps over the values of an array, times the step."""
    return (_total(a, f) - (f(a[0]) + f(F.element_at(a, -1))) / 2) * dv


def _range(a: Column, dv: float) -> Column:
    return F.array_max(a) - F.array_min(a)


register_chemistry("lfp", {"dqv_range": _range})
register_chemistry(
    "nmc",
    {
        "dqv_range": _range,
        "dqv_positive_integral": lambda a, dv: _array_area(a, lambda x: F.greatest(x, F.lit(0.0)), dv),
        "dqv_negative_integral": lambda a, dv: _array_area(a, lambda x: F.least(x, F.lit(0.0)), dv),
    },
)


def array_features(delta: DataFrame, cfg: Features = Features(), least: int = 10) -> DataFrame:
    """`delta` with the features of its difference curves, held as arrays `dq`, as `curve_features` of `clipped` has them.

    Everything happens inside the row, so no point of a curve is shuffled."""
    rows = delta.withColumn("__x", F.filter("dq", finite))
    rows = rows.withColumn("__n", F.size("__x")).withColumn("__m", _total(F.col("__x"), lambda x: x) / F.nullif("__n", F.lit(0)))
    deviation = lambda a, m, n, k: _total(F.col(a), lambda x: F.pow(x - F.col(m), F.lit(k))) / F.nullif(n, F.lit(0))
    rows = rows.withColumn("__s", F.sqrt(deviation("__x", "__m", "__n", 2)) * cfg.outlier_sigma)
    held = F.transform("__x", lambda x: clamp(x, F.col("__m") - F.col("__s"), F.col("__m") + F.col("__s")))
    rows = rows.withColumn("__a", F.when(F.col("__s") > 0, held).otherwise(F.col("__x")))
    a, n = F.col("__a"), F.col("__n")
    rows = rows.withColumn("__m", _total(a, lambda x: x) / F.nullif(n, F.lit(0)))
    rows = rows.withColumn("__v", deviation("__a", "__m", "__n", 2))
    spread = F.col("__v") > 0
    made = {
        "dqv_variance": F.col("__v"),
        "dqv_log_variance": F.log(F.col("__v") + 1e-30),
        "dqv_skewness": F.when(spread, deviation("__a", "__m", "__n", 3) / F.pow("__v", F.lit(1.5))),
        "dqv_kurtosis": F.when(spread, deviation("__a", "__m", "__n", 4) / (F.col("__v") * F.col("__v")) - 3),
        "dqv_integral_abs": _array_area(a, F.abs, cfg.dv),
        "dqv_max_deviation": F.array_max(F.transform(a, F.abs)),
        "dqv_min": F.array_min(a),
        "dqv_max": F.array_max(a),
        "dqv_mean": F.col("__m"),
        "dqv_rms": F.sqrt(_total(a, lambda x: x * x) / F.nullif(n, F.lit(0))),
    } | {name: f(a, cfg.dv) for name, f in CHEMISTRIES.get(cfg.chemistry.lower(), {}).items()}
    check_no_leakage(list(made))
    out = rows.withColumns({name: F.when(n >= least, c) for name, c in made.items()})
    return out.withColumn("extraction_ok", n >= least).drop("__x", "__n", "__m", "__s", "__a", "__v")


def delta_arrays(curves: DataFrame, rank: int = 1, supplied: DataFrame | None = None) -> DataFrame:
    """(cell_id, cycle_index, ref_cycle_index, dq: array) of the valid curves: each minus its cell's reference, which is one
    narrow table of arrays. supplied: (cell_id, grid_idx, q_ref) of references from elsewhere; their cells have -1."""
    valid = curves.where("ok").select("cell_id", "cycle_index", "q_smooth")
    refs = valid.join(reference_cycles(curves, rank), "cell_id").where("cycle_index = ref_cycle_index").select("cell_id", "ref_cycle_index", F.col("q_smooth").alias("q_ref"))
    if supplied is not None:
        points = F.array_sort(F.collect_list(F.struct("grid_idx", "q_ref")))
        given = supplied.groupBy("cell_id").agg(F.lit(-1).alias("ref_cycle_index"), F.map_from_entries(points).alias("points"))
        size = F.size(F.first("q_smooth"))
        sized = given.join(valid.groupBy("cell_id").agg(size.alias("n")), "cell_id")
        own = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.element_at("points", i))
        given = sized.select("cell_id", "ref_cycle_index", own.alias("q_ref"))
        refs = refs.join(given.select("cell_id"), "cell_id", "left_anti").unionByName(given)
    return join_small(valid, refs, ["cell_id"], rows=BROADCAST_CURVES).select(
        "cell_id", "cycle_index", "ref_cycle_index", F.zip_with("q_smooth", "q_ref", lambda a, b: a - b).alias("dq")
    )


def feature_matrix(curves: DataFrame, cfg: Features = Features(), supplied: DataFrame | None = None) -> DataFrame:
    """The feature columns for each cycle of `curves` (from curves.qv_curves). Failed curves keep a row of nulls, with the
    reference cycle of their cell; supplied as in `delta_arrays`."""
    delta = delta_arrays(curves, cfg.reference_cycle_rank, supplied)
    made = array_features(delta, cfg).drop("dq", "ref_cycle_index")
    refs = delta.select("cell_id", "ref_cycle_index").distinct()
    out = curves.select("cell_id", "cycle_index").join(made, ["cell_id", "cycle_index"], "left").join(refs, "cell_id", "left")
    return out.select(
        "cell_id", F.col("cycle_index").alias("cycle_number"), "ref_cycle_index", F.lit(cfg.hash()).alias("config_hash"),
        F.coalesce("extraction_ok", F.lit(False)).alias("extraction_ok"), *[c for c in made.columns if c.startswith("dqv_")],
    )


def usable(features: DataFrame) -> DataFrame:
    """The rows whose features could be extracted; all rows of a cell where none could."""
    any_ok = features.groupBy("cell_id").agg(F.bool_or("extraction_ok").alias("__any"))
    return join_small(features, any_ok, ["cell_id"]).where("extraction_ok or not coalesce(__any, false)").drop("__any")


def validated(df: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Legacy names renamed; ValueError naming the columns that are missing, with the older name if that is there."""
    renamed = df.withColumnsRenamed({old: new for old, new in LEGACY_NAMES.items() if old in df.columns and new not in df.columns})
    missing = [c for c in ("cell_id", "cycle_number", "soh", *FEATURE_COLS, *extra) if c not in renamed.columns]
    if missing:
        raise ValueError(f"feature table lacks {missing}; it has {df.columns}")
    return renamed


def schema() -> dict[str, list[str]]:
    return {"metadata": list(METADATA_COLS), "features": list(FEATURE_COLS)}


def soh(discharge_capacity: Column, nominal_capacity_ah: float | Column) -> Column:
    """Discharge capacity over nominal capacity: a positive number, or a column, null where that isn't positive."""
    if isinstance(nominal_capacity_ah, Column):
        return discharge_capacity / F.when(nominal_capacity_ah > 0, nominal_capacity_ah)
    if not nominal_capacity_ah or nominal_capacity_ah <= 0:
        raise ValueError("nominal capacity must be positive")
    return discharge_capacity / F.lit(float(nominal_capacity_ah))


def stability(features: DataFrame, names: list[str], group: str = "cell_id", reference=None) -> DataFrame:
    """Per feature and group: median, IQR, shift of the median against a reference group; per feature the spread of the
    medians relative to their mean, and whether that is stable (below 0.5, two groups at least)."""
    stacked = features.select(F.col(group).alias("group"), F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("x")) for n in names])).alias("s"))
    stacked = stacked.select("group", "s.feature", "s.x").where(finite(F.col("x")))
    q = F.percentile("x", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    per = stacked.groupBy("feature", "group").agg(q.alias("q")).select("feature", "group", F.col("q")[1].alias("median"), (F.col("q")[2] - F.col("q")[0]).alias("iqr"))
    over = per.groupBy("feature").agg(
        F.count("*").alias("groups"), (F.stddev_pop("median") / (F.abs(F.avg("median")) + 1e-12)).alias("spread"),
        F.max(F.when(F.col("group") == F.lit(reference), F.col("median"))).alias("reference_median"),
    )
    return per.join(over, "feature").select(
        "feature", "group", "median", "iqr", "spread", ((F.col("groups") >= 2) & (F.col("spread") < 0.5)).alias("stable"),
        (F.col("median") - F.col("reference_median")).alias("shift"),
    )


# --- preprocessing before a model ------------------------------------------------------------------------------------


def quantiles(df: DataFrame, names: list[str], probs: list[float]) -> dict[str, list[float | None]]:
    """Exact quantiles, linear between ranks, of the finite values of columns; None where there are none. Two scans."""
    return dict(zip(names, folds.exact_quantiles(df, names, probs)[folds.ALL], strict=True))


def imputed(df: DataFrame, names: list[str], train: DataFrame | None = None, flags: bool = True) -> DataFrame:
    """Missing values by the training median, with an indicator for each column that had any missing in training."""
    fit = folds.fitted(train if train is not None else df, names)[folds.ALL]
    value = {n: F.when(finite(F.col(n)), F.col(n)).otherwise(F.lit(fit[n].fill)) for n in names}
    marks = {f"{n}_missing": (~finite(F.col(n))).cast("double") for n in names if flags and f"{n}_missing" in fit}
    return df.withColumns(marks).withColumns(value)


def outliers_clipped(df: DataFrame, names: list[str], sigma: float = 5.0, train: DataFrame | None = None) -> DataFrame:
    fit = (train if train is not None else df).agg(*[f(n).alias(f"{k}_{n}") for n in names for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    return df.withColumns({n: clamp(F.col(n), F.lit(fit[f"m_{n}"] - sigma * fit[f"s_{n}"]), F.lit(fit[f"m_{n}"] + sigma * fit[f"s_{n}"])) for n in names})


def scaled(df: DataFrame, names: list[str], kind: str = "robust", train: DataFrame | None = None) -> DataFrame:
    """Robust scaling (median, interquartile range) or standard scaling (mean, population deviation)."""
    if kind not in ("robust", "standard"):
        raise ValueError(f"unknown scaler: {kind}")
    source = train if train is not None else df
    if kind == "robust":
        pairs = {n: (middle, high - low if high is not None else None) for n, (low, middle, high) in quantiles(source, names, [0.25, 0.5, 0.75]).items()}
    else:
        fit = source.agg(*[F.struct(F.avg(n), F.stddev_pop(n)).alias(n) for n in names]).first()
        pairs = {n: tuple(fit[n]) for n in names}
    return df.withColumns({n: (F.col(n) - F.lit(c)) / F.lit(s or 1.0) for n, (c, s) in pairs.items()})


def prepared(df: DataFrame, names: list[str], kind: str = "robust", sigma: float = 5.0, train: DataFrame | None = None) -> DataFrame:
    """Imputed, clipped and scaled, in that order; the indicator columns of missing values go through all three. One fit."""
    return folds.prepared(df, names, folds.fitted(train if train is not None else df, names, None, kind, sigma))


def group_folds(df: DataFrame, n_splits: int = 5, shuffle: bool = True, seed: int = 42, group: str = "cell_id") -> DataFrame:
    """`df` with a fold number that is the same for all rows of a group. Groups are cells, a narrow dimension: their names
    are shuffled on the driver with numpy's generator, so that a seed always gives the same folds; without shuffling they
    are dealt in order, by Spark."""
    names = df.select(F.col(group)).distinct()
    n = names.count()
    if n < n_splits:
        raise ValueError(f"{n_splits} folds need as many groups; there are {n}")
    if not shuffle:
        tiles = names.withColumn("fold", F.ntile(n_splits).over(Window.orderBy(group)) - 1)  # one row for each cell
        return join_small(df, tiles, [group])
    order = np.array(sorted(r[0] for r in names.collect()), dtype=object)
    np.random.RandomState(seed).shuffle(order)
    dealt = [(c, k) for k, part in enumerate(np.array_split(order, n_splits)) for c in part]
    table = df.sparkSession.createDataFrame(dealt, T.StructType([df.schema[group], T.StructField("fold", T.IntegerType())]))
    return join_small(df, table, [group])
