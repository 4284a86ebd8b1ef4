"""Health report: predictions joined with physics, trends per cell, summary, evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import clamp, finite
from .config import MECHANISM_SCALES, TREND_SIGNALS

KEYS = ["cell_id", "cycle_number"]


def repeated_keys(df: DataFrame) -> DataFrame:
    """(cell_id, cycle_number, count) of the keys that occur more than once."""
    return df.groupBy(*KEYS).count().where("count > 1")


def validate(predictions: DataFrame, per_cell: DataFrame, physics: DataFrame | None = None) -> None:
    """ValueError for missing columns, repeated keys or cells without metrics. Only counts and one name reach the driver."""
    need = {"predictions": (predictions, [*KEYS, "y_true", "y_pred"]), "per_cell": (per_cell, ["cell_id", "rmse"])}
    if physics is not None:
        need["physics"] = (physics, KEYS)
    for name, (df, columns) in need.items():
        missing = [c for c in columns if c not in df.columns]
        if missing:
            raise ValueError(f"{name} lacks {missing}")
    for name, df in (("predictions", predictions), ("physics", physics)):
        if df is not None and (twice := repeated_keys(df).first()):
            raise ValueError(f"{name} has {twice['cell_id']}, {twice['cycle_number']} {twice['count']} times")
    if lone := predictions.join(per_cell, "cell_id", "left_anti").first():
        raise ValueError(f"cell {lone['cell_id']} has no metrics")


def cycle_table(predictions: DataFrame, physics: DataFrame, features: DataFrame | None = None) -> DataFrame:
    """Every prediction with its physics, and raw features if given, where they exist."""
    out = predictions.withColumnRenamed("y_pred", "soh_pred").withColumnRenamed("y_true", "soh_true").join(physics, KEYS, "left")
    return out if features is None else out.join(features.drop(*[c for c in features.columns if c in out.columns and c not in KEYS]), KEYS, "left")


def missing_physics(predictions: DataFrame, physics: DataFrame) -> DataFrame:
    return predictions.join(physics, KEYS, "left_anti")


def trends(cycles: DataFrame, signals=TREND_SIGNALS) -> DataFrame:
    """(cell_id, signal, slope, intercept, r2, n): least squares over cycle numbers of finite values, two at least."""
    stacked = cycles.select("cell_id", F.col("cycle_number").cast("double").alias("x"), F.explode(F.array(*[F.struct(F.lit(s).alias("signal"), F.col(s).cast("double").alias("y")) for s in signals])).alias("p"))
    stacked = stacked.select("cell_id", "x", "p.signal", "p.y")
    good = F.when(finite(F.col("y")), F.col("y"))
    two = F.count(good) >= 2
    fitted = stacked.groupBy("cell_id", "signal").agg(
        F.count(good).alias("n"), F.when(two, F.regr_slope(good, F.col("x"))).alias("slope"), F.when(two, F.regr_intercept(good, F.col("x"))).alias("intercept"),
        F.regr_sxy(good, F.col("x")).alias("sxy"), F.regr_syy(good, F.col("x")).alias("syy"),
    )
    r2 = F.when(F.col("slope").isNotNull(), 1 - (F.col("syy") - F.col("slope") * F.col("sxy")) / (F.col("syy") + 1e-12))
    return fitted.select("cell_id", "signal", "slope", "intercept", r2.alias("r2"), "n")


def dominant_mechanism(slope) -> Column:
    """The mechanism of the largest slope relative to its scale; earlier ones win ties; none below 0.1 of its scale."""
    rate = {m: F.coalesce(F.abs(slope(signal)) / scale, F.lit(0.0)) for m, (signal, scale) in MECHANISM_SCALES.items()}
    best = F.greatest(*rate.values())
    out = F.when(best < 0.1, "indeterminate")
    for m, r in rate.items():
        out = out.when(r == best, m)
    return out


def cell_summary(cycles: DataFrame, fitted: DataFrame, per_cell: DataFrame) -> DataFrame:
    """One row per cell: ends of its life, mean residual, confidence and penalty, trends, dominant mechanism, metrics."""
    first, last = (lambda c: F.min_by(c, "cycle_number")), (lambda c: F.max_by(c, "cycle_number"))
    base = cycles.groupBy("cell_id").agg(
        F.count("*").alias("n_cycles"), F.min("cycle_number").alias("first_cycle"), F.max("cycle_number").alias("last_cycle"),
        first("soh_pred").alias("soh_pred_first"), last("soh_pred").alias("soh_pred_last"), (last("soh_pred") - first("soh_pred")).alias("soh_pred_change"),
        first("soh_true").alias("soh_true_first"), last("soh_true").alias("soh_true_last"),
        F.avg(F.col("soh_true") - F.col("soh_pred")).alias("mean_residual"),
        F.avg("LLI_confidence").alias("mean_lli_confidence"), F.avg("LLI_disappearance_penalty").alias("mean_penalty"),
    )
    wide = fitted.groupBy("cell_id").pivot("signal", list(TREND_SIGNALS)).agg(F.first("slope").alias("slope"), F.first("r2").alias("r2"))
    joined = base.join(wide, "cell_id", "left").join(per_cell.select("cell_id", "rmse", "mae", F.col("r2").alias("model_r2")), "cell_id", "left")
    fit = (clamp(F.coalesce("model_r2", F.lit(0.0)), F.lit(0.0), F.lit(1.0)) + 1) / 2
    confidence = (fit + F.coalesce("mean_lli_confidence", F.lit(0.5))) / 2
    return joined.withColumns(
        {"dominant_mechanism": dominant_mechanism(lambda s: F.col(f"{s}_slope")), "overall_confidence": clamp(confidence, F.lit(0.0), F.lit(1.0))}
    )


def evidence(summary: DataFrame) -> DataFrame:
    """(cell_id, evidence: JSON) with slope, fit and relative rate of each mechanism; what isn't finite is null."""
    safe = lambda c: F.when(finite(c), c)
    parts = [
        F.struct(safe(F.col(f"{s}_slope")).alias("slope"), safe(F.col(f"{s}_r2")).alias("r2"), safe(F.abs(F.col(f"{s}_slope")) / scale).alias("normalised_rate")).alias(m)
        for m, (s, scale) in MECHANISM_SCALES.items()
    ]
    body = F.struct(F.col("dominant_mechanism"), F.col("overall_confidence"), *parts)
    return summary.select("cell_id", F.to_json(body, {"ignoreNullFields": "false"}).alias("evidence"))
