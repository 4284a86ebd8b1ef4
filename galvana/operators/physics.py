"""Degradation mechanisms from incremental-capacity curves: lithium inventory, active material, resistance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions.peaks import find_all
from .config import PHYSICS_COLS

PROMINENCE = 0.02
LEAST_WIDTH_MV = 5.0
TOLERANCE_V = 0.020
PEAKS = "array<struct<idx:int,voltage:double,height:double,width_mv:double>>"
MATCHES = "array<struct<ref_voltage:double,curr_voltage:double,shift:double,matched:boolean,disappeared:boolean,confidence:double>>"


def grid_spacing(voltage: np.ndarray, tolerance: float = 0.02) -> float:
    """Mean step in mV; ValueError if the grid isn't uniform."""
    steps = np.diff(voltage)
    mean = steps.mean()
    if len(steps) == 0 or mean <= 0 or np.abs(steps - mean).max() > tolerance * abs(mean):
        raise ValueError("voltage grid isn't uniform")
    return float(mean * 1000)


def peaks_of_all(voltages: list[np.ndarray], curves: list[np.ndarray], spacings: list[float]) -> list[list[dict]]:
    """The peaks of every curve of a batch, each with its voltage, height and width in mV."""
    width = [max(1, round(LEAST_WIDTH_MV / s)) for s in spacings]
    out: list[list[dict]] = [[] for _ in curves]
    for k, i, w in zip(*(x.tolist() for x in find_all(curves, np.full(len(curves), PROMINENCE), np.array(width))), strict=True):
        out[k].append({"idx": i, "voltage": float(voltages[k][i]), "height": float(curves[k][i]), "width_mv": w * spacings[k]})
    return out


def peaks_of(voltage: np.ndarray, dqdv: np.ndarray, spacing_mv: float | None = None) -> list[dict]:
    return peaks_of_all([voltage], [dqdv], [spacing_mv or grid_spacing(voltage)])[0]


def matched_peaks(reference: np.ndarray, current: np.ndarray, tolerance: float = TOLERANCE_V) -> list[dict]:
    """Pairs of least total distance, those within the tolerance; then lost reference peaks, then new ones."""
    pairs = [(r, c, abs(reference[r] - current[c])) for r, c in kernels.assign(reference, current)]
    good = [(r, c, d) for r, c, d in pairs if d <= tolerance]
    row = lambda r, c, s, m, gone, conf: {"ref_voltage": r, "curr_voltage": c, "shift": s, "matched": m, "disappeared": gone, "confidence": conf}
    out = [row(float(reference[r]), float(current[c]), float(current[c] - reference[r]), True, False, float(1 - d / tolerance)) for r, c, d in good]
    lost = sorted(set(range(len(reference))) - {r for r, _, _ in good})
    new = sorted(set(range(len(current))) - {c for _, c, _ in good})
    out += [row(float(reference[r]), None, None, False, True, 0.0) for r in lost]
    return out + [row(None, float(current[c]), None, False, False, 0.0) for c in new]


def active_material_loss(voltage: np.ndarray, reference: np.ndarray, current: np.ndarray) -> float:
    return 1 - kernels.simpson(current, voltage) / (kernels.simpson(reference, voltage) + 1e-8)


def resistance_growth(reference_widths: np.ndarray, current_widths: np.ndarray) -> float:
    """Mean relative growth of peak widths, paired by position; widths must be positive."""
    n = min(len(reference_widths), len(current_widths))
    if n == 0:
        return 0.0
    r, c = np.asarray(reference_widths, float), np.asarray(current_widths, float)
    if (r <= 0).any() or (c <= 0).any():
        raise ValueError("widths must be positive, in mV")
    return float(np.mean((c[:n] - r[:n]) / (r[:n] + 1e-8)))


def interpreted(voltage: np.ndarray, reference: np.ndarray, current: np.ndarray, spacing_mv: float | None = None, before: list[dict] | None = None, now: list[dict] | None = None) -> dict:
    """All metrics of one curve against its reference, with the peaks and matches they come from. `before` and `now`: the
    peaks of the two, if they are known."""
    spacing = spacing_mv or grid_spacing(voltage)
    before = peaks_of(voltage, reference, spacing) if before is None else before
    now = peaks_of(voltage, current, spacing) if now is None else now
    matches = matched_peaks(np.array([p["voltage"] for p in before]), np.array([p["voltage"] for p in now]))
    shifts = [m["shift"] for m in matches if m["matched"]]
    lost = sum(m["disappeared"] for m in matches)
    widths = [np.array([p["width_mv"] for p in x]) for x in (before, now)]
    of = max(len(before), 1)
    values = (
        float(np.mean(shifts)) if shifts else 0.0, len(shifts), lost, len(matches) - len(shifts) - lost, len(shifts) / of, lost / of,
        active_material_loss(voltage, reference, current), resistance_growth(*widths),
        float(widths[0].mean()) if len(before) else 0.0, float(widths[1].mean()) if len(now) else 0.0, spacing,
    )
    return dict(zip(PHYSICS_COLS, values, strict=True)) | {"peaks": now, "matches": matches}


_COUNTS = ("LLI_n_matched", "LLI_n_disappeared", "LLI_n_appeared")
_METRICS = ", ".join(f"{c} {'int' if c in _COUNTS else 'double'}" for c in PHYSICS_COLS)


def physics_table(curves: DataFrame, reference_cycle: int | None = None) -> DataFrame:
    """Metrics of each curve of (cell_id, cycle_number, is_reference, voltage_grid, dqdv) against its cell's reference: the
    marked curve, or else `reference_cycle` if given and the cell's earliest if not. One join on the cell and one pass;
    curves must share their cell's grid. Cells without a reference say so in `failed`."""
    marked = F.coalesce("is_reference", F.lit(False))
    chosen = curves if reference_cycle is None else curves.where(marked | (F.col("cycle_number") == reference_cycle))
    place = F.struct((~marked).alias("unmarked"), "cycle_number")
    refs = chosen.groupBy("cell_id").agg(F.min_by("dqdv", place).alias("ref_dqdv"))
    return against_reference(curves.join(refs, "cell_id", "left").select("cell_id", "cycle_number", "voltage_grid", "dqdv", "ref_dqdv"))


def against_reference(pairs: DataFrame) -> DataFrame:
    """Metrics of each row of (cell_id, cycle_number, voltage_grid, dqdv, ref_dqdv), in one pass; a row that can't be
    interpreted has nulls and the reason in `failed`."""
    schema = f"cell_id string, cycle_number int, {_METRICS}, peaks {PEAKS}, matches {MATCHES}, failed string"
    arrow = pairs.sparkSession.createDataFrame([], schema).toArrow().schema

    def judged(rows: list[tuple]) -> list[dict]:
        """Metrics of a batch of (voltage, current, reference); the peaks of all its curves are found together."""
        out: list[dict] = [{} for _ in rows]
        good, curves, place = [], [], {}
        for k, (v, now, ref) in enumerate(rows):
            if ref is None:
                out[k] = {"failed": "the cell has no reference"}
            elif not len(v) == len(ref) == len(now):
                out[k] = {"failed": "grid differs from the reference's"}
            else:
                try:
                    spacing = grid_spacing(v)
                except ValueError as e:
                    out[k] = {"failed": str(e)}
                    continue
                key = (v.tobytes(), ref.tobytes())  # curves of a cell share a reference
                if key not in place:
                    place[key] = len(curves)
                    curves.append((v, ref, spacing))
                good.append((k, place[key], len(curves), spacing))
                curves.append((v, now, spacing))
        peaks = peaks_of_all(*map(list, zip(*curves, strict=True))) if curves else []
        for k, before, own, spacing in good:
            v, now, ref = rows[k]
            try:
                out[k] = interpreted(v, ref, now, spacing, peaks[before], peaks[own])
            except ValueError as e:  # widths that aren't positive
                out[k] = {"failed": str(e)}
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arrays = ([None if x.values is None else x.values.to_numpy(zero_copy_only=False).astype(float) for x in batch.column(c)] for c in ("voltage_grid", "dqdv", "ref_dqdv"))
            found = judged(list(zip(*arrays, strict=True)))
            keys = zip(batch.column("cell_id").to_pylist(), batch.column("cycle_number").to_pylist(), found, strict=True)
            rows = [{"cell_id": str(c), "cycle_number": k} | x for c, k, x in keys]
            yield pa.RecordBatch.from_pylist([{n: x.get(n) for n in arrow.names} for x in rows], arrow)

    return pairs.mapInArrow(run, schema)


def min_max(column: str | Column) -> Column:
    """An array scaled to between 0 and 1 by its least and greatest value."""
    a = F.col(column) if isinstance(column, str) else column
    low, high = F.array_min(a), F.array_max(a)
    return F.transform(a, lambda x: (x - low) / (high - low + 1e-8))


def peak_matches(df: DataFrame, reference: str = "ref_peaks", current: str = "peaks", tolerance: float = TOLERANCE_V) -> DataFrame:
    """`df` with `matches`: the peaks of two arrays of voltages assigned to each other."""

    @F.pandas_udf(MATCHES)
    def matched(ref: pd.Series, now: pd.Series) -> pd.Series:
        return pd.Series([matched_peaks(np.asarray(a, float), np.asarray(b, float), tolerance) for a, b in zip(ref, now, strict=True)])

    return df.withColumn("matches", matched(reference, current))


def width_growth(reference: str, current: str) -> Column:
    """Mean relative growth of two arrays of widths paired by position; 0 where one is empty, an error for widths that
    aren't positive."""
    pairs = F.slice(F.arrays_zip(F.col(reference).alias("r"), F.col(current).alias("c")), 1, F.least(F.size(reference), F.size(current)))
    bad = F.exists(reference, lambda x: x <= 0) | F.exists(current, lambda x: x <= 0)
    total = F.aggregate(pairs, F.lit(0.0), lambda acc, p: acc + (p["c"] - p["r"]) / (p["r"] + 1e-8))
    mean = F.when(F.size(pairs) > 0, total / F.size(pairs)).otherwise(0.0)
    return F.when(bad, F.raise_error(F.lit("widths must be positive, in mV")).cast("double")).otherwise(mean)


def lli_summary(matches: Column, n_ref: Column) -> dict[str, Column]:
    """The lithium-inventory numbers from an array of matches, natively."""
    good = F.filter(matches, lambda m: m["matched"])
    lost = F.filter(matches, lambda m: m["disappeared"])
    total = F.aggregate(F.transform(good, lambda m: m["shift"]), F.lit(0.0), lambda a, x: a + x)
    of = F.greatest(n_ref, F.lit(1))
    return {
        "LLI_mean_shift": F.when(F.size(good) > 0, total / F.size(good)).otherwise(0.0),
        "LLI_n_matched": F.size(good), "LLI_n_disappeared": F.size(lost), "LLI_n_appeared": F.size(matches) - F.size(good) - F.size(lost),
        "LLI_confidence": F.size(good) / of, "LLI_disappearance_penalty": F.size(lost) / of,
    }


def shift_trajectory(physics: DataFrame) -> DataFrame:
    """Per cell: slope and intercept of the mean shift over cycles (two at least), and the first cycle of low confidence."""
    low = F.when(F.col("LLI_confidence") < 0.5, F.col("cycle_number"))
    return physics.groupBy("cell_id").agg(
        F.when(F.count("*") >= 2, F.regr_slope("LLI_mean_shift", "cycle_number")).alias("slope"),
        F.when(F.count("*") >= 2, F.regr_intercept("LLI_mean_shift", "cycle_number")).alias("intercept"),
        F.min(low).alias("first_low_confidence"),
    )


def normalised_to_first(df: DataFrame, column: str, out: str) -> DataFrame:
    """`column` over the cell's first positive value in cycle order, as `out`; null where a cell has none."""
    positive = F.when(F.col(column) > 0, F.col(column))
    first = df.groupBy("cell_id").agg(F.min_by(positive, F.when(positive.isNotNull(), F.col("cycle_number"))).alias("__first"))
    return df.join(first, "cell_id").withColumn(out, F.col(column) / F.col("__first")).drop("__first")


def merged(ml: DataFrame, physics: DataFrame) -> DataFrame:
    """Features and physics of the cycles that have both."""
    return ml.join(physics, ["cell_id", "cycle_number"])


def peak_table(curves: DataFrame) -> DataFrame:
    """One row per peak of (cell_id, cycle_number, voltage_grid, dqdv)."""

    @F.pandas_udf(PEAKS)
    def found(voltage: pd.Series, dqdv: pd.Series) -> pd.Series:
        grids = [np.asarray(v, float) for v in voltage]
        return pd.Series(peaks_of_all(grids, [np.asarray(y, float) for y in dqdv], [grid_spacing(v) for v in grids]))

    return curves.select("cell_id", "cycle_number", F.explode(found("voltage_grid", "dqdv")).alias("p")).select("cell_id", "cycle_number", "p.*")


class ExplodePeaks:
    """`explode_peaks(TABLE(curves) PARTITION BY cell_id)`: a row for each peak of curves that have the columns cell_id,
    cycle_number, voltage_grid and dqdv. Curves are worked on a few hundred at a time."""

    def __init__(self):
        self.held: list[tuple] = []

    def eval(self, row: Row):
        if row["dqdv"] is not None and row["voltage_grid"] is not None:
            self.held.append((str(row["cell_id"]), row["cycle_number"], np.asarray(row["voltage_grid"], float), np.asarray(row["dqdv"], float)))
        if len(self.held) >= 256:
            yield from self.terminate()

    def terminate(self):
        held, self.held = self.held, []
        grids = [h[2] for h in held]
        for (cell, cycle, _, _), peaks in zip(held, peaks_of_all(grids, [h[3] for h in held], [grid_spacing(v) for v in grids]), strict=True):
            for p in peaks:
                yield cell, cycle, p["idx"], p["voltage"], p["height"], p["width_mv"]


def register_functions(spark: SparkSession) -> None:
    """The table functions of this module, for SQL."""
    kind = "cell_id string, cycle_number int, idx int, voltage double, height double, width_mv double"
    spark.udtf.register("explode_peaks", F.udtf(ExplodePeaks, returnType=kind))


#: The sentences of an explanation.
SENTENCES = {
    "health": "Predicted SOH: %.1f%%.",
    "shift": "Lithium inventory loss (LLI): ICA peaks shifted %.1f mV to %s voltage (match confidence %.0f%%).",
    "lost": "Lithium inventory loss (LLI): %d reference peak(s) disappeared, suggesting capacity-limiting Li plating or SEI growth.",
    "area": "Active material loss (LAM): %.1f%% reduction in total ICA area — electrode active sites consumed.",
    "width": "Resistance growth: ICA peak width increased %.1f%% (broadening = higher impedance / polarisation).",
    "none": "No significant degradation signature detected at this cycle.",
}


def explained(df: DataFrame) -> DataFrame:
    """`df` (soh_pred and physics columns) with a sentence for each mechanism that shows, as explanation."""
    c = lambda n: F.coalesce(F.col(n).cast("double"), F.lit(0.0))
    shift, conf, lam, res, lost = (c(n) for n in ("LLI_mean_shift", "LLI_confidence", "LAM_loss", "Resistance_growth", "LLI_n_disappeared"))
    say = lambda name, *values: F.format_string(SENTENCES[name], *values)
    moved = say("shift", shift * 1000, F.when(shift > 0, "higher").otherwise("lower"), conf * 100)
    parts = [
        F.when((conf > 0.5) & (F.abs(shift) > 0.003), moved).when(lost > 0, say("lost", lost.cast("int"))),
        F.when(lam > 0.02, say("area", lam * 100)),
        F.when(res > 0.05, say("width", res * 100)),
    ]
    none = F.when(F.coalesce(*parts).isNull(), F.lit(SENTENCES["none"]))
    return df.withColumn("explanation", F.concat_ws(" ", say("health", F.col("soh_pred") * 100), *parts, none))
