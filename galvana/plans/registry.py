"""Registered queries and the SQL that checks them. A query has no SQL only where SQL can't express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import kernels
from ..operators import curves, cycles, dashboard, features, folds, ingest, model, physics, report
from ..operators.config import Features
from ..streaming import summaries
from . import base

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, tables: str = ""):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = base.with_tables(tables, sql) if tables else sql
        return f

    return add


def r(name: str, digits: int = 6):
    return F.round(F.col(name), digits).alias(name)


# --- samples, phases, cycles -----------------------------------------------------------------------------------------


@query("SELECT cell_id, row_id, time, current, voltage FROM (SELECT *, row_number() OVER (PARTITION BY cell_id, time ORDER BY row_id) AS nth FROM samples) WHERE nth = 1", "samples")
def clean_dedup(spark, d):
    return ingest.clean_rows(base.samples(spark, d)).select("cell_id", "row_id", "time", "current", "voltage")


@query("SELECT cell_id, row_id, CAST(phase AS INTEGER) AS phase FROM cycled", "cycled")
def phase_carry(spark, d):
    return cycles.with_phase(base.samples(spark, d)).select("cell_id", "row_id", "phase")


@query("SELECT cell_id, row_id, cycle_index FROM cycled", "cycled")
def cycle_detect(spark, d):
    return base.cycled(spark, d).select("cell_id", "row_id", "cycle_index")


@query(
    """SELECT cell_id, cycle_index, n_points, round(duration_s, 3) AS duration_s, voltage_min, voltage_max, round(voltage_range, 6) AS voltage_range,
  round(charge_capacity_ah, 4) AS charge_capacity_ah, round(discharge_capacity_ah, 4) AS discharge_capacity_ah, round(c_rate_est, 6) AS c_rate_est,
  ica_suitable, fast_charge, concat_ws(';', CASE WHEN n_points < 20 THEN format('too_few_points({}<20)', n_points) END,
    CASE WHEN fast_charge THEN 'fast' END) AS flag_text FROM meta""",
    "meta",
)
def cycle_meta(spark, d):
    m = base.meta(spark, d)
    plain = F.transform("flags", lambda x: F.when(x.startswith("fast_charge_rejected"), "fast").otherwise(x))
    return m.select(
        "cell_id", "cycle_index", "n_points", r("duration_s", 3), "voltage_min", "voltage_max", r("voltage_range"), r("charge_capacity_ah", 4),
        r("discharge_capacity_ah", 4), r("c_rate_est"), "ica_suitable", "fast_charge", F.array_join(plain, ";").alias("flag_text"),
    )


@query(
    """SELECT cell_id, cycle_index, round(c_rate_est, 6) AS c_rate_est, tier = 0 AS research_grade FROM (
  SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY tier, c_rate_est, cycle_index) AS nth FROM (
    SELECT *, CASE WHEN c_rate_est <= 2.0 THEN 0 WHEN c_rate_est <= 4.0 THEN 1 END AS tier FROM meta) WHERE tier IS NOT NULL) WHERE nth = 1""",
    "meta",
)
def c_rate_pick(spark, d):
    return cycles.pick_for_ica(base.meta(spark, d), 2.0, 4.0).withColumn("c_rate_est", F.round("c_rate_est", 6))


@query("SELECT cell_id, count(*) AS suitable, CAST(sum(n_points) AS BIGINT) AS points FROM meta WHERE fast_charge AND n_points >= 3 GROUP BY ALL", "meta")
def fast_cycles(spark, d):
    return base.meta(spark, d).where("fast_charge AND n_points >= 3").groupBy("cell_id").agg(F.count("*").alias("suitable"), F.sum("n_points").alias("points"))


# --- charge, gates, voltage ------------------------------------------------------------------------------------------

_HALF = "PARTITION BY cell_id, cycle_index ORDER BY time, row_id"


@query(
    f"SELECT cell_id, row_id, round(sum(a) OVER (PARTITION BY cell_id, cycle_index ORDER BY time, row_id ROWS UNBOUNDED PRECEDING), 4) AS q_ah FROM (SELECT *, coalesce((current + lag(current) OVER h) / 2 * (time - lag(time) OVER h) / 3600, 0.0) AS a FROM discharge WINDOW h AS ({_HALF}))",
    "discharge",
)
def coulomb_trap(spark, d):
    return curves.coulomb_trapezoid(base.discharge(spark, d)).select("cell_id", "row_id", r("q_ah", 4))


@query(
    f"SELECT cell_id, row_id, round(sum(a) OVER (PARTITION BY cell_id, cycle_index ORDER BY time, row_id ROWS UNBOUNDED PRECEDING) / 3600, 4) AS q_ah FROM (SELECT *, abs(current) * coalesce(time - lag(time) OVER h, lead(time) OVER h - time, 0.0) AS a FROM discharge WINDOW h AS ({_HALF}))",
    "discharge",
)
def coulomb_rect(spark, d):
    return curves.coulomb_rectangle(base.discharge(spark, d)).select("cell_id", "row_id", r("q_ah", 4))


@query(
    """SELECT cell_id, row_id FROM (SELECT *, count(*) OVER (PARTITION BY cell_id, cycle_index) AS n FROM (
  SELECT * FROM (SELECT *, quantile_cont(abs(current), 0.5) OVER (PARTITION BY cell_id, cycle_index) AS med FROM discharge)
  WHERE med > 0 AND abs(abs(current) - med) / med <= 0.5)) WHERE n >= 2""",
    "discharge",
)
def cc_segment(spark, d):
    return curves.cc_segment(base.discharge(spark, d), 0.5, 2).select("cell_id", "row_id")


@query(
    f"""+ s AS (SELECT *, abs(abs(current) - lag(abs(current)) OVER h) / greatest(time - lag(time) OVER h, 1e-6) AS slope, row_number() OVER h AS k,
  count(*) OVER (PARTITION BY cell_id, cycle_index) AS n FROM discharge WINDOW h AS ({_HALF})),
cv AS (SELECT x.row_id, coalesce(stddev_samp(abs(y.current)), 0.0) / greatest(avg(abs(y.current)), 1e-12) AS cv FROM s x JOIN s y ON x.cell_id = y.cell_id AND x.cycle_index = y.cycle_index
  AND y.k BETWEEN x.k - (greatest(5, x.n // 20) - 1 - (greatest(5, x.n // 20) - 1) // 2) AND x.k + (greatest(5, x.n // 20) - 1) // 2 GROUP BY ALL)
SELECT cell_id, row_id, abs(current) / 100.0 <= 2.5 AS gate_rate,
  slope IS NULL OR slope <= 5 * greatest(quantile_cont(slope, 0.5) OVER (PARTITION BY cell_id, cycle_index), 1e-9) AS gate_step, cv <= 0.75 AS gate_cv
FROM s JOIN cv USING (row_id)""",
    "discharge",
)
def cc_gates(spark, d):
    found = curves.cc_gates(base.discharge(spark, d), 100.0, Features(c_rate_max=2.5, current_cv_max=0.75))
    return found.select("cell_id", "row_id", "gate_rate", F.coalesce("gate_step", F.lit(True)).alias("gate_step"), "gate_cv")


#: The fold, one kept row after another: the next one is the first that rises more than a step above it.
_RISING = """RECURSIVE_ seqd AS (SELECT *, row_number() OVER (PARTITION BY cell_id, cycle_index ORDER BY time, row_id) AS k FROM {src}),
rising AS (SELECT * FROM seqd WHERE k = 1 UNION ALL
  SELECT s.* FROM (SELECT r.cell_id AS c0, r.cycle_index AS c1, min(s.k) AS nxt FROM rising r JOIN seqd s ON s.cell_id = r.cell_id AND s.cycle_index = r.cycle_index AND s.k > r.k AND s.voltage > r.voltage + {step} GROUP BY ALL)
  JOIN seqd s ON s.cell_id = c0 AND s.cycle_index = c1 AND s.k = nxt)"""


@query("+" + _RISING.format(src="discharge", step="1e-9") + " SELECT cell_id, row_id, voltage FROM rising", "discharge")
def mono_running(spark, d):
    return curves.monotone_running(base.discharge(spark, d)).select("cell_id", "row_id", "voltage")


@query("+" + _RISING.format(src="days", step="0.3").replace("RECURSIVE_ ", "RECURSIVE_ days AS (SELECT * EXCLUDE (cycle_index), CAST(floor(time / 86400) AS INTEGER) AS cycle_index FROM cycled), ") + " SELECT cell_id, row_id FROM rising", "cycled")
def mono_steps(spark, d):
    """The same with steps so wide that most rises are too small on their own."""
    days = base.cycled(spark, d).withColumn("cycle_index", F.floor(F.col("time") / 86400).cast("int"))
    return curves.monotone_running(days, 0.3).select("cell_id", "row_id")


@query(f"SELECT cell_id, row_id FROM (SELECT *, lag(voltage) OVER ({_HALF}) AS before FROM discharge) WHERE before IS NULL OR voltage <= before + 1e-4", "discharge")
def mono_adjacent(spark, d):
    return curves.monotone_adjacent(base.discharge(spark, d)).select("cell_id", "row_id")


@query(
    "SELECT cell_id, row_id FROM (SELECT *, row_number() OVER (PARTITION BY cell_id, cycle_index, round_even(voltage * 1e4, 0) ORDER BY time, row_id) AS nth FROM discharge) WHERE nth = 1",
    "discharge",
)
def volt_dedup(spark, d):
    return curves.voltage_dedup(base.discharge(spark, d)).select("cell_id", "row_id")


@query(
    "+" + _RISING.format(src="discharge", step="1e-9") + """,
seg AS (SELECT *, lead(voltage) OVER w AS v1, lead(abs(current)) OVER w AS y1 FROM rising WINDOW w AS (PARTITION BY cell_id, cycle_index ORDER BY voltage)),
idx AS (SELECT *, CAST(ceil((voltage - 2.5) / 0.05) AS BIGINT) AS lo, CAST(ceil((v1 - 2.5) / 0.05) AS BIGINT) - 1 AS hi FROM seg),
pts AS (SELECT *, unnest(CASE WHEN v1 IS NULL THEN (CASE WHEN lo * CAST(0.05 AS DOUBLE) + 2.5 = voltage THEN [lo] ELSE [] END) WHEN hi >= lo THEN generate_series(lo, hi) ELSE [] END) AS grid_idx FROM idx)
SELECT cell_id, cycle_index, grid_idx, round(abs(current) + coalesce((grid_idx * CAST(0.05 AS DOUBLE) + 2.5 - voltage) / (v1 - voltage) * (y1 - abs(current)), 0.0), 6) AS amps FROM pts""",
    "discharge",
)
def resample_linear(spark, d):
    rising = curves.monotone_running(base.discharge(spark, d)).withColumn("amps", F.abs("current"))
    return curves.resampled(rising, "voltage", ["amps"], 0.05, 2.5).select("cell_id", "cycle_index", "grid_idx", r("amps"))


def _hourly(spark, d):
    hour = F.floor((F.col("time") - F.lit(1704067200.0)) / 21600).cast("int")
    seen = F.avg(F.when(F.col("step") == "view", F.col("voltage")))
    return base.samples(spark, d).groupBy("cell_id", hour.alias("grid_idx")).agg(seen.alias("y"))


_HOURLY = "+ hourly AS (SELECT cell_id, CAST(floor((time - 1704067200.0) / 21600) AS INTEGER) AS grid_idx, avg(CASE WHEN step = 'view' THEN voltage END) AS y FROM samples GROUP BY ALL)"


@query(
    _HOURLY
    + """, near AS (SELECT *, last_value(y IGNORE NULLS) OVER b AS y0, first_value(y IGNORE NULLS) OVER a AS y1,
    last_value(CASE WHEN y IS NOT NULL THEN grid_idx END IGNORE NULLS) OVER b AS x0, first_value(CASE WHEN y IS NOT NULL THEN grid_idx END IGNORE NULLS) OVER a AS x1
  FROM hourly WINDOW b AS (PARTITION BY cell_id ORDER BY grid_idx ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY cell_id ORDER BY grid_idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT cell_id, grid_idx, round(coalesce(y, y0 + (y1 - y0) * (grid_idx - x0) / (x1 - x0), y0, y1), 6) AS y FROM near""",
    "samples",
)
def nan_inpaint(spark, d):
    return curves.inpainted(_hourly(spark, d), "y", ("cell_id",)).select("cell_id", "grid_idx", r("y"))


@query(_HOURLY + " SELECT cell_id, grid_idx, round(CASE WHEN grid_idx >= 5 AND grid_idx < 100 THEN y END, 6) AS y FROM hourly", "samples")
def edge_trim(spark, d):
    return curves.edge_trimmed(_hourly(spark, d), ["y"], 5, 105).select("cell_id", "grid_idx", r("y"))


@query(
    f"SELECT cell_id, row_id, round(coalesce((lead(voltage) OVER h - lag(voltage) OVER h) / 2, lead(voltage) OVER h - voltage, voltage - lag(voltage) OVER h), 6) AS slope FROM discharge WINDOW h AS ({_HALF})",
    "discharge",
)
def gradient(spark, d):
    return base.discharge(spark, d).select("cell_id", "row_id", F.round(curves.gradient("voltage", curves.in_half()), 6).alias("slope"))


@query(
    "SELECT cell_id, row_id, round(sum(voltage) OVER (PARTITION BY cell_id ORDER BY time, row_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5.0, 6) AS mean FROM samples", "samples"
)
def moving_avg(spark, d):
    found = cycles.over_blocks(base.samples(spark, d), 2, {"mean": lambda w: curves.moving_average("voltage", w, 5)}, block=512)
    return found.select("cell_id", "row_id", r("mean"))


def _sg_sql() -> str:
    weights = kernels.savgol_weights(21, 3, 0, 10)
    term = lambda k: f"lead(voltage, {k}) OVER w" if k >= 0 else f"lag(voltage, {-k}) OVER w"
    total = " + ".join(f"CAST({float(c)!r} AS DOUBLE) * {term(k - 10)}" for k, c in enumerate(weights))
    return f"SELECT cell_id, row_id, round({total}, 6) AS smooth FROM samples WINDOW w AS (PARTITION BY cell_id ORDER BY time, row_id)"


@query(_sg_sql(), "samples")
def sg_smooth(spark, d):
    found = cycles.over_blocks(base.samples(spark, d), 10, {"smooth": lambda w: curves.savgol_interior("voltage", w, 21, 3)}, block=512)
    return found.select("cell_id", "row_id", r("smooth"))


# --- difference curves and features ----------------------------------------------------------------------------------

_REFS = "refs AS (SELECT cell_id, cycle_index AS ref_cycle_index FROM (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY cycle_index) AS nth FROM meta WHERE n_points >= 6) WHERE nth = 1)"
_DELTA = f"""+{_REFS},
delta AS (SELECT b.cell_id, b.cycle_index, b.grid_idx, r.ref_cycle_index, b.q - r.q AS dq FROM binned b JOIN (
  SELECT x.cell_id, x.grid_idx, x.q, f.ref_cycle_index FROM binned x JOIN refs f ON x.cell_id = f.cell_id AND x.cycle_index = f.ref_cycle_index) r
  ON b.cell_id = r.cell_id AND b.grid_idx = r.grid_idx)"""


def _refs(spark, d):
    return features.reference_cycles(base.meta(spark, d).withColumn("ok", F.col("n_points") >= 6))


def _delta(spark, d):
    return features.delta_curves(base.binned(spark, d), _refs(spark, d))


@query(f"+{_REFS} SELECT * FROM refs", "meta")
def reference_pick(spark, d):
    return _refs(spark, d)


@query(_DELTA + " SELECT cell_id, cycle_index, grid_idx, ref_cycle_index, round(dq, 6) AS dq FROM delta", "binned meta")
def delta_qv(spark, d):
    return _delta(spark, d).select("cell_id", "cycle_index", "grid_idx", "ref_cycle_index", r("dq"))


@query(
    _DELTA
    + """ SELECT cell_id, cycle_index, grid_idx, round(CASE WHEN sd > 0 THEN greatest(m - 1.5 * sd, least(dq, m + 1.5 * sd)) ELSE dq END, 6) AS dq FROM (
  SELECT *, avg(dq) OVER w AS m, stddev_pop(dq) OVER w AS sd FROM delta WINDOW w AS (PARTITION BY cell_id))""",
    "binned meta",
)
def outlier_clip(spark, d):
    return features.clipped(_delta(spark, d), 1.5, keys=("cell_id",)).select("cell_id", "cycle_index", "grid_idx", r("dq"))


@query(
    """+ moments AS (SELECT cell_id, grid_cell, count(dq) AS n, avg(dq) AS m, var_pop(dq) AS v, sum(abs(dq)) AS s, min(dq) AS lo, max(dq) AS hi, max(abs(dq)) AS dev,
    sqrt(avg(dq * dq)) AS rms, abs(arg_min(dq, grid_idx)) AS a, abs(arg_max(dq, grid_idx)) AS b FROM pts GROUP BY ALL),
centred AS (SELECT p.cell_id, p.grid_cell, avg((dq - m) ** 3) AS m3, avg((dq - m) ** 4) AS m4 FROM pts p JOIN moments USING (cell_id, grid_cell) GROUP BY ALL)
SELECT cell_id, grid_cell, n AS n_finite, round(v, 6) AS dqv_variance, round(ln(v + 1e-30), 5) AS dqv_log_variance, round(m3 / v ** 1.5, 5) AS dqv_skewness,
  round(m4 / (v * v) - 3, 5) AS dqv_kurtosis, round((s - (a + b) / 2) * 0.05, 5) AS dqv_integral_abs, dev AS dqv_max_deviation, lo AS dqv_min, hi AS dqv_max,
  round(m, 6) AS dqv_mean, round(rms, 6) AS dqv_rms FROM moments JOIN centred USING (cell_id, grid_cell) WHERE n >= 10""".replace(
        "+ moments", "+ pts AS (SELECT cell_id, row_id % 16 AS grid_cell, row_id AS grid_idx, current AS dq FROM samples), moments"
    ),
    "samples",
)
def feature_moments(spark, d):
    pts = base.samples(spark, d).select("cell_id", (F.col("row_id") % 16).alias("grid_cell"), F.col("row_id").alias("grid_idx"), F.col("current").alias("dq"))
    f = features.curve_features(pts, 0.05, keys=("cell_id", "grid_cell")).where("n_finite >= 10")
    return f.select(
        "cell_id", "grid_cell", "n_finite", r("dqv_variance"), r("dqv_log_variance", 5), r("dqv_skewness", 5), r("dqv_kurtosis", 5),
        r("dqv_integral_abs", 5), "dqv_max_deviation", "dqv_min", "dqv_max", r("dqv_mean"), r("dqv_rms"),
    )


@query("SELECT cell_id, cycle_index, round(discharge_capacity_ah / 50.0, 5) AS soh FROM meta", "meta")
def soh_label(spark, d):
    return base.meta(spark, d).select("cell_id", "cycle_index", F.round(features.soh(F.col("discharge_capacity_ah"), 50.0), 5).alias("soh"))


@query(
    """+ s AS (SELECT cell_id AS grp, unnest([{'f': 'f1', 'x': f1}, {'f': 'f2', 'x': f2}, {'f': 'f3', 'x': f3}]) AS p FROM features),
per AS (SELECT p.f AS feature, grp, quantile_cont(p.x, 0.5) AS median, quantile_cont(p.x, 0.75) - quantile_cont(p.x, 0.25) AS iqr FROM s WHERE p.x IS NOT NULL GROUP BY ALL),
o AS (SELECT feature, count(*) AS n, stddev_pop(median) / (abs(avg(median)) + 1e-12) AS spread, max(CASE WHEN grp = 0 THEN median END) AS ref FROM per GROUP BY ALL)
SELECT feature, grp AS "group", round(median, 6) AS median, round(iqr + 1e-9, 6) AS iqr, round(spread, 6) AS spread, n >= 2 AND spread < 0.5 AS stable, round(median - ref, 6) AS shift
FROM per JOIN o USING (feature)""",
    "features",
)
def feature_stability(spark, d):
    s = features.stability(base.features(spark, d), ["f1", "f2", "f3"], reference=0)
    return s.select("feature", "group", r("median"), F.round(F.col("iqr") + 1e-9, 6).alias("iqr"), r("spread"), "stable", r("shift"))


@query(
    """+ fit AS (SELECT quantile_cont(f3, 0.5) AS m FROM features)
SELECT cell_id, cycle_number, round(coalesce(f3, m), 6) AS f3, CASE WHEN f3 IS NULL THEN 1.0 ELSE 0.0 END::DOUBLE AS f3_missing FROM features, fit""",
    "features",
)
def impute_flag(spark, d):
    return features.imputed(base.features(spark, d), ["f1", "f3"]).select("cell_id", "cycle_number", r("f3"), "f3_missing")


@query(
    """+ fit AS (SELECT quantile_cont(f1, 0.5) AS m1, quantile_cont(f1, 0.75) - quantile_cont(f1, 0.25) AS s1, quantile_cont(f2, 0.5) AS m2,
    quantile_cont(f2, 0.75) - quantile_cont(f2, 0.25) AS s2 FROM features)
SELECT cell_id, cycle_number, round((f1 - m1) / s1, 5) AS f1, round((f2 - m2) / s2, 5) AS f2 FROM features, fit""",
    "features",
)
def robust_scale(spark, d):
    return features.scaled(base.features(spark, d), ["f1", "f2"]).select("cell_id", "cycle_number", r("f1", 5), r("f2", 5))


# --- model -----------------------------------------------------------------------------------------------------------


@query(
    """+ x AS (SELECT cell_id, soh AS y, f1 AS a, f2 AS b, coalesce(f3, 0.0) AS c FROM features)
SELECT cell_id, count(*) AS n, round(sum(y), 5) AS sy, round(sum(y * y), 6) AS syy, round(sum(a), 5) AS s1, round(sum(c), 4) AS s3, round(sum(a * y), 5) AS s1y,
  round(sum(a * a), 5) AS s11, round(sum(a * b), 4) AS s12, round(sum(a * c), 4) AS s13, round(sum(b * b), 3) AS s22 FROM x GROUP BY cell_id""",
    "features",
)
def gram_stats(spark, d):
    g = model.gram_stats(base.features(spark, d), ("f1", "f2", "f3"))
    pick = {"s1": ("sx", 0, 5), "s3": ("sx", 2, 4), "s1y": ("sxy", 0, 5), "s11": ("sxx", 0, 5), "s12": ("sxx", 1, 4), "s13": ("sxx", 2, 4), "s22": ("sxx", 3, 3)}
    return g.select("cell_id", "n", r("sy", 5), r("syy"), *[F.round(F.col(c)[i], k).alias(n) for n, (c, i, k) in pick.items()])


@query("SELECT cell_id, cycle_number, round(0.9 + (f1 - 0.5) / 0.25 * 0.02 + (f2 - 3.0) / 1.5 * -0.01 + (coalesce(f3, 0.0) - 4.0) / 2.0 * 0.005, 6) AS soh_pred FROM features", "features")
def predict_linear(spark, d):
    fit = {"mean": (0.5, 3.0, 4.0), "scale": (0.25, 1.5, 2.0), "coef": (0.02, -0.01, 0.005), "intercept": 0.9}
    return model.predictions(base.features(spark, d), fit, ("f1", "f2", "f3")).select("cell_id", "cycle_number", r("soh_pred"))


@query(
    """SELECT cell_id, count(*) AS n, round(sqrt(avg((y_true - y_pred) ** 2)), 6) AS rmse, round(avg(abs(y_true - y_pred)), 6) AS mae,
  round(1 - sum((y_true - y_pred) ** 2) / (var_pop(y_true) * count(*)), 4) AS r2 FROM predictions GROUP BY GROUPING SETS ((cell_id), ())""",
    "predictions",
)
def metrics_grouping_sets(spark, d):
    return model.metrics(base.predictions(spark, d)).select("cell_id", "n", r("rmse"), r("mae"), r("r2", 4))


@query()
def loco_predictions(spark, d):
    """Coordinate descent over several features isn't SQL; a test holds it against a row-wise version."""
    return model.loco_predictions(base.features(spark, d), names=("f1", "f2", "f3"))


# --- report ----------------------------------------------------------------------------------------------------------


def _cycle_table(spark, d):
    return report.cycle_table(base.predictions(spark, d), base.physics_known(spark, d))


_CT = "+ ct AS (SELECT p.cell_id, p.cycle_number, y_true AS soh_true, y_pred AS soh_pred, f.* EXCLUDE (cell_id, cycle_number) FROM predictions p LEFT JOIN physics_known f ON p.cell_id = f.cell_id AND p.cycle_number = f.cycle_number)"


@query(_CT + " SELECT cell_id, cycle_number, round(soh_pred, 6) AS soh_pred, round(LLI_mean_shift, 6) AS LLI_mean_shift, LAM_loss FROM ct", "predictions physics_known")
def report_left_join(spark, d):
    return _cycle_table(spark, d).select("cell_id", "cycle_number", r("soh_pred"), r("LLI_mean_shift"), "LAM_loss")


@query("SELECT p.cell_id, p.cycle_number, round(f1, 6) AS f1, LAM_loss FROM features p JOIN physics_known f ON p.cell_id = f.cell_id AND p.cycle_number = f.cycle_number", "features physics_known")
def ml_physics_inner(spark, d):
    return physics.merged(base.features(spark, d), base.physics_known(spark, d)).select("cell_id", "cycle_number", r("f1"), "LAM_loss")


@query("SELECT cell_id, cycle_number FROM predictions p WHERE NOT EXISTS (SELECT 1 FROM physics_known f WHERE f.cell_id = p.cell_id AND f.cycle_number = p.cycle_number)", "predictions physics_known")
def anti_missing(spark, d):
    return report.missing_physics(base.predictions(spark, d), base.physics_known(spark, d)).select("cell_id", "cycle_number")


_TRENDS = """, st AS (SELECT cell_id, CAST(cycle_number AS DOUBLE) AS x, unnest([{'s': 'soh_pred', 'y': soh_pred}, {'s': 'LLI_mean_shift', 'y': LLI_mean_shift}, {'s': 'LAM_loss', 'y': LAM_loss}, {'s': 'Resistance_growth', 'y': Resistance_growth}]) AS p FROM ct),
fits AS (SELECT cell_id, p.s AS signal, count(p.y) AS n, regr_slope(p.y, x) AS slope, regr_intercept(p.y, x) AS intercept, regr_sxy(p.y, x) AS sxy, regr_syy(p.y, x) AS syy FROM st GROUP BY ALL),
trends AS (SELECT *, 1 - (syy - slope * sxy) / (syy + 1e-12) AS r2 FROM fits)"""


@query(_CT + _TRENDS + " SELECT cell_id, signal, n, round(slope, 8) + 0.0 AS slope, round(intercept, 6) + 0.0 AS intercept, round(r2, 5) AS r2 FROM trends", "predictions physics_known")
def trend_ols(spark, d):
    return report.trends(_cycle_table(spark, d)).select("cell_id", "signal", "n", *[(F.round(c, k) + 0.0).alias(c) for c, k in (("slope", 8), ("intercept", 6))], r("r2", 5))


def _summary(spark, d):
    per = model.metrics(base.predictions(spark, d)).where("cell_id IS NOT NULL")
    table = _cycle_table(spark, d)
    return report.cell_summary(table, report.trends(table), per)


_SUMMARY = """, base AS (SELECT cell_id, count(*) AS n_cycles, min(cycle_number) AS first_cycle, max(cycle_number) AS last_cycle, arg_min(soh_pred, cycle_number) AS soh_pred_first,
  arg_max(soh_pred, cycle_number) AS soh_pred_last, avg(soh_true - soh_pred) AS mean_residual, avg(LLI_confidence) AS conf,
  1 - sum((soh_true - soh_pred) ** 2) / (var_pop(soh_true) * count(*)) AS model_r2 FROM ct GROUP BY cell_id),
rates AS (SELECT cell_id, max(CASE WHEN signal = 'LLI_mean_shift' THEN abs(slope) / 1e-4 END) AS a, max(CASE WHEN signal = 'LAM_loss' THEN abs(slope) / 5e-4 END) AS b,
  max(CASE WHEN signal = 'Resistance_growth' THEN abs(slope) / 1e-3 END) AS c FROM trends GROUP BY cell_id)"""


@query(
    _CT + _TRENDS + _SUMMARY
    + """ SELECT cell_id, n_cycles, first_cycle, last_cycle, round(soh_pred_first, 6) AS soh_pred_first, round(soh_pred_last, 6) AS soh_pred_last, round(mean_residual, 6) AS mean_residual,
  round(conf, 6) AS mean_lli_confidence, round(greatest(0.0, least(1.0, ((greatest(0.0, least(1.0, coalesce(model_r2, 0.0))) + 1) / 2 + coalesce(conf, 0.5)) / 2)), 5) AS overall_confidence FROM base""",
    "predictions physics_known",
)
def cell_summary(spark, d):
    return _summary(spark, d).select(
        "cell_id", "n_cycles", "first_cycle", "last_cycle", r("soh_pred_first"), r("soh_pred_last"), r("mean_residual"), r("mean_lli_confidence"), r("overall_confidence", 5)
    )


@query(
    _CT + _TRENDS + _SUMMARY
    + " SELECT cell_id, CASE WHEN greatest(a, b, c) < 0.1 THEN 'indeterminate' WHEN a = greatest(a, b, c) THEN 'LLI' WHEN b = greatest(a, b, c) THEN 'LAM' ELSE 'resistance_growth' END AS dominant_mechanism FROM rates",
    "predictions physics_known",
)
def dominant_mech(spark, d):
    return _summary(spark, d).select("cell_id", "dominant_mechanism")


@query(
    "SELECT cell_id, count(*) AS n, round(regr_slope(LLI_mean_shift, cycle_number), 8) AS slope, round(regr_intercept(LLI_mean_shift, cycle_number), 6) AS intercept, min(CASE WHEN LLI_confidence < 0.5 THEN cycle_number END) AS first_low_confidence FROM physics GROUP BY cell_id",
    "physics",
)
def shift_trajectory(spark, d):
    p = base.physics(spark, d)
    counted = p.groupBy("cell_id").agg(F.count("*").alias("n"))
    return physics.shift_trajectory(p).join(counted, "cell_id").select("cell_id", "n", r("slope", 8), r("intercept"), "first_low_confidence")


# --- dashboard -------------------------------------------------------------------------------------------------------

_SIG = """+ sig AS (SELECT *, least(1.0, abs(LLI_mean_shift) / 0.05) * greatest(0.3, LLI_confidence) AS lli, least(1.0, greatest(LAM_loss, 0.0) * 2) AS lam,
  least(1.0, greatest(Resistance_growth, 0.0)) AS res FROM physics),
dom AS (SELECT *, CASE WHEN lli + lam + res + 1e-9 < 0.05 THEN 'EARLY' WHEN lli >= lam AND lli >= res THEN 'LLI' WHEN lam >= res THEN 'LAM' ELSE 'RES' END AS dominant,
  least(0.97, greatest(lli, lam, res) / (lli + lam + res + 1e-9) * 0.6 + 0.35) AS confidence FROM sig)"""


def _signals(spark, d):
    return dashboard.signals(base.physics(spark, d))


@query(_SIG + " SELECT cell_id, cycle_number, round(lli, 6) AS sig_LLI, round(lam, 6) AS sig_LAM, round(res, 6) AS sig_RES, dominant, round(confidence, 6) AS confidence FROM dom", "physics")
def mechanism_signals(spark, d):
    return _signals(spark, d).select("cell_id", "cycle_number", r("sig_LLI"), r("sig_LAM"), r("sig_RES"), "dominant", r("confidence"))


_PHASES = """, run AS (SELECT *, sum(b) OVER w AS run FROM (SELECT *, CASE WHEN lag(dominant) OVER w = dominant THEN 0 ELSE 1 END AS b FROM dom WINDOW w AS (PARTITION BY cell_id ORDER BY cycle_number)) WINDOW w AS (PARTITION BY cell_id ORDER BY cycle_number)),
sized AS (SELECT *, count(*) OVER (PARTITION BY cell_id, run) AS size FROM run),
opened AS (SELECT *, CASE WHEN b = 1 AND (run = 1 OR size >= 3 OR dominant = 'EARLY') THEN 1 ELSE 0 END AS o FROM sized),
ph AS (SELECT *, sum(o) OVER (PARTITION BY cell_id ORDER BY cycle_number) AS phase FROM opened)"""


@query(
    _SIG + _PHASES.replace("opened", "opened2").replace("sized", "sized2")
    + " SELECT cell_id, CAST(phase AS BIGINT) AS phase, arg_min(dominant, cycle_number) AS mech, min(cycle_number) AS start_cycle, max(cycle_number) AS end_cycle, count(*) AS n FROM ph GROUP BY cell_id, phase",
    "physics",
)
def phase_segments(spark, d):
    return dashboard.phase_segments(_signals(spark, d).withColumn("soh", F.lit(1.0))).select("cell_id", "phase", "mech", "start_cycle", "end_cycle", "n")


@query(_SIG + " SELECT cell_id, min(CASE WHEN lli > 0.16 THEN cycle_number END) AS onset_LLI, min(CASE WHEN lam > 0.16 THEN cycle_number END) AS onset_LAM, min(CASE WHEN res > 0.16 THEN cycle_number END) AS onset_RES FROM dom GROUP BY cell_id", "physics")
def onsets(spark, d):
    return dashboard.onsets(_signals(spark, d))


@query(
    """+ steps AS (SELECT *, lag(y_pred) OVER w AS p0, lag(cycle_number) OVER w AS c0 FROM predictions WINDOW w AS (PARTITION BY cell_id ORDER BY cycle_number))
SELECT cell_id, arg_min(CAST(trunc(c0 + (0.9 - p0) / (y_pred - p0 + 1e-9) * (cycle_number - c0)) AS INTEGER), cycle_number) AS eol_cycle
FROM steps WHERE p0 IS NOT NULL AND y_pred <= 0.9 GROUP BY cell_id""",
    "predictions",
)
def eol_crossing(spark, d):
    return dashboard.eol_cycle(base.predictions(spark, d).withColumnRenamed("y_pred", "soh_pred"), 0.9)


@query(
    """+ top AS (SELECT floor(avg(m)) AS top FROM (SELECT max(cycle_number) AS m FROM predictions GROUP BY cell_id)),
grid AS (SELECT k, CAST(round_even(k / CAST(80 AS DOUBLE) * top, 0) AS INTEGER) AS cycle FROM top, range(81) t(k)),
seg AS (SELECT *, lead(cycle_number) OVER w AS c1, lead(y_true) OVER w AS t1, row_number() OVER w AS nth FROM predictions WINDOW w AS (PARTITION BY cell_id ORDER BY cycle_number)),
pts AS (SELECT cell_id, k, cycle, CASE WHEN c1 IS NULL THEN y_true ELSE y_true + greatest(0.0, (cycle - cycle_number) / CAST(c1 - cycle_number AS DOUBLE)) * (t1 - y_true) END AS y
  FROM seg JOIN grid ON (cycle >= cycle_number OR nth = 1) AND (c1 IS NULL OR cycle < c1))
SELECT CAST(k AS INTEGER) AS k, cycle, round(avg(y), 6) AS y_true FROM pts GROUP BY ALL""",
    "predictions",
)
def batch_average(spark, d):
    return dashboard.batch_average(base.predictions(spark, d), ["y_true"]).select("k", "cycle", r("y_true"))


@query(
    _CT + """ SELECT cell_id, cycle_number, concat_ws(' ', 'Predicted SOH: ' || printf('%.1f', soh_pred * 100) || '%.',
  CASE WHEN coalesce(LLI_confidence, 0) > 0.5 AND abs(coalesce(LLI_mean_shift, 0)) > 0.003 THEN 'Lithium inventory loss (LLI): ICA peaks shifted ' || printf('%.1f', LLI_mean_shift * 1000) || ' mV to '
    || CASE WHEN LLI_mean_shift > 0 THEN 'higher' ELSE 'lower' END || ' voltage (match confidence ' || printf('%.0f', LLI_confidence * 100) || '%).'
    WHEN coalesce(LLI_n_disappeared, 0) > 0 THEN 'Lithium inventory loss (LLI): ' || LLI_n_disappeared || ' reference peak(s) disappeared, suggesting capacity-limiting Li plating or SEI growth.' END,
  CASE WHEN coalesce(LAM_loss, 0) > 0.02 THEN 'Active material loss (LAM): ' || printf('%.1f', LAM_loss * 100) || '% reduction in total ICA area — electrode active sites consumed.' END,
  CASE WHEN coalesce(Resistance_growth, 0) > 0.05 THEN 'Resistance growth: ICA peak width increased ' || printf('%.1f', Resistance_growth * 100) || '% (broadening = higher impedance / polarisation).' END,
  CASE WHEN NOT (coalesce(LLI_confidence, 0) > 0.5 AND abs(coalesce(LLI_mean_shift, 0)) > 0.003) AND coalesce(LLI_n_disappeared, 0) = 0 AND coalesce(LAM_loss, 0) <= 0.02 AND coalesce(Resistance_growth, 0) <= 0.05
    THEN 'No significant degradation signature detected at this cycle.' END) AS explanation
FROM (SELECT * REPLACE (round(soh_pred, 7) + 1e-7 AS soh_pred, round(LLI_mean_shift, 7) + 1e-8 AS LLI_mean_shift, round(LAM_loss, 4) + 1e-7 AS LAM_loss, round(Resistance_growth, 4) + 1e-7 AS Resistance_growth) FROM ct)""",
    "predictions physics_known",
)
def explain_text(spark, d):
    off_ties = {c: F.round(c, k) + e for c, k, e in (("soh_pred", 7, 1e-7), ("LLI_mean_shift", 7, 1e-8), ("LAM_loss", 4, 1e-7), ("Resistance_growth", 4, 1e-7))}
    return physics.explained(_cycle_table(spark, d).withColumns(off_ties)).select("cell_id", "cycle_number", "explanation")


@query("SELECT * FROM (SELECT 'q' AS part, cell_id, cycle_index FROM meta WHERE cell_id < 4 UNION ALL SELECT 'r' AS part, cell_id, cycle_index FROM meta WHERE cell_id >= 4)", "meta")
def union_cells(spark, d):
    m = base.meta(spark, d).select("cell_id", "cycle_index")
    part = lambda name, c: m.where(c).select(F.lit(name).alias("part"), "cell_id", "cycle_index")
    return part("q", F.col("cell_id") < 4).unionByName(part("r", F.col("cell_id") >= 4))


@query(
    """+ f AS (SELECT cell_id, arg_min(Resistance_growth, cycle_number) AS v0 FROM physics WHERE Resistance_growth > 0 GROUP BY cell_id)
SELECT cell_id, cycle_number, round(Resistance_growth / v0, 5) AS ratio FROM physics JOIN f USING (cell_id)""",
    "physics",
)
def broadening_ratio(spark, d):
    return physics.normalised_to_first(base.physics(spark, d), "Resistance_growth", "ratio").select("cell_id", "cycle_number", r("ratio", 5))


@query(
    """+ fit AS (SELECT quantile_cont(f3, 0.5) AS m FROM features),
i AS (SELECT cell_id, cycle_number, coalesce(f3, m) AS x FROM features, fit),
c AS (SELECT avg(x) AS a, stddev_pop(x) AS s FROM i),
k AS (SELECT cell_id, cycle_number, greatest(a - 2 * s, least(a + 2 * s, x)) AS x FROM i, c),
q AS (SELECT quantile_cont(x, 0.5) AS m, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS w FROM k)
SELECT cell_id, cycle_number, round((x - m) / w, 5) AS f3 FROM k, q""",
    "features",
)
def prepared_features(spark, d):
    return features.prepared(base.features(spark, d), ["f3"], sigma=2.0).select("cell_id", "cycle_number", r("f3", 5))


@query(
    """+ tiles AS (SELECT cell_id, ntile(3) OVER (ORDER BY cell_id) - 1 AS fold FROM (SELECT DISTINCT cell_id FROM features)),
x AS (SELECT f.cell_id, cycle_number, fold, unnest(['f1', 'f3']) AS name, unnest([f1, f3]) AS v FROM features f JOIN tiles USING (cell_id)),
tr AS (SELECT k.fold AS k, x.* FROM x JOIN (SELECT DISTINCT fold FROM tiles) k ON x.fold <> k.fold),
med AS (SELECT k, name, quantile_cont(v, 0.5) AS m FROM tr GROUP BY ALL),
im AS (SELECT tr.k, tr.name, coalesce(v, m) AS v, CASE WHEN v IS NULL THEN 1.0 ELSE 0.0 END AS gone FROM tr JOIN med USING (k, name)),
twice AS (SELECT k, name, v FROM im UNION ALL SELECT k, name || '_missing', gone FROM im WHERE name = 'f3'),
mo AS (SELECT k, name, avg(v) AS a, stddev_pop(v) AS s FROM twice GROUP BY ALL),
cl AS (SELECT k, name, greatest(a - 2 * s, least(a + 2 * s, v)) AS v FROM twice JOIN mo USING (k, name)),
q AS (SELECT k, name, quantile_cont(v, 0.5) AS c, CASE WHEN quantile_cont(v, 0.75) = quantile_cont(v, 0.25) THEN 1.0 ELSE quantile_cont(v, 0.75) - quantile_cont(v, 0.25) END AS w FROM cl GROUP BY ALL),
t AS (SELECT x.cell_id, cycle_number, fold, x.name, coalesce(v, m) AS v FROM x JOIN med ON med.k = fold AND med.name = x.name
  UNION ALL SELECT cell_id, cycle_number, fold, 'f3_missing', CASE WHEN v IS NULL THEN 1.0 ELSE 0.0 END FROM x WHERE name = 'f3'),
z AS (SELECT t.cell_id, cycle_number, t.fold, t.name, (greatest(a - 2 * s, least(a + 2 * s, v)) - c) / w AS z FROM t JOIN mo ON mo.k = t.fold AND mo.name = t.name JOIN q ON q.k = t.fold AND q.name = t.name)
SELECT cell_id, cycle_number, CAST(fold AS INTEGER) AS fold, round(max(CASE WHEN name = 'f1' THEN z END), 5) + 0.0 AS f1, round(max(CASE WHEN name = 'f3' THEN z END), 5) + 0.0 AS f3,
  round(max(CASE WHEN name = 'f3_missing' THEN z END), 5) + 0.0 AS f3_missing FROM z GROUP BY ALL""",
    "features",
)
def fold_preparation(spark, d):
    """Every row prepared as the other folds' rows say: imputed, clipped and scaled."""
    rows = features.group_folds(base.features(spark, d), 3, shuffle=False)
    done = folds.prepared(rows, ["f1", "f3"], folds.fitted(rows, ["f1", "f3"], "fold", sigma=2.0), "fold")
    return done.select("cell_id", "cycle_number", "fold", *[(F.round(c, 5) + 0.0).alias(c) for c in ("f1", "f3", "f3_missing")])


@query(
    """SELECT cell_id, day, round(sum(w * y), 5) AS area FROM (SELECT cell_id, day, abs(current) AS y,
  CASE WHEN n = 1 THEN 0.0 WHEN nth > odd THEN 0.5 WHEN odd = 1 THEN 0.5 WHEN nth = odd AND n > odd THEN 1.0 / 3.0 + 0.5
    WHEN nth = 1 OR nth = odd THEN 1.0 / 3.0 WHEN nth % 2 = 0 THEN 4.0 / 3.0 ELSE 2.0 / 3.0 END AS w
  FROM (SELECT *, CASE WHEN n % 2 = 1 THEN n ELSE n - 1 END AS odd FROM (SELECT cell_id, current, CAST(floor(time / 86400) AS INTEGER) AS day,
    row_number() OVER (PARTITION BY cell_id, floor(time / 86400) ORDER BY time, row_id) AS nth,
    count(*) OVER (PARTITION BY cell_id, floor(time / 86400)) AS n FROM samples))) GROUP BY cell_id, day""",
    "samples",
)
def simpson_daily(spark, d):
    """Area under all points of each day, taken as evenly spaced: Simpson's weights, a last odd interval by trapezoid."""
    day = Window.partitionBy("cell_id", "day")
    rows = base.samples(spark, d).withColumn("day", F.floor(F.col("time") / 86400).cast("int"))
    rows = rows.withColumns({"nth": F.row_number().over(day.orderBy("time", "row_id")), "n": F.count("*").over(day)})
    nth, n, odd = F.col("nth"), F.col("n"), F.col("n") - (F.col("n") % 2 == 0).cast("int")
    weight = (
        F.when(n == 1, 0.0).when((nth > odd) | (odd == 1), 0.5).when((nth == odd) & (n > odd), 1 / 3 + 0.5)
        .when((nth == 1) | (nth == odd), 1 / 3).when(nth % 2 == 0, 4 / 3).otherwise(2 / 3)
    )
    return rows.groupBy("cell_id", "day").agg(F.round(F.sum(weight * F.abs("current")), 5).alias("area"))


# --- whole curves: numpy kernels on groups, beyond SQL ---------------------------------------------------------------


@query()
def qv_curves(spark, d):
    """Charge-voltage curves of the discharges of whole days."""
    half = base.samples(spark, d).withColumn("cycle_index", F.floor(F.col("time") / 86400).cast("int")).where("current < 0")
    return curves.qv_curves(half, 100.0, Features(c_rate_max=10.0, current_cv_max=10.0, max_nan_fraction=0.5))


_PEAKS_SQL = """+ bins AS (SELECT cell_id, CAST(floor(time / 86400) AS INTEGER) AS c, CAST(floor((voltage - 2.5) / 0.02) AS INTEGER) AS b, sum(abs(current)) AS y FROM samples GROUP BY ALL),
y AS (SELECT k.cell_id, k.c, t.b, coalesce(y, 0.0) AS y FROM (SELECT DISTINCT cell_id, c FROM bins) k JOIN range(85) t(b) ON TRUE LEFT JOIN bins n ON n.cell_id = k.cell_id AND n.c = k.c AND n.b = t.b),
run AS (SELECT cell_id, c, y, min(b) AS b0, max(b) AS b1 FROM (SELECT *, b - row_number() OVER (PARTITION BY cell_id, c, y ORDER BY b) AS g FROM y) GROUP BY cell_id, c, y, g),
top AS (SELECT cell_id, c, y AS top, CAST(floor((b0 + b1) / 2) AS INTEGER) AS p FROM (SELECT *, lag(y) OVER w AS before, lead(y) OVER w AS after FROM run WINDOW w AS (PARTITION BY cell_id, c ORDER BY b0)) WHERE y > before AND y > after),
wall AS (SELECT t.*, coalesce(max(CASE WHEN q.b < p AND q.y > top THEN q.b END), -1) AS l, coalesce(min(CASE WHEN q.b > p AND q.y > top THEN q.b END), 85) AS r FROM top t JOIN y q USING (cell_id, c) GROUP BY ALL),
low AS (SELECT w.*, any_value(top) - greatest(min(CASE WHEN q.b <= p THEN q.y END), min(CASE WHEN q.b >= p THEN q.y END)) AS prom FROM wall w JOIN y q ON q.cell_id = w.cell_id AND q.c = w.c AND q.b > l AND q.b < r GROUP BY ALL),
halfway AS (SELECT w.*, top - prom / 2 AS lev, max(CASE WHEN q.b < p AND q.y <= top - prom / 2 THEN q.b END) AS a, min(CASE WHEN q.b > p AND q.y <= top - prom / 2 THEN q.b END) AS z FROM low w JOIN y q USING (cell_id, c) WHERE prom >= 0.02 GROUP BY ALL),
wide AS (SELECT halfway.*, z - (lev - yz.y) / (yz1.y - yz.y) - a - (lev - ya.y) / (ya1.y - ya.y) AS w FROM halfway JOIN y ya ON ya.cell_id = halfway.cell_id AND ya.c = halfway.c AND ya.b = a JOIN y ya1 ON ya1.cell_id = halfway.cell_id AND ya1.c = halfway.c AND ya1.b = a + 1
  JOIN y yz ON yz.cell_id = halfway.cell_id AND yz.c = halfway.c AND yz.b = z JOIN y yz1 ON yz1.cell_id = halfway.cell_id AND yz1.c = halfway.c AND yz1.b = z - 1)
SELECT cell_id, c AS cycle_number, p AS idx, round(2.5 + p * CAST(0.02 AS DOUBLE), 6) AS voltage, round(top, 6) AS height, round(w * 20, 5) AS width_mv FROM wide WHERE w >= 1"""


def _histograms(spark, d):
    """(cell_id, cycle_number, voltage_grid, dqdv): each day's charge by voltage."""
    day = F.floor(F.col("time") / 86400).cast("int")
    bins = base.samples(spark, d).groupBy("cell_id", day.alias("cycle_number"), F.floor((F.col("voltage") - 2.5) / 0.02).cast("int").alias("b")).agg(F.sum(F.abs("current")).alias("y"))
    lists = bins.groupBy("cell_id", "cycle_number").agg(F.map_from_entries(F.collect_list(F.struct("b", "y"))).alias("m"))
    grid = F.sequence(F.lit(0), F.lit(84))
    return lists.select(
        "cell_id", "cycle_number", F.transform(grid, lambda i: F.lit(2.5) + i * F.lit(0.02)).alias("voltage_grid"),
        F.transform(grid, lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))).alias("dqdv"),
    )


@query(_PEAKS_SQL, "samples")
def ica_peaks(spark, d):
    """Peaks of the daily charge histogram over voltage, by prominence and width."""
    return physics.peak_table(_histograms(spark, d)).select("cell_id", "cycle_number", "idx", r("voltage"), r("height"), r("width_mv", 5))


@query(_PEAKS_SQL.replace("SELECT cell_id, c AS cycle_number", "SELECT CAST(cell_id AS VARCHAR) AS cell_id, c AS cycle_number"), "samples")
def peaks_by_sql(spark, d):
    """The same from SQL, by a table function over partitions of the curves."""
    physics.register_functions(spark)
    found = spark.sql("SELECT * FROM explode_peaks(TABLE({curves}) PARTITION BY cell_id)", curves=_histograms(spark, d))
    return found.select("cell_id", "cycle_number", "idx", r("voltage"), r("height"), r("width_mv", 5))


@query(
    """+ mv AS (SELECT cell_id, CASE WHEN current > 1e-4 THEN 1 ELSE -1 END AS sign, time, voltage, abs(current) AS a FROM samples WHERE abs(current) > 1e-4),
gap AS (SELECT *, CASE WHEN time - lag(time) OVER (PARTITION BY cell_id, sign ORDER BY time) < 7001.5 THEN 0 ELSE 1 END AS opens FROM mv),
isl AS (SELECT *, sum(opens) OVER (PARTITION BY cell_id, sign ORDER BY time ROWS UNBOUNDED PRECEDING) AS island FROM gap)
SELECT cell_id, sign, round(min(time), 3) AS "begin", round(max(time), 3) AS "end", count(*) AS n_points, min(voltage) AS voltage_min, max(voltage) AS voltage_max, round(sum(a), 5) AS ampere_seconds
FROM isl GROUP BY cell_id, sign, island""",
    "samples",
)
def rest_sessions(spark, d):
    """Half-cycles that rests of some two hours part, by session windows."""
    found = summaries.rest_sessions(base.samples(spark, d), 7001.5)
    return found.select("cell_id", "sign", r("begin", 3), r("end", 3), "n_points", "voltage_min", "voltage_max", r("ampere_seconds", 5))


from . import more  # noqa: E402, F401  (registers the rest)
