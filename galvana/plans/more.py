"""Further registered queries: ingest, files, whole curves, physics and model in forms that SQL can check."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions.columns import join_small
from ..operators import curves, cycles, dashboard, features, ingest, model, physics, report
from ..operators.config import FEATURE_COLS, Features, Ica
from ..sources import curves as curve_tables
from ..sources import datasets, readers, sinks
from ..sources.scratch import scratch_path
from . import base, summary, training
from .registry import _CT, _histograms, _PEAKS_SQL, _PHASES, _SIG, _SUMMARY, _TRENDS, _cycle_table, _hourly, _signals, _summary, query, r

#: Added before rounding, so that sums of short decimals, in whatever order, don't lie on a tie.
_OFF_TIE = 3.3e-8


def _day() -> Column:
    return F.floor(F.col("time") / 86400).cast("int")


# --- files -----------------------------------------------------------------------------------------------------------


@query("SELECT 'events' AS cell_id, event_id, event_type, value FROM events")
def read_parquet(spark, d):
    """A Parquet file through the loader that its extension names; the cell is the file's stem."""
    return readers.registry.auto_load(spark, f"{d}/events.parquet").select("cell_id", "event_id", "event_type", "value")


@query("SELECT cell_id AS cell, row_id, round(time, 3) AS time, round(voltage, 6) AS voltage, round(current, 6) AS current FROM samples", "samples")
def csv_round_trip(spark, d):
    """Samples written as CSV, read back with a sniffed delimiter, and made numeric."""
    path = scratch_path(spark, "samples.csv")
    sinks.write_csv(base.samples(spark, d).select(F.col("cell_id").alias("cell"), F.col("row_id").alias("nr"), "time", "voltage", "current"), path)
    named, _ = ingest.standardised(readers.read_raw(spark, path, "all"))
    rows = ingest.numeric(named)
    return rows.select(F.col("cell").cast("long").alias("cell"), F.col("nr").cast("long").alias("row_id"), r("time", 3), r("voltage"), r("current"))


@query("SELECT cell_id, cycle_index, n_points, flags FROM (SELECT cell_id, cycle_index, n_points, CASE WHEN n_points < 20 THEN 1 ELSE 0 END AS flags FROM meta)", "meta")
def json_round_trip(spark, d):
    """Cycle summaries with their flags, as JSON lines and back."""
    path = scratch_path(spark, "meta.json")
    few = F.filter("flags", lambda x: x.startswith("too_few"))
    sinks.write_json(base.meta(spark, d).select("cell_id", "cycle_index", "n_points", few.alias("flags")), path)
    back = spark.read.schema("cell_id long, cycle_index int, n_points long, flags array<string>").json(path)
    return back.withColumn("flags", F.size("flags"))


@query(
    """+ s AS (SELECT cell_id, CAST(floor(time / 86400) AS INTEGER) AS c, time, row_id, voltage, current, step FROM samples),
q AS (SELECT cell_id, c, sum(abs(current)) AS qd FROM s GROUP BY ALL),
h AS (SELECT *, qd / first_value(qd) OVER (PARTITION BY cell_id ORDER BY c) AS soh FROM q)
SELECT CAST(s.cell_id AS VARCHAR) AS cell_id, s.c AS cycle_index, row_number() OVER (PARTITION BY s.cell_id, s.c ORDER BY time, row_id) - 1 AS pos, time * 60 AS time,
  round(voltage, 6) AS voltage, round(current, 6) AS current, CASE WHEN current >= 0 THEN 1.0 ELSE 2.0 END::DOUBLE AS capacity, round(soh, 6) AS soh
FROM s JOIN h ON s.cell_id = h.cell_id AND s.c = h.c""",
    "samples",
)
def nested_batch(spark, d):
    """Days of each cell as nested JSON lines, one cell a line, and back through the batch loader."""
    path = scratch_path(spark, "batch.jsonl")
    rows = base.samples(spark, d).withColumn("c", _day())
    points = F.array_sort(F.collect_list(F.struct("time", "row_id", "voltage", "current")))
    per = rows.groupBy("cell_id", "c").agg(points.alias("p"), F.sum(F.abs("current")).alias("qd"))
    field = lambda name, value: F.struct(F.lit(name).alias("key"), value.cast("array<double>").alias("value"))
    same = lambda x: F.transform("p", lambda _: F.lit(x))
    arrays = F.map_from_entries(F.array(field("t", F.col("p.time")), field("V", F.col("p.voltage")), field("I", F.col("p.current")), field("Qc", same(1.0)), field("Qd", same(2.0))))
    per = per.select("cell_id", "c", "qd", arrays.alias("a"))
    cells = per.groupBy("cell_id").agg(
        F.array_sort(F.collect_list(F.struct("c", "qd"))).alias("s"), F.map_from_entries(F.collect_list(F.struct(F.col("c").cast("string"), "a"))).alias("cycles")
    )
    body = F.struct(F.struct(F.col("s.qd").alias("QDischarge"), F.col("s.c").alias("cycle")).alias("summary"), F.col("cycles"))
    cells.select(F.to_json(F.create_map(F.col("cell_id").cast("string"), body)).alias("value")).write.text(path)
    back = datasets.read_batch(spark, path)
    return back.select("cell_id", "cycle_index", (F.col("row_id") % (1 << 32)).alias("pos"), "time", r("voltage"), r("current"), "capacity", r("soh"))


# --- ingest ----------------------------------------------------------------------------------------------------------


@query(
    """SELECT cell_id, row_id, round(time, 3) AS time, round(voltage, 6) AS voltage, round(current, 6) AS current, round(abs(current) / 1000, 9) AS capacity, step FROM (
  SELECT *, row_number() OVER (PARTITION BY cell_id, time ORDER BY row_id) AS nth FROM samples WHERE step <> 'error') WHERE nth = 1""",
    "samples",
)
def ingest_vendor(spark, d):
    """A vendor's names, units and texts: renamed, parsed, in A and Ah; rows whose current can't be parsed are gone."""
    amps = F.when(F.col("step") == "error", "n/a").otherwise((F.col("current") * 1000).cast("string"))
    raw = base.samples(spark, d).select(
        "cell_id", "row_id", F.col("time").cast("string").alias("Test_Time(s)"), amps.alias("Current/mA"), F.col("voltage").cast("string").alias("Ewe/V"),
        F.abs("current").cast("string").alias("Capacity(mAh)"), F.col("step").alias("Step_Type"), F.lit("0").alias("potential"),
    )
    out = ingest.samples(raw)
    return out.select("cell_id", "row_id", r("time", 3), r("voltage"), r("current"), r("capacity", 9), "step")


@query(
    """SELECT user_id % 8 AS cell_id, event_id AS row_id, (epoch_us(ts) - CASE WHEN user_id % 2 = 0 THEN min(epoch_us(ts)) OVER (PARTITION BY user_id % 8) ELSE 0 END) / 1e6 AS time FROM events"""
)
def ingest_datetime(spark, d):
    """Half of the cells give date-times, the others seconds."""
    stamp = F.date_format(F.timestamp_micros(F.round(F.col("time") * 1e6).cast("long")), "yyyy-MM-dd HH:mm:ss.SSSSSS")
    raw = base.samples(spark, d).withColumn("time", F.when(F.col("cell_id") % 2 == 0, stamp).otherwise(F.col("time").cast("string")))
    return ingest.numeric(raw).select("cell_id", "row_id", "time")


# --- cycles ----------------------------------------------------------------------------------------------------------


@query(
    """SELECT cell_id, row_id, CASE WHEN cell_id < 4 THEN CAST(floor(time / 86400) AS INTEGER) ELSE cycle_index END AS cycle_index,
  CAST(CASE WHEN cell_id >= 4 THEN phase WHEN current > 1e-4 THEN 1 WHEN current < -1e-4 THEN -1 ELSE 0 END AS INTEGER) AS phase FROM cycled""",
    "cycled",
)
def trusted_cycles(spark, d):
    """A cycle number that comes with the data: trusted where it never falls, ignored for cells in which it does."""
    day = F.when(F.col("cell_id") < 4, _day()).otherwise(-_day())
    return cycles.with_cycles(base.samples(spark, d).withColumn("cycle_index", day)).select("cell_id", "row_id", "cycle_index", "phase")


@query(
    """+ cap AS (SELECT cell_id, cycle_index, max(CASE WHEN phase = 1 THEN abs(current) / 100 END) AS c, max(CASE WHEN phase = -1 THEN abs(current) / 100 END) AS d FROM cycled GROUP BY ALL)
SELECT m.cell_id, m.cycle_index, round(CASE WHEN m.cell_id % 2 = 0 THEN coalesce(c, 0.0) ELSE charge_capacity_ah END, 4) AS charge_capacity_ah,
  round(CASE WHEN m.cell_id % 2 = 0 THEN coalesce(d, 0.0) ELSE discharge_capacity_ah END, 4) AS discharge_capacity_ah,
  round(3.3e-8 + CASE WHEN m.cell_id < 6 THEN c_rate_est * 50 / (m.cell_id + 1) END, 6) AS c_rate_est FROM meta m JOIN cap ON m.cell_id = cap.cell_id AND m.cycle_index = cap.cycle_index""",
    "meta",
)
def capacity_measured(spark, d):
    """Half of the cells measure capacity; every cell has its own nominal capacity, and two have none."""
    rows = base.cycled(spark, d).withColumns(
        {"capacity": F.when(F.col("cell_id") % 2 == 0, F.col("current") / 100), "nominal_ah": F.when(F.col("cell_id") < 6, F.col("cell_id") + 1.0)}
    )
    found = cycles.cycle_meta(rows, "nominal_ah").withColumn("c_rate_est", F.round(F.col("c_rate_est") + _OFF_TIE, 6))
    return found.select("cell_id", "cycle_index", r("charge_capacity_ah", 4), r("discharge_capacity_ah", 4), "c_rate_est")


@query(
    """+ k AS (SELECT cell_id, CAST(floor(time / 604800) AS INTEGER) AS cycle_index, row_id,
    CASE step WHEN 'view' THEN 'C1ch' WHEN 'click' THEN 'C1dc' WHEN 'purchase' THEN 'OCVch' WHEN 'error' THEN 'OCVdc' ELSE 'rest' END AS kind FROM samples),
n AS (SELECT *, count(*) OVER (PARTITION BY cell_id, cycle_index, kind) AS n, list_position(['OCVdc', 'C1dc', 'OCVch', 'C1ch'], kind) AS rank FROM k),
b AS (SELECT *, min(rank) OVER (PARTITION BY cell_id, cycle_index) AS best FROM n WHERE n >= 10 AND rank > 0)
SELECT cell_id, cycle_index, row_id, kind FROM b WHERE rank = best""",
    "samples",
)
def half_pref(spark, d):
    kind = F.when(F.col("step") == "view", "C1ch").when(F.col("step") == "click", "C1dc").when(F.col("step") == "purchase", "OCVch").when(F.col("step") == "error", "OCVdc").otherwise("rest")
    rows = base.samples(spark, d).select("cell_id", F.floor(F.col("time") / 604800).cast("int").alias("cycle_index"), "row_id", kind.alias("kind"))
    return datasets.preferred_halves(rows).select("cell_id", "cycle_index", "row_id", "kind")


@query(
    """+ p AS (SELECT cell_id, CAST(floor(time / 86400) AS INTEGER) AS cycle_index, row_id, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY cell_id, floor(time / 86400)) AS n
  FROM samples WINDOW w AS (PARTITION BY cell_id, floor(time / 86400) ORDER BY time, row_id))
SELECT cell_id, cycle_index, row_id FROM p WHERE n <= 20 OR i IN (SELECT round_even(k * ((n - 1) / CAST(19 AS DOUBLE)), 0) FROM range(20) t(k))""",
    "samples",
)
def downsample(spark, d):
    return datasets.downsampled(base.samples(spark, d).withColumn("cycle_index", _day()), 20).select("cell_id", "cycle_index", "row_id")


@query(
    """+ h AS (SELECT cell_id, CAST(floor(time / 86400) AS INTEGER) AS c, row_id, time / 86400 AS t, abs(current) * 10 AS q, voltage FROM samples WHERE current < 0),
s AS (SELECT *, (t - min(t) OVER (PARTITION BY cell_id, c)) * CAST(86400 AS DOUBLE) AS ts, q / 1000 AS cap FROM h),
span AS (SELECT cell_id, c, max(ts) + 1 AS size FROM s GROUP BY ALL),
st AS (SELECT cell_id, c, coalesce(sum(size) OVER (PARTITION BY cell_id ORDER BY c ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS start FROM span),
g AS (SELECT *, coalesce((lead(cap) OVER w - lag(cap) OVER w) / 2, lead(cap) OVER w - cap, cap - lag(cap) OVER w) AS dq,
  coalesce((lead(ts) OVER w - lag(ts) OVER w) / 2, lead(ts) OVER w - ts, ts - lag(ts) OVER w) / 3600 AS hours FROM s WINDOW w AS (PARTITION BY cell_id, c ORDER BY ts, row_id))
SELECT g.cell_id, g.c AS cycle_index, row_id, round(ts + start, 3) AS time, voltage, round(cap, 6) AS capacity, round(CASE WHEN abs(hours) > 1e-12 THEN dq / hours ELSE 0.0 END, 3) + 0.0 AS current FROM g JOIN st USING (cell_id, c)""",
    "samples",
)
def joined_cycles(spark, d):
    """The discharge rows of days as half-cycles of a characterisation, one after another, with the current from charge."""
    rows = base.samples(spark, d).where("current < 0")
    halves = rows.select("cell_id", _day().alias("cycle_index"), "row_id", (F.col("time") / 86400).alias("time"), (F.abs("current") * 10).alias("q"), "voltage")
    found = datasets.joined_cycles(halves)
    return found.select("cell_id", "cycle_index", "row_id", r("time", 3), "voltage", r("capacity"), (F.round("current", 3) + 0.0).alias("current"))


@query(
    """SELECT cell_id, row_id, round(sum(a) OVER (PARTITION BY cell_id, cycle_index ORDER BY time, row_id ROWS UNBOUNDED PRECEDING), 4) AS q_ah FROM (
  SELECT *, coalesce((abs(current) + lag(abs(current)) OVER h) / 2 * (time - lag(time) OVER h) / 3600, 0.0) AS a FROM discharge WINDOW h AS (PARTITION BY cell_id, cycle_index ORDER BY time, row_id))""",
    "discharge",
)
def trapz_abs(spark, d):
    return curves.coulomb_trapezoid(base.discharge(spark, d).withColumn("current", F.abs("current"))).select("cell_id", "row_id", r("q_ah", 4))


# --- whole curves ----------------------------------------------------------------------------------------------------

_QV = Features(c_rate_max=10.0, current_cv_max=0.75, max_nan_fraction=0.5)


@query(
    """+ s AS (SELECT cell_id, CAST(floor(time / 86400) AS INTEGER) AS c, row_number() OVER w AS k, count(*) OVER (PARTITION BY cell_id, floor(time / 86400)) AS n, abs(current) AS a, voltage AS v,
    abs(abs(current) - lag(abs(current)) OVER w) / greatest(time - lag(time) OVER w, 1e-6) AS slope FROM samples WHERE current < 0 WINDOW w AS (PARTITION BY cell_id, floor(time / 86400) ORDER BY time, row_id)),
m AS (SELECT cell_id, c, quantile_cont(slope, 0.5) AS med FROM s GROUP BY ALL),
cv AS (SELECT x.cell_id, x.c, x.k, coalesce(stddev_samp(y.a), 0.0) / greatest(avg(y.a), 1e-12) AS cv FROM s x JOIN s y ON x.cell_id = y.cell_id AND x.c = y.c
  AND y.k BETWEEN x.k - (greatest(5, x.n // 20) - 1 - (greatest(5, x.n // 20) - 1) // 2) AND x.k + (greatest(5, x.n // 20) - 1) // 2 GROUP BY ALL),
g AS (SELECT s.*, a / 100 <= 10 AND (slope IS NULL OR slope <= 5 * greatest(med, 1e-9)) AND cv <= 0.75 AS ok FROM s JOIN m USING (cell_id, c) JOIN cv USING (cell_id, c, k)),
kept AS (SELECT *, coalesce(v <= lag(v) OVER (PARTITION BY cell_id, c ORDER BY k) + 1e-4, TRUE) AND row_number() OVER (PARTITION BY cell_id, c, round_even(v * 1e4, 0) ORDER BY k) = 1 AS keep FROM g WHERE ok),
span AS (SELECT cell_id, c, count(*) AS points, max(v) AS hi, min(v) AS lo FROM kept WHERE keep GROUP BY ALL),
nan AS (SELECT cell_id, c, avg(CASE WHEN 2.5 + i * CAST(0.005 AS DOUBLE) < lo OR 2.5 + i * CAST(0.005 AS DOUBLE) > hi THEN 1.0 ELSE 0.0 END) AS gaps FROM span, range(341) t(i) GROUP BY ALL),
t AS (SELECT cell_id, c, max(n) AS n, avg(ok::INT) AS share, sum(ok::INT) AS n_ok FROM g GROUP BY ALL),
f AS (SELECT t.*, points, hi, lo, gaps, CASE WHEN n < 10 THEN 'too_few_raw_points' WHEN share < 0.2 OR n_ok < 10 THEN 'insufficient_cc_region' WHEN points < 4 THEN 'too_few_monotonic_points'
  WHEN gaps > 0.5 THEN 'too_many_nans' END AS why FROM t LEFT JOIN span USING (cell_id, c) LEFT JOIN nan USING (cell_id, c))
SELECT CAST(cell_id AS VARCHAR) AS cell_id, c AS cycle_index, why IS NULL AS ok, why, CASE WHEN n >= 10 THEN CAST(n_ok AS INTEGER) END AS n_cc_pts, round(CASE WHEN n >= 10 THEN share END, 6) AS cc_fraction,
  round(CASE WHEN why IS NULL OR why = 'too_many_nans' THEN (hi - lo) / 1.7 END, 6) AS v_coverage, round(CASE WHEN why IS NULL OR why = 'too_many_nans' THEN gaps END, 6) AS nan_fraction FROM f""",
    "samples",
)
def qv_status(spark, d):
    """Acceptance, gates of their own width, coverage and gaps of the charge-voltage curves of days."""
    half = base.samples(spark, d).withColumn("cycle_index", _day()).where("current < 0")
    found = curves.qv_curves(half, 100.0, _QV)
    return found.select(
        "cell_id", "cycle_index", "ok", F.split("fail_reason", r"\(")[0].alias("why"), "n_cc_pts", r("cc_fraction"), r("v_coverage"), r("nan_fraction")
    )


@query(
    """+ ramp AS (SELECT cell_id, row_id, time, CAST(floor(time / 86400) AS INTEGER) AS c, 4.15 - 1.2 * (time / 86400 - floor(time / 86400)) AS v, 1 + abs(current) * 0.0001 AS a FROM samples),
near AS (SELECT * FROM (SELECT *, quantile_cont(a, 0.5) OVER (PARTITION BY cell_id, c) AS med FROM ramp) WHERE abs(a - med) <= 0.05 * med),
up AS (SELECT *, count(*) OVER (PARTITION BY cell_id, c) AS n, max(v) OVER (PARTITION BY cell_id, c ORDER BY time DESC, row_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM near),
seg AS (SELECT cell_id, c, max(n) AS n, count(*) AS points, max(v) - min(v) AS span FROM up WHERE top IS NULL OR v > top + 1e-9 GROUP BY ALL)
SELECT CAST(cell_id AS VARCHAR) AS cell_id, c AS cycle_index, 11 AS window_pts, round(span, 6) AS voltage_span_v, -1.0::DOUBLE AS direction,
  CAST(ceil((span + 0.002) / 0.002) AS INTEGER) - 10 AS n_grid FROM seg WHERE n >= 5 AND points >= 8 AND span >= 0.05""",
    "samples",
)
def ica_curves(spark, d):
    """Segment, grid, window and trim of the incremental-capacity curves of falling ramps, a ramp for each day."""
    share = F.col("time") / 86400 - F.floor(F.col("time") / 86400)
    ramp = base.samples(spark, d).withColumns({"cycle_index": _day(), "voltage": 4.15 - 1.2 * share, "current": -(1 + F.abs("current") * 0.0001)})
    found = curves.ica_curves(ramp, Ica())
    return found.select("cell_id", "cycle_index", "window_pts", r("voltage_span_v"), "direction", F.size("voltage_grid").alias("n_grid"))


def _flags_sql() -> str:
    terms = [f"CAST({float(c)!r} AS DOUBLE) * {f'lead(q, {k - 5})' if k >= 5 else f'lag(q, {5 - k})'} OVER w" for k, c in enumerate(kernels.savgol_weights(11, 3, 0, 5))]
    return f"""+ ramp AS (SELECT cell_id, row_id, time, CAST(floor(time / 86400) AS INTEGER) AS c, 4.15 - 1.2 * (time / 86400 - floor(time / 86400)) AS v, 1 + abs(current) * 0.0001 AS a FROM samples),
near AS (SELECT * FROM (SELECT *, quantile_cont(a, 0.5) OVER (PARTITION BY cell_id, c) AS med FROM ramp) WHERE abs(a - med) <= 0.05 * med),
area AS (SELECT *, coalesce((a + lag(a) OVER t) / 2 * (time - lag(time) OVER t) / 3600, 0.0) AS x FROM near WINDOW t AS (PARTITION BY cell_id, c ORDER BY time, row_id)),
sums AS (SELECT *, sum(x) OVER (PARTITION BY cell_id, c) - sum(x) OVER (PARTITION BY cell_id, c ORDER BY time, row_id ROWS UNBOUNDED PRECEDING) AS q, count(*) OVER (PARTITION BY cell_id, c) AS n,
  max(v) OVER (PARTITION BY cell_id, c ORDER BY time DESC, row_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM area),
up AS (SELECT *, lead(v) OVER w AS v1, lead(q) OVER w AS q1 FROM sums WHERE n >= 5 AND (top IS NULL OR v > top + 1e-9) WINDOW w AS (PARTITION BY cell_id, c ORDER BY v)),
ends AS (SELECT cell_id, c, min(v) AS lo, max(v) AS hi FROM up GROUP BY ALL HAVING count(*) >= 8 AND max(v) - min(v) >= 0.05),
grid AS (SELECT cell_id, c, i, lo + i * CAST(0.002 AS DOUBLE) AS g, CAST(ceil((hi + CAST(0.002 AS DOUBLE) - lo) / CAST(0.002 AS DOUBLE)) AS INTEGER) AS n FROM ends, range(700) t(i) WHERE i < ceil((hi + CAST(0.002 AS DOUBLE) - lo) / CAST(0.002 AS DOUBLE))),
raw AS (SELECT grid.*, CASE WHEN v1 IS NULL THEN up.q ELSE up.q + (g - v) / (v1 - v) * (q1 - up.q) END AS q FROM grid ASOF JOIN up ON grid.cell_id = up.cell_id AND grid.c = up.c AND grid.g >= up.v),
sm AS (SELECT cell_id, c, i, n, q, {' + '.join(terms)} AS s FROM raw WINDOW w AS (PARTITION BY cell_id, c ORDER BY i)),
res AS (SELECT cell_id, c, sqrt(avg((s - q) ** 2)) / greatest(abs(arg_max(q, i) - arg_min(q, i)), 1e-9) AS f FROM sm WHERE i >= 5 AND i < n - 5 GROUP BY ALL)
SELECT CAST(cell_id AS VARCHAR) AS cell_id, c AS cycle_index, round(f * 1e6, 2) AS residual_ppm, f > 1.2e-5 AS distorted FROM res"""


@query(_flags_sql(), "samples")
def ica_distortion(spark, d):
    """How far smoothing moves the linearly read charge of falling ramps, and the flag of those that it moves too far."""
    share = F.col("time") / 86400 - F.floor(F.col("time") / 86400)
    ramp = base.samples(spark, d).withColumns({"cycle_index": _day(), "voltage": 4.15 - 1.2 * share, "current": -(1 + F.abs("current") * 0.0001)})
    found = curves.ica_curves(ramp, Ica(interp="linear", max_residual_frac=1.2e-5))
    return found.select("cell_id", "cycle_index", F.round(F.col("residual_frac") * 1e6, 2).alias("residual_ppm"), F.exists("flags", lambda f: f.startswith("smoothing_distortion")).alias("distorted"))


def _series(spark, d) -> DataFrame:
    """(cell_id, x, y): the values of each cell's quarter days, in order, as arrays."""
    points = F.array_sort(F.collect_list(F.when(F.col("y").isNotNull(), F.struct("grid_idx", "y"))))
    return _hourly(spark, d).groupBy("cell_id").agg(points.alias("p")).select("cell_id", F.col("p.grid_idx").cast("array<double>").alias("x"), F.col("p.y").alias("y"))


_SERIES = "+ ser AS (SELECT cell_id, CAST(floor((time - 1704067200.0) / 21600) AS INTEGER) AS x, avg(voltage) AS y FROM samples WHERE step = 'view' GROUP BY ALL)"


@query(
    _SERIES
    + """, h AS (SELECT *, lead(x) OVER w - x AS h, (lead(y) OVER w - y) / (lead(x) OVER w - x) AS d, lead(y) OVER w AS y1, row_number() OVER w AS k, count(*) OVER (PARTITION BY cell_id) AS n FROM ser WINDOW w AS (PARTITION BY cell_id ORDER BY x)),
e AS (SELECT *, lag(h) OVER w AS hp, lag(d) OVER w AS dp, lead(h) OVER w AS hn, lead(d) OVER w AS dn, lag(h, 2) OVER w AS hpp, lag(d, 2) OVER w AS dpp FROM h WINDOW w AS (PARTITION BY cell_id ORDER BY x)),
s AS (SELECT *, ((2 * h + hn) * d - h * dn) / (h + hn) AS first, ((2 * hp + hpp) * dp - hp * dpp) / (hp + hpp) AS last FROM e),
m AS (SELECT *, CASE WHEN k = 1 THEN CASE WHEN sign(first) <> sign(d) THEN 0.0 WHEN sign(d) <> sign(dn) AND abs(first) > 3 * abs(d) THEN 3 * d ELSE first END
  WHEN k = n THEN CASE WHEN sign(last) <> sign(dp) THEN 0.0 WHEN sign(dp) <> sign(dpp) AND abs(last) > 3 * abs(dp) THEN 3 * dp ELSE last END
  WHEN sign(dp) * sign(d) <= 0 THEN 0.0 ELSE (3 * h + 3 * hp) / ((2 * h + hp) / dp + (h + 2 * hp) / d) END AS m FROM s),
p AS (SELECT *, lead(m) OVER (PARTITION BY cell_id ORDER BY x) AS m1 FROM m)
SELECT cell_id, CAST(k - 1 AS INTEGER) AS k, round((y + y1) / 2 + h * (m - m1) / 8, 6) AS y FROM p WHERE h IS NOT NULL""",
    "samples",
)
def pchip(spark, d):
    """The monotone cubic through each cell's quarter days, half-way between its knots."""
    knots = _hourly(spark, d).where("y IS NOT NULL").withColumn("x", F.col("grid_idx").cast("double"))
    seg = curves.pchip_segments(knots, "x", "y", ("cell_id",))
    k = F.row_number().over(Window.partitionBy("cell_id").orderBy("x0")) - 1
    return seg.select("cell_id", k.alias("k"), F.round(curves.hermite((F.col("x0") + F.col("x1")) / 2), 6).alias("y"))


def _edge_sql() -> str:
    """Weights of a window of 21 for its 21 places, generated, and applied by position."""
    rows = []
    for at in range(21):
        w, s = kernels.savgol_weights(21, 3, 0, at), kernels.savgol_weights(21, 3, 1, at)
        rows += [f"({at}, {j}, {float(w[j])!r}, {float(s[j])!r})" for j in range(21)]
    return (
        _SERIES + f""", w AS (SELECT * FROM (VALUES {', '.join(rows)}) t(pos, j, w, s)),
a AS (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY x) - 1 AS k, count(*) OVER (PARTITION BY cell_id) AS n FROM ser),
f AS (SELECT a.cell_id, a.k, sum(CAST(w.w AS DOUBLE) * b.y) AS smooth, sum(CAST(w.s AS DOUBLE) * b.y) AS slope FROM a JOIN w ON w.pos = a.k - greatest(0, least(a.k - 10, a.n - 21))
  JOIN a b ON b.cell_id = a.cell_id AND b.k = greatest(0, least(a.k - 10, a.n - 21)) + w.j WHERE a.n >= 21 GROUP BY ALL)
SELECT cell_id, CAST(k AS INTEGER) AS k, round(smooth, 6) AS smooth, round(slope, 6) AS slope,
  round(coalesce((lead(smooth) OVER o - lag(smooth) OVER o) / 2, lead(smooth) OVER o - smooth, smooth - lag(smooth) OVER o), 6) AS gradient FROM f WINDOW o AS (PARTITION BY cell_id ORDER BY k)"""
    )


@query(_edge_sql(), "samples")
def sg_edges(spark, d):
    """Savitzky-Golay value and derivative with polynomial edges, and the gradient of the smoothed values."""
    rows = _series(spark, d).where(F.size("y") >= 21)
    rows = rows.select("cell_id", curves.savgol_arrays("y", 21, 3).alias("smooth"), curves.savgol_arrays("y", 21, 3, 1).alias("slope"))
    rows = rows.withColumn("gradient", curves.gradient_array(F.col("smooth")))
    rows = rows.select("cell_id", F.posexplode(F.arrays_zip("smooth", "slope", "gradient")).alias("k", "p"))
    return rows.select("cell_id", "k", r("p.smooth").alias("smooth"), r("p.slope").alias("slope"), r("p.gradient").alias("gradient"))


@query(
    """+ p AS (SELECT cell_id, CAST(floor(time / 86400) AS INTEGER) AS day, abs(current) AS y, row_number() OVER w - 1 AS k, count(*) OVER (PARTITION BY cell_id, floor(time / 86400)) AS n
  FROM samples WINDOW w AS (PARTITION BY cell_id, floor(time / 86400) ORDER BY time, row_id)),
w AS (SELECT *, CASE WHEN n % 2 = 1 THEN n ELSE n - 1 END AS odd FROM p)
SELECT cell_id, day, round(sum(y * (CASE WHEN n = 1 THEN 0.0 WHEN n = 2 THEN 0.5 ELSE
    (CASE WHEN k >= odd THEN 0.0 WHEN k = 0 OR k = odd - 1 THEN 1.0 WHEN k % 2 = 1 THEN 4.0 ELSE 2.0 END) / 3.0
    + (CASE WHEN n % 2 = 1 THEN 0.0 WHEN k = n - 1 THEN 5.0 WHEN k = n - 2 THEN 8.0 WHEN k = n - 3 THEN -1.0 ELSE 0.0 END) / 12.0 END)), 4) AS area FROM w GROUP BY ALL""",
    "samples",
)
def simpson_uniform(spark, d):
    """Area under all samples of each day, taken as evenly spaced, by the kernel that the loss of active material uses."""

    @F.pandas_udf("double")
    def area(y: pd.Series) -> pd.Series:
        return pd.Series([kernels.simpson(v, np.arange(len(v), dtype=float)) for v in y])

    points = F.array_sort(F.collect_list(F.struct("time", "row_id", F.abs("current").alias("y"))))
    days = base.samples(spark, d).groupBy("cell_id", _day().alias("day")).agg(points.alias("p"))
    return days.select("cell_id", "day", F.round(area("p.y"), 4).alias("area"))


# --- difference curves held as arrays --------------------------------------------------------------------------------

_GRID = 17
_DAILY_SQL = "+ daily AS (SELECT cell_id, CAST(floor(time / 86400) AS INTEGER) AS c, CAST(floor((voltage - 2.5) * 10) AS INTEGER) AS g, sum(abs(current)) / 1000 AS q FROM samples GROUP BY ALL), days AS (SELECT cell_id, c, count(*) AS n FROM daily GROUP BY ALL)"


def _daily(spark, d) -> DataFrame:
    """(cell_id, cycle_index, q_smooth, ok): charge by voltage bin of each day, as arrays; days with few bins aren't ok."""
    bins = base.samples(spark, d).groupBy("cell_id", _day().alias("cycle_index"), F.floor((F.col("voltage") - 2.5) * 10).cast("int").alias("g")).agg((F.sum(F.abs("current")) / 1000).alias("q"))
    days = bins.groupBy("cell_id", "cycle_index").agg(F.map_from_entries(F.collect_list(F.struct("g", "q"))).alias("m"))
    grid = F.transform(F.sequence(F.lit(0), F.lit(_GRID - 1)), lambda g: F.try_element_at("m", g))
    return days.select("cell_id", "cycle_index", grid.alias("q_smooth"), (F.size("m") >= 12).alias("ok"))


_FEATURES_SQL = """, refs AS (SELECT cell_id, min(c) AS rc FROM days WHERE n >= 12 GROUP BY ALL),
delta AS (SELECT x.cell_id, x.c, x.g, x.q - y.q AS dq FROM daily x JOIN days USING (cell_id, c) JOIN refs USING (cell_id) JOIN daily y ON y.cell_id = x.cell_id AND y.c = rc AND y.g = x.g WHERE n >= 12),
cl AS (SELECT * REPLACE (CASE WHEN sd > 0 THEN greatest(m - 1.5 * sd, least(dq, m + 1.5 * sd)) ELSE dq END AS dq) FROM (SELECT *, avg(dq) OVER w AS m, stddev_pop(dq) OVER w AS sd FROM delta WINDOW w AS (PARTITION BY cell_id, c))),
mo AS (SELECT cell_id, c, count(*) AS k, avg(dq) AS m, var_pop(dq) AS v, sum(abs(dq)) AS s, min(dq) AS lo, max(dq) AS hi, max(abs(dq)) AS dev, sqrt(avg(dq * dq)) AS rms, arg_min(dq, g) AS a, arg_max(dq, g) AS b,
  sum(greatest(dq, 0.0)) AS pos, sum(least(dq, 0.0)) AS neg FROM cl GROUP BY ALL),
c4 AS (SELECT cell_id, c, avg((dq - mo.m) ** 3) AS m3, avg((dq - mo.m) ** 4) AS m4 FROM cl JOIN mo USING (cell_id, c) GROUP BY ALL)"""


@query(
    _DAILY_SQL + _FEATURES_SQL
    + f""" SELECT d.cell_id, d.c AS cycle_number, rc AS ref_cycle_index, '{Features(dv=0.1, outlier_sigma=1.5, chemistry="nmc").hash()}' AS config_hash, coalesce(k >= 10, FALSE) AS extraction_ok,
  round({_OFF_TIE} + CASE WHEN k >= 10 THEN v END, 6) AS dqv_variance, round({_OFF_TIE} + CASE WHEN k >= 10 THEN ln(v + 1e-30) END, 5) AS dqv_log_variance, round({_OFF_TIE} + CASE WHEN k >= 10 AND v > 0 THEN m3 / v ** 1.5 END, 5) AS dqv_skewness,
  round({_OFF_TIE} + CASE WHEN k >= 10 AND v > 0 THEN m4 / (v * v) - 3 END, 5) AS dqv_kurtosis, round({_OFF_TIE} + CASE WHEN k >= 10 THEN (s - (abs(a) + abs(b)) / 2) * 0.1 END, 5) AS dqv_integral_abs,
  round({_OFF_TIE} + CASE WHEN k >= 10 THEN dev END, 6) AS dqv_max_deviation, round({_OFF_TIE} + CASE WHEN k >= 10 THEN lo END, 6) AS dqv_min, round({_OFF_TIE} + CASE WHEN k >= 10 THEN hi END, 6) AS dqv_max, round({_OFF_TIE} + CASE WHEN k >= 10 THEN mo.m END, 6) AS dqv_mean,
  round({_OFF_TIE} + CASE WHEN k >= 10 THEN rms END, 6) AS dqv_rms, round({_OFF_TIE} + CASE WHEN k >= 10 THEN hi - lo END, 6) AS dqv_range,
  round({_OFF_TIE} + CASE WHEN k >= 10 THEN (pos - (greatest(a, 0.0) + greatest(b, 0.0)) / 2) * 0.1 END, 5) AS dqv_positive_integral,
  round({_OFF_TIE} + CASE WHEN k >= 10 THEN (neg - (least(a, 0.0) + least(b, 0.0)) / 2) * 0.1 END, 5) AS dqv_negative_integral
FROM days d LEFT JOIN refs USING (cell_id) LEFT JOIN mo USING (cell_id, c) LEFT JOIN c4 USING (cell_id, c)""",
    "samples",
)
def feature_matrix(spark, d):
    """All features, a chemistry's own included, of each day's difference curve, from arrays."""
    made = features.feature_matrix(_daily(spark, d), Features(dv=0.1, outlier_sigma=1.5, chemistry="nmc"))
    digits = {c: 5 for c in ("dqv_log_variance", "dqv_skewness", "dqv_kurtosis", "dqv_integral_abs", "dqv_positive_integral", "dqv_negative_integral")}
    return made.select("cell_id", "cycle_number", "ref_cycle_index", "config_hash", "extraction_ok", *[F.round(F.col(c) + _OFF_TIE, digits.get(c, 6)).alias(c) for c in made.columns if c.startswith("dqv_")])


@query(
    _DAILY_SQL + _FEATURES_SQL
    + """, told AS (SELECT CAST(d.cell_id AS VARCHAR) AS cell_id, d.c AS cycle_number, CASE WHEN n >= 12 THEN round(0.9 + 3.3e-8
    + CASE WHEN coalesce(k, 0) >= 10 THEN mo.m * CAST(0.02 AS DOUBLE) + lo * CAST(0.01 AS DOUBLE) - hi * CAST(0.015 AS DOUBLE) ELSE 0.0 END, 6) END AS soh_pred,
  CASE WHEN n < 12 THEN 'Extraction failed: too few bins' END AS failed FROM days d LEFT JOIN refs USING (cell_id) LEFT JOIN mo USING (cell_id, c))
SELECT * FROM told""",
    "samples",
)
def assessment(spark, d):
    """Each day's curve as a new one of its cell: health by a fixed model against the first usable day, or why there is none."""
    days = _daily(spark, d).withColumns({"dqdv": F.col("q_smooth"), "fail_reason": F.lit("too few bins")})
    weights = {"dqv_mean": 0.02, "dqv_min": 0.01, "dqv_max": -0.015}
    zero = [0.0] * len(FEATURE_COLS)
    fitted = {"mean": zero, "scale": [1.0] * len(zero), "coef": [weights.get(c, 0.0) for c in FEATURE_COLS], "intercept": 0.9}
    told = training.Predictor(fitted, Features(dv=0.1, outlier_sigma=1.5)).with_reference(days).trajectory(days)
    failed = F.when(F.col("explanation").startswith(training.FAILED), F.col("explanation"))
    return told.select("cell_id", "cycle_number", F.round(F.col("soh_pred") + _OFF_TIE, 6).alias("soh_pred"), failed.alias("failed"))


@query(
    _DAILY_SQL
    + """, refs AS (SELECT cell_id, min(c) AS rc FROM days WHERE n >= 12 GROUP BY ALL)
SELECT x.cell_id, x.c AS cycle_index, CASE WHEN x.cell_id % 2 = 0 THEN -1 ELSE rc END AS ref_cycle_index, x.g AS k, round(x.q - CASE WHEN x.cell_id % 2 = 0 THEN 1 + x.g * 0.1 ELSE y.q END, 6) AS dq
FROM daily x JOIN days USING (cell_id, c) JOIN refs USING (cell_id) LEFT JOIN daily y ON y.cell_id = x.cell_id AND y.c = rc AND y.g = x.g WHERE n >= 12 AND (x.cell_id % 2 = 0 OR y.q IS NOT NULL)""",
    "samples",
)
def supplied_reference(spark, d):
    """Difference curves of which half of the cells take a reference from elsewhere."""
    daily = _daily(spark, d)
    cells = daily.where(F.col("cell_id") % 2 == 0).select("cell_id").distinct()
    given = cells.select("cell_id", F.explode(F.sequence(F.lit(0), F.lit(_GRID - 1))).alias("grid_idx")).withColumn("q_ref", 1 + F.col("grid_idx") * 0.1)
    found = features.delta_arrays(daily, supplied=given)
    return found.select("cell_id", "cycle_index", "ref_cycle_index", F.posexplode("dq").alias("k", "dq")).where("dq IS NOT NULL").withColumn("dq", F.round("dq", 6))


@query(
    _DAILY_SQL + " SELECT cell_id, c AS cycle_index, g AS k, round((q - min(q) OVER w) / (max(q) OVER w - min(q) OVER w + 1e-8), 6) AS y FROM daily WINDOW w AS (PARTITION BY cell_id, c)", "samples"
)
def min_max(spark, d):
    scaled = _daily(spark, d).select("cell_id", "cycle_index", F.posexplode(physics.min_max("q_smooth")).alias("k", "y"))
    return scaled.where("y IS NOT NULL").withColumn("y", F.round("y", 6))


@query("SELECT cell_id, cycle_index AS cycle_number FROM (SELECT *, n_points >= 8 AND cell_id < 4 AS ok, bool_or(n_points >= 8 AND cell_id < 4) OVER (PARTITION BY cell_id) AS any_ok FROM meta) WHERE ok OR NOT any_ok", "meta")
def usable_rows(spark, d):
    """Rows with features, or all rows of a cell that has none."""
    marked = base.meta(spark, d).select("cell_id", F.col("cycle_index").alias("cycle_number"), ((F.col("n_points") >= 8) & (F.col("cell_id") < 4)).alias("extraction_ok"))
    return features.usable(marked).select("cell_id", "cycle_number")


# --- physics ---------------------------------------------------------------------------------------------------------


def _tents(width: Column, shift: Column) -> Column:
    """Two triangular peaks of height 1 on the grid of 341 points of 5 mV: half widths and shifts in grid steps."""
    tent = lambda i, at: F.greatest(F.lit(0.0), 1 - F.abs(i - (F.lit(at) + shift)) / width)
    return F.transform(F.sequence(F.lit(0), F.lit(340)), lambda i: tent(i, 100) + tent(i, 220))


@query(
    """+ p AS (SELECT cell_id, cycle_index, 1 - n_points % 20 * 0.002 AS h, 20 + 2 * (n_points % 4) AS w, 2 * (cycle_index % 2) AS s FROM meta),
g AS (SELECT i, CASE WHEN i = 0 OR i = 340 THEN 1.0 WHEN i % 2 = 1 THEN 4.0 ELSE 2.0 END * 0.005 / 3 AS w FROM range(341) t(i)),
ref AS (SELECT sum(g.w * (greatest(0.0, 1 - abs(i - 100) / 20.0) + greatest(0.0, 1 - abs(i - 220) / 20.0))) AS area FROM g),
shape AS (SELECT DISTINCT w, s FROM p),
area AS (SELECT shape.w, s, sum(g.w * (greatest(0.0, 1 - abs(i - 100 - s) / CAST(shape.w AS DOUBLE)) + greatest(0.0, 1 - abs(i - 220 - s) / CAST(shape.w AS DOUBLE)))) AS area FROM shape, g GROUP BY ALL)
SELECT CAST(cell_id AS VARCHAR) AS cell_id, cycle_index AS cycle_number, round(s * CAST(0.005 AS DOUBLE), 6) AS LLI_mean_shift, 2 AS LLI_n_matched, 0 AS LLI_n_disappeared, 0 AS LLI_n_appeared, 1.0::DOUBLE AS LLI_confidence,
  round(1 - h * area.area / ref.area, 5) AS LAM_loss, round((p.w - 20) / CAST(20 AS DOUBLE), 5) AS Resistance_growth, round(p.w * CAST(5 AS DOUBLE), 4) AS mean_curr_width_mV, CAST(5 AS DOUBLE) AS grid_spacing_mV
FROM p JOIN area USING (w, s), ref""",
    "meta",
)
def physics_table(spark, d):
    """Peaks, matches, areas and widths of made curves whose metrics are known, against a marked reference."""
    meta = base.meta(spark, d)
    made = meta.select("cell_id", F.col("cycle_index").alias("cycle_number"), F.lit(False).alias("is_reference"), (1 - F.col("n_points") % 20 * 0.002).alias("h"), (20.0 + 2 * (F.col("n_points") % 4)).alias("w"), (2 * (F.col("cycle_index") % 2)).alias("s"))
    refs = meta.select("cell_id").distinct().select("cell_id", F.lit(-1).alias("cycle_number"), F.lit(True).alias("is_reference"), F.lit(1.0).alias("h"), F.lit(20.0).alias("w"), F.lit(0).alias("s"))
    grid = F.transform(F.sequence(F.lit(0), F.lit(340)), lambda i: F.lit(2.5) + i * F.lit(0.005))
    every = made.unionByName(refs)
    shapes = every.select("w", "s").distinct().withColumns({"tents": _tents(F.col("w"), F.col("s")), "voltage_grid": grid})  # few
    scaled = F.transform("tents", lambda x: x * F.col("h"))
    table = join_small(every, shapes, ["w", "s"]).select("cell_id", "cycle_number", "is_reference", "voltage_grid", scaled.alias("dqdv"))
    found = physics.physics_table(table).where("cycle_number >= 0")
    return found.select(
        "cell_id", "cycle_number", r("LLI_mean_shift"), "LLI_n_matched", "LLI_n_disappeared", "LLI_n_appeared", "LLI_confidence", r("LAM_loss", 5), r("Resistance_growth", 5),
        r("mean_curr_width_mV", 4), r("grid_spacing_mV", 4),
    )


@query(
    """+ p AS (SELECT cell_id, cycle_index, n_points, unnest([1, 2, 3]) AS k FROM meta),
m AS (SELECT *, ((n_points * k) % 13 - 6) * CAST(0.005 AS DOUBLE) AS shift FROM p)
SELECT cell_id, cycle_index, CAST(sum((abs(shift) < 0.0201)::INT) AS INTEGER) AS n_matched, CAST(sum((abs(shift) >= 0.0201)::INT) AS INTEGER) AS n_disappeared, CAST(1 + sum((abs(shift) >= 0.0201)::INT) AS INTEGER) AS n_appeared,
  round(coalesce(avg(CASE WHEN abs(shift) < 0.0201 THEN shift END), 0.0), 6) AS mean_shift, round(sum((abs(shift) < 0.0201)::INT) / 3.0, 6) AS confidence, round(sum((abs(shift) >= 0.0201)::INT) / 3.0, 6) AS penalty FROM m GROUP BY ALL""",
    "meta",
)
def lli_match(spark, d):
    """Three well separated peaks, each moved by up to 30 mV, and one new peak: assignment, tolerance and summary."""
    moved = [(F.col("n_points") * k % 13 - 6) * F.lit(0.005) + F.lit(3.0 + 0.2 * k) for k in (1, 2, 3)]
    rows = base.meta(spark, d).select("cell_id", "cycle_index", F.array(*[F.lit(3.0 + 0.2 * k) for k in (1, 2, 3)]).alias("ref_peaks"), F.array(*moved, F.lit(4.1)).alias("peaks"))
    s = physics.lli_summary(F.col("matches"), F.size("ref_peaks"))
    return physics.peak_matches(rows, tolerance=0.0201).select(
        "cell_id", "cycle_index", s["LLI_n_matched"].alias("n_matched"), s["LLI_n_disappeared"].alias("n_disappeared"), s["LLI_n_appeared"].alias("n_appeared"),
        F.round(s["LLI_mean_shift"], 6).alias("mean_shift"), F.round(s["LLI_confidence"], 6).alias("confidence"), F.round(s["LLI_disappearance_penalty"], 6).alias("penalty"),
    )


@query(
    """+ w AS (SELECT cell_id, cycle_index, n_points, unnest(range(1, CAST(1 + n_points % 4 AS BIGINT))) AS k FROM meta)
SELECT m.cell_id, m.cycle_index, round(coalesce(avg((10.0 + m.n_points % 7 + k - (10.0 + k)) / (10.0 + k + 1e-8)), 0.0), 6) AS growth FROM meta m LEFT JOIN w USING (cell_id, cycle_index) GROUP BY ALL""",
    "meta",
)
def width_growth(spark, d):
    """Growth of peak widths paired by position: three widths of the reference against up to three."""
    n = F.col("n_points")
    now = F.transform(F.slice(F.array(F.lit(1), F.lit(2), F.lit(3)), 1, (n % 4).cast("int")), lambda k: F.lit(10.0) + n % 7 + k)
    rows = base.meta(spark, d).select("cell_id", "cycle_index", F.array(F.lit(11.0), F.lit(12.0), F.lit(13.0)).alias("was"), now.alias("now"))
    return rows.select("cell_id", "cycle_index", F.round(physics.width_growth("was", "now"), 6).alias("growth"))


# --- model -----------------------------------------------------------------------------------------------------------

_ONE = "sign({xy}) * greatest(abs({xy}) - 0.0005 * {n}, 0.0) / ({n} + 0.0005 * {n})"


@query(
    """+ x AS (SELECT cell_id, cycle_number, soh AS y, f1 AS x FROM features),
t AS (SELECT count(*) AS n, sum(x) AS sx, sum(x * x) AS sxx, sum(y) AS sy, sum(x * y) AS sxy FROM x),
c AS (SELECT cell_id, count(*) AS n, sum(x) AS sx, sum(x * x) AS sxx, sum(y) AS sy, sum(x * y) AS sxy FROM x GROUP BY ALL),
f AS (SELECT cell_id, t.n - c.n AS n, t.sx - c.sx AS sx, t.sxx - c.sxx AS sxx, t.sy - c.sy AS sy, t.sxy - c.sxy AS sxy FROM c, t),
s AS (SELECT *, sx / n AS m, sqrt((sxx - sx * sx / n) / n) AS sd FROM f), z AS (SELECT *, (sxy - m * sy) / sd AS xy FROM s)
SELECT CAST(x.cell_id AS VARCHAR) AS cell_id, cycle_number, round(y, 6) AS y_true, round(sy / n + (x - m) / sd * """
    + _ONE.format(xy="xy", n="n")
    + ", 6) AS y_pred FROM x JOIN z ON x.cell_id = z.cell_id",
    "features",
)
def loco_one_feature(spark, d):
    """Leave-one-cell-out elastic net of one feature, for which the minimum has a closed form."""
    return model.loco_predictions(base.features(spark, d), names=("f1",)).select("cell_id", "cycle_number", r("y_true"), r("y_pred"))


@query(
    "+ x AS (SELECT soh AS y, unnest([{'f': 'f1', 'x': f1}, {'f': 'f2', 'x': f2}, {'f': 'f3', 'x': coalesce(f3, 0.0)}]) AS p FROM features), "
    "z AS (SELECT p.f AS feature, count(*) AS n, (sum(p.x * y) - avg(p.x) * sum(y)) / stddev_pop(p.x) AS xy FROM x GROUP BY ALL), "
    f"w AS (SELECT feature, {_ONE.format(xy='xy', n='n')} AS w FROM z) "
    "SELECT feature, round(w, 6) AS coefficient, round(abs(w), 6) AS abs_coefficient, CAST(row_number() OVER (ORDER BY abs(w) DESC, feature) AS INTEGER) AS rank FROM w QUALIFY rank <= 2",
    "features",
)
def top_importance(spark, d):
    """The two features of largest weight, each fitted by itself."""
    names = ("f1", "f2", "f3")
    sums = model.totals(model.gram_stats(base.features(spark, d), names))
    coef = [model.full_model(model.of_features(sums, [i]))["coef"][0] for i in range(len(names))]
    return model.top_importance(model.importance(spark, {"coef": coef}, names), 2).select("feature", r("coefficient"), r("abs_coefficient"), "rank")


@query("SELECT cell_id, cycle_number, CAST(ntile AS INTEGER) AS fold FROM features JOIN (SELECT cell_id, ntile(3) OVER (ORDER BY cell_id) - 1 AS ntile FROM (SELECT DISTINCT cell_id FROM features)) USING (cell_id)", "features")
def group_folds(spark, d):
    return features.group_folds(base.features(spark, d), 3, shuffle=False).select("cell_id", "cycle_number", "fold")


# --- report, run and dashboard ---------------------------------------------------------------------------------------


@query(
    _CT + " SELECT ct.cell_id, ct.cycle_number, round(soh_pred, 6) AS soh_pred, LAM_loss, round(f1, 6) AS f1, round(f3, 6) AS f3 FROM ct LEFT JOIN features f ON f.cell_id = ct.cell_id AND f.cycle_number = ct.cycle_number",
    "predictions physics_known features",
)
def report_with_features(spark, d):
    table = report.cycle_table(base.predictions(spark, d), base.physics_known(spark, d), base.features(spark, d))
    return table.select("cell_id", "cycle_number", r("soh_pred"), "LAM_loss", r("f1"), r("f3"))


@query("SELECT cell_id, n_points AS cycle_number, count(*) AS count FROM meta GROUP BY ALL HAVING count(*) > 1", "meta")
def repeated_keys(spark, d):
    return report.repeated_keys(base.meta(spark, d).select("cell_id", F.col("n_points").alias("cycle_number")))


@query(
    _CT + _TRENDS + _SUMMARY
    + """ SELECT r.cell_id, round(max(CASE WHEN signal = 'LLI_mean_shift' THEN slope END), 8) AS lli_slope, round(max(CASE WHEN signal = 'LAM_loss' THEN r2 END), 5) AS lam_r2,
  round(max(CASE WHEN signal = 'Resistance_growth' THEN abs(slope) / 1e-3 END), 5) AS res_rate,
  max(CASE WHEN greatest(a, b, c) < 0.1 THEN 'indeterminate' WHEN a = greatest(a, b, c) THEN 'LLI' WHEN b = greatest(a, b, c) THEN 'LAM' ELSE 'resistance_growth' END) AS dominant FROM trends t JOIN rates r ON t.cell_id = r.cell_id GROUP BY ALL""",
    "predictions physics_known",
)
def evidence_json(spark, d):
    """The evidence of each cell, read back out of its JSON."""
    told = report.evidence(_summary(spark, d))
    number = lambda path, k: F.round(F.get_json_object("evidence", path).cast("double"), k)
    return told.select(
        "cell_id", number("$.LLI.slope", 8).alias("lli_slope"), number("$.LAM.r2", 5).alias("lam_r2"), number("$.resistance_growth.normalised_rate", 5).alias("res_rate"),
        F.get_json_object("evidence", "$.dominant_mechanism").alias("dominant"),
    )


@query(_SIG + _PHASES.replace("opened", "opened2").replace("sized", "sized2") + """, named AS (SELECT cell_id, phase, arg_min(dominant, cycle_number) AS mech FROM ph GROUP BY cell_id, phase)
SELECT cell_id, coalesce(arg_max(mech, CASE WHEN mech <> 'EARLY' THEN phase END), 'LLI') AS dominant FROM named GROUP BY cell_id""", "physics")  # fmt: skip
def cell_dominant(spark, d):
    return dashboard.cell_dominant(dashboard.phase_segments(_signals(spark, d).withColumn("soh", F.lit(1.0))))


_RUN = "+ cells AS (SELECT unnest(range(10)) AS cell_id), n AS (SELECT cell_id, count(*) AS n, sum(ica_suitable::INT) AS s, sum((n_points < 20 OR fast_charge)::INT) AS f, sum((n_points >= 12)::INT) AS ok FROM meta GROUP BY ALL)"


def _run_counts(spark, d) -> DataFrame:
    meta = base.meta(spark, d)
    made = meta.select("cell_id", (F.col("n_points") >= 12).alias("extraction_ok"))
    return summary.cell_counts(spark.range(10).select(F.col("id").alias("cell_id")), meta, features=made)


def _run_status(spark, d) -> DataFrame:
    failures = base.meta(spark, d).where("n_points >= 30").select("cell_id", F.lit("broken file").alias("error"))
    return summary.stage_status(_run_counts(spark, d), failures)


@query(_RUN + " SELECT cell_id, coalesce(n, 0) AS n_cycles_parsed, CAST(coalesce(s, 0) AS BIGINT) AS n_suitable, CAST(coalesce(f, 0) AS BIGINT) AS n_flagged, CAST(coalesce(ok, 0) AS BIGINT) AS n_features_ok, CAST(coalesce(f, 0) AS INTEGER) AS n_listed FROM cells LEFT JOIN n USING (cell_id)", "meta")
def cell_counts(spark, d):
    counts = _run_counts(spark, d)
    return counts.select("cell_id", "n_cycles_parsed", "n_suitable", "n_flagged", "n_features_ok", F.coalesce(F.size("flagged_cycles"), F.lit(0)).alias("n_listed"))


_STATUS = """, bad AS (SELECT DISTINCT cell_id FROM meta WHERE n_points >= 30),
st AS (SELECT c.cell_id, CASE WHEN b.cell_id IS NOT NULL THEN 'broken file' WHEN coalesce(n, 0) = 0 THEN 'no usable rows' END AS unread, CASE WHEN coalesce(ok, 0) = 0 THEN 'no usable half-cycle' END AS empty
  FROM cells c LEFT JOIN n ON n.cell_id = c.cell_id LEFT JOIN bad b ON b.cell_id = c.cell_id),
status AS (SELECT cell_id, 'parse' AS stage, CASE WHEN unread IS NULL THEN 'ok' ELSE 'failed' END AS status, unread AS error FROM st
  UNION ALL SELECT cell_id, 'ica', CASE WHEN unread IS NULL THEN 'ok' ELSE 'skipped' END, NULL FROM st
  UNION ALL SELECT cell_id, 'features', CASE WHEN unread IS NOT NULL THEN 'skipped' WHEN empty IS NULL THEN 'ok' ELSE 'failed' END, CASE WHEN unread IS NULL THEN empty END FROM st)"""


@query(_RUN + _STATUS + " SELECT cell_id, stage, status, error FROM status", "meta")
def stage_status(spark, d):
    """Ten cells of which two have no rows, and some a broken file."""
    return _run_status(spark, d).select("cell_id", "stage", "status", "error")


@query(_RUN + _STATUS + """, per AS (SELECT cell_id, bool_or(status = 'failed') AS f FROM status GROUP BY ALL)
SELECT count(*) AS n_cells, CAST(sum(f::INT) AS BIGINT) AS n_failed, CASE WHEN sum(f::INT) = 0 THEN 'ok' WHEN sum(f::INT) = count(*) THEN 'failed' ELSE 'partial' END AS overall_status FROM per""", "meta")  # fmt: skip
def status_rollup(spark, d):
    return summary.overall(_run_status(spark, d))


_VIEW_SQL = _SIG.replace("FROM physics)", "FROM physics_known)") + _PHASES.replace("opened", "opened2").replace("sized", "sized2") + """, jp AS (SELECT d.cell_id, d.cycle_number, y_true, y_pred FROM dom d JOIN predictions p ON p.cell_id = d.cell_id AND p.cycle_number = d.cycle_number),
eol AS (SELECT cell_id, arg_min(CAST(trunc(c0 + (0.8 - p0) / (y_pred - p0 + 1e-9) * (cycle_number - c0)) AS INTEGER), cycle_number) AS rul FROM (SELECT *, lag(y_pred) OVER w AS p0, lag(cycle_number) OVER w AS c0 FROM jp WINDOW w AS (PARTITION BY cell_id ORDER BY cycle_number)) WHERE p0 IS NOT NULL AND y_pred <= 0.8 GROUP BY cell_id)"""


@query(
    _VIEW_SQL
    + """ SELECT d.cell_id, count(*) AS n_cycles, max(d.cycle_number) AS max_cycle, max(pc.n) AS n_phases, min(CASE WHEN lam > 0.16 THEN d.cycle_number END) AS onset_lam, max(rul) AS rul
FROM dom d JOIN (SELECT cell_id, CAST(count(DISTINCT phase) AS INTEGER) AS n FROM ph GROUP BY cell_id) pc ON pc.cell_id = d.cell_id LEFT JOIN eol ON eol.cell_id = d.cell_id GROUP BY d.cell_id""",
    "predictions physics_known",
)
def cell_views(spark, d):
    """The JSON of each cell for a dashboard, some of it read back."""
    joined = physics.merged(base.predictions(spark, d), dashboard.signals(base.physics_known(spark, d))).withColumnsRenamed({"y_true": "soh_true", "y_pred": "soh_pred"})
    body = dashboard.cell_json(joined)
    got = lambda path, kind: F.get_json_object("body", path).cast(kind)
    phases = F.json_array_length(F.get_json_object("body", "$.phases"))
    return body.select("cell_id", got("$.nCycles", "long").alias("n_cycles"), got("$.maxCycle", "int").alias("max_cycle"), phases.alias("n_phases"), got("$.onsets.LAM", "int").alias("onset_lam"), got("$.rul", "int").alias("rul"))


@query(
    """+ known AS (SELECT p.* FROM predictions p JOIN physics_known f ON p.cell_id = f.cell_id AND p.cycle_number = f.cycle_number),
top AS (SELECT floor(avg(m)) AS top FROM (SELECT max(cycle_number) AS m FROM known GROUP BY cell_id)),
grid AS (SELECT DISTINCT CAST(round_even(k / CAST(80 AS DOUBLE) * top, 0) AS INTEGER) AS cycle FROM top, range(81) t(k)),
seg AS (SELECT *, lead(cycle_number) OVER w AS c1, lead(y_true) OVER w AS t1, row_number() OVER w AS nth FROM known WINDOW w AS (PARTITION BY cell_id ORDER BY cycle_number)),
pts AS (SELECT cycle, CASE WHEN c1 IS NULL THEN y_true ELSE y_true + greatest(0.0, (cycle - cycle_number) / CAST(c1 - cycle_number AS DOUBLE)) * (t1 - y_true) END AS y
  FROM seg JOIN grid ON (cycle >= cycle_number OR nth = 1) AND (c1 IS NULL OR cycle < c1)),
mean AS (SELECT cycle, avg(y) AS y FROM pts GROUP BY cycle)
SELECT count(*) AS n_cycles, max(cycle) AS max_cycle, round(arg_max(y, cycle) + 3.3e-8, 6) AS soh_last, round(arg_min(y, cycle) + 3.3e-8, 6) AS soh_first FROM mean""",
    "predictions physics_known",
)
def batch_view(spark, d):
    """The JSON of the average cell for a dashboard, some of it read back."""
    joined = physics.merged(base.predictions(spark, d), dashboard.signals(base.physics_known(spark, d))).withColumnsRenamed({"y_true": "soh_true", "y_pred": "soh_pred"})
    got = lambda path, kind: F.get_json_object("body", path).cast(kind)
    off = lambda path: F.round(got(path, "double") + _OFF_TIE, 6)
    return dashboard.batch_json(joined).select(
        got("$.nCycles", "long").alias("n_cycles"), got("$.maxCycle", "int").alias("max_cycle"), off("$.sohLast").alias("soh_last"), off("$.rows[0].sohTrue").alias("soh_first")
    )


@query(_PEAKS_SQL[: _PEAKS_SQL.index(",\nrun AS")] + " SELECT cell_id, c AS cycle_number, count(*) AS points, round(sum(y), 4) AS area, round(max(y), 6) AS top FROM y GROUP BY ALL", "samples")
def curve_table(spark, d):
    """Each day's curve through a curve table on disk, validated both ways."""
    path = scratch_path(spark, "curves.parquet")
    empty = {"capacity_ah": "double", "ref_cycle_number": "long", "temperature": "double", "protocol": "string"}
    table = _histograms(spark, d).withColumns({c: F.lit(None).cast(t) for c, t in empty.items()} | {"is_reference": F.lit(False), "grid_spacing_mv": F.lit(20.0)})
    curve_tables.save(table.select(*curve_tables.COLUMNS), path)
    back = curve_tables.load(spark, path)
    total = F.aggregate("dqdv", F.lit(0.0), lambda a, x: a + x)
    return back.select("cell_id", "cycle_number", F.size("dqdv").cast("long").alias("points"), F.round(total, 4).alias("area"), F.round(F.array_max("dqdv"), 6).alias("top"))
