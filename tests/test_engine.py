import json
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from galvana.operators import curves, cycles, dashboard, features, folds, ingest, model, physics, report
from galvana.operators.config import FEATURE_COLS, Cell, Features
from galvana.plans import registry, training
from galvana.sources import curves as curve_tables
from galvana.sources import datasets, readers

TABLES = "region nation customer supplier part orders lineitem events".split()


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "null"
    return f"{value + 0.0:.6f}" if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_its_sql(spark, sf_dir, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = registry.QUERIES[name](spark, sf_dir)
    got = sorted(tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect())
    cursor = db.execute(registry.ORACLES[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    order = [columns.index(c) for c in sorted(columns)]
    assert got == sorted(tuple(plain(r[i]) for i in order) for r in cursor.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_without_sql_runs(spark, sf_dir, name):
    assert registry.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


# --- ingest and cycles -----------------------------------------------------------------------------------------------


def test_vendor_columns(spark):
    raw = spark.createDataFrame([("c", 1, "1.5", "500", "x", "2"), ("c", 2, "bad", "600", "y", "3")], "cell_id string, row_id int, `Test_Time(s)` string, `I/mA` string, Note string, Ewe string")
    out = ingest.samples(raw)
    assert [tuple(r) for r in out.select("time", "current", "voltage").collect()] == [(1.5, 0.5, 2.0)]
    hours = ingest.in_si_units(spark.createDataFrame([(2.0, 3.0)], "time double, current double"), {}, Cell(time_unit="h"))
    assert hours.first().time == 7200
    with pytest.raises(ValueError, match="voltage"):
        ingest.standardised(raw.drop("Ewe"))


def test_date_times_become_seconds(spark):
    raw = spark.createDataFrame([("c", "2024-01-01 00:00:10"), ("c", "2024-01-01 00:01:00"), ("d", "5"), ("d", "7.5")], "cell_id string, time string")
    assert sorted((r.cell_id, r.time) for r in ingest.numeric(raw).collect()) == [("c", 0.0), ("c", 50.0), ("d", 5.0), ("d", 7.5)]


def cell(n_cycles=4, decay=0.02, cell_id="a", given=False):
    rows, t = [], 0.0
    for c in range(n_cycles):
        for phase, points in ((1, 300), (-1, 400)):
            x = np.linspace(0, 1, points)
            volts = 3.0 + 1.15 * x if phase == 1 else 4.15 - 1.63 * (x + 0.1 * np.sin(np.pi * x) * (1 + decay * c)) / 1.0
            for v in volts:
                rows.append((cell_id, len(rows), t, float(v), phase * 1.0 * (1 - decay * c), c if given else None))
                t += 60.0
    return rows


SAMPLES = "cell_id string, row_id long, time double, voltage double, current double, cycle_index int"


@pytest.mark.parametrize("given", [False, True])
def test_cycles_of_a_cell(spark, given):
    df = cycles.with_cycles(spark.createDataFrame(cell(given=given), SAMPLES).repartition(5))
    meta = {r.cycle_index: r for r in cycles.cycle_meta(df, 10.0).collect()}
    assert sorted(meta) == [0, 1, 2, 3]
    assert all(r.n_points == 700 and r.ica_suitable == (abs(r.c_rate_est) <= 0.1) for r in meta.values())
    assert abs(meta[0].discharge_capacity_ah - 399 * 60 / 3600) < 1e-9


def test_chunks_of_time_do_not_matter(spark):
    rng = np.random.default_rng(8)
    rows = [(f"c{k % 3}", k, float(rng.integers(0, 5000)), 3.0, float(rng.integers(-1, 2))) for k in range(3000)]
    df = spark.createDataFrame(rows, "cell_id string, row_id long, time double, voltage double, current double")
    found = [sorted((r.row_id, r.phase, r.cycle_index) for r in cycles.with_cycles(df, chunk_s=s).collect()) for s in (1e9, 300.0, 7.0)]
    want, state = {}, {}
    for cell_id, row_id, _, _, current in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        phase, count = state.get(cell_id, (0, 0))
        new = int(current) or phase
        count += phase == -1 and new == 1
        state[cell_id] = (new, count)
        want[row_id] = state[cell_id]
    assert found[0] == found[1] == found[2] == [(k, *want[k]) for k in sorted(want)]


def test_curves_features_and_model_end_to_end(spark, tmp_path):
    rows = [r for k in range(3) for r in cell(5, 0.01 + 0.01 * k, f"cell{k}")]
    for k in range(3):
        with open(tmp_path / f"cell{k}.csv", "w") as f:
            f.write("time;voltage;current\n" + "".join(f"{r[2]};{r[3]};{r[4]}\n" for r in rows if r[0] == f"cell{k}"))
    config = {"dataset": {"cells": {f"cell{k}": {"path": f"{tmp_path}/cell{k}.csv", "nominal_capacity_ah": 10.0} for k in range(3)}}, "features": {"c_rate_max": 0.15, "current_cv_max": 0.05}}
    seen = []
    job = training.job_from_config(config, str(tmp_path / "out"))
    object.__setattr__(job, "progress", lambda *x: seen.append(x[:2]))
    done = training.run(spark, job)
    assert [s for _, s in seen] == ["ok"] * len(training.STAGES)
    made = done["features"].collect()
    assert len(made) == 15 and all(r.extraction_ok for r in made) and {r.config_hash for r in made} == {job.features.hash()}
    first = [r for r in made if r.cycle_number == 0]
    assert all(r.dqv_variance == 0 and r.dqv_skewness is None for r in first)
    assert done["predictions"].count() == 15
    training.run(spark, job)
    assert [s for _, s in seen[len(training.STAGES) :]] == ["resumed"] * len(training.STAGES)
    assert done["ica"].where("size(peaks_v) >= 0").count() == 15
    curves.assert_comparable(done["ica"])
    ref = done["curves"].where("cycle_index = 0")
    fit = model.full_model(model.gram_stats(done["features"]))
    told = training.assess(done["curves"], ref, fit, job.features).collect()
    assert len(told) == 15 and all(r.explanation.startswith("Predicted SOH") for r in told)


def test_short_half_cycles_say_why(spark):
    df = spark.createDataFrame([("a", k, float(k), 3.0, -1.0, 0) for k in range(5)], SAMPLES)
    assert curves.qv_curves(df, 10.0).first().fail_reason == "too_few_raw_points"
    assert curves.ica_curves(df).count() == 0


def test_row_order_and_partitions_do_not_matter(spark):
    df = cycles.with_cycles(spark.createDataFrame(cell(2), SAMPLES))
    half = cycles.half_cycle(df, "discharge")
    cfg = Features(c_rate_max=0.15)
    one, two = (curves.qv_curves(x, 10.0, cfg).orderBy("cycle_index").collect() for x in (half, half.orderBy(F.rand(3)).repartition(7)))
    assert one == two


# --- model -----------------------------------------------------------------------------------------------------------


def plain_elastic_net(x, y, alpha=1e-3, l1_ratio=0.5, tol=1e-4, max_iter=20000):
    """Cyclic coordinate descent over rows: standardised features, a residual for each row, and the rule by which it stops."""
    mean, scale = x.mean(0), x.std(0)
    scale = np.where(scale == 0, 1, scale)
    z, target = (x - mean) / scale, y - y.mean()
    n, p = z.shape
    l1, l2 = alpha * l1_ratio * n, alpha * (1 - l1_ratio) * n
    w, residual = np.zeros(p), target.copy()
    for _ in range(max_iter):
        moved = 0.0
        for j in range(p):
            column, old = z[:, j], w[j]
            if not column.any():
                continue
            pull = column @ (residual + column * old)
            w[j] = math.copysign(max(abs(pull) - l1, 0), pull) / (column @ column + l2)
            residual -= column * (w[j] - old)
            moved = max(moved, abs(w[j] - old))
        if np.abs(w).max() == 0 or moved / np.abs(w).max() < tol:
            slope = z.T @ residual - l2 * w
            worst = np.abs(slope).max()
            if worst > l1:
                c = l1 / worst
                gap = 0.5 * (residual @ residual) * (1 + c * c)
            else:
                c, gap = 1.0, residual @ residual
            gap += l1 * np.abs(w).sum() - c * (residual @ target) + 0.5 * l2 * (1 + c * c) * (w @ w)
            if gap < tol * (target @ target):
                break
    return lambda q: y.mean() + ((q - mean) / scale) @ w, w


def health_table(spark, cells=4, rows=30):
    rng = np.random.default_rng(12)
    out = []
    for c in range(cells):
        for k in range(rows):
            f = rng.normal(0, 1, len(FEATURE_COLS)) * np.arange(1, len(FEATURE_COLS) + 1)
            f[1] = f[0] * 0.9 + rng.normal(0, 0.1)  # two features that go together
            out.append((f"cell{c}", k, float(1 - 0.01 * k + 0.02 * f[0] - 0.005 * f[3] + rng.normal(0, 0.01)), *map(float, f)))
    out[5] = (*out[5][:3], None, *out[5][4:])  # a missing feature counts as 0
    return spark.createDataFrame(out, "cell_id string, cycle_number int, soh double, " + ", ".join(f"{c} double" for c in FEATURE_COLS)), out


def test_model_matches_a_row_wise_version(spark):
    df, rows = health_table(spark)
    x = np.array([[v or 0.0 for v in r[3:]] for r in rows])
    y, cell = np.array([r[2] for r in rows]), np.array([r[0] for r in rows])
    _, w = plain_elastic_net(x, y)
    fit = model.full_model(model.gram_stats(df))
    assert np.abs(np.array(fit["coef"]) - w).max() < 1e-8 and (w != 0).sum() >= 3
    want = {}
    for c in sorted(set(cell)):
        told, _ = plain_elastic_net(x[cell != c], y[cell != c])
        want |= {(c, rows[i][1]): told(x[i]) for i in np.flatnonzero(cell == c)}
    got = {(r.cell_id, r.cycle_number): r.y_pred for r in model.loco_predictions(df).collect()}
    assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) < 1e-8
    error = np.array([rows[i][2] - want[rows[i][0], rows[i][1]] for i in range(len(rows))])
    overall = model.metrics(model.loco_predictions(df)).where("cell_id IS NULL").first()
    assert overall.rmse == pytest.approx(math.sqrt((error**2).mean())) and overall.mae == pytest.approx(np.abs(error).mean())
    assert overall.r2 == pytest.approx(1 - (error**2).sum() / ((y - y.mean()) ** 2).sum())


def test_other_estimators_can_be_injected(spark):
    df, _ = health_table(spark)
    constant = lambda n, sx, sxx, sy, sxy, syy, net: {"mean": sx / n, "scale": np.ones(len(sx)), "coef": np.zeros(len(sx)), "intercept": sy / n}
    means = {r.cell_id: r.m for r in df.groupBy("cell_id").agg(F.avg("soh").alias("m")).collect()}
    for r in model.loco_predictions(df, solver=constant).groupBy("cell_id").agg(F.min("y_pred").alias("lo"), F.max("y_pred").alias("hi")).collect():
        assert r.lo == pytest.approx(r.hi) and r.lo == pytest.approx(np.mean([m for c, m in means.items() if c != r.cell_id]))


def test_saved_models_are_listed(spark, tmp_path):
    fit = {"mean": np.zeros(10), "scale": np.ones(10), "coef": np.ones(10), "intercept": 0.9}
    for name in ("m1", "m2"):
        model.save(fit, str(tmp_path / f"{name}.json"), name)
    (tmp_path / "other.json").write_text("[1, 2")
    assert [(r.path, r.config_hash, r.net.alpha, len(r.features)) for r in model.saved_models(spark, str(tmp_path)).collect()] == [("m2.json", "m2", 1e-3, 10), ("m1.json", "m1", 1e-3, 10)]


def test_one_cell_has_no_fold(spark):
    df = spark.createDataFrame([("a", k, 1 - k / 50, float(k)) for k in range(9)], "cell_id string, cycle_number int, soh double, x double")
    assert model.loco_predictions(df, names=("x",)).count() == 0


def test_saved_model_is_tied_to_its_configuration(tmp_path):
    fit = {"mean": np.zeros(10), "scale": np.ones(10), "coef": np.ones(10), "intercept": 0.9}
    model.save(fit, str(tmp_path / "m.json"), "one")
    assert model.load(str(tmp_path / "m.json"), "one")["intercept"] == 0.9
    with pytest.raises(ValueError):
        model.load(str(tmp_path / "m.json"), "two")


def test_feature_contract(spark):
    names = ["cell_id", "cycle_index", "soh", "var_deltaQ", *[c for c in FEATURE_COLS if c != "dqv_variance"]]
    df = spark.createDataFrame([tuple([0.0] * len(names))], names)
    assert "dqv_variance" in features.validated(df).columns
    with pytest.raises(ValueError, match="dqv_rms"):
        features.validated(df.drop("dqv_rms"))
    with pytest.raises(ValueError):
        features.check_no_leakage(["soh"])


def test_exact_quantiles(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x = np.round(rng.gamma(2, 3, 5000), 1)  # many ties
    df = spark.createDataFrame([(float(v), None if k % 7 else float(k), float("nan"), 5.0) for k, v in enumerate(x)], "a double, b double, c double, d double").repartition(3)
    monkeypatch.setattr(folds, "SKETCH", 8)  # coarse brackets, some of which miss
    got = features.quantiles(df, ["a", "b", "c", "d"], [0.0, 0.25, 0.5, 0.75, 1.0])
    assert got["a"] == pytest.approx(np.quantile(x, [0, 0.25, 0.5, 0.75, 1]).tolist())
    assert got["b"] == pytest.approx(np.quantile(np.arange(0, 5000, 7), [0, 0.25, 0.5, 0.75, 1]).tolist()) and got["c"] == [None] * 5 and got["d"] == [5.0] * 5


def test_windows_over_blocks(spark):
    rng = np.random.default_rng(2)
    rows = [(f"c{k % 3 and 1}", k, float(rng.integers(0, 400_000)), float(rng.normal())) for k in range(1500)]
    df = spark.createDataFrame(rows, "cell_id string, row_id long, time double, voltage double").repartition(4)
    made = cycles.over_blocks(df, 3, {"mean": lambda w: curves.moving_average("voltage", w, 7), "ahead": lambda w: F.lead("row_id", 3).over(w)}, block=8)
    plain = df.withColumns({"mean": curves.moving_average("voltage", cycles.in_time(), 7), "ahead": F.lead("row_id", 3).over(cycles.in_time())})
    key = lambda d: sorted((r.row_id, round(r["mean"], 9), r.ahead) for r in d.collect())
    assert made.columns == plain.columns and str(key(made)) == str(key(plain))
    with pytest.raises(ValueError):
        cycles.over_blocks(df, 8, {}, block=8)


def test_group_folds_keep_cells_together(spark):
    df = spark.createDataFrame([(f"c{k % 6}", k) for k in range(60)], "cell_id string, k int")
    out = features.group_folds(df, 3)
    assert out.groupBy("cell_id").agg(F.count_distinct("fold").alias("n")).where("n <> 1").count() == 0
    assert out.select("fold").distinct().count() == 3


# --- physics, report, dashboard --------------------------------------------------------------------------------------


def ageing(spark):
    v = np.linspace(2.5, 4.2, 341)
    rows = []
    for k in range(6):
        width, centre = 0.05 + 0.002 * k, 3.5 + 0.002 * k
        rows.append(("a", k, k == 0, v.tolist(), ((1 - 0.07 * k) * np.exp(-0.5 * ((v - centre) / width) ** 2)).tolist()))
    return spark.createDataFrame(rows, "cell_id string, cycle_number int, is_reference boolean, voltage_grid array<double>, dqdv array<double>")


def test_physics_of_an_ageing_cell(spark):
    found = physics.physics_table(ageing(spark)).orderBy("cycle_number").collect()
    assert found[0].LLI_mean_shift == 0 and found[0].LAM_loss == pytest.approx(0, abs=1e-6) and found[0].Resistance_growth == 0
    last = found[-1]
    assert last.LLI_mean_shift == pytest.approx(0.010, abs=0.003) and last.Resistance_growth == pytest.approx(0.2, abs=0.05) and 0.2 < last.LAM_loss < 0.3
    assert physics.peak_table(ageing(spark)).count() == 6
    native = physics.physics_table(ageing(spark)).select("LLI_mean_shift", *[c.alias(f"n_{n}") for n, c in physics.lli_summary(F.col("matches"), F.lit(1)).items()])
    assert all(abs(r.LLI_mean_shift - r.n_LLI_mean_shift) < 1e-12 for r in native.collect())
    assert physics.shift_trajectory(physics.physics_table(ageing(spark))).first().slope == pytest.approx(0.002, abs=6e-4)


def test_report_and_views(spark):
    phys = physics.physics_table(ageing(spark)).drop("peaks", "matches", "failed")
    preds = spark.createDataFrame([("a", k, 1 - 0.06 * k, 0.99 - 0.06 * k) for k in range(6)], "cell_id string, cycle_number int, y_true double, y_pred double")
    per = model.metrics(preds).where("cell_id IS NOT NULL")
    report.validate(preds, per, phys)
    with pytest.raises(ValueError):
        report.validate(preds.union(preds), per)
    with pytest.raises(ValueError):
        report.validate(preds, per.where("cell_id = 'b'"))
    table = report.cycle_table(preds, phys)
    summary = report.cell_summary(table, report.trends(table), per)
    row = summary.first()
    assert row.dominant_mechanism == "LAM" and row.soh_pred_slope == pytest.approx(-0.06) and 0 <= row.overall_confidence <= 1
    told = json.loads(report.evidence(summary).first().evidence)
    assert told["LAM"]["slope"] > 0 and told["dominant_mechanism"] == "LAM"
    views = dashboard.signals(table)
    assert dashboard.eol_cycle(views).first().eol_cycle == 3
    assert dashboard.onsets(views).first().onset_LAM is not None
    phases = dashboard.phase_segments(views.withColumn("soh", F.col("soh_true")))
    assert phases.agg(F.sum("n")).first()[0] == 6 and dashboard.cell_dominant(phases).count() == 1
    assert dashboard.batch_average(views, ["soh_true"], 11).count() == 11
    assert json.loads(dashboard.cell_json(views).first().body)["nCycles"] == 6


def test_short_phases_join_the_one_before(spark):
    seq = ["EARLY", "LLI", "LLI", "LLI", "LAM", "LAM", "LLI", "EARLY", "RES"]
    df = spark.createDataFrame([("a", k, m, 1.0) for k, m in enumerate(seq)], "cell_id string, cycle_number int, dominant string, soh double")
    got = [(r.mech, r.start_cycle, r.end_cycle) for r in dashboard.phase_segments(df).orderBy("phase").collect()]
    assert got == [("EARLY", 0, 0), ("LLI", 1, 6), ("EARLY", 7, 8)]


# --- sources and streams ---------------------------------------------------------------------------------------------


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("time|voltage|current\n1|2|3\n")
    assert readers.read_raw(spark, str(tmp_path / "a.csv")).select("cell_id", "voltage").first()[:] == ("a", "2")
    with pytest.raises(ValueError):
        readers.read_raw(spark, "x.xlsx")
    with pytest.raises(ValueError):
        readers.read_raw(spark, "x.bin")
    with pytest.raises(KeyError):
        readers.registry.load(spark, "nothing", "x")
    assert "batch" in readers.registry.registered()
    import pyarrow as pa
    import pyarrow.feather as feather

    feather.write_feather(pa.table({"time": [1.0, 2.0], "voltage": [3.0, 3.1], "current": [1.0, 1.0]}), str(tmp_path / "b.feather"))
    assert readers.read_raw(spark, str(tmp_path / "b.feather")).count() == 2


def test_nested_batch(spark, tmp_path):
    body = {"b1": {"barcode": "X", "summary": {"QDischarge": [1.0, 0.95, 0.9], "cycle": [1, 2, 3]}, "cycles": {"1": {"t": [0, 1], "V": [3, 4], "I": [1, -1], "Qc": [0, 1], "Qd": [0, 2], "T": [25, 26]}, "bad": {"t": [1]}}}}
    (tmp_path / "b.jsonl").write_text(json.dumps(body) + "\n")
    rows = readers.registry.auto_load(spark, str(tmp_path / "b.jsonl")).orderBy("row_id").collect()
    assert [(r.time, r.capacity, r.soh) for r in rows] == [(0.0, 0.0, 1.0), (60.0, 2.0, 1.0)]


def test_characterisation_halves(spark):
    rows = [("a", c, kind, k, 10.0 + c + k / 86400, 1000.0 * k / 3600, 3.0) for c in (0, 100) for kind in ("C1ch", "C1dc") for k in range(12)]
    df = spark.createDataFrame(rows, "cell_id string, cycle_index int, kind string, row_id long, time double, q double, voltage double")
    best = datasets.preferred_halves(df)
    assert {r.kind for r in best.select("kind").distinct().collect()} == {"C1dc"}
    joined = datasets.joined_cycles(best).orderBy("time").collect()
    assert [round(r.time) for r in joined] == [*range(12), *range(12, 24)]
    assert all(abs(r.current - 1) < 1e-3 for r in joined)
    many = spark.createDataFrame([("a", 0, k, float(k)) for k in range(5000)], "cell_id string, cycle_index int, row_id long, time double")
    kept = sorted(r.row_id for r in datasets.downsampled(many, 1500).collect())
    assert kept == np.round(np.linspace(0, 4999, 1500)).astype(int).tolist()


def test_curve_table(spark, tmp_path):
    base = ageing(spark).select("cell_id", "cycle_number", F.lit(1.0).alias("capacity_ah"), "is_reference", F.lit(0).cast("long").alias("ref_cycle_number"), F.lit(25.0).alias("temperature"), F.lit("p").alias("protocol"), F.lit(5.0).alias("grid_spacing_mv"), "voltage_grid", "dqdv")
    curve_tables.save(base, str(tmp_path / "c"))
    assert curve_tables.load(spark, str(tmp_path / "c")).count() == 6
    with pytest.raises(ValueError, match="repeated"):
        curve_tables.validate(base.union(base))


def test_stream_of_samples(spark, tmp_path):
    from galvana.streaming import cycles as stream

    rows = cell(3)
    df = spark.createDataFrame(rows, SAMPLES).drop("cycle_index")
    late = spark.createDataFrame([("a", 9001, 30.0, 3.0, 1.0)], df.schema)
    for k in range(3):
        part = df.where(f"row_id div 700 = {k}")
        (part.union(late) if k == 1 else part).coalesce(1).write.parquet(str(tmp_path / "in" / f"part{k}"))
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    q = stream.with_cycles(source).writeStream.format("memory").queryName("cycles_out").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    seen = spark.table("cycles_out").collect()
    assert [(r.row_id, r.phase, r.cycle_index) for r in seen if r.late] == [(9001, None, None)]
    got = {r.row_id: (r.phase, r.cycle_index) for r in seen if not r.late}
    want = {r.row_id: (r.phase, r.cycle_index) for r in cycles.with_cycles(df).collect()}
    assert got == want
