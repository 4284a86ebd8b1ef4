"""Whole runs over several cells: capacities, failures, outputs, predictions."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from galvana.operators import curves, dashboard, features, ingest, model, physics
from galvana.operators.config import Features
from galvana.plans import training
from galvana.sources import readers, sinks

from .test_engine import SAMPLES, ageing, cell

LOOSE = {"features": {"c_rate_max": 0.15, "current_cv_max": 0.05}}


def written_cells(folder, sizes, amps=None):
    """CSV files of cells; `amps` scales the current of a cell."""
    for k, n in enumerate(sizes):
        rows = cell(n, 0.01 + 0.01 * k, f"cell{k}")
        scale = (amps or [1.0] * len(sizes))[k]
        with open(folder / f"cell{k}.csv", "w") as f:
            f.write("time;voltage;current\n" + "".join(f"{r[2]};{r[3]};{r[4] * scale}\n" for r in rows))
    return {f"cell{k}": {"path": f"{folder}/cell{k}.csv"} for k in range(len(sizes))}


def test_every_cell_has_its_own_nominal_capacity(spark, tmp_path):
    cells = written_cells(tmp_path, [3, 3], [1.0, 5.0])
    cells["cell0"]["nominal_capacity_ah"], cells["cell1"]["nominal_capacity_ah"] = 10.0, 50.0
    done = training.run(spark, training.job_from_config({"dataset": {"cells": cells}} | LOOSE, str(tmp_path / "out"), nominal_capacity_ah=7.0))
    rates = {(r.cell_id, r.cycle_index): r.c_rate_est for r in done["meta"].collect()}
    assert all(rates["cell0", k] == pytest.approx(0.1 * (1 - 0.01 * k), rel=1e-6) for k in range(3))
    assert all(rates["cell1", k] == pytest.approx(0.1 * (1 - 0.02 * k), rel=1e-6) for k in range(3))
    health = {(r.cell_id, r.cycle_number): r.soh for r in done["features"].collect()}
    assert health["cell0", 0] == pytest.approx(health["cell1", 0]) and done["curves"].where("ok").count() == 6


def test_capacities_are_settled_before_reading():
    cells = {"a": {"path": "/nowhere/a.csv", "nominal_capacity_ah": 1.0}, "b": {"path": "/nowhere/b.csv"}}
    assert {k: c.nominal_capacity_ah for k, (_, c) in training.job_from_config({"dataset": {"cells": cells, "nominal_capacity_ah": 2.0}}).cells.items()} == {"a": 1.0, "b": 2.0}
    assert training.job_from_config({"dataset": {"cells": cells, "nominal_capacity_ah": 2.0}}, nominal_capacity_ah=3.0).cells["b"][1].nominal_capacity_ah == 3.0
    for config in ({"dataset": {"cells": cells}}, {"dataset": {"dir": "/nowhere"}}, {"dataset": {}}, {"dataset": {"cells": {}}}):
        with pytest.raises(ValueError):
            training.job_from_config(config)


def test_one_broken_file_leaves_the_others(spark, tmp_path):
    cells = written_cells(tmp_path, [3, 3, 3])
    (tmp_path / "cell1.csv").write_text("time;voltage;note\n1;2;x\n")
    (tmp_path / "empty.csv").write_text("")
    cells |= {"gone": {"path": f"{tmp_path}/gone.csv"}, "empty": {"path": f"{tmp_path}/empty.csv"}}
    done = training.run_recorded(spark, training.job_from_config({"dataset": {"cells": cells, "nominal_capacity_ah": 10.0}} | LOOSE, str(tmp_path / "out")))
    assert done["overall"].first()[:] == (5, 3, "partial")
    status = {(r.cell_id, r.stage): (r.status, r.error) for r in done["status"].collect()}
    assert status["cell1", "parse"] == ("failed", "required columns are missing: ['current']") and status["cell1", "features"][0] == "skipped"
    assert status["gone", "parse"][0] == status["empty", "parse"][0] == "failed" and status["cell0", "features"] == ("ok", None)
    assert done["predictions"].select("cell_id").distinct().count() == 2
    told = {r.cell_id: r for r in done["summary"].collect()}
    assert (told["cell0"].n_cycles_parsed, told["cell0"].n_ica_curves, told["cell0"].n_features_ok, told["cell1"].n_cycles_parsed) == (3, 3, 3, 0)
    assert told["cell2"].rmse is not None and [s.stage for s in told["cell1"].stages]
    record = training.read_job(spark, str(tmp_path / "out")).first()
    assert record.status == "partial" and {s.stage for s in record.stages} == set(training.STAGES)
    training.write_outputs(done, str(tmp_path / "files"))
    back = spark.read.csv(str(tmp_path / "files/model/predictions.csv"), header=True, inferSchema=True)
    assert [(r.cell_id, r.cycle_number) for r in back.collect()] == [(f"cell{k}", c) for k in (0, 2) for c in range(3)]
    assert spark.read.csv(str(tmp_path / "files/model/feature_importance.csv"), header=True).count() == 10
    assert spark.read.json(str(tmp_path / "files/summary.json")).count() == 5


def test_nothing_to_read_is_recorded(spark, tmp_path):
    job = training.job_from_config({"dataset": {"dir": str(tmp_path)}}, str(tmp_path / "out"), 1.0)
    with pytest.raises(ValueError, match="no cell can be read"):
        training.run_recorded(spark, job)
    assert training.read_job(spark, str(tmp_path / "out"), job.key()).first().status == "failed"


def test_the_plan_does_not_grow_with_the_cells(spark, tmp_path):
    def scans(n):
        folder = tmp_path / str(n)
        folder.mkdir()
        written_cells(folder, [1] * n)
        rows, _ = training.samples_of(spark, training.job_from_config({"dataset": {"dir": str(folder)}}, nominal_capacity_ah=1.0))
        assert {r.cell_id for r in rows.select("cell_id").distinct().collect()} == {f"cell{k}" for k in range(n)}
        return rows._jdf.queryExecution().optimizedPlan().toString().count("Relation [")

    assert scans(2) == scans(7)


def test_configurations(tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"dataset": {"path": "x.csv"}, "pipeline": {"stages": ["samples"], "resume": False}}))
    job = training.job_from_config(training.load_config(str(tmp_path / "c.json")), nominal_capacity_ah=2.0)
    assert job.cells["*"][0] == "x.csv" and job.stages == ("samples",) and not job.resume
    for bad in ({"half_cycle": "both"}, {"sg_window": 20}, {"sg_polyorder": 21}):
        with pytest.raises(ValueError, match=next(iter(bad))):
            Features(**bad)


def test_trajectory_keeps_curves_that_fail(spark, tmp_path):
    cells = written_cells(tmp_path, [4, 4])
    done = training.run(spark, training.job_from_config({"dataset": {"cells": cells, "nominal_capacity_ah": 10.0}} | LOOSE, str(tmp_path / "out")))
    fitted = model.full_model(model.gram_stats(done["features"]))
    cfg = training.job_from_config({"dataset": {"cells": cells, "nominal_capacity_ah": 10.0}} | LOOSE).features
    with pytest.raises(ValueError, match="reference"):
        training.Predictor(fitted, cfg).trajectory(done["curves"])
    broken = done["curves"].withColumns({"ok": F.col("ok") & (F.col("cycle_index") != 2), "fail_reason": F.when(F.col("cycle_index") == 2, "insufficient_cc_region")})
    one = training.Predictor(fitted, cfg).with_reference(broken.where("cell_id = 'cell0'"))
    told = {(r.cell_id, r.cycle_number): r for r in one.trajectory(broken).collect()}
    assert len(told) == 8
    assert told["cell0", 2].explanation == "Extraction failed: insufficient_cc_region" and told["cell0", 2].soh_pred is None
    assert told["cell1", 1].explanation == "Extraction failed: no reference curve"
    assert told["cell0", 3].soh_pred is not None and told["cell0", 3].explanation.startswith("Predicted SOH")


def test_array_features_equal_those_by_point(spark):
    rng = np.random.default_rng(3)
    rows = [("a", k, 0, [None if rng.random() < 0.1 else float(x) for x in rng.normal(0, 1, 40) * (k + 1)]) for k in range(5)]
    rows += [("a", 5, 0, [1.0] * 40), ("a", 6, 0, [1.0, float("nan")] + [None] * 38), ("a", 7, 0, [float("inf")] + [0.5, 9.0] * 12)]
    df = spark.createDataFrame(rows, "cell_id string, cycle_index int, ref_cycle_index int, dq array<double>")
    by_array = {r.cycle_index: r for r in features.array_features(df, Features(outlier_sigma=1.5)).collect()}
    points = df.select("cell_id", "cycle_index", F.posexplode("dq").alias("grid_idx", "dq"))
    for r in features.curve_features(features.clipped(points, 1.5)).collect():
        other = by_array[r.cycle_index]
        assert r.extraction_ok == other.extraction_ok
        for c in [c for c in r.asDict() if c.startswith("dqv_")]:
            assert r[c] == pytest.approx(other[c], rel=1e-9, abs=1e-12) if r[c] is not None else other[c] is None, (r.cycle_index, c)


def test_chemistries_can_be_registered(spark):
    df = spark.createDataFrame([("a", 1, 0, [float(k) for k in range(12)])], "cell_id string, cycle_index int, ref_cycle_index int, dq array<double>")
    features.register_chemistry("sodium", {"dqv_first": lambda a, dv: a[0] + dv})
    assert features.array_features(df, Features(chemistry="Sodium")).first().dqv_first == pytest.approx(0.005)
    with pytest.raises(ValueError):
        features.register_chemistry("bad", {"soh": lambda a, dv: a[0]})


def test_references_of_the_physics_table(spark):
    table = ageing(spark).withColumn("is_reference", F.lit(False))
    chosen = {r.cycle_number: r for r in physics.physics_table(table, reference_cycle=2).collect()}
    assert chosen[2].LLI_mean_shift == 0 and chosen[0].LLI_mean_shift < 0
    assert {r.failed for r in physics.physics_table(table, reference_cycle=99).collect()} == {"the cell has no reference"}
    uneven = table.withColumn("voltage_grid", F.transform("voltage_grid", lambda v: v * v))
    assert {r.failed for r in physics.physics_table(uneven).collect()} == {"voltage grid isn't uniform"}
    with pytest.raises(Exception, match="widths must be positive"):
        spark.createDataFrame([([0.0], [1.0])], "a array<double>, b array<double>").select(physics.width_growth("a", "b")).collect()


def test_json_of_cells_and_of_the_batch(spark):
    phys = physics.physics_table(ageing(spark)).drop("peaks", "matches", "failed")
    preds = spark.createDataFrame([("a", k, 1 - 0.06 * k, 0.99 - 0.06 * k) for k in range(6)], "cell_id string, cycle_number int, soh_true double, soh_pred double")
    table = dashboard.signals(phys.join(preds, ["cell_id", "cycle_number"]))
    per = model.metrics(preds.withColumnsRenamed({"soh_true": "y_true", "soh_pred": "y_pred"}))
    body = json.loads(dashboard.cell_json(table, per).first().body)
    assert (body["nCycles"], body["maxCycle"], body["rul"], body["cellDominant"]) == (6, 5, 3, "LAM")
    assert [x["cycle"] for x in body["rows"]] == list(range(6)) and body["phases"] and body["onsets"]["LAM"] is not None and body["metrics"]["rmse"] == 0.01
    batch = json.loads(dashboard.batch_json(table, 11).first().body)
    assert batch["nCycles"] == 6 and batch["rows"][0]["sohTrue"] == 1.0


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("b", 1, [1.5, None]), ("a", 2, []), ("a", 1, None)], "cell_id string, cycle_number int, q array<double>").repartition(3)
    sinks.write_csv(df, str(tmp_path / "x.csv"))
    back = spark.read.csv(str(tmp_path / "x.csv"), header=True, escape='"').collect()
    assert [(r.cell_id, r.cycle_number) for r in back] == [("a", "1"), ("a", "2"), ("b", "1")] and json.loads(back[2].q) == [1.5, None]
    sinks.write_json(df, str(tmp_path / "x.json"))
    assert '"q":null' in "".join(r.value for r in spark.read.text(str(tmp_path / "x.json")).collect())


def test_trusted_cycles_and_dates_need_no_window_over_a_cell(spark):
    """The plan of numeric() has no window at all; its figures come from one row for each cell."""
    raw = spark.createDataFrame(cell(2), SAMPLES).withColumn("time", F.col("time").cast("string"))
    assert "Window" not in ingest.numeric(raw)._jdf.queryExecution().optimizedPlan().toString()


def test_window_of_millivolts():
    assert [curves.smoothing_points(*x, 3) for x in ((20, 2, 400), (20, 2, 8), (2, 2, 400), (20, 2, 4), (21, 2, 400), (16, 2, 400))] == [11, 7, 5, 5, 11, 9]


def test_unreadable_files_say_why(spark, tmp_path):
    (tmp_path / "a.parquet").write_bytes(b"not parquet")
    (tmp_path / "b.xyz").write_text("?")
    (tmp_path / "c.csv").write_text("")
    found = readers.columns_of(spark, [f"file://{tmp_path}/{n}" for n in ("a.parquet", "b.xyz", "c.csv")])
    assert all(isinstance(x, str) for x in found.values()) and readers.files_of(spark, f"{tmp_path}/none.csv") == []


def test_headers_are_read_from_first_blocks(spark, tmp_path):
    (tmp_path / "q.csv").write_text('"time, s";"voltage";current\n' + "1;2;3\n" * 100_000)
    (tmp_path / "t.txt").write_text("time\tvoltage\tcurrent\n1\t2\t3\n")
    (tmp_path / "c.csv").write_text('time,"voltage, V",current\n1,2,3\n')
    spark.createDataFrame([(1.0, 2.0)], "time double, voltage double").toPandas().to_feather(tmp_path / "f.feather")
    spark.createDataFrame([(1.0, 2.0)], "time double, voltage double").toPandas().to_parquet(tmp_path / "p.parquet")
    names = ("q.csv", "t.txt", "c.csv", "f.feather", "p.parquet")
    found = readers.columns_of(spark, [f"file://{tmp_path}/{n}" for n in names])
    want = [(";", ["time, s", "voltage", "current"]), ("\t", ["time", "voltage", "current"]), (",", ["time", "voltage, V", "current"]), ("", ["time", "voltage"]), ("", ["time", "voltage"])]
    assert [found[f"file://{tmp_path}/{n}"] for n in names] == want
    both = readers.read_alike(spark, [f"file://{tmp_path}/f.feather"] * 1, "").collect()
    assert [(r.time, r.voltage, r.file) for r in both] == [(1.0, 2.0, f"file://{tmp_path}/f.feather")]


def test_damaged_files_fail_their_cell_alone(spark, tmp_path):
    import pandas as pd

    for k in range(4):
        rows = cell(3, 0.01 + 0.01 * k, f"cell{k}")
        pd.DataFrame([(float(r[2]), float(r[3]), float(r[4])) for r in rows], columns=["time", "voltage", "current"]).to_parquet(tmp_path / f"cell{k}.parquet", compression="gzip")
    whole = (tmp_path / "cell1.parquet").read_bytes()
    (tmp_path / "cell1.parquet").write_bytes(whole[: len(whole) // 2])  # cut off: no footer
    whole = bytearray((tmp_path / "cell2.parquet").read_bytes())
    for at in range(200, len(whole) // 2, 7):
        whole[at] ^= 0x5A  # damaged within, while the footer is there
    (tmp_path / "cell2.parquet").write_bytes(bytes(whole))
    (tmp_path / "cell4.csv.gz").write_bytes(b"\x1f\x8b\x08\x00cut")
    cells = {f"cell{k}": {"path": f"{tmp_path}/cell{k}.parquet"} for k in range(4)} | {"cell4": {"path": f"{tmp_path}/cell4.csv.gz"}}
    done = training.run(spark, training.job_from_config({"dataset": {"cells": cells, "nominal_capacity_ah": 10.0}} | LOOSE, str(tmp_path / "out")))
    status = {(r.cell_id, r.stage): r.status for r in done["status"].collect()}
    assert [status[f"cell{k}", "parse"] for k in range(5)] == ["ok", "failed", "failed", "ok", "failed"]
    assert {r.cell_id: r["count"] for r in done["samples"].groupBy("cell_id").count().collect()}.keys() == {"cell0", "cell3"}
    assert done["predictions"].select("cell_id").distinct().count() == 2


def test_a_job_grades_picks_and_reports(spark, tmp_path):
    cells = written_cells(tmp_path, [3, 3], [1.0, 3.0])
    config = {"dataset": {"cells": cells, "nominal_capacity_ah": 10.0}, "features": {"c_rate_max": 1.0, "current_cv_max": 0.05}, "ica": {"max_c_rate_research": 0.12, "max_c_rate_fallback": 0.5}}
    done = training.run(spark, training.job_from_config(config, str(tmp_path / "out")))
    assert {(r.cell_id, r.research_grade) for r in done["picks"].collect()} == {("cell0", True), ("cell1", False)}
    flags = {(r.cell_id, curves.NOT_RESEARCH in r.flags) for r in done["ica"].collect()}
    assert flags == {("cell0", False), ("cell1", True)}
    physics_of = {(r.cell_id, r.cycle_number): r for r in done["physics"].collect()}
    assert set(physics_of) == {(f"cell{k}", c) for k in range(2) for c in range(3)} and physics_of["cell0", 0].LAM_loss == pytest.approx(0, abs=1e-6)
    told = {r.cell_id: r for r in done["report"].collect()}
    assert told["cell0"].n_cycles == 3 and json.loads(told["cell1"].evidence)["dominant_mechanism"] == told["cell1"].dominant_mechanism
    training.write_outputs(done, str(tmp_path / "files"))
    assert spark.read.json(str(tmp_path / "files/report.json")).count() == 2
