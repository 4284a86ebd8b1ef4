"""Batch training and assessment over many cells as one lineage of DataFrames.

Stages write Parquet under the output folder, keyed by a hash of everything they depend on, so a changed configuration
never reads an older stage. Cells that fail keep rows that say why.
"""

from __future__ import annotations

import argparse
import hashlib
import json
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace
from functools import reduce
from pathlib import PurePosixPath
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import join_small
from ..operators import curves, cycles, features, ingest, model, physics, report
from ..operators.config import Cell, Features, Ica, Parsing
from ..sources import readers, sinks
from . import summary

#: Fixed value: how the explanation of a curve that can't be assessed begins.
FAILED = "Extraction failed: "
STAGES = ("samples", "meta", "picks", "curves", "ica", "features", "predictions", "physics", "report")


@dataclass(frozen=True)
class Job:
    cells: dict[str, tuple[str, Cell]]  # cell_id -> (path, cell); "*" stands for a cell for each file of a pattern
    output: str
    parsing: Parsing = Parsing()
    ica: Ica = Ica()
    features: Features = Features()
    net: model.ElasticNet = model.ElasticNet()
    stages: tuple[str, ...] = STAGES
    resume: bool = True
    progress: Callable[[str, str, float], None] = field(default=lambda stage, status, seconds: None)

    def key(self) -> str:
        parts = {"cells": {k: [p, asdict(c)] for k, (p, c) in self.cells.items()}, "parsing": asdict(self.parsing), "ica": asdict(self.ica), "features": asdict(self.features), "net": asdict(self.net)}
        return hashlib.sha256(json.dumps(parts, sort_keys=True).encode()).hexdigest()[:16]


def job_from_config(config: dict, output: str | None = None, nominal_capacity_ah: float | None = None, stages=None, resume=None) -> Job:
    """A job from a parsed configuration. A cell's own nominal capacity wins over the argument, and that over the dataset's;
    ValueError for a cell that has none, before anything is read."""
    data = config.get("dataset", {})
    default = nominal_capacity_ah or data.get("nominal_capacity_ah")
    if "cells" in data:
        cells = {k: (c["path"], Cell(c.get("nominal_capacity_ah", default), *(c.get(u) for u in ("capacity_unit", "current_unit", "time_unit")))) for k, c in data["cells"].items()}
    elif "dir" in data:
        cells = {"*": (f"{data['dir']}/{data.get('pattern', '*.csv')}", Cell(default))}
    elif "path" in data:
        cells = {"*": (data["path"], Cell(default))}
    else:
        raise ValueError("the configuration names no cells: it needs dataset.cells, dataset.dir or dataset.path")
    unrated = [k for k, (_, c) in cells.items() if not c.nominal_capacity_ah or c.nominal_capacity_ah <= 0]
    if unrated or not cells:
        raise ValueError(f"cells without a nominal capacity: {unrated}" if unrated else "the configuration has no cells")
    run = config.get("pipeline", {})
    known = lambda cls, name: cls(**{k: v for k, v in config.get(name, {}).items() if k in cls.__dataclass_fields__})
    return Job(
        cells, output or config.get("output_dir", "output"), known(Parsing, "parse"), known(Ica, "ica"), known(Features, "features"), known(model.ElasticNet, "model"),
        tuple(stages or run.get("stages", STAGES)), run.get("resume", True) if resume is None else resume,
    )


def load_config(path: str) -> dict:
    """A configuration from JSON, or from YAML where a library for it is installed."""
    with open(path) as f:
        if path.endswith((".yml", ".yaml")):
            import yaml

            return yaml.safe_load(f)
        return json.load(f)


def files_table(spark: SparkSession, job: Job) -> tuple[DataFrame, dict[tuple, list[str]], list[tuple[str, str]]]:
    """(file, cell_id, nominal_ah, units) of all readable files; the files by (format, delimiter, columns); and (cell_id,
    reason) of those that can't be used. Cells given by a pattern are named by their file's stem."""
    rows, failed = [], []
    for cell_id, (path, cell) in job.cells.items():
        files = readers.files_of(spark, path)
        if not files:
            failed.append((PurePosixPath(path).stem if cell_id == "*" else cell_id, f"nothing to read at {path}"))
        rows += [(f, unquote(PurePosixPath(f).stem) if cell_id == "*" else cell_id, float(cell.nominal_capacity_ah), cell.capacity_unit, cell.current_unit, cell.time_unit) for f in files]
    found = readers.columns_of(spark, [r[0] for r in rows])
    alike: dict[tuple, list[str]] = {}
    for f, cell_id, *_ in rows:
        if isinstance(found[f], str):
            failed.append((cell_id, found[f]))
        elif missing := ingest.missing_columns(found[f][1], job.parsing):
            failed.append((cell_id, f"required columns are missing: {missing}"))
        else:
            alike.setdefault((PurePosixPath(f).suffix.lower(), found[f][0], tuple(found[f][1])), []).append(f)
    table = spark.createDataFrame(rows, "file string, cell_id string, nominal_ah double, capacity_unit string, current_unit string, time_unit string")
    return table, alike, failed


def samples_of(spark: SparkSession, job: Job, damaged: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Samples of all cells, and (cell_id, error) of those that can't be read. Files of one format and header are read
    together, so the plan grows with the kinds of files and not with the cells. A cell with a file in `damaged` fails as a
    whole."""
    table, alike, failed = files_table(spark, job)
    if damaged:
        cell_of = {r.file: r.cell_id for r in table.select("file", "cell_id").collect()}  # a row for each file
        failed += [(cell_of[f], why) for f, why in damaged.items()]
        lost = {cell_of[f] for f in damaged}
        alike = {kind: kept for kind, files in alike.items() if (kept := [f for f in files if cell_of[f] not in lost])}
    units = Cell(None, F.col("capacity_unit"), F.col("current_unit"), F.col("time_unit"))
    parts = []
    for (_, delimiter, _), files in alike.items():
        own = [c for c in table.columns if c != "file"]  # what the job says of a cell goes before a file's columns of these names
        raw = join_small(readers.read_alike(spark, files, delimiter).drop(*own), table, ["file"])
        named, hints = ingest.standardised(raw, job.parsing)
        df = ingest.clean_rows(ingest.in_si_units(ingest.numeric(named), hints, units), job.parsing)
        for c in ("capacity", "cycle_index"):
            if c not in df.columns:
                df = df.withColumn(c, F.lit(None).cast("double"))
        parts.append(df.select("cell_id", "row_id", "time", "voltage", "current", "capacity", "cycle_index", "nominal_ah"))
    failures = spark.createDataFrame(failed, "cell_id string, error string")
    if not parts:
        raise ValueError(f"no cell can be read: {sorted(failed)[:5]}")
    return cycles.with_cycles(reduce(DataFrame.unionByName, parts), job.parsing), failures


def run(spark: SparkSession, job: Job) -> dict[str, DataFrame]:
    """All stages asked for, each read back from what it wrote, with `failures`, `status`, `overall` and `summary`. A cell
    that fails leaves the others as they are."""
    done: dict[str, DataFrame] = {}
    root = f"{job.output}/{job.key()}"
    half = lambda: cycles.half_cycle(done["samples"], job.features.half_cycle)

    def samples(damaged: dict[str, str] | None = None) -> DataFrame:
        rows, failures = samples_of(spark, job, damaged)
        failures.write.mode("overwrite").parquet(f"{root}/failures")
        return rows

    def write(stage: str, path: str) -> None:
        try:
            make[stage]().write.mode("overwrite").parquet(path)
        except Exception:
            # a file may be damaged behind its header; only now is it worth reading each to find out which
            damaged = readers.damaged(spark, [f for p, _ in job.cells.values() for f in readers.files_of(spark, p)]) if stage == "samples" else {}
            if not damaged:
                raise
            samples(damaged).write.mode("overwrite").parquet(path)

    def meta() -> DataFrame:
        made = cycles.cycle_meta(done["samples"], "nominal_ah", job.parsing)
        return made.join(done["samples"].groupBy("cell_id").agg(F.max("nominal_ah").alias("nominal_ah")), "cell_id")

    def feature_rows() -> DataFrame:
        made = features.feature_matrix(done["curves"], job.features)
        health = features.soh(F.col("discharge_capacity_ah"), F.col("nominal_ah")).alias("soh")
        return made.join(done["meta"].select("cell_id", F.col("cycle_index").alias("cycle_number"), health), ["cell_id", "cycle_number"], "left")

    def graded() -> DataFrame:
        grade = (F.col("c_rate_est") <= job.ica.max_c_rate_research).alias("research_grade")
        return half().join(done["meta"].select("cell_id", "cycle_index", grade), ["cell_id", "cycle_index"], "left")

    def mechanisms() -> DataFrame:
        first = features.reference_cycles(done["curves"]).withColumnRenamed("ref_cycle_index", "cycle_index")
        return curve_physics(done["curves"], done["curves"].join(first, ["cell_id", "cycle_index"]), job.features).drop("peaks", "matches")

    def reported() -> DataFrame:
        table = report.cycle_table(done["predictions"], done["physics"].drop("failed"))
        made = report.cell_summary(table, report.trends(table), model.metrics(done["predictions"]).where("cell_id IS NOT NULL"))
        return made.join(report.evidence(made), "cell_id")

    make = {
        "samples": samples,
        "meta": meta,
        "picks": lambda: cycles.pick_for_ica(done["meta"], job.ica.max_c_rate_research, job.ica.max_c_rate_fallback),
        "curves": lambda: curves.qv_curves(half(), "nominal_ah", job.features),
        "ica": lambda: curves.ica_curves(graded(), job.ica),
        "features": feature_rows,
        "predictions": lambda: model.loco_predictions(done["features"], job.net),
        "physics": mechanisms,
        "report": reported,
    }
    for stage in STAGES:
        if stage not in job.stages:
            continue
        path, began = f"{root}/{stage}", time.time()
        ready = job.resume and readers.exists(spark, f"{path}/_SUCCESS")
        if not ready:
            write(stage, path)
        done[stage] = spark.read.parquet(path)
        job.progress(stage, "resumed" if ready else "ok", time.time() - began)
    if "meta" in done:
        failures = spark.read.parquet(f"{root}/failures")
        cells = done["samples"].select("cell_id").union(failures.select("cell_id")).distinct()
        counts = summary.cell_counts(cells, done["meta"], done.get("ica"), done.get("features"))
        status = summary.stage_status(counts, failures)
        measured = model.metrics(done["predictions"]) if "predictions" in done else None
        done |= {"failures": failures, "status": status, "overall": summary.overall(status), "summary": summary.run_summary(counts, status, measured)}
    return done


_RECORD = "job string, status string, stages array<struct<stage:string,status:string,seconds:double>>, error string"


def run_recorded(spark: SparkSession, job: Job) -> dict[str, DataFrame]:
    """`run` with a record that `read_job` finds: running while it lasts, then the status of the whole, or failed with the
    error, which is raised again."""
    seen: list[tuple[str, str, float]] = []

    def record(status: str, error: str | None = None) -> None:
        spark.createDataFrame([(job.key(), status, seen, error)], _RECORD).coalesce(1).write.mode("overwrite").json(f"{job.output}/jobs/{job.key()}")

    def progress(stage: str, status: str, seconds: float) -> None:
        seen.append((stage, status, seconds))
        record("running")
        job.progress(stage, status, seconds)

    record("running")
    try:
        done = run(spark, replace(job, progress=progress))
        record(done["overall"].first()["overall_status"] if "overall" in done else "ok")
    except Exception as e:
        record("failed", str(e).splitlines()[0])
        raise
    return done


def read_job(spark: SparkSession, output: str, key: str | None = None) -> DataFrame:
    """The record of one job, or of all jobs under an output folder."""
    return spark.read.schema(_RECORD).json(f"{output}/jobs/{key or '*'}")


def write_outputs(done: dict[str, DataFrame], path: str, net: model.ElasticNet = model.ElasticNet()) -> None:
    """The features and the model's run as CSV and JSON, and the summary of the cells."""
    spark = done["features"].sparkSession
    sinks.write_csv(done["features"], f"{path}/all_features.csv")
    fitted = model.full_model(model.gram_stats(done["features"]), net)
    sinks.write_model_run(done["predictions"], model.metrics(done["predictions"]), model.importance(spark, fitted), f"{path}/model")
    sinks.write_json(done["summary"], f"{path}/summary.json")
    sinks.write_json(done["overall"], f"{path}/overall.json")
    if "report" in done:
        sinks.write_csv(done["physics"], f"{path}/physics.csv")
        sinks.write_json(done["report"], f"{path}/report.json")


def curve_physics(current: DataFrame, reference: DataFrame, cfg: Features = Features()) -> DataFrame:
    """Mechanisms of each usable curve of `current` against the one curve of its cell in `reference`, on the grid points that
    both have; curves with fewer than 20 of these, and cells without a reference, have no row."""
    ref = reference.where("ok").select("cell_id", F.col("dqdv").alias("ref_dqdv"))
    joined = current.where("ok").join(ref, "cell_id")
    both = F.filter(F.arrays_zip(F.sequence(F.lit(0), F.size("dqdv") - 1).alias("i"), F.col("dqdv").alias("now"), F.col("ref_dqdv").alias("was")), lambda p: p["now"].isNotNull() & p["was"].isNotNull())
    shared = joined.select("cell_id", F.col("cycle_index").alias("cycle_number"), both.alias("p")).where(F.size("p") >= 20)
    volts = F.transform("p.i", lambda i: F.lit(cfg.v_min) + i * F.lit(cfg.dv))
    return physics.against_reference(shared.select("cell_id", "cycle_number", volts.alias("voltage_grid"), F.col("p.now").alias("dqdv"), F.col("p.was").alias("ref_dqdv")))


def assess(current: DataFrame, reference: DataFrame, fitted: dict, cfg: Features = Features()) -> DataFrame:
    """Health, mechanisms and explanation of each curve of `current` (cell_id, cycle_index, q_smooth, dqdv, ok) against the
    one curve per cell of `reference`. Curves with fewer than 20 grid points in common have no physics; curves that
    couldn't be extracted, and those of cells without a reference, keep a row that says so."""
    ref = reference.where("ok").select("cell_id", F.col("cycle_index").alias("ref_cycle_index"), F.col("q_smooth").alias("ref_q"))
    joined = current.where("ok").join(ref, "cell_id")
    delta = joined.select("cell_id", "cycle_index", "ref_cycle_index", F.zip_with("q_smooth", "ref_q", lambda a, b: a - b).alias("dq"))
    rows = model.predictions(features.array_features(delta, cfg), fitted)
    found = curve_physics(current, reference, cfg)
    out = rows.withColumn("cell_id", F.col("cell_id").cast("string")).withColumnRenamed("cycle_index", "cycle_number").join(found.drop("peaks", "matches", "failed"), ["cell_id", "cycle_number"], "left")
    told = physics.explained(out)
    why = F.when(~F.col("ok"), F.concat(F.lit(FAILED), F.coalesce("fail_reason", F.lit("unknown")))).otherwise(F.lit(FAILED + "no reference curve"))
    lost = current.join(ref.select("cell_id", F.lit(True).alias("__ref")), "cell_id", "left").where("not ok or __ref is null")
    lost = lost.select(F.col("cell_id").cast("string").alias("cell_id"), F.col("cycle_index").alias("cycle_number"), why.alias("explanation"))
    return told.unionByName(lost, allowMissingColumns=True)


@dataclass(frozen=True)
class Predictor:
    """A fitted model with one reference curve per cell, which `with_reference` replaces."""

    fitted: dict
    cfg: Features = Features()
    reference: DataFrame | None = None

    def with_reference(self, curves_of_reference: DataFrame) -> Predictor:
        """The first usable curve of each cell of `curves_of_reference` is its reference from now on."""
        first = features.reference_cycles(curves_of_reference).withColumnRenamed("ref_cycle_index", "cycle_index")
        return replace(self, reference=curves_of_reference.join(first, ["cell_id", "cycle_index"]))

    def trajectory(self, current: DataFrame) -> DataFrame:
        """`assess` of all curves, those that fail included; ValueError without a reference."""
        if self.reference is None:
            raise ValueError("a reference is needed first")
        return assess(current, self.reference, self.fitted, self.cfg)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description="Train on cycler files and report leave-one-cell-out errors.")
    parser.add_argument("--config", help="JSON or YAML configuration")
    parser.add_argument("--dataset", help="folder of cycler files, or one file")
    parser.add_argument("--nominal-capacity", type=float)
    parser.add_argument("--output")
    parser.add_argument("--no-resume", action="store_true")
    args = parser.parse_args(argv)
    if bool(args.config) == bool(args.dataset):
        parser.error("give either --config or --dataset")
    if args.dataset and not args.nominal_capacity:
        parser.error("--dataset needs --nominal-capacity")
    dataset = {"path": args.dataset} if args.dataset and PurePosixPath(args.dataset).suffix else {"dir": args.dataset, "pattern": "*.{csv,txt,parquet,pq}"}
    config = load_config(args.config) if args.config else {"dataset": dataset}
    job = job_from_config(config, args.output, args.nominal_capacity, resume=False if args.no_resume else None)
    done = run(SparkSession.builder.getOrCreate(), job)
    write_outputs(done, job.output, job.net)
    model.metrics(done["predictions"]).show(1000, False)
    return 0 if done["overall"].first()["overall_status"] == "ok" else 1


if __name__ == "__main__":
    raise SystemExit(main())
