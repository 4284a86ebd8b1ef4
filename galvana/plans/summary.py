"""What became of each cell in a run: stages with their status, counts, and the status of the whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cell_counts(cells: DataFrame, meta: DataFrame, ica: DataFrame | None = None, features: DataFrame | None = None) -> DataFrame:
    """Per cell of `cells` (cell_id): n_cycles_parsed, n_suitable, n_flagged, n_ica_curves, n_features_ok, flagged_cycles."""
    few = F.size("flags") > 0
    flagged = F.map_from_entries(F.array_sort(F.collect_list(F.when(few, F.struct("cycle_index", "flags")))))
    out = cells.select("cell_id").join(
        meta.groupBy("cell_id").agg(
            F.count("*").alias("n_cycles_parsed"), F.count_if("ica_suitable").alias("n_suitable"), F.count_if(few).alias("n_flagged"), flagged.alias("flagged_cycles")
        ), "cell_id", "left",
    )
    for name, df, count in (("n_ica_curves", ica, F.count("*")), ("n_features_ok", features, F.count_if("extraction_ok"))):
        if df is None:
            out = out.withColumn(name, F.lit(0).cast("long"))
        else:
            out = out.join(df.groupBy("cell_id").agg(count.alias(name)), "cell_id", "left")
    return out.fillna(0)


def stage_status(counts: DataFrame, failures: DataFrame) -> DataFrame:
    """(cell_id, stage, status, error) from `cell_counts` and (cell_id, error) of the cells that couldn't be read.

    A cell fails to parse if it couldn't be read or has no usable row, and its features fail if no cycle has any; stages
    after a failed one are skipped."""
    known = counts.join(failures.groupBy("cell_id").agg(F.min("error").alias("error")), "cell_id", "left")
    unread = F.when(F.col("error").isNotNull(), F.col("error")).when(F.col("n_cycles_parsed") == 0, "no usable rows")
    empty = F.when(F.col("n_features_ok") == 0, "no usable half-cycle")
    one = lambda stage, error, before: F.struct(
        F.lit(stage).alias("stage"), F.when(before.isNotNull(), "skipped").when(error.isNotNull(), "failed").otherwise("ok").alias("status"),
        F.when(before.isNull(), error).alias("error"),
    )
    nothing = F.lit(None).cast("string")
    stages = F.array(one("parse", unread, nothing), one("ica", nothing, unread), one("features", empty, unread))
    return known.select("cell_id", F.explode(stages).alias("s")).select("cell_id", "s.*")


def overall(status: DataFrame) -> DataFrame:
    """One row: n_cells, n_failed and overall_status, which is failed if all cells have a failed stage, partial if some."""
    per = status.groupBy("cell_id").agg(F.bool_or(F.col("status") == "failed").alias("failed"))
    out = per.agg(F.count("*").alias("n_cells"), F.count_if("failed").alias("n_failed"))
    return out.withColumn("overall_status", F.when(F.col("n_failed") == 0, "ok").when(F.col("n_failed") == F.col("n_cells"), "failed").otherwise("partial"))


def run_summary(counts: DataFrame, status: DataFrame, metrics: DataFrame | None = None) -> DataFrame:
    """One row per cell: its counts, flagged cycles, stages and metrics."""
    stages = status.groupBy("cell_id").agg(F.collect_list(F.struct("stage", "status", "error")).alias("stages"))
    out = counts.join(stages, "cell_id", "left")
    return out if metrics is None else out.join(metrics.where("cell_id IS NOT NULL").select("cell_id", "rmse", "mae", "r2"), "cell_id", "left")
