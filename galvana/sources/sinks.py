"""Results as CSV and JSON: rows sorted by cell and cycle, nested columns as JSON text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.config import FEATURE_COLS, METADATA_COLS

ORDER = ("cell_id", "cycle_number", "cycle_index", "time", "row_id")


def in_order(df: DataFrame) -> DataFrame:
    """Sorted by whichever of cell, cycle and time there are; a range partitioning, so files follow one another."""
    keys = [c for c in ORDER if c in df.columns]
    return df.orderBy(*keys) if keys else df


def write_csv(df: DataFrame, path: str) -> None:
    """A folder of CSV files with headers. Arrays, maps and structs become JSON."""
    nested = {f.name: F.to_json(f.name) for f in df.schema if isinstance(f.dataType, T.ArrayType | T.MapType | T.StructType)}
    in_order(df).withColumns(nested).write.mode("overwrite").csv(path, header=True)


def write_json(df: DataFrame, path: str) -> None:
    """A folder of JSON lines; what is null is written as null."""
    in_order(df).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_model_run(predictions: DataFrame, metrics: DataFrame, importance: DataFrame, path: str) -> None:
    """Predictions and importance as CSV; metrics by cell and over all, and the schema of the features, as JSON."""
    write_csv(predictions, f"{path}/predictions.csv")
    importance.orderBy(F.desc("abs_coefficient"), "feature").write.mode("overwrite").csv(f"{path}/feature_importance.csv", header=True)
    write_json(metrics.withColumn("scope", F.when(F.col("cell_id").isNull(), "overall").otherwise("cell")), f"{path}/metrics.json")
    spark = predictions.sparkSession
    rows = [(kind, k, c) for kind, names in (("metadata", METADATA_COLS), ("feature", FEATURE_COLS)) for k, c in enumerate(names)]
    write_json(spark.createDataFrame(rows, "kind string, position int, name string").coalesce(1), f"{path}/feature_schema.json")
