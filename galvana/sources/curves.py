"""Tables of incremental-capacity curves: validation, Parquet with native arrays, older files with binary arrays."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = ("cell_id", "cycle_number", "capacity_ah", "is_reference", "ref_cycle_number", "temperature", "protocol", "grid_spacing_mv", "voltage_grid", "dqdv")


def violations(curves: DataFrame) -> dict[str, int]:
    """Counts of what is wrong with a curve table: repeated keys, empty or differing grids, lengths that disagree, values
    that aren't finite. One aggregation; six numbers reach the driver."""
    missing = [c for c in COLUMNS if c not in curves.columns]
    if missing:
        raise ValueError(f"curve table lacks {missing}")
    bad = lambda a: F.exists(a, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    row = curves.agg(
        (F.count("*") - F.count_distinct("cell_id", "cycle_number")).alias("repeated keys"), count(F.size("voltage_grid") == 0).alias("empty grids"),
        F.greatest(F.count_distinct(F.size("voltage_grid")) - 1, F.lit(0)).alias("differing grid lengths"),
        count(F.size("voltage_grid") != F.size("dqdv")).alias("lengths that disagree"), count(bad("voltage_grid")).alias("grids not finite"), count(bad("dqdv")).alias("curves not finite"),
    ).first()
    return {k: v for k, v in row.asDict().items() if v}


def validate(curves: DataFrame) -> DataFrame:
    found = violations(curves)
    if found:
        raise ValueError(f"curve table has {found}")
    return curves


def save(curves: DataFrame, path: str) -> None:
    validate(curves).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    """A curve table; arrays that an older file holds as little-endian doubles in binary columns are decoded."""
    df = spark.read.parquet(path)
    kinds = dict(df.dtypes)

    @F.pandas_udf("array<double>")
    def decoded(data: pd.Series) -> pd.Series:
        return data.map(lambda b: None if b is None else np.frombuffer(b, "<f8"))

    old = {c: decoded(c) for c in ("voltage_grid", "dqdv") if kinds.get(c) == "binary"}
    return validate(df.withColumns(old).drop("_grid_length"))
