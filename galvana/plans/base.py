"""Battery-like tables derived from the driver's tables, as DataFrames and as the same SQL.

events: a cell is user_id % 8, the current is the value signed by the event type, the voltage follows from the value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cycles as C

NOMINAL_AH = 50.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    value, kind = F.col("value"), F.col("event_type")
    current = F.when(kind.isin("purchase", "view"), value).when(kind == "error", F.lit(0.0)).otherwise(-value)
    return table(spark, sf_dir, "events").select(
        (F.col("user_id") % 8).alias("cell_id"), F.col("event_id").alias("row_id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("time"),
        kind.alias("step"), current.alias("current"), (F.lit(2.5) + value % 170 / 100).alias("voltage"),
    )


def cycled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.with_cycles(samples(spark, sf_dir))


def discharge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.half_cycle(cycled(spark, sf_dir), "discharge")


def meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.cycle_meta(cycled(spark, sf_dir), NOMINAL_AH)


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A health curve over the detected cycles, and a prediction that is off by a share of the voltage range."""
    true = 1 - F.col("cycle_index") * 0.001
    return meta(spark, sf_dir).select(
        "cell_id", F.col("cycle_index").alias("cycle_number"), true.alias("y_true"), (true + (F.col("voltage_range") - 1.0) * 0.05).alias("y_pred")
    )


def physics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mechanism metrics of each cycle."""
    return meta(spark, sf_dir).select(
        "cell_id", F.col("cycle_index").alias("cycle_number"), (F.col("cycle_index") * 0.0001 + (F.col("voltage_min") - 2.6) * 0.01).alias("LLI_mean_shift"),
        (F.col("n_points") % 4).alias("LLI_n_disappeared"), (F.col("n_points") % 10 / 10).alias("LLI_confidence"),
        (F.col("n_points") % 5 / 10).alias("LLI_disappearance_penalty"), (F.col("cycle_index") * 0.001).alias("LAM_loss"),
        (F.col("voltage_max") - 3.9).alias("Resistance_growth"), "n_points",
    )


def physics_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same where a cycle has points enough for a curve; other cycles have no physics."""
    return physics(spark, sf_dir).where("n_points >= 4").drop("n_points")


def binned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cell_id, cycle_index, grid_idx, q): charge of each voltage bin of a discharge."""
    bin_of = F.floor((F.col("voltage") - 2.5) * 10).cast("int")
    return discharge(spark, sf_dir).groupBy("cell_id", "cycle_index", bin_of.alias("grid_idx")).agg((F.sum(F.abs("current")) / 1000).alias("q"))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cell_id, cycle_number, soh, f1..f3): numbers of each cycle that a model can use; f3 is missing now and then."""
    return meta(spark, sf_dir).select(
        "cell_id", F.col("cycle_index").alias("cycle_number"), (1 - F.col("cycle_index") * 0.001).alias("soh"), F.col("voltage_range").alias("f1"),
        F.log(F.col("duration_s") + 1).alias("f2"), F.when(F.col("n_points") % 7 != 0, F.col("c_rate_est")).alias("f3"),
    )


_W = "OVER (PARTITION BY cell_id ORDER BY time, row_id ROWS UNBOUNDED PRECEDING)"
#: The same tables for DuckDB; a query's text follows after the name of the last table that it needs.
SQL = {
    "samples": """samples AS (
  SELECT user_id % 8 AS cell_id, event_id AS row_id, epoch_us(ts) / 1e6 AS time, event_type AS step,
    CASE WHEN event_type IN ('purchase', 'view') THEN value WHEN event_type = 'error' THEN 0.0 ELSE -value END AS current,
    2.5 + (value % 170) / 100 AS voltage FROM events)""",
    "cycled": f"""signed AS (
  SELECT *, CASE WHEN current > 1e-4 THEN 1 WHEN current < -1e-4 THEN -1 ELSE 0 END AS sgn FROM samples),
phased AS (SELECT * EXCLUDE (sgn), coalesce(last_value(nullif(sgn, 0) IGNORE NULLS) {_W}, 0) AS phase FROM signed),
opened AS (
  SELECT *, CASE WHEN lag(phase) OVER (PARTITION BY cell_id ORDER BY time, row_id) = -1 AND phase = 1 THEN 1 ELSE 0 END AS opens FROM phased),
cycled AS (SELECT * EXCLUDE (opens), CAST(sum(opens) {_W} AS INTEGER) AS cycle_index FROM opened)""",
    "discharge": "discharge AS (SELECT * FROM cycled WHERE phase = -1)",
    "meta": f"""stepped AS (
  SELECT *, abs(current) AS amps, (abs(current) + lag(abs(current)) OVER h) / 2 * (time - lag(time) OVER h) / 3600 AS area
  FROM cycled WINDOW h AS (PARTITION BY cell_id, cycle_index, phase ORDER BY time, row_id)),
sized AS (
  SELECT cell_id, cycle_index, count(*) AS n_points, max(time) - min(time) AS duration_s, min(voltage) AS voltage_min,
    max(voltage) AS voltage_max, max(voltage) - min(voltage) AS voltage_range,
    coalesce(sum(CASE WHEN phase = 1 THEN area END), 0.0) AS charge_capacity_ah,
    coalesce(sum(CASE WHEN phase = -1 THEN area END), 0.0) AS discharge_capacity_ah,
    coalesce(avg(CASE WHEN amps > 0 THEN amps END) / {NOMINAL_AH}, 0.0) AS c_rate_est
  FROM stepped GROUP BY ALL),
meta AS (SELECT *, c_rate_est <= 0.1 AS ica_suitable, c_rate_est >= 1.0 AS fast_charge FROM sized)""",
    "predictions": """predictions AS (
  SELECT cell_id, cycle_index AS cycle_number, 1 - cycle_index * CAST(0.001 AS DOUBLE) AS y_true,
    1 - cycle_index * CAST(0.001 AS DOUBLE) + (voltage_range - CAST(1.0 AS DOUBLE)) * CAST(0.05 AS DOUBLE) AS y_pred FROM meta)""",
    "physics": """physics AS (
  SELECT cell_id, cycle_index AS cycle_number, cycle_index * CAST(0.0001 AS DOUBLE) + (voltage_min - CAST(2.6 AS DOUBLE)) * CAST(0.01 AS DOUBLE) AS LLI_mean_shift,
    n_points % 4 AS LLI_n_disappeared, (n_points % 10) / CAST(10 AS DOUBLE) AS LLI_confidence,
    (n_points % 5) / CAST(10 AS DOUBLE) AS LLI_disappearance_penalty, cycle_index * CAST(0.001 AS DOUBLE) AS LAM_loss,
    voltage_max - CAST(3.9 AS DOUBLE) AS Resistance_growth, n_points FROM meta)""",
    "physics_known": "physics_known AS (SELECT * EXCLUDE (n_points) FROM physics WHERE n_points >= 4)",
    "binned": """binned AS (
  SELECT cell_id, cycle_index, CAST(floor((voltage - 2.5) * 10) AS INTEGER) AS grid_idx, sum(abs(current)) / 1000 AS q FROM discharge GROUP BY ALL)""",
    "features": """features AS (
  SELECT cell_id, cycle_index AS cycle_number, 1 - cycle_index * CAST(0.001 AS DOUBLE) AS soh, voltage_range AS f1, ln(duration_s + 1) AS f2,
    CASE WHEN n_points % 7 <> 0 THEN c_rate_est END AS f3 FROM meta)""",
}
_NEEDS = {
    "samples": [], "cycled": ["samples"], "discharge": ["cycled"], "meta": ["cycled"], "predictions": ["meta"], "physics": ["meta"], "physics_known": ["physics"],
    "binned": ["discharge"], "features": ["meta"],
}


def with_tables(names: str, body: str) -> str:
    """A DuckDB query over the named tables; what they need comes first."""
    order: list[str] = []

    def add(n: str) -> None:
        for m in _NEEDS[n]:
            add(m)
        if n not in order:
            order.append(n)

    for n in names.split():
        add(n)
    more = body.lstrip().removeprefix("+")
    recursive = "RECURSIVE " if "RECURSIVE_ " in more else ""
    return f"WITH {recursive}" + ",\n".join(SQL[n] for n in order) + (",\n" if body.lstrip().startswith("+") else "\n") + more.replace("RECURSIVE_ ", "")
