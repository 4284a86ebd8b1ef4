"""Views for a dashboard: signals, dominant mechanism, phases, onsets, end of life, batch average."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ONSET = 0.16
END_OF_LIFE = 0.80
POINTS = 81


def in_order():
    return Window.partitionBy("cell_id").orderBy("cycle_number")


def signals(physics: DataFrame) -> DataFrame:
    """sig_LLI, sig_LAM, sig_RES between 0 and 1, the dominant mechanism (EARLY while all are small) and its confidence."""
    c = lambda n: F.coalesce(F.col(n).cast("double"), F.lit(0.0))
    lli = F.least(F.lit(1.0), F.abs(c("LLI_mean_shift")) / 0.05) * F.greatest(F.lit(0.3), c("LLI_confidence"))
    lam = F.least(F.lit(1.0), F.greatest(c("LAM_loss"), F.lit(0.0)) * 2)
    res = F.least(F.lit(1.0), F.greatest(c("Resistance_growth"), F.lit(0.0)))
    out = physics.withColumns({"sig_LLI": lli, "sig_LAM": lam, "sig_RES": res})
    return with_dominant(out)


def with_dominant(df: DataFrame) -> DataFrame:
    lli, lam, res = (F.col(f"sig_{m}") for m in ("LLI", "LAM", "RES"))
    total = lli + lam + res + 1e-9
    dominant = F.when(total < 0.05, "EARLY").when((lli >= lam) & (lli >= res), "LLI").when(lam >= res, "LAM").otherwise("RES")
    confidence = F.least(F.lit(0.97), F.greatest(lli, lam, res) / total * 0.6 + 0.35)
    return df.withColumns({"dominant": dominant, "confidence": confidence})


def _islands(df: DataFrame, starts: Column, name: str) -> DataFrame:
    so_far = in_order().rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("__starts", starts.cast("int")).withColumn(name, F.sum("__starts").over(so_far)).drop("__starts")


def phase_segments(df: DataFrame) -> DataFrame:
    """(cell_id, phase, mech, start_cycle, end_cycle, soh_start, soh_end, n) of (cell_id, cycle_number, dominant, soh).

    Runs of one dominant mechanism; a run of fewer than three cycles joins the phase before it unless it is EARLY or the
    first. Phases that become neighbours that way stay apart.
    """
    changed = F.coalesce(F.col("dominant") != F.lag("dominant").over(in_order()), F.lit(True))
    runs = _islands(df, changed, "run")
    size = F.count(F.lit(1)).over(Window.partitionBy("cell_id", "run"))
    sized = runs.withColumn("__size", size)
    opens = F.coalesce(F.col("run") != F.lag("run").over(in_order()), F.lit(True)) & ((F.col("run") == 1) | (F.col("__size") >= 3) | (F.col("dominant") == "EARLY"))
    phased = _islands(sized, opens, "phase")
    return phased.groupBy("cell_id", "phase").agg(
        F.min_by("dominant", "cycle_number").alias("mech"), F.min("cycle_number").alias("start_cycle"), F.max("cycle_number").alias("end_cycle"),
        F.min_by("soh", "cycle_number").alias("soh_start"), F.max_by("soh", "cycle_number").alias("soh_end"), F.count("*").alias("n"),
    )


def cell_dominant(phases: DataFrame) -> DataFrame:
    """The mechanism of the last phase that isn't EARLY, or LLI."""
    named = F.when(F.col("mech") != "EARLY", F.col("phase"))
    return phases.groupBy("cell_id").agg(F.coalesce(F.max_by("mech", named), F.lit("LLI")).alias("dominant"))


def onsets(df: DataFrame) -> DataFrame:
    """Per cell and mechanism the first cycle whose signal exceeds the onset level."""
    return df.groupBy("cell_id").agg(*[F.min(F.when(F.col(f"sig_{m}") > ONSET, F.col("cycle_number"))).alias(f"onset_{m}") for m in ("LLI", "LAM", "RES")])


def eol_cycle(df: DataFrame, limit: float = END_OF_LIFE) -> DataFrame:
    """Per cell the cycle at which predicted health falls to the limit, between the cycles around the first crossing; the
    first cycle doesn't count as one. Cells that never cross have none."""
    before, cycle_before = F.lag("soh_pred").over(in_order()), F.lag("cycle_number").over(in_order())
    steps = df.withColumns({"__before": before, "__cycle": cycle_before}).where(F.col("__before").isNotNull() & (F.col("soh_pred") <= limit))
    share = (limit - F.col("__before")) / (F.col("soh_pred") - F.col("__before") + 1e-9)
    at = (F.col("__cycle") + share * (F.col("cycle_number") - F.col("__cycle"))).cast("int")
    return steps.groupBy("cell_id").agg(F.min_by(at, "cycle_number").alias("eol_cycle"))


def on_cycles(df: DataFrame, columns: list[str], cycles: Column) -> DataFrame:
    """(cell_id, k, cycle, columns): values of each cell at the given array of cycles, linear between its own and held
    beyond its ends. Each row is exploded into the requested cycles of its segment."""
    nxt = {f"__next_{c}": F.lead(c).over(in_order()) for c in ("cycle_number", *columns)}
    first = F.row_number().over(in_order()) == 1
    rows = df.withColumns(nxt | {"__first": first})
    here, after = F.col("cycle_number"), F.col("__next_cycle_number")
    asked = F.filter(F.transform(cycles, lambda c, k: F.struct(k.alias("k"), c.alias("cycle"))), lambda s: ((s["cycle"] >= here) | F.col("__first")) & (after.isNull() | (s["cycle"] < after)))
    seg = rows.withColumn("__s", F.explode(asked))
    share = F.when(after.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), (F.col("__s.cycle") - here) / (after - here)))
    value = lambda c: F.col(c) + share * F.coalesce(F.col(f"__next_{c}") - F.col(c), F.lit(0.0))
    return seg.select("cell_id", F.col("__s.k").alias("k"), F.col("__s.cycle").alias("cycle"), *[value(c).alias(c) for c in columns])


def batch_average(df: DataFrame, columns: list[str], points: int = POINTS) -> DataFrame:
    """(k, cycle, columns): the mean over cells at evenly spaced cycles up to the mean of their last cycles."""
    last = df.groupBy("cell_id").agg(F.max("cycle_number").alias("last")).agg(F.floor(F.avg("last")).alias("top"))
    grid = last.select(F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda k: F.bround(k / F.lit(float(points - 1)) * F.col("top"), 0).cast("int")).alias("__grid"))
    joined = df.withColumn("__grid", grid.scalar())
    return on_cycles(joined, columns, F.col("__grid")).groupBy("k", "cycle").agg(*[F.avg(c).alias(c) for c in columns])


def _listed(*columns) -> Column:
    return F.array_sort(F.collect_list(F.struct(*columns)))


def _mechanism_rows() -> Column:
    probabilities = F.struct(*[(F.col(f"sig_{m}") / (F.col("sig_LLI") + F.col("sig_LAM") + F.col("sig_RES") + 1e-9)).alias(m) for m in ("LLI", "LAM", "RES")])
    signals = F.struct(*[F.col(f"sig_{m}").alias(m) for m in ("LLI", "LAM", "RES")])
    return _listed(
        F.col("cycle_number").alias("cycle"), F.col("soh_true").alias("sohTrue"), F.col("soh_pred").alias("sohPred"), signals.alias("signals"),
        probabilities.alias("probs"), F.col("dominant"), F.col("confidence").alias("conf"),
    )


def views(df: DataFrame, limit: float = END_OF_LIFE) -> DataFrame:
    """One row for each cell of (cell_id, cycle_number, soh_true, soh_pred, sig_*, dominant, confidence): its rows in cycle
    order, phases, onsets, end of life and dominant mechanism. A cell's cycles are few enough for one row."""
    phases = phase_segments(df.withColumn("soh", F.col("soh_true")))
    listed = phases.groupBy("cell_id").agg(
        _listed("phase", "mech", F.col("start_cycle").alias("start"), F.col("end_cycle").alias("end"), F.col("soh_start").alias("sohStart"), F.col("soh_end").alias("sohEnd")).alias("phases")
    )
    rows = df.groupBy("cell_id").agg(
        F.count("*").alias("nCycles"), F.max("cycle_number").alias("maxCycle"), F.max_by("soh_true", "cycle_number").alias("sohLast"), _mechanism_rows().alias("rows")
    )
    starts = onsets(df).select("cell_id", F.struct(*[F.col(f"onset_{m}").alias(m) for m in ("LLI", "LAM", "RES")]).alias("onsets"))
    out = rows
    for part in (listed, starts, eol_cycle(df, limit).withColumnRenamed("eol_cycle", "rul"), cell_dominant(phases).withColumnRenamed("dominant", "cellDominant")):
        out = out.join(part, "cell_id", "left")
    return out.withColumn("eol", F.lit(limit))


def cell_json(df: DataFrame, metrics: DataFrame | None = None) -> DataFrame:
    """(cell_id, body): `views` of each cell, with its metrics (cell_id, rmse, mae, r2) if given, as JSON."""
    out = views(df)
    if metrics is not None:
        of = metrics.where("cell_id IS NOT NULL").select("cell_id", F.struct(F.round("r2", 4).alias("r2"), F.round("rmse", 5).alias("rmse"), F.round("mae", 5).alias("mae")).alias("metrics"))
        out = out.join(of, "cell_id", "left")
    return out.select("cell_id", F.to_json(F.struct(*[c for c in out.columns if c != "cell_id"]), {"ignoreNullFields": "false"}).alias("body"))


#: Fixed value: the name of the average of all cells.
BATCH = "Batch average"


def batch_json(df: DataFrame, points: int = POINTS) -> DataFrame:
    """One row (cell_id, body) like `cell_json` for the average cell: health and signals averaged on common cycles, the
    mechanism worked out anew from the averages."""
    columns = ["soh_true", "soh_pred", "sig_LLI", "sig_LAM", "sig_RES"]
    mean = with_dominant(batch_average(df, columns, points)).withColumn("cell_id", F.lit(BATCH)).withColumnRenamed("cycle", "cycle_number")
    return cell_json(mean.dropDuplicates(["cell_id", "cycle_number"]).drop("k"))
