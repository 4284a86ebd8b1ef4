"""From raw cycler columns to canonical samples: names, units, types, cleaning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import join_small, measured
from .config import CANONICAL, REQUIRED, Cell, Parsing


def unit_hint(name: str) -> str | None:
    """Unit that a column's name ends with, if any."""
    low = name.strip().lower()
    for ending, unit in (("mah", "mAh"), ("ah", "Ah"), ("ma", "mA"), ("a", "A")):
        if low.endswith((f"/{ending}", f"({ending})")):
            return unit
    return None


def _taken(columns: list[str], cfg: Parsing) -> dict[str, str]:
    """By canonical name, the first column that stands for it."""
    taken: dict[str, str] = {}
    for name in columns:
        canonical = cfg.aliases.get(name.strip().lower())
        if canonical:
            taken.setdefault(canonical, name)
    return taken


def missing_columns(columns: list[str], cfg: Parsing = Parsing()) -> list[str]:
    taken = _taken(columns, cfg)
    return [c for c in REQUIRED if c not in taken]


def standardised(raw: DataFrame, cfg: Parsing = Parsing()) -> tuple[DataFrame, dict[str, str]]:
    """Rename vendor columns to canonical ones; the first that matches wins and all others are kept.

    Returns the table and the unit hints of the renamed columns. ValueError if a required column is missing.
    """
    if missing := missing_columns(raw.columns, cfg):
        raise ValueError(f"required columns are missing: {missing}; the table has {raw.columns}")
    taken = _taken(raw.columns, cfg)
    back = {name: canonical for canonical, name in taken.items()}
    clash = {c for c in raw.columns if c in taken and c not in back}
    out = raw.select(*[F.col(f"`{c}`").alias(back.get(c, f"raw_{c}" if c in clash else c)) for c in raw.columns])
    return out, {canonical: hint for canonical, name in taken.items() if (hint := unit_hint(name))}


def numeric(df: DataFrame, keys: tuple[str, ...] = ("cell_id",)) -> DataFrame:
    """Canonical numbers as doubles, unparsable ones as null. A `time` column of which most values are date-times, cell by
    cell, becomes seconds since the cell's first."""
    out = df
    for name in CANONICAL:
        if name in df.columns and name not in ("time", "step"):
            out = out.withColumn(name, F.col(name).try_cast("double"))
    if "time" in df.columns:
        text = F.col("time").cast("string")
        number, moment = text.try_cast("double"), F.try_to_timestamp(text)
        named = [k for k in keys if k in df.columns]
        dated = F.avg(F.when(number.isNull() & moment.isNotNull(), 1.0).otherwise(0.0)) > 0.5
        per_cell = df.groupBy(*named).agg(F.when(dated, F.min(F.unix_micros(moment))).alias("__first"))
        out = join_small(out, per_cell, named) if named else out.withColumn("__first", per_cell.scalar())
        out = out.withColumn("time", F.when(F.col("__first").isNotNull(), (F.unix_micros(moment) - F.col("__first")) / 1e6).otherwise(number))
        out = out.select(*df.columns)
    return out


def _unit(declared: str | None | Column, hint: str) -> Column:
    given = declared if isinstance(declared, Column) else F.lit(declared).cast("string")
    return F.coalesce(given, F.lit(hint))


def in_si_units(df: DataFrame, hints: dict[str, str], cell: Cell = Cell()) -> DataFrame:
    """A, Ah and s, by the cell's declared units or else the names' hints; never guessed from magnitudes.

    The cell's units may be columns, for tables that hold cells of several kinds."""
    current, capacity, time = _unit(cell.current_unit, hints.get("current", "A")), _unit(cell.capacity_unit, hints.get("capacity", "Ah")), _unit(cell.time_unit, "s")
    scale = {
        "current": F.when(current == "mA", 1e-3).otherwise(1.0), "capacity": F.when(capacity == "mAh", 1e-3).otherwise(1.0),
        "time": F.when(time == "h", 3600.0).when(time == "min", 60.0).otherwise(1.0),
    }
    return df.withColumns({c: F.col(c) * k for c, k in scale.items() if c in df.columns})


def clean_rows(df: DataFrame, cfg: Parsing = Parsing()) -> DataFrame:
    """Rows with all required values, and of the rows of a cell at one time the first by row_id."""
    good = df.withColumns({c: measured(F.col(c).cast("double")) for c in REQUIRED}).dropna(subset=list(REQUIRED))
    if not cfg.dedupe_time:
        return good
    first = Window.partitionBy("cell_id", "time").orderBy("row_id")
    return good.withColumn("__nth", F.row_number().over(first)).where("__nth = 1").drop("__nth")


def samples(raw: DataFrame, cell: Cell = Cell(), cfg: Parsing = Parsing()) -> DataFrame:
    """All of the above. `raw` needs cell_id and row_id besides the vendor's columns."""
    named, hints = standardised(raw, cfg)
    return clean_rows(in_si_units(numeric(named), hints, cell), cfg)
