"""Sharding along a Hilbert curve over quantised metadata.

Three dimensions, numbers or strings, are quantised by their own quantiles to CODE_BITS bits each, a cell of that grid has a place on
the Hilbert curve, and documents are ordered by that place. Equal runs of the order are the shards, so each shard covers
a compact region and its minima and maxima prune reads in every dimension. Only DataFrame functions are used.

The global position of a row is (rows of earlier cells) + (rows of earlier salts of its cell) + (its row number within
its cell and salt). Cells are bounded in number by the grid; the salts of a cell grow with the table, so that a cell with
a third of all rows is still numbered by many tasks. Only ids, sizes and codes are shuffled, never texts.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, written

CODE_BITS = 4
DIMENSIONS = 3
SHARDS = 16
#: Rows for each salt of a cell that holds all rows.
ROWS_A_SALT = 1 << 17
MIN_SALTS = 64
PERCENTILE_ACCURACY = 2000


@lru_cache
def curve(bits: int = CODE_BITS, dims: int = DIMENSIONS) -> list[int]:
    """Place on the Hilbert curve of each grid cell; a cell's number has its codes as base-2**bits digits.

    Skilling's transform: undo the excess work bit by bit, then Gray-encode and interleave the bits.
    """
    places = []
    for cell in range(1 << bits * dims):
        x = [cell >> bits * (dims - 1 - d) & (1 << bits) - 1 for d in range(dims)]
        q = 1 << bits - 1
        while q > 1:
            for d in range(dims):
                if x[d] & q:
                    x[0] ^= q - 1
                else:
                    t = (x[0] ^ x[d]) & (q - 1)
                    x[0] ^= t
                    x[d] ^= t
            q >>= 1
        for d in range(1, dims):
            x[d] ^= x[d - 1]
        t, q = 0, 1 << bits - 1
        while q > 1:
            if x[dims - 1] & q:
                t ^= q - 1
            q >>= 1
        place = 0
        for b in reversed(range(bits)):
            for d in range(dims):
                place = place << 1 | (x[d] ^ t) >> b & 1
        places.append(place)
    return places


def default_dimensions(docs: DataFrame, text_col: str) -> list[Column]:
    """Language, source and length; a column that the table lacks is replaced by the text's length."""
    length = F.length(F.coalesce(F.col(text_col), F.lit(""))).cast("long")
    return [*(F.col(c) if c in docs.columns else length for c in ("lang", "source")), length]


def _string_code(rows: DataFrame, name: str) -> Column:
    """Level of a string among the table's values: a value's level is the share of rows that come before it, times the levels.

    Rows are counted by value first, so a frequent value is one row of a few counts; the counts are summed up over ranges of
    values. The driver gets a total for each range and the end of each level.
    """
    levels = 1 << CODE_BITS
    counts = rows.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("value")).agg(F.count("*").alias("m"))
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = written(counts.repartitionByRange(ranges, "value").withColumn("range", F.spark_partition_id()), "value-counts")
    totals = {r["range"]: r["m"] for r in counts.groupBy("range").agg(F.sum("m").alias("m")).collect()}
    n, begins, begin = sum(totals.values()), [], 0
    for r in sorted(totals):
        begins.append((r, begin))
        begin += totals[r]
    if not n:
        return F.lit(0)
    starts = rows.sparkSession.createDataFrame(begins, "range int, begin long")
    earlier = Window.partitionBy("range").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("begin") + F.coalesce(F.sum("m").over(earlier), F.lit(0))
    level = counts.join(F.broadcast(starts), "range").select("value", F.floor(before * levels / n).cast("int").alias("level"))
    ends = level.groupBy("level").agg(F.max("value").alias("end")).orderBy("level").collect()  # at most one for each level
    below = F.lit(ends[-1]["level"])
    for r in reversed(ends[:-1]):
        below = F.when(F.col(name) <= F.lit(r["end"]), r["level"]).otherwise(below)
    return F.when(F.col(name).isNull(), 0).otherwise(below).cast("int")


def _placed(docs: DataFrame, id_col: str, text_col: str, dimensions: list[Column] | None, shards: int, rows_a_salt: int) -> DataFrame:
    dims = dimensions or default_dimensions(docs, text_col)
    if len(dims) != DIMENSIONS:
        raise ValueError(f"{DIMENSIONS} dimensions are needed")
    names = [f"d{k}" for k in range(DIMENSIONS)]
    kinds = dict(docs.select(*[d.alias(n) for d, n in zip(dims, names, strict=True)]).dtypes)
    text = F.coalesce(F.col(text_col), F.lit(""))
    data = F.encode(text, "UTF-8")
    rows = written(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            (F.length(data).cast("long") + 1).alias("size"),
            F.crc32(data).alias("text_crc32"),
            F.xxhash64(text).alias("key"),
            *[(d if kinds[n] == "string" else d.cast("long")).alias(n) for d, n in zip(dims, names, strict=True)],
        ),
        "shard-rows",
    )
    levels = 1 << CODE_BITS
    at = [k / levels for k in range(1, levels)]
    numbers = [n for n in names if kinds[n] != "string"]
    cuts = rows.agg(F.count("*").alias("n"), *[F.percentile_approx(n, at, PERCENTILE_ACCURACY).alias(n) for n in numbers]).first()
    n = cuts["n"]
    code = F.lit(0)
    for name in names:
        if name in numbers:
            own = sum((F.when(F.col(name) > F.lit(c), 1).otherwise(0) for c in cuts[name] or []), F.lit(0))
        else:
            own = _string_code(rows, name)
        code = code * levels + own
    salts = max(MIN_SALTS, -(-n // rows_a_salt))
    table = F.array(*[F.lit(p) for p in curve()])
    keyed = rows.select(
        "doc_id", "size", "text_crc32", "key", F.element_at(table, (code + 1).cast("int")).cast("int").alias("curve_place"),
        F.xxhash64("text_crc32", "size", "doc_id").alias("tie"),
    ).withColumn("salt", F.pmod(F.shiftright("tie", 7), F.lit(salts)).cast("int"))
    keyed = written(keyed, "shard-keys")
    counts = keyed.groupBy("curve_place", "salt").agg(F.count("*").alias("m"))
    cells = counts.groupBy("curve_place").agg(F.sum("m").alias("m"))  # at most as many rows as the grid has cells
    earlier = Window.orderBy("curve_place").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("curve_place", F.coalesce(F.sum("m").over(earlier), F.lit(0)).alias("cell_start"))
    within = Window.partitionBy("curve_place").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("salt_start", F.coalesce(F.sum("m").over(within), F.lit(0))).join(F.broadcast(cells), "curve_place")
    order = Window.partitionBy("curve_place", "salt").orderBy("tie", "doc_id", "text_crc32", "size", "key")
    numbered = keyed.withColumn("nth", F.row_number().over(order)).join(
        starts.select("curve_place", "salt", (F.col("cell_start") + F.col("salt_start")).alias("start")), ["curve_place", "salt"]
    )
    place = F.col("start") + F.col("nth") - 1
    shard = F.expr(f"cast((place * {shards}) div {max(n, 1)} as int)")
    first = F.expr(f"(cast(shard as long) * {max(n, 1)} + {shards - 1}) div {shards}")
    return (
        numbered.withColumn("place", place)
        .withColumn("shard", shard)
        .withColumn("slot", F.col("place") - first)
        .select("doc_id", "size", "text_crc32", "key", "curve_place", "shard", "slot")
    )


def placed(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    dimensions: list[Column] | None = None,
    shards: int = SHARDS,
    rows_a_salt: int = ROWS_A_SALT,
) -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, curve_place, shard, slot.

    Shards are runs of the curve's order, and their row counts differ by at most one; slots are gapless from 0 in each.
    A null text has size 1 (no bytes, plus one) and CRC 0; a null in a dimension has code 0; ties of a place are ordered
    by a hash of the row and then by id, so repeated rows get slots of their own. An empty table gives an empty one, and
    fewer rows than shards leave some shards empty. Other columns don't matter. Dimensions are numbers or strings.
    """
    return _placed(docs, id_col, text_col, dimensions, shards, rows_a_salt).drop("key")


def assignments(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """`placed` with the law it keeps: `rows`, counts at most one apart. Growing by a shard moves runs, so grown_shard
    is null."""
    return placed(docs, shards=shards).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
        "curve_place",
    )


def write_shards(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS) -> DataFrame:
    """Write the table as Parquet, one folder per shard, rows in the curve's order; returns a manifest with each shard's
    rows, bytes, and the minimum and maximum of the pruning columns. Every row is written once: rows that repeat an id, and
    those with a null one, are told apart by their text, and equal ones are counted off against the places they have."""
    own_id, key, nth, slot, size = fresh(docs, "own_id", "own_key", "own_nth", "own_slot", "own_size")
    count_off = F.row_number().over(Window.partitionBy(own_id, key).orderBy(F.lit(0)))
    found = _placed(docs, id_col, text_col, None, shards, ROWS_A_SALT).select(
        F.col("doc_id").alias(own_id), F.col("key").alias(key), F.col("shard").alias("__shard"), F.col("slot").alias(slot), F.col("size").alias(size)
    )
    found = written(found.withColumn(nth, F.row_number().over(Window.partitionBy(own_id, key).orderBy("__shard", slot))), "shard-places")
    rows = docs.withColumns({own_id: F.col(id_col).cast("long"), key: F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))}).withColumn(nth, count_off)
    same = rows[own_id].eqNullSafe(found[own_id]) & (rows[key] == found[key]) & (rows[nth] == found[nth])
    joined = rows.join(found, same).select(*[rows[c] for c in docs.columns], "__shard", slot, size)
    joined.repartition("__shard", F.expr(f"`{slot}` div 100000")).sortWithinPartitions("__shard", slot).drop(slot, size).write.partitionBy("__shard").parquet(path)
    ranged = [c for c in ("lang", "source", "n_chars") if c in docs.columns]
    sizes = found.groupBy(F.col("__shard").alias("shard")).agg(F.count("*").alias("rows"), F.sum(size).alias("bytes"))
    kept = docs.sparkSession.read.parquet(path).groupBy(F.col("__shard").alias("shard"))
    ranges = kept.agg(*[f(c).alias(f"{name}_{c}") for c in ranged for name, f in (("min", F.min), ("max", F.max))]) if ranged else None
    return sizes if ranges is None else sizes.join(ranges, "shard")
