"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from weakref import WeakKeyDictionary

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A relation is broadcast only when a count has shown that it has no more rows than this.
BROADCAST_ROWS = 400_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it.

    Only in local mode may that setting be missing; then a temporary folder is made and set.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="galvana-shared-")
        sc.setCheckpointDir(named)
    return named.rstrip("/")


_marked: set[str] = set()


def _own_folder(spark: SparkSession) -> str:
    """This application's folder of intermediate tables; it is deleted when the application ends."""
    sc = spark.sparkContext
    folder = f"{shared_dir(spark)}/galvana/{sc.applicationId}"
    if folder not in _marked:
        where = sc._jvm.org.apache.hadoop.fs.Path(folder)
        files = where.getFileSystem(sc._jsc.hadoopConfiguration())
        files.mkdirs(where)
        files.deleteOnExit(where)
        _marked.add(folder)
    return folder


#: Writer's options for rows of megabytes. Parquet looks at the size of a page and of a row group after 100 rows at first, so pages
#: would hold 100 such rows; its Snappy codec keeps buffers of a page's size outside the heap, for each thread and direction.
WIDE_ROWS = {"parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1", "parquet.block.size": str(4 << 20), "compression": "zstd"}


def written(df: DataFrame, label: str, wide: bool = False) -> DataFrame:
    """Cut lineage: write `df` as Parquet under the shared folder and read it back. `wide`: its rows may have megabytes."""
    spark = df.sparkSession
    path = f"{_own_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.options(**WIDE_ROWS if wide else {}).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def forget(df: DataFrame) -> None:
    """Delete the files of a table that `written` gave, once nothing reads it any more."""
    sc = df.sparkSession.sparkContext
    where = sc._jvm.org.apache.hadoop.fs.Path(_paths.pop(df))
    where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """`names`, each lengthened until `df` has no column of that name."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def small_or_shuffled(df: DataFrame, rows: int | None = None, bound: int = BROADCAST_ROWS) -> DataFrame:
    """`df` with a broadcast hint if it has at most `bound` rows; otherwise as it is, so that the join shuffles.

    `df` should be a written table of rows of a few numbers: it is counted when `rows` isn't given.
    """
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= bound else df


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """`run` for mapInArrow and the like, giving its memory back when a task ends: Spark uses a Python worker again for other
    stages, and what an allocator keeps would add up beside the executor's own."""

    def and_release(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return and_release


def arrow_map(
    df: DataFrame, per_batch: Callable[[pa.RecordBatch], pa.RecordBatch | Iterator[pa.RecordBatch]], schema: str
) -> DataFrame:
    """mapInArrow with one call for each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = per_batch(batch)
                if isinstance(out, pa.RecordBatch):
                    yield out
                else:
                    yield from out

    return df.mapInArrow(tidy(run), schema)


def utf8(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def strings(column: pa.Array) -> list[str]:
    """The strings of a column; null counts as empty."""
    return [x or "" for x in column.to_pylist()]
