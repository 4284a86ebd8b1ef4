"""Reading raw cycler files as DataFrames with cell_id and row_id."""

from __future__ import annotations

import csv
import json
import re
from collections.abc import Callable
from pathlib import PurePosixPath
from urllib.parse import unquote, urlparse

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that may separate the columns of a text file.
DELIMITERS = ",;\t|"


#: Bytes of a text file that are read for its header.
HEAD_BYTES = 1 << 16


def delimiter_of(lines: list[str]) -> str:
    """What separates the columns of a text file, from its first lines."""
    try:
        return csv.Sniffer().sniff("\n".join(lines), DELIMITERS).delimiter
    except csv.Error:
        return ","


def sniffed_delimiter(spark: SparkSession, path: str) -> str:
    """The delimiter of a text file; only its first lines reach the driver."""
    lines = [r.value for r in spark.read.text(path).limit(5).collect()]
    if not lines:
        raise ValueError(f"{path} is empty")
    return delimiter_of(lines)


def read_text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, sep=sniffed_delimiter(spark, path))


def read_feather(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Arrow IPC files, a task for each file, with the `file` that a row comes from; the first file's schema counts."""
    import pyarrow as pa
    import pyarrow.feather as feather

    files = spark.read.format("binaryFile").load(path)
    first = files.select("content").first()
    if first is None:
        raise FileNotFoundError(path)
    schema = spark.createDataFrame(feather.read_table(pa.BufferReader(bytes(first.content))).slice(0, 0)).schema
    names = list(schema.names)

    def run(batches):
        for batch in batches:
            for content, name in zip(batch.column(0), batch.column(1), strict=True):
                for part in feather.read_table(pa.BufferReader(content.as_buffer())).select(names).to_batches():
                    yield pa.record_batch([*part.columns, pa.array([name.as_py()] * part.num_rows)], [*names, "file"])

    spelt = F.regexp_replace("path", "^file:/+", "file:///")
    return files.select("content", spelt.alias("file")).mapInArrow(run, schema.add("file", "string"))


FORMATS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    ".parquet": lambda s, p: s.read.parquet(p),
    ".pq": lambda s, p: s.read.parquet(p),
    ".orc": lambda s, p: s.read.orc(p),
    ".json": lambda s, p: s.read.json(p),
    ".csv": read_text,
    ".txt": read_text,
    ".feather": lambda s, p: read_feather(s, p).drop("file"),
}


def read_raw(spark: SparkSession, path: str, cell_id: str | None = None) -> DataFrame:
    """A raw file or folder by its extension, with cell_id (the file's stem by default) and a row_id in file order.

    ValueError for an unknown extension or a file without rows; a missing path is Spark's own error.
    """
    kind = PurePosixPath(path).suffix.lower()
    if kind in (".xlsx", ".xls"):
        raise ValueError("spreadsheets need a reader that isn't installed; export them as CSV")
    if kind not in FORMATS:
        raise ValueError(f"unknown extension {kind!r}; known: {sorted(FORMATS)}")
    df = FORMATS[kind](spark, path)
    if df.limit(1).count() == 0:
        raise ValueError(f"{path} has no rows")
    stem = F.lit(cell_id) if cell_id else F.regexp_extract(F.input_file_name(), r"([^/]+)\.[^./]+$", 1) if kind != ".feather" else F.lit(PurePosixPath(path).stem)
    return df.withColumns({"cell_id": stem, "row_id": F.monotonically_increasing_id()})


def _file_name():
    """The file of a row, spelt as `files_of` spells it."""
    return F.regexp_replace("_metadata.file_path", "^file:/+", "file:///").alias("file")


def exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.text(path)
    except AnalysisException:
        return False
    return True


def files_of(spark: SparkSession, path: str) -> list[str]:
    """Names of the files of a path or pattern as Spark knows them; none if nothing is there. No job runs."""
    try:
        return sorted(re.sub("^file:/+", "file:///", f) for f in spark.read.text(path).inputFiles())
    except AnalysisException:
        return []


def _opened(path: str):
    """A file by the file system that its address names. ValueError where pyarrow knows none."""
    from pyarrow import fs

    if path.startswith("file:") or "://" not in path:
        return fs.LocalFileSystem().open_input_file(unquote(urlparse(path).path) if "://" in path else path)
    where, name = fs.FileSystem.from_uri(path)
    return where.open_input_file(name)


def _header(file, kind: str) -> tuple[str, list[str]]:
    """Delimiter and columns of an open file: of text its first block is read, of other formats the footer."""
    import pyarrow as pa
    from pyarrow import orc, parquet

    if kind in (".csv", ".txt"):
        lines = file.read(HEAD_BYTES).decode("utf-8", "replace").lstrip("\ufeff").splitlines()[:5]
        if not lines or not lines[0].strip():
            raise ValueError("the file is empty")
        delimiter = delimiter_of(lines)
        return delimiter, [c.strip() for c in next(csv.reader(lines[:1], delimiter=delimiter))]
    if kind == ".feather":
        return "", pa.ipc.open_file(file).schema.names
    return "", orc.ORCFile(file).schema.names if kind == ".orc" else parquet.read_schema(file).names


def _read_through(file, kind: str) -> None:
    """Reads all of a file, so that damage anywhere shows."""
    import pyarrow as pa
    from pyarrow import orc, parquet

    if kind in (".csv", ".txt", ".json"):
        while file.read(1 << 22):
            pass
    elif kind == ".feather":
        for k in range((found := pa.ipc.open_file(file)).num_record_batches):
            found.get_batch(k)
    elif kind == ".orc":
        for k in range((found := orc.ORCFile(file)).nstripes):
            found.read_stripe(k)
    else:
        for _ in parquet.ParquetFile(file, page_checksum_verification=True).iter_batches():
            pass


def _of_each(spark: SparkSession, files: list[str], look: Callable, tasks: int = 64) -> dict[str, tuple]:
    """`look(open file, extension)` for each file, in tasks: (result, None) or (None, what was wrong)."""

    def run(frames):
        import pandas as pd

        for frame in frames:
            rows = []
            for f in frame["file"]:
                try:
                    with _opened(f) as file:
                        rows.append((f, json.dumps(look(file, PurePosixPath(f).suffix.lower())), None))
                except Exception as e:  # whatever is wrong with a file belongs to that file alone
                    rows.append((f, None, f"{type(e).__name__}: {(str(e).splitlines() or [''])[0]}"))
            yield pd.DataFrame(rows, columns=["file", "found", "error"])

    table = spark.createDataFrame([(f,) for f in files], "file string").repartition(max(1, min(len(files), tasks)))
    got = table.mapInPandas(run, "file string, found string, error string").collect()  # a row for each file
    return {r.file: (None if r.found is None else json.loads(r.found), r.error) for r in got}


def columns_of(spark: SparkSession, files: list[str]) -> dict[str, tuple[str, list[str]] | str]:
    """By file: its delimiter ("" where it has none) and columns, or the reason why it can't be read.

    Tasks open the files and read a first block or a footer of each. Where only Spark can open them, text files give their
    first lines by a scan; JSON files have no header, and Spark infers their columns."""
    known = [f for f in files if PurePosixPath(f).suffix.lower() in FORMATS]
    out: dict[str, tuple[str, list[str]] | str] = {f: f"unknown extension {PurePosixPath(f).suffix.lower()!r}" for f in files}
    openable = ("file", "hdfs", "s3", "gs", "abfs")
    near = [f for f in known if PurePosixPath(f).suffix.lower() != ".json" and ("://" not in f or f.split(":")[0] in openable)]
    for f, (found, error) in _of_each(spark, near, _header).items() if near else ():
        out[f] = error.removeprefix("ValueError: ") if found is None else (found[0], found[1])
    far = sorted(set(known) - set(near))
    texts = [f for f in far if PurePosixPath(f).suffix.lower() in (".csv", ".txt")]
    if texts:
        lines = spark.read.text(texts).select(_file_name(), "value", F.monotonically_increasing_id().alias("line"))
        heads = {r.file: r.head for r in lines.groupBy("file").agg(F.min_by("value", "line").alias("head")).collect()}
        for f in texts:
            head = heads.get(f)
            out[f] = (d := delimiter_of([head]), [c.strip() for c in next(csv.reader([head], delimiter=d))]) if head else "the file is empty"
    for f in sorted(set(far) - set(texts)):
        try:
            out[f] = ("", FORMATS[PurePosixPath(f).suffix.lower()](spark, f).columns)
        except Exception as e:
            out[f] = f"{type(e).__name__}: {str(e).splitlines()[0]}"
    return out


def damaged(spark: SparkSession, files: list[str]) -> dict[str, str]:
    """What is wrong with those of the files that can't be read to their end. Every file is read, so ask only after a read has
    failed."""
    return {f: error for f, (_, error) in _of_each(spark, files, _read_through, 4096).items() if error}


def read_alike(spark: SparkSession, files: list[str], delimiter: str) -> DataFrame:
    """Files of one format and header as one table, with `file` and a row_id that rises within each. A damaged file makes the
    read fail rather than lose rows; `damaged` tells which it is."""
    kind = PurePosixPath(files[0]).suffix.lower()
    if kind == ".feather":
        return read_feather(spark, files).withColumn("row_id", F.monotonically_increasing_id())
    if kind in (".csv", ".txt"):
        df = spark.read.csv(files, header=True, sep=delimiter, encoding="UTF-8")
    else:
        df = spark.read.format({".pq": "parquet"}.get(kind, kind[1:])).load(files)
    return df.select("*", _file_name(), F.monotonically_increasing_id().alias("row_id"))


class Registry:
    """Named loaders of datasets, `(spark, path) -> DataFrame`, also found by extension."""

    def __init__(self):
        self._loaders: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self._extensions: dict[str, str] = {}

    def register(self, name: str, loader: Callable[[SparkSession, str], DataFrame], extensions: tuple[str, ...] = ()) -> None:
        self._loaders[name] = loader
        self._extensions.update({e.lower(): name for e in extensions})

    def load(self, spark: SparkSession, name: str, path: str) -> DataFrame:
        if name not in self._loaders:
            raise KeyError(f"no loader {name!r}; registered: {self.registered()}")
        return self._loaders[name](spark, path)

    def auto_load(self, spark: SparkSession, path: str) -> DataFrame:
        kind = PurePosixPath(path).suffix.lower()
        if kind not in self._extensions:
            raise ValueError(f"no loader for {kind!r}; known: {sorted(self._extensions)}")
        return self.load(spark, self._extensions[kind], path)

    def registered(self) -> list[str]:
        return sorted(self._loaders)


registry = Registry()
registry.register("cycler", read_raw, tuple(FORMATS))
