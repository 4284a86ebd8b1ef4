"""MATLAB files of level 5 (versions 5 to 7) as a Spark data source, `spark.read.format("matfile")`.

A file is a header of 128 bytes and a row of elements, each with a tag of type and size, so the variables can be listed from
tags and names alone. Every variable is an input partition of its own: a task seeks to its bytes, inflates and parses them,
and gives one Arrow batch for each cycle, so one cell is in memory at a time. Files are opened by the file system that their
address names (`pyarrow.fs`); where that knows none, `read_mat` has Spark hand over the files' bytes (`binaryFile`) instead.
HDF5 files (version 7.3) are another format and get an error that says so.

Two layouts:

* `samples`: cells with arrays of time, voltage and current, either for the whole cell with cycle numbers beside them or for
  each cycle of a struct or list `cycles`. A field is found by its exact name first, then by any case, since `t` and `T` are
  time and temperature. Charge that a cycle lacks is counted from its current.
* `halves`: cells of cycles `cyc0100` of half-cycles `C1ch`, `OCVdc`, ..., each with t in days, v, q in mAh and T, as
  `datasets.preferred_halves` and `joined_cycles` take them.

A variable of neither layout gives no rows, nor does a cycle without time, voltage or current.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any, BinaryIO
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

HEADER = 128
#: Fixed values of the format: storage types with their numpy kinds, and classes of arrays.
STORED = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8", 16: "u1", 17: "u2", 18: "u4"}
MATRIX, COMPRESSED = 14, 15
CELL, STRUCT, OBJECT, CHAR = 1, 2, 3, 4
NUMERIC = range(6, 16)


def byte_order(header: bytes, path: str) -> str:
    """"<" or ">"; ValueError for anything but a level-5 file."""
    if header[:4] == b"\x89HDF":
        raise ValueError(f"{path} is a MATLAB 7.3 file, which is HDF5; save it with -v7")
    mark = header[126:128]
    if len(header) < HEADER or mark not in (b"IM", b"MI"):
        raise ValueError(f"{path} isn't a MATLAB level-5 file")
    return "<" if mark == b"IM" else ">"


def _tag(data: bytes, at: int, order: str) -> tuple[int, int, int, int]:
    """Type, size, where the content begins, and where the next element does."""
    kind, size = struct.unpack_from(f"{order}II", data, at)
    if kind >> 16:  # small: size and type share a word and the content follows at once
        return kind & 0xFFFF, kind >> 16, at + 4, at + 8
    return kind, size, at + 8, at + 8 + size + (-size % 8 if kind != COMPRESSED else 0)


def _stored(data: bytes, at: int, order: str) -> tuple[np.ndarray, int]:
    kind, size, begin, end = _tag(data, at, order)
    return np.frombuffer(data, np.dtype(STORED[kind]).newbyteorder(order), size // np.dtype(STORED[kind]).itemsize, begin), end


def _head(data: bytes, at: int, order: str) -> tuple[int, bool, np.ndarray, str, int]:
    """Class, whether complex, dimensions and name of a matrix whose content begins at `at`, and where its data do."""
    flags, at = _stored(data, at, order)
    size, at = _stored(data, at, order)
    name, at = _stored(data, at, order)
    return int(flags[0]) & 0xFF, bool(flags[0] & 0x800), size, name.tobytes().decode("latin-1"), at


def parsed(data: bytes, at: int, order: str) -> Any:
    """The value of a matrix: structs as dicts (several as a list of them), cells as a list, numbers as a flat array in the
    order of columns, text as a string; None for what else there is."""
    kind, _, begin, _ = _tag(data, at, order)
    if kind != MATRIX:
        raise ValueError(f"element of type {kind} where a matrix should be")
    array, is_complex, size, _, at = _head(data, begin, order)
    count = int(np.prod(size))
    if array in NUMERIC:
        return _stored(data, at, order)[0].astype(np.float64)  # of complex numbers the real part, which comes first
    if array == CHAR:
        kind, n, begin, _ = _tag(data, at, order)
        return data[begin : begin + n].decode("utf-8") if kind in (1, 2, 16) else "".join(map(chr, _stored(data, at, order)[0]))
    if array == CELL:
        out = []
        for _ in range(count):
            out.append(parsed(data, at, order))
            at = _tag(data, at, order)[3]
        return out
    if array in (STRUCT, OBJECT):
        if array == OBJECT:
            at = _tag(data, at, order)[3]
        width, at = _stored(data, at, order)
        raw, at = _stored(data, at, order)
        names = [raw[i : i + width[0]].tobytes().split(b"\0")[0].decode("latin-1") for i in range(0, len(raw), int(width[0]))]
        out = []
        for _ in range(count):
            one = {}
            for name in names:
                one[name] = parsed(data, at, order)
                at = _tag(data, at, order)[3]
            out.append(one)
        return out[0] if count == 1 else out
    return None


def inflated(element: bytes, order: str) -> bytes:
    """A top-level element without its compression."""
    kind, size, begin, _ = _tag(element, 0, order)
    return zlib.decompress(element[begin : begin + size]) if kind == COMPRESSED else element


def variables(file: BinaryIO, path: str) -> list[tuple[str, int, int, str]]:
    """(name, begin, end, byte order) of every variable; of a compressed one only the first bytes are read and inflated."""
    file.seek(0, 2)
    length = file.tell()
    file.seek(0)
    order = byte_order(file.read(HEADER), path)
    out, at = [], HEADER
    while at + 8 <= length:
        file.seek(at)
        start = file.read(1024)
        kind, _, begin, end = _tag(start, 0, order)
        if at + end > length:
            raise ValueError(f"{path} is cut off")
        if kind == COMPRESSED:
            start, begin = zlib.decompressobj().decompress(start[begin:], 512), 8
        if kind in (MATRIX, COMPRESSED):
            out.append((_head(start, begin, order)[3], at, at + end, order))
        at += end
    return out


def cell_keys(spark: SparkSession, path: str) -> list[str]:
    """Sorted names of the variables of a file that are cells, that is, begin with `Cell`."""
    return sorted(v.name for v in _partitions(path) if v.name.startswith("Cell"))


def is_mat(name: str) -> bool:
    return name.lower().endswith(".mat")


# --- layouts ---------------------------------------------------------------------------------------------------------

#: Names of fields, the first that a cell has counts.
FIELDS = {
    "time": ("time", "time_s", "t", "test_time"), "voltage": ("voltage", "v", "ewe"), "current": ("current", "i", "current_a"),
    "capacity": ("capacity", "q", "charge_capacity", "discharge_capacity", "q_charge", "q_discharge"), "temperature": ("temperature", "temp", "T", "t_cell"),
    "cycle_index": ("cycle_index", "cycle_indicator", "cycle", "cycle_no", "cyc"),
}
NESTED = ("cycles", "cycle_data", "data", "cyc")
SAMPLES = "cell_id string, cycle_index int, pos int, time double, voltage double, current double, capacity double, temperature double"
HALVES = "cell_id string, cycle_index int, kind string, pos int, time double, voltage double, q double, temperature double"


def field(cell: dict, role: str) -> np.ndarray | None:
    """The array of numbers that plays a role; of names that differ only in case, the exact one goes first, and the name
    `t` is never read as temperature nor `T` as time while both are there."""
    lower: dict[str, str] = {}
    for k in cell:
        lower.setdefault(k.lower().strip(), k)
    taken = {"t": "T", "T": "t"} if {"t", "T"} <= cell.keys() else {}
    for name in FIELDS[role]:
        key = name if name in cell else lower.get(name.lower())
        if key is None or taken.get(name) == key or not isinstance(cell[key], np.ndarray):
            continue
        return cell[key]
    return None


def _arrays(cell: dict, roles: tuple[str, ...]) -> dict[str, np.ndarray | None] | None:
    """Arrays by role, as long as time is; None without time, voltage and current."""
    found = {r: field(cell, r) for r in roles}
    n = [len(found[r]) for r in ("time", "voltage", "current") if found.get(r) is not None]
    if len(n) < 3 or len(set(n)) > 1:
        return None
    return {r: a if a is not None and len(a) == n[0] else None for r, a in found.items()}


def _cells(name: str, value: Any) -> Iterator[tuple[str, dict]]:
    """The cells of a variable: itself, or what it holds."""
    if isinstance(value, list):
        yield from ((f"{name}_{k}", x) for k, x in enumerate(value) if isinstance(x, dict))
    elif isinstance(value, dict):
        if any(isinstance(x, np.ndarray) for x in value.values()) or any(k.lower().strip() in NESTED for k in value):
            yield name, value
        else:
            for key, x in value.items():
                yield from _cells(f"{name}_{key}", x) if isinstance(x, list) else ((f"{name}_{key}", x),) if isinstance(x, dict) else ()


def _number(key: Any) -> int | None:
    try:
        return int(key)
    except (TypeError, ValueError):
        digits = re.search(r"\d+$", str(key))  # a field name can't begin with a digit, so cycle 1 is c1 or the like
        return int(digits[0]) if digits else None


def _columns(cell: str, cycle: int, arrays: dict[str, np.ndarray | None], names: tuple[str, ...], kind: str | None = None) -> pa.RecordBatch:
    n = len(arrays["time"])
    columns = {"cell_id": pa.array([cell] * n), "cycle_index": pa.array(np.full(n, cycle, np.int32))}
    if kind is not None:
        columns["kind"] = pa.array([kind] * n)
    columns["pos"] = pa.array(np.arange(n, dtype=np.int32))
    return pa.record_batch(columns | {c: pa.nulls(n, pa.float64()) if arrays.get(c) is None else pa.array(arrays[c]) for c in names})


def sample_batches(name: str, value: Any) -> Iterator[pa.RecordBatch]:
    roles = ("time", "voltage", "current", "capacity", "temperature")
    for cell, data in _cells(name, value):
        flat = _arrays(data, roles + ("cycle_index",))
        if flat is not None:
            cycle = flat["cycle_index"].astype(np.int64) if flat["cycle_index"] is not None else np.zeros(len(flat["time"]), np.int64)
            for c in np.unique(cycle):
                yield _columns(cell, int(c), {r: a[cycle == c] for r, a in flat.items() if a is not None}, roles)
            continue
        nested = next((x for k, x in data.items() if k.lower().strip() in NESTED), None)
        items = nested.items() if isinstance(nested, dict) else enumerate(nested) if isinstance(nested, list) else ()
        for key, x in items:
            number, arrays = _number(key), _arrays(x, roles) if isinstance(x, dict) else None
            if number is not None and arrays is not None:
                yield _columns(cell, number, arrays, roles)


def half_batches(name: str, value: Any) -> Iterator[pa.RecordBatch]:
    if not name.startswith("Cell") or not isinstance(value, dict):
        return
    for key, kinds in value.items():
        number = int(key[3:]) if re.fullmatch(r"cyc\d+", key) else None
        if number is None or not isinstance(kinds, dict):
            continue
        for kind, half in kinds.items():
            if isinstance(half, dict) and all(isinstance(half.get(f), np.ndarray) for f in "tvqT"):
                arrays = {"time": half["t"], "voltage": half["v"], "q": half["q"], "temperature": half["T"]}
                if len({len(a) for a in arrays.values()}) == 1:
                    yield _columns(name, number, arrays, ("time", "voltage", "q", "temperature"), kind)


LAYOUTS = {"samples": (SAMPLES, sample_batches), "halves": (HALVES, half_batches)}


# --- Spark -----------------------------------------------------------------------------------------------------------


@dataclass
class Variable(InputPartition):
    path: str
    name: str
    begin: int
    end: int
    order: str


def _opened(path: str):
    """A file of any address that pyarrow knows a file system for, and the files below a folder."""
    from pyarrow import fs

    where, name = (fs.LocalFileSystem(), unquote(urlparse(path).path)) if "://" not in path or path.startswith("file:") else fs.FileSystem.from_uri(path)
    return where, name if "://" in path or path.startswith("file:") else path


def _partitions(path: str) -> list[Variable]:
    from pyarrow import fs

    where, name = _opened(path)
    info = where.get_file_info(name)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    files = [name] if info.is_file else sorted(f.path for f in where.get_file_info(fs.FileSelector(name, recursive=True)) if f.is_file and is_mat(f.path))
    out = []
    for f in files:
        with where.open_input_file(f) as file:
            out += [Variable(f if info.is_file is False else path, *v) for v in variables(file, f)]
    return out


class _Reader(DataSourceReader):
    def __init__(self, path: str, layout: str):
        self.path, self.layout = path, layout

    def partitions(self) -> list[Variable]:
        return _partitions(self.path) or [Variable(self.path, "", 0, 0, "<")]

    def read(self, partition: Variable) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        where, name = _opened(partition.path)
        with where.open_input_file(name) as file:
            file.seek(partition.begin)
            element = file.read(partition.end - partition.begin)
        yield from LAYOUTS[self.layout][1](partition.name, parsed(inflated(element, partition.order), 0, partition.order))


class MatSource(DataSource):
    """`spark.read.format("matfile").option("layout", "samples").load(path)`, after `register`."""

    @classmethod
    def name(cls) -> str:
        return "matfile"

    def _layout(self) -> str:
        layout = self.options.get("layout", "samples")
        if layout not in LAYOUTS:
            raise ValueError(f"layout {layout!r}; known: {sorted(LAYOUTS)}")
        return layout

    def schema(self) -> str:
        return LAYOUTS[self._layout()][0]

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], self._layout())


def register(spark: SparkSession) -> None:
    spark.dataSource.register(MatSource)


def _through_spark(spark: SparkSession, path: str, layout: str) -> DataFrame:
    """The same rows where only Spark can open the files: their variables are dealt out as bytes, then parsed."""
    schema, batches_of = LAYOUTS[layout]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = content.as_buffer().to_pybytes()
                for name, begin, end, order in variables(pa.BufferReader(data), path):
                    yield pa.record_batch({"name": [name], "data": [data[begin:end]], "byte_order": [order]})

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data, order in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield from batches_of(name, parsed(inflated(data, order), 0, order))

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[mM][aA][tT]").load(path).select("path", "content")
    return files.mapInArrow(cut, "name string, data binary, byte_order string").repartition("name", "data").mapInArrow(parse, schema)


def read_layout(spark: SparkSession, path: str, layout: str) -> DataFrame:
    """A file, or the `.mat` files below a folder, in one of the layouts."""
    scheme = urlparse(path).scheme if "://" in path else "file"
    if scheme not in ("file", "hdfs", "s3", "s3a", "gs", "abfs", "abfss"):
        return _through_spark(spark, path, layout)
    register(spark)
    return spark.read.format("matfile").option("layout", layout).load(path)


def with_charge(samples: DataFrame) -> DataFrame:
    """`samples` whose cycles without measured capacity have the running sum of absolute current times the time gradient."""
    w = Window.partitionBy("cell_id", "cycle_index").orderBy("pos")
    t = F.col("time")
    step = F.coalesce((F.lead(t).over(w) - F.lag(t).over(w)) / 2, F.lead(t).over(w) - t, t - F.lag(t).over(w), F.lit(0.0))
    passed = samples.withColumn("__q", F.abs("current") * step / 3600)
    counted = F.sum("__q").over(w.rowsBetween(Window.unboundedPreceding, 0))
    measured = F.count("capacity").over(Window.partitionBy("cell_id", "cycle_index")) > 0
    return passed.withColumn("capacity", F.when(measured, F.col("capacity")).otherwise(counted)).drop("__q")


def _placed(df: DataFrame) -> DataFrame:
    """With a row_id that rises through the cycles of a cell, in place of the position in the cycle."""
    return df.withColumn("row_id", F.col("cycle_index").cast("long") * F.lit(1 << 32) + F.col("pos")).drop("pos")


def read_mat(spark: SparkSession, path: str) -> DataFrame:
    """Samples (cell_id, cycle_index, row_id, time, voltage, current, capacity, temperature) of the cells of a file."""
    return _placed(with_charge(read_layout(spark, path, "samples")))


def read_halves(spark: SparkSession, path: str) -> DataFrame:
    """Half-cycles (cell_id, cycle_index, row_id, kind, time: days, voltage, q: mAh, temperature) of the cells of a file."""
    return _placed(read_layout(spark, path, "halves"))
