"""Vector files (.fbin, .u8bin, .i8bin, .bin) and ground-truth files, read and written by row ranges.

A file is two little-endian unsigned 32-bit numbers, rows and dimension, then the rows. The
driver reads the header only; each task opens the file through Arrow's file systems and
reads its own range of rows.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Component types by file ending, and the order in which a folder is searched.
TYPES = {".fbin": "<f4", ".bin": "<f4", ".u8bin": "u1", ".i8bin": "i1"}
BASES = ("base.fbin", "base.u8bin", "base.i8bin", "base.bin")
HEADER = 8
#: Bytes of rows that one task reads.
RANGE_BYTES = 32 << 20


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def resolve(path: str) -> str:
    """path itself if it is a file; in a folder, the first of BASES."""
    fs, at = _open(path)
    if fs.get_file_info(at).type != pafs.FileType.Directory:
        return path
    for name in BASES:
        if fs.get_file_info(f"{at}/{name}").type == pafs.FileType.File:
            return f"{path.rstrip('/')}/{name}"
    raise FileNotFoundError(f"no {', '.join(BASES)} in {path}")


def header(path: str) -> tuple[int, int]:
    fs, at = _open(path)
    with fs.open_input_file(at) as f:
        raw = f.read(HEADER)
    if len(raw) < HEADER:
        raise ValueError(f"{path} has no header")
    return struct.unpack("<II", raw)


def _read(spark: SparkSession, path: str, kind: str, limit: int | None, part: tuple[int, int] | None, schema: str, out) -> DataFrame:
    n, dim = header(path)
    if n == 0 or dim == 0:
        raise ValueError(f"{path} holds no rows")
    width = dim * np.dtype(kind).itemsize
    fs, at = _open(path)
    if fs.get_file_info(at).size < HEADER + n * width:
        raise ValueError(f"{path} is shorter than its header says")
    rows = min(n, limit) if limit else n
    each = max(1, RANGE_BYTES // width)
    ranges = spark.range(0, -(-rows // each), 1, -(-rows // each))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = _open(path)
        for b in batches:
            for k in b.column(0).to_pylist():
                first, last = k * each, min(rows, (k + 1) * each)
                with fs.open_input_file(at) as f:
                    f.seek(HEADER + first * width)
                    data = np.frombuffer(f.read((last - first) * width), kind).reshape(-1, dim)
                ids = np.arange(first, last)
                if part:
                    own = ids % part[1] == part[0]
                    ids, data = ids[own], data[own]
                yield out(ids, data, dim)

    return ranges.mapInArrow(run, schema)


def read_vectors(spark: SparkSession, path: str, limit: int | None = None, part: tuple[int, int] | None = None, kind: str | None = None) -> DataFrame:
    """(id, vec): the rows of a vector file, ids from 0, components widened to float.

    limit keeps the first rows; part (c, n) the rows whose id is c modulo n. kind overrides the
    component type that the ending names.
    """
    path = resolve(path)
    if kind is None:
        kind = next((t for e, t in TYPES.items() if path.endswith(e)), None)
        if kind is None:
            raise ValueError(f"{path} has none of the endings {', '.join(TYPES)}")

    def out(ids: np.ndarray, data: np.ndarray, dim: int) -> pa.RecordBatch:
        flat = pa.array(data.astype(np.float32).ravel())
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, dim, dtype=np.int32), flat)], ["id", "vec"])

    return _read(spark, path, kind, limit, part, "id long, vec array<float>", out)


def read_ground_truth(spark: SparkSession, path: str, queries: int | None = None) -> DataFrame:
    """(qid, ids) of a ground-truth file; queries checks its number of rows."""
    if queries is not None and header(path)[0] != queries:
        raise ValueError(f"{path} has {header(path)[0]} rows, not {queries}")

    def out(ids: np.ndarray, data: np.ndarray, dim: int) -> pa.RecordBatch:
        flat = pa.array(data.astype(np.int64).ravel())
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, dim, dtype=np.int32), flat)], ["qid", "ids"])

    return _read(spark, path, "<u4", None, None, "qid long, ids array<long>", out)


def partition(vectors: DataFrame, client: int, clients: int, key: str = "id") -> DataFrame:
    """The share of one of several clients, round robin by key."""
    return vectors.where(F.pmod(F.col(key), F.lit(clients)) == client)


def _write(rows: DataFrame, path: str, kind: str) -> int:
    """Stream rows (one array column, in order) into a file; one partition at a time reaches the driver."""
    fs, at = _open(path)
    n, dim = rows.count(), None
    with fs.open_output_stream(at) as f:
        for row in rows.toLocalIterator():
            if dim is None:
                dim = len(row[0])
                f.write(struct.pack("<II", n, dim))
            if len(row[0]) != dim:
                raise ValueError("rows differ in length")
            f.write(np.asarray(row[0]).astype(kind).tobytes())
        if dim is None:
            f.write(struct.pack("<II", 0, 0))
    return n


def write_vectors(vectors: DataFrame, path: str) -> int:
    """Write (id, vec), in order of id, as the file type its ending names; returns the rows. For files that fit one machine."""
    kind = next(t for e, t in TYPES.items() if path.endswith(e))
    return _write(vectors.orderBy("id").select("vec"), path, kind)


def write_ground_truth(truth: DataFrame, path: str) -> int:
    """Write (qid, rank, id) as a ground-truth file."""
    ids = truth.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda p: p["id"]).alias("ids"))
    return _write(ids.orderBy("qid").select("ids"), path, "<u4")


def widen(vec: Column) -> Column:
    return vec.cast("array<float>")
