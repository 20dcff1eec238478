"""What the operators of this subpackage share: tables in the folder that all executors see, and batch bounds.

Lineage is cut by writing a Parquet table below ``spark.checkpoint.dir`` and reading it
again, never by ``localCheckpoint``: a lost executor then costs a reread, not the data.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: ASCII white space as the contracts write it: space and U+0009 to U+000D.
WHITE = b" \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"

#: Most bytes of one Arrow batch sent to Python, so that very long texts don't pile up in one batch.
BATCH_BYTES = 8 << 20
BATCH_ROWS = 4096
#: Most buckets of a table.
BUCKETS = 100_000
#: A key that more than one in so many rows have is dealt to several tasks.
HEAVY = 1024


def shared_root(spark: SparkSession) -> str:
    """The shared folder: ``spark.checkpoint.dir``; unset, a temporary one, on a local master only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    root = tempfile.mkdtemp(prefix="nimbusvec-")
    atexit.register(shutil.rmtree, root, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{root}")
    return f"file://{root}"


def bound_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds, in rows and bytes, for the Python operators of this session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


#: What the operators of a Python worker keep from one task to the next, by operator.
kept: dict[str, dict] = {}


def forget_others(operator: str) -> None:
    for name, held in kept.items():
        if name != operator:
            held.clear()


def give_back() -> None:
    """Free memory of this process goes back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc only
        ctypes.CDLL(None).malloc_trim(0)


def lean(run: Callable[[Iterable], Iterator], operator: str = "") -> Callable[[Iterable], Iterator]:
    """run, an Arrow or iterator function, in a worker that holds no more than it has to.

    Workers live on, idle, next to the tasks of all later steps, and what they hold is taken
    from the same executor. So what other operators keep is dropped as run begins, and free
    memory goes back to the system as it ends.
    """

    def lean_run(batches: Iterable) -> Iterator:
        forget_others(operator)
        try:
            yield from run(batches)
        finally:
            give_back()

    return lean_run


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_root(spark)}/{spark.sparkContext.applicationId}-{label}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Write df as a table in the shared folder and read it again; also its path, for drop()."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, *paths: str) -> None:
    """Delete tables that nothing reads any more."""
    jvm = spark._jvm
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """rows as a table; by Arrow, as a list would start workers of another kind on the executors, which stay."""
    kinds = to_arrow_schema(T.StructType.fromDDL(schema))
    return spark.createDataFrame(pa.table([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(kinds)], schema=kinds))


def own_name(df: DataFrame, wish: str) -> str:
    """A column name that df doesn't have yet."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish += "_"
    return wish


def column(name: str) -> Column:
    """The column of exactly that name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def spread_join(rows: DataFrame, facts: DataFrame, on: list[str], n: str, how: str = "inner", total: int | None = None) -> DataFrame:
    """rows joined with facts, which has one row for each key, however many rows one key has.

    Column n of facts says how many of the rows have its key; null and 0 count as few. A key of
    more than one row in HEAVY is cut into as many shares as it has such parts: its rows are
    dealt to the shares in turn and its fact gets a copy for each. At most HEAVY keys can have
    that many rows, so the table of their shares, which every task gets, is bounded. total: all
    rows, or more; without it n is summed up first, for which facts should be a stored table.
    """
    if total is None:
        total = facts.agg(F.coalesce(F.sum(n), F.lit(0))).first()[0]
    share, shares = own_name(rows, own_name(facts, "_share")), own_name(rows, own_name(facts, "_shares"))
    parts = F.greatest(F.ceil(F.coalesce(F.col(n), F.lit(0)) * HEAVY / F.lit(max(1, total))), F.lit(1)).cast("int")
    heavy = F.broadcast(facts.where(F.col(n) * HEAVY > total).select(*on, parts.alias(shares)))
    dealt = rows.join(heavy, on, "left").withColumn(share, F.pmod(F.monotonically_increasing_id(), F.coalesce(shares, F.lit(1))).cast("int")).drop(shares)
    copies = facts.withColumn(share, F.explode(F.sequence(F.lit(0), parts - 1)))
    return dealt.join(copies, [*on, share], how).drop(share)


def bucket_keys(n: int) -> list[int]:
    """For each of n buckets a whole number that Spark's hash, Murmur3 with seed 42, puts there."""
    found = np.full(n, -1, np.int64)
    at, rotated = 0, lambda x, by: (x << np.uint32(by)) | (x >> np.uint32(32 - by))
    while (found < 0).any():
        numbers = np.arange(at, at + 8 * n + 64, dtype=np.uint32)
        at += len(numbers)
        h = np.uint32(42) ^ (rotated(numbers * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593))
        h = rotated(h, 13) * np.uint32(5) + np.uint32(0xE6546B64)
        h ^= np.uint32(4)
        for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
            h = (h ^ (h >> np.uint32(shift))) * np.uint32(factor)
        h ^= h >> np.uint32(16)
        bucket, first = np.unique(h.view(np.int32).astype(np.int64) % n, return_index=True)
        new = found[bucket] < 0
        found[bucket[new]] = numbers[first[new]]
    return found.tolist()


class InPlace:
    """df as a table that can lose rows without a shuffle of the others.

    Every task writes its rows to a bucket of its own. rows: the table, with a unique long, row,
    which says by its upper bits which task wrote it. kept() joins a narrow table of rows to it:
    that table alone is dealt to the buckets, and the rows are read where they lie.
    """

    def __init__(self, df: DataFrame, label: str) -> None:
        spark = df.sparkSession
        self.columns, self.row = df.columns, own_name(df, "_row")
        self.part = own_name(df, "_part")
        self.buckets = max(1, min(BUCKETS, df.rdd.getNumPartitions()))
        self.keys = F.split(F.lit(",".join(map(str, bucket_keys(self.buckets)))), ",").cast("array<int>")
        numbered = df.withColumn(self.row, F.monotonically_increasing_id())
        path = new_path(spark, label)
        table = f"{label}_{path.rsplit('-', 1)[1]}"
        writer = numbered.withColumn(self.part, self._part(F.col(self.row))).write.format("parquet").bucketBy(self.buckets, self.part)
        writer.option("path", path).option("compression", "zstd").saveAsTable(table)
        self.rows = spark.table(table)
        # else Spark would deal both sides of the join anew by all of its columns
        spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")

    def _part(self, row: Column) -> Column:
        return F.element_at(self.keys, F.pmod(F.shiftright(row, 33), F.lit(self.buckets)).cast("int") + 1)

    def kept(self, keep: DataFrame) -> DataFrame:
        """The rows whose number is in keep (row), with the columns of df."""
        wanted = keep.select(F.col("row").alias(self.row)).withColumn(self.part, self._part(F.col(self.row)))
        # dealt as the rows lie, whatever keep was dealt by before
        wanted = wanted.repartition(self.buckets, self.part).hint("shuffle_hash")
        return self.rows.join(wanted, [self.part, self.row], "left_semi").select(*(column(c) for c in self.columns))
