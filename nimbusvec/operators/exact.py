"""Exact nearest neighbours: brute force over all vectors, blocks of queries against blocks of vectors.

Queries stay a DataFrame: each task packs its own into blocks, which meet the blocks of vectors
by a product of the two tables. Their table goes to every task only where its rows are counted
and few; else Spark pairs partitions of both, and nothing but k rows for each query and task is
shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nimbusvec.functions.distance import Metric, distance

#: Most bytes of queries that are sent to every task.
QUERY_BYTES = 64 << 20
#: Rows of a block of queries and of one of vectors, at most.
QUERY_ROWS, VECTOR_ROWS = 2048, 4096
#: Rows that least() puts in one array, about.
ARRAY_ROWS = 4096


def top_k(scored: DataFrame, k: int) -> DataFrame:
    """The k nearest of (qid, id, distance) for each query, ties by id; partial top-k happens before the shuffle."""
    w = Window.partitionBy("qid").orderBy("distance", "id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("qid", "rank", "id", "distance")


def packed(rows: DataFrame, key: str, most: int) -> DataFrame:
    """(block, keys, vecs, dim): rows (key, vec) as packed arrays, at most so many a block; blocks are numbered by their task."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at = TaskContext.get().partitionId() << 33
        for b in batches:
            for i in range(0, b.num_rows, most):
                part = b.slice(i, most)
                v = matrix(part.column(1))
                keys = part.column(0).to_numpy(zero_copy_only=False).astype("<i8")
                yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([keys.tobytes()], pa.binary()), pa.array([v.astype("<f8").tobytes()], pa.binary()), pa.array([v.shape[1]], pa.int32())], ["block", "keys", "vecs", "dim"])
                at += 1

    return rows.select(F.col(key).cast("long").alias("k"), "vec").mapInArrow(run, "block long, keys binary, vecs binary, dim int")


def unpacked(keys: bytes, vecs: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(keys, "<i8"), np.frombuffer(vecs, "<f8").reshape(-1, dim)


def with_queries(rows: DataFrame, queries: DataFrame, most: int = QUERY_ROWS) -> DataFrame:
    """Each of rows with each block of queries (qid, vec), as columns block, qids, qvecs, qdim."""
    spark = rows.sparkSession
    # a row holds megabytes: few of them may go to Python at once
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    counted = queries.agg(F.count("*"), F.max(F.size("vec"))).first()
    # put together first: a table of many files would make as many small blocks
    together = queries.select("qid", "vec").repartition(max(1, -(-counted[0] // most)))
    blocks = packed(together, "qid", most).select("block", F.col("keys").alias("qids"), F.col("vecs").alias("qvecs"), F.col("dim").alias("qdim"))
    return rows.crossJoin(F.broadcast(blocks) if 8 * counted[0] * (counted[1] or 0) <= QUERY_BYTES else blocks)


def matrix(column: pa.Array) -> np.ndarray:
    """An Arrow list column of equal lengths as a matrix of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) and (column.null_count or len(pc.unique(pc.list_value_length(column))) > 1):
        raise ValueError("a vector is null or of another dimension than the others")
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def nearest_of(q: np.ndarray, qids: np.ndarray, v: np.ndarray, ids: np.ndarray, k: int, metric: Metric | str, without_self: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest of v for each query: query row, id and distance, by query and nearness, ties by id.

    One matrix product finds what may be among them, up to its rounding; only those pairs get
    their distance from the components' differences, which decides.
    """
    size_q, size_v = (q * q).sum(1), (v * v).sum(1)
    l2 = Metric(metric) is Metric.L2
    out: list[tuple[np.ndarray, ...]] = []
    step = max(1, (1 << 22) // max(1, len(v)))
    for i in range(0, len(q), step):
        own = slice(i, i + step)
        near = size_q[own, None] + size_v[None] - 2 * (q[own] @ v.T) if l2 else 1.0 - q[own] @ v.T
        if without_self:
            near[qids[own, None] == ids[None]] = np.inf
        edge = np.partition(near, k - 1, axis=1)[:, k - 1] if near.shape[1] > k else np.full(len(near), np.inf)
        slack = 1e-9 * (1.0 + size_q[own] + size_v.max(initial=0.0))
        row, at = np.nonzero((near <= (edge + slack)[:, None]) & np.isfinite(near))
        a, b = q[own][row], v[at]
        d = ((a - b) ** 2).sum(1) if l2 else 1.0 - (a * b).sum(1)
        order = np.lexsort((ids[at], d, row))
        row, at, d = row[order], at[order], d[order]
        first = np.searchsorted(row, np.arange(len(near)))
        kept = np.arange(len(row)) - first[row] < k
        out.append((row[kept] + i, ids[at[kept]], d[kept]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def knn(vectors: DataFrame, queries: DataFrame, k: int, metric: Metric | str = Metric.L2, without_self: bool = False) -> DataFrame:
    """(qid, rank, id, distance): the k nearest vectors (id, vec) of each query (qid, vec), nearest first, ties by id.

    Each task keeps k rows for each of its queries, so k rows for each query and task are all
    that is shuffled.
    """
    if k < 1:
        raise ValueError("k must be at least 1")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, ...]] = {}
        asked: dict[int, np.ndarray] = {}
        for b in batches:
            for r in b.to_pylist():
                (ids, v), (qids, q) = unpacked(r["keys"], r["vecs"], r["dim"]), unpacked(r["qids"], r["qvecs"], r["qdim"])
                if v.shape[1] != q.shape[1]:
                    raise ValueError("queries and vectors differ in dimension")
                found = nearest_of(q, qids, v, ids, k, metric, without_self)
                if r["block"] in best:
                    row, i, d = (np.concatenate(c) for c in zip(best[r["block"]], found, strict=True))
                    order = np.lexsort((i, d, row))
                    row, i, d = row[order], i[order], d[order]
                    kept = np.arange(len(row)) - np.searchsorted(row, row) < k
                    found = (row[kept], i[kept], d[kept])
                best[r["block"]], asked[r["block"]] = found, qids
        for block, (row, i, d) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array(asked[block][row]), pa.array(i), pa.array(d)], ["qid", "id", "distance"])

    pairs = with_queries(packed(vectors, "id", VECTOR_ROWS).select("keys", "vecs", "dim"), queries)
    return top_k(pairs.mapInArrow(run, "qid long, id long, distance double"), k)


def distances(vectors: DataFrame, queries: DataFrame, metric: Metric | str | Callable[[Column, Column], Column] = Metric.L2) -> DataFrame:
    """(qid, id, distance) of a set of queries to all vectors, by column expressions alone; metric may be one.

    The readable form of what knn() computes, and the one to filter by radius. The queries
    are sent to every task if they are counted and few; else partitions of both are paired.
    """
    asked = queries.select("qid", F.col("vec").alias("qvec"))
    n, dim = asked.agg(F.count("*"), F.max(F.size("qvec"))).first()
    pairs = vectors.select("id", "vec").crossJoin(F.broadcast(asked) if 8 * n * (dim or 0) <= QUERY_BYTES else asked)
    of = metric if callable(metric) else lambda a, b: distance(metric, a, b)
    return pairs.select("qid", "id", of(F.col("qvec"), F.col("vec")).alias("distance"))


def least(vectors: DataFrame, key: str, others: DataFrame, name: str, score: Callable[[Column, Column], Column], score_name: str = "distance") -> DataFrame:
    """(key, name, score): for each of vectors (key, vec) the one of others (name, vec, ...) of the least score, ties to the smaller name; nulls where others is empty.

    others are put together in arrays of about ARRAY_ROWS rows, which meet each vector; they go
    to every task if they are counted and few, else partitions of both are paired. With one
    array nothing of vectors is shuffled, with more a row for each vector and task is.
    """
    n, dim = others.agg(F.count("*"), F.max(F.size("vec"))).first()
    blocks = max(1, -(-n // ARRAY_ROWS))
    arrays = others.groupBy(F.pmod(F.xxhash64(name), F.lit(blocks)).alias("block")).agg(F.collect_list(F.struct(*others.columns)).alias("cs")).select("cs")
    if not n:
        arrays = others.agg(F.collect_list(F.struct(*others.columns)).alias("cs"))
    best = F.array_min(F.transform("cs", lambda x: F.struct(score(F.col("vec"), x).alias(score_name), x[name].alias(name))))
    rows = vectors.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), "vec")
    out = rows.crossJoin(F.broadcast(arrays) if 8 * n * (dim or 0) <= QUERY_BYTES else arrays).select("row", "key", best.alias("b"))
    if blocks > 1:
        out = out.groupBy("row", "key").agg(F.min("b").alias("b"))
    return out.select(F.col("key").alias(key), f"b.{name}", f"b.{score_name}")


def within(vectors: DataFrame, queries: DataFrame, radius: float, metric: Metric | str = Metric.L2) -> DataFrame:
    """All vectors closer to a query than radius."""
    return distances(vectors, queries, metric).where(F.col("distance") < radius)


def recall(results: DataFrame, truth: DataFrame, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """(k, recall): share of the true k nearest among the first k results, over all queries of truth.

    results: (qid, rank, id); truth: the same. A k beyond the depth of truth is left out.
    """
    depth = truth.agg(F.coalesce(F.max("rank"), F.lit(0)).alias("depth"))
    both = truth.select("qid", "id", F.col("rank").alias("true_rank")).join(results.select("qid", "id", "rank"), ["qid", "id"], "left")
    ks_ = F.explode(F.array(*(F.lit(k) for k in ks))).alias("k")
    rows = both.select("*", ks_).where(F.col("true_rank") <= F.col("k"))
    out = rows.groupBy("k").agg((F.sum((F.coalesce("rank", F.lit(1 << 30)) <= F.col("k")).cast("double")) / (F.countDistinct("qid") * F.col("k"))).alias("recall"))
    return out.join(F.broadcast(depth), F.col("k") <= F.col("depth")).select("k", "recall")
