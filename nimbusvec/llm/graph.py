"""Connected components over an edge table, by alternating star contractions.

Each round rewires every node to the smallest node of its neighbourhood: first its larger
neighbours (large star), then its smaller ones (small star). The edges converge to one star
for each component, centred on its smallest node, in O(log^2 n) rounds; nothing but two
checksums reaches the driver, and each round is a table in the shared folder. A node with many
neighbours, such as the centre of a large star, is dealt to several tasks by its degree.
Few enough edges for one task are joined there at once instead: a round has a dozen shuffles,
and a file for each of their partitions, however few its edges.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nimbusvec.llm.shared import drop, spread_join, stored

#: Edges that one task joins at once, at most; more take rounds of contractions.
TASK_EDGES = 1 << 14


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    """n: the number of edges."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    return spread_join(both.where("v > u"), least, ["u"], "n", total=2 * n).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    """n: the number of edges at most."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    moved = spread_join(edges, least, ["u"], "n", total=n).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _sum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.expr("bit_xor(xxhash64(v, u, 7L))")).first())


def _unite(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All edges -> every node and the smallest of its component."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            up.setdefault(u, u)
            up.setdefault(v, v)
            u, v = root(u), root(v)
            up[max(u, v)] = min(u, v)
    if up:
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (list(up), list(map(root, up)))], ["node", "root"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node that has an edge to another; root is the smallest node of its component.

    edges: columns u and v, of one orderable type. Loops, repeats and rows with nulls are
    ignored; an empty table gives an empty one.
    """
    spark = edges.sparkSession
    clean = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now, path = stored(clean, "edges")
    before = _sum(now)
    if 0 < before[0] <= TASK_EDGES and all(kind == "bigint" for _, kind in now.dtypes):
        found, _ = stored(now.repartition(1).mapInArrow(_unite, "node long, root long"), "roots")
        drop(spark, path)
        return found
    while before[0]:
        # after a large star every edge still points from the larger node to the smaller
        then, new = stored(_small_star(_large_star(now, before[0]), before[0]), "edges")
        drop(spark, path)
        now, path, after = then, new, _sum(then)
        if after == before:
            break
        before = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
