"""Clustering for placement: farthest-first starts, Lloyd and balanced k-means, nearest centroids."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nimbusvec.functions.distance import Metric, distance, to_many
from nimbusvec.operators.exact import distances, least

#: Rows that the in-memory forms accept; they are for samples.
SAMPLE_ROWS = 50_000
#: Rows that balanced() is fitted on for a table: it moves points one after the other.
BALANCED_ROWS = 4_000


def farthest_first(points: np.ndarray, k: int, seed: int = 1234, metric: str = "l2") -> np.ndarray:
    """Row numbers of k starts: a seeded first one, then always the point farthest from all chosen; none of no points."""
    if not len(points):
        return np.zeros(0, int)
    chosen = [int(np.random.default_rng(seed).integers(len(points)))]
    near = to_many(metric, points[chosen], points)[0]
    while len(chosen) < min(k, len(points)):
        near[chosen] = -np.inf
        chosen.append(int(np.argmax(near)))
        near = np.minimum(near, to_many(metric, points[chosen[-1:]], points)[0])
    return np.array(chosen)


def farthest_table(vectors: DataFrame, k: int, seed: int = 1234, metric: str = "l2") -> DataFrame:
    """(place, id): k starts of a whole table: the first by seeded hash, then always the farthest from all chosen, ties to the smaller id; a pass for each."""
    spark, rows = vectors.sparkSession, vectors.select("id", "vec")
    first = rows.agg(F.min_by(F.struct("id", "vec"), F.struct(F.xxhash64("id", F.lit(seed)), "id")).alias("r")).first().r
    chosen = [first] if first else []
    while chosen and len(chosen) < k:
        near = F.least(*(distance(metric, F.col("vec"), _fixed(r.vec)) for r in chosen), F.lit(float("inf")))
        left = rows.where(~F.col("id").isin([r.id for r in chosen]))
        far = left.agg(F.max_by(F.struct("id", "vec"), F.struct(near, -F.col("id"))).alias("r")).first().r
        if far is None:
            break
        chosen.append(far)
    return spark.createDataFrame([(i, r.id) for i, r in enumerate(chosen)], "place int, id long")


def _fixed(vec) -> Column:
    return F.array(*(F.lit(float(x)) for x in vec))


def lloyd(points: np.ndarray, k: int, seed: int = 1234, rounds: int = 1000, tolerance: float = 1e-3, metric: str = "l2") -> tuple[np.ndarray, np.ndarray]:
    """Centroids and each point's cluster; an empty cluster keeps its centroid; ends when the centroids hardly move. No points make no clusters."""
    centres = points[farthest_first(points, k, seed, metric)].copy()
    if not len(centres):
        return centres, np.zeros(0, int)
    for _ in range(rounds):
        own = _nearest_centre(points, centres, metric)
        new = centres.copy()
        for c in range(len(centres)):
            if (own == c).any():
                new[c] = points[own == c].mean(0)
        moved = to_many(metric, new, centres).diagonal()
        moved = np.sqrt(np.maximum(moved, 0)).sum() if Metric(metric) is Metric.L2 else np.abs(moved).sum()
        centres = new
        if moved <= tolerance:
            break
    return centres, to_many(metric, points, centres).argmin(1)


def _nearest_centre(points: np.ndarray, centres: np.ndarray, metric: str) -> np.ndarray:
    """Each point's nearest centre by one matrix product, measured from the centres' mean so that little cancels."""
    if Metric(metric) is Metric.L2:
        middle = centres.mean(0)
        own = centres - middle
        return ((own * own).sum(1) - 2 * ((points - middle) @ own.T)).argmin(1)
    return to_many(metric, points, centres).argmin(1)


def lloyd_table(vectors: DataFrame, starts: DataFrame, rounds: int = 20, tolerance: float = 1e-3, metric: str = "l2") -> DataFrame:
    """(cluster, vec): Lloyd over a whole table from starts (cluster, vec); each round is one pass and one small shuffle."""
    spark, centres = vectors.sparkSession, [(r.cluster, [float(x) for x in r.vec]) for r in starts.orderBy("cluster").collect()]
    for _ in range(rounds):
        table = spark.createDataFrame(centres, "cluster int, vec array<double>")
        own = assign(vectors, table, metric)
        means = own.join(vectors, "id").select("cluster", F.posexplode("vec").alias("pos", "x")).groupBy("cluster", "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
        found = {r.cluster: list(r.vec) for r in means.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"]).alias("vec")).collect()}
        new = [(c, found.get(c, v)) for c, v in centres]
        moved = sum(float(np.linalg.norm(np.subtract(a, b))) for (_, a), (_, b) in zip(new, centres, strict=True))
        centres = new
        if moved <= tolerance:
            break
    return spark.createDataFrame(centres, "cluster int, vec array<double>")


def balanced(points: np.ndarray, k: int, seed: int = 1234, metric: str = "l2", strength: float = 0.15, growth: float = 1.01, slack: int = 1, rounds: int = 1000) -> tuple[np.ndarray, np.ndarray]:
    """k-means whose cluster sizes differ by at most slack: full clusters cost a penalty that grows until they even out.

    Points move one after the other in their order, each to the cluster of the least distance
    plus penalty times size; should the rounds not suffice, the nearest points of the largest clusters
    are moved to the smallest.
    """
    centres, own = lloyd(points, k, seed, metric=metric)
    k = len(centres)
    if not k:
        return centres, own
    sizes = np.bincount(own, minlength=k)
    penalty = strength * float(to_many(metric, points, centres).min(1).mean() + 1e-12) / max(1, len(points) / k)
    for _ in range(rounds):
        if sizes.max() - sizes.min() <= slack:
            break
        d = to_many(metric, points, centres)
        for i in range(len(points)):
            sizes[own[i]] -= 1
            own[i] = int(np.argmin(d[i] + penalty * sizes))
            sizes[own[i]] += 1
        for c in range(k):
            if sizes[c]:
                centres[c] = points[own == c].mean(0)
        penalty *= growth
    d = to_many(metric, points, centres)
    while sizes.max() - sizes.min() > slack:
        a, b = int(sizes.argmax()), int(sizes.argmin())
        rows = np.flatnonzero(own == a)
        own[rows[np.argmin(d[rows, b] - d[rows, a])]] = b
        sizes[a], sizes[b] = sizes[a] - 1, sizes[b] + 1
    return centres, own


def centres_of(vectors: DataFrame, k: int, seed: int = 1234, most: int = SAMPLE_ROWS) -> np.ndarray:
    """k centres by some rounds of k-means on about so many rows at most, those whose hash falls below a share."""
    share = math.ceil(min(1.0, min(most, 200 * k) / max(1, vectors.count())) * (1 << 30))
    rows = vectors.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) < share).orderBy("id").limit(2 * most).select("vec").collect()
    points = np.array([r.vec for r in rows or vectors.orderBy("id").select("vec").limit(k).collect()], float)
    if not len(points):
        return np.zeros((1, 1))
    return lloyd(points, min(k, len(points)), seed, rounds=20)[0]


def _nth(rows: DataFrame, n: int) -> Row:
    """The n-th (from 1) of rows (gap, id) in their order, found in its part of a dealing by range."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, "gap", "id").withColumn("part", F.spark_partition_id()).persist()
    for r in dealt.groupBy("part").count().orderBy("part").collect():
        if n <= r["count"]:
            own = dealt.where(F.col("part") == r.part)
            found = own.withColumn("at", F.row_number().over(Window.partitionBy("part").orderBy("gap", "id"))).where(F.col("at") == n).first()
            dealt.unpersist()
            return found
        n -= r["count"]
    raise ValueError("fewer rows")


def balanced_table(vectors: DataFrame, centres: np.ndarray, metric: str = "l2") -> DataFrame:
    """(id, cluster) of every vector, to the nearest of a few centres whose cluster has room; sizes differ by at most one.

    What a cluster has beyond its share goes where room is left, first those that lose least by
    the move; at most one move for each cluster. ids are taken to be distinct. Without centres
    there are no rows.
    """
    k = len(centres)
    if not k:
        return vectors.select("id", F.lit(0).alias("cluster")).limit(0)
    d = F.array(*(distance(metric, F.col("vec"), _fixed(c)) for c in centres))
    rows = vectors.select("id", d.alias("d")).persist()
    own = rows.withColumn("cluster", (F.array_position("d", F.array_min("d")) - 1).cast("int"))
    found = {r.cluster: r["count"] for r in own.groupBy("cluster").count().collect()}
    sizes = np.array([found.get(c, 0) for c in range(k)])
    share = np.full(k, sizes.sum() // k)
    share[np.argsort(-sizes, kind="stable")[: sizes.sum() % k]] += 1
    over = sizes - share
    while over.any():
        a, b = int(over.argmax()), int(over.argmin())
        n = int(min(over[a], -over[b]))
        gap = F.col("d")[b] - F.col("d")[a]
        last = _nth(own.where(F.col("cluster") == a).select(gap.alias("gap"), "id"), n)
        goes = (F.col("cluster") == a) & (F.struct(gap.alias("gap"), "id") <= F.struct(F.lit(last.gap).alias("gap"), F.lit(last.id).cast("long").alias("id")))
        own = own.withColumn("cluster", F.when(goes, F.lit(b)).otherwise(F.col("cluster")))
        over[a], over[b] = over[a] - n, over[b] + n
    return own.select("id", "cluster")


def _merged(centres: np.ndarray, own: np.ndarray, k: int, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """k centres from more, whose closest pairs are merged greedily, and the new number of each old one."""
    centres, sizes, to = centres.copy(), np.bincount(own, minlength=len(centres)), np.arange(len(centres))
    left = list(range(len(centres)))
    while len(left) > k:
        d = to_many(metric, centres[left], centres[left])
        np.fill_diagonal(d, np.inf)
        a, b = np.unravel_index(np.argmin(d), d.shape)
        a, b = left[min(a, b)], left[max(a, b)]
        na, nb = max(1, sizes[a]), max(1, sizes[b])
        centres[a] = (na * centres[a] + nb * centres[b]) / (na + nb)
        sizes[a], sizes[b] = sizes[a] + sizes[b], 0
        to[to == b] = a
        left.remove(b)
    return centres[left], np.searchsorted(left, to)


def odd_clusters(points: np.ndarray, k: int, seed: int = 1234, metric: str = "l2") -> tuple[np.ndarray, np.ndarray]:
    """k clusters from 2k, whose closest pairs are merged greedily."""
    centres, own = lloyd(points, 2 * k, seed, metric=metric)
    centres, to = _merged(centres, own, k, metric)
    return centres, to[own]


def odd_table(vectors: DataFrame, points: np.ndarray, k: int, seed: int = 1234, metric: str = "l2") -> DataFrame:
    """(id, cluster) of every vector in the clusters that odd_clusters finds on a sample (points); no rows without points."""
    centres, own = lloyd(points, 2 * k, seed, metric=metric)
    if not len(centres):
        return vectors.select("id", F.lit(0).alias("cluster")).limit(0)
    to = _merged(centres, own, k, metric)[1]
    table = vectors.sparkSession.createDataFrame([(c, [float(x) for x in v]) for c, v in enumerate(centres)], "cluster int, vec array<double>")
    return assign(vectors, table, metric).select("id", F.element_at(F.array(*(F.lit(int(x)) for x in to)), F.col("cluster") + 1).alias("cluster"))


def ranked(vectors: DataFrame, centres: DataFrame, metric: str = "l2") -> DataFrame:
    """(id, rank, cluster, distance): all centroids (cluster, vec) in order of distance from each vector, ties to the smaller cluster."""
    scored = distances(vectors, centres.select(F.col("cluster").alias("qid"), "vec"), metric).select("id", F.col("qid").alias("cluster"), "distance")
    w = Window.partitionBy("id").orderBy("distance", "cluster")
    return scored.withColumn("rank", F.row_number().over(w)).select("id", "rank", "cluster", "distance")


def assign(vectors: DataFrame, centres: DataFrame, metric: str = "l2") -> DataFrame:
    """(id, cluster, distance) of the nearest of any number of centroids (cluster, vec), ties to the smaller cluster."""
    return least(vectors, "id", centres.select("cluster", "vec"), "cluster", lambda v, c: distance(metric, v, c["vec"]))
