"""A vector index: shard graphs with codes, built, searched and grown as DataFrames.

An index is one row for each shard, holding that shard's graph and codes as packed arrays;
rows are immutable, and every change makes a new version. Shards are built and searched
independently, one task each, and their answers merged by distance, so a search over many
shards is a union of graph searches. With one shard it is a search of one global graph.
Unless their number is given, shards are bounded in rows (about SHARD_ROWS). Rows are placed by
a hash of their id, or, with placement "centroid", near the centres of a sample, so that a query
need visit only the probe nearest of them. Queries stay a DataFrame of blocks.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nimbusvec.functions import rabitq

from nimbusvec.functions.distance import Metric, to_many
from nimbusvec.functions.layout import SHARD_HEADER, aligned, node_size, pack_pointer
from nimbusvec.functions.proximity import ESTIMATE_SLACK, Graph, Score, beam_search, build_graph, connect, exact_score, insert_rows, medoid_of, reached, single_score
from nimbusvec.operators.cluster import centres_of
from nimbusvec.operators.exact import matrix, nearest_of, top_k, unpacked, with_queries
from nimbusvec.schema import NODES, SHARDS, Params, check_dim, takes

#: Rows of a shard beyond which building and inserting ask for more shards: what one task builds in some seconds.
SHARD_ROWS = 2_500
#: Rows of a shard beyond which several tasks build it, in parts that overlap, and rows of such a part, about.
WHOLE_ROWS, PART_ROWS = 8_000, 3_000
#: The row of an index's codec and params.
CODEC = pa.schema({"params": pa.string(), "version": pa.int32(), "rotation": pa.list_(pa.float64()), "centroid": pa.list_(pa.float64()), "scale": pa.float64(), "centres": pa.list_(pa.float64()), "of_centre": pa.list_(pa.int64())})
#: Nodes that a task gives out at once, and rows of a table that is kept while an index is built, for each of its tasks, about.
NODE_ROWS, TASK_ROWS = 8_192, 8_192
#: Queries that go to a shard at once, pairs of query and row that a task has in memory, and rows of a beam that get their true distance at once.
QUERY_ROWS, STEP_CELLS, RERANK = 32_768, 1 << 22, 256


def _pack(shard: int, graph: Graph, codes: rabitq.Codes, bits: int) -> dict:
    return {
        "shard": shard, "n": len(graph.ids), "ids": graph.ids.astype("<i8").tobytes(), "vectors": graph.vectors.astype("<f4").tobytes(), "neighbors": graph.neighbours.astype("<i4").tobytes(), "medoid": graph.medoid,
        "codes": rabitq.pack_levels(codes.levels, bits).tobytes(), "add": codes.add.astype("<f8").tobytes(), "rescale": codes.rescale.astype("<f8").tobytes(),
    }


def _unpack(row: dict, dim: int, degree: int) -> Graph:
    n = row["n"]
    return Graph(np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["vectors"], "<f4").astype(float).reshape(n, dim), np.frombuffer(row["neighbors"], "<i4").astype(np.int64).reshape(n, degree).copy(), row["medoid"])


def _unpack_codes(row: dict, dim: int, bits: int) -> rabitq.Codes:
    n = row["n"]
    packed = np.frombuffer(row["codes"], np.uint8).reshape(n, -1)
    return rabitq.Codes(rabitq.unpack_levels(packed, dim, bits), np.frombuffer(row["add"]), np.frombuffer(row["rescale"]))


def centroid(vectors: DataFrame) -> DataFrame:
    """(pos, value): the mean of all vectors, by position from 0."""
    return _sums(vectors).select("pos", (F.col("s") / F.col("n")).alias("value"))


def _sums(vectors: DataFrame) -> DataFrame:
    """(pos, s, n): the sum of all vectors, by position, and their number. Tasks send their sums, not their vectors."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = None, 0
        for b in batches:
            if b.num_rows:
                part = matrix(b.column(0))
                total = part.sum(0) if total is None else total + part.sum(0)
                n += len(part)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total), pa.array(np.full(len(total), n))], ["pos", "s", "n"])

    sums = vectors.select("vec").where("vec is not null").mapInArrow(run, "pos int, s double, n long")
    return sums.groupBy("pos").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))


def mean_and_count(vectors: DataFrame, dim: int) -> tuple[np.ndarray, int]:
    """The mean on the driver, dim numbers, and of how many vectors it is, by one pass."""
    out, n = np.zeros(dim), 0
    for r in _sums(vectors).collect():
        out[r.pos], n = r.s / r.n, r.n
    return out, n


def medoid(vectors: DataFrame) -> DataFrame:
    """(id, distance): the vector nearest to the mean, ties by id; one row."""
    mean = F.broadcast(centroid(vectors).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda p: p["value"]).alias("m")))
    diff = F.zip_with("vec", "m", lambda a, b: (a.cast("double") - b) * (a.cast("double") - b))
    scored = vectors.join(mean).select("id", F.aggregate(diff, F.lit(0.0), lambda s, x: s + x).alias("distance"))
    return scored.agg(F.min_by("id", F.struct("distance", "id")).alias("id"), F.min("distance").alias("distance"))


def code_score(codec: rabitq.Codec, codes: rabitq.Codes, queries: np.ndarray, asked: int) -> Score:
    """Estimates for queries, of whose search each asks for so many at most: one product beforehand where that may be every row."""
    turned, *more = rabitq.prepare(codec, queries)
    of_all, n = (turned.astype(np.float32), *more), len(codes.levels)
    if asked < n:
        return lambda w, at: rabitq.estimate(codec, tuple(x[w] for x in of_all), codes, at).astype(np.float32)
    table = rabitq.estimate(codec, of_all, codes, np.broadcast_to(np.arange(n), (len(queries), n))).astype(np.float32)
    return lambda w, at: table[w[:, None], at]


def default_shards(n: int) -> int:
    return max(1, -(-n // SHARD_ROWS))


def _counted(params: Params, n: int) -> Params:
    """params with as many shards as n rows ask for, where none are given."""
    return params if params.shards else replace(params, shards=default_shards(n), more_shards=True)


def _nearest(vectors: DataFrame, centres: np.ndarray, take: int, *more: str) -> DataFrame:
    """(id, vec, ..., centre): each vector with its nearest centres, a row for each."""
    spark = vectors.sparkSession
    sent = spark.sparkContext.broadcast(centres)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                near = np.argsort(to_many(Metric.L2, matrix(b.column(1)), sent.value), axis=1, kind="stable")[:, :take]
                at = pa.array(np.repeat(np.arange(b.num_rows), near.shape[1]))
                yield pa.RecordBatch.from_arrays([*(c.take(at) for c in b.columns), pa.array(near.ravel().astype(np.int32))], ["id", "vec", *more, "centre"])

    rows = vectors.select("id", "vec", *more)
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("centre", T.IntegerType())]))


def _placed(vectors: DataFrame, codec: rabitq.Codec, params: Params) -> tuple[rabitq.Codec, Params]:
    """The codec with the centres that shards lie at, and params with as many shards as those make.

    A centre with more rows than two shards are meant for has several of them, dealt by hash.
    """
    centres = centres_of(vectors, params.shards, params.seed)
    sizes = {r.centre: r["count"] for r in _nearest(vectors, centres, 1).groupBy("centre").count().collect()}  # one row for each centre
    shares = [max(1, -(-sizes.get(c, 0) // (2 * SHARD_ROWS))) for c in range(len(centres))]
    of_centre = np.repeat(np.arange(len(centres)), shares)
    return replace(codec, centres=centres, of_centre=of_centre), replace(params, shards=len(of_centre))


def _with_shard(vectors: DataFrame, codec: rabitq.Codec, params: Params) -> DataFrame:
    """(id, vec, shard)."""
    if codec.centres is None:
        return vectors.select("id", "vec").withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(params.shards)).cast("int"))
    first = np.searchsorted(codec.of_centre, np.arange(len(codec.centres)))
    shares = np.bincount(codec.of_centre, minlength=len(codec.centres))
    pick = lambda values: F.element_at(F.array(*(F.lit(int(x)) for x in values)), F.col("centre") + 1)
    return _nearest(vectors, codec.centres, 1).select("id", "vec", (pick(first) + F.pmod(F.xxhash64("id"), pick(shares))).cast("int").alias("shard"))


def _part_graphs(placed: DataFrame, params: Params, parts: int, copies: int) -> DataFrame:
    """(shard, n, ids, neighbors, entry): graphs of the parts of each shard of placed (id, vec, shard), neighbours by id, -1 for none.

    Every vector goes to the parts of its copies nearest centres, and each part is built by a task
    of its own. A part with many more rows than meant is dealt by hash. The largest are built first.
    """
    centres = centres_of(placed, parts, params.seed)
    near = _nearest(placed, centres, copies, "shard").persist()
    sizes = {(r.shard, r.centre): r["count"] for r in near.groupBy("shard", "centre").count().collect()}  # one row for each part
    share_of = {k: max(1, round(n / PART_ROWS)) for k, n in sizes.items()}
    keys = sorted(sizes, key=lambda k: (-sizes[k] / share_of[k], k))
    shares = [share_of[k] for k in keys]
    first = np.cumsum([0, *shares])
    table = near.sparkSession.createDataFrame([(*map(int, k), int(f), int(m)) for k, f, m in zip(keys, first, shares, strict=False)], "shard int, centre int, first int, shares int")
    dealt = near.join(F.broadcast(table), ["shard", "centre"]).select((F.col("first") + F.pmod(F.xxhash64("id"), F.col("shares"))).cast("int").alias("part"), "shard", "id", "vec")
    own = replace(params, degree=max(1, params.degree // copies))

    def make(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for (part, shard), g in _groups(batches, ["part", "shard"]):
            ids = g.id.to_numpy()
            graph = build_graph(ids, np.stack(g.vec).astype(float), own.degree, own.beam_width_construction, own.build_alpha, own.seed + int(part), own.rounds, metric=own.metric, settled=False)
            yield pd.DataFrame([{"shard": shard, "n": len(ids), "ids": ids.astype("<i8").tobytes(), "neighbors": np.where(graph.neighbours >= 0, ids[graph.neighbours], -1).astype("<i8").tobytes(), "entry": ids[graph.medoid]}])

    return dealt.repartitionById(max(1, int(first[-1])), "part").mapInPandas(make, "shard int, n long, ids binary, neighbors binary, entry long")


def _by(rows: DataFrame, key: str, tasks: int) -> DataFrame:
    """rows dealt by key to so many tasks, or to as many as the session takes if those are fewer: a table that is kept has no partitions that are nearly empty, each of which costs every pass a start."""
    return rows.repartition(max(1, min(tasks, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))), key)


def _tasks(spark: SparkSession, n: int) -> int:
    return max(spark.sparkContext.defaultParallelism, -(-n // TASK_ROWS))


def _cogrouped(old: DataFrame, new: DataFrame, shards: int, grow: Callable, schema: str) -> DataFrame:
    """The shards that grow makes of each shard's rows of old and new."""
    return _by(old, "shard", 4 * shards).groupBy("shard").cogroup(_by(new, "shard", 4 * shards).groupBy("shard")).applyInPandas(grow, schema)


def _groups(batches: Iterable[pd.DataFrame], keys: list[str]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """The groups of a task's rows (id, ...) by keys, in order of id."""
    rows = [b for b in batches if len(b)]
    if rows:
        yield from pd.concat(rows).sort_values("id", kind="stable").groupby(keys)


def _merged(parts: pd.DataFrame, ids: np.ndarray, degree: int) -> np.ndarray:
    """The neighbours of sorted ids, as rows, put together from those of their parts."""
    out, used = np.full((len(ids), 0), -1, np.int64), np.zeros(len(ids), int)
    for r in parts.itertuples():
        own, near = np.searchsorted(ids, np.frombuffer(r.ids, "<i8")), np.frombuffer(r.neighbors, "<i8").reshape(r.n, -1)
        wide = near.shape[1]
        while out.shape[1] < (used[own].max() + 1) * wide:
            out = np.concatenate([out, np.full((len(ids), wide), -1)], axis=1)
        out[own[:, None], used[own][:, None] * wide + np.arange(wide)] = np.where(near >= 0, np.searchsorted(ids, near), -1)
        used[own] += 1
    out.sort(axis=1)
    out[:, 1:][out[:, 1:] == out[:, :-1]] = -1
    out = np.take_along_axis(out, np.argsort(out < 0, axis=1, kind="stable"), axis=1)
    return np.concatenate([out, np.full((len(ids), max(0, degree - out.shape[1])), -1)], axis=1)[:, :degree]


def _distinct(g: pd.DataFrame) -> pd.DataFrame:
    """g by id; of rows with one id the vector of the smallest components."""
    return (g.assign(parts=g.vec.map(tuple)).sort_values(["id", "parts"]).drop_duplicates("id") if g.id.duplicated().any() else g).sort_values("id")


def stitched(vectors: DataFrame, params: Params, parts: int, copies: int = 2) -> DataFrame:
    """(id, vec, neighbors, is_entry): one graph over all vectors, for any number of them, of degree params.degree at most.

    Every vector goes to the parts of its copies nearest centres; each part's graph is built by
    one task, and the edges of a vector's copies are put together. There are more parts than asked
    for where the rows are too many for them. is_entry marks the medoid of each part: searches
    start from all of them, and reach every vector. ids must be distinct.
    """
    clean = check_dim(vectors.select("id", "vec"), params.dim)
    parts = max(parts, -(-copies * clean.count() // PART_ROWS))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                ids, near = np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["neighbors"], "<i8").reshape(r["n"], -1)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([x[x >= 0] for x in near], pa.list_(pa.int64())), pa.array(ids == r["entry"])], ["id", "neighbors", "is_entry"])

    built = _part_graphs(clean.withColumn("shard", F.lit(0)), params, parts, copies).mapInArrow(run, "id long, neighbors array<long>, is_entry boolean")
    lists = built.groupBy("id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("neighbors")))).alias("neighbors"), F.max("is_entry").alias("is_entry"))
    return clean.join(lists, "id")


@dataclass(frozen=True)
class VectorIndex:
    """An index version. shards: table of SHARDS rows; codec: rotation, centroid and scale of its codes."""

    params: Params
    shards: DataFrame
    codec: rabitq.Codec
    version: int = 0
    #: The shards that an insert has written, where it left the others as they were.
    changed: DataFrame | None = None

    # ---- build ----

    @staticmethod
    def build(vectors: DataFrame, params: Params, mean: np.ndarray | None = None) -> VectorIndex:
        """An index of vectors (id, vec). Of rows with one id the vector of the smallest components stays.

        A task builds a shard by itself, or, of a shard that is too large for that, a part: rows go to
        the parts of their two nearest centres, whose edges are put together.
        """
        spark = vectors.sparkSession
        clean = check_dim(vectors.select("id", "vec"), params.dim)
        found, n = mean_and_count(clean, params.dim) if mean is None else (mean, clean.count())
        params, mean = _counted(params, n), found
        codec = rabitq.make_codec(mean, params.bits, params.seed)
        if params.placement == "centroid" and params.shards > 1:
            codec, params = _placed(clean, codec, params)
        sent = spark.sparkContext.broadcast((params, codec))

        def make(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            p, c = sent.value
            for (shard,), g in _groups(batches, ["shard"]):
                g = _distinct(g)
                v = np.stack(g.vec).astype(float)
                graph = build_graph(g.id.to_numpy(), v, p.degree, p.beam_width_construction, p.build_alpha, p.seed + int(shard), p.rounds, metric=p.metric)
                yield pd.DataFrame([_pack(int(shard), graph, rabitq.quantize(c, v), p.bits)])

        def assemble(key: tuple, g: pd.DataFrame, parts: pd.DataFrame) -> pd.DataFrame:
            p, c = sent.value
            g = g.sort_values("id")
            ids, v = g.id.to_numpy(), np.stack(g.vec).astype(float)
            graph = Graph(ids, v, _merged(parts, ids, p.degree), medoid_of(v, ids))
            connect(graph, p.metric)
            return pd.DataFrame([_pack(int(key[0]), graph, rabitq.quantize(c, v), p.bits)])

        placed = _with_shard(clean, codec, params)
        rows = n / params.shards
        if rows <= WHOLE_ROWS or params.degree < 2:
            # a task for each shard: they take long, and by hash some would get several
            return VectorIndex(params, placed.repartitionById(params.shards, "shard").mapInPandas(make, SHARDS).persist(), codec)
        placed = _by(placed, "id", _tasks(spark, n)).groupBy("id").agg(F.min(F.struct("vec", "shard")).alias("m")).select("id", "m.vec", "m.shard").persist()
        parts = _part_graphs(placed, params, math.ceil(2 * rows / PART_ROWS), 2)
        return VectorIndex(params, _cogrouped(placed, parts, params.shards, assemble, SHARDS).persist(), codec)

    @staticmethod
    def empty(spark: SparkSession, params: Params) -> VectorIndex:
        params = _counted(params, 0)
        return VectorIndex(params, spark.createDataFrame([], SHARDS), rabitq.make_codec(np.zeros(params.dim), params.bits, params.seed))

    # ---- search ----

    def search(self, queries: DataFrame, k: int, mode: str = "exact", beam_width: int | None = None, rerank: bool = True) -> DataFrame:
        """(qid, rank, id, distance): about the k nearest of each query (qid, vec), by graph search.

        mode exact scores by distances in single precision, and in the end the beam by true ones; quantized by codes, with a longer beam, all of which
        is scored exactly in the end (rerank=False: the estimates are the answer). An empty
        index finds nothing; k may not exceed the beam width.
        """
        p, spark = self.params, self.shards.sparkSession
        width = beam_width or p.beam_width
        if k < 1 or width < k:
            raise ValueError("k must be at least 1 and at most the beam width")
        if mode not in ("exact", "quantized"):
            raise ValueError("mode is exact or quantized")
        sent = spark.sparkContext.broadcast((p, self.codec))

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            p, codec = sent.value
            for b in batches:
                for row in b.to_pylist():
                    qids, q = unpacked(row["qids"], row["qvecs"], row["qdim"])
                    if codec.centres is not None and 0 < p.probe < len(codec.centres):
                        near = np.argsort(to_many(Metric.L2, q, codec.centres), axis=1, kind="stable")[:, : p.probe]
                        asks = (near == codec.of_centre[row["shard"]]).any(1)
                        qids, q = qids[asks], q[asks]
                    graph = _unpack(row, p.dim, p.degree)
                    codes = _unpack_codes(row, p.dim, p.bits) if mode == "quantized" else None
                    all_rows = np.sort(reached(graph)) if codes is None and width >= row["n"] else None
                    step = max(1, min(256 if all_rows is None else 1024, STEP_CELLS // max(1, row["n"])))
                    for i in range(0, len(q), step):
                        own = q[i : i + step]
                        if codes is None and width >= row["n"]:  # the beam drops no row that it reaches
                            at, ids, d = nearest_of(own, qids[i : i + step], graph.vectors[all_rows], graph.ids[all_rows], k, p.metric, False)
                            yield pa.RecordBatch.from_arrays([pa.array(qids[i + at]), pa.array(ids), pa.array(d)], ["qid", "id", "distance"])
                            continue
                        if codes is None:
                            score = single_score(graph, own, p.metric)
                        else:
                            score = code_score(codec, codes, own, (width + ESTIMATE_SLACK) * p.degree)
                        rows, d, _ = beam_search(graph, len(own), score, width + (ESTIMATE_SLACK if codes else 0))
                        if codes is None or rerank:
                            exact, who = exact_score(graph, own, p.metric), np.arange(len(own))
                            for j in range(0, rows.shape[1], RERANK):
                                part = rows[:, j : j + RERANK]
                                d[:, j : j + RERANK] = np.where(part >= 0, exact(who, np.maximum(part, 0)), np.inf)
                        ids = np.where(rows >= 0, graph.ids[rows], np.iinfo(np.int64).max)
                        order = np.lexsort((ids, d), axis=1)[:, :k]
                        ids, d = np.take_along_axis(ids, order, 1), np.take_along_axis(d, order, 1)
                        at, slot = np.nonzero(np.isfinite(d))
                        yield pa.RecordBatch.from_arrays([pa.array(qids[i + at]), pa.array(ids[at, slot]), pa.array(d[at, slot])], ["qid", "id", "distance"])

        pairs = with_queries(self.shards, check_dim(queries, p.dim), QUERY_ROWS)
        return top_k(pairs.mapInArrow(run, "qid long, id long, distance double"), k)

    def visited(self, queries: DataFrame, width: int) -> DataFrame:
        """(qid, id, distance) of every vector that a search of that beam width scores: the builder's candidates."""
        p = self.params

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for row in b.to_pylist():
                    qids, q = unpacked(row["qids"], row["qvecs"], row["qdim"])
                    graph = _unpack(row, p.dim, p.degree)
                    step = max(1, min(1024, STEP_CELLS // max(1, row["n"])))
                    for i in range(0, len(q), step):
                        own = q[i : i + step]
                        for qid, one, scored in zip(qids[i : i + step], own, beam_search(graph, len(own), exact_score(graph, own, p.metric), width)[2], strict=True):
                            rows = np.flatnonzero(scored)
                            d = to_many(p.metric, one[None], graph.vectors[rows])[0]
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), qid)), pa.array(graph.ids[rows]), pa.array(d)], ["qid", "id", "distance"])

        return with_queries(self.shards, check_dim(queries, p.dim)).mapInArrow(run, "qid long, id long, distance double")

    # ---- maintenance ----

    def outcomes(self, vectors: DataFrame) -> DataFrame:
        """(id, inserted, known, repeated, refused): what insert() would do with the rows (id, vec) of each id, as numbers of rows.

        Refused are rows of a null id or vector, or of another dimension; of an id that the
        index hasn't one row is inserted, and the others are repeated.
        """
        fits = takes(vectors, self.params.dim)
        sums = vectors.select("id", fits.cast("long").alias("fits")).groupBy("id").agg(F.sum("fits").alias("good"), F.sum(1 - F.col("fits")).alias("refused"))
        both = sums.join(self.ids().withColumn("has", F.lit(True)), "id", "left")
        new = F.col("has").isNull()
        one = F.least("good", F.lit(1).cast("long"))
        zero = F.lit(0).cast("long")
        return both.select("id", F.when(new, one).otherwise(zero).alias("inserted"), F.when(new, zero).otherwise(F.col("good")).alias("known"), F.when(new, F.col("good") - one).otherwise(zero).alias("repeated"), "refused")

    def insert(self, vectors: DataFrame, strict: bool = True) -> VectorIndex:
        """The next version, with vectors (id, vec) added; ids that the index has, and repeats, are left out.

        Rows that outcomes() calls refused make the insert fail, or with strict=False are left out. An index whose shards were not given is built anew on more of them where the rows ask for more.
        """
        p, spark = self.params, self.shards.sparkSession
        known = self.ids()
        fits = takes(vectors, p.dim)
        fails = F.raise_error(F.lit(f"a row has a null id, or a vector that is null, holds nulls or has another dimension than {p.dim}"))
        vectors = vectors.withColumn("vec", F.when(fits, F.col("vec")).otherwise(fails)) if strict else vectors.where(fits)
        # each row is looked up once, though several jobs read what is new
        new = _by(vectors.select("id", "vec"), "id", _tasks(spark, vectors.count())).groupBy("id").agg(F.min("vec").alias("vec")).join(known, "id", "left_anti").persist()
        if p.more_shards and default_shards(n := self.count() + new.count()) > p.shards:
            rows = self.nodes().select("id", "vec").unionByName(new).persist()
            built = replace(VectorIndex.build(rows, replace(p, shards=default_shards(n))), version=self.version + 1)
            built.count()  # kept now, so the rows it is made of need not be
            rows.unpersist()
            new.unpersist()
            return built
        add = _with_shard(new, self.codec, p)
        sent = spark.sparkContext.broadcast((p, self.codec))

        def grow(key: tuple, old: pd.DataFrame, add: pd.DataFrame) -> pd.DataFrame:
            p, codec = sent.value
            graph = _unpack(old.iloc[0].to_dict(), p.dim, p.degree) if len(old) else Graph(np.empty(0, np.int64), np.empty((0, p.dim)), np.empty((0, p.degree), np.int64), 0)
            if len(old) and not len(add):
                return old
            add = add.sort_values("id")
            graph = insert_rows(graph, add.id.to_numpy(), np.stack(add.vec).astype(float), p.beam_width_construction, p.alpha, p.metric, p.keep_all_if_small)
            return pd.DataFrame([_pack(int(key[0]), graph, rabitq.quantize(codec, graph.vectors), p.bits)])

        # only shards with new rows are read and written; their numbers are at most as many as the shards
        touched = F.col("shard").isin([r.shard for r in add.select("shard").distinct().collect()])
        grown = _cogrouped(self.shards.where(touched), add, p.shards, grow, SHARDS).persist()
        grown.count()
        new.unpersist()
        return replace(self, shards=self.shards.where(~touched).unionByName(grown).persist(), version=self.version + 1, changed=grown)

    # ---- views ----

    def ids(self) -> DataFrame:
        """(id) of all nodes; vectors and edges are not read."""

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for raw in b.column(0).to_pylist():
                    yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(raw, "<i8"))], ["id"])

        return self.shards.select("ids").mapInArrow(run, "id long")

    def nodes(self, medoids: bool = False) -> DataFrame:
        """One row for each node, or for each shard's medoid alone, as NODES; neighbours by id, offsets by place in the shard."""
        p = self.params
        size = aligned(node_size(p.dim, p.degree, p.bits))
        names = [x.strip().split()[0] for x in NODES.split(",")]

        def lists(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.Array:
            return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values, kind))

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for row in b.to_pylist():
                    n = row["n"]
                    ids, add, rescale = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["add"]), np.frombuffer(row["rescale"])
                    vectors, near, codes = np.frombuffer(row["vectors"], "<f4").reshape(n, p.dim), np.frombuffer(row["neighbors"], "<i4").reshape(n, p.degree), np.frombuffer(row["codes"], np.uint8).reshape(n, -1)
                    for at in [np.array([row["medoid"]])] if medoids else np.split(np.arange(n), range(NODE_ROWS, n, NODE_ROWS)):
                        k, has = len(at), near[at] >= 0
                        columns = [
                            pa.array(ids[at]), pa.array(np.full(k, row["shard"], np.int32)), pa.array(16 + at * size), lists(vectors[at].ravel(), np.full(k, p.dim), pa.float32()), pa.array(at == row["medoid"]),
                            pa.FixedSizeBinaryArray.from_buffers(pa.binary(codes.shape[1]), k, [None, pa.py_buffer(codes[at].tobytes())]).cast(pa.binary()), pa.array(add[at].astype(np.float32)), pa.array(rescale[at].astype(np.float32)),
                            lists(ids[near[at][has]], has.sum(1), pa.int64()),
                        ]
                        yield pa.RecordBatch.from_arrays(columns, names)

        return self.shards.mapInArrow(run, NODES)

    def edges(self) -> DataFrame:
        """(src, pos, dst), pos from 0."""
        return self.nodes().select(F.col("id").alias("src"), F.posexplode("neighbors").alias("pos", "dst"))

    def degree_stats(self) -> DataFrame:
        d = F.size("neighbors")
        return self.nodes().agg(F.count("*").alias("n"), F.avg(d).alias("avg_degree"), F.max(d).alias("max_degree"), F.min(d).alias("min_degree"))

    def medoids(self) -> DataFrame:
        """(shard, id, pointer) of each shard's entry node."""
        size = aligned(node_size(self.params.dim, self.params.degree, self.params.bits))

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                at = [np.frombuffer(raw, "<i8")[m] if raw else None for raw, m in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(at, pa.int64()), b.column(2)], ["shard", "id", "medoid"])

        # vectors, edges and codes are not read
        of_shard = self.shards.select("shard", "ids", "medoid").mapInArrow(run, "shard int, id long, medoid int").where("id is not null")
        return of_shard.select("shard", "id", pack_pointer(F.col("shard"), F.lit(SHARD_HEADER) + F.col("medoid").cast("long") * size).alias("pointer"))

    def bfs_sample(self, limit: int = 500) -> DataFrame:
        """(shard, id): the first nodes of each shard in breadth-first order from its medoid."""
        p = self.params

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for row in b.to_pylist():
                    g = _unpack(row, p.dim, p.degree)
                    ids = g.ids[reached(g, limit)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), row["shard"], np.int32)), pa.array(ids)], ["shard", "id"])

        return self.shards.mapInArrow(run, "shard int, id long")

    def unreachable(self) -> DataFrame:
        """(shard, n): nodes of each shard that its medoid doesn't reach."""
        sample = self.bfs_sample(1 << 62).groupBy("shard").count()
        return self.shards.select("shard", "n").join(sample, "shard").select("shard", (F.col("n") - F.col("count")).alias("n"))

    def count(self) -> int:
        return int(self.shards.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])

    @property
    def dimension(self) -> int:
        return self.params.dim

    def status(self) -> dict:
        return {"version": self.version, "num_vectors": self.count(), **self.params.as_dict()}

    # ---- files ----

    def save(self, path: str) -> None:
        """Write the index below path, one Parquet partition for each shard; params and codec as one row."""
        self.shards.write.mode("overwrite").partitionBy("shard").parquet(f"{path}/shards")
        self.save_codec(path)

    def save_codec(self, path: str) -> None:
        p = self.params
        many = lambda x: None if x is None else x.ravel().tolist()
        row = {"params": json.dumps(p.as_dict()), "version": self.version, "rotation": many(self.codec.rotation.T), "centroid": many(self.codec.centroid), "scale": self.codec.scale, "centres": many(self.codec.centres), "of_centre": many(self.codec.of_centre)}
        # by Arrow: no task of Python is started for one row
        self.shards.sparkSession.createDataFrame(pa.Table.from_pylist([row], CODEC)).coalesce(1).write.mode("overwrite").parquet(f"{path}/codec")

    @staticmethod
    def load(spark: SparkSession, path: str, expect: Params | None = None, shards: DataFrame | None = None) -> VectorIndex:
        """An index that save() wrote, or one of the given shards; expect's dim, bits and metric must be the stored ones."""
        row = spark.read.parquet(f"{path}/codec").first()
        p = Params(**json.loads(row.params))
        if expect and (expect.dim, expect.bits, expect.metric) != (p.dim, p.bits, p.metric):
            raise ValueError(f"the stored index has dim {p.dim}, bits {p.bits}, metric {p.metric}")
        turn = np.array(row.rotation).reshape(p.dim, p.dim).T
        if not np.allclose(turn @ turn.T, np.eye(p.dim), atol=1e-6):
            raise ValueError("the stored rotation is not orthogonal")
        codec = rabitq.Codec(turn, np.array(row.centroid), p.bits, row.scale)
        if row.centres is not None:
            codec = replace(codec, centres=np.array(row.centres).reshape(-1, p.dim), of_centre=np.array(row.of_centre))
        return VectorIndex(p, spark.read.schema(SHARDS).parquet(f"{path}/shards") if shards is None else shards, codec, row.version)


def self_recall(index: VectorIndex, vectors: DataFrame, queries: DataFrame, k: int) -> float:
    """Recall of graph search against brute force, the query itself left out on both sides."""
    from nimbusvec.operators.exact import knn, recall

    found = index.search(queries, min(k + 1, index.params.beam_width)).where("id <> qid").select("qid", "id", "distance")
    got = recall(top_k(found, k), knn(vectors, queries, k, index.params.metric, without_self=True), (k,)).first()
    return float(got.recall) if got else 0.0


