"""The registered queries of the vector engine over the driver's tables, and their SQL where it exists.

Searches take as queries every row whose id is divisible by 50, against all rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nimbusvec.functions import breakdown as B
from nimbusvec.functions import layout as L
from nimbusvec.functions.distance import ip_negative, l2_squared
from nimbusvec.operators import cluster, exact, graph_ops, routing
from nimbusvec.plans import index as ix
from nimbusvec.plans.index import VectorIndex
from nimbusvec.schema import Params
from nimbusvec.sources import config, index_files, scratch, synthetic, vector_files
from nimbusvec.streaming.inserts import IndexFolder

K = 10
SHARDS, DEGREE, BITS, DIM = 3, 32, 4, 64


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<float>").alias("vec"))


def _queries(spark: SparkSession, d: str) -> DataFrame:
    return _vectors(spark, d).where(F.col("id") % 50 == 0).withColumnRenamed("id", "qid")


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), 6) for c in columns})


def _params(**more) -> Params:
    return Params(dim=DIM, degree=DEGREE, bits=BITS, **more)


def _index(spark: SparkSession, d: str, **more) -> VectorIndex:
    v = _vectors(spark, d)
    return VectorIndex.build(v, _params(**more))


# ---- distances and exact search ----


def dist_l2(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(exact.distances(_vectors(spark, d), _queries(spark, d)), "distance")


def dist_ip(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(exact.distances(_vectors(spark, d), _queries(spark, d), "ip"), "distance")


def dist_ip_negative(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(exact.distances(_vectors(spark, d), _queries(spark, d), ip_negative), "distance")


def knn_exact_l2(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(exact.knn(_vectors(spark, d), _queries(spark, d), K), "distance")


def knn_exact_ip(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(exact.knn(_vectors(spark, d), _queries(spark, d), K, "ip"), "distance")


def knn_exact_noself(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(exact.knn(_vectors(spark, d), _queries(spark, d), K, without_self=True), "distance")


def knn_expressions(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(exact.top_k(exact.distances(_vectors(spark, d), _queries(spark, d)), K), "distance")


def recall_at_k(spark: SparkSession, d: str) -> DataFrame:
    """Recall of a search on the first half of the components against the whole vectors."""
    v, q = _vectors(spark, d), _queries(spark, d)
    half = lambda df: df.withColumn("vec", F.slice("vec", 1, DIM // 2))
    return _rounded(exact.recall(exact.knn(half(v), half(q), K), exact.knn(v, q, K)), "recall")


# ---- layout ----


def _size() -> int:
    return L.node_size(DIM, DEGREE, BITS)


def shard_assign(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    return v.select("id", L.shard_of(F.col("id"), SHARDS).alias("shard"), L.offset_of(F.col("id"), SHARDS, _size()).alias("offset"))


def shard_place(spark: SparkSession, d: str) -> DataFrame:
    return index_files.place(_vectors(spark, d), SHARDS, _size())


def remote_ptr(spark: SparkSession, d: str) -> DataFrame:
    at = shard_assign(spark, d).withColumn("pointer", L.pack_pointer(F.col("shard"), F.col("offset")))
    return at.select("id", "pointer", L.pointer_shard(F.col("pointer")).alias("shard"), L.pointer_offset(F.col("pointer")).alias("offset"))


def shard_sizes(spark: SparkSession, d: str) -> DataFrame:
    return shard_assign(spark, d).groupBy("shard").agg(F.count("*").alias("nodes"), (F.max("offset") + F.lit(L.aligned(_size()))).alias("bytes"))


def node_sizes(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(b, L.node_size(DIM, DEGREE, b), L.code_bytes(DIM, b)) for b in L.BITS_ALLOWED], "bits int, node_size int, code_bytes int")


def hash_mix64(spark: SparkSession, d: str) -> DataFrame:
    return _vectors(spark, d).select("id", L.mix64("id").alias("h"))


def hash_split_mix64(spark: SparkSession, d: str) -> DataFrame:
    return _vectors(spark, d).select("id", L.split_mix64("id").alias("h"))


def partition_read(spark: SparkSession, d: str) -> DataFrame:
    """How many rows each of three clients reads, and their ids' sum."""
    parts = [vector_files.partition(_vectors(spark, d), c, SHARDS).agg(F.lit(c).alias("client"), F.count("*").alias("n"), F.sum("id").alias("ids")) for c in range(SHARDS)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# ---- statistics, lookups, pruning ----


def centroid(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(ix.centroid(_vectors(spark, d)), "value")


def medoid(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(ix.medoid(_vectors(spark, d)), "distance")


def _knn_graph(spark: SparkSession, d: str) -> DataFrame:
    """(id, neighbors): the ten nearest others of every row."""
    v = _vectors(spark, d)
    near = exact.knn(v, v.withColumnRenamed("id", "qid"), K, without_self=True)
    return near.groupBy(F.col("qid").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda p: p["id"]).alias("neighbors"))


def neighbor_lookup(spark: SparkSession, d: str) -> DataFrame:
    g = _knn_graph(spark, d)
    return graph_ops.neighbours(g, g.select("id"))


def point_lookup(spark: SparkSession, d: str) -> DataFrame:
    return graph_ops.lookup(_vectors(spark, d), _queries(spark, d).withColumnRenamed("qid", "id"), "vec").select("id", F.size("vec").alias("dim"))


def reverse_edges(spark: SparkSession, d: str) -> DataFrame:
    edges = _knn_graph(spark, d).select(F.col("id").alias("src"), F.explode("neighbors").alias("dst"))
    return graph_ops.reverse_candidates(edges).select("id", F.array_join("candidates", ",").alias("sources"))


def degree_stats(spark: SparkSession, d: str) -> DataFrame:
    """In-degrees of the nearest-neighbour graph, of rows that are nobody's neighbour too."""
    edges = _knn_graph(spark, d).select(F.explode("neighbors").alias("dst")).groupBy("dst").count()
    degrees = _vectors(spark, d).select(F.col("id").alias("dst")).join(edges, "dst", "left").select(F.coalesce("count", F.lit(0)).alias("count"))
    return degrees.agg(F.count("*").alias("n"), F.round(F.avg("count"), 6).alias("avg_degree"), F.max("count").alias("max_degree"), F.min("count").alias("min_degree"))


def prune_l2(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    pairs = exact.knn(v, v.withColumnRenamed("id", "qid"), 64, without_self=True).select(F.col("qid").alias("src"), F.col("id").alias("dst"))
    return graph_ops.prune_table(pairs, v, 16, 1.2)


# ---- graph, codes, inserts ----


def _n(spark: SparkSession, d: str) -> int:
    return max(K, _vectors(spark, d).count())


def beam_full(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_index(spark, d).search(_queries(spark, d), K, beam_width=_n(spark, d)), "distance")


def beam_32(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_index(spark, d).search(_queries(spark, d), K), "distance")


def beam_sharded(spark: SparkSession, d: str) -> DataFrame:
    """Three shard graphs, their answers merged; the beam holds a whole shard."""
    return _rounded(_index(spark, d, shards=SHARDS).search(_queries(spark, d), K, beam_width=_n(spark, d)), "distance")


def builder_visited(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_index(spark, d, shards=1).visited(_queries(spark, d), 64), "distance")


def frontier_full(spark: SparkSession, d: str) -> DataFrame:
    """The search that joins its frontier, on one global graph."""
    scratch.root(spark)
    nodes = _index(spark, d, shards=1).nodes().persist()
    return _rounded(graph_ops.frontier_search(nodes, nodes.where("is_medoid"), _queries(spark, d), _n(spark, d), K), "distance")


def graph_degrees(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d).degree_stats()


def bfs_sample(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d, shards=1).bfs_sample(500)


def rabitq_rerank_full(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_index(spark, d).search(_queries(spark, d), K, "quantized", _n(spark, d)), "distance")


def rabitq_4bit(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_index(spark, d).search(_queries(spark, d), K, "quantized"), "distance")


def rabitq_codes(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d).nodes().select("id", F.octet_length("code").alias("code_bytes"), "add", "rescale")


def insert_then_search(spark: SparkSession, d: str) -> DataFrame:
    """Built on the even ids, the odd ones inserted."""
    v = _vectors(spark, d)
    i = VectorIndex.build(v.where(F.col("id") % 2 == 0), _params()).insert(v.where(F.col("id") % 2 == 1))
    return _rounded(i.search(_queries(spark, d), K, beam_width=_n(spark, d)), "distance")


def insert_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Into an index of the even ids: all rows, every fifth id twice, every seventh also with half a vector."""
    v = _vectors(spark, d)
    cut = v.where(F.col("id") % 7 == 0).withColumn("vec", F.slice("vec", 1, DIM // 2))
    return VectorIndex.build(v.where(F.col("id") % 2 == 0), _params()).outcomes(v.unionByName(v.where(F.col("id") % 5 == 0)).unionByName(cut))


def stream_insert(spark: SparkSession, d: str) -> DataFrame:
    """The even ids built, the odd ones streamed in."""
    v, at = _vectors(spark, d), scratch.new(spark, "stream")
    v.where(F.col("id") % 2 == 1).write.parquet(f"{at}/in")
    folder = IndexFolder(spark, f"{at}/index", _params())
    folder.start(VectorIndex.build(v.where(F.col("id") % 2 == 0), _params()))
    folder.follow(spark.readStream.schema(v.schema).parquet(f"{at}/in"), f"{at}/progress").awaitTermination()
    return _rounded(folder.index().search(_queries(spark, d), K, beam_width=_n(spark, d)), "distance")


def _quality(found: DataFrame, v: DataFrame, q: DataFrame, least: float) -> DataFrame:
    """(queries, rows, distances_exact, recall_reached) of a search's answers against brute force."""
    found, truth = found.persist(), exact.knn(v, q, K).persist()
    exact_too = found.join(v, "id").join(q.withColumnRenamed("vec", "qvec"), "qid").select("qid", (F.abs(F.col("distance") - l2_squared(F.col("vec"), F.col("qvec"))) < 1e-9).alias("same"))
    rows = exact_too.agg(F.countDistinct("qid").alias("queries"), F.count("*").alias("rows"), F.bool_and("same").alias("distances_exact"))
    got = exact.recall(found, truth, (K,)).select((F.col("recall") >= least).alias("recall_reached"))
    return rows.crossJoin(got)


def beam_32_recall(spark: SparkSession, d: str) -> DataFrame:
    q = _queries(spark, d)
    return _quality(_index(spark, d).search(q, K), _vectors(spark, d), q, 0.9)


def rabitq_4bit_recall(spark: SparkSession, d: str) -> DataFrame:
    q = _queries(spark, d)
    return _quality(_index(spark, d).search(q, K, "quantized"), _vectors(spark, d), q, 0.9)


def probed_recall(spark: SparkSession, d: str) -> DataFrame:
    """Eight shards at centres, of which a query visits three."""
    q = _queries(spark, d)
    return _quality(_index(spark, d, shards=8, placement="centroid", probe=3).search(q, K), _vectors(spark, d), q, 0.6)


def stitched_full(spark: SparkSession, d: str) -> DataFrame:
    """One graph put together from four overlapping parts, searched by joins; the beam holds every row."""
    scratch.root(spark)
    nodes = ix.stitched(_vectors(spark, d), _params(), 4).persist()
    return _rounded(graph_ops.frontier_search(nodes, nodes.where("is_entry"), _queries(spark, d), _n(spark, d), K), "distance")


def graph_invariants(spark: SparkSession, d: str) -> DataFrame:
    """What a built graph may not have: rows too many, slots too many, edges to oneself or twice, edges to nowhere, rows out of reach."""
    i = _index(spark, d, shards=1)
    nodes = i.nodes().persist()
    near = F.col("neighbors")
    out = nodes.agg(
        F.count("*").alias("nodes"), F.sum(F.col("is_medoid").cast("long")).alias("medoids"), F.sum((F.size(near) > DEGREE).cast("long")).alias("overfull"),
        F.sum(F.array_contains(near, F.col("id")).cast("long")).alias("loops"), F.sum((F.size(F.array_distinct(near)) < F.size(near)).cast("long")).alias("repeats"),
    )
    nowhere = nodes.select(F.explode(near).alias("id")).distinct().join(nodes.select("id"), "id", "left_anti").agg(F.count("*").alias("nowhere"))
    return out.crossJoin(nowhere).crossJoin(i.unreachable().agg(F.sum("n").alias("unreached")))


def visited_invariants(spark: SparkSession, d: str) -> DataFrame:
    """Each scored row once a query, at its true distance, the query's own row among them."""
    v, q = _vectors(spark, d), _queries(spark, d)
    seen = _index(spark, d).visited(q, 64)
    both = seen.join(v, "id").join(q.withColumnRenamed("vec", "qvec"), "qid")
    return both.groupBy("qid").agg(
        (F.count("*") == F.countDistinct("id")).alias("once"), F.bool_and(F.abs(F.col("distance") - l2_squared(F.col("vec"), F.col("qvec"))) < 1e-9).alias("exact"), F.bool_or(F.col("id") == F.col("qid")).alias("found")
    )


def bfs_invariants(spark: SparkSession, d: str) -> DataFrame:
    """A breadth-first sample of a hundred: how many, how often the medoid, and whether all are rows of the index."""
    i = _index(spark, d, shards=1)
    return i.bfs_sample(100).join(i.nodes().select("id", "is_medoid"), "id", "left").agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"), F.sum(F.col("is_medoid").cast("long")).alias("medoids"), F.bool_and(F.col("is_medoid").isNotNull()).alias("known"))


def node_read(spark: SparkSession, d: str) -> DataFrame:
    """Whole nodes of the query rows: vector, code and factors of the right sizes."""
    keys = _queries(spark, d).withColumnRenamed("qid", "id")
    read = graph_ops.lookup(_index(spark, d).nodes(), keys, "vec", "code", "add", "rescale", "neighbors")
    whole = F.col("add").isNotNull() & (F.col("rescale") < 0) & F.size("neighbors").between(1, DEGREE)
    return read.select("id", F.round(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double")), 5).alias("total"), F.octet_length("code").alias("code_bytes"), whole.alias("whole"))


def medoid_pointer(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d, shards=1).medoids()


def neighbor_update(spark: SparkSession, d: str) -> DataFrame:
    """The lists of the query rows written anew: themselves and their id's successor."""
    g = _vectors(spark, d).select("id", F.array((F.col("id") + 1), (F.col("id") + 2)).alias("neighbors"))
    new = _queries(spark, d).select(F.col("qid").alias("id"), F.array("qid").alias("neighbors"))
    return graph_ops.neighbours(graph_ops.with_neighbours(g, new), g.select("id"))


def code_estimates(spark: SparkSession, d: str) -> DataFrame:
    """Per bits of a code: that its levels are stored in the right number of bytes and that estimates have hardly a bias and no more than a given error."""
    v, q = _vectors(spark, d), _queries(spark, d)
    most = {1: 0.4, 2: 0.15, 4: 0.05, 8: 0.006}
    parts = []
    for bits, error in most.items():
        i = VectorIndex.build(v, Params(dim=DIM, degree=8, bits=bits, rounds=1, beam_width_construction=8, shards=1))
        found = i.search(q, K, "quantized", 32, rerank=False).join(v, "id").join(q.withColumnRenamed("vec", "qvec"), "qid")
        true = l2_squared(F.col("vec"), F.col("qvec"))
        off = found.where("id <> qid").agg((F.avg(F.abs(F.col("distance") - true)) < error).alias("near"))
        parts.append(i.nodes().agg(F.lit(bits).alias("bits"), F.count("*").alias("n"), F.min(F.octet_length("code")).alias("least_bytes"), F.max(F.octet_length("code")).alias("most_bytes")).crossJoin(off))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def typed_files(spark: SparkSession, d: str) -> DataFrame:
    """Small whole components through the files of unsigned and of signed bytes."""
    parts = []
    for ending, low in ((".u8bin", 0), (".i8bin", 100)):
        path = f"{scratch.new_folder(spark, 'typed')}/base{ending}"
        rows = _vectors(spark, d).select("id", F.array(*(((F.col("id") * 7 + j * 13) % 100 - low).cast("float") for j in range(5))).alias("vec"))
        vector_files.write_vectors(rows, path)
        parts.append(vector_files.read_vectors(spark, path).select(F.lit(ending).alias("kind"), "id", F.posexplode("vec").alias("pos", "x")).withColumn("x", F.col("x").cast("int")))
    return parts[0].unionByName(parts[1])


def meta_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Metadata and rotation files as written and read again, and whether they are refused for another index."""
    prefix = f"{scratch.new_folder(spark, 'meta')}/index"
    i = _index(spark, d, shards=SHARDS)
    index_files.save_meta(index_files.write_shards(i.nodes(), i.params, prefix), i.codec, prefix)
    meta, codec = index_files.load_meta(prefix, i.params)
    try:
        index_files.load_meta(prefix, Params(dim=DIM, bits=8))
        refused = False
    except ValueError:
        refused = True
    row = (meta["num_vectors"], meta["dim"], meta["R"], meta["rabitq_bits"], meta["num_memory_nodes"], meta["node_size"], bool(np.allclose(codec.rotation, i.codec.rotation, atol=1e-6)), refused)
    return spark.createDataFrame([row], "n long, dim int, degree int, bits int, shards int, node_size int, same_rotation boolean, refused boolean")


def settings(spark: SparkSession, d: str) -> DataFrame:
    """A settings file, read."""
    s = config.service("# a service\nservers = a b c\nclients=d\ndim = 64 ; wide\nR = 24\nbeam-width=48\nk = 10\nip-dist = yes\nsearch-mode = exact_gpu\nrouting = on\n")
    row = (",".join(s.servers), ",".join(s.clients), s.params.dim, s.params.degree, s.params.beam_width, s.k, s.params.metric, s.mode, s.routing)
    return spark.createDataFrame([row], "servers string, clients string, dim int, degree int, beam_width int, k int, metric string, mode string, routing boolean")


# ---- clustering and routing ----


def _centres(spark: SparkSession, d: str) -> DataFrame:
    """The mean of each label."""
    rows = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("label").alias("cluster"), F.posexplode("embedding").alias("pos", "x"))
    means = rows.groupBy("cluster", "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return means.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"]).alias("vec"))


def assign_nearest_centroid(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(cluster.assign(_vectors(spark, d), _centres(spark, d)), "distance")


def rank_centroids(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(cluster.ranked(_vectors(spark, d), _centres(spark, d)), "distance")


def lloyd_step(spark: SparkSession, d: str) -> DataFrame:
    """One round of k-means from the label means, in long form."""
    return cluster.lloyd_table(_vectors(spark, d), _centres(spark, d), rounds=1).select("cluster", F.posexplode("vec").alias("pos", "x")).withColumn("x", F.round("x", 6))


def kmeans_2(spark: SparkSession, d: str) -> DataFrame:
    """Two rounds of k-means from the label means."""
    return cluster.lloyd_table(_vectors(spark, d), _centres(spark, d), rounds=2, tolerance=-1.0).select("cluster", F.posexplode("vec").alias("pos", "x")).withColumn("x", F.round("x", 6))


def kmeans(spark: SparkSession, d: str) -> DataFrame:
    return cluster.lloyd_table(_vectors(spark, d), _centres(spark, d)).select("cluster", F.posexplode("vec").alias("pos", "x"))


def _sample(spark: SparkSession, d: str, most: int) -> np.ndarray:
    """The rows of the smallest hashes, so many at most, for fitting in memory; every row of the table is assigned."""
    rows = _vectors(spark, d).orderBy(F.xxhash64("id"), "id").limit(most).collect()
    return np.array([r.vec for r in rows], float).reshape(-1, DIM)


def balanced_kmeans(spark: SparkSession, d: str) -> DataFrame:
    return cluster.balanced_table(_vectors(spark, d), cluster.balanced(_sample(spark, d, cluster.BALANCED_ROWS), 5)[0])


def balanced_sizes(spark: SparkSession, d: str) -> DataFrame:
    """The sizes of balanced clusters, largest first."""
    sizes = balanced_kmeans(spark, d).groupBy("cluster").agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"))
    return sizes.select((F.row_number().over(Window.orderBy(F.desc("n"), "cluster")) - 1).alias("place"), "n", "ids")


def odd_kmeans(spark: SparkSession, d: str) -> DataFrame:
    return cluster.odd_table(_vectors(spark, d), _sample(spark, d, cluster.SAMPLE_ROWS), 3)


def farthest_first(spark: SparkSession, d: str) -> DataFrame:
    return cluster.farthest_table(_vectors(spark, d), 8)


def _clients(spark: SparkSession, d: str) -> DataFrame:
    return _centres(spark, d).select(F.col("cluster").alias("client"), "vec", (F.col("cluster") % 4).alias("inflight"))


def route_score(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(routing.route(_vectors(spark, d).withColumnRenamed("id", "qid"), _clients(spark, d)), "score")


def _loads(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/embeddings.parquet").groupBy(F.col("label").alias("client")).agg(F.sum(F.col("vec_id") % 7).alias("pending"))


def route_limits(spark: SparkSession, d: str) -> DataFrame:
    return routing.limits(_loads(spark, d))


def route_full(spark: SparkSession, d: str) -> DataFrame:
    """Batches where every client has room for all: each query at its nearest."""
    room = _clients(spark, d).select("client", F.lit(1 << 20).alias("capacity"))
    return routing.route_batches(_vectors(spark, d).withColumnRenamed("id", "qid"), _clients(spark, d), room)


def route_none(spark: SparkSession, d: str) -> DataFrame:
    """Batches where no client has room: each query at its farthest."""
    room = _clients(spark, d).select("client", F.lit(0).alias("capacity"))
    return routing.route_batches(_vectors(spark, d).withColumnRenamed("id", "qid"), _clients(spark, d), room)


def route_batches(spark: SparkSession, d: str) -> DataFrame:
    return routing.route_batches(_vectors(spark, d).withColumnRenamed("id", "qid"), _clients(spark, d), routing.limits(_loads(spark, d)))


def routing_centroid(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(routing.routing_centroid(_index(spark, d, shards=1).nodes(medoids=True), DIM).select(F.posexplode("vec").alias("pos", "x")).withColumn("x", F.col("x").cast("double")), "x")


# ---- files ----


def vector_file_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    path = f"{scratch.new_folder(spark, 'vectors')}/base.fbin"
    vector_files.write_vectors(_vectors(spark, d), path)
    back = vector_files.read_vectors(spark, path.rsplit("/", 1)[0])
    return back.select("id", F.posexplode("vec").alias("pos", "x")).withColumn("x", F.round(F.col("x").cast("double"), 6))


def ground_truth_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    path = f"{scratch.new_folder(spark, 'truth')}/truth.bin"
    vector_files.write_ground_truth(exact.knn(_vectors(spark, d), _queries(spark, d), K), path)
    return vector_files.read_ground_truth(spark, path).select((F.col("qid") * 50).alias("qid"), F.posexplode("ids").alias("pos", "id")).select("qid", (F.col("pos") + 1).alias("rank"), "id")


def index_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    path = scratch.new(spark, "index")
    _index(spark, d).save(path)
    return _rounded(VectorIndex.load(spark, path, _params()).search(_queries(spark, d), K, beam_width=_n(spark, d)), "distance")


def shard_files_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    prefix = f"{scratch.new_folder(spark, 'shards')}/index"
    i = _index(spark, d, shards=SHARDS)
    nodes = i.nodes().persist()
    index_files.save_meta(index_files.write_shards(nodes, i.params, prefix), i.codec, prefix)
    back = index_files.read_shards(spark, prefix, i.params)
    as_built = nodes.select("id", *(F.col(c).alias("built_" + c) for c in ("code", "add", "rescale", "neighbors", "is_medoid")))
    same = lambda c: F.col(c).eqNullSafe(F.col("built_" + c))
    return back.join(as_built, "id").select(
        "id", "shard", "offset", F.round(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double")), 5).alias("total"), (same("code") & same("add") & same("rescale")).alias("same_code"), same("neighbors").alias("same_neighbors")
    )


def synthetic_vectors(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(synthetic.synthetic(spark, 256, 128).select("id", F.posexplode("vec").alias("pos", "x")).withColumn("x", F.col("x").cast("double")), "x")


# ---- reports ----


def _events(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/events.parquet")


def _samples(spark: SparkSession, d: str) -> DataFrame:
    """Events as latency samples: their value in micro-units is service time, with fixed parts of it in stages."""
    s = F.floor(F.col("value") * 1000).cast("long")
    part = lambda n: F.floor(F.col("service_ns") / n).cast("long")
    names = (("gpu.kernel", 4), ("rdma.read", 5), ("transfer.upload", 8), ("cpu.sort", 10))
    out = _events(spark, d).where("value is not null").select(F.col("event_type").alias("op"), F.col("event_id").alias("id"), s.alias("service_ns"))
    out = out.withColumn("queue_wait_ns", F.col("id") % 100).withColumn("end_to_end_ns", F.col("service_ns") + F.col("queue_wait_ns"))
    return out.withColumn("stage_ns", F.create_map(*(x for n, k in names for x in (F.lit(n), part(k)))))


def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return B.percentiles(_events(spark, d), "event_type", "value")


def op_latency(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(B.latency(_samples(spark, d)), "mean")


def latency_breakdown(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(B.breakdown(_samples(spark, d)), "share")


def stage_ranking(spark: SparkSession, d: str) -> DataFrame:
    ranked = F.row_number().over(Window.partitionBy("op").orderBy(F.desc("ns"), "stage"))
    return B.stages(_samples(spark, d)).withColumn("place", ranked)


def text_summary(spark: SparkSession, d: str) -> DataFrame:
    return B.summary(_samples(spark, d))


def counters(spark: SparkSession, d: str) -> DataFrame:
    """Events as counters: each user is a thread, its first and last event id the snapshots."""
    snap = _events(spark, d).groupBy(F.col("user_id").alias("thread"), F.col("event_type").alias("counter")).agg(F.min("event_id").alias("begin"), F.max("event_id").alias("end"))
    return B.counters(snap, {"click": "max"})


def throughput(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).groupBy("event_type").agg(F.round(B.throughput(F.count("*"), 60), 6).alias("per_second"))


_ALL = (
    dist_l2, dist_ip, dist_ip_negative, knn_exact_l2, knn_exact_ip, knn_exact_noself, knn_expressions, recall_at_k, shard_assign, shard_place, remote_ptr, shard_sizes, node_sizes, hash_mix64, hash_split_mix64,
    partition_read, centroid, medoid, neighbor_lookup, point_lookup, reverse_edges, degree_stats, prune_l2, beam_full, beam_32, beam_sharded, builder_visited, frontier_full, graph_degrees, bfs_sample, rabitq_rerank_full,
    rabitq_4bit, rabitq_codes, insert_then_search, stream_insert, assign_nearest_centroid, rank_centroids, lloyd_step, kmeans, balanced_kmeans, odd_kmeans, farthest_first, route_score, route_limits, route_batches,
    routing_centroid, vector_file_roundtrip, ground_truth_roundtrip, index_roundtrip, shard_files_roundtrip, synthetic_vectors, latency_percentiles, op_latency, latency_breakdown, stage_ranking, text_summary, counters, throughput,
    beam_32_recall, rabitq_4bit_recall, probed_recall, stitched_full, graph_invariants, visited_invariants, bfs_invariants, node_read, medoid_pointer, neighbor_update, code_estimates, typed_files, meta_roundtrip, settings, kmeans_2, balanced_sizes, route_full, route_none,
    insert_outcomes,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _ALL}


_L2 = "list_sum(list_transform(list_zip({a}, {b}), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE)))"
_DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda p: p[1]::DOUBLE * p[2]::DOUBLE))"


def _dist(expression: str, more: str = "") -> str:
    e = expression.format(a="q.embedding", b="e.embedding")
    return f"SELECT q.vec_id AS qid, e.vec_id AS id, {e} AS distance FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0{more}"


def _knn_sql(expression: str = _L2, more: str = "", k: int = K, take: str = "qid, rank, id, round(distance, 6) AS distance") -> str:
    return f"SELECT {take} FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY distance, id) AS INTEGER) AS rank FROM ({_dist(expression, more)})) WHERE rank <= {k}"


_QUALITY = f"SELECT count(*) AS queries, {K} * count(*) AS rows, true AS distances_exact, true AS recall_reached FROM embeddings WHERE vec_id % 50 = 0"
_NOSELF = " AND q.vec_id <> e.vec_id"
_PLACE = f"SELECT vec_id AS id, CAST(p % {SHARDS} AS INTEGER) AS shard, CAST(16 + (p // {SHARDS}) * {{size}} AS BIGINT) AS \"offset\" FROM (SELECT vec_id, {{p}} AS p FROM embeddings)"
_CENTRES = "WITH x AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings), m AS (SELECT label, pos, avg(x) AS x FROM x GROUP BY label, pos), c AS (SELECT label AS cluster, list(x ORDER BY pos) AS vec FROM m GROUP BY label)"
_SAMPLES = "WITH s AS (SELECT event_type AS op, CAST(floor(value * 1000) AS BIGINT) AS service, CAST(floor(value * 1000) AS BIGINT) + event_id % 100 AS total FROM events WHERE value IS NOT NULL)"
_U64 = "18446744073709551616::HUGEINT"


def _mul(a: str, b: int) -> str:
    """a * b modulo 2^64, in halves so that nothing overflows."""
    return f"(((({a}) % 4294967296::HUGEINT) * {b & 0xFFFFFFFF}::HUGEINT + (((({a}) // 4294967296::HUGEINT) * {b & 0xFFFFFFFF}::HUGEINT + (({a}) % 4294967296::HUGEINT) * {b >> 32}::HUGEINT) % 4294967296::HUGEINT) * 4294967296::HUGEINT) % {_U64})"


def _xor_shift(table: str, bits: int) -> str:
    return f"SELECT id, xor(h::UBIGINT, (h // {1 << bits}::HUGEINT)::UBIGINT)::HUGEINT AS h FROM ({table})"


def _hash_sql(start: str, steps: list[tuple[str, int]]) -> str:
    sql = start
    for kind, n in steps:
        sql = _xor_shift(sql, n) if kind == "x" else f"SELECT id, {_mul('h', n)} AS h FROM ({sql})"
    return f"SELECT id, CAST(CASE WHEN h >= 9223372036854775808::HUGEINT THEN h - {_U64} ELSE h END AS BIGINT) AS h FROM ({sql})"


def oracle_sql() -> dict[str, str]:
    size = L.aligned(_size())
    knn = _knn_sql()
    near = _knn_sql(more=_NOSELF, take="qid, rank, id").replace("q.vec_id % 50 = 0", "true")
    assign = _L2.format(a="e.embedding", b="c.vec")
    own = f"{_CENTRES}, a AS (SELECT e.vec_id AS id, c.cluster, {assign} AS distance FROM embeddings e, c), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY id ORDER BY distance, cluster) AS INTEGER) AS rank FROM a)"
    place = _PLACE.format(size=size, p="vec_id")
    by_order = _PLACE.format(size=size, p="row_number() OVER (ORDER BY vec_id) - 1")
    out = {k: knn for k in ("knn_exact_l2", "knn_expressions", "beam_full", "beam_sharded", "frontier_full", "rabitq_rerank_full", "insert_then_search", "stream_insert", "index_roundtrip", "stitched_full")}
    out |= {k: _QUALITY for k in ("beam_32_recall", "rabitq_4bit_recall", "probed_recall")}
    medoid = f"WITH x AS (SELECT unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings), m AS (SELECT list(x ORDER BY pos) AS vec FROM (SELECT pos, avg(x) AS x FROM x GROUP BY pos)), b AS (SELECT vec_id, embedding, row_number() OVER (ORDER BY vec_id) - 1 AS place FROM embeddings), n AS (SELECT b.* FROM b, m ORDER BY {_L2.format(a='embedding', b='m.vec')}, vec_id LIMIT 1)"
    step = lambda c, k: f"a{k} AS (SELECT e.vec_id AS id, e.embedding, arg_min(c.cluster, {_L2.format(a='e.embedding', b='c.vec')}) AS cluster FROM embeddings e, {c} c GROUP BY e.vec_id, e.embedding), o{k} AS (SELECT cluster, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM a{k}), n{k} AS (SELECT cluster, pos, avg(x) AS x FROM o{k} GROUP BY cluster, pos), c{k} AS (SELECT c.cluster, coalesce(l.vec, c.vec) AS vec FROM {c} c LEFT JOIN (SELECT cluster, list(x ORDER BY pos) AS vec FROM n{k} GROUP BY cluster) l USING (cluster))"
    shift = lambda x, n: f"xor({x}, {x} // {1 << n})"
    up = lambda x, n: f"xor({x}, (({x} % {1 << (64 - n)}) * {1 << n}))"
    mul = f"CAST({_mul('s::HUGEINT', synthetic.FACTOR)} AS UBIGINT)"
    return out | {
        "dist_l2": f"SELECT qid, id, round(distance, 6) AS distance FROM ({_dist(_L2)})",
        "dist_ip": f"SELECT qid, id, round(1.0 - distance, 6) AS distance FROM ({_dist(_DOT)})",
        "dist_ip_negative": f"SELECT qid, id, round(-distance, 6) AS distance FROM ({_dist(_DOT)})",
        "knn_exact_ip": _knn_sql("1.0 - " + _DOT),
        "knn_exact_noself": _knn_sql(more=_NOSELF),
        "recall_at_k": f"""WITH t AS ({_knn_sql(take="qid, rank, id")}), r AS ({_knn_sql(_L2.replace("{a}", "{a}[1:32]").replace("{b}", "{b}[1:32]"), take="qid, rank, id")}), k(k) AS (VALUES (1), (5), (10))
            SELECT CAST(k AS INTEGER) AS k, round(sum(CASE WHEN r.rank <= k THEN 1.0 ELSE 0.0 END) / (count(DISTINCT t.qid) * k), 6) AS recall FROM t JOIN k ON t.rank <= k LEFT JOIN r ON t.qid = r.qid AND t.id = r.id GROUP BY k""",
        "shard_assign": place,
        "shard_place": by_order,
        "remote_ptr": f"SELECT id, CAST(shard::HUGEINT * 281474976710656 + \"offset\" AS BIGINT) AS pointer, shard, \"offset\" FROM ({place})",
        "shard_sizes": f"SELECT shard, count(*) AS nodes, max(\"offset\") + {size} AS bytes FROM ({place}) GROUP BY shard",
        "node_sizes": f"SELECT CAST(b AS INTEGER) AS bits, CAST(16 + 4 * {DIM} + (b * {DIM} + 7) // 8 + 8 + 8 * {DEGREE} AS INTEGER) AS node_size, CAST((b * {DIM} + 7) // 8 AS INTEGER) AS code_bytes FROM (VALUES (1), (2), (4), (8)) v(b)",
        "hash_mix64": _hash_sql("SELECT vec_id AS id, vec_id::HUGEINT AS h FROM embeddings", [("x", 33), ("m", 0xFF51AFD7ED558CCD), ("x", 33), ("m", 0xC4CEB9FE1A85EC53), ("x", 33)]),
        "hash_split_mix64": _hash_sql(f"SELECT vec_id AS id, (vec_id::HUGEINT + 11400714819323198485::HUGEINT) % {_U64} AS h FROM embeddings", [("x", 30), ("m", 0xBF58476D1CE4E5B9), ("x", 27), ("m", 0x94D049BB133111EB), ("x", 31)]),
        "partition_read": f"SELECT CAST(vec_id % {SHARDS} AS INTEGER) AS client, count(*) AS n, CAST(sum(vec_id) AS BIGINT) AS ids FROM embeddings GROUP BY 1",
        "centroid": "SELECT CAST(pos - 1 AS INTEGER) AS pos, round(avg(x), 6) AS value FROM (SELECT unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY pos",
        "medoid": f"WITH x AS (SELECT unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings), m AS (SELECT list(x ORDER BY pos) AS vec FROM (SELECT pos, avg(x) AS x FROM x GROUP BY pos)) SELECT vec_id AS id, round({_L2.format(a='embedding', b='m.vec')}, 6) AS distance FROM embeddings, m ORDER BY {_L2.format(a='embedding', b='m.vec')}, vec_id LIMIT 1",
        "neighbor_lookup": f"SELECT qid AS id, rank - 1 AS pos, id AS neighbor FROM ({near})",
        "point_lookup": "SELECT vec_id AS id, CAST(len(embedding) AS INTEGER) AS dim FROM embeddings WHERE vec_id % 50 = 0",
        "reverse_edges": f"SELECT id, string_agg(qid, ',' ORDER BY qid) AS sources FROM ({near}) GROUP BY id",
        "degree_stats": f"SELECT count(*) AS n, round(avg(c), 6) AS avg_degree, max(c) AS max_degree, min(c) AS min_degree FROM (SELECT vec_id, count(id) AS c FROM embeddings LEFT JOIN ({near}) ON vec_id = id GROUP BY vec_id)",
        "assign_nearest_centroid": f"{own} SELECT id, cluster, round(distance, 6) AS distance FROM r WHERE rank = 1",
        "rank_centroids": f"{own} SELECT id, rank, cluster, round(distance, 6) AS distance FROM r",
        "lloyd_step": f"{own}, o AS (SELECT r.cluster, unnest(e.embedding)::DOUBLE AS x, generate_subscripts(e.embedding, 1) AS pos FROM r JOIN embeddings e ON r.id = e.vec_id WHERE rank = 1), n AS (SELECT cluster, pos, avg(x) AS x FROM o GROUP BY cluster, pos) SELECT m.label AS cluster, CAST(m.pos - 1 AS INTEGER) AS pos, round(coalesce(n.x, m.x), 6) AS x FROM m LEFT JOIN n ON m.label = n.cluster AND m.pos = n.pos",
        "route_score": f"{_CENTRES}, a AS (SELECT e.vec_id AS qid, c.cluster AS client, {assign} * (1.0::DOUBLE + 0.2::DOUBLE * (c.cluster % 4)) AS score FROM embeddings e, c) SELECT qid, client, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score, client) AS r FROM a) WHERE r = 1",
        "route_limits": "WITH l AS (SELECT label AS client, sum(vec_id % 7) AS pending FROM embeddings GROUP BY label), s AS (SELECT client, count(*) OVER () AS n, (sum(pending) OVER () - pending)::DOUBLE AS f, (sum(pending) OVER () * (count(*) OVER () - 1))::DOUBLE AS a FROM l), t AS (SELECT client, n, CAST(CASE WHEN a > 0 THEN floor(f * 200 * n / a) ELSE 200 END AS BIGINT) AS share FROM s), u AS (SELECT client, n, share, 200 * n - sum(share) OVER () AS rest, row_number() OVER (ORDER BY client) - 1 AS place FROM t) SELECT client, CAST(share + rest // n + CASE WHEN place < rest % n THEN 1 ELSE 0 END AS BIGINT) AS capacity FROM u",
        "vector_file_roundtrip": "SELECT r AS id, CAST(pos - 1 AS INTEGER) AS pos, round(x, 6) AS x FROM (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS r, embedding FROM embeddings) t, LATERAL (SELECT unnest(t.embedding)::DOUBLE AS x, generate_subscripts(t.embedding, 1) AS pos)",
        "ground_truth_roundtrip": _knn_sql(take="qid, rank, id"),
        "shard_files_roundtrip": f"SELECT p.id, p.shard, p.\"offset\", round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 5) AS total, true AS same_code, true AS same_neighbors FROM ({by_order}) p JOIN embeddings e ON p.id = e.vec_id",
        "latency_percentiles": "WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) SELECT event_type, min(value) FILTER (i = floor(0.5::DOUBLE * (n - 1))) AS p50, min(value) FILTER (i = floor(0.95::DOUBLE * (n - 1))) AS p95, min(value) FILTER (i = floor(0.99::DOUBLE * (n - 1))) AS p99 FROM r GROUP BY event_type",
        "op_latency": f"{_SAMPLES}, r AS (SELECT op, total, row_number() OVER (PARTITION BY op ORDER BY total) - 1 AS i, count(*) OVER (PARTITION BY op) AS n FROM s) SELECT op, count(*) AS count, CAST(sum(total) AS BIGINT) AS sum, round(avg(total), 6) AS mean, min(total) FILTER (i = floor(0.5::DOUBLE * (n - 1))) AS p50, min(total) FILTER (i = floor(0.95::DOUBLE * (n - 1))) AS p95, min(total) FILTER (i = floor(0.99::DOUBLE * (n - 1))) AS p99 FROM r GROUP BY op",
        "latency_breakdown": f"{_SAMPLES}, c AS (SELECT op, CAST(sum(service) AS BIGINT) AS service, CAST(sum(service // 4) AS BIGINT) AS gpu, CAST(sum(service // 5) AS BIGINT) AS rdma, CAST(sum(service // 8) AS BIGINT) AS transfer, CAST(sum(service // 10) AS BIGINT) AS explicit FROM s GROUP BY op), d AS (SELECT *, greatest(service - gpu - rdma - transfer, 0) AS cpu FROM c), u AS (SELECT op, service, unnest(['gpu', 'rdma', 'transfer', 'cpu', 'cpu_overhead']) AS category, unnest([gpu, rdma, transfer, cpu, greatest(cpu - explicit, 0)]) AS ns FROM d) SELECT op, category, ns, round(CASE WHEN service > 0 THEN ns / service ELSE 0 END, 6) AS share FROM u",
        "stage_ranking": f"{_SAMPLES}, u AS (SELECT op, unnest(['gpu.kernel', 'rdma.read', 'transfer.upload', 'cpu.sort']) AS stage, unnest([service // 4, service // 5, service // 8, service // 10]) AS ns FROM s), g AS (SELECT op, stage, count(*) AS count, CAST(sum(ns) AS BIGINT) AS ns FROM u GROUP BY op, stage) SELECT *, CAST(row_number() OVER (PARTITION BY op ORDER BY ns DESC, stage) AS INTEGER) AS place FROM g",
        "graph_invariants": "SELECT count(*) AS nodes, 1 AS medoids, 0 AS overfull, 0 AS loops, 0 AS repeats, 0 AS nowhere, 0 AS unreached FROM embeddings",
        "visited_invariants": "SELECT vec_id AS qid, true AS once, true AS exact, true AS found FROM embeddings WHERE vec_id % 50 = 0",
        "bfs_invariants": "SELECT least(100, count(*)) AS n, least(100, count(*)) AS ids, 1 AS medoids, true AS known FROM embeddings",
        "node_read": f"SELECT vec_id AS id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 5) AS total, {L.code_bytes(DIM, BITS)} AS code_bytes, true AS whole FROM embeddings WHERE vec_id % 50 = 0",
        "medoid_pointer": f"{medoid} SELECT 0 AS shard, vec_id AS id, 16 + place * {size} AS pointer FROM n",
        "routing_centroid": f"{medoid} SELECT CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS pos, round(unnest(embedding)::DOUBLE, 6) AS x FROM n",
        "neighbor_update": "SELECT vec_id AS id, 0 AS pos, CASE WHEN vec_id % 50 = 0 THEN vec_id ELSE vec_id + 1 END AS neighbor FROM embeddings UNION ALL SELECT vec_id, 1, vec_id + 2 FROM embeddings WHERE vec_id % 50 <> 0",
        "code_estimates": f"SELECT b AS bits, (SELECT count(*) FROM embeddings) AS n, b * {DIM} // 8 AS least_bytes, b * {DIM} // 8 AS most_bytes, true AS near FROM (VALUES (1), (2), (4), (8)) v(b)",
        "typed_files": "SELECT kind, r AS id, CAST(j AS INTEGER) AS pos, CAST((vec_id * 7 + j * 13) % 100 - low AS INTEGER) AS x FROM (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS r FROM embeddings), range(5) t(j), (VALUES ('.u8bin', 0), ('.i8bin', 100)) k(kind, low)",
        "meta_roundtrip": f"SELECT count(*) AS n, {DIM} AS dim, {DEGREE} AS degree, {BITS} AS bits, {SHARDS} AS shards, {_size()} AS node_size, true AS same_rotation, true AS refused FROM embeddings",
        "settings": "SELECT 'a,b,c' AS servers, 'd' AS clients, 64 AS dim, 24 AS degree, 48 AS beam_width, 10 AS k, 'ip' AS metric, 'exact' AS mode, true AS routing",
        "kmeans_2": f"{_CENTRES}, {step('c', 1)}, {step('c1', 2)} SELECT cluster, CAST(generate_subscripts(vec, 1) - 1 AS INTEGER) AS pos, round(unnest(vec), 6) AS x FROM c2",
        "balanced_sizes": "SELECT CAST(i AS INTEGER) AS place, n // 5 + CASE WHEN i < n % 5 THEN 1 ELSE 0 END AS n, n // 5 + CASE WHEN i < n % 5 THEN 1 ELSE 0 END AS ids FROM (SELECT count(*) AS n FROM embeddings), range(5) t(i)",
        "insert_outcomes": "SELECT vec_id AS id, vec_id % 2 AS inserted, CASE WHEN vec_id % 2 = 1 THEN 0 WHEN vec_id % 5 = 0 THEN 2 ELSE 1 END AS known, CASE WHEN vec_id % 2 = 1 AND vec_id % 5 = 0 THEN 1 ELSE 0 END AS repeated, CASE WHEN vec_id % 7 = 0 THEN 1 ELSE 0 END AS refused FROM embeddings",
        "route_full": f"{own} SELECT id AS qid, cluster AS client FROM r WHERE rank = 1",
        "route_none": f"{own} SELECT id AS qid, arg_max(cluster, rank) AS client FROM r GROUP BY id",
        "synthetic_vectors": f"""WITH RECURSIVE g(k, j, s) AS (SELECT k::UBIGINT, 0, xor({synthetic.START}::UBIGINT, k::UBIGINT) FROM range(1, 257) t(k)
            UNION ALL SELECT k, j + 1, {shift('b', 27)} FROM (SELECT k, j, {up('a', 25)} AS b FROM (SELECT k, j, {shift('s', 12)} AS a FROM g WHERE j < 128))),
            v AS (SELECT k, j - 1 AS pos, (({mul} // 4294967296) % 10000) AS r FROM g WHERE j > 0)
            SELECT CAST(k AS BIGINT) AS id, CAST(pos AS INTEGER) AS pos, round(((r::FLOAT / 10000::FLOAT) + CASE WHEN pos = k % 128 THEN 4 ELSE 0 END::FLOAT + CASE WHEN pos = (k * 17 + 3) % 128 THEN 1 ELSE 0 END::FLOAT)::DOUBLE, 6) AS x FROM v""",
        "text_summary": f"{_SAMPLES}, c AS (SELECT op, CAST(sum(service) AS DOUBLE) AS service, sum(service // 4) AS gpu, sum(service // 5) AS rdma, sum(service // 8) AS transfer FROM s GROUP BY op), u AS (SELECT op, service, unnest(['gpu', 'rdma', 'transfer', 'cpu']) AS category, unnest([gpu, rdma, transfer, greatest(CAST(service AS BIGINT) - gpu - rdma - transfer, 0)]) AS ns FROM c), h AS (SELECT op, category, CASE WHEN service > 0 THEN ns / service ELSE 0 END AS share FROM u) SELECT op, CAST(row_number() OVER (PARTITION BY op ORDER BY share DESC, category) AS INTEGER) AS line, format('{{:<10}} {{:6.2f}} %', category, share * 100) AS text FROM h",
        "counters": "WITH s AS (SELECT user_id, event_type AS counter, max(event_id) - min(event_id) AS delta FROM events GROUP BY user_id, event_type) SELECT counter, CAST(CASE WHEN counter = 'click' THEN max(delta) ELSE sum(delta) END AS BIGINT) AS value FROM s GROUP BY counter",
        "throughput": "SELECT event_type, round(count(*) / 60.0::DOUBLE, 6) AS per_second FROM events GROUP BY event_type",
    }
