import json
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from nimbusvec.functions import breakdown as B
from nimbusvec.operators import cluster, exact, graph_ops, routing
from nimbusvec.plans import index
from nimbusvec.plans.index import VectorIndex, medoid, self_recall
from nimbusvec.schema import Params
from nimbusvec.sources import config, index_files, vector_files
from nimbusvec.sources.synthetic import synthetic
from nimbusvec.streaming.inserts import IndexFolder

SMALL = Params(dim=8, degree=6, beam_width=40, beam_width_construction=40, bits=8)


def table(spark, v, first=0):
    return spark.createDataFrame([(first + i, [float(x) for x in r]) for i, r in enumerate(v)], "id long, vec array<float>")


def asked(df):
    return df.withColumnRenamed("id", "qid")


def pairs(df):
    return {(r.qid, r.rank, r.id) for r in df.collect()}


def test_exact_edge_cases(spark):
    v = table(spark, [[0, 0], [1, 0], [1, 0], [0, 3]])
    got = exact.knn(v, asked(v.where("id = 0")), 10).collect()
    assert [(r.rank, r.id, r.distance) for r in sorted(got, key=lambda r: r.rank)] == [(1, 0, 0), (2, 1, 1), (3, 2, 1), (4, 3, 9)]
    assert exact.knn(v.limit(0), asked(v), 3).count() == 0
    assert exact.knn(v, asked(v.limit(0)), 3).count() == 0
    assert {(r.id, r.distance) for r in exact.within(v, asked(v.where("id = 0")), 2).collect()} == {(0, 0), (1, 1), (2, 1)}
    with pytest.raises(ValueError):
        exact.knn(v, asked(v), 0)


def test_inner_product_of_negative_components(spark):
    v = table(spark, [[1, -2], [-3, 1], [2, 2]])
    got = {(r.qid, r.id): r.distance for r in exact.knn(v, asked(v), 3, "ip").collect()}
    assert got[(0, 0)] == -4 and got[(0, 1)] == 6 and got[(1, 2)] == 5


def test_empty_index_single_node_and_growth(spark):
    empty = VectorIndex.empty(spark, SMALL)
    v = synthetic(spark, 60, 8, first_id=100)
    assert empty.count() == 0 and empty.search(asked(v), 5).count() == 0
    one = empty.insert(v.where("id = 100"))
    assert [r.id for r in one.search(asked(v.where("id = 120")), 5).collect()] == [100]
    grown = one.insert(v).insert(v)
    assert grown.count() == 60 and grown.version == 3
    assert pairs(grown.search(asked(v), 5, beam_width=60)) == pairs(exact.knn(v, asked(v), 5))
    assert grown.degree_stats().first().max_degree <= 6
    assert grown.unreachable().first().n == 0
    assert grown.nodes().where("is_medoid").count() == 1


def test_shards_follow_the_rows(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(index, "SHARD_ROWS", 25)
    v = synthetic(spark, 90, 8)
    sizes = lambda i: [r.n for r in i.shards.select("n").collect()]
    i = VectorIndex.build(v.where("id < 40"), SMALL)
    assert i.params.shards == 2 == len(sizes(i))
    i.save(str(tmp_path / "i"))
    grown = VectorIndex.load(spark, str(tmp_path / "i"), SMALL).insert(v)
    assert grown.params.shards == 4 == len(sizes(grown)) and sum(sizes(grown)) == 90 and grown.version == 1
    assert pairs(grown.search(asked(v), 5, beam_width=90)) == pairs(exact.knn(v, asked(v), 5))
    assert VectorIndex.empty(spark, SMALL).insert(v).params.shards == 4
    given = VectorIndex.build(v, replace(SMALL, shards=1)).insert(synthetic(spark, 10, 8, first_id=1000))
    assert given.params.shards == 1 and sizes(given) == [100]


def test_a_large_shard_is_built_in_parts(spark, monkeypatch):
    monkeypatch.setattr(index, "WHOLE_ROWS", 100)
    monkeypatch.setattr(index, "PART_ROWS", 60)
    v = synthetic(spark, 300, 8)
    i = VectorIndex.build(v.unionByName(v.where("id < 20")), replace(SMALL, shards=2))
    nodes = i.nodes().persist()
    assert nodes.count() == i.count() == 300 and nodes.where("is_medoid").count() == 2
    assert {r.n for r in i.unreachable().collect()} == {0} and i.degree_stats().first().max_degree <= 6
    near = nodes.select("id", "shard", F.explode("neighbors").alias("near"))
    assert near.where("id = near").count() == 0 and near.distinct().count() == near.count()
    assert near.join(nodes.select(F.col("id").alias("near"), F.col("shard").alias("other")), "near").where("shard = other").count() == near.count()
    assert pairs(i.search(asked(v), 5, beam_width=300)) == pairs(exact.knn(v, asked(v), 5))
    assert pairs(i.search(asked(v), 5, "quantized", 300)) == pairs(exact.knn(v, asked(v), 5))
    assert self_recall(i, v, asked(v), 5) > 0.9


def test_frontier_of_whole_beams(spark):
    v = synthetic(spark, 12, 8, first_id=0)
    chain = v.withColumn("neighbors", F.when(F.col("id") == 9, F.array().cast("array<long>")).otherwise(F.array(F.col("id") + 1)))
    entry = chain.where("id = 3").select("id")
    assert sorted(r.id for r in graph_ops.reached(chain, entry).collect()) == list(range(3, 10))
    want = pairs(exact.knn(v.where("id between 3 and 9"), asked(v), 4))
    assert pairs(graph_ops.frontier_search(chain, entry, asked(v), 12, 4)) == want
    assert pairs(graph_ops.frontier_search(chain, entry, asked(v), 11, 4)) == want


def test_repeated_ids_and_wrong_dimensions(spark):
    v = synthetic(spark, 30, 8)
    i = VectorIndex.build(v.unionByName(v), SMALL)
    assert i.count() == 30 and i.dimension == 8 and i.status()["num_vectors"] == 30
    with pytest.raises(Exception, match="another dimension"):
        VectorIndex.build(table(spark, [[1, 2]]), SMALL).count()
    with pytest.raises(Exception, match="another dimension"):
        i.insert(table(spark, [[1, 2]], 99)).count()
    for bad in ({"degree": 0}, {"degree": 256}, {"bits": 3}, {"metric": "cosine"}):
        with pytest.raises(ValueError):
            Params(dim=8, **bad)
    with pytest.raises(ValueError):
        i.search(asked(v), 50)


def test_recall_of_graph_and_codes(spark):
    v = synthetic(spark, 600, 16)
    p = Params(dim=16, degree=16, beam_width=32, bits=4, shards=2)
    i = VectorIndex.build(v, p)
    q = v.where("id % 5 = 0")
    truth = exact.knn(v, asked(q), 10)
    for mode in ("exact", "quantized"):
        r = {x.k: x.recall for x in exact.recall(i.search(asked(q), 10, mode), truth).collect()}
        assert r[10] >= 0.95, mode
    assert self_recall(i, v, asked(q), 10) >= 0.95


def test_save_load_and_shard_files(spark, tmp_path):
    v = synthetic(spark, 50, 8)
    p = Params(dim=8, degree=6, beam_width=40, beam_width_construction=40, bits=8, shards=2)
    i = VectorIndex.build(v, p)
    i.save(str(tmp_path / "i"))
    back = VectorIndex.load(spark, str(tmp_path / "i"), p)
    assert pairs(back.search(asked(v), 5)) == pairs(i.search(asked(v), 5))
    with pytest.raises(ValueError):
        VectorIndex.load(spark, str(tmp_path / "i"), Params(dim=9))
    prefix = str(tmp_path / "s")
    meta = index_files.write_shards(i.nodes(), p, prefix)
    index_files.save_meta(meta, i.codec, prefix)
    loaded, codec = index_files.load_meta(prefix, p)
    assert loaded["num_vectors"] == 50 and loaded["node_size"] == 16 + 32 + 8 + 8 + 48
    assert np.allclose(codec.rotation, i.codec.rotation, atol=1e-6) and codec.scale == i.codec.scale
    nodes = {r.id: (r.vec, r.neighbors, bytes(r.code)) for r in index_files.read_shards(spark, prefix, p).collect()}
    assert nodes == {r.id: (r.vec, r.neighbors, bytes(r.code)) for r in i.nodes().collect()}
    assert meta["shard_bytes"] == {0: 16 + 25 * 112, 1: 16 + 25 * 112}
    with pytest.raises(ValueError):
        index_files.load_meta(prefix, Params(dim=8, bits=4))


@pytest.mark.parametrize("ending", [".fbin", ".u8bin", ".i8bin", ".bin"])
def test_vector_files(spark, tmp_path, ending):
    low = -100 if ending == ".i8bin" else 0
    v = np.random.default_rng(0).integers(low, 100, (30, 5))
    path = str(tmp_path / ("base" + ending))
    assert vector_files.write_vectors(table(spark, v), path) == 30
    assert vector_files.resolve(str(tmp_path)) == path
    got = vector_files.read_vectors(spark, str(tmp_path)).orderBy("id").collect()
    assert [r.id for r in got] == list(range(30)) and (np.array([r.vec for r in got]) == v).all()
    assert vector_files.read_vectors(spark, path, limit=7).count() == 7
    assert [r.id for r in vector_files.read_vectors(spark, path, part=(1, 3)).orderBy("id").collect()] == list(range(1, 30, 3))


def test_bad_vector_files(spark, tmp_path):
    (tmp_path / "short.fbin").write_bytes(b"\x05\0\0\0\x05\0\0\0abc")
    with pytest.raises(ValueError):
        vector_files.read_vectors(spark, str(tmp_path / "short.fbin"))
    with pytest.raises(FileNotFoundError):
        vector_files.read_vectors(spark, str(tmp_path))


def test_ground_truth_files(spark, tmp_path):
    v = synthetic(spark, 20, 8, first_id=0)
    truth = exact.knn(v, asked(v), 3)
    path = str(tmp_path / "t.bin")
    assert vector_files.write_ground_truth(truth, path) == 20
    got = {r.qid: r.ids for r in vector_files.read_ground_truth(spark, path, 20).collect()}
    assert {(q, k + 1, i) for q, ids in got.items() for k, i in enumerate(ids)} == pairs(truth)
    with pytest.raises(ValueError):
        vector_files.read_ground_truth(spark, path, 19)


def test_stream_is_idempotent(spark, tmp_path):
    v = synthetic(spark, 40, 8)
    folder = IndexFolder(spark, str(tmp_path / "f"), SMALL)
    v.where("id <= 20").write.parquet(str(tmp_path / "in"))
    run = lambda: folder.follow(spark.readStream.schema(v.schema).parquet(str(tmp_path / "in")), str(tmp_path / "c")).awaitTermination()
    run()
    v.where("id > 20").write.mode("append").parquet(str(tmp_path / "in"))
    run()
    last = folder.latest()
    folder.apply(v, 0)
    assert folder.latest() == last and folder.index().count() == 40


def test_medoid_and_routing(spark):
    v = table(spark, [[0, 0], [2, 0], [1, 0.25]])
    assert medoid(v).first().id == 2
    clients = spark.createDataFrame([(0, [0.0, 0.0], 100), (1, [9.0, 0.0], 0)], "client int, vec array<double>, inflight long")
    assert {r.client for r in routing.route(asked(v), clients).collect()} == {1, 0}
    caps = routing.limits(spark.createDataFrame([(0, 0), (1, 10), (2, 5)], "client int, pending long"), 10)
    got = {r.client: r.capacity for r in caps.collect()}
    assert sum(got.values()) == 30 and got[0] > got[2] > got[1]
    sent = routing.route_batches(asked(synthetic(spark, 40, 2, first_id=0)), clients, spark.createDataFrame([(0, 5), (1, 100)], "client int, capacity long"), 20)
    assert sent.count() == 40 and sent.where("client = 0").count() <= 5


def test_batches_refuse_more_clients_than_they_take(spark):
    clients = spark.range(4097).selectExpr("cast(id as int) client", "array(cast(id as double)) vec")
    with pytest.raises(ValueError, match="4096"):
        routing.route_batches(asked(table(spark, [[0.0]])), clients, clients.selectExpr("client", "1 capacity"))
    few = clients.where("client < 4096")
    assert routing.route_batches(asked(table(spark, [[4095.0]])), few, few.selectExpr("client", "1 capacity")).first().client == 4095


def test_a_version_holds_what_its_batch_changed(spark, tmp_path):
    many = replace(SMALL, shards=5)
    folder = IndexFolder(spark, str(tmp_path / "i"), many)
    v = synthetic(spark, 60, 8, first_id=0)
    folder.start(VectorIndex.build(v.where("id < 50"), many))
    for k, part in enumerate(("id = 50", "id < 20", "id > 50")):
        folder.apply(v.where(part), k)
    written = spark.read.parquet(str(tmp_path / "i" / "shards")).groupBy("version").count().collect()
    assert {r.version: r["count"] for r in written}.items() >= {0: 5, 1: 1}.items() and 2 not in {r.version for r in written}
    assert [folder.index(x).count() for x in range(4)] == [50, 51, 51, 60]
    assert sorted(r.id for r in folder.index().ids().collect()) == list(range(60))
    assert self_recall(folder.index(), v, asked(v), 5) > 0.9


def test_a_rebuilt_version_hides_older_shards(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "SHARD_ROWS", 16)
    own = replace(SMALL, shards=None)
    folder = IndexFolder(spark, str(tmp_path / "i"), own)
    v = synthetic(spark, 40, 8, first_id=0)
    for k, part in enumerate(("id < 10", "id between 10 and 12", "id > 12")):
        folder.apply(v.where(part), k)
    assert folder.index().params.shards > folder.index(1).params.shards and folder._base(3) == 3
    assert sorted(r.id for r in folder.index().ids().collect()) == list(range(40))
    assert [folder.index(x).count() for x in range(4)] == [0, 10, 13, 40]


def test_insert_tells_what_it_did(spark):
    i = VectorIndex.build(synthetic(spark, 20, 8, first_id=0), SMALL)
    rows = [(5, [1.0] * 8), (100, [1.0] * 8), (100, [2.0] * 8), (101, [1.0] * 7), (102, None), (None, [1.0] * 8), (103, [1.0] * 7 + [None]), (104, [3.0] * 8)]
    new = spark.createDataFrame(rows, "id long, vec array<float>")
    got = {r.id: (r.inserted, r.known, r.repeated, r.refused) for r in i.outcomes(new).collect()}
    assert got == {5: (0, 1, 0, 0), 100: (1, 0, 1, 0), 101: (0, 0, 0, 1), 102: (0, 0, 0, 1), None: (0, 0, 0, 1), 103: (0, 0, 0, 1), 104: (1, 0, 0, 0)}
    grown = i.insert(new, strict=False)
    assert grown.count() == 22 and {r.id for r in grown.ids().collect()} == {*range(20), 100, 104}
    assert i.outcomes(new.limit(0)).count() == 0 and i.insert(new.limit(0), strict=False).count() == 20
    for bad in ("id = 101", "id = 102", "id is null", "id = 103"):
        with pytest.raises(Exception, match="another dimension"):
            i.insert(new.where(bad)).count()


def test_any_number_of_centroids_and_clients(spark):
    """More than one array of them: the same answers as brute force."""
    many = spark.range(9000).selectExpr("cast(id as int) cluster", "array(cast(id as double), 0D) vec")
    v = table(spark, [[4100.2, 0.0], [8999.0, 1.0], [0.4, 0.0], [17.5, 0.0]])
    got = {r.id: (r.cluster, r.distance) for r in cluster.assign(v.unionByName(v), many).collect()}
    assert {i: c for i, (c, _) in got.items()} == {0: 4100, 1: 8999, 2: 0, 3: 17} and got[1][1] == 1.0
    assert cluster.assign(v.unionByName(v), many).count() == 8
    assert [r.cluster for r in cluster.ranked(v, many).where("id = 3 and rank <= 3").orderBy("rank").collect()] == [17, 18, 16]
    clients = many.selectExpr("cluster client", "vec", "if(cluster = 4100, 1000L, 0L) inflight")
    assert {r.qid: r.client for r in routing.route(asked(v), clients).collect()} == {0: 4101, 1: 8999, 2: 0, 3: 17}
    assert [(r.cluster, r.distance) for r in cluster.assign(v, many.where("false")).collect()] == [(None, None)] * 4


def test_config_files():
    s = config.service("# c\nservers = a b\nclients = c\ndim = 12 ; x\nR = 9\nbeam-width=20\nip-dist = yes\nsearch-mode = rabitq_gpu\nrouting = off\n")
    assert s.servers == ["a", "b"] and s.params.dim == 12 and s.params.degree == 9 and s.params.metric == "ip" and s.params.shards == 2 and s.mode == "quantized" and not s.routing
    with pytest.raises(ValueError):
        config.parse("no setting")
    with pytest.raises(ValueError):
        config.service("k = 100\nbeam-width = 10")


def test_reports(spark):
    rows = [("query", 1, 100, 101 + i, {"gpu.k": 50, "rdma.r": 20, "cpu.s": 10}) for i in range(10)]
    s = spark.createDataFrame(rows, B.SAMPLES)
    lat = B.latency(s).first()
    assert (lat.p50, lat.p95, lat.p99, lat["count"]) == (105, 109, 109, 10)
    got = {r.category: r.ns for r in B.breakdown(s).collect()}
    assert got == {"gpu": 500, "rdma": 200, "transfer": 0, "cpu": 300, "cpu_overhead": 200}
    assert B.summary(s).orderBy("line").first().text.startswith("gpu")
    out = json.loads(B.report(s, {"dim": 8}))
    assert out["bottleneck_summary"]["query_breakdown"] == "gpu" and out["meta"]["dim"] == 8
    snaps = spark.createDataFrame([(1, "a", 0, 5), (2, "a", 1, 3), (1, "m", 0, 7), (2, "m", 0, 9)], "thread int, counter string, begin long, end long")
    assert {r.counter: r.value for r in B.counters(snaps, {"m": "max"}).collect()} == {"a": 7, "m": 9}
    assert s.select(B.throughput(F.count("*"), 5).alias("x")).first().x == 2


def _points(n):
    return np.random.default_rng(n).standard_normal((n, 16))


def test_medoids_are_those_of_the_nodes_which_are_not_read(spark, monkeypatch):
    i = VectorIndex.build(table(spark, _points(90)), Params(dim=16, degree=8, shards=3))
    want = sorted((r.shard, r.id, (r.shard << 48) + r.offset) for r in i.nodes().where("is_medoid").collect())
    monkeypatch.setattr(VectorIndex, "nodes", None)
    assert sorted(map(tuple, i.medoids().collect())) == want and len(want) == 3
    assert VectorIndex.empty(spark, Params(dim=16)).medoids().count() == 0


def test_queries_of_many_files_meet_a_shard_in_one_block(spark):
    i = VectorIndex.build(table(spark, _points(90)), Params(dim=16, degree=8, shards=3))
    q = table(spark, _points(40)).withColumnRenamed("id", "qid").repartition(16)
    assert index.with_queries(i.shards, q).count() == 3
    assert index.with_queries(i.shards, q.limit(0)).count() == 0


def test_ten_thousand_rows_are_built_by_several_tasks():
    assert index.default_shards(10_256) >= 5 and index.default_shards(0) == 1


def test_a_beam_of_every_row_finds_what_edges_lead_to(spark):
    v = _points(120)
    i = VectorIndex.build(table(spark, v), Params(dim=16, degree=8, shards=2))
    got = {(r.qid, r.rank): r.id for r in i.search(table(spark, v[:9]).withColumnRenamed("id", "qid"), 5, beam_width=120).collect()}
    for q in range(9):
        d = ((v[q].astype(np.float32).astype(float) - v.astype(np.float32).astype(float)) ** 2).sum(1)
        assert [got[q, r] for r in range(1, 6)] == np.lexsort((np.arange(120), d))[:5].tolist()


def test_nodes_of_the_medoids_alone_are_those_of_all(spark):
    i = VectorIndex.build(table(spark, np.random.default_rng(3).standard_normal((120, 8))), replace(SMALL, shards=3))
    assert sorted(i.nodes(medoids=True).collect()) == sorted(i.nodes().where("is_medoid").collect())
    assert i.nodes(medoids=True).count() == 3 and i.nodes().count() == 120


def test_kept_shards_have_few_empty_partitions(spark, monkeypatch):
    monkeypatch.setattr(index, "WHOLE_ROWS", 100)
    monkeypatch.setattr(index, "PART_ROWS", 80)
    v = np.random.default_rng(4).standard_normal((300, 8))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    try:
        parts = VectorIndex.build(table(spark, v), replace(SMALL, shards=2))
        grown = VectorIndex.build(table(spark, v[:90]), replace(SMALL, shards=2)).insert(table(spark, v[90:], 90))
        assert parts.shards.rdd.getNumPartitions() <= 8 and grown.changed.rdd.getNumPartitions() <= 8
        assert parts.count() == grown.count() == 300
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_mean_and_number_are_those_of_the_vectors(spark):
    v = np.random.default_rng(6).standard_normal((70, 8)).astype(np.float32)
    mean, n = index.mean_and_count(table(spark, v), 8)
    assert n == 70 and np.allclose(mean, v.astype(float).mean(0), atol=1e-12)
    mean, n = index.mean_and_count(table(spark, v).limit(0), 8)
    assert n == 0 and not mean.any()


def test_files_of_one_row_are_written_without_python(spark, tmp_path, monkeypatch):
    kind, plans = type(spark.range(1)), []
    coalesce = kind.coalesce
    monkeypatch.setattr(kind, "coalesce", lambda df, n: plans.append(df._jdf.queryExecution().toString()) or coalesce(df, n))
    i = VectorIndex.build(table(spark, np.eye(8)), replace(SMALL, shards=2, placement="centroid"))
    i.save(str(tmp_path / "index"))
    assert len(plans) == 1 and all("LocalTableScan" in p or "LocalRelation" in p for p in plans)
    again = VectorIndex.load(spark, str(tmp_path / "index"), SMALL)
    assert (again.codec.rotation == i.codec.rotation).all() and (again.codec.centres == i.codec.centres).all() and again.params == i.params


def test_inserted_rows_are_looked_up_once(spark, monkeypatch):
    monkeypatch.setattr(index, "SHARD_ROWS", 30)
    v = np.random.default_rng(8).standard_normal((60, 8))
    for shards in (2, None):
        read = spark.sparkContext.accumulator(0)

        def seen(x, read=read):
            read.add(1)
            return x

        rows = table(spark, v[20:], 20).withColumn("vec", F.udf(seen, "array<float>").asNondeterministic()("vec"))
        base = VectorIndex.build(table(spark, v[:20]), replace(SMALL, shards=shards))
        grown = base.insert(rows, strict=False)
        assert grown.count() == 60 and read.value <= 80  # one look is the count of the rows, which may not leave this function out
        assert pairs(grown.search(asked(table(spark, v)), 1).select("qid", "rank", "id")) == {(i, 1, i) for i in range(60)}


def test_a_stream_writes_its_versions_without_python_and_keeps_no_rows(spark, tmp_path, monkeypatch):
    kind, plans = type(spark.range(1)), []
    coalesce = kind.coalesce
    monkeypatch.setattr(kind, "coalesce", lambda df, n: plans.append(df._jdf.queryExecution().toString()) or coalesce(df, n))
    v = np.random.default_rng(11).standard_normal((40, 8))
    folder = IndexFolder(spark, str(tmp_path / "index"), replace(SMALL, shards=2))
    folder.start(VectorIndex.build(table(spark, v[:20]), replace(SMALL, shards=2)))
    kept = spark.sparkContext._jsc.getPersistentRDDs().size()
    folder.apply(table(spark, v[20:], 20), 0)
    assert folder.index().count() == 40 and spark.sparkContext._jsc.getPersistentRDDs().size() <= kept
    assert len(plans) == 4 and all("LocalTableScan" in p or "LocalRelation" in p for p in plans)
