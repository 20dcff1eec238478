"""Command lines: build an index offline, search it, and run the mixed read and insert benchmark."""

from __future__ import annotations

import argparse
import json
import math
import time
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from itertools import count, repeat

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nimbusvec.functions import breakdown
from nimbusvec.operators.exact import recall
from nimbusvec.plans.index import VectorIndex, self_recall
from nimbusvec.schema import Params
from nimbusvec.sources import index_files, vector_files
from nimbusvec.sources.synthetic import synthetic


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="nimbusvec")
    sub = p.add_subparsers(dest="what", required=True)
    b = sub.add_parser("build", help="build an index of a vector file")
    b.add_argument("--data", required=True)
    b.add_argument("--output", required=True)
    b.add_argument("--max-vectors", type=int)
    b.add_argument("--shards", type=int, default=0, help="0: by the number of rows")
    b.add_argument("--shard-files", action="store_true", help="also write shard, rotation and metadata files")
    b.add_argument("--queries")
    b.add_argument("--ground-truth")
    m = sub.add_parser("bench", help="insert and search, in turn or at once, and report latencies")
    m.add_argument("--index")
    m.add_argument("--queries")
    m.add_argument("--batches", type=int, default=4)
    m.add_argument("--batch", type=int, default=64)
    m.add_argument("--seconds", type=float, help="run for so long instead of for a number of batches")
    m.add_argument("--read-ratio", type=float, default=0.5)
    m.add_argument("--readers", type=int, default=0, help="threads that search while one inserts; 0: in turn")
    m.add_argument("--report")
    s = sub.add_parser("search", help="search an index for the vectors of a file")
    s.add_argument("--index", required=True)
    s.add_argument("--queries", required=True)
    s.add_argument("--output")
    for x in (b, m, s):
        x.add_argument("--k", type=int, default=10)
        x.add_argument("--beam-width", type=int, default=32)
        x.add_argument("--mode", choices=("exact", "quantized"), default="quantized")
    for x in (b, m):
        x.add_argument("--dim", type=int, default=128)
        x.add_argument("--degree", "-R", type=int, default=32)
        x.add_argument("--beam-width-construction", type=int, default=64)
        x.add_argument("--alpha", type=float, default=1.2)
        x.add_argument("--bits", type=int, default=4)
        x.add_argument("--metric", choices=("l2", "ip"), default="l2")
        x.add_argument("--seed", type=int, default=1234)
    return p


def _params(a: argparse.Namespace, dim: int, shards: int | None = None) -> Params:
    return Params(dim=dim, degree=a.degree, beam_width=a.beam_width, beam_width_construction=a.beam_width_construction, alpha=a.alpha, bits=a.bits, metric=a.metric, shards=shards, seed=a.seed)


def _ranked(truth: DataFrame) -> DataFrame:
    return truth.select("qid", F.posexplode("ids").alias("pos", "id")).select("qid", (F.col("pos") + 1).alias("rank"), "id")


def build(spark: SparkSession, a: argparse.Namespace) -> dict:
    n, dim = vector_files.header(vector_files.resolve(a.data))
    n = min(n, a.max_vectors or n)
    v = vector_files.read_vectors(spark, a.data, a.max_vectors)
    start = time.perf_counter()
    index = VectorIndex.build(v, _params(a, dim, a.shards or None))
    index.save(a.output)
    index = VectorIndex.load(spark, a.output)
    out = {"num_vectors": n, "dim": dim, "build_sec": time.perf_counter() - start, **index.degree_stats().first().asDict()}
    out["self_recall"] = self_recall(index, v, v.orderBy(F.xxhash64("id")).limit(200).withColumnRenamed("id", "qid"), a.k)
    if a.queries and a.ground_truth:
        q = vector_files.read_vectors(spark, a.queries).withColumnRenamed("id", "qid")
        found = index.search(q, a.k, a.mode, max(a.k, a.beam_width))
        out |= {f"recall@{r.k}": r.recall for r in recall(found, _ranked(vector_files.read_ground_truth(spark, a.ground_truth, q.count()))).collect()}
    if a.shard_files:
        index_files.save_meta(index_files.write_shards(index.nodes(), index.params, f"{a.output}/files"), index.codec, f"{a.output}/files")
    return out


def search(spark: SparkSession, a: argparse.Namespace) -> dict:
    index = VectorIndex.load(spark, a.index)
    found = index.search(vector_files.read_vectors(spark, a.queries).withColumnRenamed("id", "qid"), a.k, a.mode, max(a.k, a.beam_width))
    if a.output:
        vector_files.write_ground_truth(found, a.output)
        return {"output": a.output}
    return {"results": [r.asDict() for r in found.orderBy("qid", "rank").limit(100).collect()]}


def _steps(batches: int, seconds: float | None, usual: list[float]) -> Iterator[int]:
    """Numbers of batches; against a deadline, none is begun that would probably end after it, going by the usual latency."""
    start, k = time.perf_counter(), 0
    while k < batches if seconds is None else time.perf_counter() - start + usual[0] < seconds:
        yield k
        k += 1


def bench(spark: SparkSession, a: argparse.Namespace) -> dict:
    """Batches of searches and of inserts, in the proportion of read_ratio; latencies are of whole batches.

    Without readers they take turns. With readers so many threads search, each the version that
    is newest as it begins, while one thread inserts: versions have one writer. queue_wait_ns is the
    time that a batch of a thread waits after the start or the thread's batch before.
    """
    index = VectorIndex.load(spark, a.index) if a.index else VectorIndex.build(synthetic(spark, 4 * a.batch, a.dim), _params(a, a.dim))
    newest, dim, samples, start = [index], index.dimension, [], time.perf_counter()
    reads = round(a.batches * a.read_ratio)

    def one(read: bool, k: int, ready: int) -> float:
        fresh = synthetic(spark, a.batch, dim, first_id=10**9 + k * a.batch, first_seed=10**6 + k * a.batch)
        begun = time.perf_counter_ns()
        if read:
            q = (vector_files.read_vectors(spark, a.queries) if a.queries else fresh).withColumnRenamed("id", "qid")
            newest[0].search(q, a.k, a.mode, max(a.k, a.beam_width)).write.format("noop").mode("overwrite").save()
        else:
            grown = newest[0].insert(fresh)
            grown.count()
            newest[0] = grown
        done = time.perf_counter_ns()
        samples.append(("query" if read else "insert", begun - ready, done - begun, done - ready, {"cpu.batch": done - begun}))
        return (done - begun) / 1e9

    def work(reading: Iterator[bool], numbers: Iterator[int], usual: list[float]) -> None:
        ready = time.perf_counter_ns()
        for k in numbers:
            took = one(next(reading), k, ready)
            usual[0] = usual[0] * 7 / 8 + took / 8 if usual[0] else took
            ready = time.perf_counter_ns()

    if a.readers:
        shares = [(True, reads // a.readers + (i < reads % a.readers)) for i in range(a.readers)] + [(False, a.batches - reads)]
        with ThreadPoolExecutor(len(shares)) as pool:
            usual = [[0.0] for _ in shares]
            threads = [pool.submit(inheritable_thread_target(spark)(work), repeat(read), _steps(n, a.seconds, u), u) for (read, n), u in zip(shares, usual, strict=True)]
        for t in threads:
            t.result()
    else:
        usual = [0.0]
        work((math.ceil((k + 1) * a.read_ratio) > math.ceil(k * a.read_ratio) for k in count()), _steps(a.batches, a.seconds, usual), usual)
    seconds = time.perf_counter() - start
    table = spark.createDataFrame(samples, breakdown.SAMPLES)
    meta = {"dim": dim, "batch": a.batch, "read_ratio": a.read_ratio, "readers": a.readers, "seconds": seconds, "throughput": len(samples) * a.batch / seconds}
    out = json.loads(breakdown.report(table, {**meta, **newest[0].status()}))
    if a.report:
        with open(a.report, "w") as f:
            json.dump(out, f, indent=2)
    return out


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> dict:
    a = _parser().parse_args(argv)
    session = spark or SparkSession.builder.appName("nimbusvec").getOrCreate()
    out = {"build": build, "search": search, "bench": bench}[a.what](session, a)
    print(json.dumps(out, default=str))
    return out


if __name__ == "__main__":
    main()
