"""Reports on latency samples: percentiles, stage shares, counters and throughput.

Samples are rows (op, queue_wait_ns, service_ns, end_to_end_ns, stage_ns), the last a map
from "category.stage" to nanoseconds.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# The categories of stages.
CATEGORIES = ("gpu", "rdma", "transfer", "cpu")
SAMPLES = "op string, queue_wait_ns long, service_ns long, end_to_end_ns long, stage_ns map<string,long>"


def percentiles(rows: DataFrame, by: str, value: str, ps: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """(by, p50, p95, ...): the value at place floor(p * (n - 1)) of each group in order, an exact rank.

    Ranks come from counts of equal values, in ranges of values: counts run up inside each range,
    and the sums of the ranges run up over the ranges, so no task holds more than a range of the
    distinct values or one row for each range. Nulls are left out.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = rows.where(F.col(value).isNotNull()).select(F.col(by).alias("k"), F.col(value).alias("x")).groupBy("k", "x").agg(F.count("*").alias("c"))
    dealt = counts.repartitionByRange(parts, "k", "x").withColumn("range", F.spark_partition_id()).persist()
    sums = dealt.groupBy("k", "range").agg(F.sum("c").alias("s"))
    before = sums.select("k", "range", (F.sum("s").over(Window.partitionBy("k").orderBy("range")) - F.col("s")).alias("before"), F.sum("s").over(Window.partitionBy("k")).alias("n"))
    run = dealt.withColumn("upto", F.sum("c").over(Window.partitionBy("range", "k").orderBy("x"))).join(before.withColumnRenamed("k", "k2"), ["range"]).where(F.col("k").eqNullSafe(F.col("k2")))
    run = run.withColumn("upto", F.col("upto") + F.col("before"))
    name = lambda p: f"p{p * 100:g}".replace(".", "_")
    return run.groupBy(F.col("k").alias(by)).agg(*(F.min(F.when(F.col("upto") > F.floor(F.lit(p) * (F.col("n") - 1)), F.col("x"))).alias(name(p)) for p in ps))


def latency(samples: DataFrame, column: str = "end_to_end_ns") -> DataFrame:
    """(op, count, sum, mean, p50, p95, p99) of one latency of the samples."""
    sums = samples.groupBy("op").agg(F.count(column).alias("count"), F.sum(column).alias("sum"), F.avg(column).alias("mean"))
    return sums.join(percentiles(samples, "op", column), "op")


def breakdown(samples: DataFrame) -> DataFrame:
    """(op, category, ns, share): nanoseconds of each category; cpu is what service time the others leave, at least 0."""
    cat = lambda c: F.aggregate(F.map_entries("stage_ns"), F.lit(0).cast("long"), lambda a, e: a + F.when(e["key"].startswith(c + "."), e["value"]).otherwise(0))
    sums = samples.groupBy("op").agg(F.sum("service_ns").alias("service"), *(F.sum(cat(c)).alias(c) for c in CATEGORIES))
    cpu = F.greatest(F.col("service") - F.col("gpu") - F.col("rdma") - F.col("transfer"), F.lit(0))
    parts = F.array(*(F.struct(F.lit(c).alias("category"), (cpu if c == "cpu" else F.col(c)).alias("ns")) for c in CATEGORIES), F.struct(F.lit("cpu_overhead").alias("category"), F.greatest(cpu - F.col("cpu"), F.lit(0)).alias("ns")))
    return sums.select("op", "service", F.explode(parts).alias("p")).select("op", "p.category", "p.ns", F.when(F.col("service") > 0, F.col("p.ns") / F.col("service")).otherwise(0.0).alias("share"))


def stages(samples: DataFrame) -> DataFrame:
    """(op, stage, count, ns), most time first within an op."""
    return samples.select("op", F.explode("stage_ns").alias("stage", "ns")).groupBy("op", "stage").agg(F.count("*").alias("count"), F.sum("ns").alias("ns")).orderBy("op", F.desc("ns"), "stage")


def summary(samples: DataFrame) -> DataFrame:
    """(op, line, text): the text report, categories by descending share."""
    ranked = breakdown(samples).where("category <> 'cpu_overhead'").withColumn("line", F.row_number().over(Window.partitionBy("op").orderBy(F.desc("share"), "category")))
    return ranked.select("op", "line", F.format_string("%-10s %6.2f %%", "category", F.col("share") * 100).alias("text"))


def counters(snapshots: DataFrame, how: dict[str, str] | None = None) -> DataFrame:
    """(counter, value) of snapshots (thread, counter, begin, end): the sum over threads of end - begin; how names those to take the maximum of."""
    top = [k for k, v in (how or {}).items() if v == "max"]
    delta = F.col("end") - F.col("begin")
    return snapshots.groupBy("counter").agg(F.sum(delta).alias("s"), F.max(delta).alias("m")).select("counter", F.when(F.col("counter").isin(top), F.col("m")).otherwise(F.col("s")).alias("value"))


def throughput(completed: Column, seconds: float) -> Column:
    return completed / F.lit(float(seconds))


def report(samples: DataFrame, meta: dict) -> str:
    """The JSON report: meta, latencies and breakdown of each op, and what takes most time."""
    lat = {r.op: {k: r[k] for k in ("count", "sum", "mean", "p50", "p95", "p99")} for r in latency(samples).collect()}
    out: dict = {"meta": meta}
    for r in breakdown(samples).orderBy("op", "category").collect():
        out.setdefault(f"{r.op}_breakdown", {"end_to_end_ns": lat.get(r.op, {})})[r.category] = {"ns": r.ns, "share": r.share}
    out["bottleneck_summary"] = {op: max((k for k in v if isinstance(v[k], dict) and "share" in v[k] and k != "cpu_overhead"), key=lambda k: v[k]["share"]) for op, v in ((k, v) for k, v in out.items() if k.endswith("_breakdown"))}
    return json.dumps(out, indent=2, default=float)
