"""Routing queries to clients: by load-weighted distance, and in batches under capacity limits."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from nimbusvec.functions.distance import distance, to_many
from nimbusvec.operators.exact import least
from nimbusvec.sources.index_files import numbered

# Weight of a query in flight, queries in a batch for each client.
LOAD_WEIGHT = 0.2
BATCH = 200


def route(queries: DataFrame, clients: DataFrame, metric: str = "l2") -> DataFrame:
    """(qid, client, score): for each query (qid, vec) the client (client, vec, inflight) of the least distance * (1 + 0.2 * inflight), the first of equals."""
    score = lambda v, c: distance(metric, v, c["vec"]) * (F.lit(1.0) + F.lit(LOAD_WEIGHT) * c["inflight"])
    return least(queries, "qid", clients.select("client", "vec", "inflight"), "client", score, "score")


def limits(loads: DataFrame, batch: int = BATCH) -> DataFrame:
    """(client, capacity) from loads (client, pending): shares of batch * clients against load, what flooring leaves dealt one by one in client order."""
    every = Window.partitionBy()
    n, total = F.count("*").over(every), F.sum("pending").over(every)
    sums = loads.select("client", "pending", n.alias("n"), total.alias("total"))
    sums = sums.select("client", "n", (F.col("total") - F.col("pending")).cast("double").alias("free"), (F.col("total") * (F.col("n") - 1)).cast("double").alias("all_free"))
    share = F.when(F.col("all_free") > 0, F.floor(F.col("free") * F.lit(batch) * F.col("n") / F.col("all_free"))).otherwise(F.lit(batch)).cast("long")
    floors = sums.select("client", "n", share.alias("share"))
    left = F.lit(batch) * F.col("n") - F.sum("share").over(every)
    place = F.row_number().over(Window.orderBy("client")) - 1
    floors = floors.withColumn("left", left).withColumn("place", place)
    extra = F.floor(F.col("left") / F.col("n")) + F.when(F.col("place") < F.pmod(F.col("left"), F.col("n")), 1).otherwise(0)
    return floors.select("client", (F.col("share") + extra).cast("long").alias("capacity"))


def route_batches(queries: DataFrame, clients: DataFrame, limit: DataFrame, batch: int = BATCH, metric: str = "l2") -> DataFrame:
    """(qid, client): queries (qid, vec) in order of qid, batch * clients of them a batch, each to its nearest client with room left.

    Where no client has room left, a query goes to the farthest one, the last that was asked.
    Batches count places, not ids. They are independent: each is one group, and the order
    within it is the order of qid. More than 4096 clients are refused.
    """
    rows = clients.join(limit, "client").orderBy("client").limit(4097).collect()
    if len(rows) > 4096:
        raise ValueError("more than 4096 clients")
    names = np.array([r.client for r in rows])
    centres = np.array([r.vec for r in rows], float)
    room = np.array([r.capacity for r in rows])
    places = numbered(queries, "qid").select("qid", F.floor(F.col("place") / F.lit(max(1, batch * len(rows)))).alias("batch"))
    dealt = queries.select("qid", "vec").join(places, "qid")

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("qid")
        used, out = np.zeros(len(names), int), []
        step = max(1, (1 << 22) // len(names))
        for i in range(0, len(g), step):
            for near in np.argsort(to_many(metric, np.stack(g.vec.iloc[i : i + step]).astype(float), centres), axis=1, kind="stable"):
                free = near[used[near] < room[near]]
                pick = free[0] if len(free) else near[-1]
                used[pick] += 1
                out.append(names[pick])
        return pd.DataFrame({"qid": g.qid.to_numpy(), "client": out})

    kind = clients.schema["client"].dataType
    return dealt.groupBy("batch").applyInPandas(run, T.StructType([T.StructField("qid", T.LongType()), T.StructField("client", kind)]))


def routing_centroid(index_nodes: DataFrame, dim: int) -> DataFrame:
    """(vec): the vector of the medoid that every client of a shared index routes by; zeros for an empty index."""
    zero = F.array(*(F.lit(0.0).cast("float") for _ in range(dim)))
    return index_nodes.where("is_medoid").agg(F.min(F.struct("shard", "vec")).alias("m")).select(F.coalesce(F.col("m.vec"), zero).alias("vec"))
