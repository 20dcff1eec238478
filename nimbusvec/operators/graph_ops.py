"""Graph operators over node tables: lookups, neighbour updates, pruning, and a search that joins its frontier.

These work on DataFrames of nodes (id, vec, neighbors), for graphs that no task can hold.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nimbusvec.functions.distance import distance, to_many
from nimbusvec.functions.proximity import prune
from nimbusvec.operators.exact import knn


def lookup(nodes: DataFrame, keys: DataFrame, *columns: str) -> DataFrame:
    """The named columns of the nodes whose id is in keys (id); the scan reads those columns only."""
    return nodes.select("id", *columns).join(keys.select("id").distinct(), "id", "left_semi")


def neighbours(nodes: DataFrame, keys: DataFrame) -> DataFrame:
    """(id, pos, neighbor) of the nodes whose id is in keys."""
    return lookup(nodes, keys, "neighbors").select("id", F.posexplode("neighbors").alias("pos", "neighbor"))


def with_neighbours(nodes: DataFrame, lists: DataFrame) -> DataFrame:
    """nodes with the neighbour lists of lists (id, neighbors) in place of their own."""
    new = lists.select("id", F.col("neighbors").alias("new_neighbors"))
    return nodes.join(new, "id", "left").withColumn("neighbors", F.coalesce("new_neighbors", "neighbors")).drop("new_neighbors").select(*nodes.columns)


def reverse_candidates(edges: DataFrame) -> DataFrame:
    """(id, candidates): the sources of each node's incoming edges (src, dst), sorted."""
    return edges.groupBy(F.col("dst").alias("id")).agg(F.array_sort(F.collect_set("src")).alias("candidates"))


def prune_table(pairs: DataFrame, vectors: DataFrame, degree: int, alpha: float, metric: str = "l2", keep_all_if_small: bool = False) -> DataFrame:
    """(src, pos, dst): diverse neighbours of each source of pairs (src, dst); one task holds one source's candidates."""
    rows = pairs.where("src <> dst").select("src", "dst").distinct()
    rows = rows.join(vectors.select(F.col("id").alias("dst"), F.col("vec").alias("dvec")), "dst").join(vectors.select(F.col("id").alias("src"), F.col("vec").alias("svec")), "src")

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        v = np.stack([g.svec.iloc[0], *g.dvec]).astype(float)
        ids = np.concatenate([[key[0]], g.dst.to_numpy()])
        kept = prune(v, ids, 0, np.arange(1, len(v)), to_many(metric, v[:1], v[1:])[0], degree, alpha, metric, keep_all_if_small)
        return pd.DataFrame({"src": key[0], "pos": np.arange(len(kept), dtype=np.int32), "dst": ids[kept]})

    return rows.groupBy("src").applyInPandas(run, "src long, pos int, dst long")


def reached(nodes: DataFrame, entry: DataFrame) -> DataFrame:
    """(id): the nodes (id, neighbors) that edges lead to from entry (id), by one join for each round."""
    edges = nodes.select("id", "neighbors")
    front = entry.select("id").distinct().join(nodes.select("id"), "id", "left_semi").checkpoint()
    seen = front
    while not front.isEmpty():
        new = front.join(edges, "id").select(F.explode("neighbors").alias("id")).distinct()
        front = new.join(seen, "id", "left_anti").checkpoint()
        seen = seen.unionByName(front)
    return seen


def frontier_search(nodes: DataFrame, entry: DataFrame, queries: DataFrame, width: int, k: int, metric: str = "l2", checkpoint_every: int = 4) -> DataFrame:
    """(qid, rank, id, distance): best-first search of one global graph, one join for each round and all queries together.

    A round expands every unexpanded node of every beam, joins their neighbours' vectors,
    keeps what wasn't seen and trims the beams. nodes: (id, vec, neighbors); entry: (id), the
    medoid. It ends when no beam has an unexpanded node. Beams with room for all nodes drop none:
    then all queries have one frontier, which is kept once, and score what it reaches. The lineage
    is cut by checkpoint(), for which the session needs a checkpoint folder.
    """
    if width >= nodes.count():
        return knn(nodes.select("id", "vec").join(reached(nodes, entry), "id", "left_semi"), queries, k, metric)
    q = queries.select("qid", F.col("vec").alias("qvec"))
    vec = nodes.select("id", "vec")
    first = q.join(entry.select("id"), how="cross").join(vec, "id").select("qid", "id", distance(metric, F.col("qvec"), F.col("vec")).alias("distance"), F.lit(False).alias("expanded"))
    beam, seen = first.checkpoint(), first.select("qid", "id").checkpoint()
    w = Window.partitionBy("qid").orderBy("distance", "id")
    step = 0
    while True:
        front = beam.where(~F.col("expanded")).select("qid", "id")
        if front.isEmpty():
            break
        new = front.join(nodes.select("id", "neighbors"), "id").select("qid", F.explode("neighbors").alias("id")).distinct().join(seen, ["qid", "id"], "left_anti")
        scored = new.join(vec, "id").join(q, "qid").select("qid", "id", distance(metric, F.col("qvec"), F.col("vec")).alias("distance"), F.lit(False).alias("expanded"))
        both = beam.withColumn("expanded", F.lit(True)).unionByName(scored)
        beam = both.withColumn("r", F.row_number().over(w)).where(F.col("r") <= width).drop("r").checkpoint()
        seen = seen.unionByName(new.select("qid", "id"))
        step += 1
        if step % checkpoint_every == 0:
            seen = seen.checkpoint()
    return beam.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("qid", "rank", "id", "distance")
