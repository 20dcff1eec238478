import numpy as np
import pytest

import __spark_entry__ as entry
from nimbusvec import queries as q
from nimbusvec.operators import cluster
from tests.helpers import DATA, same, sql

ORACLES = q.oracle_sql()
#: Recall that approximate searches must reach.
RECALL = {"beam_32": 0.9, "rabitq_4bit": 0.9}


@pytest.mark.parametrize("name", [k for k in q.queries() if k in ORACLES])
def test_query_matches_its_sql(spark, name):
    same(q.queries()[name](spark, DATA).toPandas(), sql(ORACLES[name]))


@pytest.mark.parametrize("name", [k for k in q.queries() if k not in ORACLES and k not in RECALL])
def test_query_without_sql_gives_rows(spark, name):
    df = q.queries()[name](spark, DATA)
    assert df.columns and df.count() > 0


@pytest.mark.parametrize("name", RECALL)
def test_approximate_search_recalls(spark, name):
    got, want = q.queries()[name](spark, DATA).toPandas(), sql(ORACLES["knn_exact_l2"])
    found = set(zip(got.qid, got.id)) & set(zip(want.qid, want.id))
    assert len(found) / len(want) >= RECALL[name]


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(q.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 100


def test_clusters_of_no_rows(spark, tmp_path):
    spark.read.parquet(f"{DATA}/embeddings.parquet").limit(0).write.parquet(f"{tmp_path}/embeddings.parquet")
    for name in ("balanced_kmeans", "odd_kmeans", "farthest_first"):
        assert q.queries()[name](spark, str(tmp_path)).count() == 0


def test_clusters_of_a_sample_take_every_row(spark, monkeypatch):
    v = q._vectors(spark, DATA).toPandas().set_index("id").vec.map(lambda x: np.array(x, float))
    whole = q.odd_kmeans(spark, DATA).toPandas()
    monkeypatch.setattr(cluster, "SAMPLE_ROWS", 100)
    monkeypatch.setattr(cluster, "BALANCED_ROWS", 40)
    assert len(v) > 100
    balanced, odd = q.balanced_kmeans(spark, DATA).toPandas(), q.odd_kmeans(spark, DATA).toPandas()
    for got in (balanced, odd, whole):
        assert sorted(got.id) == sorted(v.index) and set(got.cluster) == set(range(got.cluster.nunique()))
    sizes = balanced.groupby("cluster").size()
    assert len(sizes) == 5 and sizes.max() - sizes.min() <= 1
    starts = q.farthest_first(spark, DATA).toPandas().sort_values("place").id.tolist()
    assert len(starts) == 8
    for n in range(1, 8):
        near = np.min([[((x - v[s]) ** 2).sum() for x in v] for s in starts[:n]], axis=0)
        assert starts[n] == v.index[near.argmax()] or np.isclose(near.max(), near[v.index.get_loc(starts[n])])
