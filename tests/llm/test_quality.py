import zlib

import numpy as np
import pytest

from nimbusvec.llm import quality
from tests.llm.common import NASTY, docs, nasty

D = "/root/testdata/sf0.1"


def tables(spark, d=D):
    return spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")


def test_held_out_accuracy(spark):
    d, l = tables(spark)
    got = quality.quality(d, l).join(l, "doc_id").where("held_out").toPandas()
    assert (got.predicted == got.quality).mean() > 0.97
    assert got[got.quality == 1].predicted.mean() > 0.97 and got[got.quality == 0].predicted.mean() < 0.1
    assert got.score.between(0, 1).all()


def test_held_out_labels_are_not_learnt(spark):
    d, l = tables(spark, "/root/testdata/sf0.01")
    flipped = l.selectExpr("doc_id", "CASE WHEN crc32(CAST(doc_id AS STRING)) % 4 = 2 THEN 1 - quality ELSE quality END AS quality")
    a, b = (quality.quality(d, x).toPandas().set_index("doc_id") for x in (l, flipped))
    assert (a.score == b.score.reindex(a.index)).all()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in a.iterrows())


def test_nasty_rows(spark):
    labels = spark.createDataFrame([(7, 1), (8, 1), (8, 1), (6, 0), (None, 1), (5, None)], "doc_id long, quality int")
    got = quality.quality(nasty(spark), labels).toPandas()
    assert len(got) == len(NASTY) and got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.7)).all()
    assert not got[got.doc_id.isna()].held_out.any()
    none = quality.quality(nasty(spark), labels.limit(0)).toPandas()
    assert np.allclose(none.score, 0.5)
    assert quality.quality(docs(spark, []), labels).collect() == []


def test_keep_good_keeps_columns(spark):
    d, l = tables(spark, "/root/testdata/sf0.01")
    df = d.selectExpr("*", "'mine' AS _x", "'mine' AS x")
    kept = quality.keep_good(df, l)
    assert kept.columns == df.columns
    want = {r.doc_id for r in quality.quality(d, l).where("predicted = 1").collect()}
    assert {r.doc_id for r in kept.collect()} == want


@pytest.mark.parametrize("raw", [None, b"", b" \n ", b"x", b"a b c\nd e f\n" * 5000, bytes(range(256))])
def test_statistics_are_finite(raw):
    x = quality.statistics(raw)
    assert len(x) == len(quality.STATISTICS) and np.isfinite(x).all()


def test_model_is_the_discriminant(spark):
    rng = np.random.default_rng(0)
    n = len(quality.STATISTICS)
    x = np.concatenate([rng.standard_normal((400, n)), 2 * rng.standard_normal((300, n)) + 1])
    y = [1] * 400 + [0] * 300
    rows = spark.createDataFrame([(i, [float(v) for v in r], c) for i, (r, c) in enumerate(zip(x, y))], "id long, x array<double>, y int")
    m = quality.fit(rows)
    def log_density(c):
        cov = m.factors[c] @ m.factors[c].T
        d = x - m.means[c]
        return -0.5 * (d @ np.linalg.inv(cov) * d).sum(1) - 0.5 * np.linalg.slogdet(cov)[1]
    prior = np.log(401 / 702) - np.log(301 / 702)
    assert np.allclose(m.difference(x), log_density(1) - log_density(0) + prior)
    assert ((m.score(x) > 0.5) == (np.array(y) == 1)).mean() > 0.95
    assert np.allclose(m.means[1], x[:400].mean(0))
