"""run() against a plain version of its stages on a small corpus, and what each stage must hold to."""

import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from nimbusvec.llm import mixing, quality
from nimbusvec.llm.queries import tokenizer_path
from tests.llm.common import NASTY, nasty
from tests.llm.test_packing import checked
from tests.llm.test_simhash import plain_classes, plain_fingerprint

WS = re.compile("[\x20\x09-\x0d]")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The small documents with exact and near copies added, and their labels."""
    at = str(tmp_path_factory.mktemp("sf"))
    d = spark.read.parquet(f"{SF}/documents.parquet")
    rng = random.Random(4)
    rows = [tuple(r) for r in d.collect()]
    more = []
    for k, r in enumerate(rng.sample(rows, 60)):
        words = r[1].split(" ")
        if k % 2:
            words[rng.randrange(len(words))] = "other"
        more.append((1000 + k, " ".join(words) + " " * (k % 3), r[2], r[3], r[4]))
    spark.createDataFrame(rows + more, d.schema).write.parquet(f"{at}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{at}/labels.parquet")
    return at


def test_run_against_brute_force(spark, folder):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    scores = {r.doc_id: r.predicted for r in quality.quality(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")).collect()}
    good = {i for i in docs if scores[i]}
    groups = {}
    for i in good:
        groups.setdefault(WS.sub("", docs[i].text), []).append((-len(docs[i].text), i))
    once = sorted(min(g)[1] for g in groups.values())
    assert len(once) < len(good) < len(docs)
    fps = {i: plain_fingerprint(docs[i].text) for i in once}
    roots = plain_classes(sorted(set(fps.values())))
    least = {}
    for i in once:
        least.setdefault(roots[fps[i]], i)
    unlike = sorted(least.values())
    assert len(unlike) < len(once)
    kept = spark.read.parquet(f"{folder}/documents.parquet").where(F.col("doc_id").isin(unlike))
    copies = {r.doc_id: r.taken // r.size for r in mixing.mix(kept).collect() if r.taken}
    got = corpus_pipeline.run(spark, folder).collect()
    times = {}
    for r in got:
        if r.piece == 0:
            times[r.doc_id] = times.get(r.doc_id, 0) + 1
    assert times == copies
    single = [i for i, n in copies.items() if n == 1]
    ends = {}
    for r in got:
        ends.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in ends.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(ends) <= 1.02 * -(-sum(r.length for r in got) // 2048) + 1
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    for i in single:
        assert sum(r.length for r in got if r.doc_id == i) == len(t.encode(docs[i].text, add_special_tokens=False).ids) + 1


def test_stages_keep_the_columns_and_take_nasty_rows(spark, tmp_path):
    df = nasty(spark)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, df, SF)
        if k + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == df.columns, name
        at = str(tmp_path / str(k))
        out.write.parquet(at)
        assert spark.read.parquet(at).count() >= 0
        empty = stage(spark, df.limit(0), SF)
        assert empty.count() == 0, name


def test_stages_are_as_registered():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "SimHash near-dedup", "mixing sources", "best-fit packing"]
    assert corpus_pipeline.ORACLE_SQL is None and checked and NASTY
