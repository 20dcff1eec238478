"""What Python workers hold on to between tasks."""

from pyspark.sql import functions as F

from nimbusvec.llm import packing, quality, shared, simhash
from nimbusvec.llm.queries import tokenizer_path
from tests.llm.common import docs


def test_workers_forget_what_other_operators_keep(monkeypatch):
    monkeypatch.setattr(shared, "kept", {"a": {1: 2}, "b": {3: 4}})
    given = []
    monkeypatch.setattr(shared, "give_back", lambda: given.append(1))
    run = shared.lean(lambda parts: (2 * x for x in parts), "b")
    assert list(run(iter([1, 2]))) == [2, 4]
    assert shared.kept == {"a": {}, "b": {3: 4}} and given == [1]


def test_a_worker_drops_its_tokenizer_for_other_operators():
    assert packing._words is shared.kept["packing"]
    packing.batch_ids(["some words"], tokenizer_path())
    assert packing._words
    assert list(shared.lean(lambda parts: parts, "packing")(iter([]))) == [] and packing._words
    for udf in (quality._statistics, simhash._fingerprints):
        packing.batch_ids(["some words"], tokenizer_path())
        assert len(list(udf.func(iter([])))) == 0 and not packing._words


def test_ids_are_right_after_forgetting(spark):
    df = docs(spark, ["some words", "more words", None])
    first = packing.pieces(df, tokenizer_path(), "doc_id", "text").collect()
    assert simhash.near_duplicates(df).count() == 3
    assert packing.pieces(df, tokenizer_path(), "doc_id", "text").collect() == first


def test_small_tables(spark):
    got = shared.small_table(spark, [(1, 2), (3, None)], "a long, b int")
    assert got.dtypes == [("a", "bigint"), ("b", "int")] and [tuple(r) for r in got.orderBy("a").collect()] == [(1, 2), (3, None)]
    assert shared.small_table(spark, [], "a long, b int").where(F.col("a") > 0).count() == 0
