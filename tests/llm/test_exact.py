import hashlib
import random
import re

import pyarrow as pa
import pytest

from nimbusvec.llm import exact
from tests.helpers import same, sql
from tests.llm.common import NASTY, docs, nasty

WS = re.compile("[\x20\x09-\x0d]")


def brute(rows):
    groups = {}
    for k, (i, t) in enumerate(rows):
        groups.setdefault(WS.sub("", t or ""), []).append((-len(t or ""), i is None, i or 0, k))
    out = []
    for norm, members in groups.items():
        best = min(m[:3] for m in members)
        for m in members:
            out.append((rows[m[3]][0], None if best[1] else best[2], len(members), hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    rows = exact.exact_duplicates(df).collect()
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in rows), key=repr), rows


def test_nasty_rows(spark):
    facts, rows = got(nasty(spark))
    assert facts == brute([(i, t) for i, t, _ in NASTY])
    assert sum(r.kept for r in rows) == len({r.text_sha256 for r in rows})
    assert exact.exact_duplicates(docs(spark, [])).collect() == []


@pytest.mark.parametrize("limit", [1 << 26, 1000])
def test_random_rows_with_a_hot_text(spark, monkeypatch, limit):
    monkeypatch.setattr(exact, "BUCKET_BYTES", limit)
    rng = random.Random(limit)
    texts = [rng.choice(["hot text", "hot  text", "hot\ttext "]) if rng.random() < 0.4 else "".join(rng.choices("ab \n", k=rng.randint(0, 9))) for _ in range(1500)]
    facts, rows = got(docs(spark, texts).repartition(7))
    assert facts == brute(list(enumerate(texts)))
    assert all(r.kept == (r.doc_id == r.keep_id) for r in rows)


def test_drop_duplicates_keeps_columns_and_one_row(spark):
    df = nasty(spark)
    kept = exact.drop_duplicates(df)
    assert kept.columns == df.columns
    rows = kept.collect()
    assert len(rows) == len({WS.sub("", r.text or "") for r in df.collect()})
    assert [r.doc_id for r in rows].count(9) == 1


def test_directory_doubles_only_overfull_buckets():
    weights = {0b0000: 90, 0b0001: 5, 0b1000: 3, 0b1100: 4}
    got = exact.double_directory(weights, 4, 10)
    assert got[(1, 1)] == 7 and got[(4, 0)] == 90 and got[(4, 1)] == 5 and sum(got.values()) == 102
    assert exact.double_directory({}, 8, 10) == {(0, 0): 0}


def test_every_slot_of_the_directory_has_a_bucket(spark):
    slots, depth = exact.directory(spark, {(1, 1): 7, (2, 0): 5, (3, 2): 1, (3, 3): 2}, 3)
    assert depth == 3 and sorted((r.slot, r.owner) for r in slots.collect()) == [(0, 0), (1, 0), (2, 1), (3, 1), (4, 2), (5, 2), (6, 2), (7, 2)]
    assert [tuple(r) for r in exact.directory(spark, {(0, 0): 0}, 4)[0].collect()] == [(0, 0)]


def batch(rows):
    kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(7)], ["key", "norm", "holder", "n", "points", "doc", "row"])


def test_texts_that_share_a_key_are_chained_and_compared():
    rows = [(1, b"x", 10, 2, 5, 3, 30), (1, b"y", 11, 1, 9, 1, 31), (1, b"x", 12, 4, 6, 9, 32), (2, b"x", 13, 1, 1, 2, 33)]
    out = [r for b in exact._own([batch(rows[:2]), batch(rows[2:])]) for r in b.to_pylist()]
    assert {r["holder"]: (r["keep_id"], r["group_size"]) for r in out} == {10: (9, 6), 12: (9, 6), 11: (1, 1), 13: (2, 1)}


@pytest.mark.parametrize("fan_in", [4, 64])
def test_a_text_that_every_task_holds(spark, monkeypatch, fan_in):
    monkeypatch.setattr(exact, "FAN_IN", fan_in)
    monkeypatch.setattr(exact, "folded", lambda holders, f=exact.folded: f(holders, fan_in))
    monkeypatch.setattr(exact, "FOLD_BYTES", 20)  # many holders for each task
    texts = [["hot text", "hot  text "][i % 2] if i % 10 else f"text {i % 70}" for i in range(1200)]
    facts, rows = got(docs(spark, texts).repartition(9))
    assert facts == brute(list(enumerate(texts)))


def test_merging_compares_bytes_and_keeps_shares_apart():
    rows = [(1, 0, b"x", 10, 2, 5, 3, 30), (1, 0, b"y", 11, 1, 9, 1, 31), (1, 0, b"x", 12, 4, 6, 9, 32), (1, 1, b"x", 13, 1, 1, 2, 33)]
    kinds = [pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * 5]
    b = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(8)], list("abcdefgh"))
    out = [r for x in exact._merge([b.slice(0, 2), b.slice(2)]) for r in x.to_pylist()]
    assert {r["holder"]: r["parent"] for r in out if r["parent"] is not None} == {12: 10}
    assert {r["holder"]: (r["n"], r["best_doc"]) for r in out if r["parent"] is None} == {10: (6, 9), 11: (1, 1), 13: (1, 2)}


def test_rows_are_dropped_where_they_lie(spark):
    from nimbusvec.llm.shared import InPlace, bucket_keys

    n = 37
    keys = spark.createDataFrame([(k,) for k in bucket_keys(n)], "k int")
    assert [r[0] for r in keys.selectExpr(f"pmod(hash(k), {n})").collect()] == list(range(n))
    rows = InPlace(docs(spark, [f"text {i}" for i in range(50)]).repartition(6), "rows")
    kept = rows.kept(rows.rows.where("doc_id % 3 = 0").selectExpr(f"`{rows.row}` AS row"))
    assert sorted(r.doc_id for r in kept.collect()) == list(range(0, 50, 3))
    plan = kept._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Exchange hashpartitioning") == 1 and "ShuffledHashJoin" in plan and "Bucketed: true" in plan


def test_folding_is_bounded_and_loses_nothing(monkeypatch):
    monkeypatch.setattr(exact, "FOLD_BYTES", 8)
    texts = [b"aaaa", b"bbbb", b"cccc", b"aaaa", b"aa aa", b""]
    b = pa.RecordBatch.from_arrays([pa.array(range(6), pa.int64()), pa.array(range(6), pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array(texts, pa.binary())], ["a", "b", "c", "d"])
    rows = [r for out in exact._fold([b]) for r in out.to_pylist()]
    bare, holders = [r for r in rows if r["norm"] is None], {r["holder"]: r for r in rows if r["norm"] is not None}
    assert [r["row"] for r in bare] == list(range(6)) and sum(r["n"] for r in holders.values()) == 6
    assert all(holders[r["holder"]]["norm"] == texts[r["row"]].replace(b" ", b"") for r in bare)


def test_query_matches_its_sql(spark):
    from nimbusvec.llm import queries

    same(queries.op3_exact_dedup(spark, "/root/testdata/sf0.001").toPandas(), sql(queries.OP3_SQL))
