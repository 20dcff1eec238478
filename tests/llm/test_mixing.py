import random
from fractions import Fraction

import pytest

from nimbusvec.llm import mixing
from tests.helpers import same, sql
from tests.llm.common import NASTY, WORD, docs, nasty


def brute_targets(sizes, weights=(5, 2, 1), epochs=3):
    """Water-filling round by round, as the contract words it."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, target = Fraction(sum(sizes.values())), set(order), {}
    while open_:
        total = sum(w[s] for s in open_)
        over = {s for s in open_ if left * w[s] / total > epochs * sizes[s]}
        if not over:
            return target | {s: left * w[s] / total for s in open_}
        for s in over:
            target[s] = Fraction(epochs * sizes[s])
            left -= target[s]
        open_ -= over
    return target


def check(df, rows):
    got = mixing.mix(df).collect()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(WORD.findall(t or ""))
    want = brute_targets(sizes)
    assert len(got) == len(rows)
    taken, most = {}, {}
    source = {}
    for i, t, s in rows:
        source.setdefault((i, len(WORD.findall(t or ""))), []).append(s)
    for r in got:
        assert 0 <= r.taken <= 3 * r.size and r.taken % max(r.size, 1) == 0
        s = next(x for x in source[(r.doc_id, r.size)] if sizes[x] == r.source_size)
        assert r.target == pytest.approx(float(want[s]))
        taken[s] = taken.get(s, 0) + r.taken
        most[s] = max(most.get(s, 0), r.size)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= most[s] + 1e-6


@pytest.mark.parametrize("seed", range(4))
def test_random_sources(spark, seed):
    rng = random.Random(seed)
    names = ["a", "b", "é", "B", None, "null", "=", "zz"][: 3 + seed]
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 5, 80])), names[0] if rng.random() < 0.5 else rng.choice(names)) for i in range(700)]
    check(docs(spark, rows), rows)


def test_sources_that_reach_their_cap_hand_on(spark):
    rows = [(0, "w " * 3, "a"), (1, "w " * 1000, "b"), (2, "w " * 10, "c")] + [(3 + i, "w " * 7, "d") for i in range(100)]
    check(docs(spark, rows), rows)
    r = {x.doc_id: x for x in mixing.mix(docs(spark, rows)).collect()}
    assert r[0].target == 9 and r[0].taken == 9


def test_nasty_rows_and_reruns(spark):
    rows = [t for t in NASTY if t[0] not in (9, None)]
    check(docs(spark, rows), rows)
    assert mixing.mix(nasty(spark)).count() == len(NASTY)
    key = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
    assert key(mixing.mix(nasty(spark))) == key(mixing.mix(nasty(spark).repartition(5)))
    assert mixing.mix(docs(spark, [])).collect() == []
    assert {r.taken for r in mixing.mix(docs(spark, [None, ""])).collect()} == {0}


def test_mixed_repeats_rows_as_taken(spark):
    df = nasty(spark)
    got = mixing.mixed(df)
    assert got.columns == df.columns and got.where("key <> 'mine'").count() == 0
    want = {}
    for r in mixing.mix(df).collect():
        if r.size:
            want[r.doc_id] = want.get(r.doc_id, 0) + r.taken // r.size
    have = {}
    for r in got.collect():
        have[r.doc_id] = have.get(r.doc_id, 0) + 1
    assert have == {k: v for k, v in want.items() if v}


def test_query_matches_its_sql(spark):
    from nimbusvec.llm import queries

    same(queries.op5_mixing(spark, "/root/testdata/sf0.001").toPandas(), sql(queries.OP5_SQL))
