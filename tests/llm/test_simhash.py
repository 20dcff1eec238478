import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from nimbusvec.llm import graph, simhash
from tests.llm.common import NASTY, WORD, components, docs, nasty


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    if not grams:
        return 0
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_classes(fps, distance=3):
    return components(fps, [(a, b) for i, a in enumerate(fps) for b in fps[:i] if (a ^ b).bit_count() <= distance])


@pytest.mark.parametrize("text", [t for _, t, _ in NASTY] + ["a b c d e", "x y x y x y x y"])
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode() if text is not None else None) == plain_fingerprint(text)


def test_long_text_is_read_in_steps(monkeypatch):
    monkeypatch.setattr(simhash, "STEP", 16)
    text = " ".join(random.Random(1).choices(["ab", "c", "defgh", "i" * 40], k=300))
    assert simhash.fingerprint(text.encode()) == plain_fingerprint(text)


def cluster(rng, n, flips):
    base = rng.getrandbits(64)
    return [base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, flips))) for _ in range(n)]


@pytest.mark.parametrize(("group", "parts"), [(8192, 4), (8, 4), (8192, 3), (4, 2)])
def test_classes_against_all_pairs(spark, group, parts):
    rng = random.Random(group + parts)
    fps = {rng.getrandbits(64) for _ in range(300)} | {0, 1, 2**64 - 1}
    for _ in range(12):
        fps |= set(cluster(rng, 25, 4))
    fps |= {rng.getrandbits(12) for _ in range(150)}  # many constant bits
    fps = sorted(fps)
    want = plain_classes(fps)
    table = spark.createDataFrame([(simhash._signed(f), i) for i, f in enumerate(fps)], "fp long, id long")
    got = {r.fp % 2**64: r.least for r in simhash.classes(table, "id", parts=parts, group=group).collect()}
    first = {}
    for i, f in enumerate(fps):
        first[want[f]] = min(first.get(want[f], i), i)
    assert got == {f: first[want[f]] for f in fps}


def test_documents_against_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [rng.choices(vocabulary, k=rng.randint(3, 400)) for _ in range(60)]
    texts = [" ".join(b) for b in base]
    for b in base[:30]:  # near copies
        c = list(b)
        c[rng.randrange(len(c))] = "other"
        texts += [" ".join(c), "  ".join(b).upper()]
    texts += [None, "", " ", "one", "one"]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs(spark, texts)).collect()}
    fps = [plain_fingerprint(t) for t in texts]
    roots = plain_classes(sorted(set(fps)))
    least = {}
    for i, f in enumerate(fps):
        least.setdefault(roots[f], i)
    assert got == {i: (f"{f:016x}", least[roots[f]]) for i, f in enumerate(fps)}


def test_nasty_rows(spark):
    got = simhash.near_duplicates(nasty(spark)).collect()
    assert len(got) == len(NASTY)
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, set()).add((r.fingerprint, r.component_id))
    assert by_id[1] == by_id[2] == by_id[3] == {("0" * 16, 1)} and by_id[8] == by_id[7] == by_id[12] and len(by_id[9]) == 1
    assert simhash.near_duplicates(docs(spark, [])).collect() == []


def test_keep_one(spark):
    df = nasty(spark)
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns and kept.where("score <> 'mine'").count() == 0
    ids = sorted((r.doc_id for r in kept.collect()), key=str)
    assert ids.count(9) == 0 and 7 in ids and 8 not in ids and 12 not in ids and 1 in ids and 2 not in ids and ids.count(None) == 1
    twice = simhash.keep_one(docs(spark, [(4, "a b c d", "s"), (4, "a b c d", "s")]))
    assert twice.count() == 1
    assert simhash.keep_one(docs(spark, [])).count() == 0


def test_units_by_dynamic_programming():
    costs = [[0, 5, 50], [0, 1, 3], [0, 9, 9.5], [0, 100, 200]]
    best = min((sum(c[u] for c, u in zip(costs, us)), us) for us in np.ndindex(3, 3, 3, 3) if sum(us) == 4)
    assert sum(c[u] for c, u in zip(costs, simhash.allot(costs, 4))) == best[0]
    with pytest.raises(ValueError):
        simhash.allot([[0, 1]], 4)


def test_correlated_bits_share_a_part(spark):
    rng = np.random.default_rng(0)
    bits = rng.integers(0, 2, (4000, 64))
    for k in range(16):  # bits k, k + 16, k + 32 and k + 48 mostly agree for k < 8
        if k < 8:
            for j in (16, 32, 48):
                bits[:, k + j] = np.where(rng.random(4000) < 0.95, bits[:, k], bits[:, k + j])
    together = (bits.T @ bits).astype(float)
    groups = simhash.group_bits(together, 4000)
    assert sorted(b for g in groups for b in g) == list(range(64)) and {len(g) for g in groups} == {16}
    for k in range(8):
        assert any({k, k + 16, k + 32, k + 48} <= set(g) for g in groups)


def test_pair_estimates(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**63, 3000, dtype=np.int64) & ~np.int64(0xFF00) | (rng.integers(0, 3, 3000) << 8)
    df = spark.createDataFrame([(int(v),) for v in x], "fp long")
    mask = 0x7F00
    want = sum(int(c) ** 2 for c in np.unique(x & mask, return_counts=True)[1])
    assert abs(simhash.pair_estimates(df, [mask])[0] / want - 1) < 0.2


@pytest.mark.parametrize("kind", ["chain", "star", "random", "empty"])
def test_components(spark, kind):
    rng = random.Random(2)
    pairs = {"chain": [(i, i + 1) for i in range(150)], "star": [(0, i) for i in range(1, 200)] + [(500, 501)], "random": [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] * 2, "empty": []}[kind]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    want = components({n for p in pairs if p[0] != p[1] for n in p}, pairs)
    assert got == want


@pytest.mark.parametrize("kind", ["chain", "star", "random", "empty"])
def test_components_in_rounds(spark, kind, monkeypatch):
    monkeypatch.setattr(graph, "TASK_EDGES", 0)
    test_components(spark, kind)


def test_few_edges_take_no_rounds(spark, monkeypatch):
    rounds, star = [], graph._large_star
    monkeypatch.setattr(graph, "_large_star", lambda *a: rounds.append(a) or star(*a))
    test_components(spark, "random")
    assert not rounds


def test_classes_write_no_row_for_what_has_no_link(spark, monkeypatch):
    wrote, put = {}, simhash.stored

    def counted(df, label):
        out = put(df, label)
        wrote[label] = out[0].count()
        return out

    monkeypatch.setattr(simhash, "stored", counted)
    fps = [0, 1, *(((1 << 40) - 1) * (2 * k + 1) << 5 & (1 << 63) - 1 for k in range(0, 3000, 97))]
    want = plain_classes(fps)
    got = {r.fp: r.least for r in simhash.classes(spark.createDataFrame([(f, f) for f in fps], "fp long, id long"), "id").collect()}
    assert got == want and sum(want.values()) < sum(fps)
    linked = sum(len([f for f in fps if want[f] == r]) for r in set(want.values()) if list(want.values()).count(r) > 1)
    assert max(n for label, n in wrote.items() if label not in ("distinct", "hot", "split")) <= linked < len(fps)


def test_spanning_forest_never_lists_pairs():
    x = np.array(sorted({int(f) for f in np.random.default_rng(0).integers(0, 64, 500)}), np.uint64)
    a, b = simhash.close_pairs(x, np.array([0]), np.array([len(x)]), 3)
    assert len(a) == len(x) - 1 and (b == 0).all()


def test_extra_columns_and_types(spark):
    df = docs(spark, ["a b c"]).withColumn("doc_id", F.col("doc_id").cast("int"))
    assert simhash.near_duplicates(df).first().component_id == 0
