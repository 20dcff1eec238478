import numpy as np
import pytest

from nimbusvec.llm import embeddings as E
from tests.helpers import same, sql
from tests.llm.common import components

KIND = "vec_id long, embedding array<double>, label int, node long, weight long, cell int"


def table(spark, vectors, ids=None):
    return spark.createDataFrame([(i if ids is None else ids[i], None if v is None else [None if x is None else float(x) for x in v], 0, 0, 0, 0) for i, v in enumerate(vectors)], KIND)


def brute(vectors, threshold=0.9):
    x = np.array(vectors, float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    close = x @ x.T >= threshold
    np.fill_diagonal(close, False)
    roots = components(range(len(x)), zip(*map(list, np.nonzero(close))))
    return {i: (int(close[i].sum()), roots[i], roots[i] == i) for i in range(len(x))}, close


def planted(n, dim, rng, cosines):
    """Random unit vectors, then for each cosine a vector at just that cosine from one of them."""
    x = rng.standard_normal((n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    out = [x]
    for c in cosines:
        base = x[rng.integers(n)]
        other = rng.standard_normal(dim)
        other -= (other @ base) * base
        out.append((c * base + np.sqrt(1 - c * c) * other / np.linalg.norm(other))[None] * rng.uniform(0.1, 9))
    return np.concatenate(out)


@pytest.mark.parametrize(("block", "per_cell"), [(8192, 400), (16, 40)])
def test_small_tables_are_exact(spark, block, per_cell):
    rng = np.random.default_rng(block)
    v = planted(150, 24, rng, np.concatenate([np.linspace(0.85, 0.999, 80), [1.0] * 10]))
    hot = v[0] + 0.01 * rng.standard_normal((60, 24))
    v = np.concatenate([v, hot, np.repeat(v[3:4], 20, axis=0)])
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in E.links(table(spark, v), block=block, per_cell=per_cell).collect()}
    assert got == brute(v)[0]


def test_recall_over_many_cells(spark):
    rng = np.random.default_rng(1)
    v = planted(6000, 64, rng, np.concatenate([np.linspace(0.9001, 0.93, 400), np.linspace(0.93, 0.999, 400)]))
    want, _ = brute(v)
    got = {r.vec_id: r.n_links for r in E.links(table(spark, v), per_cell=100).collect()}
    assert all(got[i] <= want[i][0] for i in got)
    assert sum(got.values()) / sum(w[0] for w in want.values()) > 0.95


def test_bad_vectors_link_with_nothing(spark):
    ok = [1.0, 2.0]
    v = [ok, ok, None, [], [0, 0], [None, 1], [float("nan"), 1], [float("inf"), 1], [2, 4], [-0.0, 1], [0.0, 1], [1, 2, 3], [1e-200, 2e-200], [1e200, 2e200]]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in E.links(table(spark, v)).collect()}
    for i in (2, 3, 4, 5, 6, 7, 11):
        assert got[i] == (0, i, True), i
    linked = {0, 1, 8, 12, 13}
    for i in linked:
        assert got[i][:2] == (len(linked) - 1, 0)
    assert got[9] == (1, 9, True) and got[10] == (1, 9, False)


def test_ids_null_or_repeated_and_empty(spark):
    got = E.links(table(spark, [[1.0, 0], [1.0, 0], [1.0, 0.1], [0, 1.0]], [5, 5, None, None])).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in got), key=repr) == sorted([(5, 2, 5, True), (5, 2, 5, True), (None, 2, 5, False), (None, 0, None, False)], key=repr)
    assert E.links(table(spark, [])).collect() == []
    assert E.links(table(spark, [None, [0.0]])).count() == 2


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize("dim", [64, 300])
def test_estimates_are_unbiased_and_bounded(dim):
    rng = np.random.default_rng(2)
    x, y = unit(rng.standard_normal((400, dim))), unit(rng.standard_normal((400, dim)))
    diffs = []
    for seed in range(20):
        code, factor = E.encode(E.rotate(x, seed))
        d = E.estimate(code, factor, E.rotate(y, seed)) - x @ y.T
        diffs.append(d)
        assert code.shape == (400, E.width(dim) // 8)
        assert (np.abs(d) <= E.SIGMAS * E.error(factor, E.width(dim))[:, None]).mean() > 0.9995
    assert abs(np.mean(diffs)) < 1e-3


def test_long_vectors_are_rotated_without_a_matrix():
    x = unit(np.random.default_rng(3).standard_normal((3, 5000)))
    turned = E.rotate(x)
    assert turned.shape == (3, 8192) and np.allclose(turned @ turned.T, x @ x.T)


def partners(x, cosine, rng):
    e = rng.standard_normal(x.shape)
    return cosine * x + np.sqrt(1 - cosine**2) * unit(e - (e * x).sum(1, keepdims=True) * x)


@pytest.mark.parametrize("cells", [32, 256, 2048])
@pytest.mark.parametrize("kind", ["isotropic", "clustered", "flat"])
def test_pairs_at_the_threshold_meet_at_every_number_of_cells(cells, kind):
    rng = np.random.default_rng(cells)
    centres, plane = unit(rng.standard_normal((50, 64))), rng.standard_normal((8, 64))
    draw = {
        "isotropic": lambda n: unit(rng.standard_normal((n, 64))),
        "clustered": lambda n: unit(centres[rng.integers(50, size=n)] + 0.08 * rng.standard_normal((n, 64))),
        "flat": lambda n: unit(rng.standard_normal((n, 8)) @ plane + 0.05 * rng.standard_normal((n, 64))),
    }[kind]
    sample = draw(8 * cells)
    made = E.fit_cells(sample, cells, rounds=3).astype(np.float32)
    lean = E.reach(0.9, E.freedom(sample, made))
    x = draw(1000)
    (a, va), (b, vb) = E.homes(x, made, lean), E.homes(partners(x, 0.9, rng), made, lean)
    met = [p == q or q in u or p in v for p, q, u, v in zip(a, b, va, vb, strict=True)]
    assert np.mean(met) >= 0.97
    assert cells < 256 or np.mean([len(v) for v in va]) < 0.15 * cells


def test_recall_over_clusters(spark):
    rng = np.random.default_rng(8)
    centres = unit(rng.standard_normal((40, 64)))
    v = unit(centres[rng.integers(40, size=3000)] + 0.04 * rng.standard_normal((3000, 64)))
    want, _ = brute(v)
    got = {r.vec_id: r.n_links for r in E.links(table(spark, v), per_cell=50).collect()}
    assert sum(w[0] for w in want.values()) > 10_000 and all(got[i] <= want[i][0] for i in got)
    assert sum(got.values()) / sum(w[0] for w in want.values()) > 0.97


def test_codes_decide_what_is_recomputed(spark, monkeypatch):
    rng = np.random.default_rng(4)
    v = planted(300, 64, rng, [0.95] * 20)
    kept = []
    real = E.stored
    monkeypatch.setattr(E, "stored", lambda df, label: (kept.append((label, out := real(df, label)))) or out)
    linked = sum(r.n_links for r in E.links(table(spark, v)).collect())
    open_ = dict((label, t[0]) for label, t in kept)["open"]
    assert linked == sum(w[0] for w in brute(v)[0].values()) and linked / 2 <= open_.count() < 120
    monkeypatch.setattr(E, "_open_pairs", lambda code, factor, small, step, a, b, *more: (np.zeros(len(a), bool), np.zeros(len(b), bool)))
    assert sum(r.n_links for r in E.links(table(spark, v)).collect()) == 0


def test_a_vector_of_most_rows(spark):
    rng = np.random.default_rng(6)
    v = unit(rng.standard_normal((40, 16)))
    rows = [v[0]] * 900 + list(v[1:]) + [None] * 300
    got = {r.vec_id: (r.n_links, r.component_id) for r in E.links(table(spark, rows)).collect()}
    assert all(got[i] == (899, 0) for i in range(900)) and all(got[i] == (0, i) for i in range(940, 1239)) and len(got) == 1239


def test_many_lengths(spark):
    rng = np.random.default_rng(7)
    rows = [x for d in range(1, 40) for x in [rng.standard_normal(d)] * 2] + [rng.standard_normal(3000)] * 3
    got = [r.n_links for r in E.links(table(spark, rows)).orderBy("vec_id").collect()]
    assert all(n >= 1 for n in got[2:78]) and got[78:] == [2] * 3


def test_single_precision_is_kept_as_such(spark):
    x = [0.1, 0.2, 0.3]
    df = spark.createDataFrame([(1, x), (2, x), (3, [-0.1, 0.2, 0.3])], "vec_id long, embedding array<float>")
    assert [(r.n_links, r.component_id) for r in E.links(df).orderBy("vec_id").collect()] == [(1, 1), (1, 1), (0, 3)]


def test_query_matches_its_sql(spark):
    from nimbusvec.llm import queries

    same(queries.op10_embedding_dedup(spark, "/root/testdata/sf0.001").toPandas(), sql(queries.OP10_SQL))
