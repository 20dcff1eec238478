import numpy as np
import pytest

from nimbusvec.functions import proximity, rabitq
from nimbusvec.functions.distance import to_many, to_own
from nimbusvec.functions.proximity import Graph, beam_search, build_graph, exact_score, insert_rows, medoid_of, prune, random_neighbours, reached
from nimbusvec.operators import cluster
from nimbusvec.operators.exact import nearest_of
from nimbusvec.plans import index
from nimbusvec.sources.synthetic import vectors_of


def points(n, dim=16, seed=0):
    return np.random.default_rng(seed).standard_normal((n, dim))


def brute(v, q, k):
    return np.argsort(to_many("l2", q, v), axis=1, kind="stable")[:, :k]


def test_distances():
    a, b = points(5), points(7, seed=1)
    want = ((a[:, None] - b[None]) ** 2).sum(2)
    assert np.allclose(to_many("l2", a, b), want)
    assert np.allclose(to_many("ip", a, b), 1 - a @ b.T)
    assert np.allclose(to_own("l2", a, np.stack([b] * 5)), want)
    assert (to_many("l2", a, a).diagonal() == 0).all()


def test_nearest_of_is_brute_force():
    rng = np.random.default_rng(0)
    for metric in ("l2", "ip"):
        v = np.concatenate([points(200), np.repeat(points(3, seed=5), 20, axis=0), points(5) * 1e6])
        ids = rng.permutation(len(v))
        q = np.concatenate([v[:20], v[200:260:7]])
        row, got, d = nearest_of(q, np.full(len(q), -1), v, ids, 12, metric, False)
        full = to_many(metric, q, v)
        for r in range(len(q)):
            want = np.lexsort((ids, full[r]))[:12]
            assert got[row == r].tolist() == ids[want].tolist() and np.allclose(d[row == r], full[r][want])
    row, got, _ = nearest_of(v[:4], ids[:4], v, ids, 3, "l2", True)
    assert not (got == ids[:4][row]).any()


@pytest.mark.parametrize("n", [1, 2, 5, 40, 300])
def test_graph_invariants_and_full_beam(n):
    v = points(n)
    g = build_graph(np.arange(n), v, 8, 16, 1.0, 3)
    for i, near in enumerate(g.neighbours):
        near = near[near >= 0]
        assert len(near) <= 8 and i not in near and len(set(near)) == len(near)
    assert sorted(reached(g)) == list(range(n))
    rows, d, _ = beam_search(g, n, exact_score(g, v, "l2"), n)
    assert (rows[:, : min(10, n)] == brute(v, v, min(10, n))).all()
    assert (np.diff(d, axis=1) >= 0).all()


def test_repeated_vectors_go_by_id():
    v = np.repeat(points(6), 5, axis=0)
    g = build_graph(np.arange(30), v, 6, 30, 1.0, 1)
    rows, _, _ = beam_search(g, 30, exact_score(g, v, "l2"), 30)
    assert (rows[:, :5] == np.repeat(np.arange(6) * 5, 5)[:, None] + np.arange(5)).all()


def test_prune_rule():
    v = np.array([[0.0, 0], [1, 0], [1.1, 0], [0, 2], [5, 5]])
    d = to_many("l2", v[:1], v)[0]
    assert prune(v, np.arange(5), 0, np.arange(5), d, 4, 1.0).tolist() == [1, 3]
    assert prune(v, np.arange(5), 0, np.arange(5), d, 4, 1.0, keep_all_if_small=True).tolist() == [1, 2, 3, 4]
    assert len(prune(v, np.arange(5), 0, np.arange(5), d, 1, 1.0)) == 1
    kept = prune(points(60), np.arange(60), 0, np.arange(60), to_many("l2", points(60)[:1], points(60))[0], 60, 1.2)
    p = points(60)
    for i, c in enumerate(kept):
        assert all(1.2 * ((p[k] - p[c]) ** 2).sum() > ((p[0] - p[c]) ** 2).sum() for k in kept[:i])


def test_insert_grows_from_nothing_and_recalls():
    v = points(400)
    g = insert_rows(Graph(np.empty(0, np.int64), np.empty((0, 16)), np.empty((0, 12), np.int64), 0), np.arange(400), v, 40, 1.2)
    assert g.medoid == 0 and sorted(reached(g)) == list(range(400))
    rows, _, _ = beam_search(g, 400, exact_score(g, v, "l2"), 40)
    want = brute(v, v, 10)
    assert np.mean([len(set(a[:10]) & set(b)) for a, b in zip(rows, want)]) >= 9


def test_random_neighbours_clamp():
    assert random_neighbours(1, 4, 0).tolist() == [[-1] * 4]
    r = random_neighbours(3, 4, 0)
    assert all(sorted(x[x >= 0]) == [j for j in range(3) if j != i] for i, x in enumerate(r))


def test_medoid_ties_go_by_id():
    assert medoid_of(np.array([[1.0], [-1.0]]), np.array([7, 3])) == 1


@pytest.mark.parametrize("bits", [1, 2, 4, 8])
def test_codes_estimate_without_bias(bits):
    v, q = points(600, 37), points(20, 37, 1)
    codec = rabitq.make_codec(v.mean(0), bits)
    codes = rabitq.quantize(codec, v)
    assert (rabitq.unpack_levels(rabitq.pack_levels(codes.levels, bits), 37, bits) == codes.levels).all()
    est = rabitq.estimate(codec, rabitq.prepare(codec, q), codes, np.tile(np.arange(600), (20, 1)))
    err = (est - to_many("l2", q, v)) / to_many("l2", q, v)
    assert abs(err.mean()) < 0.02
    assert np.abs(err).mean() < {1: 0.2, 2: 0.12, 4: 0.04, 8: 0.004}[bits]


def test_more_levels_than_published_scale_is_worse():
    v, q = points(500, 64), points(10, 64, 1)
    at = np.tile(np.arange(500), (10, 1))
    errors = []
    for published in (False, True):
        codec = rabitq.make_codec(v.mean(0), 4, as_published=published)
        est = rabitq.estimate(codec, rabitq.prepare(codec, q), rabitq.quantize(codec, v), at)
        errors.append(np.abs(est - to_many("l2", q, v)).mean())
    assert errors[0] < errors[1]


def test_code_of_the_centroid_itself():
    codec = rabitq.make_codec(np.ones(8), 4)
    codes = rabitq.quantize(codec, np.ones((1, 8)))
    q = points(3, 8)
    assert np.allclose(rabitq.estimate(codec, rabitq.prepare(codec, q), codes, np.zeros((3, 1), int)), to_many("l2", q, np.ones((1, 8))))


def test_best_scale_is_best():
    x = np.abs(points(1, 24)[0])
    x /= np.linalg.norm(x)

    def fit(t):
        level = np.minimum(np.floor(t * x + 1e-9), 7) + 0.5
        return level @ x / np.linalg.norm(level)

    assert fit(rabitq.best_scale(x, 7) + 1e-9) >= max(fit(t) for t in np.linspace(0.1, 80, 4000)) - 1e-6


def test_balanced_and_odd_clusters():
    v = np.concatenate([points(50), points(10, seed=2) + 8])
    _, own = cluster.balanced(v, 4)
    sizes = np.bincount(own, minlength=4)
    assert sizes.max() - sizes.min() <= 1
    centres, own = cluster.odd_clusters(v, 3)
    assert len(centres) == 3 and set(own) <= {0, 1, 2}


def test_farthest_first_is_farthest():
    v = points(40)
    chosen = cluster.farthest_first(v, 5)
    for i in range(1, 5):
        near = to_many("l2", v[chosen[:i]], v).min(0)
        assert near[chosen[i]] == near.max()


def test_synthetic_generator_against_plain_integers():
    def one(seed, dim):
        s, out = 1469598103934665603 ^ seed, []
        for _ in range(dim):
            s ^= s >> 12
            s = (s ^ (s << 25)) % 2**64
            s ^= s >> 27
            out.append(((s * 2685821657736338717 % 2**64) >> 32) % 10000)
        v = np.array(out, np.float32) / np.float32(10000)
        v[seed % dim] += 4
        v[(seed * 17 + 3) % 2**32 % dim] += 1
        return v

    got = vectors_of(np.arange(1, 9), 24)
    assert all((got[i] == one(i + 1, 24)).all() for i in range(8))


def test_pruning_many_rows_is_pruning_each():
    rng = np.random.default_rng(4)
    v = np.round(rng.standard_normal((900, 6)), 1)
    ids = rng.permutation(900)
    for metric, between in (("l2", lambda p, at: ((v[p][:, None] - v[at]) ** 2).sum(2)), ("ip", lambda p, at: 1 - (v[p][:, None] * v[at]).sum(2))):
        source = rng.permutation(900)[:40]
        candidates = np.stack([rng.permutation(900)[:700] for _ in source])
        candidates[:5, 6:] = -1
        for small in (False, True):
            got = proximity._prune_rows(between, ids, source, candidates, 12, 1.2, small)
            for s, c, kept in zip(source, candidates, got, strict=True):
                want = prune(v, ids, s, c, between(np.array([s]), np.maximum(c, 0)[None])[0], 12, 1.2, metric, small)
                assert kept[kept >= 0].tolist() == want.tolist()


def test_a_build_leaves_no_row_that_its_search_misses():
    v = np.random.default_rng(5).standard_normal((900, 32))
    g = build_graph(np.arange(900), v, 10, 16, 1.0, 2)
    seen = beam_search(g, 900, exact_score(g, v, "l2"), 16)[2]
    assert seen[np.arange(900), np.arange(900)].all()
    assert (g.degrees() <= 10).all() and len(reached(g)) == 900


def test_a_beam_of_every_row_scores_each_once():
    v = np.random.default_rng(6).standard_normal((700, 8))
    g = build_graph(np.arange(700), v, 8, 16, 1.0, 3)
    scored = []
    score = lambda q, at: scored.append(at.size) or exact_score(g, v[:3], "l2")(q, at)
    rows, d, seen = beam_search(g, 3, score, 700)
    assert sum(scored) == 3 * 700 and len(scored) < 10 and seen.all()
    assert (rows[:, 0] == np.arange(3)).all() and (np.diff(d, axis=1) >= 0).all()
    g.neighbours[:, :] = -1
    assert beam_search(g, 3, score, 700)[2].sum() == 3


def test_a_search_in_single_precision_scores_each_row_once_and_finds_what_a_double_one_does():
    v = np.random.default_rng(7).standard_normal((900, 8)).astype(np.float32).astype(float)
    v[450:] = v[:450]  # ties everywhere
    g = build_graph(np.arange(900) * 3, v, 10, 16, 1.0, 4)
    for metric in ("l2", "ip"):
        for expand in (1, 4):
            scored = []
            single = proximity.single_score(g, v[:50], metric)
            exact = exact_score(g, v[:50], metric)
            rows, d, seen = beam_search(g, 50, lambda q, at: scored.append(at.size) or exact(q, at).astype(np.float32), 20, expand)  # noqa: B023
            assert sum(scored) == seen.sum()
            order = np.lexsort((np.where(rows >= 0, rows, 900), d), axis=1)
            assert (order == np.arange(20)).all()
            rounded = lambda q, at: exact(q, at).astype(np.float32).astype(float)  # noqa: E731, B023
            want = beam_search(g, 50, rounded, 20, expand)
            assert (rows == want[0]).all() and (d == want[1]).all() and (seen == want[2]).all()
            at = np.tile(np.arange(900), (50, 1))
            assert np.allclose(single(np.arange(50), at), exact(np.arange(50), at), rtol=1e-5, atol=1e-5)


def test_pruning_compares_only_candidates_that_are_left():
    v = np.random.default_rng(8).standard_normal((900, 8))
    pairs = []
    between = lambda p, at: pairs.append(at.size) or ((v[p][:, None] - v[at]) ** 2).sum(2)
    got = proximity._prune_rows(between, np.arange(900), np.arange(40), np.tile(np.arange(900), (40, 1)), 32, 1.0)
    assert (got >= 0).any(1).all() and sum(pairs) < 5 * 40 * 900


def test_a_build_with_a_table_of_distances_prunes_all_rows():
    v = np.random.default_rng(9).standard_normal((1200, 32))
    g = build_graph(np.arange(1200), v, 8, 8, 1.0, 5, settled=False)
    dist = ((v[:, None] - v[None]) ** 2).sum(2)
    np.fill_diagonal(dist, np.inf)
    assert (g.neighbours == dist.argmin(1)[:, None]).any(1).all()
    assert (build_graph(np.arange(1200), v, 8, 8, 1.0, 6, settled=False).neighbours == g.neighbours).all()


def test_a_search_with_a_goal_ends_where_it_is_scored():
    v = np.random.default_rng(10).standard_normal((900, 16))
    g = build_graph(np.arange(900), v, 10, 16, 1.0, 7)
    own = np.arange(900)
    for score in (exact_score(g, v, "l2"), proximity.single_score(g, v, "l2")):
        ended, whole = beam_search(g, 900, score, 16, goals=own)[2], beam_search(g, 900, score, 16)[2]
        assert (ended <= whole).all() and (ended[own, own] == whole[own, own]).all()
        assert 2 * ended.sum() < whole.sum()


def test_estimates_of_the_same_rows_are_one_product(monkeypatch):
    v = points(50)
    codec = rabitq.make_codec(v.mean(0), 4)
    codes, asked, at = rabitq.quantize(codec, v), rabitq.prepare(codec, v[:7]), np.arange(3, 40)
    want = rabitq.estimate(codec, asked, codes, np.tile(at, (7, 1)))
    monkeypatch.setattr(rabitq.np, "einsum", None)
    assert np.allclose(rabitq.estimate(codec, asked, codes, np.broadcast_to(at, (7, len(at)))), want, atol=1e-5)


def test_codes_of_a_small_graph_are_estimated_by_one_product(monkeypatch):
    v, q = points(300), points(20, seed=1)
    codec = rabitq.make_codec(v.mean(0), 4)
    codes = rabitq.quantize(codec, v)
    few, many = index.code_score(codec, codes, q, 299), index.code_score(codec, codes, q, 300)
    w, at = np.arange(20).repeat(2), np.random.default_rng(2).integers(0, 300, (40, 3))
    want = few(w, at)
    monkeypatch.setattr(rabitq.np, "einsum", None)
    assert np.allclose(many(w, at), want, atol=1e-4) and many(w, at).dtype == np.float32
