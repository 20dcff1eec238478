"""Numpy kernels of the proximity graph: best-first beam search, diversity pruning, building, inserting.

A graph is its vectors (n, dim), its neighbours (n, R) as row numbers with -1 for none, and
its entry row, the medoid. Ties in distance go by id everywhere, so results repeat.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from nimbusvec.functions.distance import Metric, to_many, to_own

#: Extra room of the beam when distances are estimates.
ESTIMATE_SLACK = 64
#: Rows of a graph up to which its build keeps a table of all distances, rows that a build's search expands at a time, and rows that a build takes at once.
TABLE_ROWS, EXPAND, STEP = 1 << 13, 4, 1024
#: Neighbours of a row that are taken by whole lines of the table of all distances.
WHOLE_SLOTS = 4
#: Rows that a beam of every row scores at once, and pairs that pruning compares at once.
WHOLE_ROWS, PAIRS = 256, 1 << 16
#: A key of a row at a distance in single precision: the distance's bits, the row in ROW_BITS, and a free bit; keys sort by distance, then row. NO_KEY sorts last.
ROW_BITS, NO_KEY = 30, np.iinfo(np.int64).max
Score = Callable[[np.ndarray, np.ndarray], np.ndarray]


@dataclass
class Graph:
    ids: np.ndarray
    vectors: np.ndarray
    neighbours: np.ndarray
    medoid: int

    @property
    def degree(self) -> int:
        return self.neighbours.shape[1]

    def degrees(self) -> np.ndarray:
        return (self.neighbours >= 0).sum(1)


def exact_score(graph: Graph, queries: np.ndarray, metric: Metric | str) -> Score:
    """Distances of queries[q[i]] to the rows at[i]."""
    return lambda q, at: to_many(metric, queries[q], graph.vectors[at[0]]) if len(at) and not at.strides[0] else to_own(metric, queries[q], graph.vectors[at])


def single_score(graph: Graph, queries: np.ndarray, metric: Metric | str) -> Score:
    """exact_score() in single precision, for a search whose beam gets true distances afterwards."""
    q32, v32, l2 = queries.astype(np.float32), graph.vectors.astype(np.float32), Metric(metric) is Metric.L2

    def score(q: np.ndarray, at: np.ndarray) -> np.ndarray:
        a, b = q32[q][:, None], v32[at]
        if l2:
            b -= a
            return np.einsum("ijk,ijk->ij", b, b)
        return np.float32(1) - np.einsum("ijk,ijk->ij", np.broadcast_to(a, b.shape), b)

    return score


def medoid_of(vectors: np.ndarray, ids: np.ndarray) -> int:
    d = ((vectors - vectors.mean(0)) ** 2).sum(1)
    return int(np.lexsort((ids, d))[0])


def _by_distance(dist: np.ndarray, ids: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The order of each row's distances, ties by the ids that are asked for the rows with any."""
    order = np.argsort(dist, axis=1, kind="stable")
    near = np.take_along_axis(dist, order, axis=1)
    tied = np.flatnonzero(((near[:, 1:] == near[:, :-1]) & np.isfinite(near[:, 1:])).any(1))
    if len(tied):
        order[tied] = np.lexsort((ids(tied), dist[tied]), axis=1)
    return order


def _keys(dist: np.ndarray, rows: np.ndarray) -> np.ndarray:
    bits = (dist + np.float32(0)).view(np.int32)  # no -0.0
    bits ^= (bits >> 31) & 0x7FFFFFFF
    return (bits.astype(np.int64) << (ROW_BITS + 1)) | (rows << 1)


def _rows_of(keys: np.ndarray) -> np.ndarray:
    return (keys >> 1) & ((1 << ROW_BITS) - 1)


def _distances_of(keys: np.ndarray) -> np.ndarray:
    bits = (keys >> (ROW_BITS + 1)).astype(np.int32)
    bits ^= (bits >> 31) & 0x7FFFFFFF
    return bits.view(np.float32)


def _has_keys(dist: np.ndarray, ids: np.ndarray) -> bool:
    """Whether keys order rows as distances and ids do."""
    return dist.dtype == np.float32 and len(ids) < 1 << ROW_BITS and bool((ids[1:] > ids[:-1]).all())


def beam_search(graph: Graph, count: int, score: Score, width: int, expand: int = 1, goals: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For queries 0 to count - 1 the width nearest rows found and their distances, nearest first (-1 and inf for none), and whether each query scored each row.

    Every round expands the nearest rows (expand of them) of each beam that aren't expanded yet,
    scores their unseen neighbours and trims the beam; a query ends when all of its beam is
    expanded, or once it has scored its row of goals. A beam with room for all rows drops none, so
    its queries score what the entry reaches.
    """
    n, r = graph.neighbours.shape
    width, room = min(width, n), expand * r
    seen = np.zeros((count, n), bool)
    if width == n:
        return _whole(graph, count, score, seen)
    everyone = np.arange(count)
    start = score(everyone, np.full((count, 1), graph.medoid))[:, 0]
    seen[:, graph.medoid] = True
    if _has_keys(start, graph.ids):
        return _key_search(graph, score, start, width, expand, seen, goals)
    rows = np.full((count, width + room), -1, np.int64)
    dist = np.full((count, width + room), np.inf)
    done = np.ones((count, width + room), bool)
    rows[:, 0], dist[:, 0], done[:, 0] = graph.medoid, start, False
    active = _unmet(everyone, seen, goals)
    while len(active):
        own, own_done = rows[active], done[active]
        nth = np.cumsum(~own_done[:, :width], axis=1)
        front = ~own_done[:, :width] & (nth <= expand)
        new = np.full((len(active), expand, r), -1, np.int64)
        who, slot = np.nonzero(front)
        new[who, nth[who, slot] - 1] = graph.neighbours[own[who, slot]]
        own_done[who, slot] = True
        new = new.reshape(len(active), room)
        if expand > 1:  # two rows may share a neighbour
            new.sort(axis=1)
            new[:, 1:][new[:, 1:] == new[:, :-1]] = -1
        fresh = (new >= 0) & ~seen[active[:, None], new]
        who, slot = np.nonzero(fresh)
        seen[active[who], new[who, slot]] = True
        own[:, width:], own_done[:, width:] = np.where(fresh, new, -1), ~fresh
        own_dist = dist[active]
        own_dist[:, width:] = np.where(fresh, score(active, np.where(fresh, new, 0)), np.inf)
        order = _by_distance(own_dist, lambda tied, own=own: np.where(own[tied] >= 0, graph.ids[own[tied]], np.iinfo(np.int64).max))[:, :width]
        rows[active, :width], dist[active, :width] = np.take_along_axis(own, order, axis=1), np.take_along_axis(own_dist, order, axis=1)
        left = np.take_along_axis(own_done, order, axis=1)
        done[active, :width] = left
        active = _unmet(active[~left.all(1)], seen, goals)
    return rows[:, :width], dist[:, :width], seen


def _unmet(active: np.ndarray, seen: np.ndarray, goals: np.ndarray | None) -> np.ndarray:
    return active if goals is None else active[~seen[active, goals[active]]]


def _key_search(graph: Graph, score: Score, start: np.ndarray, width: int, expand: int, seen: np.ndarray, goals: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """beam_search() from the medoid, at distances start, by keys whose free bit says that a row is expanded."""
    count, n = seen.shape
    r = graph.degree
    near = np.where(graph.neighbours < 0, graph.medoid, graph.neighbours)  # the medoid is seen from the start
    flat, base = seen.reshape(-1), np.arange(count) * n
    keys = np.full((count, width), NO_KEY)
    keys[:, 0] = _keys(start, np.full(count, graph.medoid))
    active = _unmet(np.arange(count), seen, goals)
    while len(active):
        own = keys[active]
        waits = (own & 1) == 0
        nth = np.cumsum(waits, axis=1, dtype=np.int32)
        who, slot = np.nonzero(waits & (nth <= expand))
        turn, rows = nth[who, slot], _rows_of(own[who, slot])
        own[who, slot] |= 1
        both = np.full((len(active), width + expand * r), NO_KEY)
        both[:, :width] = own
        for j in range(expand):  # one after the other, as two rows may share a neighbour
            these = turn == j + 1
            w, to = who[these], near[rows[these]]
            if not len(w):
                break
            at = base[active[w]][:, None] + to
            fresh = ~flat[at]
            flat[at[fresh]] = True
            new, found = to[fresh], np.full(to.shape, NO_KEY)
            found[fresh] = _keys(score(np.repeat(active[w], fresh.sum(1)), new[:, None])[:, 0], new)
            both[w, width + j * r : width + (j + 1) * r] = found
        both.sort(axis=1)
        own = both[:, :width]
        keys[active] = own
        active = _unmet(active[((own & 1) == 0).any(1)], seen, goals)
    some = keys < NO_KEY
    return np.where(some, _rows_of(keys), -1), np.where(some, _distances_of(keys), np.inf).astype(float), seen


def _whole(graph: Graph, count: int, score: Score, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A search whose beams hold every row: no round drops one, so all queries expand what the medoid reaches, and each row is scored once."""
    found = reached(graph)
    seen[:, found] = True
    rows, dist = np.full(seen.shape, -1, np.int64), np.full(seen.shape, np.inf)
    for i in range(0, len(found), WHOLE_ROWS):
        part = found[i : i + WHOLE_ROWS]
        rows[:, i : i + len(part)] = part
        dist[:, i : i + len(part)] = score(np.arange(count), np.broadcast_to(part, (count, len(part))))
    order = _by_distance(dist, lambda tied: np.where(rows[tied] >= 0, graph.ids[rows[tied]], np.iinfo(np.int64).max))
    return np.take_along_axis(rows, order, axis=1), np.take_along_axis(dist, order, axis=1), seen


def prune(vectors: np.ndarray, ids: np.ndarray, source: int, candidates: np.ndarray, distances: np.ndarray, degree: int, alpha: float, metric: Metric | str = Metric.L2, keep_all_if_small: bool = False) -> np.ndarray:
    """Diverse neighbours of source: nearest first, a candidate goes if a kept one p has alpha * d(p, c) <= d(source, c).

    keep_all_if_small keeps every candidate if they are no more than degree, unexamined.
    """
    other = (candidates >= 0) & (candidates != source)
    c, d = candidates[other], distances[other]
    order = np.lexsort((ids[c], d))
    c, d = c[order], d[order]
    first = np.sort(np.unique(c, return_index=True)[1])  # of a repeated one, its least distance
    c, d = c[first], d[first]
    if keep_all_if_small and len(c) <= degree:
        return c
    l2, kept, v = Metric(metric) is Metric.L2, [], vectors[c]
    while len(c):
        kept.append(int(c[0]))
        if len(kept) == degree:
            break
        if l2:
            diff = v[1:] - v[0]
            between = np.einsum("ij,ij->i", diff, diff)
        else:
            between = 1.0 - v[1:] @ v[0]
        alive = alpha * between > d[1:]
        c, d, v = c[1:][alive], d[1:][alive], v[1:][alive]
    return np.array(kept, np.int64)


def random_neighbours(n: int, degree: int, seed: int) -> np.ndarray:
    """degree distinct rows for each row, itself not among them; fewer rows than that: all others."""
    r = min(degree, max(n - 1, 0))
    out = np.full((n, degree), -1, np.int64)
    if r:
        rng = np.random.default_rng(seed)
        for i in range(n):
            pick = rng.choice(n - 1, r, replace=False)
            out[i, :r] = pick + (pick >= i)
    return out


def _between(vectors: np.ndarray, metric: Metric | str) -> Score:
    """Distances of the rows p[i] to the rows at[i]: from one table of all pairs where the rows are few, else as they are asked for."""
    if len(vectors) > TABLE_ROWS:
        return lambda p, at: to_own(metric, vectors[p], vectors[at])
    return _looked_up(_table(vectors, metric))


def _table(vectors: np.ndarray, metric: Metric | str) -> np.ndarray:
    l2 = Metric(metric) is Metric.L2
    table = np.empty((len(vectors), len(vectors)), np.float32)
    size = (vectors * vectors).sum(1)
    for i in range(0, len(vectors), STEP):
        near = vectors[i : i + STEP] @ vectors.T
        table[i : i + STEP] = np.maximum(size[i : i + STEP, None] + size[None] - 2 * near, 0) if l2 else 1.0 - near
    return table


def _looked_up(table: np.ndarray) -> Score:
    flat, n = table.ravel(), len(table)
    return lambda p, at: flat[(p * n)[:, None] + at]


def _prune_rows(between: Score, ids: np.ndarray, source: np.ndarray, candidates: np.ndarray, degree: int, alpha: float, keep_all_if_small: bool = False) -> np.ndarray:
    """prune() for many sources at once: row i has the neighbours of source[i], nearest first, -1 for none.

    candidates (rows, any number): different ones in a row, -1 for none. What is left of them lies
    in one list, source by source and nearest first, and gets shorter with each neighbour taken.
    """
    out = np.full((len(source), degree), -1, np.int64)
    if not candidates.size:
        return out
    dist = between(source, np.maximum(candidates, 0))
    left = (candidates >= 0) & (candidates != source[:, None]) & np.isfinite(dist)
    if _has_keys(dist, ids):
        keys = np.where(left, _keys(dist, candidates), NO_KEY)
        keys.sort(axis=1)
        left = keys < NO_KEY
        keys = keys[left]
        c, d = _rows_of(keys), _distances_of(keys)
    else:
        dist = np.where(left, dist, np.inf)
        order = _by_distance(dist, lambda tied: ids[candidates[tied]])
        c, d = np.take_along_axis(candidates, order, axis=1), np.take_along_axis(dist, order, axis=1)
        left = np.isfinite(d)
        c, d = c[left], d[left]
    sizes = left.sum(1)
    if keep_all_if_small and (small := sizes <= degree).any():
        of_small = np.repeat(small, sizes)
        few = _padded(np.repeat(np.arange(len(source)), sizes)[of_small], c[of_small], len(source))
        out[:, : few.shape[1]] = few
        c, d, sizes = c[~of_small], d[~of_small], np.where(small, 0, sizes)
    at = np.flatnonzero(sizes)
    sizes = sizes[at]
    for slot in range(degree):
        if not len(at):
            break
        first = np.cumsum(sizes) - sizes
        p = c[first]
        out[at, slot] = p
        p, on = np.repeat(p, sizes), np.empty(len(c), bool)
        for i in range(0, len(c), PAIRS):
            own = slice(i, i + PAIRS)
            on[own] = alpha * between(p[own], c[own, None])[:, 0] > d[own]
        on[first] = False
        c, d, sizes = c[on], d[on], np.add.reduceat(on, first, dtype=np.int64)
        at, sizes = at[sizes > 0], sizes[sizes > 0]
    return out


def _prune_all(table: np.ndarray, ids: np.ndarray, source: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """_prune_rows() with all rows as candidates, by the table of all distances and sorted ids: whole lines of it while most rows are left, then what is left."""
    out, own = np.full((len(source), degree), -1, np.int64), np.arange(len(source))
    dist = table[source]
    dist[~np.isfinite(dist)] = np.inf
    dist[own, source] = np.inf
    whole = min(degree, WHOLE_SLOTS)
    for slot in range(whole):
        first = dist.argmin(1)  # of equal ones the first
        out[:, slot] = np.where(np.isfinite(dist[own, first]), first, -1)
        dist = np.where(alpha * table[first] > dist, dist, np.float32(np.inf))
        dist[own, first] = np.inf
    left = _padded(*np.nonzero(np.isfinite(dist)), len(source))
    out[:, whole:] = _prune_rows(_looked_up(table), ids, source, left, degree - whole, alpha)
    return out


def _padded(who: np.ndarray, what: np.ndarray, count: int) -> np.ndarray:
    """what by who (ascending, below count), a row for each, -1 for none."""
    sizes = np.bincount(who, minlength=count)
    out = np.full((count, int(sizes.max(initial=0))), -1, np.int64)
    out[who, np.arange(len(who)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = what
    return out


def _add_reverse(graph: Graph, between: Score, sources: np.ndarray, lists: np.ndarray, alpha: float) -> None:
    """Give each target of the new lists of sources the edge back, pruning where its slots run out."""
    at, slot = np.nonzero(lists >= 0)
    s, t = sources[at], lists[at, slot]
    missing = (graph.neighbours[t] != s[:, None]).all(1)
    s, t = s[missing], t[missing]
    order = np.lexsort((s, t))
    s, t = s[order], t[order]
    targets, who = np.unique(t, return_inverse=True)
    for i in range(0, len(targets), STEP):
        own = slice(*np.searchsorted(who, (i, i + STEP)))
        to = targets[i : i + STEP]
        both = np.concatenate([graph.neighbours[to], _padded(who[own] - i, s[own], len(to))], axis=1)
        both = np.take_along_axis(both, np.argsort(both < 0, axis=1, kind="stable"), axis=1)
        full = (both >= 0).sum(1) > graph.degree
        graph.neighbours[to] = both[:, : graph.degree]
        if full.any():
            graph.neighbours[to[full]] = _prune_rows(between, graph.ids, to[full], both[full], graph.degree, alpha)


def build_graph(ids: np.ndarray, vectors: np.ndarray, degree: int, width: int, alpha: float, seed: int, rounds: int = 2, step: int = 512, metric: Metric | str = Metric.L2, settled: bool = True) -> Graph:
    """A graph whose rows' neighbours are pruned from all rows, or, beyond TABLE_ROWS rows, from those that searches score.

    Those start from random neighbours, and every row is inserted anew in a seeded random order, rounds times:
    a step's rows (an eighth of all at most) are searched on the graph as it stood; all that a search
    scored and the row's neighbours so far are pruned to its new neighbours, which get the edge
    back. With a table of all distances no search is needed, as every row is a candidate of every other. At the end,
    rows that the medoid doesn't reach are hung on their nearest reached row, and, if settled, rows
    that a search of that width doesn't find are given an edge where it ended.
    """
    n = len(ids)
    if n <= TABLE_ROWS:
        own, table = np.arange(n), _table(vectors, metric)
        between, in_order = _looked_up(table), bool((ids[1:] > ids[:-1]).all())
        graph = Graph(ids, vectors, np.full((n, degree), -1, np.int64), medoid_of(vectors, ids))
        for i in range(0, n, step):
            rows = own[i : i + step]
            graph.neighbours[rows] = _prune_all(table, ids, rows, degree, alpha) if in_order else _prune_rows(between, ids, rows, np.broadcast_to(own, (len(rows), n)), degree, alpha)
        _add_reverse(graph, between, own, graph.neighbours.copy(), alpha)
        connect(graph, metric)
        if settled:
            settle(graph, between, width, metric)
        return graph
    between = _between(vectors, metric)
    graph = Graph(ids, vectors, random_neighbours(n, degree, seed), medoid_of(vectors, ids))
    rng = np.random.default_rng(seed)
    step = max(1, min(step, -(-n // 8), (1 << 26) // max(n, 1)))
    for _ in range(rounds):
        order = rng.permutation(n)
        for i in range(0, n, step):
            rows = order[i : i + step]
            seen = beam_search(graph, len(rows), lambda q, at, rows=rows: between(rows[q], at), width, expand=EXPAND)[2]
            have = graph.neighbours[rows]
            who, slot = np.nonzero(have >= 0)
            seen[who, have[who, slot]] = True
            lists = _prune_rows(between, ids, rows, _padded(*np.nonzero(seen), len(rows)), degree, alpha)
            graph.neighbours[rows] = lists
            _add_reverse(graph, between, rows, lists, alpha)
    connect(graph, metric)
    return graph


def settle(graph: Graph, between: Score, width: int, metric: Metric | str, times: int = 8) -> int:
    """Give each row that a search for it of that width doesn't score an edge from where the search ended; how many are left after so many times."""
    n = len(graph.ids)
    own = np.arange(n)
    scored = np.empty((n, -(-n // 8)), np.uint8)
    again = own
    for turn in range(times + 1):
        ends = {}
        for i in range(0, len(again), STEP):
            rows = again[i : i + STEP]
            beam, _, seen = beam_search(graph, len(rows), lambda q, at, rows=rows: between(rows[q], at), width, goals=rows)
            scored[rows] = np.packbits(seen, axis=1)
            for k in np.flatnonzero(~seen[np.arange(len(rows)), rows]).tolist():
                ends[int(rows[k])] = beam[k][beam[k] >= 0]
        if not ends or turn == times:
            break
        indegree = np.bincount(graph.neighbours[graph.neighbours >= 0], minlength=n)
        changed, before = set(), graph.neighbours.copy()
        for row, beam in ends.items():
            hosts = [h for h in beam.tolist() if h not in changed]
            free = [h for h in hosts[:8] if (graph.neighbours[h] < 0).any()]
            host = free[0] if free else hosts[0] if hosts else int(beam[0])
            near = graph.neighbours[host]
            slot = int(np.argmax(near < 0)) if free else int(np.argmax(indegree[near]))  # the neighbour with most other ways to it gives way
            if near[slot] >= 0:
                indegree[near[slot]] -= 1
            near[slot] = row
            indegree[row] += 1
            changed.add(host)
        connect(graph, metric)
        # only searches that scored a changed row can go another way now
        hit = np.zeros(n, bool)
        for h in np.flatnonzero((graph.neighbours != before).any(1)).tolist():
            hit |= (scored[:, h >> 3] >> (7 - (h & 7)) & 1).astype(bool)
        hit[list(ends)] = True
        again = own[hit]
    return len(ends)


def reached(graph: Graph, limit: int | None = None) -> np.ndarray:
    """Rows in breadth-first order from the medoid, up to a number."""
    seen = np.zeros(len(graph.ids), bool)
    front = np.array([graph.medoid])
    seen[front] = True
    out = [front]
    while len(front) and (limit is None or sum(map(len, out)) < limit):
        near = graph.neighbours[front]
        near = near[near >= 0]
        near = near[~seen[near]]
        _, first = np.unique(near, return_index=True)
        front = near[np.sort(first)]
        seen[front] = True
        out.append(front)
    rows = np.concatenate(out)
    return rows if limit is None else rows[:limit]


def connect(graph: Graph, metric: Metric | str) -> int:
    """Make every row reachable: one that isn't takes the last slot of its nearest reached row that loses nothing by it."""
    ok, fixed = np.zeros(len(graph.ids), bool), 0
    ok[reached(graph)] = True
    lost = np.flatnonzero(~ok)
    for row in lost[np.argsort(graph.ids[lost], kind="stable")].tolist():
        if ok[row]:
            continue
        near = np.flatnonzero(ok)
        near = near[np.lexsort((graph.ids[near], to_many(metric, graph.vectors[row][None], graph.vectors[near])[0]))]
        free = near[(graph.neighbours[near] < 0).any(1)]
        if len(free):
            host = int(free[0])
            graph.neighbours[host, int(np.argmax(graph.neighbours[host] < 0))] = row
        else:
            # no free slot anywhere reached: splice in between the nearest row and its last neighbour
            host = int(near[0])
            moved = int(graph.neighbours[host, -1])
            graph.neighbours[host, -1] = row
            slots = graph.neighbours[row]
            if moved not in slots:
                at = int(np.argmax(slots < 0)) if (slots < 0).any() else len(slots) - 1
                graph.neighbours[row, at] = moved
        fixed += 1
        front = np.array([row])  # what it reaches is reached now
        while len(front):
            ok[front] = True
            front = np.unique(graph.neighbours[front])
            front = front[front >= 0]
            front = front[~ok[front]]
    return fixed


def insert_rows(graph: Graph, ids: np.ndarray, vectors: np.ndarray, width: int, alpha: float, metric: Metric | str = Metric.L2, keep_all_if_small: bool = True) -> Graph:
    """The graph with new rows: the final beam of a search, pruned, becomes a row's neighbours, which get the edge back.

    Rows go in steps of up to an eighth of the graph, each searched on the graph as it stood. The
    first row of an empty graph becomes its medoid.
    """
    if not len(ids):
        return graph
    old = len(graph.ids)
    grown = Graph(np.concatenate([graph.ids, ids]), np.concatenate([graph.vectors, vectors]) if old else vectors, np.concatenate([graph.neighbours, np.full((len(ids), graph.degree), -1, np.int64)]), graph.medoid if old else 0)
    at, n = max(old, 1), len(grown.ids)
    between = _between(grown.vectors, metric)
    while at < n:
        rows = np.arange(at, min(n, at + max(1, min(512, at // 8, (1 << 26) // n))))
        found = beam_search(grown, len(rows), lambda q, at, rows=rows: between(rows[q], at), width)[0]
        lists = _prune_rows(between, grown.ids, rows, found, grown.degree, alpha, keep_all_if_small)
        grown.neighbours[rows] = lists
        _add_reverse(grown, between, rows, lists, alpha)
        at = int(rows[-1]) + 1
    connect(grown, metric)
    return grown
