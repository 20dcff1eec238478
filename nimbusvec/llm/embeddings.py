"""Embedding near-duplicates by cosine, over randomised-rotation binary codes.

One pass writes the index, a row for each vector: a strong digest, which folds equal vectors into
one node; the binary code, the signs of the unit vector after a random rotation into at least
CODE_BITS dimensions; its correction factor, the inner product of the rotated vector and its
code; the unit vector in bytes; the nearest cell of a coarse quantiser (its home) and the other
cells that a vector within the threshold of it may have as home (its visits). A pair meets in
the home of one of the two. There <code, other> / factor estimates the cosine without bias, and a
confidence bound of SIGMAS standard errors decides whether the pair stays open. Only codes,
factors and bytes are shuffled to the cells. Vectors with an open pair in a cell are then
fetched and recomputed in double precision, and only that links; each pair counts in one cell.
Cells of many rows are compared block against block. A task reports for each vector how many
links it found and one edge of a spanning forest, never the pairs.

What is approximate: two vectors at just the threshold are looked at unless both miss the
other's home, which MARGIN standard deviations of a random direction make rare, and unless
their estimate is SIGMAS standard errors too low (3 in 100,000). Tests measure recall on
planted and on clustered vectors at several numbers of cells.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nimbusvec.llm.graph import components
from nimbusvec.llm.shared import bound_batches, column, spread_join, stored
from nimbusvec.llm.simhash import forest

THRESHOLD = 0.9
#: Standard errors of the estimate that a pair must be below the threshold by, to go unrecomputed.
SIGMAS = 4.0
#: Standard deviations by which a cell must be beyond reach of a vector's partners, to go unvisited.
MARGIN = 1.25
#: Least bits of a code.
CODE_BITS = 256
#: The quantisers are fitted on about so many bytes of distinct vectors at most, those of hashes below a share, and
#: have at most so many bytes of cells, which every task gets.
SAMPLE_BYTES, CELL_BYTES = 64 << 20, 64 << 20
#: Distinct vectors for each cell, rows of the sample for each cell, and cells from which the sample's own rows serve as cells.
PER_CELL, PER_FIT, FIT_CELLS = 400, 16, 16_384
#: Vector lengths that get a quantiser, the most frequent ones; vectors of other lengths have one cell for each length.
LENGTHS = 16
#: Most rows of a block.
BLOCK = 8192
SEED = 20_240_601

_INDEX = "vec_id long, row long, digest binary, dim int, home long, visits binary, code binary, factor float, bytes binary, unit float, x binary"


#: Dimensions up to which the rotation is a dense matrix; longer vectors go through signs and Hadamard transforms.
DENSE = 2048


def width(dim: int) -> int:
    """Dimensions of a rotated vector, and bits of its code."""
    return -(-max(dim, CODE_BITS) // 8) * 8 if dim <= DENSE else 1 << (dim - 1).bit_length()


@functools.lru_cache(64)
def _matrix(dim: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((width(dim), dim)))
    return (q * np.sign(np.diag(r))).T


def rotate(unit: np.ndarray, seed: int = SEED) -> np.ndarray:
    """Unit vectors after a random linear map into width() dimensions that keeps all inner products."""
    n, dim = unit.shape
    if dim <= DENSE:
        return unit @ _matrix(dim, seed)
    wide, rng = width(dim), np.random.default_rng(seed)
    out = np.zeros((n, wide))
    out[:, :dim] = unit
    for _ in range(3):
        out = (out * rng.choice([-1.0, 1.0], wide)).reshape(n, -1)
        half = 1
        while half < wide:
            pairs = out.reshape(n, -1, 2, half)
            out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], 2).reshape(n, wide)
            half *= 2
        out = out / math.sqrt(wide)
    return out


def encode(turned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed codes of rotated unit vectors, a bit for each sign, and their correction factors."""
    return np.packbits(turned >= 0, axis=1, bitorder="little"), np.abs(turned).sum(1) / math.sqrt(turned.shape[1])


def signs(code: np.ndarray, wide: int) -> np.ndarray:
    """The codes as vectors of length 1."""
    return (np.unpackbits(code, axis=1, count=wide, bitorder="little").astype(np.float32) * 2 - 1) / np.float32(math.sqrt(wide))


def estimate(code: np.ndarray, factor: np.ndarray, turned: np.ndarray) -> np.ndarray:
    """Unbiased estimates of the cosines of coded vectors (rows) and rotated ones (columns)."""
    return (signs(code, turned.shape[1]) @ turned.astype(np.float32).T) / factor[:, None].astype(np.float32)


def error(factor: np.ndarray, wide: int) -> np.ndarray:
    """The standard error of the estimates of each coded vector, for a unit vector on the other side."""
    return np.sqrt(np.maximum(1 - factor**2, 0)) / factor / math.sqrt(max(wide - 1, 1))


def to_bytes(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors as signed bytes, and what a byte's step is worth."""
    step = np.abs(unit).max(1) / 127
    return np.rint(unit / step[:, None]).astype(np.int8), step


def unit_rows(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


# ---- cells ----


def fit_cells(sample: np.ndarray, k: int, seed: int = SEED, rounds: int = 8) -> np.ndarray:
    """k unit centroids by spherical k-means; from FIT_CELLS on, rows of the sample as they are."""
    rng = np.random.default_rng(seed)
    k = max(1, min(k, len(sample)))
    cells = sample[rng.choice(len(sample), k, replace=False)].copy()
    for _ in range(rounds if 1 < k <= FIT_CELLS else 0):
        near = np.concatenate([(sample[i : i + 4096] @ cells.T).argmax(1) for i in range(0, len(sample), 4096)])
        sums = np.zeros_like(cells)
        np.add.at(sums, near, sample)
        norms = np.linalg.norm(sums, axis=1)
        fed = norms > 0
        cells[fed] = sums[fed] / norms[fed, None]
    return cells


def freedom(sample: np.ndarray, cells: np.ndarray) -> float:
    """In how many directions vectors of a cell differ: the participation ratio of what is left of them without their cell."""
    rest = sample[:: max(1, len(sample) // 2048)]
    rest = rest - cells[(rest @ cells.T).argmax(1)]
    inner = rest @ rest.T
    total, squares = np.trace(inner), (inner * inner).sum()
    return float(max(1.0, total * total / squares)) if squares > 0 else 1.0


def reach(threshold: float, free: float, margin: float = MARGIN) -> float:
    """How far a partner at the threshold leans from one cell to another one, as a share of the distance between the two cells.

    y = cos x + sin e with e at a right angle to x: <y, a - b> gains at most sin |a - b|, and a random
    direction e gives it a standard deviation of sin |a - b| / sqrt(free).
    """
    if threshold <= 0:
        return math.inf
    return math.sqrt(max(0.0, 1 - threshold * threshold)) / threshold * min(1.0, margin / math.sqrt(free))


def homes(unit: np.ndarray, cells: np.ndarray, lean: float) -> tuple[np.ndarray, list[np.ndarray]]:
    """The nearest cell of each row, and the other cells that it visits, in order."""
    home, visits = np.empty(len(unit), np.int64), []
    step = max(1, (1 << 23) // len(cells))
    for i in range(0, len(unit), step):
        near = unit[i : i + step].astype(np.float32) @ cells.T
        own = near.argmax(1)
        home[i : i + step] = own
        margin = near[np.arange(len(near)), own][:, None] - near
        row, cell = np.nonzero(margin <= 2 * lean)  # no two cells are further than 2 apart
        apart = np.linalg.norm(cells[own[row]] - cells[cell], axis=1)
        fits = (margin[row, cell] <= lean * apart) & (cell != own[row])
        row, cell = row[fits], cell[fits]
        visits += np.split(cell.astype(np.int32), np.searchsorted(row, np.arange(1, len(near))))
    return home, visits


# ---- the index ----


def _number(kind: T.DataType) -> np.dtype:
    """What a stored component takes: single precision only for what came as such."""
    return np.dtype("<f4") if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType) else np.dtype("<f8")


def _gathered(rows: DataFrame, dim: int) -> np.ndarray:
    return rows.toArrow().column(0).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _fitted(spark: SparkSession, fine: DataFrame, threshold: float, per_cell: int, margin: float):
    """(first cell, cells, lean) of the most frequent lengths, for all tasks. Cells are numbered on; below 0 are those of other lengths."""
    sizes = {r.dim: r.n for r in fine.groupBy(F.size("x").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").limit(LENGTHS).collect()}
    quantisers, first = {}, 0
    for dim, n in sizes.items():
        most = max(PER_FIT, SAMPLE_BYTES // (8 * dim * len(sizes)))
        k = max(1, min(math.ceil(n / per_cell), CELL_BYTES // (4 * dim * len(sizes)), most // 4))
        # rows whose hash falls below a share chosen for about so many; equal vectors fall together and count once
        share = math.ceil(min(1.0, min(most, PER_FIT * k) / n) * (1 << 30))
        rows = fine.where((F.size("x") == dim) & (F.pmod(F.xxhash64("x", F.lit(SEED)), F.lit(1 << 30)) < share)).groupBy(F.xxhash64("x").alias("h")).agg(F.first("x").alias("x"))
        sample = _gathered(rows.orderBy("h").limit(2 * most).select("x"), dim)
        if not len(sample):  # few rows, and none of them fell below
            sample = _gathered(fine.where(F.size("x") == dim).select("x").limit(k), dim)
        sample = unit_rows(sample)
        cells = fit_cells(sample, k)
        quantisers[dim] = (first, cells.astype(np.float32), reach(threshold, freedom(sample, cells), margin))
        first += len(cells)
    return spark.sparkContext.broadcast(quantisers)


def _indexer(sent, number: np.dtype):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quantisers = sent.value
        names = [c.split()[0] for c in _INDEX.split(", ")]
        for b in batches:
            lists = b.column(2)
            lengths = np.asarray(lists.value_lengths().fill_null(0)) if len(lists) else np.empty(0, int)
            for dim in np.unique(lengths[lengths > 0]).tolist() if len(lengths) else []:
                at = np.flatnonzero(lengths == dim)
                x = np.asarray(lists.take(pa.array(at)).flatten()).reshape(-1, dim).astype(float)
                unit = unit_rows(x)
                code, factor = encode(rotate(unit))
                small, step = to_bytes(unit)
                if dim in quantisers:
                    first, cells, lean = quantisers[dim]
                    home, visits = homes(unit, cells, lean)
                    home, visits = home + first, [(v.astype("<i8") + first).tobytes() for v in visits]
                else:
                    home, visits = np.full(len(at), -dim, np.int64), [b""] * len(at)
                raw = [r.tobytes() for r in x.astype(number)]
                digests = [hashlib.blake2b(r, digest_size=16).digest() for r in raw]
                parts = [
                    b.column(0).take(pa.array(at)), b.column(1).take(pa.array(at)), pa.array(digests, pa.binary()), pa.array(np.full(len(at), dim, np.int32)), pa.array(home), pa.array(visits, pa.binary()),
                    pa.array([c.tobytes() for c in code], pa.binary()), pa.array(factor.astype(np.float32)), pa.array([s.tobytes() for s in small], pa.binary()), pa.array(step.astype(np.float32)), pa.array(raw, pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(parts, names)

    return run


# ---- comparing ----


def _open_pairs(code: np.ndarray, factor: np.ndarray, small: np.ndarray, step: np.ndarray, rows: np.ndarray, others: np.ndarray, threshold: float, sigmas: float) -> tuple[np.ndarray, np.ndarray]:
    """Which of rows (known in bytes) and which of others (by their codes) have a pair that the bound leaves open; a row is no pair with itself."""
    turned = rotate(small[rows].astype(np.float64) * step[rows, None])
    wide = turned.shape[1]
    # rounding to bytes moves a vector by half a step a component at most
    blur = step[rows] * math.sqrt(small.shape[1]) / 2
    plus, open_rows, open_others = signs(code[others], wide), np.zeros(len(rows), bool), np.zeros(len(others), bool)
    f = factor[others].astype(np.float64)
    least = ((threshold - 1e-4 - sigmas * error(f, wide)) * f).astype(np.float32)
    for i in range(0, len(rows), 512):
        near = turned[i : i + 512].astype(np.float32) @ plus.T
        may = near + blur[i : i + 512, None].astype(np.float32) >= least[None]
        may &= rows[i : i + 512, None] != others[None]
        open_rows[i : i + 512] = may.any(1)
        open_others |= may.any(0)
    return open_rows, open_others


def _look(threshold: float, sigmas: float):
    """Which vectors of a block have open pairs."""

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        cell, lo, hi = key
        dim = int(g.dim.iloc[0])
        code = np.frombuffer(b"".join(g.code), np.uint8).reshape(len(g), -1)
        at_home = (g.home == cell).to_numpy()
        small, step = np.zeros((len(g), dim), np.int8), np.zeros(len(g))
        small[at_home] = np.frombuffer(b"".join(g.bytes[at_home]), np.int8).reshape(-1, dim)
        step[at_home] = g.unit[at_home]
        side, factor, found = (g.own == hi).to_numpy(), g.factor.to_numpy(), np.zeros(len(g), bool)
        rows, others = np.flatnonzero(at_home), np.arange(len(g))
        # a block meets itself, or two blocks each other: home rows of either side against all of the other side
        for a, b in [(rows, others)] if lo == hi else [(rows[~side[rows]], others[side]), (rows[side[rows]], others[~side])]:
            if len(a) and len(b):
                p, q = _open_pairs(code, factor, small, step, a, b, threshold, sigmas)
                found[a[p]] = True
                found[b[q]] = True
        return g.loc[found, ["cell", "lo", "hi", "own", "node", "weight", "home", "visits"]]

    return run


def _recompute(number: np.dtype, threshold: float):
    """Links of a block's vectors, in double precision."""

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        cell, lo, hi = key
        x = unit_rows(np.frombuffer(b"".join(g.x), number).reshape(len(g), -1).astype(float))
        node, weight, home, side = g.node.to_numpy(), g.weight.to_numpy(), g.home.to_numpy(), (g.own == hi).to_numpy()
        count, label = np.zeros(len(g), np.int64), np.arange(len(g))
        rows = np.flatnonzero(home == cell)
        visits = [frozenset(np.frombuffer(v, "<i8").tolist()) for v in g.visits]

        @functools.cache
        def visiting(other: int) -> np.ndarray:
            return np.fromiter((other in v for v in visits), bool, len(g))

        def linked(a: np.ndarray, b: np.ndarray) -> None:
            """Pairs of home rows a and of rows b, each once."""
            nonlocal label
            for i in range(0, len(a), 512):
                p, q = np.nonzero(x[a[i : i + 512]] @ x[b].T >= threshold - 1e-9)
                p, q = a[p + i], b[q]
                once = np.where(home[q] == cell, p < q if lo == hi else side[p] < side[q], p != q)
                # where each is in the other's home, the smaller cell counts the pair
                for h in np.unique(home[q]).tolist():
                    if h < cell:
                        once &= (home[q] != h) | ~visiting(h)[p]
                p, q = p[once], q[once]
                for t in range(0, len(p), 1 << 16):
                    r, s = p[t : t + (1 << 16)], q[t : t + (1 << 16)]
                    exact = np.einsum("ij,ij->i", x[r], x[s]) >= threshold
                    r, s = r[exact], s[exact]
                    count[:] += np.bincount(r, weight[s], len(g)).astype(np.int64) + np.bincount(s, weight[r], len(g)).astype(np.int64)
                    label = forest(len(g), np.concatenate([np.arange(len(g)), r]), np.concatenate([label, s]))

        everyone = np.arange(len(g))
        if lo == hi:
            linked(rows, everyone)
        else:
            linked(rows[~side[rows]], everyone[side])
            linked(rows[side[rows]], everyone[~side])
        got = np.flatnonzero(count)
        return pd.DataFrame({"node": node[got], "links": count[got], "parent": node[label[got]]})

    return run


def links(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", threshold: float = THRESHOLD, sigmas: float = SIGMAS, margin: float = MARGIN, per_cell: int = PER_CELL, block: int = BLOCK) -> DataFrame:
    """One row for each row of vectors: vec_id, n_links, component_id, kept.

    Two vectors are linked if their cosine, in double precision, is at least the threshold.
    n_links counts the other rows linked to a row; component_id is the smallest vec_id that
    links reach, its own included; kept says whether that is its own. A vector that is null,
    empty or zero, or holds a null or non-finite component, links with nothing. Vectors of
    different lengths are never linked; long ones only cost their bytes. Rows that repeat a
    vector link with one another; null vec_ids give their id to no component that has another.
    Other columns are not read. An empty table gives an empty one.
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    number = _number(vectors.select(column(embedding)).schema[0].dataType)
    x = F.transform(column(embedding), lambda v: v.cast("double") + F.lit(0.0))  # -0.0 is 0.0
    fine = F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0), F.lit(False))
    rows = vectors.select(column(vec_id).cast("long").alias("vec_id"), F.when(fine, x).alias("x"))
    good, bad = rows.where("x is not null"), rows.where("x is null")
    sent = _fitted(spark, good, threshold, per_cell, margin)
    index, _ = stored(good.select("vec_id", F.monotonically_increasing_id().alias("row"), "x").mapInArrow(_indexer(sent, number), _INDEX), "index")

    # equal vectors are one node, named by their smallest row; its weight is how many they are
    first = F.min(F.struct("row", "dim", "home", "visits", "code", "factor", "bytes", "unit")).alias("f")
    nodes, _ = stored(index.groupBy("digest").agg(first, F.count("*").alias("weight"), F.min("vec_id").alias("least")).select("digest", "weight", "least", F.col("f.row").alias("node"), "f.dim", "f.home", "f.visits", "f.code", "f.factor", "f.bytes", "f.unit"), "nodes")
    look = ["cell", "node", "weight", "dim", "home", "visits", "code", "factor", "bytes", "unit"]
    filed, _ = stored(nodes.mapInArrow(_file, "cell long, node long, weight long, dim int, home long, visits binary, code binary, factor float, bytes binary, unit float"), "filed")
    sizes, _ = stored(filed.groupBy("cell").agg(F.count("*").alias("n")), "sizes")
    blocks = sizes.select("cell", "n", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    dealt = spread_join(filed, blocks, ["cell"], "n").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # a row of block i meets every block: in group (min, max)
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other"))
    open_, _ = stored(dealt.select("lo", "hi", "own", *look).groupBy("cell", "lo", "hi").applyInPandas(_look(threshold, sigmas), "cell long, lo int, hi int, own int, node long, weight long, home long, visits binary"), "open")
    fetched = open_.join(index.select(F.col("row").alias("node"), "x"), "node")
    found, _ = stored(fetched.groupBy("cell", "lo", "hi").applyInPandas(_recompute(number, threshold), "node long, links long, parent long"), "found")

    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("node").alias("u"), F.col("parent").alias("v")))
    named = nodes.select("node", "digest", "weight", "least").join(counts, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named, _ = stored(named, "named")
    least, _ = stored(named.groupBy("root").agg(F.min("least").alias("component"), F.count("*").alias("members")), "least")
    facts = spread_join(named, least, ["root"], "members").select("digest", "weight", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component")
    facts, _ = stored(facts, "facts")
    out = spread_join(index.select("vec_id", "digest"), facts, ["digest"], "weight").select("vec_id", "n_links", "component")
    out = out.unionByName(bad.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component")))
    return out.select("vec_id", "n_links", F.col("component").alias("component_id"), F.coalesce(F.col("vec_id") == F.col("component"), F.lit(False)).alias("kept"))


def _file(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each node at its home, with its bytes and visits, and under each cell that it visits, with its code alone."""
    for b in batches:
        t = {n: b.column(n) for n in ("node", "weight", "dim", "home", "visits", "code", "factor", "bytes", "unit")}
        if not b.num_rows:
            continue
        lists = [np.frombuffer(v, "<i8") for v in t["visits"].to_pylist()]
        at = np.repeat(np.arange(len(lists)), [len(v) for v in lists])
        away, none = pa.array(at), pa.array([b""] * len(at), pa.binary())
        cells = pa.array(np.concatenate([np.empty(0, np.int64), *lists]))
        guests = [cells, *(t[n].take(away) for n in ("node", "weight", "dim", "home")), none, t["code"].take(away), t["factor"].take(away), none, pa.array(np.zeros(len(at), np.float32))]
        names = ["cell", *t]
        yield pa.RecordBatch.from_arrays([t["home"], *t.values()], names)
        if len(at):
            yield pa.RecordBatch.from_arrays(guests, names)
