"""SimHash near-duplicates: 64-bit fingerprints, linked at a small Hamming distance.

Candidates come from a generalised pigeonhole. The 64 bits are dealt to parts so that
correlated bits share one; part i gets u_i units, the units summing to distance + 1. Two
fingerprints within the distance must then differ in fewer than u_i bits in at least one
part i, so probing every part for that many differences loses no pair. Which part gets how
many units (0 skips a part, 1 asks for equality, 2 allows one difference) is chosen by
dynamic programming on the candidate counts that each choice would make, estimated by
second-moment sketches of all fingerprints. A probe is an equal-key group: the part's bits,
with one of them masked for two units. Groups too large for one task are dealt out anew by
a second pigeonhole over their remaining bits, and those still too large are cut into blocks
that meet pair by pair. Every candidate is verified by its distance.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nimbusvec.llm.graph import components
from nimbusvec.llm.shared import InPlace, bound_batches, column, lean, own_name, spread_join, stored

SEED = 42
SHINGLE = 3
BITS = 64
DISTANCE = 3
PARTS = 4
#: Fingerprints of a group that one task compares at once. Larger groups are split by further bits, so many times
#: over; those that stay large are compared block against block.
GROUP = 8192
SPLITS = 2
#: Distances that cost as much as one key row that is made, shuffled and sorted.
PAIRS_PER_ROW = 400
SKETCH = 1024
#: A text is cut into words in steps of about so many bytes.
STEP = 1 << 20

# A-Z to a-z, white space to space
_FOLD = bytes.maketrans(bytes(range(65, 91)) + b"\t\n\x0b\x0c\r", bytes(range(97, 123)) + b"     ")


def _word_steps(raw: bytes) -> Iterator[list[bytes]]:
    """The folded words of a text, a bounded number at a time."""
    at, end = 0, len(raw)
    while at < end:
        cut = end if end - at <= STEP else raw.find(b" ", at + STEP)
        cut = end if cut < 0 else cut
        yield raw[at:cut].split()
        at = cut


def fingerprint(raw: bytes | None, shingle: int = SHINGLE) -> int:
    """The unsigned fingerprint of a text in UTF-8; 0 for no text and for no word."""
    ones, total, kept = np.zeros(BITS, np.int64), 0, []
    for words in _word_steps((raw or b"").translate(_FOLD)):
        kept = [*kept, *words]
        if len(kept) < shingle:
            continue
        grams = map(b" ".join, zip(*(kept[i:] for i in range(shingle)), strict=False))
        h = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64, len(kept) - shingle + 1)
        ones += np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, BITS).sum(0, dtype=np.int64)
        total += len(h)
        kept = kept[len(kept) - shingle + 1 :]
    if not total:
        if not kept:
            return 0
        return xxhash.xxh64_intdigest(b" ".join(kept), SEED)
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.uint64)[0])


@F.pandas_udf(T.LongType())
def _fingerprints(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    return lean(lambda each: (pd.Series(np.array([fingerprint(x) for x in raw], np.uint64).view(np.int64)) for raw in each))(parts)


def fingerprints(df: DataFrame, text: str = "text", to: str = "fp") -> DataFrame:
    """df with the fingerprint of its text as a signed long; a null text counts as one without words."""
    bound_batches(df.sparkSession)
    return df.withColumn(to, _fingerprints(column(text).cast("binary")))


# ---- which bits go together, and what each choice would cost ----


def _tree_sum(rows: DataFrame, width: int, kind: str) -> np.ndarray:
    """The sum of one vector for each task; the driver gets at most 16 of them."""

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, kind)
        for b in batches:
            for x in b.column(0).to_pylist():
                total += np.frombuffer(x, kind)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["s"])

    parts = rows.repartition(16).mapInArrow(add, "s binary").collect()
    return sum((np.frombuffer(r.s, kind) for r in parts), np.zeros(width, kind))


def _per_task(fps: DataFrame, width: int, kind: str, of) -> np.ndarray:
    """The sum over all fingerprints of of(array of them), a vector."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, kind)
        for b in batches:
            if b.num_rows:
                total += of(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["s"])

    return _tree_sum(fps.select("fp").mapInArrow(run, "s binary"), width, kind)


def bit_counts(fps: DataFrame) -> np.ndarray:
    """How often each pair of bits is set together, 64 x 64."""

    def of(x: np.ndarray) -> np.ndarray:
        bits = np.unpackbits(np.ascontiguousarray(x).view(np.uint8), bitorder="little").reshape(-1, BITS).astype(np.float32)
        return (bits.T @ bits).astype(np.float64).ravel()

    return _per_task(fps, BITS * BITS, "f8", of).reshape(BITS, BITS)


def group_bits(together: np.ndarray, n: int, parts: int = PARTS) -> list[list[int]]:
    """Deal the bits to parts of equal width, correlated ones to the same part, greedily."""
    p = np.diag(together) / max(n, 1)
    cov = together / max(n, 1) - np.outer(p, p)
    sd = np.sqrt(np.maximum(np.diag(cov), 0))
    # a bit that never changes says nothing: it counts as wholly correlated with its like
    corr = np.where(np.outer(sd, sd) > 0, np.abs(cov) / np.maximum(np.outer(sd, sd), 1e-12), (sd[:, None] == 0) & (sd[None] == 0))
    np.fill_diagonal(corr, 0)
    left, out = list(range(BITS)), []
    for k in range(parts):
        width = (BITS - sum(map(len, out))) // (parts - k)
        seed = max(left, key=lambda i: (corr[i, left].max(), -i))
        part = [seed]
        left.remove(seed)
        while len(part) < width:
            best = max(left, key=lambda i: (corr[i, part].sum(), -i))
            part.append(best)
            left.remove(best)
        out.append(sorted(part))
    return out


def _mask(bits: Iterable[int]) -> int:
    return sum(1 << b for b in bits)


def part_masks(bits: list[int], units: int) -> list[int]:
    """Masks of which two values within units - 1 differences share at least one."""
    return [_mask(set(bits) - set(gone)) for gone in combinations(bits, units - 1)] if 0 < units <= len(bits) else []


def pair_estimates(fps: DataFrame, masks: list[int]) -> list[float]:
    """About how many pairs of all fingerprints agree under each mask: second moments by signed count sketches."""
    shift = np.uint64(BITS - SKETCH.bit_length() + 1)

    def of(x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(masks), SKETCH))
        for k, m in enumerate(masks):
            z = (x & np.uint64(m)) * np.uint64(0x9E3779B97F4A7C15)
            z = (z ^ (z >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            z ^= z >> np.uint64(32)
            z *= np.uint64(0x94D049BB133111EB)
            out[k] = np.bincount((z >> shift).astype(np.int64), weights=((z >> np.uint64(20)) & np.uint64(1)).astype(np.float64) * 2 - 1, minlength=SKETCH)
        return out.ravel()

    s = _per_task(fps, len(masks) * SKETCH, "f8", of).reshape(len(masks), SKETCH)
    return [float(x) for x in (s * s).sum(1)]


def allot(costs: list[list[float]], units: int) -> list[int]:
    """Units for each part, summing to units, at the least total cost; costs[i][u] is part i's with u units."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for part in costs:
        then: dict[int, tuple[float, list[int]]] = {}
        for had, (cost, chosen) in best.items():
            for u, more in enumerate(part):
                if had + u <= units and (had + u not in then or cost + more < then[had + u][0]):
                    then[had + u] = (cost + more, [*chosen, u])
        best = then
    if units not in best:
        raise ValueError("too few parts for that distance")
    return best[units][1]


def probe_masks(fps: DataFrame, n: int, distance: int = DISTANCE, parts: int = PARTS) -> list[int]:
    """The masks whose equal-key groups hold every pair within the distance."""
    groups = group_bits(bit_counts(fps), n, parts)
    most = max(2, -(-(distance + 1) // parts))
    masks = [[part_masks(g, u) for u in range(most + 1)] for g in groups]
    flat = sorted({m for part in masks for choice in part for m in choice})
    pairs = dict(zip(flat, pair_estimates(fps, flat), strict=True))
    costs = [[len(choice) * n + sum(max(0.0, pairs[m] - n) for m in choice) / 2 / PAIRS_PER_ROW for choice in part] for part in masks]
    chosen = allot(costs, distance + 1)
    return [m for part, u in zip(masks, chosen, strict=True) for m in part[u]]


def split_mask(mask: int, distance: int = DISTANCE) -> list[int]:
    """Longer masks: the bits outside mask in distance + 1 blocks, each added to it in turn."""
    rest = [b for b in range(BITS) if not mask >> b & 1]
    k = min(distance + 1, len(rest))
    return [mask | _mask(rest[i::k]) for i in range(k)]


# ---- probe and verify ----


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _keyed(fps: DataFrame, masks: list[int]) -> DataFrame:
    pairs = F.array(*(F.struct(F.lit(_signed(m)).alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for m in masks))
    return fps.select("fp", F.explode(pairs).alias("p")).select("p.mask", "p.key", "fp")


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least index of each index's component, for pairs (a, b) of indexes below n."""
    label = np.arange(n)
    while len(a):
        la, lb = label[a], label[b]
        if (differ := la != lb).any():
            a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
            np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
            while (label != label[label]).any():
                label = label[label]
        else:
            break
    return label


def close_pairs(x: np.ndarray, starts: np.ndarray, ends: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, as index pairs, of what lies within the distance inside each run of x; pairs are never listed."""
    n = len(x)
    label = np.arange(n)
    sizes = ends - starts
    large = sizes > 64
    ids = np.repeat(np.arange(len(sizes)), sizes)
    small = ~np.repeat(large, sizes)
    lag = 1
    most = int(sizes[~large].max(initial=0))
    found_a, found_b = [], []
    at = np.flatnonzero(small)
    while lag < most:
        at = at[at + lag < n]
        at = at[ids[at] == ids[at + lag]]
        hit = at[np.bitwise_count(x[at] ^ x[at + lag]) <= distance]
        found_a.append(hit)
        found_b.append(hit + lag)
        lag += 1
    if found_a:
        label = forest(n, np.concatenate(found_a), np.concatenate(found_b))
    for s, e in zip(starts[large], ends[large], strict=True):
        own = np.arange(e - s)
        for i in range(0, e - s, 256):
            near = np.bitwise_count(x[s + i : min(s + i + 256, e), None] ^ x[None, s:e]) <= distance
            a, b = np.nonzero(near)
            own = forest(e - s, np.concatenate([np.arange(e - s), a + i]), np.concatenate([own, b]))
        label[s:e] = own + s
    move = np.flatnonzero(label != np.arange(n))
    return move, label[move]


def _verifier(distance: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        rows = 0

        def done(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, rows
            mask, key, block, fp = (np.concatenate(c) for c in zip(*held, strict=True))
            new = np.flatnonzero((mask[1:] != mask[:-1]) | (key[1:] != key[:-1]) | (block[1:] != block[:-1])) + 1
            starts = np.concatenate([[0], new])
            ends = np.concatenate([new, [len(fp)]])
            if not last:  # the last group may go on
                cut = starts[-1]
                held, rows = [(mask[cut:], key[cut:], block[cut:], fp[cut:])], len(fp) - cut
                starts, ends, fp = starts[:-1], ends[:-1], fp[:cut]
            if len(fp):
                a, b = close_pairs(fp.view(np.uint64), starts, ends, distance)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(fp[a]), pa.array(fp[b])], ["u", "v"])

        for batch in batches:
            if batch.num_rows:
                held.append(tuple(batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)))
                rows += batch.num_rows
                if rows >= 1 << 16:
                    yield from done(False)
        if held:
            yield from done(True)

    return run


def near_edges(fps: DataFrame, distance: int = DISTANCE, parts: int = PARTS, group: int = GROUP, splits: int = SPLITS) -> DataFrame:
    """Edges (u, v) between distinct fingerprints, a spanning forest of each probed group.

    fps: distinct fingerprints, column fp, in a stored table. Every pair within the distance
    is joined by a path of such edges.
    """
    masks = probe_masks(fps, fps.count(), distance, parts)
    keys, ready = _keyed(fps, masks), []
    for depth in range(splits + 1):
        counts = keys.groupBy("mask", "key").agg(F.count("*").alias("n"))
        hot, _ = stored(counts.where(F.col("n") > group), "hot")
        whole = F.lit(0).cast("long").alias("block")
        if hot.isEmpty():
            ready.append(keys.select("mask", "key", whole, "fp"))
            break
        ready.append(keys.join(hot, ["mask", "key"], "left_anti").select("mask", "key", whole, "fp"))
        large = keys.join(hot, ["mask", "key"])
        if depth == splits:  # alike in too many bits to be split by them: block against block
            blocks = F.ceil(F.col("n") / group).cast("long")
            large = large.withColumn("own", F.pmod(F.xxhash64("fp"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
            ready.append(large.select("mask", "key", (F.shiftleft(F.least("own", "other"), 31) + F.greatest("own", "other") + 1).alias("block"), "fp"))
            break
        to = {m: split_mask(m, distance) for m in masks}
        longer = F.create_map(*(x for m, ms in to.items() for x in (F.lit(_signed(m)), F.array(*(F.lit(_signed(t)) for t in ms)))))
        wide = large.select("fp", F.explode(longer[F.col("mask")]).alias("mask"))
        keys, _ = stored(wide.select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp"), "split")
        masks = sorted({t for ms in to.values() for t in ms})
    every = ready[0]
    for r in ready[1:]:
        every = every.unionByName(r)
    dealt = every.repartition("mask", "key", "block").sortWithinPartitions("mask", "key", "block", "fp")
    return dealt.mapInArrow(lean(_verifier(distance)), "u long, v long")


def classes(prints: DataFrame, key: str, distance: int = DISTANCE, parts: int = PARTS, group: int = GROUP) -> DataFrame:
    """(fp, least, n): for each fingerprint, the smallest key of all rows linked to it, directly or not, and how many rows have it.

    prints: columns fp and key. Null keys count only where a class has no other.
    """
    distinct, _ = stored(prints.groupBy("fp").agg(F.min(column(key)).alias("least"), F.count("*").alias("n")), "distinct")
    roots = components(near_edges(distinct.select("fp"), distance, parts, group)).withColumnRenamed("node", "fp")
    # only fingerprints that have a link: each of the others is a class of its own
    linked, _ = stored(roots.join(distinct.select("fp", "least"), "fp"), "linked")
    least, _ = stored(linked.groupBy("root").agg(F.min("least").alias("least"), F.count("*").alias("members")), "least")
    moved = spread_join(linked.drop("least"), least, ["root"], "members").select("fp", F.col("least").alias("moved"))
    return distinct.join(moved, "fp", "left").select("fp", F.coalesce("moved", "least").alias("least"), "n")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", distance: int = DISTANCE) -> DataFrame:
    """One row for each row of docs: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id that links reach, the row's own included. Texts that
    are null, empty or without words have fingerprint zero and link like any other; repeated
    rows each get their row; a row of null doc_id takes part, and gives its id to no class that
    has another. Other columns are not read. An empty table gives an empty one.
    """
    prints, _ = stored(fingerprints(docs.select(column(doc_id).alias("doc_id"), column(text).alias("text"))).select("doc_id", "fp"), "prints")
    found, _ = stored(classes(prints, "doc_id", distance), "classes")
    return spread_join(prints, found, ["fp"], "n").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("least").alias("component_id"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", distance: int = DISTANCE) -> DataFrame:
    """docs, columns unchanged, with one row of each class: that of the smallest doc_id (null last; of equal ones, any one).

    Rows without words are one class, or part of one, like any other; texts of any length count
    whole. An empty table gives an empty one.
    """
    fp = own_name(docs, "_fp")
    rows = InPlace(fingerprints(docs, text, fp), "rows")
    prints = rows.rows.select(column(doc_id).alias("doc_id"), F.col(fp).alias("fp"), F.col(rows.row).alias("row"))
    # the smallest (doc_id, row) of a class stays: nulls last
    first = prints.select("fp", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row").alias("key"))
    return rows.kept(classes(first, "key", distance).select(F.col("least.row").alias("row")).distinct()).select(*(column(c) for c in docs.columns))
