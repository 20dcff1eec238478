"""Exact deduplication by an extendible-hash index on shared files.

A first pass hashes each normalised text and folds equal texts that one task meets soon
after each other: it compares their bytes and writes one entry with the bytes (the holder)
for them, plus a bare entry for each document. From the holders' sizes by hash prefix a
directory is doubled until no bucket is overfull; a bucket that isn't full keeps its
shorter prefix, so several directory slots share it. Buckets are dealt to owner tasks, each
a range of keys. An owner walks its keys in order, chains texts that share a key, compares
bytes along the chain, and writes the index: for each holder, which document its group
keeps and how many documents the group has. Documents then take their answer from their
holder. A text that makes up much of the corpus has one holder for each task, not one for
each copy; where a key has many holders, they are dealt to shares and folded there, as often
as needed, so that no owner reads more than FAN_IN copies of a text.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nimbusvec.llm.shared import WHITE, InPlace, bound_batches, column, drop, lean, small_table, stored

#: Most bytes of texts that a task remembers for folding.
FOLD_BYTES = 8 << 20
#: Holders of one key that an owner reads, at most, but for texts whose keys collide; more are folded in shares of a quarter as many.
FAN_IN = 64
#: Keys of so many holders up to which their numbers, of 16 bytes each, are sent to every task.
SENT_KEYS = 1 << 20
#: A bucket with more bytes of distinct texts than this is split, unless the directory would be too deep.
BUCKET_BYTES = 4 << 20
#: Bytes of texts that an owner task reads, if there are more tasks than shuffle partitions.
OWNER_BYTES = 256 << 20
#: The directory has at most 2 to this many slots, which bounds what the driver holds.
MAX_DEPTH = 20
#: Prefix bits of the first histogram.
FIRST_DEPTH = 8

_ENTRY = "doc_id long, row long, holder long, key long, sha string, points long, norm binary, n long, best_points long, best_doc long, best_row long"
_HOLDERS = "holder long, parent long, key long, norm binary, n long, best_points long, best_doc long, best_row long"
_INDEX = "holder long, keep_id long, keep_row long, group_size long"


def better(a: tuple, b: tuple) -> tuple:
    """Of two (points, doc_id, row): more code points, then the smaller doc_id (null last), then the smaller row."""
    rank = lambda x: (-x[0], x[1] is None, x[1] if x[1] is not None else 0, x[2])
    return a if rank(a) <= rank(b) else b


def _fold(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries: holders carry norm and the sums of what was folded into them; the others are bare."""
    held: OrderedDict[bytes, list] = OrderedDict()  # digest -> norm, holder, key, n, best
    size = 0
    names = [x.split()[0] for x in _ENTRY.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    schema = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in _ENTRY.split(", ")])

    def rows(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], schema.field(i).type) for i in range(len(names))], schema=schema)

    def holder(e: list) -> tuple:
        return (None, None, e[1], e[2], None, None, e[0], e[3], *e[4])

    for batch in batches:
        out, gone, gone_bytes = [], [], 0
        for doc, row, points, raw in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            norm = (raw or b"").translate(None, WHITE)
            digest = hashlib.sha256(norm).digest()
            e = held.get(digest)
            if e is not None and e[0] == norm:
                held.move_to_end(digest)
                e[3] += 1
                e[4] = better(e[4], (points, doc, row))
            else:
                if e is not None:  # equal digests of different bytes: the chain of the owner keeps them apart
                    gone.append(holder(held.pop(digest)))
                    size -= len(e[0])
                key = int.from_bytes(digest[:8], "big") >> 1
                e = held[digest] = [norm, row, key, 1, (points, doc, row)]
                size += len(norm)
                while size > FOLD_BYTES and len(held) > 1:
                    _, old = held.popitem(last=False)
                    size -= len(old[0])
                    gone.append(holder(old))
                    gone_bytes += len(old[0])
            out.append((doc, row, e[1], None, digest.hex(), points, None, None, None, None, None))
            if gone_bytes > FOLD_BYTES:
                yield rows(gone)
                gone, gone_bytes = [], 0
        if out:
            yield rows(out)
        if gone:
            yield rows(gone)
    gone, gone_bytes = [], 0
    while held:
        _, old = held.popitem(last=False)
        gone.append(holder(old))
        gone_bytes += len(old[0])
        if gone_bytes > FOLD_BYTES or len(gone) >= 4096 or not held:
            yield rows(gone)
            gone, gone_bytes = [], 0


def _merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Holders by key and share: one stays for each text of a share, with the sums; the others name it as their parent."""
    chain: list[list] = []  # norm, n, best, holder
    now = None
    out: list[tuple] = []
    fields = [x.split() for x in _HOLDERS.split(", ")]

    def made() -> pa.RecordBatch:
        b = pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.binary() if kind == "binary" else pa.int64()) for i, (_, kind) in enumerate(fields)], [name for name, _ in fields])
        out.clear()
        return b

    for batch in batches:
        for key, share, norm, holder, n, *best in zip(*(batch.column(i).to_pylist() for i in range(8)), strict=True):
            if (key, share) != now:
                out.extend((h, None, now[0], text, k, *top) for text, k, top, h in chain)
                chain.clear()
                now = (key, share)
            for link in chain:
                if link[0] == norm:
                    link[1] += n
                    link[2] = better(link[2], tuple(best))
                    out.append((holder, link[3], None, None, None, None, None, None))
                    break
            else:
                chain.append([norm, n, tuple(best), holder])
        if out:
            yield made()
    out.extend((h, None, now[0], text, k, *top) for text, k, top, h in chain)
    yield made()


def folded(holders: DataFrame, fan_in: int = FAN_IN) -> tuple[DataFrame, list[DataFrame]]:
    """holders with no key of more than fan_in of equal texts, and the tables (holder, parent) of what was folded, first round first."""
    spark, links = holders.sparkSession, []
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    while True:
        counts = holders.groupBy("key").agg(F.count("*").alias("holders"))
        hot, _ = stored(counts.where(F.col("holders") > fan_in), "hot")
        n = hot.count()
        if not n:
            return holders, links
        sent = F.broadcast(hot) if n <= SENT_KEYS else hot
        shares = F.ceil(F.col("holders") * 4 / fan_in)
        large = holders.join(sent, "key").withColumn("share", F.pmod(F.xxhash64("holder", F.lit(len(links))), shares)).repartition(parts, "key", "share").sortWithinPartitions("key", "share", "holder")
        round_, _ = stored(large.select("key", "share", "norm", "holder", "n", "best_points", "best_doc", "best_row").mapInArrow(lean(_merge), _HOLDERS), "folded")
        merged = round_.where("parent is null").drop("parent")
        links.append(round_.where("parent is not null").select("holder", "parent"))
        holders = holders.join(sent, "key", "left_anti").select(*merged.columns).unionByName(merged)
        if links[-1].isEmpty():  # texts that differ and share a key: nothing more to fold
            return holders, links


def double_directory(weights: dict[int, int], depth: int, limit: int) -> dict[tuple[int, int], int]:
    """Buckets {(local depth, prefix): bytes} of a directory grown from one bucket until none is overfull.

    weights: bytes by prefix of depth bits. A bucket of that depth is not split further.
    """
    open_, done = {(0, 0): sum(weights.values())}, {}
    for level in range(depth):
        over = {k: w for k, w in open_.items() if w > limit}
        done |= {k: w for k, w in open_.items() if w <= limit}
        if not over:
            return done
        # the directory doubles to 2 ** (level + 1) slots; only overfull buckets get two of their own
        split: dict[tuple[int, int], int] = {(level + 1, 2 * p + s): 0 for (_, p) in over for s in (0, 1)}
        for prefix, w in weights.items():
            k = (level + 1, prefix >> (depth - level - 1))
            if k in split:
                split[k] += w
        open_ = split
    return done | open_


def buckets_of(holders: DataFrame, limit: int | None = None, max_depth: int = MAX_DEPTH) -> dict[tuple[int, int], int]:
    """The buckets for all holders. The driver sees at most 2 ** max_depth sums, never a fingerprint."""
    depth = min(FIRST_DEPTH, max_depth)
    while True:
        sums = holders.groupBy(F.shiftright("key", 63 - depth).alias("p")).agg(F.sum(F.length("norm") + 64).alias("w"))
        weights = {r.p: r.w for r in sums.collect()}
        # a corpus of any size has few enough buckets for a directory of bounded depth
        most = max(BUCKET_BYTES if limit is None else limit, sum(weights.values()) >> (max_depth - 2))
        buckets = double_directory(weights, depth, most)
        if depth == max_depth or not any(d == depth and w > most for (d, _), w in buckets.items()):
            return buckets
        depth = min(max_depth, depth + 4)


def directory(spark: SparkSession, buckets: dict[tuple[int, int], int], owners: int = 1) -> tuple[DataFrame, int]:
    """The directory (slot, owner), one row for each of its 2 ** depth slots, and its depth.

    Slots of one bucket have one owner, and an owner's slots are a range of keys; the ranges are
    of about equal bytes.
    """
    depth = max(d for d, _ in buckets)
    each, before, rows = max(1, -(-sum(buckets.values()) // owners)), 0, []
    for (d, p), w in sorted(buckets.items(), key=lambda b: b[0][1] << (depth - b[0][0])):
        rows.append((p << (depth - d), 1 << (depth - d), min(owners - 1, (before + w // 2) // each)))
        before += w
    table = small_table(spark, rows, "first long, slots long, owner int")
    return table.select("owner", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("slots") - 1)).alias("slot")), depth


def _own(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by key: chain what shares a key, compare bytes, write the index entries of each key."""
    chain: list[list] = []  # norm, n, best, holders
    now = None
    out: list[tuple] = []

    def close() -> None:
        for _, n, best, holders in chain:
            out.extend((h, best[1], best[2], n) for h in holders)
        chain.clear()

    def index() -> pa.RecordBatch:
        b = pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(4)], ["holder", "keep_id", "keep_row", "group_size"])
        out.clear()
        return b

    for batch in batches:
        for key, norm, holder, n, points, doc, row in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
            if key != now:
                close()
                now = key
            for link in chain:
                if link[0] == norm:
                    link[1] += n
                    link[2] = better(link[2], (points, doc, row))
                    link[3].append(holder)
                    break
            else:
                chain.append([norm, n, (points, doc, row), [holder]])
        if len(out) >= 1 << 14:
            yield index()
    close()
    yield index()


def grouped(docs: DataFrame, doc_id: str, text: str, row: str) -> DataFrame:
    """(doc_id, row, text_sha256, keep_id, keep_row, group_size) for each row of docs; row: unique longs."""
    bound_batches(docs.sparkSession)
    raw = F.coalesce(column(text).cast("string"), F.lit(""))
    rows = docs.select(column(doc_id).cast("long").alias("doc_id"), column(row).alias("row"), F.char_length(raw).cast("long").alias("points"), raw.cast("binary").alias("raw"))
    spark = docs.sparkSession
    log, path = stored(rows.mapInArrow(lean(_fold), _ENTRY), "entries")
    holders, links = folded(log.where("norm is not null").select("holder", "key", "norm", "n", "best_points", "best_doc", "best_row"))
    buckets = buckets_of(holders.select("key", "norm"))
    owners = max(int(spark.conf.get("spark.sql.shuffle.partitions")), sum(buckets.values()) // OWNER_BYTES)
    slots, depth = directory(spark, buckets, owners)
    # at most 2 ** MAX_DEPTH rows of two numbers
    placed = holders.withColumn("slot", F.shiftright("key", 63 - depth)).join(F.broadcast(slots), "slot")
    dealt = placed.repartitionById(owners, F.col("owner")).sortWithinPartitions("key", "holder")
    index, _ = stored(dealt.select("key", "norm", "holder", "n", "best_points", "best_doc", "best_row").mapInArrow(lean(_own), _INDEX), "index")
    for link in reversed(links):  # what was folded takes the answer of what it was folded into
        index = index.unionByName(link.join(index.withColumnRenamed("holder", "parent"), "parent").select(*index.columns))
    bare, _ = stored(log.where("norm is null").select("doc_id", "row", "holder", "sha"), "bare")
    drop(spark, path)  # the texts aren't needed any more
    return bare.select("doc_id", "row", "holder", F.col("sha").alias("text_sha256")).join(index, "holder").drop("holder")


def exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if they are the same bytes once white space (U+0009 to U+000D and the
    space) is gone; a null text counts as empty. The row of the most code points stays, of
    those the smallest doc_id (null last), of repeated rows exactly one. Other columns are
    not read; an empty table gives an empty one.
    """
    keyed = docs.select(column(doc_id).alias("doc_id"), column(text).alias("text"), F.monotonically_increasing_id().alias("row"))
    out = grouped(keyed, "doc_id", "text", "row")
    return out.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256")


def drop_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs, columns unchanged, with the one row of each group of equal texts that exact_duplicates() keeps.

    Null and empty texts are one group like any other; of repeated rows one stays; texts of any
    length count whole. An empty table gives an empty one.
    """
    rows = InPlace(docs, "rows")
    return rows.kept(grouped(rows.rows, doc_id, text, rows.row).where("row = keep_row").select("row"))
