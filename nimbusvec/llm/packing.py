"""Best-fit packing of tokenised documents into sequences, by hierarchical residual packing.

Pieces are narrow rows, dealt to tasks by a hash, so that every task sees all kinds of sizes.
A task packs its pieces best-fit decreasing and emits the bins that are nearly full. Bins
with room are taken apart again, back to bins of one piece, and go up a tree as items: each
level deals those of several tasks together and packs best-fit anew. A level has as many
tasks as its items ask for. Where those would be as many as before, because few bins were
nearly full, bins as full as the mean of the others are emitted too, as often as needed; bins
all alike so end the tree, and one task emits all of its bins. So no task holds more than a
bounded number of items at once, and no bin is closed for want of space in a task. Every level
is a table of its own, and a piece is emitted in just one.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nimbusvec.llm.shared import bound_batches, column, kept, lean, stored

CAPACITY = 2048
#: The id that ends every document.
END = 0
#: A bin with at most this much room is closed at once.
SLACK = 8
#: Tasks whose items meet at a level of the tree.
FAN_IN = 8
#: Items that a task packs together, at most: many times the capacity, so that even items of one id fill bins.
TASK_ROWS = 100_000
#: Words of a generation of those whose ids a worker remembers.
WORDS = 200_000
#: Words of a batch whose ids are put together at once.
STEP = 1 << 20

# Characters of one code point each, whose lower case and normal form stay so in every version of Unicode.
_PLAIN = re.compile(r"[\t-\r\x20-\x7e¡-įı-žƀ-ǃ]*+")
# The tokenizer file's rule for cutting text, its classes of letters and numbers written out for plain lower-case
# text; every cut ends in one token that is marked as a word's end.
_LETTERS, _NUMBERS = "a-zªµºß-öø-įı-žƀ-ǃ", "0-9²³¹¼-¾"
_CUTS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^\s{_LETTERS}{_NUMBERS}]+")

# Byte-level models spell printable bytes as themselves and the others as the letters from U+0100 on, in order.
_ITSELF = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_LETTERS = np.arange(256, dtype="<u4")
_OTHERS = np.setdiff1d(np.arange(256), [32, *_ITSELF])
_BYTE_LETTERS[_OTHERS] = 256 + np.searchsorted(np.setdiff1d(np.arange(256), _ITSELF), _OTHERS)


class _Words:
    """Lower-case word without white space -> its ids as little-endian unsigned 32-bit bytes.

    Two generations: when the young one is full it becomes the old one, whose words move back
    as they are met again, so common words are never tokenised anew.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.of: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.tokenizer = Tokenizer.from_file(path)
        # the same model for text that is normal, cut and spelt in byte letters already
        with open(path) as f:
            file = json.load(f)
        file |= {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": []}
        self.model = Tokenizer.from_str(json.dumps(file))
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True

    def ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def look(self, words: list[str]) -> list[bytes]:
        """The ids of distinct words, those that are new tokenised in one call."""
        if len(self.of) > WORDS:
            self.of, self.old = {}, self.of
        of, old = self.of, self.old
        ids = list(map(of.get, words))
        unknown = [i for i, x in enumerate(ids) if x is None]
        if not unknown:
            return ids
        fresh = []
        for i in unknown:
            w = words[i]
            known = old.get(w)
            if known is None:
                fresh.append(i)
            else:
                ids[i] = of[w] = known
        joined = {i: _CUTS.findall(words[i]) for i in fresh if not words[i].isalpha()}
        cuts = {words[i] for i in fresh if i not in joined}
        for c in set().union(*joined.values()) - cuts:
            if c not in of:
                if c in old:
                    of[c] = old[c]
                else:
                    cuts.add(c)
        cuts = list(cuts)
        of.update(zip(cuts, self._tokenized(cuts), strict=True))
        for i in fresh:
            w = words[i]
            ids[i] = of[w] if i not in joined else b"".join([of[c] for c in joined[i]])
            of[w] = ids[i]
        return ids

    def _tokenized(self, cuts: list[str]) -> list[bytes]:
        spelt = _BYTE_LETTERS[np.frombuffer(" ".join(cuts).encode(), np.uint8)].tobytes().decode("utf-32-le")
        ids = np.array(self.model.encode_batch_fast([spelt], add_special_tokens=False)[0].ids, "<u4")
        stops = (4 * np.flatnonzero(self.ends[ids]) + 4).tolist()
        if len(stops) != len(cuts) or 4 * len(ids) != (stops[-1] if stops else 0):  # not cut as expected: one by one
            return [self.ids(c) for c in cuts]
        raw = ids.tobytes()
        return [raw[i:j] for i, j in zip([0, *stops], stops, strict=False)]


_words: dict[str, _Words] = kept.setdefault("packing", {})


def _known(path: str) -> _Words:
    return _words.get(path) or _words.setdefault(path, _Words(path))


def _plain(text: str) -> bool:
    """Whether the tokenizer would drop the white space of a text and take its words one by one, in lower case."""
    return "<|" not in text and _PLAIN.fullmatch(text) is not None


def token_bytes(text: str | None, path: str) -> bytes:
    """The ids of a whole text as the tokenizer file gives them, no special tokens added, four bytes each."""
    return batch_ids([text], path)[0].tobytes()


def batch_ids(texts: list[str | None], path: str) -> list[np.ndarray]:
    """The ids of whole texts as the tokenizer file gives them, no special tokens added.

    The tokenizer drops white space and lets no token span it, so texts of plain characters are
    looked up word by word, each distinct word of the texts once; any other text, or one that
    may name a special token, goes to the tokenizer as it is.
    """
    known, out = _known(path), [np.empty(0, "<u4")] * len(texts)
    plain = [i for i, t in enumerate(texts) if t and _plain(t)]
    for i in set(range(len(texts))).difference(plain):
        if texts[i]:
            out[i] = np.frombuffer(known.ids(texts[i]), "<u4")
    if not plain:
        return out
    lists = pc.ascii_split_whitespace(pa.array([texts[i].lower() for i in plain], pa.large_string()))
    ends = lists.offsets.to_numpy()
    flat = lists.flatten()
    parts, counts = [], []
    for at in range(0, len(flat), STEP):
        coded = flat.slice(at, STEP).dictionary_encode()
        words = coded.dictionary.to_pylist()
        ids = known.look(words)  # white space at either end leaves an empty word, which has no cuts
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) >> 2
        first, which = np.cumsum(sizes) - sizes, coded.indices.to_numpy()
        each = sizes[which]
        run = np.cumsum(each)
        parts.append(np.frombuffer(b"".join(ids), "<u4")[np.repeat(first[which] - run + each, each) + np.arange(run[-1])])
        counts.append(each)
    every = np.concatenate(parts) if parts else np.empty(0, "<u4")
    upto = np.concatenate([[0], np.cumsum(np.concatenate(counts))]) if counts else np.zeros(1, np.int64)
    for i, a, b in zip(plain, upto[ends[:-1]].tolist(), upto[ends[1:]].tolist(), strict=True):
        out[i] = every[a:b]
    return out


def pieces(docs: DataFrame, tokenizer: str, doc_id: str, text: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) for each piece of each row of docs; long documents are cut, others stay whole."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([END], "<u4")
        for b in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for doc, own in zip(b.column(0).to_pylist(), batch_ids(b.column(1).to_pylist(), tokenizer), strict=True):
                ids = np.concatenate([own, end])
                for k, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at : at + capacity]
                    for c, v in zip(out, (doc, k, at, len(part), zlib.crc32(part)), strict=True):
                        c.append(v)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    bound_batches(docs.sparkSession)
    return docs.select(column(doc_id).cast("long").alias("doc_id"), column(text).cast("string").alias("text")).mapInArrow(lean(run, "packing"), "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(sizes: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: for each size its bin and its place there, and the fill of each bin.

    Bins are kept by their room; a bit set of the rooms that occur finds the tightest in one step.
    """
    at, place, fill = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), []
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    have = 0
    order = np.argsort(-sizes, kind="stable")
    for i, size in zip(order.tolist(), sizes[order].tolist(), strict=True):
        fits = have >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            k = rooms[room].pop()
            if not rooms[room]:
                have ^= 1 << room
        else:
            room, k = capacity, len(fill)
            fill.append(0)
        at[i], place[i] = k, fill[k]
        fill[k] += size
        left = room - size
        if left:
            rooms[left].append(k)
            have |= 1 << left
    return at, place, np.array(fill, np.int64)


def _pack_task(capacity: int, slack: int, rows: int, level: int, last: bool):
    """Arrow function: items with their length -> the same with sequence_id, offset, their bin's fill and done, whether it is emitted."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = np.int64(TaskContext.get().partitionId() | level << 24) << np.int64(32)
        made = 0

        def pack(tables: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nonlocal made
            t = pa.Table.from_batches(tables).combine_chunks()
            at, place, fill = best_fit(t.column("length").to_numpy(), capacity)
            done = np.full(len(fill), last) | (capacity - fill <= slack)
            columns = (("sequence_id", task | (at + made)), ("offset", place), ("fill", fill[at]), ("done", done[at]))
            made += len(fill)
            for name, values in columns:
                t = t.append_column(name, pa.array(values))
            yield from t.to_batches()

        held, n = [], 0
        for b in batches:
            while b.num_rows:
                held.append(b.slice(0, rows - n))
                b, n = b.slice(rows - n), n + held[-1].num_rows
                if n == rows:
                    yield from pack(held)
                    held, n = [], 0
        if held:
            yield from pack(held)

    return run


def pack(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, fan_in: int = FAN_IN, task_rows: int = TASK_ROWS, slack: int = SLACK) -> DataFrame:
    """One row for each piece of each row of docs: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and one END. Documents of more than capacity ids are cut into pieces
    of that size, the last one shorter; no other is cut, however long its text. Pieces of a
    sequence lie one after the other from 0, without gaps, up to capacity. A null or empty text
    is one END; repeated rows are packed each on its own; other columns are not read; an empty
    table gives an empty one.
    """
    cut, _ = stored(pieces(docs, tokenizer, doc_id, text, capacity), "pieces")
    return packed(cut, capacity, fan_in, task_rows, slack)


def packed(cut: DataFrame, capacity: int = CAPACITY, fan_in: int = FAN_IN, task_rows: int = TASK_ROWS, slack: int = SLACK) -> DataFrame:
    """cut, a stored table with a column length of 1 to capacity, plus sequence_id and offset."""
    whole = cut.where(F.col("length") == capacity).withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    items = cut.where(F.col("length") < capacity).withColumn("item", F.monotonically_increasing_id())
    schema = T.StructType([*items.schema.fields, *T.StructType.fromDDL("sequence_id long, offset long, fill long, done boolean").fields])
    out, n, level = whole, items.count(), 0
    tasks = -(-n // task_rows)
    while n:
        met = (items.repartition(tasks, F.xxhash64("item", F.lit(level))) if tasks > 1 else items.repartition(1)).sortWithinPartitions("item")
        table, _ = stored(met.mapInArrow(lean(_pack_task(capacity, slack, task_rows, level, tasks == 1), "packing"), schema), f"level{level}")
        goes = ~F.col("done")
        # a further level pays if fewer tasks can hold what goes there: if they can't, bins as full as the mean stay as they are
        while True:
            n, mean = table.where(goes).agg(F.count("*"), F.avg("fill")).first()
            fewer = max(-(-tasks // fan_in), -(-n // task_rows))
            if not n or fewer < tasks:
                break
            goes = goes & (F.col("fill") < mean)
        out = out.unionByName(table.where(~goes).drop("item", "fill", "done"))
        items, tasks, level = table.where(goes).drop("sequence_id", "offset", "fill", "done"), fewer, level + 1
    return out
