import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from nimbusvec.llm import packing
from nimbusvec.llm.queries import tokenizer_path
from tests.llm.common import NASTY, docs, nasty

PATH = tokenizer_path()
TOKENIZER = Tokenizer.from_file(PATH)


def plain_ids(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids + [0]


@pytest.mark.parametrize("text", [t for _, t, _ in NASTY] + ["It's we'll 'tis ''s 're!'t", "Grüße ÀÉÎ ½ ² ª ŉ ǆ İ ß", "a\xa0b\x0bc", "x1y22,,..z", "'", "漢字 кириллица عربى"])
def test_tokens_are_the_tokenizers(text):
    assert np.frombuffer(packing.token_bytes(text, PATH), "<u4").tolist() + [0] == plain_ids(text)


def test_tokens_of_random_plain_texts(monkeypatch):
    monkeypatch.setattr(packing, "WORDS", 50)
    rng = random.Random(3)
    letters = [chr(c) for c in [*range(0x20, 0x7F), *range(0xA1, 0x180)] if chr(c) != "İ"] + ["'s", "'ll", "\n", "\t", " ", " ", " "]
    for _ in range(300):
        text = "".join(rng.choices(letters, k=rng.randint(0, 200)))
        assert np.frombuffer(packing.token_bytes(text, PATH), "<u4").tolist() + [0] == plain_ids(text), text


@pytest.mark.parametrize("capacity", [1, 7, 64, 2048])
def test_best_fit_places_everything(capacity):
    sizes = np.random.default_rng(capacity).integers(1, capacity + 1, 3000)
    at, place, fill = packing.best_fit(sizes, capacity)
    for b in range(len(fill)):
        own = np.flatnonzero(at == b)
        order = own[np.argsort(place[own])]
        assert (np.cumsum(sizes[order]) - sizes[order] == place[order]).all() and sizes[own].sum() == fill[b] <= capacity
    # best fit decreasing needs at most 11/9 of the least bins, and 4 more
    assert len(fill) <= 11 / 9 * -(-sizes.sum() // capacity) * (2 if capacity < 8 else 1.2) + 4


def checked(rows, texts, capacity):
    """Sequences, after every piece and place has been held against plain tokenising."""
    pieces = {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
    for i, t in texts.items():
        ids = plain_ids(t)
        mine = sorted(pieces.pop(i), key=lambda r: r.piece)
        assert [(r.piece, r.start) for r in mine] == [(k, k * capacity) for k in range(-(-len(ids) // capacity))]
        for r in mine:
            part = ids[r.start : r.start + capacity]
            assert r.length == len(part) and r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
    assert not pieces
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


@pytest.mark.parametrize(("parts", "fan_in"), [(1, 8), (12, 2), (30, 8)])
def test_packing_across_levels(spark, parts, fan_in):
    rng = random.Random(parts)
    texts = {i: " ".join(rng.choices(["alpha", "beta", "x", "gamma,"], k=rng.choice([0, 3, 30, 90, 300]))) for i in range(400)}
    rows = packing.pack(docs(spark, [(i, t, "s") for i, t in texts.items()]).repartition(parts), PATH, capacity=128, fan_in=fan_in, task_rows=parts * 10).collect()
    n = checked(rows, texts, 128)
    assert n <= 1.05 * -(-sum(r.length for r in rows) // 128) + 1


def test_bins_of_many_tasks_meet(spark):
    texts = {i: "x " * 30 for i in range(64)}  # 31 ids each: no task can fill a bin of 1000 alone
    rows = packing.pack(docs(spark, [(i, t, "s") for i, t in texts.items()]).repartition(32), PATH, capacity=1000, fan_in=4, task_rows=40).collect()
    assert checked(rows, texts, 1000) == 2


def test_nasty_rows(spark):
    rows = packing.pack(nasty(spark), PATH).collect()
    once = {i: t for i, t, _ in NASTY if i not in (9, None)}
    assert sum(r.doc_id == 9 for r in rows) == 2 and sum(r.doc_id is None for r in rows) == 2
    for i, t in once.items():
        assert sum(r.length for r in rows if r.doc_id == i) == len(plain_ids(t))
    assert packing.pack(docs(spark, []), PATH).collect() == []


def lengths(spark, sizes, at):
    spark.createDataFrame([(i, int(x)) for i, x in enumerate(sizes)], "k long, length long").repartition(6).write.parquet(at)
    return spark.read.parquet(at)


def sequences(rows, capacity):
    """Number of sequences, after gaps, overlaps and overfull ones have been ruled out."""
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        b.sort()
        assert [o for o, _ in b] == [sum(n for _, n in b[:k]) for k in range(len(b))] and sum(n for _, n in b) <= capacity
    return len(bins)


def test_residues_of_all_tasks_meet(spark, tmp_path):
    # large pieces come first, small ones after them, so that no stretch of the table can be packed well on its own
    sizes = [1100] * 6000 + [900] * 6000 + [2048] * 5
    rows = packing.packed(lengths(spark, sizes, str(tmp_path / "a")), task_rows=1000, fan_in=3).collect()
    assert len(rows) == len(sizes) and sequences(rows, 2048) <= 1.01 * 6005
    rng = np.random.default_rng(5)
    sizes = np.concatenate([rng.integers(1, 400, 3000), rng.integers(700, 2000, 6000)])
    rows = packing.packed(lengths(spark, sizes, str(tmp_path / "b")), task_rows=500, fan_in=4).collect()
    assert len(rows) == len(sizes) and sequences(rows, 2048) <= 1.01 * len(packing.best_fit(sizes)[2])


def test_what_nothing_fits_with_ends_the_tree(spark, tmp_path, monkeypatch):
    made = []
    real = packing.stored
    monkeypatch.setattr(packing, "stored", lambda df, label: made.append(label) or real(df, label))
    rows = packing.packed(lengths(spark, [1500] * 3000, str(tmp_path / "a")), task_rows=250).collect()
    assert sequences(rows, 2048) == len(rows) == 3000 and made == ["level0"]


def test_a_batch_of_texts_is_as_its_texts():
    texts = ["a b  a", None, "", " \n", "Über <|endoftext|> x", "x " * 70_000 + "end", "a\x1cb", "b a b"]
    got = packing.batch_ids(texts, PATH)
    assert [g.tolist() + [0] for g in got] == [plain_ids(t) for t in texts]
