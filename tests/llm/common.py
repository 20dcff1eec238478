"""Tables that hold what operators must not stumble over, and small brute-force helpers."""

import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile("[^\x20\x09-\x0d]+")


def docs(spark, texts, first=0, source="s"):
    """Documents of texts; an entry may be a text or (doc_id, text, source)."""
    rows = [t if isinstance(t, tuple) else (first + i, t, source) for i, t in enumerate(texts)]
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS)


#: Nulls in every column, empty and blank texts, a very long one, ties, repeated rows.
NASTY = [
    (1, None, "a"), (2, "", "a"), (3, " \t\n\x0b\x0c\r ", None), (None, "a text without an id", "b"), (5, "word", "b"), (6, "two words", "b"),
    (7, "The same text, twice over and over.", "a"), (8, "The same text, twice over and over.", "a"), (9, "The  same text,\ntwice over and over. ", "c"), (9, "The  same text,\ntwice over and over. ", "c"),
    (10, "long " * 60_000 + "end", "a"), (11, "Ünïcödé — «ŧext» with İ, ς, 　 and \U0001f600 signs", None), (12, "THE SAME TEXT, TWICE OVER AND OVER.", "c"), (None, None, None), (13, "<|endoftext|> is a name", "a"), (14, "\x00\x1c\x85\xa0 odd", "a"),
]


def nasty(spark):
    """NASTY as documents, with columns more whose names operators might use themselves."""
    df = docs(spark, NASTY)
    for c in ("_row", "row", "fp", "_fp", "_x", "key", "size", "times", "place", "bucket", "node", "root", "score"):
        df = df.selectExpr("*", f"'mine' AS `{c}`")
    return df


def components(nodes, pairs):
    """Smallest node of each node's component."""
    up = {n: n for n in nodes}

    def find(n):
        while up[n] != n:
            up[n] = up[up[n]]
            n = up[n]
        return n

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}
