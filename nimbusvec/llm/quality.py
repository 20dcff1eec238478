"""Quality classifier: regularised quadratic discriminant over document statistics.

Each whole text becomes a vector of transformed statistics. Of each class the count, mean
and covariance are summed over all labelled rows, task by task, so training needs one pass
over narrow rows and the driver sees a few small matrices. A class covariance is shrunk
towards the pooled one and that towards a multiple of the identity; its Cholesky factor is
computed once and sent with the model, and a score is the logistic of the difference of the
two log densities (half squared Mahalanobis lengths and log determinants) and log priors,
tempered by a scale fitted on the training sums' own rows.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nimbusvec.llm.shared import bound_batches, column, lean, own_name, stored

#: Share of a class's covariance that is replaced by the pooled one, and of that by its mean variance.
TO_POOLED, TO_SPHERE = 0.1, 0.02
#: Scores are tempered on at most so many training rows, of hashes below a share.
TEMPER_ROWS = 20_000
THRESHOLD = 0.7

STATISTICS = (
    "log_words", "log_word_length", "word_length_spread", "upper", "digits", "marks", "odd_marks",
    "odd_words", "distinct_words", "top_word", "repeated_lines", "line_length", "packed", "entropy", "short_words",
)

_IS = np.zeros((5, 256))
_IS[0, 65:91] = 1
_IS[1, 48:58] = 1
_IS[2, [ord(c) for c in ".,;:'\"-()?"]] = 1
_IS[3, [i for i in range(33, 127) if not chr(i).isalnum() and chr(i) not in ".,;:'\"-()?@/+=_"]] = 1
_IS[4, [*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_ODD = bytes(i for i in range(256) if _IS[3, i])
_KEEP_ODD = bytes(i for i in range(256) if not _IS[3, i] and i not in b" \t\n\x0b\x0c\r")


def _rare(k: float, n: float) -> float:
    """The log of a share, kept finite and alike for short and long texts."""
    return math.log((k + 0.002 * n + 0.05) / (n + 0.1))


def statistics(raw: bytes | None) -> list[float]:
    """The transformed statistics of a whole text; of an empty one, those of no words."""
    raw = raw or b""
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    upper, digits, marks, odd, letters = (float(x) for x in _IS @ counts)
    words = raw.split()
    n, size = len(words), len(raw)
    if not n:
        return [0.0] * len(STATISTICS)
    lengths = np.fromiter(map(len, words), np.float64, n)
    seen = Counter(words)
    lines = [x for x in raw.split(b"\n") if x]
    p = counts[counts > 0] / size
    packer = zlib.compressobj(1)
    packed = sum(len(packer.compress(raw[i : i + (1 << 20)])) for i in range(0, size, 1 << 20)) + len(packer.flush())
    odd_words = len(raw.translate(None, _KEEP_ODD).split())
    return [
        math.log(n + 1),
        math.log(lengths.mean()),
        math.log(lengths.std() + 0.1),
        _rare(upper, letters),
        _rare(digits, size),
        _rare(marks, n),
        _rare(odd, n),
        _rare(odd_words, n),
        math.log(len(seen) + 1) - math.log(n + 1),
        _rare(max(seen.values()) - 1, n),
        _rare(len(lines) - len(set(lines)), len(lines)),
        math.log(size / max(len(lines), 1)),
        math.log(packed / (size + 40)),
        float(-(p * np.log(p)).sum()),
        _rare(float((lengths <= 3).sum()), n),
    ]


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _statistics(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    return lean(lambda each: (pd.Series([statistics(x) for x in raw]) for raw in each))(parts)


def with_statistics(df: DataFrame, text: str, to: str) -> DataFrame:
    bound_batches(df.sparkSession)
    return df.withColumn(to, _statistics(column(text).cast("binary")))


@dataclass
class Model:
    """Means, Cholesky factors and their inverses of the classes 0 and 1, log priors, and the scale of the score."""

    means: list[np.ndarray]
    factors: list[np.ndarray]
    offsets: list[float]
    scale: float = 1.0
    shift: float = 0.0
    inverses: list[np.ndarray] = field(default_factory=list)

    def difference(self, x: np.ndarray) -> np.ndarray:
        """log p(1, x) - log p(0, x)."""
        out = []
        for mean, inverse, offset in zip(self.means, self.inverses, self.offsets, strict=True):
            z = inverse @ (x - mean).T
            out.append(offset - 0.5 * (z * z).sum(0))
        return out[1] - out[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.difference(x) + self.shift, -500, 500)))


def _sums(rows: DataFrame) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """Count, sum and products of each class over rows (x, y)."""
    d = len(STATISTICS)
    width = 1 + d + d * d

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, width))
        for b in batches:
            if b.num_rows:
                x = np.stack(b.column(0).to_numpy(zero_copy_only=False))
                y = b.column(1).to_numpy(zero_copy_only=False)
                for c in (0, 1):
                    own = x[y == c]
                    total[c] += np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["s"])

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, width))
        for b in batches:
            for x in b.column(0).to_pylist():
                total += np.frombuffer(x).reshape(2, width)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["s"])

    parts = rows.select("x", "y").mapInArrow(run, "s binary").repartition(8).mapInArrow(add, "s binary").collect()
    total = sum((np.frombuffer(r.s).reshape(2, width) for r in parts), np.zeros((2, width)))
    return [(t[0], t[1 : 1 + d], t[1 + d :].reshape(d, d)) for t in total]


def fit(rows: DataFrame, to_pooled: float = TO_POOLED, to_sphere: float = TO_SPHERE, temper_rows: int = TEMPER_ROWS) -> Model:
    """The model for rows (id, x, y): x the statistics, y 0 or 1; other labels and nulls are ignored.

    A class without rows gets the pooled moments, so that without any labels every score is a half.
    """
    known = rows.where("x is not null and y in (0, 1)").select("id", "x", "y")
    sums = _sums(known)
    d = len(STATISTICS)
    n = sum(s[0] for s in sums)
    mean_all = sum(s[1] for s in sums) / max(n, 1)
    scatter = [s[2] - np.outer(s[1], s[1]) / max(s[0], 1) for s in sums]
    pooled = sum(scatter) / max(n - 2, 1) + 1e-3 * np.eye(d)
    spread = np.diag(np.diag(pooled))  # the statistics have scales of their own
    pooled = (1 - to_sphere) * pooled + to_sphere * spread
    model = Model([], [], [])
    for (count, total, _), s in zip(sums, scatter, strict=True):
        # a class of few rows leans more on the pooled covariance
        lean = to_pooled + (1 - to_pooled) * d / (count + d)
        cov = (1 - lean) * s / max(count - 1, 1) + lean * pooled
        factor = np.linalg.cholesky(cov)
        model.means.append(total / count if count else mean_all)
        model.factors.append(factor)
        model.inverses.append(np.linalg.inv(factor))
        model.offsets.append(math.log((count + 1) / (n + 2)) - float(np.log(np.diag(factor)).sum()))
    if all(s[0] for s in sums):
        # rows whose hash falls below a share chosen for about so many, ten times that at most: tasks send no others
        share = math.ceil(min(1.0, temper_rows / n) * (1 << 30))
        sample = known.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < share).limit(10 * temper_rows).select("x", "y").toPandas()
        if len(sample):
            _temper(model, np.stack(sample.x), sample.y.to_numpy(float))
    return model


def _temper(model: Model, x: np.ndarray, y: np.ndarray) -> None:
    """Scale and shift the log odds by a ridge logistic fit of one slope, as densities alone are too sure of themselves."""
    t = np.clip(model.difference(x), -60, 60)
    w = np.array([1.0, 0.0])
    a = np.stack([t, np.ones_like(t)], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(2)
        step = np.linalg.solve(h, a.T @ (y - p) - 1e-2 * (w - [1.0, 0.0]))
        w = w + np.clip(step, -1, 1)
        if abs(step).max() < 1e-9:
            break
    if w[0] > 0:
        model.scale, model.shift = float(w[0]), float(w[1])


def scored(rows: DataFrame, model: Model, to: str) -> DataFrame:
    """rows with the score of their statistics, column x."""

    @F.pandas_udf(T.DoubleType())
    def score(x: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.stack(x))) if len(x) else pd.Series([], dtype=float)

    return rows.withColumn(to, score("x"))


def held_out(doc_id: Column) -> Column:
    """Whether a document's label is kept from training: crc32 of its id as text, mod 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _training(stats: DataFrame, labels: DataFrame) -> DataFrame:
    known = labels.select(F.col("doc_id"), F.col("quality").alias("y")).where("doc_id is not null and y is not null").where(~held_out(F.col("doc_id")))
    return stats.select("doc_id", "x").join(known, "doc_id").select(F.col("doc_id").alias("id"), "x", "y")


def quality(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, score, predicted.

    Only labels (doc_id, quality) of rows that aren't held out are learnt from; scores use the
    text alone. A null text counts as empty and gets the score of no words; a null doc_id is
    scored, never trained on; of repeated labels each counts; without labels every score is a
    half. Other columns are not read. An empty table gives an empty one.
    """
    stats, _ = stored(with_statistics(docs.select(column(doc_id).alias("doc_id"), column(text).alias("text")), "text", "x").drop("text"), "statistics")
    out = scored(stats, fit(_training(stats, labels)), "score")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs, columns unchanged, without the rows whose score is below the threshold.

    A null or empty text has the score of no words, as has any text without words; repeated rows
    stay or go together; texts of any length count whole. An empty table gives an empty one.
    """
    x = own_name(docs, "_x")
    rows, _ = stored(with_statistics(docs, text, x), "rows")
    model = fit(_training(rows.select(column(doc_id).alias("doc_id"), F.col(x).alias("x")), labels))

    @F.pandas_udf(T.BooleanType())
    def good(v: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.stack(v)) >= threshold) if len(v) else pd.Series([], dtype=bool)

    return rows.where(good(F.col(x))).select(*(column(c) for c in docs.columns))
