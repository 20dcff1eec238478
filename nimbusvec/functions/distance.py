"""Distances between vectors: as column expressions, and as numpy kernels over batches.

Components are widened to double before any arithmetic, so that results don't depend on the
order of partitions and can be held against another engine. Squared Euclidean distance has
no root; the inner-product distance is 1 - a.b.
"""

from __future__ import annotations

from enum import Enum

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


class Metric(str, Enum):
    L2 = "l2"
    IP = "ip"


def _fold(a: Column, b: Column, term) -> Column:
    return F.aggregate(F.zip_with(a, b, term), F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _fold(a, b, lambda x, y: x.cast("double") * y.cast("double"))


def l2_squared(a: Column, b: Column) -> Column:
    return _fold(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))


def ip_distance(a: Column, b: Column) -> Column:
    return F.lit(1.0) - dot(a, b)


def ip_negative(a: Column, b: Column) -> Column:
    """The builder's form of the inner-product distance: the same order as ip_distance, other values."""
    return -dot(a, b)


def distance(metric: Metric | str, a: Column, b: Column) -> Column:
    return l2_squared(a, b) if Metric(metric) is Metric.L2 else ip_distance(a, b)


def to_many(metric: Metric | str, queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Distances of every query to every vector. L2 takes differences, not the expanded square: nothing cancels."""
    if Metric(metric) is Metric.IP:
        return 1.0 - queries @ vectors.T
    out = np.empty((len(queries), len(vectors)))
    step = max(1, (1 << 21) // max(1, vectors.size))
    for i in range(0, len(queries), step):
        diff = queries[i : i + step, None, :] - vectors[None]
        out[i : i + step] = np.einsum("ijk,ijk->ij", diff, diff)
    return out


def to_own(metric: Metric | str, queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Distances of query i to its own candidates[i], an array (queries, candidates, dim)."""
    if Metric(metric) is Metric.IP:
        return 1.0 - np.einsum("ik,ijk->ij", queries, candidates)
    diff = candidates - queries[:, None, :]
    return np.einsum("ijk,ijk->ij", diff, diff)
