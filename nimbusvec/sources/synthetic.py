"""Deterministic synthetic vectors, unnormalised, so that they tell distances from inner products."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# Fixed values of the generator.
START, FACTOR = 1469598103934665603, 2685821657736338717


def vectors_of(seeds: np.ndarray, dim: int) -> np.ndarray:
    """One vector for each seed: shift-register steps, then two components raised by 4 and 1."""
    s = np.uint64(START) ^ seeds.astype(np.uint64)
    out = np.empty((len(seeds), dim), np.float32)
    for j in range(dim):
        s ^= s >> np.uint64(12)
        s ^= s << np.uint64(25)
        s ^= s >> np.uint64(27)
        v = (s * np.uint64(FACTOR)) >> np.uint64(32)
        out[:, j] = (v % np.uint64(10000)).astype(np.float32) / np.float32(10000)
    rows = np.arange(len(seeds))
    out[rows, seeds % dim] += np.float32(4)
    out[rows, ((seeds * 17 + 3) % (1 << 32)) % dim] += np.float32(1)
    return out


def synthetic(spark: SparkSession, n: int, dim: int, first_id: int = 1, first_seed: int = 1) -> DataFrame:
    """(id, vec): n vectors of seeds and ids that count up."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = b.column(0).to_numpy()
            flat = pa.array(vectors_of(k + first_seed, dim).ravel())
            yield pa.RecordBatch.from_arrays([pa.array(k + first_id), pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, dim, dtype=np.int32), flat)], ["id", "vec"])

    return spark.range(n).mapInArrow(run, "id long, vec array<float>")
