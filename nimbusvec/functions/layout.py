"""Node sizes, shard placement, pointers and hashes of the stored index, as column expressions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the record format.
SHARD_HEADER = 16
NODE_HEADER = 16
OFFSET_BITS = 48
BITS_ALLOWED = (1, 2, 4, 8)
MAX_DEGREE = 255


def code_bytes(dim: int, bits: int) -> int:
    return -(-bits * dim // 8)


def node_size(dim: int, degree: int, bits: int) -> int:
    """Bytes of a node record: header, vector, code with its two factors, neighbour slots."""
    return NODE_HEADER + 4 * dim + code_bytes(dim, bits) + 8 + 8 * degree


def aligned(size: int) -> int:
    return -(-size // 8) * 8


def shard_of(place: Column, shards: int) -> Column:
    """Nodes of one size go to the emptiest shard, the first of equals: round robin by place."""
    return F.pmod(place, F.lit(shards)).cast("int")


def offset_of(place: Column, shards: int, size: int) -> Column:
    return (F.lit(SHARD_HEADER) + F.floor(place / F.lit(shards)) * F.lit(aligned(size))).cast("long")


def pack_pointer(shard: Column, offset: Column) -> Column:
    return F.shiftleft(shard.cast("long"), OFFSET_BITS).bitwiseOR(offset.cast("long"))


def pointer_shard(pointer: Column) -> Column:
    return F.shiftrightunsigned(pointer, OFFSET_BITS).cast("int")


def pointer_offset(pointer: Column) -> Column:
    return pointer.bitwiseAND(F.lit((1 << OFFSET_BITS) - 1))


@F.pandas_udf(T.LongType())
def mix64(x: pd.Series) -> pd.Series:
    """The 64-bit finaliser with shifts of 33 that pointer hashes use."""
    z = x.to_numpy(np.int64).view(np.uint64).copy()
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        z ^= z >> np.uint64(33)
        z *= np.uint64(factor)
    z ^= z >> np.uint64(33)
    return pd.Series(z.view(np.int64))


@F.pandas_udf(T.LongType())
def split_mix64(x: pd.Series) -> pd.Series:
    """One step of SplitMix64 from x."""
    z = x.to_numpy(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    z ^= z >> np.uint64(31)
    return pd.Series(z.view(np.int64))
