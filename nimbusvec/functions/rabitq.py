"""Rotated scalar codes of 1, 2, 4 or 8 bits a dimension, and distance estimates from them.

A vector is rotated and centred; each coordinate of the direction becomes a sign and a
magnitude level. Two factors stored with the code turn an inner product of code and query
into an unbiased estimate of the squared distance. The scale from coordinates to levels is
searched for the levels a code really has, bits - 1 of them; as_published searches it for
one bit more, as the published index does, which saturates a fifth of the coordinates.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from nimbusvec.functions.layout import BITS_ALLOWED

_EPS = 1e-5


@dataclass
class Codec:
    """What is shared by all codes: rotation, rotated centroid, bits and scale; and by all shards that lie at centres: these, and each shard's."""

    rotation: np.ndarray
    centroid: np.ndarray
    bits: int
    scale: float
    centres: np.ndarray | None = None
    of_centre: np.ndarray | None = None

    @property
    def dim(self) -> int:
        return len(self.centroid)


@dataclass
class Codes:
    """Levels (n, dim) as unsigned numbers, with the factors add and rescale."""

    levels: np.ndarray
    add: np.ndarray
    rescale: np.ndarray


def random_rotation(dim: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.where(np.diag(r) < 0, -1.0, 1.0)


def best_scale(unit: np.ndarray, top: int) -> float:
    """The scale whose levels, 0 to top, lie closest in direction to a vector of absolute values.

    Going up, a scale changes the code only where a coordinate reaches its next level, so these
    scales are visited in order, and norm and inner product are kept up to date.
    """
    o = np.abs(unit)
    keep = o > 1e-12
    if top < 1 or not keep.any():
        return 0.0
    i, level = np.meshgrid(np.flatnonzero(keep), np.arange(1, top + 1), indexing="ij")
    at = (level / o[i]).ravel()
    order = np.argsort(at, kind="stable")
    # a coordinate at level l stands for l + 1/2
    up_dot = o[i].ravel()[order]
    up_norm = (2.0 * level).ravel()[order]
    dots = 0.5 * o.sum() + np.cumsum(up_dot)
    norms = 0.25 * len(o) + np.cumsum(up_norm)
    return float(at[order][np.argmax(dots / np.sqrt(norms))])


def constant_scale(dim: int, bits: int, seed: int, samples: int = 1000, as_published: bool = False) -> float:
    """The mean best scale over random directions; 0 for codes without magnitude levels."""
    top = (1 << bits) - 1 if as_published else (1 << (bits - 1)) - 1
    draws = np.random.default_rng(seed).standard_normal((samples, dim))
    draws /= np.linalg.norm(draws, axis=1, keepdims=True)
    return float(np.mean([best_scale(x, top) for x in draws]))


def make_codec(mean: np.ndarray, bits: int, seed: int = 1234, samples: int = 200, as_published: bool = False) -> Codec:
    if bits not in BITS_ALLOWED:
        raise ValueError(f"bits must be one of {BITS_ALLOWED}")
    turn = random_rotation(len(mean), seed)
    return Codec(turn, mean @ turn, bits, constant_scale(len(mean), bits, seed, samples, as_published))


def quantize(codec: Codec, vectors: np.ndarray) -> Codes:
    """Codes of vectors (n, dim). A vector at the centroid has no direction: its estimate is its add factor alone."""
    delta = vectors @ codec.rotation - codec.centroid
    norm = np.linalg.norm(delta, axis=1)
    safe = np.where(norm > 0, norm, 1.0)
    half = 1 << (codec.bits - 1)
    level = np.minimum(np.floor(codec.scale * np.abs(delta) / safe[:, None] + _EPS), half - 1).astype(np.int64)
    levels = np.where(delta >= 0, level + half, half - 1 - level).astype(np.uint8)
    middle = levels - (2 * half - 1) / 2.0
    along = (middle * delta).sum(1)
    across = middle @ codec.centroid
    ok = (norm > 0) & (along != 0)
    ratio = np.where(ok, norm**2 / np.where(ok, along, 1.0), 0.0)
    return Codes(levels, norm**2 + 2 * ratio * across, -2 * ratio)


def prepare(codec: Codec, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each query: rotated form, squared distance to the centroid, and minus half its sum."""
    turned = queries @ codec.rotation
    return turned, ((turned - codec.centroid) ** 2).sum(1), -0.5 * turned.sum(1)


def estimate(codec: Codec, prepared: tuple[np.ndarray, np.ndarray, np.ndarray], codes: Codes, at: np.ndarray) -> np.ndarray:
    """Estimated squared distances of query i to the codes at[i], an array (queries, candidates)."""
    turned, add, half_sum = prepared
    # levels are small whole numbers: gathered as bytes, multiplied in single precision
    turned = turned.astype(np.float32, copy=False)
    if len(at) and not at.strides[0]:  # all queries ask for the same rows
        inner = (turned @ codes.levels[at[0]].astype(np.float32).T).astype(np.float64)
    else:
        inner = np.einsum("ijk,ik->ij", codes.levels[at].astype(np.float32), turned).astype(np.float64)
    return codes.add[at] + add[:, None] + codes.rescale[at] * (inner + half_sum[:, None] * ((1 << codec.bits) - 1))


def pack_levels(levels: np.ndarray, bits: int) -> np.ndarray:
    """Levels as bytes, the first in the lowest bits, rows padded to whole bytes."""
    n, dim = levels.shape
    each = (levels[:, :, None] >> np.arange(bits, dtype=np.uint8)) & 1
    return np.packbits(each.reshape(n, dim * bits), axis=1, bitorder="little")


def unpack_levels(packed: np.ndarray, dim: int, bits: int) -> np.ndarray:
    flat = np.unpackbits(packed, axis=1, count=dim * bits, bitorder="little").reshape(len(packed), dim, bits)
    return (flat << np.arange(bits, dtype=np.uint8)).sum(2, dtype=np.uint8)
