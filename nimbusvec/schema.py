"""Schemas and parameters of an index."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nimbusvec.functions.distance import Metric
from nimbusvec.functions.layout import BITS_ALLOWED, MAX_DEGREE, code_bytes, node_size

VECTORS = "id long, vec array<float>"
RESULTS = "qid long, rank int, id long, distance double"
NODES = "id long, shard int, offset long, vec array<float>, is_medoid boolean, code binary, add float, rescale float, neighbors array<long>"
#: One row for each shard: its graph as packed arrays.
SHARDS = "shard int, n long, ids binary, vectors binary, neighbors binary, medoid int, codes binary, add binary, rescale binary"


@dataclass(frozen=True)
class Params:
    """What an index is built and searched with. shards None: as many as the rows ask for, when built and when inserts add to them."""

    dim: int
    degree: int = 32
    beam_width: int = 32
    beam_width_construction: int = 64
    alpha: float = 1.2
    build_alpha: float = 1.0
    bits: int = 4
    metric: str = "l2"
    shards: int | None = None
    seed: int = 1234
    rounds: int = 2
    keep_all_if_small: bool = True
    #: Where shards lie: "hash" of the ids, or "centroid"; then a search visits the probe nearest, 0 for all.
    placement: str = "hash"
    probe: int = 0
    #: Set by a build whose shards were not given: inserts may ask for more.
    more_shards: bool = False

    def __post_init__(self) -> None:
        Metric(self.metric)
        if self.placement not in ("hash", "centroid") or self.probe < 0:
            raise ValueError("placement is hash or centroid, probe 0 or more")
        if self.dim < 1 or (self.shards is not None and self.shards < 1) or self.beam_width < 1 or self.beam_width_construction < 1:
            raise ValueError("dim, shards and beam widths must be at least 1")
        if not 1 <= self.degree <= MAX_DEGREE:
            raise ValueError(f"degree must be from 1 to {MAX_DEGREE}")
        if self.bits not in BITS_ALLOWED:
            raise ValueError(f"bits must be one of {BITS_ALLOWED}")

    def meta(self, n: int, medoid_shard: int, medoid_offset: int, data_file: str = "", prefix: str = "") -> dict:
        """The fields of the metadata file."""
        return {
            "data_file": data_file, "output_prefix": prefix, "distance": self.metric, "num_vectors": n, "dim": self.dim, "R": self.degree,
            "beam_width": self.beam_width, "beam_width_construction": self.beam_width_construction, "alpha": self.alpha, "rabitq_bits": self.bits,
            "num_memory_nodes": self.shards or 1, "medoid": {"memory_node": medoid_shard, "offset": medoid_offset},
            "node_size": node_size(self.dim, self.degree, self.bits), "rabitq_size": code_bytes(self.dim, self.bits) + 8,
        }

    def as_dict(self) -> dict:
        return asdict(self)


def takes(vectors: DataFrame, dim: int) -> Column:
    """Whether an index of that dimension takes a row (id, vec)."""
    return vectors["id"].isNotNull() & F.coalesce(F.size(vectors["vec"]) == dim, F.lit(False)) & ~F.coalesce(F.exists(vectors["vec"], lambda x: x.isNull()), F.lit(False))


def check_dim(vectors: DataFrame, dim: int, vec: str = "vec") -> DataFrame:
    """vectors, failing at run time on a null vector or one of another length."""
    ok = F.coalesce(F.size(vec) == dim, F.lit(False))
    return vectors.withColumn(vec, F.when(ok, F.col(vec)).otherwise(F.raise_error(F.concat(F.lit(f"a vector has another dimension than {dim}: "), F.coalesce(F.size(vec), F.lit(-1)).cast("string")))))
