"""The index as shard files, rotation file and metadata file, for exchange with other programs.

A shard file starts with its end and, on the first shard, the pointer of the medoid; node
records of one size follow: header, id, edge count, vector, packed code, two factors, and
pointers of the neighbours. Each shard is written and read by one task.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nimbusvec.functions.layout import OFFSET_BITS, SHARD_HEADER, aligned, code_bytes, node_size
from nimbusvec.functions.rabitq import Codec
from nimbusvec.schema import NODES, Params
from nimbusvec.sources.vector_files import _open

MEDOID_FLAG = 1 << 1


def shard_path(prefix: str, shard: int, shards: int) -> str:
    return f"{prefix}_node{shard + 1}_of{shards}.dat"


def place(nodes: DataFrame, shards: int, size: int) -> DataFrame:
    """(id, shard, offset) of nodes: dealt round robin in order of id, as records of one size fill the emptiest shard."""
    place_ = numbered(nodes)
    return place_.select("id", F.pmod("place", F.lit(shards)).cast("int").alias("shard"), (F.lit(SHARD_HEADER) + F.floor(F.col("place") / shards) * F.lit(aligned(size))).cast("long").alias("offset"))


def numbered(rows: DataFrame, key: str = "id") -> DataFrame:
    """rows with their place in order of key, from 0: ranges are sorted apart, then counts of ranges added up."""
    dealt = rows.select(key).repartitionByRange(F.col(key)).sortWithinPartitions(key).withColumn("range", F.spark_partition_id()).withColumn("inside", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33)).persist()
    sizes = sorted((r["range"], r["count"]) for r in dealt.groupBy("range").count().collect())
    before, start = [], 0
    for k, n in sizes:
        before.append((k, start))
        start += n
    table = rows.sparkSession.createDataFrame(before, "range int, start long")
    return dealt.join(F.broadcast(table), "range").select(key, (F.col("start") + F.col("inside")).alias("place"))


def write_shards(nodes: DataFrame, params: Params, prefix: str) -> dict:
    """Write nodes (as NODES; shard and offset are dealt anew) as shard files; returns the metadata, which save_meta() writes.

    Pointers take the neighbours' own places, so placement is joined to the edges first.
    """
    size = node_size(params.dim, params.degree, params.bits)
    at = place(nodes, params.shards or 1, size).persist()
    pointer = F.shiftleft(F.col("shard").cast("long"), OFFSET_BITS).bitwiseOR(F.col("offset"))
    edges = nodes.select("id", F.posexplode("neighbors").alias("pos", "dst")).join(at.select(F.col("id").alias("dst"), pointer.alias("to")), "dst")
    lists = edges.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "to"))), lambda p: p["to"]).alias("pointers"))
    rows = nodes.drop("shard", "offset", "neighbors").join(at, "id").join(lists, "id", "left")
    first = nodes.where("is_medoid").agg(F.min("id").alias("id"))
    med = at.join(first, "id").first()
    n = nodes.count()
    meta = params.meta(n, med.shard if med else 0, med.offset if med else 0, prefix=prefix)
    pointer_of_medoid = (med.shard << OFFSET_BITS) | med.offset if med else 0
    shards, dim, degree = params.shards or 1, params.dim, params.degree

    def write(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("offset")
        step = aligned(size)
        out = bytearray(SHARD_HEADER + len(g) * step)
        struct.pack_into("<QQ", out, 0, len(out), pointer_of_medoid if key[0] == 0 else 0)
        for r in g.itertuples():
            to = [] if r.pointers is None else [int(x) for x in r.pointers]
            struct.pack_into("<QIB3x", out, r.offset, MEDOID_FLAG if r.is_medoid else 0, r.id, len(to))
            at_ = r.offset + 16
            out[at_ : at_ + 4 * dim] = np.asarray(r.vec, "<f4").tobytes()
            at_ += 4 * dim
            out[at_ : at_ + len(r.code)] = r.code
            at_ += code_bytes(dim, params.bits)
            struct.pack_into("<ff", out, at_, r.add, r.rescale)
            struct.pack_into(f"<{degree}Q", out, at_ + 8, *to, *[0] * (degree - len(to)))
        fs, path = _open(shard_path(prefix, int(key[0]), shards))
        with fs.open_output_stream(path) as f:
            f.write(bytes(out))
        return pd.DataFrame({"shard": [int(key[0])], "bytes": [len(out)]})

    meta["shard_bytes"] = {r.shard: r.bytes for r in rows.groupBy("shard").applyInPandas(write, "shard int, bytes long").collect()}
    return meta


def read_shards(spark: SparkSession, prefix: str, params: Params) -> DataFrame:
    """Nodes, as NODES, of shard files; a missing or short file is an error."""
    size, dim, degree = node_size(params.dim, params.degree, params.bits), params.dim, params.degree
    step, shards, wide = aligned(size), params.shards or 1, code_bytes(params.dim, params.bits)
    schema = NODES.replace("neighbors array<long>", "pointers array<long>")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard in b.column(0).to_pylist():
                fs, path = _open(shard_path(prefix, shard, shards))
                with fs.open_input_file(path) as f:
                    raw = f.read()
                end, _ = struct.unpack_from("<QQ", raw, 0)
                if len(raw) < end:
                    raise ValueError(f"{path} ends at {len(raw)}, not at {end}")
                out: list[list] = [[] for _ in range(9)]
                for at in range(SHARD_HEADER, end, step):
                    head, id_, count = struct.unpack_from("<QIB", raw, at)
                    c = at + 16 + 4 * dim
                    add, rescale = struct.unpack_from("<ff", raw, c + wide)
                    to = struct.unpack_from(f"<{degree}Q", raw, c + wide + 8)[:count]
                    row = (id_, shard, at, np.frombuffer(raw, "<f4", dim, at + 16), bool(head & MEDOID_FLAG), raw[c : c + wide], add, rescale, [x for x in to if x])
                    for col, v in zip(out, row, strict=True):
                        col.append(v)
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.float32()), pa.bool_(), pa.binary(), pa.float32(), pa.float32(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], [x.strip().split()[0] for x in schema.split(",")])

    rows = spark.range(0, shards, 1, shards).mapInArrow(run, schema)
    pointer = F.shiftleft(F.col("shard").cast("long"), OFFSET_BITS).bitwiseOR(F.col("offset"))
    ids = rows.select(pointer.alias("to"), F.col("id").alias("dst"))
    edges = rows.select("id", F.posexplode("pointers").alias("pos", "to")).join(ids, "to")
    lists = edges.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "dst"))), lambda p: p["dst"]).alias("neighbors"))
    return rows.drop("pointers").join(lists, "id", "left").withColumn("neighbors", F.coalesce("neighbors", F.array().cast("array<long>")))


def save_meta(meta: dict, codec: Codec, prefix: str) -> None:
    """Write the metadata and the rotation file: dimension, rotation by columns, rotated centroid, scale."""
    fs, path = _open(prefix)
    with fs.open_output_stream(f"{path}.meta.json") as f:
        f.write(json.dumps({k: v for k, v in meta.items() if k != "shard_bytes"}, indent=2).encode())
    with fs.open_output_stream(f"{path}.rotation.bin") as f:
        f.write(struct.pack("<I", codec.dim) + codec.rotation.T.astype("<f4").tobytes() + codec.centroid.astype("<f4").tobytes() + struct.pack("<d", codec.scale))


def load_meta(prefix: str, expect: Params | None = None) -> tuple[dict, Codec]:
    """Metadata and codec of save_meta(), checked against each other and against expect."""
    fs, path = _open(prefix)
    with fs.open_input_file(f"{path}.meta.json") as f:
        meta = json.loads(f.read())
    with fs.open_input_file(f"{path}.rotation.bin") as f:
        raw = f.read()
    (dim,) = struct.unpack_from("<I", raw)
    if len(raw) != 4 + 4 * dim * dim + 4 * dim + 8:
        raise ValueError("the rotation file is incomplete")
    if dim != meta["dim"] or meta["rabitq_size"] != code_bytes(dim, meta["rabitq_bits"]) + 8:
        raise ValueError("rotation file and metadata disagree")
    if expect and (expect.dim, expect.bits, expect.shards or meta["num_memory_nodes"]) != (dim, meta["rabitq_bits"], meta["num_memory_nodes"]):
        raise ValueError("the index has other parameters than expected")
    turn = np.frombuffer(raw, "<f4", dim * dim, 4).reshape(dim, dim).T.astype(float)
    centre = np.frombuffer(raw, "<f4", dim, 4 + 4 * dim * dim).astype(float)
    return meta, Codec(turn, centre, meta["rabitq_bits"], struct.unpack_from("<d", raw, len(raw) - 8)[0])
