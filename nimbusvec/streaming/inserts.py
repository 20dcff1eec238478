"""Inserting a stream of vectors: each micro-batch makes the next version of an index folder.

A version holds the shards that its batch has changed, and the codec; the others are read from
the version that wrote them last. A version that shares the rows out anew holds all shards,
and none from before it is read any more.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from nimbusvec.plans.index import VectorIndex
from nimbusvec.schema import SHARDS, Params


class IndexFolder:
    """A folder of index versions. Version b + 1 is what micro-batch b made; a batch that ran before is not run again."""

    def __init__(self, spark: SparkSession, path: str, params: Params) -> None:
        self.spark, self.path, self.params = spark, path.rstrip("/"), params

    def _at(self, version: int) -> str:
        return f"{self.path}/v{version}"

    def _done(self, version: int) -> bool:
        # the codec is written last, so it marks a complete version
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self._at(version)}/codec/_SUCCESS")
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)

    def latest(self) -> int:
        """The highest complete version; -1 for none. Versions have no gaps."""
        v = -1
        while self._done(v + 1):
            v += 1
        return v

    def _base(self, version: int) -> int:
        """The version from which on shards count: the last that holds all of them."""
        return self.spark.read.schema("base int").parquet(f"{self._at(version)}/base").first().base

    def _shards(self, version: int) -> DataFrame:
        written = self.spark.read.schema(f"{SHARDS}, version int").parquet(f"{self.path}/shards").where(F.col("version").between(self._base(version), version))
        # one narrow row for each shard, of which there is one in about 2,500 rows
        last = F.broadcast(written.groupBy("shard").agg(F.max("version").alias("version")))
        return written.join(last, ["shard", "version"], "left_semi").drop("version")

    def _write(self, index: VectorIndex, version: int, base: int) -> None:
        changed = index.shards if base == version else index.changed
        changed.write.mode("overwrite").partitionBy("shard").parquet(f"{self.path}/shards/version={version}")
        self.spark.createDataFrame(pa.table({"base": pa.array([base], pa.int32())})).coalesce(1).write.mode("overwrite").parquet(f"{self._at(version)}/base")
        index.save_codec(self._at(version))

    def index(self, version: int | None = None) -> VectorIndex:
        v = self.latest() if version is None else version
        return VectorIndex.empty(self.spark, self.params) if v < 0 else VectorIndex.load(self.spark, self._at(v), self.params, self._shards(v))

    def start(self, base: VectorIndex) -> None:
        self._write(base, 0, 0)

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        if self.latest() >= batch_id + 1:
            return
        if self.latest() < 0:
            self.start(VectorIndex.empty(self.spark, self.params))
        grown = self.index(batch_id).insert(batch.select("id", "vec"))
        self._write(grown, batch_id + 1, batch_id + 1 if grown.changed is None else self._base(batch_id))
        (grown.shards if grown.changed is None else grown.changed).unpersist()

    def follow(self, stream: DataFrame, checkpoint: str, once: bool = True) -> StreamingQuery:
        """Insert a stream (id, vec), in order of arrival."""
        writer = stream.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer).start()
