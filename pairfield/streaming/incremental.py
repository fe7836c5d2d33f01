"""Pair counts of a growing set: DD(A + B) = DD(A) + DD(A, B) + DD(B, A) + DD(B).

Each micro-batch joins only its own points with all earlier ones. Every batch writes its points and
its part of the counts under its own number, so a batch that is run again after a failure replaces
what it had written before, and the counts are the sum of the parts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.counts import count
from ..sources.points import PointSet


class IncrementalPairCount:
    """Counts pairs of streamed points by distance; path is a shared folder for its state."""

    def __init__(self, spark: SparkSession, path: str, edges: Sequence[float], id: str, pos: Sequence[str], weight: str | None = None):
        self.spark, self.path, self.edges, self.id, self.pos, self.weight = spark, path.rstrip("/"), list(edges), id, list(pos), weight

    def _set(self, df: DataFrame) -> PointSet:
        return PointSet.of(df, self.id, self.pos, self.weight)

    def _stored(self, kind: str, before: int | None = None) -> DataFrame | None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}")
        system = where.getFileSystem(self.spark._jsc.hadoopConfiguration())
        batches = [s.getPath() for s in system.listStatus(where)] if system.exists(where) else []
        paths = [p.toString() for p in batches if before is None or int(p.getName().split("=")[1]) < before]
        return self.spark.read.parquet(*paths) if paths else None

    def add(self, batch: DataFrame, number: int) -> None:
        """Takes a micro-batch in."""
        columns = [self.id, *self.pos, *([self.weight] if self.weight else [])]
        batch.select(*columns).write.mode("overwrite").parquet(f"{self.path}/points/batch={number}")
        new = self._set(self.spark.read.parquet(f"{self.path}/points/batch={number}"))
        part = count(new, new, self.edges, weighted=True)
        earlier = self._stored("points", number)
        if earlier is not None:
            old = self._set(earlier)
            part = part.unionByName(count(new, old, self.edges, weighted=True)).unionByName(count(old, new, self.edges, weighted=True))
        summed = part.groupBy("bin", "edge").agg(F.sum("count").alias("count"), F.sum("weight0").alias("weight0"))
        summed.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/counts/batch={number}")

    def start(self, stream: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """Counts a stream of points."""
        return stream.writeStream.foreachBatch(self.add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

    def counts(self) -> DataFrame | None:
        """bin, edge, count and weight0 of all points so far; None before the first batch."""
        stored = self._stored("counts")
        return None if stored is None else stored.groupBy("bin", "edge").agg(F.sum("count").alias("count"), F.sum("weight0").alias("weight0"))
