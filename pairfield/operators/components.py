"""Connected components of an edge table."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Edges up to which one task may hold all that is left after each partition has reduced its own.
UNION_FIND_EDGES = 2_000_000
_PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def shared_folder(spark: SparkSession) -> str:
    """Where intermediate tables go: below spark.checkpoint.dir. Where that is unset there must be one machine, whose own folder will do."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{(folder or '/tmp/checkpoints').rstrip('/')}/pairfield"


def stored(df: DataFrame, rows: int | None = None) -> tuple[DataFrame, str]:
    """df written as a table in the shared folder and read again, and its path; rows, if known, bounds the number of its files.

    A table rather than a checkpoint: what Spark infers about a checkpointed plan grows with every
    round of a loop until planning takes longer than the work.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    (df if rows is None else df.coalesce(1 + rows // 100_000)).write.parquet(path)
    return spark.read.parquet(path), path


def dropped(spark: SparkSession, path: str) -> None:
    """Deletes a stored table that is no longer read."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a partition as (member, least member) of each of its components."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = np.fromiter(parent, np.int64, len(parent))
    roots = np.fromiter(map(root, list(parent)), np.int64, len(parent))
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(roots)], schema=_PAIR)


def connected_components(edges: DataFrame, strategy: str = "auto") -> DataFrame:
    """node and root (the least node of its component) of each node of edges (a, b).

    `union_find`: each partition reduces its edges to a forest, one task joins the forests. `labels`: rounds of joins, for forests too large for one
    task. `auto` counts first.
    """
    edges = edges.select(F.col("a").cast("long"), F.col("b").cast("long"))
    if strategy == "auto":
        edges, _ = stored(edges)
        strategy = "union_find" if edges.count() <= UNION_FIND_EDGES else "labels"
    if strategy == "union_find":
        forest = edges.mapInArrow(_forest, "a long, b long").coalesce(1).mapInArrow(_forest, "a long, b long")
        return forest.select(F.col("a").alias("node"), F.col("b").alias("root"))
    if strategy != "labels":
        raise ValueError(strategy)
    both, _ = stored(edges.union(edges.select("b", "a")).distinct())
    return least_labels(both, both.count())


def least_labels(both: DataFrame, rows: int) -> DataFrame:
    """node and root for edges (a, b) given in both directions, in about log(n) rounds.

    In a round each node offers the least grandparent among its neighbours to itself and to its own
    parent, and every node then points at the least of its grandparent and its offers.
    """
    spark = both.sparkSession
    labels, path = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root")), rows)
    before = None
    while True:
        total = labels.agg(F.sum(F.col("root").cast("decimal(38,0)"))).first()[0]
        if total == before:
            return labels
        before = total
        parents = labels.select(F.col("node").alias("root"), F.col("root").alias("grand"))
        known = labels.join(parents, "root")
        least = both.join(known.select(F.col("node").alias("b"), "grand"), "b").groupBy(F.col("a").alias("node")).agg(F.min("grand").alias("m"))
        offered = labels.join(least, "node")
        offers = offered.select("node", "m").unionByName(offered.select(F.col("root").alias("node"), "m")).groupBy("node").agg(F.min("m").alias("m"))
        old = path
        labels, path = stored(known.join(offers, "node", "left").select("node", F.least("grand", "m").alias("root")), rows)
        dropped(spark, old)
