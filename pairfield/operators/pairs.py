"""Pairs within a radius: as a DataFrame, for a consumer in batches, or as an iterator."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from itertools import islice, starmap

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F

from ..plans.epsjoin import within
from ..sources.points import PointSet
from .components import dropped, shared_folder, stored

BUNCH = 100_000
#: Pairs that pass to the driver as one value, in one task's result, and that the driver writes at once.
PACK, PART, SPOOL = 10_000, 200_000, 500_000


def enum(a: PointSet, b: PointSet, rmax: float, strategy: str = "grid", metric: Column | None = None, observe: Observation | None = None) -> DataFrame:
    """i, j, r of all ordered pairs with r <= rmax; a set joined with itself has (i, j), (j, i) and (i, i). observe gets their number as `pairs`."""
    return within(a, b, rmax, strategy=strategy, metric=metric, observe=observe).select(F.col("a_id").alias("i"), F.col("b_id").alias("j"), F.sqrt("r2").alias("r"))


def enum_distinct(a: PointSet, rmax: float, strategy: str = "grid") -> DataFrame:
    """i < j and r of the pairs of one set, each once."""
    return within(a, a, rmax, F.col("a_id") < F.col("b_id"), strategy).select(F.col("a_id").alias("i"), F.col("b_id").alias("j"), F.sqrt("r2").alias("r"))


def process(pairs: DataFrame, consumer: Callable[[pd.DataFrame], pd.DataFrame], schema: str, bunch: int = BUNCH) -> DataFrame:
    """consumer's rows for batches of bunch pairs (the last one of a task may have fewer), on the executors."""
    if bunch < 1:
        raise ValueError("bunch is 1 or more")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        size = 0
        for batch in batches:
            start = 0
            while size + len(batch) - start >= bunch:
                held.append(batch.iloc[start : start + bunch - size])
                start += bunch - size
                yield consumer(pd.concat(held, ignore_index=True))
                held, size = [], 0
            if start < len(batch):
                held.append(batch.iloc[start:])
                size += len(batch) - start
        if held:
            yield consumer(pd.concat(held, ignore_index=True))

    return pairs.mapInPandas(run, schema)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each PACK rows as one binary value."""
    for batch in batches:
        for start in range(0, batch.num_rows, PACK):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema) as stream:
                stream.write_batch(batch.slice(start, PACK))
            yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["packed"])


def iterate(pairs: DataFrame, plain: bool = False) -> Iterator[tuple]:
    """The pairs one by one. The driver holds PART of them two or three times, however many there are: they are stored first and then dealt out evenly. They are Rows, or with plain tuples, which take a fraction of the time."""
    held, path = stored(pairs)
    try:
        dealt = held.repartition(1 + held.count() // PART).mapInArrow(_packed, "packed binary")
        for row in dealt.toLocalIterator(prefetchPartitions=True):
            table = pa.ipc.open_stream(row["packed"]).read_all()
            values = zip(*[c.to_pylist() for c in table.columns])
            yield from values if plain else starmap(Row(*table.column_names), values)
    finally:
        dropped(pairs.sparkSession, path)


def spooled(spark: SparkSession, rows: Iterator[tuple], schema: str) -> DataFrame:
    """Rows from the driver as a table in the shared folder; the driver holds SPOOL of them."""
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    empty = spark.createDataFrame([], schema)
    empty.write.parquet(path)
    while bunch := list(islice(rows, SPOOL)):
        table = pa.table(dict(zip(empty.columns, map(list, zip(*bunch)))))
        spark.createDataFrame(table, schema).write.mode("append").parquet(path)
    return spark.read.schema(empty.schema).parquet(path)
