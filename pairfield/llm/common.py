"""Helpers shared by the corpus operators: table access, shared scratch space and id ranges."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of one input table; the projection reaches the Parquet scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset and there is one machine (tests), a local one is set."""
    directory = spark.conf.get("spark.checkpoint.dir", None)
    if not directory:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isEmpty() and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        directory = current.get() if current.isDefined() else "/tmp/checkpoints/pairfield"
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(directory)
    return directory


def fresh(df: DataFrame, *names: str) -> list[str]:
    """A name for each of names that no column of df has, whatever their case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def small_batches(spark: SparkSession) -> None:
    """Bounds what goes to Python at once, where the session says nothing: rows here are whole texts."""
    for key, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", "1000"), ("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))):
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, for a table that executors write and read."""
    return f"{shared_dir(spark).rstrip('/')}/pairfield/{name}-{uuid.uuid4().hex}"


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a scratch table that is no longer read."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def materialised(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df cut from its lineage by a reliable checkpoint in the shared folder; rows, if known, bounds the number of its files."""
    shared_dir(df.sparkSession)
    return (df if rows is None else df.coalesce(1 + rows // 100_000)).checkpoint(eager=True)


class IdFilter:
    """A Bloom filter of long ids: says no only for ids that aren't among them. Its size has a bound, whatever their number."""

    HASHES, MOST_BITS = 4, 1 << 26

    def __init__(self, ids: DataFrame, id_col: str):
        n = ids.count()
        #: Whether the ids are too many to be told from others.
        self.full = 8 * n > self.MOST_BITS
        self.bits = min(self.MOST_BITS, 1 << max(10, (12 * n).bit_length()))
        at = F.explode(F.array(*[F.pmod(F.xxhash64(F.col(id_col), F.lit(k)), F.lit(self.bits)) for k in range(self.HASHES)]))
        words = ids.select(at.alias("at")).groupBy(F.shiftright("at", 5).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 31 AS int))")).alias("bits"))
        table = np.zeros(self.bits >> 5, np.uint32)
        for batch in words.toArrow().to_batches():  # bits / 32 rows at most
            table[batch.column(0).to_numpy()] = batch.column(1).to_numpy().astype(np.uint32)
        self.table = ids.sparkSession.sparkContext.broadcast(table)  # 8 MB at most

    def places(self, id_col: str) -> list[Column]:
        """The places of an id in the table, as columns place0 .. (null for a null id)."""
        return [F.when(F.col(id_col).isNotNull(), F.pmod(F.xxhash64(F.col(id_col), F.lit(k)), F.lit(self.bits))).alias(f"place{k}") for k in range(self.HASHES)]

    @staticmethod
    def test(table: np.ndarray, places: Sequence[pa.Array]) -> np.ndarray:
        """Which ids, given by their places, may be among them; a null id is not."""
        held = ~places[0].is_null().to_numpy(zero_copy_only=False) if len(places[0]) else np.zeros(0, bool)
        for p in places:
            at = p.fill_null(0).to_numpy()
            held &= (table[at >> 5] >> (at & 31).astype(np.uint32) & 1).astype(bool)
        return held

    def may_have(self, id_col: str) -> Column:
        """Whether the id of a row may be among them (null: no)."""
        table, test = self.table, self.test

        @F.pandas_udf("boolean")
        def found(*places: pd.Series) -> pd.Series:
            return pd.Series(test(table.value, [pa.array(p, pa.int64(), from_pandas=True) for p in places]))

        return found(*self.places(id_col))


#: Bytes of input, by Spark's estimate, for which there is a range; and the most ranges there are, whose bounds all tasks get.
RANGE_BYTES, MOST_RANGES = 32 << 20, 50_000


def range_count(df: DataFrame, least: int) -> int:
    """Into how many ranges df is dealt: least, or as many as its size asks for."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return max(least, min(MOST_RANGES, size // RANGE_BYTES) if size < 1 << 60 else 0)  # of unknown size Spark says a number without bounds


def range_bounds(df: DataFrame, key: str, parts: int) -> list[int]:
    """At most parts - 1 ascending split points of an integer key, from an approximate quantile sketch.

    Only the key column is read, and only the split points reach the driver.
    """
    if parts < 2:
        return []
    shares = [i / parts for i in range(1, parts)]
    row = df.agg(F.percentile_approx(key, shares, 20 * parts).alias("q")).first()
    return sorted(set(row["q"] or []))


def range_index(key: Column, bounds: list[int]) -> Column:
    """The number of bounds below or equal to key (null: 0), found in two steps of about sqrt(n)."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    values = F.array(*[F.lit(b).cast("long") for b in bounds])
    heads = F.array(*[F.lit(b).cast("long") for b in bounds[::step]])
    group = F.size(F.filter(heads, lambda b: b <= key))
    within = F.size(F.filter(F.slice(values, (F.greatest(group, F.lit(1)) - 1) * step + 1, step), lambda b: b <= key))
    return F.when(key.isNull() | (group == 0), F.lit(0)).otherwise((group - 1) * step + within)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def text_pieces(text: str, limit: int = 1 << 20) -> Iterator[str]:
    """Cuts a text before single spaces between two non-spaces, into pieces of limit or more characters.

    No pre-token of a byte-level splitter crosses such a place, so pieces count and encode alone.
    """
    start, n = 0, len(text)
    while n - start > limit:
        at = text.find(" ", start + limit)
        while 0 < at < n - 1 and (text[at - 1].isspace() or text[at + 1].isspace()):
            at = text.find(" ", at + 1)
        if not 0 < at < n - 1:
            break
        yield text[start:at]
        start = at
    yield text[start:] if start else text


def batch_of(schema: pa.Schema, **columns) -> pa.RecordBatch:
    """A record batch of the given columns in the order of schema."""
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, f.type) for f in schema for c in [columns[f.name]]]
    return pa.RecordBatch.from_arrays([a if a.type == f.type else a.cast(f.type) for a, f in zip(arrays, schema)], schema=schema)
