"""The registered queries of the point-set operators, each beside the SQL that says the same."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .functions import sky
from .functions.metric import pair_columns
from .operators import estimators
from .operators.binning import AngularBinning, Axis, Binning, FastAngularBinning, FastRBinning, FlatSkyBinning, FlatSkyMultipoleBinning, MultipoleBinning, RBinning, RmuBinning, XYBinning
from .operators.boxes import integrate, integrate_many
from .operators.bootstrap import Policy, resample
from .operators.components import connected_components, shared_folder
from .operators.counts import collapsed, count
from .operators.fof import fof, fof_labels, fof_runs
from .operators.force import KERNELS, count_kernel, force, plummer_kernel
from .operators.forest import cell_sums, make_forest
from .operators.paircount import norms, paircount
from .operators.pairs import enum, enum_distinct, iterate, process, spooled
from .operators.regions import in_regions, sky_regions
from .plans.epsjoin import within
from .streaming.incremental import IncrementalPairCount
from .sources.points import FieldSet, PointSet, SkyPointSet, read_points

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function (spark, sf_dir) under its name, with its SQL."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return register


# ---- the point sets, in Spark and in SQL ----


def part(spark: SparkSession, sf: str, **more) -> PointSet:
    df = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"), F.col("p_size").cast("double").alias("w"), (F.col("p_partkey") % 7).cast("double").alias("v"), F.col("p_size").alias("size"))
    return PointSet.of(df, "p_partkey", ["x", "y"], "w", extra=("size",), **more)


def part_box(spark: SparkSession, sf: str) -> PointSet:
    df = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", (F.col("p_size") - 1).cast("double").alias("x"), (F.col("p_retailprice") - 900).alias("y"), F.col("p_size").cast("double").alias("w"))
    return PointSet.of(df, "p_partkey", ["x", "y"], "w", boxsize=(50.0, 100.0))


def part_field(spark: SparkSession, sf: str) -> PointSet:
    df = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"), F.col("p_size").cast("double").alias("w"), (F.col("p_partkey") % 7).cast("double").alias("v"))
    return FieldSet.of(df, "p_partkey", ["x", "y"], "v", "w")


def suppliers(spark: SparkSession, sf: str) -> PointSet:
    df = spark.read.parquet(f"{sf}/supplier.parquet").select("s_suppkey", (F.col("s_suppkey") % 50).cast("double").alias("x"), (F.col("s_suppkey") % 97 + 901.5).cast("double").alias("y"), (F.col("s_suppkey") % 5 + 1).cast("double").alias("w"))
    return PointSet.of(df, "s_suppkey", ["x", "y"], "w")


def lattice(spark: SparkSession, sf: str) -> PointSet:
    df = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", F.col("l_quantity").alias("x"), F.round(F.col("l_discount") * 100).alias("y"), F.round(F.col("l_tax") * 100).alias("z"))
    return PointSet.of(df, "l_orderkey", ["x", "y", "z"])


def customers(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey", F.pmod(F.col("c_custkey") * 137.5, F.lit(360.0)).alias("ra"), (F.col("c_acctbal") / 10000 * 80).alias("dec"), F.lit(1.0).alias("w"))


def customer_sky(spark: SparkSession, sf: str) -> PointSet:
    return SkyPointSet.of(customers(spark, sf), "c_custkey", "ra", "dec", "w")


def _d(x: float) -> str:
    return f"CAST('{float(x)!r}' AS DOUBLE)"


PART = "(SELECT p_partkey AS id, CAST(p_size AS DOUBLE) AS x, p_retailprice AS y, CAST(p_size AS DOUBLE) AS w, CAST(p_partkey % 7 AS DOUBLE) AS v FROM part)"
PART_BOX = "(SELECT p_partkey AS id, CAST(p_size - 1 AS DOUBLE) AS x, p_retailprice - 900 AS y, CAST(p_size AS DOUBLE) AS w FROM part)"
SUPPLIERS = "(SELECT s_suppkey AS id, CAST(s_suppkey % 50 AS DOUBLE) AS x, CAST(s_suppkey % 97 + 901.5 AS DOUBLE) AS y, CAST(s_suppkey % 5 + 1 AS DOUBLE) AS w FROM supplier)"
SKY = f"(SELECT c_custkey AS id, (c_custkey * {_d(137.5)}) % {_d(360)} AS ra, c_acctbal / 10000 * 80 AS dec FROM customer)"
SKY3 = f"(SELECT id, ra, dec, sin(radians(ra)) * cos(radians(dec)) AS x, cos(radians(ra)) * cos(radians(dec)) AS y, sin(radians(dec)) AS z FROM {SKY})"


def _pairs(a: str, b: str, rmax: float, on: str = "TRUE", axes: str = "xy", box: tuple | None = None, more: str = "") -> str:
    """Both sides' columns (1 and 2 behind x, y, w, v) and r of all pairs within rmax."""
    terms = []
    for k, x in enumerate(axes):
        d = f"abs(a.{x} - b.{x})"
        if box:
            d = f"(CASE WHEN {d} > {_d(box[k] / 2)} THEN {_d(box[k])} - {d} ELSE {d} END)"
        terms.append(f"{d} * {d}")
    r2 = " + ".join(terms)
    columns = ", ".join(f"a.{x} AS {x}1, b.{x} AS {x}2" for x in axes)
    return f"(SELECT a.id AS i, b.id AS j, {columns}, sqrt({r2}) AS r{more} FROM {a} a JOIN {b} b ON {r2} <= {_d(rmax * rmax)} AND {on})"


W = ", a.w AS w1, b.w AS w2"


def _index(axis: Axis, x: str) -> str:
    low, high = float(axis.edges[0]), float(axis.edges[-1])
    if axis.spacing == "linear":
        i = f"ceil(({x} - {_d(low)}) * {_d(axis.n / (high - low))})"
    elif axis.spacing == "log":
        i = f"ceil(log10((CASE WHEN {x} = 0 THEN {_d(0.9 * low)} ELSE {x} END) / {_d(low)}) * {_d(axis.n / math.log10(high / low))})"
    else:
        i = "(" + " + ".join(f"CAST({x} > {_d(e)} AS INTEGER)" for e in axis.edges) + ")"
    return f"CAST(least(greatest({i}, 0), {axis.n + 1}) AS INTEGER)"


def _binned(pairs: str, axes: list[tuple[Axis, str]], sums: dict[str, str], empty: str = "0") -> str:
    keys = [f"bin{k}" for k in range(len(axes))]
    bins = " CROSS JOIN ".join(f"(SELECT CAST(unnest(range(0, {axis.n + 2})) AS INTEGER) AS {k})" for k, (axis, _) in zip(keys, axes))
    index = ", ".join(f"{_index(axis, x)} AS {k}" for k, (axis, x) in zip(keys, axes))
    return f"""WITH p AS {pairs}, k AS (SELECT *, {index} FROM p),
s AS (SELECT {", ".join(keys)}, {", ".join(f"{e} AS {n}" for n, e in sums.items())} FROM k GROUP BY {", ".join(keys)})
SELECT {", ".join(keys)}, {", ".join(f"coalesce({n}, {empty}) AS {n}" if not n.startswith("mean") else n for n in sums)} FROM {bins} LEFT JOIN s USING ({", ".join(keys)})"""


SUMS = {"sum1": "sum(w1 * w2)", "npairs": "count(*)"}

# ---- distance joins ----


@query(f"SELECT i, j, r FROM {_pairs(PART, PART, 0.6)}")
def pairs_within(spark, sf):
    return enum(part(spark, sf), part(spark, sf), 0.6)


@query(f"SELECT i, j, r FROM {_pairs(PART, PART, 0.6, 'a.id < b.id')}")
def pairs_within_distinct(spark, sf):
    return enum_distinct(part(spark, sf), 0.6)


@query(f"SELECT i, j, r FROM {_pairs(PART_BOX, PART_BOX, 1.2, box=(50, 100))}")
def pairs_within_periodic(spark, sf):
    return enum(part_box(spark, sf), part_box(spark, sf), 1.2)


@query(f"SELECT i, j, r FROM {_pairs(PART, SUPPLIERS, 2.5)}")
def pairs_cross(spark, sf):
    return enum(part(spark, sf), suppliers(spark, sf), 2.5)


@query(f"SELECT i, j, r FROM {_pairs(PART, PART, 0.0)}")
def pairs_same_place(spark, sf):
    return enum(part(spark, sf), part(spark, sf), 0.0)


@query(f"SELECT i, j, r FROM {_pairs(PART, SUPPLIERS, 3.0)} WHERE abs(x1 - x2) + abs(y1 - y2) <= 3.0")
def pairs_metric(spark, sf):
    """A user's metric: the sum of the differences."""
    a, b = part(spark, sf), suppliers(spark, sf)
    city = F.abs(F.col("a_x0") - F.col("b_x0")) + F.abs(F.col("a_x1") - F.col("b_x1"))
    found = within(a, b, 3.0, metric=city * city).select(F.col("a_id").alias("i"), F.col("b_id").alias("j"), (F.col("a_x0") - F.col("b_x0")).alias("dx"), (F.col("a_x1") - F.col("b_x1")).alias("dy"))
    return found.select("i", "j", F.sqrt(F.abs("dx") * F.abs("dx") + F.abs("dy") * F.abs("dy")).alias("r"))


@query(f"SELECT CAST(i % 10 AS BIGINT) AS k, count(*) AS n FROM {_pairs(PART, PART, 0.6)} GROUP BY 1")
def pairs_processed(spark, sf):
    """A consumer of batches of pairs, whose partial results are then summed."""
    tally = process(enum(part(spark, sf), part(spark, sf), 0.6), lambda b: (b["i"] % 10).value_counts().rename_axis("k").reset_index(name="n"), "k long, n long", bunch=1000)
    return tally.groupBy("k").agg(F.sum("n").alias("n"))


@query(f"SELECT i, j, r FROM {_pairs(SUPPLIERS, SUPPLIERS, 30.0)}")
def pairs_theta(spark, sf):
    """A radius as large as the space, by the nested loop."""
    return enum(suppliers(spark, sf), suppliers(spark, sf), 30.0, strategy="theta")


@query(f"SELECT count(*) AS pairs FROM {_pairs(PART, SUPPLIERS, 2.5)}")
def pairs_observed(spark, sf):
    """The counter of pairs, read after a run over them."""
    seen = Observation()
    enum(part(spark, sf), suppliers(spark, sf), 2.5, observe=seen).write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([(seen.get["pairs"],)], "pairs long")


@query(f"SELECT i, j, r FROM {_pairs(SUPPLIERS, SUPPLIERS, 4.0)}")
def pairs_iterated(spark, sf):
    """Pairs one by one on the driver, which keeps none of them."""
    return spooled(spark, iterate(enum(suppliers(spark, sf), suppliers(spark, sf), 4.0), plain=True), "i long, j long, r double")


@query("""WITH e AS (SELECT vec_id AS id, embedding FROM embeddings),
p AS (SELECT a.id AS i, b.id AS j, list_sum(list_transform(range(1, 65), lambda k: (CAST(a.embedding[k] AS DOUBLE) - b.embedding[k]) * (CAST(a.embedding[k] AS DOUBLE) - b.embedding[k]))) AS r2 FROM e a JOIN e b ON a.id < b.id)
SELECT i, j, round(sqrt(r2), 6) AS r FROM p WHERE r2 <= CAST('1.2100000000000002' AS DOUBLE)""")
def embedding_neighbours(spark, sf):
    points = PointSet.of(spark.read.parquet(f"{sf}/embeddings.parquet"), "vec_id", "embedding", dims=64)
    return enum_distinct(points, 1.1).select("i", "j", F.round("r", 6).alias("r"))


# ---- counts by distance ----

EDGES = [0.0, 0.5, 1.0, 2.0, 5.0]


def _counted(a: str, b: str, edges: list[float], box: tuple | None = None) -> str:
    place = " + ".join(f"CAST(r > {_d(e)} AS INTEGER)" for e in edges)
    table = ", ".join(f"({k}, {_d(e)})" for k, e in enumerate(edges))
    return f"""WITH p AS {_pairs(a, b, edges[-1], box=box, more=W)}, s AS (SELECT {place} AS bin, count(*) AS n, sum(w1 * w2) AS w FROM p GROUP BY 1), e(bin, edge) AS (VALUES {table})
SELECT CAST(e.bin AS INTEGER) AS bin, edge, coalesce(n, 0) AS count, coalesce(w, 0) AS weight0 FROM e LEFT JOIN s ON e.bin = s.bin"""


@query(_counted(PART, PART, EDGES))
def count_weighted(spark, sf):
    return count(part(spark, sf), part(spark, sf), EDGES, weighted=True)


@query(_counted(PART, PART, EDGES).replace("edge, coalesce(n, 0) AS count, coalesce(w, 0) AS weight0", "edge, coalesce(n, 0) AS count"))
def count_edges(spark, sf):
    return count(part(spark, sf), part(spark, sf), EDGES, by_cells=False)


@query(_counted(PART_BOX, PART_BOX, EDGES, box=(50, 100)))
def count_periodic(spark, sf):
    return count(part_box(spark, sf), part_box(spark, sf), EDGES, weighted=True)


@query("""WITH l AS (SELECT l_quantity AS x, round(l_discount * 100) AS y, round(l_tax * 100) AS z, count(*) AS n FROM lineitem GROUP BY 1, 2, 3),
p AS (SELECT sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) AS r, a.n * b.n AS n FROM l a JOIN l b ON abs(a.x - b.x) <= 3 AND abs(a.y - b.y) <= 3 AND abs(a.z - b.z) <= 3),
e(bin, edge) AS (VALUES (0, CAST(0 AS DOUBLE)), (1, CAST(1 AS DOUBLE)), (2, CAST(2 AS DOUBLE)), (3, CAST(3 AS DOUBLE)))
SELECT CAST(bin AS INTEGER) AS bin, edge, CAST(coalesce(sum(n), 0) AS BIGINT) AS count FROM e LEFT JOIN (SELECT CAST(ceil(r) AS INTEGER) AS b, n FROM p WHERE r <= 3) ON b = bin GROUP BY ALL""")
def lattice_count(spark, sf):
    """Points on a lattice become one for each place first."""
    points = collapsed(lattice(spark, sf))
    return count(points, points, [0.0, 1.0, 2.0, 3.0])


@query(f"""SELECT CAST(floor(x / 5) AS BIGINT) AS c0, CAST(floor(y / 5) AS BIGINT) AS c1, count(*) AS n, sum(w) AS w0, min(x) AS x0_min, max(x) AS x0_max, min(y) AS x1_min, max(y) AS x1_max FROM {PART} GROUP BY 1, 2""")
def cell_summary(spark, sf):
    return cell_sums(part(spark, sf), 5.0)


@query(f"""SELECT c0, c1, CAST(floor(k / 16) AS BIGINT) AS chunk, count(*) AS n FROM (SELECT CAST(floor(x / 5) AS BIGINT) AS c0, CAST(floor(y / 5) AS BIGINT) AS c1, row_number() OVER (PARTITION BY floor(x / 5), floor(y / 5) ORDER BY x, y, id) - 1 AS k FROM {PART}) GROUP BY ALL""")
def forest_chunks(spark, sf):
    return make_forest(part(spark, sf), 16, 5.0).groupBy("c0", "c1", "chunk").agg(F.count("*").alias("n"))


# ---- binned pair sums ----

R = RBinning(np.linspace(0, 5, 11))
R_LOG = RBinning(np.logspace(-1, 0.6, 9))
R_ODD = RBinning([0.05, 0.35, 1.05, 2.25, 4.45])


@query(_binned(_pairs(PART, PART, 5, more=W), [(R.axes[0], "r")], SUMS))
def paircount_r(spark, sf):
    return paircount(part(spark, sf), part(spark, sf), R)


@query(_binned(_pairs(PART, PART, R_LOG.rmax, more=W), [(R_LOG.axes[0], "r")], SUMS))
def paircount_r_log(spark, sf):
    return paircount(part(spark, sf), part(spark, sf), R_LOG)


@query(_binned(_pairs(PART, PART, R_ODD.rmax, more=W), [(R_ODD.axes[0], "r")], SUMS))
def paircount_r_irregular(spark, sf):
    return paircount(part(spark, sf), part(spark, sf), R_ODD)


@query(_binned(_pairs(PART_BOX, PART_BOX, 5, box=(50, 100), more=W), [(R.axes[0], "r")], SUMS))
def paircount_r_periodic(spark, sf):
    return paircount(part_box(spark, sf), part_box(spark, sf), R)


@query(f"""WITH p AS {_pairs(PART, PART, 5, more=W)}, s AS (SELECT {" + ".join(f"CAST(r > {_d(e)} AS INTEGER)" for e in R.axes[0].edges)} AS bin0, count(*) AS n, sum(w1 * w2) AS w FROM p GROUP BY 1)
SELECT CAST(b AS INTEGER) AS bin0, coalesce(w, 0) AS sum1, coalesce(n, 0) AS npairs FROM (SELECT unnest(range(0, 12)) AS b) LEFT JOIN s ON bin0 = b""")
def cellcount_fast(spark, sf):
    return paircount(part(spark, sf), part(spark, sf), FastRBinning(np.linspace(0, 5, 11)))


RMU = RmuBinning(np.linspace(0, 3, 7), 4, observer=(-10.0, 880.0))
_C = f"((x1 + x2) * {_d(0.5)} - {_d(-10)}), ((y1 + y2) * {_d(0.5)} - {_d(880)})".split(", ")
_DOT, _LEN = f"((x1 - x2) * {_C[0]} + (y1 - y2) * {_C[1]})", f"sqrt({_C[0]} * {_C[0]} + {_C[1]} * {_C[1]})"


@query(_binned(_pairs(PART, PART, 3, more=W), [(RMU.axes[0], "r"), (RMU.axes[1], f"(CASE WHEN r * {_LEN} = 0 THEN 10 ELSE {_DOT} / (r * {_LEN}) END)")], SUMS))
def paircount_rmu(spark, sf):
    return paircount(part(spark, sf), part(spark, sf), RMU)


class AcrossAlong(Binning):
    """A user's scheme: the difference across, by uneven edges, and the signed one along."""

    axes = (Axis("across", [0.0, 0.5, 1.5, 3.0]), Axis("along", [-3.0, -1.0, 0.25, 3.0]))

    def coordinates(self, dim, box):
        a, b = pair_columns(dim)
        return [F.abs(a[0] - b[0]), a[1] - b[1]]


USER = AcrossAlong()


@query(_binned(_pairs(PART, PART, 3, more=W), [(USER.axes[0], "abs(x1 - x2)"), (USER.axes[1], "(y1 - y2)")], SUMS))
def paircount_user_binning(spark, sf):
    return paircount(part(spark, sf), part(spark, sf), USER)


XY = XYBinning(3.0, 5, observer=(-10.0, 880.0))
_LOS = f"({_DOT} / {_LEN})"


@query(_binned(_pairs(PART, PART, 3, more=W), [(XY.axes[0], f"sqrt(abs((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2) - {_LOS} * {_LOS}))"), (XY.axes[1], _LOS)], SUMS))
def paircount_xy(spark, sf):
    return paircount(part(spark, sf), part(spark, sf), XY)


FLAT = FlatSkyBinning(np.linspace(0, 3, 7), 3, los=1, mu_min=0, mu_max=1, absmu=True)
_PAR = f"(CASE WHEN y1 - y2 > {_d(50)} THEN y1 - y2 - {_d(100)} WHEN y1 - y2 <= {_d(-50)} THEN y1 - y2 + {_d(100)} ELSE y1 - y2 END)"


@query(_binned(_pairs(PART_BOX, PART_BOX, 3, box=(50, 100), more=W), [(FLAT.axes[0], "r"), (FLAT.axes[1], f"(CASE WHEN r = 0 THEN 10 ELSE abs({_PAR} / r) END)")], SUMS))
def paircount_flatsky(spark, sf):
    return paircount(part_box(spark, sf), part_box(spark, sf), FLAT)


def _multipoles(pairs: str, axis: Axis, mu: str) -> str:
    one = f"SELECT {{n}} AS ell, bin0, round(sum(w1 * w2 * ({{f}})), 3) + 0.0 AS sum1, count(*) AS npairs FROM m GROUP BY bin0"
    parts = " UNION ALL ".join([one.format(n=0, f="1"), one.format(n=1, f="3 * mu"), one.format(n=2, f="2.5 * (3 * mu * mu - 1)")])
    return f"""WITH p AS {pairs}, m AS (SELECT *, {_index(axis, "r")} AS bin0, {mu} AS mu FROM p), s AS ({parts})
SELECT b.bin0, CAST(e.ell AS INTEGER) AS ell, coalesce(sum1, 0) AS sum1, coalesce(npairs, 0) AS npairs FROM (SELECT CAST(unnest(range(0, {axis.n + 2})) AS INTEGER) AS bin0) b CROSS JOIN (VALUES (0), (1), (2)) e(ell) LEFT JOIN s ON s.bin0 = b.bin0 AND s.ell = e.ell"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("sum1", F.round("sum1", 3) + 0.0)


MULTI = MultipoleBinning(np.linspace(0, 3, 7), [0, 1, 2])
_LEN0 = f"sqrt(((x1 + x2) * {_d(0.5)}) * ((x1 + x2) * {_d(0.5)}) + ((y1 + y2) * {_d(0.5)}) * ((y1 + y2) * {_d(0.5)}))"
_DOT0 = f"((x1 - x2) * ((x1 + x2) * {_d(0.5)}) + (y1 - y2) * ((y1 + y2) * {_d(0.5)}))"


@query(_multipoles(_pairs(PART, SUPPLIERS, 3, more=W), MULTI.axes[0], f"(CASE WHEN r * {_LEN0} <> 0 THEN {_DOT0} / (r * {_LEN0}) END)"))
def multipole(spark, sf):
    return _rounded(paircount(part(spark, sf), suppliers(spark, sf), MULTI))


MULTI_FLAT = FlatSkyMultipoleBinning(np.linspace(0, 3, 7), [0, 1, 2], los=1)


@query(_multipoles(_pairs(PART_BOX, PART_BOX, 3, box=(50, 100), more=W), MULTI_FLAT.axes[0], f"(CASE WHEN r <> 0 THEN {_PAR} / r END)"))
def multipole_flatsky(spark, sf):
    return _rounded(paircount(part_box(spark, sf), part_box(spark, sf), MULTI_FLAT))


@query(_binned(_pairs(PART, PART, 5, more=W + ", a.v AS v1, b.v AS v2"), [(R.axes[0], "r")], {"sum1": "sum(w1 * v1 * (w2 * v2))", "sum2": "sum(w1 * w2)", "npairs": "count(*)"}))
def paircount_field(spark, sf):
    return paircount(part_field(spark, sf), part_field(spark, sf), R)


@query(_binned(_pairs(PART, PART, 5, more=W), [(R.axes[0], "r")], {"sum1": "sum(w1 * w2)", "npairs": "count(*)", "mean0": "round(avg(r), 9)"}))
def paircount_mean_coords(spark, sf):
    return paircount(part(spark, sf), part(spark, sf), R, mean_coords=True).withColumn("mean0", F.round("mean0", 9))


@query(f"SELECT sum(w) * sum(w) AS weight FROM {PART}")
def pair_weight(spark, sf):
    return norms(part(spark, sf), part(spark, sf))


# ---- boxes ----


@query("SELECT count(*) AS count, coalesce(sum(CAST(p_size AS DOUBLE)), 0) AS weight0 FROM part WHERE p_size >= 10 AND p_size < 20 AND p_retailprice >= 920 AND p_retailprice < 950")
def integrate_box(spark, sf):
    return integrate(part(spark, sf), [10, 920], [20, 950])


BOXES = "(SELECT s_suppkey AS id, CAST(s_suppkey % 40 AS DOUBLE) AS l0, CAST(900 + s_suppkey % 60 AS DOUBLE) AS l1, CAST(s_suppkey % 40 + 10 AS DOUBLE) AS h0, CAST(925 + s_suppkey % 60 AS DOUBLE) AS h1 FROM supplier)"


@query(f"SELECT b.id AS box_id, count(p.id) AS count, coalesce(sum(p.w), 0) AS weight0 FROM {BOXES} b LEFT JOIN {PART} p ON x >= l0 AND x < h0 AND y >= l1 AND y < h1 GROUP BY 1")
def integrate_boxes(spark, sf):
    k = F.col("s_suppkey")
    boxes = spark.read.parquet(f"{sf}/supplier.parquet").select(k.alias("box_id"), (k % 40).cast("double").alias("l0"), (k % 60 + 900).cast("double").alias("l1"), (k % 40 + 10).cast("double").alias("h0"), (k % 60 + 925).cast("double").alias("h1"))
    return integrate_many(part(spark, sf), boxes, "box_id", ["l0", "l1"], ["h0", "h1"])


@query("WITH q AS (SELECT l_quantity AS q, count(*) AS n FROM lineitem GROUP BY 1) SELECT q, CAST(coalesce(sum(n) OVER (ORDER BY q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS count FROM q")
def integrate_below(spark, sf):
    """Points of a lattice below each of its first coordinates, by boxes open to one side."""
    points = lattice(spark, sf)
    boxes = points.df.select("x0").distinct().select(F.col("x0").cast("long").alias("q"), *[F.lit(-math.inf).alias(f"l{k}") for k in range(3)], F.col("x0").alias("h0"), F.lit(math.inf).alias("h1"), F.lit(math.inf).alias("h2"))
    found = integrate_many(points, boxes, "q", ["l0", "l1", "l2"], ["h0", "h1", "h2"])
    return found.select(F.col("q").cast("double").alias("q"), "count")


# ---- friends of friends ----

LL = 0.6
_LABELS = f"""WITH RECURSIVE e AS (SELECT i, j FROM {_pairs(PART, PART, LL)}),
w(id, seen) AS (SELECT id, id FROM {PART} UNION SELECT w.id, e.j FROM w JOIN e ON w.seen = e.i),
l AS (SELECT id, min(seen) AS label FROM w GROUP BY id)"""
_GROUPS = f"""{_LABELS}, g AS (SELECT label AS root, count(*) AS length FROM l GROUP BY 1),
n AS (SELECT row_number() OVER (ORDER BY length DESC, root) - 1 AS label, root, length, CAST(sum(length) OVER (ORDER BY length DESC, root) - length AS BIGINT) AS "offset" FROM g)"""


@query(f"{_LABELS} SELECT id, label FROM l")
def fof_part_labels(spark, sf):
    return fof_labels(part(spark, sf), LL)


@query(f"{_LABELS.replace(PART, PART_BOX)} SELECT id, label FROM l".replace(_pairs(PART_BOX, PART_BOX, LL), _pairs(PART_BOX, PART_BOX, LL, box=(50, 100))))
def fof_periodic_labels(spark, sf):
    return fof_labels(part_box(spark, sf), LL, strategy="labels")


@query(f"{_LABELS.replace(PART, PART[:-1] + ' WHERE p_partkey % 2 = 0)')} SELECT p_partkey AS id, coalesce(label, p_partkey) AS label FROM part LEFT JOIN l ON id = p_partkey")
def fof_subset(spark, sf):
    points = part(spark, sf)
    return fof_labels(points, LL, active=points.where("id % 2 = 0").df.select("id"))


@query(f"{_GROUPS} SELECT label, root, length, \"offset\" FROM n")
def fof_catalogue(spark, sf):
    return fof(part(spark, sf), LL).groups


@query(f"{_GROUPS} SELECT l.id FROM l JOIN n ON l.label = n.root WHERE n.label = 3")
def fof_find(spark, sf):
    return fof(part(spark, sf), LL).find(3)


@query(f"{_GROUPS} SELECT n.label, sum(w) AS sum FROM l JOIN n ON l.label = n.root JOIN {PART} p ON p.id = l.id GROUP BY 1")
def fof_sum(spark, sf):
    return fof(part(spark, sf), LL).sum()


@query(f"{_GROUPS} SELECT n.label, round(sum(w * x) / sum(w), 6) AS x0, round(sum(w * y) / sum(w), 6) AS x1 FROM l JOIN n ON l.label = n.root JOIN {PART} p ON p.id = l.id GROUP BY 1")
def fof_center(spark, sf):
    return fof(part(spark, sf), LL).center().select("label", F.round("x0", 6).alias("x0"), F.round("x1", 6).alias("x1"))


@query(f"{_GROUPS} SELECT \"offset\" + row_number() OVER (PARTITION BY n.label ORDER BY l.id) - 1 AS position, l.id FROM l JOIN n ON l.label = n.root")
def fof_indices(spark, sf):
    return fof(part(spark, sf), LL).indices()


@query("""WITH e AS (SELECT event_id, user_id, epoch(ts) AS x, lag(epoch(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events),
r AS (SELECT event_id, user_id, sum(CAST(b IS NULL OR (x - b) * (x - b) > 466560000 AS INTEGER)) OVER (PARTITION BY user_id ORDER BY x, event_id) AS run FROM e)
SELECT event_id AS id, min(event_id) OVER (PARTITION BY user_id, run) AS label FROM r""")
def fof_events_1d(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "user_id", F.col("ts").cast("timestamp").cast("double").alias("x"))
    return fof_runs(events, ["user_id"], "x", 21600.0, "event_id")


@query()
def components_of_lines(spark, sf):
    """The components of all orders and suppliers of lineitem, by rounds of joins; suppliers have negative ids. Tests hold it against union-find."""
    lines = spark.read.parquet(f"{sf}/lineitem.parquet")
    return connected_components(lines.select(F.col("l_orderkey").alias("a"), (-1 - F.col("l_suppkey")).alias("b")), "labels")


# ---- kernel sums ----


@query(f"SELECT t.id, coalesce(f, 0) AS f0, coalesce(f, 0) AS f1 FROM {SUPPLIERS} t LEFT JOIN (SELECT i, sum(w2) AS f FROM {_pairs(SUPPLIERS, PART, 4, more=W)} GROUP BY 1) ON i = t.id")
def force_count(spark, sf):
    return force(suppliers(spark, sf), part(spark, sf), count_kernel(), 4.0)


@query(f"SELECT t.id, round(coalesce(f0, 0), 6) AS f0, round(coalesce(f1, 0), 6) AS f1 FROM {SUPPLIERS} t LEFT JOIN (SELECT i, sum(w2 * CASE WHEN r > 0 THEN (x2 - x1) / ((r * r + 0.25) * sqrt(r * r + 0.25)) ELSE 0 END) AS f0, sum(w2 * CASE WHEN r > 0 THEN (y2 - y1) / ((r * r + 0.25) * sqrt(r * r + 0.25)) ELSE 0 END) AS f1 FROM {_pairs(SUPPLIERS, PART, 4, more=W)} GROUP BY 1) ON i = t.id")
def force_plummer(spark, sf):
    found = force(suppliers(spark, sf), part(spark, sf), plummer_kernel(0.5), 4.0)
    return found.select("id", F.round("f0", 6).alias("f0"), F.round("f1", 6).alias("f1"))


@query(f"SELECT t.id, coalesce(f, 0) AS f0, coalesce(f, 0) AS f1 FROM {SUPPLIERS} t LEFT JOIN (SELECT i, sum(w2) AS f FROM {_pairs(SUPPLIERS, PART, 4, more=W)} GROUP BY 1) ON i = t.id")
def force_opening_angle(spark, sf):
    """With an opening angle cells act as one mass; the mass within a radius is the same."""
    return force(suppliers(spark, sf), part(spark, sf), KERNELS["count"](), 4.0, eta=1.0)


@query(f"SELECT t.id, round(coalesce(f, 0), 6) AS f0, round(coalesce(g, 0), 6) AS f1 FROM {SUPPLIERS} t LEFT JOIN (SELECT i, sum(w2 / (1 + r)) AS f, sum(w2 * (y2 - y1)) AS g FROM {_pairs(SUPPLIERS, PART, 4, more=W)} GROUP BY 1) ON i = t.id")
def force_user_kernel(spark, sf):
    found = force(suppliers(spark, sf), part(spark, sf), lambda r, dx: [1 / (1 + r), dx[1]], 4.0)
    return found.select("id", F.round("f0", 6).alias("f0"), F.round("f1", 6).alias("f1"))


# ---- resampling ----

DRAWN = {0: 2, 3: 1, 5: 3}
STRAPS = Policy("id % 8")
_CACHE = f"SELECT CAST(i % 8 AS INTEGER) AS s0, CAST(j % 8 AS INTEGER) AS s1, {_index(R.axes[0], 'r')} AS bin0, sum(w1 * w2) AS value FROM {_pairs(PART, PART, 5, more=W)} GROUP BY 1, 2, 3"


@query("SELECT CAST(p_partkey % 8 AS INTEGER) AS strap, count(*) AS size FROM part GROUP BY 1")
def strap_sizes(spark, sf):
    return STRAPS.sizes(part(spark, sf))


@query(_CACHE)
def strap_cache(spark, sf):
    return STRAPS.run_paircount(part(spark, sf), part(spark, sf), R)


@query(f"WITH c AS ({_CACHE}), m(s, m) AS (VALUES (0, 2), (3, 1), (5, 3)) SELECT bin0, sum(value * a.m * b.m) AS value FROM c JOIN m a ON s0 = a.s JOIN m b ON s1 = b.s GROUP BY 1")
def strap_resample(spark, sf):
    return resample(STRAPS.run_paircount(part(spark, sf), part(spark, sf), R), DRAWN, ["bin0"])


@query("WITH v AS (SELECT CAST(p_partkey % 8 AS INTEGER) AS s, sum(CAST(p_size AS DOUBLE)) AS v FROM part GROUP BY 1) SELECT a.s AS s0, b.s AS s1, a.v * b.v AS value FROM v a CROSS JOIN v b")
def strap_products(spark, sf):
    return STRAPS.run_sums([part(spark, sf), part(spark, sf)], F.col("w0"))


@query(f"WITH c AS (SELECT CAST(i % 3 AS INTEGER) AS s0, CAST(j % 3 AS INTEGER) AS s1, CAST(CAST(r > 0.5 AS INTEGER) + CAST(r > 1 AS INTEGER) AS INTEGER) AS bin, count(*) AS n FROM {_pairs(PART, PART, 2)} GROUP BY 1, 2, 3), e(bin, edge) AS (VALUES (0, {_d(0.5)}), (1, {_d(1)}), (2, {_d(2)})), s AS (SELECT DISTINCT s0, s1 FROM c) SELECT s0, s1, CAST(e.bin AS INTEGER) AS bin, edge, coalesce(n, 0) AS count FROM s CROSS JOIN e LEFT JOIN c USING (s0, s1, bin)")
def strap_run(spark, sf):
    """Any estimator over every combination of straps."""
    return Policy("id % 3").run(lambda a, b: count(a, b, [0.5, 1.0, 2.0], by_cells=False), part(spark, sf), part(spark, sf))


@query("SELECT CAST(p_partkey % 5 AS INTEGER) AS strap, count(*) AS n, sum(CAST(p_size AS DOUBLE)) AS w0 FROM part GROUP BY 1")
def strap_subsamples(spark, sf):
    straps = Policy("id % 5").create_straps(part(spark, sf))
    return reduce(DataFrame.unionByName, [p.sums().select(F.lit(s).alias("strap"), "n", "w0") for s, p in straps.items()])


@query()
def strap_bootstrap(spark, sf):
    """A seeded draw of straps."""
    return spark.createDataFrame(sorted(STRAPS.bootstrap(part(spark, sf), seed=7).items()), "strap int, times int")


# ---- estimators ----

_DD, _RR = PART[:-1] + " WHERE p_size <= 25)", PART[:-1] + " WHERE p_size > 25)"


def _xi(formula: str, *names: str) -> str:
    sides = {"dd": (_DD, _DD), "dr": (_DD, _RR), "rr": (_RR, _RR)}
    ctes = ", ".join(f"{n}_p AS {_pairs(*sides[n], 5)}, {n} AS (SELECT {_index(R.axes[0], 'r')} AS bin0, count(*) AS {n} FROM {n}_p GROUP BY 1)" for n in names)
    joins = " ".join(f"LEFT JOIN {n} USING (bin0)" for n in names)
    values = ", ".join(f"CAST(coalesce({n}, 0) AS DOUBLE) AS {n}" for n in names)
    return f"WITH {ctes}, b AS (SELECT bin0, {values} FROM (SELECT CAST(unnest(range(1, 11)) AS INTEGER) AS bin0) {joins}) SELECT bin0, round({formula}, 9) AS xi FROM b"


def _halves(spark, sf):
    df = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", "p_size", F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"))
    points = PointSet.of(df, "p_partkey", ["x", "y"], extra=("p_size",))
    return points.where("p_size <= 25"), points.where("p_size > 25")


def _xi_rounded(df: DataFrame) -> DataFrame:
    return df.select("bin0", F.round("xi", 9).alias("xi"))


@query(_xi("CASE WHEN rr = 0 THEN NULL ELSE dd / rr - 1 END", "dd", "rr"))
def dd_rr(spark, sf):
    d, r = _halves(spark, sf)
    return _xi_rounded(estimators.natural(paircount(d, d, R, full=False), paircount(r, r, R, full=False)))


@query(_xi("CASE WHEN dr = 0 THEN NULL ELSE dd / dr - 1 END", "dd", "dr"))
def dd_dr(spark, sf):
    d, r = _halves(spark, sf)
    return _xi_rounded(estimators.davis_peebles(paircount(d, d, R, full=False), paircount(d, r, R, full=False)))


@query(_xi("CASE WHEN rr = 0 THEN NULL ELSE (dd - 2 * 0.5 * dr + 0.25 * rr) / (0.25 * rr) END", "dd", "dr", "rr"))
def landy_szalay(spark, sf):
    d, r = _halves(spark, sf)
    return _xi_rounded(estimators.landy_szalay(*(paircount(x, y, R, full=False) for x, y in ((d, d), (d, r), (r, r))), ratio=0.5))


@query(f"WITH p AS {_pairs(PART, PART, 5, more=W + ', a.v AS v1, b.v AS v2')}, b AS (SELECT CAST(unnest(range(0, 12)) AS INTEGER) AS bin0) SELECT bin0, round(sum(w1 * v1 * (w2 * v2)) / sum(w1 * w2), 9) AS xi FROM b LEFT JOIN (SELECT *, {_index(R.axes[0], 'r')} AS k FROM p) ON k = bin0 GROUP BY 1")
def field_correlation(spark, sf):
    return _xi_rounded(estimators.field_mean(paircount(part_field(spark, sf), part_field(spark, sf), R)))


@query("SELECT CAST(bin AS INTEGER) AS bin, round((bin * bin * bin - (bin - 1) * (bin - 1) * (bin - 1)) * 4 * pi() / 3 * 1000, 6) AS rr FROM (SELECT unnest(range(1, 6)) AS bin)")
def analytic_rr(spark, sf):
    shells = spark.range(1, 6).select(F.col("id").cast("int").alias("bin"), (F.col("id") - 1.0).alias("low"), F.col("id").cast("double").alias("high"))
    return estimators.analytic_rr(shells, 1000.0, 1000.0).select("bin", F.round("rr", 6).alias("rr"))


# ---- the sky ----

NSIDE = 16


@query(f"SELECT id, round(x, 9) + 0.0 AS x0, round(y, 9) + 0.0 AS x1, round(z, 9) + 0.0 AS x2 FROM {SKY3}")
def sky_unitvec(spark, sf):
    return customer_sky(spark, sf).df.select("id", *[(F.round(f"x{k}", 9) + 0.0).alias(f"x{k}") for k in range(3)])


@query(f"""WITH a AS (SELECT id, cos(radians(90 - dec)) AS z, sin(radians(90 - dec)) AS s, (radians(ra) / {_d(math.pi / 2)}) % 4 AS t FROM {SKY}),
b AS (SELECT *, floor({NSIDE} * (t + 0.5) - z * {0.75 * NSIDE}) AS u, floor({NSIDE} * (t + 0.5) + z * {0.75 * NSIDE}) AS v,
  CASE WHEN abs(z) > 0.99 THEN {NSIDE} * s / sqrt((1 + abs(z)) / 3) ELSE {NSIDE} * sqrt(3 * (1 - abs(z))) END AS c FROM a),
d AS (SELECT *, {NSIDE} + 1 + u - v AS ring, floor((t - floor(t)) * c) + floor((1 - (t - floor(t))) * c) + 1 AS i FROM b)
SELECT id, CAST(CASE WHEN z > -2.0 / 3 AND z < 2.0 / 3 THEN {2 * NSIDE * (NSIDE - 1)} + {4 * NSIDE} * (ring - 1) + floor((u + v - {NSIDE} + (1 - ring % 2) + 1) / 2) % {4 * NSIDE}
  WHEN z > 0 THEN 2 * i * (i - 1) + floor(t * i) % (4 * i) ELSE {12 * NSIDE * NSIDE} - 2 * i * (i + 1) + floor(t * i) % (4 * i) END AS BIGINT) AS pix FROM d""")
def healpix_ang2pix(spark, sf):
    return customers(spark, sf).select(F.col("c_custkey").alias("id"), sky.radec2pix(NSIDE, F.col("ra"), F.col("dec")).alias("pix"))


@query(f"""WITH p AS (SELECT DISTINCT CAST(c_custkey % {12 * NSIDE * NSIDE} AS BIGINT) AS pix FROM customer), q AS (SELECT *, {2 * NSIDE * (NSIDE - 1)} AS cap, {12 * NSIDE * NSIDE} AS n FROM p),
a AS (SELECT pix, cap, n, CASE WHEN pix < cap THEN floor((1 + floor(sqrt(1 + 2 * pix))) / 2) WHEN pix < n - cap THEN floor((pix - cap) / {4 * NSIDE}) + {NSIDE} ELSE floor((1 + floor(sqrt(2 * (n - pix) - 1))) / 2) END AS i FROM q),
b AS (SELECT *, CASE WHEN pix < cap THEN pix + 1 - 2 * i * (i - 1) WHEN pix < n - cap THEN (pix - cap) % {4 * NSIDE} + 1 ELSE 4 * i + 1 - (n - pix - 2 * i * (i - 1)) END AS k FROM a)
SELECT pix, round(degrees(CASE WHEN pix < cap OR pix >= n - cap THEN (k - 0.5) * pi() / 2 / i ELSE (k - 0.5 * ((i + {NSIDE}) % 2 + 1)) * pi() / 2 / {NSIDE} END), 6) AS ra,
  round(90 - degrees(acos(CASE WHEN pix < cap THEN 1 - 4 * i * i / n WHEN pix < n - cap THEN {8 * NSIDE} * ({2 * NSIDE} - i) / n ELSE -1 + 4 * i * i / n END)), 6) AS dec FROM b""")
def healpix_pix2ang(spark, sf):
    pix = spark.read.parquet(f"{sf}/customer.parquet").select((F.col("c_custkey") % sky.nside2npix(NSIDE)).cast("long").alias("pix")).distinct()
    ra, dec = sky.pix2radec(NSIDE, F.col("pix"))
    return pix.select("pix", F.round(ra, 6).alias("ra"), F.round(dec, 6).alias("dec"))


ANGLES = AngularBinning([0.13, 0.71, 1.37, 2.93], spacing="irregular")
_ANGLE_PAIRS = _pairs(SKY3, SKY3, ANGLES.rmax, axes="xyz", more=", 1 AS w1, 1 AS w2")


@query(_binned(_ANGLE_PAIRS, [(ANGLES.axes[0], "r")], {"sum1": "CAST(sum(w1 * w2) AS DOUBLE)", "npairs": "count(*)", "mean0": "round(degrees(avg(2 * asin(r / 2))), 6)"}))
def angular_paircount(spark, sf):
    return paircount(customer_sky(spark, sf), customer_sky(spark, sf), ANGLES, mean_coords=True).withColumn("mean0", F.round("mean0", 6))


@query(f"""WITH p AS {_ANGLE_PAIRS}, s AS (SELECT {" + ".join(f"CAST(r > {_d(e)} AS INTEGER)" for e in ANGLES.axes[0].edges)} AS k, count(*) AS n FROM p GROUP BY 1)
SELECT CAST(b AS INTEGER) AS bin0, CAST(coalesce(n, 0) AS DOUBLE) AS sum1, coalesce(n, 0) AS npairs FROM (SELECT unnest(range(0, {ANGLES.axes[0].n + 2})) AS b) LEFT JOIN s ON k = b""")
def angular_paircount_fast(spark, sf):
    return paircount(customer_sky(spark, sf), customer_sky(spark, sf), FastAngularBinning([0.13, 0.71, 1.37, 2.93], spacing="irregular"))


@query()
def sky_region_sizes(spark, sf):
    """Rows and area of each region of about the area of a pixel."""
    regions = sky_regions(customers(spark, sf), 4, density=1.0)
    return in_regions(customers(spark, sf), regions, 4).groupBy("region").agg(F.count("*").alias("n"), F.first("area").alias("area"))


# ---- streams ----


@query(_counted(PART, PART, EDGES))
def streamed_count(spark, sf):
    """count_weighted, kept up to date over micro-batches of a stream of points."""
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    table = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"), F.col("p_size").cast("double").alias("w"))
    table.repartition(3, "p_partkey").write.parquet(f"{folder}/in")
    counter = IncrementalPairCount(spark, f"{folder}/state", EDGES, "p_partkey", ["x", "y"], "w")
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    counter.start(stream, f"{folder}/log").awaitTermination()
    return counter.counts()


# ---- sources ----


@query("SELECT CAST(count(*) AS BIGINT) AS n, sum(s_acctbal) IS NOT NULL AS known FROM supplier")
def stored_points(spark, sf):
    points = read_points(spark, f"{sf}/supplier.parquet", "s_suppkey", ["s_acctbal"])
    return points.df.agg(F.count("*").alias("n"), F.sum("x0").isNotNull().alias("known"))
