"""Distance joins, counts and boxes against NumPy."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from pairfield.operators import boxes, counts
from pairfield.operators import paircount as operators_paircount
from pairfield.operators import pairs as operators_pairs
from pairfield.operators.binning import FastRBinning, RBinning, RmuBinning
from pairfield.operators.boxes import integrate, integrate_many
from pairfield.operators.counts import collapsed, count
from pairfield.operators.force import count_kernel, force, plummer_kernel
from pairfield.operators.forest import make_forest
from pairfield.operators.paircount import paircount
from pairfield.operators.pairs import enum, enum_distinct, iterate, process, spooled
from pairfield.plans import epsjoin
from pairfield.sources.points import FieldSet, PointSet


def points(spark, x, box=None, w=None, **more):
    x = np.asarray(x, float)
    x = x if x.ndim == 2 else x[:, None]
    df = pd.DataFrame({"id": np.arange(len(x)), **{f"p{k}": x[:, k] for k in range(x.shape[1])}, "w": np.ones(len(x)) if w is None else w, **more})
    schema = "id long, " + ", ".join(f"{c} double" for c in df.columns[1:])
    return PointSet.of(spark.createDataFrame(df, schema), "id", [f"p{k}" for k in range(x.shape[1])], "w", boxsize=box, value="v" if "v" in more else None)


def distances(a, b, box=None):
    d = np.abs(a[:, None, :] - b[None, :, :])
    if box:
        d = np.where(d > box / 2, box - d, d)
    return np.sqrt((d * d).sum(axis=-1))


@pytest.mark.parametrize("box", [None, 1.0])
@pytest.mark.parametrize("rmax", [0.0, 0.01, 0.1, 0.3, 0.34, 0.5, 0.7])
def test_grid_join_is_brute_force(spark, box, rmax):
    x = np.random.default_rng(3).random((150, 2))
    p = points(spark, x, box)
    found = enum(p, p, rmax).toPandas()
    true = distances(x, x, box) <= rmax
    assert set(zip(found.i, found.j)) == set(zip(*np.nonzero(true))) and len(found) == true.sum()


def test_theta_and_grid_agree_and_self_pairs_count(spark):
    x = np.random.default_rng(5).random((80, 3))
    p = points(spark, x)
    grid, theta = (enum(p, p, 0.2, strategy=s).toPandas() for s in ("grid", "theta"))
    assert sorted(zip(grid.i, grid.j, grid.r)) == sorted(zip(theta.i, theta.j, theta.r))
    assert (grid[grid.i == grid.j].r == 0).all() and len(grid[grid.i == grid.j]) == 80
    assert len(enum_distinct(p, 0.2).collect()) == (len(grid) - 80) // 2


@pytest.mark.parametrize("threshold", ["10485760", "-1"])
def test_crowded_cells_are_dealt_out(spark, threshold, monkeypatch):
    """One cell holds most points; with and without a broadcast all pairs are found, by several tasks."""
    monkeypatch.setattr(epsjoin, "CROWDED_POINTS", 50)
    x = np.concatenate([np.random.default_rng(1).random((300, 2)) * 0.01, np.random.default_rng(2).random((100, 2))])
    p = points(spark, x)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        seen = Observation()
        found = enum(p, p, 0.02, observe=seen)
        tasks = found.groupBy(F.spark_partition_id()).count().collect()
        found = found.toPandas()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    true = distances(x, x) <= 0.02
    assert set(zip(found.i, found.j)) == set(zip(*np.nonzero(true))) and len(found) == true.sum() == seen.get["pairs"]
    assert len(tasks) == 4 and max(t["count"] for t in tasks) < 0.5 * len(found)


def test_many_axes(spark):
    """Of many axes the longest are ruled; where none is longer than two radii all points are compared."""
    x = np.random.default_rng(6).random((60, 6)) * [1, 1, 1, 5, 1, 9]
    p = points(spark, x)
    assert epsjoin.ruled_axes(p, 0.6) == [3, 5] and epsjoin.ruled_axes(p, 20.0) == []
    for r in (0.6, 3.0, 20.0):
        assert enum(p, p, r).count() == (distances(x, x) <= r).sum()


def test_consumers(spark):
    p = points(spark, np.random.default_rng(5).random((40, 2)))
    pairs = enum(p, p, 0.3)
    sizes = process(pairs, lambda b: pd.DataFrame({"n": [len(b)]}), "n long", bunch=7).toPandas().n
    assert sizes.sum() == pairs.count() and sizes.max() <= 7
    # batches are full across the batches that Arrow brings, but for the last of each task
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        sizes = process(pairs.coalesce(1), lambda b: pd.DataFrame({"n": [len(b)]}), "n long", bunch=30).toPandas().n
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sizes.sum() == pairs.count() and set(sizes[:-1]) == {30}
    with pytest.raises(ValueError):
        process(pairs, lambda b: b, "n long", bunch=0)
    assert sum(1 for _ in iterate(pairs)) == pairs.count()


def test_iterator_and_its_table_hold_little_at_once(spark, monkeypatch):
    """However many pairs: a task's result on the driver has about PART of them, and what is written at once SPOOL at most."""
    x = np.random.default_rng(5).random((60, 2))
    p = points(spark, x)
    pairs = enum(p, p, 0.5).coalesce(1)
    monkeypatch.setattr(operators_pairs, "PACK", 30)
    monkeypatch.setattr(operators_pairs, "PART", 50)
    monkeypatch.setattr(operators_pairs, "SPOOL", 100)
    parts, local = [], type(pairs).toLocalIterator
    monkeypatch.setattr(type(pairs), "toLocalIterator", lambda df, **more: parts.append(df.rdd.glom().map(len).collect()) or local(df, **more))
    written, make = [], type(spark).createDataFrame
    monkeypatch.setattr(type(spark), "createDataFrame", lambda s, data, *more: written.append(len(data)) or make(s, data, *more))
    found = spooled(spark, iterate(pairs), "i long, j long, r double").toPandas()
    d = distances(x, x)
    assert {(i, j): r for i, j, r in found.itertuples(index=False)} == {(i, j): d[i, j] for i, j in zip(*np.nonzero(d <= 0.5))} and len(found) == (d <= 0.5).sum()
    assert len(parts[0]) > 10 and max(parts[0]) <= 3 and max(written) == 100
    assert spooled(spark, iter([]), "i long").count() == 0


@pytest.mark.parametrize("box", [None, 1.0])
def test_count(spark, box):
    rng = np.random.default_rng(7)
    x, y, w = rng.random((200, 3)), rng.random((150, 3)), rng.integers(1, 5, 200).astype(float)
    a, b = points(spark, x, box, w), points(spark, y, box)
    edges = [-1.0, 0.0, 0.1, 0.25, 0.4]
    d = distances(x, y, box)
    at = np.searchsorted(np.array(edges), d, side="left")
    found = count(a, b, edges, weighted=True).orderBy("bin").toPandas()
    assert found["count"].tolist() == [int((at == k).sum()) for k in range(5)]
    assert found["weight0"].tolist() == [float((w[:, None] * (at == k)).sum()) for k in range(5)]
    back = count(b, a, edges).orderBy("bin").toPandas()
    assert back["count"].tolist() == found["count"].tolist()


def test_count_by_cells_equals_points_and_self_pairs_are_in_bin_0(spark):
    x = np.round(np.random.default_rng(1).random((300, 2)) * 20)
    p = points(spark, x)
    edges = [0.0, 1.0, 2.0, 3.0]
    one, two = (count(p, p, edges, weighted=True, by_cells=c).orderBy("bin").collect() for c in (True, False))
    assert one == two and one[0]["count"] >= 300
    c = collapsed(p)
    assert [r["count"] for r in count(c, c, edges).orderBy("bin").collect()] == [r["count"] for r in one]


@pytest.mark.parametrize("box", [None, 10.0])
def test_copies_of_a_position_make_no_pairs_of_their_own(spark, box, monkeypatch):
    """120,000 points on 60 positions, 14,400,000,000 pairs at most: joined are 60 by 60; counts, sums, means and fields are those of all points."""
    rng = np.random.default_rng(17)
    x, times = rng.integers(0, 10, (60, 2)).astype(float), 2000
    x = np.unique(x, axis=0)
    joined = []
    for module in (counts, operators_paircount):
        monkeypatch.setattr(module, "within", lambda a, b, *more, **named: joined.append(a.df.count()) or epsjoin.within(a, b, *more, **named))
    one = spark.createDataFrame([(k, float(p), float(q), float(k % 5 + 1), float(k % 3)) for k, (p, q) in enumerate(x)], "id long, p double, q double, w double, v double")
    df = one.crossJoin(spark.range(times).select((F.col("id") * 1000).alias("shift"))).withColumn("id", F.col("id") + F.col("shift"))
    p, f = PointSet.of(df, "id", ["p", "q"], "w", boxsize=box), FieldSet.of(df.withColumn("v", F.col("v") + F.pmod("shift", F.lit(3000)) / 1000), "id", ["p", "q"], "v", "w", boxsize=box)
    w = np.arange(len(x)) % 5 + 1.0
    v = np.arange(len(x)) % 3 + np.mean(np.arange(times) % 3)  # of the copies of a position
    d, edges = distances(x, x, box), [0.0, 1.5, 3.3]
    at = np.searchsorted(edges, d)
    for by_cells in (None, False):
        found = count(p, p, edges, weighted=True, by_cells=by_cells).orderBy("bin").toPandas()
        assert found["count"].tolist() == [int((at == k).sum()) * times**2 for k in range(3)]
        assert found.weight0.tolist() == [float((np.outer(w, w) * (at == k)).sum()) * times**2 for k in range(3)]
    found = paircount(p, p, RBinning([0.5, 1.5, 3.3], "irregular"), mean_coords=True, full=False).orderBy("bin0").toPandas()
    bins = [(d > 0.5) & (d <= 1.5), (d > 1.5) & (d <= 3.3)]
    assert found.npairs.tolist() == [int(m.sum()) * times**2 for m in bins] and found.sum1.tolist() == [float((np.outer(w, w) * m).sum()) * times**2 for m in bins]
    assert np.allclose(found.mean0, [d[m].mean() for m in bins], rtol=1e-12)
    found = paircount(f, p, RBinning([0.5, 1.5, 3.3], "irregular"), full=False).orderBy("bin0").toPandas()
    assert np.allclose(found.sum1, [(np.outer(w * v, w) * m).sum() * times**2 for m in bins], rtol=1e-12) and found.sum2.tolist() == [float((np.outer(w, w) * m).sum()) * times**2 for m in bins]
    assert len(joined) == 4 and set(joined) == {len(x)}


def test_count_on_levels(spark, monkeypatch):
    """Dense points: several levels, the same counts as by points; and the estimate that chooses."""
    rng = np.random.default_rng(11)
    x, y = rng.random((3000, 2)), rng.random((500, 2)) * 0.3
    w = rng.integers(1, 9, 3000).astype(float)
    a, b = points(spark, x, w=w), points(spark, y, w=np.arange(500) % 4 + 1.0)
    monkeypatch.setattr(counts, "LEAF", 4)
    edges = [0.05, 0.2, 0.5]
    d, ww = distances(x, y), w[:, None] * (np.arange(500) % 4 + 1.0)
    bins = np.searchsorted(edges, d)
    made, kept = [], counts.stored
    monkeypatch.setattr(counts, "stored", lambda df: made.append(1) or kept(df))
    found = count(a, b, edges, weighted=True, by_cells=True).orderBy("bin").toPandas()
    assert len(made) >= 3
    assert found["count"].tolist() == [(bins == k).sum() for k in range(3)] and found.weight0.tolist() == [ww[bins == k].sum() for k in range(3)]
    assert not counts.dense(a, b, 0.5)
    monkeypatch.setattr(counts, "COSTLY", 1000)
    assert counts.dense(a, b, 0.5) and not counts.dense(a, b, 0.001)


def test_metric_and_counters(spark):
    """A user's metric in counts and bins, and the number of pairs that were compared."""
    x = np.random.default_rng(31).random((120, 2))
    p, seen = points(spark, x), Observation()
    city = F.abs(F.col("a_x0") - F.col("b_x0")) + F.abs(F.col("a_x1") - F.col("b_x1"))
    d = np.abs(x[:, None] - x[None]).sum(axis=-1)
    found = count(p, p, [0.1, 0.3], metric=city * city, observe=seen).orderBy("bin").toPandas()["count"].tolist()
    assert found == [(d <= 0.1).sum(), ((d > 0.1) & (d <= 0.3)).sum()] and seen.get["pairs"] == sum(found)
    for scheme in (RBinning, FastRBinning):
        bins = paircount(p, p, scheme([0.05, 0.1, 0.3]), metric=city * city).orderBy("bin0").toPandas().npairs.tolist()
        assert bins == [(d <= 0.05).sum(), ((d > 0.05) & (d <= 0.1)).sum(), ((d > 0.1) & (d <= 0.3)).sum(), 0]


def test_point_set_rules(spark):
    df = spark.createDataFrame([(1, 1, 1.0, None), (2, 2, 2.0, 1.0)], "id long, i int, x double, w double")
    with pytest.raises(TypeError):
        PointSet.of(df, "id", ["i"])
    with pytest.raises(ValueError):
        PointSet.of(df, "id", ["x"], boxsize=0)
    assert PointSet.of(df, "id", ["x"], "w").df.count() == 1
    one, two = PointSet.of(df, "id", ["x"]), PointSet.of(df, "id", ["x"], boxsize=5.0)
    with pytest.raises(ValueError):
        enum(one, two, 1.0)
    empty = one.where("id < 0")
    assert empty.norm().first()["norm"] == 0 and enum(empty, one, 1.0).count() == 0
    assert [r["count"] for r in count(empty, one, [1.0]).collect()] == [0]


def test_array_positions(spark):
    df = spark.createDataFrame([(1, [0.0, 1.0]), (2, [0.5, 1.0])], "id long, p array<float>")
    assert enum_distinct(PointSet.of(df, "id", "p", dims=2), 0.5).collect() == [(1, 2, 0.5)]


def test_radial_bins(spark):
    x = np.random.default_rng(9).random((120, 3))
    p = points(spark, x, 1.0)
    edges = np.linspace(0, 0.5, 10)
    true = np.bincount(np.searchsorted(edges, distances(x, x, 1.0).ravel(), side="left"), minlength=11)[:11]
    slow = paircount(p, p, RBinning(edges), mean_coords=True).orderBy("bin0").toPandas()
    assert slow.npairs[1:10].tolist() == true[1:10].tolist() and slow.npairs[0] == 120
    fast = paircount(p, p, FastRBinning(edges)).orderBy("bin0").toPandas()
    assert fast.sum1[:10].tolist() == slow.sum1[:10].tolist()
    with pytest.raises(ValueError):
        paircount(p, p, FastRBinning(edges), mean_coords=True)
    with pytest.raises(ValueError):
        paircount(p, p, RmuBinning(edges, 4))


def test_field_of_ones_and_vector_field(spark):
    x = np.random.default_rng(2).random((60, 2))
    df = spark.createDataFrame(pd.DataFrame({"id": range(60), "x": x[:, 0], "y": x[:, 1], "one": 1.0, "two": 2.0}))
    f = FieldSet.of(df, "id", ["x", "y"], "one")
    s = paircount(f, f, RBinning([0.0, 0.2, 0.4])).toPandas()
    assert s.sum1.tolist() == s.sum2.tolist()
    v = FieldSet.of(df, "id", ["x", "y"], ["one", "two"])
    s = paircount(v, v, RBinning([0.0, 0.2, 0.4])).toPandas()
    assert (s.sum1_1 == 4 * s.sum1_0).all()


def test_boxes(spark):
    p = points(spark, np.arange(100.0))
    assert integrate(p, -math.inf, math.inf).first()["count"] == 100
    assert integrate(p, 0, 0).first()["count"] == 0 and integrate(p, 99, 99).first()["count"] == 0 and integrate(p, 0, 1).first()["count"] == 1
    boxes = spark.createDataFrame([(k, 0.0, float(k)) for k in range(0, 120, 7)] + [(500, 3.0, 1.0), (501, -math.inf, math.inf)], "b long, l double, h double")
    found = {r["b"]: r["count"] for r in integrate_many(p, boxes, "b", ["l"], ["h"]).collect()}
    assert found == {**{k: min(k, 100) for k in range(0, 120, 7)}, 500: 0, 501: 100}
    with pytest.raises(ValueError):
        integrate(p, [0, 0], [1, 1])


def test_boxes_on_levels(spark, monkeypatch):
    """Clumped points and boxes of all sizes, over several levels."""
    monkeypatch.setattr(boxes, "LEAF", 2)
    rng = np.random.default_rng(21)
    x = np.concatenate([rng.random((400, 2)), rng.random((400, 2)) * 0.01 + 0.5, [[0.0, 0.0], [1.0, 1.0]]])
    low = rng.random((60, 2))
    high = low + rng.choice([0.001, 0.02, 0.5, 2.0], (60, 1))
    df = spark.createDataFrame(pd.DataFrame({"b": np.arange(60), "l0": low[:, 0], "l1": low[:, 1], "h0": high[:, 0], "h1": high[:, 1]}))
    found = integrate_many(points(spark, x, w=np.arange(802.0)), df, "b", ["l0", "l1"], ["h0", "h1"]).orderBy("b").toPandas()
    true = ((x[None] >= low[:, None]) & (x[None] < high[:, None])).all(axis=-1)
    assert found["count"].tolist() == true.sum(axis=1).tolist() and found.weight0.tolist() == (true * np.arange(802.0)).sum(axis=1).tolist()


def test_forces(spark):
    x = np.random.default_rng(4).random((60, 3))
    p = points(spark, x, w=np.arange(60.0))
    d = distances(x, x)
    near = d <= 0.3
    found = force(p, p, count_kernel(), 0.3).orderBy("id").toPandas()
    assert np.allclose(found.f0, (near * np.arange(60.0)).sum(axis=1))
    s = np.where(near & (d > 0), np.arange(60.0) / (d * d + 0.01) ** 1.5, 0)
    exact = (s[:, :, None] * (x[None] - x[:, None])).sum(axis=1)
    found = force(p, p, plummer_kernel(0.1), 0.3).orderBy("id").toPandas()
    assert np.allclose(found[["f0", "f1", "f2"]], exact)
    rough = force(p, p, plummer_kernel(0.1), 0.3, eta=0.3).orderBy("id").toPandas()
    assert np.allclose(rough[["f0", "f1", "f2"]], exact, atol=0.1 * np.abs(exact).max())


def test_forest_respects_chunk_size(spark):
    p = points(spark, np.random.default_rng(8).random((200, 2)))
    sizes = make_forest(p, 9, 0.25).groupBy("c0", "c1", "chunk").count().toPandas()["count"]
    assert sizes.max() <= 9 and sizes.sum() == 200
    with pytest.raises(ValueError):
        make_forest(p, 0, 0.25)


def test_plan_is_an_equi_join_with_pushed_projection(spark):
    p = points(spark, np.random.default_rng(8).random((50, 2)))
    plan = enum(p, p, 0.1)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode" in plan and "(_c0" in plan.replace(" (_c0", "(_c0")
    physical = enum(p, p, 0.1)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in physical and "Cartesian" not in physical
    assert F is not None


def test_stored_points_gives_back_what_is_stored(spark, tmp_path):
    from pairfield.catalog import QUERIES
    from pairfield.sources.points import read_points

    suppliers = spark.read.parquet("/root/testdata/sf0.001/supplier.parquet")
    read = read_points(spark, "/root/testdata/sf0.001/supplier.parquet", "s_suppkey", ["s_acctbal"]).df.select("id", "x0").collect()
    assert sorted(map(tuple, read)) == sorted((r["s_suppkey"], float(r["s_acctbal"])) for r in suppliers.collect())
    suppliers.where("false").write.parquet(f"{tmp_path}/supplier.parquet")
    assert tuple(QUERIES["stored_points"](spark, str(tmp_path)).first()) == (0, False)
