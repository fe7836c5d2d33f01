"""Friends of friends, components, resampling, estimators, the sky and streams."""

import math

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F
from test_points import distances, points

from pairfield.functions import sky
from pairfield.operators import counts
from pairfield.operators.binning import AngularBinning, FlatSkyMultipoleBinning, MultipoleBinning, RBinning
from pairfield.operators.bootstrap import Policy, lengths, resample
from pairfield.catalog import QUERIES
from pairfield.operators.components import connected_components
from pairfield.operators.estimators import landy_szalay, natural
from pairfield.operators.fof import fof, fof_labels, fof_runs
from pairfield.operators.paircount import paircount
from pairfield.operators.regions import in_regions, region_sets, sky_regions
from pairfield.sources.points import SkyPointSet


@pytest.mark.parametrize("strategy", ["union_find", "labels"])
def test_components(spark, strategy):
    rng = np.random.default_rng(1)
    n = 400
    names = rng.permutation(n)
    edges = [(int(names[i]), int(names[i + 1])) for i in range(n - 1) if i % 50 != 49]
    found = connected_components(spark.createDataFrame(edges, "a long, b long"), strategy).toPandas().set_index("node").root
    true = {int(names[i]): int(names[i - i % 50 : i - i % 50 + 50].min()) for i in range(n)}
    assert found.to_dict() == true
    empty = connected_components(spark.createDataFrame([], "a long, b long"), strategy)
    assert empty.count() == 0


def brute_roots(edges):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in list(parent)}


def test_components_of_whole_table_chain_and_hot_node(spark):
    sf = "/root/testdata/sf0.001"
    lines = [(r["l_orderkey"], -1 - r["l_suppkey"]) for r in spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_suppkey").collect()]
    assert {r["node"]: r["root"] for r in QUERIES["components_of_lines"](spark, sf).collect()} == brute_roots(lines)
    edges = [(i, i + 1) for i in range(0, 1000)] + [(5000, i) for i in range(5001, 9000)]
    found = connected_components(spark.createDataFrame(edges, "a long, b long"), "labels").collect()
    assert {r["node"]: r["root"] for r in found} == brute_roots(edges)


@pytest.mark.parametrize("box", [None, 1.0])
def test_chain(spark, box):
    n = 300
    x = np.random.default_rng(0).permutation(np.arange(n) / n)
    p = points(spark, x, box)
    assert fof_labels(p, 1.1 / n).select("label").distinct().count() == 1
    assert fof_labels(p, 0.8 / n).where("id = label").count() == n
    c = fof(p, 1.1 / n)
    assert c.sum().collect() == [(0, float(n))] and c.groups.collect()[0]["length"] == n


@pytest.mark.parametrize("box", [None, 1.0])
def test_fof_is_brute_force_and_inclusive(spark, box):
    x = np.round(np.random.default_rng(6).random((150, 2)), 2)
    near = distances(x, x, box) <= 0.05
    label = np.arange(150)
    for _ in range(150):
        label = np.array([label[near[i]].min() for i in range(150)])
    found = fof_labels(points(spark, x, box), 0.05).orderBy("id").toPandas().label
    assert found.tolist() == label.tolist()


def test_fof_of_clumps(spark):
    """Clumps of points, a bridge between two of them that only points decide, and two that almost touch."""
    rng = np.random.default_rng(9)
    clumps = [rng.random((400, 2)) * 0.3 + c for c in ([0, 0], [1, 0], [0, 5], [0.45, 5])]
    x = np.concatenate([*clumps, [[0.4 + 0.09 * k, 0.15] for k in range(6)], rng.random((100, 2)) * 3 + 10])
    for ll in (0.05, 0.1, 0.17):
        seen = Observation()
        found = fof_labels(points(spark, x), ll, observe=seen).toPandas().set_index("id").label
        assert 0 < seen.get["sure"] <= seen.get["cells"] < len(x) ** 2 / 2
        d = distances(x, x) <= ll
        label = np.arange(len(x))
        while True:
            least = np.where(d, label[None, :], len(x)).min(axis=1)
            least = least[least]
            if (least == label).all():
                break
            label = least
        assert (found.sort_index().to_numpy() == label).all()


def test_long_chains(spark):
    """10,000 points in a row: one group if the length reaches the next point, else all alone."""
    p = points(spark, np.arange(10_000) / 10_000)
    assert {r["label"] for r in fof_labels(p, 1.1 / 10_000).select("label").distinct().collect()} == {0}
    assert fof_labels(p, 0.8 / 10_000).where("label <> id").count() == 0


def test_regions_take_pixels_in_order(spark):
    """Each pixel joins the smallest region if both stay below a pixel's area; plain lists say the same."""
    rng = np.random.default_rng(5)
    ra, dec = rng.random(3000) * 200, np.degrees(np.arcsin(rng.random(3000) * 0.7))
    df = spark.createDataFrame(pd.DataFrame({"ra": ra, "dec": dec, "other": 1}))
    nside, density = 4, 0.6
    pix = [r["pix"] for r in df.select(sky.radec2pix(nside, F.col("ra"), F.col("dec")).alias("pix")).collect()]
    regions = []
    for p in sorted(set(pix)):
        area = pix.count(p) / density
        least = min(range(len(regions)), key=lambda i: (regions[i][0], regions[i][1][0]), default=None)
        if least is not None and regions[least][0] + area < 41252.96 / 192:
            regions[least] = (regions[least][0] + area, [*regions[least][1], p])
        else:
            regions.append((area, [p]))
    want = {p: (i, area) for i, (area, pixels) in enumerate(sorted(regions)) for p in pixels}
    found = {r["pix"]: (r["region"], r["area"]) for r in sky_regions(df, nside, density).collect()}
    assert found == want and any(len(pixels) > 2 for _, pixels in regions)
    few = df.limit(40)
    sets = list(region_sets(2, few, 0.01, few.where("ra < 100")))
    assert sum(s[1].count() for s in sets) == 40 and sum(s[2].count() for s in sets) == few.where("ra < 100").count()
    assert [s[0] for s in sets] == sorted(s[0] for s in sets) and sets[0][1].columns == df.columns


def test_run_takes_any_estimator(spark):
    """Sums of values over straps, their product, and resampling: strap i has the sum 2 i."""
    v = -np.arange(20) % 10
    a, b = points(spark, v), points(spark, v)
    policy = Policy("cast(x0 as int)")
    product = lambda p, q: p.df.agg(F.sum("x0").alias("p")).crossJoin(q.df.agg(F.sum("x0").alias("q"))).select((F.col("p") * F.col("q")).alias("value"))
    few = [p.where("x0 < 4") for p in (a, b)]
    cache = policy.run(product, *few)
    assert {(r["s0"], r["s1"]): r["value"] for r in cache.collect()} == {(i, j): 4.0 * i * j for i in range(4) for j in range(4)}
    assert resample(cache, {1: 1, 3: 2}).first()["value"] == sum(m * n * 4 * i * j for i, m in ((1, 1), (3, 2)) for j, n in ((1, 1), (3, 2)))
    assert lengths(policy, few, {1: 1, 3: 2}) == [6, 6]
    with pytest.raises(ValueError):
        Policy("id").run(product, *[points(spark, np.arange(40))] * 2)


def test_fof_subset_catalogue_and_empty(spark):
    p = points(spark, np.arange(20.0))
    active = p.df.where("id % 2 = 0").select("id")
    found = fof_labels(p, 2.1, active=active).orderBy("id").toPandas().label
    assert found.tolist() == [0 if i % 2 == 0 else i for i in range(20)]
    c = fof(points(spark, [0, 0.1, 5, 9, 9.1, 9.2]), 0.15)
    groups = c.groups.orderBy("label").collect()
    assert [(g["length"], g["offset"], g["root"]) for g in groups] == [(3, 0, 3), (2, 3, 0), (1, 5, 2)]
    assert sorted(r["id"] for r in c.find(0).collect()) == [3, 4, 5]
    assert [r["id"] for r in c.indices().orderBy("position").collect()] == [3, 4, 5, 0, 1, 2]
    assert fof(points(spark, np.zeros((0, 3)), 1.0), 0.1).groups.count() == 0
    with pytest.raises(ValueError):
        fof_labels(p, 1.0, method="buggy")


def test_runs(spark):
    df = spark.createDataFrame([(1, 0.0, "a"), (2, 1.0, "a"), (3, 2.5, "a"), (4, 0.5, "b")], "k long, x double, g string")
    assert dict(fof_runs(df, ["g"], "x", 1.0, "k").collect()) == {1: 1, 2: 1, 3: 3, 4: 4}


def test_bootstrap(spark):
    x = (-np.arange(4)) % 2.0
    p = points(spark, x)
    policy = Policy(F.col("x0"))
    cache = policy.run_paircount(p, p, RBinning([0.0, 100.0], spacing="linear"))
    drawn = {0: 1, 1: 1}
    assert lengths(policy, [p, p], drawn) == [4, 4]
    full = {r["bin0"]: r["value"] for r in resample(cache, drawn, ["bin0"]).collect()}
    assert full == {0: 8.0, 1: 8.0}
    v = points(spark, (-np.arange(20)) % 10.0, w=(-np.arange(20)) % 10.0)
    sums = Policy(F.col("x0")).run_sums([v, v], F.col("w0"))
    assert resample(sums, {3: 1}).first()["value"] == 36 and resample(sums, {3: 2}).first()["value"] == 144
    assert resample(sums.where("s0 = s1"), {3: 1, 4: 1}, operator=max).first()["value"] == 64
    assert sum(Policy(F.col("x0")).bootstrap(v, 1).values()) == 10
    assert len(policy.create_straps(p)) == 2


def test_multipole_0_is_the_count(spark):
    x = np.random.default_rng(3).random((60, 3))
    p = points(spark, x)
    edges = np.linspace(0.05, 0.5, 6)
    plain = paircount(p, p, RBinning(edges), full=False).orderBy("bin0").toPandas()
    for b in (MultipoleBinning(edges, [0, 2]), FlatSkyMultipoleBinning(edges, [0, 2], los=0)):
        s = paircount(p, p, b, full=False).where("ell = 0").orderBy("bin0").toPandas()
        assert np.allclose(s.sum1, plain.sum1)


def test_estimators(spark):
    sums = lambda *v: spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "bin0 int, sum1 double")
    assert [r["xi"] for r in natural(sums(2, 3), sums(1, 0)).orderBy("bin0").collect()] == [1.0, None]
    assert [r["xi"] for r in landy_szalay(sums(6), sums(2), sums(2), ratio=1.0).collect()] == [2.0]


@pytest.mark.parametrize("nside", [1, 2, 4, 16])
def test_pixels_round_trip(spark, nside):
    pix = spark.range(sky.nside2npix(nside)).withColumnRenamed("id", "pix")
    theta, phi = sky.pix2ang(nside, F.col("pix"))
    back = pix.select("pix", theta.alias("t"), phi.alias("p")).select("pix", sky.ang2pix(nside, F.col("t"), F.col("p")).alias("again"))
    assert back.where("pix <> again").count() == 0


def test_angles_and_regions(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame(pd.DataFrame({"id": range(300), "ra": rng.random(300) * 360, "dec": np.degrees(np.arcsin(rng.random(300) * 2 - 1))}))
    p = SkyPointSet.of(df, "id", "ra", "dec")
    x = p.df.orderBy("id").select("x0", "x1", "x2").toPandas().to_numpy()
    angle = np.degrees(2 * np.arcsin(np.clip(distances(x, x) / 2, 0, 1)))
    s = paircount(p, p, AngularBinning([1.3, 7.7, 20.1], spacing="irregular"), mean_coords=True, full=False).orderBy("bin0").toPandas()
    assert s.npairs.tolist() == [int(((angle > a) & (angle <= b)).sum()) for a, b in ((1.3, 7.7), (7.7, 20.1))]
    assert s.mean0.between([1.3, 7.7], [7.7, 20.1]).all()
    regions = sky_regions(df, 2, density=300 / 41252.96)
    assert in_regions(df, regions, 2).where("region IS NULL").count() == 0
    area = regions.select("region", "area").distinct().orderBy("region").toPandas().area
    assert area.is_monotonic_increasing


def test_unit_vectors_are_those_of_sql(spark):
    """Bit by bit, so that a pair whose angle is an edge has the same bin; null and NaN stay what they are."""
    k = np.arange(20000)
    sky_df = pd.DataFrame({"id": k, "ra": k * 137.5 % 360, "dec": (k * 7919 % 1000000 / 100) / 10000 * 80})
    found = SkyPointSet.of(spark.createDataFrame(sky_df), "id", "ra", "dec").df.orderBy("id").toPandas()
    con = duckdb.connect()
    sql = con.execute("SELECT sin(radians(ra)) * cos(radians(dec)) AS x, cos(radians(ra)) * cos(radians(dec)) AS y, sin(radians(dec)) AS z FROM sky_df ORDER BY id").df()
    assert (found.x0 == sql.x).all() and (found.x1 == sql.y).all() and (found.x2 == sql.z).all()
    odd = spark.createDataFrame([(1, None, 0.0), (2, 0.0, None), (3, float("nan"), 0.0), (4, float("inf"), 0.0), (5, 90.0, 0.0)], "id long, ra double, dec double")
    rows = SkyPointSet.of(odd, "id", "ra", "dec").df.orderBy("id").collect()
    assert [r["id"] for r in rows] == [3, 4, 5] and [math.isnan(r["x0"]) for r in rows] == [True, True, False] and rows[2]["x0"] == 1.0


def test_a_square_is_in_the_bin_of_its_root():
    for e in (0.0, 0.0022689276370736895, 0.1, 1.3, 2.9, 1e-200):
        edge = counts._squares([e, 10.0])[0]
        assert math.sqrt(edge) <= e < math.sqrt(math.nextafter(edge, math.inf))
    assert counts._squares([1.0, 1.0]) == [1.0, 1.0] and counts._squares([-1.0, math.inf]) == [-1.0, math.inf]
