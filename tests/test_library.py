"""Sources, spatial operators, statistics, simulation and the entry points."""

import math
import random
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from riverspark.functions.geometry import haversine_km, min_area_box, point_segment, robinson, segment_meets_box, smallest_box, thinned
from riverspark.functions.special import betainc, chi2_p, gammaincc, normal_p, poisson_quantile, student_p
from riverspark.operators.bins import auto_bins, signed_histogram, split_bins
from riverspark.operators.ordering import next_match, positions, quantiles, ranks, running_sum
from riverspark.operators.simulation import convergence, empirical, running_error, strong_uniform, thinned as thin, uniform, with_missed
from riverspark.operators.spatial import knn, nearest_regions, overlaps, regions_of, segments_meeting
from riverspark.operators.statistics import Determinant, determinant, effects, fdr, gram, independence, moran, ols, spatial_lag, vif, welch
from riverspark.operators.tables import copy_by_key, differences, keyed_replace
from riverspark.sources.config import parse_flag, positive, scenario_rows
from riverspark.sources.obb import obb_points
from riverspark.sources.raster import align_nearest, rasterize
from riverspark.sources.tables import latest, measured, require_columns

ROOT = Path(__file__).resolve().parents[1]


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_measured_and_required(spark):
    d = spark.createDataFrame([(1.0,), (float("nan"),), (-999.0,), (None,)], "v double")
    assert [r[0] for r in d.select(measured("v")).collect()] == [1.0, None, None, None]
    with pytest.raises(ValueError, match="zz"):
        require_columns(d, ["v", "zz"])


def test_latest_breaks_ties_by_value(spark):
    d = spark.createDataFrame([(1, 5, 1.0), (1, 6, 0.5), (1, 6, 0.7), (None, 1, 2.0)], "k int, t int, v double")
    assert rows(latest(d, ["k"], "t", ["v"])) == [(1, 0.7), (None, 2.0)]


def test_obb_lines(spark):
    lines = ["193.0 43.0 276.0 43.0 276.0 158.0 193.0 158.0 embankment_dam 0", "286.0 195.0 357.0 195.0 357.0 249.0 286.0 249.0 Barrage_dam 0", "105.0 80.0 215.0 80.0 215.0 180.0 104.0 180.0 x", "a b c", "", "1 1 1 1 1 1 1 1 flat 0", "1 2 3 4 5 6 7 x dam 0"]
    d = spark.createDataFrame([(k, x) for k, x in enumerate(lines)] + [(99, None)], "k int, line string")
    got = {r["k"]: (round(r["cx"], 2), round(r["cy"], 2), r["dam_type"]) for r in obb_points(d, "line").collect()}
    assert got[0] == (234.5, 100.5, "embankment_dam") and got[1] == (321.5, 222.0, "Barrage_dam") and set(got) == {0, 1, 2}


def test_config():
    assert parse_flag(" Yes ") and not parse_flag("0") and parse_flag("", True) and not parse_flag(None)
    with pytest.raises(ValueError):
        positive("n", 0)
    assert scenario_rows([{"scenario_name": "a", "indicator_1": "X", "weight_1": 1, "csi_thresh": 9, "to_process": 0}]) == []


def test_annotation_xml(spark):
    from riverspark.sources.voc import voc_documents, voc_objects

    o = spark.createDataFrame(
        [(1, 0, "a<b", 0, 1, 1.0, 2.0, 5.0, 4.0, None, None, None, None, None), (1, 1, "dam & lake", 1, 0, None, None, None, None, 10.0, 10.0, 4.0, 2.0, math.pi / 2), (2, 0, None, 0, 0, 0.0, 0.0, 1.0, 1.0, None, None, None, None, None)],
        "doc int, pos int, name string, truncated int, difficult int, xmin double, ymin double, xmax double, ymax double, cx double, cy double, w double, h double, angle double",
    )
    whole = voc_documents(o, "doc", "pos").unionByName(spark.createDataFrame([(3, "<annotation></annotation>"), (4, None), (5, "<annotation><object><name>x</name></object></annotation>")], "doc int, xml string"))
    got = {(r["doc"], r["place"]): r for r in voc_objects(whole).collect()}
    assert set(got) == {(1, 0), (1, 1), (2, 0), (5, 0)}
    r, q = got[1, 0], got[1, 1]
    assert (r["type"], r["name"], r["difficult"]) == ("bndbox", "a<b", 1) and [r[f"{c}{k}"] for k in range(1, 5) for c in "xy"] == [1, 2, 5, 2, 5, 4, 1, 4]
    assert (q["type"], q["name"], q["truncated"]) == ("robndbox", "dam & lake", 1) and [q[f"{c}{k}"] for k in range(1, 5) for c in "xy"] == pytest.approx([11, 8, 11, 12, 9, 12, 9, 8])
    assert got[5, 0]["x1"] is None and voc_objects(whole.limit(0)).count() == 0


def test_geopackage_and_shapefile(spark, tmp_path):
    from riverspark.sources.geopackage import GeoPackageSource, bounds
    from riverspark.sources.shapefile import ShapefileSource

    spark.dataSource.register(GeoPackageSource)
    spark.dataSource.register(ShapefileSource)
    boxes = [(k, "é" if k % 2 else None, k * 1.0, -k * 1.0, k + 1.0, k + 2.0) for k in range(25)]
    GeoPackageSource.write_boxes(str(tmp_path / "a.gpkg"), "odd layer", boxes)
    g = spark.read.format("geopackage").option("layer", "odd layer").option("rows", "7").load(str(tmp_path / "a.gpkg"))
    assert rows(g.select("hybas_id", "continent", "min_x", "min_y", "max_x", "max_y")) == sorted(boxes, key=repr) and g.rdd.getNumPartitions() == 4
    with pytest.raises(Exception, match="no layer"):
        spark.read.format("geopackage").option("layer", "none").load(str(tmp_path / "a.gpkg")).count()
    few = spark.read.format("geopackage").options(layer="odd layer", columns="hybas_id", where="hybas_id IN (1, 2)").load(str(tmp_path / "a.gpkg"))
    assert "continent" not in few.columns and {r["hybas_id"] for r in few.collect()} == {1, 2} & {b[0] for b in boxes}
    assert bounds(bytes.fromhex("0101000000000000000000f03f0000000000000040")) == (1.0, 2.0, 1.0, 2.0)
    pts = [(k, k * 0.5, -k * 2.0) for k in range(30)]
    ShapefileSource.write_points(str(tmp_path / "p.shp"), "id", pts)
    s = spark.read.format("shapefile").option("rows", "11").load(str(tmp_path / "p.shp"))
    assert rows(s.select("id", "x", "y")) == sorted(pts, key=repr)
    ShapefileSource.write_points(str(tmp_path / "e.shp"), "id", [])
    assert spark.read.format("shapefile").load(str(tmp_path / "e.shp")).count() == 0


def test_rasterize_and_align(spark):
    d = spark.createDataFrame([("a", 0.0, 0.0), ("a", 0.4, 0.4), ("a", 2.0, 1.0), ("b", 5.0, 5.0), ("b", None, 1.0)], "t string, x double, y double")
    assert rows(rasterize(d, "x", "y", 1.0, ["t"])) == [("a", 0, 0, 1), ("b", 0, 0, 1)]  # edge points of whole extents lie outside
    assert rasterize(d.limit(0), "x", "y", 1.0).count() == 0
    c = spark.createDataFrame([(0, 0, 5), (0, 1, 7)], "row long, col long, n int")
    assert rows(align_nearest(c, 2.0, 1.0, 2, 4).select("row", "col", "n")) == [(0, 0, 5), (0, 1, 5), (0, 2, 7), (0, 3, 7), (1, 0, 5), (1, 1, 5), (1, 2, 7), (1, 3, 7)]


def boxes(spark):
    return spark.createDataFrame([(1, 0.0, 0.0, 10.0, 10.0), (2, 10.0, 0.0, 20.0, 10.0), (3, 5.0, 5.0, 15.0, 15.0)], "id long, min_x double, min_y double, max_x double, max_y double")


def test_regions(spark):
    p = spark.createDataFrame([(1, 1.0, 1.0), (2, 10.0, 5.0), (3, 7.0, 7.0), (4, None, 1.0), (5, 99.0, 99.0)], "p long, x double, y double")
    assert rows(regions_of(p, boxes(spark), "id", "x", "y", 4.0).select("p", "id")) == [(1, 1), (3, 1), (3, 3)]
    assert rows(regions_of(p, boxes(spark), "id", "x", "y", 4.0, strict=False).select("p", "id")) == [(1, 1), (2, 1), (2, 2), (2, 3), (3, 1), (3, 3)]
    assert {r["p"]: r["id"] for r in nearest_regions(p, boxes(spark), "p", "x", "y", "id").collect()} == {1: 1, 2: 1, 3: 1, 5: 3}
    s = spark.createDataFrame([(1, -5.0, 5.0, 30.0, 5.0), (2, 11.0, 20.0, 20.0, 11.0), (3, 50.0, 50.0, 50.0, 50.0), (4, 14.0, 16.0, 17.0, 13.0)], "sid long, ax double, ay double, bx double, by double")
    assert rows(segments_meeting(s, boxes(spark), "id", 6.0)) == [(1, 1), (1, 2), (1, 3), (4, 3)] or rows(segments_meeting(s, boxes(spark), "id", 6.0)) == [(1, 1), (1, 2), (1, 3)] + ([(4, 3)] if 14 + 16 <= 30 else [])


def test_overlaps_equal_brute_force(spark):
    r = random.Random(4)
    b = [(k % 3, k, x := r.uniform(0, 100), y := r.uniform(0, 100), x + r.uniform(1, 40), y + r.uniform(1, 40)) for k in range(60)]
    d = spark.createDataFrame(b, "g int, id int, xmin double, ymin double, xmax double, ymax double")
    want = sorted((g, i, j) for g, i, a, c, e, f in b for h, j, p, q, s, t in b if g == h and a < s and p < e and c < t and q < f)
    assert sorted(map(tuple, overlaps(d, d, ["g"], 25.0).collect())) == want


def test_knn_equals_brute_force(spark):
    r = random.Random(6)
    pl = [(k, r.uniform(-180, 180), r.uniform(-89, 89)) for k in range(70)] + [(100, 0.0, 89.9), (101, 179.0, -89.0)]
    d = spark.createDataFrame(pl, "id long, lon double, lat double")

    def km(a, b):
        h = math.sin(math.radians(b[2] - a[2]) / 2) ** 2 + math.cos(math.radians(a[2])) * math.cos(math.radians(b[2])) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
        return 2 * 6371.0088 * math.asin(min(1, math.sqrt(h)))

    want = sorted((a[0], b[0]) for a in pl for b in sorted((x for x in pl if x[0] != a[0]), key=lambda x: (km(a, x), x[0]))[:5])
    got = knn(d, 5).collect()
    assert sorted((x["i"], x["j"]) for x in got) == want and {x["w"] for x in got} == {0.2}
    assert knn(d.limit(3), 5).count() == 6


def test_geometry(spark):
    one = spark.range(1).select(point_segment(F.lit(0.0), F.lit(3.0), F.lit(-1.0), F.lit(0.0), F.lit(1.0), F.lit(0.0)), haversine_km(F.lit(0.0), F.lit(0.0), F.lit(180.0), F.lit(0.0)), segment_meets_box(*map(F.lit, (0.0, 0.0, 4.0, 4.0, 1.0, 1.0, 2.0, 2.0))), segment_meets_box(*map(F.lit, (0.0, 3.0, 0.0, 9.0, 1.0, 1.0, 2.0, 2.0)))).first()
    assert one[0] == 3.0 and one[1] == pytest.approx(math.pi * 6371.0088) and one[2] and not one[3]
    assert smallest_box(np.array([[0, 0], [4, 0], [4, 2], [0, 2], [1, 1]]))[2:4] == (4.0, 2.0)
    turned = np.array([[0, 0], [3, 3], [2, 4], [-1, 1]])
    assert smallest_box(turned)[2:4] == (pytest.approx(math.sqrt(18)), pytest.approx(math.sqrt(2)))
    assert len(thinned(np.c_[np.arange(9.0), np.zeros(9)], 0.1)) == 2
    b = spark.createDataFrame([([0.0, 2.0, 2.0, 0.0], [0.0, 0.0, 1.0, 1.0])], "x array<double>, y array<double>").select(min_area_box("x", "y").alias("b")).first()["b"]
    assert (b["long_side"], b["short_side"]) == (2.0, 1.0)
    r = spark.range(1).select(robinson(F.lit(180.0), F.lit(0.0)).alias("r")).first()["r"]
    assert r["x"] == pytest.approx(17005.8, rel=1e-3) and r["y"] == 0.0


def test_special_functions():
    assert student_p(2.228139, 10) == pytest.approx(0.05, abs=1e-6) and student_p(0.0, 5) == pytest.approx(1)
    assert chi2_p(3.841459, 1) == pytest.approx(0.05, abs=1e-6) and chi2_p(18.307038, 10) == pytest.approx(0.05, abs=1e-6)
    assert normal_p(1.959964) == pytest.approx(0.05, abs=1e-6)
    assert betainc(2, 3, 0.4) == pytest.approx(0.5248) and betainc(0.5, 0.5, 0.25) == pytest.approx(1 / 3)
    assert gammaincc(1, 2.0) == pytest.approx(math.exp(-2)) and gammaincc(5, 0.1) == pytest.approx(1, abs=1e-6)
    for mean in (0.5, 4.0, 200.0):
        ks = [poisson_quantile(mean, u) for u in np.linspace(0.0005, 0.9995, 1000)]
        assert np.mean(ks) == pytest.approx(mean, rel=0.02) and np.var(ks) == pytest.approx(mean, rel=0.05)
    assert poisson_quantile(0.0, 0.5) == 0


def test_bins(spark):
    d = spark.createDataFrame([(x,) for x in (-20.0, -5.0, -1.0, 0.0, 0.0, 5.0, 10.0, 10.0, 99.0, None, float("nan"))], "v double")
    h = {r["label"]: r["n"] for r in signed_histogram(d, "v", [-10.0, -5.0, 0.0, 10.0, 20.0]).collect()}
    assert h == {"< -10": 1, "[-10, -5]": 1, "[-5, 0)": 2, "= 0": 2, "(0, 10]": 3, "[10, 20]": 2, "> 20": 1, "Total": 9}
    s = {r["label"]: r["n"] for r in split_bins(d, "v", [-10.0, 10.0]).collect()}
    assert s == {"-10,0": 2, "0,0": 2, "0,10": 3}
    e = [r["edge"] for r in auto_bins(d, "v", 2).collect()]
    assert e == sorted(e) and min(e) == -20 and max(e) == 99
    assert rows(auto_bins(d.limit(0), "v", 2)) == []


def test_positions(spark):
    r = random.Random(1)
    d = spark.createDataFrame([(r.choice([None, 1, 2, 3]), k) for k in range(500)], "a int, k int")
    got = sorted((x["pos"], x["a"], x["k"]) for x in positions(d, ["a", "k"]).collect())
    want = sorted(((x["a"] is None, x["a"], x["k"]) for x in d.collect()), key=lambda t: (t[0], t[1] or 0, t[2]))
    assert got == [(i + 1, a, k) for i, (_, a, k) in enumerate(want)]


def test_tables(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 2.0)], "k int, v double")
    b = spark.createDataFrame([(2, None), (3, 9.0)], "k int, v double")
    assert rows(keyed_replace(a, b, ["k"], ["v"])) == [(1, 1.0), (2, None)]
    assert rows(copy_by_key(a, b, "k", "v", 0.0).select("k", "v")) == [(1, 0.0), (2, 0.0)]
    assert {r["side"] for r in differences(a, b).collect()} == {"a", "b"} and differences(a, a).count() == 0
    with pytest.raises(ValueError):
        keyed_replace(a, b, ["k"], ["zz"])


def sample(spark, n=400, seed=3):
    g = np.random.default_rng(seed)
    x, z = g.normal(5, 2, n), g.normal(0, 1, n)
    y = 3 + 2 * x - 1.5 * z + g.normal(0, 1, n)
    return x, z, y, spark.createDataFrame([(k, float(a), float(b), float(c)) for k, (a, b, c) in enumerate(zip(x, z, y))] + [(n, None, 1.0, 1.0), (n + 1, float("nan"), 1.0, 1.0)], "id long, x double, z double, y double")


def test_gram_ols_vif(spark):
    x, z, y, d = sample(spark)
    n, mean, g = gram(d, ["x", "z"])
    assert n == 400 and mean == pytest.approx([x.mean(), z.mean()]) and g == pytest.approx(np.cov(np.c_[x, z].T) * 399)
    f = ols(d, "y", ["x", "z"])
    want = np.linalg.lstsq(np.c_[np.ones(400), x, z], y, rcond=None)[0]
    assert f.coefficients == pytest.approx(want) and 0.9 < f.r2 < 1
    assert vif(d, ["x", "z"])["x"] == pytest.approx(1 / (1 - np.corrcoef(x, z)[0, 1] ** 2))
    assert math.isnan(vif(d.withColumn("c", F.lit(1.0)), ["x", "c"])["c"])
    with pytest.raises(ValueError):
        ols(d.limit(2), "y", ["x", "z"])


def ring(n, k=2):
    return [(i, (i + s) % n, 1 / (2 * k)) for i in range(n) for s in [*range(-k, 0), *range(1, k + 1)]]


def test_spatial_lag_recovers_its_parameters(spark):
    n, rho = 400, 0.6
    x, z, _, _ = sample(spark, n)
    w = np.zeros((n, n))
    for i, j, a in ring(n):
        w[i, j] = a
    y = np.linalg.solve(np.eye(n) - rho * w, 1 + 2 * x - z + np.random.default_rng(5).normal(0, 1, n))
    d = spark.createDataFrame([(k, float(y[k]), float(x[k]), float(z[k])) for k in range(n)], "id long, y double, x double, z double")
    ws = spark.createDataFrame(ring(n), "i long, j long, w double")
    f, t = spatial_lag(d, ws, "y", ["x", "z"])
    assert f.rho == pytest.approx(rho, abs=0.05) and f.coefficients[1] == pytest.approx(2, abs=0.1) and f.rho_p < 1e-6
    inverse = np.linalg.inv(np.eye(n) - f.rho * w)
    direct, indirect, total = effects(f, t)[0]
    assert direct == pytest.approx(f.coefficients[1] * np.trace(inverse) / n, rel=1e-3) and total == pytest.approx(f.coefficients[1] * inverse.sum() / n, rel=1e-6)
    assert direct + indirect == pytest.approx(total)


def test_log_determinant_is_exact_at_any_size(spark):
    r = np.random.default_rng(3)
    at = r.random((300, 2))
    near = np.argsort(((at[:, None] - at[None]) ** 2).sum(axis=2), axis=1)[:, 1:6]
    w = np.zeros((300, 300))
    np.put_along_axis(w, near, 0.2, axis=1)
    det = Determinant(300, np.repeat(np.arange(300), 5), near.ravel(), np.full(1500, 0.2))
    assert det.band < 120
    for rho in (-0.9, 0.0, 0.5, 0.98):
        assert det.log(rho) == pytest.approx(np.linalg.slogdet(np.eye(300) - rho * w)[1], abs=1e-9)
        assert det.mean_diagonal(rho) == pytest.approx(np.trace(np.linalg.inv(np.eye(300) - rho * w)) / 300, abs=1e-5)
    for n in (2_999, 3_001):
        i, j, v = map(np.array, zip(*ring(n)))
        t = 2 * np.pi * np.arange(n) / n
        exact = np.log(1 - 0.95 * (np.cos(t) + np.cos(2 * t)) / 2).sum()
        assert Determinant(n, i, j, v).log(0.95) == pytest.approx(exact, abs=1e-6)
    assert Determinant(3, np.zeros(0, int), np.zeros(0, int), np.zeros(0)).log(0.5) == 0.0
    with pytest.raises(ValueError):
        determinant(spark.createDataFrame(ring(30), "i long, j long, w double"), limit=10)


def test_order_without_a_single_task(spark):
    r = np.random.default_rng(8)
    data = [(k, None if k % 11 == 0 else int(g), int(v), None if k % 13 == 0 else float(q)) for k, (g, v, q) in enumerate(zip(r.choice([1, 1, 1, 2, 3], 500), r.integers(0, 9, 500), r.integers(0, 40, 500)))]
    d = spark.createDataFrame(data, "k long, g int, v int, q double").repartition(5).withColumn("pos", F.lit("x"))
    got = {x["k"]: x["s"] for x in running_sum(d, ["g"], ["k"], "v", "s").collect()}
    hit = {x["k"]: x["nxt"] for x in next_match(d.where("g IS NOT NULL"), ["g"], "k", F.col("v") == 4, "nxt").collect()}
    for k, g, _, _ in data:
        assert got[k] == sum(v for a, b, v, _ in data if b == g and a < k)
        if g is not None:
            assert hit[k] == min((a for a, b, v, _ in data if b == g and a > k and v == 4), default=None)
    rank = {x["k"]: x["r"] for x in ranks(d, F.col("v"), "r").collect()}
    assert all(rank[k] == 1 + sum(b < v for _, _, b, _ in data) for k, _, v, _ in data)
    q = {x["g"]: x for x in quantiles(d, ["g"], "q", {"med": 0.5, "high": 0.975, "most": 1.0}).collect()}
    for g in (None, 1, 2, 3):
        values = [v for _, b, _, v in data if b == g and v is not None]
        assert (q[g]["med"], q[g]["high"], q[g]["most"]) == pytest.approx((np.median(values), np.quantile(values, 0.975), max(values)))
    assert quantiles(d.limit(0), ["g"], "q", {"med": 0.5}).count() == running_sum(d.limit(0), ["g"], ["k"], "v", "s").count() == 0


def test_moran(spark):
    n = 60
    v = [math.sin(2 * math.pi * k / n) for k in range(n)]
    d = spark.createDataFrame(list(enumerate(v)), "id long, v double")
    m = moran(d, spark.createDataFrame(ring(n, 1), "i long, j long, w double")).first()
    z = np.array(v) - np.mean(v)
    w = np.zeros((n, n))
    for i, j, a in ring(n, 1):
        w[i, j] = a
    i = n / w.sum() * (z @ w @ z) / (z @ z)
    s1, s2 = ((w + w.T) ** 2).sum() / 2, ((w.sum(0) + w.sum(1)) ** 2).sum()
    var = (n * n * s1 - n * s2 + 3 * w.sum() ** 2) / ((n * n - 1) * w.sum() ** 2) - 1 / (n - 1) ** 2
    assert m["i"] == pytest.approx(i) and m["z"] == pytest.approx((i + 1 / (n - 1)) / math.sqrt(var)) and m["p"] < 1e-6


def test_moran_of_one_way_links(spark):
    v, links = [1.0, 2.0, 4.0, 8.0, 3.0], [(0, 1, 1.0), (2, 1, 0.5), (1, 2, 0.5), (3, 4, 1.0)]
    m = moran(spark.createDataFrame(list(enumerate(v)), "id long, v double"), spark.createDataFrame(links, "i long, j long, w double")).first()
    z, w = np.array(v) - np.mean(v), np.zeros((5, 5))
    for i, j, a in links:
        w[i, j] = a
    n, i = 5, 5 / w.sum() * (z @ w @ z) / (z @ z)
    s1, s2 = ((w + w.T) ** 2).sum() / 2, ((w.sum(0) + w.sum(1)) ** 2).sum()
    var = (n * n * s1 - n * s2 + 3 * w.sum() ** 2) / ((n * n - 1) * w.sum() ** 2) - 1 / (n - 1) ** 2
    assert m["z"] == pytest.approx((i + 1 / (n - 1)) / math.sqrt(var))


def test_welch_independence_fdr(spark):
    d = spark.createDataFrame([(True, 1.0), (True, 2.0), (True, 4.0), (False, 9.0), (False, 7.0), (False, None), (False, float("inf"))], "h boolean, v double")
    w = welch(d, F.col("h"), ["v"]).first()
    assert (w["n_high"], w["n_low"]) == (3, 2) and w["t"] == pytest.approx((7 / 3 - 8) / math.sqrt(7 / 9 + 1)) and 0 < w["p"] < 0.1
    c = spark.createDataFrame([("a", "x", 10), ("a", "y", 20), ("b", "x", 30)], "r string, c string, n long")
    x = independence(c, "r", "c", "n").first()
    o = np.array([[10, 20], [30, 0]])
    e = np.outer(o.sum(1), o.sum(0)) / 60
    assert x["chi2"] == pytest.approx(((o - e) ** 2 / e).sum()) and x["dof"] == 1
    p = spark.createDataFrame([("r", 1, 0.01), ("r", 2, 0.04), ("r", 3, 0.03), ("r", 4, None), ("s", 5, 0.2)], "g string, k int, p double")
    assert {r["k"]: r["p_adj"] and round(r["p_adj"], 6) for r in fdr(p, "g", "p", "k").collect()} == {1: 0.03, 2: 0.04, 3: 0.04, 4: None, 5: 0.2}


def test_simulation(spark):
    d = spark.createDataFrame([(k, k % 5 == 0, 0.3 if k % 7 else None, "ab"[k % 2]) for k in range(1000)], "k long, c boolean, p double, g string")
    kept = thin(d, "k", F.col("c"), F.col("p"), 30)
    n = kept.groupBy("k").count().collect()
    certain = {r["k"]: r["count"] for r in n}
    assert all(certain[k] == 30 for k in range(0, 1000, 5))
    assert sum(v for k, v in certain.items() if k % 5) / (30 * sum(1 for k in range(1000) if k % 5 and k % 7)) == pytest.approx(0.3, abs=0.02)
    assert rows(kept) == rows(thin(d.repartition(7), "k", F.col("c"), F.col("p"), 30))
    u = [r[0] for r in spark.range(20_000).select(strong_uniform(F.col("id"), F.lit(1), 42)).collect()]
    assert np.mean(u) == pytest.approx(0.5, abs=0.01) and 0 <= min(u) and max(u) < 1
    assert spark.range(5000).select(F.avg(uniform(F.col("id"), F.lit(3), 1))).first()[0] == pytest.approx(0.5, abs=0.02)
    m = with_missed(kept, spark.createDataFrame([("a", 0.5)], "g string, recall double"), "g").groupBy("g").agg(F.avg(F.col("n_missed") / F.col("n_true")).alias("r")).collect()
    got = {r["g"]: r["r"] for r in m}
    assert got["a"] == pytest.approx(1.0, abs=0.1) and got["b"] == pytest.approx(0.0989 / 0.9011, abs=0.05)
    v = [3.0, 5.0, 4.0, 4.5]
    s = spark.createDataFrame([("a", i + 1, x) for i, x in enumerate(v)], "g string, sim int, v double")
    e = empirical(s, ["g"], "v").first()
    assert (e["mean"], e["low"], e["high"]) == (pytest.approx(np.mean(v)), pytest.approx(np.percentile(v, 2.5)), pytest.approx(np.percentile(v, 97.5)))
    run = running_error(s, ["g"], "v")
    assert [round(r["se"], 6) for r in run.orderBy("k").collect()] == [round(float(np.std(v[: k + 1]) / math.sqrt(k + 1)), 6) for k in range(4)]
    assert {r["share"]: r["k"] for r in convergence(run, ["g"], [0.5, 0.0]).collect()} == {0.5: 1, 0.0: 1}


def test_stream_ingest_takes_each_file_once(spark, tmp_path):
    from riverspark.streaming.ingest import ingest

    d = spark.createDataFrame([(1, "a"), (2, "b")], "k int, p string")
    args = (spark, str(tmp_path / "in"), d.schema, str(tmp_path / "store"), str(tmp_path / "progress"), "p")
    d.write.parquet(str(tmp_path / "in"))
    ingest(*args)
    ingest(*args)
    spark.createDataFrame([(3, "a")], d.schema).write.mode("append").parquet(str(tmp_path / "in"))
    ingest(*args)
    assert rows(spark.read.schema(d.schema).parquet(str(tmp_path / "store")).select("k", "p")) == [(1, "a"), (2, "b"), (3, "a")]


def test_shared_folder_of_the_session_is_used():
    """In a process of its own, as the setting belongs to the start of a session."""
    code = """
import tempfile, pathlib
from riverspark.session import build_session, cut, shared_folder
d = tempfile.mkdtemp()
s = build_session(1, **{"spark.checkpoint.dir": "file://" + d})
assert shared_folder(s) == "file://" + d
assert cut(s.range(3)).count() == 3 and any(pathlib.Path(d).rglob("*.parquet"))
"""
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_entry_points():
    import __spark_entry__ as e

    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q) and len(q) > 180 and all(map(callable, q.values()))
    assert {"p3_found", "p4_found", "p5_found"} <= set(q)


def test_the_rest_stands_without_the_text_package(tmp_path):
    import shutil

    shutil.copytree(ROOT / "riverspark", tmp_path / "riverspark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 180 and not any(k.startswith('p6') for k in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)


DATA = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not DATA.exists(), reason="no test data")
@pytest.mark.parametrize("name", ["p1_river_load", "p3_found", "p4_found", "p5_found", "net1_dof", "net14_river_status", "jon7_nearest_reach", "agg28_sensitivity", "mc5_empirical"])
def test_queries_equal_their_sql(spark, name):
    sys.path.insert(0, str(ROOT / "tests"))
    from compare import compare

    text, same = compare(spark, name, str(DATA))
    assert same, text
