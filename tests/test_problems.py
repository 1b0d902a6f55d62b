"""The data-processing operators against brute force on small tables, with nulls, ties, repeats, empty tables and clashing columns."""

import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from riverspark.operators.proximity import near_pairs
from riverspark.operators.references import ForeignKey, orphan_cascade
from riverspark.operators.skew import Measure, heavy_keys, salted_aggregate, salted_join
from riverspark.session import cut
from riverspark.operators.snapshots import chunk_report, snapshot_changes


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


# 1: hot keys


def skewed(n=3000):
    r = random.Random(5)
    return [(None if r.random() < 0.05 else ("hot" if r.random() < 0.4 else f"k{r.randrange(200)}"), r.randrange(50) if r.random() < 0.9 else None, r.choice([None, 1.5, 2.25, -3.0])) for _ in range(n)]


def test_salted_aggregate_is_complete(spark):
    data = skewed()
    df = spark.createDataFrame(data, "k string, unit int, v double").withColumn("_salt", F.lit("x")).withColumn("_heavy", F.lit(1)).withColumn("_n", F.lit(2))
    got = salted_aggregate(df, ["k"], {"n": Measure("count"), "d": Measure("distinct", F.col("unit")), "s": Measure("sum", F.col("v")), "m": Measure("mean", F.col("v")), "lo": Measure("min", F.col("v")), "hi": Measure("max", F.col("v")), "var": Measure("var_pop", F.col("v"))}, salts=8)
    want = defaultdict(list)
    for k, u, v in data:
        want[k].append((u, v))
    out = {r["k"]: r for r in got.collect()}
    assert set(out) == set(want)
    for k, xs in want.items():
        vs = [v for _, v in xs if v is not None]
        mean = sum(vs) / len(vs) if vs else None
        r = out[k]
        assert (r["n"], r["d"]) == (len(xs), len({u for u, _ in xs if u is not None}))
        assert r["s"] == pytest.approx(sum(vs)) if vs else r["s"] is None
        assert r["m"] == (pytest.approx(mean) if vs else None)
        assert (r["lo"], r["hi"]) == ((min(vs), max(vs)) if vs else (None, None))
        assert r["var"] == (pytest.approx(sum((v - mean) ** 2 for v in vs) / len(vs), abs=1e-9) if vs else None)


def test_salted_aggregate_without_distinct_and_empty(spark):
    df = spark.createDataFrame(skewed(500), "k string, unit int, v double")
    plain = rows(df.groupBy("k").agg(F.count(F.lit(1)), F.sum("v")))
    assert rows(salted_aggregate(df, ["k"], {"n": Measure("count"), "s": Measure("sum", F.col("v"))}, unit="unit")) == plain
    assert rows(salted_aggregate(df.limit(0), ["k"], {"n": Measure("count"), "d": Measure("distinct", F.col("unit"))})) == []
    with pytest.raises(ValueError):
        salted_aggregate(df, ["k"], {"a": Measure("distinct", F.col("unit")), "b": Measure("distinct", F.col("v"))})


def test_heavy_keys_are_few(spark):
    df = spark.createDataFrame(skewed(), "k string, unit int, v double")
    h = heavy_keys(df, ["k"], 0.1).collect()
    assert [r["k"] for r in h] == ["hot"]


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_join(spark, how):
    a = spark.createDataFrame(skewed(800), "k string, unit int, v double").withColumn("_salt", F.lit(1)).withColumn("_heavy", F.lit(True))
    b = spark.createDataFrame([("hot", 1), ("hot", 2), ("k1", 3), ("k5", 4), (None, 5)], "k string, w int")
    cols = ["k", "unit", "v", "_salt", "_heavy"] + (["w"] if how in ("inner", "left") else [])
    assert rows(salted_join(a, b, ["k"], how, salts=4).select(cols)) == rows(a.join(b, "k", how).select(cols))
    with pytest.raises(ValueError):
        salted_join(a, b.withColumnRenamed("w", "v"), ["k"])


# 3: proximity


def away(p, s, kind):
    (px, py), (ax, ay, bx, by) = p, s
    if kind == "box":
        return math.hypot(max(ax - px, px - bx, 0), max(ay - py, py - by, 0))
    dx, dy = bx - ax, by - ay
    n = dx * dx + dy * dy
    t = min(max(((px - ax) * dx + (py - ay) * dy) / n, 0), 1) if n else 0
    return math.hypot(px - ax - t * dx, py - ay - t * dy)


@pytest.mark.parametrize("lot", [20_000, 40, 1])
@pytest.mark.parametrize("kind", ["segment", "box"])
def test_near_pairs_equal_brute_force(spark, kind, lot):
    r = random.Random(11)
    pts = [(k, r.uniform(1, 3000), r.uniform(-500, 3000)) for k in range(300)] + [(k, 100.0, 100.0) for k in range(300, 420)] + [(500, 40.0, 200.0)]
    shp = []
    for k in range(150):
        x, y = r.uniform(0, 3000), r.uniform(0, 3000)
        w, h = r.choice([(5, 5), (200, 10), (0, 0), (2500, 900)])
        shp.append((k, x, y, x + w, y + h))
    bad_p = [(900, None, 1.0), (901, 0.0, 0.0), (902, float("nan"), 1.0), (None, 5.0, 5.0), (903, float("inf"), 2.0)]
    bad_s = [(900, None, 1.0, 1.0, 1.0), (None, 1.0, 1.0, 1.0, 1.0), (901, float("nan"), 0.0, 1.0, 1.0)]
    p = spark.createDataFrame(pts + pts[:5] + bad_p, "pid long, x double, y double").withColumn("strip", F.lit("s"))
    s = spark.createDataFrame(shp + shp[:9] + bad_s, "sid long, ax double, ay double, bx double, by double").withColumn("kind", F.lit("s"))
    reach = 120.0
    want, every = [], []
    for i, x, y in pts:
        d = sorted((away((x, y), q, kind), k) for k, *q in shp)
        every += [(i, k) for a, k in d if a <= reach]
        if d[0][0] <= reach:
            want.append((i, d[0][1]))
    near = near_pairs(p, s, reach, kind, strip=200.0, lot=lot)
    assert sorted((x["pid"], x["sid"]) for x in near.collect()) == sorted(want)
    whole = near_pairs(p, s, reach, kind, nearest=False, strip=200.0, lot=lot)
    assert sorted((x["pid"], x["sid"]) for x in whole.collect()) == sorted(every)


def test_near_pairs_others_ties_and_empty(spark):
    p = spark.createDataFrame([(1, 10.0, 10.0), (2, 12.0, 10.0), (3, 8.0, 10.0), (4, 500.0, 500.0)], "pid long, x double, y double")
    s = p.select(F.col("pid").alias("sid"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("x").alias("bx"), F.col("y").alias("by"))
    assert rows(near_pairs(p, s, 5.0, others=True).select("pid", "sid")) == [(1, 2), (2, 1), (3, 1)]
    assert rows(near_pairs(p.limit(0), s, 5.0)) == [] and rows(near_pairs(p, s.limit(0), 5.0)) == []
    with pytest.raises(ValueError):
        near_pairs(p, s, -1.0)


@pytest.mark.parametrize("density", [1, 10, 100])
def test_copies_of_shapes_dont_grow_with_density(spark, density):
    from riverspark.operators.proximity import _cells

    n, side = 2_000 * density, 400_000.0
    at = lambda k: F.rand(k) * side
    p = spark.range(n).select(F.col("id").alias("pid"), at(1).alias("x"), at(2).alias("y"))
    s = spark.range(n).select(F.col("id").alias("sid"), at(3).alias("ax"), at(4).alias("ay")).withColumn("bx", F.col("ax") + 500).withColumn("by", F.col("ay") + 900)
    cells = _cells(p, s, 5_000.0, 40_000.0, 500, "segment", (0.0, 0.0, side, side), n)
    assert cells.count() <= 1.3 * 2 * n
    assert cells.where("kind = 1").count() == n
    plan = near_pairs(p, s, 5_000.0)._jdf.queryExecution().toString()
    assert "rangepartitioning" in plan.lower()


def test_a_dense_place_and_a_garbled_shape(spark):
    r = random.Random(4)
    pts = [(k, 1000 + r.random(), 1000 + r.random()) for k in range(400)] + [(k, r.uniform(1, 9000), r.uniform(1, 9000)) for k in range(400, 450)]
    shp = [(k, 1000 + r.random(), 1000 + r.random(), 1001.0, 1001.0) for k in range(200)] + [(900, 5000.0, 5000.0, 9e14, 5000.0)]
    p, s = spark.createDataFrame(pts, "pid long, x double, y double"), spark.createDataFrame(shp, "sid long, ax double, ay double, bx double, by double")
    want = {}
    for i, x, y in pts:
        d = min((away((x, y), q, "segment"), k) for k, *q in shp)
        if d[0] <= 300:
            want[i] = d[1]
    assert {x["pid"]: x["sid"] for x in near_pairs(p, s, 300.0, lot=2).collect()} == want


# 4: snapshots


def changes(data, tolerance=1e-6):
    held = {}
    for y, g, v, t in data:
        if y is None or g is None:
            continue
        if (y, g) not in held or (t, v is not None, v) > held[y, g]:
            held[y, g] = (t, v is not None, v)
    out = []
    years = sorted({y for y, _ in held})
    for a, b in zip(years, years[1:]):
        old, new = ({g: x[2] for (y, g), x in held.items() if y == k} for k in (a, b))
        for g in old.keys() | new.keys():
            if g not in old:
                out.append((b, g, "added"))
            elif g not in new:
                out.append((b, g, "removed"))
            elif (old[g] is None) != (new[g] is None) or old[g] is not None and abs(old[g] - new[g]) > tolerance:
                out.append((b, g, "changed"))
    return sorted(out)


@pytest.mark.parametrize("chunk, span", [(8, 4096), (1, 3), (64, 50)])
def test_snapshot_changes_equal_brute_force(spark, chunk, span):
    r = random.Random(2)
    base = {g: round(r.random() * 100, 4) for g in range(-300, 700)}
    data = []
    for y in (2010, 2015, 2020):
        for g, v in list(base.items()):
            u = r.random()
            if u < 0.03:
                del base[g]
                continue
            if u < 0.08:
                base[g] = r.choice([None, round(r.random() * 100, 4)])
            v = base[g]
            noise = v if v is None or r.random() < 0.5 else v + r.choice([1e-9, -1e-8])
            data.append((y, g, noise, 1))
            if r.random() < 0.1:
                data += [(y, g, 7.0, 0), (y, g, noise, 1)]
        base |= {g: 1.0 for g in range(r.randrange(1000, 2000), 2010)}
    data += [(None, 1, 1.0, 1), (2010, None, 1.0, 1)]
    df = spark.createDataFrame(data, "y int, g long, v double, t int").withColumn("snap", F.lit("x")).withColumn("key", F.lit(0)).withColumn("val", F.lit(0))
    got = sorted(map(tuple, snapshot_changes(df, "y", "g", F.col("v"), order="t", chunk_rows=chunk, range_keys=span).collect()))
    assert got == changes(data)


def test_snapshot_changes_edges(spark):
    one = spark.createDataFrame([(2010, 1, 1.0)], "y int, g long, v double")
    assert rows(snapshot_changes(one, "y", "g", F.col("v"))) == []
    assert rows(snapshot_changes(one.limit(0), "y", "g", F.col("v"))) == []
    near = spark.createDataFrame([(1, 5, 1.0), (2, 5, 1.0 + 0.9e-6), (3, 5, 1.0 + 2.1e-6)], "y int, g long, v double")
    assert rows(snapshot_changes(near, "y", "g", F.col("v"))) == [(3, 5, "changed")]


def test_digests_discard_what_is_equal(spark):
    old = [(1, g, float(g), 1) for g in range(20_000)]
    clustered = old + [(2, g, float(g) + (g < 2_000), 1) for g in range(20_000)]
    scattered = old + [(2, g, float(g) + (g % 10 == 0), 1) for g in range(20_000)]
    for data, least, most in ((clustered, 0.88, 0.9), (scattered, 0.1, 0.6)):
        df = spark.createDataFrame(data, "y int, g long, v double, t int")
        r = chunk_report(df, "y", "g", F.col("v"), order="t").first()
        assert r["n_rows"] == 20_000 and r["n_open_chunks"] < r["n_chunks"]
        assert least <= 1 - r["n_open_rows"] / r["n_rows"] <= most
        assert snapshot_changes(df, "y", "g", F.col("v"), order="t").count() == 2_000
    assert rows(chunk_report(df.limit(0), "y", "g", F.col("v"))) == []


# 5: references


def table_of(spark, data, schema="rec_id long, period int, own string, up string, valid_from int, valid_to int"):
    return spark.createDataFrame(data, schema).withColumn("_p", F.lit(9)).withColumn("level", F.lit(9))


def test_orphan_cascade(spark):
    nodes = table_of(spark, [
        (1, 2010, "a", None, None, None), (2, 2010, "b", "a", None, None), (3, 2010, "c", "gone", None, None), (4, 2010, "d", "c", None, None), (5, 2010, "e", "d", None, None),
        (6, 2010, "x", "y", None, None), (7, 2010, "y", "x", None, None), (8, 2010, "s", "s", None, None), (3, 2010, "c", "gone", None, None), (9, 2015, "late", None, 2012, 2016), (10, 2010, None, "late", None, None),
    ])
    leaf = table_of(spark, [(100, 2010, None, "e", None, None), (101, 2010, None, "a", None, None), (102, 2010, None, None, None, None), (103, None, None, "zzz", None, None), (104, 2014, None, "late", None, None)])
    out = orphan_cascade({"n": nodes, "l": leaf}, [ForeignKey("n", "up", "n", "own"), ForeignKey("l", "up", "n", "own")])
    assert rows(out.select("src_table", "rec_id", "level", "kind")) == sorted([("n", 3, 0, "direct"), ("n", 4, 1, "inherited"), ("n", 5, 2, "inherited"), ("n", 10, 0, "direct"), ("l", 100, 3, "inherited"), ("l", 103, 0, "direct")], key=repr)


def test_orphans_of_a_shared_key_and_a_cycle_below_an_orphan(spark):
    nodes = table_of(spark, [(1, 1, "k", "gone", None, None), (2, 1, "k", None, None, None), (3, 1, "m", "k", None, None), (4, 1, "p", "gone", None, None), (5, 1, "q", "p", None, None), (5, 1, "q", "r", None, None), (6, 1, "r", "q", None, None)])
    out = orphan_cascade({"n": nodes}, [ForeignKey("n", "up", "n", "own")])
    assert rows(out.select("rec_id", "ref", "level")) == [(1, "gone", 0), (4, "gone", 0), (5, "p", 1), (5, "r", 3), (6, "q", 2)]


def test_a_deep_cascade_takes_few_rounds(spark, monkeypatch):
    import riverspark.operators.references as m

    written = []
    monkeypatch.setattr(m, "cut", lambda df, name="cut": written.append(name) or cut(df, name))
    chain = table_of(spark, [(k, 1, f"n{k}", f"n{k - 1}", None, None) for k in range(1, 1001)])
    out = orphan_cascade({"n": chain}, [ForeignKey("n", "up", "n", "own")])
    assert sorted((r["rec_id"], r["level"]) for r in out.collect()) == [(k, k - 1) for k in range(1, 1001)]
    assert len(written) <= 5 + 2 * 11
    two = chain.unionByName(table_of(spark, [(2000, 1, "n7", None, None, None)]))
    deep = orphan_cascade({"n": two}, [ForeignKey("n", "up", "n", "own")], max_rounds=10)
    assert deep.count() == 7  # n7 has another row, which is no orphan
    with pytest.raises(ValueError):
        orphan_cascade({"n": two.where("rec_id <> 2000").unionByName(table_of(spark, [(3000, 1, "n5", "gone", None, None)]))}, [ForeignKey("n", "up", "n", "own")], max_rounds=10)


def test_orphans_edges(spark):
    e = table_of(spark, [])
    assert rows(orphan_cascade({"n": e}, [ForeignKey("n", "up", "n", "own")])) == []
    assert rows(orphan_cascade({"l": e, "n": e}, [ForeignKey("l", "up", "n", "own")])) == []
    with pytest.raises(ValueError):
        orphan_cascade({}, [])
    hot = table_of(spark, [(k, 1, None, "gone" if k % 3 else "here", None, None) for k in range(900)])
    got = orphan_cascade({"l": hot, "n": table_of(spark, [(1, None, "here", None, None, None)])}, [ForeignKey("l", "up", "n", "own")])
    assert got.count() == 600
