"""Polygons against brute force, with holes, parts, shared edges, odd geometries and nulls."""

import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from riverspark.operators.polygons import crossings, edges_of, hull, hulls, lines_meeting, lines_within, nearest_hulls, polygons_of, ring_edges


def wkb(*rings, order="<", multi=False):
    head = struct.pack(order + "BII", int(order == "<"), 3, len(rings)) if order == "<" else b"\0" + struct.pack(">II", 3, len(rings))
    body = head + b"".join(struct.pack(order + "I", len(r)) + b"".join(struct.pack(order + "dd", *p) for p in r) for r in rings)
    return struct.pack("<BII", 1, 6, 1) + body if multi else body


SQUARE = [(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)]
HOLE = [(4, 4), (6, 4), (6, 6), (4, 6), (4, 4)]
ELL = [(10, 0), (20, 0), (20, 5), (15, 5), (15, 10), (10, 10), (10, 0)]
SHAPES = {1: [SQUARE, HOLE], 2: [ELL]}


def inside(rings, x, y):
    odd = False
    for r in rings:
        for (ax, ay), (bx, by) in zip(r, r[1:]):
            if (ay > y) != (by > y) and x < ax + (y - ay) * (bx - ax) / (by - ay):
                odd = not odd
    return odd


def polygons(spark):
    data = [(1, wkb(SQUARE, HOLE)), (2, wkb(ELL, order=">", multi=True)), (3, None), (4, struct.pack("<BII", 1, 3, 0)), (5, struct.pack("<BIdd", 1, 1, 3.0, 3.0)), (None, wkb(SQUARE))]
    return edges_of(spark.createDataFrame(data, "id long, wkb binary").withColumn("_key", F.lit("x")), "id")


def test_ring_edges():
    assert ring_edges(wkb(SQUARE, HOLE)).shape == (8, 4) and ring_edges(wkb(ELL, order=">", multi=True)).tolist() == ring_edges(wkb(ELL)).tolist()
    assert ring_edges(None).shape == ring_edges(b"").shape == (0, 4)
    z = struct.pack("<BII", 1, 1002, 2) + struct.pack("<6d", 0, 1, 9, 2, 3, 9)
    assert ring_edges(z).tolist() == [[0, 1, 2, 3]]


@pytest.mark.parametrize("cell", [3.0, 100.0])
def test_points_in_polygons(spark, cell):
    r = random.Random(3)
    pts = [(k, r.uniform(-1, 21), r.uniform(-1, 11)) for k in range(300)] + [(900, 10.0, 3.0), (901, 5.0, 5.0), (902, None, 3.0), (903, float("nan"), 1.0)]
    p = spark.createDataFrame(pts, "pid long, x double, y double").withColumn("gx", F.lit("clash"))
    got = sorted((x["pid"], x["id"]) for x in polygons_of(p, polygons(spark), "id", "x", "y", cell).collect())
    assert got == sorted((k, i) for k, x, y in pts if x is not None and x == x for i, rings in SHAPES.items() if inside(rings, x, y))
    assert [i for k, i in got if k == 900] == [2] and 901 not in dict(got)
    assert polygons_of(p.limit(0), polygons(spark), "id", "x", "y", cell).count() == polygons_of(p, polygons(spark).limit(0), "id", "x", "y", cell).count() == 0


def test_lines_and_polygons(spark):
    s = spark.createDataFrame([(1, 1.0, 1.0, 2.0, 2.0), (2, 1.0, 1.0, 30.0, 1.0), (3, 3.0, 5.0, 7.0, 5.0), (4, 30.0, 0.0, 40.0, 0.0), (5, -5.0, -5.0, 5.0, 0.0), (6, 16.0, 7.0, 19.0, 9.0), (7, None, 1.0, 1.0, 1.0)], "sid long, ax double, ay double, bx double, by double")
    e = polygons(spark)
    pairs = lambda df: sorted((x["sid"], x["id"]) for x in df.collect())
    assert pairs(lines_meeting(s, e, "id", 4.0)) == [(1, 1), (2, 1), (2, 2), (3, 1), (5, 1)]
    assert pairs(lines_within(s, e, "id", 4.0)) == [(1, 1)]
    assert pairs(crossings(s, e, "id", 4.0)) == [(2, 1), (2, 2), (3, 1), (5, 1)]


def test_hulls_and_nearest(spark):
    r = np.random.default_rng(1)
    a, b = r.normal(0, 1, (400, 2)), r.normal((10, 0), 1, (300, 2))
    assert hull(np.array([[0, 0], [2, 0], [1, 0], [1, 2], [1, 1]], float)).tolist() == [[0, 0], [2, 0], [1, 2]]
    data = [("a", *map(float, p)) for p in a] + [("b", *map(float, p)) for p in b] + [("c", 5.0, 9.0), (None, 0.0, 0.0), ("c", None, 1.0)]
    h = hulls(spark.createDataFrame(data, "k string, x double, y double").repartition(5), "k", "x", "y")
    assert {x["k"]: x["n"] for x in h.groupBy("k").agg(F.count(F.lit(1)).alias("n")).collect()} == {"a": len(hull(a)), "b": len(hull(b)), "c": 1}
    p = spark.createDataFrame([(1, 0.1, 0.1), (2, 9.0, 0.5), (3, 5.0, 8.0), (4, 4.0, 0.0), (5, None, 0.0)], "pid long, x double, y double")
    got = {x["pid"]: x["k"] for x in nearest_hulls(p, h, "pid", "x", "y", "k").collect()}
    gap = {k: min(np.hypot(*(v - (4, 0)).T)) for k, v in (("a", a), ("b", b))}
    assert got == {1: "a", 2: "b", 3: "c", 4: min(gap, key=gap.get)}
    assert nearest_hulls(p, h.limit(0), "pid", "x", "y", "k").where("k IS NOT NULL").count() == 0
