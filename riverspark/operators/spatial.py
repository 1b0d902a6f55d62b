"""Regions, overlaps and neighbours without cross joins: cells of a grid turn predicates into equi-joins."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riverspark.functions.geometry import EARTH_KM, haversine_km, segment_meets_box
from riverspark.operators.skew import salted_join
from riverspark.session import cut

#: Places of one cube of the first search in knn.
LOAD = 64


def _cells(lo: Column, hi: Column, cell: float) -> Column:
    return F.sequence(F.floor(lo / F.lit(cell)).cast("long"), F.floor(hi / F.lit(cell)).cast("long"))


def on_grid(df: DataFrame, x0: str, y0: str, x1: str, y1: str, cell: float) -> DataFrame:
    """df once per grid cell that its bounds touch, as (gx, gy); rows with null bounds are in none."""
    fine = df.where(" AND ".join(f"`{c}` IS NOT NULL" for c in (x0, y0, x1, y1)))
    return fine.withColumn("gx", F.explode(_cells(F.col(x0), F.col(x1), cell))).withColumn("gy", F.explode(_cells(F.col(y0), F.col(y1), cell)))


def regions_of(points: DataFrame, boxes: DataFrame, key: str, x: str, y: str, cell: float, strict: bool = True) -> DataFrame:
    """points inner joined with the boxes (key, min_x, min_y, max_x, max_y) that hold them; strict excludes the edges.

    A cell may hold a third of all points: points of crowded cells are salted. A point in several boxes has several rows.
    """
    p = points.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("gx", F.floor(F.col(x) / F.lit(cell)).cast("long")).withColumn("gy", F.floor(F.col(y) / F.lit(cell)).cast("long"))
    b = on_grid(boxes.select(F.col(key).alias("_key"), F.col("min_x").alias("_x0"), F.col("min_y").alias("_y0"), F.col("max_x").alias("_x1"), F.col("max_y").alias("_y1")), "_x0", "_y0", "_x1", "_y1", cell)
    j = salted_join(p, b, ["gx", "gy"])
    px, py = F.col(x), F.col(y)
    inside = ((px > F.col("_x0")) & (px < F.col("_x1")) & (py > F.col("_y0")) & (py < F.col("_y1"))) if strict else ((px >= F.col("_x0")) & (px <= F.col("_x1")) & (py >= F.col("_y0")) & (py <= F.col("_y1")))
    return j.where(inside).drop("gx", "gy", "_x0", "_y0", "_x1", "_y1").withColumnRenamed("_key", key)


def segments_meeting(segments: DataFrame, boxes: DataFrame, key: str, cell: float) -> DataFrame:
    """(sid, key) once each: segments (sid, ax, ay, bx, by) that have a point in common with a box."""
    s = segments.withColumn("_lx", F.least("ax", "bx")).withColumn("_ly", F.least("ay", "by")).withColumn("_hx", F.greatest("ax", "bx")).withColumn("_hy", F.greatest("ay", "by"))
    s = on_grid(s, "_lx", "_ly", "_hx", "_hy", cell)
    b = on_grid(boxes.select(key, F.col("min_x").alias("_x0"), F.col("min_y").alias("_y0"), F.col("max_x").alias("_x1"), F.col("max_y").alias("_y1")), "_x0", "_y0", "_x1", "_y1", cell)
    c = F.col
    return salted_join(s, b, ["gx", "gy"]).where(segment_meets_box(c("ax"), c("ay"), c("bx"), c("by"), c("_x0"), c("_y0"), c("_x1"), c("_y1"))).select("sid", key).distinct()


def overlaps(a: DataFrame, b: DataFrame, by: list[str], cell: float) -> DataFrame:
    """(by, a_id, b_id) once each: boxes of a and b (id, xmin, ymin, xmax, ymax) in one group whose insides overlap.

    Boxes meet in the cells they touch; boxes that only share an edge don't overlap.
    """
    ga = on_grid(a.select(*by, F.col("id").alias("a_id"), *[F.col(c).alias(f"a_{c}") for c in ("xmin", "ymin", "xmax", "ymax")]), "a_xmin", "a_ymin", "a_xmax", "a_ymax", cell)
    gb = on_grid(b.select(*by, F.col("id").alias("b_id"), *[F.col(c).alias(f"b_{c}") for c in ("xmin", "ymin", "xmax", "ymax")]), "b_xmin", "b_ymin", "b_xmax", "b_ymax", cell)
    hit = (F.col("a_xmin") < F.col("b_xmax")) & (F.col("b_xmin") < F.col("a_xmax")) & (F.col("a_ymin") < F.col("b_ymax")) & (F.col("b_ymin") < F.col("a_ymax"))
    return salted_join(ga, gb, [*by, "gx", "gy"]).where(hit).select(*by, "a_id", "b_id").distinct()


def nearest_regions(points: DataFrame, regions: DataFrame, pid: str, x: str, y: str, key: str) -> DataFrame:
    """(pid, key): the region (key, min_x …) nearest to each point; equal distances: the lowest key.

    Regions are a small dimension (continents): at most 10,000, which is checked, so they are sent to every task and
    folded inside a row, without a join.
    """
    rows = regions.select(key, "min_x", "min_y", "max_x", "max_y").where("min_x IS NOT NULL AND max_x IS NOT NULL").limit(10_001).collect()
    if len(rows) > 10_000:
        raise ValueError("more than 10000 regions")
    if not rows:
        return points.select(pid, F.lit(None).cast(regions.schema[key].dataType).alias(key))
    spark = points.sparkSession
    one = spark.createDataFrame(rows, regions.select(key, "min_x", "min_y", "max_x", "max_y").schema).agg(F.collect_list(F.struct(key, "min_x", "min_y", "max_x", "max_y")).alias("_r"))
    px, py = F.col(x), F.col(y)

    def away(r: Column) -> Column:
        dx = F.greatest(r["min_x"] - px, px - r["max_x"], F.lit(0.0))
        dy = F.greatest(r["min_y"] - py, py - r["max_y"], F.lit(0.0))
        return F.struct((dx * dx + dy * dy).alias("d"), r[key].alias("k"))

    best = F.array_min(F.transform("_r", away))
    return points.where(px.isNotNull() & py.isNotNull()).join(F.broadcast(one), F.lit(True)).select(pid, best["k"].alias(key))


def knn(places: DataFrame, k: int, by: list[str] | None = None) -> DataFrame:
    """(by, i, j, d, w): the k nearest other places (id, lon, lat) of each by great-circle distance, row-standardised weights.

    min(k, n-1) neighbours of a group of n; equal distances: the lower id. Places are points of the unit sphere in a grid of
    cubes, so neither poles nor the date line are special. The first cubes are so small that none holds more than LOAD
    places (or as small as useful). A place meets those of its own and the 26 neighbouring cubes; what lies outside is
    further away than a cube's side. Places whose k-th neighbour isn't closer than that are searched again with cubes
    twice as large, until none is left.
    """
    by = by or []
    p = places.where("lon IS NOT NULL AND lat IS NOT NULL AND NOT isnan(lon) AND NOT isnan(lat)").select(*by, "id", "lon", "lat").distinct()
    flat = F.cos(F.radians("lat"))
    p = cut(p.withColumns({"_x": flat * F.cos(F.radians("lon")), "_y": flat * F.sin(F.radians("lon")), "_z": F.sin(F.radians("lat"))}), "places")
    sizes = p.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")) if by else p.agg(F.count(F.lit(1)).alias("_n"))
    todo = p.join(F.broadcast(sizes), by) if by else p.join(F.broadcast(sizes), F.lit(True))
    cube = lambda size: [F.floor(F.col(c) / F.lit(size)).cast("int").alias(f"_c{c}") for c in ("_x", "_y", "_z")]
    cells = ["_c_x", "_c_y", "_c_z"]
    side = 1.0
    while side > 1e-5 and (p.select(*by, *cube(side)).groupBy(*by, *cells).count().agg(F.max("count")).first()[0] or 0) > max(LOAD, 8 * k):
        side /= 2
    done = None
    around = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c")) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)])
    while True:
        near = todo.select(*by, F.col("id").alias("i"), F.col("lon").alias("x1"), F.col("lat").alias("y1"), "_n", *cube(side), F.explode(around).alias("_o"))
        near = near.select(*by, "i", "x1", "y1", "_n", *[(F.col(c) + F.col(f"_o.{o}")).alias(c) for c, o in zip(cells, "abc")])
        other = p.select(*by, F.col("id").alias("j"), F.col("lon").alias("x2"), F.col("lat").alias("y2"), *cube(side))
        c = near.join(other, [*by, *cells]).where("i <> j").withColumn("d", haversine_km(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")))
        r = c.withColumn("r", F.row_number().over(Window.partitionBy(*by, "i").orderBy("d", "j"))).where(F.col("r") <= k)
        most = Window.partitionBy(*by, "i")
        r = r.withColumn("_got", F.count(F.lit(1)).over(most)).withColumn("_far", F.max("d").over(most))
        whole = side >= 2
        sure = F.lit(True) if whole else (F.col("_got") == F.least(F.lit(k), F.col("_n") - 1)) & (F.col("_far") < F.lit(2 * EARTH_KM * math.asin(side / 2)))
        good = cut(r.where(sure).select(*by, "i", "j", "d"), "neighbours")
        done = good if done is None else done.unionByName(good)
        todo = cut(todo.join(good.select(*by, F.col("i").alias("id")).distinct(), [*by, "id"], "left_anti"), "lonely")
        if whole or todo.isEmpty():
            break
        side *= 2
    return done.withColumn("w", F.lit(1.0) / F.count(F.lit(1)).over(Window.partitionBy(*by, "i")))
