"""Points and lines in polygons, and convex hulls, without cross joins.

A polygon is the edges of its rings (ax, ay, bx, by), holes and further parts among them: inside is where a ray to the
right meets an odd number of edges, so rings need no order and no direction. Edges are gathered by strips of y, so a point
meets only those of its strip, of polygons whose strip reaches its grid cell; the count runs inside the row, in the JVM.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riverspark.functions.geometry import hull
from riverspark.operators.skew import salted_join
from riverspark.operators.spatial import on_grid

EDGE = ("ax", "ay", "bx", "by")
#: Regions that nearest_hulls sends to every task at most, and corners of all their hulls.
MAX_REGIONS, MAX_CORNERS = 10_000, 1_000_000


def ring_edges(wkb: bytes | None) -> np.ndarray:
    """The edges of all rings of a WKB polygon, multipolygon or collection, one row each; of lines their pieces; none for points, null and empty geometries."""
    out: list[np.ndarray] = []

    def read(at: int) -> int:
        e = "<" if wkb[at] == 1 else ">"
        u4 = lambda k: int(np.frombuffer(wkb, e + "u4", 1, k)[0])
        raw = u4(at + 1)
        flags, kind = raw >> 28, raw & 0x0FFFFFFF
        dims = 2 + (kind // 1000 in (1, 2)) + 2 * (kind // 1000 == 3) + bool(flags & 8) + bool(flags & 4)
        at, kind = at + 5 + 4 * bool(flags & 2), kind % 1000
        if kind == 1:
            return at + 8 * dims
        n, at = u4(at), at + 4
        if kind > 3:
            for _ in range(n):
                at = read(at)
            return at
        for _ in range(n if kind == 3 else 1):
            m, at = (u4(at), at + 4) if kind == 3 else (n, at)
            p = np.frombuffer(wkb, e + "f8", m * dims, at).reshape(m, dims)[:, :2]
            if m > 1:
                out.append(np.c_[p[:-1], p[1:]])
            at += 8 * dims * m
        return at

    if wkb:
        read(0)
    return np.concatenate(out).astype(float) if out else np.zeros((0, 4))


def edges_of(polygons: DataFrame, key: str, wkb: str = "wkb") -> DataFrame:
    """(key, ax, ay, bx, by): the edges of geometries in WKB; null and empty ones have none."""
    kind = polygons.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            each = [ring_edges(w) for w in b["_wkb"]]
            flat = np.concatenate([*each, np.zeros((0, 4))])
            yield pd.DataFrame({"_key": b["_key"].repeat([len(x) for x in each]).to_numpy()} | {c: flat[:, i] for i, c in enumerate(EDGE)})

    found = polygons.select(F.col(key).alias("_key"), F.col(wkb).alias("_wkb")).mapInPandas(run, f"_key {kind}, " + ", ".join(f"{c} double" for c in EDGE))
    return found.withColumnRenamed("_key", key)


def _usable(edges: DataFrame, key: str) -> DataFrame:
    fine = F.col(key).isNotNull()
    for c in EDGE:
        fine &= F.abs(F.col(c)) < 1e15  # neither null nor NaN nor infinite
    return edges.where(fine).select(F.col(key).alias("_key"), *EDGE)


def _inside(edges: Column, x: Column, y: Column) -> Column:
    def turn(odd: Column, e: Column) -> Column:
        meets = ((e["ay"] > y) != (e["by"] > y)) & (x < e["ax"] + (y - e["ay"]) * (e["bx"] - e["ax"]) / (e["by"] - e["ay"]))
        return F.when(meets, ~odd).otherwise(odd)

    return F.aggregate(edges, F.lit(False), turn)


def polygons_of(points: DataFrame, edges: DataFrame, key: str, x: str, y: str, cell: float) -> DataFrame:
    """points inner joined with the polygons (edges: key, ax, ay, bx, by) that hold them.

    A point on an edge that two polygons share is in exactly one of them. A point in several polygons has several rows;
    points with null coordinates are in none. Points of crowded cells are salted.
    """
    px, py = F.col(x), F.col(y)
    at = lambda c: F.floor(c / F.lit(float(cell))).cast("long")
    p = points.where(px.isNotNull() & py.isNotNull() & (F.abs(px) < 1e15) & (F.abs(py) < 1e15)).withColumn("_gx", at(px)).withColumn("_gy", at(py))
    e = _usable(edges, key).where("ay <> by").withColumn("_gy", F.explode(F.sequence(at(F.least("ay", "by")), at(F.greatest("ay", "by")))))
    strips = e.groupBy("_key", "_gy").agg(F.collect_list(F.struct(*EDGE)).alias("_edges"), F.min(F.least("ax", "bx")).alias("_lo"), F.max(F.greatest("ax", "bx")).alias("_hi"))
    held = strips.withColumn("_gx", F.explode(F.sequence(at(F.col("_lo")), at(F.col("_hi"))))).drop("_lo", "_hi")
    j = salted_join(p, held, ["_gx", "_gy"])
    return j.where(_inside(F.col("_edges"), px, py)).select(*[F.col(c) for c in points.columns], F.col("_key").alias(key))


def crossings(segments: DataFrame, edges: DataFrame, key: str, cell: float) -> DataFrame:
    """(sid, key) once each: segments (sid, ax, ay, bx, by) that have a point in common with an edge of a polygon."""
    corner = lambda f, c: f(f"{c}ax" if c else "ax", f"{c}bx" if c else "bx")
    s = segments.select("sid", *EDGE).withColumns({"_x0": corner(F.least, ""), "_x1": corner(F.greatest, ""), "_y0": F.least("ay", "by"), "_y1": F.greatest("ay", "by")})
    e = _usable(edges, key).select("_key", *[F.col(c).alias(f"e{c}") for c in EDGE])
    e = e.withColumns({"_u0": F.least("eax", "ebx"), "_u1": F.greatest("eax", "ebx"), "_v0": F.least("eay", "eby"), "_v1": F.greatest("eay", "eby")})
    j = salted_join(on_grid(s, "_x0", "_y0", "_x1", "_y1", cell), on_grid(e, "_u0", "_v0", "_u1", "_v1", cell), ["gx", "gy"])
    near = (F.col("_x0") <= F.col("_u1")) & (F.col("_u0") <= F.col("_x1")) & (F.col("_y0") <= F.col("_v1")) & (F.col("_v0") <= F.col("_y1"))

    def side(a: str, b: str, p: str) -> Column:
        """On which side of the line from a to b the point p lies: 1, 0 or -1."""
        c = lambda n: F.col(n)
        return F.signum((c(f"{b}x") - c(f"{a}x")) * (c(f"{p}y") - c(f"{a}y")) - (c(f"{b}y") - c(f"{a}y")) * (c(f"{p}x") - c(f"{a}x")))

    meet = (side("a", "b", "ea") * side("a", "b", "eb") <= 0) & (side("ea", "eb", "a") * side("ea", "eb", "b") <= 0)
    return j.where(near & meet).select("sid", F.col("_key").alias(key)).distinct()


def lines_meeting(segments: DataFrame, edges: DataFrame, key: str, cell: float) -> DataFrame:
    """(sid, key) once each: segments that touch or cross a polygon, or lie in it."""
    start = polygons_of(segments.select("sid", "ax", "ay"), edges, key, "ax", "ay", cell).select("sid", key)
    return crossings(segments, edges, key, cell).unionByName(start).distinct()


def lines_within(segments: DataFrame, edges: DataFrame, key: str, cell: float) -> DataFrame:
    """(sid, key) once each: segments that lie in a polygon and don't meet its edges."""
    a = polygons_of(segments.select("sid", "ax", "ay"), edges, key, "ax", "ay", cell).select("sid", key)
    return a.distinct().join(crossings(segments, edges, key, cell), ["sid", key], "left_anti")


def hulls(points: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """(key, ax, ay, bx, by): the edges of the convex hull of each group's points; one edge without length for a single place.

    Each task first takes the hulls of its own points, so a group is merged from a few corners a task, whatever its size.
    """
    kind = points.schema[key].dataType.simpleString()

    def corners(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[object, np.ndarray] = {}
        for b in batches:
            for k, g in b.groupby("_key"):
                held[k] = hull(np.concatenate([held.get(k, np.zeros((0, 2))), g[["_x", "_y"]].to_numpy(float)]))
        for k, h in held.items():
            yield pd.DataFrame({"_key": k, "_x": h[:, 0], "_y": h[:, 1]})

    def whole(g: pd.DataFrame) -> pd.DataFrame:
        h = hull(g[["_x", "_y"]].to_numpy(float))
        n = np.roll(h, -1, axis=0)
        return pd.DataFrame({key: g["_key"].iloc[0], "ax": h[:, 0], "ay": h[:, 1], "bx": n[:, 0], "by": n[:, 1]})

    slim = points.select(F.col(key).alias("_key"), F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).where("_key IS NOT NULL AND _x IS NOT NULL AND _y IS NOT NULL")
    part = slim.mapInPandas(corners, f"_key {kind}, _x double, _y double")
    return part.groupBy("_key").applyInPandas(whole, f"`{key}` {kind}, ax double, ay double, bx double, by double")


def nearest_hulls(points: DataFrame, edges: DataFrame, pid: str, x: str, y: str, key: str) -> DataFrame:
    """(pid, key): the convex region (edges: key, ax, ay, bx, by) nearest to each point, 0 away inside; equal distances: the lowest key.

    Regions are a small dimension (continents): at most MAX_REGIONS with MAX_CORNERS corners, which is checked, so they
    are sent to every task and folded inside a row, without a join.
    """
    e = _usable(edges, key)
    size = e.agg(F.countDistinct("_key").alias("k"), F.count(F.lit(1)).alias("n")).first()
    if size["k"] > MAX_REGIONS or size["n"] > MAX_CORNERS:
        raise ValueError(f"more than {MAX_REGIONS} regions or {MAX_CORNERS} corners")
    if not size["k"]:
        return points.select(pid, F.lit(None).cast(edges.schema[key].dataType).alias(key))
    one = e.groupBy("_key").agg(F.collect_list(F.struct(*EDGE)).alias("_e")).agg(F.collect_list(F.struct("_key", "_e")).alias("_r"))
    px, py = F.col(x), F.col(y)

    def away(r: Column) -> Column:
        def of(q: Column) -> Column:
            dx, dy = q["bx"] - q["ax"], q["by"] - q["ay"]
            t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide((px - q["ax"]) * dx + (py - q["ay"]) * dy, dx * dx + dy * dy), F.lit(0.0))))
            return F.pow(px - q["ax"] - t * dx, 2) + F.pow(py - q["ay"] - t * dy, 2)

        return F.struct(F.when(_inside(r["_e"], px, py), F.lit(0.0)).otherwise(F.array_min(F.transform(r["_e"], of))).alias("d"), r["_key"].alias("k"))

    best = F.array_min(F.transform("_r", away))
    return points.where(px.isNotNull() & py.isNotNull()).join(F.broadcast(one), F.lit(True)).select(pid, best["k"].alias(key))
