"""Points near points, segments or regions.

Latitude is cut into strips, and a strip's longitudes into columns. A point belongs to the one cell (strip, column) that
holds it, a shape to every cell within reach of it: so each pair has one owner, the point's cell. Cells are 8 by 16 times
the reach, so that the overlap adds two fifths of the shapes at most, at any density. Cells are range-partitioned in the
order of strip and column, so neighbours share a task, and sorted by longitude; one pass keeps the active set, the shapes
whose x-range is within reach of the sweep line, and measures exact planar distances to active shapes only. Where only
the nearest shape is asked for, an eighth of the reach is searched first, so a dense place costs little more than a
sparse one. Memory is one Arrow batch and the active set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Height of a strip without a reach; points of a cell that stay together, and the share of all rows (1/CROWDED) below which they always do.
STRIP, LOT, CROWDED = 40_000.0, 100_000, 5_000
#: Lots of shapes are so many times larger; a lot of points holds at least SPARE times the shapes that are copied to it.
SHAPE_LOTS, SPARE = 20, 5
#: Pairs measured at once.
BLOCK_PAIRS = 2_000_000


def usable(x: str, y: str) -> Column:
    """Coordinates that can be used: not null, not NaN or infinite, not 0/0."""
    fine = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < F.lit(1e15))
    return fine(x) & fine(y) & ~((F.col(x) == 0) & (F.col(y) == 0))


def segment_distance(px, py, ax, ay, bx, by):
    """Planar distance of points to segments; a segment of length 0 is a point."""
    dx, dy = bx - ax, by - ay
    length = dx * dx + dy * dy
    t = np.where(length > 0, ((px - ax) * dx + (py - ay) * dy) / np.where(length > 0, length, 1.0), 0.0)
    t = np.clip(t, 0.0, 1.0)
    return np.hypot(px - (ax + t * dx), py - (ay + t * dy))


def box_distance(px, py, ax, ay, bx, by):
    """Planar distance of points to boxes, 0 inside."""
    return np.hypot(np.maximum(np.maximum(ax - px, px - bx), 0.0), np.maximum(np.maximum(ay - py, py - by), 0.0))


def _cells(points: DataFrame, shapes: DataFrame, reach: float, strip: float, lot: int, kind: str, box: tuple[float, ...], rows: int) -> DataFrame:
    """Points and shapes as rows of (strip, col, lots): kind 0 shapes come before kind 1 points at the same place of the sweep.

    A cell with very many points is cut into lots of points by hash, each with all shapes of the cell; a lot holds SPARE
    times as many points as shapes, so this adds a fifth of the points at most. Only beyond SHAPE_LOTS*lot shapes in one
    cell are the shapes cut as well, and the points repeated once a lot of shapes.
    """
    width = 2 * strip
    at = lambda c, size: F.floor(c / F.lit(size)).cast("long")
    p = points.select(F.lit(1).alias("kind"), F.col("pid").alias("id"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("x").alias("bx"), F.col("y").alias("by"), at(F.col("y"), strip).alias("strip"), at(F.col("x"), width).alias("col"))
    wide = reach * (1 + 1e-9) + 1e-6

    def over(lo: Column, hi: Column, size: float, first: float, last: float) -> Column:
        # only the points' strips and columns: a garbled shape of any length stays bounded
        a, b = (at(F.greatest(F.lit(first), F.least(F.lit(last), c)), size) for c in (lo, hi))
        return F.explode(F.when((lo <= F.lit(last)) & (hi >= F.lit(first)), F.sequence(a, b)))

    s = shapes.select(F.lit(0).alias("kind"), F.col("sid").alias("id"), "ax", "ay", "bx", "by", over(F.least("ay", "by") - F.lit(wide), F.greatest("ay", "by") + F.lit(wide), strip, box[1], box[3]).alias("strip"))
    x0, x1 = F.col("ax"), F.col("bx")
    if kind == "segment":  # the x-range of a segment inside the strip and its surroundings
        dy = F.col("by") - F.col("ay")
        t = lambda y: F.when(F.abs(dy) > 1e-9, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (y - F.col("ay")) / dy)))
        low, high = F.col("strip") * F.lit(strip) - F.lit(wide), (F.col("strip") + 1) * F.lit(strip) + F.lit(wide)
        x0, x1 = (F.coalesce(F.col("ax") + t(y) * (F.col("bx") - F.col("ax")), F.col(c)) for y, c in ((low, "ax"), (high, "bx")))
    s = s.withColumn("col", over(F.least(x0, x1) - F.lit(wide), F.greatest(x0, x1) + F.lit(wide), width, box[0], box[2]))
    both = p.unionByName(s)
    # crowded cells hold more than 1/CROWDED of the rows, so there are a few times CROWDED of them at most: safe to broadcast
    load = both.groupBy("strip", "col").agg(F.sum("kind").alias("np"), F.sum(1 - F.col("kind")).alias("ns"))
    share = F.lit(float(rows) / CROWDED)
    of_shapes = F.greatest(F.lit(float(SHAPE_LOTS * lot)), share)
    of_points = F.greatest(F.lit(float(lot)), share, F.lit(float(SPARE)) * F.least(F.col("ns"), of_shapes))
    lots = load.withColumn("plots", F.ceil(F.col("np") / of_points).cast("int")).withColumn("slots", F.ceil(F.col("ns") / of_shapes).cast("int"))
    crowded = lots.where("np > 0 AND ns > 0 AND (plots > 1 OR slots > 1)").select("strip", "col", "plots", "slots")
    # rows of lot (i, j): the i-th lot of points against the j-th lot of shapes
    own = F.xxhash64("id", "ax", "ay", "bx", "by")
    j = both.join(F.broadcast(crowded), ["strip", "col"], "left").withColumn("plots", F.coalesce("plots", F.lit(1))).withColumn("slots", F.coalesce("slots", F.lit(1)))
    j = j.withColumn("pl", F.when(F.col("kind") == 1, F.array(F.pmod(own, F.col("plots")).cast("int"))).otherwise(F.sequence(F.lit(0), F.col("plots") - 1)))
    j = j.withColumn("pl", F.explode("pl")).withColumn("sl", F.when(F.col("kind") == 0, F.array(F.pmod(own, F.col("slots")).cast("int"))).otherwise(F.sequence(F.lit(0), F.col("slots") - 1))).withColumn("sl", F.explode("sl"))
    return j.select("strip", "col", "pl", "sl", "kind", "id", "ax", "ay", "bx", "by", (F.least("ax", "bx") - F.when(F.col("kind") == 0, F.lit(wide)).otherwise(F.lit(0.0))).alias("at"))


def _clip(a: np.ndarray, y_lo: np.ndarray, y_hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The x-range of segments (columns ax ay bx by) inside a band of y."""
    ax, ay, bx, by = a.T
    dy = np.where(by == ay, 1.0, by - ay)
    t0, t1 = np.clip((y_lo - ay) / dy, 0, 1), np.clip((y_hi - ay) / dy, 0, 1)
    t0, t1 = np.where(by == ay, 0.0, t0), np.where(by == ay, 1.0, t1)
    x0, x1 = ax + t0 * (bx - ax), ax + t1 * (bx - ax)
    return np.minimum(x0, x1), np.maximum(x0, x1)


def _sweep(reach: float, strip: float, kind: str, gather: str, others: bool):
    measure = box_distance if kind == "box" else segment_distance

    def near(pts: np.ndarray, pid: np.ndarray, shp: np.ndarray, sid: np.ndarray, band: tuple[float, float], r: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Of points sorted by x: (point index, shape id, distance) of all pairs within r."""
        if kind == "box":
            lo, hi = np.minimum(shp[:, 0], shp[:, 2]), np.maximum(shp[:, 0], shp[:, 2])
        else:
            lo, hi = _clip(shp, np.full(len(shp), band[0]), np.full(len(shp), band[1]))
        first, last = np.searchsorted(pts[:, 0], lo - r, "left"), np.searchsorted(pts[:, 0], hi + r, "right")
        n = np.maximum(last - first, 0)
        ends = np.cumsum(n)
        start = 0
        while start < len(n):
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + BLOCK_PAIRS, "right")))
            k = n[start:stop]
            which = np.repeat(np.arange(start, stop), k)
            i = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k) + np.repeat(first[start:stop], k)
            s = shp[which]
            y = pts[i, 1]
            close = (y >= np.minimum(s[:, 1], s[:, 3]) - r) & (y <= np.maximum(s[:, 1], s[:, 3]) + r)
            i, which, s = i[close], which[close], s[close]
            d = measure(pts[i, 0], pts[i, 1], s[:, 0], s[:, 1], s[:, 2], s[:, 3])
            ok = (d <= r) & (sid[which] != pid[i]) if others else d <= r
            yield i[ok], sid[which[ok]], d[ok]
            start = stop

    def best(i: np.ndarray, s: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each point the nearest shape, of equal distances the lowest id."""
        o = np.lexsort((s, d, i))
        i, s, d = i[o], s[o], d[o]
        keep = np.r_[True, i[1:] != i[:-1]] if len(i) else np.zeros(0, bool)
        return i[keep], s[keep], d[keep]

    def pairs(pts: np.ndarray, pid: np.ndarray, shp: np.ndarray, sid: np.ndarray, band: tuple[float, float]) -> Iterator[pd.DataFrame]:
        nearest = gather != "all"
        for r in (reach / 8, reach) if nearest and reach > 0 else (reach,):
            if not len(pts):
                return
            found = list(near(pts, pid, shp, sid, band, r))
            if nearest:  # a point with a shape within a smaller radius needs no larger one
                found = [best(*(np.concatenate(x) for x in zip(*(best(*f) for f in found))))]
            for i, s, d in found:
                if len(i):
                    yield pd.DataFrame({"pid": pid[i], "sid": s, "distance": d})
            if nearest:
                rest = np.ones(len(pts), bool)
                rest[found[0][0]] = False
                pts, pid = pts[rest], pid[rest]

    def sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, active, ids = None, np.zeros((0, 4)), np.zeros(0, np.int64)
        for batch in batches:
            lots = batch[["strip", "col", "pl", "sl"]].to_numpy()
            edges = np.flatnonzero(np.r_[True, (lots[1:] != lots[:-1]).any(axis=1), True]) if len(batch) else []
            geometry, kinds, rid = batch[["ax", "ay", "bx", "by"]].to_numpy(float), batch["kind"].to_numpy(), batch["id"].to_numpy(np.int64)
            for a, b in zip(edges, edges[1:]):
                lot = tuple(lots[a])
                if lot != at:
                    at, active, ids = lot, np.zeros((0, 4)), np.zeros(0, np.int64)
                g, k = geometry[a:b], kinds[a:b]
                shapes = k == 0
                active, ids = np.concatenate([active, g[shapes]]), np.concatenate([ids, rid[a:b][shapes]])
                pts, pid = g[~shapes][:, :2], rid[a:b][~shapes]
                if len(pts) and len(active):
                    yield from pairs(pts, pid, active, ids, (lot[0] * strip - reach, (lot[0] + 1) * strip + reach))
                if b == len(batch) and len(active):  # what the sweep line has passed leaves the active set
                    stay = np.maximum(active[:, 0], active[:, 2]) + reach >= batch["at"].iat[-1]
                    active, ids = active[stay], ids[stay]

    return sweep


def near_pairs(points: DataFrame, shapes: DataFrame, reach: float, kind: str = "segment", nearest: bool = True, others: bool = False, strip: float | None = None, lot: int = LOT) -> DataFrame:
    """(pid, sid, distance): of each point the nearest shape within reach (equal distances: the lowest sid), or all shapes.

    others leaves out the shape with the point's own id, for joins of a table to itself.

    points: pid (long), x, y. shapes: sid (long), ax, ay, bx, by; a segment from a to b (a = b is a point), or with
    kind="box" a box with corners a <= b. Rows with unusable coordinates (null, NaN, infinite; points also 0/0) and null
    ids are left out, and points without a shape in reach have no row. Repeated points and shapes are measured once. A
    point on a cell's edge belongs to the upper cell only, so no pair is found twice. Empty inputs give no rows. strip is
    the height of the latitude strips (8 times the reach by default; with reach 0 it should suit the shapes' size).
    """
    if kind not in ("segment", "box") or reach < 0:
        raise ValueError("kind is segment or box, reach at least 0")
    p = points.where(usable("x", "y") & F.col("pid").isNotNull()).select("pid", "x", "y")
    fine = F.col("sid").isNotNull()
    for c in ("ax", "ay", "bx", "by"):
        fine &= F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < F.lit(1e15))
    s = shapes.where(fine).select("sid", "ax", "ay", "bx", "by")
    *box, n = p.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y"), F.count(F.lit(1))).first()
    if not n:
        return p.select("pid", F.col("pid").alias("sid"), F.col("x").alias("distance")).limit(0)
    strip = float(strip or 8 * reach or STRIP)
    rows = _cells(p.distinct(), s.distinct(), float(reach), strip, lot, kind, tuple(box), n)
    spread = rows.repartitionByRange("strip", "col", "pl", "sl").sortWithinPartitions("strip", "col", "pl", "sl", "at", "kind")
    found = spread.mapInPandas(_sweep(float(reach), strip, kind, "nearest" if nearest else "all", others), "pid long, sid long, distance double")
    if not nearest:
        return found.groupBy("pid", "sid").agg(F.min("distance").alias("distance"))
    b = found.groupBy("pid").agg(F.min(F.struct("distance", "sid")).alias("_b"))
    return b.select("pid", F.col("_b.sid").alias("sid"), F.col("_b.distance").alias("distance"))
