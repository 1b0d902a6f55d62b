"""The nearest segment of each point, however far.

Segments are packed into tiles: slabs of x by ranges, cut by y, so that tiles hold equally many at any density. The tiles'
bounds, at most about TILES of them, are all that every task knows. Each side of a tile's bounds touches a segment, which
limits the distance from above as well as from below: a point is sent to the tile with the least upper limit and measured
there, then to those other tiles alone that begin nearer than what was found. So a point meets a few tiles, whether its
river is next to it or a continent away, and neither distance nor density changes the number of passes. Inside a tile the
same limits hold for blocks of BLOCK segments. Memory is one Arrow batch and one tile.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riverspark.operators.proximity import usable
from riverspark.session import cut

#: Segments of a tile, and tiles beyond which they hold more; segments of a block; a tile's points that stay together.
TILE, TILES, BLOCK, LOT = 4_096, 16_384, 32, 20_000
#: Segments so many times longer than the median have tiles of their own, as they would widen those of others.
LONG = 64
#: Points taken at once, and pairs measured at once.
POINTS, PAIRS = 2_048, 8_192


def _pack(mx: np.ndarray, my: np.ndarray, size: int) -> np.ndarray:
    """An order of places in which each run of size is compact: strips of x, each by y."""
    n = -(-len(mx) // size)
    strip = np.empty(len(mx), np.int64)
    strip[np.argsort(mx, kind="stable")] = np.arange(len(mx)) // (-(-n // int(np.ceil(np.sqrt(n)))) * size)
    return np.lexsort((my, strip))


def _bounds(boxes: np.ndarray, size: int) -> np.ndarray:
    """Bounds of each run of size boxes (columns x0 y0 x1 y1)."""
    at = np.arange(0, len(boxes), size)
    return np.c_[np.minimum.reduceat(boxes[:, :2], at), np.maximum.reduceat(boxes[:, 2:], at)]


def _limits(x, y, box, upper: bool = True):
    """Squared distances that the nearest segment inside the bounds can't be below, and can't be above."""
    x0, y0, x1, y1 = box
    a, b, c, e = x0 - x, x - x1, y0 - y, y - y1
    low = np.maximum(np.maximum(a, b), 0.0) ** 2 + np.maximum(np.maximum(c, e), 0.0) ** 2
    if not upper:
        return low, None
    a, b, c, e = a * a, b * b, c * c, e * e
    return low, np.minimum(np.minimum(a, b) + np.maximum(c, e), np.maximum(a, b) + np.minimum(c, e))


class _Tiles:
    """Bounds of tiles in groups, to find the tiles of points."""

    def __init__(self, ids: np.ndarray, boxes: np.ndarray) -> None:
        self.size = max(1, int(np.sqrt(len(ids))))
        o = _pack(boxes[:, 0] + boxes[:, 2], boxes[:, 1] + boxes[:, 3], self.size)
        self.ids, self.boxes = ids[o], boxes[o]
        self.groups = _bounds(self.boxes, self.size)
        self.top = float(np.abs(boxes).max())

    def wide(self, p: np.ndarray, d: np.ndarray) -> np.ndarray:
        """A distance squared, with room for rounding."""
        return (d + 1e-6 + 1e-14 * (d + np.abs(p).sum(axis=1) + self.top)) ** 2

    def _open(self, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (point, tile) of the pairs (point, group) that are set, in the order of points."""
        i, g = np.nonzero(near)
        n = np.minimum(self.size, len(self.ids) - g * self.size)
        return np.repeat(i, n), np.arange(n.sum()) + np.repeat(g * self.size - (np.cumsum(n) - n), n)

    def first(self, p: np.ndarray) -> np.ndarray:
        """The tile in which to measure first."""
        low, high = _limits(p[:, :1], p[:, 1:], self.groups.T)
        # the tiles of the best group limit the distance closer than the groups do
        t = np.minimum(high.argmin(axis=1)[:, None] * self.size + np.arange(self.size), len(self.ids) - 1)
        most = _limits(p[:, :1], p[:, 1:], self.boxes[t].transpose(2, 0, 1))[1].min(axis=1)
        near = low <= self.wide(p, np.sqrt(most))[:, None]
        if len(p) > 1 and near.sum() * self.size > 256 * PAIRS:
            return np.concatenate([self.first(h) for h in np.array_split(p, 2)])
        i, t = self._open(near)
        low, high = _limits(p[i, 0], p[i, 1], self.boxes[t].T)
        score = np.sqrt(high) + np.sqrt(low) / 4
        at = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
        hit = np.flatnonzero(score == np.minimum.reduceat(score, at)[i])
        return self.ids[t[hit[np.r_[True, i[hit][1:] != i[hit][:-1]]]]]

    def within(self, p: np.ndarray, d: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (point, tile) of all tiles that begin within d."""
        for a in range(0, len(p), POINTS):
            yield from self._within(p[a : a + POINTS], self.wide(p[a : a + POINTS], d[a : a + POINTS]), a)

    def _within(self, p: np.ndarray, far: np.ndarray, start: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        near = _limits(p[:, :1], p[:, 1:], self.groups.T, False)[0] <= far[:, None]
        if len(p) > 1 and near.sum() * self.size > 256 * PAIRS:
            h = len(p) // 2
            yield from self._within(p[:h], far[:h], start)
            yield from self._within(p[h:], far[h:], start + h)
            return
        i, t = self._open(near)
        ok = _limits(p[i, 0], p[i, 1], self.boxes[t].T, False)[0] <= far[i]
        yield i[ok] + start, self.ids[t[ok]]


class _Tile:
    """Segments of one tile in blocks."""

    def __init__(self, geometry: np.ndarray, sid: np.ndarray) -> None:
        o = _pack(geometry[:, 0] + geometry[:, 2], geometry[:, 1] + geometry[:, 3], BLOCK)
        o = o[np.lexsort((sid[o], np.arange(len(o)) // BLOCK))]  # by id inside a block: the first of equal distances is the lowest
        o = np.r_[o, np.repeat(o[-1], -len(o) % BLOCK)]
        ax, ay, bx, by = geometry[o].T
        self.boxes = _bounds(np.c_[np.minimum(ax, bx), np.minimum(ay, by), np.maximum(ax, bx), np.maximum(ay, by)], BLOCK)
        dx, dy = bx - ax, by - ay
        self.shape = np.stack([v.reshape(-1, BLOCK) for v in (ax, ay, dx, dy, dx * dx + dy * dy)])
        self.sid = sid[o].reshape(-1, BLOCK)

    def _measure(self, p: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least distance of each pair (point, block), in the arithmetic of the SQL, and its segment."""
        d, s = np.empty(len(p)), np.empty(len(p), np.int64)
        for a in range(0, len(p), PAIRS):
            x, y, b = p[a : a + PAIRS, :1], p[a : a + PAIRS, 1:], block[a : a + PAIRS]
            ax, ay, dx, dy, length = self.shape[:, b]
            t = np.where(length > 0, ((x - ax) * dx + (y - ay) * dy) / np.where(length > 0, length, 1.0), 0.0)
            t = np.minimum(np.maximum(t, 0.0), 1.0)
            all_ = np.sqrt((x - (ax + t * dx)) ** 2 + (y - (ay + t * dy)) ** 2)
            k = np.arange(len(b)), all_.argmin(axis=1)
            d[a : a + PAIRS], s[a : a + PAIRS] = all_[k], self.sid[b][k]
        return d, s

    def nearest(self, p: np.ndarray, most: np.ndarray, wide) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(point index, segment, distance): the nearest segment of each point that has one within most."""
        parts = [self._nearest(p[a : a + POINTS], most[a : a + POINTS], wide, a) for a in range(0, len(p), POINTS)]
        return tuple(np.concatenate(x) for x in zip(*parts))

    def _nearest(self, p, most, wide, start):
        low = _limits(p[:, :1], p[:, 1:], self.boxes.T, False)[0]
        own = np.flatnonzero(low.min(axis=1) <= wide(p, most))
        p, most, low = p[own], most[own], low[own]
        block = _limits(p[:, :1], p[:, 1:], self.boxes.T)[1].argmin(axis=1) if np.isinf(most).any() else low.argmin(axis=1)
        d, s = self._measure(p, block)
        more = low <= wide(p, np.minimum(d, most))[:, None]
        more[np.arange(len(p)), block] = False
        i, b = np.nonzero(more)
        d2, s2 = self._measure(p[i], b)
        i, d, s = np.r_[np.arange(len(p)), i], np.r_[d, d2], np.r_[s, s2]
        o = np.lexsort((s, d, i))
        o = o[np.r_[True, i[o][1:] != i[o][:-1]]] if len(o) else o
        o = o[d[o] <= most[i[o]]]
        return own[i[o]] + start, s[o], d[o]


def _cut_tiles(size: int):
    """Rows sorted by (class, my, geometry, sid) with the number of their tile; of equal segments the lowest id stays."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tile, held, last, kind = TaskContext.get().partitionId() << 32, 0, None, None
        for batch in batches:
            g = batch[["class", "ax", "ay", "bx", "by"]].to_numpy(float)
            before = np.r_[g[:1] + 1 if last is None else last[None], g[:-1]] if len(g) else g
            batch, last = batch[(g != before).any(axis=1)], g[-1] if len(g) else last
            for c, part in batch.groupby("class", sort=True):
                if c != kind:
                    tile, held, kind = tile + 1, 0, c
                at = held + np.arange(len(part))
                yield part[["sid", "ax", "ay", "bx", "by"]].assign(tile=tile + at // size)
                tile, held = tile + (held + len(part)) // size, (held + len(part)) % size

    return run


def _send(tiles: _Tiles):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            p = batch[["x", "y"]].to_numpy(float)
            if len(p):
                yield batch.assign(distance=np.inf, tile=np.concatenate([tiles.first(p[a : a + POINTS]) for a in range(0, len(p), POINTS)]))

    return run


def _search(tiles: _Tiles, further: bool):
    """Of rows sorted by (tile, lot, kind), kind 0 segments and kind 1 points: (pid, sid, distance), and with further rows (pid, x, y, distance, tile) of the other tiles to try."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, shapes, tile = None, [], None
        for batch in batches:
            key = batch[["tile", "lot"]].to_numpy(np.int64)
            edges = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1), True]) if len(batch) else []
            geometry, kinds, rid = batch[["ax", "ay", "bx", "by"]].to_numpy(float), batch["kind"].to_numpy(), batch["id"].to_numpy(np.int64)
            for a, b in zip(edges, edges[1:]):
                if tuple(key[a]) != at:
                    at, shapes, tile = tuple(key[a]), [], None
                is_point = kinds[a:b] == 1
                if not is_point.all():
                    shapes.append((geometry[a:b][~is_point], rid[a:b][~is_point]))
                if not is_point.any():
                    continue
                if tile is None:
                    tile, shapes = _Tile(*(np.concatenate(x) for x in zip(*shapes))), []
                p, most, pid = geometry[a:b][is_point][:, :2], geometry[a:b][is_point][:, 2], rid[a:b][is_point]
                i, s, d = tile.nearest(p, most, tiles.wide)
                yield pd.DataFrame({"pid": pid[i], "sid": s, "distance": d, "x": 0.0, "y": 0.0, "tile": -1})
                for k, t in tiles.within(p[i], d) if further else ():
                    k, t = k[t != at[0]], t[t != at[0]]
                    yield pd.DataFrame({"pid": pid[i[k]], "sid": -1, "distance": d[k], "x": p[i[k], 0], "y": p[i[k], 1], "tile": t})

    return run


def _visit(points: DataFrame, shapes: DataFrame, tiles: _Tiles, lot: int, further: bool) -> DataFrame:
    """Points (pid, x, y, distance, tile) measured in their tiles; a tile with many points is sent to several lots of them."""
    lots = F.broadcast(points.groupBy("tile").agg(F.ceil(F.count(F.lit(1)) / F.lit(lot)).cast("int").alias("lots")))
    p = points.join(lots, "tile").select("tile", F.pmod(F.xxhash64("pid", "x", "y"), "lots").cast("int").alias("lot"), F.lit(1).alias("kind"), F.col("pid").alias("id"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("distance").alias("bx"), F.lit(0.0).alias("by"))
    s = shapes.join(lots, "tile").select("tile", F.explode(F.sequence(F.lit(0), F.col("lots") - 1)).alias("lot"), F.lit(0).alias("kind"), F.col("sid").alias("id"), "ax", "ay", "bx", "by")
    rows = p.unionByName(s).repartition("tile", "lot").sortWithinPartitions("tile", "lot", "kind")
    return rows.mapInPandas(_search(tiles, further), "pid long, sid long, distance double, x double, y double, tile long")


def nearest_segments(points: DataFrame, shapes: DataFrame, tile: int = TILE, lot: int = LOT) -> DataFrame:
    """(pid, sid, distance): of each point the nearest segment at any distance; equal distances: the lowest sid.

    points: pid (long), x, y. shapes: sid (long), ax, ay, bx, by; a = b is a point. Rows with unusable coordinates (null,
    NaN, infinite; points also 0/0) and null ids are left out. A pid with several places has the nearest of all of them.
    """
    p = points.where(usable("x", "y") & F.col("pid").isNotNull()).select(F.col("pid").cast("long").alias("pid"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    fine = F.col("sid").isNotNull()
    for c in ("ax", "ay", "bx", "by"):
        fine &= F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < F.lit(1e15))
    s = shapes.where(fine).select(F.col("sid").cast("long").alias("sid"), *[F.col(c).cast("double").alias(c) for c in ("ax", "ay", "bx", "by")])
    length = F.greatest(F.abs(F.col("bx") - F.col("ax")), F.abs(F.col("by") - F.col("ay")))
    n, median = s.agg(F.count(F.lit(1)), F.percentile_approx(length, 0.5, 100)).first()
    if not n:
        return p.select("pid", F.col("pid").alias("sid"), F.col("x").alias("distance")).limit(0)
    tile = max(tile, -(-n // TILES))
    s = s.withColumn("class", F.greatest(F.lit(0), F.floor(F.log(F.greatest(length, F.lit(1e-9)) / F.lit(median or 1.0)) / F.log(F.lit(float(LONG))))).cast("int"))
    s = s.withColumn("mx", F.col("ax") + F.col("bx")).withColumn("my", F.col("ay") + F.col("by"))
    slabs = max(1, round((n / tile) ** 0.5))
    s = s.repartitionByRange(slabs, "class", "mx").sortWithinPartitions("class", "my", "ax", "ay", "bx", "by", "sid")
    s = cut(s.select("class", "sid", "ax", "ay", "bx", "by").mapInPandas(_cut_tiles(tile), "sid long, ax double, ay double, bx double, by double, tile long"), "tiles")
    boxes = s.groupBy("tile").agg(F.min(F.least("ax", "bx")), F.min(F.least("ay", "by")), F.max(F.greatest("ax", "bx")), F.max(F.greatest("ay", "by"))).orderBy("tile").collect()
    tiles = _Tiles(np.array([b[0] for b in boxes], np.int64), np.array([b[1:] for b in boxes], float))
    lot = max(lot, 5 * tile)
    first = cut(p.mapInPandas(_send(tiles), "pid long, x double, y double, distance double, tile long"), "sent")
    seen = cut(_visit(first, s, tiles, lot, True), "seen")
    more = _visit(seen.where("tile <> -1"), s, tiles, lot, False)
    b = seen.where("tile = -1").select("pid", "sid", "distance").unionByName(more.select("pid", "sid", "distance")).groupBy("pid").agg(F.min(F.struct("distance", "sid")).alias("_b"))
    return b.select("pid", F.col("_b.sid").alias("sid"), F.col("_b.distance").alias("distance"))
