"""Planar and spherical geometry as expressions; Arrow UDFs only where a loop over vertices is needed."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

EARTH_KM = 6371.0088


def haversine_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def point_segment(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Planar distance of a point to a segment."""
    dx, dy = bx - ax, by - ay
    n = dx * dx + dy * dy
    t = F.least(F.greatest(F.coalesce(F.try_divide((px - ax) * dx + (py - ay) * dy, n), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    return F.sqrt(F.pow(px - (ax + t * dx), 2) + F.pow(py - (ay + t * dy), 2))


def segment_meets_box(ax: Column, ay: Column, bx: Column, by: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Whether a segment and a closed box have a point in common: clipping the segment to the box leaves some of it."""
    dx, dy = bx - ax, by - ay
    enter, leave = F.lit(0.0), F.lit(1.0)
    for d, a, lo, hi in ((dx, ax, x0, x1), (dy, ay, y0, y1)):
        t0, t1 = F.try_divide(lo - a, d), F.try_divide(hi - a, d)
        outside = (d == 0) & ((a < lo) | (a > hi))
        enter = F.when(outside, F.lit(2.0)).otherwise(F.greatest(enter, F.coalesce(F.least(t0, t1), F.lit(0.0))))
        leave = F.least(leave, F.coalesce(F.greatest(t0, t1), F.lit(1.0)))
    return enter <= leave


def checked_crs(crs: str | None) -> str:
    """EPSG:4326, which an absent CRS counts as; any other is refused."""
    if (crs or "EPSG:4326").upper() != "EPSG:4326":
        raise ValueError(f"only EPSG:4326 is supported, not {crs}")
    return "EPSG:4326"


def hull(points: np.ndarray) -> np.ndarray:
    """Convex hull (monotone chain) in turning order; fewer than three points are returned as they are."""
    p = np.unique(points, axis=0)
    if len(p) < 3:
        return p

    def half(rows):
        out: list[np.ndarray] = []
        for q in rows:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    return np.array(half(p) + half(p[::-1]))


def smallest_box(points: np.ndarray) -> tuple[float, float, float, float, float]:
    """Middle x and y, long side, short side and angle of the smallest rectangle: one of its sides lies on the hull."""
    h = hull(points)
    if len(h) == 1:
        return float(h[0, 0]), float(h[0, 1]), 0.0, 0.0, 0.0
    best = None
    for a, b in zip(h, np.roll(h, -1, axis=0)):
        angle = float(np.arctan2(b[1] - a[1], b[0] - a[0]))
        r = np.array([[np.cos(angle), np.sin(angle)], [-np.sin(angle), np.cos(angle)]])
        q = h @ r.T
        lo, hi = q.min(axis=0), q.max(axis=0)
        w, height = hi - lo
        if best is None or w * height < best[0] - 1e-9:
            best = (w * height, *((lo + hi) / 2 @ r), w, height, angle)
    _, x, y, w, height, angle = best
    if height > w:
        w, height, angle = height, w, angle + np.pi / 2
    return float(x), float(y), float(w), float(height), float(angle % np.pi)


@F.pandas_udf(StructType([StructField(n, DoubleType()) for n in ("cx", "cy", "long_side", "short_side", "angle")]))
def min_area_box(xs: pd.Series, ys: pd.Series) -> pd.DataFrame:
    """smallest_box of the vertices in two arrays."""
    return pd.DataFrame([smallest_box(np.c_[x, y]) for x, y in zip(xs, ys)], columns=["cx", "cy", "long_side", "short_side", "angle"])


def thinned(p: np.ndarray, tolerance: float) -> np.ndarray:
    """Douglas-Peucker: the vertices kept of a line, without recursion."""
    keep = np.zeros(len(p), bool)
    keep[[0, -1]] = True
    todo = [(0, len(p) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        d = p[b] - p[a]
        n = np.hypot(*d)
        off = p[a + 1 : b] - p[a]
        dist = np.abs(d[0] * off[:, 1] - d[1] * off[:, 0]) / n if n > 0 else np.hypot(off[:, 0], off[:, 1])
        k = int(dist.argmax())
        if dist[k] > tolerance:
            keep[a + 1 + k] = True
            todo += [(a, a + 1 + k), (a + 1 + k, b)]
    return p[keep]


@F.pandas_udf(StructType([StructField(n, ArrayType(DoubleType())) for n in ("xs", "ys")]))
def simplify(xs: pd.Series, ys: pd.Series, tolerance: pd.Series) -> pd.DataFrame:
    """Lines of vertices in two arrays, thinned; lines of up to two vertices stay."""
    out = [thinned(np.c_[x, y], t) if len(x) > 2 else np.c_[x, y] for x, y, t in zip(xs, ys, tolerance)]
    return pd.DataFrame({"xs": [o[:, 0] for o in out], "ys": [o[:, 1] for o in out]})


#: The Robinson projection's table by 5 degrees of latitude (parallel length, distance from the equator).
ROBINSON_X = [1.0, 0.9986, 0.9954, 0.99, 0.9822, 0.973, 0.96, 0.9427, 0.9216, 0.8962, 0.8679, 0.835, 0.7986, 0.7597, 0.7186, 0.6732, 0.6213, 0.5722, 0.5322]
ROBINSON_Y = [0.0, 0.062, 0.124, 0.186, 0.248, 0.31, 0.372, 0.434, 0.4958, 0.5571, 0.6176, 0.6769, 0.7346, 0.7903, 0.8435, 0.8936, 0.9394, 0.9761, 1.0]


def robinson(lon: Column, lat: Column) -> Column:
    """struct(x, y) in kilometres, by linear interpolation in the table."""
    a = F.least(F.abs(lat), F.lit(90.0)) / 5
    i = F.least(F.floor(a).cast("int"), F.lit(17))
    tx, ty = F.array(*map(F.lit, ROBINSON_X)), F.array(*map(F.lit, ROBINSON_Y))
    at = lambda t: F.get(t, i) + (F.get(t, i + 1) - F.get(t, i)) * (a - i)
    return F.struct((F.lit(0.8487 * 6378.137) * at(tx) * F.radians(lon)).alias("x"), (F.lit(1.3523 * 6378.137) * at(ty) * F.signum(lat)).alias("y"))
