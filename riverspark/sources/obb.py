"""Oriented boxes as text lines: x1 y1 x2 y2 x3 y3 x4 y4 type [flag]."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def shoelace(xs: list[Column], ys: list[Column]) -> tuple[Column, Column, Column]:
    """(doubled area, centroid x, centroid y) of a polygon; the centroid of a polygon without area is null."""
    n = len(xs)
    cross = [xs[i] * ys[(i + 1) % n] - xs[(i + 1) % n] * ys[i] for i in range(n)]
    a = sum(cross[1:], cross[0])
    sx = sum(((xs[i] + xs[(i + 1) % n]) * cross[i] for i in range(1, n)), (xs[0] + xs[1]) * cross[0])
    sy = sum(((ys[i] + ys[(i + 1) % n]) * cross[i] for i in range(1, n)), (ys[0] + ys[1]) * cross[0])
    three = F.when(a != 0, F.lit(3.0) * a)
    return a, sx / three, sy / three


def obb_tokens(lines: DataFrame, line: str, least: int = 9) -> DataFrame:
    """lines with t, the tokens, where there are enough and the first eight are numbers; bad lines are dropped."""
    t = F.split(F.trim(line), r"\s+")
    numbers = F.forall(F.slice(t, 1, 8), lambda x: F.try_to_number(x, F.lit("999999999.999999")).isNotNull() | x.rlike(r"^-?\d+(\.\d+)?([eE]-?\d+)?$"))
    return lines.withColumn("t", t).where((F.size("t") >= least) & numbers)


def obb_points(lines: DataFrame, line: str, least: int = 9) -> DataFrame:
    """lines with dam_type, cx and cy of their box; boxes without area are dropped."""
    b = obb_tokens(lines, line, least)
    num = lambda i: F.get("t", F.lit(i)).try_cast("double")
    _, cx, cy = shoelace([num(i) for i in (0, 2, 4, 6)], [num(i) for i in (1, 3, 5, 7)])
    return b.withColumn("dam_type", F.get("t", F.lit(8))).withColumn("cx", cx).withColumn("cy", cy).where("cx IS NOT NULL").drop("t")
