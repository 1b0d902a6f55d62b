"""Sparse rasters: one row per filled cell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pixel_latitudes(cells: DataFrame, top: float, bottom: float, height: int) -> DataFrame:
    """cells with lat, from an even mesh of `height` samples that begins on the top edge and ends on the bottom edge."""
    step = (top - bottom) / (height - 1) if height > 1 else 0.0
    return cells.withColumn("lat", F.lit(top) - F.col("row") * F.lit(step))


def rasterize(points: DataFrame, x: str, y: str, resolution: float, by: list[str] | None = None) -> DataFrame:
    """(by, row, col, n): points per cell of a grid that spans the data's own bounds (per group of by).

    A point exactly on the far edge of a grid whose extent is a multiple of the resolution lies outside and isn't counted.
    """
    by = by or []
    p = points.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    b = p.groupBy(*by).agg(F.min(x).alias("_x0"), F.max(x).alias("_x1"), F.min(y).alias("_y0"), F.max(y).alias("_y1"))
    # one row, or one per layer
    j = p.join(F.broadcast(b), by) if by else p.join(F.broadcast(b), F.lit(True))
    r = F.lit(float(resolution))
    size = lambda a: F.greatest(F.ceil(a / r), F.lit(1))
    j = j.withColumn("col", F.floor((F.col(x) - F.col("_x0")) / r)).withColumn("row", F.floor((F.col("_y1") - F.col(y)) / r))
    j = j.where((F.col("col") < size(F.col("_x1") - F.col("_x0"))) & (F.col("row") < size(F.col("_y1") - F.col("_y0"))))
    return j.groupBy(*by, "row", "col").agg(F.count(F.lit(1)).alias("n"))


def band(lat: Column, width: float) -> Column:
    """Number of the left-closed latitude band, from -90 on."""
    return F.floor((lat + F.lit(90.0)) / F.lit(width)).cast("int")


def align_nearest(cells: DataFrame, from_res: float, to_res: float, height: int, width: int) -> DataFrame:
    """cells on another grid of the same corner: each target cell takes the source cell that holds its centre.

    Only targets of filled source cells are made: their number per source cell is bounded by the ratio of the grids.
    """
    k = from_res / to_res
    first = lambda c: F.greatest(F.ceil(F.col(c) * F.lit(k) - F.lit(0.5)), F.lit(0)).cast("long")
    last = lambda c, n: F.least(F.ceil((F.col(c) + 1) * F.lit(k) - F.lit(0.5)) - 1, F.lit(n - 1)).cast("long")
    some = cells.where((first("row") <= last("row", height)) & (first("col") <= last("col", width)))
    r = some.withColumn("_r", F.explode(F.sequence(first("row"), last("row", height)))).withColumn("_c", F.explode(F.sequence(first("col"), last("col", width))))
    return r.drop("row", "col").withColumnRenamed("_r", "row").withColumnRenamed("_c", "col")
