"""Classes and labels as column expressions (no UDF). Bounds and labels are fixed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def length_class(km: Column) -> Column:
    """River length class: the largest of 10, 100, 500, 1000 km that is exceeded, else 0; null is class 0."""
    return F.when(km > 1000, 1000).when(km > 500, 500).when(km > 100, 100).when(km > 10, 10).otherwise(0)


def latitude_class(lat: Column) -> Column:
    """Low (-1, 30], Mid (30, 60], High (60, 91] of the absolute latitude."""
    a = F.abs(lat)
    return F.when((a > -1) & (a <= 30), "Low").when((a > 30) & (a <= 60), "Mid").when((a > 60) & (a <= 91), "High")


def climate_zone(lat: Column) -> Column:
    """Five zones by the polar circles and the tropics, left-closed; null is null."""
    return F.when(lat < -66.5, "Antarctic").when(lat < -23.5, "S. Temperate").when(lat < 23.5, "Tropical").when(lat < 66.5, "N. Temperate").when(lat.isNotNull(), "Arctic")


def width_by_discharge(q: Column) -> Column:
    """Line width by discharge; null gets the smallest."""
    return F.when(q >= 2000, 4.0).when(q >= 1500, 2.0).when(q >= 600, 1.0).otherwise(0.5)


def width_by_order(order: Column, widths: dict[int, float], default: float = 0.05) -> Column:
    """Line width from a literal map of river orders."""
    pairs = F.create_map(*[F.lit(x) for k, v in widths.items() for x in (k, float(v))])
    return F.coalesce(F.try_element_at(pairs, order), F.lit(default))


def stars(p: Column) -> Column:
    """Significance marks; null has none."""
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")


def moran_label(i: Column, p: Column, level: float = 0.05) -> Column:
    """Sign of a significant autocorrelation, else none (also for nulls)."""
    return F.when((i > 0) & (p < level), "positive").when((i < 0) & (p < level), "negative").otherwise("none")


def threshold_flag(x: Column, threshold: float) -> Column:
    """0 below the threshold, else 1; null is 1."""
    return F.when(x < threshold, 0).otherwise(1)


def dof_class(x: Column) -> Column:
    """DOF classes (-0.1, 0], (0, 25], (25, 50], (50, 75], (75, 100] as 0 to 4; outside: null."""
    return F.when((x > -0.1) & (x <= 0), 0).when((x > 0) & (x <= 25), 1).when((x > 25) & (x <= 50), 2).when((x > 50) & (x <= 75), 3).when((x > 75) & (x <= 100), 4)


def percent_change(old: Column, new: Column) -> Column:
    """Change in percent; from 0 it is infinite if there is any now, else 0."""
    return F.when(old == 0, F.when(new > 0, F.lit(float("inf"))).otherwise(0.0)).otherwise((new - old) * F.lit(100.0) / old)


def signed_log(x: Column, largest: Column) -> Column:
    """tanh of the signed logarithm over its largest size; 0 where there is none."""
    return F.tanh(F.coalesce(F.try_divide(F.signum(x) * F.log1p(F.abs(x)), largest), F.lit(0.0)))
