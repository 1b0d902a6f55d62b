"""Rounding that two engines agree on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def settled(value: Column | str, digits: int) -> Column:
    """value rounded to digits, half up, with halves that float noise puts on either side moved to one."""
    c = F.col(value) if isinstance(value, str) else value
    return F.round(c + F.lit(10.0 ** -(digits + 3)), digits)
