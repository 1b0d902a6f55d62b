"""Histograms that keep zero apart. Edges are few and literal: a row's bins are found in place, without a join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _text(x: float) -> str:
    return str(int(x)) if float(x).is_integer() else str(x)


def _counted(values: DataFrame, value: str, bins: list[tuple[str, Column]]) -> DataFrame:
    """(label, n, pct) of every bin; a value may lie in several. One row per bin leaves a task, whatever the input."""
    each = F.array(*[F.struct(F.lit(n).alias("label"), F.count_if(c).alias("n")) for n, c in bins])
    one = values.where(F.col(value).isNotNull() & ~F.isnan(value)).agg(each.alias("_b"), F.count(F.lit(1)).alias("_t"))
    return one.select(F.explode("_b").alias("b"), "_t").select("b.label", "b.n", F.round(F.coalesce(F.try_divide(F.col("b.n") * F.lit(100.0), F.col("_t")), F.lit(0.0)) + F.lit(1e-7), 3).alias("pct"))


def signed_histogram(values: DataFrame, value: str, edges: list[float]) -> DataFrame:
    """Bins < first, [a, b] closed on both sides (a shared edge counts twice), [a, 0), = 0, (0, b], > last; then Total.

    Bins without values are left out. Nulls and NaN don't count. edges rise and may hold 0.
    """
    v = F.col(value)
    bins = [(f"< {_text(edges[0])}", v < edges[0])]
    for a, b in zip(edges, edges[1:]):
        if b == 0:
            bins += [(f"[{_text(a)}, 0)", (v >= a) & (v < 0)), ("= 0", v == 0)]
        elif a == 0:
            bins.append((f"(0, {_text(b)}]", (v > 0) & (v <= b)))
        else:
            bins.append((f"[{_text(a)}, {_text(b)}]", (v >= a) & (v <= b)))
    bins.append((f"> {_text(edges[-1])}", v > edges[-1]))
    total = values.where(v.isNotNull() & ~F.isnan(value)).agg(F.count(F.lit(1)).alias("n")).select(F.lit("Total").alias("label"), "n", F.lit(100.0).alias("pct"))
    return _counted(values, value, bins).where("n > 0").unionByName(total)


def split_bins(values: DataFrame, value: str, edges: list[float]) -> DataFrame:
    """Half-open bins away from zero; a bin that spans or meets zero is split into below, the bin 0,0 and above. All bins are given."""
    v, bins, zero = F.col(value), [], False
    for a, b in zip(edges, edges[1:]):
        if a < 0:
            top = min(b, 0.0)
            bins.append((f"{_text(a)},{_text(top)}", (v >= a) & (v < top)))
        if a <= 0 <= b and not zero:
            bins.append(("0,0", v == 0))
            zero = True
        if b > 0:
            low = max(a, 0.0)
            bins.append((f"{_text(low)},{_text(b)}", (v > low) & (v <= b)))
    if not zero:
        bins.append(("0,0", v == 0))
    return _counted(values, value, bins)


def auto_bins(values: DataFrame, value: str, each: int) -> DataFrame:
    """(edge): quantile edges of the positive and of the negative values, `each` bins a side; exact, linear in between."""
    at = F.array(*[F.lit(k / each) for k in range(each + 1)])
    v = F.col(value)
    q = values.where(~F.isnan(value)).agg(F.percentile(F.when(v < 0, v), at).alias("a"), F.percentile(F.when(v > 0, v), at).alias("b"))
    both = F.concat(F.coalesce("a", F.array().cast("array<double>")), F.coalesce("b", F.array().cast("array<double>")))
    return q.select(F.explode(F.array_sort(F.array_distinct(both))).alias("edge"))
