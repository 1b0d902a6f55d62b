"""Aggregation and joins over keys of which a handful hold most rows.

heavy_keys finds the keys above a share of all rows; by counting, at most 1/share of them exist, so that list is safe to
broadcast at any input size. Rows of heavy keys get a salt, which spreads them over many tasks; a second, small
aggregation merges the partials by the original key.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key that holds more of all rows than this is heavy; its salts are so many at least, and one for each ROWS_A_SALT of its rows.
HEAVY_SHARE, SALTS, ROWS_A_SALT = 0.002, 32, 2_000_000


@dataclass(frozen=True)
class Measure:
    """One result column: kind is count, sum, mean, min, max, var_pop or distinct, over value (ignored by count)."""

    kind: str
    value: Column | None = None


def key_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows per key; combined before the shuffle, so a hot key costs one row per task."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))


def heavy_counts(df: DataFrame, keys: list[str], share: float = HEAVY_SHARE) -> DataFrame:
    """The keys that hold more than share of all rows, and their rows as _n: at most 1/share rows, whatever the input."""
    counts = key_counts(df, keys)
    total = counts.agg(F.sum("_n").alias("_all"))
    return counts.where(F.col("_n") > total.scalar() * F.lit(share))


def heavy_keys(df: DataFrame, keys: list[str], share: float = HEAVY_SHARE) -> DataFrame:
    """The keys of heavy_counts."""
    return heavy_counts(df, keys, share).select(*keys)


def _flagged(df: DataFrame, heavy: DataFrame, keys: list[str], salts: int) -> DataFrame:
    """df with __rs_salts: over how many tasks a heavy key's rows are spread, null for other keys."""
    many = F.greatest(F.lit(salts), F.ceil(F.col("_n") / F.lit(ROWS_A_SALT))).cast("int")
    marks = heavy.select(*[F.col(k).alias(f"__rs_h{i}") for i, k in enumerate(keys)], many.alias("__rs_salts"))
    on = [F.col(k).eqNullSafe(F.col(f"__rs_h{i}")) for i, k in enumerate(keys)]
    return df.join(F.broadcast(marks), on, "left").drop(*[f"__rs_h{i}" for i in range(len(keys))])


def _partials(name: str, m: Measure) -> tuple[dict[str, Column], Column]:
    """The partial columns of a measure, and the column that merges them."""
    p = f"_p_{name}"
    if m.kind == "count":
        return {p: F.count(F.lit(1))}, F.sum(p)
    if m.kind == "sum":
        return {p: F.sum(m.value)}, F.sum(p)
    if m.kind in ("min", "max"):
        f = F.min if m.kind == "min" else F.max
        return {p: f(m.value)}, f(p)
    if m.kind == "mean":
        return {p: F.sum(m.value), f"{p}n": F.count(m.value)}, F.try_divide(F.sum(p), F.sum(f"{p}n"))
    if m.kind == "var_pop":  # mergeable moments around 0 would cancel; kept as count, mean, M2 with the pairwise update
        n, mean, m2 = F.col(f"{p}n"), F.col(p), F.col(f"{p}v")
        total, centre = F.sum(n), F.try_divide(F.sum(n * mean), F.sum(n))
        return {f"{p}n": F.count(m.value).cast("double"), p: F.avg(m.value), f"{p}v": F.var_pop(m.value)}, F.try_divide(F.sum(n * (m2 + mean * mean)), total) - centre * centre
    raise ValueError(f"unknown measure {m.kind}")


def salted_aggregate(df: DataFrame, keys: list[str], measures: Mapping[str, Measure], unit: str | None = None, share: float = HEAVY_SHARE, salts: int = SALTS) -> DataFrame:
    """Complete per-key results by two-stage salted aggregation.

    Stage 1 aggregates by (key, salt), stage 2 merges by key. The salt of a heavy key's row comes from a hash of `unit`
    (the column whose distinct values are counted), or of the whole row: pseudo-random, but the same in a retried task,
    which rand() is not. All rows of one unit share a salt, so distinct counts of partials simply add up.

    Null keys form one group of their own; null measures are skipped as in SQL (a group of only nulls: sum, mean, min,
    max null, counts 0). Repeated rows count as often as they occur; distinct counts them once. An empty table gives an
    empty result. Columns of df other than keys and measures are ignored, whatever their names.
    """
    distinct = [n for n, m in measures.items() if m.kind == "distinct"]
    if len(distinct) > 1:
        raise ValueError("one distinct measure a call: its values choose the salt")
    chosen = measures[distinct[0]].value if distinct else (F.col(unit) if unit else F.struct(*[F.col(c) for c in df.columns]))
    names = [f"_k{i}" for i in range(len(keys))]
    values = {n: m.value for n, m in measures.items() if m.value is not None}
    slim = df.select(*[F.col(k).alias(a) for k, a in zip(keys, names)], *[v.alias(f"_v_{n}") for n, v in values.items()], F.xxhash64(chosen).alias("_s"))
    spread = _flagged(slim, heavy_counts(slim, names, share), names, salts).withColumn("__rs_salt", F.coalesce(F.pmod("_s", F.col("__rs_salts")).cast("int"), F.lit(-1)))
    bound = {n: Measure(m.kind, F.col(f"_v_{n}") if m.value is not None else None) for n, m in measures.items()}
    partial, merge = {}, {}
    for n, m in bound.items():
        if m.kind == "distinct":
            continue
        p, merge[n] = _partials(n, m)
        partial |= p
    stage0 = [*names, "__rs_salt"]
    if distinct:
        d = distinct[0]
        # the values of a unit are merged first, with a combine on the map side; each distinct value is then one row
        inner = spread.groupBy(*stage0, f"_v_{d}").agg(*[c.alias(a) for a, c in partial.items()], F.count(f"_v_{d}").alias("_seen")) if partial else spread.groupBy(*stage0, f"_v_{d}").agg(F.count(f"_v_{d}").alias("_seen"))
        again = [merge_partials(n, m) for n, m in bound.items() if m.kind != "distinct"]
        one = inner.groupBy(*stage0).agg(*[c.alias(a) for pairs in again for a, c in pairs.items()], F.sum(F.when(F.col("_seen") > 0, 1).otherwise(0)).alias(f"_p_{d}"))
        merge[d] = F.sum(f"_p_{d}")
    else:
        one = spread.groupBy(*stage0).agg(*[c.alias(a) for a, c in partial.items()])
    return one.groupBy(*names).agg(*[merge[n].alias(n) for n in measures]).select(*[F.col(a).alias(k) for a, k in zip(names, keys)], *measures)


def merge_partials(name: str, m: Measure) -> dict[str, Column]:
    """Partial columns merged into partial columns of the same form."""
    p = f"_p_{name}"
    if m.kind in ("min", "max"):
        return {p: (F.min if m.kind == "min" else F.max)(p)}
    if m.kind == "mean":
        return {p: F.sum(p), f"{p}n": F.sum(f"{p}n")}
    if m.kind == "var_pop":
        n, mean, m2 = F.col(f"{p}n"), F.col(p), F.col(f"{p}v")
        centre = F.try_divide(F.sum(n * mean), F.sum(n))
        return {f"{p}n": F.sum(n), p: centre, f"{p}v": F.try_divide(F.sum(n * (m2 + mean * mean)), F.sum(n)) - centre * centre}
    return {p: F.sum(p)}


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", share: float = HEAVY_SHARE, salts: int = SALTS) -> DataFrame:
    """left joined to right on keys, where left may hold a third of its rows under one key.

    Rows of left's heavy keys are spread over `salts` tasks, or more where a key has more than that many times
    ROWS_A_SALT; only right's rows of those keys (they are few: at most 1/share keys) are repeated once a salt. how: inner,
    left, left_semi or left_anti. Null keys match nothing. right's other columns must not clash with left's names.
    """
    if clash := (set(left.columns) & set(right.columns)) - set(keys):
        raise ValueError(f"both sides have {sorted(clash)}")
    heavy = heavy_counts(left.where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys)), keys, share)
    of_row = F.xxhash64(*[F.col(c) for c in left.columns])
    a = _flagged(left, heavy, keys, salts).withColumn("__rs_salt", F.coalesce(F.pmod(of_row, F.col("__rs_salts")).cast("int"), F.lit(0))).drop("__rs_salts")
    every = F.when(F.col("__rs_salts").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("__rs_salts") - 1))
    b = _flagged(right, heavy, keys, salts).withColumn("__rs_salt", F.explode(every)).drop("__rs_salts")
    return a.join(b, [*keys, "__rs_salt"], how).drop("__rs_salt")
