"""Percentiles against exact ranks."""

import math
import random

import pytest
from pyspark.sql import functions as F

from riverspark.llm.quantiles import cell_of, merge_counts, percentiles, read_parts, value_counts, value_of, write_part


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_percentiles_are_within_the_error(spark):
    r = random.Random(3)
    data = [(g, r.choice([0.0, 0.0, r.lognormvariate(3, 3), -r.random() * 1e-3, None, float("nan")])) for g in ("a", "a", "a", None) for _ in range(700)]
    df = spark.createDataFrame(data, "g string, v double").withColumn("cell", F.lit(1)).withColumn("n", F.lit(1))
    shares = [0.0, 0.01, 0.5, 0.9, 1.0]
    for error, bound in (({"step": 0.01}, lambda v: 0.005 + 1e-9), ({"relative": 0.01}, lambda v: 0.0100001 * abs(v) + 1e-9)):
        c = value_counts(df, ["g"], F.col("v"), **error)
        out = {(x["g"], x["p"]): x for x in percentiles(c, ["g"], shares, **error).collect()}
        for g in ("a", None):
            vs = sorted(v for k, v in data if k == g and v is not None and v == v)
            for p in shares:
                exact = vs[max(1, math.ceil(p * len(vs))) - 1]
                assert abs(out[g, p]["value"] - exact) <= bound(exact), (g, p)
                assert out[g, p]["n"] == len(vs)


def test_parts_of_days_combine_without_loss(spark, tmp_path):
    r = random.Random(8)
    df = spark.createDataFrame([(r.randrange(4), "ab"[r.randrange(2)], r.random() * 50) for _ in range(900)], "day int, g string, v double")
    whole = rows(percentiles(value_counts(df, ["g"], F.col("v"), step=0.1), ["g"], [0.1, 0.5], step=0.1))
    parts = [value_counts(df.where(F.col("day") == k), ["g"], F.col("v"), step=0.1) for k in range(4)]
    assert rows(percentiles(merge_counts(*parts, groups=["g"]), ["g"], [0.1, 0.5], step=0.1)) == whole
    for k, p in enumerate(parts):
        write_part(p, str(tmp_path), f"day{k}")
    assert rows(percentiles(merge_counts(*read_parts(spark, str(tmp_path), [f"day{k}" for k in range(4)]), groups=["g"]), ["g"], [0.1, 0.5], step=0.1)) == whole
    by_day = value_counts(df, ["g", "day"], F.col("v"), step=0.1)
    assert rows(percentiles(merge_counts(by_day, groups=["g"]), ["g"], [0.1, 0.5], step=0.1)) == whole


def test_percentiles_of_nothing_and_cells(spark):
    e = spark.createDataFrame([], "g string, v double")
    assert rows(percentiles(value_counts(e, ["g"], F.col("v"), step=1.0), ["g"], [0.5], step=1.0)) == []
    with pytest.raises(ValueError):
        percentiles(value_counts(e, ["g"], F.col("v"), step=1.0), ["g"], [1.5], step=1.0)
    with pytest.raises(ValueError):
        cell_of(F.lit(1.0))
    v = [-1e300, -5.0, -1e-12, 0.0, 1e-12, 0.1, 7.0, 1e300, float("inf")]
    for error in ({"step": 0.5}, {"relative": 0.001}):
        c = [x[0] for x in spark.createDataFrame([(x,) for x in v], "v double").select(cell_of(F.col("v"), **error)).collect()]
        assert c == sorted(c)
    near = spark.range(1).select(value_of(cell_of(F.lit(1234.5), relative=0.001), relative=0.001)).first()[0]
    assert abs(near - 1234.5) <= 1.2346
