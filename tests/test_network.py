"""Routing on a hand-checkable network, properties on random forests, and equivalence with direct walks."""

import math
import random

import pytest
from pyspark.sql import functions as F

from riverspark.session import cut
from riverspark.operators.network import accumulate, barrier_scores, decay, dense_ids, dissolve, dof_score, fragmentation, pass_ratio, regulation, river_status, small_stretches, trapping

SEVEN = [(1, None, 100.0), (2, 1, 50.0), (3, 1, 40.0), (4, 2, 25.0), (5, 2, 5.0), (6, 3, 20.0), (7, 3, 15.0)]


def net(spark, rows=SEVEN, falls=()):
    return spark.createDataFrame([(n, d, q, int(n in falls)) for n, d, q in rows], "node long, down long, q double, fall int")


def dof(spark, barriers, falls=(), rows=SEVEN):
    b = spark.createDataFrame([(x,) for x in barriers], "node long")
    return {r["node"]: round(r["dof"], 4) for r in fragmentation(net(spark, rows, falls), b).collect()}


def test_hand_computed_dof(spark):
    edge = round(100 - 100 * math.log10(2) / math.log10(5), 4)
    assert dof(spark, [2, 2, 999]) == {1: edge, 2: 100.0, 3: 0.0, 4: edge, 5: 0.0, 6: 0.0, 7: 0.0}
    assert dof(spark, [2], falls=(4,))[4] == 0.0
    at_fall = dof(spark, [2], falls=(2,))
    assert at_fall[2] == 100.0 and at_fall[4] == 0.0 and at_fall[1] == edge
    assert set(dof(spark, []).values()) == {0.0}


def test_zero_discharge_isnt_routed(spark):
    rows = [(1, None, 10.0), (2, 1, 0.0), (3, 2, None)]
    assert dof(spark, [2, 3], rows=rows) == {1: 0.0, 2: 100.0, 3: 100.0}


def test_own_factors_and_modes(spark):
    b = spark.createDataFrame([(2, 2.0, 0.5)], "node long, dfu double, dfd double")
    d = {r["node"]: r["dof"] for r in fragmentation(net(spark), b).collect()}
    assert d[4] == pytest.approx(0.0, abs=1e-9) and d[1] == 0.0 and d[2] == 100.0
    with pytest.raises(ValueError):
        decay(2)


def direct_dof(rows, barriers):
    q, down = {n: x for n, _, x in rows}, {n: d for n, d, _ in rows}
    kids = {}
    for n, d, _ in rows:
        kids.setdefault(d, []).append(n)
    best = dict.fromkeys(q, 0.0)
    f = lambda a, b: max(0.0, min(100.0, 100 - abs(math.log10(a) - math.log10(b)) * 100 / math.log10(5)))
    for b in set(barriers):
        todo = [b]
        while todo:
            n = todo.pop()
            if q[n] >= q[b] / 5:
                best[n] = max(best[n], f(min(q[n], q[b]), q[b]))
                todo += kids.get(n, [])
        n = b
        while n is not None and q[n] <= q[b] * 5:
            best[n] = max(best[n], f(max(q[n], q[b]), q[b]))
            n = down[n]
    return best


def forest(seed, n=60):
    r = random.Random(seed)
    rows = []
    for k in range(1, n + 1):
        d = r.randrange(1, k) if k > 2 and r.random() < 0.95 else None
        rows.append((k, d, round(1000 / (k + 1) * r.uniform(0.6, 1.4), 3)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_dof_equals_direct_walks_and_grows_with_barriers(spark, seed):
    rows, r = forest(seed), random.Random(seed)
    some = r.sample(range(1, 61), 5)
    got, want = dof(spark, some, rows=rows), direct_dof(rows, some)
    assert all(abs(got[k] - want[k]) < 1e-3 for k in want)
    more = dof(spark, [*some, 60], rows=rows)
    assert all(0 <= got[k] <= more[k] <= 100 for k in got)


def test_scores_keep_what_they_carry(spark):
    b = spark.createDataFrame([(2, 2), (4, 4)], "node long, src long")
    s = barrier_scores(net(spark), b, carry=["src"])
    assert {(r["src"]) for r in s.where("node = 1").collect()} == {2, 4}


def test_dor_and_accumulation(spark):
    d = {r["node"]: round(r["dor"], 3) for r in regulation(net(spark), spark.createDataFrame([(2, 60.0), (2, 40.0), (77, 9.0)], "node long, stor_mcm double")).collect()}
    assert d[2] == 6.342 and d[1] == 3.171 and d[3] == d[4] == 0.0
    t = {r["node"]: r["total"] for r in accumulate(net(spark), net(spark).select("node", F.lit(1.0).alias("amount"))).collect()}
    assert t == {1: 7.0, 2: 3.0, 3: 3.0, 4: 1.0, 5: 1.0, 6: 1.0, 7: 1.0}


def test_a_cycle_is_an_error(spark):
    n = net(spark, [(1, 2, 5.0), (2, 1, 5.0)])
    with pytest.raises(ValueError):
        accumulate(n, n.select("node", F.lit(1.0).alias("amount"))).collect()
    with pytest.raises(ValueError):
        fragmentation(n, n.select("node")).collect()
    with pytest.raises(ValueError):
        dissolve(n.withColumn("c", F.lit(1)), ["c"])


def test_a_long_river_takes_few_rounds(spark, monkeypatch):
    import riverspark.operators.network as m

    written = []
    monkeypatch.setattr(m, "cut", lambda df, name="cut": written.append(name) or cut(df, name))
    n = spark.range(1, 5001).select(F.col("id").alias("node"), F.when(F.col("id") > 1, F.col("id") - 1).alias("down"), (5001.0 - F.col("id")).alias("q"), F.lit(0).alias("fall"))
    total = {r["node"]: r["total"] for r in accumulate(n, n.select("node", F.lit(1.0).alias("amount"))).collect()}
    assert all(total[k] == 5001 - k for k in range(1, 5001))
    assert len(written) <= 2 + 14 + 13
    written.clear()
    d = {r["node"]: r["dof"] for r in fragmentation(n, spark.createDataFrame([(2001,)], "node long")).collect()}
    want = {k: max(0.0, 100 - abs(math.log10(5001 - k) - math.log10(3000)) * 100 / math.log10(5)) for k in range(1, 5001)}
    assert all(abs(d[k] - want[k]) < 1e-6 for k in want)
    assert len(written) <= 2 + 14 + 13


def test_pass_ratio(spark):
    d = spark.createDataFrame([(0.0, 5.0), (5.0, 0.0), (31.536, 1.0), (1e-9, 1e9)], "v double, q double")
    assert [round(r[0], 6) for r in d.select(pass_ratio(F.col("v"), F.col("q"))).collect()] == [1.0, 1.0, 0.05, 1.0]


def test_trapping(spark):
    n = net(spark).withColumn("ero", F.lit(10.0))
    none = spark.createDataFrame([], "node long, volume double, loss double")
    s = {r["node"]: r for r in trapping(n, spark.createDataFrame([(2, 1e9)], "node long, volume double"), none).collect()}
    assert s[1]["natural"] == pytest.approx(70) and s[3]["sed"] == 0.0
    assert s[1]["sed"] == pytest.approx(100 * 30 / 70, rel=0.01) and s[2]["sed"] > 99


def test_dissolve_and_status(spark):
    n = net(spark).withColumn("bb", F.when(F.col("node").isin(1, 2, 4), 1).otherwise(F.col("node"))).withColumn("ff", F.when(F.col("node") == 4, 0).otherwise(1))
    s = {r["node"]: r["stretch"] for r in dissolve(n, ["bb", "ff"]).collect()}
    assert s[2] == s[1] == 1 and s[4] == 4 and s[3] == 3
    rows = spark.createDataFrame([(1, 1, 1, 60.0, 100.0), (1, 1, 1, 40.0, 100.0), (2, 5, 1, 10.0, 100.0), (2, 6, 0, 90.0, 100.0), (3, 7, 0, 1.0, None)], "bb_id long, stretch long, ff int, length double, bb_length double")
    st = {r["stretch"]: (r["status2"], r["status1"]) for r in river_status(rows).collect()}
    assert st == {1: (1, 1), 5: (2, 3), 6: (3, 3), 7: (0, 0)}
    v = rows.withColumnRenamed("length", "volume").withColumnRenamed("bb_length", "bb_volume")
    assert [tuple(r) for r in small_stretches(v, 95.0).collect()] == [(2, 6)]


def test_dense_ids(spark):
    d = spark.createDataFrame([(1, "a", 5.0), (2, "a", 1.0), (3, "a", None), (4, "b", 2.0)], "k long, b string, u double")
    assert {r["k"]: r["idx"] for r in dense_ids(d, "b", ["u"], "k").collect()} == {1: 2, 2: 1, 3: 3, 4: 1}


def test_both_sides_of_a_score(spark):
    r = spark.range(1).select(dof_score(F.lit(10.0), F.lit(100.0), 5.0, True), dof_score(F.lit(10.0), F.lit(100.0), 5.0, False), dof_score(F.lit(100.0), F.lit(100.0), 5.0, True)).first()
    assert tuple(r) == (0.0, 100.0, 100.0)
