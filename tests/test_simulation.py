"""Whole simulations: against brute force over the same draws."""

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from riverspark.operators.simulation import first_present, group_means, segment_statistics, strong_uniform, thinned

SCORES = [(1, 10, 100.0), (1, 11, 60.0), (2, 10, 80.0), (2, 11, 100.0), (2, 12, 40.0), (3, 12, 100.0), (3, 11, 60.0), (4, 13, 100.0), (4, 10, 0.0)]
RECORDS = [(1, 1, 2010, None, 0.4), (2, 1, 2020, False, 0.5), (3, 2, 2015, False, 0.7), (4, 2, 2015, True, None), (5, 3, 2010, False, 0.3), (6, 3, 2020, True, 0.1), (7, 4, 2020, False, None), (8, 3, 2015, False, 0.02), (9, None, 2010, True, 1.0)]
NODES, YEARS, SIMS = [(10, "a"), (11, "a"), (12, "b"), (13, "b"), (14, None)], (2010, 2015, 2020), 150


def brute(spark):
    records = spark.createDataFrame(RECORDS, "key long, src long, first_year int, certain boolean, confidence double")
    values = defaultdict(float)
    for r in thinned(records, "key", F.col("certain"), F.col("confidence"), SIMS, 42, strong_uniform).collect():
        for src, node, s in SCORES:
            for y in YEARS:
                if src == r["src"] and r["first_year"] <= y:
                    values[node, y, r["sim"]] = max(values[node, y, r["sim"]], s)
    scores = spark.createDataFrame(SCORES, "src long, node long, s double")
    nodes = spark.createDataFrame(NODES, "node long, g string")
    return nodes, values, *first_present(scores, records, YEARS, SIMS)


def test_group_means_equal_brute_force(spark):
    nodes, values, floors, hits = brute(spark)
    got = {(r["g"], r["year"], r["sim"]): r["mean"] for r in group_means(nodes, "g", floors, hits, YEARS, SIMS).collect()}
    assert len(got) == 2 * 3 * SIMS
    for (g, y, i), v in got.items():
        own = [n for n, x in NODES if x == g]
        assert v == pytest.approx(np.mean([values[n, y, i] for n in own]))
    assert {got["a", 2010, i] for i in range(1, SIMS + 1)} == {0.0, 30.0, 80.0}  # dams of later years aren't there yet


def test_segment_statistics_equal_brute_force(spark):
    nodes, values, floors, hits = brute(spark)
    got = {(r["node"], r["year"]): r for r in segment_statistics(nodes, floors, hits, YEARS, SIMS).collect()}
    assert len(got) == len(NODES) * len(YEARS)
    for (n, y), r in got.items():
        v = [values[n, y, i] for i in range(1, SIMS + 1)]
        assert (r["n"], r["mean"], r["low"], r["high"]) == (SIMS, *[pytest.approx(x) for x in (np.mean(v), *np.percentile(v, [2.5, 97.5]))])
    assert got[11, 2010]["mean"] < got[11, 2015]["mean"] and got[12, 2020]["low"] == 100.0


def test_every_reach_has_an_interval_in_every_year(spark):
    import __spark_entry__ as e

    d = "/root/testdata/sf0.001"
    r = e.queries()["mc5_whole_reaches"](spark, d)
    assert r.count() == 3 * e.queries()["net1_dof"](spark, d).count() and r.where("low > high OR low < 0 OR high > 100 OR n <> 1000").isEmpty()
    by_year = {x["year"]: x["m"] for x in r.groupBy("year").agg(F.avg("mean").alias("m")).collect()}
    assert by_year[2010] < by_year[2015] < by_year[2020]


def test_whole_queries_run_all_simulations(spark):
    import __spark_entry__ as e
    from riverspark.plans.simulation import WHOLE

    d, q = "/root/testdata/sf0.001", e.queries()
    assert WHOLE == 1000
    b = q["mc5_whole_basins"](spark, d).collect()
    assert {r["n"] for r in b} == {1000} and {r["year"] for r in b} == {2010, 2015, 2020}
    assert q["mc1_whole"](spark, d).agg(F.max("sim")).first()[0] == 1000
    for name in ("mc2_whole", "mc10_whole"):
        assert q[name](spark, d).agg(F.max("sim")).first()[0] == 1000


def test_convergence_of_dof_with_the_global_series(spark):
    import __spark_entry__ as e
    from riverspark.plans.simulation import converged, whole_dof

    d, q = "/root/testdata/sf0.001", e.queries()
    dof = defaultdict(dict)
    for r in whole_dof(spark, d, 2000, (2020,)).collect():
        dof[r["hybas_id"]][r["sim"]] = r["dof"]
    x = np.array([[v[i] for i in range(1, 2001)] for v in dof.values()])
    series = dict(zip(dof, x)) | {None: x.mean(axis=0)}
    got = {(r["scope"], r["hybas_id"], r["share"]): r["k"] for r in q["mc8_whole"](spark, d).collect()}
    assert len(got) == 5 * len(series)
    varied = 0
    for b, v in series.items():
        se = np.round([v[:i].std() / np.sqrt(i) for i in range(1, 2001)], 9)
        se = np.where(se > 0, se, np.nan)
        if np.isnan(se[:20]).all():  # no early error to compare with
            continue
        varied += 1
        for share in (0.5, 0.2, 0.1, 0.05, 0.01):
            at = np.where(se <= np.nanmax(se[:20]) * share)[0]
            assert got["all" if b is None else "basin", b, share] == (at[0] + 1 if len(at) else None)
    assert varied > 5 and got["all", None, 0.1] > 20
    still = spark.createDataFrame([("basin", 1, k, 0.0) for k in range(1, 30)], "scope string, hybas_id long, k int, se double")
    assert [r["k"] for r in converged(still).collect()] == [None] * 5
