"""Models of many simulated responses: against the single models, and the whole pipeline."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from riverspark.operators.propagation import Model
from riverspark.operators.statistics import effects, moran, ols, spatial_lag


def test_model_equals_the_single_ones(spark):
    rng, n = np.random.default_rng(5), 60
    x = rng.normal(size=(n, 2)) * [3, 0.1] + [5, 1]
    pairs = [(i, int(j), 0.2) for i in range(n) for j in rng.choice([k for k in range(n) if k != i], 5, replace=False)]
    m = Model(list(range(n)), pairs, x)
    y = np.linalg.solve(np.eye(n) - 0.4 * m.w, m.x @ [1, 2, -1] + rng.normal(size=n) * 0.5)
    q, c = m.fit(y)
    df = spark.createDataFrame([(i, float(y[i]), float(m.x[i, 1]), float(m.x[i, 2])) for i in range(n)], "id long, y double, a double, b double")
    w = spark.createDataFrame(pairs, "i long, j long, w double")
    one, (lag, traces) = ols(df, "y", ["a", "b"]), spatial_lag(df, w, "y", ["a", "b"])
    assert [q["ols_r2"], q["ols_adjusted_r2"], q["ols_aic"]] == pytest.approx([one.r2, one.adjusted, one.aic])
    assert [k["ols_beta"] for k in c] == pytest.approx(list(one.coefficients[1:]))
    assert q["rho"] == pytest.approx(lag.rho, abs=1e-5) and [k["beta"] for k in c] == pytest.approx(list(lag.coefficients[1:]), abs=1e-4)
    assert [(k["direct"], k["indirect"], k["total"]) for k in c] == [pytest.approx(e, abs=1e-3) for e in effects(lag, traces)]
    # by the information matrix here, by the curvature of the concentrated likelihood there
    assert q["rho_p"] == pytest.approx(lag.rho_p, abs=1e-3)
    got = moran(df.select("id", F.col("y").alias("v")), w).first()
    assert list(m.moran(y).values()) == pytest.approx([got["i"], got["expected"], got["z"], got["p"]])
    assert m.fit(np.ones(n)) == ({}, []) and np.isnan(m.moran(np.ones(n))["i"])


def test_pipeline_has_every_part(spark):
    import __spark_entry__ as e

    rows = e.queries()["pipe3_regression_with_uncertainty"](spark, "/root/testdata/sf0.01").collect()
    assert {r["kind"] for r in rows} == {"moran", "fit", "effects"} and {r["region"] for r in rows} == {"Global", "Low", "Mid", "High"}
    assert len({(r["kind"], r["region"], r["dam_type"], r["variable"], r["measure"]) for r in rows}) == len(rows)
    by = {(r["kind"], r["region"], r["dam_type"], r["variable"], r["measure"]): r for r in rows}
    for t in ("e", "g", "b", "a", "total"):
        for k in [("moran", "Global", t, None, "i"), ("fit", "Mid", t, None, "rho"), ("effects", "Global", t, "hdi", "indirect")]:
            assert by[k]["n"] == 1000 and (by[k]["low"] < by[k]["high"]) == (t in ("e", "total"))
    for r in rows:
        assert (r["p_adj"] is not None) == (r["measure"] == "p_value") and (r["label"] is not None) == (r["measure"] in ("i", "resid_i"))
        assert r["p_adj"] is None or r["p_adj"] >= r["mean"] - 1e-12
