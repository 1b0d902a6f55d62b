"""The nearest segment at any distance against brute force and SQL."""

import random
import sys
from pathlib import Path

import duckdb
import numpy as np
import pytest

from riverspark.operators.nearest import nearest_segments
from riverspark.operators.proximity import segment_distance

POINT, SHAPE = "pid long, x double, y double", "sid long, ax double, ay double, bx double, by double"


def brute(pts, shp):
    s = np.array([q[1:] for q in shp], float)
    want = {}
    for i, x, y in pts:
        d = segment_distance(x, y, *s.T)
        want[i] = min(want.get(i, (np.inf, 0)), min(zip(d.round(7), (q[0] for q in shp))))
    return want


@pytest.mark.parametrize("tile,lot", [(1024, 50_000), (7, 3), (1, 1)])
def test_nearest_equals_brute_force(spark, tile, lot):
    r = random.Random(3)
    pts = [(k, r.uniform(1, 3000), r.uniform(-500, 3000)) for k in range(200)] + [(k, 100.0, 100.0) for k in range(200, 260)] + [(300, 4e11, -9.0), (301, 1500.0, 8e5), (302, 2000.0, 2000.0), (302, 9.0, 9.0)]
    shp = [(k, x, y, x + w, y + h) for k in range(150) for x, y in [(r.uniform(0, 500), r.uniform(0, 3000))] for w, h in [r.choice([(5, 5), (-20, 10), (0, 0), (2500, 900)])]]
    shp += [(700 + k, 50.0, 50.0, 60.0, 50.0) for k in range(40)] + [(900, 5000.0, 5000.0, 9e14, 5000.0)] + [(800 - k, 250.0, 3000.0 + 7 * (k % 2), 251.0, 3001.0 + 5 * (k % 2)) for k in range(6)]
    bad_p = [(400, None, 1.0), (401, 0.0, 0.0), (402, float("nan"), 1.0), (None, 5.0, 5.0), (403, float("inf"), 2.0)]
    bad_s = [(901, None, 1.0, 1.0, 1.0), (None, 1.0, 1.0, 1.0, 1.0), (902, float("nan"), 0.0, 1.0, 1.0)]
    p, s = spark.createDataFrame(pts + pts[:5] + bad_p, POINT), spark.createDataFrame(shp + shp[:9] + bad_s, SHAPE)
    got = nearest_segments(p, s, tile=tile, lot=lot).collect()
    want = brute(pts, shp)
    assert {x["pid"]: x["sid"] for x in got} == {k: v[1] for k, v in want.items()} and len(got) == len(want)
    assert all(abs(x["distance"] - want[x["pid"]][0]) <= 1e-6 + 1e-12 * x["distance"] for x in got)
    assert nearest_segments(p.limit(0), s).collect() == [] and nearest_segments(p, s.limit(0)).collect() == []


def test_dams_beyond_every_reach_equal_sql(spark, tmp_path):
    """Dams at any distance, the farthest 900,000 km away, in one plan that doesn't grow with the distance."""
    import __spark_entry__ as e

    sys.path.insert(0, str(Path(__file__).resolve().parent))
    from compare import compare

    source = Path("/root/testdata/sf0.001")
    if not source.exists():
        pytest.skip("no test data")
    for t in ("dams", "reaches"):
        duckdb.execute(f"COPY (SELECT {'* REPLACE (CASE WHEN dam_id % 5 = 0 THEN x * 40 WHEN dam_id % 5 = 1 THEN x + 9e8 ELSE x END AS x)' if t == 'dams' else '*'} FROM '{source}/{t}.parquet') TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
    text, same = compare(spark, "jon8_nearest_reach_any_distance", str(tmp_path))
    assert same, text
    plan = e.queries()["jon8_nearest_reach_any_distance"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 20
