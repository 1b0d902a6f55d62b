"""Properties that hold for any input, by hypothesis."""

import math

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from riverspark.functions.geometry import hull, smallest_box, thinned
from riverspark.functions.special import betainc, gammaincc, poisson_quantile
from riverspark.operators.proximity import box_distance, segment_distance

number = st.floats(-1e4, 1e4, allow_nan=False).map(lambda x: round(x, 3))
points = st.lists(st.tuples(number, number), min_size=1, max_size=12)


@given(number, number, number, number, number, number)
@settings(max_examples=200, deadline=None)
def test_segment_distance_is_the_least_over_the_segment(px, py, ax, ay, bx, by):
    d = float(segment_distance(*(np.array([float(v)]) for v in (px, py, ax, ay, bx, by)))[0])
    t = np.linspace(0, 1, 501)
    near = np.hypot(px - (ax + t * (bx - ax)), py - (ay + t * (by - ay))).min()
    assert d <= near + 1e-6 and near - d <= math.hypot(bx - ax, by - ay) / 500 + 1e-6


@given(number, number, number, number, st.floats(0, 100), st.floats(0, 100))
@settings(max_examples=100, deadline=None)
def test_box_distance_is_zero_inside_only(px, py, ax, ay, w, h):
    d = float(box_distance(px, py, ax, ay, ax + w, ay + h))
    assert (d == 0) == (ax <= px <= ax + w and ay <= py <= ay + h)


@given(points)
@settings(max_examples=150, deadline=None)
def test_smallest_box_holds_all_points(ps):
    p = np.array(ps, float)
    x, y, w, h, a = smallest_box(p)
    assert w >= h >= 0 and len(hull(p)) <= len(np.unique(p, axis=0))
    r = np.array([[math.cos(a), math.sin(a)], [-math.sin(a), math.cos(a)]])
    q = (p - [x, y]) @ r.T
    assert (np.abs(q[:, 0]) <= w / 2 + 1e-3).all() and (np.abs(q[:, 1]) <= h / 2 + 1e-3).all()


@given(st.lists(st.tuples(number, number), min_size=2, max_size=30), st.floats(0.01, 500))
@settings(max_examples=100, deadline=None)
def test_thinned_lines_keep_their_ends_and_only_vertices(ps, tolerance):
    p = np.array(ps, float)
    q = thinned(p, tolerance)
    assert (q[0] == p[0]).all() and (q[-1] == p[-1]).all() and len(q) <= len(p)
    assert {tuple(x) for x in q} <= {tuple(x) for x in p}
    assert len(thinned(p, 1e9)) == 2


@given(st.floats(0.1, 50), st.floats(0.1, 50), st.floats(0.001, 0.999))
@settings(max_examples=150, deadline=None)
def test_incomplete_functions_are_distributions(a, b, x):
    v = betainc(a, b, x)
    assert -1e-9 <= v <= 1 + 1e-9 and abs(v + betainc(b, a, 1 - x) - 1) < 1e-8
    assert -1e-9 <= gammaincc(a, b) <= 1 + 1e-9 and gammaincc(a, b) >= gammaincc(a, b + 1) - 1e-9


@given(st.floats(0.01, 300), st.floats(0.001, 0.999))
@settings(max_examples=150, deadline=None)
def test_poisson_quantile_inverts(mean, u):
    k = poisson_quantile(mean, u)
    assert gammaincc(k + 1, mean) >= u - 1e-9 and (k == 0 or gammaincc(k, mean) < u + 1e-9)
