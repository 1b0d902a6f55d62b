"""Tests and models. Data are reduced by aggregates to moments, counts or a small Gram matrix; only those reach the driver."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riverspark.functions.special import chi2_p_value, normal_p, normal_p_value, student_p_value

#: Places of a lag model at most: their weights are factorised on the driver, within a band of about the root of their number.
MAX_PLACES = 50_000
#: Largest |rho|.
BOUND = 0.999


def welch(df: DataFrame, high: Column, metrics: list[str]) -> DataFrame:
    """(metric, n_high, n_low, mean_high, mean_low, t, dof, p) of Welch's test between two groups.

    Nulls, NaN and infinities are left out. A group of fewer than two values, or without variance in both, has null t.
    """
    each = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics])
    rows = df.select(high.alias("h"), F.explode(each).alias("s")).select("h", "s.*").where(F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") < float("inf")))
    a = {x: F.when(F.col("h") == x, F.col("v")) for x in (True, False)}
    g = rows.groupBy("metric").agg(*[f(a[x]).alias(f"{n}{int(x)}") for x in a for n, f in (("n", F.count), ("m", F.avg), ("s", F.var_samp))])
    q1, q0 = F.try_divide(F.col("s1"), F.col("n1")), F.try_divide(F.col("s0"), F.col("n0"))
    t = F.try_divide(F.col("m1") - F.col("m0"), F.sqrt(q1 + q0))
    dof = F.try_divide(F.pow(q1 + q0, 2), F.try_divide(q1 * q1, F.col("n1") - 1) + F.try_divide(q0 * q0, F.col("n0") - 1))
    w = g.select("metric", F.col("n1").alias("n_high"), F.col("n0").alias("n_low"), F.col("m1").alias("mean_high"), F.col("m0").alias("mean_low"), t.alias("t"), dof.alias("dof"))
    return w.withColumn("p", student_p_value("t", "dof"))


def independence(counts: DataFrame, row: str, col: str, n: str) -> DataFrame:
    """(chi2, dof, p) of a table of counts (row, col, n); cells that don't occur count as 0."""
    total = F.sum(n).over(Window.partitionBy())  # a table of categories, already aggregated
    c = counts.select(F.col(n).cast("double").alias("o"), F.sum(n).over(Window.partitionBy(row)).cast("double").alias("r"), F.sum(n).over(Window.partitionBy(col)).cast("double").alias("c"), total.cast("double").alias("t"), F.col(row).alias("_row"), F.col(col).alias("_col"))
    # an absent cell adds its expected count; all expected counts add up to t
    e = F.col("r") * F.col("c") / F.col("t")
    s = c.agg(F.sum(F.pow(F.col("o") - e, 2) / e).alias("x"), F.sum(e).alias("e"), F.max("t").alias("t"), F.countDistinct("_row").alias("a"), F.countDistinct("_col").alias("b"))
    return s.select((F.col("x") + F.col("t") - F.col("e")).alias("chi2"), ((F.col("a") - 1) * (F.col("b") - 1)).cast("long").alias("dof")).withColumn("p", chi2_p_value("chi2", F.col("dof").cast("double")))


def fdr(df: DataFrame, region: str, p: str, key: str) -> DataFrame:
    """df with p_adj: Benjamini-Hochberg within each region; null and NaN p-values have none and don't count."""
    ok = F.when(F.col(p).isNotNull() & ~F.isnan(p), F.col(p))
    d = df.withColumn("_p", ok)
    n = F.count("_p").over(Window.partitionBy(region))
    r = F.row_number().over(Window.partitionBy(region).orderBy(F.col("_p").asc_nulls_last(), key))
    d = d.withColumn("_q", F.when(F.col("_p").isNotNull(), F.col("_p") * n / r)).withColumn("_r", r)
    after = Window.partitionBy(region).orderBy("_r").rowsBetween(0, Window.unboundedFollowing)
    return d.withColumn("p_adj", F.when(F.col("_p").isNotNull(), F.least(F.lit(1.0), F.min("_q").over(after)))).drop("_p", "_q", "_r")


def moran(values: DataFrame, weights: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, n, i, expected, z, p): Moran's I under normality. values (by, id, v); weights (i, j, w), of rows with a value only.

    A group without variance or links has null i.
    """
    by = by or []
    w0 = Window.partitionBy(*by)
    v = values.where(F.col("v").isNotNull()).withColumn("z", F.col("v") - F.avg("v").over(w0)).select(*by, "id", "z")
    a, b = v.select(*by, F.col("id").alias("i"), F.col("z").alias("zi")), v.select(*by, F.col("id").alias("j"), F.col("z").alias("zj"))
    pairs = weights.select("i", "j", "w").join(a, "i").join(b, [*by, "j"])
    back = weights.select(F.col("i").alias("j"), F.col("j").alias("i"), F.col("w").alias("wb"))
    both = pairs.join(back, ["i", "j"], "left")
    wb = F.coalesce("wb", F.lit(0.0))
    # S1 = half the sum of (w_ij + w_ji)^2 over ordered pairs; a pair that is stored one way only counts for both orders
    one_way = F.when(F.col("wb").isNull(), F.lit(2.0)).otherwise(F.lit(1.0))
    sums = both.groupBy(*by).agg(F.sum("w").alias("s0"), F.sum(F.col("w") * F.col("zi") * F.col("zj")).alias("cross"), (F.sum(F.pow(F.col("w") + wb, 2) * one_way) / 2).alias("s1"))
    out, into = pairs.groupBy(*by, F.col("i").alias("id")).agg(F.sum("w").alias("o")), pairs.groupBy(*by, F.col("j").alias("id")).agg(F.sum("w").alias("k"))
    s2 = out.join(into, [*by, "id"], "full_outer").groupBy(*by).agg(F.sum(F.pow(F.coalesce("o", F.lit(0.0)) + F.coalesce("k", F.lit(0.0)), 2)).alias("s2"))
    base = v.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(F.pow("z", 2)).alias("ss"))
    j = base.join(sums, by).join(s2, by) if by else base.join(sums, F.lit(True)).join(s2, F.lit(True))
    n = F.col("n").cast("double")
    i = F.try_divide(n * F.col("cross"), F.col("s0") * F.col("ss"))
    ei = F.try_divide(F.lit(-1.0), n - 1)
    var = F.try_divide(n * n * F.col("s1") - n * F.col("s2") + 3 * F.col("s0") * F.col("s0"), (n * n - 1) * F.col("s0") * F.col("s0")) - ei * ei
    m = j.select(*by, "n", i.alias("i"), ei.alias("expected"), var.alias("_v"))
    return m.withColumn("z", F.try_divide(F.col("i") - F.col("expected"), F.sqrt("_v"))).drop("_v").withColumn("p", normal_p_value("z"))


def gram(df: DataFrame, columns: list[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, means and centred Gram matrix of complete cases, in one pass; rows with a null or NaN are left out.

    Products are taken about the means (a first small aggregate), so large offsets don't cancel digits.
    """
    ok = df.select(*[F.col(c).cast("double").alias(f"c{k}") for k, c in enumerate(columns)])
    k = len(columns)
    for c in ok.columns:
        ok = ok.where(F.col(c).isNotNull() & ~F.isnan(c))
    first = ok.agg(F.count(F.lit(1)).alias("n"), *[F.avg(f"c{i}").alias(f"m{i}") for i in range(k)]).first()
    if not first["n"]:
        return 0, np.zeros(k), np.zeros((k, k))
    mean = np.array([first[f"m{i}"] for i in range(k)])
    cells = [(i, j) for i in range(k) for j in range(i, k)]
    row = ok.agg(*[F.sum((F.col(f"c{i}") - F.lit(float(mean[i]))) * (F.col(f"c{j}") - F.lit(float(mean[j])))).alias(f"g{i}_{j}") for i, j in cells]).first()
    g = np.zeros((k, k))
    for i, j in cells:
        g[i, j] = g[j, i] = row[f"g{i}_{j}"]
    return first["n"], mean, g


def vif(df: DataFrame, columns: list[str]) -> dict[str, float]:
    """Variance inflation of each column: the diagonal of the inverse correlation matrix; NaN for a constant column, infinite for a collinear one."""
    _, _, g = gram(df, columns)
    d = np.sqrt(np.diag(g))
    live = d > 0
    out = dict.fromkeys(columns, math.nan)
    if live.any():
        r = g[np.ix_(live, live)] / np.outer(d[live], d[live])
        try:
            inverse = np.diag(np.linalg.inv(r))
        except np.linalg.LinAlgError:
            inverse = np.full(live.sum(), math.inf)
        out |= dict(zip(np.array(columns)[live], map(float, inverse)))
    return out


@dataclass
class Fit:
    """A linear model: coefficients of the intercept (first) and the columns, and its quality."""

    n: int
    coefficients: np.ndarray
    r2: float
    adjusted: float
    aic: float
    rho: float = 0.0
    rho_z: float = math.nan
    rho_p: float = math.nan


def ols(df: DataFrame, y: str, xs: list[str]) -> Fit:
    """Least squares with an intercept, from the centred Gram matrix."""
    n, mean, g = gram(df, [y, *xs])
    k = len(xs)
    if n <= k + 1:
        raise ValueError(f"{n} complete cases are too few")
    b = np.linalg.lstsq(g[1:, 1:], g[1:, 0], rcond=None)[0]
    rss = max(g[0, 0] - b @ g[1:, 0], 0.0)
    r2 = 1 - rss / g[0, 0] if g[0, 0] > 0 else math.nan
    aic = n * (math.log(2 * math.pi * max(rss, 1e-300) / n) + 1) + 2 * (k + 1)
    return Fit(n, np.r_[mean[0] - b @ mean[1:], b], float(r2), float(1 - (1 - r2) * (n - 1) / (n - k - 1)), float(aic))


class Determinant:
    """ln|I - rho W| of row-standardised sparse weights, exact at any rho between -1 and 1 and any number of places.

    Places are put in the order of a breadth-first walk (reverse Cuthill-McKee), which gathers the weights in a band;
    elimination within the band needs no pivots, as I - rho W is diagonally dominant. Cost: places times band squared.
    """

    def __init__(self, places: int, rows: np.ndarray, columns: np.ndarray, w: np.ndarray):
        order = _walk_order(places, rows, columns)
        place = np.empty(places, np.int64)
        place[order] = np.arange(places)
        self.n, self.i, self.j, self.w = places, place[rows], place[columns], w
        self.band = int(np.abs(self.i - self.j).max()) if len(w) else 0

    def log(self, rho: float) -> float:
        n, b = self.n, self.band
        if not b:
            return 0.0
        band = np.zeros((n, 2 * b + 1))  # row r holds columns r-b to r+b
        band[:, b] = 1.0
        np.add.at(band, (self.i, self.j - self.i + b), -rho * self.w)
        flat, width, total = band.reshape(-1), 2 * b + 1, 0.0
        size = flat.itemsize
        for k in range(n):
            m = min(b, n - 1 - k)
            pivot = band[k, b]
            total += math.log(pivot)
            if m:
                # one row down in a column is one row of the band less one place
                below = np.lib.stride_tricks.as_strided(flat[(k + 1) * width + b - 1 :], (m,), (2 * b * size,))
                block = np.lib.stride_tricks.as_strided(flat[(k + 1) * width + b :], (m, m), (2 * b * size, size))
                live = np.flatnonzero(below)
                if len(live):
                    block[live] -= np.outer(below[live] / pivot, band[k, b + 1 : b + 1 + m])
        return total

    def mean_diagonal(self, rho: float, h: float = 1e-4) -> float:
        """The mean diagonal of (I - rho W)^-1, from the derivative of the log-determinant (error about h^2)."""
        return 1 - rho / self.n * (self.log(rho + h) - self.log(rho - h)) / (2 * h) if self.n else 1.0


def _walk_order(places: int, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Places in reverse Cuthill-McKee order of the links in either direction."""
    a, b = np.r_[rows, columns], np.r_[columns, rows]
    o = np.lexsort((b, a))
    a, b = a[o], b[o]
    first = np.searchsorted(a, np.arange(places + 1))
    degree = np.diff(first)
    seen, out = np.zeros(places, bool), []
    for start in np.argsort(degree, kind="stable"):
        if seen[start]:
            continue
        seen[start] = True
        queue = [int(start)]
        for p in queue:
            near = np.unique(b[first[p] : first[p + 1]])
            near = near[~seen[near]]
            seen[near] = True
            queue += near[np.argsort(degree[near], kind="stable")].tolist()
        out += queue
    return np.array(out[::-1], np.int64)


def determinant(weights: DataFrame, limit: int = MAX_PLACES) -> Determinant:
    """Of weights (i, j, w) between at most `limit` places, which is checked before they are fetched."""
    size = weights.agg(F.countDistinct("i").alias("n"), F.count(F.lit(1)).alias("links")).first()
    if size["n"] > limit or size["links"] > 50 * limit:
        raise ValueError(f"a lag model is limited to {limit} places and 50 links each")
    rows = weights.select("i", "j", "w").collect()
    i, j = (np.array([r[c] for r in rows], np.int64) for c in ("i", "j"))
    ids = np.unique(np.r_[i, j])
    return Determinant(len(ids), np.searchsorted(ids, i), np.searchsorted(ids, j), np.array([r["w"] for r in rows], float))


def spatial_lag(df: DataFrame, weights: DataFrame, y: str, xs: list[str]) -> tuple[Fit, Determinant]:
    """Maximum likelihood of y = rho W y + X b + e, and the determinant. df: id, y, xs, complete; weights (i, j, w), row-standardised.

    The likelihood is concentrated on rho: it needs the Gram matrix of (y, Wy, X), made by Spark, and ln|I - rho W|, which
    is exact at every size. rho is sought between -0.999 and 0.999; one at the bound is an error.
    """
    lag = weights.join(df.select(F.col("id").alias("j"), F.col(y).alias("_y")), "j").groupBy(F.col("i").alias("id")).agg(F.sum(F.col("w") * F.col("_y")).alias("_wy"))
    n, mean, g = gram(df.join(lag, "id"), [y, "_wy", *xs])
    k = len(xs)
    if n <= k + 2:
        raise ValueError(f"{n} complete cases are too few")
    det = determinant(weights)
    gx = g[2:, 2:]
    b0, bl = np.linalg.lstsq(gx, g[2:, 0], rcond=None)[0], np.linalg.lstsq(gx, g[2:, 1], rcond=None)[0]
    e00 = g[0, 0] - b0 @ g[2:, 0]
    e01 = g[0, 1] - b0 @ g[2:, 1]
    e11 = g[1, 1] - bl @ g[2:, 1]

    def likelihood(r: float) -> float:
        return det.log(r) - n / 2 * math.log(max(e00 - 2 * r * e01 + r * r * e11, 1e-300) / n)

    lo, hi, golden = -BOUND, BOUND, (math.sqrt(5) - 1) / 2
    a, b = hi - golden * (hi - lo), lo + golden * (hi - lo)
    fa, fb = likelihood(a), likelihood(b)
    while hi - lo > 1e-7:
        if fa < fb:
            lo, a, fa = a, b, fb
            b = lo + golden * (hi - lo)
            fb = likelihood(b)
        else:
            hi, b, fb = b, a, fa
            a = hi - golden * (hi - lo)
            fa = likelihood(a)
    rho = (lo + hi) / 2
    if BOUND - abs(rho) < 1e-4:
        raise ValueError("the likelihood has no maximum below |rho| = 1")
    h = 1e-4
    curve = -(likelihood(rho + h) - 2 * likelihood(rho) + likelihood(rho - h)) / h**2
    z = rho * math.sqrt(curve) if curve > 0 else math.nan
    beta = b0 - rho * bl
    rss = max(e00 - 2 * rho * e01 + rho * rho * e11, 1e-300)
    r2 = 1 - rss / g[0, 0] if g[0, 0] > 0 else math.nan
    full = likelihood(rho) - n / 2 * (math.log(2 * math.pi) + 1)
    numbers = (r2, 1 - (1 - r2) * (n - 1) / (n - k - 2), 2 * (k + 2) - 2 * full, rho, z, normal_p(z))
    fit = Fit(n, np.r_[mean[0] - rho * mean[1] - beta @ mean[2:], beta], *map(float, numbers))
    return fit, det


def effects(fit: Fit, det: Determinant) -> list[tuple[float, float, float]]:
    """(direct, indirect, total) of each column: the mean diagonal and row sum of (I - rho W)^-1 times the coefficient."""
    direct, total = det.mean_diagonal(fit.rho), 1 / (1 - fit.rho)
    return [(float(b * direct), float(b * (total - direct)), float(b * total)) for b in fit.coefficients[1:]]
