"""Moran's I, least squares and spatial lag models of many simulated responses over the same places: what no simulation changes is made once."""

from __future__ import annotations

import math

import numpy as np

from riverspark.functions.special import normal_p

#: Fewest places of a region.
LEAST = 10


class Places:
    """Places with dense row-standardised weights (at most a few thousand places); pairs: (i, j, w)."""

    def __init__(self, ids: list[int], pairs: list[tuple[int, int, float]]):
        self.ids, at = list(ids), {x: k for k, x in enumerate(ids)}
        self.w = np.zeros((len(at), len(at)))
        for i, j, w in pairs:
            self.w[at[i], at[j]] = w
        self.s0, self.s1 = self.w.sum(), ((self.w + self.w.T) ** 2).sum() / 2
        self.s2 = ((self.w.sum(axis=0) + self.w.sum(axis=1)) ** 2).sum()

    def moran(self, v: np.ndarray) -> dict[str, float]:
        """i, expected, z and p under normality; NaN without variance."""
        n, z = len(v), v - v.mean()
        ss, expected = z @ z, -1 / (n - 1)
        if ss <= 0 or self.s0 <= 0:
            return dict.fromkeys(("i", "expected", "z", "p_value"), math.nan)
        i = n * (z @ self.w @ z) / (self.s0 * ss)
        var = (n * n * self.s1 - n * self.s2 + 3 * self.s0**2) / ((n * n - 1) * self.s0**2) - expected**2
        score = (i - expected) / math.sqrt(var) if var > 0 else math.nan
        return {"i": i, "expected": expected, "z": score, "p_value": normal_p(score)}


class Model(Places):
    """Regressions on x (places by columns), which are standardised first."""

    def __init__(self, ids: list[int], pairs: list[tuple[int, int, float]], x: np.ndarray):
        super().__init__(ids, pairs)
        sd = x.std(axis=0)
        self.x = np.c_[np.ones(len(x)), (x - x.mean(axis=0)) / np.where(sd > 0, sd, 1)]
        self.inverse, self.eigen = np.linalg.pinv(self.x), np.linalg.eigvals(self.w)

    def fit(self, y: np.ndarray) -> tuple[dict[str, float], list[dict[str, float]]]:
        """Quality of least squares and of the lag model by maximum likelihood, and of each column its slopes and effects; NaN for a constant y."""
        n, k = self.x.shape
        b0, bl, wy = self.inverse @ y, None, self.w @ y
        e0, tss = y - self.x @ b0, float(((y - y.mean()) ** 2).sum())
        if tss <= 0:
            return {}, []
        rss = max(float(e0 @ e0), 1e-300)
        r2 = 1 - rss / tss
        rest = self.moran(e0)
        quality = {"ols_r2": r2, "ols_adjusted_r2": 1 - (1 - r2) * (n - 1) / (n - k), "ols_aic": n * (math.log(2 * math.pi * rss / n) + 1) + 2 * k, "resid_i": rest["i"], "resid_p": rest["p_value"]}
        bl = self.inverse @ wy
        el = wy - self.x @ bl

        def likelihood(r: float) -> float:
            e = e0 - r * el
            return float(np.log(1 - r * self.eigen).real.sum()) - n / 2 * math.log(max(float(e @ e), 1e-300) / n)

        lo, hi, golden = -0.999, 0.999, (math.sqrt(5) - 1) / 2
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
        beta, e = b0 - rho * bl, e0 - rho * el
        s2 = max(float(e @ e) / n, 1e-300)
        spread = np.linalg.inv(np.eye(n) - rho * self.w)
        g = self.w @ spread
        gxb, t = g @ (self.x @ beta), np.trace(g)
        info = np.zeros((k + 2, k + 2))
        info[:k, :k], info[:k, k] = self.x.T @ self.x / s2, self.x.T @ gxb / s2
        info[k, :k], info[k, k] = info[:k, k], (g * g.T).sum() + (g * g).sum() + gxb @ gxb / s2
        info[k, k + 1] = info[k + 1, k] = t / s2
        info[k + 1, k + 1] = n / (2 * s2 * s2)
        scale = np.sqrt(np.diag(info))
        scale[scale <= 0] = 1
        var = np.diag(np.linalg.pinv(info / np.outer(scale, scale))) / scale**2
        z = [float(c) / math.sqrt(v) if v > 0 else math.nan for c, v in zip((*beta, rho), var)]
        fitted = y - e
        lag_r2 = float(np.corrcoef(y, fitted)[0, 1] ** 2) if fitted.std() > 0 else math.nan
        quality |= {"lag_r2": lag_r2, "rho": rho, "rho_p": normal_p(z[k]), "r2_gain": lag_r2 - r2}
        direct, total = np.trace(spread) / n, spread.sum() / n
        columns = [{"ols_beta": b0[c], "beta": beta[c], "direct": beta[c] * direct, "indirect": beta[c] * (total - direct), "total": beta[c] * total, "z": z[c], "p_value": normal_p(z[c])} for c in range(1, k)]
        return quality, columns
