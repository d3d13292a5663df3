"""Statistics that Spark lacks, in numpy and the standard library."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np


def z_of(p: float) -> float:
    """Standard normal quantile, for use as a literal in plans."""
    return NormalDist().inv_cdf(p)


def normal_cdf(x: np.ndarray, mu: float = 0.0, sigma: float = 1.0) -> np.ndarray:
    return np.array([0.5 * math.erfc(-(v - mu) / (sigma * math.sqrt(2))) for v in np.asarray(x, float)])


def ks_asymptotic(d: float, n: float) -> float:
    """Kolmogorov's limit distribution: P(D > d)."""
    x = math.sqrt(n) * d
    if x <= 0:
        return 1.0
    if x < 1:
        s = sum(math.exp(-((2 * k - 1) ** 2) * math.pi**2 / (8 * x * x)) for k in range(1, 30))
        return min(1.0, max(0.0, 1 - math.sqrt(2 * math.pi) / x * s))
    s = sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101))
    return min(1.0, max(0.0, 2 * s))


def ks_exact(d: float, n: int) -> float:
    """P(D_n >= d) for n values without ties, by the matrix-power formula of Marsaglia,
    Tsang and Wang (2003)."""
    k = int(n * d) + 1
    m, h = 2 * k - 1, k - n * d
    a = (np.arange(m)[:, None] - np.arange(m)[None, :] + 1 >= 0).astype(float)
    power = h ** np.arange(1, m + 1)
    a[:, 0] -= power
    a[-1, :] -= power[::-1]
    if 2 * h - 1 > 0:
        a[-1, 0] += (2 * h - 1) ** m
    for i in range(m):
        for j in range(min(i + 1, m - 1) + 1):
            if i - j + 1 > 0:
                a[i, j] /= math.factorial(i - j + 1)
    s = np.linalg.matrix_power(a, n)[k - 1, k - 1]
    for i in range(1, n + 1):
        s *= i / n
    return float(min(1.0, max(0.0, 1 - s)))


def ks_one_sample(x: np.ndarray, cdf, exact: bool | None = None) -> tuple[float, float]:
    """Two-sided statistic and p-value; exact below 100 values without ties by default."""
    x = np.sort(np.asarray(x, float))
    n = len(x)
    f = cdf(x)
    d = float(max((np.arange(1, n + 1) / n - f).max(), (f - np.arange(n) / n).max()))
    if exact is None:
        exact = n < 100 and len(np.unique(x)) == n
    return d, ks_exact(d, n) if exact else ks_asymptotic(d, n)


def ks_two_sample(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    x, y = np.sort(x), np.sort(y)
    at = np.concatenate([x, y])
    d = float(np.abs(np.searchsorted(x, at, "right") / len(x) - np.searchsorted(y, at, "right") / len(y)).max())
    return d, ks_asymptotic(d, len(x) * len(y) / (len(x) + len(y)))


def anderson_darling_k(samples: list[np.ndarray]) -> float:
    """k-sample Anderson-Darling statistic (Scholz and Stephens 1987, without ties)."""
    pooled = np.sort(np.concatenate(samples))
    n, j = len(pooled), np.arange(1, len(pooled))
    out = 0.0
    for s in samples:
        m = np.searchsorted(np.sort(s), pooled[:-1], "right")
        out += ((n * m - j * len(s)) ** 2 / (j * (n - j))).sum() / len(s)
    return float(out / n)


def rank_sum_p(x: np.ndarray, y: np.ndarray) -> float:
    """Two-sided rank-sum test by the normal limit, ties at mean rank."""
    both = np.concatenate([x, y])
    _, back, count = np.unique(both, return_inverse=True, return_counts=True)
    rank = (np.cumsum(count) - (count - 1) / 2)[back]
    n, m = len(x), len(y)
    mean, var = n * (n + m + 1) / 2, n * m / 12 * ((n + m + 1) - (count**3 - count).sum() / max((n + m) * (n + m - 1), 1))
    if var <= 0:
        return 1.0
    z = (rank[:n].sum() - mean) / math.sqrt(var)
    return math.erfc(abs(z) / math.sqrt(2))


def weibull_mle(x: np.ndarray) -> tuple[float, float] | None:
    """Scale and shape by Newton's method on the profile likelihood of the shape; None if
    the values do not vary."""
    x = np.asarray(x, float)
    if len(x) < 2 or x.min() <= 0 or x.min() == x.max():
        return None
    log_x = np.log(x / x.max())
    c = max(0.1, (x.mean() / max(x.std(ddof=1), 1e-6)) ** 1.086)
    for _ in range(200):
        w = np.exp(c * log_x)
        s0, s1, s2 = w.sum(), (w * log_x).sum(), (w * log_x**2).sum()
        g = s1 / s0 - 1 / c - log_x.mean()
        step = g / ((s2 * s0 - s1**2) / s0**2 + 1 / c**2)
        new = c - step
        if new <= 0:
            new = c / 2
        if abs(new - c) < 1e-12 * c:
            c = new
            break
        c = new
    return float(x.max() * np.exp(c * log_x).mean() ** (1 / c)), float(c)


def mixture_em(x: np.ndarray, k: int = 2, max_rounds: int = 500, start: dict | None = None) -> dict | None:
    """Gaussian mixture by expectation maximisation on values in time order.

    Starts from evenly spaced values, or from a model; stops once the log likelihood gains at
    most 0.03 ln n, or after max_rounds (converged False). None where the values do not vary.
    """
    x = np.asarray(x, float)
    n = len(x)
    if n < max(2, k) or x.min() == x.max():
        return None
    spread = x.var()
    floor_ = spread / 1e5
    if start is None:
        mean = x[[int((j * (n - 1)) // (k - 1)) if k > 1 else 0 for j in range(k)]].copy()
        var, share = np.full(k, spread + floor_), np.full(k, 1 / k)
    else:
        mean, var, share = (np.array(v, float) for v in (start["mu"], np.square(start["sigma"]), start["prop"]))

    def joint():
        lp = -0.5 * (x[:, None] - mean) ** 2 / var - 0.5 * (math.log(2 * math.pi) + np.log(var))
        top = lp.max(axis=1)
        p = np.exp(lp - top[:, None]) * share
        return p, p.sum(axis=1), top

    p, total, top = joint()
    now, converged = float((np.log(total) + top).sum()), False
    for _ in range(max_rounds):
        before, resp = now, p / total[:, None]
        weight = resp.sum(axis=0)
        if not (weight > 0).all():
            return None
        mean = (x[:, None] * resp).sum(axis=0) / weight
        var = ((x[:, None] - mean) ** 2 * resp).sum(axis=0) / weight + floor_
        share = weight / weight.sum()
        p, total, top = joint()
        now = float((np.log(total) + top).sum())
        if now - before <= 0.03 * math.log(n):
            converged = True
            break
    order = np.argsort(mean, kind="stable")
    return {"mu": mean[order], "sigma": np.sqrt(var[order]), "prop": share[order], "loglik": now, "converged": converged}


def merge_closest(fit: dict) -> dict:
    """A mixture with its two closest components merged: those that lose the least likelihood."""
    mu, var, share = fit["mu"], np.square(fit["sigma"]), fit["prop"]
    best = None
    for a in range(len(mu)):
        for b in range(a + 1, len(mu)):
            s = share[a] + share[b]
            w = share[a] / s
            m = w * mu[a] + (1 - w) * mu[b]
            v = w * (var[a] + (m - mu[a]) ** 2) + (1 - w) * (var[b] + (m - mu[b]) ** 2)
            far = s * np.log(v) - share[a] * np.log(var[a]) - share[b] * np.log(var[b])
            if best is None or far < best[0]:
                best = (far, a, b, m, v, s)
    _, a, b, m, v, s = best
    out = {"mu": mu.copy(), "sigma": np.sqrt(var), "prop": share.copy()}
    for name, value in (("mu", m), ("sigma", math.sqrt(v)), ("prop", s)):
        out[name][a] = value
        out[name] = np.delete(out[name], b)
    return out


def mixture_mdl(x: np.ndarray, k: int = 3, final_k: int = 0) -> dict | None:
    """Order reduction: from k components down, the closest pair is merged and the fit goes on
    from there; the order of least description length (Rissanen), or final_k if it is given."""
    fit, best, n = mixture_em(x, k), None, len(x)
    for m in range(k, max(final_k, 1) - 1, -1):
        if fit is not None and m < k:
            fit = mixture_em(x, m, start=merge_closest(fit))
        if fit is None:
            break
        fit["mdl"] = -fit["loglik"] + 0.5 * (3 * m - 1) * math.log(n)
        if final_k in (0, m) and (best is None or fit["mdl"] < best["mdl"]):
            best = fit
    return best


def mixture_loglik(x: np.ndarray, fit: dict) -> np.ndarray:
    """Log likelihood of new values under a fitted mixture."""
    x = np.asarray(x, float)[:, None]
    lp = -0.5 * ((x - fit["mu"]) / fit["sigma"]) ** 2 - np.log(fit["sigma"] * math.sqrt(2 * math.pi)) + np.log(fit["prop"])
    top = lp.max(axis=1)
    return top + np.log(np.exp(lp - top[:, None]).sum(axis=1))


def mixture_classes(x: np.ndarray, fit: dict) -> np.ndarray:
    """The likeliest component of each value."""
    x = np.asarray(x, float)[:, None]
    return np.argmax(-0.5 * ((x - fit["mu"]) / fit["sigma"]) ** 2 - np.log(fit["sigma"]) + np.log(fit["prop"]), axis=1)
