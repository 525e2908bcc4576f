"""Test statistics' tail probabilities.

Everything that is arithmetic on counts stays in Spark expressions. The four tails Spark has no function
for are small vectorised helpers over rows that are already aggregated (one row per sheet, arm or split).
"""

from __future__ import annotations

import ctypes
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

Z = 1.96                        # fixed value: the two-sided 95 % point every half-width uses
_SAME = 1e-7                    # two outcomes count as equally likely within this relative difference
_SPAN = 1 << 20


def half_width(se: Column | str) -> Column:
    return F.lit(Z) * (F.col(se) if isinstance(se, str) else se)


def rel_half_width(variance: Column | str, p: Column | str) -> Column:
    v = F.col(variance) if isinstance(variance, str) else variance
    p = F.col(p) if isinstance(p, str) else p
    return F.lit(Z) * F.sqrt(v) / p


_LN_SMALL = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, 64)))])


def _ln_factorial(k: np.ndarray) -> np.ndarray:
    """ln k!: a table below 64, Stirling's series from there (relative error below 1e-15)."""
    k = np.asarray(k, float)
    x = np.maximum(k, 63.0) + 1.0
    series = (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x ** 3) + 1 / (1260 * x ** 5)
    return np.where(k < 64, _LN_SMALL[np.clip(k, 0, 63).astype(int)], series)


def _c_ln_gamma() -> np.ndarray:
    """ln k! of small k as the C library's lgamma has it, which SQL engines call: outcomes that are equally likely are then told
    apart, or not, by the same last bits. Where the process shows no such function, Python's own stands in."""
    try:
        ln_gamma = ctypes.CDLL(None).lgamma
    except (OSError, AttributeError, TypeError):
        ln_gamma = math.lgamma
    else:
        ln_gamma.restype, ln_gamma.argtypes = ctypes.c_double, [ctypes.c_double]
    return np.array([ln_gamma(k + 1.0) for k in range(4096)])


_LN_GAMMA = _c_ln_gamma()


def _tails(ln_pmf, lo: np.ndarray, hi: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Per row, the total probability of the outcomes lo..hi no likelier than the one at `at`.

    Rows of similar support are laid out as one matrix; a support wider than a matrix is summed span by span.
    `ln_pmf(outcomes, rows)` gives log probabilities for a matrix of outcomes of the given rows.
    """
    width, out = hi - lo + 1, np.zeros(len(lo))
    order, i = np.argsort(width, kind="stable"), 0
    while i < len(order):
        j = i + 1
        while j < len(order) and (j - i + 1) * width[order[j]] <= _SPAN:
            j += 1
        rows = order[i:j]
        cut = ln_pmf(at[rows][:, None], rows) + math.log1p(_SAME)
        for start in range(0, int(width[rows[-1]]), _SPAN):
            k = lo[rows][:, None] + np.arange(start, min(start + _SPAN, int(width[rows[-1]])))
            inside = k <= hi[rows][:, None]
            ln = ln_pmf(np.where(inside, k, lo[rows][:, None]), rows)
            out[rows] += np.cumsum(np.where(inside & (ln <= cut), np.exp(ln), 0.0), axis=1)[:, -1]       # one after the other, as SQL adds
        i = j
    return np.minimum(out, 1.0)


def _fishers(a, b, c, d) -> np.ndarray:
    small = a + b + c + d < len(_LN_GAMMA)
    out = np.zeros(len(a))
    for some, ln in ((small, lambda k: _LN_GAMMA[k]), (~small, _ln_factorial)):
        if some.any():
            out[some] = _fisher_tails(ln, a[some], b[some], c[some], d[some])
    return out


def _fisher_tails(ln, a, b, c, d) -> np.ndarray:
    r1, r2, c1 = a + b, c + d, a + c
    fixed = ln(r1) + ln(r2) + ln(c1) + ln(b + d) - ln(r1 + r2)

    def ln_pmf(k, rows):
        x, y, z = r1[rows][:, None], c1[rows][:, None], r2[rows][:, None]
        return fixed[rows][:, None] - ln(k) - ln(x - k) - ln(y - k) - ln(z - y + k)
    return _tails(ln_pmf, np.maximum(0, c1 - r2), np.minimum(r1, c1), a)


def _binomials(k, n, p) -> np.ndarray:
    inner = (p > 0) & (p < 1)
    q = np.where(inner, p, 0.5)
    fixed = _ln_factorial(n)

    def ln_pmf(x, rows):
        m, s = n[rows][:, None], q[rows][:, None]
        return fixed[rows][:, None] - _ln_factorial(x) - _ln_factorial(m - x) + x * np.log(s) + (m - x) * np.log1p(-s)
    certain = np.where(k == np.where(p <= 0, 0, n), 1.0, 0.0)
    return np.where(inner, _tails(ln_pmf, np.zeros_like(n), n, k), certain)


def _kolmogorov(d: float, n: int) -> float:
    """P(D_n >= d) of the one-sample two-sided test, exact at every n.

    The ordered sample is a Poisson process of rate n given n points. Its count must stay above t - nd and below t + nd;
    it can leave only where a bound passes a whole number, so the distribution of the count goes from one such time to the next.
    """
    if d <= 1 / (2 * n):
        return 1.0
    if d >= 1:
        return 0.0
    c = n * d
    least = [(m + c, 1, m + 1) for m in range(int(math.floor(n - c)) + 1)]         # from this time at least so many
    most = [(j - c, 0, j - 1) for j in range(int(math.ceil(c)), n + 1)]            # up to this time at most so many
    kernels: dict[float, np.ndarray] = {}
    low, at, now, ln = 0, np.ones(1), 0.0, 0.0
    for time, kind, bound in [*sorted(least + most), (float(n), 2, n)]:
        step = round(time - now, 12)
        if step > 0:
            if step not in kernels:
                k = np.arange(int(step + 12 * math.sqrt(step) + 25))
                kernels[step] = np.exp(k * math.log(step) - step - _ln_factorial(k))
            at = np.convolve(at, kernels[step])[:n - low + 1]
        if kind == 1 and bound > low:
            at, low = at[bound - low:], bound
        elif kind == 0:
            at = at[:max(0, bound - low + 1)]
        total = at.sum()
        if not total > 0:
            return 1.0
        at, ln, now = at / total, ln + math.log(total), time
    if not low <= n < low + len(at) or at[n - low] <= 0:
        return 1.0
    inside = ln + math.log(at[n - low]) + float(_ln_factorial(n)) + n - n * math.log(n)
    return min(1.0, max(0.0, -math.expm1(min(0.0, inside))))


def _beta_cdf(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - _beta_cdf(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1.0 / max(1 - (a + b) * x / (a + 1), 1e-300)
    f = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                    -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            f *= c * d
        if abs(c * d - 1) < 1e-16:
            break
    return front * f


def _beta_quantile(q: float, a: float, b: float) -> float:
    lo, hi = 0.0, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _beta_cdf(mid, a, b) < q else (lo, mid)
    return (lo + hi) / 2


def _rank_sum(u: float, n1: int, n2: int) -> float:
    """Two-sided Mann-Whitney p without ties: exact where a group has at most 8 rows, else the normal limit."""
    if min(n1, n2) <= 8:
        # the ways to each u up to the observed tail: a Gaussian binomial coefficient, factor by factor
        small, large, far = min(n1, n2), max(n1, n2), int(math.floor(min(u, n1 * n2 - u)))
        ways = np.zeros(far + 1)
        ways[0] = 1.0
        for i in range(1, small + 1):
            for r in range(min(i, far + 1)):
                ways[r::i] = np.cumsum(ways[r::i])
            if large + i <= far:
                ways[large + i:] -= ways[:far + 1 - large - i].copy()
        return min(1.0, 2 * float(ways.sum()) / math.comb(n1 + n2, small))
    z = (max(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) / math.sqrt(n1 * n2 * (n1 + n2 + 1) / 12)
    return min(1.0, math.erfc(z / math.sqrt(2)))


def _each(fn, *columns: pd.Series) -> pd.Series:
    """`fn` over rows; a row with a missing argument has no answer."""
    return pd.Series([None if any(pd.isna(v) for v in row) else fn(*row) for row in zip(*columns)], dtype="float64")


def _together(fn, *columns: pd.Series) -> pd.Series:
    """`fn` over whole columns at once; a row with a missing argument has no answer."""
    table = pd.concat([c.reset_index(drop=True) for c in columns], axis=1)
    out = pd.Series(np.nan, index=table.index)
    full = table.dropna()
    if len(full):
        out[full.index] = fn(*[full.iloc[:, i] for i in range(full.shape[1])])
    return out.astype(object).where(out.notna(), None).astype("Float64")


@F.pandas_udf(DoubleType())
def fisher_p(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    """Fisher's exact two-sided p of the table [[a, b], [c, d]]."""
    return _together(lambda *t: _fishers(*[x.to_numpy(np.int64) for x in t]), a, b, c, d)


@F.pandas_udf(DoubleType())
def binomial_p(k: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
    """The exact two-sided binomial p of k in n at rate p."""
    return _together(lambda k, n, p: _binomials(k.to_numpy(np.int64), n.to_numpy(np.int64), p.to_numpy(float)), k, n, p)


@F.pandas_udf(DoubleType())
def chi2_tail(x: pd.Series) -> pd.Series:
    """P(chi-square with one degree of freedom >= x)."""
    return _each(lambda v: math.erfc(math.sqrt(v / 2)), x)


@F.pandas_udf(DoubleType())
def kolmogorov_p(d: pd.Series, n: pd.Series) -> pd.Series:
    return _each(lambda d, n: _kolmogorov(float(d), int(n)), d, n)


@F.pandas_udf(DoubleType())
def rank_sum_p(u: pd.Series, n1: pd.Series, n2: pd.Series) -> pd.Series:
    return _each(lambda u, a, b: _rank_sum(float(u), int(a), int(b)), u, n1, n2)


@F.pandas_udf(DoubleType())
def beta_quantile(q: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
    return _each(lambda q, a, b: _beta_quantile(float(q), float(a), float(b)), q, a, b)


def jeffreys(accepted: Column, n: Column) -> Column:
    """The Jeffreys mean (k + 1/2) / (n + 1)."""
    return (accepted + F.lit(0.5)) / (n + F.lit(1.0))
