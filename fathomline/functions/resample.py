"""Resampling by counts: how often each cell is drawn, not which rows.

Rows that are alike are one cell with a count. A resample of n rows is then a multinomial count over the cells, drawn as a chain of
binomials: the first cell's share of n, the next one's share of what is left, and so on. A binomial is the inverse of its
distribution function at one uniform number, summed within ten standard deviations of the mean (all that lies beyond is below
1e-20). The work is cells x replicates, whatever the number of rows. Uniform numbers are hashes of (seed, group, cell, replicate).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from .stats import _ln_factorial

SPREAD = 10.0
SIZES, STEPS = 8, 4_096         # more sizes than these, and up to this spread: replicates step together
_COUNTS = ArrayType(LongType())
_pair = lambda a, b, kind: StructType([StructField(a, kind), StructField(b, kind)])                       # noqa: E731
_STEP, _ROUNDS = np.uint64(0x9E3779B97F4A7C15), ((np.uint64(30), np.uint64(0xBF58476D1CE4E5B9)), (np.uint64(27), np.uint64(0x94D049BB133111EB)))


def _mixed(x: np.ndarray) -> np.ndarray:
    for shift, factor in _ROUNDS:
        x = (x ^ x >> shift) * factor
    return x ^ x >> np.uint64(31)


def uniforms(seed: int, group: int, cell: np.ndarray, n: int, first: int = 0) -> np.ndarray:
    """A number in [0, 1) for every cell (a row of 64-bit keys) and each of `n` replicates from `first`."""
    with np.errstate(over="ignore"):
        start = _mixed(_mixed(np.array([group & (2**64 - 1)], dtype=np.uint64) + np.uint64(seed)) + cell.astype(np.uint64) * _STEP)
        x = _mixed(_mixed(start)[:, None] + np.arange(first + 1, first + n + 1, dtype=np.uint64)[None, :] * _STEP)
    return (x >> np.uint64(11)).astype(float) / 2.0 ** 53


def _stepped(u: np.ndarray, n: np.ndarray, p: float) -> np.ndarray:
    """`binomials` of many sizes and a narrow spread: all step up from ten standard deviations below, each to its quantile."""
    reach = SPREAD * np.sqrt(n * p * (1 - p)) + 2 * SPREAD
    k = np.maximum(0, (n * p - reach).astype(np.int64))
    last = np.minimum(n, (n * p + reach).astype(np.int64) + 1)
    pmf = np.exp(_ln_factorial(n) - _ln_factorial(k) - _ln_factorial(n - k) + k * np.log(p) + (n - k) * np.log1p(-p))
    out, at, odds = k.copy(), np.arange(len(n)), p / (1 - p)
    cdf = pmf.copy()
    while len(at):
        on = (cdf <= u[at]) & (k < last)
        out[at] = k
        at, k, cdf, pmf, last = at[on], k[on], cdf[on], pmf[on], last[on]
        pmf = pmf * ((n[at] - k) / (k + 1.0) * odds)
        cdf, k = cdf + pmf, k + 1
    return out


def binomials(u: np.ndarray, n: np.ndarray, p: float) -> np.ndarray:
    """The binomial(n, p) count at each quantile u; u and n are of one length."""
    n = np.asarray(n, dtype=np.int64)
    if p <= 0 or p >= 1:
        return n * int(p >= 1)
    sizes = np.unique(n)
    if len(sizes) > SIZES and SPREAD * np.sqrt(sizes[-1] * p * (1 - p)) <= STEPS:
        return _stepped(u, n, p)
    out = np.zeros(len(n), dtype=np.int64)
    for size in sizes:
        reach = SPREAD * np.sqrt(size * p * (1 - p)) + 2 * SPREAD
        k = np.arange(max(0, int(size * p - reach)), min(int(size), int(size * p + reach) + 1) + 1)
        ln = _ln_factorial(size) - _ln_factorial(k) - _ln_factorial(size - k) + k * np.log(p) + (size - k) * np.log1p(-p)
        at = n == size
        out[at] = k[np.minimum(np.searchsorted(np.cumsum(np.exp(ln)), u[at], side="right"), len(k) - 1)]
    return out


def multinomials(u: np.ndarray, n: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Per cell (row) and replicate (column): how many of n draws fall on the cell, cells being drawn in proportion to `counts`."""
    out = np.zeros(u.shape, dtype=np.int64)
    left, mass = np.array(n, dtype=np.int64), int(counts.sum())
    for j, c in enumerate(counts):
        out[j] = binomials(u[j], left, c / mass) if c < mass else left
        left, mass = left - out[j], mass - int(c)
    return out


@F.pandas_udf(_COUNTS)
def binomial_counts(u: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
    """The binomial(n, p) counts at an array of quantiles."""
    return pd.Series([binomials(np.asarray(x), np.full(len(x), k), q) for x, k, q in zip(u, n, p)])


@F.pandas_udf(_COUNTS)
def multinomial_totals(seed: pd.Series, group: pd.Series, first: pd.Series, replicates: pd.Series, counts: pd.Series) -> pd.Series:
    """The draws of each cell in each of so many replicates from `first`, cell after cell in one array; as many draws as the counts
    add up to."""
    def one(s, g, f, r, c):
        c = np.asarray(c, dtype=np.int64)
        return multinomials(uniforms(s, g, np.arange(len(c)), r, f), np.full(r, c.sum()), c).ravel()
    return pd.Series([one(*x) for x in zip(seed, group, first, replicates, counts)])


@F.pandas_udf(_pair("wy", "w", ArrayType(DoubleType())))
def weighted_totals(seed: pd.Series, group: pd.Series, draws: pd.Series, counts: pd.Series, wy: pd.Series, w: pd.Series) -> pd.DataFrame:
    """Per replicate, the sums of two cell values over the cells drawn; `draws` says how many fall on these cells in all."""
    out: tuple[list, list] = ([], [])
    for s, g, n, c, a, b in zip(seed, group, draws, counts, wy, w):
        c = np.asarray(c, dtype=np.int64)
        got = multinomials(uniforms(s, g, np.arange(len(c)), len(n)), np.asarray(n), c)
        for to, value in zip(out, (a, b)):
            to.append(np.asarray(value, dtype=float) @ got)
    return pd.DataFrame({"wy": out[0], "w": out[1]})


@F.pandas_udf(_pair("lo", "hi", DoubleType()))
def kappa_limits(seed: pd.Series, group: pd.Series, replicates: pd.Series, a: pd.Series, b: pd.Series, counts: pd.Series) -> pd.DataFrame:
    """The 2.5 and 97.5 per cent points of Cohen's kappa over resampled confusion counts."""
    lo, hi = [], []
    for s, g, r, x, y, c in zip(seed, group, replicates, a, b, counts):
        x, y, c = np.asarray(x), np.asarray(y), np.asarray(c, dtype=np.int64)
        n = float(c.sum())
        got = multinomials(uniforms(s, g, np.arange(len(c)), r), np.full(r, c.sum()), c)
        agree = got[x == y].sum(axis=0) / n
        chance = sum(got[x == k].sum(axis=0) * got[y == k].sum(axis=0) for k in np.union1d(x, y)) / (n * n)
        kappa = np.where(chance >= 1, 1.0, (agree - chance) / np.where(chance >= 1, 1.0, 1 - chance))
        lo.append(np.quantile(kappa, 0.025))
        hi.append(np.quantile(kappa, 0.975))
    return pd.DataFrame({"lo": lo, "hi": hi})
