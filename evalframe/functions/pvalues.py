"""Tail probabilities for the paired tests (T3, T6), on whole columns.

Spark SQL has no Student t, normal tail or signed-rank distribution, and
SciPy is not assumed.  These NumPy functions run inside Arrow-batched pandas
UDFs on the *aggregated* table (one row per test).

Both tails are integrals of their densities from the statistic to infinity,
taken by exp-sinh quadrature: with y = s exp(pi/2 sinh u) the integrand dies
off doubly exponentially at both ends whatever the density's own tail (power
law for few degrees of freedom, Gaussian for many), so equal steps in u give
nearly full precision, and the relative one, as nothing is subtracted from 1.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

_STEP = 0.04
_U = np.arange(-5.0, 5.0 + _STEP / 2, _STEP)
_NODES = np.exp(np.pi / 2 * np.sinh(_U))
_WEIGHTS = _STEP * np.pi / 2 * np.cosh(_U) * _NODES
_ROWS = 2048          # rows whose nodes are held at once


def _tail(log_decay, scale: np.ndarray) -> np.ndarray:
    """Integral over y > 0 of exp(log_decay(y)); ``scale`` is about the width of the decay."""
    y = scale[:, None] * _NODES
    with np.errstate(over="ignore", under="ignore", invalid="ignore"):
        value = np.exp(log_decay(y))
    return scale * (np.nan_to_num(value) * _WEIGHTS).sum(1)


def _half_step_ratio(a: np.ndarray) -> np.ndarray:
    """Gamma(a + 1/2) / Gamma(a): the asymptotic series far out, brought back by the recurrence."""
    shift = 50
    b = a + shift
    series = 1 + (-1 / 8 + (1 / 128 + (5 / 1024 + (-21 / 32768 + (-399 / 262144 + 869 / 4194304 / b) / b) / b) / b) / b) / b
    out = np.sqrt(b) * series
    for j in range(shift):
        out = out * ((a + j) / (a + j + 0.5))
    return out


def _in_blocks(fn, *columns: np.ndarray) -> np.ndarray:
    n = len(columns[0])
    parts = [fn(*[c[at:at + _ROWS] for c in columns]) for at in range(0, n, _ROWS)]
    return np.concatenate(parts) if parts else np.empty(0)


def t_two_sided_p(t, df) -> np.ndarray:
    """Two-sided p-values of Student's t; NaN for missing or infinite t and df <= 0."""
    t, df = np.broadcast_arrays(np.abs(np.asarray(t, float)), np.asarray(df, float))
    out = np.full(t.shape, np.nan)
    ok = np.isfinite(t) & np.isfinite(df) & (df > 0)

    def block(t, df):
        half = (df + 1) / 2
        at_t = np.exp(-half * np.log1p(t * t / df)) * _half_step_ratio(df / 2) / np.sqrt(np.pi * df)
        spread = df + t * t
        scale = spread / half / (t + np.sqrt(t * t + spread / half))     # where the exponent is about 1
        return 2 * at_t * _tail(lambda y: -half[:, None] * np.log1p(y * (2 * t[:, None] + y) / spread[:, None]), scale)

    out[ok] = np.minimum(_in_blocks(block, t[ok], df[ok]), 1.0)
    return out


def normal_two_sided_p(z) -> np.ndarray:
    """Two-sided p-values of standard normal statistics."""
    z = np.abs(np.atleast_1d(np.asarray(z, float)))
    out = np.full(z.shape, np.nan)
    ok = np.isfinite(z)

    def block(z):
        return 2 / np.sqrt(2 * np.pi) * np.exp(-z * z / 2) * _tail(lambda y: -y * (z[:, None] + y / 2), 1 / (1 + z))

    out[ok] = np.minimum(_in_blocks(block, z[ok]), 1.0)
    return out


@lru_cache(maxsize=4096)
def _below_share(ranks2: tuple) -> np.ndarray:
    """Share of the sign assignments with a rank sum of at most 0, 1, 2, ... (doubled ranks):
    the product of the polynomials 1 + x^r, one convolution for each rank."""
    counts = np.ones(1)
    for r in ranks2:
        factor = np.zeros(r + 1)
        factor[0], factor[r] = 1.0, factor[r] + 1.0
        counts = np.convolve(counts, factor)
    return np.cumsum(counts) / 2.0 ** len(ranks2)


def signed_rank_exact_p(ranks2, w2) -> np.ndarray:
    """Exact two-sided p of the signed-rank statistic, min(1, 2 P(W+ <= W)), for tests that
    share the (integer) doubled ranks ``ranks2`` of their non-zero differences; ``w2`` is
    twice each test's min(W+, W-)."""
    share = _below_share(tuple(int(r) for r in ranks2 if r > 0))
    at = np.minimum(np.asarray(w2, np.int64), len(share) - 1)
    return np.minimum(1.0, 2.0 * share[at])


def wilcoxon_p(m, w2, tie_term, exact, ranks2) -> np.ndarray:
    """T6 on columns: exact tests by their rank sets, the others by the normal approximation
    without continuity correction, variance m(m+1)(2m+1)/24 - sum(t^3 - t)/48.  NaN for fewer
    than two non-zero differences."""
    m, w2 = np.asarray(m, float), np.asarray(w2, float)
    tie_term, exact = np.nan_to_num(np.asarray(tie_term, float)), np.asarray(exact, bool)
    out = np.full(len(m), np.nan)
    usable = np.isfinite(m) & np.isfinite(w2) & (m >= 2)
    var = m * (m + 1) * (2 * m + 1) / 24.0 - tie_term / 48.0
    normal = usable & ~exact & (var > 0)
    out[normal] = normal_two_sided_p((w2[normal] / 2.0 - m[normal] * (m[normal] + 1) / 4.0) / np.sqrt(var[normal]))
    sets: dict[tuple, list[int]] = {}
    for i in np.flatnonzero(usable & exact):
        sets.setdefault(tuple(sorted(int(r) for r in ranks2[i])), []).append(i)
    for ranks, at in sets.items():
        out[at] = signed_rank_exact_p(ranks, w2[at])
    return out


@pandas_udf(DoubleType())
def t_pvalue_udf(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(t_two_sided_p(t.to_numpy(float, na_value=np.nan), df.to_numpy(float, na_value=np.nan)))


@pandas_udf(DoubleType())
def wilcoxon_p_udf(m: pd.Series, w2: pd.Series, tie_term: pd.Series, exact: pd.Series,
                   ranks2: pd.Series) -> pd.Series:
    number = lambda s: s.to_numpy(float, na_value=np.nan)
    return pd.Series(wilcoxon_p(number(m), number(w2), number(tie_term), exact.fillna(False).to_numpy(bool), ranks2.to_numpy()))
