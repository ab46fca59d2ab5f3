"""Tails against closed forms, against each other, and against plain enumeration."""

import itertools
import math

import numpy as np
import pytest

from evalframe.functions import pvalues as P

T = np.array([0.0, 1e-9, 0.01, 0.3, 1.0, 2.5, 7.0, 40.0, 1e3, 1e8])


@pytest.mark.parametrize("df,closed", [
    (1, lambda t: 2 / math.pi * math.atan2(1, t)),
    (2, lambda t: 2 / (math.sqrt(t * t + 2) * (math.sqrt(t * t + 2) + t))),
    (3, lambda t: 1 - 2 / math.pi * (math.atan(t / math.sqrt(3)) + t / math.sqrt(3) / (1 + t * t / 3)) if t < 100 else None),
])
def test_t_against_closed_forms(df, closed):
    got = P.t_two_sided_p(T, df)
    for t, p in zip(T, got):
        want = closed(t)
        if want is not None:
            assert p == pytest.approx(want, rel=1e-12 if df < 3 else 1e-9, abs=1e-300)


@pytest.mark.parametrize("df", [30, 1000, 1e6, 1e10])
def test_t_against_a_fine_sum(df):
    for t in (0.2, 1.5, 4.0):
        # Simpson's rule on a long fine grid, normalised by the whole
        f = lambda x: np.exp(-(df + 1) / 2 * np.log1p(x * x / df))
        simpson = lambda x: (x[1] - x[0]) / 3 * (f(x)[0] + f(x)[-1] + 4 * f(x)[1:-1:2].sum() + 2 * f(x)[2:-1:2].sum())
        tail, head = simpson(np.linspace(t, 60 + t, 400_001)), simpson(np.linspace(0, t, 20_001))
        assert P.t_two_sided_p([t], df)[0] == pytest.approx(tail / (tail + head), rel=1e-10)


def test_t_becomes_normal_and_keeps_small_tails():
    z = np.array([0.0, 0.1, 1.0, 3.0, 8.0, 20.0, 37.0])
    want = np.array([math.erfc(x / math.sqrt(2)) for x in z])
    assert P.normal_two_sided_p(z) == pytest.approx(want, rel=1e-12)
    assert P.t_two_sided_p(z[:5], 1e10) == pytest.approx(want[:5], rel=1e-6)
    assert np.isnan(P.t_two_sided_p([np.nan, np.inf, 1.0, 1.0], [3, 3, 0, -1])).all()
    assert P.t_two_sided_p([0.0], [7])[0] == pytest.approx(1.0, rel=1e-13) and P.t_two_sided_p([], []).size == 0
    assert len(P.t_two_sided_p(np.ones(5000), 9)) == 5000


@pytest.mark.parametrize("ranks2", [(2, 4, 6, 8), (3, 3, 6, 8), (2,), tuple(range(2, 24, 2)), (5, 5, 5, 5, 5)])
def test_exact_signed_ranks_against_enumeration(ranks2):
    sums = [sum(s) for s in itertools.product(*[(0, r) for r in ranks2])]
    w2 = np.arange(0, sum(ranks2) + 1)
    want = [min(1.0, 2 * sum(x <= w for x in sums) / len(sums)) for w in w2]
    assert P.signed_rank_exact_p(ranks2, w2) == pytest.approx(want, rel=1e-15)


def test_wilcoxon_mixes_branches_and_missing():
    got = P.wilcoxon_p([4, 60, np.nan, 1, 4], [2, 900, 1, 1, 2], [0, 12, 0, 0, 0], [True, False, True, True, True],
                       [[2, 4, 6, 8], None, None, [2], [2, 4, 6, 8]])
    assert got[0] == got[4] == pytest.approx(4 / 16) and 0 < got[1] < 1 and np.isnan(got[[2, 3]]).all()
