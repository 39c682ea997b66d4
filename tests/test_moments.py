"""Sliding moments against exact arithmetic."""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pandas as pd
import pytest

from candlewick.operators import correlation, zscore
from candlewick.operators.moments import sliding


def frame(spark, columns, n):
    rows = [("s", (pd.Timestamp("2024-01-01") + pd.Timedelta(minutes=i)).to_pydatetime(), *[None if c[i] is None else float(c[i]) for c in columns.values()]) for i in range(n)]
    return spark.createDataFrame(rows, "symbol string, start_time timestamp_ntz, " + ", ".join(f"{c} double" for c in columns))


def exact(x, y, i, steps):
    both = [(Fraction(x[k]), Fraction(y[k])) for k in range(max(0, i - steps + 1), i + 1) if x[k] is not None and y[k] is not None]
    n = len(both)
    if not n:
        return 0, None, None, None, None
    mx, my = sum(a for a, _ in both) / n, sum(b for _, b in both) / n
    return n, float(mx), float(sum((a - mx) ** 2 for a, _ in both) / n), float(sum((b - my) ** 2 for _, b in both) / n), float(sum((a - mx) * (b - my) for a, b in both) / n)


@pytest.mark.parametrize("steps", [1, 2, 7, 50, 500])
def test_sliding_moments_are_exact(spark, steps):
    """Mean 1e9 and deviation 1e-3, with gaps, a stretch without values, a jump, and values that are all the same."""
    rng, n = np.random.default_rng(steps), 160
    x = [None if rng.random() < 0.2 or 60 <= i < 75 else 1e9 + 1e-3 * rng.normal() for i in range(n)]
    y = [None if rng.random() < 0.1 else 5.0 if 90 <= i < 120 else 1e6 * (i > 140) + rng.normal() for i in range(n)]
    got = sliding(frame(spark, {"x": x, "y": y}, n), ["symbol"], steps, ["x", "y"]).orderBy("start_time").collect()
    assert len(got) == n
    for i, r in enumerate(got):
        k, mean, var_x, var_y, covar = exact(x, y, i, steps)
        assert r.n == k
        if k:
            assert abs(r.mean_x + r.shift_x - mean) <= 1e-6
            for found, want, scale in ((r.var_x, var_x, 1e-6), (r.var_y, var_y, max(var_y, 1)), (r.covar, covar, (var_x * var_y) ** 0.5)):
                assert abs(found - want) <= 1e-9 * scale + 1e-18, (i, found, want)


def test_rolling_frames_follow(spark):
    """z-scores and correlations of long frames; nothing of an outlier is left once it has gone."""
    rng, n, steps = np.random.default_rng(3), 900, 300
    x = [1e12 if i == 100 else 1e9 + 1e-3 * rng.normal() for i in range(n)]
    y = [1e9 - 1e-3 * rng.normal() for _ in range(n)]
    z = zscore.rolling(frame(spark, {"value": x}, n), steps).orderBy("start_time").collect()
    two = frame(spark, {"value": x}, n).unionByName(frame(spark, {"value": y}, n).replace("s", "t"))
    c = correlation.rolling(two, steps).orderBy("start_time").collect()
    for i in (50, 399, 400, 401, 599, 899):
        a, b = (np.array([Fraction(v) - Fraction(10**9) for v in w[max(0, i - steps + 1) : i + 1]]).astype(float) for w in (x, y))
        want = (a[-1] - a.mean()) / a.std() if a.var() > 1e-9 else 0.0
        assert abs(z[i].z - want) < 1e-6 and z[i].n == len(a)
        assert abs(c[i].correlation - np.corrcoef(a, b)[0, 1]) < 1e-9
