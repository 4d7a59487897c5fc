"""Thresholds of chance against shifts made one by one."""

from __future__ import annotations

import numpy as np
import pytest

from quietfield.operators import references


def tables(spark, n, seed=3):
    rng = np.random.default_rng(seed)
    y = np.cumsum(rng.normal(size=(2, n)), 1) * 0.2 + rng.normal(size=(2, n))
    x = rng.normal(size=(3, n)) + rng.normal(size=(3, 2)) @ y * 0.5
    make = lambda v, name: spark.createDataFrame([(f"{name}{i}", t, float(z)) for i, r in enumerate(v) for t, z in enumerate(r)], "channel string, t long, x double").repartition(3)
    return x, y, make(x, "x"), make(y, "y")


def by_shifts(x, y, rounds, seed):
    """Canonical correlations by orthogonal bases, references rolled."""
    q = lambda v: np.linalg.qr((v - v.mean(1, keepdims=True)).T)[0]
    return np.array([np.linalg.svd(q(x).T @ q(np.roll(y, int(s), 1)))[1][0] ** 2 for s in references.null_shifts(x.shape[1], rounds, seed)])


@pytest.mark.parametrize("n", [400, 401, 30])
def test_one_window(spark, n):
    x, y, _, _ = tables(spark, n)
    assert np.allclose(references.null_correlations(x, y, 50, 7), by_shifts(x, y, 50, 7), atol=1e-9)
    assert references.null_threshold(x, y, 0.1, 50, 7) == pytest.approx(np.quantile(by_shifts(x, y, 50, 7), 0.9))


def test_shifts_stay_away_from_none():
    for n, low in ((100, 10), (1000, 100), (2, 1), (1, 1)):
        s = references.null_shifts(n, 300, 0)
        assert s.min() >= low and (s.max() < max(n - low, 2)) and len(s) == 300


def test_windows_have_their_own(spark):
    x, y, a, b = tables(spark, 230)
    got = references.null_thresholds(a, b, 10.0, 230, 6.0, 0.5, 0.2, 40, 1).orderBy("start").collect()
    assert [(r.start, r.stop) for r in got] == [(s, min(s + 60, 230)) for s in range(0, 230, 30)]
    for r in got:
        want = by_shifts(x[:, r.start : r.stop], y[:, r.start : r.stop], 40, 1)
        assert r.threshold == pytest.approx(np.quantile(want, 0.8)) and r.highest == pytest.approx(want.max())


def test_a_whole_recording(spark):
    x, y, a, b = tables(spark, 360)
    assert references.global_null_threshold(a, b, 360, 0.1, 30, 2) == pytest.approx(np.quantile(by_shifts(x, y, 30, 2), 0.9))


def test_cleaning_above_chance(spark):
    """What is common goes; references that have nothing in common with the signal take nothing but what chance does."""
    x, y, a, b = tables(spark, 600)
    clean = references.reference_clean(a, b, 10.0, 600, 60.0, null=0.05).toPandas().pivot(index="channel", columns="t", values="x").to_numpy()
    want, k = references.clean_window(x, y, references.null_threshold(x, y, 0.05))
    assert k > 0 and np.allclose(clean, want)
    other = np.random.default_rng(1).normal(size=(2, 600))
    _, none = references.clean_window(x, other, references.null_threshold(x, other, 0.01))
    assert none == 0
