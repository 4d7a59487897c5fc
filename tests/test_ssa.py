"""Groups of components by weighted correlation."""

from __future__ import annotations

import numpy as np

from quietfield.functions import linalg as L
from quietfield.operators import series


def long(spark, x):
    return spark.createDataFrame([(f"c{i:02d}", t, float(v)) for i, r in enumerate(x) for t, v in enumerate(r)], "channel string, t long, x double").repartition(3)


def test_weighted_correlations_are_those_of_trajectories(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4, 60)).cumsum(1)
    names, m = series.w_correlations(long(spark, x), 13, 60)
    rows = [np.lib.stride_tricks.sliding_window_view(v, 13).ravel() for v in x]  # every place in the trajectory matrix
    want = np.array([[a @ b / np.sqrt((a @ a) * (b @ b)) for b in rows] for a in rows])
    assert names == ["c00", "c01", "c02", "c03"] and np.allclose(m, want) and np.allclose(L.w_correlation(x, 13), want)


def test_groups():
    m = np.eye(5)
    m[0, 3] = m[3, 0] = -0.9
    m[3, 4] = m[4, 3] = 0.6
    m[1, 2] = m[2, 1] = 0.4
    assert series.alike(m, 0.5) == [0, 1, 2, 0, 0] and series.alike(m, 0.3) == [0, 1, 1, 0, 0] and series.alike(m, 0.95) == list(range(5))


def test_two_waves_are_two_groups(spark):
    t = np.arange(600)
    x = 3 * np.sin(2 * np.pi * t / 20) + np.sin(2 * np.pi * t / 7.3)
    got = series.ssa_groups(long(spark, x[None]), 20.0, 600, 60, 0.5, stretch=300).orderBy("stretch", "component").toPandas()
    for _, f in got.groupby("stretch"):
        f = f[f["share"] > 1e-3]
        together = f["together"].tolist()
        assert len(f) == 4 and together[0] == together[1] and together[2] == together[3] and together[0] != together[2]
    assert sorted(got["stretch"].unique()) == [0, 1]
