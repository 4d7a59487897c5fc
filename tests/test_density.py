"""Density clusters against a clustering by all pairs."""

from __future__ import annotations

import numpy as np
import pytest

from quietfield.operators import asr, density


def by_hand(x, eps, least):
    near = np.abs(x[:, None] - x[None]).max(2) <= eps
    core = near.sum(1) >= least
    label = np.full(len(x), -1)
    for i in np.flatnonzero(core):
        if label[i] < 0:
            todo = [i]
            label[i] = i
            while todo:
                for j in np.flatnonzero(near[todo.pop()] & core & (label < 0)):
                    label[j] = i
                    todo.append(j)
    for i in np.flatnonzero(~core):
        own = label[near[i] & core]
        label[i] = own.min() if len(own) else -1
    return label, core


def cloud(n, dims, seed):
    """Two dense lumps joined by a thin bridge, a curve, a thin haze, copies and samples on the borders of cells."""
    rng = np.random.default_rng(seed)
    k = n // 5
    lump = rng.normal(0, 0.25, (2 * k, dims)) + np.where(rng.random((2 * k, 1)) < 0.5, 0, 2.2)
    bridge = np.linspace(0, 2.2, k // 4)[:, None] + rng.normal(0, 0.02, (k // 4, dims))
    curve = np.column_stack([5 + np.sin(np.linspace(0, 5, k)), *[np.linspace(-3, 3, k)] * (dims - 1)]) if dims > 1 else np.linspace(5, 7, k)[:, None]
    grid = rng.integers(-12, 12, (k, dims)) / 4
    haze = rng.uniform(-6, 8, (n - 4 * k - k // 4 - 40, dims))
    return np.concatenate([lump, bridge, curve, grid, haze, np.full((40, dims), -5.0)])[rng.permutation(n)]


@pytest.mark.parametrize(("dims", "eps", "least", "most"), [(2, 0.25, 12, 512), (2, 0.25, 12, 7), (3, 0.5, 25, 50), (1, 0.01, 4, 20), (2, 40.0, 10, 100), (2, 1e-6, 2, 100), (3, 0.3, 5000, 100)])
def test_clusters(spark, dims, eps, least, most):
    x = cloud(2000 if dims > 1 else 600, dims, dims)
    label, core = by_hand(x, eps, least)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "t long, f array<double>").repartition(4)
    got = {r.t: (-1 if r.cluster is None else r.cluster, r.core) for r in density.clusters(table, eps, least, dims, most).collect()}
    assert got == {i: (label[i], core[i]) for i in range(len(x))}


def test_no_samples(spark):
    assert density.clusters(spark.createDataFrame([], "t long, f array<double>"), 1.0, 3, 2).collect() == []
    with pytest.raises(ValueError, match="radius"):
        density.clusters(spark.createDataFrame([], "t long, f array<double>"), 0.0, 3, 2)


def test_reference_samples_leave_bursts_out(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(6, 900))
    x[:, 300:360] *= 30
    signal = spark.createDataFrame([(f"c{i}", t, float(v)) for i, r in enumerate(x) for t, v in enumerate(r)], "channel string, t long, x double")
    got = {r.t: r for r in asr.reference_samples(signal, 3, eps=0.8, least=20).collect()}
    f = np.sort(np.abs(x), 0)[::-1][:3].T
    label, core = by_hand(f, 0.8, 20)
    names = sorted(set(label[label >= 0]), key=lambda c: (np.median(f[label == c, 0]), -(label == c).sum(), c))
    assert [got[t].kept for t in range(900)] == (label == names[0]).tolist() and [got[t].core for t in range(900)] == core.tolist()
    assert not any(got[t].kept for t in range(300, 360) if f[t, 0] > 10)
    usual = asr.reference_samples(signal)
    assert usual.columns == ["t", "cluster", "core", "kept"] and usual.count() == 900
