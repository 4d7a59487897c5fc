"""Fits for each stretch in one pass against fits of each stretch by itself."""

from __future__ import annotations

import numpy as np
import pytest

from quietfield.functions import linalg as L
from quietfield.operators import dss, references, segments, spans, windows


def recording(spark, n, c=4, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(c, c)) @ np.cumsum(rng.normal(size=(c, n)), 1) * 0.1 + rng.normal(size=(c, n)) + np.arange(c)[:, None]
    return x, spark.createDataFrame([(f"c{i}", t, float(v)) for i, r in enumerate(x) for t, v in enumerate(r)], "channel string, t long, x double").repartition(3)


def wide(df, shape):
    out = np.full(shape, np.nan)
    for r in df.collect():
        assert np.isnan(out[int(r.channel[1:]), r.t])
        out[int(r.channel[1:]), r.t] = r.x
    return out


def faded(n, parts):
    """parts: (lo, hi, own lo, own hi, data)."""
    total, weight = 0.0, np.zeros(n)
    for lo, hi, a, b, data in parts:
        w = np.ones(hi - lo)
        if a > lo:
            e = 2 * (a - lo)
            w[:e] = np.minimum(w[:e], (1 - np.cos(np.pi * np.arange(1, e + 1) / e)) / 2)
        if hi > b:
            e = 2 * (hi - b)
            w[-e:] = np.minimum(w[-e:], ((1 - np.cos(np.pi * np.arange(1, e + 1) / e)) / 2)[::-1])
        full = np.zeros((len(data), n))
        full[:, lo:hi] = w * data
        total, weight = total + full, weight + np.pad(w, (lo, n - hi))
    return total / weight


@pytest.mark.parametrize(("n", "size", "hop"), [(100, 30, 20), (100, 30, 30), (95, 30, 10), (30, 30, 7), (20, 30, 5), (101, 10, 9)])
def test_blocks(spark, n, size, hop):
    got = [tuple(r)[1:] for r in segments.blocks(spark, n, size, hop).orderBy("k").collect()]
    assert got == spans.block_bounds(n, size, hop)


def by_hand(x, bounds, lag, keep):
    parts, rs = [], []
    for lo, hi, a, b in bounds:
        part = x[:, lo:hi]
        now, past = part[:, lag:], part[:, :-lag]
        nc, pc = now - now.mean(1, keepdims=True), past - past.mean(1, keepdims=True)
        qx, rx = np.linalg.qr(nc.T)
        qy, _ = np.linalg.qr(pc.T)
        u, r, _ = np.linalg.svd(qx.T @ qy)  # canonical variates by orthogonal bases
        f = np.linalg.solve(rx, u).T
        mean = part.mean(1, keepdims=True)
        z = f @ (part - mean)
        mixing = (part - mean) @ np.linalg.pinv(z)
        k = keep(r)
        parts.append((lo, hi, a, b, mixing[:, k] @ z[k] + mean))
        rs.append(r)
    return parts, rs


@pytest.mark.parametrize(("n", "size", "hop"), [(430, 120, 80), (430, 120, 120), (430, 500, 100)])  # a ragged tail, no overlap, one block
@pytest.mark.parametrize("rule", ["count", "threshold", "squared", "high"])
def test_blocks_of_delayed_correlation(spark, n, size, hop, rule):
    x, sig = recording(spark, n)
    how, keep = {
        "count": ({"remove": 2}, lambda r: np.arange(4) < 2), "threshold": ({"threshold": 0.5}, lambda r: r >= 0.5),
        "squared": ({"threshold": 0.5, "squared": True}, lambda r: r**2 >= 0.5), "high": ({"remove": 1, "low": False}, lambda r: np.arange(4) >= 1),
    }[rule]
    parts, rs = by_hand(x, spans.block_bounds(n, size, hop), 2, keep)
    clean, about = references.delayed_cca_blocks(sig, n, size, hop, 2, **how)
    assert np.abs(wide(clean, x.shape) - faded(n, parts)).max() < 1e-8
    rows = about.orderBy("k", "component").collect()
    assert np.allclose([r.r for r in rows], np.concatenate(rs)) and [r.kept for r in rows] == np.concatenate([keep(r) for r in rs]).tolist()
    assert all(abs(r.autocorrelation) <= r.r + 1e-9 and 0 <= r.asymmetry <= 2**0.5 + 1e-9 for r in rows)


def test_one_block_is_the_global_fit(spark):
    x, sig = recording(spark, 300)
    clean, _ = references.delayed_cca_blocks(sig, 300, 300, 300, 1, remove=2)
    model, gone = references.delayed_cca(sig, 1, remove=2)
    want = wide(model.keep(sig, [k for k in range(4) if k not in gone]), x.shape)
    assert np.abs(wide(clean, x.shape) - want - x.mean(1, keepdims=True)).max() < 1e-8 or np.abs(wide(clean, x.shape) - want).max() < 1e-8


def test_refused(spark):
    _, sig = recording(spark, 60)
    for how in ({}, {"remove": 1, "threshold": 0.5}, {"remove": 5}):
        with pytest.raises(ValueError):
            references.delayed_cca_blocks(sig, 60, 30, 30, 1, **how)
    with pytest.raises(ValueError, match="too few"):
        references.delayed_cca_blocks(sig, 60, 6, 6, 2, remove=1)


@pytest.mark.parametrize(("n", "length", "ramp"), [(400, 100, 10), (360, 100, 0), (90, 100, 10)])
def test_segment_fits(spark, n, length, ramp):
    x, sig = recording(spark, n, seed=3)
    parts = []
    for a, b in spans.fixed_segments(n, length):
        lo, hi = max(a - ramp, 0), min(b + ramp, n)
        part = x[:, lo:hi]
        biased = np.stack([[v[max(0, t - 4) : t + 1].mean() for t in range(len(v))] for v in part])
        scale = np.linalg.norm(part, axis=1)
        f, p, _ = L.dss(np.cov(part / scale[:, None], bias=True), np.cov(biased / scale[:, None], bias=True))
        f, p = f / scale, p * scale[:, None]
        parts.append((lo, hi, a, b, part - p[:, :1] @ f[:1] @ part))
    got = wide(dss.segmented(sig, n, length, ramp, lambda s: windows.running_mean(s, 5), 1), x.shape)
    assert np.abs(got - faded(n, parts)).max() < 1e-8


def test_scans_do_not_grow_with_segments(spark):
    _, sig = recording(spark, 400)
    plans = [dss.segmented(sig, 400, length, 5, lambda s: windows.running_mean(s, 5), 1)._jdf.queryExecution().optimizedPlan().toString() for length in (200, 20)]
    assert plans[0].count("LogicalRDD") == plans[1].count("LogicalRDD")
