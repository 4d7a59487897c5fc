"""Filters over short blocks against one pass over the whole series."""

from __future__ import annotations

import numpy as np
import pytest

from quietfield.functions import kernels as K
from quietfield.operators import filters, spectral
from quietfield.operators.filters import Cascade

SLOW = ((1.0, -0.5, 0.2), tuple(np.real(np.poly([0.99999, 0.9995 * np.exp(0.3j), 0.9995 * np.exp(-0.3j)]))))
CASES = {
    "slow": Cascade.of(SLOW),
    "plain": Cascade.of(((0.5,), (1.0,))),
    "shaping": Cascade.of(K.shaping_filter(250.0)),
    "sections": Cascade.of_sos(K.butter_sos(4, [0.05, 0.4], "bandpass", 100.0)),
    "mixed": Cascade.of(SLOW, ((1.0, 1.0), (2.0, -1.0))),
}


def series(n, channels=2):
    x = np.random.default_rng(n).normal(size=(channels, n)) + np.linspace(0, 5, n)
    return x, [(f"c{i}", t, float(v)) for i, r in enumerate(x) for t, v in enumerate(r)]


def wide(df, n, channels=2):
    out = np.full((channels, n), np.nan)
    for r in df.collect():
        out[int(r.channel[1:]), r.t] = r.x
    return out


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize(("n", "block"), [(1050, 100), (1050, 7), (40, 100)])
def test_scan_is_one_pass(spark, name, n, block):
    x, rows = series(n)
    sig = spark.createDataFrame(rows, "channel string, t long, x double").repartition(3)
    want = CASES[name].run(x)[0]
    assert np.abs(wide(filters.scan(sig, CASES[name], block=block), n) - want).max() < 1e-10 * max(1, np.abs(want).max())


def test_step_and_steady_state():
    for c in CASES.values():
        m = sum(c.sizes())
        s = np.random.default_rng(0).normal(size=m)
        assert np.allclose(c.run(np.zeros(50), s)[1], np.linalg.matrix_power(c.step(), 50) @ s)
        y, after = c.run(np.ones(20), c.steady())
        assert np.allclose(y, y[0]) and np.allclose(after, c.steady(), rtol=1e-6)


@pytest.mark.parametrize("name", ["slow", "shaping", "sections"])
@pytest.mark.parametrize(("n", "block"), [(900, 100), (11, 4)])
def test_both_ways(spark, name, n, block):
    x, rows = series(n)
    c = CASES[name]
    sos = np.array([[*b, *a] for b, a in c.sections]) if len(c.sections) > 1 else None
    want = np.stack([K.sosfiltfilt(sos, v) if sos is not None else K.filtfilt(*map(np.array, c.sections[0]), v) for v in x])
    got = wide(filters.both_ways(spark.createDataFrame(rows, "channel string, t long, x double"), c, n, block), n)
    assert np.abs(got - want).max() < 1e-8 * max(1, np.abs(want).max())


def test_filters_give_the_same_in_short_blocks(spark):
    """Blocks below the filters' memory are scanned, longer ones have margins."""
    n = 1500
    x, rows = series(n)
    sig = spark.createDataFrame(rows, "channel string, t long, x double").repartition(3).persist()
    for f in (lambda b: spectral.bandpass(sig, 100.0, 3.0, 9.0, block=b), lambda b: spectral.notch(sig, 100.0, 20.0, block=b), lambda b: spectral.peak(sig, 100.0, 10.0, block=b), lambda b: spectral.comb(sig, 100.0, 10.0, block=b)):
        assert np.abs(wide(f(120), n) - wide(f(1 << 18), n)).max() < 1e-9
