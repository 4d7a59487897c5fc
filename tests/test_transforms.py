"""Transforms over many tasks against numpy on the whole series."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from quietfield.functions import kernels as K
from quietfield.operators import spectral, transforms


def signal_of(spark, xs):
    rows = [(f"c{i}", t, float(v)) for i, x in enumerate(xs) for t, v in enumerate(x)]
    return spark.createDataFrame(rows, "channel string, t long, x double").repartition(3)


def values(df, n, channels=2, at="t"):
    out = np.zeros((channels, n), complex)
    for r in df.collect():
        out[int(r.channel[1:]), r[at]] = complex(r.re, r.im) if at == "bin" else r.x
    return out


def test_no_task_grows():
    for n in [*range(1, 400), 10**6, 10**7, 2 * 3**12]:
        for cell in (64, 1 << 16):
            shape = transforms.layout(n, cell)
            assert shape is None or (shape[0] * shape[1] == n and max(shape) <= cell)
    assert transforms.layout(10**7) == (3125, 3200) and transforms.layout(1_000_003) is None and transforms.layout(720, 64) == (24, 30)


@pytest.mark.parametrize(("n", "cell"), [(720, 64), (720, 1 << 16), (101, 64), (127, 32), (1, 64), (2, 64), (360, 20)])
def test_transform_and_back(spark, n, cell):
    x = np.random.default_rng(n).normal(size=(2, n))
    sig = signal_of(spark, x)
    z = transforms.spectrum(sig, n, cell)
    got = values(z, n, at="bin")[:, : n // 2 + 1]
    assert np.abs(got - np.fft.rfft(x)).max() < 1e-9
    assert np.abs(values(transforms.from_spectrum(z, n, cell), n).real - x).max() < 1e-10


@pytest.mark.parametrize(("n", "cell"), [(60, 12), (61, 16), (60, 100)])  # factors, none, one task
def test_complex_inverse(spark, n, cell):
    rng = np.random.default_rng(1)
    x = rng.normal(size=n) + 1j * rng.normal(size=n)
    rows = spark.createDataFrame([("c0", t, float(v.real), float(v.imag)) for t, v in enumerate(x) if t % 7], "channel string, t long, re double, im double")
    x[::7] = 0  # samples that are missing
    assert np.abs(values(transforms.transform(rows, n, inverse=True, cell=cell), n, 1, "bin")[0] - np.fft.ifft(x)).max() < 1e-12
    with pytest.raises(ValueError, match="too long"):
        transforms.transform(rows, 10**6 + 3, cell=cell)


def test_long_signal(spark):
    n = 200_000
    x = np.random.default_rng(3).normal(size=n)
    sig = spark.createDataFrame(pd.DataFrame({"channel": "c0", "t": np.arange(n), "x": x}))
    got = transforms.periodogram(sig, n, 250.0, cell=1 << 10).orderBy("freq").toPandas()
    want = 2 * np.abs(np.fft.rfft(x)[1 : n // 2]) ** 2 / (n * 250)
    assert len(got) == n // 2 - 1 and np.allclose(got["power"], want, rtol=1e-8) and np.allclose(got["freq"], np.arange(1, n // 2) * 250 / n)


@pytest.mark.parametrize(("n", "cell"), [(600, 30), (601, 64), (601, 1 << 16)])
@pytest.mark.parametrize(("half", "neighbours"), [(1.0, 2.0), (0.5, 6.0), (0.01, 1.0)])
def test_interpolated_lines(spark, n, cell, half, neighbours):
    """Lines whose neighbourhoods overlap, one beyond the range, one at the highest frequency."""
    rng = np.random.default_rng(n)
    x = rng.normal(size=(2, n)) + 3 * np.sin(2 * np.pi * 10 * np.arange(n) / 100)
    freqs = [20.0, 10.0, 12.5, 49.9, 70.0]
    got = values(transforms.interpolate_lines(signal_of(spark, x), n, 100.0, freqs, half, neighbours, cell), n).real
    assert np.abs(got - np.stack([K.interpolate_spectrum(v, 100.0, freqs, half, neighbours) for v in x])).max() < 1e-9


@pytest.mark.parametrize(("n", "cell"), [(300, 20), (301, 1 << 16), (211, 40), (1, 5)])
def test_cosine_mask(spark, n, cell):
    x = np.random.default_rng(n).normal(size=(2, n))
    for how in ({"fraction": 0.3}, {"mask": np.array([1.0, 0.2, 0.0, 0.7])}, {"mask": np.array([0.5])}):
        got = values(transforms.cosine_mask(signal_of(spark, x), n, cell=cell, **how), n).real
        assert np.abs(got - np.stack([K.dct_mask(v, how.get("fraction", 0.5), how.get("mask")) for v in x])).max() < 1e-9


def test_hybrid_notch(spark):
    rng = np.random.default_rng(5)
    n, rate, f0, width = 2000, 100.0, 20.0, 0.5
    x = rng.normal(size=(3, n))
    x[0] += 4 * np.sin(2 * np.pi * f0 * np.arange(n) / rate)
    x[1] = np.sin(2 * np.pi * 20.6 * np.arange(n) / rate) + 1e-3 * x[1]  # the notch takes most of what stands beside the line
    want, refused = x.copy(), []
    for v in want:
        y = K.sosfiltfilt(K.butter_sos(4, [f0 - width, f0 + width], "bandstop", rate), v)
        f, before = K.welch(v, rate, 400)
        ring = (np.abs(f - f0) <= 3) & (np.abs(f - f0) > width)
        refused.append(10 * np.log10(before[ring].mean() / K.welch(y, rate, 400)[1][ring].mean()) > 0.5)
        v[:] = v if refused[-1] else y
    assert refused == [False, True, False]
    got = values(spectral.hybrid_notch(signal_of(spark, x), rate, f0, width, 0.5), n, 3).real
    assert np.abs(got - want).max() < 1e-8
