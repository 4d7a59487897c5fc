"""Numerical kernels against definitions."""

from __future__ import annotations

import math

import numpy as np
import pytest

from quietfield.functions import kernels as K
from quietfield.functions import linalg as L
from quietfield.operators import asr, lines, references, spans, windows

RNG = np.random.default_rng(0)


def direct_filter(b, a, x):
    y = np.zeros(len(x))
    for t in range(len(x)):
        y[t] = sum(b[k] * x[t - k] for k in range(len(b)) if t >= k) - sum(a[k] * y[t - k] for k in range(1, len(a)) if t >= k)
    return y


@pytest.mark.parametrize("n", [1, 5, 300, 700])
def test_recursive_filter(n):
    b, a, x = [0.2, 0.3, 0.1], [1.0, -0.7, 0.25], RNG.standard_normal(n)
    y, _ = K.lfilter(b, a, x)
    np.testing.assert_allclose(y, direct_filter(b, a, x), atol=1e-10)


def test_filter_state_carries():
    b, a = K.peak_filter(10, 5, 100)
    x = RNG.standard_normal(500)
    whole, _ = K.lfilter(b, a, x)
    first, state = K.lfilter(b, a, x[:123])
    second, _ = K.lfilter(b, a, x[123:], state)
    np.testing.assert_allclose(np.concatenate([first, second]), whole, atol=1e-10)


@pytest.mark.parametrize(("kind", "freqs"), [("lowpass", [20]), ("highpass", [20]), ("bandpass", [10, 30]), ("bandstop", [10, 30])])
def test_butterworth_gain(kind, freqs):
    sos, rate = K.butter_sos(4, freqs, kind, 200), 200

    def gain(f):
        z = np.exp(-2j * np.pi * f / rate)
        return abs(np.prod([(s[0] + s[1] * z + s[2] * z * z) / (s[3] + s[4] * z + s[5] * z * z) for s in sos]))

    for f in freqs:
        assert gain(f) == pytest.approx(math.sqrt(0.5), rel=1e-6)
    through = {"lowpass": 1, "highpass": 90, "bandpass": 17.5, "bandstop": 1}[kind]
    assert gain(through) == pytest.approx(1, abs=1e-2)


def test_zero_phase_keeps_a_passed_tone():
    t = np.arange(2000) / 200
    x = np.sin(2 * np.pi * 20 * t)
    y = K.sosfiltfilt(K.butter_sos(4, [10, 30], "bandpass", 200), x)
    np.testing.assert_allclose(y[300:-300], x[300:-300], atol=1e-3)


def test_cosine_transform():
    x = RNG.standard_normal(37)
    np.testing.assert_allclose(K.dct(x), K.dct_matrix(37) @ x, atol=1e-10)
    np.testing.assert_allclose(K.idct(K.dct(x)), x, atol=1e-10)


def test_short_time_round_trip():
    x = RNG.standard_normal(500)
    np.testing.assert_allclose(K.istft(K.stft(x, 64, 32), 64, 32, 500), x, atol=1e-8)


def test_incomplete_gamma():
    assert K.gammainc(1, 2) == pytest.approx(1 - math.exp(-2))
    assert K.gammainc(0.5, 1.3) == pytest.approx(math.erf(math.sqrt(1.3)))
    for p in (0.01, 0.5, 0.99):
        assert K.gammainc(0.7, K.gammaincinv(0.7, p)) == pytest.approx(p)


def test_peaks():
    x = np.array([0, 1, 0, 3, 3, 0, 2, 0, 0.5, 0.4, 0.6, 0])
    assert K.find_peaks(x).tolist() == [1, 3, 6, 8, 10]
    assert K.find_peaks(x, prominence=0.3).tolist() == [1, 3, 6, 10]
    assert K.find_peaks(x, height=0.9, distance=3).tolist() == [3, 6]


def test_fractional_boxcar_removes_the_line():
    t = np.arange(3000)
    x = np.sin(2 * np.pi * t / 16.7)
    assert np.abs(K.fractional_boxcar(x, 16.7)[200:-200]).max() < 1e-3


def test_rms_fit_ignores_artifacts():
    x = np.abs(np.concatenate([RNG.normal(10, 1, 900), RNG.normal(60, 5, 100)]))
    mu, sigma = K.fit_rms(x)
    assert abs(mu - 10) < 0.7 and 0.5 < sigma < 2


def test_yule_walker_follows_gains():
    b, a = K.yule_walker(8, np.array([0, 0.3, 0.5, 1]), np.array([1, 1, 0.2, 0.2]))
    assert (np.abs(np.roots(a)) < 1).all()
    z = np.exp(-1j * np.pi * np.array([[0.15], [0.8]]) * np.arange(9))
    np.testing.assert_allclose(np.abs(z @ b) / np.abs(z @ a), [1, 0.2], atol=0.15)


def test_separation_contract():
    a = RNG.standard_normal((6, 6))
    c0, c1 = a @ a.T, np.diag(np.arange(6.0))
    f, p, s = L.dss(c0, c1)
    np.testing.assert_allclose(f @ c0 @ f.T, np.eye(6), atol=1e-8)
    np.testing.assert_allclose(f @ c1 @ f.T, np.diag(s), atol=1e-8)
    np.testing.assert_allclose(p @ f, np.eye(6), atol=1e-8)
    assert (np.diff(s) <= 1e-12).all()


def test_counts():
    assert L.knee([100, 90, 2, 1.9]) == 2 and L.knee([4, 3, 2, 1]) == 0
    assert L.outliers([1.0] * 30 + [50.0]) == 1


def test_canonical_correlation_of_copies():
    x = RNG.standard_normal((3, 400))
    y = RNG.standard_normal((3, 3)) @ x
    c = np.cov(np.vstack([x, y]))
    assert L.cca(c[:3, :3], c[3:, 3:], c[:3, 3:])[2] == pytest.approx([1, 1, 1], abs=1e-6)


def test_components_of_a_series_add_up():
    x = RNG.standard_normal(80)
    parts = L.ssa(x, 20)
    np.testing.assert_allclose(parts.sum(0), x, atol=1e-8)
    w = L.w_correlation(parts, 20)
    np.testing.assert_allclose(np.diag(w), 1)


def test_means_of_matrices():
    m = np.array([np.eye(3) * v for v in (1.0, 2.0, 4.0)])
    assert np.trace(L.karcher_mean(m)) / 3 == pytest.approx(2)
    assert np.trace(L.geometric_median(m)) / 3 == pytest.approx(2, abs=1e-3)


def test_neighbours_reproduce_a_shared_source():
    c = np.ones((4, 4)) + 1e-6 * np.eye(4)
    w = L.neighbour_weights(c)
    assert np.diag(w).tolist() == [0] * 4 and w.sum(1) == pytest.approx([1] * 4, abs=1e-3)


def test_line_segment_is_cleaned():
    t = np.arange(4000) / 250
    x = RNG.standard_normal((6, 4000)) + np.outer(RNG.standard_normal(6) * 3, np.sin(2 * np.pi * 50 * t))
    y = lines.clean_segment(x, 250.0, 50.0)
    f, before = K.welch(x, 250, 1000)
    _, after = K.welch(y, 250, 1000)
    k = np.abs(f - 50).argmin()
    assert after.mean(0)[k] < 0.1 * before.mean(0)[k]


def test_reference_window():
    r = RNG.standard_normal((1, 500))
    x = RNG.standard_normal((4, 500)) * 0.3 + np.outer([1, 2, 3, 4], r[0])
    y, k = references.clean_window(x, r)
    assert k == 1 and abs(np.corrcoef(y[3], r[0])[0, 1]) < 0.2


def test_repair_leaves_clean_data_alone():
    m = np.eye(3)
    state = asr.State(["a", "b", "c"], m, np.eye(3) * 5)
    assert asr.repair(state, np.linalg.eigh(np.eye(3)))[1].all()
    r, keep, _ = asr.repair(state, np.linalg.eigh(np.diag([1.0, 1.0, 1000.0])))
    assert not keep.all() and abs(r[2, 2]) < 1e-8 and r[0, 0] == pytest.approx(1)


def test_windows_and_segments():
    assert windows.window_starts(10, 4, 3) == [0, 3, 6]
    assert windows.window_starts(11, 4, 3) == [0, 3, 6, 7]
    assert spans.fixed_segments(100, 30) == [(0, 30), (30, 60), (60, 100)]
    b = spans.block_bounds(100, 40, 30)
    assert [x[2] for x in b][1:] == [x[3] for x in b][:-1] and b[-1][1] == 100


def test_chunks_of_repair_are_those_of_one_chunk(spark):
    from pyspark.sql import functions as F

    n, c = 600, 4
    x = RNG.standard_normal((c, n))
    x[:, 300:330] += np.outer([9.0, -8, 7, 5], np.ones(30)) * RNG.standard_normal(30)
    sig = spark.createDataFrame([(f"c{i}", t, float(x[i, t])) for i in range(c) for t in range(n)], "channel string, t long, x double")
    state = asr.State([f"c{i}" for i in range(c)], np.eye(c), 3 * np.eye(c))
    one, many = (asr.process(sig, state, 50.0, n, 0.5, chunk=k).withColumnRenamed("x", f"x{j}") for j, k in enumerate((6000, 96)))
    both = one.join(many, ["channel", "t"])
    assert both.count() == n * c and both.where(F.abs(F.col("x0") - F.col("x1")) > 1e-6).count() == 0
    assert both.join(sig, ["channel", "t"]).agg(F.max(F.abs(F.col("x") - F.col("x0")))).first()[0] > 1


def test_settings():
    from quietfield.plans import validation as V

    assert V.sample_window((-0.1, 0.25), "seconds", 10) == (-1, 2)
    assert V.agreed_rate(None, 250.0) == 250.0
    for bad in (lambda: V.sample_window((3, 3)), lambda: V.agreed_rate(1.0, 2.0), lambda: V.same_channels(["a"], ["b"])):
        with pytest.raises(ValueError):
            bad()


def test_unusable_channels_are_named(spark):
    from quietfield.plans import validation as V

    rows = [("a", t, float(t)) for t in range(200)] + [("b", t, 1.0) for t in range(200)]
    sig = spark.createDataFrame(rows, "channel string, t long, x double")
    with pytest.raises(ValueError, match="b"):
        V.filled(sig)
    holed = spark.createDataFrame([(c, t, float("nan") if t == 5 and c == "a" else x + t % 7) for c, t, x in rows], "channel string, t long, x double")
    assert V.filled(holed).where("channel = 'a' and t = 5").first().x == 0.0


def test_log_levels():
    from quietfield import progress as P

    class Fit:
        verbose = "ERROR"

        @P.verbose
        def run(self):
            return P.LOG.level

    assert Fit().run() == 40 and Fit().run(verbose="DEBUG") == 10
    with P.log_level("INFO"):
        assert Fit().run() == 20


def test_null_threshold_lies_above_chance():
    x, y = RNG.standard_normal((3, 300)), RNG.standard_normal((2, 300))
    assert 0 < references.null_threshold(x, y, rounds=20) < 0.3
