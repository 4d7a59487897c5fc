"""Queries without SQL against answers worked out another way, with numpy on the whole signal, at the smallest size."""

from __future__ import annotations

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from quietfield import queries as Q
from quietfield.functions import kernels as K
from quietfield.functions import linalg as L
from quietfield.operators import asr, dss, head, moments, references, spectral, windows
from quietfield.sources import signals as S

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables here")


def wide(df) -> tuple[list[str], np.ndarray]:
    """Channels by time."""
    f = df.toPandas().pivot(index="channel", columns="t", values="x").sort_index()
    return list(f.index), f.to_numpy(float)


@pytest.fixture(scope="module")
def sig(spark):
    return S.hourly(spark, DATA).persist()


@pytest.fixture(scope="module")
def x(sig):
    return wide(sig)[1]


@pytest.fixture(scope="module")
def vec(spark):
    return wide(S.vectors(spark, DATA))[1]


def run(spark, name):
    return Q.QUERIES[name](spark, DATA)


def matrix(df) -> np.ndarray:
    return df.toPandas().pivot(index="row", columns="col", values="v").sort_index().to_numpy(float)


def shares(c: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Generalised eigenvalues, falling, by a triangular root (the code goes by a whitener)."""
    r = np.linalg.inv(np.linalg.cholesky(c))
    return np.linalg.eigvalsh(r @ b @ r.T)[::-1]


def cov(x: np.ndarray) -> np.ndarray:
    return np.cov(x, bias=True)


def scores(df) -> np.ndarray:
    f = df.toPandas().groupby("component")["score"].first()
    return f.sort_index().to_numpy(float)


def smoothed(x: np.ndarray, w: int = 24) -> np.ndarray:
    return np.stack([[r[max(0, t - w + 1) : t + 1].mean() for t in range(len(r))] for r in x])


def slow_filter(b, a, x: np.ndarray) -> np.ndarray:
    """A recursive filter by its difference equation."""
    y = np.zeros(len(x))
    for t in range(len(x)):
        y[t] = (sum(b[k] * x[t - k] for k in range(len(b)) if t >= k) - sum(a[k] * y[t - k] for k in range(1, len(a)) if t >= k)) / a[0]
    return y


# --- separation

def test_smooth_separation(spark, x):
    assert np.allclose(scores(run(spark, "dss_smooth")), shares(cov(x), cov(smoothed(x))), rtol=1e-6)


def test_denoised_keeps_the_leading_two(spark, x):
    c, b = cov(x), cov(smoothed(x))
    r = np.linalg.inv(np.linalg.cholesky(c))
    v, u = np.linalg.eigh(r @ b @ r.T)
    w = u[:, ::-1][:, :2].T @ r
    want = c @ w.T @ w @ (x - x.mean(1, keepdims=True))
    assert np.allclose(wide(run(spark, "dss_denoised"))[1], want, atol=1e-6 * np.abs(want).max())


def test_epoch_separation(spark, x):
    n = x.shape[1] // 24 * 24
    e = x[:, :n].reshape(len(x), -1, 24)
    mean = np.repeat(e.mean(1)[:, None], e.shape[1], 1).reshape(len(x), -1)
    sources = wide(run(spark, "dss_epochs_sources"))[1]
    own = sources[:, :n].reshape(len(x), -1, 24)
    share = (own.mean(1) - own.mean((1, 2))[:, None]).var(1) / own.var((1, 2))
    assert np.allclose(np.sort(share)[::-1], shares(cov(x[:, :n]), cov(mean)), rtol=1e-5, atol=1e-9)


@pytest.mark.parametrize(("name", "make"), [("dss_narrowband", lambda s: spectral.bandpass(s, 24.0, 0.8, 1.2)), ("dss_comb", lambda s: spectral.comb(s, 24.0, 1.0))])
def test_filtered_separation(spark, sig, x, name, make):
    """The filters themselves are tested below."""
    assert np.allclose(scores(run(spark, name)), shares(cov(x), cov(wide(make(sig))[1])), rtol=1e-6)


def test_narrowband_scan(spark, sig, x):
    for r in run(spark, "dss_narrowband_scan").collect():
        assert r.error is None
        assert r.score == pytest.approx(shares(cov(x), cov(wide(spectral.bandpass(sig, 24.0, r.freq - 0.2, r.freq + 0.2))[1]))[0], rel=1e-6)


def fixed_point(table, x, f, slope, rank=None) -> float:
    """How nearly the found directions are fixed points, in whitened data."""
    t = table.toPandas().pivot(index="component", columns="channel", values="filter").to_numpy(float)
    y = t @ (x - x.mean(1, keepdims=True))
    assert np.allclose(y @ y.T / y.shape[1], np.eye(len(y)), atol=1e-6)
    w, _ = L.whitener(cov(x), rank)
    z = w @ (x - x.mean(1, keepdims=True))
    d = t @ np.linalg.pinv(w)
    gap = []
    for k in range(len(d)):
        new = (f(y[k]) * z).mean(1) - slope(y[k]).mean() * d[k]
        new -= d[:k].T @ (d[:k] @ new)
        gap.append(1 - abs(new @ d[k]) / np.linalg.norm(new))
    return max(gap)


def test_iterative_directions_are_fixed_points(spark, vec):
    assert fixed_point(run(spark, "dss_iterative"), vec, np.tanh, lambda s: 1 - np.tanh(s) ** 2, 8) < 0.02
    assert fixed_point(run(spark, "dss_iterative_damped"), vec, np.tanh, lambda s: 1 - np.tanh(s) ** 2, 8) < 0.02


def test_symmetric_directions_are_orthogonal(spark, vec):
    t = run(spark, "dss_iterative_symmetric").toPandas().pivot(index="component", columns="channel", values="filter").to_numpy(float)
    y = t @ (vec - vec.mean(1, keepdims=True))
    assert np.allclose(y @ y.T / y.shape[1], np.eye(2), atol=1e-6)


def test_step_rules():
    assert dss.gamma179(np.array([1.0]), np.array([-1.0]), 1.0) == 0.5 == dss.gamma179(np.array([1.0]), None, 0.5)
    assert dss.gamma_predictive(np.array([0.5]), np.array([1.0]), 1.0) == 1.5 and dss.gamma_predictive(np.array([-2.0]), np.array([1.0]), 1.0) == 0.5


# --- covariance and whitening

def test_whitened(spark, vec):
    _, y = wide(run(spark, "whitened"))
    assert np.allclose(cov(y), np.eye(len(y)), atol=1e-8)


def test_canonical_correlations_by_angles(spark, vec):
    q = [np.linalg.qr((p - p.mean(1, keepdims=True)).T)[0] for p in (vec[:23], vec[23:])]  # channels below e3 by name, and the others
    got = [r.r for r in run(spark, "cca").orderBy("component").collect()]
    assert np.allclose(got, np.linalg.svd(q[0].T @ q[1])[1], atol=1e-8)


def test_mixing_is_least_squares(spark, vec):
    y = vec - vec.mean(1, keepdims=True)
    w, _ = L.whitener(cov(y))
    want = np.linalg.lstsq((w @ y).T, y.T, rcond=None)[0].T
    assert np.allclose(matrix(run(spark, "mixing_least_squares")), want, atol=1e-8)


def test_geometric_median_has_no_pull(spark, sig, x):
    names = S.channels_of(sig)
    blocks = moments.block_covariances(sig, 24, x.shape[1]).toPandas()
    mats = np.stack([g.pivot(index="ci", columns="cj", values="v").sort_index().to_numpy(float) for _, g in blocks.groupby("block")])
    m = matrix(run(spark, "geometric_median_covariance"))
    d = mats - m
    pull = (d / np.linalg.norm(d, axis=(1, 2))[:, None, None]).sum(0)
    assert len(names) == len(m) and np.linalg.norm(pull) < 1e-3 * len(mats)


def test_affine_mean_has_no_pull(sig, x):
    names = S.channels_of(sig)
    blocks = moments.block_covariances(sig, 24, x.shape[1])
    f = blocks.toPandas()
    mats = np.stack([g.pivot(index="ci", columns="cj", values="v").sort_index().to_numpy(float) for _, g in f.groupby("block")])
    mats = np.stack([L.spd_map(m, lambda v: v) for m in mats])
    m = asr._karcher_covariance(blocks, names)
    ih = L.spd_map(m, lambda v: 1 / np.sqrt(v))
    assert np.linalg.norm(np.mean([L.spd_log(ih @ c @ ih) for c in mats], 0)) < 1e-3


def test_robust_covariance_is_a_concentration(spark, vec):
    c = matrix(run(spark, "robust_covariance"))
    y = vec.T
    h = (len(y) + 65) // 2
    rng = np.random.default_rng(0)
    best = min(np.linalg.slogdet(np.cov(y[rng.choice(len(y), h, replace=False)].T, bias=True))[1] for _ in range(50))
    assert np.linalg.slogdet(c)[1] < best


# --- filters and spectra

def test_filters_do_not_depend_on_blocks(sig):
    for make in (
        lambda s, k: spectral.bandpass(s, 24.0, 3.0, 6.0, block=k), lambda s, k: spectral.notch(s, 24.0, 3.0, 0.5, block=k),
        lambda s, k: spectral.peak(s, 24.0, 3.0, 5.0, block=k), lambda s, k: spectral.comb(s, 24.0, 3.0, 2, 5.0, block=k),
    ):
        a, b = (wide(make(sig, k))[1] for k in (100, 10_000))
        assert np.abs(a - b).max() < 1e-8 * max(1.0, np.abs(b).max())


def test_filters_are_their_difference_equations(spark, x):
    sos = K.butter_sos(4, [0.8, 1.2], "bandpass", 24.0)
    y = wide(run(spark, "bandpass"))[1][0]
    rng = np.random.default_rng(0)
    z = rng.standard_normal(300)
    b, a = K.peak_filter(1.0, 30.0, 24.0)
    assert np.allclose(K.lfilter(b, a, z[None])[0][0], slow_filter(b, a, z), atol=1e-9)
    forward = z
    for s in sos:
        forward = slow_filter(s[:3], s[3:], forward)
    quick = z
    for s in sos:
        quick = K.lfilter(s[:3], s[3:], quick[None])[0][0]
    assert np.allclose(forward, quick, atol=1e-9)
    f = np.fft.rfftfreq(len(y), 1 / 24)
    kept, all_ = np.abs(np.fft.rfft(y)) ** 2, np.abs(np.fft.rfft(x[0])) ** 2
    inside = (f > 0.9) & (f < 1.1)
    assert kept[f > 3].sum() < 1e-3 * all_[f > 3].sum() and kept[inside].sum() > 0.5 * all_[inside].sum()


def test_welch(spark, x):
    want, w = [], 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(96) / 96)
    for s in range(0, x.shape[1] - 96 + 1, 48):
        p = x[:, s : s + 96] - x[:, s : s + 96].mean(1, keepdims=True)
        z = np.abs(np.stack([(p * w * np.exp(-2j * np.pi * k * np.arange(96) / 96)).sum(1) for k in range(49)], 1)) ** 2 / (24 * (w * w).sum())
        z[:, 1:-1] *= 2
        want.append(z)
    f = run(spark, "welch_psd").toPandas().pivot(index="channel", columns="freq", values="power").sort_index()
    assert np.allclose(f.to_numpy(float), np.mean(want, 0), rtol=1e-8, atol=1e-9)


def test_line_presence_and_verdict(spark, sig):
    for name, nperseg, f0 in (("line_presence", 240, 1.0), ("line_verdict", 480, 3.5)):
        p = spectral.welch(sig, 24.0, nperseg).toPandas().pivot(index="channel", columns="freq", values="power")
        f, db = p.columns.to_numpy(float), (10 * np.log10(np.maximum(p.to_numpy(float), p.to_numpy(float).max() * 1e-20))).mean(0)
        low, high = db[(f - f0 < -1) & (f - f0 >= -3)], db[(f - f0 > 1) & (f - f0 <= 3)]
        centre = np.concatenate([low, high]).mean()
        spread = centre - np.mean([np.quantile(side, 0.05) for side in (low, high) if len(side)])
        r = run(spark, name).first()
        if name == "line_presence":
            top = db[np.abs(f - f0) <= 0.06].max()
            assert (r.centre, r.deviation, r.peak, r.present) == (pytest.approx(centre), pytest.approx(spread), pytest.approx(top), bool(top > centre + 2 * spread))
        else:
            c = db[(f >= f0 - 0.4) & (f <= f0 + 0.1)]
            t = db[np.abs(f - f0) <= 0.05]
            weak, strong = (t > centre + 2 * spread).mean() > 0.005 if len(t) else False, (c < centre - 2 * spread).mean() > 0.005
            assert r.verdict == ("weak" if weak else "strong" if strong else "ok")


def test_spectrum_interpolation_leaves_other_bins_alone(spark, x):
    y = wide(run(spark, "spectrum_interpolation"))[1]
    f = np.fft.rfftfreq(x.shape[1], 1 / 24)
    a, b = np.fft.rfft(x, axis=1), np.fft.rfft(y, axis=1)
    line = (np.abs(f - 1) <= 0.05) | (np.abs(f - 2) <= 0.05)
    assert np.allclose(a[:, ~line], b[:, ~line], atol=1e-6 * np.abs(a).max())
    assert np.allclose(np.angle(a[:, line] * np.conj(b[:, line])), 0, atol=1e-6)


def test_cosine_mask_by_its_matrix(spark, x):
    n = x.shape[1]
    k = np.arange(n)
    d = np.sqrt(2 / n) * np.cos(np.pi * (k[None] + 0.5) * k[:, None] / n)
    d[0] /= np.sqrt(2)
    keep = k < int(0.2 * n)
    assert np.allclose(wide(run(spark, "cosine_mask"))[1], x @ d[keep].T @ d[keep], atol=1e-6 * np.abs(x).max())


# --- references and sensors

def test_sensor_noise_by_regressions(spark, vec):
    y = vec - vec.mean(1, keepdims=True)
    r = np.abs(np.corrcoef(y))
    want = []
    for i in range(64):
        near = [j for j in np.argsort(-r[i]) if j != i][:3]
        want.append(np.linalg.lstsq(y[near].T, y[i], rcond=None)[0] @ y[near])
    assert np.allclose(wide(run(spark, "sensor_noise_suppressed"))[1], want, atol=1e-8)


def slow_sound(g, lead, lam=0.1, rounds=5, seed=0):
    """Every channel from the others by solving with their rows and columns alone."""
    n, rng, ll = len(g), np.random.default_rng(seed), lead @ lead.T

    def left(i, b):
        o = [j for j in range(n) if j != i]
        return np.sqrt(g[i, i] - 2 * b @ g[o, i] + b @ g[np.ix_(o, o)] @ b)

    s = np.array([left(i, np.linalg.solve(g[np.ix_(o, o)] + np.trace(g) / n * np.eye(n - 1), g[o, i])) for i in range(n) for o in [[j for j in range(n) if j != i]]])
    for _ in range(rounds):
        for i in rng.permutation(n):
            o = [j for j in range(n) if j != i]
            k = ll[np.ix_(o, o)] / np.outer(s[o], s[o])
            s[i] = left(i, np.linalg.solve(k + lam * np.trace(k) / (n - 1) * np.eye(n - 1), ll[o, i] / s[o]) / s[o])
    k = ll / np.outer(s, s)
    return ll @ np.diag(1 / s) @ np.linalg.inv(k + lam * np.trace(k) / n * np.eye(n)) @ np.diag(1 / s), s


def test_source_informed(spark, vec):
    lead = head.lead_field(L.spherical_points(64), 12)[0]
    m, s = slow_sound(vec @ vec.T / vec.shape[1], lead)
    got, noise = L.sound(vec @ vec.T / vec.shape[1], lead)
    assert np.allclose(noise, s, rtol=1e-6) and np.allclose(got, m, atol=1e-6 * np.abs(m).max())
    assert np.allclose(wide(run(spark, "source_informed"))[1], m @ vec, atol=1e-6 * np.abs(m @ vec).max())


def test_best_reference_averages_to_zero(spark, vec):
    y = wide(run(spark, "source_informed_best_reference"))[1]
    assert np.allclose(y.mean(0), 0, atol=1e-9 * max(1, np.abs(y).max()))
    assert L.sensor_noise(vec @ vec.T / vec.shape[1]).argmin() == references.source_informed_best_reference(S.vectors(spark, DATA), head.lead_field(L.spherical_points(64), 12)[0])[1]


def test_lead_field_of_a_homogeneous_sphere():
    """With one conductivity, radial dipoles have a potential in closed form; columns have a mean of zero."""
    h = head.Head(skull_to_brain=1.0)
    up = L.spherical_points(30)
    gain, at = head.lead_field(up, 7, h, average=False)
    b = np.linalg.norm(at, axis=1)[0]
    unit = at / b
    for k in range(7):
        c = up @ unit[k]
        want = ((1 - b * b) / (1 - 2 * b * c + b * b) ** 1.5 - 1) / b / (4 * np.pi * 0.33 * 0.088**2)
        assert np.allclose(gain[:, 3 * k : 3 * k + 3] @ unit[k], want, rtol=1e-6, atol=1e-6)
    skull, _ = head.lead_field(up, 7)
    assert np.allclose(skull.mean(0), 0) and np.abs(skull).max() < np.abs(gain - gain.mean(0)).max()
    assert [round(r, 4) for _, r, _ in head.Head().shells()] == [0.9205, 0.9659, 1.0]


def test_projected_recovery(spark, vec):
    lead = head.lead_field(L.spherical_points(64), 12)[0]
    sig = S.vectors(spark, DATA)
    top = references.artifact_topographies(sig, 100.0, 20.0, 1)
    p = np.eye(64) - top @ top.T
    u, s, v = np.linalg.svd(p @ lead, full_matrices=False)
    k = min(24, int((s > s[0] * 1e-10).sum()))
    assert np.allclose(wide(run(spark, "projected_recovery"))[1], lead @ v[:k].T @ np.diag(1 / s[:k]) @ u[:, :k].T @ p @ vec, atol=1e-8 * np.abs(vec).max())


def test_delayed_correlations(spark, sig, x):
    now, past = x[:, 1:] - x[:, 1:].mean(1, keepdims=True), x[:, :-1] - x[:, :-1].mean(1, keepdims=True)
    r = np.linalg.svd(np.linalg.qr(now.T)[0].T @ np.linalg.qr(past.T)[0])[1]
    model, gone = references.delayed_cca(sig, 1, remove=1)
    assert np.allclose(model.scores, r, atol=1e-8) and gone == [len(r) - 1]
    y = wide(run(spark, "delayed_cca"))[1]
    assert np.linalg.matrix_rank(cov(x - y), tol=1e-8 * np.abs(cov(x)).max()) == 1
    assert np.allclose(references.filter_asymmetry(np.eye(3), -2 * np.eye(3)), 0)


# --- series

def test_ssa_by_reconstruction(spark, sig, x):
    y = wide(run(spark, "ssa"))[1]
    n = x.shape[1]
    w = max(2, min(48, 100, (n + 1) // 2))
    h = np.stack([x[0, k : k + n - w + 1] for k in range(w)])
    u, s, v = np.linalg.svd(h, full_matrices=False)
    gone = np.zeros(n)
    for k in range(w):
        part = s[k] * np.outer(u[:, k], v[k])
        line = np.array([np.mean([part[i, t - i] for i in range(w) if 0 <= t - i < n - w + 1]) for t in range(n)])
        if np.fft.rfftfreq(n, 1 / 24)[np.abs(np.fft.rfft(line)).argmax()] <= 0.1:
            gone += line
    assert np.allclose(y[0], x[0] - gone, atol=1e-6 * np.abs(x).max())


def test_local_ssa_removes_a_slow_wave():
    rng = np.random.default_rng(1)
    t = np.arange(600)
    slow, fast = 8 * np.sin(2 * np.pi * t / 150), rng.standard_normal(600)
    y = L.local_ssa_clean(slow + fast, 30)
    assert np.corrcoef(y, slow)[0, 1] < 0.35 < np.corrcoef(y, fast)[0, 1]
    part, order = L.subspace_of(np.outer(rng.standard_normal(200), np.ones(6)) + 1e-6 * rng.standard_normal((200, 6)))
    assert order == 1 and part.shape == (200, 6)
    assert np.array_equal(L.local_ssa_clean(fast[:60], 30, clusters=8), fast[:60])  # clusters too small: left alone


# --- subspace repair

def test_similarity_matching_finds_the_leading_directions():
    rng = np.random.default_rng(5)
    q, _ = np.linalg.qr(rng.standard_normal((6, 6)))
    c = q @ np.diag([9.0, 6, 0.1, 0.1, 0.1, 0.1]) @ q.T
    for whitened in (True, False):
        learner = asr.Subspace.start(np.linalg.qr(rng.standard_normal((6, 2)))[0], c, whitened, 0.02, 0.5)
        for _ in range(1500):
            learner = learner.advanced(c)
        b = learner.components()
        assert np.linalg.norm(b @ b.T - q[:, :2] @ q[:, :2].T) < 0.05


def test_an_update_is_the_formula_on_samples():
    rng = np.random.default_rng(6)
    data = rng.standard_normal((5, 400))
    a = asr.Subspace.start(np.eye(5)[:, :3], np.eye(5), True, 0.1, 0.7)
    y = np.linalg.inv(a.m) @ a.w @ data
    b = a.advanced(data @ data.T / 400)
    assert np.allclose(b.w, 0.8 * a.w + 0.2 * y @ data.T / 400)
    assert np.allclose(b.m, a.m + 0.1 / 0.7 * (y @ y.T / 400 - np.eye(3)))


def test_adaptive_calibration(spark, sig, x):
    n = x.shape[1]
    model = asr.adaptive_fit(sig, 24.0, n, 3.0, length=1.0)
    before = model.learner.w.copy(), model.state.thresholds.copy()
    with pytest.raises(ValueError, match="shorter"):
        asr.partial_fit(model, sig.where("t < 10"), 24.0, 10)
    after = asr.partial_fit(model, sig.where("t < 240"), 24.0, 240, 3.0, 1.0)
    assert np.array_equal(model.learner.w, before[0]) and np.array_equal(model.state.thresholds, before[1])
    basis = after.learner.components()
    assert np.allclose(basis.T @ basis, np.eye(len(basis)), atol=1e-9) and after.state.thresholds.shape == before[1].shape
    one = wide(asr.process(sig, after.state, 24.0, n, 1.0, chunk=240))[1]
    two = wide(asr.process(sig, after.state, 24.0, n, 1.0, chunk=240))[1]  # nothing is carried from call to call
    assert np.array_equal(one, two)


def test_log_tells_what_was_changed(spark, sig, x):
    n = x.shape[1]
    state = asr.calibrate(sig, 24.0, n, 1.0, length=1.0)
    y = wide(asr.process(sig, state, 24.0, n, 1.0, chunk=240))[1]
    log = asr.process(sig, state, 24.0, n, 1.0, chunk=240, log=True).orderBy("start").collect()
    assert log[0].start == 0 and log[-1].stop == n and all(a.stop == b.start for a, b in zip(log[:-1], log[1:], strict=True))
    for r in log:
        same = np.allclose(x[:, r.start : r.stop], y[:, r.start : r.stop], atol=1e-9 * np.abs(x).max())
        assert same or r.applied
        v, lim = np.array(r.variances), np.array(r.limits)
        bad = ~((v < lim) | (np.arange(len(v)) < len(v) - asr.half_up(0.66 * len(v))))
        assert r.n_reconstructed == bad.sum()
    frame = asr.process(sig, state, 24.0, n, 1.0, chunk=240, log=True)
    mask = {r.t: r.on for r in asr.rejection_mask(frame).collect()}
    held = sum(r.stop - r.start for r in asr.rejection_spans(frame).collect())
    d = asr.diagnostics(frame).first()
    assert len(mask) == n and held == sum(mask.values()) and d.samples_changed == pytest.approx(held / n) and d.n_windows == len(log)


def test_calibration_mask(spark, sig, x):
    n = x.shape[1]
    _, starts = asr.clean_windows(sig, 24.0, n)
    want = np.zeros(n, bool)
    for s in starts:
        want[s : s + 24] = True
    assert [r.on for r in run(spark, "asr_calibration_mask").orderBy("t").collect()] == want.tolist()


def test_repair_of_the_stream_is_that_of_the_whole(spark, x):
    got = wide(run(spark, "asr_stream"))[1]
    assert got.shape == x.shape and np.allclose(got, wide(run(spark, "asr"))[1], atol=1e-7 * np.abs(x).max())


def test_global_repair(spark, sig, x):
    n = x.shape[1]
    state = asr.calibrate(sig, 24.0, n, 0.1, length=1.0, filtered=False)
    c = x @ x.T / n
    v, u = L.riemannian_eigenspace(c)
    limit = ((state.thresholds @ u) ** 2).sum(0)
    keep = (v < limit) | (np.arange(len(v)) < len(v) - asr.half_up(0.66 * len(v)))
    r = np.eye(len(v)) if keep.all() else state.mixing @ np.linalg.pinv(np.diag(keep.astype(float)) @ u.T @ state.mixing) @ u.T
    y = wide(asr.process_globally(sig, state, n, 12))[1]
    assert np.allclose(y[:, 12:], (r @ x)[:, 12:], atol=1e-7 * np.abs(x).max())


def test_window_scores(spark, sig, x):
    f = windows.window_rms(sig, windows.fractional_starts(x.shape[1], 24, 0.5), 24).toPandas()
    for r in f.sample(20, random_state=0).itertuples():
        k = S.channels_of(sig).index(r.channel)
        assert r.rms == pytest.approx(np.sqrt((x[k, r.start : r.start + 24] ** 2).mean()))
    g = run(spark, "rms_distribution").toPandas()
    for r in g.itertuples():
        v = f[f.channel == r.channel]["rms"]
        assert v.min() <= r.mu <= v.max() and 0 <= r.sigma < v.max() - v.min()
