"""Filters, transforms and distributions in numpy, from their published formulas."""

from __future__ import annotations

import math

import numpy as np


def butter_sos(order: int, freqs, kind: str, rate: float) -> np.ndarray:
    """Second-order sections of a Butterworth filter: prototype poles, band transform, bilinear transform."""
    warped = 2 * rate * np.tan(np.pi * np.atleast_1d(np.asarray(freqs, float)) / rate)
    p = np.exp(1j * np.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order))
    z, gain = np.zeros(0, complex), 1.0
    if kind in ("lowpass", "highpass"):
        w = warped[0]
        if kind == "lowpass":
            p, gain = p * w, w**order
        else:
            gain = float(np.real(1 / np.prod(-p)))
            p, z = w / p, np.zeros(order, complex)
    else:
        w, width = math.sqrt(warped[0] * warped[1]), warped[1] - warped[0]
        if kind == "bandpass":
            half = p * width / 2
            root = np.sqrt(half**2 - w**2 + 0j)
            p, z, gain = np.concatenate([half + root, half - root]), np.zeros(order, complex), width**order
        else:
            gain = float(np.real(1 / np.prod(-p)))
            half = width / 2 / p
            root = np.sqrt(half**2 - w**2 + 0j)
            p, z = np.concatenate([half + root, half - root]), np.concatenate([np.full(order, 1j * w), np.full(order, -1j * w)])
    c = 2 * rate
    gain *= float(np.real(np.prod(c - z) / np.prod(c - p)))
    z, p = np.concatenate([(c + z) / (c - z), -np.ones(len(p) - len(z))]), (c + p) / (c - p)
    return _sections(z, p, gain)


def _sections(z: np.ndarray, p: np.ndarray, gain: float) -> np.ndarray:
    """Conjugate (or real) pairs, poles nearest the circle last, each with the zeros nearest to it."""

    def pairs(x: np.ndarray) -> list[np.ndarray]:
        up = sorted(x[x.imag > 1e-10], key=lambda v: (abs(v), v.real))
        real = sorted(x[np.abs(x.imag) <= 1e-10].real)
        out = [np.array([v, v.conjugate()]) for v in up]
        while len(real) > 1:
            out.append(np.array([real.pop(0), real.pop(-1)]))
        return out + [np.array([v, 0.0]) for v in real]

    poles, zeros = sorted(pairs(p), key=lambda q: abs(abs(q[0]) - 1), reverse=True), pairs(z)
    sos = []
    for q in reversed(poles):
        k = min(range(len(zeros)), key=lambda i: abs(zeros[i][0] - q[0])) if zeros else -1
        b = np.real(np.poly(zeros.pop(k))) if k >= 0 else np.array([1.0, 0.0, 0.0])
        sos.insert(0, [*b, *np.real(np.poly(q))])
    out = np.array(sos)
    out[0, :3] *= gain
    return out


def lfilter(b: np.ndarray, a: np.ndarray, x: np.ndarray, zi: np.ndarray | None = None, size: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Recursive filter (direct form II transposed) along the last axis, with its final state.

    Blocks of ``size`` samples are matrix products: the response to the block's input, and to the state before it.
    """
    n = max(len(a), len(b))
    b, a = np.pad(np.asarray(b, float), (0, n - len(b))) / a[0], np.pad(np.asarray(a, float), (0, n - len(a))) / a[0]
    x = np.asarray(x, float)
    flat = x.reshape(-1, x.shape[-1])
    m = n - 1
    if m == 0:
        return b[0] * x, np.zeros((*x.shape[:-1], 0))
    step = np.zeros((m, m))
    step[:, 0] = -a[1:]
    step[:-1, 1:] += np.eye(m - 1)
    drive = b[1:] - a[1:] * b[0]
    size = min(size, max(1, flat.shape[1]))
    see, reach = np.empty((size, m)), np.empty((size, m))  # output on the state before; state after on input
    power, push = np.eye(m), drive.copy()
    impulse = np.empty(size)
    for k in range(size):
        see[k] = power[0]
        impulse[k] = b[0] if k == 0 else reach[k - 1][0]
        reach[k] = push
        power, push = step @ power, step @ push
    lower = np.zeros((size, size))
    for k in range(size):
        lower[k:, k] = impulse[: size - k]
    state = np.zeros((len(flat), m)) if zi is None else np.asarray(zi, float).reshape(len(flat), m).copy()
    out = np.empty_like(flat)
    powers = {size: power}
    for lo in range(0, flat.shape[1], size):
        part = flat[:, lo : lo + size]
        k = part.shape[1]
        out[:, lo : lo + k] = part @ lower[:k, :k].T + state @ see[:k].T
        if k not in powers:
            powers[k] = np.linalg.matrix_power(step, k)
        state = state @ powers[k].T + part[:, ::-1] @ reach[:k]
    return out.reshape(x.shape), state.reshape(*x.shape[:-1], m)


def lfilter_zi(b: np.ndarray, a: np.ndarray) -> np.ndarray:
    """State of the steady response to ones."""
    n = max(len(a), len(b))
    b, a = np.pad(np.asarray(b, float), (0, n - len(b))) / a[0], np.pad(np.asarray(a, float), (0, n - len(a))) / a[0]
    m = n - 1
    step = np.zeros((m, m))
    step[:, 0] = -a[1:]
    step[:-1, 1:] += np.eye(m - 1)
    return np.linalg.solve(np.eye(m) - step, b[1:] - a[1:] * b[0])


def _odd(x: np.ndarray, pad: int) -> np.ndarray:
    pad = min(pad, len(x) - 1)
    return np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]]) if pad > 0 else x


def filtfilt(b: np.ndarray, a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Zero phase: forward and backward from steady states, edges turned about the edge sample."""
    pad = min(3 * max(len(a), len(b)), len(x) - 1)
    y, zi = _odd(x, pad), lfilter_zi(b, a)
    for _ in range(2):
        y = lfilter(b, a, y, zi * y[0])[0][::-1]
    return y[pad : pad + len(x)] if pad > 0 else y


def sosfiltfilt(sos: np.ndarray, x: np.ndarray) -> np.ndarray:
    taps = 2 * len(sos) + 1 - min((sos[:, 2] == 0).sum(), (sos[:, 5] == 0).sum())
    pad = min(3 * int(taps), len(x) - 1)
    y = _odd(np.asarray(x, float), pad)
    for _ in range(2):
        scale = y[0]
        for s in sos:
            zi = lfilter_zi(s[:3], s[3:])
            y = lfilter(s[:3], s[3:], y, zi * scale)[0]
            scale = scale * s[:3].sum() / s[3:].sum()
        y = y[::-1]
    return y[pad : pad + len(x)] if pad > 0 else y


def memory(*denominators: np.ndarray, left: float = 1e-13, least: int = 64) -> int:
    """Samples after which recursive filters one after another have forgotten all but ``left`` of what was before. Several
    sections near one pole forget more slowly than one of them: each adds its own time."""
    total = 0
    for a in denominators:
        slowest = max(np.abs(np.roots(a)), default=0.0)
        total += int(np.ceil(np.log(left) / np.log(min(max(slowest, 1e-6), 1 - 1e-9))))
    return max(total, least)


def peak_filter(freq: float, q: float, rate: float) -> tuple[np.ndarray, np.ndarray]:
    w = 2 * np.pi * freq / rate
    g = 1 / (1 + math.tan(w / q / 2))
    return (1 - g) * np.array([1.0, 0.0, -1.0]), np.array([1.0, -2 * g * math.cos(w), 2 * g - 1])


def hann(n: int) -> np.ndarray:
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)


def welch(x: np.ndarray, rate: float, nperseg: int, nfft: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Power density along the last axis: Hann segments with half overlap, each without its mean."""
    nperseg = min(nperseg, x.shape[-1])
    nfft, w = max(nfft or nperseg, nperseg), hann(nperseg)
    starts = range(0, x.shape[-1] - nperseg + 1, max(1, nperseg - nperseg // 2))
    total = 0
    for s in starts:
        part = x[..., s : s + nperseg]
        total = total + np.abs(np.fft.rfft((part - part.mean(-1, keepdims=True)) * w, nfft)) ** 2
    power = total / len(starts) / (rate * (w * w).sum())
    power[..., 1 : (nfft + 1) // 2 if nfft % 2 else nfft // 2] *= 2
    return np.fft.rfftfreq(nfft, 1 / rate), power


def stft(x: np.ndarray, nperseg: int, noverlap: int) -> np.ndarray:
    """(bins, frames) of a signal with zeros at its edges, filled up to whole frames."""
    hop, w = nperseg - noverlap, hann(nperseg)
    x = np.pad(x, nperseg // 2)
    x = np.pad(x, (0, -(len(x) - nperseg) % hop))
    return np.fft.rfft(np.lib.stride_tricks.sliding_window_view(x, nperseg)[::hop] * w, axis=1).T / w.sum()


def istft(z: np.ndarray, nperseg: int, noverlap: int, n: int) -> np.ndarray:
    hop, w = nperseg - noverlap, hann(nperseg)
    frames = np.fft.irfft(z.T * w.sum(), nperseg, axis=1) * w
    out, norm = np.zeros(nperseg + hop * (len(frames) - 1)), np.zeros(nperseg + hop * (len(frames) - 1))
    for k, f in enumerate(frames):
        out[k * hop : k * hop + nperseg] += f
        norm[k * hop : k * hop + nperseg] += w * w
    return (out / np.where(norm > 1e-10, norm, 1))[nperseg // 2 : nperseg // 2 + n]


def masked_spectrogram(x: np.ndarray, nperseg: int = 256, noverlap: int | None = None, mask: np.ndarray | None = None, percentile: float = 90.0) -> np.ndarray:
    """x through a mask over time and frequency: a given one (stretched to fit), or magnitudes above a percentile."""
    nperseg = min(nperseg, len(x))
    noverlap = nperseg // 2 if noverlap is None else noverlap
    z = stft(x, nperseg, noverlap)
    if mask is None:
        keep = np.abs(z) >= np.percentile(np.abs(z), percentile)
    else:
        at = [np.minimum((np.arange(s) * m / s).astype(int), m - 1) for s, m in zip(z.shape, mask.shape, strict=True)]
        keep = mask[np.ix_(*at)]
    return istft(z * keep, nperseg, noverlap, len(x))


def dct_matrix(n: int) -> np.ndarray:
    """Orthonormal cosine transform, type II."""
    m = np.sqrt(2 / n) * np.cos(np.pi * (2 * np.arange(n)[None] + 1) * np.arange(n)[:, None] / (2 * n))
    m[0] /= np.sqrt(2)
    return m


def dct(x: np.ndarray) -> np.ndarray:
    n = len(x)
    z = np.fft.fft(np.concatenate([x, x[::-1]]))[:n] * np.exp(-1j * np.pi * np.arange(n) / (2 * n))
    y = z.real * np.sqrt(1 / (2 * n))
    y[0] /= np.sqrt(2)
    return y


def idct(y: np.ndarray) -> np.ndarray:
    n = len(y)
    z = np.zeros(2 * n, complex)
    z[:n] = y * np.exp(1j * np.pi * np.arange(n) / (2 * n)) * np.sqrt(2 * n)
    z[0] *= np.sqrt(2)
    z[n + 1 :] = np.conj(z[1:n][::-1])
    return np.fft.ifft(z)[:n].real


def dct_mask(x: np.ndarray, fraction: float = 0.5, mask: np.ndarray | None = None) -> np.ndarray:
    y = dct(x)
    keep = (np.arange(len(x)) < max(1, int(fraction * len(x)))) if mask is None else np.interp(np.linspace(0, 1, len(x)), np.linspace(0, 1, len(mask)), mask)
    return idct(y * keep)


def interpolate_spectrum(x: np.ndarray, rate: float, freqs, half: float = 1.0, neighbours: float = 2.0) -> np.ndarray:
    z, grid = np.fft.rfft(x), np.fft.rfftfreq(len(x), 1 / rate)
    for f in sorted(f for f in freqs if f < rate / 2):
        d = np.abs(grid - f)
        band = d <= half
        if not band.any():
            band[d.argmin()] = True
        ring = (d <= half + neighbours) & ~band
        if ring.any():
            z[band] = np.abs(z[ring]).mean() * np.exp(1j * np.angle(z[band]))
    return np.fft.irfft(z, len(x))


def find_peaks(x: np.ndarray, height: float | None = None, distance: int = 1, prominence: float | None = None) -> np.ndarray:
    """Places of local maxima (middles of flat tops), filtered in the order height, distance, prominence."""
    edge = np.flatnonzero(np.diff(x) != 0)
    starts, stops = np.concatenate([[0], edge + 1]), np.concatenate([edge, [len(x) - 1]])
    v = x[starts]
    top = np.flatnonzero((v[1:-1] > v[:-2]) & (v[1:-1] > v[2:])) + 1
    peaks = (starts[top] + stops[top]) // 2
    if height is not None:
        peaks = peaks[x[peaks] >= height]
    if distance > 1:
        keep = np.ones(len(peaks), bool)
        for i in np.argsort(x[peaks], kind="stable")[::-1]:
            if keep[i]:
                near = np.abs(peaks - peaks[i]) < distance
                near[i] = False
                keep &= ~near
        peaks = peaks[keep]
    if prominence is not None:
        kept = []
        for p in peaks:
            left, right = x[: p + 1][::-1], x[p:]
            a, b = np.argmax(left > x[p]) or len(left), np.argmax(right > x[p]) or len(right)
            if x[p] - max(left[:a].min(), right[:b].min()) >= prominence:
                kept.append(p)
        peaks = np.array(kept, int)
    return peaks


def quasi_periodic(x: np.ndarray, distance: int = 100, percentile: float = 75.0, length: int | None = None, smooth: bool = True) -> np.ndarray:
    """Every cycle (between middles of peaks of |x|) becomes the mean cycle, at its own size and level."""
    peaks = find_peaks(np.abs(x), np.percentile(np.abs(x), percentile), distance)
    if len(peaks) < 3:
        return x.copy()
    cuts = np.concatenate([[0], (peaks[1:] + peaks[:-1]) // 2, [len(x)]])
    n = length or int(np.median(np.diff(cuts)))
    bend = lambda y, m: np.interp(np.linspace(0, 1, m), np.linspace(0, 1, len(y)), y)
    template = np.mean([bend(x[a:b], n) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], 0)
    if smooth:
        w = max(1, n // 20)
        template = np.convolve(np.pad(template, (w // 2, w - 1 - w // 2), "edge"), np.ones(w) / w, "valid")
    out = np.empty(len(x))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        y, t = x[a:b], bend(template, b - a)
        scale = y.std() / t.std() if t.std() > 1e-15 else 0.0
        out[a:b] = (t - t.mean()) * scale + y.mean()
    return out


def fractional_boxcar(x: np.ndarray, period: float) -> np.ndarray:
    """Mean over a period that need not be whole: the causal boxcar's response, on the mirrored signal."""
    n = len(x)
    if period <= 1:
        return x.copy()
    if period >= n:
        return np.full(n, x.mean())
    pad = min(int(np.ceil(4 * period)), n - 1)
    y = np.concatenate([x[pad:0:-1], x, x[-2 : -pad - 2 : -1]])
    f = np.fft.rfftfreq(len(y))
    kernel = np.sinc(f * period) / np.sinc(f) * np.exp(-1j * np.pi * f * (period - 1))
    return np.fft.irfft(np.fft.rfft(y) * kernel, len(y))[pad : pad + n]


def gammainc(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function: series, or continued fraction."""
    if x <= 0:
        return 0.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return total * front
    b, c, d = x + 1 - a, 1e300, 1 / (x + 1 - a)
    h = d
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d, c = 1 / (an * d + b), b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return 1 - front * h


def gammaincinv(a: float, p: float) -> float:
    if p <= 0:
        return 0.0
    lo, hi = 0.0, 1.0
    while gammainc(a, hi) < p:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if gammainc(a, mid) < p else (lo, mid)
    return (lo + hi) / 2


def fit_rms(values: np.ndarray, clean: float = 0.25, dropout: float = 0.1, quantiles: tuple[float, float] = (0.022, 0.6), shapes: np.ndarray | None = None) -> tuple[float, float]:
    """Robust (mu, sigma) of window amplitudes: the truncated generalised Gaussian nearest to the binned counts.

    Searched over where the clean part begins, how much it takes and its shape; median and deviation as a fallback.
    """
    x = np.sort(values[np.isfinite(values)])
    n = len(x)
    shapes = np.arange(1.7, 3.51, 0.15) if shapes is None else shapes
    q = np.array(quantiles)
    best = None
    if n >= 5 and x[-1] > x[0]:
        widths = np.arange(q[1] - q[0], clean * (q[1] - q[0]) - 1e-12, -0.01)
        offsets = np.arange(q[0], q[0] + dropout + 1e-12, 0.01)
        bounds = {b: np.sign(q - 0.5) * np.array([gammaincinv(1 / b, s * (2 * v - 1)) ** (1 / b) for v, s in zip(q, np.sign(q - 0.5), strict=True)]) for b in shapes}
        for w in widths:
            m = int(w * n + 0.5)
            if m < 2:
                continue
            bins = max(1, int(3 * math.log2(1 + m / 2) + 0.5))
            for o in offsets:
                lo = int(o * n + 0.5)
                part = x[lo : lo + m]
                if len(part) < 2 or part[-1] <= part[0]:
                    continue
                counts = np.bincount(np.minimum(((part - part[0]) / (part[-1] - part[0]) * bins).astype(int), bins - 1), minlength=bins)
                logs = np.log(counts + 0.01)
                for b in shapes:
                    z = bounds[b]
                    p = np.exp(-np.abs(z[0] + (np.arange(bins) + 0.5) / bins * (z[1] - z[0])) ** b)
                    p /= p.sum()
                    cost = float((p * (np.log(p) - logs)).sum() + math.log(m))
                    if best is None or cost < best[0]:
                        best = cost, b, part[0], part[-1], z
    if best is None:
        mad = 1.4826 * np.median(np.abs(x - np.median(x))) if n else 0.0
        return (float(np.median(x)) if n else 0.0), float(mad if mad > 0 else (x.std(ddof=1) if n > 1 else 0.0))
    _, b, lo, hi, z = best
    alpha = (hi - lo) / (z[1] - z[0])
    return float(lo - z[0] * alpha), float(math.sqrt(alpha**2 * math.gamma(3 / b) / math.gamma(1 / b)))


def yule_walker(order: int, freqs: np.ndarray, gains: np.ndarray, points: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Recursive filter whose magnitude fits gains at frequencies (0 to 1): denominator from the autocorrelation by the
    modified normal equations, numerator by least squares on its response; both made minimum phase."""
    grid = np.linspace(0, 1, points + 1)
    want = np.interp(grid, freqs, gains)
    r = np.fft.irfft(want**2)
    rows = 4 * order
    m = np.array([[r[abs(order + k - j)] for j in range(1, order + 1)] for k in range(1, rows + 1)])
    a = np.concatenate([[1.0], np.linalg.lstsq(m, -np.array([r[order + k] for k in range(1, rows + 1)]), rcond=None)[0]])
    a = stable(a)
    w = np.exp(-1j * np.pi * grid[:, None] * np.arange(order + 1))
    power = want**2 * np.abs(w @ a) ** 2
    # The numerator of minimum phase with that power: exponent of the causal half of its cepstrum.
    c = np.fft.irfft(np.log(np.maximum(power, 1e-20)) / 2)
    n = len(c)
    fold = np.zeros(n)
    fold[0], fold[1 : n // 2], fold[n // 2] = c[0], 2 * c[1 : n // 2], c[n // 2]
    h = np.exp(np.fft.rfft(fold))
    b = np.linalg.lstsq(np.concatenate([w.real, w.imag]), np.concatenate([h.real, h.imag]), rcond=None)[0]
    return stable(b) if abs(b[0]) > 1e-12 else b, a


def stable(a: np.ndarray) -> np.ndarray:
    """Roots outside the unit circle turned inside."""
    v = np.roots(a)
    out = np.abs(v) > 1
    v[out] = 1 / np.conj(v[out])
    return np.real(np.poly(v)) * a[0]


def shaping_filter(rate: float) -> tuple[np.ndarray, np.ndarray]:
    """Eighth-order filter that stresses bands where artifacts dominate. Frequencies and gains are fixed values."""
    freqs = np.array([0, 2, 3, 13, 16, 40, min(80.0, rate / 2 - 1), rate / 2]) * 2 / rate
    gains = np.array([3, 0.75, 0.33, 0.33, 1, 1, 3, 3])
    ok = np.concatenate([[True], np.diff(np.minimum(freqs, 1)) > 0])
    return yule_walker(8, np.minimum(freqs, 1)[ok], gains[ok])


def kmeans(x: np.ndarray, k: int, seed: int = 0, rounds: int = 100) -> np.ndarray:
    """Labels by Lloyd's rounds from far-apart seeds."""
    rng = np.random.default_rng(seed)
    c = [x[rng.integers(len(x))]]
    for _ in range(k - 1):
        d = np.min([((x - m) ** 2).sum(1) for m in c], 0)
        c.append(x[rng.choice(len(x), p=d / d.sum())] if d.sum() > 0 else x[rng.integers(len(x))])
    c, label = np.array(c), np.zeros(len(x), int)
    for _ in range(rounds):
        new = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
        if (new == label).all() and _:
            break
        label = new
        for j in range(k):
            if (label == j).any():
                c[j] = x[label == j].mean(0)
    return label


def gev_mode(x: np.ndarray) -> float:
    """Mode of the generalised extreme value distribution fitted by likelihood (simplex search)."""
    scale = np.median(x) or 1.0
    y = x / scale

    def cost(p: np.ndarray) -> float:
        mu, ls, c = p
        z = (y - mu) / math.exp(ls)
        if abs(c) < 1e-6:
            return float(len(y) * ls + (z + np.exp(-z)).sum())
        w = 1 - c * z
        if (w <= 0).any():
            return 1e300
        return float(len(y) * ls - (1 / c - 1) * np.log(w).sum() + (w ** (1 / c)).sum())

    s = y.std() * math.sqrt(6) / math.pi or 1e-3
    p = simplex(cost, np.array([y.mean() - 0.5772 * s, math.log(s), 0.05]))
    mu, sigma, c = p[0], math.exp(p[1]), p[2]
    mode = mu + sigma * (1 - (1 - c) ** c) / c if c < 1 and abs(c) > 1e-9 else mu
    return float(mode * scale)


def simplex(f, start: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Nelder and Mead's search."""
    n = len(start)
    pts = [start, *(start + (0.1 * (abs(start[i]) or 1)) * np.eye(n)[i] for i in range(n))]
    val = [f(p) for p in pts]
    for _ in range(rounds):
        order = np.argsort(val, kind="stable")
        pts, val = [pts[i] for i in order], [val[i] for i in order]
        if val[-1] - val[0] < 1e-10:
            break
        mid = np.mean(pts[:-1], 0)
        r = mid + (mid - pts[-1])
        fr = f(r)
        if fr < val[0]:
            e = mid + 2 * (mid - pts[-1])
            fe = f(e)
            pts[-1], val[-1] = (e, fe) if fe < fr else (r, fr)
        elif fr < val[-2]:
            pts[-1], val[-1] = r, fr
        else:
            c = mid + 0.5 * ((r if fr < val[-1] else pts[-1]) - mid)
            fc = f(c)
            if fc < min(fr, val[-1]):
                pts[-1], val[-1] = c, fc
            else:
                pts = [pts[0], *(pts[0] + 0.5 * (p - pts[0]) for p in pts[1:])]
                val = [val[0], *(f(p) for p in pts[1:])]
    return pts[int(np.argmin(val))]
