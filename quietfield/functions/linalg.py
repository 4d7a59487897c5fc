"""Small dense problems that a fit leaves to the driver: matrices of channels, never of samples."""

from __future__ import annotations

import numpy as np


def descending(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    v, u = np.linalg.eigh((c + c.T) / 2)
    return v[::-1], u[:, ::-1]


def whitener(cov: np.ndarray, rank: int | None = None, reg: float = 1e-9) -> tuple[np.ndarray, np.ndarray]:
    """(whitener, dewhitener): leading directions with a variance above ``reg`` of the largest."""
    v, u = descending(cov)
    if v[-1] < -1e-10 * max(abs(v[0]), 1e-300):
        raise ValueError("a covariance matrix has a negative direction")
    k = min(int((v > reg * v[0]).sum()), rank or len(v))
    s = np.sqrt(v[:k])
    return (u[:, :k] / s).T, u[:, :k] * s


def dss(base: np.ndarray, biased: np.ndarray, components: int | None = None, rank: int | None = None, reg: float = 1e-9) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(filters, patterns, scores): directions by the share of the biased covariance, at unit variance of the base."""
    w, _ = whitener(base, rank, reg)
    score, v = descending(w @ biased @ w.T)
    a = w.T @ v
    a = a / np.sqrt(np.maximum(np.einsum("ij,ik,kj->j", a, base, a), 1e-15))
    k = components or a.shape[1]
    return a.T[:k], (base @ a)[:, :k], score[:k]


def cca(xx: np.ndarray, yy: np.ndarray, xy: np.ndarray, reg: float = 1e-12) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(A, B, r) of centred covariances: variates x A and y B of unit variance, correlations falling within [0, 1]."""
    wx, _ = whitener(xx, reg=reg)
    wy, _ = whitener(yy, reg=reg)
    u, r, v = np.linalg.svd(wx @ xy @ wy.T, full_matrices=False)
    return wx.T @ u, wy.T @ v.T, np.clip(r, 0, 1)


def outliers(scores, sigma: float = 3.0) -> int:
    """How many scores lie above mean + sigma deviations, taken away again and again."""
    x, n = np.asarray(scores, float), 0
    while len(x) > 2 and x.std() >= 1e-12:
        out = x > x.mean() + sigma * x.std()
        if not out.any():
            break
        n += int(out.sum())
        x = x[~out]
    return n


def knee(scores, floor: float = 0.01, ratio: float = 3.0) -> int:
    """Scores before the steepest fall of their logarithm, if it starts high enough and is a factor of ``ratio``."""
    x = np.asarray(scores, float)
    if len(x) < 2 or x.max() <= 0:
        return 0
    logs = np.log10(np.maximum(x, x.max() * 1e-12))
    drop = np.where(x[:-1] > floor * x.max(), logs[:-1] - logs[1:], -np.inf)
    k = int(drop.argmax())
    return k + 1 if drop[k] >= np.log10(ratio) else 0


def component_count(scores, sigma: float = 3.0, floor: float = 0.01, ratio: float = 3.0) -> int:
    s = np.asarray(scores, float)
    return max(outliers(s, sigma), knee(s[: len(s) // 2 + 1], floor, ratio))


def spd_map(c: np.ndarray, f, reg: float = 1e-12) -> np.ndarray:
    """f of the eigenvalues, floored at ``reg`` of the scale of the matrix."""
    v, u = np.linalg.eigh((c + c.T) / 2)
    return (u * f(np.maximum(v, reg * max(abs(np.trace(c)) / len(c), v[-1], 1e-300)))) @ u.T


def geometric_median(mats: np.ndarray, weights: np.ndarray | None = None, rounds: int = 128, tol: float = 1e-7) -> np.ndarray:
    """Weiszfeld's iteration from the mean; mats is (n, ...)."""
    x = mats.reshape(len(mats), -1)
    w0 = np.ones(len(x)) if weights is None else weights
    m = (x * w0[:, None]).sum(0) / w0.sum()
    for _ in range(rounds):
        d = np.linalg.norm(x - m, axis=1)
        w = w0 / np.maximum(d, 1e-12 * max(d.max(), 1e-300))
        new = (x * w[:, None]).sum(0) / w.sum()
        done = np.linalg.norm(new - m) <= tol * max(np.linalg.norm(m), 1e-300)
        m = new
        if done:
            break
    return m.reshape(mats.shape[1:])


def karcher_mean(mats: np.ndarray, rounds: int = 32, tol: float = 1e-7) -> np.ndarray:
    """Affine-invariant mean of covariance matrices, by averages in the tangent space."""
    m = mats.mean(0)
    for _ in range(rounds):
        h, ih = spd_map(m, np.sqrt), spd_map(m, lambda v: 1 / np.sqrt(v))
        step = np.mean([spd_log(ih @ c @ ih) for c in mats], 0)
        v, u = np.linalg.eigh(step)
        m = h @ ((u * np.exp(v)) @ u.T) @ h
        if np.linalg.norm(step) < tol:
            break
    return m


def spd_log(c: np.ndarray) -> np.ndarray:
    return spd_map(c, np.log)


def neighbour_weights(cov: np.ndarray, neighbours: int = 0, skip: int = 0, rcond: float = 1e-12) -> np.ndarray:
    """Rows that give each channel from its most correlated others (all, if 0), the first ``skip`` left out."""
    n = len(cov)
    d = np.diag(cov)
    r2 = cov**2 / np.maximum(np.outer(d, d), 1e-300)
    out = np.zeros((n, n))
    for i in range(n):
        order = [j for j in np.argsort(-r2[i], kind="stable") if j != i and d[j] > 0][skip:]
        near = order[: neighbours or len(order)]
        if near and d[i] > 0:
            out[i, near] = np.linalg.pinv(cov[np.ix_(near, near)], rcond=rcond) @ cov[near, i]
    return out


def prediction_errors(a: np.ndarray) -> np.ndarray:
    """Rows that leave of each channel what a regression on all others does not give, by the inverse of a regularised
    covariance: its row, at 1 for the channel itself."""
    p = np.linalg.inv(a)
    return p / np.diag(p)[:, None]


def sensor_noise(gram: np.ndarray, ridge: float | None = None) -> np.ndarray:
    """Deviation of each channel from its prediction by all others; the ridge is the mean power unless given."""
    e = prediction_errors(gram + (np.mean(np.diag(gram)) if ridge is None else ridge) * np.eye(len(gram)))
    return np.sqrt(np.maximum(np.einsum("ij,jk,ik->i", e, gram, e), 1e-300))


def _whitened_model(model: np.ndarray, noise: np.ndarray, lam: float, without: int | None = None) -> np.ndarray:
    """The model's covariance in units of noise, with a ridge of ``lam`` of its mean power (of the other channels)."""
    g = model / np.outer(noise, noise)
    power = np.delete(np.diag(g), without) if without is not None else np.diag(g)
    return g + lam * power.mean() * np.eye(len(g))


def sound(gram: np.ndarray, lead: np.ndarray, lam: float = 0.1, rounds: int = 5, seed: int = 0, tol: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(operator, noise) of the source-informed Wiener estimate; gram is the data's mean x x'.

    In each round every channel, in random order, is predicted from the others by minimum norm sources with the noise
    known so far; what is left is its noise from then on.
    """
    rng, model = np.random.default_rng(seed), lead @ lead.T
    noise = sensor_noise(gram)
    for _ in range(rounds):
        before = noise.copy()
        for i in rng.permutation(len(gram)):
            e = prediction_errors(_whitened_model(model, noise, lam, i))[i] / noise * noise[i]
            noise[i] = np.sqrt(max(e @ gram @ e, 1e-300))
        if tol is not None and (abs(noise / before - 1) < tol).all():
            break
    return model / noise @ np.linalg.inv(_whitened_model(model, noise, lam)) / noise, noise


def sound_with_best_reference(gram: np.ndarray, lead: np.ndarray, lam: float = 0.1, rounds: int = 5, seed: int = 0) -> tuple[np.ndarray, np.ndarray, int]:
    """(operator, noise, channel): data and lead field are referred to the channel of least noise, and the result to
    the mean of all channels, as one operator."""
    n = len(gram)
    best = int(sensor_noise(gram).argmin())
    refer = np.eye(n) - np.eye(n)[best][None]
    others = np.delete(np.arange(n), best)  # the reference itself is flat
    r = refer[others]
    m, noise = sound(r @ gram @ r.T, r @ lead, lam, rounds, seed)
    back = np.zeros((n, n - 1))
    back[others] = np.eye(n - 1)
    return (np.eye(n) - 1 / n) @ back @ m @ r, noise, best


def riemannian_eigenspace(c: np.ndarray, alpha: float = 1.0, reg: float = 1e-8) -> tuple[np.ndarray, np.ndarray]:
    """Rising eigenvalues and directions of c + alpha diag(c^-1 1): the nonlinear eigenspace's first approximation. One
    matrix, or a stack of them."""
    v, u = np.linalg.eigh((c + np.swapaxes(c, -1, -2)) / 2)
    scale = np.maximum(np.maximum(np.abs(np.trace(c, axis1=-2, axis2=-1)) / c.shape[-1], v[..., -1]), 1e-300)
    v = np.maximum(v, reg * scale[..., None])
    ones = (u / v[..., None, :]) @ u.sum(-2)[..., None]  # c^-1 1
    m = (u * v[..., None, :]) @ np.swapaxes(u, -1, -2) + alpha * np.eye(c.shape[-1]) * ones
    return np.linalg.eigh((m + np.swapaxes(m, -1, -2)) / 2)


def unit_columns(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=0), 1e-300)


def to_sensor_space(filters: np.ndarray, patterns: np.ndarray, whitener: np.ndarray, dewhitener: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Filters and patterns of whitened data as those of the sensors."""
    return filters @ whitener, dewhitener @ patterns


def spherical_points(n: int) -> np.ndarray:
    """Unit vectors on a golden spiral."""
    k = np.arange(n) + 0.5
    z, a = 1 - 2 * k / n, np.pi * (1 + np.sqrt(5)) * k
    r = np.sqrt(np.maximum(1 - z * z, 0))
    return np.stack([r * np.cos(a), r * np.sin(a), z], 1)


def description_length(values: np.ndarray, n: int) -> int:
    """Order of least description length of falling eigenvalues over n observations."""
    v = np.maximum(np.asarray(values, float), 1e-300)
    d = len(v)
    best = []
    for p in range(d):
        tail = v[p:]
        best.append(-n * (d - p) * (np.log(tail).mean() - np.log(tail.mean())) + 0.5 * (p * d - p * (p - 1) / 2 + 1) * np.log(n))
    return int(np.argmin(best))


def ssa(x: np.ndarray, window: int) -> np.ndarray:
    """Components (k, n) of a series by singular spectrum analysis."""
    h = np.lib.stride_tricks.sliding_window_view(x, window).T
    u, s, v = np.linalg.svd(h, full_matrices=False)
    keep = s > s[0] * max(h.shape) * np.finfo(float).eps if s[0] > 0 else s > 0
    return np.array([diagonal_mean(np.outer(u[:, k] * s[k], v[k])) for k in np.flatnonzero(keep)]).reshape(-1, len(x))


def diagonal_mean(m: np.ndarray) -> np.ndarray:
    rows, cols = m.shape
    at = (np.arange(rows)[:, None] + np.arange(cols)[None]).ravel()
    return np.bincount(at, m.ravel()) / np.bincount(at)


def w_correlation(components: np.ndarray, window: int) -> np.ndarray:
    n = components.shape[1]
    i = np.arange(n)
    w = np.minimum(np.minimum(i + 1, n - i), min(window, n - window + 1))
    g = (components * w) @ components.T
    d = np.sqrt(np.maximum(np.diag(g), 1e-300))
    return g / np.outer(d, d)


def ssa_window(n: int, rate: float | None = None, window: int | None = None, most: int = 100) -> int:
    w = window or (int(0.5 * rate + 0.5) if rate else n // 2)
    return max(2, min(w, most, (n + 1) // 2))


def ssa_clean(x: np.ndarray, rate: float, window: int | None = None, drop_below: float = 3.0, band: tuple[float, float] | None = None, check: int | None = None) -> np.ndarray:
    """Without the components whose strongest frequency is low (or in a band)."""
    parts = ssa(x, ssa_window(len(x), rate, window))
    f = np.fft.rfftfreq(len(x), 1 / rate)[np.abs(np.fft.rfft(parts, axis=1)).argmax(1)]
    drop = (f <= drop_below) if band is None else (f >= band[0]) & (f <= band[1])
    drop[check if check is not None else len(drop) :] = False
    return x - parts[drop].sum(0)


def subspace_of(y: np.ndarray) -> tuple[np.ndarray, int]:
    """Rows as they are in the mean and the leading directions of all rows, as many as take the least description."""
    mean = y.mean(0)
    values, directions = descending(np.cov(y.T, bias=True))
    order = description_length(values, len(y))
    keep = directions[:, :order]
    return mean + (y - mean) @ keep @ keep.T, order


def cluster_part(rows: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, bool]:
    """What each cluster of rows holds in few directions, and whether every cluster has few: at most half of a row."""
    part, few = np.empty_like(rows), True
    for j in np.unique(label):
        part[label == j], order = subspace_of(rows[label == j])
        few &= 2 * order <= rows.shape[1]
    return part, few


def local_ssa_clean(x: np.ndarray, window: int | None = None, rate: float | None = None, clusters: int | None = None, seed: int = 0) -> np.ndarray:
    """Without what clusters of lag vectors hold in few directions; with the most clusters that are large enough for
    their directions and need few of them, down to one. A number given is taken if its clusters are large enough."""
    from quietfield.functions.kernels import kmeans

    size = ssa_window(len(x), rate, window)
    rows = np.lib.stride_tricks.sliding_window_view(x, size).astype(float)

    def parts():
        for k in (clusters,) if clusters else range(max(1, min(10, len(rows) // size)), 0, -1):
            label = kmeans(rows, k, seed)
            if k == 1 or np.bincount(label, minlength=k).min() >= size:
                part, few = cluster_part(rows, label)
                if few or k == 1 or clusters:
                    yield part

    part = next(parts(), None)
    return x.copy() if part is None else x - diagonal_mean(part.T)
