"""Canonical correlation with a delayed copy or with reference channels, and models of sensor noise."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quietfield.functions import kernels as K
from quietfield.functions import linalg as L
from quietfield.operators import segments, transforms, windows
from quietfield.operators.moments import gram
from quietfield.plans.model import Linear, apply_long, by_window, fitted_covariance
from quietfield.plans.tables import kept
from quietfield.sources.signals import by_sample, channels_of, long_from_samples


def joint_covariance(x: DataFrame, y: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """Centred covariance of the channels of x and then of y, at the samples of both."""
    both = by_sample(x).withColumnRenamed("xs", "a").join(by_sample(y).withColumnRenamed("xs", "b"), "t").select(F.concat("a", "b").alias("xs"))
    g, s, w, _ = gram(both)
    return g / w - np.outer(s / w, s / w), s / w, int(w)


def correlate(x: DataFrame, y: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    k = len(channels_of(x))
    c, mean, _ = joint_covariance(x, y)
    return *L.cca(c[:k, :k], c[k:, k:], c[:k, k:]), mean


def delayed_cca(signal: DataFrame, lag: int, remove: int | None = None, threshold: float | None = None, low: bool = True) -> tuple[Linear, list[int]]:
    """Components of the signal by correlation with itself ``lag`` before, and which go: a count, or those below
    (above) a threshold."""
    names = channels_of(signal)
    pairs = windows.lagged_pairs(signal, lag)
    a, _, r, mean = correlate(pairs.select("channel", "t", "x"), pairs.select("channel", "t", F.col("past").alias("x")))
    cov, own_mean, _ = fitted_covariance(signal)
    f = a.T
    model = Linear(names, f, cov @ f.T @ np.linalg.inv(f @ cov @ f.T), r, own_mean)
    order = np.argsort(r if low else -r, kind="stable")
    gone = order[:remove].tolist() if remove is not None else np.flatnonzero(r < threshold if low else r > threshold).tolist() if threshold is not None else []
    return model, sorted(gone)


FITTED = "k long, m array<double>, mean array<double>, component int, r double, autocorrelation double, asymmetry double, kept boolean"


def delayed_cca_blocks(signal: DataFrame, n: int, size: int, hop: int, lag: int, remove: int | None = None, threshold: float | None = None, low: bool = True, squared: bool = False) -> tuple[DataFrame, DataFrame]:
    """(cleaned, components) by a delayed correlation for each block of ``size`` samples every ``hop``, blended where they
    overlap; the last block ends with the signal. ``remove`` components go, or those whose correlation (its square, if
    ``squared``) is below the threshold; the others with ``low`` False. Means stay.

    One aggregation gives the moments of all blocks: of every sample, and of pairs that don't leave their block.
    components: (k, component, r, autocorrelation, asymmetry, kept). A block with no more pairs than channels is refused,
    as its correlations would all be 1.
    """
    if (remove is None) == (threshold is None):
        raise ValueError("give the number of components to remove or a threshold, one of both")
    names = channels_of(signal)
    c, size = len(names), min(size, n)
    if min(size, n) - lag <= c:
        raise ValueError(f"{size - lag} pairs of samples are too few for {c} channels")
    if remove is not None and remove > c:
        raise ValueError(f"{remove} components of {c} can't go")
    spans, cell = segments.blocks(signal.sparkSession, n, size, hop), min(size, 1 << 14)
    samples = by_sample(signal)
    past = samples.select((F.col("t") + lag).alias("t"), F.col("xs").alias("past"))
    met = segments.spread(samples.join(past, "t", "left"), spans, cell).withColumn("past", F.when(F.col("t") - lag >= F.col("lo"), F.col("past")))
    sums = segments.moments(met, ["xs"]).withColumnRenamed("sums", "own").join(segments.moments(met, ["xs", "past"]).withColumnRenamed("sums", "pairs"), "k")

    def fit(k: int, sums: dict[str, np.ndarray]) -> list[tuple]:
        cov, mean, _ = segments.centred(sums["own"])
        both, _, _ = segments.centred(sums["pairs"])
        xx, yy, xy = both[:c, :c], both[c:, c:], both[:c, c:]
        a, b, r = L.cca(xx, yy, xy)
        f = a.T
        patterns = cov @ f.T @ np.linalg.pinv(f @ cov @ f.T)
        signed = np.einsum("ki,ij,kj->k", f, xy, f) / np.sqrt(np.maximum(np.einsum("ki,ij,kj->k", f, xx, f) * np.einsum("ki,ij,kj->k", f, yy, f), 1e-300))
        size = r**2 if squared else r
        if remove is not None:
            keep = np.arange(len(r)) < len(r) - remove if low else np.arange(len(r)) >= remove
        else:
            keep = size >= threshold if low else size <= threshold
        m, apart = (patterns[:, keep] @ f[keep]).ravel().tolist(), filter_asymmetry(a, b)
        return [(k, m if i == 0 else None, mean.tolist() if i == 0 else None, i, float(r[i]), float(signed[i]), float(apart[i]), bool(keep[i])) for i in range(len(r))]

    fitted = kept(segments.fits(sums, fit, FITTED), "fits")
    cleaned = segments.applied(signal, names, spans, fitted.where("component = 0").select("k", "m", "mean"), cell)
    return cleaned, fitted.drop("m", "mean")


def clean_window(x: np.ndarray, y: np.ndarray, threshold: float = 0.7, most: float = 0.5, basis: str = "X") -> tuple[np.ndarray, int]:
    """x (channels by time) without its variates (or those of the references) that correlate with the references."""
    xc, yc = x - x.mean(1, keepdims=True), y - y.mean(1, keepdims=True)
    n = x.shape[1]
    try:
        a, b, r = L.cca(xc @ xc.T / n, yc @ yc.T / n, xc @ yc.T / n)
    except (ValueError, np.linalg.LinAlgError):
        return x, 0
    k = int((r**2 >= threshold).sum())
    if most < 1:
        k = min(k, max(1, int(most * len(r)))) if most > 0 else 0
    if k == 0:
        return x, 0
    parts = {"X": [a[:, :k].T @ xc], "Y": [b[:, :k].T @ yc], "both": [a[:, :k].T @ xc, b[:, :k].T @ yc]}[basis]
    z = np.vstack(parts)
    return x - (xc @ z.T) @ np.linalg.pinv(z @ z.T) @ z, k


def null_shifts(n: int, rounds: int, seed: int) -> np.ndarray:
    """Random circular shifts that stay a tenth of the samples away from none; any, where that leaves none."""
    low = max(1, int(0.1 * n))
    low, high = (low, n - low) if n - low > low else (1, n)
    return np.random.default_rng(seed).integers(low, high, rounds) if high > low else np.ones(rounds, np.int64)


def null_squares(xx: np.ndarray, yy: np.ndarray, xy: np.ndarray) -> np.ndarray:
    """Largest squared canonical correlation for each cross-covariance of a stack; 1 where there is none to be had."""
    try:
        wx, wy = L.whitener(xx, reg=1e-12)[0], L.whitener(yy, reg=1e-12)[0]
        return np.clip(np.linalg.svd(wx @ xy @ wy.T, compute_uv=False).max(-1), 0, 1) ** 2
    except (ValueError, np.linalg.LinAlgError):
        return np.ones(len(xy))


def null_correlations(x: np.ndarray, y: np.ndarray, rounds: int = 100, seed: int = 0) -> np.ndarray:
    """Largest squared correlation of x (channels by time) with references turned round, for each random shift.

    A turn leaves covariances as they are, and one cross-spectrum has the cross-covariances of all shifts.
    """
    n = x.shape[1]
    xc, yc = x - x.mean(1, keepdims=True), y - y.mean(1, keepdims=True)
    cross = np.fft.irfft(np.fft.rfft(xc)[:, None] * np.conj(np.fft.rfft(yc))[None], n) / n
    return null_squares(xc @ xc.T / n, yc @ yc.T / n, np.moveaxis(cross[:, :, null_shifts(n, rounds, seed)], 2, 0))


def null_threshold(x: np.ndarray, y: np.ndarray, alpha: float = 0.05, rounds: int = 100, seed: int = 0) -> float:
    """The quantile of null_correlations() that correlations without any common part exceed with probability alpha."""
    return float(np.quantile(null_correlations(x, y, rounds, seed), 1 - alpha))


def _together(signal: DataFrame, references: DataFrame) -> DataFrame:
    """Channels of both, those of the signal first in order of name."""
    return signal.select(F.concat(F.lit("0"), "channel").alias("channel"), "t", "x").unionByName(references.select(F.concat(F.lit("1"), "channel").alias("channel"), "t", "x"))


def null_thresholds(signal: DataFrame, references: DataFrame, rate: float, n: int, seconds: float = 2.0, overlap: float = 0.0, alpha: float = 0.05, rounds: int = 100, seed: int = 0) -> DataFrame:
    """(start, stop, threshold, highest) of each window: the quantile over its replicates, and the largest of them.
    Windows are tasks of their own; replicates are rows."""
    k = len(channels_of(signal))
    size = max(2, min(n, int(seconds * rate)))

    def run(start: int, stop: int, t: np.ndarray, x: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"start": start, "stop": stop, "square": null_correlations(x[:k], x[k:], rounds, seed)})

    made = by_window(_together(signal, references), size, max(1, round(size * (1 - overlap))), n, run, "start long, stop long, square double")
    return made.groupBy("start", "stop").agg(F.percentile("square", 1 - alpha).alias("threshold"), F.max("square").alias("highest"))


def global_null_threshold(signal: DataFrame, references: DataFrame, n: int, alpha: float = 0.05, rounds: int = 100, seed: int = 0) -> float:
    """The same over a whole recording, whatever its length: cross-spectra by transforms over many tasks, and of their
    inverse the places of the shifts alone."""
    names, others = channels_of(signal), channels_of(references)
    c, mean, _ = joint_covariance(signal, references)
    k = len(names)
    z = lambda s, i: transforms.spectrum(s, n).select(F.col("channel").alias(i), "bin", F.col("re").alias(f"re_{i}"), F.col("im").alias(f"im_{i}")).where("bin > 0")
    met = z(signal, "a").join(z(references, "b"), "bin")  # without bin 0, so of what is left of the mean
    re, im = F.col("re_a") * F.col("re_b") + F.col("im_a") * F.col("im_b"), F.col("im_a") * F.col("re_b") - F.col("re_a") * F.col("im_b")
    pairs = met.select(F.to_json(F.struct("a", "b")).alias("channel"), "bin", re.alias("re"), im.alias("im"))
    shifts = null_shifts(n, rounds, seed)
    back = transforms.from_spectrum(pairs, n).where(F.col("t").isin(sorted(set(shifts.tolist())))).select(F.from_json("channel", "a string, b string").alias("p"), "t", "x")
    cross = {(r.p.a, r.p.b, r.t): r.x / n for r in back.collect()}  # channels by references by shifts
    xy = np.array([[[cross[a, b, s] for b in others] for a in names] for s in shifts.tolist()])
    return float(np.quantile(null_squares(c[:k, :k], c[k:, k:], xy), 1 - alpha))


def reference_clean(signal: DataFrame, references: DataFrame, rate: float, n: int, seconds: float = 2.0, overlap: float = 0.0, threshold: float = 0.7, most: float = 0.5, basis: str = "X", null: float | None = None) -> DataFrame:
    """Windows without what they share with references, averaged where they overlap. Windows are tasks of their own. With
    ``null``, each window's threshold is what chance exceeds with that probability, by its own null_threshold()."""
    names, others = channels_of(signal), channels_of(references)
    size = max(2, min(n, int(seconds * rate)))
    step = max(1, round(size * (1 - overlap)))
    k = len(names)

    def run(start: int, stop: int, t: np.ndarray, x: np.ndarray) -> pd.DataFrame:
        inside = (t >= start) & (t < stop)
        own = threshold if null is None else null_threshold(x[:k, inside], x[k:, inside], null)
        y = clean_window(x[:k, inside], x[k:, inside], own, most, basis)[0] if inside.sum() > k + len(others) else x[:k, inside]
        return pd.DataFrame({"t": t[inside], "xs": list(y.T)})

    done = by_window(_together(signal, references), size, step, n, run, "t long, xs array<double>")
    return long_from_samples(done, names).groupBy("channel", "t").agg(F.avg("x").alias("x"))


def rereferenced(signal: DataFrame, full_rank: bool = False) -> DataFrame:
    """Each sample less its mean over channels (over channels and one more, which keeps the rank)."""
    mean = signal.groupBy("t").agg((F.sum("x") / (F.count("*") + (1 if full_rank else 0))).alias("m"))
    return signal.join(mean, "t").select("channel", "t", (F.col("x") - F.col("m")).alias("x"))


def suppress_sensor_noise(signal: DataFrame, neighbours: int = 0, skip: int = 0, rounds: int = 1) -> tuple[DataFrame, np.ndarray]:
    """Each channel from its neighbours; rounds work on the covariance alone and compose to one operator."""
    cov, mean, _ = fitted_covariance(signal)
    m = np.eye(len(cov))
    for _ in range(rounds):
        w = L.neighbour_weights(cov, neighbours, skip)
        m, cov = w @ m, w @ cov @ w.T
    return apply_long(signal, m, mean), m


def source_informed(signal: DataFrame, lead: np.ndarray, lam: float = 0.1, rounds: int = 5, seed: int = 0) -> tuple[DataFrame, np.ndarray]:
    """Wiener estimate by a lead field (channels by sources), each channel weighted by its noise."""
    g, _, w, _ = gram(by_sample(signal))
    m, _ = L.sound(g / w, lead, lam, rounds, seed)
    return apply_long(signal, m), m


def artifact_topographies(signal: DataFrame, rate: float, high_pass: float, components: int | float) -> np.ndarray:
    """Leading spatial directions of the high-passed signal: a count, or a share of variance."""
    from quietfield.operators.filters import Cascade, zero_phase

    sos = K.butter_sos(2, [high_pass], "highpass", rate)
    cov, _, _ = fitted_covariance(zero_phase(rereferenced(signal), Cascade.of_sos(sos)))
    v, u = L.descending(cov)
    k = int(components) if components >= 1 else int(np.searchsorted(np.cumsum(v) / v.sum(), components) + 1)
    return u[:, :k]


def projected_recovery(signal: DataFrame, lead: np.ndarray, topographies: np.ndarray, rank: int) -> DataFrame:
    """Artifact directions projected out, and the loss made good by the lead field: L (P L)^+ P, at a rank."""
    p = np.eye(len(lead)) - topographies @ topographies.T
    u, s, v = np.linalg.svd(p @ lead, full_matrices=False)
    k = min(rank, int((s > s[0] * 1e-10).sum()))
    return apply_long(signal, lead @ (v[:k].T / s[:k]) @ u[:, :k].T @ p)


def component_slopes(sources: DataFrame, rate: float, low: float, high: float) -> DataFrame:
    from quietfield.operators.spectral import slopes, welch

    return slopes(welch(sources, rate, int(rate)), low, high)


def signed_autocorrelations(sources: DataFrame, lag: int) -> DataFrame:
    """(channel, r) of each component with itself ``lag`` before, at the sign it has."""
    return windows.lagged_pairs(sources, lag).groupBy("channel").agg(F.corr("x", "past").alias("r"))


def filter_asymmetry(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How far the filters of both sides (columns) are apart, at unit length and the nearer of both signs."""
    u, v = L.unit_columns(a), L.unit_columns(b)
    return np.minimum(np.linalg.norm(u - v, axis=0), np.linalg.norm(u + v, axis=0))


def source_informed_best_reference(signal: DataFrame, lead: np.ndarray, lam: float = 0.1, rounds: int = 5, seed: int = 0) -> tuple[DataFrame, int]:
    """As source_informed, referred to the channel of least noise and then to the mean; and which channel that was."""
    g, _, w, _ = gram(by_sample(signal))
    m, _, best = L.sound_with_best_reference(g / w, lead, lam, rounds, seed)
    return apply_long(signal, m), best
