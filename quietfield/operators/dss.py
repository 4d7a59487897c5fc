"""Denoising source separation: directions in which a bias keeps most of the variance."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quietfield.functions import kernels as K
from quietfield.functions import linalg as L
from quietfield.operators import segments, spans, spectral, windows
from quietfield.operators.moments import covariance
from quietfield.plans.model import Linear, apply_long, fitted_covariance
from quietfield.sources.signals import by_sample, channels_of


def fit(signal: DataFrame, biased: DataFrame, components: int | None = None, rank: int | None = None, reg: float = 1e-9, normalize: bool = True) -> Linear:
    """From a signal and what a bias leaves of it. Channels are scaled to unit norm first, unless told not to."""
    names = channels_of(signal)
    base, mean, w = fitted_covariance(signal)
    other, _, _ = covariance(by_sample(biased))
    scale = np.sqrt(np.maximum(np.diag(base) + mean**2, 1e-300) * w) if normalize else np.ones(len(names))
    f, p, s = L.dss(base / np.outer(scale, scale), other / np.outer(scale, scale), components, rank, reg)
    return Linear(names, f / scale, p * scale[:, None], s, mean)


def select(model: Linear, count: int | str = "auto") -> list[int]:
    n = L.component_count(model.scores) if count == "auto" else int(count)
    return list(range(min(n, len(model.scores))))


def smooth(signal: DataFrame, window: int = 10, **kw) -> Linear:
    return fit(signal, windows.running_mean(signal, window), **kw)


def narrowband(signal: DataFrame, rate: float, freq: float, width: float = 2.0, **kw) -> Linear:
    return fit(signal, spectral.bandpass(signal, rate, freq - width / 2, freq + width / 2), **kw)


def comb(signal: DataFrame, rate: float, freq: float, harmonics: int = 3, **kw) -> Linear:
    return fit(signal, spectral.comb(signal, rate, freq, harmonics), **kw)


def narrowband_scan(signal: DataFrame, rate: float, freqs: list[float], width: float = 2.0) -> list[tuple[float, float | None, str | None]]:
    """(frequency, leading score, what failed) for each."""
    out = []
    for f in freqs:
        try:
            out.append((f, float(narrowband(signal, rate, f, width).scores[0]), None))
        except (ValueError, np.linalg.LinAlgError) as e:
            out.append((f, None, str(e)))
    return out


def epochs(data: DataFrame, **kw) -> Linear:
    """With the mean over epochs as bias; data is (channel, epoch, t, x)."""
    flat = lambda d: d.select("channel", (F.col("epoch") * (1 << 40) + F.col("t")).alias("t"), "x")
    return fit(flat(data), flat(spans.epoch_average(data)), **kw)


def time_shifted(data: DataFrame, lags: list[int], rank: int, components: int = 1) -> tuple[Linear, DataFrame]:
    """Epoch-average separation over channels and lags (positive: the past), and the channels it works on.

    Lags never cross an epoch: each epoch of a channel is a series of its own.
    """
    series = data.select(F.concat_ws("|", "channel", F.col("epoch").cast("string")).alias("channel"), "t", "x")
    moved = windows.lag_features(series, lags)
    parts = F.split("channel", r"\|(?=[^|]*$)")
    wide = moved.select(F.concat_ws("@", parts[0], F.format_string("%+06d", F.col("lag"))).alias("channel"), parts[1].cast("long").alias("epoch"), "t", "x")
    return epochs(wide, rank=rank, components=components), wide


def evoked_share(sources: DataFrame) -> DataFrame:
    """Power of the mean over epochs over all power, of (channel, epoch, t, x)."""
    mean = sources.groupBy("channel", "t").agg(F.avg("x").alias("m")).groupBy("channel").agg(F.avg(F.col("m") * F.col("m")).alias("evoked"))
    total = sources.groupBy("channel").agg(F.avg(F.col("x") * F.col("x")).alias("total"))
    return mean.join(total, "channel").select("channel", (F.col("evoked") / F.col("total")).alias("score"))


CONTRASTS = {
    "tanh": (np.tanh, lambda s: -np.mean(1 - np.tanh(s) ** 2)),
    "pow3": (lambda s: s**3, lambda s: -3.0),
    "gauss": (lambda s: s * np.exp(-s * s / 2), lambda s: -np.mean((1 - s * s) * np.exp(-s * s / 2))),
    "skew": (lambda s: s * s, lambda s: 0.0),
}


def iterative(signal: DataFrame, components: int, contrast: str = "tanh", symmetric: bool = False, rounds: int = 100, tol: float = 1e-6, seed: int = 0, rank: int | None = None, gamma=None) -> tuple[Linear, list[tuple[int, bool]]]:
    """Fixed points w <- E[z f(w z)] + beta w on whitened samples; every round is one pass that adds up k x k matrices.

    Deflation takes directions one by one, against those found; otherwise all at once, made orthogonal together.
    ``gamma`` (gamma179, gamma_predictive) sets how much of each step is taken when directions go one by one.
    """
    names, (cov, mean, _) = channels_of(signal), fitted_covariance(signal)
    w0, dw0 = L.whitener(cov, rank)
    white = _cached(by_sample(signal))
    f, slope = CONTRASTS[contrast]
    d = len(w0)

    def pass_over(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sent = signal.sparkSession.sparkContext.broadcast((w, w0, mean))

        def run(frames):
            import pandas as pd

            w, w0, mean = sent.value
            total, n = np.zeros((len(w), w.shape[1] + 1)), 0
            for frame in frames:
                if len(frame):
                    z = (np.stack(frame["xs"].to_numpy()).astype(float) - mean) @ w0.T
                    s = z @ w.T
                    total[:, :-1] += f(s).T @ z
                    total[:, -1] += [slope(c) * len(c) for c in s.T]
                    n += len(z)
            yield pd.DataFrame({"k": np.arange(len(w)), "row": list(total), "n": n})

        got = white.select("xs").mapInPandas(run, "k int, row array<double>, n long").select("k", "n", F.posexplode("row").alias("j", "v")).groupBy("k", "j").agg((F.sum("v") / F.sum("n")).alias("v")).collect()
        out = np.zeros((len(w), w.shape[1] + 1))
        for r in got:
            out[r.k, r.j] = r.v
        return out[:, :-1], out[:, -1]

    rng, found, info = np.random.default_rng(seed), np.zeros((0, d)), []
    if symmetric:
        u, _, v = np.linalg.svd(rng.standard_normal((components, d)), full_matrices=False)
        w = u @ v
        for k in range(1, rounds + 1):
            e, b = pass_over(w)
            u, _, v = np.linalg.svd(e + b[:, None] * w, full_matrices=False)
            new = u @ v
            gap, w = 1 - np.abs((new * w).sum(1)).min(), new
            if gap < tol:
                break
        found, info = w, [(k, bool(gap < tol))] * components
    else:
        for _ in range(components):
            w = rng.standard_normal(d)
            w -= found.T @ (found @ w)
            w /= np.linalg.norm(w)
            share, last = 1.0, None
            for k in range(1, rounds + 1):
                e, b = pass_over(w[None])
                new = e[0] + b[0] * w
                new -= found.T @ (found @ new)
                size = np.linalg.norm(new)
                new = new / size if size > 1e-12 else rng.standard_normal(d)
                if gamma is not None:
                    step = (new if new @ w >= 0 else -new) - w
                    share = gamma(step, last, share)
                    new, last = w + share * step, step
                    new = new / np.linalg.norm(new)
                gap, w = 1 - abs(new @ w), new
                if gap < tol:
                    break
            found = np.vstack([found, w])
            info.append((k, bool(gap < tol)))
    filters, patterns = L.to_sensor_space(found, found.T, w0, dw0)
    return Linear(names, filters, patterns, np.ones(components), mean), info


def _cached(df: DataFrame) -> DataFrame:
    return df.persist()


def gamma179(step: np.ndarray, before: np.ndarray | None, gamma: float) -> float:
    """1, and for good 0.5 from the first time that two steps in a row turn back."""
    return 0.5 if gamma == 0.5 or (before is not None and step @ before < 0) else 1.0


def gamma_predictive(step: np.ndarray, before: np.ndarray | None, gamma: float, least: float = 0.5) -> float:
    if before is None:
        return gamma
    return max(least, gamma + float(step @ before / max(before @ before, 1e-300)))


def denoised(signal: DataFrame, model: Linear, count: int | str = "auto", action: str = "extract") -> DataFrame:
    return model.keep(signal, select(model, count)) if action == "extract" else model.remove(signal, select(model, count))


def segmented(signal: DataFrame, n: int, length: int, ramp: int, bias, count: int | str = "auto") -> DataFrame:
    """A fit for each fixed segment, cross-faded where they meet."""
    return segment_fits(signal, n, spans.fixed_segments(n, length), ramp, bias, count)


def segment_fits(signal: DataFrame, n: int, edges: list[tuple[int, int]], ramp: int, bias, count: int | str = "auto") -> DataFrame:
    """The signal without the leading components of each segment's own fit, on the segment and ``ramp`` samples on both
    sides, cross-faded there. ``bias`` works on channels; each segment's channels are series of their own, so all
    segments are biased, summed and fitted in one pass, however many there are."""
    names = channels_of(signal)
    c, where = len(names), segments.around(signal.sparkSession, edges, ramp, n)
    cell = max(1, min(max(b - a for a, b in edges), 1 << 14))
    series = segments.keyed(signal, where, cell)
    base = segments.moments(segments.unkeyed(series), ["xs"]).withColumnRenamed("sums", "base")
    both = base.join(segments.moments(segments.unkeyed(bias(series)), ["xs"]).withColumnRenamed("sums", "biased"), "k")

    def one(k: int, sums: dict[str, np.ndarray]) -> list[tuple]:
        cov, mean, w = segments.centred(sums["base"])
        scale = np.sqrt(np.maximum(np.diag(cov) + mean**2, 1e-300) * w)
        f, p, s = L.dss(cov / np.outer(scale, scale), segments.centred(sums["biased"])[0] / np.outer(scale, scale))
        gone = list(range(min(L.component_count(s) if count == "auto" else int(count), len(s))))
        return [(k, (np.eye(c) - (p * scale[:, None])[:, gone] @ (f / scale)[gone]).ravel().tolist(), [0.0] * c)]

    return segments.applied(signal, names, where, segments.fits(both, one, "k long, m array<double>, mean array<double>"), cell)


def covariance_boundaries(signal: DataFrame, n: int, window: int, least: int, prominence: float = 0.5) -> list[tuple[int, int]]:
    """Segments between marked changes of the spatial covariance (by windows, at unit trace)."""
    from quietfield.operators.moments import pair_products

    rows = pair_products(signal.where(F.col("t") < n // window * window).withColumn("w", F.floor(F.col("t") / window)), ["w"])
    rows = rows.select("w", "ci", "cj", (F.col("s") / F.col("n") - F.col("si") * F.col("sj") / F.col("n") / F.col("n")).alias("v"))
    trace = rows.where("ci = cj").groupBy("w").agg(F.sum("v").alias("trace"))
    unit = rows.join(trace, "w").select("w", "ci", "cj", (F.col("v") / F.col("trace")).alias("v"))
    nxt = unit.select((F.col("w") - 1).alias("w"), "ci", "cj", F.col("v").alias("u"))
    d = [r.d for r in unit.join(nxt, ["w", "ci", "cj"]).groupBy("w").agg(F.sqrt(F.sum(F.pow(F.col("v") - F.col("u"), 2))).alias("d")).orderBy("w").collect()]
    x = np.array(d)
    cuts = [0]
    for p in K.find_peaks(x, distance=max(1, least // window), prominence=prominence * x.std()) if len(x) > 2 else []:
        at = (int(p) + 1) * window
        if at - cuts[-1] >= least:
            cuts.append(at)
    if len(cuts) > 1 and n - cuts[-1] < least:
        cuts.pop()
    return list(zip(cuts, [*cuts[1:], n], strict=True))
