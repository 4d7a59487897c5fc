"""Line noise: what a smooth over one period leaves, separated by a line bias, without its leading components."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quietfield.functions import kernels as K
from quietfield.operators import dss, spectral, windows


def period_smooth(signal: DataFrame, rate: float, freq: float) -> DataFrame:
    """Mean over the last period; one that is not whole (to 1e-4) by its frequency response."""
    p = rate / freq
    if abs(p - round(p)) / p <= 1e-4:
        return windows.running_mean(signal, round(p))
    return spectral.per_channel(signal, lambda x: K.fractional_boxcar(x, p))


def clean(signal: DataFrame, rate: float, freq: float, n: int, count: int | str = "auto", nfft: int = 1024, width: float | None = None) -> tuple[DataFrame, dss.Linear, list[int]]:
    """(cleaned, model, removed): x less the projection of the residual on its line components; with a ``width``, only
    that part of it near the harmonics goes."""
    smooth = period_smooth(signal, rate, freq)
    residual = _less(signal, smooth)
    model = dss.fit(residual, spectral.line_blocks(residual, freq, rate, n, nfft))
    chosen = dss.select(model, count)
    logs = None
    if not chosen and count == "auto":
        size = min(n, int(4 * rate)) or n
        logs = spectral.log_power(spectral.welch(signal, rate, size))
        row = spectral.line_present(logs, freq).first()
        if row is not None and row.present:
            for k in range(1, len(model.scores) + 1):
                chosen = list(range(k))
                after = _less(signal, model.keep(residual, chosen))
                if spectral.line_verdict(spectral.log_power(spectral.welch(after, rate, size)), freq).first().verdict == "ok":
                    break
    if not chosen:
        return signal, model, chosen
    part = model.keep(residual, chosen)
    if width is not None:
        hs = [freq * h for h in range(1, max(1, int(rate / 2 / freq)) + 1)]
        part = spectral.band_part(part, n, spectral.line_bins(n, rate, hs, width))
    return _less(signal, part), model, chosen


def _less(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.withColumnRenamed("x", "y"), ["channel", "t"]).select("channel", "t", (F.col("x") - F.col("y")).alias("x"))


def clean_adaptive(signal: DataFrame, rate: float, n: int, fmin: float = 17.0, fmax: float = 99.0, segment: float = 30.0, most: float = 0.2) -> tuple[DataFrame, list[dict]]:
    """Every noise frequency found, segment by segment; segments are tasks of their own, and whatever a segment does is
    decided from its own spectrum. Frequencies follow one another, each on what the last has left."""
    size = min(n, max(1024, int(4 * rate)))
    logs = spectral.log_power(spectral.welch(signal, rate, size))
    freqs = sorted(r.freq for r in spectral.noise_frequencies(logs, fmin, fmax).collect())
    info = []
    for f in freqs:
        signal = _segments(signal, rate, f, n, int(segment * rate), most)
        info.append({"freq": f})
    return signal, info


def _segments(signal: DataFrame, rate: float, freq: float, n: int, length: int, most: float) -> DataFrame:
    import pandas as pd

    from quietfield.sources.signals import by_sample, channels_of, long_from_samples

    names = channels_of(signal)

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("t")
        x = np.stack(f["xs"].to_numpy()).astype(float).T
        return pd.DataFrame({"t": f["t"].to_numpy(), "xs": list(clean_segment(x, rate, freq, most).T)})

    cut = by_sample(signal).withColumn("seg", F.least(F.floor(F.col("t") / length), F.lit(max(0, (n - (length + 1) // 2) // length))))
    return long_from_samples(cut.groupBy("seg").applyInPandas(run, "t long, xs array<double>"), names)


def clean_segment(x: np.ndarray, rate: float, freq: float, most: float = 0.2) -> np.ndarray:
    """One segment (channels by time): fine peak, presence, then up to five tries at a threshold that moves with the
    verdict on the result."""
    from quietfield.functions import linalg as L

    nfft = min(x.shape[1], int(4 * rate))
    fine, power = K.welch(x, rate, nfft, nfft=16 * nfft)
    near = np.abs(fine - freq) <= 0.05
    fine = float(fine[near][power.mean(0)[near].argmax()]) if near.any() else freq

    def verdict(y: np.ndarray) -> tuple[bool, str]:
        f, p = K.welch(y, rate, nfft)
        db = (10 * np.log10(np.maximum(p, p.max() * 1e-20))).mean(0)
        d = f - fine
        sides = [db[(d < -1) & (d >= -3)], db[(d > 1) & (d <= 3)]]
        if min(map(len, sides)) == 0:
            return False, "ok"
        centre = np.concatenate(sides).mean()
        dev = centre - np.mean([np.quantile(s, 0.05) for s in sides])
        tight, low = db[np.abs(d) <= max(0.05, rate / nfft / 2)], db[(d >= -0.4) & (d <= 0.1)]
        present = bool(len(tight) and tight.max() > centre + 2 * dev)
        weak = len(tight) and np.mean(tight > centre + 2 * dev) > 0.005
        strong = len(low) and np.mean(low < centre - 2 * dev) > 0.005
        return present, "weak" if weak else "strong" if strong else "ok"

    present, _ = verdict(x)
    r = x - np.array([K.fractional_boxcar(c, rate / fine) for c in x])
    r0 = r - r.mean(1, keepdims=True)
    z = np.fft.rfft(r0)
    bins = spectral.line_bins(x.shape[1], rate, [fine * h for h in range(1, int(rate / 2 / fine) + 1)], 1.0)
    mask = np.zeros(z.shape[1], bool)
    mask[bins] = True
    b = np.fft.irfft(z * mask, x.shape[1])
    try:
        f, p, s = L.dss(r0 @ r0.T / x.shape[1], b @ b.T / x.shape[1])
    except (ValueError, np.linalg.LinAlgError):
        return x
    sigma, least, out = 3.0, int(present), x
    for _ in range(5):
        k = max(min(L.outliers(s, sigma), max(1, int(len(x) * most))), least)
        out = x - p[:, :k] @ (f[:k] @ r0) if k else x
        _, said = verdict(out)
        if said == "ok":
            break
        step = -0.25 if said == "weak" else 0.25
        if not 2.5 <= sigma + step <= 4:
            break
        sigma += step
        least = least + 1 if said == "weak" and least < max(1, int(len(x) * most)) else least
    return out
