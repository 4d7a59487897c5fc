"""Frequencies: direct sums of x cos and x sin over samples at a few bins, segments, and filters.

Of direct sums each task adds up its share of every bin, so what is shuffled is bins times channels, whatever the length;
whole transforms are in ``transforms``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quietfield.functions import kernels as K
from quietfield.operators.filters import Cascade, zero_phase


def transform_at(signal: DataFrame, n: int, bins: list[int]) -> DataFrame:
    """(channel, bin, re, im) of the discrete transform over n samples, at a few bins."""
    k = np.array(sorted(bins))
    at_once = max(64, (1 << 20) // max(len(k), 1))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, np.ndarray] = {}
        for f in frames:
            for channel, g in f.groupby("channel", sort=False):
                t, x = g["t"].to_numpy(), g["x"].to_numpy(float)
                for lo in range(0, len(t), at_once):
                    turn = np.exp(-2j * np.pi * ((t[lo : lo + at_once, None] * k[None]) % n) / n)
                    total[channel] = total.get(channel, 0) + x[lo : lo + at_once] @ turn
        for channel, z in total.items():
            yield pd.DataFrame({"channel": channel, "bin": k, "re": z.real, "im": z.imag})

    return signal.select("channel", "t", "x").mapInPandas(run, "channel string, bin long, re double, im double").groupBy("channel", "bin").agg(F.sum("re").alias("re"), F.sum("im").alias("im"))


def power_at(signal: DataFrame, n: int, bins: list[int], rate: float = 1.0) -> DataFrame:
    """(channel, freq, power): one-sided periodogram at bins, 2 |X|^2 / (n rate) (not doubled at 0 and n/2)."""
    twice = F.when((F.col("bin") == 0) | (2 * F.col("bin") == n), 1.0).otherwise(2.0)
    z = transform_at(signal, n, bins)
    return z.select("channel", (F.col("bin") * rate / n).alias("freq"), (twice * (F.col("re") * F.col("re") + F.col("im") * F.col("im")) / (n * rate)).alias("power"))


def band_part(signal: DataFrame, n: int, bins: list[int]) -> DataFrame:
    """The part of the signal in some bins, from their transform: what a line filter takes for the line."""
    z = transform_at(signal, n, bins)
    waves = z.groupBy("channel").agg(F.collect_list(F.struct("bin", "re", "im")).alias("z"))  # as many as bins asked for
    turn = F.lit(2 * np.pi) * F.pmod(F.col("t") * F.col("w.bin"), F.lit(n)) / n
    each = signal.join(F.broadcast(waves), "channel").select("channel", "t", F.explode("z").alias("w"))
    twice = F.when((F.col("w.bin") == 0) | (2 * F.col("w.bin") == n), 1.0).otherwise(2.0)
    value = twice * (F.col("w.re") * F.cos(turn) - F.col("w.im") * F.sin(turn)) / n
    return each.groupBy("channel", "t").agg(F.sum(value).alias("x"))


def line_bins(n: int, rate: float, freqs: list[float], half: float) -> list[int]:
    """Bins within ``half`` of any frequency; a frequency without one takes the nearest."""
    grid = np.arange(n // 2 + 1) * rate / n
    found: set[int] = set()
    for f in freqs:
        hit = np.flatnonzero(np.abs(grid - f) <= half)
        found |= set(hit.tolist()) if len(hit) else {int(np.abs(grid - f).argmin())}
    return sorted(found)


def line_blocks(signal: DataFrame, freq: float, rate: float, n: int, nfft: int = 1024, half: float = 1.0, harmonics: int | None = None) -> DataFrame:
    """Only the harmonics, block by block of min(nfft, n) samples (a shorter last block as it is): the line bias."""
    size = min(nfft, n)
    count = harmonics or max(1, int(rate / 2 / freq))
    freqs = [freq * h for h in range(1, count + 1) if freq * h <= rate / 2]

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("t")
        x = f["x"].to_numpy(float)
        z = np.fft.rfft(x)
        keep = np.zeros(len(z), bool)
        keep[[b for b in line_bins(len(x), rate, freqs, half) if b < len(z)]] = True
        f["x"] = np.fft.irfft(np.where(keep, z, 0), len(x))
        return f[["channel", "t", "x"]]

    return signal.withColumn("block", F.floor(F.col("t") / size)).groupBy("channel", "block").applyInPandas(run, "channel string, t long, x double")


def per_channel(signal: DataFrame, function) -> DataFrame:
    """function(xs) of each channel's whole series, one task a channel: for transforms of all samples."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("t")
        f["x"] = np.asarray(function(f["x"].to_numpy(float)), float)
        return f[["channel", "t", "x"]]

    return signal.groupBy("channel").applyInPandas(run, "channel string, t long, x double")


def in_blocks(signal: DataFrame, function, memory: int, after: int | None = None, block: int = 1 << 18) -> DataFrame:
    """function(xs) of each channel, for filters that forget: blocks of time are tasks of their own, each with a margin of
    the filter's memory before it (and ``after`` it, as much unless given), so a long recording is many tasks."""
    after = memory if after is None else after
    t = F.col("t")
    reach = F.sequence(F.greatest(F.floor((t - after) / block), F.lit(0)), F.floor((t + memory) / block))

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("t")
        f["x"] = np.asarray(function(f["x"].to_numpy(float)), float)
        return f.loc[f["t"] // block == f["block"].iloc[0], ["channel", "t", "x"]]

    return signal.select("channel", "t", "x", F.explode(reach).alias("block")).groupBy("channel", "block").applyInPandas(run, "channel string, t long, x double")


def bandpass(signal: DataFrame, rate: float, low: float, high: float, order: int = 4, block: int = 1 << 18) -> DataFrame:
    return zero_phase(signal, Cascade.of_sos(K.butter_sos(order, [low, high], "bandpass", rate)), block)


def notch(signal: DataFrame, rate: float, freq: float, width: float = 0.5, order: int = 4, block: int = 1 << 18) -> DataFrame:
    """Band-stop of freq +- width, within the limits; unchanged if nothing is left between them."""
    low, high = max(freq - width, 0.001 * rate / 2), min(freq + width, 0.999 * rate / 2)
    if low >= high:
        return signal
    return zero_phase(signal, Cascade.of_sos(K.butter_sos(order, [low, high], "bandstop", rate)), block)


def hybrid_notch(signal: DataFrame, rate: float, freq: float, width: float = 0.5, most_db: float = 3.0) -> DataFrame:
    """The notch on channels whose power around it (within 3 Hz) falls by ``most_db`` at most, by spectra of segments."""
    n = signal.agg((F.max("t") + 1).alias("n")).first().n or 0
    clean = notch(signal, rate, freq, width)
    away = F.abs(F.col("freq") - freq)
    around = lambda s, name: welch(s, rate, min(n, int(4 * rate))).where((away <= 3) & (away > width)).groupBy("channel").agg(F.avg("power").alias(name))
    both = around(signal, "before").join(around(clean, "after"), "channel")
    refused = both.where(10 * F.log10(F.col("before") / F.greatest("after", F.lit(1e-300))) > most_db).select("channel", F.lit(True).alias("refused"))
    met = signal.select("channel", "t", "x").join(clean.select("channel", "t", F.col("x").alias("y")), ["channel", "t"]).join(F.broadcast(refused), "channel", "left")
    return met.select("channel", "t", F.when(F.col("refused"), F.col("x")).otherwise(F.col("y")).alias("x"))


def peak(signal: DataFrame, rate: float, freq: float, q: float = 30.0, block: int = 1 << 18) -> DataFrame:
    return zero_phase(signal, Cascade.of(K.peak_filter(freq, q, rate)), block)


def comb(signal: DataFrame, rate: float, freq: float, harmonics: int = 3, q: float = 30.0, proportional: bool = False, weights: list[float] | None = None, block: int = 1 << 18) -> DataFrame:
    """Weighted sum of peaks at the harmonics below 0.95 of the highest frequency; weights 1/h."""
    parts = [(K.peak_filter(freq * h, q * h if proportional else q, rate), (weights or [1 / k for k in range(1, harmonics + 1)])[h - 1]) for h in range(1, harmonics + 1) if freq * h < 0.95 * rate / 2]
    if max((K.memory(a) for (_, a), _ in parts), default=0) <= block:
        return in_blocks(signal, lambda x: sum((w * K.filtfilt(b, a, x) for (b, a), w in parts), np.zeros(len(x))), K.memory(*[a for (_, a), _ in parts]), block=block)
    each = [zero_phase(signal, Cascade.of(section), block).withColumn("x", w * F.col("x")) for section, w in parts]
    return reduce(DataFrame.unionByName, each).groupBy("channel", "t").agg(F.sum("x").alias("x"))


def welch(signal: DataFrame, rate: float, nperseg: int, nfft: int | None = None) -> DataFrame:
    """(channel, freq, power), Hann windows with half overlap; segments are tasks of their own, then averaged."""
    hop = max(1, nperseg - nperseg // 2)
    n = signal.agg((F.max("t") + 1).alias("n")).first().n or 0
    starts = list(range(0, n - nperseg + 1, hop))
    last = starts[-1] if starts else -1

    def run(f: pd.DataFrame) -> pd.DataFrame:
        x = f.sort_values("t")["x"].to_numpy(float)
        freq, power = K.welch(x, rate, nperseg, nfft=nfft)
        return pd.DataFrame({"channel": f["channel"].iloc[0], "freq": freq, "power": power})

    seg = F.explode(F.sequence(F.greatest(F.floor((F.col("t") - nperseg) / hop) + 1, F.lit(0)), F.floor(F.col("t") / hop)))
    cut = signal.withColumn("segment", seg).where(F.col("segment") * hop <= last)
    return cut.groupBy("channel", "segment").applyInPandas(run, "channel string, freq double, power double").groupBy("channel", "freq").agg(F.avg("power").alias("power"))


def log_power(psd: DataFrame) -> DataFrame:
    """10 log10 of power, averaged over channels, with a floor of 1e-20 of the largest."""
    top = psd.agg((F.max("power") * 1e-20).alias("floor"))
    return psd.crossJoin(F.broadcast(top)).groupBy("freq").agg(F.avg(10 * F.log10(F.greatest("power", "floor"))).alias("db"))


def noise_frequencies(logs: DataFrame, fmin: float, fmax: float, width: float = 6.0, above: float = 4.0) -> DataFrame:
    """Peaks of log power that stand ``above`` dB over the mean of the outer thirds of a window around them."""
    a, b = logs.alias("a"), logs.alias("b")
    cell = lambda c: F.floor(c / width)
    left = a.where((F.col("freq") >= fmin) & (F.col("freq") <= fmax)).select(F.col("freq").alias("f"), F.col("db").alias("peak"), F.explode(F.sequence(cell(F.col("freq")) - 1, cell(F.col("freq")) + 1)).alias("cell"))
    right = b.select(F.col("freq").alias("g"), F.col("db").alias("near"), cell(F.col("freq")).alias("cell"))
    met = left.join(right, "cell").where(F.abs(F.col("f") - F.col("g")) <= width / 2)
    out = met.groupBy("f", "peak").agg(F.avg(F.when(F.abs(F.col("f") - F.col("g")) > width / 6, F.col("near"))).alias("around"), F.max("near").alias("top"))
    return out.where((F.col("peak") == F.col("top")) & (F.col("peak") > F.col("around") + above)).select(F.col("f").alias("freq"), F.col("peak").alias("db"), "around")


def _flanks(logs: DataFrame, f0: float, width: float = 3.0) -> DataFrame:
    """centre and deviation about f0: mean of the outer thirds, and how far their low five per cent lie below it."""
    d = F.col("freq") - f0
    at = logs.where(F.abs(d) <= width).withColumn("side", F.when(d < -width / 3, "low").when(d > width / 3, "high"))
    outer = at.where("side is not null")
    low = outer.groupBy("side").agg(F.percentile("db", 0.05).alias("q")).agg(F.avg("q").alias("q"))
    return outer.agg(F.avg("db").alias("centre")).crossJoin(F.broadcast(low)).select("centre", (F.col("centre") - F.col("q")).alias("deviation"))


def line_present(logs: DataFrame, f0: float, tight: float = 0.05, factor: float = 2.0) -> DataFrame:
    at = logs.where(F.abs(F.col("freq") - f0) <= tight).agg(F.max("db").alias("peak"))
    return _flanks(logs, f0).crossJoin(F.broadcast(at)).select("centre", "deviation", "peak", (F.col("peak") > F.col("centre") + factor * F.col("deviation")).alias("present"))


def line_verdict(logs: DataFrame, f0: float, above: float = 0.005, below: float = 0.005, factor: float = 2.0) -> DataFrame:
    """weak: too much is left at the line; strong: too much is gone beside it; else ok."""
    c = logs.where((F.col("freq") >= f0 - 0.4) & (F.col("freq") <= f0 + 0.1)).crossJoin(F.broadcast(_flanks(logs, f0)))
    tight = F.abs(F.col("freq") - f0) <= 0.05
    high = F.avg(F.when(tight, (F.col("db") > F.col("centre") + factor * F.col("deviation")).cast("double")))
    low = F.avg((F.col("db") < F.col("centre") - factor * F.col("deviation")).cast("double"))
    r = c.agg(F.coalesce(high, F.lit(0.0)).alias("high"), F.coalesce(low, F.lit(0.0)).alias("low"))
    return r.select("high", "low", F.when(F.col("high") > above, "weak").when(F.col("low") > below, "strong").otherwise("ok").alias("verdict"))


def harmonics(logs: DataFrame, f0: float, fmax: float, width: float = 6.0, above: float = 4.0, near: float = 0.5) -> DataFrame:
    """Multiples of f0 (from the second) that are noise frequencies."""
    found = noise_frequencies(logs, 0.0, fmax, width, above)
    h = F.round(F.col("freq") / f0)
    return found.where((h >= 2) & (F.abs(F.col("freq") - h * f0) <= near)).select(h.cast("long").alias("harmonic"), "freq", "db")


def slopes(psd: DataFrame, low: float, high: float) -> DataFrame:
    """Slope of log power on log frequency in a band, for each channel."""
    x, y = F.log10("freq"), F.log10("power")
    band = psd.where((F.col("freq") >= low) & (F.col("freq") <= high) & (F.col("power") > 0))
    return band.groupBy("channel").agg(F.regr_slope(y, x).alias("slope"))
