"""Fourier and cosine transforms of whole signals as many tasks, whatever their length.

A transform of n = n1 n2 samples is n2 transforms of every n2-th sample, a turn of each value, and n1 transforms of n2
values: two shuffles, and no task holds more than ``CELL`` values of a channel. A length without such factors goes
through the chirp form of the transform, a convolution, on a length that is a power of two.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELL = 1 << 16
BINS = "channel string, bin long, re double, im double"


def layout(n: int, cell: int = CELL) -> tuple[int, int] | None:
    """(n1, n2) with n = n1 n2 and both within ``cell``, n1 as small as n2 allows above the square root; None if there is
    no such pair."""
    if n <= cell:
        return 1, n
    for a in range(math.isqrt(n), 0, -1):
        if n // a > cell:
            return None
        if n % a == 0:
            return a, n // a
    return None


def transform(values: DataFrame, n: int, inverse: bool = False, cell: int = CELL) -> DataFrame:
    """(channel, bin, re, im) of values (channel, t, re, im), samples that are missing as 0.

    With ``inverse``, of bins given as ``t``: sums with the other sign, over n.
    """
    sign = 2j * np.pi if inverse else -2j * np.pi
    shape = layout(n, cell)
    if shape is None:
        return _chirp(values, n, inverse, cell)
    n1, n2 = shape
    rows = values.select("channel", "t", "re", "im")
    if n1 > 1:
        wide = max(1, cell // n1)

        def columns(f: pd.DataFrame) -> pd.DataFrame:
            t = f["t"].to_numpy()
            first = int((t % n2).min()) // wide * wide
            b = np.arange(first, min(first + wide, n2))
            m = np.zeros((n1, len(b)), complex)
            np.add.at(m, (t // n2, t % n2 - first), f["re"].to_numpy() + 1j * f["im"].to_numpy())
            m = np.fft.ifft(m, axis=0) * n1 if inverse else np.fft.fft(m, axis=0)
            k = np.arange(n1)
            m *= np.exp(sign * ((k[:, None] * b[None]) % n) / n)
            at = (k[:, None] * n2 + b[None]).ravel()  # the same place for the next pass: k1, then b
            return pd.DataFrame({"channel": f["channel"].iloc[0], "t": at, "re": m.real.ravel(), "im": m.imag.ravel()})

        keyed = rows.withColumn("part", F.floor(F.col("t") % n2 / wide))
        rows = keyed.groupBy("channel", "part").applyInPandas(columns, "channel string, t long, re double, im double")
    deep = max(1, cell // n2)

    def lines(f: pd.DataFrame) -> pd.DataFrame:
        t = f["t"].to_numpy()
        first = int((t // n2).min()) // deep * deep
        k1 = np.arange(first, min(first + deep, n1))
        m = np.zeros((len(k1), n2), complex)
        np.add.at(m, (t // n2 - first, t % n2), f["re"].to_numpy() + 1j * f["im"].to_numpy())
        m = np.fft.ifft(m, axis=1) * (n2 / n) if inverse else np.fft.fft(m, axis=1)
        k = (k1[:, None] + n1 * np.arange(n2)[None]).ravel()
        return pd.DataFrame({"channel": f["channel"].iloc[0], "bin": k, "re": m.real.ravel(), "im": m.imag.ravel()})

    return rows.withColumn("part", F.floor(F.col("t") / (n2 * deep))).groupBy("channel", "part").applyInPandas(lines, BINS)


def _turned(re: Column, im: Column, angle: Column) -> tuple[Column, Column]:
    """A complex number times exp(i angle)."""
    return re * F.cos(angle) - im * F.sin(angle), re * F.sin(angle) + im * F.cos(angle)


def _chirp(values: DataFrame, n: int, inverse: bool, cell: int) -> DataFrame:
    """t k = (t^2 + k^2 - (t - k)^2) / 2 makes the transform a convolution with a chirp, on a length of 2^b."""
    m = 1 << (2 * n - 2).bit_length()
    if layout(m, cell) is None:
        raise ValueError(f"{n} samples are too long for tasks of {cell} values")
    s = 1.0 if inverse else -1.0
    angle = lambda c: F.lit(np.pi) * F.pmod(F.pmod(c, F.lit(2 * n)) * F.pmod(c, F.lit(2 * n)), F.lit(2 * n)) / n
    re, im = _turned(F.col("re"), F.col("im"), s * angle(F.col("t")))
    sent = transform(values.select("channel", "t", re.alias("re"), im.alias("im")), m, cell=cell)
    there = values.sparkSession.range(m).select(F.lit("chirp").alias("channel"), F.col("id").alias("t"), F.when(F.col("id") < n, F.col("id")).when(F.col("id") > m - n, F.col("id") - m).alias("d")).where("d is not null")
    chirp = transform(there.select("channel", "t", F.cos(angle(F.col("d"))).alias("re"), (-s * F.sin(angle(F.col("d")))).alias("im")), m, cell=cell)
    b = chirp.select("bin", F.col("re").alias("c"), F.col("im").alias("d"))
    met = sent.join(b, "bin").select("channel", F.col("bin").alias("t"), (F.col("re") * F.col("c") - F.col("im") * F.col("d")).alias("re"), (F.col("re") * F.col("d") + F.col("im") * F.col("c")).alias("im"))
    back = transform(met, m, inverse=True, cell=cell).where(F.col("bin") < n)
    re, im = _turned(F.col("re"), F.col("im"), s * angle(F.col("bin")))
    scale = 1.0 / n if inverse else 1.0
    return back.select("channel", "bin", (re * scale).alias("re"), (im * scale).alias("im"))


def spectrum(signal: DataFrame, n: int, cell: int = CELL) -> DataFrame:
    """(channel, bin, re, im) of a real signal, bins 0 to n/2."""
    return transform(signal.select("channel", "t", F.col("x").alias("re"), F.lit(0.0).alias("im")), n, cell=cell).where(2 * F.col("bin") <= n)


def from_spectrum(bins: DataFrame, n: int, cell: int = CELL) -> DataFrame:
    """The real signal (channel, t, x) of bins 0 to n/2; what a real signal can't have at both ends is left out."""
    twice = F.when((F.col("bin") == 0) | (2 * F.col("bin") == n), 1.0).otherwise(2.0)
    half = bins.select("channel", F.col("bin").alias("t"), (twice * F.col("re")).alias("re"), (twice * F.col("im")).alias("im"))
    return transform(half, n, inverse=True, cell=cell).select("channel", F.col("bin").alias("t"), F.col("re").alias("x"))


def periodogram(signal: DataFrame, n: int, rate: float = 1.0, cell: int = CELL) -> DataFrame:
    """(channel, freq, power) of the bins between 0 and n/2: 2 |X|^2 / (n rate)."""
    z = spectrum(signal, n, cell).where((F.col("bin") > 0) & (2 * F.col("bin") < n))
    return z.select("channel", (F.col("bin") * rate / n).alias("freq"), (2 * (F.col("re") * F.col("re") + F.col("im") * F.col("im")) / (n * rate)).alias("power"))


def bins_within(freq: float, width: float, rate: float, n: int) -> tuple[int, int]:
    """The first and last bin of 0 to n/2 within ``width`` of a frequency (the last below the first if none is)."""
    near = lambda k: abs(k / (n / rate) - freq) <= width
    lo, hi = max(math.floor((freq - width) * n / rate) - 1, 0), min(math.ceil((freq + width) * n / rate) + 1, n // 2)
    while lo <= hi and not near(lo):
        lo += 1
    while hi >= lo and not near(hi):
        hi -= 1
    return lo, hi


def interpolate_lines(signal: DataFrame, n: int, rate: float, freqs: list[float], half: float = 1.0, neighbours: float = 2.0, cell: int = CELL) -> DataFrame:
    """Magnitudes within ``half`` of each line (at the nearest bin, if none is) become the mean of their neighbours, those
    within ``neighbours`` more; phases stay. In order of frequency, each line sees what came of those before.

    What a line sees is what the transform has and what earlier lines put there, so sums over the transform, one pass for
    all lines, give the means one after the other.
    """
    steps: list[tuple[tuple[int, int], list[tuple[int, int]]]] = []
    for f in sorted(f for f in freqs if f < rate / 2):
        lo, hi = bins_within(f, half, rate, n)
        if hi < lo:
            lo = hi = min(range(max(0, int(f * n / rate) - 1), min(n // 2, int(f * n / rate) + 2) + 1), key=lambda k: (abs(k / (n / rate) - f), k))
        a, b = bins_within(f, half + neighbours, rate, n)
        ring = [(x, y) for x, y in ((a, lo - 1), (hi + 1, b)) if x <= y]
        if ring:
            steps.append(((lo, hi), ring))
    if not steps:
        return signal.select("channel", "t", "x")
    z = spectrum(signal, n, cell).withColumn("size", F.hypot("re", "im"))
    within = lambda ranges: F.lit(False) if not ranges else _any([(F.col("bin") >= a) & (F.col("bin") <= b) for a, b in ranges])
    sums = z.groupBy("channel").agg(*[F.coalesce(F.sum(F.when(within(ring) & ~within([b for b, _ in steps[:i]]), F.col("size"))), F.lit(0.0)).alias(f"s{i}") for i, (_, ring) in enumerate(steps)])
    for i, (_, ring) in enumerate(steps):
        left, total = ring, F.col(f"s{i}")
        for j in range(i - 1, -1, -1):  # the last line over a bin is what stands there
            band = steps[j][0]
            seen = sum(max(0, min(b, band[1]) - max(a, band[0]) + 1) for a, b in left)
            left = [p for a, b in left for p in ((a, min(b, band[0] - 1)), (max(a, band[1] + 1), b)) if p[0] <= p[1]]
            if seen:
                total = total + seen * F.col(f"m{j}")
        sums = sums.withColumn(f"m{i}", total / sum(b - a + 1 for a, b in ring))
    new = F.lit(None).cast("double")
    for i, (band, _) in enumerate(steps):
        new = F.when(within([band]), F.col(f"m{i}")).otherwise(new)
    met = z.join(F.broadcast(sums), "channel").withColumn("new", new)  # a row for each channel
    turn = F.when(F.col("size") > 0, F.col("new") / F.col("size"))
    re = F.when(F.col("new").isNull(), F.col("re")).otherwise(F.coalesce(turn * F.col("re"), F.col("new")))
    im = F.when(F.col("new").isNull(), F.col("im")).otherwise(F.coalesce(turn * F.col("im"), F.lit(0.0)))
    return from_spectrum(met.select("channel", "bin", re.alias("re"), im.alias("im")), n, cell)


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def cosine_mask(signal: DataFrame, n: int, fraction: float = 0.5, mask: np.ndarray | None = None, cell: int = CELL) -> DataFrame:
    """The low part of the cosine transform (type II), or it times a mask stretched to fit.

    Samples at even times followed by those at odd times backwards have a transform V with C[k] = 2 Re(u) and
    C[n - k] = -2 Im(u) for u = V[k] exp(-i pi k / 2n), so both are masked where they stand.
    """
    if n < 1:
        return signal.select("channel", "t", "x")

    def kept(k: Column) -> Column:
        if mask is None:
            return (k < max(1, int(fraction * n))).cast("double")
        at = k * (len(mask) - 1) / max(n - 1, 1)
        i = F.least(F.floor(at), F.lit(max(len(mask) - 2, 0)))
        m = F.array(*[F.lit(float(v)) for v in mask])
        low, high = F.get(m, i.cast("int")), F.coalesce(F.get(m, (i + 1).cast("int")), F.get(m, i.cast("int")))
        return low + (high - low) * (at - i)

    t, k = F.col("t"), F.col("bin")
    turned = signal.select("channel", F.when(t % 2 == 0, t / 2).otherwise(n - 1 - (t - 1) / 2).cast("long").alias("t"), F.col("x").alias("re"), F.lit(0.0).alias("im"))
    v = transform(turned, n, cell=cell)
    angle = F.lit(np.pi / (2 * n)) * k
    p, q = _turned(F.col("re"), F.col("im"), -angle)
    re, im = _turned(kept(k) * p, F.when(k > 0, kept(n - k)).otherwise(0.0) * q, angle)
    back = transform(v.select("channel", k.alias("t"), re.alias("re"), im.alias("im")), n, inverse=True, cell=cell)
    half = (n + 1) // 2
    return back.select("channel", F.when(k < half, 2 * k).otherwise(2 * (n - 1 - k) + 1).alias("t"), F.col("re").alias("x"))
