"""Operators on whole series of a channel, singular spectrum analysis by stretches, and its trajectory form."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quietfield.functions import kernels as K
from quietfield.functions import linalg as L
from quietfield.operators.moments import gram
from quietfield.operators.spectral import per_channel
from quietfield.operators.windows import BLOCK, blocked
from quietfield.sources.signals import by_sample, channels_of


def spectrogram_mask(signal: DataFrame, nperseg: int = 256, noverlap: int | None = None, mask: np.ndarray | None = None, percentile: float = 90.0) -> DataFrame:
    return per_channel(signal, lambda x: K.masked_spectrogram(x, nperseg, noverlap, mask, percentile))


def quasi_periodic(signal: DataFrame, distance: int = 100, percentile: float = 75.0, smooth: bool = True) -> DataFrame:
    return per_channel(signal, lambda x: K.quasi_periodic(x, distance, percentile, None, smooth))


def rms_distribution(rms: DataFrame) -> DataFrame:
    """(channel, mu, sigma) of window amplitudes (channel, start, rms), robust against windows that are not clean."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        mu, sigma = K.fit_rms(f["rms"].to_numpy(float))
        return pd.DataFrame({"channel": f["channel"].iloc[:1], "mu": [mu], "sigma": [sigma]})

    return rms.groupBy("channel").applyInPandas(run, "channel string, mu double, sigma double")


def ssa(signal: DataFrame, rate: float, n: int, window: int | None = None, drop_below: float = 3.0, stretch: int = 1 << 14) -> DataFrame:
    """Without slow components; stretches of time are tasks of their own, as the trajectory matrix grows with both."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("t")
        x = f["x"].to_numpy(float)
        f["x"] = L.ssa_clean(x, rate, window, drop_below) if len(x) >= 4 else x
        return f[["channel", "t", "x"]]

    last = max(0, (n - stretch // 2) // stretch)
    return signal.withColumn("s", F.least(F.floor(F.col("t") / stretch), F.lit(last))).groupBy("channel", "s").applyInPandas(run, "channel string, t long, x double")


def w_correlations(components: DataFrame, window: int, n: int) -> tuple[list[str], np.ndarray]:
    """(names, matrix) of weighted correlations between components (channel, t, x) of n samples: a sample weighs as much as
    there are places for it in a trajectory matrix of lag ``window``. Weighted moments are one pass, whatever n is."""
    t, most = F.col("t"), min(window, n - window + 1)
    rows = by_sample(components).withColumn("w", F.least(t + 1, F.lit(n) - t, F.lit(most)))
    g, _, _, _ = gram(rows, "w")
    d = np.sqrt(np.maximum(np.diag(g), 1e-300))
    return channels_of(components), g / np.outer(d, d)


def alike(matrix: np.ndarray, least: float) -> list[int]:
    """For each component the first that it hangs together with by correlations of ``least`` or more, either sign."""
    group = list(range(len(matrix)))
    for i in range(len(matrix)):
        for j in range(i):
            if abs(matrix[i, j]) >= least and group[i] != group[j]:
                low, high = sorted((group[i], group[j]))
                group = [low if g == high else g for g in group]
    return group


def ssa_groups(signal: DataFrame, rate: float, n: int, window: int | None = None, least: float = 0.5, stretch: int = 1 << 14) -> DataFrame:
    """(channel, stretch, component, together, share): components of each stretch, the first of those that they are not
    separable from by weighted correlation, and their share of the stretch's power."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        x = f.sort_values("t")["x"].to_numpy(float)
        size = L.ssa_window(len(x), rate, window)
        parts = L.ssa(x, size)
        power = (parts**2).sum(1)
        return pd.DataFrame({"channel": f["channel"].iloc[0], "stretch": f["s"].iloc[0], "component": np.arange(len(parts)), "together": alike(L.w_correlation(parts, size), least), "share": power / max(power.sum(), 1e-300)})

    last = max(0, (n - stretch // 2) // stretch)
    cut = signal.withColumn("s", F.least(F.floor(F.col("t") / stretch), F.lit(last)))
    return cut.groupBy("channel", "s").applyInPandas(run, "channel string, stretch long, component int, together int, share double")


def local_ssa(signal: DataFrame, rate: float, window: int | None = None, clusters: int | None = None) -> DataFrame:
    return per_channel(signal, lambda x: L.local_ssa_clean(x, window, rate, clusters))


def trajectory(signal: DataFrame, window: int, block: int = BLOCK) -> DataFrame:
    """(channel, k, t, x): x[t + k] for k below the window, where all are there."""
    out, w, own = blocked(signal, 0, window - 1, block)
    rows = out.select("channel", "t", own.alias("own"), F.array(*[F.lead("x", k).over(w) for k in range(window)]).alias("xs"))
    return rows.where("own").where(F.forall("xs", lambda v: v.isNotNull())).select("channel", "t", F.posexplode("xs").alias("k", "x")).select("channel", F.col("k").cast("long").alias("k"), "t", "x")


def diagonal_average(rows: DataFrame) -> DataFrame:
    return rows.groupBy("channel", (F.col("t") + F.col("k")).alias("t")).agg(F.avg("x").alias("x"))
