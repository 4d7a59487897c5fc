"""Fit and apply: a fit is one aggregation to small matrices and a dense problem on the driver; to apply an operator is a
narrow map over samples, with the operator broadcast (channels x channels, checked)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quietfield.operators.moments import covariance
from quietfield.sources.signals import by_sample, channels_of, long_from_samples

MOST_CHANNELS = 4096


def apply_operator(samples: DataFrame, operator: np.ndarray, mean: np.ndarray | None = None, out_mean: np.ndarray | None = None) -> DataFrame:
    """(t, xs) with xs -> operator (xs - mean) + out_mean."""
    if max(operator.shape) > MOST_CHANNELS:
        raise ValueError(f"an operator of {operator.shape} is too large to broadcast")
    sent = samples.sparkSession.sparkContext.broadcast((operator, 0 if mean is None else mean, 0 if out_mean is None else out_mean))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, a, b = sent.value
        for f in frames:
            if len(f):
                x = np.stack(f["xs"].to_numpy()).astype(float)
                yield pd.DataFrame({"t": f["t"], "xs": list((x - a) @ m.T + b)})

    return samples.select("t", "xs").mapInPandas(run, "t long, xs array<double>")


def apply_long(signal: DataFrame, operator: np.ndarray, mean: np.ndarray | None = None, names: list[str] | None = None) -> DataFrame:
    """The same over a long signal, with names for the rows of the operator (the channels, unless given)."""
    return long_from_samples(apply_operator(by_sample(signal), operator, mean), names or channels_of(signal))


class Linear:
    """A fitted spatial model: filters (k x channels), patterns (channels x k), scores, and the mean."""

    def __init__(self, channels: list[str], filters: np.ndarray, patterns: np.ndarray, scores: np.ndarray, mean: np.ndarray):
        self.channels, self.filters, self.patterns, self.scores, self.mean = channels, filters, patterns, scores, mean

    def sources(self, signal: DataFrame) -> DataFrame:
        return apply_long(signal, self.filters, self.mean, [f"s{k:03d}" for k in range(len(self.filters))])

    def keep(self, signal: DataFrame, components: list[int]) -> DataFrame:
        """The part of the signal in some components (the mean stays out)."""
        return apply_long(signal, self.patterns[:, components] @ self.filters[components], self.mean, self.channels)

    def remove(self, signal: DataFrame, components: list[int]) -> DataFrame:
        m = np.eye(len(self.channels)) - self.patterns[:, components] @ self.filters[components]
        return apply_long(signal, m, None, self.channels)

    def table(self, signal: DataFrame) -> DataFrame:
        rows = [(k, c, float(self.filters[k, i]), float(self.patterns[i, k]), float(self.scores[k])) for k in range(len(self.filters)) for i, c in enumerate(self.channels)]
        return signal.sparkSession.createDataFrame(rows, "component int, channel string, filter double, pattern double, score double")


def fitted_covariance(signal: DataFrame) -> tuple[np.ndarray, np.ndarray, float]:
    return covariance(by_sample(signal))


def matrix_table(signal: DataFrame, m: np.ndarray, rows: list[str], cols: list[str]) -> DataFrame:
    data = [(r, c, float(m[i, j])) for i, r in enumerate(rows) for j, c in enumerate(cols)]
    return signal.sparkSession.createDataFrame(data, "row string, col string, v double")


def by_window(signal: DataFrame, length: int, step: int, n: int, function, schema: str, before: int = 0, after: int = 0) -> DataFrame:
    """function(start, stop, t, x as channels by time) of each window [k step, k step + length) with margins: windows are
    tasks of their own, so the length of a recording is no limit."""
    t = F.col("t")
    samples = by_sample(signal).withColumn("w", F.explode(F.sequence(F.greatest(F.ceil((t - length - after + 1) / step), F.lit(0)).cast("long"), F.least(F.floor((t + before) / step), F.lit(max((n - 1) // step, 0))).cast("long"))))

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("t")
        start = int(f["w"].iloc[0]) * step
        return function(start, min(start + length, n), f["t"].to_numpy(), np.stack(f["xs"].to_numpy()).astype(float).T)

    return samples.groupBy("w").applyInPandas(run, schema)
