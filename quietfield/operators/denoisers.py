"""Nonlinear functions of sources (channel, t, x), as column expressions over at most one aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quietfield.operators.windows import BLOCK, local_mean, local_variance

X = F.col


def _with_stats(signal: DataFrame, *stats: Column) -> DataFrame:
    return signal.join(F.broadcast(signal.groupBy("channel").agg(*stats)), "channel")


def tanh_mask(signal: DataFrame, alpha: float = 1.0, normalize: bool = True) -> DataFrame:
    """std * tanh(alpha x / std); unchanged without spread."""
    if not normalize:
        return signal.withColumn("x", F.tanh(alpha * X("x")))
    s = _with_stats(signal, F.stddev_pop("x").alias("s"))
    return s.withColumn("x", F.when(X("s") > 1e-15, X("s") * F.tanh(alpha * X("x") / X("s"))).otherwise(X("x"))).drop("s")


def robust_tanh(x: Column, alpha: float = 1.0) -> Column:
    return x - F.tanh(alpha * x)


def gauss(x: Column, a: float = 1.0) -> Column:
    return x * F.exp(-a * x * x / 2)


def skew(x: Column) -> Column:
    return x * x


def kurtosis(x: Column, kind: str = "tanh", alpha: float = 1.0) -> Column:
    return {"tanh": F.tanh(alpha * x), "cube": x * x * x, "gauss": gauss(x, alpha)}[kind]


def smooth_tanh(signal: DataFrame, n: int, alpha: float = 1.0, window: int = 10, block: int = BLOCK) -> DataFrame:
    out = local_mean(signal, window, n, block)
    return out.select("channel", "t", F.tanh(alpha * X("mean")).alias("x"))


def beta(signal: DataFrame, kind: str = "tanh", a: float = 1.0) -> DataFrame:
    """Mean derivative of a contrast, negated, for each channel."""
    x = X("x")
    made = {"tanh": -F.avg(1 - F.pow(F.tanh(x), 2)), "pow3": F.lit(-3.0) + 0 * F.avg(x), "gauss": -F.avg((1 - a * x * x) * F.exp(-a * x * x / 2))}[kind]
    return signal.groupBy("channel").agg(made.alias("beta"))


def wiener_mask(signal: DataFrame, n: int, window: int = 50, percentile: float = 25.0, least: float = 0.01, noise: float | None = None, block: int = BLOCK) -> DataFrame:
    """x times max(1 - noise / local variance, least); the noise is a percentile of the local variance unless given."""
    v = local_variance(signal, window, n, block)
    v = v.withColumn("noise", F.lit(noise)) if noise is not None else _with_stats(v, F.percentile("var", percentile / 100).alias("noise"))
    gain = F.greatest(F.when(X("var") > 0, 1 - X("noise") / X("var")).otherwise(0.0), F.lit(least))
    return v.select("channel", "t", (X("x") * gain).alias("x"))


def variance_mask(signal: DataFrame, n: int, window: int = 100, percentile: float = 75.0, soft: bool = True, block: int = BLOCK) -> DataFrame:
    """x times a logistic (or hard) mask of its local variance about a percentile."""
    v = _with_stats(local_variance(signal, window, n, block), F.percentile("var", percentile / 100).alias("level"), F.stddev_pop("var").alias("spread"))
    mask = F.when(X("spread") > 1e-15, 1 / (1 + F.exp(-(X("var") - X("level")) / X("spread")))).otherwise(1.0) if soft else (X("var") >= X("level")).cast("double")
    return v.select("channel", "t", (X("x") * mask).alias("x"))
