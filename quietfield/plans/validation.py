"""Checks before a fit: what a table must hold, and settings that must agree."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sample_window(window: tuple[float, float], unit: str = "samples", rate: float | None = None) -> tuple[int, int]:
    """(start, stop) in samples, half open; seconds are rounded to the nearest sample, halves to even."""
    a, b = window
    if unit == "seconds":
        if not rate or rate <= 0:
            raise ValueError("a window in seconds needs a sampling rate")
        a, b = round(a * rate), round(b * rate)
    elif unit != "samples":
        raise ValueError(f"unknown unit: {unit}")
    if int(a) != a or int(b) != b or a >= b:
        raise ValueError(f"not a window: {window}")
    return int(a), int(b)


def agreed_rate(declared: float | None, recorded: float | None, required: bool = True) -> float | None:
    if declared is not None and recorded is not None and not math.isclose(declared, recorded, rel_tol=1e-5, abs_tol=1e-8):
        raise ValueError(f"sampling rates differ: {declared} and {recorded}")
    found = declared if declared is not None else recorded
    if found is None and required:
        raise ValueError("no sampling rate")
    return found


def same_channels(fitted: list[str], given: list[str]) -> None:
    if fitted != given:
        raise ValueError(f"channels differ from those of the fit: {sorted(set(fitted) ^ set(given)) or 'another order'}")


def density(signal: DataFrame) -> DataFrame:
    """(channel, n, finite, spread, dense): one aggregate says whether each channel has every sample, and usable ones."""
    ok = ~F.isnan("x") & (F.abs("x") < float("inf"))
    last = signal.agg((F.max("t") + 1).alias("length"))
    rows = signal.groupBy("channel").agg(F.count("*").alias("n"), F.count_distinct("t").alias("samples"), F.avg(ok.cast("double")).alias("finite"), F.var_pop(F.when(ok, F.col("x")).otherwise(0.0)).alias("spread"))
    out = rows.crossJoin(F.broadcast(last))
    return out.select("channel", "n", "finite", "spread", ((F.col("n") == F.col("length")) & (F.col("samples") == F.col("length"))).alias("dense"))


def filled(signal: DataFrame, least: float = 0.99, flat: float = 1e-12) -> DataFrame:
    """The signal with values that aren't finite as 0; an error if a channel is not dense, has too many of them or is flat."""
    rows = density(signal).collect()  # one row a channel
    top = max((r.spread for r in rows), default=0.0)
    bad = [r.channel for r in rows if not r.dense or r.finite < least or r.spread <= flat * top]
    if bad:
        raise ValueError(f"channels that can't be used: {sorted(bad)}")
    return signal.withColumn("x", F.when(F.isnan("x") | (F.abs("x") == float("inf")), 0.0).otherwise(F.col("x")))
