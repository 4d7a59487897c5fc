"""The data behind pictures: small tables for any plotting tool, with no more rows than a picture needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _both(before: DataFrame, after: DataFrame, value: str, keys: list[str]) -> DataFrame:
    return before.withColumnRenamed(value, "before").join(after.withColumnRenamed(value, "after"), keys)


def _sem(x: Column) -> Column:
    return F.stddev_samp(x) / F.sqrt(F.count(x))


def histogram(signal: DataFrame, bins: int) -> DataFrame:
    """(channel, bin, n) over each channel's range."""
    edge = signal.groupBy("channel").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    at = F.least(F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1)).cast("long")
    return signal.join(F.broadcast(edge), "channel").groupBy("channel", at.alias("bin")).agg(F.count("*").alias("n"))


def field_power(epochs: DataFrame) -> DataFrame:
    """Root mean square over channels of the mean over epochs."""
    mean = epochs.groupBy("channel", "t").agg(F.avg("x").alias("m"))
    return mean.groupBy("t").agg(F.sqrt(F.avg(F.col("m") * F.col("m"))).alias("gfp"))


def field_power_bootstrap(epochs: DataFrame, rounds: int = 1000, level: float = 0.95, seed: int = 42) -> DataFrame:
    """(t, low, high): quantiles over resampled epochs. A draw's share of each epoch is a Poisson count by hash, so no
    resample is ever made; sums of all draws are one aggregation."""
    u = lambda b: (F.pmod(F.xxhash64("epoch", F.lit(seed), b), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    edges = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563]  # Poisson(1)
    draws = epochs.select("channel", "epoch", "t", "x", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))).alias("b"))
    w = sum((F.when(u(F.col("b")) > e, 1.0).otherwise(0.0) for e in edges), F.lit(0.0))
    mean = draws.withColumn("w", w).groupBy("b", "channel", "t").agg((F.sum(F.col("w") * F.col("x")) / F.greatest(F.sum("w"), F.lit(1.0))).alias("m"))
    gfp = mean.groupBy("b", "t").agg(F.sqrt(F.avg(F.col("m") * F.col("m"))).alias("gfp"))
    return gfp.groupBy("t").agg(F.percentile("gfp", (1 - level) / 2).alias("low"), F.percentile("gfp", (1 + level) / 2).alias("high"))


def grand_average(epochs: DataFrame) -> DataFrame:
    return epochs.groupBy("channel", "t").agg(F.avg("x").alias("mean"), _sem(F.col("x")).alias("sem"))


def metric_bars(data: DataFrame, metric: str, group: str) -> DataFrame:
    x = F.col(metric)
    return data.groupBy(group).agg(F.avg(x).alias("mean"), _sem(x).alias("sem"), F.count(x).alias("n"))


def metric_violins(data: DataFrame, metric: str, group: str) -> DataFrame:
    return data.groupBy(group).agg(*[F.percentile(metric, p / 100).alias(f"p{p}") for p in (5, 25, 50, 75, 95)])


def tradeoff(data: DataFrame, x: str, y: str, group: str, subject: str = "subject") -> DataFrame:
    return data.select(group, subject, F.col(x).alias("x"), F.col(y).alias("y"))


def forest(data: DataFrame, metric: str, group: str, z: float = 1.96) -> DataFrame:
    m, e = F.avg(metric), _sem(F.col(metric))
    return data.groupBy(group).agg(m.alias("mean"), (m - z * e).alias("low"), (m + z * e).alias("high"))


def paired_slopes(data: DataFrame, metric: str, first: str, second: str, group: str = "grp", subject: str = "subject") -> DataFrame:
    """Each subject's mean in two groups, and the change."""
    a, b = (F.avg(F.when(F.col(group) == g, F.col(metric))) for g in (first, second))
    return data.groupBy(subject).agg(a.alias("a"), b.alias("b"), (b - a).alias("change"))


def null_distribution(values: DataFrame, observed: float, level: float = 95.0) -> DataFrame:
    """Interval of null values and the two-sided share at least as far out as what was observed."""
    v = F.col("value")
    return values.agg(F.percentile(v, (100 - level) / 200).alias("low"), F.percentile(v, (100 + level) / 200).alias("high"), F.avg((F.abs(v) >= abs(observed)).cast("double")).alias("p"))


def interaction(traces: DataFrame) -> DataFrame:
    """Mean and its error by condition, group and time."""
    return traces.groupBy("condition", "grp", "t").agg(F.avg("x").alias("mean"), _sem(F.col("x")).alias("sem"))


def power_ratio(before: DataFrame, after: DataFrame) -> DataFrame:
    both = _both(before, after, "x", ["channel", "t"]).groupBy("channel").agg(F.var_pop("before").alias("b"), F.var_pop("after").alias("a"))
    return both.select("channel", F.when(F.col("b") != 0, F.col("a") / F.col("b")).alias("ratio"))


def overlay(before: DataFrame, after: DataFrame, start: int, stop: int, scale: bool = True) -> DataFrame:
    """Both signals over a stretch, the second at the spread of the first."""
    both = _both(before, after, "x", ["channel", "t"])
    f = both.groupBy("channel").agg((F.stddev_pop("before") / F.stddev_pop("after")).alias("f"))
    part = both.where((F.col("t") >= start) & (F.col("t") < stop)).join(F.broadcast(f), "channel")
    return part.select("channel", "t", "before", (F.col("after") * (F.col("f") if scale else 1.0)).alias("after"))


def time_course(before: DataFrame, after: DataFrame, channels: list[str], start: int, stop: int) -> DataFrame:
    keep = F.col("channel").isin(channels) & (F.col("t") >= start) & (F.col("t") < stop)
    return _both(before.where(keep), after.where(keep), "x", ["channel", "t"])


def psd_comparison(before: DataFrame, after: DataFrame) -> DataFrame:
    return _both(before, after, "power", ["channel", "freq"]).groupBy("freq").agg(F.avg("before").alias("before"), F.avg("after").alias("after"))


def psd_zoom(before: DataFrame, after: DataFrame, f0: float, width: float) -> DataFrame:
    both = _both(before, after, "power", ["channel", "freq"]).where(F.abs(F.col("freq") - f0) <= width)
    return both.select("channel", "freq", (10 * F.log10("before")).alias("before"), (10 * F.log10("after")).alias("after"))


def harmonic_attenuation(before: DataFrame, after: DataFrame, f0: float, harmonics: int, width: float) -> DataFrame:
    h = F.explode(F.sequence(F.lit(1).cast("long"), F.lit(harmonics).cast("long")))
    both = _both(before, after, "power", ["channel", "freq"]).withColumn("harmonic", h).where(F.abs(F.col("freq") - F.col("harmonic") * f0) <= width + 1e-9)
    return both.groupBy("harmonic", "channel").agg((10 * F.log10(F.max("before") / F.max("after"))).alias("db"))


def spectrogram(signal: DataFrame, rate: float, nperseg: int) -> DataFrame:
    """(frame, freq, power) averaged over channels: half-overlapping Hann frames, each a task's own group of samples."""
    import numpy as np
    import pandas as pd

    from quietfield.functions.kernels import hann

    hop = nperseg // 2
    n = signal.agg((F.max("t") + 1).alias("n")).first().n or 0
    last = (n - nperseg) // hop

    def run(f: pd.DataFrame) -> pd.DataFrame:
        x, w = f.sort_values("t")["x"].to_numpy(float), hann(nperseg)
        z = np.abs(np.fft.rfft((x - x.mean()) * w)) ** 2 / (rate * (w * w).sum())
        return pd.DataFrame({"frame": int(f["frame"].iloc[0]), "freq": np.fft.rfftfreq(nperseg, 1 / rate), "power": z})

    at = F.explode(F.sequence(F.greatest(F.floor((F.col("t") - nperseg) / hop) + 1, F.lit(0)), F.floor(F.col("t") / hop)))
    cut = signal.withColumn("frame", at).where(F.col("frame") <= last)
    return cut.groupBy("channel", "frame").applyInPandas(run, "frame long, freq double, power double").groupBy("frame", "freq").agg(F.avg("power").alias("power"))


def epochs_image(sources: DataFrame, length: int) -> DataFrame:
    """(component, epoch, t, x) of component signals cut into epochs."""
    from quietfield.sources.signals import to_epochs

    return to_epochs(sources, length).withColumnRenamed("channel", "component")


def count_series(marks: DataFrame, size: int) -> DataFrame:
    """(window, n, mean): marks of (t, on) in consecutive windows, and the mean of their counts."""
    n = marks.groupBy(F.floor(F.col("t") / size).alias("window")).agg(F.sum(F.col("on").cast("long")).alias("n"))
    return n.crossJoin(F.broadcast(n.agg(F.avg("n").alias("mean"))))


def kept_fraction(masks: DataFrame) -> DataFrame:
    """(label, share) of the samples that masks of (label, t, on) keep."""
    return masks.groupBy("label").agg(F.avg(F.col("on").cast("double")).alias("share"))


def tradeoff_summary(data: DataFrame, x: str, y: str, metric: str, group: str) -> DataFrame:
    """Means of both axes, and of a metric with its error, by group."""
    return tradeoff(data.withColumn("metric", F.col(metric)), x, y, group).join(metric_bars(data, metric, group), group).groupBy(group).agg(
        F.avg("x").alias("x"), F.avg("y").alias("y"), F.max("mean").alias("mean"), F.max("sem").alias("sem")
    )


def denoising_summary(before: DataFrame, after: DataFrame) -> DataFrame:
    """Of each channel: size before, after and of what is gone, and how alike before and after are."""
    rms = lambda c: F.sqrt(F.avg(c * c))
    a, b = F.col("before"), F.col("after")
    return _both(before, after, "x", ["channel", "t"]).groupBy("channel").agg(rms(a).alias("before"), rms(b).alias("after"), rms(a - b).alias("removed"), F.corr(a, b).alias("r"))


def diagnostics_summary(signals: DataFrame, reference: str) -> DataFrame:
    """Of signals (grp, t, x): size, range, and the correlation with a reference group."""
    ref = signals.where(F.col("grp") == reference).select("t", F.col("x").alias("ref"))
    return signals.join(ref, "t").groupBy("grp").agg(F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("rms"), (F.max("x") - F.min("x")).alias("spread"), F.corr("x", "ref").alias("r"))


def cleaning_summary(scores: list[float], selected: list[int], before: DataFrame, after: DataFrame) -> DataFrame:
    """(panel, key, value): scores, whether each component was taken out, and the share of each channel's power that went."""
    spark = before.sparkSession
    rows = [("score", str(k), float(v)) for k, v in enumerate(scores)] + [("selected", str(k), float(k in set(selected))) for k in range(len(scores))]
    gone = power_ratio(before, after).select(F.lit("removed").alias("panel"), F.col("channel").alias("key"), (1 - F.col("ratio")).alias("value"))
    return spark.createDataFrame(rows, "panel string, key string, value double").unionByName(gone)


def component_summary(model, signal: DataFrame) -> DataFrame:
    """(component, score, size of its pattern, size of its trace) of a fitted model."""
    sources = model.sources(signal)
    sizes = sources.groupBy("channel").agg(F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("trace"))
    rows = [(f"s{k:03d}", float(model.scores[k]), float((model.patterns[:, k] ** 2).sum() ** 0.5)) for k in range(len(model.scores))]
    table = signal.sparkSession.createDataFrame(rows, "component string, score double, pattern double")
    return table.join(sizes.withColumnRenamed("channel", "component"), "component")


def repair_ratios(log: DataFrame) -> DataFrame:
    """(start, component, ratio, weight): variance over limit of each direction of each update, and how much of it stays."""
    each = log.select("start", F.posexplode(F.arrays_zip("variances", "limits", "weights")).alias("component", "z"))
    return each.select("start", "component", (F.col("z.variances") / F.col("z.limits")).alias("ratio"), F.col("z.weights").alias("weight"))


def guided_weights(log: DataFrame) -> DataFrame:
    """(start, stop, component, weight, applied): a row for each direction of each update, and whether it changed anything."""
    return log.select("start", "stop", "applied", F.posexplode("weights").alias("component", "weight"))
