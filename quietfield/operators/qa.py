"""Quality metrics: aggregates over power spectra (channel, freq, power), or over signals before and after."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def near(f0: float, width: float) -> Column:
    return (F.col("freq") >= f0 - width) & (F.col("freq") <= f0 + width)


def _both(before: DataFrame, after: DataFrame) -> DataFrame:
    return before.withColumnRenamed("power", "before").join(after.withColumnRenamed("power", "after"), ["channel", "freq"])


def _db(x: Column) -> Column:
    return 10 * F.log10(x)


def peak_attenuation(before: DataFrame, after: DataFrame, f0: float, width: float = 2.0) -> DataFrame:
    """dB from the largest power near f0 before to that after, for each channel."""
    return _both(before, after).where(near(f0, width)).groupBy("channel").agg(_db(F.max("before") / F.max("after")).alias("db"))


def suppression_ratio(before: DataFrame, after: DataFrame, f0: float, width: float = 2.0) -> DataFrame:
    """dB of mean power near f0, before over after; infinite if nothing is left."""
    r = _both(before, after).where(near(f0, width)).agg(F.avg("before").alias("b"), F.avg("after").alias("a"))
    return r.select(F.when(F.col("a") <= 0, F.lit(float("inf"))).otherwise(_db(F.col("b") / F.col("a"))).alias("db"))


def _ring(f0: float, inner: float, outer: float) -> Column:
    return near(f0, outer) & ~near(f0, inner)


def noise_surround(psd: DataFrame, f0: float, peak: float = 2.0, surround: float = 5.0) -> DataFrame:
    """Mean power at the peak over that around it, for each channel."""
    return psd.groupBy("channel").agg((F.avg(F.when(near(f0, peak), F.col("power"))) / F.avg(F.when(_ring(f0, peak, surround), F.col("power")))).alias("ratio"))


def below_noise_distortion(before: DataFrame, after: DataFrame, exclude: float | None = None, width: float = 5.0, fmin: float = 1.0, fmax: float = 45.0, harmonics: int = 0) -> DataFrame:
    """10 times the mean absolute log10 ratio in a band, without the harmonics of ``exclude``."""
    keep = (F.col("freq") >= fmin) & (F.col("freq") <= fmax)
    for h in range(1, harmonics + 2) if exclude is not None else ():
        keep = keep & ~near(exclude * h, width)
    return _both(before, after).where(keep & (F.col("before") > 0) & (F.col("after") > 0)).agg((10 * F.avg(F.abs(F.log10(F.col("after") / F.col("before"))))).alias("db"))


def spectral_distortion(before: DataFrame, after: DataFrame, line: float = 50.0, harmonics: int = 3, width: float = 2.0, fmin: float = 2.0, fmax: float = 160.0) -> DataFrame:
    """Root mean square change in dB away from the harmonics."""
    keep = (F.col("freq") >= fmin) & (F.col("freq") <= fmax)
    for h in range(1, harmonics + 1):
        keep = keep & ~near(line * h, 2 * width)
    change = _db(F.col("after") / F.col("before"))
    return _both(before, after).where(keep & (F.col("before") > 0) & (F.col("after") > 0)).agg(F.sqrt(F.avg(change * change)).alias("db"))


def overclean(before: DataFrame, after: DataFrame, f0: float, width: float = 2.0, threshold: float = 3.0) -> DataFrame:
    """Share of channels whose floor around f0 fell by more than ``threshold`` dB."""
    ring = _ring(f0, width, 3 * width)
    drop = _both(before, after).where(ring).groupBy("channel").agg(_db(F.avg("before") / F.avg("after")).alias("db"))
    return drop.agg(F.avg((F.col("db") > threshold).cast("double")).alias("share"))


def underclean(after: DataFrame, f0: float, peak: float = 2.0, surround: float = 5.0, threshold: float = 2.0) -> DataFrame:
    return noise_surround(after, f0, peak, surround).agg(F.avg((F.col("ratio") > threshold).cast("double")).alias("share"))


def geometric_ratio(before: DataFrame, after: DataFrame, fmin: float = 1.0, fmax: float = 45.0) -> DataFrame:
    keep = (F.col("freq") >= fmin) & (F.col("freq") <= fmax) & (F.col("before") > 0) & (F.col("after") > 0)
    return _both(before, after).where(keep).agg(F.exp(F.avg(F.log(F.col("after") / F.col("before")))).alias("ratio"))


def _pairs(before: DataFrame, after: DataFrame) -> DataFrame:
    return before.withColumnRenamed("x", "b").join(after.withColumnRenamed("x", "a"), ["channel", "t"])


def variance_removed(before: DataFrame, after: DataFrame) -> DataFrame:
    """Per cent of variance over all samples and channels that is gone."""
    return _pairs(before, after).agg((100 * (1 - F.var_pop("a") / F.var_pop("b"))).alias("percent"))


def rms_change(before: DataFrame, after: DataFrame) -> DataFrame:
    return _pairs(before, after).agg(F.sqrt(F.avg(F.pow(F.col("a") - F.col("b"), 2))).alias("rms"))


def max_change(before: DataFrame, after: DataFrame) -> DataFrame:
    return _pairs(before, after).agg(F.max(F.abs(F.col("a") - F.col("b"))).alias("change"))


def variance_ratio(before: DataFrame, after: DataFrame, floor: float = 2.220446049250313e-16) -> DataFrame:
    return _pairs(before, after).groupBy("channel").agg((F.var_pop("a") / F.greatest(F.var_pop("b"), F.lit(floor))).alias("ratio"))


def summary(before: DataFrame, after: DataFrame, psd_before: DataFrame, psd_after: DataFrame, line: float, harmonics: int = 0, width: float = 2.0) -> DataFrame:
    """(metric, value) rows: medians over channels where a metric has one for each."""
    med = lambda df, c, name: df.agg(F.median(c).alias("value")).select(F.lit(name).alias("metric"), "value")
    one = lambda df, c, name: df.select(F.lit(name).alias("metric"), F.col(c).alias("value"))
    out = one(variance_removed(before, after), "percent", "variance_removed")
    for part in (
        one(rms_change(before, after), "rms", "rms_change"),
        one(max_change(before, after), "change", "max_change"),
        med(variance_ratio(before, after), "ratio", "variance_ratio"),
        one(geometric_ratio(psd_before, psd_after, 0.0, 1e9), "ratio", "geometric_ratio"),
        *(med(peak_attenuation(psd_before, psd_after, line * h, width), "db", f"attenuation_{h}") for h in range(1, harmonics + 2)),
        *(med(noise_surround(psd_after, line * h, width, 2.5 * width), "ratio", f"surround_{h}") for h in range(1, harmonics + 2)),
    ):
        out = out.unionByName(part)
    return out


def overcorrection(operator: DataFrame, leadfield: DataFrame) -> DataFrame:
    """What an operator (row, col, v) does to each source's topography (channel, source, gain): change of amplitude,
    correlation, relative error and goodness of fit."""
    moved = operator.join(leadfield, operator.col == leadfield.channel).groupBy("source", F.col("row").alias("channel")).agg(F.sum(F.col("v") * F.col("gain")).alias("new"))
    both = leadfield.join(moved, ["source", "channel"], "left").withColumn("new", F.coalesce("new", F.lit(0.0)))
    g, n = F.col("gain"), F.col("new")
    agg = both.groupBy("source").agg(F.sqrt(F.sum(g * g)).alias("norm"), F.sqrt(F.sum(n * n)).alias("kept"), F.corr(g, n).alias("correlation"), F.sqrt(F.sum((g - n) * (g - n))).alias("error"))
    return agg.select("source", (F.col("kept") / F.col("norm") - 1).alias("amplitude_change"), "correlation", (F.col("error") / F.col("norm")).alias("relative_error"), (1 - F.pow(F.col("error") / F.col("norm"), 2)).alias("goodness"))
