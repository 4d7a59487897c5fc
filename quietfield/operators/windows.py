"""Operators on stretches of time. Frames are bounded, so each is worked out in blocks of time with a margin:
a long channel is many tasks, not one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1 << 16


def blocked(signal: DataFrame, before: int, after: int, block: int = BLOCK, keys: tuple[str, ...] = ("channel",)) -> tuple[DataFrame, Window, Column]:
    """Rows copied to every block whose frames reach them, the window within a block, and which rows are its own."""
    at = lambda t: F.floor(t / block)
    t = F.col("t")
    out = signal.withColumn("block", F.explode(F.sequence(at(t - after), at(t + before)))) if before or after else signal.withColumn("block", at(t))
    return out, Window.partitionBy(*keys, "block").orderBy("t"), at(t) == F.col("block")


def framed(signal: DataFrame, before: int, after: int, make, name: str = "x", block: int = BLOCK) -> DataFrame:
    """``make(window)`` over the frame [t - before, t + after]; ``before`` and ``after`` are in samples."""
    out, window, own = blocked(signal, before, after, block)
    return out.withColumn(name, make(window)).where(own).drop("block")


def running_mean(signal: DataFrame, window: int, iterations: int = 1, block: int = BLOCK) -> DataFrame:
    """Causal mean of the last ``window`` samples, of fewer at the start."""
    for _ in range(iterations):
        signal = framed(signal, window - 1, 0, lambda w: F.avg("x").over(w.rowsBetween(1 - window, 0)), block=block)
    return signal


def moving_average(signal: DataFrame, window: int, block: int = BLOCK) -> DataFrame:
    """Sum of the last ``window`` samples over ``window``, as if zeros came before."""
    return framed(signal, window - 1, 0, lambda w: F.sum("x").over(w.rowsBetween(1 - window, 0)) / window, block=block)


def lag_average(signal: DataFrame, lags: list[int], weighting: str = "uniform", block: int = BLOCK) -> DataFrame:
    """(Weighted) mean of x[t + lag] where all lags exist, else 0; weights 1/|lag| (1 for lag 0) if inverse."""
    weight = {k: (1.0 if weighting == "uniform" or k == 0 else 1.0 / abs(k)) for k in lags}
    total = sum(weight.values())

    def make(w: Window) -> Column:
        parts = [F.lead("x", k).over(w) if k >= 0 else F.lag("x", -k).over(w) for k in lags]
        mean = sum((p * weight[k] for p, k in zip(parts, lags, strict=True)), F.lit(0.0)) / total
        return F.coalesce(mean, F.lit(0.0))

    return framed(signal, max(0, -min(lags)), max(0, max(lags)), make, block=block)


def lag_features(signal: DataFrame, lags: list[int], block: int = BLOCK) -> DataFrame:
    """(channel, lag, t, x): x[t - lag] for every lag, where all exist."""
    out, w, own = blocked(signal, max(0, max(lags)), max(0, -min(lags)), block)
    made = out.select("channel", "t", own.alias("own"), F.array(*[F.lag("x", k).over(w) if k >= 0 else F.lead("x", -k).over(w) for k in lags]).alias("xs"))
    made = made.where("own").where(F.forall("xs", lambda v: v.isNotNull()))
    names = F.array(*map(F.lit, lags))
    return made.select("channel", "t", F.posexplode("xs").alias("k", "x")).select("channel", F.element_at(names, F.col("k") + 1).alias("lag"), "t", "x")


def lagged_pairs(signal: DataFrame, lag: int, block: int = BLOCK) -> DataFrame:
    """(channel, t, x, past): each sample with the one ``lag`` before."""
    return framed(signal, lag, 0, lambda w: F.lag("x", lag).over(w), "past", block).where("past is not null")


def reflected(signal: DataFrame, half: int, n: int) -> DataFrame:
    """The signal with its edges mirrored, edge sample repeated: d c b a | a b c d | d c b a."""
    head = signal.where(F.col("t") < half).withColumn("t", -1 - F.col("t"))
    tail = signal.where(F.col("t") >= n - half).withColumn("t", 2 * n - 1 - F.col("t"))
    return signal.unionByName(head).unionByName(tail)


def odd_reflected(signal: DataFrame, half: int, n: int) -> DataFrame:
    """The signal with its edges turned about the edge sample: 2 x[0] - x[t] before, 2 x[n-1] - x[t] after."""
    ends = signal.where((F.col("t") == 0) | (F.col("t") == n - 1))
    first = ends.where("t = 0").select("channel", F.col("x").alias("e"))
    last = ends.where(F.col("t") == n - 1).select("channel", F.col("x").alias("e"))
    head = signal.where((F.col("t") >= 1) & (F.col("t") <= half)).join(first, "channel").select("channel", (-F.col("t")).alias("t"), (2 * F.col("e") - F.col("x")).alias("x"))
    tail = signal.where((F.col("t") < n - 1) & (F.col("t") >= n - 1 - half)).join(last, "channel").select("channel", (2 * (n - 1) - F.col("t")).alias("t"), (2 * F.col("e") - F.col("x")).alias("x"))
    return signal.select("channel", "t", "x").unionByName(head).unionByName(tail)


def local_mean(signal: DataFrame, window: int, n: int, block: int = BLOCK) -> DataFrame:
    """Centred mean of ``window`` samples with mirrored edges (an even window reaches one further back)."""
    back = window // 2
    ahead = window - 1 - back
    out = framed(reflected(signal, window, n), back, ahead, lambda w: F.avg("x").over(w.rowsBetween(-back, ahead)), "mean", block)
    return out.where((F.col("t") >= 0) & (F.col("t") < n))


def local_variance(signal: DataFrame, window: int, n: int, block: int = BLOCK) -> DataFrame:
    """Centred variance of ``window`` samples with mirrored edges: mean of squares less the square of the mean."""
    back = window // 2
    ahead = window - 1 - back

    def make(w: Window) -> Column:
        f = w.rowsBetween(-back, ahead)
        return F.greatest(F.avg(F.col("x") * F.col("x")).over(f) - F.pow(F.avg("x").over(f), 2), F.lit(0.0))

    out = framed(reflected(signal, window, n), back, ahead, make, "var", block)
    return out.where((F.col("t") >= 0) & (F.col("t") < n))


def fractional_starts(n: int, window: int, overlap: float) -> list[int]:
    """Window starts on a fractional step; the last full window is not among them."""
    step = window * (1 - overlap)
    found, k = [], 0
    while 1 + k * step < n - window + 2.220446049250313e-16:
        found.append(int((1 + k * step) + 0.5) - 1)
        k += 1
    return sorted(set(found))


def window_starts(n: int, window: int, step: int) -> list[int]:
    """Starts by a whole step, with a last window that ends with the signal."""
    found = list(range(0, n - window + 1, step))
    if found and found[-1] != n - window:
        found.append(n - window)
    return found


def in_windows(signal: DataFrame, starts: list[int], length: int) -> DataFrame:
    """Rows with each window (its start) that covers them, by an equi-join on blocks of ``length`` samples.

    A window meets at most two blocks, so each start is sent to those alone.
    """
    spark = signal.sparkSession
    begin = spark.createDataFrame([(int(s),) for s in starts], "start long")
    spread = begin.select("start", F.explode(F.sequence(F.floor(F.col("start") / length), F.floor((F.col("start") + length - 1) / length))).alias("cell"))
    cut = signal.withColumn("cell", F.floor(F.col("t") / length))
    return cut.join(spread, "cell").where((F.col("t") >= F.col("start")) & (F.col("t") < F.col("start") + length)).drop("cell")


def window_rms(signal: DataFrame, starts: list[int], length: int) -> DataFrame:
    return in_windows(signal, starts, length).groupBy("channel", "start").agg(F.sqrt(F.sum(F.col("x") * F.col("x")) / length).alias("rms"))


def overlap_add(chunks: DataFrame, floor: float = 1e-10) -> DataFrame:
    """(channel, t, x) from overlapping (channel, t, x, taper): weighted means."""
    return chunks.groupBy("channel", "t").agg((F.sum(F.col("x") * F.col("taper")) / F.greatest(F.sum("taper"), F.lit(floor))).alias("x"))


def raised_cosine(k: Column, width: int) -> Column:
    """Ramp (1 - cos(pi k / width)) / 2 for k = 1..width."""
    return (1 - F.cos(F.lit(3.141592653589793) * k / width)) / 2


def cross_faded(signal: DataFrame, starts: list[int], length: int, ramp: int) -> DataFrame:
    """Chunks of the signal with tapers for overlap_add: 1 inside, raised cosines over ``ramp`` samples at inner edges."""
    k = F.col("t") - F.col("start") + 1
    back = F.col("start") + length - F.col("t")
    first, last = min(starts), max(starts)
    up = F.when((F.col("start") > first) & (k <= ramp), raised_cosine(k, ramp)).otherwise(1.0)
    down = F.when((F.col("start") < last) & (back <= ramp), raised_cosine(back, ramp)).otherwise(1.0)
    return in_windows(signal, starts, length).withColumn("taper", F.least(up, down))


def lag_weights(weights: DataFrame, lags: list[int], block: int = BLOCK) -> DataFrame:
    """(channel, t, w): the least weight among the samples that a lagged row is made of; x holds the weights."""
    made = framed(weights, max(0, max(lags)), max(0, -min(lags)), lambda w: F.array(*[F.lag("x", k).over(w) if k >= 0 else F.lead("x", -k).over(w) for k in lags]), "ws", block)
    return made.where(F.forall("ws", lambda v: v.isNotNull())).select("channel", "t", F.array_min("ws").alias("w"))
