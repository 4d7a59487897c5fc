"""Means, covariances and robust statistics: each task adds up small matrices, and only those are shuffled."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quietfield.sources.signals import by_sample


def channel_means(signal: DataFrame, weight: str | None = None) -> DataFrame:
    w = F.lit(1.0) if weight is None else F.col(weight)
    return signal.groupBy("channel").agg((F.sum(w * F.col("x")) / F.sum(w)).alias("mean"))


def gram(samples: DataFrame, weight: str | None = None) -> tuple[np.ndarray, np.ndarray, float, int]:
    """(sum of w x x', sum of w x, sum of w, samples) of rows with an array xs; a matrix for each task is all that moves."""
    rows = samples.select("xs", (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("w"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for f in frames:
            if len(f):
                x = np.stack(f["xs"].to_numpy()).astype(float)
                x = np.column_stack([x, np.ones(len(x))])
                part = (x * f["w"].to_numpy()[:, None]).T @ x
                total = part if total is None else total + part
                n = len(f) if total is part else n + len(f)
        if total is not None:
            yield pd.DataFrame({"i": np.arange(len(total)), "row": list(total), "n": [n] * len(total)})

    parts = rows.mapInPandas(run, "i int, row array<double>, n long")
    flat = parts.select("i", "n", F.posexplode("row").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v"), F.sum("n").alias("n")).collect()
    if not flat:
        return np.zeros((0, 0)), np.zeros(0), 0.0, 0
    d = max(r.i for r in flat) + 1
    m = np.zeros((d, d))
    for r in flat:
        m[r.i, r.j] = r.v
    return m[:-1, :-1], m[:-1, -1], float(m[-1, -1]), flat[0].n


def covariance(samples: DataFrame, weight: str | None = None, centered: bool = False) -> tuple[np.ndarray, np.ndarray, float]:
    """Population covariance, means and total weight."""
    g, s, w, _ = gram(samples, weight)
    mean = s / w
    return g / w - (0 if centered else np.outer(mean, mean)), mean, w


def shrunk(cov: np.ndarray, intensity: float) -> np.ndarray:
    """Towards the mean variance on the diagonal."""
    return (1 - intensity) * cov + intensity * np.trace(cov) / len(cov) * np.eye(len(cov))


def shrinkage(samples: DataFrame, cov: np.ndarray, mean: np.ndarray, n: float) -> float:
    """Ledoit-Wolf intensity within [0, 1]; one more pass for the fourth moments."""
    sent = samples.sparkSession.sparkContext.broadcast(mean)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = 0.0
        for f in frames:
            if len(f):
                x = np.stack(f["xs"].to_numpy()).astype(float) - sent.value
                total += float(((x * x).sum(1) ** 2).sum())
        yield pd.DataFrame({"q": [total]})

    q = samples.select("xs").mapInPandas(run, "q double").agg(F.sum("q")).first()[0] or 0.0
    mu = np.trace(cov) / len(cov)
    delta = ((cov - mu * np.eye(len(cov))) ** 2).sum()
    beta = (q / n - (cov**2).sum()) / n
    return float(np.clip(beta / delta, 0, 1)) if delta > 1e-12 * max(mu * mu, 1e-300) else 0.0


def oas(cov: np.ndarray, n: float) -> float:
    """Oracle-approximating intensity."""
    p = len(cov)
    a, t = (cov**2).mean(), np.trace(cov) / p
    low = (n + 1.0) * (a - t * t / p)
    return 1.0 if low == 0 else min((a + t * t) / low, 1.0)


def min_covariance_determinant(x: np.ndarray, starts: int = 20, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance of the half of the rows of least determinant, by concentration steps. x is a bounded sample."""
    n, p = x.shape
    h, rng, best = (n + p + 1) // 2, np.random.default_rng(seed), None
    for _ in range(starts):
        rows = rng.choice(n, min(n, p + 1), replace=False)
        for _ in range(30):
            m, c = x[rows].mean(0), np.cov(x[rows].T, bias=True).reshape(p, p) + 1e-12 * np.eye(p)
            d = x - m
            new = np.sort(np.argsort((d @ np.linalg.pinv(c) * d).sum(1), kind="stable")[:h])
            if len(rows) == h and (new == rows).all():
                break
            rows = new
        det = np.linalg.slogdet(np.cov(x[rows].T, bias=True).reshape(p, p) + 1e-12 * np.eye(p))[1]
        if best is None or det < best[0]:
            best = det, x[rows].mean(0), np.cov(x[rows].T, bias=True).reshape(p, p)
    return best[1], best[2]


def robust_covariance(samples: DataFrame, start: int = 4096, rounds: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance of the half of all samples (t, xs) of least determinant.

    The search starts from a bounded sample (``start`` rows) and goes on by concentration steps over all rows: the half
    nearest to the mean so far, by a quantile of distances, gives the next mean and covariance.
    """
    x = np.array([row.xs for row in samples.orderBy(F.xxhash64("t")).limit(start).collect()], float)
    mean, cov = min_covariance_determinant(x)
    p, last = len(mean), np.inf
    for _ in range(rounds):
        far = distances(samples, mean, np.linalg.pinv(cov + 1e-12 * np.eye(p), hermitian=True))
        n = far.agg(F.count("*").alias("n")).first().n
        cut = far.agg(F.percentile_approx("d", ((n + p + 1) // 2) / n, 1_000_000).alias("d")).first().d
        cov, mean, _ = covariance(far.where(F.col("d") <= cut).select("t", "xs"))
        size = np.linalg.slogdet(cov + 1e-12 * np.eye(p))[1]
        if size >= last - 1e-9:
            break
        last = size
    return mean, cov


def distances(samples: DataFrame, mean: np.ndarray, inverse: np.ndarray) -> DataFrame:
    """(t, xs, d): squared distances from the mean by the inverse of a covariance."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                x = np.stack(f["xs"].to_numpy()).astype(float) - mean
                yield f.assign(d=np.einsum("ti,ij,tj->t", x, inverse, x))

    return samples.select("t", "xs").mapInPandas(run, "t long, xs array<double>, d double")


def pair_products(signal: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ci, cj, s, si, sj, n): sums of products of channel pairs within groups, from the sample layout.

    A sample's pairs are made and summed within its task before anything moves.
    """
    rows = signal.groupBy(*keys, "t").agg(F.array_sort(F.collect_list(F.struct("channel", "x"))).alias("v"))
    left = rows.select(*keys, "v", F.explode("v").alias("a"))
    pairs = left.select(*keys, F.col("a.channel").alias("ci"), F.col("a.x").alias("xi"), F.explode("v").alias("b"))
    pairs = pairs.select(*keys, "ci", "xi", F.col("b.channel").alias("cj"), F.col("b.x").alias("xj"))
    return pairs.groupBy(*keys, "ci", "cj").agg(F.sum(F.col("xi") * F.col("xj")).alias("s"), F.sum("xi").alias("si"), F.sum("xj").alias("sj"), F.count("*").alias("n"))


def block_covariances(signal: DataFrame, block: int, n: int, padded: bool = True) -> DataFrame:
    """(block, ci, cj, v): uncentred x x' / block of each block; a short last block is filled up with the last sample
    (padded) or divided by the full size all the same."""
    rows = signal
    short = n % block
    if padded and short:
        last = signal.where(F.col("t") == n - 1)
        rows = rows.unionByName(last.withColumn("t", F.explode(F.sequence(F.lit(n), F.lit(n - 1 + block - short)))))
    rows = rows.withColumn("block", F.floor(F.col("t") / block))
    return pair_products(rows, ["block"]).select("block", "ci", "cj", (F.col("s") / block).alias("v"))


def robust_scale(signal: DataFrame) -> DataFrame:
    """(channel, center, scale): median and 1.4826 times the median absolute deviation, else the standard deviation."""
    center = signal.groupBy("channel").agg(F.median("x").alias("center"), F.stddev_samp("x").alias("sd"))
    off = signal.join(F.broadcast(center), "channel").groupBy("channel").agg(F.first("center").alias("center"), F.first("sd").alias("sd"), (1.4826 * F.median(F.abs(F.col("x") - F.col("center")))).alias("mad"))
    return off.select("channel", "center", F.when(F.col("mad") > 0, F.col("mad")).otherwise(F.col("sd")).alias("scale"))


def automatic_mask(signal: DataFrame, threshold: float) -> DataFrame:
    """(t, on): the largest |x - median| / scale over channels is within the threshold."""
    s = robust_scale(signal)
    z = F.abs(F.col("x") - F.col("center")) / F.when(F.col("scale") > 0, F.col("scale")).otherwise(1.0)
    return signal.join(F.broadcast(s), "channel").groupBy("t").agg((F.max(z) <= threshold).alias("on"))


def histogram_mode(values: DataFrame, column: str) -> float | None:
    """Centre of the fullest bin of Freedman-Diaconis width."""
    q = values.agg(F.percentile(column, 0.25).alias("a"), F.percentile(column, 0.75).alias("b"), F.count(column).alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).first()
    if not q.n or q.hi == q.lo:
        return q.lo
    width = 2 * (q.b - q.a) / q.n ** (1 / 3)
    bins = max(1, int(np.ceil((q.hi - q.lo) / width))) if width > 0 else 1
    at = F.least(F.floor((F.col(column) - q.lo) / (q.hi - q.lo) * bins), F.lit(bins - 1))
    top = values.groupBy(at.alias("bin")).count().orderBy(F.desc("count"), "bin").first()
    return q.lo + (top.bin + 0.5) * (q.hi - q.lo) / bins


def channels_by_sample(signal: DataFrame) -> DataFrame:
    return by_sample(signal)


def sensor_whitener(signal: DataFrame, kinds: DataFrame | None = None) -> DataFrame:
    """(channel, w): one over the deviation of each channel, or of all channels of its kind (channel, kind)."""
    if kinds is None:
        return signal.groupBy("channel").agg((1 / F.stddev_pop("x")).alias("w"))
    of = kinds.select("channel", "kind")
    w = signal.join(F.broadcast(of), "channel").groupBy("kind").agg((1 / F.stddev_pop("x")).alias("w"))
    return of.join(w, "kind").select("channel", "w")


def padded(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """(key, xs): ragged rows as arrays of the longest one's length, filled up with NaN. The longest row's length is one
    number that an aggregation gives."""
    lists = rows.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda s: s[value].cast("double")).alias("xs"))
    most = lists.agg(F.max(F.size("xs")).alias("most"))
    return lists.crossJoin(F.broadcast(most)).select(key, F.concat("xs", F.array_repeat(F.lit(float("nan")), F.col("most") - F.size("xs"))).alias("xs"))
