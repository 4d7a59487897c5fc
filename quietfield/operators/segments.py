"""A fit for each stretch of time in one pass, and operators of stretches applied with cross-fades.

Stretches are rows (k, lo, hi, own_lo, own_hi): a half-open span and the part of it that the stretch answers for; spans
overlap, owned parts meet. Samples meet their stretches by cells of time, second moments are summed by stretch, every
stretch is fitted where its sums are, and a table of operators meets the samples again: the number of scans and of jobs
doesn't depend on how many stretches there are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quietfield.operators.windows import overlap_add, raised_cosine
from quietfield.sources.signals import by_sample

SPANS = "k long, lo long, hi long, own_lo long, own_hi long"
HELD = 64  # stretches whose sums a task holds at once


def blocks(spark: SparkSession, n: int, size: int, hop: int) -> DataFrame:
    """Blocks of ``size`` samples every ``hop``, a last one that ends with the signal; owners change in the middle of
    overlaps. One block, if the signal isn't longer."""
    if hop < 1 or hop > size:
        raise ValueError(f"blocks of {size} samples can't start every {hop}")
    last = max(n - size, 0)
    count = -(-last // hop) + 1
    start = lambda k: F.least(k * hop, F.lit(last))
    k = F.col("id")
    middle = lambda a: F.floor((start(a) + start(a + 1) + size) / 2)
    return spark.range(count).select(
        k.alias("k"), start(k).alias("lo"), F.least(start(k) + size, F.lit(n)).alias("hi"),
        F.when(k == 0, 0).otherwise(middle(k - 1)).cast("long").alias("own_lo"), F.when(k == count - 1, n).otherwise(middle(k)).cast("long").alias("own_hi"),
    )


def around(spark: SparkSession, edges: list[tuple[int, int]], ramp: int, n: int) -> DataFrame:
    """Stretches that meet, each with a margin of ``ramp`` on both sides."""
    return spark.createDataFrame([(k, max(a - ramp, 0), min(b + ramp, n), a, b) for k, (a, b) in enumerate(edges)], SPANS)


def spread(rows: DataFrame, spans: DataFrame, cell: int) -> DataFrame:
    """Rows with every span that holds their t, by an equi-join on cells of time."""
    cells = spans.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") / cell), F.floor((F.col("hi") - 1) / cell))))
    return rows.withColumn("cell", F.floor(F.col("t") / cell)).join(cells, "cell").where((F.col("t") >= F.col("lo")) & (F.col("t") < F.col("hi"))).drop("cell")


def moments(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(k, sums): sums of z z' for z = (xs of each column, 1) by k, as flat arrays; rows where a column is null are left
    out. A task holds the sums of HELD stretches and gives those away that it saw longest ago."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}
        for f in frames:
            for k, g in f.groupby("k", sort=False):
                z = np.column_stack([*[np.stack(g[c].to_numpy()).astype(float) for c in columns], np.ones(len(g))])
                old = held.pop(k, None)
                held[k] = z.T @ z if old is None else old + z.T @ z
            while len(held) > HELD:
                k = next(iter(held))
                yield pd.DataFrame({"k": [k], "sums": [held.pop(k).ravel()]})
        if held:
            yield pd.DataFrame({"k": list(held), "sums": [m.ravel() for m in held.values()]})

    parts = rows.dropna(subset=columns).select("k", *columns).mapInPandas(run, "k long, sums array<double>")
    return parts.select("k", F.posexplode("sums").alias("i", "v")).groupBy("k", "i").agg(F.sum("v").alias("v")).groupBy("k").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("sums"))


def centred(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(population covariance, mean, count) of flat sums."""
    d = int(round(len(sums) ** 0.5))
    m = np.asarray(sums, float).reshape(d, d)
    mean = m[:-1, -1] / m[-1, -1]
    return m[:-1, :-1] / m[-1, -1] - np.outer(mean, mean), mean, float(m[-1, -1])


def fits(sums: DataFrame, fit: Callable[[int, dict[str, np.ndarray]], list[tuple]], schema: str) -> DataFrame:
    """Rows that ``fit(k, sums by name)`` gives for each stretch, of sums (k, one column of flat arrays each)."""
    names = [c for c in sums.columns if c != "k"]
    columns = [c.split()[0] for c in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [r for row in f.itertuples(index=False) for r in fit(int(row.k), {c: np.asarray(getattr(row, c), float) for c in names})]
            yield pd.DataFrame(rows, columns=columns)

    return sums.mapInPandas(run, schema)


def applied(signal: DataFrame, channels: list[str], spans: DataFrame, operators: DataFrame, cell: int) -> DataFrame:
    """The signal through operators (k, m, mean), xs -> mean + m (xs - mean), cross-faded where spans overlap.

    Samples of a span and a cell are a task's group, so spans may be longer than a task holds; an operator is copied to
    the cells of its span.
    """
    c = len(channels)
    met = spread(by_sample(signal), spans, cell).withColumn("part", F.floor(F.col("t") / cell))
    placed = operators.join(spans.select("k", F.explode(F.sequence(F.floor(F.col("lo") / cell), F.floor((F.col("hi") - 1) / cell))).alias("part")), "k")

    def run(f: pd.DataFrame, o: pd.DataFrame) -> pd.DataFrame:
        if f.empty or o.empty:
            return pd.DataFrame({"k": [], "t": [], "xs": []})
        m, mean = np.array(o["m"].iloc[0], float).reshape(c, c), np.array(o["mean"].iloc[0], float)
        x = np.stack(f["xs"].to_numpy()).astype(float)
        return pd.DataFrame({"k": f["k"], "t": f["t"], "xs": list(mean + (x - mean) @ m.T)})

    done = met.select("k", "part", "t", "xs").groupBy("k", "part").cogroup(placed.groupBy("k", "part")).applyInPandas(run, "k long, t long, xs array<double>")
    up, down = F.col("own_lo") - F.col("lo"), F.col("hi") - F.col("own_hi")
    t = F.col("t")
    rise = F.when((up > 0) & (t < F.col("own_lo") + up), raised_cosine(t - F.col("lo") + 1, 2 * up)).otherwise(1.0)
    fall = F.when((down > 0) & (t >= F.col("own_hi") - down), raised_cosine(F.col("hi") - t, 2 * down)).otherwise(1.0)
    faded = done.join(F.broadcast(spans) if spans.count() <= 1 << 16 else spans, "k").withColumn("taper", F.least(rise, fall))
    chunks = faded.select("taper", "t", F.posexplode("xs").alias("c", "x")).select(F.element_at(F.array(*map(F.lit, channels)), F.col("c") + 1).alias("channel"), "t", "x", "taper")
    return overlap_add(chunks)


def keyed(signal: DataFrame, spans: DataFrame, cell: int) -> DataFrame:
    """(channel, t, x) with a series of its own for each stretch and channel, t from 0: what works on channels works on
    all stretches at once and never crosses from one to another."""
    return spread(signal, spans, cell).select(F.concat_ws("|", F.col("k").cast("string"), "channel").alias("channel"), (F.col("t") - F.col("lo")).alias("t"), "x")


def unkeyed(series: DataFrame) -> DataFrame:
    """(k, t, xs) of keyed series, channels in order of name."""
    cut = series.select(F.substring_index("channel", "|", 1).cast("long").alias("k"), F.expr("substring(channel, instr(channel, '|') + 1)").alias("channel"), "t", "x")
    return cut.groupBy("k", "t").agg(F.transform(F.array_sort(F.collect_list(F.struct("channel", "x"))), lambda s: s["x"]).alias("xs"))
