"""Masks, spans and events: half-open stretches [start, stop) of samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELL = 1 << 12


def round_half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def mask_to_spans(mask: DataFrame, cell: int = 1 << 16) -> DataFrame:
    """Runs of true in (channel, t, on): found in cells of time, which are tasks of their own, and joined where they touch."""
    on = mask.where("on").withColumn("cell", F.floor(F.col("t") / cell))
    key = F.col("t") - F.row_number().over(Window.partitionBy("channel", "cell").orderBy("t"))
    runs = on.withColumn("run", key).groupBy("channel", "cell", "run").agg(F.min("t").alias("start"), (F.max("t") + 1).alias("stop"))
    return merge_spans(runs.select("channel", "start", "stop"))


def merge_spans(spans: DataFrame, cell: int = 1 << 20) -> DataFrame:
    """Touching and overlapping spans of a channel as one.

    Spans are cut at the borders of cells of time and merged within cells, which are tasks of their own. Only what then
    touches a border is carried over it: two rows a cell at most, so a channel of any length has few to put in order.
    """
    last = F.floor((F.greatest(F.col("stop"), F.col("start") + 1) - 1) / cell)
    cut = spans.select("channel", "start", "stop", F.explode(F.sequence(F.floor(F.col("start") / cell), last)).alias("cell"))
    cut = cut.select("channel", "cell", F.greatest("start", F.col("cell") * cell).alias("start"), F.least("stop", (F.col("cell") + 1) * cell).alias("stop"))
    w = Window.partitionBy("channel", "cell").orderBy("start", "stop")
    reach = F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(reach.isNull() | (F.col("start") > reach), 1).otherwise(0)
    run = cut.withColumn("new", new).withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    pieces = run.groupBy("channel", "cell", "run").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    border = (F.col("start") == F.col("cell") * cell) | (F.col("stop") == (F.col("cell") + 1) * cell)
    along = Window.partitionBy("channel").orderBy("start", "stop")
    fresh = (~F.lag("stop").over(along).eqNullSafe(F.col("start"))).cast("int")
    carried = pieces.where(border).withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    joined = carried.groupBy("channel", "run").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("run")
    return joined.unionByName(pieces.where(~border).select("channel", "start", "stop"))


def _cells(spans: DataFrame) -> DataFrame:
    return spans.withColumn("cell", F.explode(F.sequence(F.floor(F.col("start") / CELL), F.floor((F.greatest(F.col("stop"), F.col("start") + 1) - 1) / CELL))))


def within(signal: DataFrame, spans: DataFrame, how: str = "left_semi") -> DataFrame:
    """Samples inside (left_semi) or outside (left_anti) any span, by an equi-join on cells of time."""
    s = _cells(spans).select(F.col("channel").alias("c"), F.col("cell").alias("k"), "start", "stop")
    cut = signal.withColumn("cell", F.floor(F.col("t") / CELL))
    return cut.join(s, (cut.channel == s.c) & (cut.cell == s.k) & (cut.t >= s.start) & (cut.t < s.stop), how).drop("cell")


def annotation_spans(notes: DataFrame, rate: float, first: int = 0) -> DataFrame:
    """(onset, duration) in seconds to sample spans, the start rounded down and the stop up."""
    return notes.withColumns({"start": F.floor((F.col("onset") - first / rate) * rate).cast("long"), "stop": F.ceil((F.col("onset") + F.col("duration") - first / rate) * rate).cast("long")})


def span_annotations(spans: DataFrame, rate: float, label: str) -> DataFrame:
    return spans.select("channel", (F.col("start") / rate).alias("onset"), ((F.col("stop") - F.col("start")) / rate).alias("duration"), F.lit(label).alias("label"))


def prefixed(notes: DataFrame, prefixes: list[str]) -> DataFrame:
    """Annotations whose label begins with a prefix, whatever the case."""
    low = F.lower("label")
    test = F.lit(False)
    for p in prefixes:
        test = test | low.startswith(p.lower())
    return notes.where(test)


def fixed_segments(n: int, length: int) -> list[tuple[int, int]]:
    """Consecutive segments; a tail shorter than half of one belongs to the last."""
    edges = list(range(0, n, length)) or [0]
    if len(edges) > 1 and n - edges[-1] < length / 2:
        edges.pop()
    return list(zip(edges, [*edges[1:], n], strict=True))


def block_bounds(n: int, block: int, hop: int) -> list[tuple[int, int, int, int]]:
    """(start, stop, own start, own stop) of blocks by ``hop``, the last one ending with the signal; owners change in
    the middle of an overlap."""
    starts = list(range(0, max(n - block, 0) + 1, hop))
    if starts[-1] + block < n:
        starts.append(n - block)
    stops = [min(s + block, n) for s in starts]
    middle = [(a + b) // 2 for a, b in zip(starts[1:], stops[:-1], strict=True)]
    return list(zip(starts, stops, [0, *middle], [*middle, n], strict=True))


def epoch_average(epochs: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """Mean over epochs at each time, given back to every epoch; (epoch, w) weights, 0 where all are 0."""
    rows = epochs if weights is None else epochs.join(weights, "epoch")
    w = F.lit(1.0) if weights is None else F.col("w")
    mean = rows.groupBy("channel", "t").agg(F.coalesce(F.try_divide(F.sum(w * F.col("x")), F.sum(w)), F.lit(0.0)).alias("mean"))
    return epochs.join(mean, ["channel", "t"]).select("channel", "epoch", "t", F.col("mean").alias("x"))


def cycle_average(signal: DataFrame, events: DataFrame, before: int, after: int, n: int) -> DataFrame:
    """Mean over events of x[event + k], k in [-before, after), written back to every event's stretch; where stretches
    overlap their mean, and 0 elsewhere. Events whose stretch leaves the signal are left out."""
    at = events.select("event").distinct().where((F.col("event") - before >= 0) & (F.col("event") + after <= n))
    reach = at.select("event", F.explode(F.sequence(F.lit(-before), F.lit(after - 1))).alias("k")).withColumn("t", F.col("event") + F.col("k"))
    met = signal.join(reach, "t")
    mean = met.groupBy("channel", "k").agg(F.avg("x").alias("mean"))
    back = met.select("channel", "t", "k").join(mean, ["channel", "k"]).groupBy("channel", "t").agg(F.avg("mean").alias("y"))
    return signal.join(back, ["channel", "t"], "left").select("channel", "t", F.coalesce("y", F.lit(0.0)).alias("x"))
