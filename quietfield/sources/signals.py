"""Signals: long tables (channel, t, x), and how tables of events, vectors and orders become such.

``t`` counts samples from 0 without gaps; a channel is a string. Layouts: long (one value a row), by sample (t, xs: one
array a sample, channels in order), and by channel (channel, xs).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def write_signal(signal: DataFrame, path: str) -> None:
    """Sorted within files by channel and time, so that scans of a channel or a stretch skip row groups."""
    signal.repartitionByRange("channel", "t").sortWithinPartitions("channel", "t").write.mode("overwrite").parquet(path)


def read_signal(spark: SparkSession, path: str, channels: list[str] | None = None, start: int | None = None, stop: int | None = None) -> DataFrame:
    """A stored signal; channels and the half-open stretch are pushed down to the scan."""
    out = spark.read.parquet(path)
    if channels is not None:
        out = out.where(F.col("channel").isin(channels))
    if start is not None:
        out = out.where(F.col("t") >= start)
    if stop is not None:
        out = out.where(F.col("t") < stop)
    return out


def restore_channels(cleaned: DataFrame, template: DataFrame) -> DataFrame:
    """The template with the channels of ``cleaned`` put in place; all others as they are."""
    others = template.join(F.broadcast(cleaned.select("channel").distinct()), "channel", "left_anti")
    return others.unionByName(cleaned.select(*template.columns))


def dense(found: DataFrame, step: str = "slot") -> DataFrame:
    """(channel, slot, x) on the full grid of channels and slots from the first to the last, missing values 0; t from 0."""
    lo, hi = found.agg(F.min(step), F.max(step)).first()
    if lo is None:
        return found.select("channel", F.col(step).alias("t"), "x")
    grid = found.select("channel").distinct().select("channel", F.explode(F.sequence(F.lit(lo).cast("long"), F.lit(hi).cast("long"))).alias(step))
    return grid.join(found, ["channel", step], "left").select("channel", (F.col(step) - lo).alias("t"), F.coalesce("x", F.lit(0.0)).alias("x"))


def day_number(ts: Column) -> Column:
    return F.datediff(F.to_date(ts), F.lit("1970-01-01")).cast("long")


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum of event values for each type and hour."""
    events = table(spark, sf_dir, "events")
    slot = day_number(F.col("ts")) * 24 + F.hour("ts")
    return dense(events.groupBy(F.col("event_type").alias("channel"), slot.alias("slot")).agg(F.sum("value").alias("x")))


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum of order prices for each priority and day, in thousands."""
    orders = table(spark, sf_dir, "orders")
    return dense(orders.groupBy(F.col("o_orderpriority").alias("channel"), day_number(F.col("o_orderdate")).alias("slot")).agg((F.sum("o_totalprice") / 1000).alias("x")))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The components of the embeddings as channels e0, e1, ..., in order of vec_id."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("t"), F.posexplode("embedding").alias("c", "x"))
    return rows.select(F.concat(F.lit("e"), F.col("c").cast("string")).alias("channel"), "t", F.col("x").cast("double").alias("x"))


def by_sample(signal: DataFrame) -> DataFrame:
    """(t, xs): channels in order of name."""
    return signal.groupBy("t").agg(F.transform(F.array_sort(F.collect_list(F.struct("channel", "x"))), lambda s: s["x"]).alias("xs"))


def channels_of(signal: DataFrame) -> list[str]:
    return sorted(r.channel for r in signal.select("channel").distinct().collect())


def long_from_samples(samples: DataFrame, channels: list[str]) -> DataFrame:
    names = F.array(*map(F.lit, channels))
    return samples.select("t", F.posexplode("xs").alias("c", "x")).select(F.element_at(names, F.col("c") + 1).alias("channel"), "t", "x")


def pick_kind(channels: DataFrame) -> DataFrame:
    """Channels of the one kind that stands first among mag, grad, eeg; (channel, kind, bad) rows."""
    rank = F.when(F.col("kind") == "mag", 0).when(F.col("kind") == "grad", 1).when(F.col("kind") == "eeg", 2)
    first = channels.agg(F.min(rank).alias("first"))
    return channels.join(F.broadcast(first), rank == F.col("first"), "left_semi")


def pick_data(channels: DataFrame, names: list[str] | None = None, exclude_bads: bool = False) -> DataFrame:
    """Explicit names, or all kinds that carry data, without bad channels if asked for."""
    kinds = ("mag", "grad", "eeg", "seeg", "ecog", "dbs", "fnirs", "csd")
    out = channels.where(F.col("channel").isin(names) if names is not None else F.col("kind").isin(*kinds))
    return out.where(~F.col("bad")) if exclude_bads else out


def to_epochs(signal: DataFrame, length: int) -> DataFrame:
    """(channel, epoch, t within, x) of consecutive epochs; an incomplete last one is left out."""
    n = signal.agg((F.max("t") + 1).alias("n")).first().n or 0
    return signal.where(F.col("t") < n // length * length).select("channel", F.floor(F.col("t") / length).alias("epoch"), (F.col("t") % length).alias("t"), "x")


def from_epochs(epochs: DataFrame, length: int) -> DataFrame:
    return epochs.select("channel", (F.col("epoch") * length + F.col("t")).alias("t"), "x")
