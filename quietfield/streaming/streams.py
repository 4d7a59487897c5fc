"""Streams: operators that carry state from batch to batch, and give what the batch operators give."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quietfield.functions import linalg as L
from quietfield.operators.asr import State
from quietfield.plans.tables import shared_dir
from quietfield.sources import signals as S
from quietfield.streaming.repair import Repairer, repaired


def running_mean_state(signal: DataFrame, window: int) -> DataFrame:
    """Causal mean of the last ``window`` samples of a stream of (channel, t, x) that comes in order for each channel.

    The state of a channel is its last window - 1 samples, so it is bounded whatever the length of the stream.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        f = pd.concat(list(frames)).sort_values("t")
        kept = np.array(state.get[0], float) if state.exists else np.zeros(0)
        x = np.concatenate([kept, f["x"].to_numpy(float)])
        sums = np.concatenate([[0.0], np.cumsum(x)])
        hi = np.arange(len(kept) + 1, len(x) + 1)
        lo = np.maximum(hi - window, 0)
        state.update((x[-(window - 1) :].tolist() if window > 1 else [],))
        yield pd.DataFrame({"channel": key[0], "t": f["t"].to_numpy(), "x": (sums[hi] - sums[lo]) / (hi - lo)})

    return signal.groupBy("channel").applyInPandasWithState(run, "channel string, t long, x double", "kept array<double>", "append", GroupStateTimeout.NoTimeout)


def _fed(spark: SparkSession, signal: DataFrame, parts: int, make, name: str) -> DataFrame:
    """Write a signal as files of consecutive stretches, stream them one by one, and read the sink."""
    root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    n = (signal.agg(F.max("t")).first()[0] or 0) + 1
    signal = signal.persist()
    for k in range(parts):
        signal.where((F.col("t") >= k * n // parts) & (F.col("t") < (k + 1) * n // parts)).coalesce(1).write.mode("append").parquet(f"{root}/in")
    signal.unpersist()
    stream = spark.readStream.schema(signal.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    run = make(stream).writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(f"{root}/out")


def running_mean_stream(spark: SparkSession, sf_dir: str, window: int, parts: int = 3) -> DataFrame:
    return _fed(spark, S.hourly(spark, sf_dir), parts, lambda s: running_mean_state(s, window), "mean")


def adaptive_state(samples: DataFrame, window: int, cutoff: float, decay: float = 0.995) -> DataFrame:
    """Adaptive repair of a stream of (rec, t, xs): directions whose variance over the last window exceeds ``cutoff``
    times their share of a slowly updated covariance are taken out. State: that covariance and the last window.

    A batch's state is replaced only after all of it has been worked out, so a failed batch is done again whole.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        f = pd.concat(list(frames)).sort_values("t")
        x = np.stack(f["xs"].to_numpy()).astype(float)
        c = x.shape[1]
        if state.exists:
            flat, kept = state.get
            base, past = np.array(flat).reshape(c, c), np.array(kept).reshape(-1, c)
        else:
            base, past = np.cov(x.T, bias=True).reshape(c, c) + 1e-9 * np.eye(c), np.zeros((0, c))
        every = np.concatenate([past, x])
        out = np.empty_like(x)
        step = max(1, window // 2)
        for lo in range(0, len(x), step):
            hi = min(lo + step, len(x))
            seen = every[max(0, len(past) + hi - window) : len(past) + hi]
            cov = seen.T @ seen / window
            v, u = np.linalg.eigh(cov)
            limit = cutoff * np.einsum("ik,ij,jk->k", u, base, u)
            keep = v <= limit
            root = L.spd_map(base, np.sqrt)
            r = np.eye(c) if keep.all() else root @ np.linalg.pinv(keep[:, None] * (u.T @ root)) @ u.T
            out[lo:hi] = x[lo:hi] @ r.T
            if keep.all():
                base = decay * base + (1 - decay) * cov
        state.update((base.ravel().tolist(), every[-window:].ravel().tolist()))
        yield pd.DataFrame({"rec": key[0], "t": f["t"].to_numpy(), "xs": list(out)})

    return samples.groupBy("rec").applyInPandasWithState(run, "rec string, t long, xs array<double>", "base array<double>, kept array<double>", "append", GroupStateTimeout.NoTimeout)


def adaptive_repair(spark: SparkSession, sf_dir: str, window: int = 24, cutoff: float = 4.0) -> DataFrame:
    rows = S.by_sample(S.hourly(spark, sf_dir)).select(F.lit("hourly").alias("rec"), "t", "xs")
    return _fed(spark, rows, 3, lambda s: adaptive_state(s, window, cutoff), "repair")


def repair(spark: SparkSession, signal: DataFrame, state: State, rate: float, length: float = 0.5, step: int | None = None, parts: int = 5) -> DataFrame:
    """(channel, t, x): a signal fed in chunks through the repair with carried state; what asr.process gives for it."""
    rows = S.by_sample(signal)
    ended = rows.crossJoin(F.broadcast(signal.agg(F.max("t").alias("end")))).select(F.lit("all").alias("rec"), "t", "xs", (F.col("t") == F.col("end")).alias("last"))
    done = _fed(spark, ended, parts, lambda s: repaired(s, Repairer.of(state, rate, length, step)), "asr")
    return S.long_from_samples(done, state.channels)


def windowed_rates(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts and sums of a stream of events by kind and window, with a bound on how late a row may be."""
    stamped = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return stamped.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
