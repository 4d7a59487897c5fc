"""Connected components by alternating large and small stars, every round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quietfield.llm.common import Scratch


def _print(edges: DataFrame) -> tuple[int, int]:
    r = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("h")).first()
    return r.n, r.h


def components(edges: DataFrame, scratch: Scratch, name: str, rounds: int = 60) -> DataFrame:
    """(v, comp) for every vertex of edges(a, b) in a component of two or more; comp is its least vertex.

    No vertex's neighbours are ever gathered: minima are aggregated and joined back, so a hub is only a skewed key.
    """
    now = edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = scratch.write(now, f"{name}-0", compact=True)
    mark = _print(now)
    for k in range(1, rounds + 1):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        now = scratch.write(small, f"{name}-{k}", compact=True)
        before, mark = mark, _print(now)
        scratch.drop(f"{name}-{k - 1}")
        if mark == before:
            break
    return now.select(F.col("a").alias("v"), F.col("b").alias("comp")).unionByName(now.select(F.col("b").alias("v"), F.col("b").alias("comp")).distinct())
