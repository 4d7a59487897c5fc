"""Density clusters of samples in the chessboard metric, exactly, and without comparing all samples of a cell.

Samples lie in cells as wide as the radius, so those of one cell are all neighbours and others only in adjacent cells.
Cells are cut to finer ones and these to blocks of bounded size with boxes. Two boxes say of two blocks that no pair, or
that every pair of their samples is within the radius; only of blocks about which boxes can't tell are samples compared.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quietfield.plans.tables import kept

FINE, MOST = 4, 512  # finer cells along a cell's side; samples of a block, about


def components(edges: DataFrame, nodes: DataFrame, rounds: int = 100) -> DataFrame:
    """(v, label) for nodes(v) under edges(a, b): the least node of each component.

    Each round takes the least label of the neighbours and then that node's own label, so paths halve.
    """
    both = kept(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    now = nodes.select("v", F.col("v").alias("label"))
    for _ in range(rounds):
        near = both.join(now, both.b == now.v).groupBy("a").agg(F.min("label").alias("near"))
        least = now.join(near, now.v == near.a, "left").select("v", "label", F.least("label", F.coalesce("near", "label")).alias("new"))
        jump = least.select(F.col("v").alias("through"), F.col("new").alias("there"))
        new = kept(least.join(jump, F.col("new") == F.col("through"), "left").select("v", F.col("label").alias("old"), F.least("new", F.coalesce("there", "new")).alias("label")), "labels")
        now = new.select("v", "label")
        if new.where("old != label").isEmpty():
            break
    return now


def _blocks(points: DataFrame, eps: float, dims: int, most: int) -> DataFrame:
    """(block, cell, n, lo, hi, points): samples (t, f) in blocks; a full finer cell is several blocks, by hash."""
    fine = points.select("t", "f", F.transform("f", lambda v: F.floor(v / (eps / FINE))).alias("sub"))
    parts = fine.groupBy("sub").agg(F.ceil(F.count("*") / most).cast("int").alias("parts"))
    dealt = fine.join(parts, "sub").withColumn("part", F.pmod(F.xxhash64("t"), F.col("parts")))
    name = F.concat_ws(":", F.concat_ws(",", F.transform("sub", lambda v: v.cast("string"))), F.col("part").cast("string"))
    ends = lambda pick: F.array(*[pick(F.col("f")[i]) for i in range(dims)])
    grouped = dealt.groupBy(name.alias("block"), F.transform("sub", lambda v: F.floor(v / FINE)).alias("cell"))
    return grouped.agg(F.count("*").alias("n"), ends(F.min).alias("lo"), ends(F.max).alias("hi"), F.collect_list(F.struct("t", "f")).alias("points"))


def _pairs(left: DataFrame, right: DataFrame, eps: float, dims: int, *carried: Column) -> DataFrame:
    """(a, cell_a, b, cell_b, n, sure, carried) for blocks of the same or adjacent cells that may have neighbours."""
    steps = F.array(*[F.array(*map(F.lit, s)) for s in itertools.product((-1, 0, 1), repeat=dims)])
    a = left.select(F.col("block").alias("a"), F.col("cell").alias("cell_a"), F.col("lo").alias("lo_a"), F.col("hi").alias("hi_a"), F.explode(steps).alias("step"))
    a = a.withColumn("cell_b", F.zip_with("cell_a", "step", lambda c, s: c + s)).drop("step")
    b = right.select(F.col("block").alias("b"), F.col("cell").alias("cell_b"), F.col("lo").alias("lo_b"), F.col("hi").alias("hi_b"), "n", *carried)
    over = lambda x, y: F.zip_with(x, y, lambda p, q: p - q)
    apart = F.array_max(F.concat(over("lo_a", "hi_b"), over("lo_b", "hi_a")))
    across = F.array_max(F.concat(over("hi_a", "lo_b"), over("hi_b", "lo_a")))
    met = a.join(b, "cell_b").withColumn("apart", apart).withColumn("sure", across <= eps).where(F.col("apart") <= eps)
    return met.drop("lo_a", "hi_a", "lo_b", "hi_b", "apart")


def _compared(pairs: DataFrame, left: DataFrame, right: DataFrame, eps: float, make, schema: str) -> DataFrame:
    """make(row, times of left samples, left by right: whether within eps) for each pair (a, b)."""
    met = pairs.join(left.select(F.col("block").alias("a"), F.col("points").alias("one")), "a").join(right.select(F.col("block").alias("b"), F.col("points").alias("two")), "b")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for r in f.itertuples(index=False):
                x, y = (np.array([p["f"] for p in side], float) for side in (r.one, r.two))
                out.append(make(r, np.array([p["t"] for p in r.one]), (np.abs(x[:, None] - y[None]).max(2)) <= eps))
            if out:
                yield pd.concat(out)

    return met.mapInPandas(run, schema)


def core_samples(points: DataFrame, eps: float, least: int, dims: int, most: int = MOST) -> DataFrame:
    """(t, f, core): whether at least ``least`` samples, itself among them, are within eps of a sample."""
    blocks = kept(_blocks(points, eps, dims, most), "blocks")
    full = blocks.groupBy("cell").agg(F.sum("n").alias("all"))
    state = blocks.join(full, "cell")
    sure = state.where(F.col("all") >= least)
    left = state.where(F.col("all") < least)
    pairs = kept(_pairs(left, blocks, eps, dims), "pairs")
    bounds = pairs.groupBy("a").agg(F.sum(F.when(F.col("sure"), F.col("n")).otherwise(0)).alias("low"), F.sum("n").alias("high"))
    judged = left.join(bounds, left.block == bounds.a)
    open_ = judged.where((F.col("low") < least) & (F.col("high") >= least)).select("block", "low", "points")
    asked = pairs.where("NOT sure").select("a", "b").join(open_.select(F.col("block").alias("a"), "low"), "a")
    count = lambda r, t, near: pd.DataFrame({"t": t, "c": near.sum(1)})
    found = _compared(asked, open_, blocks, eps, count, "t long, c long").groupBy("t").agg(F.sum("c").alias("c"))
    each = lambda df, core: df.select(F.explode("points").alias("p"), core.alias("core"), *(["low"] if "low" in df.columns else [])).select("p.t", "p.f", "core", *(["low"] if "low" in df.columns else []))
    counted = each(open_, F.lit(False)).join(found, "t", "left").select("t", "f", (F.col("low") + F.coalesce("c", F.lit(0)) >= least).alias("core"))
    rest = judged.where((F.col("low") >= least) | (F.col("high") < least))
    return each(sure, F.lit(True)).unionByName(each(rest, F.col("low") >= least).select("t", "f", "core")).unionByName(counted)


def clusters(points: DataFrame, eps: float, least: int, dims: int, most: int = MOST) -> DataFrame:
    """(t, cluster, core) of samples (t, f), f an array of ``dims`` values: density clusters in the chessboard metric.

    A sample is core if ``least`` samples are within eps of it; core samples within eps are of one cluster, which is named
    by the least t of its core samples; another sample goes to the least of the clusters that have a core sample within eps
    of it, or to none (null).
    """
    if not eps > 0:
        raise ValueError(f"a radius of {eps}")
    judged = kept(core_samples(points, eps, least, dims, most), "judged")
    key = lambda c: F.concat_ws(",", F.transform(c, lambda v: v.cast("string")))
    cores = kept(_blocks(judged.where("core"), eps, dims, most).withColumn("first", F.array_min(F.transform("points", lambda p: p["t"]))), "cores")
    others = kept(_blocks(judged.where("NOT core"), eps, dims, most), "others")

    met = kept(_pairs(cores, cores, eps, dims).where(F.col("cell_a") < F.col("cell_b")), "met")
    linked = met.where("sure").select("cell_a", "cell_b").distinct()
    asked = met.join(linked, ["cell_a", "cell_b"], "left_anti").withColumn("x", key("cell_a")).withColumn("y", key("cell_b"))
    touch = lambda r, t, near: pd.DataFrame({"x": [r.x], "y": [r.y]} if near.any() else {"x": [], "y": []}, dtype=str)
    close = _compared(asked.select("a", "b", "x", "y"), cores, cores, eps, touch, "x string, y string").distinct()
    edges = linked.select(key("cell_a").alias("a"), key("cell_b").alias("b")).unionByName(close.select(F.col("x").alias("a"), F.col("y").alias("b")))
    cells = cores.groupBy(key("cell").alias("v")).agg(F.min("first").alias("first"))
    parts = components(edges, cells).join(cells, "v")
    named = kept(parts.join(parts.groupBy("label").agg(F.min("first").alias("cluster")), "label").select("v", "cluster"), "named")
    owned = cores.withColumn("v", key("cell")).join(named, "v")
    inner = owned.select(F.explode("points").alias("p"), "cluster").select("p.t", "cluster", F.lit(True).alias("core"))

    near = kept(_pairs(others, owned, eps, dims, F.col("cluster")), "near")
    whole = near.where("sure").groupBy(F.col("a").alias("block")).agg(F.min("cluster").alias("whole"))
    hit = lambda r, t, near: pd.DataFrame({"t": t[near.any(1)], "cluster": r.cluster})
    single = _compared(near.where("NOT sure").select("a", "b", "cluster"), others, owned, eps, hit, "t long, cluster long").groupBy("t").agg(F.min("cluster").alias("single"))
    outer = others.select("block", F.explode("points").alias("p")).join(whole, "block", "left").select("p.t", "whole").join(single, "t", "left")
    return inner.unionByName(outer.select("t", F.least("whole", "single").alias("cluster"), F.lit(False).alias("core")))
