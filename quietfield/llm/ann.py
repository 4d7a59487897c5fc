"""Nearest neighbours by learned partitions.

A bounded sample gives a graph of nearest neighbours, which is cut into parts of equal size with few edges between
them. A small network learns to tell a vector's part. It then deals every row of the table to its likeliest part, and
each query to as many of its likeliest parts as a calibration on the sample asks for. Within parts, in blocks of
bounded size, all candidates are compared and the best are scored again exactly.

Vectors of other lengths than the most frequent one are parts of their own, each compared as a whole: inner products
are of vectors of one length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quietfield.llm.common import Scratch, read
from quietfield.llm.kernel import mix

SAMPLE, NEIGHBOURS, RECALL = 8192, 10, 0.97
TOP, EVERY = 20, 20
PART_ROWS, LEAST_PARTS, MOST_PARTS = 4096, 8, 256
BLOCK, QUERIES, AT_ONCE = 8192, 4096, 512


def usable(x: Column) -> Column:
    return x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)


def neighbours(x: np.ndarray, k: int) -> np.ndarray:
    """The k rows of largest inner product with each row, itself left out."""
    out = np.empty((len(x), k), np.int32)
    for lo in range(0, len(x), 1024):
        s = x[lo : lo + 1024] @ x.T
        s[np.arange(len(s)), lo + np.arange(len(s))] = -np.inf
        out[lo : lo + 1024] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(x: np.ndarray, near: np.ndarray, parts: int, sweeps: int = 20, slack: float = 1.1) -> np.ndarray:
    """A cut of the neighbour graph into parts of at most ``slack`` times the mean size.

    From halvings along the leading directions, rows move to where most of their neighbours are, those that gain most
    first, as long as there is room.
    """
    n = len(x)
    part = np.zeros(n, np.int32)
    groups = [np.arange(n)]
    while len(groups) < parts:
        halves = groups[: max(2 * len(groups) - parts, 0)]  # when less than twice as many are wanted
        for g in groups[len(halves) :]:
            y = x[g] - x[g].mean(0)
            v = np.random.default_rng(3).standard_normal(x.shape[1])
            for _ in range(10):
                v = y.T @ (y @ v)
                v /= np.linalg.norm(v) + 1e-12
            order = np.argsort(y @ v, kind="stable")
            halves += [g[order[: len(g) // 2]], g[order[len(g) // 2 :]]]
        groups = halves
    for k, g in enumerate(groups):
        part[g] = k
    room = int(np.ceil(slack * n / parts))
    heads, tails = np.repeat(np.arange(n), near.shape[1]), near.ravel()
    for _ in range(sweeps):
        count = np.zeros((n, parts), np.float32)
        np.add.at(count, (heads, part[tails]), 1)
        np.add.at(count, (tails, part[heads]), 1)
        best = count.argmax(1)
        gain = count[np.arange(n), best] - count[np.arange(n), part]
        size, moved = np.bincount(part, minlength=parts), 0
        for i in np.argsort(-gain, kind="stable").tolist():
            if gain[i] <= 0:
                break
            if size[best[i]] < room:
                size[part[i]] -= 1
                size[best[i]] += 1
                part[i] = best[i]
                moved += 1
        if moved < n // 200:
            break
    return part


class Router:
    """A network of one hidden layer from a vector to its parts' probabilities."""

    def __init__(self, x: np.ndarray, want: np.ndarray, hidden: int = 96, epochs: int = 30):
        rng = np.random.default_rng(9)
        self.scale = float(np.sqrt((x * x).mean()) + 1e-12)
        self.p = [rng.standard_normal((x.shape[1], hidden)) / np.sqrt(x.shape[1]), np.zeros(hidden), rng.standard_normal((hidden, want.shape[1])) * 0.1, np.zeros(want.shape[1])]
        m1, m2, t = [np.zeros_like(q) for q in self.p], [np.zeros_like(q) for q in self.p], 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for lo in range(0, len(x), 256):
                i = order[lo : lo + 256]
                a = x[i] / self.scale
                h = np.maximum(a @ self.p[0] + self.p[1], 0)
                d = (self._soft(h @ self.p[2] + self.p[3]) - want[i]) / len(i)
                dh = (d @ self.p[2].T) * (h > 0)
                t += 1
                for k, g in enumerate((a.T @ dh, dh.sum(0), h.T @ d, d.sum(0))):
                    g = g + 1e-5 * self.p[k]
                    m1[k] += 0.1 * (g - m1[k])
                    m2[k] += 0.001 * (g * g - m2[k])
                    self.p[k] = self.p[k] - 0.003 * (m1[k] / (1 - 0.9**t)) / (np.sqrt(m2[k] / (1 - 0.999**t)) + 1e-8)

    @staticmethod
    def _soft(a: np.ndarray) -> np.ndarray:
        a = np.exp(a - a.max(1, keepdims=True))
        return a / a.sum(1, keepdims=True)

    def order(self, x: np.ndarray) -> np.ndarray:
        """Parts of each row, the likeliest first."""
        h = np.maximum(x / self.scale @ self.p[0] + self.p[1], 0)
        return np.argsort(-(h @ self.p[2] + self.p[3]), axis=1, kind="stable")


def fit(sample: np.ndarray, parts: int, recall: float = RECALL, top: int = TOP) -> tuple[Router | None, int]:
    """A router, and to how many parts a query goes for the recall wanted on held-out rows of the sample.

    Nearest rows lie closer in the whole table than in its sample, so the sample is the harder case. With less than 20 rows
    for each neighbour wanted there is too little to calibrate on: queries go to all parts. A single part needs no router.
    """
    parts = min(parts, len(sample) // (2 * NEIGHBOURS))
    if parts < 2:
        return None, 1
    held = np.random.default_rng(4).permutation(len(sample))
    test, train = held[: min(512, len(sample) // 8)], held[min(512, len(sample) // 8) :]
    x = sample[train]
    near = neighbours(x, NEIGHBOURS)
    part = balanced_parts(x, near, parts)
    want = 0.5 * np.eye(parts)[part] + 0.5 * np.eye(parts)[part[near]].mean(1)
    router = Router(x, want)
    if len(sample) < 20 * max(parts, top):
        return router, parts
    home = router.order(x)[:, 0]
    s = sample[test] @ x.T
    k = min(top, len(x))
    true = np.argpartition(-s, k - 1, axis=1)[:, :k]
    place = np.empty((len(test), parts), np.int64)
    order = router.order(sample[test])
    place[np.arange(len(test))[:, None], order] = np.arange(parts)
    need = place[np.arange(len(test))[:, None], home[true]]
    for probes in range(1, parts + 1):
        if (need < probes).mean() >= recall:
            return router, probes
    return router, parts


def exact(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of rows, added up in the order of components whatever the block."""
    out = np.zeros(len(q))
    for j in range(q.shape[1]):
        out += q[:, j] * c[:, j]
    return out


def few_of_each(c: np.ndarray, most: int) -> np.ndarray:
    """Places of rows, of equal ones the first ``most``: no more can be among the best of any query."""
    h = mix((c.view(np.uint64) * mix(np.arange(1, c.shape[1] + 1, dtype=np.uint64))).sum(1))
    order = np.argsort(h, kind="stable")
    new = np.concatenate([[True], h[order][1:] != h[order][:-1]])
    head = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    within = np.arange(len(order)) - head
    many = np.flatnonzero(within >= most)
    many = many[(c[order[many]] == c[order[head[many]]]).all(1)]  # those of one hash may differ
    return np.sort(np.delete(order, many))


def best_of_block(qrow: np.ndarray, q: np.ndarray, crow: np.ndarray, cid: np.ndarray, c: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query's row, candidate's place, score): the best of a block for each query, ties by id and row; not its own row."""
    order = np.lexsort((crow, cid))
    keep = order[few_of_each(c[order], top + 1)]
    crow, c = crow[keep], c[keep]
    s = q @ c.T
    by_row = np.argsort(crow)
    at = np.searchsorted(crow[by_row], qrow)
    own = np.flatnonzero((at < len(crow)) & (crow[by_row][np.minimum(at, len(crow) - 1)] == qrow))
    s[own, by_row[at[own]]] = -np.inf
    k = min(top, s.shape[1])
    least = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
    row, col = np.nonzero((s >= (least - 1e-9 * (1 + np.abs(np.where(np.isfinite(least), least, 0))))[:, None]) & np.isfinite(s))
    score = np.concatenate([exact(q[row[i : i + 65536]], c[col[i : i + 65536]]) for i in range(0, len(row), 65536)]) if len(row) else np.zeros(0)
    order = np.lexsort((col, -score, row))  # columns stand by id and row
    row, col, score = row[order], col[order], score[order]
    first = np.searchsorted(row, np.arange(len(q)))
    kept = np.arange(len(row)) - first[row] < top
    return qrow[row[kept]], keep[col[kept]], score[kept]


def nearest(table: DataFrame, queries: Column, top: int = TOP) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of table(vec_id, embedding) where ``queries`` holds, its nearest
    others by inner product.

    Vectors that are null, empty, zero, or hold null or non-finite components take no part. A vector's candidates are all
    other rows with a vector of its length, those of its own id or without one included; of rows that are repeated each has
    its own results. Ties go to the smaller vec_id, a null one last; a row without an id is no query.
    """
    spark = table.sparkSession
    scratch = Scratch(spark, "ann")
    x = F.transform("embedding", lambda v: v.cast("double"))
    nameless = F.col("vec_id").isNull().cast("long")  # the lowest bit of a row's number; its id is the greatest there is
    rows = table.where(usable(F.col("embedding"))).select(F.coalesce(F.col("vec_id").cast("long"), F.lit(2**63 - 1)).alias("vec_id"), x.alias("x"), (2 * F.monotonically_increasing_id() + nameless).alias("row"))
    rows = scratch.write(rows, "rows")  # written, so that numbers stay
    sizes = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    d, n = sizes[0].d, sizes[0]["count"]
    parts = int(np.clip(2 ** round(np.log2(max(n / PART_ROWS, 1))), LEAST_PARTS, MOST_PARTS))
    sample = rows.where(F.size("x") == d).orderBy(F.xxhash64("vec_id"), "vec_id", "row").limit(SAMPLE).toArrow()["x"].combine_chunks()
    router, probes = fit(sample.flatten().to_numpy().reshape(-1, d), parts, top=top)
    sent = spark.sparkContext.broadcast((router, probes))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        router, probes = sent.value
        for batch in batches:
            size = batch.column(1).value_lengths().to_numpy()
            parts = [[-int(k)] for k in size]  # of another length: a part for each
            mine = np.flatnonzero(size == d)
            if len(mine):
                x = batch.column(1).take(pa.array(mine)).flatten().to_numpy().reshape(len(mine), d)
                order = router.order(x)[:, :probes] if router is not None else np.zeros((len(mine), 1), int)
                for i, o in zip(mine.tolist(), order.tolist(), strict=True):
                    parts[i] = o
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(parts, pa.list_(pa.int32()))], ["vec_id", "x", "row", "parts"])

    dealt = scratch.write(rows.mapInArrow(route, "vec_id long, x array<double>, row long, parts array<int>"), "dealt")
    asked = dealt.where(queries & (F.col("row") % 2 == 0)).select("vec_id", "x", "row", F.explode("parts").alias("part"))
    home = dealt.select("vec_id", "x", "row", F.col("parts")[0].alias("part"))
    # Blocks of each part, on either side.
    size = home.groupBy("part").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("cbs")).join(asked.groupBy("part").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("qbs")), "part")
    size = F.broadcast(scratch.write(size, "size", compact=True))  # a row for each part and for each other length
    cut = lambda n: F.pmod(F.xxhash64("row"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = [F.col(c).alias(c) for c in ("row", "vec_id", "x", "part")]  # by new names: both sides are of one table
    left = asked.join(size, "part").select(*columns, cut("qbs").alias("qb"), every("cbs").alias("cb"))
    right = home.join(size, "part").select(*columns, cut("cbs").alias("cb"), every("qbs").alias("qb"))

    def search(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(q) and len(c):
            crow, cid, cx = c["row"].to_numpy(), c["vec_id"].to_numpy(), np.stack(c["x"].to_numpy())
            id_of = dict(zip(q["row"], q["vec_id"], strict=True))
            for lo in range(0, len(q), AT_ONCE):
                part = q.iloc[lo : lo + AT_ONCE]
                a, b, s = best_of_block(part["row"].to_numpy(), np.stack(part["x"].to_numpy()), crow, cid, cx, top)
                found.append(pd.DataFrame({"query_row": a, "query_id": [id_of[r] for r in a], "vec_id": cid[b], "row": crow[b], "score": s}))
        return pd.concat(found) if found else pd.DataFrame({"query_row": [], "query_id": [], "vec_id": [], "row": [], "score": []}).astype({"query_row": "int64", "query_id": "int64", "vec_id": "int64", "row": "int64"})

    keys = ("part", "qb", "cb")
    each = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(search, "query_row long, query_id long, vec_id long, row long, score double")
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
    named = F.when(F.col("row") % 2 == 0, F.col("vec_id")).alias("vec_id")
    return each.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).select("query_id", "rank", named, "score")


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest rows of every twentieth vector among all; its columns are those of the contract."""
    return nearest(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % EVERY == 0)
