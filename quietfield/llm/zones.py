"""Centroid clustering over zone maps: vectors along a Hilbert curve in blocks with boxes, candidates by box distances.

Vectors are sorted over the whole table by their places on a Hilbert curve through the directions in which the first
centroids differ most, so a block holds what lies close together. Each round a block's box leaves some candidate
centroids; a block with one gives its stored sums, the others compare their members in exact integers.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quietfield.llm import boxes
from quietfield.llm.common import Scratch, parallelism, read

WIDTH, CENTROIDS, ROUNDS, SCALE = 64, 16, 3, 64
FLAT = 256
AXES, BITS = 8, 7
BLOCKS = "n int, kind string, ids array<long>, members binary, low binary, high binary, sums binary"


def curve(vectors: DataFrame, centroids: np.ndarray, axes: int = AXES, bits: int = BITS) -> DataFrame:
    """(key, tie, vec_id, q): places on the curve. Any directions give right clusters, good ones give small boxes."""
    middle = centroids.mean(0)
    turn = np.linalg.svd(centroids - middle, full_matrices=False)[2][:axes].T
    reach = np.maximum(1.5 * np.abs((centroids - middle) @ turn).max(0), 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q = b.column("q").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            key = boxes.hilbert(boxes.grid((q - middle) @ turn, -reach, reach, bits), bits)
            yield pa.RecordBatch.from_arrays([pa.array(key), *b.columns], names=["key", *b.schema.names])

    return vectors.select("tie", "vec_id", "q").mapInArrow(run, "key long, tie long, vec_id long, q array<int>")


def zone_map(placed: DataFrame, size: int = FLAT) -> DataFrame:
    """BLOCKS along the curve: ranges of it are tasks; equal vectors are told apart by ``tie``, so none is a hot range."""
    names = [c.split()[0] for c in BLOCKS.split(", ")]
    kinds = [pa.int32(), pa.string(), pa.list_(pa.int64()), *[pa.binary()] * 4]

    def row(t: pa.Table) -> pa.RecordBatch:
        x = t.column("q").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(t), -1)
        data = boxes.narrowed(x.ravel())
        low, high = (y.astype("<i4").tobytes() for y in (x.min(0), x.max(0)))
        values = [len(t), data.dtype.str, t.column("vec_id").to_pylist(), data.tobytes(), low, high, x.sum(0, dtype=np.int64).astype("<i8").tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for b in batches:
            t = pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
            whole = len(t) // size * size
            for lo in range(0, whole, size):
                yield row(t.slice(lo, size))
            rest = t.slice(whole)
        if rest is not None and len(rest):
            yield row(rest)

    dealt = placed.repartitionByRange(parallelism(placed.sparkSession), "key", "tie").sortWithinPartitions("key", "tie")
    return dealt.select("vec_id", "q").mapInArrow(run, BLOCKS)


def _stacked(batches: Iterator[pa.RecordBatch], width: int, size: int, at_once: int = 64) -> Iterator[tuple]:
    """(ids, members, counts, low, high, sums) of some blocks at a time; short blocks are filled up."""
    for b in batches:
        for lo in range(0, b.num_rows, at_once):
            rows = b.slice(lo, at_once).to_pylist()
            members = np.zeros((len(rows), size, width), np.int32)
            for m, r in zip(members, rows, strict=True):
                x = np.frombuffer(r["members"], r["kind"]).reshape(r["n"], width)
                m[: r["n"]], m[r["n"] :] = x, x[-1]
            low, high, sums = (np.stack([np.frombuffer(r[c], k) for r in rows]) for c, k in (("low", "<i4"), ("high", "<i4"), ("sums", "<i8")))
            yield [r.get("ids") for r in rows], members, np.array([r["n"] for r in rows]), low, high, sums


def one_round(blocks: DataFrame, centroids: np.ndarray, size: int = FLAT) -> np.ndarray:
    """Centroids after every vector went to its nearest."""
    k, w = centroids.shape
    sent = blocks.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((k, w), np.int64), np.zeros(k, np.int64)
        for _, members, counts, low, high, sums in _stacked(batches, w, size):
            s, n = boxes.gathered(members, counts, sums, low, high, sent.value)
            total, count = total + s, count + n
        entry, dim = (x.ravel() for x in np.indices((k, w)))
        arrays = [entry, dim, total.ravel(), np.repeat(count, w)]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in arrays], names=["entry", "dim", "s", "n"])

    found = blocks.drop("ids").mapInArrow(run, "entry long, dim long, s long, n long")
    return boxes.moved(centroids, found.groupBy("entry", "dim").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n")).collect())


def assigned(blocks: DataFrame, centroids: np.ndarray, size: int = FLAT) -> DataFrame:
    """(vec_id, cluster, distance) of every vector."""
    w = centroids.shape[1]
    sent = blocks.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, members, counts, low, high, _ in _stacked(batches, w, size):
            index, distance = boxes.nearest(members, boxes.shortlists(low, high, sent.value), sent.value)
            real = np.arange(size)[None] < counts[:, None]
            flat = pa.array([i for x in ids for i in x], pa.int64())
            yield pa.RecordBatch.from_arrays([flat, pa.array(index[real], pa.int32()), pa.array(distance[real])], names=["vec_id", "cluster", "distance"])

    return blocks.mapInArrow(run, "vec_id long, cluster int, distance long")


def clustered(vectors: DataFrame, scratch: Scratch, vector: str = "embedding", width: int = WIDTH, k: int = CENTROIDS, rounds: int = ROUNDS, scale: int = SCALE, size: int = FLAT) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, cluster, distance), centroids) of vectors (vec_id, vector).

    Vectors of another length than ``width``, null ones and those with null or non-finite components take no part. The
    first centroids are the vectors of the k least sha256 of "1:<vec_id>"; of rows of one id the lesser vector is first,
    and null ids are last. Each row is a vector of its own. A component too large for distances in 64 bits is an error.
    Without any vector there are no rows and no centroids; with fewer than k, as many centroids as vectors.
    """
    q = boxes.floors(F.col(vector), scale, boxes.largest(width))
    kept = vectors.where(boxes.sound(F.col(vector)) & (F.size(vector) == width)).select(F.col("vec_id").cast("long").alias("vec_id"), q.alias("q"))
    lot = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    first = kept.orderBy(F.asc_nulls_last(lot), "q").limit(k).select("q").collect()
    centroids = np.array([r.q for r in first], np.int64).reshape(len(first), width)
    if not first:
        return vectors.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long"), centroids
    blocks = scratch.write(zone_map(curve(kept.withColumn("tie", F.monotonically_increasing_id()), centroids), size), "blocks")
    for _ in range(rounds):
        centroids = one_round(blocks, centroids, size)
    return scratch.write(assigned(blocks, centroids, size), "assigned"), centroids


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector that clustered() takes."""
    found, centroids = clustered(read(spark, sf_dir, "embeddings"), Scratch(spark, "zones"))
    sums = {r.cluster: int(r.s) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # one for each centroid
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    about = [{"cluster": i, "cluster_inertia": s, "inertia": sum(sums.values()), "centroid_sha256": digest[i]} for i, s in sorted(sums.items())]
    table = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(about)), "array<struct<cluster: int, cluster_inertia: bigint, inertia: bigint, centroid_sha256: string>>")))
    return found.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
