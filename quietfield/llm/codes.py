"""Product codes of vectors: Hilbert-sorted flat blocks, shortlists of entries by boxes, exact integer kernels.

Vectors are gathered to chunks, as they come, of at most ``CHUNK``. In a chunk each part position has its parts in order
of a Hilbert curve, in flat blocks with boxes and sums, stored in one row of a table; rounds and codes read that table,
and nothing is shuffled but sums of entries and of labels.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quietfield.llm import boxes
from quietfield.llm.common import Scratch, read, with_groups

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
CHUNK, FLAT = 1 << 14, 64
BLOCKS = "n int, width int, kind string, ids array<long>, labels array<string>, members binary, places binary, low binary, high binary, sums binary"


def _packed(q: np.ndarray, ids: pa.Array, labels: pa.Array, parts: int) -> dict:
    """A chunk's row: for each part its blocks in order of the curve, and which vector each member is of."""
    n, width = q.shape
    w = width // parts
    axes = min(w, 8)
    members, places, lows, highs, sums = [], [], [], [], []
    for p in range(parts):
        x = q[:, p * w : (p + 1) * w]
        low, high = x.min(0), x.max(0)
        wide = np.sort(np.argsort(low - high, kind="stable")[:axes])
        bits = min(12, 62 // axes)
        order = np.argsort(boxes.hilbert(boxes.grid(x[:, wide], low[wide], high[wide], bits), bits), kind="stable")
        m, _, lo, hi, s = boxes.flat(x[order], FLAT)
        members, places, lows, highs, sums = [*members, m], [*places, order], [*lows, lo], [*highs, hi], [*sums, s]
    data = boxes.narrowed(np.concatenate([m.ravel() for m in members]))
    return {
        "n": n, "width": width, "kind": data.dtype.str, "ids": ids.to_pylist(), "labels": labels.to_pylist(), "members": data.tobytes(), "places": np.concatenate(places).astype("<i4").tobytes(),
        "low": np.stack(lows).astype("<i4").tobytes(), "high": np.stack(highs).astype("<i4").tobytes(), "sums": np.stack(sums).astype("<i8").tobytes(),
    }


def flat_blocks(vectors: DataFrame, parts: int = PARTS) -> DataFrame:
    """BLOCKS of (vec_id, label, q): a row for each chunk, made where the vectors are."""
    names = [c.split()[0] for c in BLOCKS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flushed() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            q = t.column("q").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(t), -1)
            row = _packed(q, t.column("vec_id"), t.column("label"), parts)
            kinds = [pa.int32(), pa.int32(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.string()), *[pa.binary()] * 5]
            return pa.RecordBatch.from_arrays([pa.array([row[c]], k) for c, k in zip(names, kinds, strict=True)], names=names)

        for b in batches:
            for lo in range(0, b.num_rows, CHUNK):
                cut = b.slice(lo, CHUNK)
                if size + cut.num_rows > CHUNK:
                    yield flushed()
                    held, size = [], 0
                held, size = [*held, cut], size + cut.num_rows
        if size:
            yield flushed()

    return vectors.select("vec_id", "label", "q").mapInArrow(run, BLOCKS)


class _Chunk:
    """A row of the table as arrays, by part."""

    def __init__(self, row: dict, parts: int):
        n, w = row["n"], row["width"] // parts
        b = -(-n // FLAT)
        self.n, self.ids, self.labels = n, row.get("ids"), row.get("labels")
        self.members = np.frombuffer(row["members"], row["kind"]).reshape(parts, b, FLAT, w)
        self.places = np.frombuffer(row.get("places", b""), "<i4").reshape(parts, -1)
        self.low, self.high = (np.frombuffer(row[c], "<i4").reshape(parts, b, w) for c in ("low", "high"))
        self.sums = np.frombuffer(row["sums"], "<i8").reshape(parts, b, w)
        self.counts = np.full(b, FLAT)
        self.counts[-1] = n - (b - 1) * FLAT


def _rows(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[_Chunk]:
    for b in batches:
        for i in range(b.num_rows):
            yield _Chunk({c: b.column(c)[i].as_py() for c in b.schema.names}, parts)


def one_round(blocks: DataFrame, books: np.ndarray) -> np.ndarray:
    """Codebooks (parts, entries, w) after every part went to its nearest entry."""
    parts, k, w = books.shape
    sent = blocks.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((parts, k, w), np.int64), np.zeros((parts, k), np.int64)
        for c in _rows(batches, parts):
            for p in range(parts):
                s, n = boxes.gathered(c.members[p], c.counts, c.sums[p], c.low[p], c.high[p], sent.value[p])
                total[p] += s
                count[p] += n
        part, entry, dim = (x.ravel() for x in np.indices((parts, k, w)))
        arrays = [part, entry, dim, total.ravel(), np.repeat(count.ravel(), w)]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in arrays], names=["part", "entry", "dim", "s", "n"])

    found = blocks.drop("ids", "labels", "places").mapInArrow(run, "part long, entry long, dim long, s long, n long")
    rows = found.groupBy("part", "entry", "dim").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n")).collect()  # as many as the codebooks have components
    out = books.copy()
    for p in range(parts):
        out[p] = boxes.moved(books[p], [r for r in rows if r["part"] == p])
    return out


def coded(blocks: DataFrame, books: np.ndarray) -> DataFrame:
    """(vec_id, label, code, error) of every vector."""
    parts = len(books)
    sent = blocks.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in _rows(batches, parts):
            code, error = np.zeros((c.n, parts), np.uint8), np.zeros(c.n, np.int64)
            for p in range(parts):
                index, distance = boxes.nearest(c.members[p], boxes.shortlists(c.low[p], c.high[p], sent.value[p]), sent.value[p])
                code[c.places[p], p] = index.ravel()[: c.n]
                error[c.places[p]] += distance.ravel()[: c.n]
            texts = code.tobytes().hex()
            texts = [texts[i : i + 2 * parts] for i in range(0, len(texts), 2 * parts)]
            yield pa.RecordBatch.from_arrays([pa.array(c.ids, pa.int64()), pa.array(c.labels, pa.string()), pa.array(texts, pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"])

    return blocks.select("n", "width", "kind", "ids", "labels", "members", "places", "low", "high", "sums").mapInArrow(run, "vec_id long, label string, code string, error long")


def compressed(vectors: DataFrame, scratch: Scratch, vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, label, code, error), codebooks) of vectors (vec_id, label, vector).

    A vector that is null or has null or non-finite components takes no part, nor has one whose length isn't the usual
    one: the commonest that the parts divide (of equally common ones the longest). Rows of one vec_id are vectors of
    their own; a null vec_id is last in the order of ids. Repeated vectors are coded alike. A component too large for
    distances in 64 bits is an error. Without any vector there are no rows and no entries.
    """
    if not 1 <= entries <= 256:
        raise ValueError("an entry's index has to fit two hex digits")
    fine = vectors.where(boxes.sound(F.col(vector)))
    size = F.size(vector)
    usual = fine.groupBy(size.alias("w")).count().where(f"w > 0 AND w % {parts} = 0").orderBy(F.desc("count"), F.desc("w")).first()
    width = usual.w if usual else 0
    q = boxes.floors(F.col(vector), scale, boxes.largest(width))
    kept = fine.where(size == width).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), q.alias("q"))
    first = kept.orderBy(F.asc_nulls_last("vec_id"), "q").limit(entries).select("q").collect() if width else []
    books = np.array([r.q for r in first], np.int64).reshape(len(first), parts, width // parts).transpose(1, 0, 2)
    if not first:
        return vectors.sparkSession.createDataFrame([], "vec_id long, label string, code string, error long"), books
    blocks = scratch.write(flat_blocks(kept, parts), "blocks")
    for _ in range(rounds):
        books = one_round(blocks, books)
    return scratch.write(coded(blocks, books), "codes"), books


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every vector that compressed() codes; nulls are one label."""
    codes, books = compressed(read(spark, sf_dir, "embeddings"), Scratch(spark, "codes"))
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    keyed = codes.withColumn("key", F.coalesce(F.concat(F.lit("="), "label"), F.lit("")))
    sums = keyed.groupBy("key").agg(F.sum(F.col("error").cast("decimal(38,0)")).try_cast("long").alias("label_error"), F.count("*").alias("size"))
    return with_groups(keyed, sums, ["key"], "size").select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
