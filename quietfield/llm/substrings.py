"""Removal of repeated passages: windows of WINDOW words, compared by super-k-mers.

The minimiser of a window is the least hash of its word pairs, so equal windows share it. Runs of consecutive windows
with one minimiser travel as one packed string (their bytes in the text) to the minimiser's bucket, sorted by
minimiser, document and place. There equal windows are brought together by sorting, and all but the earliest are
repeats. Windows are equal if two 64-bit hashes of their words' 64-bit hashes are.

Hot minimisers (a common passage) never meet in one task. Of buckets of more than HOT times the mean, the earliest
place of each window is found by an aggregation with map-side combination; whatever stands elsewhere is a repeat, and
no occurrence is joined with another. A minimiser with more than GROUP rows in another bucket is treated by window too.
The buckets are done in ``slices`` passes over the text, which bounds the shuffle files held at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quietfield.llm.common import Scratch, parallelism, read
from quietfield.llm.kernel import Words, mix, text_pieces, windows

WINDOW = 20
BUCKETS, HOT, GROUP = 1 << 14, 8, 50_000
CHUNK = 1 << 20
_LAST = (1 << 63) - 1  # a null id sorts last
RUN = "id long, version long, start int, n int"
LOOSE = "w1 long, w2 long"


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    span = 1
    while 2 * span <= w:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (w - span)], x[w - span :]) if w > span else x


class SuperKmers:
    """Of one piece of texts: runs of windows with the same minimiser."""

    def __init__(self, words: Words, k: int):
        self.words, self.k = words, k
        h = words.hashes()
        n = max(len(h) - k + 1, 0)
        self.start = np.zeros(0, np.int64)
        if not n:
            return
        low = sliding_min(windows(h, 2), k - 1)
        doc = words.doc[:n]
        valid = doc == words.doc[k - 1 : k - 1 + n]
        new = np.ones(n, bool)
        new[1:] = (low[1:] != low[:-1]) | ~valid[:-1] | (doc[1:] != doc[:-1])
        new &= valid
        edge = np.flatnonzero(new | ~valid)
        self.start = np.flatnonzero(new)
        nxt = np.concatenate([edge, [n]])
        self.n = nxt[np.searchsorted(nxt, self.start, side="right")] - self.start
        self.doc = doc[self.start]
        self.minimiser = mix(low[self.start] + np.uint64(0x9E3779B97F4A7C15))
        self.bucket = (self.minimiser % np.uint64(BUCKETS)).astype(np.int32)


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x)


def _batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def hot_buckets(docs: DataFrame, k: int, least: int = 1000) -> np.ndarray:
    """Buckets of more than HOT times the mean (and ``least``) super-k-mers: at most BUCKETS / HOT of them, whatever the input."""
    schema = pa.schema([("bucket", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for _, words in text_pieces(batches):
            s = SuperKmers(words, k)
            if len(s.start):
                total += np.bincount(s.bucket, minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield _batch(schema, at.astype(np.int32), total[at])

    counts = docs.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    rows = counts.crossJoin(counts.agg(F.greatest(F.sum("n") / F.lit(float(BUCKETS)) * HOT, F.lit(least)).alias("limit"))).where("n > limit").select("bucket").collect()
    return np.array(sorted(r.bucket for r in rows), np.int32)


def _loose(h1: np.ndarray, h2: np.ndarray, ids, versions, starts) -> list:
    return [_long(h1), _long(h2), pa.array(ids, pa.int64()), pa.array(versions, pa.int64()), pa.array(starts.astype(np.int32))]


def repeats(docs: DataFrame, hot: np.ndarray, k: int = WINDOW, slices: int = 2, group: int = GROUP) -> tuple[DataFrame, Scratch]:
    """Runs of repeated windows (id, version, start, n) of docs(id, version, text), but for those in hot buckets."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "substrings")
    loose_schema = pa.schema([("w1", pa.int64()), ("w2", pa.int64()), ("id", pa.int64()), ("version", pa.int64()), ("start", pa.int32())])
    packed_schema = pa.schema([("minimiser", pa.int64()), ("id", pa.int64()), ("version", pa.int64()), ("start", pa.int32()), ("packed", pa.binary())])
    mixed_schema = pa.schema([*loose_schema, ("n", pa.int32())])

    def pack(part: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, words in text_pieces(batches):
                s = SuperKmers(words, k)
                if not len(s.start):
                    continue
                mine = np.flatnonzero((s.bucket % slices == part) & ~np.isin(s.bucket, hot))
                doc, at = s.doc[mine], s.start[mine]
                data = words.data.tobytes()
                cuts = zip(words.start[at].tolist(), words.end[at + s.n[mine] + k - 2].tolist(), strict=True)
                yield _batch(packed_schema, _long(s.minimiser[mine]), _column(batch, "id")[doc], _column(batch, "version")[doc], (at - words.first[doc]).astype(np.int32), pa.array([data[a:b] for a, b in cuts], pa.binary()))

        return run

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by minimiser: groups are gathered up to CHUNK bytes; a group beyond GROUP rows goes on as windows."""

        def solve(parts: list[pa.RecordBatch], whole_group: bool) -> pa.RecordBatch:
            table = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
            words = Words(_as_text(table.column(4)))
            h = words.hashes()
            ids, versions, starts = (_column(table, c) for c in ("id", "version", "start"))
            n = words.count - (k - 1)
            row = np.repeat(np.arange(len(n)), n)
            off = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            at = words.first[:-1][row] + off
            h1, h2 = windows(h, k)[at], windows(h, k, 1)[at]
            begin = starts[row].astype(np.int64) + off
            if not whole_group:
                return _batch(mixed_schema, *_loose(h1, h2, ids[row], versions[row], begin), pa.nulls(len(row), pa.int32()))
            order = np.argsort(h1)
            a, b = h1[order], h2[order]
            if np.any((a[1:] == a[:-1]) & (b[1:] != b[:-1])):  # a first hash with two second ones
                order = np.lexsort((h2, h1))
                a, b = h1[order], h2[order]
            new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
            first = np.repeat(np.minimum.reduceat(order, new), np.diff(np.concatenate([new, [len(order)]])))
            later = np.zeros(len(order), bool)  # rows stand by id and start; rows of one id are on a par
            later[order] = (ids[row][order] != ids[row][first]) | (begin[order] != begin[first])
            d = np.flatnonzero(later)
            new = np.ones(len(d), bool)
            new[1:] = (d[1:] != d[:-1] + 1) | (row[d[1:]] != row[d[:-1]])
            s = np.flatnonzero(new)
            length = np.diff(np.concatenate([s, [len(d)]]))
            r, none = row[d[s]], pa.nulls(len(s), pa.int64())
            return _batch(mixed_schema, none, none, ids[r], versions[r], begin[d[s]].astype(np.int32), length.astype(np.int32))

        held: list[pa.RecordBatch] = []  # complete groups, and at the end the open one
        size = 0
        open_rows, open_key, spilled = 0, None, False
        for batch in batches:
            keys = _column(batch, "minimiser")
            cuts = np.flatnonzero(np.diff(keys)) + 1
            edges = [0, *cuts.tolist(), len(keys)]
            lo = 0
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if keys[a] != open_key:
                    part = batch.slice(lo, a - lo)
                    if a > lo:
                        held.append(part)
                        size += part.nbytes
                    lo = a
                    if spilled:
                        if held:
                            yield solve(held, False)
                        held, size, spilled = [], 0, False
                    elif size >= CHUNK:
                        yield solve(held, True)
                        held, size = [], 0
                    open_key, open_rows = keys[a], 0
                    group_from = len(held)
                open_rows += b - a
                if open_rows > group and not spilled:
                    done = held[:group_from]
                    if done:
                        yield solve(done, True)
                    held, spilled = held[group_from:], True
                    group_from = 0
                    size = sum(x.nbytes for x in held)
            if lo < len(keys):
                held.append(batch.slice(lo))
                size += held[-1].nbytes
            if spilled and held:
                yield solve(held, False)
                held, size, group_from = [], 0, 0
        if held:
            yield solve(held, not spilled)

    names = []
    for part in range(slices):
        parts = parallelism(spark)
        sent = docs.mapInArrow(pack(part), "minimiser long, id long, version long, start int, packed binary")
        met = sent.repartition(parts, "minimiser").sortWithinPartitions("minimiser", "id", "start")
        scratch.write(met.mapInArrow(count, f"{LOOSE}, {RUN}"), f"part-{part}")
        names.append(f"part-{part}")
        del sent, met
        scratch.free()
    found = spark.read.parquet(*[f"{scratch.root}/{n}" for n in names])
    runs = found.where("n is not null").select("id", "version", "start", "n")
    loose = found.where("n is null").select("w1", "w2", "id", "version", "start")
    if not loose.isEmpty():
        first = loose.groupBy("w1", "w2").agg(F.min(F.struct("id", "start")).alias("first"), F.count("*").alias("times")).where("times > 1")
        more = loose.join(first, ["w1", "w2"]).where("id != first.id or start != first.start").select("id", "version", "start", F.lit(1).alias("n"))
        runs = runs.unionByName(more)
    return runs, scratch


def earliest(docs: DataFrame, hot: np.ndarray, k: int) -> DataFrame:
    """(id, start) of the earliest place of each window in a hot bucket."""
    schema = pa.schema([("w1", pa.int64()), ("w2", pa.int64()), ("id", pa.int64()), ("start", pa.int32())])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, words in text_pieces(batches):
            at = hot_windows(SuperKmers(words, k), hot)
            if len(at):
                doc, h = words.doc[at], words.hashes()
                yield _batch(schema, _long(windows(h, k)[at]), _long(windows(h, k, 1)[at]), _column(batch, "id")[doc], (at - words.first[doc]).astype(np.int32))

    # A place as one number, so that the minimum is kept in a hash table.
    place = F.col("id").cast("decimal(19,0)") * F.lit(1 << 31).cast("decimal(10,0)") + F.col("start")
    least = docs.mapInArrow(spread, "w1 long, w2 long, id long, start int").groupBy("w1", "w2").agg(F.min(place.cast("decimal(38,0)")).alias("place"))
    start = F.pmod("place", F.lit(1 << 31).cast("decimal(10,0)"))
    return least.select(((F.col("place") - start) / F.lit(1 << 31)).cast("decimal(38,0)").cast("long").alias("id"), start.cast("int").alias("start"))


def hot_windows(s: SuperKmers, hot: np.ndarray) -> np.ndarray:
    """Places of a piece's windows in hot buckets."""
    if not len(s.start) or not len(hot):
        return np.zeros(0, np.int64)
    mine = np.flatnonzero(np.isin(s.bucket, hot))
    n = s.n[mine]
    return np.repeat(s.start[mine], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _as_text(packed: pa.Array) -> pa.Array:
    """Binary as the text layout that Words reads (no copy of the bytes)."""
    packed = packed.cast(pa.large_binary())
    return pa.LargeStringArray.from_buffers(len(packed), packed.buffers()[1], packed.buffers()[2], offset=packed.offset)


def remove_repeats(docs: DataFrame, k: int = WINDOW, slices: int = 2, group: int = GROUP, hot_from: int = 1000) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words left, joined by one space) for every row of ``docs``.

    A word goes if a window that covers it also starts earlier (smaller doc_id, or the same one and an earlier
    start). Windows are judged on the input. Rows of one doc_id are on a par: neither is earlier at the same start.
    A null doc_id sorts last. Null, empty and short texts (under ``k`` words) lose nothing.
    """
    keyed = docs.select("doc_id", F.coalesce("doc_id", F.lit(_LAST)).alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("version"), "text")
    sent = keyed.select("id", "version", "text")
    hot = hot_buckets(sent, k, hot_from)
    runs, scratch = repeats(sent, hot, k, slices, group)
    by_doc = runs.groupBy("id", "version").agg(F.collect_set(F.struct("start", "n")).alias("runs"))
    by_doc = scratch.write(by_doc, "runs")
    scratch.drop(*(f"part-{i}" for i in range(slices)))
    joined = keyed.join(by_doc, ["id", "version"], "left")
    if len(hot):
        firsts = scratch.write(earliest(sent, hot, k).groupBy("id").agg(F.collect_set("start").alias("firsts")), "firsts")
        scratch.free()
        joined = joined.join(firsts, "id", "left")
    else:
        joined = joined.withColumn("firsts", F.lit(None).cast("array<int>"))
    joined = joined.select("doc_id", "text", "runs", "firsts")
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, words in text_pieces(batches):
            lists = batch.column(2)
            owner = np.repeat(np.arange(len(lists)), np.diff(_list_offsets(lists)))
            flat = lists.flatten()
            begin = words.first[:-1][owner] + flat.field(0).to_numpy(zero_copy_only=False)
            mark = np.zeros(len(words) + 1, np.int64)
            np.add.at(mark, begin, 1)
            np.add.at(mark, begin + flat.field(1).to_numpy(zero_copy_only=False) + k - 1, -1)
            at = hot_windows(SuperKmers(words, k), hot)
            if len(at):
                firsts = batch.column(3)
                owner = np.repeat(np.arange(len(firsts)), np.diff(_list_offsets(firsts)))
                begin = firsts.flatten().to_numpy(zero_copy_only=False)
                mine = begin < words.count[owner]  # the others are of another text with the same id
                first = np.zeros(len(words), bool)
                first[words.first[:-1][owner[mine]] + begin[mine]] = True
                at = at[~first[at]]
                np.add.at(mark, at, 1)
                np.add.at(mark, at + k, -1)
            gone = np.cumsum(mark)[:-1] > 0
            removed = np.concatenate([[0], np.cumsum(gone)])[words.first]
            data, left, kept = words.data.tobytes(), ~gone, []
            for i, (a, b) in enumerate(zip(words.at[:-1].tolist(), words.at[1:].tolist(), strict=True)):
                found = data[a:b].split()
                if removed[i + 1] > removed[i]:
                    found = [w for w, keep in zip(found, left[words.first[i] : words.first[i + 1]].tolist(), strict=True) if keep]
                kept.append(b" ".join(found))
            yield _batch(schema, batch.column(0).cast(pa.int64()), words.count.astype(np.int64), np.diff(removed).astype(np.int64), pa.array(kept, pa.binary()).cast(pa.string()))

    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")


def _list_offsets(lists: pa.ListArray) -> np.ndarray:
    n = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.cumsum(n)])


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words left; its columns are those of the contract. Null, empty and short texts lose nothing; rows
    of one id are on a par; a null id sorts last, as 2^63 - 1 does."""
    found = remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
