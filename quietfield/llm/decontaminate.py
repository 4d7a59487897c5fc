"""Benchmark decontamination by latent semantic retrieval.

Texts are tiled into passages of TILE words, weighted by hashed TF-IDF over all of them. One distributed pass applies
their Gram matrix to a random test matrix; a Nystrom step on the driver (features x RANK, a fixed size) gives the
leading singular vectors and values. Every text is then read as overlapping windows of about each item's length,
four blocks each, whose whitened latent vectors and words in common with an item are sums over blocks. Windows near an
item in cosine that share enough of its words are held against it by longest common subsequence, over the item and over
its answer (its last sentence). So are stretches around any GRAM words in a row that an item has as well, whatever the
weights of its words: an item copied word for word is found even if all its words are common, or the item is short.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quietfield.llm.common import ship_code, read
from quietfield.llm.kernel import PUNCTUATION, Lookup, Words, mix, text_pieces, whole, windows

TILE, FEATURES, RANK, SEED = 64, 1 << 14, 24, 11
OVER = 6  # directions more than RANK in the test matrix
COMMON, LEAST = 2.5, 0.05  # what is taken off a word's weight, and the least that is left
GRAM = 5
LENGTHS, CLASS = 16, 64  # windows are of 16, 32, 48 or 64 words; longer items are searched by their parts
NEAR, SHARED = 0.5, 0.35  # both are less than what ALIKE asks for
SAME, ALIKE, ANSWERED = 0.8, 0.5, 0.8
BLOCK = 2000
CELLS, ROWS = 1 << 18, 1 << 14  # window-item pairs compared at once; windows held against items word by word at once
_U = np.uint64


def features(words: Words) -> tuple[np.ndarray, np.ndarray]:
    h = words.hashes(words.lowered())
    return h, (mix(h) % _U(FEATURES)).astype(np.int32)


def _pieces(batches):
    return text_pieces(batches, separator=PUNCTUATION)


def _tiles(words: Words) -> np.ndarray:
    """Tile of each word."""
    place = np.arange(len(words)) - words.first[:-1][words.doc]
    new = np.zeros(len(words), np.int64)
    new[(place % TILE == 0)] = 1
    return np.cumsum(new) - 1


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, tiles = np.zeros(FEATURES, np.int64), 0
    for _, words in _pieces(batches):
        if len(words):
            _, f = features(words)
            tile = _tiles(words)
            pairs = np.sort(tile * FEATURES + f)
            kept = pairs[np.concatenate([[True], pairs[1:] != pairs[:-1]])]
            total += np.bincount(kept % FEATURES, minlength=FEATURES)
            tiles += int(tile[-1]) + 1
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[at], tiles))], ["f", "n"])


def inverse_frequencies(docs: DataFrame) -> np.ndarray:
    """Weight of each feature over all passages; words of more than about a twelfth of them weigh little, but all weigh something."""
    rows = docs.select("text").mapInArrow(_frequencies, "f long, n long").groupBy("f").agg(F.sum("n").alias("n")).collect()
    counts, tiles = np.zeros(FEATURES), 0
    for r in rows:
        if r.f < 0:
            tiles = r.n
        else:
            counts[r.f] = r.n
    return np.maximum(np.log((tiles + 1) / (counts + 1)) - COMMON, LEAST).astype(np.float32)


def latent_space(docs: DataFrame, idf: np.ndarray) -> np.ndarray:
    """Whitened right singular vectors of the passages' matrix, times the weights: a latent vector for each feature.

    The range is sought with OVER directions more than RANK, of which the RANK leading ones stay. Of texts without words
    there is one direction, which is zero.
    """
    width = RANK + OVER
    test = np.random.default_rng(SEED).standard_normal((FEATURES, width)).astype(np.float32)
    sent = docs.sparkSession.sparkContext.broadcast((test, idf))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test, idf = sent.value
        weighted = with_blank(test * idf[:, None])
        total = np.zeros((width, FEATURES))
        for _, words in _pieces(batches):
            if not len(words):
                continue
            f = features(words)[1].astype(np.intp)
            tile = _tiles(words)
            # A word's weight is its feature's by its tile's norm, so both norms go to the tiles and the other weight to the end.
            norm = np.bincount(tile, np.square(idf, dtype=float).take(f))
            sums, fours, doc = _fours(words, f, weighted)
            z = np.add.reduceat(sums, np.flatnonzero((np.arange(len(doc)) - fours[:-1][doc]) % (TILE // 4) == 0))
            z = (z / norm[:, None]).T.copy()
            for j in range(width):
                total[j] += np.bincount(f, z[j].take(tile), FEATURES)
        total *= idf
        at = np.flatnonzero(total.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(list(total.T[at]), pa.list_(pa.float64()))], ["f", "y"])

    sums = [F.sum(F.col("y")[j]).alias(f"y{j}") for j in range(width)]
    found = docs.select("text").mapInArrow(run, "f long, y array<double>").groupBy("f").agg(*sums).toArrow()
    y = np.zeros((FEATURES, width))
    if len(found):
        y[found["f"].to_numpy()] = np.stack([found[f"y{j}"].to_numpy() for j in range(width)], 1)
    # Nystrom: y is G test for the Gram matrix G, so G is about y (test' y)^-1 y'.
    core = test.T.astype(float) @ y
    value, vector = np.linalg.eigh((core + core.T) / 2)
    good = value > max(value.max(), 0) * 1e-9
    if not good.any():
        return np.zeros((FEATURES, 1), np.float32)
    u, s, _ = np.linalg.svd(y @ (vector[:, good] / np.sqrt(value[good])), full_matrices=False)
    good = (s > s[0] * 1e-6) & (np.arange(len(s)) < RANK)
    return (u[:, good] / s[good] * idf[:, None]).astype(np.float32)


class Items:
    """A block of benchmark items, ready to be searched for."""

    def __init__(self, rows: list[tuple[int, str]], latent: np.ndarray, idf: np.ndarray):
        self.ids = np.array([i for i, _ in rows], np.int64)
        words = Words(whole(pa.array([t for _, t in rows], pa.string())), PUNCTUATION)
        h, f = features(words)
        cut = [(int(a), int(b)) for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
        self.words = [h[a:b].tolist() for a, b in cut]
        self.bits = [bits(w) for w in self.words]
        self.size = np.diff(words.first)
        self.answer = []
        for (_, text), (a, b) in zip(rows, cut, strict=True):
            last = [x for x in re.split(r"(?<=[.!?])\s+", (text or "").strip()) if re.search(r"\w", x)][-1:] or [""]
            n = len(Words(whole(pa.array(last)), PUNCTUATION))
            n = n if 3 <= n < b - a else max(1, (b - a) // 3)  # without a last sentence, its last third
            self.answer.append(h[max(a, b - n) : b].tolist())
        # Words in a row: of each length, where in which item they stand. Shorter items are looked for whole.
        self.grams: dict[int, tuple[Lookup, np.ndarray, np.ndarray, np.ndarray]] = {}
        for n in sorted({min(GRAM, b - a) for a, b in cut} - {0}):
            at = np.concatenate([np.arange(a, b - n + 1) for a, b in cut if min(GRAM, b - a) == n])
            g = windows(h, n)[at]
            order = np.argsort(g, kind="stable")
            own = np.searchsorted(words.first, at, side="right") - 1
            names, first = np.unique(g[order], return_index=True)
            self.grams[n] = (Lookup(names), np.append(first, len(g)), own[order], (at - words.first[own])[order])
        # The parts that are searched for: (item, place, latent direction, how often it has each feature)
        self.parts: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        found: dict[int, list] = {}
        for k, (a, b) in enumerate(cut):
            for lo in range(a, b, CLASS):
                hi = min(lo + CLASS, b)
                if hi - lo < LENGTHS // 2 and lo > a:
                    continue
                size = min(CLASS, max(LENGTHS, LENGTHS * round((hi - lo) / LENGTHS)))
                v = latent[f[lo:hi]].sum(0, dtype=float)
                if np.linalg.norm(v) > 0:
                    found.setdefault(size, []).append((k, lo - a, v / np.linalg.norm(v), f[lo:hi]))
        for size, parts in found.items():
            table = np.zeros((len(parts), FEATURES), np.int8)
            for r, p in enumerate(parts):
                np.add.at(table[r], p[3], 1)
            self.parts[size] = (np.array([p[0] for p in parts]), np.array([p[1] for p in parts]), np.stack([p[2] for p in parts]).astype(np.float32), table)


def bits(a: list[int]) -> dict[int, int]:
    """Where each word stands, as bits."""
    masks: dict[int, int] = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | 1 << i
    return masks


def common_subsequence(a: list[int], b: list[int], masks: dict[int, int] | None = None) -> int:
    """Length of the longest common subsequence, by bits of one number."""
    masks = bits(a) if masks is None else masks
    full = (1 << len(a)) - 1
    row = full
    for x in b:
        m = masks.get(x)
        if m:
            low = row & m
            row = (row + low | row - low) & full
    return len(a) - row.bit_count()


def with_blank(table: np.ndarray) -> np.ndarray:
    """A table by feature with a last row of zeros, for places without a word."""
    return np.vstack([table, np.zeros((1, table.shape[1]), table.dtype)])


def _fours(words: Words, f: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of a table's rows over every four words of each document, where documents begin, and the document of each four."""
    n = -(-words.count // 4)
    fours = np.concatenate([[0], np.cumsum(n)])
    doc = np.repeat(np.arange(len(n)), n)
    place = words.first[:-1][doc] + 4 * (np.arange(len(doc)) - fours[:-1][doc])
    end = words.first[1:][doc]
    total = table.take(f.take(place), axis=0)
    for k in range(1, 4):
        at = place + k
        total += table.take(np.where(at < end, f.take(at, mode="clip"), len(table) - 1), axis=0)
    return total, fours, doc


def in_common(seen: np.ndarray, have: np.ndarray) -> np.ndarray:
    """How many words each window has in common with a part, each counted as often as in both; -1 is no word."""
    if not len(seen):
        return np.zeros(0, int)
    seen = np.sort(seen, axis=1)
    new = np.ones(seen.shape, bool)
    new[:, 1:] = seen[:, 1:] != seen[:, :-1]
    steps = np.arange(seen.shape[1])
    before = steps - np.maximum.accumulate(np.where(new, steps, 0), axis=1)  # how often the word stood before
    return np.count_nonzero((seen >= 0) & (before < have.take(seen, mode="clip")), axis=1)


def _near(words: Words, f: np.ndarray, sums: np.ndarray, fours: np.ndarray, size: int, parts: tuple, have: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, document and part of each window of ``size`` words that is near a part in cosine and shares enough of its words.

    Windows begin at every quarter of their size, so each is four blocks in a row; what of a block lies beyond the
    document is blank. ``have`` says of each feature which parts have it, ``sums`` are those of latent vectors.
    """
    _, _, direction, table = parts
    step = size // 4
    least = np.ceil(SHARED * np.minimum(table.sum(1, dtype=int), size)).astype(np.int8)
    n = np.where(words.count > 0, np.maximum(-(-(words.count - size) // step), 0) + 1, 0)
    blocks = np.where(n > 0, n + 3, 0)
    doc = np.repeat(np.arange(len(n)), blocks)
    place = np.arange(len(doc)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    whole_window = place < n[doc]
    start, end = words.first[:-1][doc] + place * step, words.first[1:][doc]
    four, last = fours[:-1][doc] + place * (step // 4), fours[1:][doc]
    blank_sum, blank = np.zeros((1, sums.shape[1]), sums.dtype), len(have) - 1
    sums = np.concatenate([sums, blank_sum])
    out = []
    tile = max(256, CELLS // len(direction))
    for lo in range(0, len(doc) - 3, tile):
        rows = slice(lo, lo + tile + 3)
        v, shared = 0, 0
        for q in range(step // 4):
            at = four[rows] + q
            v = v + sums.take(np.where(at < last[rows], at, len(sums) - 1), axis=0)
        for j in range(step):
            at = start[rows] + j
            shared = shared + have.take(np.where(at < end[rows], f.take(at, mode="clip"), blank), axis=0)
        v = v[:-3] + v[1:-2] + v[2:-1] + v[3:]
        v /= np.maximum(np.sqrt(np.einsum("ij,ij->i", v, v)), 1e-12)[:, None]
        good = v @ direction.T >= NEAR
        good &= shared[:-3] + shared[1:-2] + shared[2:-1] + shared[3:] >= least
        w, p = np.divmod(np.flatnonzero(good), len(direction))
        w += lo
        w, p = w[whole_window[w]], p[whole_window[w]]
        for k in range(0, len(w), ROWS):
            a, b = w[k : k + ROWS], p[k : k + ROWS]
            at = start[a][:, None] + np.arange(size)
            seen = np.where(at < end[a][:, None], f.take(at, mode="clip") + b[:, None] * FEATURES, -1)
            fine = in_common(seen, table.reshape(-1)) >= least[b]
            out.append((a[fine], b[fine]))
    w, p = (np.concatenate(x) for x in zip((np.zeros(0, int),) * 2, *out, strict=True))
    return start[w], doc[w], p


FOUND = "doc_id long, item_id long, lcs double, answer double"


def search(docs: DataFrame, items: Items, latent: np.ndarray) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast((items, latent))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, latent = sent.value
        latent = with_blank(latent)
        have = {size: with_blank(np.ascontiguousarray(table.T > 0).view(np.int8)) for size, (_, _, _, table) in items.parts.items()}
        for batch, words in _pieces(batches):
            if not len(words):
                continue
            h, f = features(words)
            sums, fours, _ = _fours(words, f, latent)
            asked: dict[tuple[int, int], set[tuple[int, int]]] = {}
            for size, (owner, shift, _, _) in items.parts.items():
                at, doc, p = _near(words, f, sums, fours, size, items.parts[size], have[size])
                own, at = owner[p], at - shift[p]
                lo_word = np.maximum(at - size // 2, words.first[doc])
                hi_word = np.maximum(np.minimum(at + items.size[own] + size, words.first[doc + 1]), lo_word)
                for d, k, lo, hi in zip(doc.tolist(), own.tolist(), lo_word.tolist(), hi_word.tolist(), strict=True):
                    asked.setdefault((d, k), set()).add((lo, hi))
            for n, (lookup, first, owner, pos) in items.grams.items():
                g = lookup(windows(h, n))
                at = np.flatnonzero(g >= 0)
                at = at[words.doc[at] == words.doc[at + n - 1]]
                many = first[g[at] + 1] - first[g[at]]
                which = np.repeat(first[g[at]] - np.cumsum(many) + many, many) + np.arange(many.sum())
                place, k = np.repeat(at, many), owner[which]
                half = np.maximum(items.size[k] // 2, 4)
                begin = (place - pos[which]) // half  # a cell of half an item's length
                for d, k, x in np.unique(np.stack([words.doc[place], k, begin], 1), axis=0).tolist():
                    m = int(items.size[k])
                    half = max(m // 2, 4)
                    span = (max(x * half - half, int(words.first[d])), min(x * half + m + 2 * half, int(words.first[d + 1])))
                    asked.setdefault((d, k), set()).add(span)
            out = []
            for (d, k), spans in asked.items():
                best = (0.0, 0.0)
                for lo_word, hi_word in spans:
                    near = h[lo_word:hi_word].tolist()
                    own = items.words[k]
                    lcs = common_subsequence(own, near, items.bits[k]) / len(own)
                    if lcs >= ALIKE:
                        best = max(best, (lcs, common_subsequence(items.answer[k], near) / len(items.answer[k])))
                if best[0] >= SAME or (best[0] >= ALIKE and best[1] >= ANSWERED):
                    out.append((d, k, *best))
            if out:
                ids = batch.column(batch.schema.get_field_index("doc_id"))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array([o[0] for o in out])), pa.array(items.ids[[o[1] for o in out]]), pa.array([o[2] for o in out]), pa.array([o[3] for o in out])], ["doc_id", "item_id", "lcs", "answer"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, FOUND)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, lcs, answer): texts of docs(doc_id, text) that hold an item of benchmark(item_id, text).

    An item is held if a stretch of the text has SAME of its words as a common subsequence, or ALIKE of them and
    ANSWERED of its answer's. Null and empty texts hold nothing, and items without words are held by none; rows that
    are repeated give repeated results. Items go out in blocks of BLOCK, each a pass over the texts.
    """
    ship_code(docs.sparkSession)
    idf = inverse_frequencies(docs)
    latent = latent_space(docs, idf)
    out = None
    items = benchmark.where("text is not null and item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    blocks = -(-items.count() // BLOCK)
    for b in range(max(blocks, 1)):
        rows = items if blocks <= 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        found = search(docs, Items(sorted((r.item_id, r.text) for r in rows.collect()), latent, idf), latent)
        out = found if out is None else out.unionByName(found)
    return out


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold an item, with the item and how much of it. Null and empty texts hold none; repeated rows give
    repeated results; an empty table of either gives an empty one."""
    return contaminated(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
