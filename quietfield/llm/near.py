"""Near duplicates by ProbMinHash: signatures of weighted shingles, banding, exact verification, classes.

A document is its shingles of five words; one that occurs n times weighs 2 - 1/n. Every shingle sends arrivals of a
Poisson process of its weight as rate: the j-th goes to the j-th component of the shingle's own permutation, and a
component keeps the shingle that arrives first. Two signatures agree in a component with the probability Jaccard
similarity of the documents. An element stops as soon as its next arrival is later than all that a document has kept.
Weights stay within 1 and 2, so that one line, repeated many times, doesn't outweigh a text. A second signature gives
every shingle the weight 1; it agrees in a component with the probability |A and B| / max(|A|, |B|), which is never less
than what is verified, the Jaccard similarity of the sets. Counts can part the weighted signatures of two such texts, so
26 of the 33 bands are of the second signature: of sets with a similarity of 0.8 they miss one pair in 30,000, of 0.85
one in 1.5 million, whatever the counts are. The other bands are of the weighted one.

Exact copies are one vertex from the start. Vertices that agree in a band meet in a bucket. In a small bucket all are
compared; in a larger one all are compared with its leader, the vertex with most company. Links give components.
Buckets that still hold several components are closed: signatures of different components are compared in blocks of
bounded size, and components with a promising pair form a region. What goes on from a block is a spanning forest of
its components, not its pairs. All texts of a region that are of different components are then compared exactly, in
tiles of bounded size, by their sets of shingles; a tile gives a spanning forest of its links. So no two texts that
meet in a bucket are left apart unseen, and no table has a row for each pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quietfield.llm.common import Scratch, read
from quietfield.llm.graph import components
from quietfield.llm.kernel import Words, mix, powers, text_pieces, whole, windows

SHINGLE, SIMILAR = 5, 0.8
COMPONENTS, ROWS = 167, 5  # a prime, so that steps make a permutation; 33 bands
PLAIN = 26  # bands of the signature without weights
BANDS = COMPONENTS // ROWS
SMALL, BLOCK, TILE = 4, 2048, 256
LOAD = 1 << 19  # words of a block of texts
PROMISING = 0.66  # four standard errors of an estimate below what is wanted
_U = np.uint64


def shingles(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle, weight) of each distinct shingle. A shorter text is one shingle; one without words has none."""
    h = words.hashes()
    s = windows(h, SHINGLE)
    n = len(s)
    inside = np.flatnonzero(words.doc[:n] == words.doc[SHINGLE - 1 : SHINGLE - 1 + n]) if n else np.zeros(0, np.int64)
    doc, value = words.doc[inside], s[inside]
    short = np.flatnonzero((words.count > 0) & (words.count < SHINGLE))
    if len(short):
        one, _ = sequence_prints(words, h)
        doc, value = np.concatenate([doc, short]), np.concatenate([value, one[short]])
    key = value ^ mix(doc.astype(np.uint64) + _U(1))
    order = np.argsort(key)
    key = key[order]
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else order
    first = order[new]
    return doc[first], value[first], 2 - 1 / np.diff(np.concatenate([new, [len(key)]]))


def sequence_prints(words: Words, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit fingerprints of each document's sequence of words."""
    place = np.arange(len(h)) - words.first[:-1][words.doc]
    out = []
    for base in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F):
        total = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * powers(base, len(h) + 1)[place], out=total[1:])
        out.append(mix(total[words.first[1:]] - total[words.first[:-1]] + words.count.astype(np.uint64)))
    return out[0], out[1]


def prob_minhash(doc: np.ndarray, value: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """Signatures (n x COMPONENTS) of documents 0..n-1: the shingle that arrives first in each component."""
    m = COMPONENTS
    best, kept = np.full(n * m, np.inf), np.zeros(n * m, np.uint64)
    seed = mix(value + _U(0x632BE59BD9B4E019))
    at, step = (seed % _U(m)).astype(np.int64), (seed >> _U(32)) % _U(m - 1)
    step = step.astype(np.int64) + 1
    x, row, weight = np.zeros(len(doc)), doc * m, weight.astype(np.float64)
    for j in range(m):
        seed = mix(seed + _U(0x9E3779B97F4A7C15))
        x = x - np.log(((seed >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53) * (m / (m - j)) / weight
        flat = row + at
        better = np.flatnonzero(x < best[flat])
        f, y = flat[better], x[better]
        np.minimum.at(best, f, y)
        won = y == best[f]
        kept[f[won]] = value[better[won]]
        latest = best.reshape(n, m).max(1)
        go = np.flatnonzero(x < latest[row // m])
        if not len(go):
            break
        at = at[go] + step[go]
        x, row, seed, step, weight, value = x[go], row[go], seed[go], step[go], weight[go], value[go]
        at[at >= m] -= m
    return kept.reshape(n, m)


def band_keys(signature: np.ndarray) -> np.ndarray:
    keys = np.zeros((len(signature), BANDS), np.uint64)
    for b in range(BANDS):
        k = np.full(len(signature), b + 1, np.uint64)
        for r in range(ROWS):
            k = mix(k * _U(0x9E3779B97F4A7C15) + signature[:, b * ROWS + r])
        keys[:, b] = k
    return keys


def _lists(x: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(np.ascontiguousarray(x).view(np.int64).ravel()))


def _rows(x: np.ndarray) -> pa.Array:
    """Each row's bytes."""
    return pa.array([r.tobytes() for r in x], pa.binary())


SIGNED = "doc_id long, p1 long, p2 long, n int, sig binary, keys array<long>"


def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, words in text_pieces(batches):
        doc, value, weight = shingles(words)
        signature = prob_minhash(doc, value, np.ones(len(doc)), len(batch))
        keys = band_keys(prob_minhash(doc, value, weight, len(batch)))
        keys[:, :PLAIN] = band_keys(signature)[:, :PLAIN]
        p1, p2 = sequence_prints(words, words.hashes())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(p1.view(np.int64)), pa.array(p2.view(np.int64)), pa.array(words.count.astype(np.int32)), _rows(signature.astype(np.uint16)), _lists(keys)],
            ["doc_id", "p1", "p2", "n", "sig", "keys"],
        )


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, COMPONENTS)


ESTIMATED = "a long, b long, est double"


def estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = (_signatures(batch.column(batch.schema.get_field_index(c))) for c in ("sig_a", "sig_b"))
        yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in ("a", "b")), pa.array((a == b).mean(1))], ["a", "b", "est"])


def agreements(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many components each signature of ``a`` agrees with each of ``b``."""
    out = np.zeros((len(a), len(b)), np.uint8)
    if out.size <= 1024:
        return np.count_nonzero(a[:, None] == b[None], axis=2)
    left, right = np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)
    for x, y in zip(left, right, strict=True):
        out += x[:, None] == y[None]
    return out


class Forest:
    """Which components have been joined; the joins made are a spanning forest."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = i = self.parent[self.parent[i]]
        return int(i)

    def roots(self, i: np.ndarray) -> np.ndarray:
        while True:
            up = self.parent[i]
            if np.array_equal(up, i):
                return i
            i = up

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.parent[max(a, b)] = min(a, b)
        return a != b


def promising(comp: np.ndarray, side: np.ndarray, sig: np.ndarray, one: int, two: int) -> list[tuple[int, int]]:
    """Of blocks ``one`` and ``two``: components joined by promising estimates, as a spanning forest."""
    names, number = np.unique(comp, return_inverse=True)
    order = np.argsort(number, kind="stable")
    left, right = order[side[order] == one], order[side[order] == two]
    forest, found = Forest(len(names)), []
    for i in range(0, len(left), TILE):
        x = left[i : i + TILE]
        for j in range(i if one == two else 0, len(right), TILE):
            y = right[j : j + TILE]
            p, q = forest.roots(number[x]), forest.roots(number[y])
            if p.min() == p.max() == q.min() == q.max():
                continue
            r, c = np.nonzero((agreements(sig[x], sig[y]) >= PROMISING * COMPONENTS) & (p[:, None] != q[None]))
            for pair in np.unique(p[r] * len(names) + q[c]).tolist():
                a, b = divmod(pair, len(names))
                if forest.join(a, b):
                    found.append((int(names[a]), int(names[b])))
    return found


REGION_EDGES = "a long, b long"


def _groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[tuple, pa.Table]]:
    """Rows of each group of neighbours with the same keys."""
    held: list[pa.RecordBatch] = []
    now: tuple | None = None
    for batch in batches:
        if not len(batch):
            continue
        columns = [batch.column(batch.schema.get_field_index(k)) for k in keys]
        new = np.zeros(len(batch), bool)
        for c in columns:
            x = c.to_numpy(zero_copy_only=False)
            new[1:] |= x[1:] != x[:-1]
        cut = np.flatnonzero(new).tolist()
        for lo, hi in zip([0, *cut], [*cut, len(batch)], strict=True):
            group = tuple(c[lo].as_py() for c in columns)
            if held and group != now:
                yield now, pa.Table.from_batches(held)
                held = []
            now = group
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield now, pa.Table.from_batches(held)


def _edges(found: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = (np.array(x, np.int64) for x in (zip(*found, strict=True) if found else ((), ())))
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Joined components of every (key, one, two), whose rows stand together."""
    for (_, one, two), rows in _groups(batches, ("key", "one", "two")):
        sig = _signatures(rows["sig"])
        yield _edges(promising(rows["comp"].to_numpy(), rows["side"].to_numpy(), sig, one, two))


SETS = "v long, n int, shingles binary"


def shingle_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's distinct shingles as bytes."""
    for batch, words in text_pieces(batches):
        doc, value, _ = shingles(words)
        order = np.argsort(doc, kind="stable")
        value, cut = value[order], np.searchsorted(doc[order], np.arange(len(batch) + 1))
        sets = [value[i:j].tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(cut).astype(np.int32)), pa.array(sets, pa.binary())], ["v", "n", "shingles"])


def linked(v: np.ndarray, comp: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, similar: float) -> list[tuple[int, int]]:
    """Links between texts of different components, ``left`` against ``right`` (places), as a spanning forest."""
    names, number = np.unique(comp, return_inverse=True)
    forest, found = Forest(len(names)), []
    size = np.array([len(x) for x in sets])
    if size[left].sum() > size[right].sum():
        left, right = right, left
    value = np.concatenate([sets[i] for i in right])
    owner = np.repeat(np.arange(len(right)), size[right])
    order = np.argsort(value)
    value, owner = value[order], owner[order]
    for i in left.tolist():
        mine, theirs = forest.root(number[i]), forest.roots(number[right])
        if (theirs == mine).all():
            continue
        lo, hi = np.searchsorted(value, sets[i]), np.searchsorted(value, sets[i], side="right")
        n = hi - lo
        at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
        both = np.bincount(owner[at], minlength=len(right))
        near = np.flatnonzero((both >= similar * (size[i] + size[right] - both)) & (theirs != mine))
        for j in near.tolist():
            if forest.join(number[i], number[right[j]]):
                found.append((int(v[i]), int(v[right[j]])))
    return found


def tiles(similar: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links of every (region, one, two), whose rows stand together."""
        for (_, one, two), rows in _groups(batches, ("region", "one", "two")):
            side = np.array(rows["block"].to_pylist())
            sets = [np.frombuffer(x, np.uint64) for x in rows["shingles"].to_pylist()]
            yield _edges(linked(rows["v"].to_numpy(), rows["comp"].to_numpy(), sets, np.flatnonzero(side == one), np.flatnonzero(side == two), similar))

    return run


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets of shingles."""
    other = len(np.setxor1d(a, b, assume_unique=True))
    both = (len(a) + len(b) - other) // 2
    return both / max(both + other, 1)


CHECKED = "a long, b long, sim double"


def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact similarity of pairs of texts."""

    def sets(texts: pa.Array) -> list[np.ndarray]:
        doc, value, _ = shingles(Words(texts))
        order = np.argsort(doc, kind="stable")
        cut = np.searchsorted(doc[order], np.arange(len(texts) + 1))
        return [value[order[i:j]] for i, j in zip(cut[:-1], cut[1:], strict=True)]

    for batch in batches:
        column = lambda c, batch=batch: batch.column(batch.schema.get_field_index(c))
        texts = {"a": whole(column("text_a")), "b": whole(column("text_b"))}
        out: list[float] = []
        for lo in range(0, len(batch), 64):
            left, right = (sets(texts[c].slice(lo, 64)) for c in "ab")
            out.extend(similarity(x, y) for x, y in zip(left, right, strict=True))
        yield pa.RecordBatch.from_arrays([column("a"), column("b"), pa.array(out, pa.float64())], ["a", "b", "sim"])


def near_duplicates(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """(doc_id, class_id) for every row of docs(doc_id, text): class_id is the least doc_id of its class.

    Classes are the components of links, pairs of texts whose shingles have a Jaccard similarity of ``similar`` or more. Rows of one doc_id are one
    document with several texts. Texts without words (null, empty, blank) are alone; a null doc_id has a null class.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = scratch.write(docs.where("doc_id is not null").mapInArrow(sign, SIGNED), "signed")
    copies = signed.where("n > 0").groupBy("p1", "p2").agg(F.min("doc_id").alias("v"))
    copies = scratch.write(copies, "copies", compact=True)
    members = scratch.write(signed.where("n > 0").select("doc_id", "p1", "p2").join(copies, ["p1", "p2"]).select("doc_id", "v").distinct(), "members", compact=True)
    reps = signed.join(copies.withColumnRenamed("v", "doc_id"), ["doc_id", "p1", "p2"]).select(F.col("doc_id").alias("v"), "sig", "keys").dropDuplicates(["v", "sig"])
    reps = scratch.write(reps, "reps")
    scratch.drop("signed", "copies")

    met = reps.select(F.explode("keys").alias("key"), "v").distinct()
    counts = met.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    company = scratch.write(met.join(counts, "key"), "company")
    small = company.where(f"n <= {SMALL}").select("key", "v")
    pairs = small.alias("x").join(small.alias("y"), "key").where("x.v < y.v").select(F.col("x.v").alias("a"), F.col("y.v").alias("b"))
    large = company.where(f"n > {SMALL}")
    much = company.groupBy("v").agg(F.sum("n").alias("much"))
    leaders = large.join(much, "v").groupBy("key").agg(F.max(F.struct("much", (-F.col("v")).alias("v"))).alias("top")).select("key", (-F.col("top.v")).alias("leader"))
    pairs = pairs.unionByName(large.join(leaders, "key").where("v != leader").select(F.least("v", "leader").alias("a"), F.greatest("v", "leader").alias("b")))
    pairs = scratch.write(pairs.distinct(), "pairs", compact=True)
    links: list[DataFrame] = []
    if not pairs.isEmpty():
        needed = company.select("v").distinct()
        texts = scratch.write(docs.join(needed, docs.doc_id == needed.v, "left_semi").select(F.col("doc_id").alias("v"), "text").distinct(), "texts")
        sigs = reps.select("v", "sig")

        def check(asked: DataFrame, name: str) -> None:
            both = asked.join(texts.select(F.col("v").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("v").alias("b"), F.col("text").alias("text_b")), "b")
            checked = scratch.write(both.select("a", "b", "text_a", "text_b").mapInArrow(verify, CHECKED), name, compact=True)
            links.append(checked.where(F.col("sim") >= similar).select("a", "b"))

        seen = pairs.join(sigs.select(F.col("v").alias("a"), F.col("sig").alias("sig_a")), "a").join(sigs.select(F.col("v").alias("b"), F.col("sig").alias("sig_b")), "b")
        seen = seen.mapInArrow(estimate, ESTIMATED).groupBy("a", "b").agg(F.max("est").alias("est"))
        asked = scratch.write(seen.where(f"est >= {PROMISING}").select("a", "b"), "asked", compact=True)
        scratch.drop("pairs")
        check(asked, "checked-0")
        comps = components(_all(links), scratch, "comps-0")

        mixed = company.join(comps, "v", "left").withColumn("comp", F.coalesce("comp", "v"))
        open_ = mixed.where(f"n > {SMALL}").groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
        open_ = scratch.write(mixed.join(open_, "key"), "open", compact=True)
        scratch.drop("company")
        joined = scratch.write(_closed(open_, sigs), "joined", compact=True)
        if not joined.isEmpty():
            regions = components(joined, scratch, "regions").select(F.col("v").alias("comp"), F.col("comp").alias("region"))
            inside = scratch.write(open_.select("v", "comp").distinct().join(regions, "comp"), "inside", compact=True)
            sets = texts.join(inside, "v", "left_semi").select("v", "text").mapInArrow(shingle_sets, SETS)
            links.append(scratch.write(_within(scratch.write(inside.join(sets, "v"), "sets"), similar), "linked", compact=True))
            scratch.drop("sets", "inside")
        scratch.drop("texts", "open", "joined")
    classes = components(_all(links), scratch, "classes") if links else None
    named = members
    if classes is not None:
        named = members.join(classes, "v", "left").select("doc_id", F.coalesce("comp", "v").alias("class_id"))
    else:
        named = members.select("doc_id", F.col("v").alias("class_id"))
    # Texts of one doc_id may be in several classes: they are one.
    several = named.groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.max("class_id").alias("other"))
    several = scratch.write(several, "named", compact=True)
    joined = several.where("class_id < other")
    if not joined.isEmpty():
        merged = components(joined.select(F.col("other").alias("a"), F.col("class_id").alias("b")), scratch, "merged")
        several = several.join(merged, several.class_id == merged.v, "left").select("doc_id", F.coalesce("comp", "class_id").alias("class_id"))
    ids = docs.select("doc_id")
    return ids.join(several.select("doc_id", "class_id"), "doc_id", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))


def _closed(open_: DataFrame, sigs: DataFrame) -> DataFrame:
    """Components that have a promising pair, from open buckets (key, n, v, comp) in blocks."""
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    rows = open_.withColumn("side", F.pmod(F.xxhash64("v"), blocks).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rows = rows.join(sigs, "v").select("key", F.least("side", "with").alias("one"), F.greatest("side", "with").alias("two"), "side", "comp", "sig")
    return rows.repartition("key", "one", "two").sortWithinPartitions("key", "one", "two").mapInArrow(close, REGION_EDGES).distinct()


def _within(sets: DataFrame, similar: float) -> DataFrame:
    """Links within regions, of sets(v, comp, region, n, shingles).

    A large component has blocks of its own, which are never held against each other; small ones share blocks.
    """
    load = sets.groupBy("region", "comp").agg(F.sum(F.col("n") + 1).alias("load"))
    large = load.where(f"load >= {LOAD}").select("region", "comp", F.ceil(F.col("load") / LOAD).cast("int").alias("parts"))
    rest = load.where(f"load < {LOAD}").groupBy("region").agg(F.ceil(F.sum("load") / LOAD).cast("int").alias("shared"))
    own = sets.join(large, ["region", "comp"], "left").join(rest, "region", "left").withColumn(
        "block",
        F.when(F.col("parts").isNotNull(), F.concat_ws(":", F.col("comp").cast("string"), F.pmod(F.xxhash64("v"), F.col("parts")).cast("string")))
        .otherwise(F.concat_ws(":", F.lit("shared"), F.pmod(F.xxhash64("comp"), F.col("shared")).cast("string"))),
    )
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    blocks = large.select("region", F.col("comp").cast("string").alias("whose"), every("parts").alias("k")).unionByName(rest.select("region", F.lit("shared").alias("whose"), every("shared").alias("k")))
    blocks = blocks.select("region", "whose", F.concat_ws(":", "whose", F.col("k").cast("string")).alias("block"))
    x, y = (blocks.select("region", F.col("whose").alias(f"whose_{c}"), F.col("block").alias(c)) for c in ("one", "two"))
    met = x.join(y, "region").where("one <= two and (whose_one != whose_two or whose_one = 'shared')").select("region", "one", "two")
    sides = met.select("region", "one", "two", F.explode(F.array_distinct(F.array("one", "two"))).alias("block"))
    rows = own.select("region", "block", "v", "comp", "shingles").join(sides, ["region", "block"])
    return rows.repartition("region", "one", "two").sortWithinPartitions("region", "one", "two").mapInArrow(tiles(similar), REGION_EDGES).distinct()


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's class. Texts without words are alone, rows of one id are one document, and an empty table gives an
    empty one; a null id has a null class."""
    return near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"))
