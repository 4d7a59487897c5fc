"""Language-model scores of whole documents: exact counts of all training tokens, and a gated recurrent model.

Tokens are words with A-Z in lower case, and one end for each document. The model's vocabulary is the most frequent
words; every other word is one of some tail tokens (by its first two bytes), times its share of that tail's counts.
So the score is a log10 probability over all texts, unseen words included.

Counts are kept by 64-bit hash of the word. The FREQUENT most frequent are broadcast (a fixed bound); the counts of
rarer words reach the documents by a join. The recurrent model is trained where the data are: each round has an
even share of the training documents, all of them in the rounds together; every task trains on its part of the round's
from the same start, and the weights are averaged by tokens: sums of them are made in tasks, level by level, and the
driver gets at most SUMS of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quietfield.llm.common import Scratch, fold, read
from quietfield.llm.gru import Model
from quietfield.llm.kernel import Lookup, Words, mix, text_pieces

FOLDS, HELD_OUT = 7, 2
FREQUENT, VOCABULARY, TAILS = 1 << 19, 992, 31
ROUNDS = 3
SUMS = 32
#: The tail of each two bytes.
_TAIL = (mix(np.arange(1 << 16, dtype=np.uint64)) % np.uint64(TAILS)).astype(np.int32)


def lowered(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hash and tail of each word."""
    data = words.lowered()
    two = np.where(words.end - words.start > 1, data.take(words.start + 1, mode="clip"), 0) if len(words) else 0
    return words.hashes(data), _TAIL[data[words.start].astype(np.int64) * 256 + two]


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, words in text_pieces(batches):
        if len(words):
            h, tail = lowered(words)
            order = np.argsort(h)
            h = h[order]
            new = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            n = np.diff(np.concatenate([new, [len(h)]]))
            yield pa.RecordBatch.from_arrays([pa.array(h[new].view(np.int64)), pa.array(tail[order[new]]), pa.array(n)], ["h", "tail", "c"])


class Language:
    """What scoring needs of the corpus: bounded tables."""

    def __init__(self, h: np.ndarray, c: np.ndarray, tail: np.ndarray, tails: dict[int, tuple[int, int]], n: int, v: int, ends: int):
        order = np.lexsort((h, -c))
        self.lookup, count = Lookup(h[order].view(np.uint64)), c[order].astype(np.int64)
        self.log_count = np.concatenate([np.log10(count + 1.0), [0.0]])  # the last is of place -1, of words not in the list
        k = min(VOCABULARY, len(c))
        self.n, self.v, self.ends = n, v, ends
        seen, kinds = np.zeros(TAILS), np.zeros(TAILS)
        for t, (total, distinct) in tails.items():
            seen[t], kinds[t] = total, distinct
        np.subtract.at(seen, tail[order[:k]], count[:k])
        np.subtract.at(kinds, tail[order[:k]], 1)
        self.tail_log = np.log10(seen + kinds + 1)
        # tokens: the vocabulary's words, the end, the tails; by falling counts
        counts = np.concatenate([count[:k], [ends], seen])
        rank = np.empty(len(counts), np.int32)
        rank[np.argsort(-counts, kind="stable")] = np.arange(len(counts))
        self.k, self.word_token, self.end, self.tail_token = k, rank[:k], int(rank[k]), rank[k + 1 :]
        self.model = Model(np.sort(counts)[::-1], self.end)

    def tokens(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens of a piece with ends; place in the list of frequent words (else -1) and tail of each word."""
        h, tail = lowered(words)
        place = self.lookup(h)
        inside = (place >= 0) & (place < self.k)
        token = self.tail_token[tail]
        token[inside] = self.word_token[place[inside]]
        out = np.full(len(h) + len(words.count), self.end, np.int32)
        out[np.arange(len(h)) + words.doc] = token
        return out, place, tail

    def logs(self, place: np.ndarray, tail: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What counts for each word: log10(c + 1) where known so far, and with log10 of the tail's total off it where it is of a tail."""
        log_c = self.log_count[place]
        return log_c, np.where((place >= 0) & (place < self.k), 0.0, log_c - self.tail_log[tail])


def learn(docs: DataFrame, scratch: Scratch, rounds: int = ROUNDS, share: int | None = None, frequent: int = FREQUENT) -> tuple[Language, DataFrame]:
    """Counts of all words of docs(doc_id, text), and a model trained on a ``share``-th of them in each round.

    ``share`` is the number of rounds unless given, so that the rounds together train on every document once.
    """
    spark, share = docs.sparkSession, share or rounds
    counted = docs.select("text").mapInArrow(count_words, "h long, tail int, c long").groupBy("h", "tail").agg(F.sum("c").alias("c"))
    counted = scratch.write(counted, "counts")
    tails = {r.tail: (r.n, r.v) for r in counted.groupBy("tail").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()}
    ends = docs.count()
    # Of the counts' eighths of powers of two, as many as fit into the bound.
    level = F.floor(F.log2("c") * 8)
    left, floor = frequent, 0
    for r in counted.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():
        left -= r["count"]
        if left < 0:
            floor = r.level + 1
            break
    top = counted.where(level >= floor).toArrow()
    column = lambda name: top[name].to_numpy()
    n, v = sum(x for x, _ in tails.values()) + ends, sum(x for _, x in tails.values()) + (ends > 0)
    language = Language(column("h"), column("c"), column("tail"), tails, n, v, ends)
    for k in range(rounds):
        sent = spark.sparkContext.broadcast(language)

        def train(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            lang, model, seen = sent.value, None, 0
            for batch in batches:
                parts = [(lang.tokens(words)[0], words.count + 1) for _, words in text_pieces([batch])]
                if parts:
                    if model is None:
                        model = Model(np.ones(lang.model.v), lang.end).unpack(lang.model.pack())
                    seen += model.train(np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts]))
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array([seen], pa.int64()), pa.array([model.pack().astype(np.float64) * seen], pa.list_(pa.float64()))], ["n", "w"])

        mine = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(share)) == k % share).select("text")
        total, seen = _summed(mine.mapInArrow(train, WEIGHTS))
        if seen:
            language.model.unpack(total / seen)
        sent.unpersist()
    return language, counted


WEIGHTS = "n long, w array<double>"


def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for all of a task's: the sums of n and of w, a row at a time."""
    n, total = 0, None
    for batch in batches:
        for k, w in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            x = w.values.to_numpy()
            n, total = n + k, x.copy() if total is None else total + x
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total], pa.list_(pa.float64()))], ["n", "w"])


def _summed(each: DataFrame) -> tuple[np.ndarray, int]:
    """Sums of w and n over all rows, of which each task has one; in tasks by the root of their number until few are left."""
    tasks = each.rdd.getNumPartitions()
    while tasks > SUMS:
        tasks = -(-tasks // SUMS)
        each = each.repartition(tasks).mapInArrow(_sum, WEIGHTS)
    total, seen = np.zeros(1), 0
    for batch in each.toArrow().to_batches():
        for x in _sum(iter([batch])):
            total, seen = total + x.column(1)[0].values.to_numpy(), seen + x.column(0)[0].as_py()
    return total, seen


SCORED = "id long, version long, none boolean, n_tokens long, n_known long, base double, score double"


def score(docs: DataFrame, language: Language, counted: DataFrame) -> DataFrame:
    """docs(doc_id, text) with n_tokens, n_known, base_score, score (log10) of the whole text; null is empty."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(language)
    none = F.col("doc_id").isNull()
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.xxhash64(F.coalesce("text", F.lit("")), none).alias("version"), "text", none.alias("none"))

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lang = sent.value
        for batch, words in text_pieces(batches):
            h, _ = lowered(words)
            at = np.flatnonzero(lang.lookup(h) < 0)
            doc = words.doc[at]
            ids, versions = (batch.column(i).to_numpy()[doc] for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(h[at].view(np.int64)), pa.array(ids), pa.array(versions)], ["h", "id", "version"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lang = sent.value
        total = np.log10(lang.n + lang.v + 1)
        for batch in batches:
            tokens, sizes, known, base, rest = [], [], [], [], []
            for _, words in text_pieces([batch]):
                token, place, tail = lang.tokens(words)
                log_c, extra = lang.logs(place, tail)
                add = lambda x, words=words: np.bincount(words.doc, x, len(words.count))
                tokens.append(token)
                sizes.append(words.count + 1)
                known.append(add(place >= 0) + (lang.ends > 0))
                base.append(add(log_c) + np.log10(lang.ends + 1) - (words.count + 1) * total)
                rest.append(add(extra))
            if sizes:
                sizes = np.concatenate(sizes)
                own = lang.model.score(np.concatenate(tokens), sizes) / np.log(10) + np.concatenate(rest)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(sizes.astype(np.int64)), pa.array(np.concatenate(known).astype(np.int64)), pa.array(np.concatenate(base)), pa.array(own)], ["id", "version", "none", "n_tokens", "n_known", "base", "score"])

    texts = keyed.select("id", "version", "text")
    found = texts.mapInArrow(rare, "h long, id long, version long").groupBy("h", "id", "version").agg(F.count("*").alias("tf"))
    more = found.join(counted.select("h", "c"), "h").groupBy("id", "version").agg(F.sum(F.col("tf") * F.log10(F.col("c") + 1.0)).alias("more"), F.sum("tf").alias("known"))
    # Rows of one doc_id with one text were counted together: each has its share.
    same = keyed.groupBy("id", "version").agg(F.count("*").alias("rows")).where("rows > 1")
    own = keyed.mapInArrow(run, SCORED)
    out = own.join(more, ["id", "version"], "left").join(same, ["id", "version"], "left")
    share = lambda c: F.coalesce(F.col(c) / F.coalesce("rows", F.lit(1)), F.lit(0.0))
    return out.select(
        F.when(~F.col("none"), F.col("id")).alias("doc_id"),
        "n_tokens", (F.col("n_known") + share("known")).cast("long").alias("n_known"),
        (F.col("base") + share("more")).alias("base_score"), (F.col("score") + share("more")).alias("score"),
    )


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score, learned from those outside the held-out fold; its columns are those of the contract.

    A null or empty text is its end alone; a null doc_id is not held out; repeated rows give repeated results.
    """
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out_of_fold = F.coalesce(fold(F.col("doc_id"), FOLDS), F.lit(0)) == HELD_OUT
    scratch = Scratch(spark, "lmscore")
    language, counted = learn(docs.where(~out_of_fold), scratch)
    scratch.free()
    found = score(docs, language, counted)
    return found.select("doc_id", out_of_fold.alias("held_out"), "n_tokens", "n_known", F.lit(language.n).cast("long").alias("train_tokens"), "base_score", "score")
