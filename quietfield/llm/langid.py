"""Language identification by cross-parsing entropy.

Labelled text of each language becomes a suffix automaton. A text is parsed greedily against each: every phrase is
the longest piece that occurs somewhere in that language's text. Fewer phrases per character mean a smaller cross
entropy, and the language with the fewest wins.

Texts are read in lower case, as UTF-8, with one blank for each run of characters that are not letters; so every
script has its whole alphabet, and the automata are dense tables over the bytes that their language has. Many texts are
parsed at once, a byte of each per step: long texts are cut into segments of SEGMENT bytes, which are parsed side by
side and then mended: a segment is parsed again from where the one before it ends, up to where both parses are in one
state. So phrases run over the cuts, and their number is that of the whole text.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quietfield.llm.common import fold, read, ship_code
from quietfield.llm.kernel import offsets, pieces, whole

SEGMENT = 512
FOLDS, HELD_OUT = 3, 1
UND = "und"
PARSED = "lang_pred string, score double"
BLANK = 0x20


def is_letter(c: str) -> bool:
    return unicodedata.category(c).startswith("L")


def _low(point: int) -> int:
    """A letter in lower case, a mark as it is; BLANK for anything else."""
    c = chr(point)
    if is_letter(c):
        return ord(c.lower()[0])
    return point if unicodedata.category(c).startswith("M") else BLANK


_LOW = np.array([_low(p) for p in range(0x3000)], np.uint32)
_MARK = np.array([unicodedata.category(chr(p)).startswith("M") for p in range(0x3000)])


def normal(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all texts as they are parsed, where each begins (and the end), and how many letters each has."""
    at = offsets(texts)
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    points = np.frombuffer(raw.tobytes().decode(errors="replace").encode("utf-32-le"), np.uint32)
    at = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[at - at[0]]  # in characters
    low = _LOW[np.minimum(points, len(_LOW) - 1)]
    high = np.flatnonzero(points >= len(_LOW))
    if len(high):
        values, back = np.unique(points[high], return_inverse=True)
        low[high] = np.array([_low(int(v)) for v in values], np.uint32)[back]
    letter = low != BLANK
    mark = _MARK[np.minimum(points, len(_MARK) - 1)]
    if len(high):
        mark[high] = np.array([unicodedata.category(chr(int(v))).startswith("M") for v in values])[back]
    letters = np.concatenate([[0], np.cumsum(letter & ~mark)])
    keep = letter.copy()  # of a run of other characters one is kept
    keep[1:] |= letter[:-1]
    keep[at[:-1][at[:-1] < len(low)]] = True
    low, kept = low[keep], np.concatenate([[0], np.cumsum(keep)])[at]
    size = 1 + (low >= 0x80) + (low >= 0x800) + (low >= 0x10000)
    data = np.frombuffer(low.astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8)
    return data, np.concatenate([[0], np.cumsum(size)])[kept], letters[at[1:]] - letters[at[:-1]]


class Automata:
    """One table of transitions for all languages; a state is premultiplied by the size of its language's alphabet.

    A transition that fails has FAILED set and leads to where the failing byte begins a new phrase.
    """

    FAILED = np.int32(1 << 30)

    def __init__(self, texts: dict[str, str]):
        self.languages = sorted(texts)
        tables, self.starts, self.codes, base = [], [], [], 0
        for lang in self.languages:
            data, _, _ = normal(whole(pa.array([texts[lang]])))
            own = np.unique(data)
            code = np.zeros(256, np.int32)  # 0: a byte that the language's text lacks
            code[own] = np.arange(1, len(own) + 1)
            a = len(own) + 1
            table = self.automaton(code[data], a)
            root, n = table[0], len(table)
            # One state more, in which every byte begins a phrase: the start, and what follows a byte that the
            # language's text doesn't have.
            full = np.vstack([table, np.full((1, a), -1, np.int32)])
            step = np.where(full < 0, np.where(root < 0, n, root)[None, :], full) * a + base
            tables.append(np.where(full < 0, step | self.FAILED, step).astype(np.int32).ravel())
            self.starts.append(base + n * a)
            self.codes.append(code)
            base += (n + 1) * a
        self.table = np.concatenate(tables) if tables else np.zeros(0, np.int32)

    @staticmethod
    def automaton(codes: np.ndarray, a: int) -> np.ndarray:
        """Suffix automaton of a code sequence, as rows of next states (-1: none)."""
        n = len(codes)
        go = np.full((2 * n + 2, a), -1, np.int32)
        length, link = [0] * (2 * n + 2), [-1] * (2 * n + 2)
        last, states = 0, 1
        for c in codes.tolist():
            new, p = states, last
            states += 1
            length[new] = length[last] + 1
            while p >= 0 and go[p, c] < 0:
                go[p, c] = new
                p = link[p]
            if p < 0:
                link[new] = 0
            else:
                q = int(go[p, c])
                if length[q] == length[p] + 1:
                    link[new] = q
                else:
                    copy = states
                    states += 1
                    length[copy], link[copy] = length[p] + 1, link[q]
                    go[copy] = go[q]
                    while p >= 0 and go[p, c] == q:
                        go[p, c] = copy
                        p = link[p]
                    link[q] = link[new] = copy
            last = new
        return go[:states]

    def phrases(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Phrases of each text (data[at[i]:at[i+1]]) under each language."""
        texts, k = len(at) - 1, len(self.languages)
        parts = -(-np.diff(at) // SEGMENT)
        owner = np.repeat(np.arange(texts), parts)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
        begin = at[:-1][owner] + place * SEGMENT
        size = np.minimum(at[1:][owner] - begin, SEGMENT)
        out = np.zeros((texts, k), np.int64)
        if not len(owner):
            return out
        order = np.argsort(-size, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        follows = np.where(place > 0, np.append(rank[-1:], rank[:-1]), -1)[order]  # the segment before, if any
        owner, begin, size = owner[order], begin[order], size[order]
        after = np.full(len(owner), -1)
        after[follows[follows >= 0]] = np.flatnonzero(follows >= 0)
        alive = np.searchsorted(-size, -np.arange(1, SEGMENT + 1), side="right")  # segments with a byte there
        padded = np.concatenate([data, np.zeros(SEGMENT, data.dtype)])
        columns = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, SEGMENT)[begin].T)
        taken = np.zeros((SEGMENT, len(owner)), np.int32)
        for lang in range(k):
            own = self.codes[lang].take(columns)
            state, count = np.full(len(owner), self.starts[lang], np.int32), np.zeros(len(owner), np.int64)
            for j in range(SEGMENT):
                m = alive[j]
                if not m:
                    break
                step = self.table.take(state[:m] + own[j, :m], mode="clip")
                taken[j, :m] = step
                count[:m] += step >> 30
                state[:m] = step & (self.FAILED - 1)
            self._mend(own, taken, size, follows, after, state, count)
            out[:, lang] = np.bincount(owner, count, texts)
        return out

    def _mend(self, own: np.ndarray, taken: np.ndarray, size: np.ndarray, follows: np.ndarray, after: np.ndarray, state: np.ndarray, count: np.ndarray) -> None:
        """Counts as if each segment had been entered in the state that the one before it ends in."""
        fresh_end, fresh_count = state.copy(), count.copy()
        todo = np.flatnonzero(follows >= 0)
        while len(todo):
            now, gain, seg = state[follows[todo]].copy(), np.zeros(len(todo), np.int64), todo
            place = np.arange(len(todo))
            new_end, more = fresh_end[todo].copy(), np.zeros(len(todo), np.int64)
            for j in range(SEGMENT):
                step = self.table.take(now + own[j, seg], mode="clip")
                was = taken[j, seg]
                gain += (step >> 30) - (was >> 30)
                now = step & (self.FAILED - 1)
                met = now == (was & (self.FAILED - 1))
                done = met | (j + 1 >= size[seg])
                if done.any():
                    more[place[done]], new_end[place[done]] = gain[done], now[done]
                    met_end = done & met
                    new_end[place[met_end]] = fresh_end[seg[met_end]]
                    left = ~done
                    now, gain, seg, place = now[left], gain[left], seg[left], place[left]
                    if not len(seg):
                        break
            changed = new_end != state[todo]
            count[todo], state[todo] = fresh_count[todo] + more, new_end
            todo = after[todo[changed]]
            todo = todo[todo >= 0]

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """Language and score of each text; ``und`` and 0 where it has no letter.

        Score: by how much (as a share) the runner-up needs more phrases; 1 with a single language.
        Ties go to the language that sorts first.
        """
        data, at, n_letters = normal(texts)
        if not self.languages:
            return [UND] * len(texts), np.zeros(len(texts))
        n = self.phrases(data, at)
        best = n.argmin(1)
        least = n[np.arange(len(n)), best]
        second = np.partition(n, 1, axis=1)[:, 1] if n.shape[1] > 1 else np.full(len(n), np.inf)
        score = np.where(n_letters > 0, 1 - least / np.maximum(second, 1), 0.0)
        return [self.languages[i] if k else UND for i, k in zip(best.tolist(), n_letters.tolist(), strict=True)], score


def fit(docs: DataFrame, texts_per_language: int = 48, chars_per_language: int = 24_000, chars: int = 600_000) -> Automata:
    """Automata from a bounded sample of labelled rows of ``docs`` (text, lang, doc_id).

    Of each label the ``texts_per_language`` rows of smallest id hash give up to ``chars_per_language`` characters in
    all, an even share of each text, from a place that the id's hash names. With many labels each gives less, so that
    all together have ``chars``: this bounds the tables (and the broadcast) whatever the input. Rows with a null label or
    text teach nothing; labels whose sample has no letter are not learned; without any labelled row every text is ``und``.
    """
    spark = docs.sparkSession
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    rank = Window.partitionBy("lang").orderBy("h", "doc_id")
    chosen = labelled.select("doc_id", "lang", F.xxhash64("doc_id").alias("h")).withColumn("k", F.row_number().over(rank))
    ids = sorted({(r.doc_id, r.lang) for r in chosen.where(F.col("k") <= texts_per_language).select("doc_id", "lang").collect() if r.doc_id is not None})
    if not ids:
        return Automata({})
    each = min(chars_per_language, max(chars // len({lang for _, lang in ids}), 1))
    share = -(-each // texts_per_language)
    size = 8 * share
    start = F.pmod(F.xxhash64("doc_id"), F.greatest(F.length("text") - size + 1, F.lit(1))).cast("int") + 1
    wanted = F.broadcast(spark.createDataFrame(ids, "doc_id long, lang string"))
    rows = labelled.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", F.substring("text", start, F.lit(size)).alias("text")).join(wanted, ["doc_id", "lang"], "left_semi").collect()
    texts: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.text)):
        texts.setdefault(r.lang, []).append(r.text)
    sample = {}
    for lang, found in texts.items():
        left, out = each, []
        for i, x in enumerate(found):
            part = x[: max(share, left // (len(found) - i))][:left]
            out.append(part)
            left -= len(part)
        if any(is_letter(c) for x in out for c in x):
            sample[lang] = " ".join(out)
    return Automata(sample)


def identify(docs: DataFrame, model: Automata) -> DataFrame:
    """``docs`` with lang_pred and score (replacing columns of these names). A null text is ``und``."""
    spark = docs.sparkSession
    ship_code(spark)
    shared = spark.sparkContext.broadcast(model)
    kept = docs.drop("lang_pred", "score")
    schema = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in kept.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = whole(batch.column(batch.schema.get_field_index("text")))
            for lo, hi in pieces(texts, 1 << 21):
                lang, score = shared.value.predict(texts.slice(lo, hi - lo))
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*part.schema.names, "lang_pred", "score"])

    return kept.mapInArrow(run, f"{schema}, {PARSED}")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, learned from the labelled documents outside the held-out fold; its columns are those of
    the contract. Null, empty and letterless texts are ``und`` with score 0; repeated rows give repeated results."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs.where(fold(F.col("doc_id"), FOLDS) != HELD_OUT))
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "lang_pred", "score")
