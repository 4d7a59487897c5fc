"""Mixing to target weights with soft membership: domain posteriors, then nonnegative document rates.

A classifier of a bounded sample of labelled documents gives every document a posterior over domains. Rates r >= 0
then minimise the squared distance of the domains' expected token totals, sum of r * tokens * posterior, to target
shares of all tokens, by projected gradient from r = 1. A document's rate depends on the steps so far and on its
own posterior only, so an iteration is one small aggregation, and the rates are an expression over the posteriors.
Iterations are accelerated by momentum. Each aggregation tries several steps at once: plain gradients, and gradients in
the metric of the rates that are not zero, in which few steps are enough; the best one is taken.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quietfield.llm.common import Scratch, read, ship_code
from quietfield.llm.kernel import Words, mix, text_pieces

#: Domains of the labelled table, and the shares of tokens wanted of each.
DOMAINS = ("good", "poor", "toxic")
TARGETS = (0.75, 0.25, 0.0)
FEATURES, TELLS = 1 << 16, 4.0  # hashed features; standard errors by which one must tell domains apart
SAMPLE = 6_000
_U = np.uint64
_EDGE = frozenset(b".,;:!?\"'()[]")


def domain(quality: Column, toxic: Column) -> Column:
    return F.when(toxic == 1, 2).when(quality == 1, 0).when(quality == 0, 1)


def _features(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, feature) of a piece: words in lower case without a mark at the end, and what marks stand."""
    data = words.lowered()
    end = words.end.copy()
    last = data[end - 1] if len(end) else np.zeros(0, np.uint8)
    marked = ((last < 48) | ((last > 57) & (last < 97))) & (end - words.start > 1) & (last < 128)
    kept, words.end = words.end, end - marked
    f = (mix(words.hashes(data)) % _U(FEATURES - 128)).astype(np.int64) + 128
    words.end = kept
    doc = np.concatenate([words.doc, words.doc[marked]])
    return _distinct(doc, np.concatenate([f, last[marked].astype(np.int64)]))


def _distinct(doc: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    key = np.sort(doc * FEATURES + f)
    key = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
    return key // FEATURES, key % FEATURES


def _shape(words: Words) -> np.ndarray:
    """Dense features of each document: log length, share of capitals, of marks and of numerals, mean length of words."""
    d, n = words.data, np.maximum(np.diff(words.at), 1)
    total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[words.at]) / n
    marks = ((d > 32) & (d < 48)) | ((d > 57) & (d < 65)) | ((d > 90) & (d < 97)) | ((d > 122) & (d < 127))
    return np.stack([np.log1p(words.count), total((d >= 65) & (d <= 90)), total(marks), total((d >= 48) & (d <= 57)), np.log1p(n / np.maximum(words.count, 1))], 1)


class Classifier:
    """Multinomial logistic regression on all features that tell domains apart, and the shape of the text."""

    def __init__(self, doc: np.ndarray, f: np.ndarray, shape: np.ndarray, label: np.ndarray):
        k, n = len(DOMAINS), len(label)
        counts = np.stack([np.bincount(f[label[doc] == c], minlength=FEATURES) for c in range(k)]).astype(float)
        size = np.bincount(label, minlength=k).astype(float)
        seen = counts.sum(0)
        expected = seen[None] * size[:, None] / max(n, 1)
        z = np.abs(counts - expected) / np.sqrt(np.maximum(expected * (1 - size[:, None] / max(n, 1)), 0.5))
        z[:, seen < 3] = 0
        chosen = np.flatnonzero(z.max(0) > TELLS)
        self.at = np.full(FEATURES, -1, np.int32)
        self.at[chosen] = np.arange(len(chosen))
        self.mean, self.scale = (shape.mean(0), shape.std(0) + 1e-6) if n else (np.zeros(5), np.ones(5))
        on = self.at[f] >= 0
        order = np.argsort(doc[on], kind="stable")
        f, cut = self.at[f[on]][order], np.searchsorted(doc[on][order], np.arange(n + 1))
        dense = (shape - self.mean) / self.scale
        self.w, self.v, self.b = np.zeros((len(chosen), k)), np.zeros((5, k)), np.log((size + 1) / (n + k))
        self._learn(f, cut, dense, np.eye(k)[label])

    def _learn(self, f: np.ndarray, cut: np.ndarray, dense: np.ndarray, y: np.ndarray) -> None:
        """Adam over batches of rows; of the weights of features only those move that a batch has."""
        n, k = y.shape
        rng, step = np.random.default_rng(5), 0
        m1, m2 = [np.zeros_like(x) for x in (self.w, self.v)], [np.zeros_like(x) for x in (self.w, self.v)]
        for _ in range(max(12, -(-400 * 256 // max(n, 256))) if n else 0):  # 400 steps at least
            order = rng.permutation(n)
            for lo in range(0, n, 256):
                i = order[lo : lo + 256]
                many = cut[i + 1] - cut[i]
                mine = f[np.repeat(cut[i] - np.cumsum(many) + many, many) + np.arange(many.sum())]
                row = np.repeat(np.arange(len(i)), many)
                a = self.b + dense[i] @ self.v
                for c in range(k):
                    a[:, c] += np.bincount(row, self.w[mine, c], len(i))
                d = (self._soft(a) - y[i]) / len(i)
                touched, back = np.unique(mine, return_inverse=True)
                g = np.stack([np.bincount(back, d[row, c], len(touched)) for c in range(k)], 1) if len(touched) else np.zeros((0, k))
                step += 1
                for x, at, gx, first, second in ((self.w, touched, g, m1[0], m2[0]), (self.v, np.arange(5), dense[i].T @ d, m1[1], m2[1])):
                    gx = gx + 1e-5 * x[at]
                    first[at] += 0.1 * (gx - first[at])
                    second[at] += 0.001 * (gx * gx - second[at])
                    x[at] -= 0.02 * (first[at] / (1 - 0.9**step)) / (np.sqrt(second[at] / (1 - 0.999**step)) + 1e-8)

    @staticmethod
    def _soft(a: np.ndarray) -> np.ndarray:
        a = np.exp(a - a.max(1, keepdims=True))
        return a / a.sum(1, keepdims=True)

    def posterior(self, words: Words) -> np.ndarray:
        doc, f = _features(words)
        on = self.at[f] >= 0
        a = np.tile(self.b, (len(words.count), 1))
        for c in range(a.shape[1]):
            a[:, c] += np.bincount(doc[on], self.w[self.at[f[on]], c], len(a))
        return self._soft(a + (_shape(words) - self.mean) / self.scale @ self.v)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Classifier:
    """From the ``sample`` labelled rows of least id hash (all, if fewer): a bound on what the driver gets."""
    ship_code(docs.sparkSession)
    known = labels.where("doc_id is not null").select("doc_id", domain(F.col("quality"), F.col("toxic")).alias("label")).where("label is not null")
    ids = known.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, words in text_pieces(batches):
            doc, f = _features(words)
            cut = np.searchsorted(doc, np.arange(len(words.count) + 1)).astype(np.int32)
            shape = _shape(words)
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.ListArray.from_arrays(pa.array(cut), pa.array(f.astype(np.int32))), pa.array(list(shape), pa.list_(pa.float64()))], ["label", "f", "shape"])

    chosen = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("text", "label")
    got = chosen.mapInArrow(run, "label int, f array<int>, shape array<double>").toArrow().combine_chunks()
    n = len(got)
    sizes = got["f"].combine_chunks().value_lengths().to_numpy(zero_copy_only=False) if n else np.zeros(0, int)
    flat = got["f"].combine_chunks().flatten().to_numpy() if n else np.zeros(0, int)
    shape = got["shape"].combine_chunks().flatten().to_numpy().reshape(n, 5) if n else np.zeros((0, 5))
    return Classifier(np.repeat(np.arange(n), sizes), flat.astype(np.int64), shape, got["label"].to_numpy().astype(int) if n else np.zeros(0, int))


def posteriors(docs: DataFrame, model: Classifier) -> DataFrame:
    """doc_id, version (a hash of the text), tokens (words) and a posterior for each domain; null is an empty text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, words in text_pieces(batches):
            p = sent.value.posterior(words)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(words.count.astype(np.int64)), *(pa.array(np.ascontiguousarray(p[:, k])) for k in range(p.shape[1]))], ["doc_id", "version", "tokens", *(f"p_{d}" for d in DOMAINS)])

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), version().alias("version"), "text")
    return keyed.mapInArrow(run, "doc_id long, version long, tokens long, " + ", ".join(f"p_{d} double" for d in DOMAINS))


def version() -> Column:
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def rates(table: DataFrame, targets: tuple[float, ...] = TARGETS, iterations: int = 60, close: float = 1e-6) -> tuple[Column, list[float]]:
    """Rate of each row of posteriors(), as an expression, and the shares of tokens reached.

    Gradients are in the metric of tokens, so a step moves a rate by posterior * step. It ends when the shares are
    ``close`` to the targets, or five iterations running make the squared distance no more than a thousandth less. Without
    tokens every rate is 1.
    """
    total = table.agg(F.sum("tokens").alias("n")).first().n
    if not total:
        return F.lit(1.0), [0.0] * len(DOMAINS)
    want, k = np.array(targets), len(DOMAINS)
    weighed = table.select((F.col("tokens") / float(total)).alias("w"), *[f"p_{d}" for d in DOMAINS])

    def look(steps: list[Step], tried: list[np.ndarray], momentum: float) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """After each of the steps tried: shares reached, shares ahead (with momentum), and second moments of rows ahead
        that have a rate."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((len(tried), 2 * k + k * k))
            for batch in batches:
                w, *p = (c.to_numpy() for c in batch.columns)
                p = np.stack(p, 1)
                rate, ahead = np.ones(len(w)), np.ones(len(w))
                for h, beta in steps:
                    rate, ahead = _moved(rate, ahead, p @ h, beta, np.maximum)
                for t, h in enumerate(tried):
                    new, far = _moved(rate, ahead, p @ h, momentum, np.maximum)
                    on = p[far > 0]
                    sums[t] += np.concatenate([(w * new) @ p, (w * far) @ p, (on.T @ (on * w[far > 0][:, None])).ravel()])
            for t, x in enumerate(sums):
                yield pa.RecordBatch.from_arrays([pa.array([t], pa.int32()), pa.array([x], pa.list_(pa.float64()))], ["t", "x"])

        each = weighed.mapInArrow(run, "t int, x array<double>").groupBy("t").agg(*[F.sum(F.col("x")[i]).alias(f"x{i}") for i in range(2 * k + k * k)])
        rows = {r.t: np.array(r[1:]) for r in each.collect()}
        return [(rows[t][:k], rows[t][k : 2 * k], rows[t][2 * k :].reshape(k, k)) for t in range(len(tried))]

    steps: list[Step] = []
    reached, ahead, m = look(steps, [np.zeros(k)], 0.0)[0]
    longest = 1 / np.linalg.eigvalsh(m)[-1]  # no rate is zero here: with this length a gradient never fails to descend
    least, pace, slow = ((reached - want) ** 2).sum(), 1.0, 0
    best = (least, 0, reached, m)
    for _ in range(iterations):
        if np.abs(best[2] - want).max() < close or slow == 5:
            break
        e = ahead - want
        value, vector = np.linalg.eigh(m)
        metric = vector @ np.diag(1 / np.maximum(value, 1e-6 * max(value[-1], 1e-12))) @ vector.T
        tried = [longest * e, 100 * longest * e, *(c * (metric @ e) for c in (1.0, 0.5, 0.1))]
        faster = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        found = look(steps, tried, (pace - 1) / faster)
        t = min(range(len(tried)), key=lambda t: ((found[t][0] - want) ** 2).sum())
        now = ((found[t][0] - want) ** 2).sum()
        slow = slow + 1 if now > 0.999 * best[0] else 0
        if now > best[0]:  # too far: back to the best, and on without momentum
            steps = steps[: best[1]]
            if steps:
                steps[-1] = (steps[-1][0], 0.0)
            ahead, m, pace = best[2], best[3], 1.0
        else:
            steps.append((tried[t], (pace - 1) / faster))
            ahead, m, pace = found[t][1], found[t][2], faster
            best = (now, len(steps), found[t][0], m)
    return _rate(steps[: best[1]]), best[2].tolist()


Step = tuple[np.ndarray, float]  # how far along the posterior, and the momentum after it


def _moved(rate, ahead, along, momentum, larger):
    """The rate after a step, and the one ahead of it, from which the next step goes."""
    new = larger(0.0, ahead - along)
    return new, larger(0.0, new + (new - rate) * momentum)


def _rate(steps: list[Step]) -> Column:
    """Rate after some steps. They go in as one constant, so that the plan has one expression whatever their number."""
    if not steps:
        return F.lit(1.0)
    p = [F.col(f"p_{d}") for d in DOMAINS]
    taken = F.array(*[F.array(*[F.lit(float(x)) for x in (*h, beta)]) for h, beta in steps])
    start = F.struct(F.lit(1.0).alias("rate"), F.lit(1.0).alias("ahead"))

    def step(acc: Column, h: Column) -> Column:
        along = sum((q * h[i] for i, q in enumerate(p)), F.lit(0.0))
        new, far = _moved(acc["rate"], acc["ahead"], along, h[len(p)], lambda a, b: F.greatest(F.lit(a), b))
        return F.struct(new.alias("rate"), far.alias("ahead"))

    return F.aggregate(taken, start, step)["rate"]


def mix_to_targets(docs: DataFrame, labels: DataFrame, targets: tuple[float, ...] = TARGETS) -> DataFrame:
    """doc_id, version, tokens, posteriors, domain (the likeliest) and rate for every row of docs(doc_id, text).

    Ties of domains go to the first. Rows without words keep the rate of their posterior and count for nothing.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    table = scratch.write(posteriors(docs, fit(docs, labels)), "posteriors")
    rate, _ = rates(table, targets)
    p = [F.col(f"p_{d}") for d in DOMAINS]
    most = F.greatest(*p)
    named = F.coalesce(*[F.when(q == most, F.lit(d)) for q, d in zip(p, DOMAINS, strict=True)])
    return table.select("*", named.alias("domain"), rate.alias("rate"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens, posteriors, likeliest domain and rate. Null and empty texts have no tokens; repeated rows give
    repeated results."""
    found = mix_to_targets(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels"))
    return found.drop("version")
