"""Each operator against a brute-force version on small tables, with nulls, empty and very long texts, ties, repeated
rows, empty tables and extra columns."""

from __future__ import annotations

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quietfield.llm import ann, chat, decontaminate, graph, gru, kernel, langid, licenses, lmscore, mixing, near, pii, scans, substrings
from quietfield.llm.common import Scratch

RNG = random.Random(5)
WORDS = [f"{a}{b}" for a in "ba ko ti mu re zo".split() for b in "la ne shi po tu".split()]


def prose(n: int, rng: random.Random = RNG) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n))


def frame(spark, rows):
    """doc_id, text and columns whose names operators use themselves."""
    return spark.createDataFrame([(i, t, "x", 1.0) for i, t in rows], "doc_id long, text string, version string, score double")


ODD = [(None, "no id at all"), (90, None), (91, ""), (92, " \n\t "), (93, "word"), (94, "é" * 5000 + " " + "q" * 60_000)]


def empty(spark):
    return frame(spark, [(1, "a")]).where("doc_id < 0")


# --- kernels

def test_words_are_those_of_split():
    texts = ["", " a  b\tc ", "é ñ\x0b日本 x", "one", "\n", "a" * 3000]
    w = kernel.Words(kernel.whole(pa.array(texts)))
    assert w.count.tolist() == [len(t.encode().split()) for t in texts]
    flat = [x for t in texts for x in t.encode().split()]
    assert [bytes(w.data[a:b]) for a, b in zip(w.start, w.end, strict=True)] == flat
    h = w.hashes().tolist()
    assert all((flat[i] == flat[j]) == (h[i] == h[j]) for i in range(len(flat)) for j in range(len(flat)))


def test_window_hashes_meet_if_words_do():
    w = kernel.Words(kernel.whole(pa.array(["a b c a b c d a b"])))
    k = kernel.windows(w.hashes(), 3)
    assert k[0] == k[3] and len({int(x) for x in k}) == len(k) - 1


# --- 1

def test_near_duplicates(spark):
    base = prose(120).split()
    edit = lambda at: " ".join("zz" if i in at else x for i, x in enumerate(base))
    rows = [(10, " ".join(base)), (7, edit({3})), (12, edit({60})), (5, edit(set(range(0, 120, 6)))), (20, prose(100)), (21, "a b"), (22, "a  b"), (23, "c"), (20, rows_text := prose(90)), (30, rows_text), *ODD, (95, None)]
    got = {}
    for r in near.near_duplicates(frame(spark, rows)).collect():
        assert got.setdefault(r.doc_id, r.class_id) == r.class_id
    assert got[10] == got[7] == got[12] == 7
    assert got[5] == 5
    assert got[21] == got[22] == 21 and got[23] == 23
    assert got[20] == got[30] == 20  # rows of one id are one document
    assert all(got[i] == i for i in (90, 91, 92, 93, 94, 95)) and got[None] is None
    assert near.near_duplicates(empty(spark)).count() == 0


@pytest.mark.parametrize("tight", [False, True])
def test_large_group_against_all_pairs(spark, monkeypatch, tight):
    if tight:  # many blocks and tiles
        monkeypatch.setattr(near, "BLOCK", 16)
        monkeypatch.setattr(near, "LOAD", 600)
    rng = random.Random(1)
    base = prose(70, rng).split()
    texts = {i: " ".join(w if rng.random() > 0.01 * (i % 9) else prose(1, rng) for w in base) for i in range(150)}
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in texts:
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    got = {r.doc_id: r.class_id for r in near.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == {i: find(i) for i in texts}


def test_twins_among_many_that_share_a_passage(spark):
    """Twins are alike, and far from all others of the large buckets that they meet in."""
    rng = random.Random(4)
    shared, texts = prose(100, rng), {}
    for k in range(0, 600, 2):
        own = prose(38, rng).split()
        for i in (k, k + 1):
            texts[i] = " ".join([shared, *own])
            own = [*own[:18], "zz", *own[19:]]
            shared_words = shared.split()
            if i % 4 == 3:
                texts[i] = " ".join([*shared_words[:50], "yy", *shared_words[51:], *own])
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in texts.items()}
    assert all(len(sets[k] & sets[k + 1]) >= 0.8 * len(sets[k] | sets[k + 1]) for k in range(0, 600, 2))
    assert all(len(sets[0] & sets[k]) < 0.8 * len(sets[0] | sets[k]) for k in range(2, 600))
    got = {r.doc_id: r.class_id for r in near.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == {i: i - i % 2 for i in texts}


def test_repeated_lines_do_not_hide_links(spark):
    """One set of shingles, of very different counts: the estimate must be of what is verified."""
    rng = random.Random(6)
    line, rest = prose(30, rng), prose(20, rng)
    texts = [(i, f"{rest} " + " ".join([line] * n)) for i, n in enumerate((2, 200, 4, 400))]
    assert {r.class_id for r in near.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")).collect()} == {0}


def test_counts_do_not_part_alike_sets(spark):
    """120 words, and the same with the first 24 of them 400 times: sets of shingles with a similarity above 0.9."""
    texts = []
    for k in range(30):
        words = [f"w{k}x{i}" for i in range(120)]
        texts += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[:24] * 400 + words[24:]))]
    assert {(r.doc_id, r.class_id) for r in near.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")).collect()} == {(i, i - i % 2) for i in range(60)}


@pytest.mark.parametrize(("shared", "tail"), [(160, 16), (160, 27), (160, 32)])
def test_bands_of_texts_that_repeat_different_passages(shared, tail):
    """Two texts share two passages; one repeats the first 40 times, the other the second, and each has its own tail."""
    met = 0
    for k in range(300):
        a, b = ([f"{c}{k}x{i}" for i in range(shared)] for c in "ab")
        texts = [" ".join([*a * 40, *b, *[f"t{k}x{i}" for i in range(tail)]]), " ".join([*a, *b * 40, *[f"u{k}x{i}" for i in range(tail)]])]
        one, two = (set(x.tolist()) for x in (near.shingles(kernel.Words(kernel.whole(pa.array([t]))))[1] for t in texts))
        assert len(one & two) >= 0.8 * len(one | two)
        batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(texts)], ["doc_id", "text"])
        x, y = next(near.sign(iter([batch]))).column(5).to_pylist()
        met += any(p == q for p, q in zip(x, y, strict=True))
    assert met >= 297


def test_links_within_a_tile():
    rng = np.random.default_rng(2)
    base = rng.integers(1 << 60, size=60).astype(np.uint64)
    sets = [np.unique(np.where(rng.random(60) < 0.02 * (i % 7), rng.integers(1 << 60, size=60).astype(np.uint64), base)) for i in range(40)]
    comp = np.arange(40) // 2
    got = near.linked(np.arange(40), comp, sets, np.arange(40), np.arange(40), 0.8)
    forest = near.Forest(20)
    for i in range(40):
        for j in range(i):
            if near.similarity(sets[i], sets[j]) >= 0.8:
                forest.join(comp[i], comp[j])
    mine = near.Forest(20)
    assert all(near.similarity(sets[i], sets[j]) >= 0.8 and mine.join(comp[i], comp[j]) for i, j in got)
    assert mine.roots(np.arange(20)).tolist() == forest.roots(np.arange(20)).tolist()


def test_estimates_are_of_what_is_verified():
    """Texts of one set of shingles, of very different counts, have one signature."""
    rng = random.Random(6)
    line, rest = prose(30, rng), prose(20, rng)
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([f"{rest} " + " ".join([line] * n) for n in (2, 400)])], ["doc_id", "text"])
    one, two = next(near.sign(iter([batch]))).column(4).to_pylist()
    assert one == two


def test_signatures_estimate_probability_jaccard():
    rng = np.random.default_rng(0)
    va, vb = np.arange(1, 401, dtype=np.uint64), np.arange(101, 501, dtype=np.uint64)
    wa, wb = rng.integers(1, 5, 400).astype(float), rng.integers(1, 5, 400).astype(float)
    a, b = dict(zip(va.tolist(), wa, strict=True)), dict(zip(vb.tolist(), wb, strict=True))
    exact = sum(1 / sum(max(a.get(q, 0) / a[s], b.get(q, 0) / b[s]) for q in a.keys() | b.keys()) for s in a.keys() & b.keys())
    agree = []
    for k in range(12):
        x = near.prob_minhash(np.zeros(400, int), kernel.mix(va + np.uint64(1000 * k)), wa, 1)
        y = near.prob_minhash(np.zeros(400, int), kernel.mix(vb + np.uint64(1000 * k)), wb, 1)
        agree.append((x == y).mean())
    assert abs(np.mean(agree) - exact) < 0.04


def test_components(spark):
    edges = [(2, 1), (3, 2), (4, 3), (9, 8), (8, 9), (7, 7)] + [(100 + i, 100) for i in range(1, 50)]
    got = {r.v: r.comp for r in graph.components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t"), "c").collect()}
    assert {got[i] for i in (1, 2, 3, 4)} == {1} and got[9] == got[8] == 8 and got[149] == 100 and 7 not in got


# --- 2

def test_nearest(spark):
    """Against all products: ties, equal vectors, unusable ones, repeated ids and rows, vectors of other lengths."""
    rng = np.random.default_rng(1)
    x = rng.standard_normal((300, 8)).astype(np.float32)
    x[50:110] = x[50]
    odd = rng.standard_normal((30, 3)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(7, x[7].tolist()), (40, x[41].tolist()), (40, x[40].tolist())]
    rows += [(2000 + 10 * i, v.tolist()) for i, v in enumerate(odd)] + [(3000, [1.0] * 5)]
    rows += [(None, [3.0] * 8), (None, [-3.0] * 8), (None, x[60].tolist())]  # candidates, but no queries
    good = [(i, np.array(v, float)) for i, v in rows]
    rows += [(1000, None), (1020, [0.0] * 8), (1040, [float("nan")] + [1.0] * 7), (1060, [1.0, None] + [1.0] * 6), (1080, []), (None, None), (1100, [float("inf")] * 8)]
    t = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit("x")).withColumn("part", F.lit(1))
    got = ann.nearest(t, F.col("vec_id") % 20 == 0).collect()
    want, hits = [], 0
    for k, (i, v) in enumerate(good):
        if i is not None and i % 20 == 0:
            others = [(-s, 2**63 - 1 if j is None else j) for m, (j, w) in enumerate(good) if m != k and len(w) == len(v) for s in [products(v, w[None])[0]]]
            want += [(i, r + 1, None if j == 2**63 - 1 else j, -s) for r, (s, j) in enumerate(sorted(others)[:20])]
    mine = Counter(tuple(r) for r in got)
    assert len(got) == len(want) and mine == Counter(want)  # a small sample sends queries to all parts
    assert any(r.vec_id is None for r in got)
    assert ann.nearest(t.where("vec_id < 0"), F.lit(True)).count() == 0


def products(q, d):
    s = np.zeros(len(d))
    for j in range(d.shape[1]):
        s += q[j] * d[:, j]
    return s


def test_best_of_a_block_is_exact():
    rng = np.random.default_rng(3)
    d = rng.integers(-2, 3, (500, 6)).astype(float)  # many ties and equal vectors
    ids = np.sort(rng.choice(5000, 500, replace=False))
    row = np.random.default_rng(4).permutation(500)
    q, c, s = ann.best_of_block(row[::10], d[::10], row, ids, d, 20)
    q, c = ids[np.argsort(row)[q]], ids[c]
    for k in range(0, 500, 10):
        t = products(d[k], d)
        t[k] = -np.inf
        want = np.lexsort((ids, -t))[:20]
        assert c[q == ids[k]].tolist() == ids[want].tolist() and s[q == ids[k]].tolist() == t[want].tolist()


def test_router_recall():
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((16, 16)) * 3
    x = centres[rng.integers(16, size=3000)] + rng.standard_normal((3000, 16)) * 0.3
    router, probes = ann.fit(x, 8)
    home, order = router.order(x)[:, 0], router.order(x[:200])[:, :probes]
    true = ann.neighbours(x, 20)[:200]
    assert probes < 8 and (home[true][:, :, None] == order[:, None]).any(2).mean() >= 0.9


# --- 3

def test_chat_round_trip(spark):
    said = "<|im_end|><|im_start|>assistant ok"
    convs = {
        1: [(0, "user", "hi \\ <| \n"), (1, "assistant", "a\\|b<"), (2, "user", None), (3, "assistant", ""), (4, "user", "bye\n")],
        2: [(0, "user", said), (1, "assistant", said)],
        3: [(0, "system", "x")],
        4: [(0, "we\\ird\n\\l", "t" * 50_000), (1, "assistant", "\\l\\\\n|>"), (1, "assistant", "\\l\\\\n|>")],
        None: [(None, None, "q")],
    }
    rows = [(c, t, r, x, 0) for c, ts in convs.items() for t, r, x in ts]
    t = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, pos int")
    got = {r.conv_id: r for r in chat.digest(chat.examples(t)).collect()}
    for c, ts in convs.items():
        body = "".join(f"{r or ''}\n{x or ''}\n" for _, r, x in ts)
        loss = "".join(x or "" for _, r, x in ts if r == "assistant")
        assert got[c].n_turns == len(ts) and got[c].turns_sha256 == hashlib.sha256(body.encode()).hexdigest()
        assert got[c].loss_chars == len(loss) and got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    ex = chat.examples(t).where("conv_id = 1").orderBy("target").collect()
    assert sum(e.target is not None for e in ex) == 2 and all(e.text[e.loss_start : e.loss_end] == chat_escape(convs[1][e.target][2]) for e in ex if e.target is not None)
    assert chat.digest(chat.examples(t.where("turn > 99"))).count() == 0


def chat_escape(x):
    return (x or "").replace("\\", "\\\\").replace("<|", "<\\|")


# --- 4

@pytest.mark.parametrize(("group", "hot_from"), [(50_000, 1000), (3, 10**9), (50_000, 1)])
def test_substrings(spark, group, hot_from):
    passage, rng = prose(60, random.Random(3)), random.Random(4)
    rows = [(i, f"{prose(rng.randint(0, 40), rng)}  {passage if i % 3 else ''}\n{prose(25, rng)}") for i in range(40)] + [(50, passage + " " + passage), (51, "a " * 300), *ODD, (0, "an id that stands twice")]
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in substrings.remove_repeats(frame(spark, rows), 20, 2, group, hot_from).collect())
    key = lambda i: (1 << 63) - 1 if i is None else i
    first: dict = {}
    for i, t in rows:
        w = (t or "").encode().split()
        for s in range(len(w) - 19):
            k = tuple(w[s : s + 20])
            first[k] = min(first.get(k, (key(i), s)), (key(i), s))
    want = Counter()
    for i, t in rows:
        w = (t or "").encode().split()
        gone = {j for s in range(len(w) - 19) if first[tuple(w[s : s + 20])] != (key(i), s) for j in range(s, s + 20)}
        want[(i, len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone).decode())] += 1
    assert got == want
    assert substrings.remove_repeats(empty(spark)).count() == 0


# --- 5

def test_base_scores_and_model(spark):
    rows = [(i, prose(30)) for i in range(60)] + [(60, "ONLY é here"), (61, None), (62, ""), (63, "ONLY é here"), (63, "ONLY é here"), (None, "ba"), ((1 << 63) - 1, "ba")]
    docs = frame(spark, rows)
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2 if i is not None else False
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7, F.lit(0)) == 2
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = [(i, (t or "").translate(low).encode().split() + [None]) for i, t in rows]
    c = Counter(w for i, ws in tokens if not held(i) for w in ws)
    n, v = sum(c.values()), len(c)
    want = Counter((i, len(ws), sum(c[w] > 0 for w in ws), round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 6)) for i, ws in tokens)
    for frequent in (1 << 10, 3):  # with all counts broadcast, and with most of them joined
        language, counted = lmscore.learn(docs.where(~fold), Scratch(spark, "t"), share=1, frequent=frequent)
        found = lmscore.score(docs, language, counted).collect()
        assert Counter((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in found) == want
        assert language.n == n and all(-1e4 < r.score < 0 for r in found)


def test_every_training_document_is_learned_from(spark):
    """Whatever ids the training documents have, null among them, the model learns from them."""
    for rows in ([(None, prose(40))] * 3, [(7, prose(40))], [(12, prose(40))], [(i, prose(40)) for i in range(20, 23)]):
        language, _ = lmscore.learn(frame(spark, rows), Scratch(spark, "t"))
        fresh = gru.Model(np.ones(language.model.v), language.end)
        assert not np.array_equal(language.model.p["u"], fresh.p["u"])


def test_very_long_text_and_empty_table(spark):
    """A text of 200,000 tokens beside short ones takes memory in proportion to its tokens, and is read to its end."""
    sizes = np.array([200_001] + [40] * 511)
    groups = gru.alike(sizes)
    assert sorted(np.concatenate(groups).tolist()) == list(range(512))
    assert sum(gru.Lanes(np.zeros(sizes.sum(), np.int32), sizes, g).target.size for g in groups) <= 2 * sizes.sum()
    rows = [(i, prose(30)) for i in range(20)] + [(20, prose(200_000))]
    language, counted = lmscore.learn(frame(spark, rows), Scratch(spark, "t"), rounds=1)
    found = {r.doc_id: r for r in lmscore.score(frame(spark, rows), language, counted).collect()}
    assert found[20].n_tokens == 200_001 and -400_000 < found[20].score < -100_000
    language, counted = lmscore.learn(empty(spark), Scratch(spark, "t"))
    assert language.n == 0 and lmscore.score(empty(spark), language, counted).count() == 0
    assert lmscore.score(frame(spark, rows[:2]), language, counted).count() == 2


def test_weights_are_summed_in_levels(spark, monkeypatch):
    monkeypatch.setattr(lmscore, "SUMS", 3)
    rows = spark.range(20).repartition(20).selectExpr("id AS n", "array(double(id), 1D) AS w")
    total, n = lmscore._summed(rows)
    assert n == 190 and total.tolist() == [190.0, 20.0]


def test_model_learns_and_its_probabilities_add_up():
    rng = np.random.default_rng(0)
    sizes = np.full(200, 20)
    tokens = np.concatenate([np.append(np.tile([1, 2, 3], 7)[rng.integers(3) :][:19], 0) for _ in range(200)]).astype(np.int32)
    m = gru.Model(np.bincount(tokens, minlength=6).astype(float) + 1, 0)
    before = m.score(tokens, sizes).sum()
    for _ in range(20):
        m.train(tokens, sizes)
    assert m.score(tokens, sizes).sum() > 0.5 * before
    p = m.outputs(np.tile(rng.standard_normal((1, m.h)).astype(np.float32), (6, 1)), np.arange(6), False)[0]
    assert abs(np.exp(p).sum() - 1) < 1e-4


def test_gradients():
    m = gru.Model(np.array([5.0, 4, 3, 2, 1]), 0, hidden=3)
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    s, t = np.random.default_rng(1).standard_normal((4, 3)), np.array([0, 3, 1, 4])
    _, g = m.outputs(s, t, True)
    e = 1e-6
    for k in ("cw", "ow"):
        at = np.unravel_index(3, m.p[k].shape)
        m.p[k][at] += e
        up = m.outputs(s, t, False)[0].sum()
        m.p[k][at] -= 2 * e
        down = m.outputs(s, t, False)[0].sum()
        m.p[k][at] += e
        assert abs((up - down) / (2 * e) - g[k][at]) < 1e-5


def plain_score(m, tokens):
    """Log probability of one document, a token at a time in double precision."""
    p = {k: x.astype(float) for k, x in m.p.items()}
    sigmoid, h, state, before, total = (lambda x: 1 / (1 + np.exp(-x))), m.h, np.zeros(m.h), m.end, 0.0
    for token in tokens:
        x, y = p["e"][before] @ p["w"] + p["b"], state @ p["u"] + p["d"]
        z, r = sigmoid((x + y)[:h]), sigmoid((x + y)[h : 2 * h])
        state = state + z * (np.tanh(x[2 * h :] + r * y[2 * h :]) - state)
        c, j = divmod(token, m.s)
        a, b = state @ p["cw"] + p["cb"], state @ p["ow"][c] + p["ob"][c]
        total += a[c] - np.logaddexp.reduce(a) + b[j] - np.logaddexp.reduce(b)
        before = token
    return total


def some_model(scale=1.0):
    """Weights of outputs are times ``scale``."""
    rng = np.random.default_rng(3)
    m = gru.Model(np.arange(90.0, 0, -1), 4, hidden=8)
    m.p = {k: ((x + 0.5 * rng.standard_normal(x.shape)) * (scale if k in ("cw", "cb", "ow", "ob") else 1)).astype(np.float32) for k, x in m.p.items()}
    return m, rng


@pytest.mark.parametrize("scale", [1.0, 40.0])
def test_scores_of_documents_side_by_side(scale):
    """As of each alone, also where exponents need a shift; a long text adds its own steps only, not those of a group of its own."""
    m, rng = some_model(scale)
    sizes = rng.permutation(np.concatenate([[3000, 700], rng.integers(1, 90, 1200)]))
    tokens = rng.integers(0, 90, sizes.sum()).astype(np.int32)
    tokens[np.cumsum(sizes) - 1] = m.end
    steps, forward = [], m.forward
    m.forward = lambda table, before, *rest: steps.append(len(before)) or forward(table, before, *rest)
    got = m.score(tokens, sizes)
    want = [plain_score(m, tokens[hi - n : hi]) for n, hi in zip(sizes, np.cumsum(sizes), strict=True)]
    assert np.allclose(got, want, rtol=1e-5 * scale, atol=1e-3 * scale)
    assert sum(steps) == 3000
    lanes = gru.Lanes(tokens, sizes, np.argsort(-sizes), 64)
    assert lanes.target.size == sizes.sum() == sum(on.sum() for _, on, _, _ in lanes.windows())


@pytest.mark.parametrize("scale", [1.0, 40.0])
def test_gradients_of_outputs(scale):
    m, rng = some_model(scale)
    m.p = {k: x.astype(np.float64) for k, x in m.p.items()}
    states, target, e = rng.uniform(-1, 1, (30, 8)), rng.integers(0, 90, 30), 1e-6
    _, g = m.outputs(states, target, True)
    for k, x in [(k, m.p[k]) for k in ("cw", "cb", "ow", "ob")] + [("states", states)]:
        for i in np.argsort(-np.abs(g[k]).ravel())[:: max(1, x.size // 20)]:
            at = np.unravel_index(i, x.shape)
            value, sums = x[at], []
            for step in (e, -e):
                x[at] = value + step
                sums.append(m.outputs(states, target, False)[0].sum())
            x[at] = value
            assert abs((sums[0] - sums[1]) / (2 * e) - g[k][at]) < 1e-4 * max(1, scale), k


def test_gradients_through_time():
    m, rng = some_model()
    target, on, start = rng.integers(0, 90, (6, 5)).astype(np.int32), np.ones((6, 5), bool), np.zeros((6, 5), bool)
    start[0, :3] = start[3, 1] = True
    on[4:, 2] = False
    state, last = rng.uniform(-0.9, 0.9, (5, 8)).astype(np.float32), rng.integers(0, 90, 5).astype(np.int32)
    g, after = m.gradients(target, on, start, state, last)
    assert set(g) == set(m.p)

    def total():
        before = np.where(start, m.end, np.concatenate([last[None], target[:-1]]))
        states = m.forward(m.table(), before, start, state)[0]
        assert np.array_equal(states[-1], after) or moved
        return m.outputs(states[on], target[on], False)[0].sum()

    moved = False
    total()
    moved = True
    for k, x in m.p.items():
        for i in np.argsort(-np.abs(g[k]).ravel())[:: max(1, x.size // 12)][:12]:
            at, eps = np.unravel_index(i, x.shape), np.float32(1e-2)
            value, sums = x[at], []
            for step in (eps, -eps):
                x[at] = value + step
                sums.append(total())
            x[at] = value
            assert abs((sums[0] - sums[1]) / (2 * eps) - g[k][at]) < 5e-3 + 5e-3 * abs(g[k][at]), k


# --- 6

def test_licenses(spark):
    texts = ["Under the MIT License, under-the mit license", "Apache License, Version 2.0 and CC BY-NC 4.0", "cc by nc cc by nc", "under the mİt license K", "SPDX-License-Identifier: GPL-3.0", "the mit campus", None, "", "licensed under the gnu general public license version 3 " * 400]
    got = {r.doc_id: r for r in licenses.digest(licenses.scan(frame(spark, list(enumerate(texts))).withColumn("line", F.lit(1)))).collect()}
    for i, t in enumerate(texts):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        hits = [(k, label) for p, label in licenses.BASE.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        r, at = got[i], [k for k, _ in hits]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(hits), min(at, default=None), max(at, default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in hits})) and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
    assert "gpl-3" in got[4].labels and "gpl-3" in got[8].labels and got[5].labels == "" and got[6].score == 0
    assert licenses.digest(licenses.scan(empty(spark))).count() == 0


def sample_of(tree, most: bool) -> str:
    """A text that a parsed regular expression matches, with as few or as many of its optional parts as it can have."""
    out = ""
    for op, arg in tree:
        kind = str(op)
        if kind == "LITERAL":
            out += chr(arg)
        elif kind == "MAX_REPEAT":
            out += sample_of(arg[2], most) * arg[1 if most else 0]
        elif kind == "SUBPATTERN":
            out += sample_of(arg[3], most)
        elif kind == "BRANCH":
            out += sample_of(arg[1][-1 if most else 0], most)
        elif kind == "IN":
            out += chr(arg[0][1] if str(arg[0][0]) == "LITERAL" else arg[0][1][0])
        elif kind == "ANY":
            out += "x"
        else:
            assert kind == "ASSERT", kind
    return out


def test_license_rules_pass_their_gates(spark):
    rules = licenses.rules()
    for r in rules:
        for most in (False, True):
            line = sample_of(re._parser.parse(r.regex), most) + " "
            assert re.search(r.regex, line) and f" {r.keyword} " in line, (r, line)
    texts = {0: ("licensed under GPLv2", "gpl-2"), 1: ("GPLv3 license", "gpl-3"), 2: ("FreeBSD license", "bsd-2"), 3: ("PSF license", "python-2"), 4: ("licensed under zero clause BSD", "0bsd"), 5: ("licensed under the Apache License, version 2.0", "apache-2")}
    got = {r.doc_id: r.labels for r in licenses.digest(licenses.scan(frame(spark, [(i, t) for i, (t, _) in texts.items()]))).collect()}
    assert got == {i: label for i, (_, label) in texts.items()}
    assert len({r.regex for r in rules}) == len(rules) > 200


def detections(line: str, table) -> list[tuple]:
    """Matches of every rule, gate or not, less those suppressed, by the definition."""
    found = []
    for r in table:
        for m in re.finditer(r.regex, line):
            found.append((r.priority, line[: m.start()].count(" "), -line[: m.end()].count(" "), r.label))
    kept: list[tuple] = []
    for p, a, b, label in sorted(found):
        if not any((q < p and c < -b and a < -d) or (q == p and c <= a and -b <= -d) for q, c, d, _ in kept):
            kept.append((p, a, b, label))
    return sorted((a, -b, p, label) for p, a, b, label in kept)


def test_every_license_rule_against_its_definition(spark):
    """Texts that each rule matches, and mixtures of them, against all rules run without gates."""
    table, rng = licenses.rules(), random.Random(8)
    texts = [sample_of(re._parser.parse(r.regex), most) for r in table for most in (False, True)]
    texts += [" ".join(rng.choice(texts) if rng.random() < 0.5 else prose(3, rng) for _ in range(12)) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0])]
    found = licenses.scan(frame(spark, rows)).select("doc_id", "line", "detections").collect()
    assert len(found) == len(rows)
    for r in found:
        got = sorted((d.start, d.end, d.priority, d.label) for d in r.detections)
        assert got == detections(r.line, table), r.line


def test_many_matches_in_one_text(spark):
    """Time grows with the matches, not with their square."""
    took = []
    for n in (200, 2000, 16_000):
        docs = frame(spark, [(1, "under the mit license and apache license version 2 " * n)])
        began = time.time()
        r = licenses.scan(docs).select(F.size("detections").alias("found"), "base", "n_words").collect()[0]
        took.append(time.time() - began)
        assert [(b.label, b.n) for b in r.base] == [("mit", n), ("apache-2", n)] and r.found == 2 * n and r.n_words == 9 * n
    assert took[2] < 5 + 12 * took[1]


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 500, 5000])
def test_prefixes(spark, n):
    rng = random.Random(n)
    xs = [rng.randrange(-50, 50) for _ in range(n)]
    r = spark.createDataFrame([(xs,)], "v array<bigint>").select(scans.sums_before(F.col("v")).alias("s"), scans.most_before(F.col("v"), -99).alias("m")).collect()[0]
    assert r.s == [sum(xs[:k]) for k in range(n)] and r.m == [max([-99, *xs[:k]]) for k in range(n)]


# --- 7

def test_personal_data(spark):
    rows = [(i, f'said password={"%016x" % (0xA1B2C3D4E5F60718 + 977 * i)} and {prose(5)}') for i in range(8)]
    rows += [(20, 'é a.b@c.de x@y.z_q@e.f 1.2.3.4.5.6.7.8 256.1.1.1 card 4111 1111-1111 1111 +1 (988) 555-2485 password=horse-9-staple'), (21, "1" * 30_000 + "a" * 30_000 + "@"), (22, "1 " * 20_000), *ODD]
    docs = frame(spark, rows)
    contexts = pii.learn_contexts(docs)
    assert [tuple(r) for r in contexts.collect()] == [("password=", pii.KINDS.index("secret"))]
    found = pii.find(docs.withColumn("spans", F.lit(1)), contexts)
    got = {r.doc_id: r for r in pii.digest(found).collect()}
    assert (got[20].n_email, got[20].n_ip, got[20].n_card, got[20].n_phone) == (3, 2, 1, 1)
    text = rows[8][1]
    ends = [text[int(a) : int(b)] for k, a, b in (s.split(":") for s in got[20].spans.split(",")) if k == "secret"]
    assert ends == ["horse-9-staple"]
    clean = {r.doc_id: r.text for r in pii.redact(found).collect()}
    assert "horse" not in clean[20] and "[secret]" in clean[20] and clean[90] is None and clean[93] == "word"
    assert got[90].base_sha256 == hashlib.sha256(b"").hexdigest()
    none = pii.learn_contexts(empty(spark))
    assert none.count() == 0 and pii.digest(pii.find(empty(spark), none)).count() == 0


BASE_KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_of(text: str) -> list[str]:
    """kind:start:end of the fixed kinds, by the definition."""

    def good(kind, m):
        digits = re.sub("[^0-9]", "", m)
        if kind == "ip":
            return all(int(x) <= 255 for x in m.split("."))
        if kind == "card":
            total = sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(int(x) for x in reversed(digits)))
            return 14 <= len(digits) <= 19 and total % 10 == 0
        return kind == "email" or 10 <= len(digits) <= 15

    found = [(m.start(), i, m.end(), k) for i, (k, x) in enumerate(BASE_KINDS.items()) for m in re.finditer(x, text) if good(k, m.group())]
    return [f"{k}:{a}:{b}" for a, _, b, k in sorted(found)]


@pytest.mark.parametrize(("kind", "value", "unseen"), [
    ("email", lambda i: f"user{i}@mail{i}.example.com", "u77mailbox"), ("ip", lambda i: f"10.0.{i}.7", "10.0.x5.7"), ("phone", lambda i: f"+1415555{1000 + i}", "+1415x5551"),
    ("card", lambda i: next(n for n in (f"4{i:05d}00000000{c:02d}" for c in range(100)) if sum(int(d) if j % 2 == 0 else (2 * int(d) - 9 if int(d) > 4 else 2 * int(d)) for j, d in enumerate(reversed(n))) % 10 == 0), "4x00112233"),
])
def test_seeds_of_each_kind_teach_contexts(spark, kind, value, unseen):
    for before in (f"{kind}field=", f"their {kind}word "):
        rows = [(i, f"so {before}{value(i)} it was", "v", 1.0) for i in range(40)]
        docs = spark.createDataFrame([*rows, (99, f"so {before}{unseen} it was", "v", 1.0)], "doc_id long, text string, version string, score double")
        learned = pii.learn_contexts(docs)
        assert {pii.KINDS[r.kind] for r in learned.collect()} == {kind}, before
        found = {r.doc_id: r.spans for r in pii.digest(pii.find(docs, learned)).collect()}
        start = len(f"so {before}")
        assert f"{kind}:{start}:{start + len(unseen)}" in found[99].split(",")


def test_many_spans_in_one_text(spark):
    """Spans and their replacement in long texts, some of characters beyond two bytes; time grows with the spans."""
    took, none = [], spark.createDataFrame([], "context string, kind int")
    for n in (100, 1000, 20_000):
        text = "é𐍈 mail a.b@example.com or +1 (988) 555-2485 日 " * n
        began = time.time()
        r = pii.redact(pii.find(frame(spark, [(1, text)]), none)).select("text", "spans").collect()[0]
        took.append(time.time() - began)
        assert r.text == "é𐍈 mail [email] or [phone] 日 " * n and len(r.spans) == 2 * n
    assert took[2] < 5 + 24 * took[1]


def test_overlapping_spans_are_replaced_once(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice("abé𐍈 ") for _ in range(k)) for k in (0, 5, 300, 9000)]
    rows = []
    for i, t in enumerate(texts):
        spans = sorted((a, min(len(t), a + rng.randrange(40)), rng.randrange(4)) for a in (rng.randrange(len(t) + 1) for _ in range(i * 20)))
        rows.append((i, t, spans))
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans array<struct<start:bigint,end:bigint,kind:int>>")
    for r in pii.redact(docs).collect():
        out, at = "", 0
        for a, b, k in rows[r.doc_id][2]:
            out += f"{texts[r.doc_id][at:a]}[{pii.KINDS[k]}]" if a >= at else ""
            at = max(at, b)
        assert r.text == out + texts[r.doc_id][at:]


def test_fixed_kinds_against_their_definition(spark):
    rng = random.Random(21)
    bits = ["4111 1111 1111 1111", "4111-1111-1111-1112", "a.b@c.de", "x@y", "@", "1.2.3.4", "300.1.1.1", "1.2.3.4.5.6.7.8", "+1 (988) 555-2485", "+12", "é", "日本", "+44 20 7946 0958.", "12345678901234567890", "0", " ", ".", "-", "q@r.s.t@u.v"]
    texts = ["".join(rng.choice(bits) + rng.choice(["", " ", "  ", ","]) for _ in range(rng.randint(1, 14))) for _ in range(400)]
    rows = [(i + 1000, t) for i, t in enumerate(texts)] + [(1000, texts[0]), *ODD]
    none = pii.learn_contexts(empty(spark))
    got = pii.digest(pii.find(frame(spark, rows), none)).collect()
    text_of = dict(rows)
    assert len(got) == len(rows)
    for r in got:
        want = base_of(text_of[r.doc_id] or "")
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), text_of[r.doc_id]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w.startswith(k) for w in want) for k in BASE_KINDS]


@pytest.mark.parametrize("most", [4096, 0])
def test_patterns_of_words_and_long_values(spark, monkeypatch, most):
    """Two words before seeds mark values that are no seeds; values go to their end; contexts in the plan or joined."""
    monkeypatch.setattr(pii, "MOST", most)
    rng = random.Random(4)
    rows = [(i, f"{prose(4, rng)} account number 41{'%012d' % (i * 7919)} {prose(3, rng)}") for i in range(200)]
    luhn = [(i, t) for i, t in rows if base_of(t)]
    assert len(luhn) >= 3
    key = "".join(rng.choice("0123456789abcdef") for _ in range(300))
    docs = frame(spark, [*luhn, (900, f"{prose(3, rng)} account number ZX-55-81q thanks"), (901, "the number 12345678"), *((i + 1000, f"token = '{'%032x' % rng.getrandbits(128)}'") for i in range(5)), (902, f'token = "{key}"'), (903, "token = eyJhbGci.eyJzdWIi1" + "Aa.-_" * 60 + "z"), (902, f'token = "{key}"'), (None, "account number 77-abc")])
    contexts = pii.learn_contexts(docs)
    assert {(r.context, pii.KINDS[r.kind]) for r in contexts.collect()} == {("account number ", "card"), ("token='", "secret")} | ({("token=\"", "secret")} & set())
    found = pii.find(docs, contexts)
    got = {r.doc_id: r.spans for r in pii.digest(found).collect()}
    text = {r.doc_id: r.text for r in docs.collect()}
    cut = lambda i: [text[i][int(a) : int(b)] for _, a, b in (x.split(":") for x in got[i].split(",") if x)]
    assert cut(900) == ["ZX-55-81q"] and cut(901) == [] and cut(None) == ["77-abc"]
    assert all(cut(i + 1000) == [text[i + 1000][9:-1]] for i in range(5))
    assert found.count() == docs.count()


# --- 8

def test_decontamination(spark):
    rng = random.Random(8)
    items = [(k, prose(rng.randint(18, 59), rng) + ". " + prose(8, rng) + ".") for k in range(12)]
    # Words of their own, as texts from thirty words would share too much.
    own = lambda t, k: " ".join(w + chr(97 + (k + j) % 26) + chr(97 + (j * 7) % 26) for j, w in enumerate(t.split()))
    items = [(k, own(t, k)) for k, t in items] + [(50, None), (51, "")]
    rows = [(k, f"{own(prose(200, rng), 3 * k)} {t.upper() if k % 2 else t} {own(prose(150, rng), 5 * k)}") for k, t in items if t]
    part = items[0][1].split()
    rows += [(30, own(prose(300, rng), 11)), (31, " ".join(part[: len(part) // 4]) + " " + own(prose(80, rng), 2)), (32, " ".join(w for i, w in enumerate(items[1][1].split()) if i % 7)), *ODD]
    docs, table = frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, table).collect()}
    assert got == {(k, k) for k, t in items if t} | {(32, 1)}
    assert decontaminate.contaminated(empty(spark), table).count() == 0 and decontaminate.contaminated(docs, table.where("item_id < 0")).count() == 0


def test_items_of_common_words_and_short_items_are_found(spark):
    """Items copied word for word, where every word is common or the item has few of them; items whose words are changed."""
    rng = random.Random(12)
    few = "na to mi re so la".split()
    item = " ".join(rng.choice(few) for _ in range(30))
    rows = [(i, " ".join(rng.choice(few) for _ in range(128))) for i in range(60)] + [(60, " ".join(rng.choice(few) for _ in range(64)) + f" {item} " + " ".join(rng.choice(few) for _ in range(64)))]
    found = decontaminate.contaminated(frame(spark, rows), spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert 60 in {r.doc_id for r in found.collect()}
    words = [f"{a}{b}{c}" for a in WORDS for b in "xyz" for c in "pqr"]
    fresh = lambda n: [rng.choice(words) for _ in range(n)]
    items = {k: fresh([1, 3, 6, 9][k % 4]) for k in range(12)} | {k: fresh(40) for k in range(12, 24)}
    rows = [(k, " ".join(fresh(60) + w + fresh(60))) for k, w in items.items() if k < 12]
    for k in range(12, 24):  # 45 of 100 words are others; the answer (the last third) stays
        w = items[k]
        cut = 2 * len(w) // 3
        changed = [x if rng.random() > 0.65 else rng.choice(words) for x in w[:cut]] + w[cut:]
        rows.append((k, " ".join(fresh(50) + changed + fresh(80))))
    rows += [(100 + k, " ".join(fresh(150))) for k in range(60)] + [(12, rows[12][1])]
    table = spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()], "item_id long, text string").withColumn("lcs", F.lit("x"))
    got = decontaminate.contaminated(frame(spark, rows).withColumn("item_id", F.lit(1)), table).collect()
    pairs = {(r.doc_id, r.item_id) for r in got if r.doc_id < 100}
    assert {(k, k) for k in range(12)} <= pairs
    alike = {}
    for k in range(12, 24):
        near = rows[k][1].split()[50:90]
        n = decontaminate.common_subsequence(items[k], near) / 40
        alike[k] = n >= 0.5
    assert sum((k, k) in pairs for k, ok in alike.items() if ok) >= 0.9 * sum(alike.values()) and sum(alike.values()) >= 6
    assert not {r.item_id for r in got if r.doc_id >= 100} & set(range(12, 24))
    assert sum((r.doc_id, r.item_id) == (12, 12) for r in got) in (0, 2)  # a repeated row gives repeated results


def texts_and_items():
    """Texts of few words, with empty and very short ones, and items of each length that share words with them."""
    rng = random.Random(21)
    words = [a + b for a in WORDS for b in "xy"]
    fresh = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(k, fresh(n)) for k, n in enumerate([3000, 0, 1, 3, 4, 5, 15, 16, 17, 63, 64, 65, 1, 700, 130])] + [(90, None)]
    return rows, [(k, fresh(rng.choice([2, 9, 16, 30, 47, 64, 150]))) for k in range(120)]


def test_windows_are_held_against_all_items_at_once(spark, monkeypatch):
    """Python steps for each item and piece of text were most of the search's time."""
    rows, items = texts_and_items()
    docs = frame(spark, rows)
    idf = decontaminate.inverse_frequencies(docs)
    latent = decontaminate.latent_space(docs, idf)
    items = decontaminate.Items(items, latent, idf)
    kept, calls, real = [], [], decontaminate.in_common
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, schema: kept.append(run))
    decontaminate.search(docs, items, latent)
    monkeypatch.setattr(decontaminate, "in_common", lambda *a: calls.append(len(a[0])) or real(*a))
    ids, texts = zip(*rows, strict=True)
    list(kept[0](iter([pa.RecordBatch.from_arrays([pa.array(ids), pa.array(texts)], ["doc_id", "text"])])))
    assert 0 < len(calls) <= sum(-(-sum(calls) // decontaminate.ROWS) for _ in items.parts)


def test_near_windows_against_plain_loops(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "ROWS", 100)
    rows, items = texts_and_items()
    docs = frame(spark, rows)
    idf = decontaminate.inverse_frequencies(docs)
    latent = decontaminate.latent_space(docs, idf)
    items = decontaminate.Items(items, latent, idf)
    words = kernel.Words(kernel.whole(pa.array([t for _, t in rows], pa.string())), kernel.PUNCTUATION)
    _, f = decontaminate.features(words)
    blank = decontaminate.with_blank(latent)
    sums, fours, _ = decontaminate._fours(words, f, blank)
    total = 0
    for size, (owner, shift, direction, table) in items.parts.items():
        have = decontaminate.with_blank(np.ascontiguousarray(table.T > 0).view(np.int8))
        got = set(zip(*(x.tolist() for x in decontaminate._near(words, f, sums, fours, size, items.parts[size], have)), strict=True))
        sure, maybe = set(), set()
        for d in range(len(rows)):
            a, b = int(words.first[d]), int(words.first[d + 1])
            for lo in range(a, max(b - size, a) + size // 4, size // 4) if b > a else ():
                window = f[lo : min(lo + size, b)]
                v = latent[window].sum(0, dtype=float)
                count = np.bincount(window, minlength=decontaminate.FEATURES)
                for p in range(len(owner)):
                    enough = np.minimum(count, table[p]).sum() >= decontaminate.SHARED * min(table[p].sum(dtype=int), size)
                    near = direction[p] @ v / max(np.linalg.norm(v), 1e-12) - decontaminate.NEAR
                    if enough and near > -1e-5:
                        (sure if near > 1e-5 else maybe).add((lo, d, p))
        assert sure <= got <= sure | maybe
        total += len(sure)
    assert total > 100


def test_common_subsequence():
    rng = random.Random(2)
    for _ in range(50):
        a, b = ([rng.randint(0, 5) for _ in range(rng.randint(1, 20))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert decontaminate.common_subsequence(a, b) == t[-1][-1]


# --- 9

def test_mixing(spark):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(300):
        kind = i % 3
        rows.append((i, prose(40, rng) + [" fine", " junk!! junk!!", " vile vile"][kind]))
        if i % 2 == 0:
            labels.append((i, 1 if kind != 1 else 0, int(kind == 2)))
    docs = frame(spark, [*rows, *ODD])
    table = spark.createDataFrame([*labels, (None, 1, 0), (1, None, None)], "doc_id long, quality int, toxic int")
    got = mixing.mix_to_targets(docs, table, (0.6, 0.4, 0.0)).collect()
    assert len(got) == len(rows) + len(ODD) and all(r.rate >= 0 for r in got)
    right = [r.domain == mixing.DOMAINS[r.doc_id % 3] for r in got if r.doc_id is not None and r.doc_id < 300]
    assert sum(right) >= 0.95 * len(right)
    total = sum(r.tokens for r in got)
    share = [sum(r.rate * r.tokens * r[f"p_{d}"] for r in got) / total for d in mixing.DOMAINS]
    assert abs(share[0] - 0.6) < 0.02 and abs(share[1] - 0.4) < 0.02 and share[2] < 0.02
    assert mixing.mix_to_targets(empty(spark), table).count() == 0
    assert all(r.rate >= 0 for r in mixing.mix_to_targets(docs, table.where("doc_id < 0")).collect())


def test_rates_against_a_solver(spark):
    """Squared distance to the targets as small as an exact solver's, ties and repeated rows among the documents."""
    rng = np.random.default_rng(3)
    for targets, sharp in (((0.75, 0.25, 0.0), 6.0), ((0.1, 0.2, 0.7), 2.0), ((0.5, 0.5, 0.0), 0.5)):
        a = np.exp(sharp * rng.standard_normal((80, 3)))
        a[40:60] = a[0]
        post, tokens = a / a.sum(1, keepdims=True), rng.integers(0, 200, 80)
        tokens[40:60] = tokens[0]
        rows = [(i, i, int(t), *map(float, q)) for i, (t, q) in enumerate(zip(tokens, post, strict=True))]
        table = spark.createDataFrame(rows, "doc_id long, version long, tokens long, " + ", ".join(f"p_{d} double" for d in mixing.DOMAINS))
        rate, reached = mixing.rates(table, targets)
        got = np.array([r.rate for r in table.select("doc_id", rate.alias("rate")).orderBy("doc_id").collect()])
        w = tokens / tokens.sum()
        assert (got >= 0).all() and np.allclose((w * got) @ post, reached, atol=1e-9)
        r, step = np.ones(80), 1 / np.linalg.eigvalsh((post * w[:, None]).T @ post)[-1]
        for _ in range(40_000):
            r = np.maximum(0, r - step * post @ ((w * r) @ post - targets))
        value = lambda x: float(((((w * x) @ post) - targets) ** 2).sum())
        assert value(got) <= 1.1 * value(r) + 1e-6, (targets, value(got), value(r))


def test_held_out_accuracy_of_domains(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    train, test = (labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 0 if k else F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 0) for k in (0, 1))
    model = mixing.fit(docs, train)
    found = mixing.posteriors(docs, model).join(test.select("doc_id", mixing.domain(F.col("quality"), F.col("toxic")).alias("label")).where("label is not null"), "doc_id").collect()
    right = [max(range(3), key=lambda k: r[f"p_{mixing.DOMAINS[k]}"]) == r.label for r in found]
    assert len(right) > 50 and sum(right) >= 0.9 * len(right), (sum(right), len(right))


# --- 10

def greedy(hay: bytes, s: bytes) -> int:
    """Phrases by the definition: the longest piece that stands in the language's text, again and again."""
    n = at = 0
    while at < len(s):
        k = 1
        while at + k < len(s) and s[at : at + k + 1] in hay:
            k += 1
        at, n = at + k, n + 1
    return n


SAMPLE = {"aa": "the cat sat on the mat and ate " * 3, "bb": "der hund lag auf der matte und schlief " * 3}


def parsed(x: str) -> bytes:
    return langid.normal(kernel.whole(pa.array([x])))[0].tobytes()


def test_marks_alone_are_no_letters():
    model = langid.Automata({"de": "das ist gut e\u0301 so", "en": "this is good"})
    lang, score = model.predict(kernel.whole(pa.array(["\u0301" * 3, "\u0301", "\U0001e8d0\U0001e8d1", "e\u0301", "12 \u0301 ?"])))
    assert [x == langid.UND for x in lang] == [True, True, True, False, True] and score[:3].tolist() == [0, 0, 0]


def test_cross_parsing_is_greedy():
    """Over whole texts, those of many segments included, and a language's own text, which is one phrase."""
    rng = random.Random(3)
    sample = SAMPLE | {"cc": prose(1500, rng), "dd": "一二三四五六七八九十" * 20 + "ab" * 400}
    model = langid.Automata(sample)
    own = sample["cc"]
    texts = ["the dog lay", "und die katze", "x1y2z3", "é", "matte", "", "12", own, own[700:6000] + " " + own[:900], prose(900, rng), "ab" * 2000 + "一二三" * 300, "the mat " * 700, "ქართული ენა " * 100]
    data, at, _ = langid.normal(kernel.whole(pa.array(texts)))
    n = model.phrases(data, at)
    for i, t in enumerate(texts):
        assert n[i].tolist() == [greedy(parsed(sample[lang]), parsed(t)) for lang in model.languages], t[:40]
    assert n[7][model.languages.index("cc")] == 1


def test_scripts_keep_their_letters(spark):
    """Languages of many scripts, and one language more than sixty-four labels, are told apart on held-out texts."""
    rng = random.Random(14)
    scripts = {"la": (0x61, 26), "ru": (0x430, 32), "el": (0x3B1, 25), "ka": (0x10D0, 33), "th": (0xE01, 46), "zh": (0x4E00, 800), "ko": (0xAC00, 800)}
    lexicon = {k: ["".join(chr(a + rng.randrange(n)) for _ in range(rng.randint(1, 6))) for _ in range(150)] for k, (a, n) in scripts.items()}
    lexicon |= {f"x{k}": [w[::-1] + "z" for w in prose(1, rng).split() * 3] + ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(30)] for k in range(64)}
    make = lambda lang: " ".join(rng.choice(lexicon[lang]) for _ in range(40))
    rows = [(i * 100 + j, make(lang), lang) for i, lang in enumerate(lexicon) for j in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs.where("doc_id % 2 = 0"))
    assert len(model.languages) == len(lexicon) > 64
    held = langid.identify(docs.where("doc_id % 2 = 1"), model).collect()
    assert sum(r.lang_pred == r.lang for r in held) >= 0.97 * len(held)
    assert all(r.lang_pred == r.lang for r in held if r.lang in scripts)


def test_language_id(spark):
    rows = [(1, "the cat ate", "aa"), (2, "der hund schlief", "bb"), (3, None, "aa"), (4, "12 !?", "bb"), (5, "", None), (6, "the mat " * 3000, None), (7, "日本語", None), (None, "auf der matte", None)]
    rows += [(100 + i, t, lang) for lang, t in SAMPLE.items() for i in range(ord(lang[0]), ord(lang[0]) + 1)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, lang_pred string")
    model = langid.fit(docs.where("doc_id >= 100"))
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(docs, model).collect()}
    assert [got[i][0] for i in (1, 2, 3, 4, 5, 6, None)] == ["aa", "bb", "und", "und", "und", "aa", "bb"]
    assert all(0 <= s <= 1 for _, s in got.values()) and got[7][0] in SAMPLE
    assert langid.identify(docs.unionAll(docs), model).count() == 2 * len(rows)  # repeated rows
    assert langid.identify(docs.where("doc_id < 0"), langid.fit(docs.where("doc_id < 0"))).count() == 0
