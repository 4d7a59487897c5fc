"""Exact duplicates, product codes and centroids against brute-force versions, with nulls, empty and very long texts,
ties, repeated rows, empty tables and further columns with clashing names."""

from __future__ import annotations

import functools
import hashlib
import math
import random
import re

import numpy as np
import pytest

from quietfield.llm import boxes, codes, exact, zones
from quietfield.llm.common import Scratch

RNG = np.random.default_rng(3)


# --- boxes

@pytest.mark.parametrize(("d", "bits"), [(2, 5), (3, 3), (4, 2), (1, 6)])
def test_curve_visits_every_cell_and_neighbours_follow_each_other(d, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * d, indexing="ij"), -1).reshape(-1, d)
    key = boxes.hilbert(cells, bits)
    assert sorted(key.tolist()) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[np.argsort(key)], axis=0)).sum(1) == 1).all()


@pytest.mark.parametrize("width", [1, 4, 64])
def test_shortlists_keep_the_nearest(width):
    for spread in (3, 40):  # few values: ties between entries and at the faces of boxes
        x = RNG.integers(-spread, spread + 1, (500, width))
        e = np.concatenate([RNG.integers(-spread, spread + 1, (15, width)), x[:1], x[:1]])
        x = x[np.argsort(boxes.hilbert(x[:, :8] + spread, 7), kind="stable")]
        members, counts, low, high, sums = boxes.flat(x, 8)
        may = boxes.shortlists(low, high, e)
        index, distance = boxes.nearest(members, may, e)
        d = ((x[:, None] - e[None]) ** 2).sum(2)
        assert (index.ravel()[:500] == d.argmin(1)).all() and (distance.ravel()[:500] == d.min(1)).all()
        total, count = boxes.gathered(members, counts, sums, low, high, e)
        assert (count == np.bincount(d.argmin(1), minlength=len(e))).all()
        assert all((total[k] == x[d.argmin(1) == k].sum(0)).all() for k in range(len(e)))
        assert width > 4 or spread < 40 or may.mean() < 0.4  # small boxes leave few


# --- 11

def texts():
    rng = random.Random(8)
    long = "".join(rng.choice("abcé日") for _ in range(4000))
    spaced = re.sub("(.{7})", "\\1 \t", long)
    same = "x" * 3000
    rows = [(1, "a b"), (2, "ab"), (3, " a\nb "), (4, None), (5, ""), (6, " \n\x0b\x0c\r\t"), (None, "ab"), (7, "ab"), (7, "ab"), (7, "other"), (8, long), (9, spaced), (10, long[:-1]), (11, long[1:]), (12, "a b"),
            (13, same), (14, same + "x"), (15, same[:-1]), (16, same), (17, "x" * 64), (18, "x" * 65), (19, "x" * 128), (20, "word " * 60_000)]
    return rows + [(100 + i, "copy of one " * 40) for i in range(300)] + [(1000 + i, f"text {i}") for i in range(200)]


def groups_by_hand(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    found = {}
    for k, (i, t) in enumerate(rows):
        found.setdefault(norm(t), []).append((-len(t or ""), i is None, i or 0, k))
    out = []
    for k, (i, t) in enumerate(rows):
        best = min(found[norm(t)])
        out.append((i, rows[best[3]][0], len(found[norm(t)]), best[3] == k, hashlib.sha256(norm(t).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize(("size", "large"), [(64, 2000), (64, 3), (1024, 2000)])
def test_exact_groups(spark, monkeypatch, size, large):
    monkeypatch.setattr(exact, "LARGE", large)
    rows = texts()
    docs = spark.createDataFrame([(i, t, 1, "n", 2) for i, t in rows], "doc_id long, text string, level int, name string, rid int").repartition(5)
    got = exact.groups(docs, Scratch(spark, "t11"), size=size)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == groups_by_hand(rows)
    assert exact.groups(docs.where("doc_id < 0"), Scratch(spark, "t11")).collect() == []


def test_identities_are_of_contents(spark):
    """Each frequent content has several places, and one name; no Python on the way."""
    rows = [(i, "ab" * 100 if i % 2 else f"{i % 7}" * 200) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    ids = exact.identities(docs, Scratch(spark, "t11"), size=16)
    assert "Python" not in ids._jdf.queryExecution().toString()
    found = {r.doc_id: (r.level, r.name) for r in ids.collect()}
    assert len(set(found.values())) == len({t for _, t in rows})
    assert all((found[i] == found[j]) == (rows[i][1] == rows[j][1]) for i in range(40) for j in range(40))


# --- 12 and 13

def vectors(spark, n=700, width=64, seed=4):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(6, width))
    x = (middle[rng.integers(0, 6, n)] + 0.4 * rng.normal(size=(n, width))).astype(np.float32)
    x[n // 2 : n // 2 + n // 3] = x[0]  # a third is one vector
    rows = [(i * 3, [float(v) for v in r], None if i % 11 == 0 else i % 4) for i, r in enumerate(x)]
    odd = [float(v) for v in x[1]]
    rows += [(5, None, 1), (7, [None, *odd[1:]], 1), (8, [math.nan, *odd[1:]], 2), (10, [*odd[:-1], math.inf], 2), (11, odd[:5], 3), (13, [], 3), (None, odd, None), (30, odd, 1), (30, odd, 1), (14, [-0.0] * width, 1)]
    return spark.createDataFrame([(*r, "c", 1) for r in rows], "vec_id long, embedding array<float>, label int, code string, error int").repartition(3), rows


def kept(rows, width):
    fine = [(i, v, y) for i, v, y in rows if v and len(v) == width and all(c is not None and math.isfinite(c) for c in v)]
    return fine


@pytest.mark.parametrize("chunk", [100, 1 << 14])
def test_codes(spark, monkeypatch, chunk):
    monkeypatch.setattr(codes, "CHUNK", chunk)
    table, rows = vectors(spark)
    rows = kept(rows, 64)
    q = np.array([[math.floor(256 * c) for c in v] for _, v, _ in rows], np.int64).reshape(-1, 16, 4)
    first = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, q[k].tolist()))[:64]
    books = q[first].transpose(1, 0, 2).copy()
    near = lambda: np.stack([((q[:, p, None] - books[None, p]) ** 2).sum(2) for p in range(16)], 1)
    for _ in range(2):
        k = near().argmin(2)
        for p in range(16):
            for e in range(64):
                if (k[:, p] == e).any():
                    books[p, e] = q[k[:, p] == e, p].sum(0) // (k[:, p] == e).sum()
    d = near()
    code, error = d.argmin(2), d.min(2).sum(1)
    got, found = codes.compressed(table, Scratch(spark, "t12"))
    assert (found == books).all()
    want = sorted((str(i), "".join(f"{c:02x}" for c in code[k]), int(error[k]), str(y)) for k, (i, _, y) in enumerate(rows))
    assert sorted((str(r.vec_id), r.code, r.error, str(r.label)) for r in got.collect()) == want


def test_codes_query(spark, tmp_path):
    table, rows = vectors(spark, 90)
    table.drop("code", "error").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = codes.op12_vector_codes(spark, str(tmp_path)).collect()
    labels = {}
    for i, _, y in kept(rows, 64):
        labels.setdefault(i, []).append(y)
    sums = {}
    for r in found:
        if len(set(labels[r.vec_id])) == 1:
            sums.setdefault(labels[r.vec_id][0], set()).add(r.label_error)
    assert all(len(s) == 1 for s in sums.values()) and len({r.codebooks_sha256 for r in found}) == 1
    assert sum(s.pop() for s in sums.values()) == sum(r.error for r in found)
    table.drop("code", "error").where("vec_id < 0").write.parquet(f"{tmp_path}/none/embeddings.parquet")
    assert codes.op12_vector_codes(spark, f"{tmp_path}/none").collect() == []
    assert zones.op13_centroids(spark, f"{tmp_path}/none").collect() == []


@pytest.mark.parametrize(("n", "size"), [(700, 16), (700, 256), (9, 256)])
def test_centroids(spark, tmp_path, monkeypatch, n, size):
    monkeypatch.setattr(zones, "clustered", functools.partial(zones.clustered, size=size))
    table, rows = vectors(spark, n)
    table.write.parquet(f"{tmp_path}/embeddings.parquet")
    rows = kept(rows, 64)
    q = np.array([[math.floor(64 * c) for c in v] for _, v, _ in rows], np.int64)
    lot = lambda k: (rows[k][0] is None, hashlib.sha256(f"1:{rows[k][0]}".encode()).hexdigest(), q[k].tolist())
    c = q[sorted(range(len(rows)), key=lot)[:16]].copy()
    near = lambda: ((q[:, None] - c[None]) ** 2).sum(2)
    for _ in range(3):
        k = near().argmin(1)
        for e in set(k.tolist()):
            c[e] = q[k == e].sum(0) // (k == e).sum()
    k, d = near().argmin(1), near().min(1)
    sums = np.bincount(k, d, minlength=16).astype(int)
    sha = [hashlib.sha256(",".join(map(str, e)).encode()).hexdigest() for e in c.tolist()]
    want = sorted((str(i), int(k[j]), int(d[j]), int(sums[k[j]]), int(d.sum()), sha[k[j]]) for j, (i, _, _) in enumerate(rows))
    got = zones.op13_centroids(spark, str(tmp_path)).collect()
    assert sorted((str(r.vec_id), *r[1:]) for r in got) == want


def test_components_too_large_are_an_error(spark):
    table = spark.createDataFrame([(1, [1e30] * 64, 1)], "vec_id long, embedding array<float>, label int")
    with pytest.raises(Exception, match="no exact distance"):
        zones.clustered(table, Scratch(spark, "t13"))
