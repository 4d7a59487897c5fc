"""Repair with carried state against the repair of the whole signal, and its directions by another route."""

from __future__ import annotations

import numpy as np
import pytest

from quietfield.functions import kernels as K
from quietfield.functions import linalg as L
from quietfield.operators import asr
from quietfield.streaming import repair, streams

RATE = 50.0


def recording(n, c=4, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(c, c)) @ rng.normal(size=(c, n))
    for lo in range(60, n, 170):
        x[:, lo : lo + 25] += 12 * rng.normal(size=(c, 1)) * np.sin(np.arange(min(25, n - lo)))
    return x


def model(c=4, filtered=True, scale=2.0):
    rng = np.random.default_rng(9)
    mixing = rng.normal(size=(c, c))
    mixing = mixing @ mixing.T + np.eye(c)
    u = np.linalg.eigh(mixing)[1]
    b, a = K.shaping_filter(RATE) if filtered else (np.array([1.0]), np.array([1.0]))
    return asr.State([f"c{i}" for i in range(c)], mixing, scale * np.linspace(2, 4, c)[:, None] * u.T, b, a)


def long(spark, x):
    return spark.createDataFrame([(f"c{i}", t, float(v)) for i, r in enumerate(x) for t, v in enumerate(r)], "channel string, t long, x double")


def wide(df, shape):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[int(r.channel[1:]), r.t] = r.x
    return out


def in_chunks(repairer, x, cuts):
    carry, parts, lo = repairer.start(0), [], 0
    for hi in [*cuts, x.shape[1]]:
        carry, first, y = repairer.feed(carry, x[:, lo:hi], hi == x.shape[1])
        carry = repair.Carry.of(carry.row(), len(x))  # as the state store keeps it
        assert first == sum(p.shape[1] for p in parts)
        assert max(carry.raw.shape[1], carry.stats.shape[1]) <= hi - lo + 2 * repairer.size + repairer.step + repairer.ahead
        parts, lo = [*parts, y], hi
    return np.concatenate(parts, 1)


@pytest.mark.parametrize("filtered", [True, False])
@pytest.mark.parametrize(("n", "step"), [(500, None), (500, 7), (501, 12), (30, None), (9, None)])
def test_any_split_gives_the_whole(spark, filtered, n, step):
    x, state = recording(n), model(filtered=filtered)
    want = wide(asr.process(long(spark, x), state, RATE, n, 0.5, step, chunk=1 << 15), x.shape)
    repairer = repair.Repairer.of(state, RATE, 0.5, step)
    rng = np.random.default_rng(n)
    splits = [[], list(range(1, n)), [1], [n - 1], list(range(13, n, 13)), *[sorted(rng.choice(np.arange(1, n), size=min(k, n - 1), replace=False).tolist()) for k in (2, 3, 9, 40)]]
    for cuts in splits:
        assert np.abs(in_chunks(repairer, x, cuts) - want).max() < 1e-7 * np.abs(x).max()
    assert n < 100 or np.abs(want - x).max() > 1


def test_chunks_as_tasks_give_the_whole_too(spark):
    x, state = recording(700), model()
    want = in_chunks(repair.Repairer.of(state, RATE), x, [])
    assert np.abs(wide(asr.process(long(spark, x), state, RATE, 700, chunk=100), x.shape) - want).max() < 1e-7 * np.abs(x).max()


def test_streams_of_recordings(spark):
    x, state = recording(400), model()
    want = in_chunks(repair.Repairer.of(state, RATE), x, [])
    got = wide(streams.repair(spark, long(spark, x), state, RATE, parts=4), x.shape)
    assert np.abs(got - want).max() < 1e-7 * np.abs(x).max()


def test_a_recording_that_ended_begins_anew(spark, tmp_path):
    """Two recordings of one name after each other, times going on, and another one between; then a gap."""
    state, repairer = model(filtered=False), repair.Repairer.of(model(filtered=False), RATE)
    a, b, c = recording(120, seed=2), recording(90, seed=3), recording(100, seed=4)
    rows = [("one", t, a[:, t].tolist(), t == 119) for t in range(120)] + [("one", 120 + t, b[:, t].tolist(), t == 89) for t in range(90)]
    rows += [("two", 7 + t, c[:, t].tolist(), t == 99) for t in range(100)]
    schema = "rec string, t long, xs array<double>, last boolean"
    for k in range(3):
        spark.createDataFrame([r for r in rows if r[1] * 3 // 210 == k], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def run(name):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        going = repair.repaired(stream, repairer).writeStream.format("parquet").option("path", f"{tmp_path}/{name}").option("checkpointLocation", f"{tmp_path}/{name}-state").trigger(availableNow=True).start()
        going.awaitTermination()
        return {(r.rec, r.t): r.xs for r in spark.read.parquet(f"{tmp_path}/{name}").collect()}

    got = run("out")
    assert len(got) == 310 and state.channels == repairer.state.channels
    for rec, at, x in (("one", 0, a), ("one", 120, b), ("two", 7, c)):
        want = in_chunks(repairer, x, [])
        assert np.allclose([got[rec, at + t] for t in range(x.shape[1])], want.T, atol=1e-7)
    spark.createDataFrame([("two", 5000, [0.0] * 4, False), ("two", 5002, [0.0] * 4, False)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    with pytest.raises(Exception, match="don't follow each other"):
        run("again")


def test_nonlinear_eigenspaces_by_another_route():
    rng = np.random.default_rng(0)
    stack = np.stack([(m := rng.normal(size=(5, 5))) @ m.T + 0.1 * np.eye(5) for _ in range(20)])
    v, u = L.riemannian_eigenspace(stack, 0.7)
    for c, values, turns in zip(stack, v, u, strict=True):
        want = c + 0.7 * np.diag(np.linalg.solve(c, np.ones(5)))
        assert np.allclose(turns @ np.diag(values) @ turns.T, want) and np.allclose(turns.T @ turns, np.eye(5)) and (np.diff(values) >= 0).all()
        one = L.riemannian_eigenspace(c, 0.7)
        assert np.allclose(one[0], values)
    assert np.allclose(L.riemannian_eigenspace(stack, 0.0)[0], np.linalg.eigvalsh(stack))


def test_windowed_nonlinear_repair(spark):
    n = 300
    x, state = recording(n), model(filtered=False)
    sig = long(spark, x)
    plain = wide(asr.process(sig, state, RATE, n), x.shape)
    assert np.abs(wide(asr.process(sig, state, RATE, n, alpha=0.0), x.shape) - plain).max() < 1e-6 * np.abs(x).max()
    got = wide(asr.process(sig, state, RATE, n, alpha=5.0), x.shape)
    # by another route: each window's covariance by sums over its samples, directions by a generalised problem
    size, ahead = 25, 13
    step = size // 2
    padded = np.concatenate([2 * x[:, :1] - x[:, ahead:0:-1], x, 2 * x[:, -1:] - x[:, -2 : -ahead - 2 : -1]], 1)
    out, last, done = np.empty_like(x), None, -step
    for m in [-step, *range(step, n + step + 1, step)]:
        end = min(m + ahead, n - 1 + ahead) + ahead + 1
        cov = sum(np.outer(v, v) for v in padded[:, max(end - size, 0) : end].T) / size
        values, turns = np.linalg.eig(cov + 5.0 * np.diag(np.linalg.inv(cov) @ np.ones(4)))
        order = np.argsort(values)
        values, turns = values[order].real, turns[:, order].real
        turns /= np.linalg.norm(turns, axis=0)
        keep = np.array([values[k] < np.linalg.norm(state.thresholds @ turns[:, k]) ** 2 or k < 4 - 3 for k in range(4)])
        r = np.eye(4) if keep.all() else state.mixing @ np.linalg.pinv(np.diag(keep * 1.0) @ turns.T @ state.mixing) @ turns.T
        for t in range(max(done, 0), min(m, n)):
            w = (1 - np.cos(np.pi * (t - done + 1) / (m - done))) / 2
            out[:, t] = w * (r @ x[:, t]) + (1 - w) * (last @ x[:, t])
        last, done = r, m
    assert np.abs(got - out).max() < 1e-6 * np.abs(x).max() and np.abs(got - plain).max() > 1e-3


def test_accelerated_median_is_the_median(spark):
    rng = np.random.default_rng(5)
    mats = np.stack([(m := rng.normal(size=(4, 4)) * rng.lognormal(0, 1)) @ m.T for _ in range(60)])
    calls = []

    def step(now):
        calls.append(1)
        w = 1 / np.maximum(np.linalg.norm(mats - now, axis=(1, 2)), 1e-12)
        return (w[:, None, None] * mats).sum(0) / w.sum()

    got = asr.accelerated(step, mats.mean(0), 128, 1e-9)
    pull = sum((got - m) / np.linalg.norm(got - m) for m in mats)
    assert np.linalg.norm(pull) < 1e-6 and len(calls) < 30
