"""Artifact subspace reconstruction: thresholds from clean stretches, then a sliding repair of what exceeds them."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quietfield.functions import kernels as K
from quietfield.functions import linalg as L
from quietfield.operators import windows
from quietfield.operators.filters import Cascade, forward
from quietfield.operators.moments import block_covariances
from quietfield.plans.model import by_window
from quietfield.plans.tables import kept as kept_table
from quietfield.sources.signals import by_sample, channels_of, long_from_samples


def half_up(x: float) -> int:
    return int(np.floor(x + 0.5))


@dataclass
class State:
    """A calibrated model: mixing, threshold operator, the filter of its statistics."""

    channels: list[str]
    mixing: np.ndarray
    thresholds: np.ndarray  # rows: threshold times component
    b: np.ndarray = field(default_factory=lambda: np.array([1.0]))
    a: np.ndarray = field(default_factory=lambda: np.array([1.0]))
    bounds: np.ndarray | None = None


def clean_windows(signal: DataFrame, rate: float, n: int, length: float = 1.0, overlap: float = 0.66, most_bad: float = 0.075, z: tuple[float, float] = (-3.5, 5.5)) -> tuple[DataFrame, list[int]]:
    """(start, rejected, worst) of each window, and the starts that stay: at most a share of channels may have an
    amplitude out of the robust range of theirs. If none stays, the least bad does."""
    size = half_up(length * rate)
    starts = windows.fractional_starts(n, size, overlap)
    rms = windows.window_rms(signal, starts, size)

    def run(f: pd.DataFrame) -> pd.DataFrame:
        mu, sigma = K.fit_rms(f["rms"].to_numpy())
        f["z"] = (f["rms"] - mu) / (sigma if sigma > 0 else 1.0)
        return f[["channel", "start", "z"]]

    scores = rms.groupBy("channel").applyInPandas(run, "channel string, start long, z double")
    names = channels_of(signal)
    tolerated = min(half_up(most_bad * len(names)) if most_bad < 1 else int(most_bad), len(names) - 1)
    ranked = scores.groupBy("start").agg(F.sort_array(F.collect_list("z"), asc=False).alias("z"))
    high, low = F.col("z")[tolerated], F.element_at("z", -1 - tolerated)
    table = ranked.select("start", ((high > z[1]) | (low < z[0])).alias("rejected"), high.alias("worst"))
    rows = table.collect()  # one row a window
    kept = sorted(r.start for r in rows if not r.rejected) or [min(rows, key=lambda r: (r.worst, r.start)).start]
    return table, kept


def calibrate(signal: DataFrame, rate: float, n: int, cutoff: float = 20.0, length: float = 0.5, overlap: float = 0.66, block: int = 10, filtered: bool = True, select_clean: bool = True, reference: DataFrame | None = None, mean: str = "median") -> State:
    """Mixing: root of the geometric median of block covariances of clean, filtered data. Thresholds: mean plus ``cutoff``
    deviations of each component's amplitude. With a ``reference`` (t, kept), its samples are the clean data. ``mean`` is
    "median" or "karcher", the affine-invariant mean."""
    names = channels_of(signal)
    kept = signal
    if reference is not None:
        chosen = signal.join(reference.where("kept").select("t"), "t", "left_semi")
        kept = chosen.join(_renumbered(chosen), "t").select("channel", F.col("k").alias("t"), "x")
    elif select_clean:
        size = half_up(rate)
        _, starts = clean_windows(signal, rate, n)
        kept = windows.in_windows(signal, starts, size).select("channel", "t", "x").distinct()
        order = _renumbered(kept)
        kept = kept.join(order, "t").select("channel", F.col("k").alias("t"), "x")
    b, a = K.shaping_filter(rate) if filtered and rate > 8 else (np.array([1.0]), np.array([1.0]))
    kept = kept_table(_filtered(kept, State(names, np.eye(1), np.eye(1), b, a)), "clean")  # read by several passes
    m = kept.agg((F.max("t") + 1).alias("n")).first().n
    blocks = block_covariances(kept, block, m)
    cov = _median_covariance(blocks, names) if mean == "median" else _karcher_covariance(blocks, names)
    mixing = L.spd_map(cov, np.sqrt, 1e-8)
    u = np.linalg.eigh((mixing + mixing.T) / 2)[1]
    bounds = component_limits(kept, u, m, half_up(length * rate), overlap, cutoff)
    return State(names, mixing, bounds[:, None] * u.T, b, a, bounds)


def _renumbered(kept: DataFrame, cell: int = 1 << 16) -> DataFrame:
    """(t, k): kept samples numbered without gaps; ranks within cells of time, plus the counts of cells before."""
    from pyspark.sql import Window

    ts = kept.select("t").distinct().withColumn("cell", F.floor(F.col("t") / cell))
    counts = ts.groupBy("cell").count().withColumn("before", F.coalesce(F.sum("count").over(Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("cell").orderBy("t")) - 1
    return ts.withColumn("r", rank).join(F.broadcast(counts.select("cell", "before")), "cell").select("t", (F.col("before") + F.col("r")).alias("k"))


def _blocks_as_rows(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("block").agg(F.transform(F.array_sort(F.collect_list(F.struct("ci", "cj", "v"))), lambda s: s["v"]).alias("v"))


def _folded(rows: DataFrame, c: int, make) -> tuple[np.ndarray, np.ndarray]:
    """Sums over blocks of weight times make(matrices) -> (weights, matrices): one pass, a row of sums for each task."""

    def run(frames):
        total, weight = np.zeros(c * c), 0.0
        for f in frames:
            if len(f):
                w, m = make(np.stack(f["v"].to_numpy()).astype(float).reshape(-1, c, c))
                total, weight = total + (w[:, None, None] * m).sum(0).ravel(), weight + w.sum()
        yield pd.DataFrame({"k": np.arange(c * c), "s": total, "w": weight})

    found = rows.select("v").mapInPandas(run, "k int, s double, w double").groupBy("k").agg(F.sum("s").alias("s"), F.sum("w").alias("w")).orderBy("k").toPandas()
    return found["s"].to_numpy().reshape(c, c), float(found["w"].iloc[0])


def _median_covariance(blocks: DataFrame, names: list[str], rounds: int = 128, tol: float = 1e-7) -> np.ndarray:
    """Geometric median by Weiszfeld's iteration, accelerated, over a written table of blocks: a pass each round and a row
    of sums for each task, whatever their number."""
    c, rows = len(names), kept_table(_blocks_as_rows(blocks), "blocks")
    s, w = _folded(rows, c, lambda m: (np.ones(len(m)), m))

    def step(now: np.ndarray) -> np.ndarray:
        floor = 1e-12 * max(np.linalg.norm(now), 1e-300)
        s, w = _folded(rows, c, lambda m: (1 / np.maximum(np.linalg.norm(m - now, axis=(1, 2)), floor), m))
        return s / w

    return accelerated(step, s / w, rounds, tol)


def accelerated(step, start: np.ndarray, rounds: int, tol: float, memory: int = 5) -> np.ndarray:
    """A fixed point of ``step``, which is a pass over the data, by Anderson's mixing of the last steps: the combination of
    them whose residuals, taken linearly, cancel best. A mix whose residual is larger than the last one is given up for
    the plain step."""
    x, xs, gs, best = start, [], [], np.inf
    for _ in range(rounds):
        g = step(x)
        size = float(np.linalg.norm(g - x))
        if size <= tol * max(np.linalg.norm(x), 1e-300):
            return g
        if size > 2 * best and gs:  # back to the plain step from the last good point
            x, xs, gs, best = gs[-1], [], [], np.inf
            continue
        best = min(best, size)
        xs, gs = [*xs, x][-memory:], [*gs, g][-memory:]
        f = np.stack([(b - a).ravel() for a, b in zip(xs, gs, strict=True)])
        x = g
        if len(f) > 1:
            d = np.diff(f, axis=0)
            mix = np.linalg.lstsq(d.T, f[-1], rcond=1e-10)[0]
            x = g - np.tensordot(mix, np.diff(np.stack(gs), axis=0), 1)
    return x


def _karcher_covariance(blocks: DataFrame, names: list[str], rounds: int = 32, tol: float = 1e-7) -> np.ndarray:
    """Affine-invariant mean over a table of blocks: tangent vectors are averaged in a pass each round."""
    c, rows = len(names), kept_table(_blocks_as_rows(blocks), "blocks")
    s, w = _folded(rows, c, lambda m: (np.ones(len(m)), m))
    now = s / w
    for _ in range(rounds):
        h, ih = L.spd_map(now, np.sqrt), L.spd_map(now, lambda v: 1 / np.sqrt(v))
        s, w = _folded(rows, c, lambda m, ih=ih: (np.ones(len(m)), np.stack([L.spd_log(ih @ x @ ih) for x in m])))
        v, u = np.linalg.eigh(s / w)
        now = h @ ((u * np.exp(v)) @ u.T) @ h
        if np.linalg.norm(s / w) < tol:
            break
    return now


def repair(state: State, space: tuple[np.ndarray, np.ndarray], most: float = 0.66, weights=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(operator, kept directions, their limits) for one window, given by its variances and directions."""
    v, u = space
    c = len(v)
    limit = ((state.thresholds @ u) ** 2).sum(0)
    keep = (v < limit) | (np.arange(c) < c - half_up(most * c))
    if keep.all():
        return np.eye(c), keep, limit
    r = state.mixing @ np.linalg.pinv(keep[:, None] * (u.T @ state.mixing)) @ u.T
    if weights is not None:
        w = weights(v, u, limit, keep)
        r = (u * w) @ u.T + (u * (1 - w)) @ u.T @ r
    return np.real(r), keep, limit


def spaces(covariances: np.ndarray, alpha: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Variances and directions of a stack of window covariances; with ``alpha``, of their nonlinear eigenspaces."""
    return np.linalg.eigh(covariances) if alpha is None else L.riemannian_eigenspace(covariances, alpha)


LOG = "start long, stop long, n_reconstructed int, applied boolean, variances array<double>, limits array<double>, weights array<double>"


def process(signal: DataFrame, state: State, rate: float, n: int, length: float = 0.5, step: int | None = None, most: float = 0.66, chunk: int = 1 << 15, weights=None, log: bool = False, alpha: float | None = None) -> DataFrame:
    """The repaired signal; with ``alpha``, each window's directions are those of its nonlinear eigenspace. Chunks of time are tasks of their own: an update sees only the last window of the filtered
    stream, and the blend only the update before, so a margin of both is all they need; the filter itself is scanned, so
    its memory, which at low rates is longer than any chunk, is no margin.
    Nothing is carried from call to call: every call starts anew. With ``log``, what was done instead of the signal:
    a row (LOG) for each update, with the span that it governs."""
    c = len(state.channels)
    size = max(half_up(length * rate), half_up(1.5 * c))
    step = step or max(1, size // 2)
    ahead = half_up(size / 2)
    chunk = max(chunk // step * step, step)
    edge = max(min(ahead, n - 1), 0)
    turned = windows.odd_reflected(signal, edge, n).withColumn("t", F.col("t") + edge)  # from 0 on
    both = turned.select(F.concat(F.lit("0|"), "channel").alias("channel"), "t", "x")
    if len(state.a) > 1:
        both = both.unionByName(_filtered(turned, state).select(F.concat(F.lit("1|"), "channel").alias("channel"), "t", "x"))
    both = both.withColumn("t", F.col("t") - edge)
    sent = signal.sparkSession.sparkContext.broadcast(state)

    def run(start: int, stop: int, t: np.ndarray, x: np.ndarray) -> pd.DataFrame:
        st = sent.value
        x, s = x[:c], x[-c:]
        at = {int(k): i for i, k in enumerate(t)}
        first = start // step * step
        marks = [m for m in range(first - step, stop + step + 1, step) if m > 0 or m == first - step]
        out = x[:, [at[k] for k in range(start, stop)]].copy()
        sums = np.concatenate([np.zeros((1, c, c)), np.cumsum(np.einsum("it,jt->tij", s, s), 0)]) if s.shape[1] * c * c < 4e7 else None
        last, trivial = np.eye(c), True
        done, rows = None, []
        ends = [at[max(min(m + ahead, int(t[-1])), int(t[0]))] + 1 for m in marks]
        moments = [(sums[hi] - sums[max(hi - size, 0)]) if sums is not None else s[:, max(hi - size, 0) : hi] @ s[:, max(hi - size, 0) : hi].T for hi in ends]
        for m, *space in zip(marks, *spaces(np.stack(moments) / size, alpha), strict=True):
            r, keep, limit = repair(st, space, most, weights)
            own = bool(keep.all())
            if log and done is not None and start < m <= stop + (step if stop == n else 0) and done < n:
                soft = np.where(keep, 1.0, 0.0) if weights is None else weights(*space, limit, keep)
                rows.append((max(done, 0), min(m, n), int((~keep).sum()), not (own and trivial), space[0].tolist(), limit.tolist(), soft.tolist()))
            if done is not None:
                a, b = max(done, start), min(m, stop)
                if b > a and not (own and trivial):
                    ramp = (1 - np.cos(np.pi * (np.arange(a, b) - done + 1) / (m - done))) / 2
                    part = x[:, [at[k] for k in range(a, b)]]
                    out[:, a - start : b - start] = ramp * (r @ part) + (1 - ramp) * (last @ part)
            last, trivial, done = r, own, m
        return pd.DataFrame(rows, columns=[c.split()[0] for c in LOG.split(", ")]) if log else pd.DataFrame({"t": np.arange(start, stop), "xs": list(out.T)})

    done = by_window(both, chunk, chunk, n, run, LOG if log else "t long, xs array<double>", before=size + 2 * step, after=ahead + step)
    return done if log else long_from_samples(done, state.channels)


def rejection_mask(log: DataFrame) -> DataFrame:
    """(t, on) for every sample that an update governs: whether it was changed."""
    return log.select(F.explode(F.sequence("start", F.col("stop") - 1)).alias("t"), F.col("applied").alias("on"))


def rejection_spans(log: DataFrame) -> DataFrame:
    """(start, stop) of the stretches that were changed, touching ones as one."""
    from quietfield.operators.spans import merge_spans

    return merge_spans(log.where("applied").select(F.lit("all").alias("channel"), "start", "stop")).select("start", "stop")


def diagnostics(log: DataFrame) -> DataFrame:
    """One row: windows, the share with a repair, the share of samples changed, and the most directions replaced."""
    size = F.col("stop") - F.col("start")
    return log.agg(
        F.count("*").alias("n_windows"), F.avg((F.col("n_reconstructed") > 0).cast("double")).alias("windows_repaired"),
        (F.sum(F.when(F.col("applied"), size).otherwise(0)) / F.sum(size)).alias("samples_changed"), F.max("n_reconstructed").alias("most_reconstructed"),
    )


def calibration_mask(signal: DataFrame, rate: float, n: int, **how) -> DataFrame:
    """(t, on) for every sample: whether a clean window holds it."""
    _, starts = clean_windows(signal, rate, n, **how)
    on = windows.in_windows(signal, starts, half_up(how.get("length", 1.0) * rate)).select("t").distinct().withColumn("on", F.lit(True))
    return signal.select("t").distinct().join(on, "t", "left").select("t", F.coalesce("on", F.lit(False)).alias("on"))


def process_globally(signal: DataFrame, state: State, n: int, step: int, most: float = 0.66) -> DataFrame:
    """One covariance of the whole signal, its nonlinear eigenspace, and one operator, faded in over the first step."""
    from quietfield.operators.moments import gram
    from quietfield.plans.model import apply_long

    kept = _filtered(signal, state)
    g, _, w, _ = gram(by_sample(kept))
    r, keep, _ = repair(state, L.riemannian_eigenspace(g / w), most)
    if keep.all():
        return signal
    ramp = F.when(F.col("t") >= step, 1.0).otherwise((1 - F.cos(F.lit(np.pi) * (F.col("t") + 1) / step)) / 2)
    both = apply_long(signal, r).withColumnRenamed("x", "y").join(signal, ["channel", "t"])
    return both.select("channel", "t", (ramp * F.col("y") + (1 - ramp) * F.col("x")).alias("x"))


def _filtered(signal: DataFrame, state: State) -> DataFrame:
    """Filtered by the statistics' filter."""
    return signal if len(state.a) == 1 else forward(signal, Cascade.of((state.b, state.a)))


def guided_weights(artifact: np.ndarray | None, preserve: np.ndarray | None, strength: float = 1.0):
    """Soft weights for repair(): threshold over variance where flagged, moved by how much more a direction belongs to
    what is to be preserved than to artifacts."""

    def weights(v: np.ndarray, u: np.ndarray, limit: np.ndarray, keep: np.ndarray) -> np.ndarray:
        def share(m: np.ndarray | None) -> np.ndarray:
            return np.zeros(len(v)) if m is None else np.maximum(np.einsum("ik,ij,jk->k", u, m, u) / np.trace(m) - 1 / len(v), 0)

        p, a = share(preserve), share(artifact)
        g = np.where(p + a > 0, (p - a) / np.maximum(p + a, 1e-300), 0)
        base = np.minimum(limit / np.maximum(v, 1e-300), 1)
        guided = np.where(g >= 0, base + g * (1 - base), base * (1 + g))
        return np.where(keep, 1.0, base + strength * (guided - base))

    return weights


def guidance(signal: DataFrame, biased: list[DataFrame]) -> np.ndarray:
    """Mean of the covariances of what biases leave, at unit trace."""
    from quietfield.operators.moments import covariance

    parts = [covariance(by_sample(b))[0] for b in biased]
    return np.mean([p / np.trace(p) for p in parts], 0)


def reference_samples(signal: DataFrame, top: int = 5, share: float = 0.1, eps: float | None = None, least: int | None = None) -> DataFrame:
    """(t, cluster, core, kept): density clusters of samples by their ``top`` largest amplitudes, and whether a sample is of
    the chosen one, that of the least median largest amplitude (of equals the larger, then the earlier).

    Unless given, the radius is a tenth of the mode of the amplitudes' size, and a core sample needs ``share`` of the
    samples up to that mode as neighbours. Where there is no cluster, every sample is kept.
    """
    from quietfield.operators.density import clusters
    from quietfield.operators.moments import histogram_mode

    c = len(channels_of(signal))
    top = min(top, c)
    tops = by_sample(signal).select("t", F.slice(F.sort_array(F.transform("xs", lambda v: F.abs(v)), asc=False), 1, top).alias("f"))
    tops = tops.withColumn("size", F.sqrt(F.aggregate("f", F.lit(0.0), lambda s, v: s + v * v)))
    mode = histogram_mode(tops, "size")
    eps = eps or (mode / 10 if mode else 1.0)
    least = least or max(2, int(np.ceil(share * tops.where(F.col("size") <= mode).count())))
    found = clusters(tops.select("t", "f"), eps, least, top).join(tops.select("t", F.col("f")[0].alias("largest")), "t")
    best = found.where("cluster is not null").groupBy("cluster").agg(F.median("largest").alias("middle"), F.count("*").alias("n")).orderBy("middle", F.desc("n"), "cluster").first()
    return found.select("t", "cluster", "core", F.lit(True).alias("kept") if best is None else F.coalesce(F.col("cluster") == best.cluster, F.lit(False)).alias("kept"))


def gev_reference(signal: DataFrame, points: int = 2000) -> DataFrame:
    """(t, kept): largest amplitude not above the mode of its distribution, fitted to quantiles of all samples."""
    top = by_sample(signal).select("t", F.array_max(F.transform("xs", lambda v: F.abs(v))).alias("a"))
    levels = [(k + 0.5) / points for k in range(points)]
    x = top.agg(F.percentile_approx("a", levels, 100 * points).alias("q")).first().q
    return top.select("t", (F.col("a") <= K.gev_mode(np.array(x))).alias("kept"))


@dataclass(frozen=True)
class Subspace:
    """Principal directions learned online by similarity matching. It never changes: an update gives another one, so
    that one that fails leaves the last as it is.

    With B = M^-1 W and a chunk's second moments G = x x' / n, the outputs y = B x have the moments y x' / n = B G and
    y y' / n = B G B', so a chunk enters by G alone, which is one aggregation however long the chunk is.
    """

    w: np.ndarray  # how inputs go with outputs
    m: np.ndarray  # how outputs go with each other
    whitened: bool = True  # outputs tend to unit variance; else they keep their own
    rate: float = 0.2
    tau: float = 1e-5

    @classmethod
    def start(cls, basis: np.ndarray, second: np.ndarray, whitened: bool = True, rate: float = 0.2, tau: float | None = None, reg: float = 1e-8) -> Subspace:
        """From directions (channels x k) and second moments of the data."""
        y = basis.T @ second
        return cls(y, L.spd_map(y @ basis, lambda v: v, reg), whitened, rate, (1e-5 if whitened else 0.8) if tau is None else tau)

    def map(self) -> np.ndarray:
        return np.linalg.solve(self.m, self.w)

    def advanced(self, second: np.ndarray) -> Subspace:
        b = self.map()
        w = self.w + 2 * self.rate * (b @ second - self.w)
        goal = np.eye(len(b)) if self.whitened else self.m
        m = self.m + self.rate / self.tau * (b @ second @ b.T - goal)
        if np.linalg.cond(m) > 1 / np.finfo(float).eps:
            m = L.spd_map(m, lambda v: v, 1e-8)
        return replace(self, w=w, m=m)

    def components(self) -> np.ndarray:
        """An orthonormal basis (channels x k)."""
        return np.linalg.qr(self.map().T)[0]


@dataclass(frozen=True)
class Adaptive:
    """A calibration that goes on: the state to process with, and the directions learned so far."""

    state: State
    learner: Subspace


def adaptive_fit(signal: DataFrame, rate: float, n: int, cutoff: float = 20.0, whitened: bool = True, block: int = 10, **how) -> Adaptive:
    """A calibration as by calibrate(), whose directions start the learner."""
    state = calibrate(signal, rate, n, cutoff, block=block, **how)
    second = _second_moments(_clean_part(signal, state, rate, n)[0])
    basis = np.linalg.eigh((state.mixing + state.mixing.T) / 2)[1]
    return Adaptive(state, Subspace.start(basis, second, whitened))


def partial_fit(model: Adaptive, chunk: DataFrame, rate: float, n: int, cutoff: float = 20.0, length: float = 0.1, overlap: float = 0.66, block: int = 10) -> Adaptive:
    """The model after a further chunk (t from 0). The one given stays as it was, so a chunk that fails changes nothing.

    A chunk shorter than a second has no window to judge and is refused.
    """
    if n < half_up(rate):
        raise ValueError(f"a chunk of {n} samples is shorter than a window of {half_up(rate)}")
    kept, m = _clean_part(chunk, model.state, rate, n)
    learner = model.learner.advanced(_second_moments(kept))
    names, basis = model.state.channels, learner.components()
    cov = _median_covariance(block_covariances(kept, block, m), names)
    bounds = component_limits(kept, basis, m, half_up(max(length * rate, 2)), overlap, cutoff)
    return Adaptive(State(names, L.spd_map(cov, np.sqrt, 1e-8), bounds[:, None] * basis.T, model.state.b, model.state.a, bounds), learner)


def moving_fit(signal: DataFrame, rate: float, n: int, seconds: float = 20.0, **how) -> State:
    """A calibration on the last ``seconds`` alone."""
    first = max(0, n - half_up(seconds * rate))
    return calibrate(signal.where(F.col("t") >= first).withColumn("t", F.col("t") - first), rate, n - first, **how)


def _second_moments(kept: DataFrame) -> np.ndarray:
    from quietfield.operators.moments import gram

    g, _, w, _ = gram(by_sample(kept))
    return g / w


def _clean_part(signal: DataFrame, state: State, rate: float, n: int) -> tuple[DataFrame, int]:
    """Samples of clean windows, numbered without gaps and filtered, and how many."""
    _, starts = clean_windows(signal, rate, n)
    kept = windows.in_windows(signal, starts, half_up(rate)).select("channel", "t", "x").distinct()
    kept = kept.join(_renumbered(kept), "t").select("channel", F.col("k").alias("t"), "x")
    return _filtered(kept, state), kept.agg((F.max("t") + 1).alias("n")).first().n


def component_limits(kept: DataFrame, basis: np.ndarray, m: int, size: int, overlap: float, cutoff: float) -> np.ndarray:
    """Mean plus ``cutoff`` deviations of the amplitudes of each direction (columns) in windows, by the robust fit."""
    from quietfield.plans.model import apply_long

    comps = apply_long(kept, basis.T, None, [f"c{k:03d}" for k in range(basis.shape[1])])
    rms = windows.window_rms(comps, windows.fractional_starts(m, size, overlap) or [0], min(size, m))

    def run(f: pd.DataFrame) -> pd.DataFrame:
        mu, sigma = K.fit_rms(f["rms"].to_numpy())
        return pd.DataFrame({"channel": f["channel"].iloc[:1], "limit": [mu + cutoff * sigma]})

    found = {r.channel: r.limit for r in rms.groupBy("channel").applyInPandas(run, "channel string, limit double").collect()}
    return np.array([found[f"c{k:03d}"] for k in range(basis.shape[1])])
