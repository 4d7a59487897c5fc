"""Subspace repair of a stream: state by recording, whatever the chunks that it comes in.

Carried are the state of the statistics' filter, the samples of its output that the next window covers, the samples that
no update governs yet, the last operator and where its span ends: a window, a step and the look-ahead of samples,
whatever the length of the stream. What comes out is what ``asr.process`` gives for the whole signal.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quietfield.functions import kernels as K
from quietfield.operators.asr import State, half_up, repair, spaces

CARRIED = "base long, seen long, started boolean, zi array<double>, raw array<double>, stats array<double>, stats_at long, mark long, done long, operator array<double>, whole boolean"


@dataclass(frozen=True)
class Carry:
    """What is known of a recording between chunks. It never changes: a chunk gives another one."""

    base: int  # the time of its first sample; other times count from there
    seen: int  # samples that have come
    started: bool
    zi: np.ndarray  # channels x order
    raw: np.ndarray  # the last samples
    stats: np.ndarray  # the last filtered ones
    stats_at: int  # time of the first of these
    mark: int  # the next update
    done: int  # where the spans of the updates so far end
    operator: np.ndarray
    whole: bool  # the last operator changes nothing

    @classmethod
    def new(cls, base: int, c: int, order: int, step: int) -> Carry:
        none = np.zeros((c, 0))
        return cls(base, 0, False, np.zeros((c, order)), none, none, 0, -step, -step, np.eye(c), True)

    def row(self) -> tuple:
        flat = lambda x: np.ascontiguousarray(x).ravel().tolist()
        return (self.base, self.seen, self.started, flat(self.zi), flat(self.raw), flat(self.stats), self.stats_at, self.mark, self.done, flat(self.operator), self.whole)

    @classmethod
    def of(cls, row: tuple, c: int) -> Carry:
        base, seen, started, zi, raw, stats, stats_at, mark, done, operator, whole = row
        table = lambda x: np.array(x, float).reshape(c, -1)
        return cls(base, seen, started, table(zi), table(raw), table(stats), stats_at, mark, done, table(operator), whole)


@dataclass(frozen=True)
class Repairer:
    """The parameters of ``asr.process``, in samples."""

    state: State
    size: int
    step: int
    ahead: int
    most: float = 0.66
    alpha: float | None = None

    @classmethod
    def of(cls, state: State, rate: float, length: float = 0.5, step: int | None = None, most: float = 0.66, alpha: float | None = None) -> Repairer:
        size = max(half_up(length * rate), half_up(1.5 * len(state.channels)))
        return cls(state, size, step or max(1, size // 2), half_up(size / 2), most, alpha)

    def start(self, base: int) -> Carry:
        return Carry.new(base, len(self.state.channels), max(len(self.state.a), len(self.state.b)) - 1, self.step)

    def _filtered(self, x: np.ndarray, zi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return K.lfilter(self.state.b, self.state.a, x, zi) if len(self.state.a) > 1 else (x, zi)

    def feed(self, carry: Carry, x: np.ndarray, last: bool) -> tuple[Carry, int, np.ndarray]:
        """(state after, time of the first repaired sample, repaired samples) of a further chunk (channels by time).

        ``last`` ends the recording: the edge is turned about its last sample, and all that waits comes out.
        """
        raw, seen = np.concatenate([carry.raw, x], 1), carry.seen + x.shape[1]
        first = max(carry.done, 0)
        if seen == 0 or (not carry.started and seen <= self.ahead and not last):  # the turned edge needs more samples
            return replace(carry, raw=raw, seen=seen), first, raw[:, :0]
        new, zi, stats, at, lead = x, carry.zi, carry.stats, carry.stats_at, min(self.ahead, seen - 1)
        if not carry.started:
            new, at = np.concatenate([2 * raw[:, :1] - raw[:, lead:0:-1], raw], 1), -lead
        s, zi = self._filtered(new, zi)
        stats = np.concatenate([stats, s], 1)
        final = seen - 1
        if last:
            tail = min(self.ahead, seen - 1)
            s, _ = self._filtered(2 * raw[:, -1:] - raw[:, -2 : -tail - 2 : -1], zi)
            stats, final = np.concatenate([stats, s], 1), seen - 1 + tail
        marks, m = [], carry.mark
        while (m - self.step < seen) if last else (m + self.ahead <= final):
            marks.append(m)
            m = m + self.step if m > 0 else self.step
        c, parts, done, operator, whole = len(raw), [], carry.done, carry.operator, carry.whole
        if marks:
            ends = [max(min(k + self.ahead, final), at) - at + 1 for k in marks]
            windows = [stats[:, max(e - self.size, 0) : e] for e in ends]
            values, turns = spaces(np.stack([w @ w.T for w in windows]) / self.size, self.alpha)
            for k, v, u in zip(marks, values, turns, strict=True):
                r, keep, _ = repair(self.state, (v, u), self.most)
                own = bool(keep.all())
                if k > -self.step:
                    a, b = max(done, 0), min(k, seen)
                    part = raw[:, raw.shape[1] - (seen - a) :][:, : b - a]
                    if b > a and not (own and whole):
                        ramp = (1 - np.cos(np.pi * (np.arange(a, b) - done + 1) / (k - done))) / 2
                        part = ramp * (r @ part) + (1 - ramp) * (operator @ part)
                    parts.append(part)
                done, operator, whole = k, r, own
        out = np.concatenate(parts, 1) if parts else np.zeros((c, 0))
        hold = max(seen - max(done, 0), min(self.ahead + 1, seen))
        cut = max(0, min(m + self.ahead + 1 - self.size - at, stats.shape[1]))
        after = Carry(carry.base, seen, True, zi, raw[:, raw.shape[1] - hold :], stats[:, cut:], at + cut, m, done, operator, whole)
        return after, first, out


def repaired(samples: DataFrame, repairer: Repairer) -> DataFrame:
    """(rec, t, xs) of a stream of (rec, t, xs, last): recordings in order of t without gaps, channels as in the model.

    A row with ``last`` ends its recording; rows of that name that come later begin another one. A gap is an error, and a
    batch that fails is done again from the state before it.
    """
    sent = samples.sparkSession.sparkContext.broadcast(repairer)
    c = len(repairer.state.channels)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        f = pd.concat(list(frames)).sort_values("t")
        t, x, ends = f["t"].to_numpy(), np.stack(f["xs"].to_numpy()).astype(float).T, f["last"].fillna(False).to_numpy(bool)
        carry = Carry.of(state.get, c) if state.exists else None
        lo, out = 0, []
        for hi in [*(np.flatnonzero(ends) + 1).tolist(), len(t)]:
            if hi == lo:
                continue
            carry = carry or sent.value.start(int(t[lo]))
            if int(t[lo]) != carry.base + carry.seen or (np.diff(t[lo:hi]) != 1).any():
                raise ValueError(f"samples of {key[0]} don't follow each other at {int(t[lo])}")
            after, first, y = sent.value.feed(carry, x[:, lo:hi], bool(ends[hi - 1]))
            out.append(pd.DataFrame({"rec": key[0], "t": carry.base + first + np.arange(y.shape[1]), "xs": list(y.T)}))
            carry, lo = None if ends[hi - 1] else after, hi
        if carry is not None:
            state.update(carry.row())
        elif state.exists:
            state.remove()
        yield pd.concat(out)

    return samples.groupBy("rec").applyInPandasWithState(run, "rec string, t long, xs array<double>", CARRIED, "append", GroupStateTimeout.NoTimeout)
