"""Recursive filters over blocks of time, exactly: a scan of affine maps of the filter's state.

A block takes the state before it to the state after it by a fixed matrix (the filter's step to the power of the block's
length) and adds the end state of its own samples from rest. One pass gives each block's end state from rest, a prefix
over these (a row for each block) its true start, and a second pass filters every block from there. Nothing is repeated
and nothing has to be forgotten, so blocks may be shorter than the filter's memory.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quietfield.functions import kernels as K
from quietfield.operators.windows import odd_reflected

BLOCK = 1 << 18


@dataclass(frozen=True)
class Cascade:
    """Sections (b, a) one after the other, with one state for all of them."""

    sections: tuple[tuple[tuple[float, ...], tuple[float, ...]], ...]

    @classmethod
    def of(cls, *sections) -> Cascade:
        return cls(tuple((tuple(map(float, b)), tuple(map(float, a))) for b, a in sections))

    @classmethod
    def of_sos(cls, sos: np.ndarray) -> Cascade:
        return cls.of(*[(s[:3], s[3:]) for s in sos])

    def sizes(self) -> list[int]:
        return [max(len(b), len(a)) - 1 for b, a in self.sections]

    def run(self, x: np.ndarray, state: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(output, state after) along the last axis; from rest unless a state is given."""
        ends, at = [], 0
        for (b, a), m in zip(self.sections, self.sizes(), strict=True):
            x, end = K.lfilter(np.array(b), np.array(a), x, None if state is None else state[..., at : at + m])
            ends, at = [*ends, end], at + m
        return x, np.concatenate(ends, -1) if ends else np.zeros((*x.shape[:-1], 0))

    def step(self) -> np.ndarray:
        """What one sample of silence makes of the state: state after = step @ state before."""
        m = sum(self.sizes())
        return self.run(np.zeros((m, 1)), np.eye(m))[1].T

    def steady(self) -> np.ndarray:
        """State of the steady response to ones."""
        out, scale = [], 1.0
        for b, a in self.sections:
            b, a = np.array(b), np.array(a)
            out.append(K.lfilter_zi(b, a) * scale if max(len(a), len(b)) > 1 else np.zeros(0))
            scale *= b.sum() / a.sum()
        return np.concatenate(out) if out else np.zeros(0)

    def memory(self) -> int:
        return K.memory(*[np.array(a) for _, a in self.sections])

    def padding(self) -> int:
        """Samples that forward and backward filtering put at each end: three times the taps."""
        if len(self.sections) == 1:
            return 3 * max(map(len, self.sections[0]))
        b2, a2 = (sum(s[k][2] == 0 if len(s[k]) > 2 else True for s in self.sections) for k in (0, 1))
        return 3 * (2 * len(self.sections) + 1 - min(b2, a2))


def scan(signal: DataFrame, cascade: Cascade, first: int = 0, steady: bool = False, block: int = BLOCK) -> DataFrame:
    """The filtered signal (channel, t, x), t from ``first`` without gaps; from rest, or from the steady state of the
    first sample."""
    schema, m = "channel string, t long, x double", sum(cascade.sizes())
    if m == 0:
        gain = float(np.prod([b[0] / a[0] for b, a in cascade.sections])) if cascade.sections else 1.0
        return signal.select("channel", "t", (F.col("x") * gain).alias("x"))
    rows = signal.select("channel", "t", "x", F.floor((F.col("t") - first) / block).alias("block"))

    def ends(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("t")
        x = f["x"].to_numpy(float)
        return pd.DataFrame({"channel": f["channel"].iloc[:1], "block": f["block"].iloc[:1], "head": x[:1], "end": [cascade.run(x)[1].tolist()]})

    over = np.linalg.matrix_power(cascade.step(), block)
    rest = cascade.steady() if steady else np.zeros(m)

    def starts(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("block")
        state, out = rest * f["head"].iloc[0] if steady else rest, []
        for e in f["end"]:
            out.append(state.tolist())
            state = over @ state + np.array(e)
        return pd.DataFrame({"channel": f["channel"], "block": f["block"], "state": out})

    seen = rows.groupBy("channel", "block").applyInPandas(ends, "channel string, block long, head double, end array<double>")
    states = seen.groupBy("channel").applyInPandas(starts, "channel string, block long, state array<double>")  # a row for each block

    def filtered(f: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("t")
        f["x"] = cascade.run(f["x"].to_numpy(float), np.array(s["state"].iloc[0], float))[0]
        return f[["channel", "t", "x"]]

    return rows.groupBy("channel", "block").cogroup(states.groupBy("channel", "block")).applyInPandas(filtered, schema)


def forward(signal: DataFrame, cascade: Cascade, block: int = BLOCK) -> DataFrame:
    """Filtered from rest. A filter that forgets within a block needs one pass with a margin; others are scanned."""
    from quietfield.operators.spectral import in_blocks

    if cascade.memory() <= block:
        return in_blocks(signal, lambda x: cascade.run(x)[0], cascade.memory(), after=0, block=block)
    return scan(signal, cascade, block=block)


def both_ways(signal: DataFrame, cascade: Cascade, n: int, block: int = BLOCK) -> DataFrame:
    """Zero phase: forward and backward from steady states, edges turned about the edge sample."""
    pad = min(cascade.padding(), n - 1)
    if n < 1:
        return signal.select("channel", "t", "x")
    there = scan(odd_reflected(signal, pad, n), cascade, -pad, True, block)
    turn = lambda s: s.select("channel", (F.lit(n - 1) - F.col("t")).alias("t"), "x")
    return turn(scan(turn(there), cascade, -pad, True, block)).where((F.col("t") >= 0) & (F.col("t") < n))


def zero_phase(signal: DataFrame, cascade: Cascade, block: int = BLOCK) -> DataFrame:
    """both_ways(), in one pass with margins where the filter forgets within a block."""
    from quietfield.operators.spectral import in_blocks

    if cascade.memory() <= block:
        if len(cascade.sections) == 1:
            b, a = map(np.array, cascade.sections[0])
            return in_blocks(signal, lambda x: K.filtfilt(b, a, x), cascade.memory(), block=block)
        sos = np.array([[*b, *a] for b, a in cascade.sections])
        return in_blocks(signal, lambda x: K.sosfiltfilt(sos, x), cascade.memory(), block=block)
    return both_ways(signal, cascade, signal.agg((F.max("t") + 1).alias("n")).first().n or 0, block)
