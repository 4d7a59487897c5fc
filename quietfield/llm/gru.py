"""A small gated recurrent language model in numpy: truncated backpropagation, class-factored softmax.

Sequences run side by side in lanes; a lane holds whole documents one after another and its state is set to zero
where one begins, so that every document is read from its start to its end with the state carried across windows.
"""

from __future__ import annotations

import heapq

import numpy as np

WINDOW, PART, PLACES = 32, 1024, 8192
TINY, SAFE = 1e-37, 60


def alike(sizes: np.ndarray) -> list[np.ndarray]:
    """Documents in groups whose sizes are within a factor of four, so that lanes side by side are about as long."""
    order = np.argsort(-sizes, kind="stable")
    order = order[sizes[order] > 0]
    out = []
    while len(order):
        n = int(np.searchsorted(-sizes[order], -(sizes[order[0]] / 4), side="left"))
        out.append(order[: max(n, 1)])
        order = order[max(n, 1) :]
    return out


class Lanes:
    """Token sequences of some documents laid out in lanes, the longest lane first: tokens and documents by lane.

    It takes as many places as there are tokens. Documents should come by falling size, so that lanes are about as long.
    """

    def __init__(self, tokens: np.ndarray, sizes: np.ndarray, chosen: np.ndarray, most: int = 512):
        at = np.cumsum(sizes) - sizes
        n = max(1, min(most, len(chosen)))
        heap, lane = [(0, k) for k in range(n)], np.zeros(len(chosen), np.int64)
        for i, size in enumerate(sizes[chosen].tolist()):
            total, k = heap[0]
            lane[i] = k
            heapq.heapreplace(heap, (total + size, k))
        length = np.zeros(n, np.int64)
        length[[k for _, k in heap]] = [total for total, _ in heap]
        rank = np.empty(n, np.int64)
        rank[np.argsort(-length, kind="stable")] = np.arange(n)
        self.length = np.sort(length)[::-1]
        self.stop = np.cumsum(self.length)
        docs = chosen[np.argsort(rank[lane], kind="stable")]
        size = sizes[docs]
        first = np.cumsum(size) - size
        self.target = np.concatenate([tokens[:0], *(tokens[lo:hi] for lo, hi in zip(at[docs].tolist(), (at[docs] + size).tolist(), strict=True))])
        self.owner = np.repeat(docs.astype(np.int32), size)
        self.begins = np.zeros(len(self.target), bool)
        self.begins[first[size > 0]] = True

    def windows(self, steps: int = WINDOW, places: int = 0):
        """Targets, which places have one, starts and documents of windows of ``steps``, or as many as ``places`` allow.

        Lanes that have ended are left out, so later windows have fewer.
        """
        lo = 0
        while len(self.target) and lo < self.length[0]:
            n = int(np.searchsorted(-self.length, -lo, side="left"))
            hi = min(lo + max(steps, places // n), int(self.length[0]))
            at = (self.stop - self.length)[:n] + np.arange(lo, hi)[:, None]
            on = at < self.stop[:n]
            at = np.minimum(at, len(self.target) - 1)
            yield np.where(on, self.target[at], 0), on, on & self.begins[at], self.owner[at]
            lo = hi


class Model:
    """Tokens stand by falling frequency; class c holds those of rank c*S up to (c+1)*S."""

    def __init__(self, counts: np.ndarray, end: int, hidden: int = 16, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.end, self.h, self.v = end, hidden, len(counts)
        self.s = max(1, int(np.ceil(np.sqrt(self.v))))
        self.c = -(-self.v // self.s)
        p = np.full(self.c * self.s, 1e-30)
        p[: self.v] = counts + 0.5
        p = p.reshape(self.c, self.s) / p.sum()
        f = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
        self.p = {
            "e": f(self.v, hidden), "w": f(hidden, 3 * hidden) * 3, "b": np.zeros(3 * hidden, np.float32),
            "u": f(hidden, 3 * hidden) * 3, "d": np.zeros(3 * hidden, np.float32),
            "cw": f(hidden, self.c) * 0.1, "cb": np.log(p.sum(1)).astype(np.float32),
            "ow": f(self.c, hidden, self.s) * 0.1, "ob": np.maximum(np.log(p / p.sum(1, keepdims=True)), -60).astype(np.float32),
        }

    def pack(self) -> np.ndarray:
        return np.concatenate([self.p[k].ravel() for k in sorted(self.p)])

    def unpack(self, flat: np.ndarray) -> Model:
        at = 0
        for k in sorted(self.p):
            n = self.p[k].size
            self.p[k] = flat[at : at + n].reshape(self.p[k].shape).astype(np.float32)
            at += n
        return self

    def forward(self, table: np.ndarray, before: np.ndarray, start: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """States of a window, its gates (update, reset, new) and what its new states have of the states before.

        ``table`` has each token's share in each gate. Gates are apart, so that all arrays are read as they lie.
        """
        (steps, n), h = before.shape, self.h
        out, own, y = np.empty((steps, n, h), np.float32), np.empty((steps, n, h), np.float32), np.empty((3, n, h), np.float32)
        gates = table.take(before, axis=1)
        half = np.float32(0.5)
        u = self.p["u"].reshape(h, 3, h).transpose(1, 0, 2) * np.array([half, half, 1], np.float32)[:, None, None]
        d = np.repeat(self.p["d"][None, 2 * h :], n, axis=0)
        resets = start.any(1).tolist()
        for t in range(steps):
            if resets[t]:
                state = np.where(start[t][:, None], np.float32(0), state)
            np.matmul(state, u, out=y)
            both, new, nxt = gates[:2, t], gates[2, t], out[t]
            both += y[:2]
            np.tanh(both, out=both)
            both *= half
            both += half
            mine = np.add(y[2], d, out=own[t])
            new += np.multiply(mine, both[1], out=nxt)
            np.tanh(new, out=new)
            np.subtract(new, state, out=nxt)
            nxt *= both[0]
            nxt += state
            state = nxt
        return out, gates, own

    def by_token(self, token: np.ndarray) -> np.ndarray:
        """Places by their tokens; few bits are sorted several times as fast."""
        return np.argsort(token.astype(np.uint16) if self.v <= 1 << 16 else token, kind="stable")

    def outputs(self, states: np.ndarray, target: np.ndarray, learn: bool):
        """Log probability (natural) of each target, and gradients by ascent if asked for.

        Places are taken by target, so that each class and each token has its own in a row.
        """
        p, n, h = self.p, len(target), self.h
        order = self.by_token(target)
        x, token = states.take(order, axis=0), target[order]
        cut = np.searchsorted(token, np.arange(self.c + 1) * self.s)
        cb, ob = p["cb"] - p["cb"].max(), p["ob"] - p["ob"].max(1, keepdims=True)
        # each token's weights, its class's and its own
        w, b = (p["ow"].transpose(0, 2, 1) + p["cw"].T[:, None]).reshape(-1, h), (ob + cb[:, None]).ravel()
        ea = x @ p["cw"]
        eb = np.empty((n, self.s), ea.dtype)
        for c in range(self.c):
            if cut[c] < cut[c + 1]:
                np.matmul(x[cut[c] : cut[c + 1]], p["ow"][c], out=eb[cut[c] : cut[c + 1]])
        # States are within -1 and 1: up to SAFE no exponent is too large or too small, and biases are factors of the sums.
        shift = np.zeros((), ea.dtype)
        if np.abs(p["cw"]).sum(0).max() > SAFE:
            ea += cb
            most, cb = ea.max(1), np.zeros_like(cb)
            ea -= most[:, None]
            shift = shift + most
        if np.abs(p["ow"]).sum(1).max() > SAFE:
            eb += np.repeat(ob, np.diff(cut), axis=0)
            most, ob = eb.max(1), np.zeros_like(ob)
            eb -= most[:, None]
            shift = shift + most
        np.exp(ea, out=ea)
        np.exp(eb, out=eb)
        cb, ob = np.exp(cb), np.exp(ob)
        sa, sb = ea @ cb + TINY, np.empty(n, ea.dtype)
        for c in range(self.c):
            if cut[c] < cut[c + 1]:
                np.matmul(eb[cut[c] : cut[c + 1]], ob[c], out=sb[cut[c] : cut[c + 1]])
        sb += TINY
        wt = w.take(token, axis=0)
        logp = np.empty(n)
        logp[order] = np.einsum("ij,ij->i", x, wt) + b[token] - shift - np.log(sa) - np.log(sb)
        if not learn:
            return logp, None
        sa, sb = 1 / sa, 1 / sb
        seen = np.bincount(token, minlength=len(b)).astype(ea.dtype)
        first = np.flatnonzero(np.diff(token, prepend=-1))
        total = np.zeros((len(b), h), ea.dtype)  # of the states, by token
        total[token[first]] = np.add.reduceat(x, first, axis=0)
        total, seen = total.reshape(self.c, self.s, h), seen.reshape(self.c, self.s)
        xa, xb = x * sa[:, None], x * sb[:, None]
        grad = {
            "cw": total.sum(1).T - xa.T @ ea * cb, "cb": seen.sum(1) - sa @ ea * cb,
            "ow": np.ascontiguousarray(total.transpose(0, 2, 1)), "ob": seen,
        }
        up = ea @ (p["cw"] * cb).T
        up *= -sa[:, None]
        up += wt
        for c in range(self.c):
            lo, hi = cut[c], cut[c + 1]
            if lo < hi:
                grad["ow"][c] -= xb[lo:hi].T @ eb[lo:hi] * ob[c]
                grad["ob"][c] -= sb[lo:hi] @ eb[lo:hi] * ob[c]
                up[lo:hi] -= eb[lo:hi] @ (p["ow"][c] * ob[c]).T * sb[lo:hi, None]
        grad["states"] = np.empty_like(up)
        grad["states"][order] = up
        return logp, grad

    def table(self) -> np.ndarray:
        """Each token's share in the gates update, reset (halved, as tanh makes sigmoids of them) and new."""
        x = self.p["e"] @ self.p["w"] + self.p["b"]
        x[:, : 2 * self.h] += self.p["d"][: 2 * self.h]
        x[:, : 2 * self.h] *= np.float32(0.5)
        return np.ascontiguousarray(x.reshape(self.v, 3, self.h).transpose(1, 0, 2))

    def score(self, tokens: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Natural log probability of each document's whole sequence."""
        total, table = np.zeros(len(sizes)), self.table()
        lanes = Lanes(tokens, sizes, np.argsort(-sizes, kind="stable"))
        state, last = np.zeros((len(lanes.length), self.h), np.float32), np.full(len(lanes.length), self.end, np.int32)
        for target, on, start, owner in lanes.windows(1, PLACES):
            n = target.shape[1]
            before = np.concatenate([last[None, :n], target[:-1]])
            states, _, _ = self.forward(table, before, start, state[:n])
            state, last = states[-1], target[-1]
            logp, _ = self.outputs(states[on], target[on], False)
            total += np.bincount(owner[on], logp, len(sizes))
        return total

    def gradients(self, target: np.ndarray, on: np.ndarray, start: np.ndarray, state: np.ndarray, last: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients, by ascent, of the log probability of a window's targets that are ``on``; and the states after it."""
        h, p, n = self.h, self.p, target.shape[1]
        before = np.where(start, self.end, np.concatenate([last[None], target[:-1]]))
        states, (z, r, new), own = self.forward(self.table(), before, start, state)
        _, g = self.outputs(states[on], target[on], True)
        up = np.zeros_like(states)
        up[on] = g.pop("states")
        old = np.concatenate([state[None], states[:-1]])
        old[start] = 0
        # What a state's gradient is multiplied by for those of update, reset and new gate by the state before, of the new
        # gate by inputs, and of the state before itself; then these gradients.
        back = np.empty((5, *states.shape), np.float32)
        keep = np.subtract(1, z, out=back[4])
        np.multiply((new - old) * z, keep, out=back[0])
        np.multiply(1 - new * new, z, out=back[3])
        np.multiply(back[3], r, out=back[2])
        np.multiply(back[2] * own, 1 - r, out=back[1])
        u = np.ascontiguousarray(p["u"].reshape(h, 3, h).transpose(1, 2, 0))
        carry, by_gate, resets = np.zeros((n, h), np.float32), np.empty((3, n, h), np.float32), start.any(1).tolist()
        for t in reversed(range(len(target))):
            now = back[:, t]
            carry += up[t]
            now *= carry
            np.matmul(now[:3], u, out=by_gate)
            np.add(by_gate[0], by_gate[1], out=carry)
            carry += by_gate[2]
            carry += now[4]
            if resets[t]:
                carry[start[t]] = 0
        back, token = back.reshape(5, -1, h), before.ravel()
        side = lambda x: x.transpose(1, 0, 2).reshape(h, 3 * h)
        g["u"], g["d"] = side(old.reshape(-1, h).T @ back[:3]), (np.ones(len(token), np.float32) @ back[:3]).ravel()
        order = self.by_token(token)
        at = np.flatnonzero(np.diff(token[order], prepend=-1))
        total = np.zeros((3, self.v, h), np.float32)
        for k, gate in enumerate((0, 1, 3)):
            total[k, token[order[at]]] = np.add.reduceat(back[gate].take(order, axis=0), at, axis=0)
        w = p["w"].reshape(h, 3, h).transpose(1, 2, 0)
        g["w"], g["b"], g["e"] = side(p["e"].T @ total), total.sum(1).ravel(), (total @ w).sum(0)
        return g, states[-1].copy()

    def train(self, tokens: np.ndarray, sizes: np.ndarray, rate: float = 0.01, lanes: int = 256) -> int:
        """One pass of truncated backpropagation (Adam) over all tokens; returns how many.

        Longer documents are learned from in parts of PART tokens, each from a state of zero, so that lanes are full.
        """
        parts = -(-sizes // PART)
        whole = np.full(parts.sum(), PART)
        whole[np.cumsum(parts)[parts > 0] - 1] = (sizes - (parts - 1) * PART)[parts > 0]
        sizes = whole
        p = self.p
        first, second = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
        seen, step, laid = 0, 0, None
        for lane, (target, on, start, _) in ((x, w) for group in alike(sizes) for x in [Lanes(tokens, sizes, group, lanes)] for w in x.windows()):
            n = target.shape[1]
            if lane is not laid:
                laid, state, last = lane, np.zeros((n, self.h), np.float32), np.full(n, self.end, np.int32)
            g, state = self.gradients(target, on, start, state[:n], last[:n])
            last = target[-1]
            step += 1
            count = int(on.sum())
            seen += count
            for k, x in g.items():
                x = x / np.float32(count)
                first[k] += np.float32(0.1) * (x - first[k])
                second[k] += np.float32(0.01) * (x * x - second[k])
                p[k] = p[k] + np.float32(rate / (1 - 0.9**step)) * first[k] / (np.sqrt(second[k] / np.float32(1 - 0.99**step)) + np.float32(1e-6))
        return seen
