"""A character-level bidirectional LSTM with CRF transitions, in numpy."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

#: ASCII, other letters, other characters, padding.
SYMBOLS = 131
PAD = 130
#: Runs of a chain that are walked at once: what is held of them stays in the cache.
RUNS = 256


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class LstmCrf:
    """gates[d]: input of the four gates (in, forget, out, cell) by symbol; back[d]: the same by hidden state; d = 0 reads forwards, 1 backwards."""

    tags: int
    hidden: int = 8
    seed: int = 7
    params: dict[str, np.ndarray] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.params:
            return
        rng, h = np.random.Generator(np.random.PCG64(self.seed)), self.hidden
        for d in (0, 1):
            self.params[f"gates{d}"] = rng.normal(0, 0.3, (SYMBOLS, 4 * h))
            self.params[f"gates{d}"][:, h : 2 * h] += 1.0
            self.params[f"back{d}"] = rng.normal(0, 0.3, (h, 4 * h))
        self.params["emit"] = rng.normal(0, 0.3, (2 * h, self.tags))
        self.params["bias"] = np.zeros(self.tags)
        self.params["move"] = np.zeros((self.tags, self.tags))

    # -- training -------------------------------------------------------------

    def _forward(self, x: np.ndarray, d: int) -> tuple[np.ndarray, list]:
        """x: (time, batch). Hidden states and what the gradient needs."""
        h, p = self.hidden, self.params
        hs, kept = np.zeros((*x.shape, h)), []
        state, cell = np.zeros((x.shape[1], h)), np.zeros((x.shape[1], h))
        for t in range(len(x)) if d == 0 else range(len(x) - 1, -1, -1):
            a = p[f"gates{d}"][x[t]] + state @ p[f"back{d}"]
            g, s = np.tanh(a[:, 3 * h :]), _sigmoid(a[:, : 3 * h])
            before = cell
            cell = s[:, h : 2 * h] * cell + s[:, :h] * g
            top = np.tanh(cell)
            kept.append((t, state, before, s, g, top))
            state = s[:, 2 * h :] * top
            hs[t] = state
        return hs, kept

    def _backward(self, x: np.ndarray, d: int, kept: list, dh: np.ndarray, grad: dict[str, np.ndarray]) -> None:
        h = self.hidden
        dstate, dcell = np.zeros(dh.shape[1:]), np.zeros(dh.shape[1:])
        back = self.params[f"back{d}"]
        for t, state, before, s, g, top in reversed(kept):
            dstate = dstate + dh[t]
            i, f, o = s[:, :h], s[:, h : 2 * h], s[:, 2 * h :]
            dcell = dcell + dstate * o * (1 - top * top)
            da = np.concatenate([dcell * g * i * (1 - i), dcell * before * f * (1 - f), dstate * top * o * (1 - o), dcell * i * (1 - g * g)], 1)
            np.add.at(grad[f"gates{d}"], x[t], da)
            grad[f"back{d}"] += state.T @ da
            dstate, dcell = da @ back.T, dcell * f

    def loss(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Negative log-likelihood for each window and its gradient; x, y: (time, batch)."""
        p, (n_t, n_b), k, h = self.params, x.shape, self.tags, self.hidden
        grad = {n: np.zeros_like(v) for n, v in p.items()}
        runs = [self._forward(x, d) for d in (0, 1)]
        hs = np.concatenate([r[0] for r in runs], 2)
        e = hs @ p["emit"] + p["bias"]
        move = p["move"]

        def logsum(a: np.ndarray, axis: int) -> np.ndarray:
            m = a.max(axis, keepdims=True)
            return np.log(np.exp(a - m).sum(axis)) + m.squeeze(axis)

        alpha, beta = np.zeros((n_t, n_b, k)), np.zeros((n_t, n_b, k))
        alpha[0] = e[0]
        for t in range(1, n_t):
            alpha[t] = e[t] + logsum(alpha[t - 1][:, :, None] + move, 1)
        for t in range(n_t - 2, -1, -1):
            beta[t] = logsum(move + (e[t + 1] + beta[t + 1])[:, None, :], 2)
        z = logsum(alpha[-1], 1)
        de = np.exp(alpha + beta - z[None, :, None])
        b = np.arange(n_b)
        gold = 0.0
        for t in range(n_t):
            de[t, b, y[t]] -= 1
            gold += e[t, b, y[t]].sum()
            if t:
                grad["move"] += np.exp(alpha[t - 1][:, :, None] + move + (e[t] + beta[t])[:, None, :] - z[:, None, None]).sum(0)
                np.subtract.at(grad["move"], (y[t - 1], y[t]), 1)
                gold += move[y[t - 1], y[t]].sum()
        grad["emit"] = np.einsum("tbh,tbk->hk", hs, de)
        grad["bias"] = de.sum((0, 1))
        dh = de @ p["emit"].T
        for d in (0, 1):
            self._backward(x, d, runs[d][1], dh[:, :, d * h : d * h + h], grad)
        return float(z.sum() - gold) / n_b, {n: g / n_b for n, g in grad.items()}

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int, batch: int = 64, rate: float = 0.02) -> list[float]:
        """Adam over windows x, y: (windows, time). Returns the mean loss of each epoch."""
        rng = np.random.Generator(np.random.PCG64(self.seed))
        m = {n: np.zeros_like(v) for n, v in self.params.items()}
        v = {n: np.zeros_like(g) for n, g in self.params.items()}
        step, told = 0, []
        for epoch in range(epochs):
            order, losses = rng.permutation(len(x)), []
            for k in range(0, len(x), batch):
                own = order[k : k + batch]
                loss, grad = self.loss(x[own].T, y[own].T)
                losses.append(loss)
                step += 1
                scale = min(1.0, 5 / max(1e-9, np.sqrt(sum((g * g).sum() for g in grad.values()))))
                pace = rate * (0.5 * (1 + np.cos(np.pi * epoch / epochs)) + 0.02)
                for n, g in grad.items():
                    m[n] = 0.9 * m[n] + 0.1 * g * scale
                    v[n] = 0.99 * v[n] + 0.01 * (g * scale) ** 2
                    self.params[n] -= pace * (m[n] / (1 - 0.9**step)) / (np.sqrt(v[n] / (1 - 0.99**step)) + 1e-8)
            told.append(float(np.mean(losses)))
        return told

    # -- reading --------------------------------------------------------------

    def ready(self) -> None:
        """Single-precision copies, a row for each gate, that need one exponential for all: with r = 1 / (1 + exp(-x)) a sigmoid is r, and the tanh of x / 2 is 2 r - 1."""
        h, p = self.hidden, self.params
        turned = np.r_[np.full(3 * h, -1.0), np.full(h, -2.0)]
        self.fast = {f"{n}{d}": np.ascontiguousarray((p[f"{n}{d}"] * turned).T, np.float32) for d in (0, 1) for n in ("gates", "back")}
        self.fast |= {"emit": np.ascontiguousarray(p["emit"].T, np.float32), "bias": p["bias"].astype(np.float32), "move": p["move"].astype(np.float32)}

    def _read(self, x: np.ndarray, d: int, out: np.ndarray) -> None:
        """Hidden states of one direction into out (time, hidden, windows)."""
        h, n = self.hidden, x.shape[1]
        gates, back = self.fast[f"gates{d}"], self.fast[f"back{d}"]
        state, cell = np.zeros((h, n), np.float32), np.zeros((h, n), np.float32)
        a, s = np.empty((4 * h, n), np.float32), np.empty((4 * h, n), np.float32)
        kept, top = np.empty((h, n), np.float32), np.empty((h, n), np.float32)
        with np.errstate(over="ignore"):  # a gate that is shut: exp is infinite, r is 0
            for t in range(len(x)) if d == 0 else range(len(x) - 1, -1, -1):
                np.take(gates, x[t], axis=1, out=a, mode="clip")
                np.matmul(back, state, out=s)
                s += a
                np.exp(s, out=s)
                s += 1
                np.reciprocal(s, out=s)
                tanh = s[3 * h :]
                tanh *= 2
                tanh -= 1
                np.multiply(s[:h], tanh, out=kept)
                cell *= s[h : 2 * h]
                cell += kept
                np.tanh(cell, out=top)
                state = out[t]
                np.multiply(s[2 * h : 3 * h], top, out=state)

    def emissions(self, x: np.ndarray) -> np.ndarray:
        """x: (time, windows). The score of each tag (time, tags, windows)."""
        h = self.hidden
        hs = np.empty((len(x), 2 * h, x.shape[1]), np.float32)
        self._read(x, 0, hs[:, :h])
        self._read(x, 1, hs[:, h:])
        e = np.matmul(self.fast["emit"], hs)
        e += self.fast["bias"][:, None]
        return e

    def gain(self) -> tuple[np.ndarray, float]:
        """Bounds of what transitions give a run of tags other than 0 over as many of tag 0: for each place, by tag, and for the run."""
        m = self.fast["move"] - self.fast["move"][0, 0]
        inside = m[1:, 1:].max(0)
        return inside, float((m[0, 1:] - inside).max() + m[1:, 0].max())


def best_path(e: np.ndarray, move: np.ndarray, length: int = 64) -> np.ndarray:
    """The tags of the best path through scores e (positions, tags), before which stands tag 0.

    The chain is cut into runs of a length. For all runs at once: the best
    score from each tag before to each last tag of a run. One pass over the
    runs finds their last tags, then all are walked at once.
    """
    n, k = e.shape
    if not n:
        return np.zeros(0, np.int8)
    parts = -(-n // length)
    rest = parts * length - n
    never = np.float32(-1e9)
    if rest:  # tag 0 behind the end changes nothing but by what leads to it, so it is free
        e = np.concatenate([e, np.zeros((rest, k), e.dtype)])
    e = np.ascontiguousarray(e.reshape(parts, length, k).transpose(1, 2, 0))
    stay = np.where(np.eye(k, dtype=bool), np.float32(0), never)
    groups = [slice(a, min(a + RUNS, parts)) for a in range(0, parts, RUNS)]

    def step(t: int, own: slice) -> np.ndarray:
        """(tag before, tag, run)."""
        out = move[:, :, None] + e[t, :, own]
        if t >= length - rest and own.stop == parts:
            out[:, :, -1] = stay
        return out

    whole = np.empty((parts, k, k), np.float32)
    for own in groups:
        held = step(0, own)
        best, ways = np.empty_like(held), np.empty_like(held)
        for t in range(1, length):
            s = step(t, own)
            np.add(held[:, 0, None], s[0], out=best)
            for m in range(1, k):
                np.add(held[:, m, None], s[m], out=ways)
                np.maximum(best, ways, out=best)
            held, best = best, held
        whole[own] = held.transpose(2, 0, 1)
    score = np.full((parts + 1, k), never, np.float64)
    score[0, 0] = 0
    for p in range(parts):
        score[p + 1] = (score[p][:, None] + whole[p]).max(0)
    last = np.zeros(parts + 1, np.int64)
    last[-1] = int(score[-1].argmax())
    for p in range(parts - 1, -1, -1):
        last[p] = int((score[p] + whole[p][:, last[p + 1]]).argmax())
    path = np.zeros((length, parts), np.int8)
    path[-1] = last[1:]
    for own in groups:
        all_ = np.arange(own.stop - own.start)
        top = step(0, own)[last[own], :, all_].T
        come = np.zeros((length, k, len(all_)), np.int8)
        for t in range(1, length):
            s, before = step(t, own), top
            top = before[0] + s[0]
            for m in range(1, k):
                way = before[m] + s[m]
                np.copyto(come[t], m, where=way > top)
                np.maximum(top, way, out=top)
        for t in range(length - 1, 0, -1):
            path[t - 1, own] = come[t][path[t, own], all_]
    return path.T.ravel()[:n]
