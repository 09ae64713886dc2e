"""A bidirectional gated recurrent network with attention pooling, in numpy.

Inputs are words: a learned vector for each word of a bounded vocabulary, plus
the mean of learned vectors of the word's character trigrams, so that unknown
spellings have an input too. The states of both directions are pooled by
attention into one logit a window.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from nearsieve.llm.words import Words, mix

TRIGRAMS = 4096


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + np.float32(0.5)


@dataclass
class Text:
    """Distinct words of a batch: ids in the vocabulary, trigram rows, and each word's index among them."""

    at: np.ndarray  # for each word of the batch, its distinct word
    known: np.ndarray  # for each distinct word, its vocabulary row (0: unknown)
    trigrams: np.ndarray  # rows of all trigrams, distinct word by distinct word
    first: np.ndarray  # where each distinct word's trigrams begin

    def only(self, words: np.ndarray) -> tuple[Text, np.ndarray]:
        """The distinct words of these words of the batch alone, and each one's index among them."""
        sub, at = np.unique(self.at[words], return_inverse=True)
        size = np.diff(np.append(self.first, len(self.trigrams)))[sub]
        first = np.concatenate([[0], np.cumsum(size)[:-1]]) if len(size) else size
        take = np.repeat(self.first[sub] - first, size) + np.arange(size.sum())
        return Text(np.arange(len(sub)), self.known[sub], self.trigrams[take], first), at


def distinct(words: Words, vocabulary: np.ndarray) -> Text:
    """``vocabulary``: sorted hashes; row i + 1 belongs to entry i."""
    hashes, one, at = np.unique(words.hash, return_index=True, return_inverse=True)
    place = np.minimum(np.searchsorted(vocabulary, hashes), max(len(vocabulary) - 1, 0))
    known = np.where(vocabulary[place] == hashes, place + 1, 0) if len(vocabulary) else np.zeros(len(hashes), np.int64)
    start, size = words.start[one], words.end[one] - words.start[one]
    first = np.cumsum(size) - size
    rows = np.empty(int(size.sum()), np.int32)
    for low in range(0, len(size), 1 << 14):  # a slice of words at a time, for memory
        part = slice(low, low + (1 << 14))
        begin, n = np.repeat(start[part], size[part]), int(first[low])
        ends = np.repeat(start[part] + size[part], size[part])
        pos = np.arange(len(begin)) + n - np.repeat(first[part], size[part]) + begin
        here = words.data[pos].astype(np.uint64)
        left = np.where(pos == begin, 1, words.data[pos - 1]).astype(np.uint64)
        right = np.where(pos + 1 == ends, 2, words.data[np.minimum(pos + 1, len(words.data) - 1)]).astype(np.uint64)
        rows[n : n + len(pos)] = mix(left << np.uint64(16) | here << np.uint64(8) | right) % np.uint64(TRIGRAMS)
    return Text(at.astype(np.int32), known.astype(np.int32), rows, first)


@dataclass
class Network:
    words: int
    inputs: int = 16
    hidden: int = 12
    attention: int = 8
    seed: int = 3
    p: dict[str, np.ndarray] = field(default_factory=dict)

    def __post_init__(self):
        r, e, h, a = np.random.default_rng(self.seed), self.inputs, self.hidden, self.attention
        new = lambda *shape, scale: (r.standard_normal(shape) * scale).astype(np.float32)
        self.p = {"word": np.zeros((self.words + 1, e), np.float32), "char": new(TRIGRAMS, e, scale=0.5)}
        for d in "fb":
            self.p |= {f"W{d}": new(e, 3 * h, scale=e**-0.5), f"c{d}": np.zeros(3 * h, np.float32), f"U{d}": new(h, 3 * h, scale=h**-0.5)}
        self.p |= {"A": new(2 * h, a, scale=(2 * h) ** -0.5), "a": np.zeros(a, np.float32), "v": new(a, scale=a**-0.5), "w": new(2 * h, scale=(2 * h) ** -0.5), "o": np.zeros(1, np.float32)}

    def embed(self, text: Text) -> np.ndarray:
        """Input vectors of distinct words."""
        if not len(text.known):
            return np.zeros((0, self.inputs), np.float32)
        size = np.diff(np.append(text.first, len(text.trigrams)))
        return self.p["word"][text.known] + np.add.reduceat(self.p["char"][text.trigrams], text.first, axis=0) / size[:, None].astype(np.float32)

    def _run(self, gates: np.ndarray, mask: np.ndarray, u: np.ndarray, backward: bool, keep: bool):
        """gates: (T, B, 3H) without the recurrent part; mask: (T, B, 1)."""
        steps, batch, _ = gates.shape
        h, hid = np.zeros((batch, self.hidden), np.float32), self.hidden
        states, saved = np.empty((steps, batch, hid), np.float32), []
        for t in range(steps - 1, -1, -1) if backward else range(steps):
            g = h @ u
            zr = sigmoid(gates[t, :, : 2 * hid] + g[:, : 2 * hid])
            z, r = zr[:, :hid], zr[:, hid:]
            n = np.tanh(gates[t, :, 2 * hid :] + r * g[:, 2 * hid :])
            new = h + mask[t] * (1 - z) * (n - h)
            if keep:
                saved.append((t, h, z, r, n, g[:, 2 * hid :]))
            states[t] = h = new
        return states, saved

    def forward(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Logits of windows. x: (T, B, 6H) gates of both directions; mask: (T, B, 1)."""
        p, h3 = self.p, 3 * self.hidden
        forth, one = self._run(x[:, :, :h3], mask, p["Uf"], False, keep)
        back, two = self._run(x[:, :, h3:], mask, p["Ub"], True, keep)
        s = np.concatenate([forth, back], axis=2)
        q = np.tanh(s @ p["A"] + p["a"])
        score = q @ p["v"] + np.where(mask[:, :, 0] > 0, 0, -1e9).astype(np.float32)
        score = np.exp(score - score.max(axis=0))
        alpha = score / score.sum(axis=0)
        pooled = np.einsum("tb,tbh->bh", alpha, s)
        return pooled @ p["w"] + p["o"][0], (s, q, alpha, pooled, one, two)

    def gates(self, vectors: np.ndarray) -> np.ndarray:
        p = self.p
        return np.concatenate([vectors @ p["Wf"] + p["cf"], vectors @ p["Wb"] + p["cb"]], axis=1)

    def logits(self, text: Text, windows: np.ndarray, batch: int = 2048) -> np.ndarray:
        """windows: (N, T) indices into the batch's words, -1 where a window is shorter."""
        out = np.empty(len(windows), np.float32)
        for i in range(0, len(windows), batch):
            part = windows[i : i + batch].T
            inside = part >= 0
            own, at = text.only(part[inside])
            table = np.zeros((len(own.known) + 1, 6 * self.hidden), np.float32)
            table[:-1] = self.gates(self.embed(own))
            word = np.full(part.shape, len(own.known), np.int32)
            word[inside] = at
            out[i : i + batch] = self.forward(table[word], inside[:, :, None].astype(np.float32))[0]
        return out

    def gradients(self, text: Text, windows: np.ndarray, y: np.ndarray, drop: np.ndarray) -> tuple[float, dict]:
        """Mean logistic loss and its gradients; ``drop`` marks distinct words whose own vector is left out."""
        p, hid = self.p, self.hidden
        known = np.where(drop, 0, text.known)
        text = Text(text.at, known, text.trigrams, text.first)
        vectors = self.embed(text)
        part = windows.T
        valid = part >= 0
        word = np.where(valid, text.at[part], 0)
        x, mask = vectors[word] * valid[:, :, None], valid[:, :, None].astype(np.float32)
        gates = self.gates(x.reshape(-1, self.inputs)).reshape(*word.shape, -1)
        logit, (s, q, alpha, pooled, one, two) = self.forward(gates, mask, keep=True)
        prob = 1 / (1 + np.exp(-logit))
        loss = float(-np.mean(y * np.log(prob + 1e-7) + (1 - y) * np.log(1 - prob + 1e-7)))
        d = ((prob - y) / len(y)).astype(np.float32)
        g = {"w": pooled.T @ d, "o": d.sum(keepdims=True)}
        d_pool = d[:, None] * p["w"]
        d_alpha = np.einsum("bh,tbh->tb", d_pool, s)
        ds = alpha[:, :, None] * d_pool
        d_score = alpha * (d_alpha - (alpha * d_alpha).sum(axis=0))
        g["v"] = np.einsum("tb,tba->a", d_score, q)
        dq = d_score[:, :, None] * p["v"] * (1 - q * q)
        g["a"] = dq.sum(axis=(0, 1))
        g["A"] = s.reshape(-1, 2 * hid).T @ dq.reshape(-1, dq.shape[2])
        ds = ds + dq @ p["A"].T
        dx = np.zeros((*word.shape, self.inputs), np.float32)
        for name, saved, side in (("f", one, ds[:, :, :hid]), ("b", two, ds[:, :, hid:])):
            u = p[f"U{name}"]
            dg, du, dh = np.zeros((*word.shape, 3 * hid), np.float32), np.zeros_like(u), np.zeros((word.shape[1], hid), np.float32)
            for t, h, z, r, n, gn in reversed(saved):
                dh = dh + side[t]
                step = mask[t] * dh
                dz, dn = step * (h - n) * z * (1 - z), step * (1 - z) * (1 - n * n)
                dr = dn * gn * r * (1 - r)
                dg[t] = np.concatenate([dz, dr, dn], axis=1)
                rec = np.concatenate([dz, dr, dn * r], axis=1)
                du += h.T @ rec
                dh = dh - step * (1 - z) + rec @ u.T
            flat = dg.reshape(-1, 3 * hid)
            g |= {f"U{name}": du, f"W{name}": x.reshape(-1, self.inputs).T @ flat, f"c{name}": flat.sum(axis=0)}
            dx += (flat @ p[f"W{name}"].T).reshape(dx.shape)
        each = np.zeros_like(vectors)
        np.add.at(each, word[valid], dx[valid])
        size = np.diff(np.append(text.first, len(text.trigrams)))
        used = np.flatnonzero(np.abs(each).sum(axis=1))
        g["word"] = (known[used], each[used])
        spread = np.zeros(len(size), bool)
        spread[used] = True
        g["char"] = (text.trigrams[np.repeat(spread, size)], np.repeat(each[used] / size[used, None], size[used], axis=0))
        return loss, g


class Adam:
    """Adam for dense parameters, Adagrad for rows of tables."""

    def __init__(self, net: Network, rate: float = 4e-3, rows: float = 0.08):
        self.net, self.rate, self.rows, self.n = net, rate, rows, 0
        self.m = {k: np.zeros_like(v) for k, v in net.p.items()}
        self.v = {k: np.zeros_like(v) for k, v in net.p.items()}

    def step(self, g: dict) -> None:
        self.n += 1
        for k, d in g.items():
            if isinstance(d, tuple):
                row, inverse = np.unique(d[0], return_inverse=True)
                total = np.zeros((len(row), d[1].shape[1]), np.float32)
                np.add.at(total, inverse, d[1])
                self.v[k][row] += total**2
                self.net.p[k][row] -= self.rows * total / (np.sqrt(self.v[k][row]) + 1e-6)
            else:
                self.m[k] = 0.9 * self.m[k] + 0.1 * d
                self.v[k] = 0.999 * self.v[k] + 0.001 * d * d
                self.net.p[k] = (self.net.p[k] - self.rate * (self.m[k] / (1 - 0.9**self.n)) / (np.sqrt(self.v[k] / (1 - 0.999**self.n)) + 1e-8)).astype(np.float32)
