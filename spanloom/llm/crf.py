"""A linear-chain conditional random field over hashed features, in numpy."""

from __future__ import annotations

import io

import numpy as np


class Chain:
    """Weights of hashed features (2**bits rows), transitions and starts over `labels` labels.

    A sequence is an (n, f) array of feature rows. Sequences are trained and decoded in padded batches.
    """

    def __init__(self, labels: int, bits: int = 18):
        self.labels, self.bits = labels, bits
        self.w = np.zeros((1 << bits, labels), np.float32)
        self.t = np.zeros((labels, labels), np.float32)
        self.s = np.zeros(labels, np.float32)

    def dump(self) -> bytes:
        f = io.BytesIO()
        used = np.flatnonzero(np.abs(self.w).sum(axis=1) > 1e-4)
        np.savez_compressed(f, used=used.astype(np.int32), w=self.w[used].astype(np.float16), t=self.t, s=self.s, bits=self.bits)
        return f.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Chain:
        z = np.load(io.BytesIO(data))
        c = cls(len(z["s"]), int(z["bits"]))
        c.w[z["used"]] = z["w"].astype(np.float32)
        c.t, c.s = z["t"], z["s"]
        return c

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Emission scores (n, labels) of the feature rows x (n, f)."""
        e = np.zeros((len(x), self.labels), np.float32)
        for j in range(x.shape[1]):
            e += self.w[x[:, j]]
        return e

    def packed(self) -> tuple[np.ndarray, np.ndarray]:
        """The place of each row among those that aren't zero (0: a row of zeros), and the weights by place."""
        if getattr(self, "_packed", None) is None:
            used = np.flatnonzero(self.w.any(axis=1))
            place = np.zeros(len(self.w), np.int32)
            place[used] = np.arange(1, len(used) + 1)
            self._packed = place, np.concatenate([np.zeros((1, self.labels), np.float32), self.w[used]])
        return self._packed

    def _padded(self, e: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(time, batch, labels) emissions of sequences laid end to end, and the flat places (time, batch), -1 for none."""
        n, b = int(lengths.max()), len(lengths)
        at = np.full((n, b), -1, np.int64)
        first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        t = np.arange(n)[:, None]
        live = t < lengths[None, :]
        at[live] = (first[None, :] + t)[live]
        return e[np.maximum(at, 0)], at

    def marginals(self, e: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Label marginals (n, labels), expected transitions and starts of the batch, by scaled forward-backward."""
        p, at = self._padded(e, lengths)
        live = at >= 0
        p = np.exp(p - p.max(axis=2, keepdims=True))
        tr, n, b = np.exp(self.t), *live.shape
        alpha, beta, c = np.empty_like(p), np.ones_like(p), np.ones((n, b, 1), np.float32)
        a = np.exp(self.s - self.s.max())[None] * p[0]
        for i in range(n):
            if i:
                a = (alpha[i - 1] @ tr) * p[i]
            c[i] = a.sum(axis=1, keepdims=True)
            a = a / c[i]
            alpha[i] = np.where(live[i][:, None], a, alpha[i - 1] if i else a)
        for i in range(n - 2, -1, -1):
            nxt = ((p[i + 1] * beta[i + 1]) @ tr.T) / c[i + 1]
            beta[i] = np.where(live[i + 1][:, None], nxt, 1)
        g = alpha * beta
        g /= g.sum(axis=2, keepdims=True)
        right = np.where(live[1:, :, None], p[1:] * beta[1:] / c[1:], 0)
        pairs = (alpha[:-1].reshape(-1, self.labels).T @ right.reshape(-1, self.labels)) * tr
        out = np.empty((len(e), self.labels), np.float32)
        out[at[live]] = g[live]
        return out, pairs, g[0].sum(axis=0)

    def viterbi(self, e: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The best label path of each sequence, laid end to end."""
        if not len(e):
            return np.zeros(0, np.int8)
        order = np.argsort(-lengths, kind="stable")
        first = np.concatenate([[0], np.cumsum(lengths)[:-1]])[order]
        sizes = lengths[order]
        n = int(sizes[0])
        live = np.searchsorted(-sizes, -np.arange(n), side="left")  # sequences longer than i
        back = np.zeros((len(e), self.labels), np.int8)
        d = self.s[None] + e[first[: live[0]]]
        ends = np.empty((len(sizes), self.labels), np.float32)
        into = np.ascontiguousarray(self.t.T)  # (to, from)
        row = np.arange(len(sizes) * self.labels) * self.labels
        for i in range(1, n):
            k = live[i]
            ends[k : len(d)] = d[k:]
            m = (d[:k, None, :] + into).reshape(-1, self.labels)
            best = m.argmax(axis=1)
            at = first[:k] + i
            back[at] = best.reshape(k, -1)
            d = m.ravel()[row[: len(m)] + best].reshape(k, -1) + e[at]
        ends[: len(d)] = d
        out = np.zeros(len(e), np.int8)
        y = np.zeros(len(sizes), np.int64)
        for i in range(n - 1, -1, -1):
            k = live[i]
            done = live[i + 1] if i + 1 < n else 0
            y[done:k] = ends[done:k].argmax(axis=1)
            if done:
                y[:done] = back[first[:done] + i + 1, y[:done]]
            out[first[:k] + i] = y[:k]
        return out

    def train(self, xs: list[np.ndarray], ys: list[np.ndarray], epochs: int = 6, batch_tokens: int = 9000, rate: float = 0.1, decay: float = 1e-2, seed: int = 7, seen: int = 20) -> Chain:
        """Penalised maximum likelihood by AdaGrad over batches of sequences of like length; deterministic for a seed.

        Features of fewer than `seen` tokens keep the weight 0: they would only learn the noise of the labels. The others
        are numbered on, so that their weights lie close together.
        """
        count = np.zeros(1 << self.bits, np.int64)
        for x in xs:
            count += np.bincount(x.ravel(), minlength=len(count))
        used = np.flatnonzero(count >= seen)
        place = np.zeros(1 << self.bits, np.int32)
        place[used] = np.arange(1, len(used) + 1)
        w = np.concatenate([np.zeros((1, self.labels), np.float32), self.w[used]])
        order = sorted((i for i in range(len(xs)) if len(xs[i])), key=lambda i: (len(xs[i]), i))
        batches: list[list[int]] = []
        for i in order:
            if not batches or (len(batches[-1]) + 1) * len(xs[i]) > batch_tokens:
                batches.append([])
            batches[-1].append(i)
        gw, gt, gs = np.full((len(w), 1), 1e-6, np.float32), np.full_like(self.t, 1e-6), np.full_like(self.s, 1e-6)
        rng = np.random.default_rng(seed)
        kept = []
        for b in batches:
            x = place[np.concatenate([xs[i] for i in b])]
            y = np.concatenate([ys[i] for i in b]).astype(np.int64)
            flat = x.ravel()
            live = np.flatnonzero(flat)
            by = live[np.argsort(flat[live], kind="stable")]
            rows, start = np.unique(flat[by], return_index=True)
            kept.append((np.ascontiguousarray(x.T), y, np.array([len(xs[i]) for i in b]), (by // x.shape[1]).astype(np.int32), rows, start))
        for _ in range(epochs):
            for b in rng.permutation(len(kept)):
                x, y, lengths, token, rows, start = kept[b]
                e = np.zeros((len(y), self.labels), np.float32)
                part = np.empty_like(e)
                for column in x:
                    e += np.take(w, column, axis=0, out=part, mode="clip")
                m, pairs, starts = self.marginals(e, lengths)
                m[np.arange(len(y)), y] -= 1
                first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
                inner = np.ones(len(y), bool)
                inner[first] = False
                k = np.flatnonzero(inner)
                np.add.at(pairs, (y[k - 1], y[k]), -1)
                np.add.at(starts, y[first], -1)
                if not len(rows):
                    continue
                g = np.add.reduceat(np.take(m, token, axis=0, mode="clip"), start, axis=0) + decay * len(lengths) * w[rows]
                gw[rows] += (g * g).mean(axis=1, keepdims=True)
                w[rows] -= rate * g / np.sqrt(gw[rows])
                gt += pairs * pairs
                self.t -= rate * pairs / np.sqrt(gt)
                gs += starts * starts
                self.s -= rate * starts / np.sqrt(gs)
        self.w[used] = w[1:]
        return self
