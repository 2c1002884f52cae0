"""A character-level bidirectional LSTM with a linear-chain CRF on top, in numpy."""

from __future__ import annotations

import numpy as np


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


class BiLstmCrf:
    """Symbols (batch, length) to tags; every row is a window of one length."""

    def __init__(self, symbols: int, tags: int, hidden: int = 16, seed: int = 3, kind: type = np.float64):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
        self.hidden, self.tags = hidden, tags
        self.p: dict[str, np.ndarray] = {"out": draw(2 * hidden, tags), "bias": np.zeros(tags), "move": np.zeros((tags, tags)), "start": np.zeros(tags)}
        # Both directions side by side: the second reads the window from its end.
        self.p |= {"x": rng.normal(0, 0.3, (2, symbols, 4 * hidden)), "h": np.stack([draw(hidden, 4 * hidden), draw(hidden, 4 * hidden)]), "b": np.zeros((2, 1, 4 * hidden))}
        self.p["b"][:, :, hidden : 2 * hidden] = 1.0  # remember at first
        self.p = {k: a.astype(kind) for k, a in self.p.items()}

    def _run(self, x: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
        """Hidden states (length, batch, both directions' units), and what the gradient needs."""
        n, size, length = self.hidden, len(x), x.shape[1]
        wh, b = self.p["h"], self.p["b"]
        both = np.stack([x, x[:, ::-1]])
        fed = np.stack([w[s] for w, s in zip(self.p["x"], both)]) + b[:, :, None, :]  # direction, batch, step, gates
        h = c = np.zeros((2, size, n), wh.dtype)
        out, tape = np.empty((length, size, 2 * n), wh.dtype), []
        for t in range(length):
            z = fed[:, :, t] + h @ wh
            g = _sigmoid(z[:, :, : 3 * n])
            i, f, o, u = g[:, :, :n], g[:, :, n : 2 * n], g[:, :, 2 * n :], np.tanh(z[:, :, 3 * n :])
            c_new = f * c + i * u
            tanh_c = np.tanh(c_new)
            if keep:
                tape.append((h, c, i, f, o, u, tanh_c))
            h, c = o * tanh_c, c_new
            out[t, :, :n], out[length - 1 - t, :, n:] = h
        return out, tape

    def emissions(self, x: np.ndarray) -> np.ndarray:
        """(length, batch, tags)"""
        return self._run(x, False)[0] @ self.p["out"] + self.p["bias"]

    def _back(self, x: np.ndarray, tape: list, dout: np.ndarray, grad: dict) -> None:
        n, length = self.hidden, len(tape)
        back = self.p["h"].transpose(0, 2, 1)
        all_, before = (np.empty((2, length, len(x), k), dout.dtype) for k in (4 * n, n))
        dh = dc = np.zeros((2, len(x), n), dout.dtype)
        for t in range(length - 1, -1, -1):
            h, c, i, f, o, u, tanh_c = tape[t]
            dh = dh + np.stack([dout[t, :, :n], dout[length - 1 - t, :, n:]])
            dc = dc + dh * o * (1 - tanh_c**2)
            dz = np.concatenate([dc * u * i * (1 - i), dc * c * f * (1 - f), dh * tanh_c * o * (1 - o), dc * i * (1 - u**2)], axis=2)
            all_[:, t], before[:, t] = dz, h
            dh, dc = dz @ back, dc * f
        flat = all_.reshape(2, -1, 4 * n)
        symbol = np.stack([x.T, x[:, ::-1].T]).reshape(2, -1)
        known = np.eye(self.p["x"].shape[1], dtype=dout.dtype)
        grad["x"] = np.stack([known[s].T @ d for s, d in zip(symbol, flat)])
        grad["h"] = before.reshape(2, -1, n).transpose(0, 2, 1) @ flat
        grad["b"] = flat.sum(axis=1, keepdims=True)

    def loss(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood of the tag rows y, and its gradient."""
        size, length = x.shape
        both, tape = self._run(x, True)
        e = both @ self.p["out"] + self.p["bias"]
        move = self.p["move"]
        step = np.exp(move)
        # Forward and backward sums, each row over its largest, with the logarithms of what was taken out.
        top = e.max(axis=2)
        shown = np.exp(e - top[:, :, None])
        alpha, beta = np.empty_like(e), np.ones_like(e)
        taken = np.zeros((length, size))
        row = shown[0] * np.exp(self.p["start"])
        for t in range(length):
            if t:
                row = shown[t] * (row @ step)
            scale = row.sum(axis=1)
            alpha[t] = row = row / scale[:, None]
            taken[t] = np.log(scale)
        for t in range(length - 2, -1, -1):
            row = (shown[t + 1] * beta[t + 1]) @ step.T
            scale = row.sum(axis=1)
            beta[t] = row / scale[:, None]
        total = taken.sum(axis=0) + top.sum(axis=0)
        rows = np.arange(size)
        gold = self.p["start"][y[:, 0]] + np.take_along_axis(e, y.T[:, :, None], axis=2)[:, :, 0].sum(axis=0) + move[y[:, :-1], y[:, 1:]].sum(axis=1)
        de = alpha * beta
        de /= de.sum(axis=2, keepdims=True)
        after = shown[1:] * beta[1:]
        after = after / ((alpha[:-1] @ step) * after).sum(axis=2, keepdims=True)
        g_move = np.tensordot(alpha[:-1], after, ([0, 1], [0, 1])) * step
        np.subtract.at(g_move, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
        de[np.arange(length)[:, None], rows[None, :], y.T] -= 1
        grad = {"move": g_move, "start": de[0].sum(axis=0), "bias": de.sum(axis=(0, 1)), "out": np.tensordot(both, de, ([0, 1], [0, 1]))}
        self._back(x, tape, de @ self.p["out"].T, grad)
        return float((total - gold).mean()), {k: v / size for k, v in grad.items()}

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 10, batch: int = 64, rate: float = 0.02, seed: int = 5) -> list[float]:
        """Adam; the mean loss of each epoch."""
        rng = np.random.default_rng(seed)
        m, v = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2))
        losses, step = [], 0
        for epoch in range(epochs):
            order, total = rng.permutation(len(x)), 0.0
            for a in range(0, len(x), batch):
                part = order[a : a + batch]
                loss, grad = self.loss(x[part], y[part])
                total += loss * len(part)
                step += 1
                norm = np.sqrt(sum(float((g**2).sum()) for g in grad.values()))
                scale = min(1.0, 5.0 / max(norm, 1e-9))
                speed = rate * 0.5 ** (3 * epoch / max(1, epochs))
                for k, g in grad.items():
                    g = g * scale
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.99 * v[k] + 0.01 * g * g
                    self.p[k] = (self.p[k] - speed * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(self.p[k].dtype)
            losses.append(total / max(1, len(x)))
        return losses

    def decode(self, x: np.ndarray) -> np.ndarray:
        """Best tag rows of the windows, each by itself."""
        e = self.emissions(x).transpose(1, 0, 2)
        return self.best(e.reshape(-1, self.tags), np.full(len(x), x.shape[1])).reshape(len(x), -1)

    def best(self, emissions: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Best tags (Viterbi) of sequences of these lengths, whose emissions (rows, tags) lie one after the other."""
        out = np.zeros(len(emissions), np.int64)
        lengths = np.asarray(lengths, np.int64)
        begins = np.cumsum(lengths) - lengths
        order = np.argsort(-lengths, kind="stable")
        begins, lengths = begins[order], lengths[order]
        if not len(lengths) or not lengths[0]:
            return out
        active = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")  # sequences longer than t
        back = np.zeros((len(emissions), self.tags), np.int8)
        move = self.p["move"].T[None]  # to, from
        score = emissions[begins[: active[0]]] + self.p["start"]
        for t in range(1, lengths[0]):
            m = active[t]
            ended = slice(m, active[t - 1])
            out[begins[ended] + t - 1] = score[m:].argmax(axis=1)
            at = begins[:m] + t
            step = score[:m, None, :] + move
            back[at] = step.argmax(axis=2)
            score = step.max(axis=2) + emissions[at]
        out[begins[: active[-1]] + lengths[0] - 1] = score.argmax(axis=1)
        for t in range(lengths[0] - 1, 0, -1):
            at = begins[: active[t]] + t
            out[at - 1] = back[at, out[at]]
        return out
