"""A character-level bidirectional LSTM with a CRF on top, trained and run in numpy."""

import numpy as np

#: Characters: each of ASCII by itself, then other letters, other digits, other spaces, the rest; the last pads.
VOCABULARY = 133
PAD = 132


def encode(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    other = np.flatnonzero(codes > 127)
    if len(other):
        small = np.array([128 if c.isalpha() else 129 if c.isdigit() else 130 if c.isspace() else 131 for c in map(chr, np.unique(codes[other]).tolist())])
        codes[other] = small[np.searchsorted(np.unique(codes[other]), codes[other])]
    return codes


def sigmoid(x):
    return 1 / (1 + np.exp(-x))


def log_sum(x, axis):
    top = x.max(axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis)) + np.squeeze(top, axis)


class Tagger:
    """Tags are 0 (outside), then for each kind its first and its inner character."""

    def __init__(self, kinds: int, hidden: int, seed: int):
        rng = np.random.default_rng(seed)
        self.hidden, self.tags = hidden, 1 + 2 * kinds
        h = hidden
        scale = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape).astype(np.float32)
        self.p = {}
        for d in ("f", "b"):
            self.p[f"x{d}"] = (rng.normal(0, 0.3, (VOCABULARY, 4 * h))).astype(np.float32)
            self.p[f"u{d}"] = scale(h, 4 * h)
            bias = np.zeros(4 * h, np.float32)
            bias[h : 2 * h] = 1  # remember at first
            self.p[f"c{d}"] = bias
        self.p["o"], self.p["ob"] = scale(2 * h, self.tags), np.zeros(self.tags, np.float32)
        self.p["t"] = np.zeros((self.tags, self.tags), np.float32)
        allowed = np.ones((self.tags, self.tags), bool)
        self.start = np.zeros(self.tags, np.float32)
        for k in range(kinds):
            inner = 2 + 2 * k
            allowed[:, inner] = False
            allowed[[inner - 1, inner], inner] = True
        self.barred = np.where(allowed, 0, -1e4).astype(np.float32)

    def run(self, codes, d, keep):
        """Hidden states over time (time first); ``keep`` also returns what training needs."""
        n, steps, h = codes.shape[0], codes.shape[1], self.hidden
        x, u, c0 = self.p[f"x{d}"], self.p[f"u{d}"], self.p[f"c{d}"]
        order = range(steps) if d == "f" else range(steps - 1, -1, -1)
        state, cell = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
        out, held = np.empty((steps, n, h), np.float32), {}
        for t in order:
            z = x[codes[:, t]]
            z += state @ u
            z += c0
            gate = sigmoid(z[:, : 3 * h])
            new = np.tanh(z[:, 3 * h :])
            before, last = cell, state
            cell = gate[:, h : 2 * h] * cell + gate[:, :h] * new
            squashed = np.tanh(cell)
            state = gate[:, 2 * h :] * squashed
            out[t] = state
            if keep:
                held[t] = (gate, new, before, squashed, last)
        return out, held

    def emissions(self, codes):
        f, _ = self.run(codes, "f", False)
        b, _ = self.run(codes, "b", False)
        h = self.hidden
        return f @ self.p["o"][:h] + b @ self.p["o"][h:] + self.p["ob"]

    def decode(self, codes):
        """Viterbi tags and, for each character, the probability of its tag given the whole window.

        Probabilities are only worked out for windows with any tag; elsewhere they are 1.
        """
        e = self.emissions(codes)
        steps, n, k = e.shape
        move = self.p["t"] + self.barred
        score = e[0] + self.barred[0]
        back = np.empty((steps, n, k), np.int8)
        for t in range(1, steps):
            total = score[:, :, None] + move
            back[t] = total.argmax(1)
            score = total.max(1) + e[t]
        tags = np.empty((n, steps), np.int64)
        tags[:, -1] = score.argmax(1)
        rows = np.arange(n)
        for t in range(steps - 1, 0, -1):
            tags[:, t - 1] = back[t][rows, tags[:, t]]
        sure = np.ones((n, steps))
        some = np.flatnonzero((tags > 0).any(1))
        if len(some):
            whole = self.posterior(e[:, some].astype(np.float64), move.astype(np.float64))
            sure[some] = np.take_along_axis(whole, tags[some].T[:, :, None], 2)[:, :, 0].T
        return tags, sure

    def posterior(self, e, move):
        """The probability of each tag at each time: forward times backward sums."""
        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[0] = e[0] + self.barred[0]
        for t in range(1, len(e)):
            alpha[t] = log_sum(alpha[t - 1][:, :, None] + move, 1) + e[t]
        for t in range(len(e) - 2, -1, -1):
            beta[t] = log_sum(move + (e[t + 1] + beta[t + 1])[:, None, :], 2)
        return np.exp(alpha + beta - log_sum(alpha[-1], 1)[None, :, None])

    def step(self, codes, tags, rate, moments, count):
        """One Adam step on the CRF's negative log-likelihood; returns the loss for each character."""
        n, steps, h, p = codes.shape[0], codes.shape[1], self.hidden, self.p
        f, kept_f = self.run(codes, "f", True)
        b, kept_b = self.run(codes, "b", True)
        e = (f @ p["o"][:h] + b @ p["o"][h:] + p["ob"]).astype(np.float64)
        move = (p["t"] + self.barred).astype(np.float64)

        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[0] = e[0] + self.barred[0]
        for t in range(1, steps):
            alpha[t] = log_sum(alpha[t - 1][:, :, None] + move, 1) + e[t]
        for t in range(steps - 2, -1, -1):
            beta[t] = log_sum(move + (e[t + 1] + beta[t + 1])[:, None, :], 2)
        whole = log_sum(alpha[-1], 1)
        grad_e = np.exp(alpha + beta - whole[None, :, None])
        pairs = np.exp(alpha[:-1, :, :, None] + move + (e[1:] + beta[1:])[:, :, None, :] - whole[None, :, None, None]).sum((0, 1))
        rows, times = np.arange(n), np.arange(steps)
        gold = e[times[:, None], rows, tags.T].sum(0) + move[tags[:, :-1], tags[:, 1:]].sum(1)
        loss = float((whole - gold).sum()) / (n * steps)
        grad_e[times[:, None], rows, tags.T] -= 1
        np.subtract.at(pairs, (tags[:, :-1], tags[:, 1:]), 1)
        grad_e = (grad_e / n).astype(np.float32)
        g = {"t": (pairs / n).astype(np.float32), "ob": grad_e.sum((0, 1))}
        flat = grad_e.reshape(-1, self.tags)
        g["o"] = np.vstack([f.reshape(-1, h).T @ flat, b.reshape(-1, h).T @ flat])
        for d, held, part in (("f", kept_f, p["o"][:h]), ("b", kept_b, p["o"][h:])):
            u = p[f"u{d}"]
            gx, gu, gc = np.zeros_like(p[f"x{d}"]), np.zeros_like(u), np.zeros(4 * h, np.float32)
            dh, dc = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
            for t in range(steps - 1, -1, -1) if d == "f" else range(steps):
                gate, new, before, squashed, last = held[t]
                dh = dh + grad_e[t] @ part.T
                i, fo, o = gate[:, :h], gate[:, h : 2 * h], gate[:, 2 * h :]
                dc = dc + dh * o * (1 - squashed**2)
                dz = np.hstack([dc * new * i * (1 - i), dc * before * fo * (1 - fo), dh * squashed * o * (1 - o), dc * i * (1 - new**2)])
                np.add.at(gx, codes[:, t], dz)
                gu += last.T @ dz
                gc += dz.sum(0)
                dh, dc = dz @ u.T, dc * fo
            g[f"x{d}"], g[f"u{d}"], g[f"c{d}"] = gx, gu, gc
        norm = np.sqrt(sum(float((v**2).sum()) for v in g.values()))
        for k, v in g.items():
            v = v * min(1.0, 5.0 / max(norm, 1e-9))
            m, s = moments.setdefault(k, (np.zeros_like(v), np.zeros_like(v)))
            m, s = 0.9 * m + 0.1 * v, 0.99 * s + 0.01 * v**2
            moments[k] = (m, s)
            p[k] = (p[k] - rate * (m / (1 - 0.9**count)) / (np.sqrt(s / (1 - 0.99**count)) + 1e-7)).astype(np.float32)
        return loss


def fit(examples: list, kinds: list, hidden: int, length: int, steps: int, seed: int, batch: int = 64) -> Tagger:
    """``examples``: (text, spans) with spans (kind, start, end) inside the text of at most ``length`` characters."""
    codes = np.full((len(examples), length), PAD, np.int64)
    tags = np.zeros((len(examples), length), np.int64)
    for row, (text, spans) in enumerate(examples):
        part = encode(text)[:length]
        codes[row, : len(part)] = part
        for kind, a, b in spans:
            first = 1 + 2 * kinds.index(kind)
            tags[row, a : min(b, length)] = first + 1
            if 0 <= a < length:
                tags[row, a] = first
    tagger, rng, moments = Tagger(len(kinds), hidden, seed), np.random.default_rng(seed), {}
    for k in range(1, steps + 1):
        pick = rng.integers(0, len(examples), min(batch, len(examples)))
        tagger.step(codes[pick], tags[pick], 0.02 * min(1.0, 2 * (1 - k / (steps + 1))), moments, k)
    return tagger
