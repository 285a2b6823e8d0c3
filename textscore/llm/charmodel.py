"""A character-level bidirectional LSTM with CRF transitions, in numpy.

Symbols are ASCII characters and one symbol for all others. Tags are O and B-/I- of each kind. The
input weights of a symbol are a row of a table, so the embedding costs a lookup. Windows are
processed in batches; `fit` is full back-propagation through time with Adam.
"""

import numpy as np

SYMBOLS = 129
PAD = 128


def encode(text):
    """Symbol numbers of a text: code points below 128 as they are, all others one symbol."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.minimum(points, PAD).astype(np.int16)


def tag_names(kinds):
    return ["O", *(f"{p}-{k}" for k in kinds for p in "BI")]


def allowed(tags):
    """allowed[a, b]: tag b may follow tag a (I- only after B- or I- of its kind)."""
    ok = np.ones((len(tags), len(tags)), bool)
    for j, b in enumerate(tags):
        if b[0] == "I":
            ok[:, j] = [a[1:] == b[1:] for a in tags]
    return ok


def _sigmoid(z):
    return 1 / (1 + np.exp(-z))


class Model:
    def __init__(self, kinds, hidden=24, seed=5):
        rng = np.random.default_rng(seed)
        self.tags, self.hidden = tag_names(kinds), hidden
        n = len(self.tags)
        small = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
        self.p = {"out": small(2 * hidden, n), "bias": np.zeros(n, np.float32),
                  "trans": np.zeros((n, n), np.float32), "start": np.zeros(n, np.float32)}
        for side in "fb":
            self.p[f"in_{side}"] = small(SYMBOLS, 4 * hidden)
            self.p[f"in_{side}"][:, hidden:2 * hidden] += 0.5          # remember at first
            self.p[f"rec_{side}"] = small(hidden, 4 * hidden)
        self.forbidden = np.where(allowed(self.tags), 0, -1e4).astype(np.float32)

    def _run(self, x, side, keep=False):
        """Hidden states [length, rows, hidden] of one direction, and what back-propagation needs."""
        table, rec, h = self.p[f"in_{side}"], self.p[f"rec_{side}"], self.hidden
        length, rows = x.shape
        out = np.zeros((length, rows, h), np.float32)
        state = cell = np.zeros((rows, h), np.float32)
        saved = []
        for t in range(length) if side == "f" else range(length - 1, -1, -1):
            z = table[x[t]] + state @ rec
            gates, g = _sigmoid(z[:, :3 * h]), np.tanh(z[:, 3 * h:])
            i, f, o = gates[:, :h], gates[:, h:2 * h], gates[:, 2 * h:]
            before, cell = cell, f * cell + i * g
            squashed = np.tanh(cell)
            if keep:
                saved.append((t, state, before, i, f, o, g, squashed))
            state = o * squashed
            out[t] = state
        return out, saved

    def emissions(self, x, keep=False):
        f, sf = self._run(x, "f", keep)
        b, sb = self._run(x, "b", keep)
        both = np.concatenate([f, b], 2)
        return both @ self.p["out"] + self.p["bias"], both, sf, sb

    def _scores(self):
        # A window may open inside a span, so any tag may come first.
        return self.p["trans"] + self.forbidden, self.p["start"]

    def _sums(self, e):
        """Log alphas and betas [length, rows, tags], and log Z per row."""
        trans, start = self._scores()
        a, b = np.zeros_like(e), np.zeros_like(e)
        grown = np.exp(trans)

        def step(v, m):                                  # log(exp(v) @ m), kept in range
            top = v.max(1, keepdims=True)
            return np.log(np.maximum(np.exp(v - top) @ m, 1e-30)) + top

        a[0] = e[0] + start
        for t in range(1, len(e)):
            a[t] = step(a[t - 1], grown) + e[t]
        for t in range(len(e) - 2, -1, -1):
            b[t] = step(b[t + 1] + e[t + 1], grown.T)
        top = a[-1].max(1)
        return a, b, top + np.log(np.exp(a[-1] - top[:, None]).sum(1))

    def decode(self, x):
        """Best tags and their marginal probabilities, both [length, rows]."""
        e = self.emissions(x)[0]
        trans, start = self._scores()
        best, back = e[0] + start, np.zeros(e.shape, np.int8)
        for t in range(1, len(e)):
            options = best[:, :, None] + trans
            back[t] = options.argmax(1)
            best = options.max(1) + e[t]
        tags = np.zeros(x.shape, np.int8)
        tags[-1] = best.argmax(1)
        for t in range(len(e) - 1, 0, -1):
            tags[t - 1] = np.take_along_axis(back[t], tags[t][:, None].astype(int), 1)[:, 0]
        a, b, z = self._sums(e)
        chance = np.exp(np.take_along_axis(a + b, tags[:, :, None].astype(int), 2)[:, :, 0] - z)
        return tags, chance

    def gradients(self, x, y):
        """Mean loss per row and its gradients."""
        e, both, sf, sb = self.emissions(x, keep=True)
        length, rows = x.shape
        trans, start = self._scores()
        a, b, z = self._sums(e)
        marginal = np.exp(a + b - z[None, :, None])
        eye = np.eye(len(self.tags), dtype=np.float32)
        wanted = eye[y]
        d_e = (marginal - wanted) / rows
        pair = np.zeros_like(trans)
        for t in range(1, length):
            joint = (a[t - 1] - z[:, None])[:, :, None] + trans + (b[t] + e[t])[:, None, :]
            pair += np.exp(joint).sum(0)
        np.add.at(pair, (y[:-1].ravel(), y[1:].ravel()), -1)
        gold = (np.take_along_axis(e, y[:, :, None], 2).sum((0, 2)) + start[y[0]]
                + trans[y[:-1], y[1:]].sum(0))
        g = {"trans": pair / rows, "start": d_e[0].sum(0), "bias": d_e.sum((0, 1)),
             "out": both.reshape(-1, both.shape[2]).T @ d_e.reshape(-1, d_e.shape[2])}
        d_both = d_e @ self.p["out"].T
        h = self.hidden
        for side, saved, d_out in (("f", sf, d_both[:, :, :h]), ("b", sb, d_both[:, :, h:])):
            rec = self.p[f"rec_{side}"]
            d_in, d_rec = np.zeros_like(self.p[f"in_{side}"]), np.zeros_like(rec)
            d_state, d_cell = np.zeros((rows, h), np.float32), np.zeros((rows, h), np.float32)
            for t, state, before, i, f, o, c, squashed in reversed(saved):
                d_h = d_out[t] + d_state
                d_cell = d_cell + d_h * o * (1 - squashed ** 2)
                d_z = np.concatenate([d_cell * c * i * (1 - i), d_cell * before * f * (1 - f),
                                      d_h * squashed * o * (1 - o), d_cell * i * (1 - c ** 2)], 1)
                np.add.at(d_in, x[t], d_z)
                d_rec += state.T @ d_z
                d_state, d_cell = d_z @ rec.T, d_cell * f
            g[f"in_{side}"], g[f"rec_{side}"] = d_in, d_rec
        return float((z - gold).mean()), g

    def fit(self, x, y, steps=300, batch=48, rate=0.01, seed=3):
        """Adam over random batches of windows (columns of x and y)."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        losses = []
        for step in range(1, steps + 1):
            pick = rng.integers(0, x.shape[1], min(batch, x.shape[1]))
            loss, g = self.gradients(x[:, pick], y[:, pick])
            size = np.sqrt(sum(float((v ** 2).sum()) for v in g.values()))
            now = rate * (1 - 0.9 * step / steps)
            for k, v in g.items():
                v = v * min(1.0, 5 / (size + 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * v
                s[k] = 0.999 * s[k] + 0.001 * v * v
                self.p[k] = (self.p[k] - now * (m[k] / (1 - 0.9 ** step))
                             / (np.sqrt(s[k] / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)
            losses.append(loss)
        return losses
