"""A gated recurrent language model in numpy with a class-factored softmax.

Word ids are in order of frequency; class = id // ``width``, so a word's probability is that
of its class times that of the word among the class's ``width`` words. Output biases start
at the given word frequencies, output weights at zero: an untrained model is the unigram
model of its vocabulary.
"""

from __future__ import annotations

import heapq

import numpy as np

HIDDEN, EMBED, WIDTH = 24, 16, 32
LANES, STEPS = 512, 64
TRAIN_LANES, TRAIN_STEPS = 128, 32
ROWS = 4096
END = 0
NAMES = ("embed", "wx", "wh", "b", "wc", "bc", "ww", "bw")


def sigmoid(x):
    x = np.negative(x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def tanh(x):
    """By ``exp``, which numpy computes several times faster; the error is that of a rounding at 1."""
    x = x + x
    np.exp(x, out=x)
    x += 1
    np.divide(-2, x, out=x)
    x += 1
    return x


def new_params(freq: np.ndarray, seed: int = 5) -> dict:
    """``freq``: probability of each word id; its length is a multiple of ``WIDTH``."""
    rng = np.random.default_rng(seed)
    v, c = len(freq), len(freq) // WIDTH
    f = np.maximum(freq, 1e-12).reshape(c, WIDTH)
    p = {
        "embed": rng.normal(0, 0.3, (v, EMBED)), "wx": rng.normal(0, EMBED**-0.5, (EMBED, 3 * HIDDEN)), "wh": rng.normal(0, HIDDEN**-0.5, (HIDDEN, 3 * HIDDEN)),
        "b": np.zeros(3 * HIDDEN), "wc": np.zeros((HIDDEN, c)), "bc": np.log(f.sum(1)), "ww": np.zeros((c, HIDDEN, WIDTH)), "bw": np.log(f / f.sum(1, keepdims=True)),
    }
    return {k: x.astype(np.float32) for k, x in p.items()}


def _column_sums(x: np.ndarray) -> np.ndarray:
    return np.ones(len(x), x.dtype) @ x


def _exps(x: np.ndarray, most: float):
    """exp(``x``) and its row sums. ``most`` bounds the numbers; rows are shifted below 0 (``x`` too) only where they could overflow or vanish."""
    if not most < 60:
        x -= x.max(1, keepdims=True)
    e = np.exp(x)
    return e, e @ np.ones(x.shape[1], x.dtype)


def step(gx, h, wh):
    g = h @ wh
    gates = sigmoid(gx[:, : 2 * HIDDEN] + g[:, : 2 * HIDDEN])
    z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
    u = g[:, 2 * HIDDEN :]
    n = r * u
    n += gx[:, 2 * HIDDEN :]
    n = tanh(n)
    new = h - n
    new *= z
    new += n
    return new, z, r, n, u


def output(p: dict, x: np.ndarray, ids: np.ndarray, grads: dict | None = None):
    """Natural log probabilities of ``ids`` after states ``x``; with ``grads``, adds to them and returns d loss / d x."""
    n, classes = len(ids), len(p["bc"])
    order = np.argsort((ids // WIDTH).astype(np.min_scalar_type(classes)), kind="stable")
    x, ids = x[order], ids[order]
    cls, word, row = ids // WIDTH, ids % WIDTH, np.arange(n)
    cut = np.searchsorted(cls, np.arange(classes + 1))
    parts = [(c, slice(cut[c], cut[c + 1])) for c in np.flatnonzero(cut[1:] > cut[:-1])]
    reach = max(1.0, float(x.max()), -float(x.min())) if n else 1.0
    by_class = x @ p["wc"]
    by_class += p["bc"]
    e, total = _exps(by_class, (reach * np.abs(p["wc"]).sum(0) + np.abs(p["bc"])).max())
    own = by_class[row, cls] - np.log(total)
    if grads is not None:
        e *= (1 / (n * total))[:, None]
        e[row, cls] -= 1 / n
        grads["wc"] += x.T @ e
        grads["bc"] += _column_sums(e)
        dx = e @ p["wc"].T
    by_word = p["bw"][cls]
    for c, i in parts:
        by_word[i] += x[i] @ p["ww"][c]
    e, total = _exps(by_word, (reach * np.abs(p["ww"]).sum(1) + np.abs(p["bw"])).max())
    logp = np.empty(n)
    logp[order] = own.astype(np.float64) + (by_word[row, word] - np.log(total))
    if grads is None:
        return logp
    e *= (1 / (n * total))[:, None]
    e[row, word] -= 1 / n
    x = np.c_[x, np.ones((n, 1), x.dtype)]  # the last row of the product is the bias
    for c, i in parts:
        both = x[i].T @ e[i]
        grads["ww"][c] += both[:-1]
        grads["bw"][c] += both[-1]
        dx[i] += e[i] @ p["ww"][c].T
    back = np.empty_like(dx)
    back[order] = dx
    return logp, back


def window_gradients(p: dict, ids: np.ndarray, before: np.ndarray, h: np.ndarray):
    """Truncated backpropagation over one window. ``ids``, ``before``: (steps, lanes) words and
    the words before them; after an END the state starts anew. Returns gradients, last state, loss."""
    steps, lanes = ids.shape
    g = {k: np.zeros_like(x) for k, x in p.items()}
    gx = (p["embed"] @ p["wx"] + p["b"])[before]
    go = (before != END)[:, :, None].astype(gx.dtype)
    states, start, z, r, n, u = (np.empty((steps, lanes, HIDDEN), gx.dtype) for _ in range(6))
    for t in range(steps):
        np.multiply(h, go[t], out=start[t])
        h, z[t], r[t], n[t], u[t] = step(gx[t], start[t], p["wh"])
        states[t] = h
    logp, dx = output(p, states.reshape(-1, HIDDEN), ids.reshape(-1), g)
    dx = dx.reshape(steps, lanes, HIDDEN)
    by_n, by_z, by_r = (1 - z) * (1 - n * n), (start - n) * z * (1 - z), u * r * (1 - r)
    dh, dg, dn = np.zeros((lanes, HIDDEN), dx.dtype), np.empty_like(gx), np.empty_like(z)
    wh = np.ascontiguousarray(p["wh"].T)
    for t in range(steps - 1, -1, -1):
        dh += dx[t]
        np.multiply(dh, by_n[t], out=dn[t])
        np.multiply(dh, by_z[t], out=dg[t, :, :HIDDEN])
        np.multiply(dn[t], by_r[t], out=dg[t, :, HIDDEN : 2 * HIDDEN])
        np.multiply(dn[t], r[t], out=dg[t, :, 2 * HIDDEN :])
        dh *= z[t]
        dh += dg[t] @ wh
        dh *= go[t]
    g["wh"] = start.reshape(-1, HIDDEN).T @ dg.reshape(-1, 3 * HIDDEN)
    dg[:, :, 2 * HIDDEN :] = dn
    flat = dg.reshape(-1, 3 * HIDDEN)
    g["b"] = _column_sums(flat)
    g["wx"] = p["embed"][before.reshape(-1)].T @ flat
    order = np.argsort(before.reshape(-1).astype(np.min_scalar_type(len(p["embed"]))), kind="stable")
    words = before.reshape(-1)[order]
    first = np.flatnonzero(np.r_[True, words[1:] != words[:-1]])
    g["embed"][words[first]] = np.add.reduceat((flat @ p["wx"].T)[order], first)
    return g, h, -logp.mean()


class Trainer:
    """Adam over windows of a stream of documents, cut into lanes."""

    def __init__(self, params: dict, rate: float = 0.02):
        self.rate, self.t, self.tokens = rate, 0, 0
        self.flat = np.concatenate([x.reshape(-1) for x in params.values()])
        cuts = np.cumsum([x.size for x in params.values()])[:-1]
        self.p = {k: part.reshape(x.shape) for (k, x), part in zip(params.items(), np.split(self.flat, cuts))}  # views
        self.m, self.v = np.zeros_like(self.flat), np.zeros_like(self.flat)

    def feed(self, ids: np.ndarray) -> None:
        """``ids``: documents, each closed by END, end to end."""
        steps = len(ids) // TRAIN_LANES
        if not steps:
            return
        self.tokens += steps * TRAIN_LANES
        now = ids[: steps * TRAIN_LANES].reshape(TRAIN_LANES, steps).T
        before = np.concatenate([np.full((1, TRAIN_LANES), END), now[:-1]])
        h = np.zeros((TRAIN_LANES, HIDDEN), np.float32)
        for a in range(0, steps, TRAIN_STEPS):
            g, h, _ = window_gradients(self.p, now[a : a + TRAIN_STEPS], before[a : a + TRAIN_STEPS], h)
            g = np.concatenate([g[k].reshape(-1) for k in self.p])
            g *= min(1.0, 1.0 / (float(np.sqrt(g @ g)) + 1e-9))
            self.t += 1
            rate = self.rate / (1 + self.t / 200) * (1 - 0.999**self.t) ** 0.5 / (1 - 0.9**self.t)
            self.m *= 0.9
            self.m += 0.1 * g
            g *= g
            g *= 0.001
            self.v *= 0.999
            self.v += g
            by = np.sqrt(self.v)
            by += 1e-8
            np.divide(self.m, by, out=by)
            by *= rate
            self.flat -= by


def score(p: dict, ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Natural log probability of each document [bounds[i], bounds[i+1]) of ``ids`` (closed by END).

    Documents are dealt to lanes, the longest first; a lane's state runs on over windows
    of ``STEPS`` words and starts anew with each document.
    """
    n, size = len(bounds) - 1, np.diff(bounds)
    out = np.zeros(n)
    if not n:
        return out
    lanes = min(LANES, n)
    heap, held = [(0, i) for i in range(lanes)], [[] for _ in range(lanes)]
    for d in np.argsort(-size, kind="stable"):
        load, i = heapq.heappop(heap)
        held[i].append(d)
        heapq.heappush(heap, (load + int(size[d]), i))
    length = np.array([size[x].sum() for x in held])
    held = [held[i] for i in np.argsort(-length, kind="stable")]
    length = -np.sort(-length)
    words = [np.concatenate([ids[bounds[d] : bounds[d + 1]] for d in x]) for x in held]
    owner = [np.repeat(x, size[x]) for x in held]
    px = p["embed"] @ p["wx"] + p["b"]
    h, last = np.zeros((lanes, HIDDEN), np.float32), np.full(lanes, END)
    for a in range(0, int(length[0]), STEPS):
        active = int(np.searchsorted(-length, -a, "left"))
        steps = min(STEPS, int(length[0]) - a)
        now, own = np.full((steps, active), END), np.full((steps, active), -1)
        for i in range(active):
            part = words[i][a : a + steps]
            now[: len(part), i] = part
            own[: len(part), i] = owner[i][a : a + steps]
        states = np.empty((steps, active, HIDDEN), np.float32)
        h, last = h[:active], last[:active]
        for t in range(steps):
            h = step(px[last], h * (last != END)[:, None].astype(np.float32), p["wh"])[0]
            states[t] = h
            last = now[t]
        real = own.reshape(-1) >= 0
        x, now, own = states.reshape(-1, HIDDEN)[real], now.reshape(-1)[real], own.reshape(-1)[real]
        for i in range(0, len(own), ROWS):
            out += np.bincount(own[i : i + ROWS], output(p, x[i : i + ROWS], now[i : i + ROWS]), n)
    return out
