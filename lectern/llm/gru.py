"""A gated recurrent language model in numpy: class-factored softmax, truncated backpropagation."""

from __future__ import annotations

import numpy as np

#: Backpropagation goes back this many tokens; the state goes on from window to window.
WINDOW = 16
#: Texts side by side in training: few for many small steps, many for a cheap pass.
LANES, WIDE = 64, 1024

Params = dict[str, np.ndarray]


def shape(vocabulary: int, hidden: int, classes: int) -> dict[str, tuple[int, ...]]:
    """Parameter shapes. Words are 0 .. vocabulary - 1; input ``vocabulary`` stands for a text's start."""
    per = -(-vocabulary // classes)
    return {"x": (vocabulary + 1, 3 * hidden), "u": (hidden, 3 * hidden), "wc": (hidden, classes), "bc": (classes,), "wo": (classes, hidden, per), "bo": (classes, per)}


def start(counts: np.ndarray, hidden: int, classes: int, seed: int = 3) -> Params:
    """Small random weights; the biases give the counts' own distribution. Word w is in class w // per."""
    rng = np.random.RandomState(seed)
    p = {k: (rng.standard_normal(s) * 0.08).astype(np.float32) for k, s in shape(len(counts), hidden, classes).items()}
    per = p["bo"].shape[1]
    padded = np.full(classes * per, 1e-30)
    padded[: len(counts)] = (counts + 0.5) / (counts + 0.5).sum()
    by_class = padded.reshape(classes, per)
    p["bc"] = np.log(by_class.sum(1)).astype(np.float32)
    p["bo"] = np.log(by_class / by_class.sum(1, keepdims=True)).astype(np.float32)
    return p


#: Predictions that are made at once: few enough that their outputs stay in a core's cache.
ROWS = 1024


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place."""
    np.exp(np.negative(x, out=x), out=x)
    x += 1
    return np.divide(1, x, out=x)


def _gates(a: np.ndarray) -> np.ndarray:
    """Columns of the three gates apart, so that whatever is done to one gate runs over memory without gaps."""
    return np.ascontiguousarray(a.reshape(len(a), 3, -1).swapaxes(0, 1))


def _step(x: np.ndarray, u: np.ndarray, word: np.ndarray, h: np.ndarray):
    """The next state, gates z and r, candidate c and its part g of the state; x and u by gate."""
    g, x = np.matmul(h, u), x.take(word, axis=1)
    zr = _sigmoid(np.add(g[:2], x[:2], out=x[:2]))
    c = np.multiply(zr[1], g[2])
    c += x[2]
    np.tanh(c, out=c)
    new = np.subtract(h, c)
    new *= zr[0]
    new += c
    return new, zr[0], zr[1], c, g[2]


def _with_bias(w: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Weights with their bias as one more row, for states with a 1 at the end."""
    return np.concatenate([w, b[..., None, :]], axis=-2)


def _moderate(p: Params) -> bool:
    """Can no output before the softmax be so large that its exponential overflows? States lie between -1 and 1."""
    return max(float((np.abs(p["wc"]).sum(0) + p["bc"]).max()), float((np.abs(p["wo"]).sum(1) + p["bo"]).max())) < 60


def _by(values: np.ndarray) -> np.ndarray:
    """A stable order; small numbers are sorted by their digits."""
    return np.argsort(values.astype(np.uint16) if len(values) and values.max() < 1 << 16 else values, kind="stable")


def _softmax(a: np.ndarray, at: np.ndarray, moderate: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Turns outputs into exponentials, in their place; their sums, where the picked ones are in a, and their log probabilities."""
    if not moderate:
        a -= a.max(1, keepdims=True)
    flat = np.arange(0, a.size, a.shape[1])
    flat += at
    own = a.reshape(-1).take(flat)
    total = np.exp(a, out=a) @ np.ones(a.shape[1], a.dtype)
    own -= np.log(total)
    return total, flat, own


def _pieces(by: np.ndarray) -> list[tuple[int, int, int]]:
    """(value, its first place, the place after its last) in ordered values."""
    cut = np.flatnonzero(np.append(True, by[1:] != by[:-1]))
    return list(zip(by[cut].tolist(), cut.tolist(), [*cut[1:].tolist(), len(by)]))


def _log_p(p: Params, h: np.ndarray, word: np.ndarray, moderate: bool) -> np.ndarray:
    """log p(word) after states h: of its class, times of the word in its class. Tokens go by class, ROWS at a time."""
    per, n = p["bo"].shape[1], h.shape[1]
    wc, wo = _with_bias(p["wc"], p["bc"]), _with_bias(p["wo"], p["bo"])
    k = word // per
    order = _by(k)
    out, states, words = np.empty(len(word), h.dtype), np.ones((ROWS, n + 1), h.dtype), np.empty((ROWS, per), h.dtype)
    for lo in range(0, len(word), ROWS):
        who = order[lo : lo + ROWS]
        by, s, e = k[who], states[: len(who)], words[: len(who)]
        s[:, :n] = h.take(who, axis=0)
        lp = _softmax(s @ wc, by, moderate)[2]
        for j, a, b in _pieces(by):
            np.matmul(s[a:b], wo[j], out=e[a:b])
        lp += _softmax(e, word[who] - by * per, moderate)[2]
        out[who] = lp
    return out


def score(p: Params, texts: list[np.ndarray], block: int = 64, side: int = 512) -> np.ndarray:
    """Natural-log probability of each whole text (word ids with the end token last).

    Texts run ``side`` by side, longest first; each carries its state from its first
    token to its last, and drops out when it ends. Predictions are made from
    the kept states, ``block`` steps at a time.
    """
    order = np.argsort([-len(t) for t in texts], kind="stable")
    out, moderate = np.zeros(len(texts)), _moderate(p)
    for lo in range(0, len(order), side):
        some = order[lo : lo + side]
        out[some] = _score_side_by_side(p, [texts[i] for i in some], block, moderate)
    return out


def _score_side_by_side(p: Params, texts: list[np.ndarray], block: int, moderate: bool) -> np.ndarray:
    """Texts in falling order of length."""
    lengths = np.asarray([len(t) for t in texts])
    vocabulary, n = p["x"].shape[0] - 1, p["u"].shape[0]
    left = np.searchsorted(-lengths, -np.arange(1, lengths[0] + 1), "right").tolist()  # texts that have a token at each step
    x, u = _gates(p["x"]), _gates(p["u"])
    h, word, total = np.zeros((len(texts), n), np.float32), np.full(len(texts), vocabulary), np.zeros(len(texts))
    for at in range(0, lengths[0], block):
        lanes = left[at : at + block]
        y = np.full((len(lanes), lanes[0]), -1, np.int64)
        for i in range(lanes[0]):
            part = texts[i][at : at + block]
            y[: len(part), i] = part
        states = np.empty((len(lanes), lanes[0], n), np.float32)
        for t, active in enumerate(lanes):
            h = _step(x, u, word[:active], h[:active])[0]
            states[t, :active] = h
            word = y[t]
        there = y >= 0
        who = np.nonzero(there)[1]
        total[: lanes[0]] += np.bincount(who, _log_p(p, states[there], y[there], moderate), lanes[0])
    return total


class Adam:
    def __init__(self, p: Params, rate: float):
        self.p, self.rate, self.t = p, rate, 0
        self.m, self.v, self.step = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(3))

    def update(self, grads: Params) -> None:
        self.t += 1
        fix = np.sqrt(1 - 0.99**self.t) / (1 - 0.9**self.t)
        for k, g in grads.items():
            m, v, step = self.m[k], self.v[k], self.step[k]
            m += np.multiply(np.subtract(g, m, out=step), 0.1, out=step)
            v += np.multiply(np.subtract(np.multiply(g, g, out=step), v, out=step), 0.01, out=step)
            np.sqrt(v, out=step)
            step += 1e-6
            np.divide(m, step, out=step)
            step *= self.rate * fix
            self.p[k] -= step


def gradients(p: Params, inputs: np.ndarray, targets: np.ndarray, fresh: np.ndarray, h: np.ndarray) -> tuple[Params, np.ndarray, float]:
    """Gradients of the mean negative log-likelihood over one window, the state after it, and the loss.

    inputs, targets and fresh (a text begins here) are steps x lanes.
    """
    steps, lanes = inputs.shape
    n, kind = p["u"].shape[0], p["u"].dtype
    x, u = _gates(p["x"]), _gates(p["u"])
    new = [np.flatnonzero(f) for f in fresh]
    h_in, kept = np.empty((steps, lanes, n), kind), []
    hs = np.empty_like(h_in)
    for t in range(steps):
        h_in[t] = h
        h_in[t, new[t]] = 0
        h, *gates = _step(x, u, inputs[t], h_in[t])
        hs[t] = h
        kept.append(gates)
    dH, g, loss = _predict(p, hs.reshape(-1, n), targets.reshape(-1))
    dH, dh, du, gu = dH.reshape(steps, lanes, n), np.zeros((lanes, n), kind), np.empty((3, steps, lanes, n), kind), np.zeros_like(u)
    ut = np.ascontiguousarray(u.swapaxes(1, 2))
    for t in range(steps - 1, -1, -1):
        z, r, c, gn = kept.pop()
        dh += dH[t]
        d = du[:, t]
        # d of the candidate, then of z, of the state's part of the candidate, and of r; all before their functions
        rest = 1 - z
        dc = np.multiply(c, c)
        np.subtract(1, dc, out=dc)
        dc *= rest
        dc *= dh
        dh *= z
        np.subtract(h_in[t], c, out=d[0])
        d[0] *= rest
        d[0] *= dh
        np.multiply(dc, r, out=d[2])
        np.subtract(1, r, out=d[1])
        d[1] *= gn
        d[1] *= d[2]
        gu += np.matmul(h_in[t].T, d)
        for part in np.matmul(d, ut):
            dh += part
        dh[new[t]] = 0
        d[2] = dc
    g["u"] = np.ascontiguousarray(gu.swapaxes(0, 1)).reshape(p["u"].shape)
    word = inputs.reshape(-1)
    order = _by(word)
    word = word[order]
    cut = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
    g["x"] = np.zeros_like(p["x"])
    for i, d in enumerate(du.reshape(3, -1, n)):
        g["x"][word[cut], i * n : (i + 1) * n] = np.add.reduceat(d.take(order, axis=0), cut, axis=0)
    return g, h, loss


def _predict(p: Params, h: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, Params, float]:
    """The mean loss of predicting y after states h, and its gradients: of the states, and of the outputs' weights.

    Tokens go by class, ROWS at a time: one product a class, all else over all of them.
    """
    n, per = h.shape[1], p["bo"].shape[1]
    wc, wo = _with_bias(p["wc"], p["bc"]), _with_bias(p["wo"], p["bo"])
    gc, go, back = np.zeros_like(wc), np.zeros_like(wo), np.empty_like(h)
    wct, wot = np.ascontiguousarray(p["wc"].T), np.ascontiguousarray(p["wo"].swapaxes(1, 2))
    moderate, scale, loss = _moderate(p), np.float32(1 / len(y)), 0.0

    def gradient(a: np.ndarray, at: np.ndarray) -> float:
        """The scaled gradient with respect to a, in its place; the loss."""
        total, flat, own = _softmax(a, at, moderate)
        a *= (scale / total)[:, None]
        a.reshape(-1)[flat] -= scale
        return -float(own.sum())

    k = y // per
    order = _by(k)
    states, words = np.ones((ROWS, n + 1), h.dtype), np.empty((ROWS, per), h.dtype)
    for lo in range(0, len(y), ROWS):
        who = order[lo : lo + ROWS]
        by, s, e = k[who], states[: len(who)], words[: len(who)]
        s[:, :n] = h.take(who, axis=0)
        d = s @ wc
        loss += gradient(d, by)
        gc += s.T @ d
        d = d @ wct
        parts = _pieces(by)
        for j, a, b in parts:
            np.matmul(s[a:b], wo[j], out=e[a:b])
        loss += gradient(e, y[who] - by * per)
        for j, a, b in parts:
            go[j] += s[a:b].T @ e[a:b]
            d[a:b] += e[a:b] @ wot[j]
        back[who] = d
    return back, {"wc": gc[:n].copy(), "bc": gc[n].copy(), "wo": go[:, :n].copy(), "bo": go[:, n].copy()}, loss / len(y)


def train(p: Params, texts: list[np.ndarray], updates: int, rate: float, seed: int = 0, lanes: int = LANES) -> Params:
    """Goes through the texts, shuffled, for at least ``updates`` windows and at least once; texts lie end to end in so many lanes.

    The lanes are of equal length; where the last one ends early, it goes on with the first texts again, so every token is learnt.
    """
    p = {k: x.copy() for k, x in p.items()}
    texts = [t for t in texts if len(t)]
    if not texts:
        return p
    vocabulary = p["x"].shape[0] - 1
    model, rng, done = Adam(p, rate), np.random.RandomState(seed), 0
    while True:
        line = [texts[i] for i in rng.permutation(len(texts))]
        y = np.concatenate(line)
        x = np.concatenate([np.append(vocabulary, t[:-1]) for t in line])
        fresh = x == vocabulary
        side = min(lanes, max(1, len(y) // WINDOW))
        long = -(-len(y) // side)
        x, y, fresh = (np.resize(a, long * side).reshape(side, long).T for a in (x, y, fresh))
        h = np.zeros((side, p["u"].shape[0]), np.float32)
        for t in range(0, long, WINDOW):
            g, h, _ = gradients(p, x[t : t + WINDOW], y[t : t + WINDOW], fresh[t : t + WINDOW], h)
            norm = np.sqrt(sum(float(np.vdot(v, v)) for v in g.values()))
            if norm > 1:
                g = {k: v / np.float32(norm) for k, v in g.items()}
            model.update(g)
            done += 1
        if done >= updates:
            return p


def pack(p: Params) -> bytes:
    return b"".join(np.ascontiguousarray(p[k], np.float32).tobytes() for k in sorted(p))


def unpack(raw: bytes, vocabulary: int, hidden: int, classes: int) -> Params:
    out, at = {}, 0
    for k, s in sorted(shape(vocabulary, hidden, classes).items()):
        n = int(np.prod(s))
        out[k] = np.frombuffer(raw, np.float32, n, at).reshape(s).copy()
        at += 4 * n
    return out
