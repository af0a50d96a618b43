"""A gated recurrent language model over word numbers, in numpy.

Many documents run side by side in lanes; a lane's state goes on from window to window until its
document ends, so every document is scored whole, while gradients stop at the window's edge. The
softmax is factored: first the word's class, then the word within the class.
"""

from __future__ import annotations

import numpy as np

#: State units; words in a class, and such classes; steps of a window.
UNITS, SIZE, CLASSES, WINDOW = 16, 64, 48, 32
#: Number 0 is the end, a class of its own; then come the RARE kinds of rarer words, and the model's own words in order of frequency.
RARE = 256
WORDS = 1 + SIZE * CLASSES


def start(counts: np.ndarray, seed: int = 0) -> dict[str, np.ndarray]:
    """Parameters whose first predictions are the frequencies of the WORDS words."""
    n = UNITS
    rng = np.random.default_rng(seed)
    p = (counts + 1.0) / (counts.sum() + WORDS)
    own = p[1:].reshape(CLASSES, SIZE)
    f = np.float32
    normal = lambda *shape: rng.standard_normal(shape).astype(f)
    return {
        "xg": normal(WORDS, 2 * n) * f(0.15), "xc": normal(WORDS, n) * f(0.3), "u": normal(n, 3 * n) / f(n**0.5), "bg": np.r_[np.full(n, 0.5), np.zeros(n)].astype(f), "bc": np.zeros(n, f),
        "c": np.zeros((n, 1 + CLASSES), f), "cb": np.log(np.r_[p[:1], own.sum(axis=1)]).astype(f), "o": np.zeros((CLASSES, n, SIZE), f), "ob": np.log(own / own.sum(axis=1, keepdims=True)).astype(f),
    }


def flat(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in sorted(p)])


def unflat(v: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k in sorted(like):
        n = like[k].size
        out[k] = v[at : at + n].reshape(like[k].shape).astype(np.float32)
        at += n
    return out


class Lanes:
    """Documents dealt to lanes, longest first, each to the lane that is shortest so far; lanes in order of length."""

    def __init__(self, lengths: np.ndarray, lanes: int):
        import heapq

        lanes = max(1, min(lanes, len(lengths)))
        heap = [(0, i) for i in range(lanes)]
        held: list[list[int]] = [[] for _ in range(lanes)]
        for d in np.argsort(-lengths, kind="stable").tolist():
            n, i = heap[0]
            heapq.heapreplace(heap, (n + int(lengths[d]), i))
            held[i].append(d)
        total = np.array([int(lengths[x].sum()) for x in held])
        self.order = np.argsort(-total, kind="stable")
        self.docs = [held[i] for i in self.order]
        self.total = total[self.order]

    def windows(self, tokens: np.ndarray, first: np.ndarray, end: int):
        """(words, before, fresh, doc) of each window, (steps, lanes): the word to predict, the word before, whether a document begins, its number (-1: the lane has ended)."""
        ahead = [np.concatenate([np.arange(first[d], first[d + 1], dtype=np.int32) for d in docs]) if docs else np.zeros(0, np.int32) for docs in self.docs]
        which = [np.repeat(np.array(docs, np.int32), [first[d + 1] - first[d] for d in docs]) for docs in self.docs]
        for at in range(0, int(self.total.max(initial=0)), WINDOW):
            live = int(np.searchsorted(-self.total, -at, side="left"))
            steps = int(min(WINDOW, self.total[0] - at))
            place, doc = np.zeros((steps, live), np.int32), np.full((steps, live), -1, np.int32)
            for i in range(live):
                part = ahead[i][at : at + steps]
                place[: len(part), i], doc[: len(part), i] = part, which[i][at : at + steps]
            fresh = place == first[np.maximum(doc, 0)]
            yield tokens[place], np.where(fresh, end, tokens[np.maximum(place - 1, 0)]), fresh, doc


def recur(p: dict[str, np.ndarray], before: np.ndarray, fresh: np.ndarray, h: np.ndarray, keep: bool):
    """States before each step's prediction (steps, lanes, units), the last state, and what the way back needs.

    A gate is (1 + tanh) / 2 of its input, which is halved by the parameters' scale.
    """
    n = UNITS
    gates, cands = p["xg"][before], p["xc"][before]
    gates += p["bg"]
    cands += p["bc"]
    u = p["u"]
    on = (~fresh).astype(np.float32)[:, :, None]
    steps, lanes = before.shape
    out, held = np.empty((steps, lanes, n), np.float32), []
    for t in range(steps):
        h = h * on[t]
        gh = h @ u
        g = gates[t]
        g += gh[:, : 2 * n]
        np.tanh(g, out=g)
        g += 1
        g *= 0.5
        c = cands[t]
        ghc = gh[:, 2 * n :]
        c += g[:, n:] * ghc
        np.tanh(c, out=c)
        if keep:
            held.append((h, g, c, ghc))
        h = h - c
        h *= g[:, :n]
        h += c
        out[t] = h
    return out, h, held


def loss(p: dict[str, np.ndarray], states: np.ndarray, words: np.ndarray, grads: dict[str, np.ndarray] | None):
    """ln P of each word given its state; with grads, adds those of the negative sum and returns the states' own as well."""
    cls = (words + (SIZE - 1)) // SIZE
    a = states @ p["c"]
    a += p["cb"]
    rows = np.arange(len(words))
    lp = a[rows, cls]
    np.exp(a, out=a)
    s = a @ np.ones(a.shape[1], np.float32)
    lp = lp - np.log(s)
    d = None
    if grads is not None:
        a /= s[:, None]
        a[rows, cls] -= 1
        grads["c"] += states.T @ a
        grads["cb"] += a.sum(axis=0)
        d = a @ p["c"].T
    some = np.flatnonzero(words)
    some = some[np.argsort(cls[some].astype(np.int16), kind="stable")]
    edges = np.searchsorted(cls[some], np.arange(1, CLASSES + 2))
    ones = np.ones(SIZE, np.float32)
    for k in range(CLASSES):
        at = some[edges[k] : edges[k + 1]]
        if not len(at):
            continue
        own, w = states[at], (words[at] - 1) % SIZE
        a = own @ p["o"][k]
        a += p["ob"][k]
        here = np.arange(len(at))
        got = a[here, w]
        np.exp(a, out=a)
        s = a @ ones
        lp[at] += got - np.log(s)
        if grads is not None:
            a /= s[:, None]
            a[here, w] -= 1
            grads["o"][k] += own.T @ a
            grads["ob"][k] += a.sum(axis=0)
            d[at] += a @ p["o"][k].T
    return lp, d


def back(p: dict[str, np.ndarray], before: np.ndarray, fresh: np.ndarray, held: list, d_states: np.ndarray, grads: dict[str, np.ndarray]) -> None:
    n = UNITS
    dh = np.zeros_like(d_states[0])
    g_all = np.empty((*before.shape, 3 * n), np.float32)
    gu, ut = np.zeros_like(p["u"]), np.ascontiguousarray(p["u"].T)
    on = (~fresh).astype(np.float32)[:, :, None]
    for t in range(len(held) - 1, -1, -1):
        h0, g, c, ghc = held[t]
        z, r = g[:, :n], g[:, n:]
        dh += d_states[t]
        out = g_all[t]
        dc = dh * (1 - z)
        dc *= 1 - c * c
        slope = g * (1 - g)
        slope *= 2
        out[:, :n] = dh * (h0 - c) * slope[:, :n]
        out[:, n : 2 * n] = dc * ghc * slope[:, n:]
        out[:, 2 * n :] = dc * r
        gu += h0.T @ out
        dh = dh * z
        dh += out @ ut
        dh *= on[t]
        out[:, 2 * n :] = dc
    grads["u"] += gu
    g = g_all.reshape(-1, 3 * n)
    total = g.sum(axis=0)
    grads["bg"] += total[: 2 * n]
    grads["bc"] += total[2 * n :]
    words = before.ravel().astype(np.int16)
    order = np.argsort(words, kind="stable")
    at = np.flatnonzero(np.r_[True, np.diff(words[order]) != 0])
    seen = words[order[at]]
    sums = np.add.reduceat(g[order], at, axis=0)
    grads["xg"][seen] += sums[:, : 2 * n]
    grads["xc"][seen] += sums[:, 2 * n :]


def train(p: dict[str, np.ndarray], tokens: np.ndarray, first: np.ndarray, end: int, lanes: int = 256, rate: float = 0.01, adam: tuple | None = None):
    """One pass over documents (tokens[first[d]:first[d+1]]) by truncated backpropagation; Adam steps on the mean loss of each window. Returns Adam's state."""
    m, v, step = adam or ({k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0)
    dealt = Lanes(np.diff(first), lanes)
    h = np.zeros((len(dealt.docs), UNITS), np.float32)
    for words, before, fresh, doc in dealt.windows(tokens, first, end):
        grads = {k: np.zeros_like(x) for k, x in p.items()}
        states, last, held = recur(p, before, fresh, h[: words.shape[1]], True)
        h = last
        real = doc >= 0
        count = int(real.sum())
        _, d = loss(p, states[real], words[real], grads)
        d_states = np.zeros_like(states)
        d_states[real] = d
        back(p, before, fresh, held, d_states, grads)
        step += 1
        scale = 1.0 / count
        for k, g in grads.items():
            g *= scale
            m[k] += 0.1 * (g - m[k])
            v[k] += 0.01 * (g * g - v[k])
            p[k] -= (rate / (1 - 0.9**step)) * m[k] / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)
    return m, v, step


def score(p: dict[str, np.ndarray], tokens: np.ndarray, first: np.ndarray, end: int, lanes: int = 256) -> np.ndarray:
    """ln P of each whole document."""
    out = np.zeros(len(first) - 1)
    dealt = Lanes(np.diff(first), lanes)
    h = np.zeros((len(dealt.docs), UNITS), np.float32)
    for words, before, fresh, doc in dealt.windows(tokens, first, end):
        states, h, _ = recur(p, before, fresh, h[: words.shape[1]], False)
        real = doc >= 0
        lp, _ = loss(p, states[real], words[real], None)
        out += np.bincount(doc[real], weights=lp, minlength=len(out))
    return out
