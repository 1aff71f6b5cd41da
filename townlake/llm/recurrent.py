"""A gated recurrent language model in numpy, with a class-factored output softmax.

A word's probability is that of its class given the words before it, times that of the word in
its class: for the frequent words a second softmax, for all other words, whose class comes from
their last letters, their share of the class in the corpus counts.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np

EMBEDDING = 12
HIDDEN = 16
#: Steps that gradients go back through; the state itself is carried on to the next window.
WINDOW = 24
CLASS_WORDS = 32


@dataclass
class Layout:
    """Ids 0 to n_frequent - 1 are frequent words, then come the classes of all others, then BOS."""

    n_frequent: int
    n_rare_classes: int

    @property
    def n_frequent_classes(self) -> int:
        return -(-self.n_frequent // CLASS_WORDS)

    @property
    def n_classes(self) -> int:
        return self.n_frequent_classes + self.n_rare_classes

    @property
    def start(self) -> int:
        return self.n_frequent + self.n_rare_classes

    def classes(self, ids: np.ndarray) -> np.ndarray:
        return np.where(ids < self.n_frequent, ids // CLASS_WORDS, ids - self.n_frequent + self.n_frequent_classes)


Weights = dict[str, np.ndarray]


def initial(layout: Layout, counts: np.ndarray, seed: int = 2) -> Weights:
    """Small random states, and output biases that make the untrained model the corpus unigram.

    ``counts`` are those of the frequent words and of the classes of all others.
    """
    rng = np.random.default_rng(seed)
    shares = np.log(counts + 0.5)
    n, padded = layout.n_frequent, layout.n_frequent_classes * CLASS_WORDS
    word_bias = np.full(padded, -1e9, np.float32)
    word_bias[:n] = shares[:n]
    by_class = word_bias.reshape(-1, CLASS_WORDS).max(1, initial=-1e9)
    class_bias = np.concatenate([
        by_class + np.log(np.exp(word_bias.reshape(-1, CLASS_WORDS) - by_class[:, None]).sum(1)), shares[n:]
    ])
    scale = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
    return {
        "embedding": (0.5 * rng.standard_normal((layout.start + 1, EMBEDDING))).astype(np.float32),
        "w": scale(EMBEDDING, 3 * HIDDEN),
        "u": scale(HIDDEN, 3 * HIDDEN),
        "b": np.zeros(3 * HIDDEN, np.float32),
        "c": np.zeros((HIDDEN, layout.n_classes), np.float32),
        "cb": (class_bias - class_bias.max()).astype(np.float32),
        "o": np.zeros((HIDDEN, padded), np.float32),
        "ob": np.where(word_bias < -1e8, -30, word_bias - word_bias.max()).astype(np.float32),
    }


def lanes(docs: list[np.ndarray], layout: Layout, end: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents dealt to at most ``most`` lanes of about equal length, one after the other.

    Returns (steps, lanes) arrays of inputs, targets and document numbers (-1: no document). A
    document's inputs begin with BOS, where the state starts anew; its last target is ``end``.
    """
    sizes = np.array([len(d) + 1 for d in docs])
    n = int(max(1, min(most, sizes.sum() // max(sizes.max(), 4 * WINDOW))))
    filled = [(0, k) for k in range(n)]
    dealt: list[list[int]] = [[] for _ in range(n)]
    for i in np.argsort(-sizes, kind="stable"):
        size, k = heapq.heappop(filled)
        dealt[k].append(int(i))
        heapq.heappush(filled, (size + int(sizes[i]), k))
    steps = max(size for size, _ in filled)
    inputs = np.full((steps, n), layout.start, np.int32)
    targets = np.zeros((steps, n), np.int32)
    owner = np.full((steps, n), -1, np.int32)
    for k, mine in enumerate(dealt):
        at = 0
        for i in mine:
            d, m = docs[i], len(docs[i])
            inputs[at + 1 : at + 1 + m, k] = d
            targets[at : at + m, k] = d
            targets[at + m, k] = end
            owner[at : at + m + 1, k] = i
            at += m + 1
    return inputs, targets, owner


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place, by exp, which numpy computes much faster than tanh."""
    np.negative(x, out=x)
    with np.errstate(over="ignore"):  # 1 / (1 + inf) is 0
        np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _exps(states: np.ndarray, weights: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a softmax over ``states @ weights + bias`` the exponentials, their sums and what was taken off.

    States lie between -1 and 1, so a bound of all values is known beforehand and no row's largest
    value has to be found.
    """
    bound = np.abs(weights).sum(0) + bias
    shift = bias - bound.max()
    x = states @ weights
    x += shift
    np.exp(x, out=x)
    return x, x @ np.ones(x.shape[1], x.dtype), shift


def _states(p: Weights, table: np.ndarray, inputs: np.ndarray, start: int, h: np.ndarray, keep: bool):
    """Hidden states of a window from ``h``, and what a backward pass needs if ``keep``."""
    steps = []
    out = np.empty((*inputs.shape, HIDDEN), np.float32)
    starts = inputs == start
    begins = starts.any(1)
    given = table[inputs]
    for t in range(len(inputs)):
        if begins[t]:
            h = np.where(starts[t][:, None], h.dtype.type(0), h)
        x, g = given[t], h @ p["u"]
        zr = _sigmoid(x[:, : 2 * HIDDEN] + g[:, : 2 * HIDDEN])
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        n = r * g[:, 2 * HIDDEN :]
        n += x[:, 2 * HIDDEN :]
        n += n
        n = _sigmoid(n)
        n += n
        n -= 1
        new = h - n
        new *= z
        new += n
        if keep:
            steps.append((h, z, r, n, g[:, 2 * HIDDEN :]))
        h = out[t] = new
    return out, h, steps


def _in_classes(classes: np.ndarray, layout: Layout) -> tuple[np.ndarray, list[tuple[int, slice]]]:
    """The places of words of frequent classes, class by class, and (class, slice of them) for each that occurs."""
    order = np.argsort(classes, kind="stable")
    ends = np.searchsorted(classes[order], np.arange(layout.n_frequent_classes + 1)).tolist()
    return order[: ends[-1]], [(c, slice(a, b)) for c, (a, b) in enumerate(zip(ends, ends[1:], strict=False)) if a < b]


def score(p: Weights, layout: Layout, docs: list[np.ndarray], end: int, most_lanes: int = 512) -> np.ndarray:
    """Natural log probability of each whole document; for words of rare classes, of the class."""
    inputs, targets, owner = lanes(docs, layout, end, most_lanes)
    table = p["embedding"] @ p["w"] + p["b"]
    h = np.zeros((inputs.shape[1], HIDDEN), np.float32)
    total = np.zeros(len(docs))
    for a in range(0, len(inputs), WINDOW):
        span = slice(a, a + WINDOW)
        out, h, _ = _states(p, table, inputs[span], layout.start, h, False)
        real = owner[span].ravel() >= 0
        states, ids = out.reshape(-1, HIDDEN)[real], targets[span].ravel()[real]
        classes = layout.classes(ids)
        x, sums, _ = _exps(states, p["c"], p["cb"])
        share = x[np.arange(len(ids)), classes] / sums
        rows, parts = _in_classes(classes, layout)
        ordered, inside = states[rows], ids[rows] % CLASS_WORDS
        shares = np.empty(len(rows), x.dtype)
        for c, part in parts:
            words = slice(c * CLASS_WORDS, (c + 1) * CLASS_WORDS)
            x, sums, _ = _exps(ordered[part], p["o"][:, words], p["ob"][words])
            shares[part] = x[np.arange(len(x)), inside[part]] / sums
        share[rows] *= shares
        found = np.log(np.maximum(share, np.float32(1e-37)))
        total += np.bincount(owner[span].ravel()[real], found, len(docs))
    return total


class Trainer:
    """Truncated backpropagation through time, a window of all lanes an update."""

    def __init__(self, weights: Weights, layout: Layout, rate: float) -> None:
        self.p = {k: v.copy() for k, v in weights.items()}
        self.layout, self.rate, self.updates = layout, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in weights.items()}
        self.v = {k: np.zeros_like(v) for k, v in weights.items()}

    def learn(self, docs: list[np.ndarray], end: int, most_lanes: int = 256) -> None:
        inputs, targets, owner = lanes(docs, self.layout, end, most_lanes)
        h = np.zeros((inputs.shape[1], HIDDEN), np.float32)
        for a in range(0, len(inputs), WINDOW):
            span = slice(a, a + WINDOW)
            h = self._window(inputs[span], targets[span], owner[span], h)

    def _window(self, inputs: np.ndarray, targets: np.ndarray, owner: np.ndarray, h: np.ndarray) -> np.ndarray:
        g, n, last = self.gradient(inputs, targets, owner, h)
        self._step(g, max(1, n))
        return last

    def gradient(self, inputs: np.ndarray, targets: np.ndarray, owner: np.ndarray, h: np.ndarray) -> tuple[Weights, int, np.ndarray]:
        """The gradient of the window's summed loss, the number of its words, and the last states."""
        p, layout = self.p, self.layout
        table = p["embedding"] @ p["w"] + p["b"]
        out, last, steps = _states(p, table, inputs, layout.start, h, True)
        real = np.flatnonzero(owner.ravel() >= 0)
        states, ids = out.reshape(-1, HIDDEN)[real], targets.ravel()[real]
        classes = layout.classes(ids)
        g = {k: np.zeros_like(v) for k, v in p.items()}
        error, sums, _ = _exps(states, p["c"], p["cb"])
        error *= (1 / sums)[:, None]
        error[np.arange(len(ids)), classes] -= 1
        g["c"], g["cb"] = states.T @ error, np.ones(len(ids), error.dtype) @ error
        back = error @ p["c"].T
        rows, parts = _in_classes(classes, layout)
        ordered, inside = states[rows], ids[rows] % CLASS_WORDS
        more = np.empty_like(ordered)
        for c, part in parts:
            words = slice(c * CLASS_WORDS, (c + 1) * CLASS_WORDS)
            of_class = ordered[part]
            e, sums, _ = _exps(of_class, p["o"][:, words], p["ob"][words])
            e *= (1 / sums)[:, None]
            e[np.arange(len(e)), inside[part]] -= 1
            g["o"][:, words], g["ob"][words] = of_class.T @ e, np.ones(len(e), e.dtype) @ e
            more[part] = e @ p["o"][:, words].T
        back[rows] += more
        d_out = np.zeros((out.shape[0] * out.shape[1], HIDDEN), np.float32)
        d_out[real] = back
        d_out = d_out.reshape(out.shape)
        d_table = np.empty((*inputs.shape, 3 * HIDDEN), np.float32)
        h_side = np.empty_like(d_table)
        d_h = np.zeros_like(h)
        goes_on = inputs != layout.start
        back_u = p["u"].T.copy()
        for t in range(len(inputs) - 1, -1, -1):
            before, z, r, n, u_n = steps[t]
            d = d_out[t]
            d += d_h
            keep = 1 - z
            d_n = d * keep
            d_n *= 1 - n * n
            d_z = before - n
            d_z *= d
            keep *= z
            d_z *= keep
            d_r = d_n * u_n
            d_r *= r - r * r
            x_side, u_side = d_table[t], h_side[t]
            x_side[:, :HIDDEN], x_side[:, HIDDEN : 2 * HIDDEN], x_side[:, 2 * HIDDEN :] = d_z, d_r, d_n
            u_side[:, : 2 * HIDDEN] = x_side[:, : 2 * HIDDEN]
            np.multiply(d_n, r, out=u_side[:, 2 * HIDDEN :])
            d *= z
            d_h = u_side @ back_u
            d_h += d
            if not goes_on[t].all():
                d_h *= goes_on[t][:, None]
        flat = d_table.reshape(-1, 3 * HIDDEN)
        befores = np.concatenate([s[0] for s in steps])
        g["u"] = befores.T @ h_side.reshape(-1, 3 * HIDDEN)
        words = inputs.ravel()
        order = np.argsort(words, kind="stable")
        ordered = words[order]
        starts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
        by_word, distinct = np.add.reduceat(flat[order], starts, axis=0), ordered[starts]
        g["w"], g["b"] = p["embedding"][distinct].T @ by_word, by_word.sum(0)
        g["embedding"][distinct] = by_word @ p["w"].T
        return g, len(ids), last

    def _step(self, g: Weights, n: int) -> None:
        self.updates += 1
        norm = np.sqrt(sum(float((x * x).sum()) for x in g.values())) / n
        scale = np.float32(min(1.0, 1.0 / (norm + 1e-9)) / n)
        rate = self.rate * np.sqrt(1 - 0.999**self.updates) / (1 - 0.9**self.updates)
        for k, x in g.items():
            x = x * scale
            self.m[k] += 0.1 * (x - self.m[k])
            self.v[k] += 0.001 * (x * x - self.v[k])
            self.p[k] -= np.float32(rate) * self.m[k] / (np.sqrt(self.v[k]) + 1e-7)


def packed(weights: Weights) -> bytes:
    return b"".join(weights[k].astype("<f4").tobytes() for k in sorted(weights))


def unpacked(raw: bytes, like: Weights) -> Weights:
    values, out, at = np.frombuffer(raw, "<f4"), {}, 0
    for k in sorted(like):
        out[k] = values[at : at + like[k].size].reshape(like[k].shape).astype(np.float32)
        at += like[k].size
    return out
