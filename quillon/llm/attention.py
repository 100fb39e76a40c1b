"""A causal self-attention model over subword ids, in numpy.

Counts over the whole corpus give a table of what follows what: probabilities of
a class after the id before, and of an id within its class. Attention over the
window tilts the classes: p(class) is proportional to table[id before, class] x
exp(context . U). With U at zero the model is the counted table, so training
starts from it.

Every probability is positive and sums to one over the vocabulary.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np

#: Inputs of a window, and how many of its last places are scored; the rest is context of the window before.
WINDOW = 32
STRIDE = 24
LEAD = WINDOW - STRIDE
WIDTH = 16
CLASSES = 96
#: Classes of one frequent id each; the others are clusters, the document end and a class of rare ids.
OWN = 46
#: Frequent ids are symbols of their own; the other ids are one more, within which an id has its counted odds.
SYMBOLS = 2048
#: Weight of the symbols' own odds among the counts after a symbol.
PRIOR = 20.0
CONTEXTS = 256
BLOCK = 64
RATE = 0.03
#: Training: windows of a gradient, and gradients of a step, after so many steps of one gradient each.
GRADIENT_WINDOWS = 32
STEP_GRADIENTS = 4
FIRST_STEPS = 200
#: Windows that are copied out at once.
FETCH = 16 * GRADIENT_WINDOWS
#: What an exponent may reach in scoring; larger weights are scaled down once.
HIGHEST = 60.0

_NEVER = np.float32(-1e9)


@dataclass
class Vocabulary:
    """What counts give. An id belongs to a symbol, a symbol to a class; tables by the symbol before."""

    end: int
    symbol_of: np.ndarray
    log_within: np.ndarray  # of an id in its symbol
    class_of: np.ndarray  # of a symbol
    after: np.ndarray  # (symbol before, class) probabilities
    log_inside: np.ndarray  # (symbol before, symbol): log odds in the symbol's class

    @property
    def symbols(self) -> int:
        return len(self.class_of)

    def fixed(self, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """What no weight changes of documents' log probabilities: ids in their symbols, and symbols in their classes."""
        symbol = self.symbol_of[ids]
        before = np.concatenate([[0], symbol[:-1]])
        before[starts[:-1]] = 0
        return np.bincount(np.repeat(np.arange(len(starts) - 1), np.diff(starts)), self.log_within[ids] + self.log_inside[before, symbol], len(starts) - 1)


def cluster(features: np.ndarray, k: int, rounds: int = 15) -> np.ndarray:
    """Spherical k-means; the first centres are spread over the rows in their order (by frequency)."""
    n = len(features)
    if n <= k:
        return np.arange(n)
    x = features / np.maximum(np.linalg.norm(features, axis=1, keepdims=True), 1e-12)
    centres = x[:k].copy()
    at = np.zeros(n, np.int64)
    for _ in range(rounds):
        at = (x @ centres.T).argmax(1)
        for c in range(k):
            if (at == c).any():
                v = x[at == c].sum(0)
                centres[c] = v / max(np.linalg.norm(v), 1e-12)
    return at


def vocabulary(size: int, counts: np.ndarray, steps: tuple[np.ndarray, np.ndarray, np.ndarray]) -> Vocabulary:
    """From id counts (``size`` ids, the last is the document end) and counts of (id, next id) within words.

    In ``steps`` the end id stands for a word's border on either side.
    """
    end = size - 1
    order = np.lexsort((np.arange(size), -counts))
    order = order[(counts[order] > 0) & (order != end)][: SYMBOLS - 1]
    a, b, n = steps
    own, rest = order[:OWN], order[OWN:]
    class_of = np.concatenate([np.full(SYMBOLS, CLASSES - 1), np.arange(CLASSES)])
    class_of[0] = 0
    class_of[1 : 1 + len(own)] = 1 + np.arange(len(own))
    rank = np.full(size, -1)
    rank[order] = np.arange(len(order))
    if len(rest):
        # what stands before and after an id within words, by the most frequent ids and the border
        place = np.where((rank >= 0) & (rank < CONTEXTS - 1), rank, -1)
        place[end] = CONTEXTS - 1
        row = np.full(size, -1)
        row[rest] = np.arange(len(rest))
        x = np.zeros((len(rest), 2 * CONTEXTS))
        for mine, other, shift in ((b, a, 0), (a, b, CONTEXTS)):
            ok = (row[mine] >= 0) & (place[other] >= 0)
            np.add.at(x, (row[mine[ok]], place[other[ok]] + shift), n[ok])
        class_of[1 + OWN : 1 + len(order)] = 1 + OWN + cluster(np.sqrt(x), CLASSES - 2 - OWN)
    # ids beyond the symbols share one, and are smoothed: they may never have been seen
    rare = SYMBOLS + CLASSES - 1
    symbol_of = np.where(rank >= 0, rank + 1, rare)
    symbol_of[end] = 0
    inside = counts + (symbol_of == rare)
    total = np.bincount(symbol_of, inside, len(class_of)).astype(np.float64)
    log_within = np.log(np.maximum(inside, 1e-300) / np.maximum(total[symbol_of], 1e-300))
    log_within[end] = 0.0
    # a word's steps are counted; from its last symbol on go the first symbols of all words
    pairs = np.zeros((len(class_of), len(class_of)))
    inner = (a != end) & (b != end)
    np.add.at(pairs, (symbol_of[a[inner]], symbol_of[b[inner]]), n[inner])
    first = np.bincount(symbol_of[b[a == end]], n[a == end], len(class_of)).astype(np.float64)
    last = np.bincount(symbol_of[a[b == end]], n[b == end], len(class_of)).astype(np.float64)
    first[0] += counts[end]
    first /= max(first.sum(), 1)
    pairs += np.outer(last, first)
    pairs[0] += counts[end] * first
    alone = total + 0.5 * (np.bincount(symbol_of, minlength=len(class_of)) > 0)  # nothing for symbols without ids
    alone[0] = counts[end] + 0.5
    pairs += PRIOR * alone / alone.sum()
    pairs /= pairs.sum(1, keepdims=True)
    after = np.zeros((len(class_of), CLASSES))
    np.add.at(after.T, class_of, pairs.T)
    return Vocabulary(end, symbol_of.astype(np.int32), log_within.astype(np.float32), class_of.astype(np.int32), after.astype(np.float32), np.log(np.maximum(pairs, 1e-300) / np.maximum(after[:, class_of], 1e-300)).astype(np.float32))


class Parameters:
    """All weights as views of one vector."""

    def __init__(self, symbols: int, flat: np.ndarray | None = None) -> None:
        d = WIDTH
        shapes = {"e": (symbols, d), "p": (WINDOW, d), "q": (d, d), "k": (d, d), "v": (d, d), "u": (d, CLASSES)}
        new = flat is None
        self.flat = np.zeros(self.size(symbols), np.float32) if new else flat.astype(np.float32, copy=False)
        at = 0
        for name, (a, b) in shapes.items():
            setattr(self, name, self.flat[at : at + a * b].reshape(a, b))
            at += a * b
        if new:
            rng = np.random.default_rng(17)
            self.e[...] = rng.normal(0, 0.5, self.e.shape)
            self.p[...] = rng.normal(0, 0.1, self.p.shape)
            for w in (self.q, self.k, self.v):
                w[...] = np.eye(d) * 0.5 + rng.normal(0, 0.1, w.shape)
            self.u[...] = rng.normal(0, 0.02, self.u.shape)

    @staticmethod
    def size(symbols: int) -> int:
        return WIDTH * (symbols + WINDOW + 3 * WIDTH + CLASSES)


_ONES = np.ones(max(WINDOW, CLASSES), np.float32)
_CAUSAL = np.where(np.arange(WINDOW)[None, :] <= np.arange(WINDOW)[:, None], np.float32(0), _NEVER)


class Room:
    """Arrays that one call after the other fills: memory that a call gave back would be mapped and cleared again in the next."""

    def __init__(self, windows: int, symbols: int, width: int = WIDTH * 3) -> None:
        new = lambda *shape: np.empty((windows, *shape), np.float32)
        # not like weights that were broadcast: these have a type of their own, with which add.at is 15 times as slow
        self.g = Parameters(symbols, np.empty(Parameters.size(symbols), np.float32))
        self.rows = np.arange(0, windows * STRIDE * CLASSES, CLASSES)
        self.x, self.dx, self.qkv, self.dqkv = new(WINDOW, WIDTH), new(WINDOW, WIDTH), new(WINDOW, width), new(WINDOW, width)
        self.s, self.da = new(STRIDE, WINDOW), new(STRIDE, WINDOW)
        self.ctx, self.some, self.dctx = new(STRIDE, WIDTH), new(STRIDE, WIDTH), new(STRIDE, WIDTH)
        self.sums = new(STRIDE, WIDTH + 1)
        self.z, self.after = new(STRIDE, CLASSES), new(STRIDE, CLASSES)
        self.places, self.place = np.arange(symbols * WIDTH).reshape(symbols, WIDTH), np.empty((windows, WINDOW, WIDTH), np.int64)


@functools.lru_cache(2)
def _room(windows: int, symbols: int) -> Room:
    return Room(windows, symbols)


def gradient(p: Parameters, after: np.ndarray, symbol: np.ndarray, target: np.ndarray, first: np.ndarray) -> tuple[float, int, np.ndarray]:
    """Loss and gradient over windows, summed over scored places, and the count of these.

    Input symbols (windows, WINDOW); classes of the symbols at the last STRIDE
    places (windows, STRIDE), -1: not scored; whether LEAD places are padding.

    Odds are never divided by their sums: a row's sum divides the short vectors
    that its odds are multiplied with.
    """
    b, d = len(symbol), WIDTH
    room = _room(max(b, GRADIENT_WINDOWS), len(p.e))
    g = room.g
    scale = np.float32(1 / np.sqrt(d))
    w = np.concatenate([p.q * scale, p.k, p.v], 1)
    x = p.e.take(symbol, 0, out=room.x[:b], mode="clip")
    x.reshape(b, -1)[...] += p.p.ravel()
    x = x.reshape(-1, d)
    qkv = room.qkv[:b]
    np.matmul(x, w, out=qkv.reshape(-1, 3 * d))
    q, k, v = qkv[:, LEAD:, :d], qkv[:, :, d : 2 * d], qkv[:, :, 2 * d :]
    s = np.matmul(q, k.transpose(0, 2, 1), out=room.s[:b])
    far = max(s.max(initial=0), -s.min(initial=0)) > HIGHEST
    s += _CAUSAL[LEAD:]
    s[first, :, :LEAD] = _NEVER
    if far:
        s -= s.max(-1, keepdims=True)
    np.exp(s, out=s)
    share = 1 / (s.reshape(-1, WINDOW) @ _ONES[:WINDOW])[:, None]
    ctx = np.matmul(s, v, out=room.ctx[:b]).reshape(-1, d)
    ctx *= share
    z = np.matmul(ctx, p.u, out=room.z[:b].reshape(-1, CLASSES))
    if max(z.max(initial=0), -z.min(initial=0)) > HIGHEST:
        np.clip(z, -HIGHEST, HIGHEST, out=z)
    np.exp(z, out=z)
    z *= after.take(symbol[:, LEAD:], 0, out=room.after[:b], mode="clip").reshape(-1, CLASSES)
    total = z @ _ONES[:CLASSES]
    t = target.ravel()
    scored = (t >= 0).astype(np.float32)
    at = room.rows[: len(t)] + np.maximum(t, 0)
    odds = z.reshape(-1)
    hit = odds[at]
    loss = -float(np.log(np.maximum(hit / total, 1e-30)) @ scored)
    odds[at] = hit - total
    part = (scored / total)[:, None]
    some, dctx = room.some[:b].reshape(-1, d), room.dctx[:b].reshape(-1, d)
    np.matmul(np.multiply(ctx, part, out=some).T, z, out=g.u)
    np.matmul(z, p.u.T, out=dctx)
    dctx *= part * share
    da = np.matmul(room.dctx[:b], v.transpose(0, 2, 1), out=room.da[:b])
    da -= np.einsum("ij,ij->i", dctx, ctx).reshape(b, STRIDE, 1)
    da *= s
    dqkv = room.dqkv[:b]
    dqkv[:, :LEAD, :d] = 0
    np.matmul(da, k, out=dqkv[:, LEAD:, :d])
    np.matmul(da.transpose(0, 2, 1), q, out=dqkv[:, :, d : 2 * d])
    np.matmul(s.transpose(0, 2, 1), room.dctx[:b], out=dqkv[:, :, 2 * d :])
    dqkv = dqkv.reshape(-1, 3 * d)
    dw = x.T @ dqkv
    np.multiply(dw[:, :d], scale, out=g.q)
    g.k[...], g.v[...] = dw[:, d : 2 * d], dw[:, 2 * d :]
    dx = np.matmul(dqkv, w.T, out=room.dx[:b].reshape(-1, d))
    g.e[...] = 0
    np.add.at(g.e.reshape(-1), room.places.take(symbol, 0, out=room.place[:b], mode="clip").ravel(), dx.ravel())
    g.p[...] = (np.ones(b, np.float32) @ dx.reshape(b, -1)).reshape(g.p.shape)
    return loss, int(scored.sum()), g.flat.copy()


class Adam:
    def __init__(self, size: int, rate: float = RATE) -> None:
        self.m, self.s, self.n, self.rate = np.zeros(size, np.float32), np.zeros(size, np.float32), 0, rate
        self.spare = np.empty(size, np.float32)

    def step(self, flat: np.ndarray, g: np.ndarray) -> None:
        self.n += 1
        t = np.multiply(g, np.float32(0.1), out=self.spare)
        self.m *= np.float32(0.9)
        self.m += t
        np.multiply(g, g, out=t)
        t *= np.float32(0.01)
        self.s *= np.float32(0.99)
        self.s += t
        np.sqrt(self.s, out=t)
        t *= np.float32(1 / np.sqrt(1 - 0.99**self.n))
        t += np.float32(1e-8)
        np.divide(self.m, t, out=t)
        t *= np.float32(self.rate / (1 - 0.9**self.n))
        flat -= t


class Windows:
    """Overlapping windows over symbol sequences: every symbol stands once among the last STRIDE places of one."""

    def __init__(self, known: np.ndarray, starts: np.ndarray) -> None:
        n = np.diff(starts)
        per = -(-n // STRIDE)
        self.doc = np.repeat(np.arange(len(n)), per)
        self.number = np.arange(len(self.doc)) - np.repeat(np.cumsum(per) - per, per)
        # inputs are the symbols one place earlier; before a document stands the end
        shifted = np.concatenate([np.zeros(LEAD + 1, known.dtype), known, np.zeros(WINDOW, known.dtype)])
        shifted[LEAD + starts[1:-1]] = 0
        padded = np.concatenate([known, np.zeros(WINDOW, known.dtype)])
        self.at = starts[self.doc] + self.number * STRIDE
        self.left = n[self.doc] - self.number * STRIDE
        self.inputs, self.targets = (np.lib.stride_tricks.sliding_window_view(x, w) for x, w in ((shifted, WINDOW), (padded, STRIDE)))


class Trainer:
    """Takes gradient steps on every window of the documents it is given, in an order that a generator mixes."""

    def __init__(self, vocabulary: Vocabulary, flat: np.ndarray, rate: float, seed: int) -> None:
        self.v, self.p = vocabulary, Parameters(vocabulary.symbols, flat.copy())
        self.adam, self.rng = Adam(len(flat), rate), np.random.default_rng(seed)
        self.sum, self.n, self.gradients, self.seen = np.zeros_like(self.p.flat), 0, 0, 0

    def documents(self, ids: np.ndarray, starts: np.ndarray) -> None:
        self.symbols(self.v.symbol_of[ids], starts)

    def symbols(self, known: np.ndarray, starts: np.ndarray) -> None:
        """``known``: symbols of documents one after the other, each ended by the end; ``starts``: where each begins, and the length."""
        w = Windows(known, starts)
        order, inner = self.rng.permutation(len(w.doc)), np.arange(STRIDE)
        for lo in range(0, len(order), FETCH):
            some = order[lo : lo + FETCH]
            at, left, first = w.at[some], w.left[some], w.number[some] == 0
            inputs, target = w.inputs[at], self.v.class_of.take(w.targets[at])
            ends = np.flatnonzero(left < STRIDE)
            target[ends] = np.where(inner < left[ends, None], target[ends], -1)
            for i in range(0, len(some), GRADIENT_WINDOWS):
                s = slice(i, i + GRADIENT_WINDOWS)
                _, n, g = gradient(self.p, self.v.after, inputs[s], target[s], first[s])
                self.sum += g
                self.n += n
                self.gradients += 1
                self.seen += len(first[s])
                if self.adam.n < FIRST_STEPS or self.gradients >= STEP_GRADIENTS:
                    self.step()

    def step(self) -> None:
        if self.n:
            self.sum /= np.float32(self.n)
            self.adam.step(self.p.flat, self.sum)
            self.sum[:] = 0
            self.n = self.gradients = 0


class Scorer:
    """Scores sequences: log probability (natural) of every document of a batch."""

    def __init__(self, vocabulary: Vocabulary, flat: np.ndarray) -> None:
        p, self.v = Parameters(vocabulary.symbols, flat), vocabulary
        scale = 1 / np.sqrt(WIDTH)
        # one row of (query, key, value) for each symbol, and for each place
        self.table = np.concatenate([p.e @ p.q * scale, p.e @ p.k, p.e @ p.v], 1)
        self.places = np.concatenate([p.p @ p.q * scale, p.p @ p.k, p.p @ p.v], 1)
        d = WIDTH
        far = lambda a, b, s: np.linalg.norm(a[:, s], axis=1).max(initial=0) + np.linalg.norm(b[:, s], axis=1).max(initial=0)
        qk = far(self.table, self.places, np.s_[:d]) * far(self.table, self.places, np.s_[d : 2 * d])
        if qk > HIGHEST:
            for t in (self.table, self.places):
                t[:, : 2 * d] *= np.sqrt(HIGHEST / qk)
        vu = far(self.table, self.places, np.s_[2 * d :]) * np.linalg.norm(p.u, axis=0).max(initial=0)
        self.u = (p.u * min(1.0, HIGHEST / max(vu, 1e-9))).astype(np.float32)
        # a last column of ones: the sum of the odds comes with their product
        add = lambda t, one: np.concatenate([t, np.full((len(t), 1), one)], 1).astype(np.float32)
        self.table, self.places = add(self.table, 1), add(self.places, 0)
        self.mask = _CAUSAL[LEAD:]
        self.room = Room(BLOCK, 0, 3 * WIDTH + 1)

    def windows(self, inputs: np.ndarray, first: np.ndarray, target: np.ndarray) -> np.ndarray:
        """log p(class) at the last STRIDE places. Symbols: inputs (windows, WINDOW); classes: target (windows, STRIDE); ``first`` windows have LEAD padded places."""
        b, d, room = len(inputs), WIDTH, self.room
        x = self.table.take(inputs, 0, out=room.qkv[:b], mode="clip")
        x += self.places
        a = np.matmul(x[:, LEAD:, :d], x[:, :, d : 2 * d].transpose(0, 2, 1), out=room.s[:b])
        a += self.mask
        a[first, :, :LEAD] = _NEVER
        np.exp(a, out=a)
        sums = np.matmul(a, x[:, :, 2 * d :], out=room.sums[:b])
        ctx = np.divide(sums[:, :, :d], sums[:, :, d:], out=room.ctx[:b]).reshape(-1, d)
        z = np.matmul(ctx, self.u, out=room.z[:b].reshape(-1, CLASSES))
        at = room.rows[: len(z)] + target.ravel()
        after = self.v.after.take(inputs[:, LEAD:], 0, out=room.after[:b], mode="clip").reshape(-1, CLASSES)
        lp = z.reshape(-1)[at]
        np.exp(z, out=z)
        lp += np.log(after.reshape(-1)[at] / np.einsum("bc,bc->b", after, z))
        return lp.reshape(b, STRIDE)

    def symbols(self, known: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Log probability of the classes of every document's symbols. ``known``: documents one after the other, each ended by the end; ``starts``: where each begins, and the length."""
        w = Windows(known, starts)
        out = np.zeros(len(starts) - 1)
        inner = np.arange(STRIDE)
        for lo in range(0, len(w.doc), FETCH):
            at, left, first, doc = (x[lo : lo + FETCH] for x in (w.at, w.left, w.number == 0, w.doc))
            inputs, target = w.inputs[at], self.v.class_of.take(w.targets[at])
            lp = np.concatenate([self.windows(inputs[i : i + BLOCK], first[i : i + BLOCK], target[i : i + BLOCK]) for i in range(0, len(at), BLOCK)])
            ends = np.flatnonzero(left < STRIDE)
            lp[ends] = np.where(inner < left[ends, None], lp[ends], 0)
            low = doc[0]
            some = np.bincount(doc - low, lp.sum(1, dtype=np.float64))
            out[low : low + len(some)] += some
        return out

    def documents(self, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """``ids``: documents one after the other, each ended by the end id; ``starts``: where each begins, and the length."""
        return self.symbols(self.v.symbol_of[ids], starts) + self.v.fixed(ids, starts)
