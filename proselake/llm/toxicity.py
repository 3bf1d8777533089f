"""Toxicity: a bidirectional gated recurrent network with attention pooling over character and word inputs, trained in numpy.

A word is a run of ASCII letters, digits and non-ASCII bytes. Its inputs are a learned vector of the word, the mean of
learned vectors of its 5-byte character grams (word edges count as a character), and four numbers: how much likelier its grams
(most and mean) and the word are in texts labelled 1 than in others, and its length. A window of ``WINDOW`` words starts at every
word up to the last full one, so any span of that length lies whole in one; a text's score is that of its strongest window,
through a logistic fit on the training texts. Gradient steps take windows that start every ``STRIDE`` words, and one that ends
at the last word; they move the network and the vectors.

The network is fitted on the driver on a bounded sample of labelled texts (``MOST_TOXIC``, ``MOST_CLEAN`` rows, ``MOST_BYTES``
in all of either label); scoring runs where the texts are and adds no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import LOWER, blocks, cut, splitmix, utf8, word_hashes

#: Labelled texts that the fit takes at most, and bytes of all texts of a label; the texts of the smallest hashed ids.
MOST_TOXIC, MOST_CLEAN, MOST_BYTES = 700, 1400, 3 << 20
LOOKED_UP = 8
#: Gradient steps before and after the choice of windows is renewed, and windows in each.
STEPS, BATCH = (150, 300), 384
WINDOW, STRIDE = 12, 8
#: Numbers of a word's log odds and length, of its own vector, and of its grams' vector.
STATIC, LEARNED = 4, 6
HIDDEN, INPUTS, POOL = 6, STATIC + 2 * LEARNED, 6
TABLE, VECTORS = 1 << 20, 1 << 16
#: Bytes of text that are read at once, and windows that one pass scores.
READ, PASS = 1 << 18, 4096
#: Strength of the prior that a gram says nothing.
PRIOR = 4.0
SEED = 7

_LETTER = np.zeros(256, bool)
_LETTER[48:58] = _LETTER[97:123] = _LETTER[128:] = True


@dataclass
class Tables:
    """Log odds of a character gram and of a word, and the learned vectors of both, by hash."""

    grams: np.ndarray
    words: np.ndarray
    gram_vectors: np.ndarray
    word_vectors: np.ndarray


@dataclass
class Words:
    """The words of some texts: the different ones by key, hashed grams, hash and length, the number of each word, where each text's words begin."""

    key: np.ndarray
    gram: np.ndarray
    gram_of: np.ndarray
    word: np.ndarray
    length: np.ndarray
    number: np.ndarray
    edge: np.ndarray


def read_words(data: np.ndarray, at: np.ndarray) -> Words:
    """Of the texts data[at[i]:at[i + 1]], with at[0] = 0."""
    n = len(at) - 1
    held = np.full(len(data) + n + 1 + 4, 32, np.uint8)  # a blank before each text and some behind
    low = LOWER[data]
    low[~_LETTER[low]] = 32
    for i in range(n):
        held[at[i] + i + 1 : at[i + 1] + i + 1] = low[at[i] : at[i + 1]]
    at = at + np.arange(n + 1) + 1  # text i is held[at[i]:at[i + 1] - 1]
    inside = held != 32
    starts = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
    ends = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
    key, first, number = np.unique(word_hashes(held, starts, ends), return_index=True, return_inverse=True)
    length = (ends - starts)[first]
    size = np.maximum(length - 2, 0)  # grams of five that begin at the blank before the word
    gram_of = np.repeat(np.arange(len(key)), size)
    place = np.arange(len(gram_of)) - np.repeat(np.cumsum(size) - size, size) + starts[first][gram_of] - 1
    gram = np.zeros(len(place), np.uint64)
    for k in range(5):
        gram |= held[place + k].astype(np.uint64) << np.uint64(8 * k)
    gram = (gram * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)
    word = splitmix(key) & np.uint64(TABLE - 1)
    return Words(key, gram.astype(np.int32), gram_of.astype(np.int32), word.astype(np.int32), length, number, np.searchsorted(starts, at))


def read_all(texts: list[bytes]) -> Words:
    """The words of texts that are read in blocks."""
    at = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
    parts = [read_words(np.frombuffer(b"".join(texts[a:b]), np.uint8), at[a : b + 1] - at[a]) for a, b in blocks(at, READ)]
    if not parts:
        return read_words(np.zeros(0, np.uint8), np.zeros(1, np.int64))
    key, first, number = np.unique(np.concatenate([p.key for p in parts]), return_index=True, return_inverse=True)
    before = np.concatenate(([0], np.cumsum([len(p.key) for p in parts])))
    gram_of = np.concatenate([p.gram_of + np.int64(k) for p, k in zip(parts, before, strict=False)])
    new = np.full(before[-1], -1, np.int64)  # the number of a part's word that is taken as the first of its key
    new[first] = np.arange(len(key))
    gram_of = new[gram_of]
    order = np.argsort(gram_of, kind="stable")
    order = order[np.searchsorted(gram_of[order], 0) :]
    one = lambda name: np.concatenate([getattr(p, name) for p in parts])
    words = np.concatenate([number[k : k + len(p.key)][p.number] for p, k in zip(parts, before, strict=False)])
    ends = np.cumsum([len(p.number) for p in parts])
    edge = np.concatenate([p.edge[:-1] + (e - len(p.number)) for p, e in zip(parts, ends, strict=True)] + [ends[-1:]])
    return Words(key, one("gram")[order], gram_of[order].astype(np.int32), one("word")[first], one("length")[first], words, edge)


def word_inputs(w: Words, t: Tables) -> np.ndarray:
    """A row of inputs for each different word, and one of zeros."""
    n = len(w.word)
    x = np.zeros((n + 1, INPUTS), np.float32)
    if not n:
        return x
    if len(w.gram):
        some, begin, count = np.unique(w.gram_of, return_index=True, return_counts=True)
        x[some, 0] = np.maximum.reduceat(t.grams[w.gram], begin)
        x[some, 1] = np.add.reduceat(t.grams[w.gram], begin) / count
        x[some, STATIC + LEARNED :] = np.add.reduceat(t.gram_vectors[w.gram & VECTORS - 1], begin, axis=0) / count[:, None]
    x[:-1, 2] = t.words[w.word]
    x[:-1, 3] = np.minimum(w.length, 16) / 16
    x[:-1, STATIC : STATIC + LEARNED] = t.word_vectors[w.word & VECTORS - 1]
    return x


def features(w: Words, t: Tables) -> np.ndarray:
    """A row of inputs for each word of the texts, and one of zeros."""
    return word_inputs(w, t)[np.append(w.number, len(w.word))]


def fresh_vectors(rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of grams and of words before any step: all but zero, so that a word never seen says little."""
    return tuple((0.01 * rng.standard_normal((VECTORS, LEARNED))).astype(np.float32) for _ in range(2))


def tables(w: Words, labels: np.ndarray, rows: np.ndarray, vectors: tuple[np.ndarray, np.ndarray]) -> Tables:
    """Log odds over the texts ``rows``: in how many of each label a gram or word is."""
    toxic, clean = float(labels[rows].sum()), float((1 - labels[rows]).sum())
    base = toxic / (toxic + clean)
    chosen = np.zeros(len(labels), bool)
    chosen[rows] = True
    text = np.repeat(np.arange(len(labels)), np.diff(w.edge))
    n = max(1, len(w.word))
    once = np.unique((text * n + w.number)[chosen[text]])  # a text's different words
    text, number = once // n, once % n

    def odds(pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        n, t = np.zeros(TABLE, np.int64), np.zeros(TABLE)
        for key, of in pairs:  # of some texts at a time, each text whole
            once = np.unique(of * TABLE + key)
            of, key = once // TABLE, once % TABLE
            n += np.bincount(key, minlength=TABLE)
            t += np.bincount(key, weights=labels[of], minlength=TABLE)
        out = np.log((t + PRIOR * base) / (toxic + PRIOR)) - np.log((n - t + PRIOR * (1 - base)) / (clean + PRIOR))
        out[n == 0] = 0
        return np.clip(out / 2, -3, 3).astype(np.float32)

    size = np.bincount(w.gram_of, minlength=n)
    begin = np.cumsum(size) - size
    cuts = np.searchsorted(text, np.arange(0, len(labels) + 64, 64))

    def words() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield w.word[number[a:b]].astype(np.int64), text[a:b]

    def grams() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for a, b in zip(cuts, cuts[1:], strict=False):
            many = size[number[a:b]]
            place = np.repeat(begin[number[a:b]] - (np.cumsum(many) - many), many) + np.arange(many.sum())
            yield w.gram[place].astype(np.int64), np.repeat(text[a:b], many)

    return Tables(odds(grams()), odds(words()), *vectors)


def windows(edge: np.ndarray, blank: int) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of a window every ``STRIDE`` words (rows of WINDOW; ``blank`` fills short texts) and its text."""
    n = np.diff(edge)
    count = np.where(n > WINDOW, -(-(n - WINDOW) // STRIDE) + 1, (n > 0).astype(np.int64))
    of = np.repeat(np.arange(len(n)), count)
    k = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    begin = edge[of] + np.minimum(k * STRIDE, np.maximum(0, n[of] - WINDOW))
    index = begin[:, None] + np.arange(WINDOW)
    index[index >= edge[of + 1][:, None]] = blank
    return index, of


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.clip(x, -30, 30, out=x)
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


@dataclass
class Network:
    """Weights by name; the two directions are ``f`` and ``b``."""

    w: dict[str, np.ndarray] = field(default_factory=dict)

    @staticmethod
    def fresh(rng: np.random.Generator) -> Network:
        def draw(*shape: int) -> np.ndarray:
            return (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

        w = {"A": draw(2 * HIDDEN, POOL), "v": draw(POOL), "o": draw(2 * HIDDEN), "o0": np.zeros(1, np.float32)}
        for d in "fb":
            w |= {f"W{d}": draw(INPUTS, 3 * HIDDEN), f"c{d}": np.zeros(3 * HIDDEN, np.float32), f"U{d}": draw(HIDDEN, 2 * HIDDEN), f"N{d}": draw(HIDDEN, HIDDEN)}
        return Network(w)

    def states(self, x: np.ndarray, index: np.ndarray, d: str, kept: list | None = None) -> np.ndarray:
        """Hidden states (time, window, HIDDEN) of one direction; ``kept`` gets what the gradient needs."""
        return self._states(x @ self.w[f"W{d}"] + self.w[f"c{d}"], index, d, kept)

    def _states(self, projected: np.ndarray, index: np.ndarray, d: str, kept: list | None = None) -> np.ndarray:
        u, m = self.w[f"U{d}"], self.w[f"N{d}"]
        h = np.zeros((len(index), HIDDEN), np.float32)
        out = np.empty((WINDOW, len(index), HIDDEN), np.float32)
        for t in range(WINDOW) if d == "f" else range(WINDOW - 1, -1, -1):
            p = projected[index[:, t]]
            g = _sigmoid(p[:, : 2 * HIDDEN] + h @ u)
            z, r = g[:, :HIDDEN], g[:, HIDDEN:]
            hm = h @ m
            n = np.tanh(p[:, 2 * HIDDEN :] + r * hm)
            new = n + z * (h - n)
            if kept is not None:
                kept.append((t, h, z, r, hm, n))
            h = out[t] = new
        return out

    def pool(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Logits, and what the gradient needs, of states (time, window, 2 * HIDDEN)."""
        a = np.tanh(s @ self.w["A"])
        e = a @ self.w["v"]
        e = np.exp(e - e.max(axis=0))
        alpha = e / e.sum(axis=0)
        c = (alpha[:, :, None] * s).sum(axis=0)
        return c @ self.w["o"] + self.w["o0"][0], a, alpha, c

    def logits(self, x: np.ndarray, index: np.ndarray) -> np.ndarray:
        projected = {d: x @ self.w[f"W{d}"] + self.w[f"c{d}"] for d in "fb"}
        out = [
            self.pool(np.concatenate([self._states(projected[d], i, d) for d in "fb"], axis=2))[0]
            for i in (index[k : k + PASS] for k in range(0, len(index), PASS))
        ]
        return np.concatenate(out) if out else np.zeros(0, np.float32)

    def strongest(self, inputs: np.ndarray, number: np.ndarray, edge: np.ndarray) -> np.ndarray:
        """The largest logit of all windows of each text, -inf without a word; ``inputs`` by word number, the last row blank.

        The texts lie one behind the other, those shorter than a window filled with blanks; the windows that start at
        neighbouring words take neighbouring columns, so no word is gathered twice.
        """
        best = np.full(len(edge) - 1, -np.inf)
        n = np.diff(edge)
        room = np.where(n > 0, np.maximum(n, WINDOW), 0)
        last = np.cumsum(room)
        total = int(last[-1]) if len(last) else 0
        if not total:
            return best
        line = np.full(total, len(inputs) - 1, np.int64)
        line[np.arange(len(number)) + np.repeat(last - room - edge[:-1], n)] = number
        projected = [(inputs @ self.w[f"W{d}"] + self.w[f"c{d}"]).T.astype(np.float32) for d in "fb"]
        of = np.repeat(np.arange(len(n)), room)
        for a in range(0, total - WINDOW + 1, PASS):
            m = min(PASS, total - WINDOW + 1 - a)
            words = line[a : a + m + WINDOW - 1]
            logit = self._columns([np.ascontiguousarray(p[:, words]) for p in projected], m)
            own = of[a : a + m]
            whole = own == of[a + WINDOW - 1 : a + m + WINDOW - 1]
            np.maximum.at(best, own[whole], logit[whole].astype(np.float64))
        return best

    def _columns(self, projected: list[np.ndarray], m: int) -> np.ndarray:
        """Logits of m windows, window k on columns k to k + WINDOW - 1 of both directions' projected words."""
        out = np.empty((WINDOW, 2 * HIDDEN, m), np.float32)
        for k, d in enumerate("fb"):
            both = np.ascontiguousarray(np.concatenate([self.w[f"U{d}"], self.w[f"N{d}"]], axis=1).T)
            h = np.zeros((HIDDEN, m), np.float32)
            for t in range(WINDOW) if d == "f" else range(WINDOW - 1, -1, -1):
                p = projected[k][:, t : t + m]
                q = both @ h
                g = q[: 2 * HIDDEN]
                g += p[: 2 * HIDDEN]
                g *= 0.5
                np.tanh(g, out=g)
                g *= 0.5
                g += 0.5
                z, r, new = g[:HIDDEN], g[HIDDEN:], q[2 * HIDDEN :]
                new *= r
                new += p[2 * HIDDEN :]
                np.tanh(new, out=new)
                h = h - new
                h *= z
                h += new
                out[t, k * HIDDEN : (k + 1) * HIDDEN] = h
        a = np.ascontiguousarray(self.w["A"].T)
        e = np.stack([self.w["v"] @ np.tanh(a @ s) for s in out])
        e -= e.max(axis=0)
        np.exp(e, out=e)
        e /= e.sum(axis=0)
        c = out[0] * e[0]
        for t in range(1, WINDOW):
            c += out[t] * e[t]
        return self.w["o"] @ c + self.w["o0"][0]

    def gradient(self, x: np.ndarray, index: np.ndarray, y: np.ndarray, weight: np.ndarray, inputs: np.ndarray | None = None) -> dict[str, np.ndarray]:
        """Of the weighted mean log loss; ``inputs`` (window, time, INPUTS) gets that of the words' inputs added."""
        kept = {"f": [], "b": []}
        s = np.concatenate([self.states(x, index, d, kept[d]) for d in "fb"], axis=2)
        logit, a, alpha, c = self.pool(s)
        dl = ((_sigmoid(logit.copy()) - y) * weight / weight.sum()).astype(np.float32)
        g = {"o": c.T @ dl, "o0": np.array([dl.sum()], np.float32)}
        dc = dl[:, None] * self.w["o"]
        ds = alpha[:, :, None] * dc
        dalpha = (s * dc).sum(axis=2)
        de = alpha * (dalpha - (alpha * dalpha).sum(axis=0))
        da = de[:, :, None] * self.w["v"] * (1 - a * a)
        g["v"] = np.tensordot(de, a, 2)
        g["A"] = np.tensordot(s, da, ((0, 1), (0, 1)))
        ds += da @ self.w["A"].T
        for d, own in (("f", ds[:, :, :HIDDEN]), ("b", ds[:, :, HIDDEN:])):
            w, u, m = self.w[f"W{d}"], self.w[f"U{d}"], self.w[f"N{d}"]
            g |= {f"W{d}": np.zeros_like(w), f"c{d}": np.zeros(3 * HIDDEN, np.float32), f"U{d}": np.zeros_like(u), f"N{d}": np.zeros_like(m)}
            dh = np.zeros((len(index), HIDDEN), np.float32)
            for t, h, z, r, hm, n in reversed(kept[d]):
                dh = dh + own[t]
                dn = dh * (1 - z) * (1 - n * n)
                dz = dh * (h - n) * z * (1 - z)
                dr = dn * hm * r * (1 - r)
                dg = np.concatenate([dz, dr], axis=1)
                g[f"U{d}"] += h.T @ dg
                g[f"N{d}"] += h.T @ (dn * r)
                dp = np.concatenate([dg, dn], axis=1)
                g[f"W{d}"] += x[index[:, t]].T @ dp
                g[f"c{d}"] += dp.sum(axis=0)
                if inputs is not None:
                    inputs[:, t] += dp @ w.T
                dh = dh * z + dg @ u.T + (dn * r) @ m.T
        return g


@dataclass
class Model:
    """What scoring needs; a network of None scores everything 0."""

    tables: Tables | None = None
    network: Network | None = None
    slope: float = 1.0
    offset: float = 0.0

    def score(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The score of each text data[at[i]:at[i + 1]]; 0 without a word."""
        out = np.zeros(len(at) - 1)
        if self.network is None:
            return out
        w = read_words(data, at)
        best = self.network.strongest(word_inputs(w, self.tables), w.number, w.edge)
        some = np.isfinite(best)
        out[some] = 1 / (1 + np.exp(-np.clip(self.slope * best[some] + self.offset, -50, 50)))
        return out


class _Descent:
    """Steps over the log loss with both labels weighing alike: Adam for the network, steps by summed squares for the vectors.

    ``x`` holds a row for each word and half, the blank row last; row k is of word k % (number of words).
    """

    def __init__(self, net: Network, rng: np.random.Generator, words: Words, vectors: tuple[np.ndarray, np.ndarray]):
        self.net, self.rng, self.step, self.words = net, rng, 0, words
        self.first, self.second = ({k: np.zeros_like(v) for k, v in net.w.items()} for _ in range(2))
        self.vectors, self.squares = vectors, tuple(np.full_like(v, 1e-8) for v in vectors)
        size = np.bincount(words.gram_of, minlength=max(1, len(words.word)))
        self.begin, self.size = np.cumsum(size) - size, size

    def _renew(self, x: np.ndarray, rows: np.ndarray) -> None:
        """The learned inputs of the words ``rows`` from the vectors, in both halves."""
        n = len(self.words.word)
        size = self.size[rows]
        place = np.repeat(self.begin[rows] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        mean = np.zeros((len(rows), LEARNED), np.float32)
        np.add.at(mean, np.repeat(np.arange(len(rows)), size), self.vectors[0][self.words.gram[place] & VECTORS - 1])
        mean /= np.maximum(1, size)[:, None]
        for k in (0, n):
            x[rows + k, STATIC + LEARNED :] = mean
            x[rows + k, STATIC : STATIC + LEARNED] = self.vectors[1][self.words.word[rows] & VECTORS - 1]

    def _move(self, rows: np.ndarray, slope: np.ndarray) -> None:
        """A step of the vectors of the words ``rows`` against the slopes of their learned inputs."""
        size = self.size[rows]
        place = np.repeat(self.begin[rows] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        of_gram = np.repeat(slope[:, LEARNED:] / np.maximum(1, size)[:, None], size, axis=0)
        for k, (key, g) in enumerate(((self.words.gram[place], of_gram), (self.words.word[rows], slope[:, :LEARNED]))):
            key, own = np.unique(key & VECTORS - 1, return_inverse=True)
            g = np.stack([np.bincount(own, weights=c, minlength=len(key)) for c in g.T], axis=1)
            self.squares[k][key] += g * g
            self.vectors[k][key] -= (0.05 * g / np.sqrt(self.squares[k][key])).astype(np.float32)

    def run(self, x: np.ndarray, index: np.ndarray, y: np.ndarray, steps: int) -> None:
        weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())).astype(np.float32)
        blank, n = len(x) - 1, len(self.words.word)
        for _ in range(steps):
            self.step += 1
            i = self.rng.integers(0, len(y), BATCH)
            rate = 0.03 if self.step <= 150 else 0.01
            used = index[i]
            rows, own = np.unique(used, return_inverse=True)
            slope = np.zeros((*used.shape, INPUTS), np.float32)
            for name, g in self.net.gradient(x[rows], own.reshape(used.shape), y[i], weight[i], slope).items():
                g = np.clip(g, -1, 1)
                self.first[name] = 0.9 * self.first[name] + 0.1 * g
                self.second[name] = 0.99 * self.second[name] + 0.01 * g * g
                move = self.first[name] / (1 - 0.9**self.step) / (np.sqrt(self.second[name] / (1 - 0.99**self.step)) + 1e-6)
                self.net.w[name] -= (rate * move).astype(np.float32)
            real = used != blank
            rows, own = np.unique(used[real] % n, return_inverse=True)
            of_word = np.stack([np.bincount(own, weights=c, minlength=len(rows)) for c in slope[real][:, STATIC:].T], axis=1)
            self._move(rows, of_word)
            self._renew(x, rows)


def fit(texts: list[bytes], labels: np.ndarray) -> Model:
    """A model of the texts' labels (0 or 1); one that scores 0 if either label is missing.

    Inputs of each half of the texts come from the other half's log odds, as they do for new texts. Of a text
    labelled 1 the strongest window by inputs counts as such, of others the strongest and one at random as 0;
    after some steps the network's own choice of strongest windows replaces the first.
    """
    labels = np.asarray(labels, dtype=np.int64)
    if labels.sum() in (0, len(labels)):
        return Model()
    rng = np.random.default_rng(SEED)
    w = read_all(texts)
    n, vectors = len(w.word), fresh_vectors(rng)
    if not n:
        return Model()
    half = rng.permutation(len(texts)) % 2
    text = np.repeat(np.arange(len(texts)), np.diff(w.edge))
    x = np.zeros((2 * n + 1, INPUTS), np.float32)  # a row for each word and half, and a blank one
    for k in (0, 1):
        x[k * n : (k + 1) * n] = word_inputs(w, tables(w, labels, np.flatnonzero(half != k), vectors))[:-1]
    number = w.number + n * half[text]  # a word's row of x
    index, of = windows(w.edge, len(number))
    index = np.append(number, 2 * n)[index]
    strength = x[index, 0].max(axis=1) + x[index, 2].max(axis=1)
    net = Network.fresh(rng)
    descent = _Descent(net, rng, w, vectors)
    for k, steps in enumerate(STEPS):
        if k:
            descent._renew(x, np.arange(n))
            strength = net.logits(x, index)
        order = np.lexsort((-strength, of))
        top = order[np.flatnonzero(np.concatenate(([True], of[order][1:] != of[order][:-1])))]
        other = rng.choice(len(of), size=min(len(of), len(texts)), replace=False)
        other = other[labels[of[other]] == 0]
        chosen = np.concatenate([top, other])
        descent.run(x, index[chosen], labels[of[chosen]].astype(np.float32), steps)
    descent._renew(x, np.arange(n))
    best = net.strongest(x, number, w.edge)
    some = np.isfinite(best)
    slope, offset = _logistic(best[some], labels[some])
    return Model(tables(w, labels, np.arange(len(texts)), vectors), net, slope, offset)


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a one-dimensional logistic fit, by damped Newton steps."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([((p - y) * x).sum() + 0.1 * (a - 1), (p - y).sum()])
        q = p * (1 - p)
        h = np.array([[(q * x * x).sum() + 0.1, (q * x).sum()], [(q * x).sum(), q.sum() + 1e-3]])
        da, db = np.clip(np.linalg.solve(h, g), -1, 1)
        a, b = max(0.05, a - da), b - db
    return float(a), float(b)


def held_out(doc_id: str = "doc_id"):
    """Whether a row's labels are not learned from: crc32 of its id as text is divisible by 5."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit on labelled rows that are not held out: of either label those with the smallest hashed ids, up to a number of rows and of bytes.

    ``LOOKED_UP`` times as many labelled ids are looked up, since some may have no text. The sample ends where a label's texts
    add up to ``MOST_BYTES``; texts of any length up to that take part. Of rows that repeat an id the one of the smallest
    text digest teaches.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id IS NOT NULL AND y IN (0, 1)")
    known = known.where(~held_out("id")).groupBy("id").agg(F.max("y").alias("y"))
    order = (F.xxhash64("id"), F.col("id"))
    first = [known.where(F.col("y") == y).orderBy(*order).limit(LOOKED_UP * n) for y, n in ((1, MOST_TOXIC), (0, MOST_CLEAN))]
    asked = F.broadcast(first[0].unionByName(first[1]))  # at most LOOKED_UP * (MOST_TOXIC + MOST_CLEAN) rows
    whole = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.octet_length("text").between(1, MOST_BYTES))
    whole = cut(whole.join(asked, "id").select("id", "y", "text", F.octet_length("text").alias("bytes"), F.md5(F.col("text").cast("binary")).alias("key")))
    least = whole.groupBy("id", "y").agg(F.min(F.struct("key", "bytes")).alias("t")).select("id", "y", "t.key", "t.bytes")
    sample = [least.where(F.col("y") == y).orderBy(*order).limit(n) for y, n in ((1, MOST_TOXIC), (0, MOST_CLEAN))]
    so_far = F.sum("bytes").over(Window.partitionBy("y").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    chosen = sample[0].unionByName(sample[1]).withColumn("so_far", so_far).where(F.col("so_far") <= MOST_BYTES)
    rows = whole.join(F.broadcast(chosen.select("id", "key")), ["id", "key"]).select("id", "y", "text").dropDuplicates(["id"]).toArrow()
    data, at = utf8(rows.column("text"))
    texts = [data[at[i] : at[i + 1]].tobytes() for i in range(len(rows))]
    held = sorted(zip(rows.column("id").to_pylist(), texts, rows.column("y").to_pylist(), strict=True))
    return fit([t for _, t, _ in held], np.array([y for _, _, y in held], dtype=np.int64))


def _scores(model: Model, column: pa.Array) -> np.ndarray:
    data, at = utf8(column)
    out = [model.score(data[at[a] : at[b]], at[a : b + 1] - at[a]) for a, b in blocks(at, READ)]
    return np.concatenate(out) if out else np.zeros(0)


def scorer(model: Model, docs: DataFrame, text_at: int, keep: Callable[[np.ndarray], np.ndarray] | None = None):
    """A mapInArrow function that adds each row's score, or with ``keep`` lets rows through as they are."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = _scores(held.value, batch.column(text_at))
            if keep is not None:
                yield batch.filter(pa.array(keep(score)))
            else:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], names=["doc_id", "score"])

    return run


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of documents.

    Labels come from rows that are not held out; labels, lang, source and doc_id are no inputs. Null, empty and
    wordless texts score 0. Without texts of both labels every score is 0. Rows with null labels or labels other
    than 0 and 1 teach nothing; an id labelled both 0 and 1 counts as 1; repeated rows are scored alike. Null ids are carried and
    not held out. Very long texts are scored whole, ``PASS`` windows at a time. Other columns are neither read nor returned.
    """
    model = train(docs, labels)
    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", "text").mapInArrow(scorer(model, docs, 1), f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, most: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, that score below ``most``; see toxicity_scores."""
    model = train(docs, labels)
    return docs.mapInArrow(scorer(model, docs, docs.columns.index("text"), lambda s: s < most), docs.schema)
