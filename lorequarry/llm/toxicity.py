"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

A text is lower-cased and cut to words; overlapping windows of ``WINDOW`` words, ``STRIDE``
apart, cover all of it. A word enters the network twice: as an entry of a hashed word table
and as the mean of hashed entries of its character 2-, 3- and 4-grams, so altered spellings
of a word stay near to it; a run of more than ``LONGEST`` bytes without a blank is cut to overlapping
pieces, each a word of its own, so all of it is read. Two gated recurrent layers read the window in both directions,
attention weights pool their states, and a logit follows. A text's logit is that of its worst
window; two numbers fitted on held-back training rows turn it to a score from 0 to 1.

Training (multiple instances: a label belongs to the worst window of its text) is plain
backpropagation through time with Adam, on all labelled rows but a fifth, by which the two
numbers are fitted. In each of ``ROUNDS`` rounds the tasks that hold the texts look up the worst
window of each, by all of its windows; these windows are dealt by a hash of the id to blocks of
about ``BLOCK``, every block goes on from the net of the round, and the mean of their nets (by rows)
is the next round's. No whole texts leave their tasks. Word and character entries start with the
shrunk log-odds of their bucket in the first coordinate, counted over all those rows, and are
pulled toward that start; the first state of either direction starts as a detector of high ones.
So some forty toxic texts are enough to find words that several of them share.

Defined results: a null text counts as empty; an empty text is scored as a window without
words; labels that are null or lack a document are ignored; with labels of one kind only (or
none) every score is the share of label 1 (0 without labels); extra columns are ignored.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import materialize, release
from .common import lean, small_batches, total
from .quality import labelled, vector
from .words import mix, slices

WINDOW, STRIDE = 32, 16  # a span of up to WINDOW - STRIDE + 1 words stands whole in a window
HIDDEN, WIDTH = 8, 8  # state of each direction; entries of either table
WORD_SLOTS, GRAM_SLOTS = 1 << 15, 1 << 15
BLOCK = 8192  # rows whose windows are learnt from together
ROUNDS, STEPS, BATCH = 2, 240, 64  # as many steps whatever the number of rows, but at least as many as bring in each
LEAD = 1.5
EVIDENCE, DROP, TABLE_RATE, PULL = 3.0, 0.1, 0.3, 0.5  # against learning the words of single texts by heart
LONGEST = 24  # bytes of a word; longer ones are cut to pieces of so many, half of them shared with the next
CACHE = 200_000  # runs of bytes that a worker remembers
CHUNK = 1024  # windows that are read together
FINE = 1024  # the steps of a logit in which held-back rows are counted
HELD = 5  # one labelled row in so many is for the scale of the scores
TOKEN = re.compile(rb"[^\x00-\x20]+")
EDGE = b"\".,;:!?()[]{}<>|*%$&#'`-_"


def pieces(w: bytes) -> list[bytes]:
    """What a run of bytes without a blank enters as: itself without its edges, or overlapping pieces of it."""
    w = w.strip(EDGE) or w
    half = LONGEST // 2
    return [w] if len(w) <= LONGEST else [w[i : i + LONGEST] for i in range(0, len(w) - half, half)]


def tokens(text: bytes) -> list[bytes]:
    return [p for w in text.lower().split() for p in pieces(w)]


def gram_slots(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(slots of all character grams, word after word; how many each word has). Words have at most LONGEST bytes."""
    flat = np.zeros((len(words), LONGEST + 2), np.uint64)
    raw = np.frombuffer(b"".join(w.ljust(LONGEST, b"\0") for w in words), np.uint8).reshape(len(words), LONGEST)
    flat[:, 1:-1] = raw
    size = np.fromiter(map(len, words), np.int64, len(words))
    flat[:, 0] = 1  # the word's start; its end is the zero that follows
    out, use = [], []
    for n in (2, 3, 4):
        h = np.full((len(words), LONGEST + 3 - n), n, np.uint64)
        for i in range(n):
            h = h * np.uint64(0x100000001B3) + flat[:, i : LONGEST + 3 - n + i]
        out.append((mix(h) % np.uint64(GRAM_SLOTS)).astype(np.int32))
        use.append(np.arange(LONGEST + 3 - n)[None, :] < np.maximum(1, size[:, None] + 3 - n))
    on = np.concatenate(use, 1)
    return np.concatenate(out, 1)[on], on.sum(1)


class Grams:
    """The character grams of a vocabulary."""

    def __init__(self, words: list[bytes]):
        parts = [gram_slots(words[i : i + 4096]) for i in range(0, len(words), 4096)]
        self.slots = np.concatenate([np.empty(0, np.int32), *[p[0] for p in parts]])
        self.count = np.concatenate([np.empty(0, np.int64), *[p[1] for p in parts]])
        self.start = np.cumsum(self.count) - self.count

    def take(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(slots, counts) of the words at these places."""
        n = self.count[at]
        return self.slots[np.repeat(self.start[at] - np.cumsum(n) + n, n) + np.arange(n.sum())], n


def mean_of(table: np.ndarray, slots: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The mean entry of each word's grams."""
    if not len(count):
        return np.zeros((0, table.shape[1]), np.float32)
    return np.add.reduceat(table[slots], np.cumsum(count) - count, 0) / count[:, None].astype(np.float32)


def sums_by_slot(slots: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """(n, width): the sum of the rows of each slot."""
    return np.stack([np.bincount(slots, rows[:, k], n) for k in range(rows.shape[1])], 1).astype(np.float32)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


@dataclass
class Net:
    """p: word, gram (tables); per direction d in fb: Wd (input), Ud (state), bd; att, out, bias."""

    p: dict[str, np.ndarray]
    slope: float = 1.0
    offset: float = 0.0
    constant: float | None = None

    @staticmethod
    def new(seed: int = 11) -> Net:
        r = np.random.default_rng(seed)
        f = lambda *s, scale=0.3: (r.standard_normal(s) * scale).astype(np.float32)
        p = {"word": f(WORD_SLOTS, WIDTH, scale=0.05), "gram": f(GRAM_SLOTS, WIDTH, scale=0.05), "att": f(2 * HIDDEN), "out": f(2 * HIDDEN), "bias": np.zeros(1, np.float32)}
        for d in "fb":
            p |= {f"W{d}": f(2 * WIDTH, 3 * HIDDEN), f"U{d}": f(HIDDEN, 3 * HIDDEN), f"b{d}": np.zeros(3 * HIDDEN, np.float32)}
            # the first state of either direction begins as a detector of words and grams with high log-odds
            for first in (0, WIDTH):
                p[f"W{d}"][first, [0, 2 * HIDDEN]] = LEAD
        for first in (0, HIDDEN):
            p["att"][first] = p["out"][first] = LEAD
        return Net(p)

    def inputs(self, words: list[bytes], slots: np.ndarray) -> np.ndarray:
        """(words, 2 * WIDTH): what enters for each distinct word."""
        return np.concatenate([self.p["word"][slots], mean_of(self.p["gram"], *gram_slots(words))], 1).astype(np.float32)

    def project(self, x: np.ndarray) -> np.ndarray:
        """(..., 2, 3 * HIDDEN): the input's share of the gates, once for each distinct word."""
        return np.stack([x @ self.p["Wf"] + self.p["bf"], x @ self.p["Wb"] + self.p["bb"]], -2)

    def run(self, g: np.ndarray, ids: np.ndarray, keep: bool = False):
        """Logits of windows. g: projected words, the last for 'no word'; ids: (windows, WINDOW), -1 for none."""
        n, h = len(ids), HIDDEN
        mask = (ids >= 0).astype(np.float32)
        states = np.zeros((n, WINDOW, 2 * h), np.float32)
        tape = {}
        for k, d in enumerate("fb"):
            s = np.zeros((n, h), np.float32)
            u = self.p[f"U{d}"]
            own = np.ascontiguousarray(g[:, k])
            for t in range(WINDOW) if d == "f" else range(WINDOW - 1, -1, -1):
                a = own[ids[:, t]]
                b = s @ u
                zr = a[:, : 2 * h] + b[:, : 2 * h]
                np.negative(zr, zr)
                np.exp(zr, zr)
                zr += 1
                np.reciprocal(zr, zr)
                z, r = zr[:, :h], zr[:, h:]
                c = np.tanh(a[:, 2 * h :] + r * b[:, 2 * h :])
                m = mask[:, t, None]
                new = s + (c - s) * (z * m)
                if keep:
                    tape[d, t] = (s, b, z, r, c, m)
                s = new
                states[:, t, k * h : (k + 1) * h] = s
        e = states @ self.p["att"]
        e = np.where(mask > 0, e, np.float32(-1e9))
        w = np.exp(e - e.max(1, keepdims=True))
        w *= mask
        w /= np.maximum(w.sum(1, keepdims=True), 1e-9)
        pooled = np.einsum("nt,nth->nh", w, states)
        logit = pooled @ self.p["out"] + self.p["bias"][0]
        return (logit, (states, w, pooled, mask, tape)) if keep else logit

    def read(self, g: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Logits of windows, as ``run`` has them but for rounding. Windows are the last axis, so that every step goes
        through whole rows. g: (2, words, 3 * HIDDEN), projected words by direction, the last for 'no word'."""
        n, h = len(ids), HIDDEN
        mask = np.ascontiguousarray(ids.T) >= 0
        at = np.where(mask, ids.T, g.shape[1] - 1)
        full = mask.all(1)
        states = np.empty((WINDOW, 2 * h, n), np.float32)
        a, b, zr = np.empty((n, 3 * h), np.float32), np.empty((3 * h, n), np.float32), np.empty((2 * h, n), np.float32)
        z, r = zr[:h], zr[h:]
        for k, d in enumerate("fb"):
            s, u = np.zeros((h, n), np.float32), np.ascontiguousarray(self.p[f"U{d}"].T)
            for t in range(WINDOW) if d == "f" else range(WINDOW - 1, -1, -1):
                np.take(g[k], at[t], 0, out=a, mode="clip")
                np.matmul(u, s, out=b)
                np.add(a.T[: 2 * h], b[: 2 * h], out=zr)
                np.negative(zr, zr)
                np.exp(zr, zr)
                zr += 1
                np.reciprocal(zr, zr)
                c = b[2 * h :]
                c *= r
                c += a.T[2 * h :]
                np.tanh(c, c)
                c -= s
                c *= z
                if not full[t]:
                    c *= mask[t]
                new = states[t, k * h : (k + 1) * h]
                np.add(s, c, out=new)
                s = new
        e = np.where(mask, np.einsum("h,thn->tn", self.p["att"], states), np.float32(-1e9))
        w = np.exp(e - e.max(0))
        w *= mask
        w /= np.maximum(w.sum(0), 1e-9)
        return np.einsum("tn,tn->n", w, np.einsum("h,thn->tn", self.p["out"], states)) + self.p["bias"][0]

    def back(self, ids: np.ndarray, tape, dl: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the parameters but the tables, and of the projected inputs (windows, WINDOW, 2, 3 * HIDDEN)."""
        states, w, pooled, mask, steps = tape
        h = HIDDEN
        grad = {"out": dl @ pooled, "bias": np.array([dl.sum()], np.float32)}
        dp = dl[:, None] * self.p["out"]
        dw = np.einsum("nh,nth->nt", dp, states)
        de = w * (dw - (w * dw).sum(1, keepdims=True))
        grad["att"] = np.einsum("nt,nth->h", de, states)
        ds = w[:, :, None] * dp[:, None, :] + de[:, :, None] * self.p["att"]
        dg = np.zeros((*ids.shape, 2, 3 * h), np.float32)
        for k, d in enumerate("fb"):
            u, du = self.p[f"U{d}"], np.zeros_like(self.p[f"U{d}"])
            carry = np.zeros((len(ids), h), np.float32)
            for t in range(WINDOW - 1, -1, -1) if d == "f" else range(WINDOW):
                s, b, z, r, c, m = steps[d, t]
                carry = carry + ds[:, t, k * h : (k + 1) * h]
                zm = z * m
                dc = carry * zm * (1 - c * c)
                dz = carry * (c - s) * m * z * (1 - z)
                dr = dc * b[:, 2 * h :] * r * (1 - r)
                db = np.concatenate([dz, dr, dc * r], 1)
                dg[:, t, k] = np.concatenate([dz, dr, dc], 1)
                du += s.T @ db
                carry = carry * (1 - zm) + db @ u.T
            grad[f"U{d}"] = du
        return grad, dg


def windows(ids: np.ndarray) -> np.ndarray:
    """(windows, WINDOW) of one text; at least one, -1 where no word is."""
    n = max(1, -(-(len(ids) - WINDOW) // STRIDE) + 1)
    out = np.full((n - 1) * STRIDE + WINDOW, -1, np.int32)
    out[: len(ids)] = ids
    return np.lib.stride_tricks.sliding_window_view(out, WINDOW)[::STRIDE]


def word_slot(words: list[bytes]) -> np.ndarray:
    return (mix(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))) % np.uint64(WORD_SLOTS)).astype(np.int32)


def log_odds(toxic: np.ndarray, clean: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """Of buckets, from the numbers of texts that hold them; shrunk where few do."""
    odds = np.log((toxic + 1) / (n1 + 2)) - np.log((clean + n0 / n1) / (n0 + 2 * n0 / n1))
    return np.clip(odds * (toxic + clean) / (toxic + clean + EVIDENCE), -3, 3) / 2


class Tally:
    """Of each bucket of words and of grams, how many (text, word of it) there are, by label; and how many texts."""

    def __init__(self):
        self.texts, self.word, self.gram, self.seen = np.zeros(2), np.zeros((2, WORD_SLOTS)), np.zeros((2, GRAM_SLOTS)), ({}, {})

    def add(self, text: bytes, label: int) -> None:
        self.texts[label] += 1
        own = self.seen[label]
        for w in set(tokens(text)):
            own[w] = own.get(w, 0) + 1
        if len(own) > 1 << 15:
            self.flush()

    def flush(self) -> None:
        for label, own in enumerate(self.seen):
            words, times = list(own), np.fromiter(own.values(), np.float64, len(own))
            self.word[label] += np.bincount(word_slot(words), times, WORD_SLOTS)
            for i in range(0, len(words), 4096):
                slots, count = gram_slots(words[i : i + 4096])
                self.gram[label] += np.bincount(slots, np.repeat(times[i : i + 4096], count), GRAM_SLOTS)
            own.clear()

    def vector(self) -> np.ndarray:
        self.flush()
        return np.concatenate([self.texts, self.word.ravel(), self.gram.ravel()])


def begin(tally: np.ndarray, seed: int) -> Net:
    """The net before training: log-odds start the first coordinates."""
    net = Net.new(seed)
    n0, n1 = tally[:2]
    word, gram = np.split(tally[2:], [2 * WORD_SLOTS])
    for k, v in (("word", word), ("gram", gram)):
        clean, toxic = v.reshape(2, -1)
        net.p[k][:, 0] = log_odds(toxic, clean, n1, n0)
    return net


def learn(net: Net, first: dict[str, np.ndarray], rows: list[list[bytes]], y: np.ndarray, share: float, seed: list[int], late: bool) -> Net:
    """The net after some batches of these windows, each given by its words. first: what the tables are pulled toward; share: of toxic rows, among all."""
    net = Net({k: v.copy() for k, v in net.p.items()})
    index: dict[bytes, int] = {}
    every = np.full((len(rows), WINDOW), -1, np.int32)
    for to, ws in zip(every, rows, strict=True):
        to[: len(ws)] = [index.setdefault(w, len(index)) for w in ws]
    words = list(index)
    slots, grams = word_slot(words), Grams(words)
    draw = np.random.default_rng(seed)
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share))

    def batches() -> Iterator[np.ndarray]:
        while True:
            order = draw.permutation(len(rows))
            yield from (order[i : i + BATCH] for i in range(0, len(order), BATCH))

    more = batches()
    for tick in range(1, 1 + max(STEPS, -(-len(rows) // BATCH))):
        at = next(more)
        ids = every[at]
        ids = np.where(draw.random(ids.shape) < DROP, -1, ids)
        uniq, inv = np.unique(ids, return_inverse=True)
        inv = inv.reshape(ids.shape)
        x = np.zeros((len(uniq), 2 * WIDTH), np.float32)
        real = np.flatnonzero(uniq >= 0)
        here, count = grams.take(uniq[real])
        if len(real):
            x[real] = np.concatenate([net.p["word"][slots[uniq[real]]], mean_of(net.p["gram"], here, count)], 1)
        logit, tape = net.run(net.project(x), np.where(ids >= 0, inv, -1), keep=True)
        dl = ((sigmoid(logit) - y[at]) * weight[at] / len(at)).astype(np.float32)
        grad, dg = net.back(ids, tape, dl)
        flat = sums_by_slot(inv.ravel(), dg.reshape(-1, 6 * HIDDEN), len(uniq)).reshape(len(uniq), 2, 3 * HIDDEN)
        if uniq[0] < 0:
            flat[0] = 0
        dx = np.zeros_like(x)
        for k, d in enumerate("fb"):
            grad[f"W{d}"] = x.T @ flat[:, k]
            grad[f"b{d}"] = flat[:, k].sum(0)
            dx += flat[:, k] @ net.p[f"W{d}"].T
        grad["word"] = sums_by_slot(slots[uniq[real]], dx[real, :WIDTH], WORD_SLOTS)
        grad["gram"] = sums_by_slot(here, np.repeat(dx[real, WIDTH:] / count[:, None], count, 0), GRAM_SLOTS)
        rate = 0.003 if late else 0.01
        for k, v in grad.items():
            m, s = moment[k]
            m *= 0.9
            m += 0.1 * v
            s *= 0.999
            s += 0.001 * v * v
            own = rate * (TABLE_RATE if k in first else 1)
            net.p[k] -= own * (m / (1 - 0.9**tick)) / (np.sqrt(s / (1 - 0.999**tick)) + 1e-8)
            if k in first:
                net.p[k] -= own * PULL * (net.p[k] - first[k])
    return net


def two_numbers(top: np.ndarray, ones: np.ndarray, all_: np.ndarray) -> tuple[float, float]:
    """Slope and offset for logits, which ``all_`` texts have each and ``ones`` toxic ones of them."""
    a, b = 1.0, 0.0
    for _ in range(80):  # Newton steps with a pull toward the unchanged logit
        p = sigmoid(np.clip(a * top + b, -30, 30))
        r, k = p * all_ - ones, np.maximum(p * (1 - p), 1e-6) * all_
        h = np.array([[(k * top * top).sum() + 5, (k * top).sum()], [(k * top).sum(), k.sum() + 1e-2]])
        step = np.linalg.solve(h, [(r * top).sum() + 5 * (a - 1), r.sum()])
        a, b = max(0.05, a - np.clip(step[0], -0.5, 0.5)), b - np.clip(step[1], -0.5, 0.5)
    return float(a), float(b)


def train_net(texts: list[bytes], y: np.ndarray, seed: int = 11) -> Net:
    """As ``train`` does, from texts in memory that are one block."""
    if not len(y) or y.min() == y.max():
        net = Net.new(seed)
        net.constant = float(y.mean()) if len(y) else 0.0
        return net
    held = np.arange(len(y)) % HELD == 0
    if len(set(y[~held])) < 2:
        held[:] = False
    tally = Tally()
    for i in np.flatnonzero(~held):
        tally.add(texts[i], int(y[i]))
    net = begin(tally.vector(), seed)
    first = {k: net.p[k].copy() for k in ("word", "gram")}
    for turn in range(ROUNDS):
        rows = [ws for ws, _ in Scorer(net).worst([texts[i] for i in np.flatnonzero(~held)])]
        net = learn(net, first, rows, y[~held], y[~held].mean(), [seed, turn, 0], turn >= ROUNDS // 2)
    if held.any():
        top = np.array([t for _, t in Scorer(net).worst([texts[i] for i in np.flatnonzero(held)])], np.float64)
        net.slope, net.offset = two_numbers(top, y[held], np.ones(len(top)))
    return net


class Places(dict):
    """Run of bytes without a blank -> the place of its word; of a run that is cut, -2 - the place of its pieces in ``cut``."""

    def __init__(self):
        self.at, self.words, self.cut = {}, [], []

    def place(self, word: bytes) -> int:
        at = self.at.setdefault(word, len(self.words))
        if at == len(self.words):
            self.words.append(word)
        return at

    def __missing__(self, run: bytes) -> int:
        own = pieces(run)
        if len(own) == 1:
            at = self.place(own[0])
        else:
            self.cut.append([self.place(w) for w in own])
            at = -1 - len(self.cut)
        self[run] = at
        return at

    def of(self, text: bytes) -> np.ndarray:
        """The places of a text's words."""
        runs = text.lower().split()
        out = np.fromiter(map(self.__getitem__, runs), np.int32, len(runs))
        if len(out) and out.min() < 0:
            out = np.concatenate([self.cut[-2 - i] if i < 0 else [i] for i in out.tolist()]).astype(np.int32)
        return out


class Scorer:
    """Scores texts; keeps the projected inputs of the words seen lately."""

    def __init__(self, net: Net):
        self.net, self.places = net, Places()
        self.g = np.zeros((2, 1, 3 * HIDDEN), np.float32)  # the first ``ready`` words, then 'no word'
        self.ready = 0

    def prepare(self) -> None:
        """Project the words that are new."""
        words = self.places.words
        if len(words) >= self.g.shape[1]:
            g = np.empty((2, max(len(words) + 1, min(2 * self.g.shape[1], CACHE)), 3 * HIDDEN), np.float32)
            g[:, : self.ready] = self.g[:, : self.ready]
            self.g = g
        for i in range(self.ready, len(words), 4096):
            some = words[i : i + 4096]
            self.g[:, i : i + len(some)] = self.net.project(self.net.inputs(some, word_slot(some))).swapaxes(0, 1)
        self.ready = len(words)
        self.g[:, self.ready] = 0

    def windows(self, texts: list[bytes]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """(all windows, their logits) of each text."""
        if len(self.places) > CACHE:
            self.places, self.ready = Places(), 0
        each = [windows(self.places.of(t)) for t in texts]
        self.prepare()
        every = np.concatenate(each)
        g = self.g[:, : self.ready + 1]
        out = np.concatenate([self.net.read(g, every[i : i + CHUNK]) for i in range(0, len(every), CHUNK)])
        return each, np.split(out, np.cumsum([len(w) for w in each])[:-1])

    def logits(self, texts: list[bytes]) -> list[np.ndarray]:
        """The logits of all windows of each text."""
        return self.windows(texts)[1]

    def worst(self, texts: list[bytes]) -> list[tuple[list[bytes], float]]:
        """Of each text, the words of its worst window (the first of equal ones) and that window's logit."""
        out = []
        for own, x in zip(*self.windows(texts), strict=True):
            i = int(x.argmax())
            out.append(([self.places.words[k] for k in own[i].tolist() if k >= 0], float(x[i])))
        return out

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        if self.net.constant is not None:
            return np.full(len(texts), self.net.constant)
        top = np.array([x.max() for x in self.logits([t or b"" for t in texts])], np.float64)
        return sigmoid(np.clip(self.net.slope * top + self.net.offset, -30, 30))


def dump(net: Net) -> bytes:
    out = io.BytesIO()
    scale = [net.slope, net.offset, np.nan if net.constant is None else net.constant]
    np.savez(out, _scale=np.array(scale, np.float64), **net.p)
    return out.getvalue()


def load(data: bytes) -> Net:
    with np.load(io.BytesIO(data)) as f:
        p = {k: f[k] for k in f.files}
    slope, offset, constant = map(float, p.pop("_scale"))
    return Net(p, slope, offset, None if np.isnan(constant) else constant)


def block_of(net: Net, first: dict[str, np.ndarray], share: float, seed: list[int], late: bool):
    """A function on a block of windows: the net after learning from them, times their number, behind that number."""

    def block(t: pa.Table) -> pa.Table:
        t = t.sort_by([("_id", "ascending"), ("h", "ascending")])
        k = t["k"][0].as_py()
        own = learn(net, first, t["words"].to_pylist(), t["y"].to_numpy().astype(np.float64), share, [*seed, k], late)
        return vector(k, len(t) * np.concatenate([[1.0], *(own.p[x].ravel().astype(np.float64) for x in sorted(own.p))]))

    return block


def train(docs: DataFrame, labels: DataFrame, keep: Column, label: str = "toxic", seed: int = 11) -> Net:
    """``keep``: a condition on doc_id for the rows that may be learnt from; all of them that have a label are.
    Counts and nets (two to four megabytes each) are added up by tasks; only their sums come to the driver."""
    small_batches(docs.sparkSession)
    found = labelled(docs, labels, label, keep)
    parts = found.withColumn("held", F.pmod(F.xxhash64("_id", F.lit(5)), F.lit(HELD)) == 0)
    have = {(r["held"], r["y"]): r["count"] for r in parts.groupBy("held", "y").count().collect()}
    toxic, n = sum(c for (_, v), c in have.items() if v), sum(have.values())
    if not toxic or toxic == n:
        return train_net([], np.empty(0)) if not n else train_net([b""], np.array([toxic / n]))
    n1, n0 = have.get((False, 1), 0), have.get((False, 0), 0)
    if not n1 or not n0:
        parts, n1, n0 = parts.withColumn("held", F.lit(False)), toxic, n - toxic
    rows, held = parts.where("not held").select("_id", "y", "text"), parts.where("held").select("y", "text")

    @lean
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally, k = Tally(), TaskContext.get().partitionId()
        for b in slices(batches, 256):
            for text, y in zip(b["text"], b["y"].to_pylist(), strict=True):
                tally.add(text.as_py(), y)
        yield from vector(k, tally.vector()).to_batches()

    net = begin(total(rows.mapInArrow(count, "k long, data binary")), seed)
    first = {k: net.p[k].copy() for k in ("word", "gram")}
    names, blocks, share = sorted(net.p), max(1, round((n1 + n0) / BLOCK)), n1 / (n1 + n0)
    for turn in range(ROUNDS):
        now, late = net, turn >= ROUNDS // 2

        @lean
        def look_up(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            own = Scorer(now)
            for b in slices(batches, 256):
                words = [ws for ws, _ in own.worst(b["text"].to_pylist())]
                yield pa.RecordBatch.from_arrays([b["_id"], b["h"], b["y"], pa.array(words, pa.list_(pa.binary()))], ["_id", "h", "y", "words"])

        worst = materialize(rows.select("_id", F.xxhash64("text").alias("h"), "y", "text").mapInArrow(look_up, "_id long, h long, y int, words array<binary>"), "windows")
        got = total(worst.withColumn("k", F.pmod(F.xxhash64("_id"), F.lit(blocks))).groupBy("k").applyInArrow(block_of(now, first, share, [seed, turn], late), "k long, data binary"))
        release(worst, worst)
        parts_of = np.split(got[1:] / got[0], np.cumsum([net.p[x].size for x in names])[:-1])
        net = Net({x: v.reshape(net.p[x].shape).astype(np.float32) for x, v in zip(names, parts_of, strict=True)})

    @lean
    def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Scorer(net)
        for b in slices(batches, 256):
            top = [t for _, t in own.worst(b["text"].to_pylist())]
            yield pa.RecordBatch.from_arrays([b["y"], pa.array(top, pa.float64())], ["y", "top"])

    bins = held.select("y", "text").mapInArrow(tops, "y int, top double").groupBy(F.round(F.col("top") * FINE).cast("long").alias("b")).agg(F.sum("y"), F.count("*"))
    if bins := sorted(bins.collect()):
        at, ones, all_ = (np.array(c, np.float64) for c in zip(*bins, strict=True))
        net.slope, net.offset = two_numbers(at / FINE, ones, all_)
    release(found, found)
    return net


def scorer(net: Net):
    """A column function: text (binary) -> score."""

    @F.arrow_udf("double")
    @lean
    def score_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = Scorer(net)
        for texts in batches:
            parts = [own.scores(texts.slice(i, 256).to_pylist()) for i in range(0, len(texts), 256)]
            yield pa.array(np.concatenate(parts) if parts else [], pa.float64())

    return score_of


def score(docs: DataFrame, net: Net, text_col: str = "text") -> DataFrame:
    """docs with a column ``score``, which replaces any of that name."""
    small_batches(docs.sparkSession)
    return docs.withColumn("score", scorer(net)(F.col(text_col).cast("binary")))
