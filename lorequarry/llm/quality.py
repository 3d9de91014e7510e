"""Quality scores by Bradley-Terry pairwise ranking.

Every text is reduced to a few dozen numbers (shares and counts of character classes, word
lengths, repetition). From labelled rows preference pairs (a good and a bad text) are drawn
and weights learnt by logistic loss on the feature differences; a text's strength is the
weighted sum of its features. Two more numbers, fitted on the labelled rows, turn strengths
to scores between 0 and 1. Filters cut at a quantile of scores: ``cut`` is the quantile of the
training scores at the share of bad labels, ``threshold_at`` the score below which a given
share of the good training texts lies.

Fitting reads all labelled rows. Their numbers are dealt by a hash of the id to blocks of about
``BLOCK`` rows; every row is in a pair of its block, and the weights are the mean of the blocks'
(by their numbers of the rarer label). Mean and spread of the numbers and the cut are those of
all rows, exactly; the two numbers of the scale are fitted on strengths in ``STEPS`` steps to a
standard deviation, so that counts come to the driver and not rows. Scoring covers all rows, one
text at a time, whole.

Defined results: null text counts as empty, and empty texts are scored like any; labels that
are null or lack a document are ignored; with labels of one kind only (or none) every score
is the share of label 1 (0.5 without labels); repeated rows are scored alike; extra columns
are ignored, so their names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import SENT_ROWS
from .common import lean, materialize, release, small_batches, total
from .words import ROWS, slices

BLOCK = 10_000  # rows that are fitted together
PAIRS = 20_000
STEPS = 1024
SIGNS = b"!#$%&*|.,;:?-_/\\<>()[]{}=+~^@'\"`"


def _classes() -> np.ndarray:
    """Byte -> rows of counts: upper, lower, digit, space, newline, other ASCII, beyond ASCII, and each sign."""
    out = np.zeros((7 + len(SIGNS), 256), np.float64)
    for b in range(256):
        c = chr(b)
        kind = 6 if b >= 128 else 0 if c.isupper() else 1 if c.islower() else 2 if c.isdigit() else 4 if c == "\n" else 3 if c.isspace() else 5
        out[kind, b] = 1
    for i, b in enumerate(SIGNS):
        out[7 + i, b] = 1
    return out


CLASSES = _classes()


def features(text: bytes) -> np.ndarray:
    hist = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    counts = CLASSES @ hist
    n = max(1, len(text))
    words = text.split()
    m = max(1, len(words))
    kinds = len(set(words))
    again = sum(map(eq, words, words[1:]))
    second = sum(map(eq, words, words[2:]))
    p = hist[hist > 0] / n
    lines = text.split(b"\n")
    letters = max(1.0, counts[0] + counts[1] + counts[6])
    own = [
        np.log1p(len(text)), np.log1p(len(words)), len(text) / m / 20, kinds / m, again / m, np.log1p(again), second / m, np.log1p(second),
        counts[0] / letters, float(-(p * np.log(p)).sum()) if len(p) else 0.0, np.log1p(len(lines)), 1 - len(set(lines)) / len(lines),
        (text.count(b"!!") + text.count(b"***") + text.count(b"$$$") + text.count(b"###") + text.count(b"%%%") + text.count(b"&&&")) / m,
        text.count(b" | ") / m, np.log1p(text.count(b" | ")), np.log1p(text.count(b"!!")),
    ]
    return np.concatenate([own, np.sqrt(counts / n), np.log1p(counts[7:])])


def matrix(texts: list[bytes | None]) -> np.ndarray:
    return np.array([features(t or b"") for t in texts])


@dataclass(frozen=True)
class Ranker:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    slope: float
    offset: float
    good: np.ndarray  # ascending scores of good training texts, equal steps of strength as one
    times: np.ndarray  # how many texts have each
    cut: float = 0.0  # the quantile of training scores at the share of bad labels

    def strength(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.of_strength(self.strength(x))

    def of_strength(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * z + self.offset, -30, 30)))

    def threshold_at(self, share: float) -> float:
        """The score below which this share of the good training texts lies."""
        return float(self.good[min(np.searchsorted(np.cumsum(self.times), share * self.times.sum()), len(self.good) - 1)]) if len(self.good) else 0.0


def even(base: float, good: int, d: int) -> Ranker:
    """For labels of one kind: every score is ``base``."""
    p = float(np.clip(base, 1e-6, 1 - 1e-6))
    return Ranker(np.zeros(d), np.ones(d), np.zeros(d), 0.0, float(np.log(p / (1 - p))), np.full(min(good, 1), p), np.full(min(good, 1), good))


def fit(x: np.ndarray, y: np.ndarray, mean: np.ndarray, scale: np.ndarray, pairs: int = PAIRS, penalty: float = 1e-4, steps: int = 300, seed: int = 7) -> np.ndarray:
    """Weights from ``pairs`` pairs of a good and a bad text, or as many more as bring in every text."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    z = np.clip((x - mean) / scale, -8, 8)
    draw = np.random.default_rng(seed)
    n = max(pairs, len(good), len(bad))
    turns = lambda rows: np.concatenate([draw.permutation(rows) for _ in range(-(-n // len(rows)))])[:n]
    diff = z[turns(good)] - z[turns(bad)]
    d = x.shape[1]
    w, m, v = np.zeros(d), np.zeros(d), np.zeros(d)
    for t in range(1, steps + 1):  # Adam on the whole set of pairs
        lost = 1 / (1 + np.exp(np.clip(diff @ w, -30, 30)))
        g = -(lost @ diff) / n + penalty * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return w


def two_numbers(u: np.ndarray, ones: np.ndarray, all_: np.ndarray) -> tuple[float, float]:
    """Slope and offset for strengths u, of which ``all_`` texts have each and ``ones`` of them label 1."""
    a, b = 1.0, 0.0
    for _ in range(60):  # Newton steps
        p = 1 / (1 + np.exp(-np.clip(a * u + b, -30, 30)))
        r, k = p * all_ - ones, np.maximum(p * (1 - p), 1e-9) * all_
        h = np.array([[(k * u * u).sum() + 1, (k * u).sum()], [(k * u).sum(), k.sum() + 1e-3]])
        step = np.linalg.solve(h, [(r * u).sum() + (a - 1), r.sum()])
        a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -1, 1)
    return a, b


def remainder(id_col: str, n: int) -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(n))


def labelled(docs: DataFrame, labels: DataFrame, label: str, keep: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All labelled rows with their texts: _id, y, text. Beyond the labels that may be sent to tasks, documents are
    exchanged once and the labelled ones written."""
    chosen = labels.select(F.col(id_col).alias("_id"), F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1))
    chosen = chosen.withColumn("doc_id", F.col("_id")).where(keep).groupBy("_id").agg(F.max("y").alias("y"))
    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    if chosen.count() <= SENT_ROWS:
        return texts.join(F.broadcast(chosen), "_id").select("_id", "y", "text")
    return materialize(texts.join(chosen, "_id").select("_id", "y", "text"), "labelled")


def train(docs: DataFrame, labels: DataFrame, keep: Column, label: str = "quality") -> Ranker:
    """``keep``: a condition on doc_id for the rows that may be learnt from; all of them that have a label are."""
    spark = docs.sparkSession
    small_batches(spark)

    @lean
    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            x = matrix(b["text"].to_pylist())
            yield pa.RecordBatch.from_arrays([b["_id"], b["y"], b["h"], pa.array(list(x), pa.list_(pa.float64()))], ["_id", "y", "h", "x"])

    found = labelled(docs, labels, label, keep)
    rows = materialize(found.select("_id", "y", F.xxhash64("text").alias("h"), "text").mapInArrow(reduce, "_id long, y int, h long, x array<double>"), "features")
    release(rows, found)
    d = len(features(b""))
    have = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    n = sum(have.values())
    if len(have) < 2:
        release(rows, rows)
        return even(have.get(1, 0) / n if n else 0.5, have.get(1, 0), d)
    blocks = max(1, round(n / BLOCK))
    take = lambda t: (np.asarray(t["x"].combine_chunks().flatten(), np.float64).reshape(-1, d), t["y"].to_numpy().astype(np.float64))
    sorted_ = lambda t: t.sort_by([("_id", "ascending"), ("h", "ascending")])

    def moments(t: pa.Table) -> pa.Table:
        x, _ = take(sorted_(t))
        mean = x.mean(0)
        return vector(t["k"][0].as_py(), np.concatenate([[len(x)], len(x) * mean, ((x - mean) ** 2).sum(0), len(x) * mean**2]))

    by_block = rows.withColumn("k", F.pmod(F.xxhash64("_id"), F.lit(blocks)))
    got = total(by_block.groupBy("k").applyInArrow(moments, "k long, data binary"))
    mean = got[1 : d + 1] / n
    var = (got[d + 1 : 2 * d + 1] + got[2 * d + 1 :]) / n - mean**2
    scale = np.where(var > 1e-18, np.sqrt(np.maximum(var, 0)), 1.0)
    scale = np.where(scale > 1e-9, scale, 1.0)

    def weights(t: pa.Table) -> pa.Table:
        x, y = take(sorted_(t))
        least = min((y == 1).sum(), (y == 0).sum())  # a block without pairs has no say
        return vector(t["k"][0].as_py(), np.concatenate([[least], least * fit(x, y, mean, scale) if least else np.zeros(d)]))

    got = total(by_block.groupBy("k").applyInArrow(weights, "k long, data binary"))
    model = Ranker(mean, scale, got[1:] / max(got[0], 1), 1.0, 0.0, np.empty(0), np.empty(0))

    def strengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            x, y = take(pa.Table.from_batches([t]))
            yield pa.RecordBatch.from_arrays([t["y"], pa.array(model.strength(x), pa.float64())], ["y", "s"])

    of = rows.select("x", "y").mapInArrow(lean(strengths), "y int, s double")
    s0 = max(float(f"{of.agg(F.stddev_pop('s')).first()[0]:.6g}"), 1e-9)  # the same in whatever order it is added up
    step = s0 / STEPS
    bins = sorted(of.groupBy(F.round(F.col("s") / step).cast("long").alias("b")).agg(F.sum("y"), F.count("*"), F.min("s"), F.max("s")).collect())
    at, ones, all_, low, high = (np.array(c, np.float64) for c in zip(*bins, strict=True))
    a, b = two_numbers(at / STEPS, ones, all_)
    # the exact strengths of the two ranks that the quantile lies between (its method: midpoint)
    rank = have[0] / n * (n - 1)
    ends = np.cumsum(all_)
    exact = []
    for r in (int(np.floor(rank)), int(np.ceil(rank))):
        i = int(np.searchsorted(ends, r, "right"))
        if low[i] == high[i]:
            exact.append(low[i])
            continue
        within = sorted(of.where(F.round(F.col("s") / step).cast("long") == int(at[i])).groupBy("s").count().collect())
        upto = np.cumsum([c for _, c in within]) + ends[i] - all_[i]
        exact.append(within[int(np.searchsorted(upto, r, "right"))][0])
    release(rows, rows)
    model = Ranker(mean, scale, model.weights, a / s0, b, np.empty(0), np.empty(0))
    good = ones > 0
    return Ranker(mean, scale, model.weights, a / s0, b, model.of_strength(at[good] * step), ones[good], float(model.of_strength(np.array(exact)).mean()))


def vector(k: int, data: np.ndarray) -> pa.Table:
    return pa.table({"k": pa.array([k], pa.int64()), "data": pa.array([np.asarray(data, np.float64).tobytes()], pa.binary())})


def scorer(model: Ranker):
    """A column function: text (binary) -> score."""

    @F.arrow_udf("double")
    @lean
    def score_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            parts = [model.score(matrix(texts.slice(i, ROWS).to_pylist())) for i in range(0, len(texts), ROWS)]
            yield pa.array(np.concatenate(parts) if parts else [], pa.float64())

    return score_of


def score(docs: DataFrame, model: Ranker, text_col: str = "text") -> DataFrame:
    """docs with a column ``score``, which replaces any of that name."""
    small_batches(docs.sparkSession)
    return docs.withColumn("score", scorer(model)(F.col(text_col).cast("binary")))
