"""Packing of documents into fixed windows by non-negative least squares.

A document's tokens are cut at multiples of the window: full pieces fill a sequence each, the
rest is packed. Only the histogram of the rests' lengths (at most ``window`` counts) goes to
the driver. Shallow combinations of two or three lengths that fill a window exactly are
enumerated, their repeat counts solved by non-negative least squares against the histogram,
rounded down to what the histogram holds, and what remains is packed greedily (longest
first, best fit), also on counts. The plan is a table of (length, ranks) -> (sequence,
offset); pieces find their place by their rank among pieces of their length, which is
counted in runs, so a length that a third of the pieces share is spread over tasks.

Defined results: null and empty texts are one token, the end mark; the string of an added token
in a text is that token, as the tokenizer has it (with ``added_as_text``, ordinary text); repeated
rows are packed each; an empty table gives no pieces; other input columns are ignored.
"""

from __future__ import annotations

import json
import re
import sys
import types
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import KEPT, give_back, lean, materialize, small_batches
from .words import slices

WINDOW, END = 2048, 1
#: Fixed value: the pattern by which the byte-level vocabularies split texts.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LONG_BLANKS = 5_000
RUN = re.compile(r"\s{%d}" % LONG_BLANKS)
BLOCK = 1 << 20  # pairs of lengths that are tried at once


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for bytes: printable ones for themselves, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Token ids of texts, as the tokenizer file's own library gives them.

    A plain byte-level BPE vocabulary whose ids follow its merges is run by a faster library with
    the same ranks. Any other file, texts that hold an added token, and texts with a run of blanks
    too long for that library's pattern go to the file's own. With ``added_as_text`` the
    strings of added tokens are ordinary text."""

    def __init__(self, path: str, added_as_text: bool = False):
        self.path, self.as_text, self.own = path, added_as_text, None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.added = [] if added_as_text else [t["content"] for t in spec.get("added_tokens") or []]
        ranks = self.ranks(spec)
        self.fast = None
        if ranks:
            import tiktoken

            self.fast = tiktoken.Encoding("packing", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    @staticmethod
    def ranks(spec: dict) -> dict[bytes, int] | None:
        model, pre, letters = spec["model"], spec.get("pre_tokenizer") or {}, byte_letters()
        plain = model.get("type") == "BPE" and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer")
        if not plain or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
            return None
        vocab = {k: v for k, v in model["vocab"].items() if k not in {t["content"] for t in spec.get("added_tokens") or []}}
        merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
        in_order = all(vocab.get(m) == 256 + i for i, m in enumerate(merged)) and len(vocab) == 256 + len(merged) and all(vocab.get(c, 256) < 256 for c in letters)
        return {bytes(letters[c] for c in k): v for k, v in vocab.items()} if in_order else None

    def slow(self, text: str) -> list[int]:
        if self.own is None:
            from tokenizers import Tokenizer

            self.own = Tokenizer.from_file(self.path)
            self.own.encode_special_tokens = self.as_text
        return self.own.encode(text, add_special_tokens=False).ids

    def ids(self, text: str) -> list[int]:
        odd = any(t in text for t in self.added) or (len(text) >= LONG_BLANKS and RUN.search(text))
        return self.slow(text) if odd or not self.fast else self.fast(text)


def encoder(path: str, added_as_text: bool = False) -> Encoder:
    """The encoder of this worker process, which its tasks share."""
    kept = sys.modules.setdefault(KEPT, types.ModuleType(KEPT)).__dict__.setdefault("encoders", {})
    key = (path, added_as_text)
    if key not in kept:
        kept.clear()
        kept[key] = Encoder(path, added_as_text)
    return kept[key]


def pieces(docs: DataFrame, tokenizer: str, window: int = WINDOW, end: int = END, id_col: str = "doc_id", text_col: str = "text", added_as_text: bool = False) -> DataFrame:
    """doc_id, doc_tokens, start, length, ids_crc32: each document's tokens, cut at multiples of the window."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer, added_as_text)
        for batch in slices(batches, 128):
            out: tuple[list, ...] = ([], [], [], [], [])
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                data = np.array([*own.ids(text.as_py() or ""), end], "<u4").tobytes()
                total = len(data) // 4
                for s in range(0, total, window):
                    part = data[4 * s : 4 * min(total, s + window)]
                    for col, x in zip(out, (doc, total, s, len(part) // 4, zlib.crc32(part)), strict=True):
                        col.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["doc_id", "doc_tokens", "start", "length", "ids_crc32"])
        give_back()

    small_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(cut, "doc_id long, doc_tokens long, start long, length long, ids_crc32 long")


def combinations(lengths: np.ndarray, window: int, block: int = BLOCK) -> np.ndarray:
    """(combinations, 3) indices into ``lengths`` (ascending; len(lengths) for none): all pairs and triples
    of lengths that fill a window exactly."""
    none = len(lengths)
    where = np.full(window + 1, -1)
    where[lengths] = np.arange(none)
    a = np.arange(none)
    rest = window - lengths
    ok = (rest >= lengths) & (where[rest] >= 0)
    out = [np.stack([a[ok], where[rest[ok]], np.full(ok.sum(), none)], 1)]
    rows = max(1, block // max(1, none))
    for at in range(0, none, rows):
        i, j = np.indices((min(rows, none - at), none)).reshape(2, -1)
        i += at
        rest = window - lengths[i] - lengths[j]
        ok = (i <= j) & (rest >= lengths[j])
        ok[ok] = where[rest[ok]] >= 0
        out.append(np.stack([i[ok], j[ok], where[rest[ok]]], 1))
    return np.concatenate(out)


def solve(combos: np.ndarray, counts: np.ndarray, steps: int = 300) -> np.ndarray:
    """Repeat counts x >= 0 that minimise |A x - counts|^2, A's columns being the combinations (accelerated projected gradient)."""
    if not len(combos):
        return np.zeros(0)
    n = len(counts)

    def used(x: np.ndarray) -> np.ndarray:
        return np.bincount(combos.ravel(), np.repeat(x, combos.shape[1]), n + 1)[:n]

    target = counts.astype(float)
    v = np.ones(len(combos))
    for _ in range(20):  # largest eigenvalue of A'A
        v = np.append(used(v), 0)[combos].sum(1)
        v /= np.linalg.norm(v) + 1e-12
    top = np.linalg.norm(np.append(used(v), 0)[combos].sum(1)) * 1.05 + 1e-9
    x = y = np.zeros(len(combos))
    t = 1.0
    for _ in range(steps):
        g = np.append(used(y) - target, 0)[combos].sum(1)
        new = np.maximum(0, y - g / top)
        u = (1 + np.sqrt(1 + 4 * t * t)) / 2
        x, y, t = new, new + (t - 1) / u * (new - x), u
    return x


def plan(histogram: dict[int, int], window: int = WINDOW) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, how many such sequences): every piece of the histogram is in one."""
    left = {n: c for n, c in histogram.items() if c and n < window}
    out = [((window,), histogram[window])] if histogram.get(window) else []
    lengths = np.array(sorted(left), np.int64)
    if len(lengths):
        combos = combinations(lengths, window)
        x = solve(combos, np.array([left[n] for n in lengths]))
        for c in np.argsort(-x, kind="stable"):
            own = [int(lengths[i]) for i in combos[c] if i < len(lengths)]
            need = {n: own.count(n) for n in own}
            times = min(int(x[c] + 1e-6), *[left[n] // k for n, k in need.items()])
            if times > 0:
                out.append((tuple(own), times))
                for n, k in need.items():
                    left[n] -= k * times
    rest = sorted(n for n, c in left.items() if c)
    while rest:
        own, space, free = {}, window, dict(left)
        while True:
            i = bisect_right(rest, space) - 1
            while i >= 0 and not free[rest[i]]:
                i -= 1
            if i < 0:
                break
            k = min(free[rest[i]], space // rest[i])
            own[rest[i]] = own.get(rest[i], 0) + k
            free[rest[i]] -= k
            space -= k * rest[i]
        times = min(left[n] // k for n, k in own.items())
        out.append((tuple(n for n, k in own.items() for _ in range(k)), times))
        for n, k in own.items():
            left[n] -= k * times
        rest = [n for n in rest if left[n]]
    return out


def places(sequences: list[tuple[tuple[int, ...], int]], window: int) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset), sorted: a piece of that length with rank r
    from the first rank up to the next row's is in sequence ``first sequence + r - first rank``."""
    rows, taken, at = [], {}, 0
    for lengths, times in sequences:
        offset = 0
        for n in lengths:
            rows.append((n, taken.get(n, 0), at, offset))
            taken[n] = taken.get(n, 0) + times
            offset += n
        at += times
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, end: int = END, rows_per_run: int = 500_000, id_col: str = "doc_id", text_col: str = "text", added_as_text: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: a row per piece."""
    cut = materialize(pieces(docs, tokenizer, window, end, id_col, text_col, added_as_text), "pieces")
    histogram = {r[0]: r[1] for r in cut.groupBy("length").count().collect()}  # at most ``window`` rows
    table = places(plan(histogram, window), window)
    runs = max(16, -(-max(histogram.values(), default=0) // rows_per_run))
    cut = cut.withColumn("run", F.pmod(F.xxhash64("doc_id", "start"), F.lit(runs)).cast("int"))
    ahead = Window.partitionBy("length").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    base = cut.groupBy("length", "run").count().select("length", "run", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("base"))
    in_run = Window.partitionBy("length", "run").orderBy("doc_id", "start", "ids_crc32")
    ranked = cut.withColumn("rank", F.row_number().over(in_run) - 1).join(base, ["length", "run"]).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("base") + F.col("rank")).cast("long").alias("rank"))
    key = table[:, 0] * (1 << 50) + table[:, 1]

    @lean
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, r = b["length"].to_numpy(), b["rank"].to_numpy()
            row = table[np.searchsorted(key, n * (1 << 50) + r, "right") - 1] if len(n) else table[:0]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(row[:, 2] + r - row[:, 1]), pa.array(row[:, 3])], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
