"""Benchmark decontamination by winnowing.

Of the hashes of ``GRAM`` consecutive words, the least in each run of ``WINDOW - GRAM + 1``
is a fingerprint, so any shared span of ``WINDOW`` words shares one. The fingerprints of the
benchmark are looked up for every window of every document; where one meets, the hit is
extended: the window's two 64-bit hashes are compared with those of the benchmark's windows.
Benchmark items of fewer words than ``WINDOW`` are one window each (fingerprint and window
are then the same hash).

Up to ``block_windows`` windows (about 40 bytes each) the benchmark is sent whole and looked up
where the documents lie. A larger one is cut into blocks of about that many windows, by item
and window: each block is joined with the documents in a pass of its own, which writes the hits
of each text under the text's SHA-256; a worker never holds more than one block. The hits of all
blocks are then united by text. Either way gives the same result, and in the first documents are
never shuffled, whatever passage they share.

Defined results: null or empty texts have no words and no hits, and an empty item fits
nowhere; item ids are cast to long, items with a null id are ignored; repeated items count once;
an empty benchmark leaves all documents clean; other input columns are kept by ``mark`` unless
they bear the name of one that it adds (n_words, hit_spans, items), and all are by ``clean``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, materialize, release, small_batches
from .words import ROWS, WordHashes, ascii_word_table, grams, mix, slices

WINDOW, GRAM = 10, 5
BLOCK = 1_000_000
SECOND = 0xC2B2AE3D27D4EB4F
TABLE = ascii_word_table()
BITS = 22


def word_hashes(text: bytes | None, cache: WordHashes) -> np.ndarray:
    return cache.of((text or b"").translate(TABLE).split())


def winnow(h: np.ndarray) -> np.ndarray:
    """For each window of WINDOW words the fingerprint that stands for it."""
    g = grams(h, GRAM)
    n = len(g) - (WINDOW - GRAM)
    if n <= 0:
        return np.empty(0, np.uint64)
    out = g[:n]
    for i in range(1, WINDOW - GRAM + 1):
        out = np.minimum(out, g[i : n + i])
    return out


def item_windows(text: bytes | None, cache: WordHashes) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """(length, fingerprints, first and second hashes) of an item's windows."""
    h = word_hashes(text, cache)
    n = min(len(h), WINDOW)
    if not n:
        return 0, *[np.empty(0, np.uint64)] * 3
    a = grams(h, n)
    return n, winnow(h) if n == WINDOW else a, a, grams(h, n, SECOND)


def benchmark_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, length, f (fingerprint), a, b (hashes): the distinct windows of each item."""

    @lean
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in slices(batches):
            out = [[], [], [], [], []]
            for item, text in zip(batch["item_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                n, f, a, b = item_windows(text, cache)
                for col, x in zip(out, (np.full(len(a), item), np.full(len(a), n), f.view(np.int64), a.view(np.int64), b.view(np.int64)), strict=True):
                    col.append(x)
            cols = [np.concatenate(x) if x else np.empty(0) for x in out]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64 if i != 1 else np.int32)) for i, c in enumerate(cols)], ["item_id", "length", "f", "a", "b"])

    source = items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("binary").alias("text")).where("item_id is not null")
    return source.mapInArrow(cut, "item_id long, length int, f long, a long, b long").distinct()


class Index:
    """Windows of a block of the benchmark, ready for lookups; at most 40 MB beside the block's own."""

    def __init__(self, item: np.ndarray, length: np.ndarray, f: np.ndarray, a: np.ndarray, b: np.ndarray):
        self.by_length = {}
        for n in np.unique(length):
            own = length == n
            order = np.lexsort((b[own], a[own]))
            prints = np.unique(f[own])
            bits = np.zeros(1 << BITS, bool)
            bits[(prints & np.uint64((1 << BITS) - 1)).astype(np.int64)] = True
            self.by_length[int(n)] = (prints, bits, a[own][order], b[own][order], item[own][order])

    def hits(self, h: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(length, start, item) arrays of the windows that occur."""
        for n, (prints, bits, a, b, item) in self.by_length.items():
            if len(h) < n:
                continue
            f = winnow(h) if n == WINDOW else grams(h, n)
            at = np.flatnonzero(bits[(f & np.uint64((1 << BITS) - 1)).astype(np.int64)])
            at = at[np.isin(f[at], prints)]
            if not len(at):
                continue
            span = h[at[:, None] + np.arange(n)[None, :]]
            x, y = (_rows(span, base) for base in (None, SECOND))
            low, high = np.searchsorted(a, x, "left"), np.searchsorted(a, x, "right")
            count = high - low
            start = np.repeat(np.arange(len(at)), count)
            row = np.repeat(low - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
            same = b[row] == y[start]
            yield n, at[start[same]], item[row[same]]


def _rows(span: np.ndarray, base: int | None) -> np.ndarray:
    """grams() of each row as a whole."""
    m = np.uint64(base or 0x9E3779B97F4A7C15)
    out = span[:, 0].copy()
    for i in range(1, span.shape[1]):
        out = out * m + span[:, i]
    return mix(out)


RESULT = T.StructType().add("n_words", "long").add("hit_spans", T.ArrayType(T.StructType().add("start", "long").add("end", "long"))).add("items", T.ArrayType(T.LongType()))
ARROW = pa.struct([("n_words", pa.int64()), ("hit_spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("items", pa.list_(pa.int64()))])


def look_up(text: bytes | None, indexes: list[Index], cache: WordHashes) -> dict:
    h = word_hashes(text, cache)
    change, own = np.zeros(len(h) + 1, np.int64), []
    for index in indexes:
        for n, start, item in index.hits(h):
            start = np.unique(start)
            np.add.at(change, start, 1)
            np.add.at(change, start + n, -1)
            own.append(np.unique(item))
    if not own:
        return {"n_words": len(h), "hit_spans": [], "items": []}
    on = np.diff(np.concatenate([[0], (np.cumsum(change) > 0).astype(np.int8)]))
    spans = [{"start": int(s), "end": int(e)} for s, e in zip(np.flatnonzero(on == 1), np.flatnonzero(on == -1), strict=True)]
    return {"n_words": len(h), "hit_spans": spans, "items": np.unique(np.concatenate(own)).tolist()}


def _blocks(items: DataFrame, block_windows: int, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    small_batches(items.sparkSession)
    found = materialize(benchmark_windows(items, id_col, text_col), "benchmark-windows")
    return found, max(1, -(-found.count() // block_windows))


def _send(found: DataFrame, blocks: int, i: int) -> Broadcast:
    """The windows of block i, which number about ``block_windows``."""
    t = (found if blocks == 1 else found.where(F.pmod(F.xxhash64("item_id", "a"), F.lit(blocks)) == i)).toArrow()
    cols = [t[c].to_numpy() for c in ("item_id", "length", "f", "a", "b")]
    return found.sparkSession.sparkContext.broadcast([*cols[:2], *[c.astype(np.int64).view(np.uint64) for c in cols[2:]]])


def _marker(block: Broadcast):
    """A column function: text (binary) -> struct of n_words, hit_spans (array of [start, end)
    in words, disjoint, in order) and items (ids, sorted)."""

    @F.arrow_udf(RESULT)
    @lean
    def hits_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        cache, indexes = WordHashes(), [Index(*block.value)]
        for texts in batches:
            rows = [look_up(t, indexes, cache) for i in range(0, len(texts), ROWS) for t in texts.slice(i, ROWS).to_pylist()]
            yield pa.array(rows, ARROW)

    return hits_of


@F.arrow_udf(T.LongType())
@lean
def _count_words(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        yield pa.array([len((t or b"").translate(TABLE).split()) for i in range(0, len(texts), ROWS) for t in texts.slice(i, ROWS).to_pylist()], pa.int64())


@F.arrow_udf(RESULT["hit_spans"].dataType)
def _united(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Sorted spans to disjoint ones that don't touch."""
    for rows in batches:
        out = []
        for spans in rows.to_pylist():
            own = []
            for s in spans:
                if own and s["start"] <= own[-1]["end"]:
                    own[-1]["end"] = max(own[-1]["end"], s["end"])
                else:
                    own.append(s)
            out.append(own)
        yield pa.array(out, ARROW.field("hit_spans").type)


def _hits_in(texts: DataFrame, block: Broadcast) -> DataFrame:
    """key, hit_spans, items of the texts that a block hits, equal texts once."""

    @lean
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, indexes = WordHashes(), [Index(*block.value)]
        schema = pa.schema([("key", pa.string()), *[(f.name, f.type) for f in ARROW][1:]])
        for batch in slices(batches):
            got = [look_up(t.as_py(), indexes, cache) | {"key": k.as_py()} for k, t in zip(batch["key"], batch["text"], strict=True)]
            yield pa.RecordBatch.from_pylist([g for g in got if g["items"]], schema)

    kind = T.StructType([T.StructField("key", T.StringType()), *RESULT.fields[1:]])
    return texts.mapInArrow(find, kind).dropDuplicates(["key"])


def _hits_by_text(docs: DataFrame, text: Column, found: DataFrame, blocks: int) -> DataFrame:
    """key (SHA-256 of the text), hit_spans, items: a row for each text with a hit. A pass over the
    texts for each block, which writes its hits before the next block is sent."""
    texts = docs.select(F.sha2(text, 256).alias("key"), text.alias("text")).where("text is not null")
    passes = []
    for i in range(blocks):
        block = _send(found, blocks, i)
        passes.append(materialize(_hits_in(texts, block), "block-hits"))
        block.unpersist()
    every = reduce(DataFrame.unionByName, passes)  # a key has at most one row of each block
    every = every.groupBy("key").agg(F.flatten(F.collect_list("hit_spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))
    out = every.select("key", _united(F.array_sort("spans")).alias("hit_spans"), F.array_sort(F.array_distinct("items")).alias("items"))
    return release(materialize(out, "hits"), *passes, found)


def mark(docs: DataFrame, items: DataFrame, block_windows: int = BLOCK, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs with n_words, hit_spans and items, which replace any columns of these names."""
    found, blocks = _blocks(items, block_windows, item_id, item_text)
    text = F.col(text_col).cast("binary")
    hits = "_hits"
    while hits in {c.lower() for c in docs.columns}:
        hits += "_"
    if blocks == 1:
        marked = release(docs.withColumn(hits, _marker(_send(found, 1, 0))(text)), found)
    else:
        by_text = _hits_by_text(docs, text, found, blocks)
        by_text = by_text.select(F.col("key").alias(f"{hits}key"), F.struct("hit_spans", "items").alias(f"{hits}found"))
        joined = docs.withColumn(f"{hits}n", _count_words(text)).join(by_text, F.sha2(text, 256) == F.col(f"{hits}key"), "left")
        of = lambda c: F.coalesce(F.col(f"{hits}found.{c}"), F.array().cast(RESULT[c].dataType)).alias(c)
        marked = joined.withColumn(hits, F.struct(F.col(f"{hits}n").alias("n_words"), of("hit_spans"), of("items"))).drop(f"{hits}n", f"{hits}key", f"{hits}found")
    return marked.withColumns({c: F.col(f"{hits}.{c}") for c in ("n_words", "hit_spans", "items")}).drop(hits)


def clean(docs: DataFrame, items: DataFrame, block_windows: int = BLOCK, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs that nothing of the benchmark hits, with all their columns."""
    found, blocks = _blocks(items, block_windows, item_id, item_text)
    text = F.col(text_col).cast("binary")
    if blocks == 1:
        return release(docs.where(F.size(_marker(_send(found, 1, 0))(text)["items"]) == 0), found)
    keys = _hits_by_text(docs, text, found, blocks).select("key")
    return docs.join(keys, F.sha2(text, 256) == keys["key"], "left_anti")


def n_hit(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
