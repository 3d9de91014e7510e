"""Byte-balanced sharding by histogram sort (DataFrame operations only).

The sort key is ``(xxhash64(text), id)``: copies of a text are neighbours. For each of the
``n_shards - 1`` splitters the exact number of bytes below candidate boundaries is counted
over all partitions; the cell that holds the target is divided again until a boundary meets
the tolerance or a cell is a single key. Each round brings back at most
``n_shards * 1024`` counts, whatever the number of rows. Rows are exchanged once.

A group of equal texts stays whole if its bytes are at most ``group_tolerance`` of a shard;
larger groups (a third of the corpus may be one text) are divided by id.

Defined results: a null text has no bytes (size 1, CRC 0) like an empty one; a null id sorts
first; rows that are equal in text and id share a shard and get slots in any order; an empty
table gives no rows; other input columns are ignored, so their names can't clash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

RADIX = 10  # bits of the hash that a round adds
CELLS = 1 << RADIX
LOWEST = -(1 << 63)


@dataclass(frozen=True)
class Splitter:
    """Rows with a key of at least (hash, id) stand above it."""

    hash: int
    id: int


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("h"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(LOWEST)).alias("k"),
    )


def _nearest(cells: list[tuple[int, int]], below: int, target: float) -> tuple[int, int, int, int]:
    """The cell in which ``target`` falls: (cell, bytes below it, bytes in it, next cell in order)."""
    for i, (cell, size) in enumerate(cells):
        if below + size >= target or i == len(cells) - 1:
            return cell, below, size, cells[i + 1][0] if i + 1 < len(cells) else None
        below += size
    raise ValueError("no cells")


def find_splitters(keys: DataFrame, n_shards: int, tolerance: float, group_tolerance: float) -> tuple[list[Splitter], int]:
    """The splitters and the number of rows. ``keys`` has h, k and size."""
    totals = keys.agg(F.sum("size"), F.count("size")).first()
    total, rows = totals[0] or 0, totals[1]
    if not total or n_shards < 2:
        return [], rows
    share = total / n_shards
    done: dict[int, Splitter] = {}
    # splitter -> (prefix of the hash, bytes below that prefix)
    open_: dict[int, tuple[int | None, int]] = {i: (None, 0) for i in range(1, n_shards)}
    groups: dict[int, tuple[int, int, int]] = {}  # splitter -> (hash, bytes below, bytes)
    bits = 0
    while open_ and bits < 64:
        step = min(RADIX, 64 - bits)
        shift = 64 - bits - step
        prefix = F.shiftright("h", shift) if shift else F.col("h")
        part = keys
        if bits:
            part = keys.where(F.shiftright("h", 64 - bits).isin(sorted({p for p, _ in open_.values()})))
        counts: dict[int | None, list[tuple[int, int]]] = {}
        for cell, size in part.groupBy(prefix.alias("cell")).agg(F.sum("size").alias("size")).collect():
            counts.setdefault(cell >> step if bits else None, []).append((cell, size))
        bits += step
        left = {}
        for i, (p, below) in open_.items():
            cell, at, size, _ = _nearest(sorted(counts[p]), below, i * share)
            low, high = i * share - at, at + size - i * share
            if min(low, high) <= tolerance * share:
                done[i] = Splitter((cell if low <= high else cell + 1) << (64 - bits), LOWEST)
            elif bits < 64:
                left[i] = (cell, at)
            elif size <= group_tolerance * share:
                done[i] = Splitter(cell if low <= high else cell + 1, LOWEST)
            else:
                groups[i] = (cell, at, size)
        open_ = left
    for h in sorted({h for h, _, _ in groups.values()}):
        done |= _inside(keys.where(F.col("h") == h), h, {i: (at, i * share) for i, (g, at, _) in groups.items() if g == h}, tolerance * share)
    found = [done[i] for i in range(1, n_shards)]
    return [s if s.hash < 1 << 63 else Splitter((1 << 63) - 1, (1 << 63) - 1) for s in found], rows


def _inside(group: DataFrame, h: int, wanted: dict[int, tuple[int, float]], tolerance: float) -> dict[int, Splitter]:
    """Splitters inside a large group of equal texts, by id."""
    low, high = group.agg(F.min("k"), F.max("k")).first()
    done: dict[int, Splitter] = {}
    open_ = {i: (low, high, at, target) for i, (at, target) in wanted.items()}
    while open_:
        left = {}
        for lo, hi in sorted({(lo, hi) for lo, hi, _, _ in open_.values()}):
            width = max(1, -(-(hi - lo + 1) // CELLS))
            # floor division in decimals: ids may span more than 63 bits
            cell = F.floor((F.col("k").cast("decimal(20,0)") - F.lit(lo).cast("decimal(20,0)")) / F.lit(width).cast("decimal(20,0)")).cast("long")
            counts = sorted(tuple(r) for r in group.where(F.col("k").between(lo, hi)).groupBy(cell.alias("cell")).agg(F.sum("size")).collect())
            for i, (a, b, at, target) in open_.items():
                if (a, b) != (lo, hi):
                    continue
                c, below, size, _ = _nearest(counts, at, target)
                start, end = lo + c * width, lo + (c + 1) * width
                if width == 1 or min(target - below, below + size - target) <= tolerance:
                    done[i] = Splitter(h, start if target - below <= below + size - target else min(end, (1 << 63) - 1))
                else:
                    left[i] = (start, min(end - 1, hi), below, target)
        open_ = left
    return done


def shard_of(splitters: list[Splitter]) -> Column:
    above = [((F.col("h") > s.hash) | ((F.col("h") == s.hash) & (F.col("k") >= s.id))).cast("int") for s in splitters]
    out = F.lit(0)
    for a in above:
        out = out + a
    return out


def shard(docs: DataFrame, n_shards: int = 16, tolerance: float = 0.005, group_tolerance: float = 0.03, id_col: str = "doc_id", text_col: str = "text", rows_per_run: int = 500_000) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot. A shard's slots are given in runs of about
    ``rows_per_run`` rows (by a hash of the id), so no task numbers a whole shard."""
    keys = materialize(keyed(docs, id_col, text_col), "shard-keys")
    splitters, rows = find_splitters(keys, n_shards, tolerance, group_tolerance)
    runs = max(16, -(-rows // (n_shards * rows_per_run)))
    placed = keys.withColumn("shard", shard_of(splitters)).withColumn("run", F.pmod(F.xxhash64("k", F.lit(7)), F.lit(runs)).cast("int"))
    counts = placed.groupBy("shard", "run").agg(F.count("*").alias("n"))
    # at most n_shards * runs rows
    ahead = Window.partitionBy("shard").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("shard", "run", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base"))
    in_run = Window.partitionBy("shard", "run").orderBy("h", "k")
    ranked = placed.withColumn("rank", F.row_number().over(in_run) - 1)
    return ranked.join(base, ["shard", "run"]).select("doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("rank")).cast("long").alias("slot"))
