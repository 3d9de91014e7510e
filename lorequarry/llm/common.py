"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import functools
import gc
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import fresh_path, materialize, release, remove, sent, table

__all__ = ["KEPT", "ascii_lower", "fresh_path", "lean", "materialize", "release", "remove", "sent", "small_batches", "sql_strings", "table", "total"]

KEPT = "lorequarry_packing_worker"  # not a file: where a worker process keeps its encoder
FAN = 8  # vectors that one task adds up
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(c, UPPER, LOWER)


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Lower the session's Arrow batches to ``rows`` whole texts, unless they are smaller. A batch of the usual
    10,000 costs every task some tens of megabytes in its Python worker and up to twice that outside the
    JVM's heap, which is not given back. No result depends on it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, rows)


def sql_strings(values) -> str:
    """An array literal of strings as SQL text: one parse instead of a call for each value."""
    return "array(" + ", ".join("'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" for v in values) + ")"


def lean(task):
    """A worker's function on batches that leaves its process small: Spark runs the next tasks of any operator in the
    same process, and what an earlier one freed (or kept: the encoder of packing) would count beside theirs."""

    @functools.wraps(task)
    def run(batches: Iterator) -> Iterator:
        sys.modules.pop(KEPT, None)
        try:
            yield from task(batches)
        finally:
            give_back()

    return run


def give_back() -> None:
    """Return freed memory to the system, where its C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def total(parts: DataFrame) -> np.ndarray | None:
    """The sum of vectors (k long, data binary: 64-bit floats), added up by tasks in the order of k, so that few
    of them come to the driver; None without any."""

    def add(rows: pa.Table) -> pa.Table:
        order = np.argsort(rows["k"].to_numpy(), kind="stable")
        out = sum(np.frombuffer(rows["data"][int(i)].as_buffer(), np.float64) for i in order)
        return pa.table({"k": pa.array([rows["k"][0].as_py() // FAN], pa.int64()), "data": pa.array([out.tobytes()], pa.binary())})

    for _ in range(3):
        up = F.expr(f"k div {FAN}")
        parts = parts.groupBy(up.alias("up")).applyInArrow(add, "k long, data binary")
    rows = sorted(parts.collect())
    return sum(np.frombuffer(r["data"], np.float64) for r in rows) if rows else None
