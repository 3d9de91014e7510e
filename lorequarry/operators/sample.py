"""Stratified sampling and resumption."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocab


def stratified(chunks: DataFrame, per_type: int = 5, least: int = 15, seed: str = "0", strata: tuple[str, ...] = tuple(t for t, _ in vocab.DOC_TYPES), type_col: str = "doc_type", id_col: str = "chunk_id") -> DataFrame:
    """Up to ``per_type`` rows of each target type, then rows of any type until there are
    ``least``. Order within a type is that of md5(seed and id), so a seed fixes the sample."""
    rows = chunks.withColumn("_h", F.md5(F.concat(F.lit(seed), F.col(id_col).cast("string"))))
    ranked = rows.withColumn("_r", F.row_number().over(Window.partitionBy(type_col).orderBy("_h", id_col)))
    taken = ranked.where(F.col(type_col).isin(*strata) & (F.col("_r") <= per_type)).drop("_r")
    n = taken.count()  # at most per_type * strata
    if n < least:
        rest = rows.join(taken.select(id_col).distinct(), id_col, "left_anti").select(rows.columns)
        taken = taken.unionByName(rest.orderBy("_h", id_col).limit(least - n))
    return taken.drop("_h")


def pending(chunks: DataFrame, done: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    """Chunks whose id no finished extraction bears."""
    return chunks.join(done.select(id_col).where(F.col(id_col).isNotNull()), id_col, "left_anti")
