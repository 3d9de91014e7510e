"""Connected components by large-star and small-star rounds on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialize, release


def components(edges: DataFrame) -> DataFrame:
    """edges: x, y (of one comparable type). Returns id, component (the least id that it
    reaches), for ids that have an edge to another. Edges are written between rounds, so
    lineage stays short and nothing but a count and two checksums reaches the driver."""
    edges = materialize(edges.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).where("x <> y").distinct(), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.toDF("y", "x"))
        least = both.groupBy("x").agg(F.min("y").alias("m")).withColumn("m", F.least("x", "m"))
        large = both.join(least, "x").where("y > x").select(F.col("y").alias("x"), F.col("m").alias("y")).where("x <> y").distinct()
        lower = large.groupBy("x").agg(F.min("y").alias("m"))
        small = large.join(lower, "x").select(F.col("y").alias("x"), F.col("m").alias("y")).where("x <> y").unionByName(lower.toDF("x", "y")).distinct()
        edges = release(materialize(small, "edges"), edges)
        now = edges.agg(F.count("*"), F.sum(F.hash("x", "y").cast("long")), F.sum(F.hash("y", "x", "y").cast("long"))).first()
        if now == before or not now[0]:
            return edges.groupBy(F.col("x").alias("id")).agg(F.min("y").alias("component"))
        before = now
