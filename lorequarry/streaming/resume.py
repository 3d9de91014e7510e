"""Resumable extraction: a file stream of chunks whose offsets are the checkpoint.

Each micro-batch drops ids that the output has, extracts, and appends; a restarted query goes on
where the checkpoint stands, and a repeated batch appends nothing twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.sample import pending
from ..sources.records import CHUNK


def chunk_stream(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(CHUNK).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def extract_stream(chunks: DataFrame, work: Callable[[DataFrame], DataFrame], output: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """``work``: chunks -> rows with chunk_id. Appends to the Parquet table ``output``."""

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch = batch.dropDuplicates(["chunk_id"])
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{output}/_SUCCESS")
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            batch = pending(batch, spark.read.parquet(output))
        work(batch).write.mode("append").parquet(output)

    writer = chunks.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def progress(query: StreamingQuery) -> dict:
    """Rows so far and rows per second of the last batch."""
    last = query.lastProgress
    return {"batch": last.batchId if last else -1, "rows": sum(p.numInputRows for p in query.recentProgress), "per_second": last.processedRowsPerSecond if last else 0.0}
