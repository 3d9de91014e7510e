"""Tables written between the steps of a job, in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that may be sent to every task: ids and a few numbers, so some tens of megabytes.
SENT_ROWS = 500_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    A default is set in local mode only (tests, notebooks); a cluster has to name one, as no folder
    of a single machine would do.
    """
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
        path = "/tmp/checkpoints"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def fresh_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/lorequarry-{what}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut, and a lost
    executor costs a reread instead of a recomputation."""
    spark = df.sparkSession
    path = fresh_path(spark, what)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Delete a written table; works for any file system that Spark can reach."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def release(out: DataFrame, *used: DataFrame) -> DataFrame:
    """``out``, after the tables that only it was made of are deleted; it must be written itself."""
    for df in used:
        if path := vars(df).get("_written"):
            remove(out.sparkSession, path)
    return out


def sent(few: DataFrame, on: str | list[str], many: DataFrame, how: str = "inner") -> DataFrame:
    """``many`` joined with ``few``, which is sent to every task if it has at most SENT_ROWS rows, so that
    ``many`` stays where it is; beyond that, both are exchanged."""
    return many.join(F.broadcast(few) if few.count() <= SENT_ROWS else few, on, how)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
