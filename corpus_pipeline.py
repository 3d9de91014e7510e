"""A corpus pipeline of five stages: quality, toxicity, near duplicates, decontamination, packing.

Every stage takes (spark, docs, sf_dir) and works on all documents that its predecessor kept;
all but the last return the columns of ``documents``. Models are trained on the labelled
documents of ``sf_dir``, whatever reaches the stage. The shares that stages keep follow from
their decisions only; no stage samples or caps.

Texts may be null, empty or very long, ids repeat or be null, and further columns be there:
rows without id pass the near-duplicate stage, rows that repeat an id and its text leave it once,
rows of one id with different texts are judged each, and all columns are handed on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorequarry.llm import decontam, minhash, packing, quality, queries, toxicity
from lorequarry.llm.common import fresh_path, materialize, sent, table

TOXIC_FROM = 0.3


def _text(name: str = "text"):
    return F.col(name).cast("binary")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches the quantile of training scores at the share of bad labels."""
    model = quality.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), F.lit(True))
    return docs.where(quality.scorer(model)(_text()) >= model.cut)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    net = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), F.lit(True))
    return docs.where(toxicity.scorer(net)(_text()) < TOXIC_FROM)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group (five-word shingles, similarity 0.8) the document with the smallest id stays."""
    found = materialize(minhash.near_duplicates(docs.select("doc_id", "text"), k=5, percent=80).where("doc_id is not null"), "judged")
    rows = found.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "kept").count()
    this = lambda few: (docs["doc_id"] == few["_id"]) & (F.xxhash64(docs["text"].cast("binary")) == few["_hash"])
    lost, again = (materialize(rows.where(c).select("_id", "_hash"), "rows") for c in ("not kept", "kept and count > 1"))
    once = sent(again, this(again), sent(lost, this(lost), docs, "left_anti"), "left_anti")
    return once.unionByName(sent(again, this(again), docs, "left_semi").dropDuplicates(["doc_id", "text"]))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, queries.default_tokenizer())


STAGES = [
    ("quality", keep_quality),
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: The models and the tokenizer have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
