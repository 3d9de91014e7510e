"""JSON Lines of chunks and extractions, checkpoints, and a folder of notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text

CHUNK = "doc_id string, doc_type string, source_reliability string, page_number int, chunk_text string, chunk_id string, source_path string, extraction_method string, chunk_index int"
ENTITY = "struct<name:string,entity_type:string,aliases:array<string>>"
RELATION = "struct<source_entity:string,relation_type:string,target_entity:string,property_value:string,negated:boolean,confidence:double,justification:string,source_chunk_id:string,source_doc_id:string,source_reliability:string>"
META = "struct<chunk_id:string,doc_id:string,source_reliability:string,page_number:string>"
EXTRACTION = f"struct<entities:array<{ENTITY}>,relations:array<{RELATION}>,chunk_meta:{META},_bad:string>"


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Strict: a bad line fails the job; blank lines are skipped."""
    return spark.read.schema(CHUNK).option("mode", "FAILFAST").json(path)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """ord, line of the non-blank lines. ord follows files and positions within them, so a single file keeps its order."""
    rows = spark.read.text(path).select(F.monotonically_increasing_id().alias("ord"), F.col("value").alias("line"))
    return rows.where(text.strip(F.col("line")) != "")


def line_error(line: Column) -> Column:
    """Why a line is no extraction record, else null. Judged on the raw JSON, so wrong types aren't coerced."""
    start = F.left(text.strip(line), F.lit(1))
    whole = F.try_parse_json(line)
    kind = lambda path: F.schema_of_variant(F.try_variant_get(whole, path, "variant"))
    out = F.when(whole.isNull(), "not JSON").when(start != "{", "not an object")
    for key in ("entities", "relations"):
        out = out.when(~F.coalesce(F.startswith(kind(f"$.{key}"), F.lit("ARRAY")), F.lit(False)), f"missing or invalid '{key}'")
    return out


def parse_extractions(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows: ord, line. (extractions, rejects): rejects have ord, line, error. Records whose elements
    lack a name, source, type or (but for properties) target are rejected too."""
    parsed = rows.withColumn("error", line_error(F.col("line"))).withColumn("x", F.from_json("line", EXTRACTION, {"columnNameOfCorruptRecord": "_bad"}))
    x = F.col("x")
    holes = F.exists(x["entities"], lambda e: e["name"].isNull()) | F.exists(x["relations"], lambda r: r["source_entity"].isNull() | r["relation_type"].isNull() | ((r["relation_type"] != "has_property") & r["target_entity"].isNull()))
    broken = x.isNull() | x["entities"].isNull() | x["relations"].isNull() | x["_bad"].isNotNull()
    parsed = parsed.withColumn("error", F.coalesce("error", F.when(broken, "malformed field"), F.when(holes, "element without a required field")))
    good = parsed.where("error is null").select("ord", "x.entities", "x.relations", F.struct(x["chunk_meta"]["chunk_id"].alias("chunk_id"), x["chunk_meta"]["doc_id"].alias("doc_id"), x["chunk_meta"]["source_reliability"].alias("source_reliability"), F.expr("try_cast(x.chunk_meta.page_number as int)").alias("page_number")).alias("chunk_meta"))
    return good, parsed.where("error is not null").select("ord", "line", "error")


def read_extractions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Lenient. FileNotFoundError without input, ValueError without any valid record."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        raise FileNotFoundError(path)
    good, bad = parse_extractions(lines(spark, path))
    if good.isEmpty():
        raise ValueError(f"no valid extraction record in {path}")
    return good, bad


def read_checkpoint(spark: SparkSession, path: str) -> DataFrame:
    """Finished extractions with chunk_id; bad lines and records without a chunk id are dropped, repeats kept."""
    good, _ = parse_extractions(lines(spark, path))
    return good.withColumn("chunk_id", F.col("chunk_meta.chunk_id")).where("chunk_id is not null")


def read_notes(spark: SparkSession, folder: str) -> DataFrame:
    """name, entity_type of the Markdown notes of a folder."""
    files = spark.read.option("pathGlobFilter", "*.md").text(folder, wholetext=True).select("value", F.col("_metadata.file_name").alias("file"))
    front = F.regexp_extract("value", r"(?s)\A---(.*?)---", 1)
    kind = text.strip(F.regexp_extract(front, r"(?m)^entity_type:(.*)$", 1))
    return files.select(F.regexp_replace(F.url_decode("file"), r"\.md$", "").alias("name"), F.when(kind == "", "unknown").otherwise(kind).alias("entity_type"))
