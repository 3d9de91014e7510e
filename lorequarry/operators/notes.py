"""Markdown notes: one (filename, body) row per entity, and the sink that writes them as files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from . import relations as R


def _ascii_json(c):
    """A JSON string with everything beyond ASCII escaped (in UTF-16 units)."""
    units = F.transform(F.split(c, ""), lambda ch: F.when(F.ascii(ch) < 128, F.substr(F.to_json(F.array(ch)), F.lit(2), F.length(F.to_json(F.array(ch))) - 2)).otherwise(
        F.array_join(F.transform(F.sequence(F.lit(1), (F.octet_length(F.encode(ch, "UTF-16BE")) / 2).cast("int")), lambda i: F.concat(F.lit("\\u"), F.lower(F.hex(F.substring(F.encode(ch, "UTF-16BE"), 2 * i - 1, F.lit(2)))))), "")))
    inner = F.array_join(F.transform(units, lambda u: F.when(F.startswith(u, F.lit('"')), F.substr(u, F.lit(2), F.length(u) - 2)).otherwise(u)), "")
    return F.concat(F.lit('"'), inner, F.lit('"'))


def notes(entities: DataFrame, edges: DataFrame, properties: DataFrame, conflicts: DataFrame, contradictions: DataFrame, mentions: DataFrame) -> DataFrame:
    """filename, body, clash (how many notes share the filename). ``entities``: canonical_name, entity_type, aliases."""

    def listed(rows: DataFrame, key: str, line: str, order: list[str], title: str) -> DataFrame:
        lines = F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(line).alias("line")))), lambda s: s["line"])
        return rows.groupBy(F.col(key).alias("canonical_name")).agg(lines.alias(title))

    relation = listed(R.note_lines(edges), "source_entity", "line", ["ord"], "relations")
    blank = properties.groupBy(F.col("owner").alias("canonical_name")).agg(F.lit(True).alias("has_properties"))
    props = listed(R.property_lines(properties), "owner", "line", ["ord"], "properties")
    clashes = conflicts.select("owner", F.col("description").alias("line"), F.lit(0).alias("ord")).unionByName(contradictions.select("owner", F.col("description").alias("line"), F.lit(1).alias("ord")))
    clashes = listed(clashes.withColumn("line", F.concat(F.lit("- ⚠️ "), "line")), "owner", "line", ["ord"], "contradictions")
    seen = R.first_mentions(mentions).withColumn("line", F.concat(F.lit("- "), F.coalesce("meta.doc_id", F.lit("unknown")), F.lit(" ("), F.coalesce("meta.chunk_id", F.lit("")), F.lit(") [reliability: "), F.coalesce("meta.source_reliability", F.lit("unknown")), F.lit("]")))
    seen = listed(seen, "canonical_name", "line", ["ord", "pos"], "mentions")
    out = entities
    for part in (relation, blank, props, clashes, seen):
        out = out.join(part, "canonical_name", "left")
    others = F.array_sort(F.array_remove(F.array_distinct("aliases"), F.col("canonical_name")))
    none = F.array().cast("array<string>")
    head = F.concat(F.array(F.lit("---"), F.concat(F.lit("entity_type: "), "entity_type")), F.when(F.size(others) > 0, F.array(F.concat(F.lit("aliases: ["), F.array_join(F.transform(others, _ascii_json), ", "), F.lit("]")))).otherwise(none),
                    F.array(F.lit("---"), F.lit(""), F.concat(F.lit("# "), "canonical_name"), F.lit("")))
    section = lambda c, title: F.concat(F.array(F.lit(f"## {title}"), F.lit("")), F.coalesce(F.col(c), none), F.array(F.lit("")))
    body = head
    for c, title in (("relations", "Relations"), ("properties", "Properties"), ("contradictions", "Contradictions"), ("mentions", "Mentions")):
        body = F.concat(body, F.when(F.col("has_properties") if c == "properties" else F.size(c) > 0, section(c, title)).otherwise(none))
    out = out.select(F.concat(text.filename(F.col("canonical_name")), F.lit(".md")).alias("filename"), F.array_join(body, "\n").alias("body"))
    same = out.groupBy("filename").agg(F.count("*").alias("clash"))
    return out.join(same, "filename")


def write_notes(notes: DataFrame, folder: str) -> int:
    """One file for each filename, through the Hadoop file system of ``folder``, by the tasks that
    hold the rows where it is local, else row by row from an iterator on the driver. Returns the
    number of notes; a later note of the same filename overwrites an earlier one."""
    spark = notes.sparkSession
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    n = 0
    for row in notes.select("filename", "body").toLocalIterator():
        out = fs.create(jvm.org.apache.hadoop.fs.Path(path, row["filename"]), True)
        out.write(bytearray(row["body"].encode()))
        out.close()
        n += 1
    return n
