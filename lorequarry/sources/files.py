"""A corpus of files as pages and chunks.

Files are listed and read by Spark's binaryFile source. Text and Markdown are decoded here
(invalid bytes dropped); PDF, DOCX and images need parsers that are passed in:
``parsers[extension](content: bytes, ocr) -> list of (page number, text, method)``. A file whose
parser fails gives no pages and one row of rejects.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text, vocab
from ..functions.names import BLANKS
from ..functions.splitter import split_text

Parser = Callable[[bytes, Callable[[bytes], str] | None], list[tuple[int, str, str]]]
FILE = "path string, doc_id string, doc_type string, source_reliability string, extension string"


def scan(spark: SparkSession, root: str) -> DataFrame:
    """path, doc_id, doc_type, source_reliability, extension, content of the files with a known extension, in all folders below ``root``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = files.sparkSession._jvm.org.apache.hadoop.fs.Path(root)
    base = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(base).toString()
    plain = lambda p: F.regexp_replace(p, "^[a-z0-9]+:/*(?=/)", "")
    kind = text.doc_type(F.col("path"))
    root_path = base.split(":", 1)[-1] if ":" in base else base
    root_path = "/" + root_path.lstrip("/")
    out = files.select(F.col("path"), text.doc_id(plain(F.col("path")), root_path).alias("doc_id"), kind.alias("doc_type"), text.reliability_of(kind).alias("source_reliability"), text.extension(F.col("path")).alias("extension"), "content")
    return out.where(F.col("extension").isin(*vocab.EXTENSIONS))


def plain_text(content: bytes, ocr=None) -> list[tuple[int, str, str]]:
    body = content.decode("utf-8", "ignore").strip(BLANKS)
    return [(1, body, "native_text")] if body else []


def paged(pages: list[tuple[int, str, bytes | None]], ocr) -> list[tuple[int, str, str]]:
    """For parsers: (number, text, picture) of pages; a page with hardly any text is read by ``ocr`` from its picture instead."""
    out = []
    for number, body, picture in pages:
        method = "native_text"
        if len(body.strip(BLANKS)) < vocab.OCR_BELOW and ocr is not None and picture is not None:
            body, method = ocr(picture), "ocr"
        if body.strip(BLANKS):
            out.append((number, body.strip(BLANKS), method))
    return out


def docx_text(paragraphs: list[str], tables: list[list[list[str]]]) -> str:
    """Non-blank paragraphs, then the rows of all tables that have any non-blank cell, cells joined by bars."""
    lines = [p.strip(BLANKS) for p in paragraphs if p.strip(BLANKS)]
    for rows in tables:
        lines += [" | ".join(c.strip(BLANKS) for c in cells) for cells in rows if any(c.strip(BLANKS) for c in cells)]
    return "\n".join(lines)


def image_text(content: bytes, ocr) -> list[tuple[int, str, str]]:
    body = (ocr(content) if ocr else "").strip(BLANKS)
    return [(1, body, "ocr")] if body else []


def pages(files: DataFrame, parsers: dict[str, Parser] | None = None, ocr: Callable[[bytes], str] | None = None) -> DataFrame:
    """The files' columns but content, and page_number, text, extraction_method, error (a rejected file has one row with an error)."""
    table = {"txt": plain_text, "md": plain_text, "jpg": image_text, "jpeg": image_text, "png": image_text} | (parsers or {})
    kept = [c for c in files.columns if c != "content"]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                try:
                    read = table.get(row["extension"])
                    if read is None:
                        raise ValueError(f"no parser for {row['extension']}")
                    found = [(n, t, m, None) for n, t, m in read(row["content"], ocr)]
                except Exception as e:  # one file must not stop the corpus
                    found = [(None, None, None, f"{type(e).__name__}: {e}")]
                if found:
                    cols = [pa.array([row[c]] * len(found), pa.string()) for c in kept]
                    n, t, m, err = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([*cols, pa.array(n, pa.int32()), pa.array(t, pa.string()), pa.array(m, pa.string()), pa.array(err, pa.string())], [*kept, "page_number", "text", "extraction_method", "error"])

    return files.mapInArrow(parse, ", ".join(f"{c} string" for c in kept) + ", page_number int, text string, extraction_method string, error string")


def chunks(pages: DataFrame, size: int = vocab.CHUNK_SIZE, overlap: int = vocab.CHUNK_OVERLAP) -> DataFrame:
    """pages: doc_id, doc_type, source_reliability, page_number, text, path, extraction_method. Chunk records."""

    @F.arrow_udf("array<string>")
    def split(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            yield pa.array([split_text(t, size, overlap) if t else [] for t in batch.to_pylist()], pa.list_(pa.string()))

    rows = pages.where(F.col("text").isNotNull()).select("doc_id", "doc_type", "source_reliability", F.col("page_number").cast("int").alias("page_number"), F.col("path").alias("source_path"), "extraction_method", F.posexplode(split("text")).alias("chunk_index", "chunk_text"))
    return rows.select("doc_id", "doc_type", "source_reliability", "page_number", "chunk_text", text.chunk_id(F.col("doc_id"), F.col("page_number"), F.col("chunk_index")).alias("chunk_id"), "source_path", "extraction_method", "chunk_index")


def ingest(spark: SparkSession, root: str, output: str, parsers: dict[str, Parser] | None = None, ocr=None) -> DataFrame:
    """Scan, parse, split and write chunk records as Parquet; returns the rejects (path, error)."""
    from ..storage import materialize

    read = materialize(pages(scan(spark, root), parsers, ocr), "pages")
    chunks(read.where("error is null")).write.mode("overwrite").parquet(output)
    return read.where("error is not null").select("path", "error")
