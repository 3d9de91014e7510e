"""WARC archives: writing, reading and revisit resolution.

Archives are written by Spark's text writer (so by its commit protocol, to any file system
Spark reaches): a row is a record up to the end of its block, the line separator is the two
line ends that close a WARC record. They are read back through Spark's text reader with the same
separator, a stream of bytes per file, whose records are cut by Content-Length in Python; a
task holds one record and one batch at a time, however large the file. Archives are compressed
whole, so a file is never split among tasks.

Revisit resolution shuffles headers only (digest, page id, URL, and the record's own id): the
digests that recur give each record that repeats one its response. Those decisions are joined to
the archived records by record id, in place if they are few enough to be sent to every task
(``sent_rows``), else by exchanging records on ids that are all different, so no digest is hot
there. Of the records with equal payloads of at least ``least_bytes``, the one with the
smallest page id is the response; the others become revisit records (no payload, WARC-Refers-To
the response), and all get fresh headers. Smaller payloads are responses each.

Defined results: a null payload is an empty one; a null URL gives a record without target;
ASCII control characters in URLs, and blanks at either end, are written percent-encoded; records
without a page id are never chosen as response while another has one; rows that repeat the
response's page id and payload are responses too; an empty table gives archives without records.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh_path, materialize, remove

HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n\r\n"
LEAST = 100
RECORDS_PER_FILE = 50_000
BATCH_BYTES = 16 << 20
SENT_ROWS = 500_000  # decisions of about 150 bytes
CONTROLS = [*range(32), 127]


def record_id(page_id: Column, digest: Column, url: Column, generation: str) -> Column:
    """A URN that depends on the record only, so a repeated task writes the same."""
    h = F.sha2(F.concat_ws("|", F.lit(generation), F.coalesce(page_id.cast("string"), F.lit("")), digest, F.coalesce(url, F.lit(""))), 256)
    cut = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in cut]), F.lit(">"))


def _line(name: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))).otherwise("")


def safe_url(url: Column) -> Column:
    """One line without blanks at its ends."""
    out = url
    for c in CONTROLS:
        out = F.replace(out, F.lit(chr(c)), F.lit(f"%{c:02X}"))
    out = F.when(F.rlike(url, F.lit(r"[\x00-\x1F\x7F]")), out).otherwise(url)
    bare = F.btrim(out)
    ends = F.length(out) - F.length(F.ltrim(out)), F.length(out) - F.length(F.rtrim(out))
    blanks = lambda n: F.repeat(F.lit("%20"), n.cast("int"))
    trimmed = F.when(bare == "", blanks(F.length(out))).otherwise(F.concat(blanks(ends[0]), bare, blanks(ends[1])))
    return F.when(out != bare, trimmed).otherwise(out)


def write(records: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", records_per_file: int = RECORDS_PER_FILE, level: str = "BEST_SPEED") -> None:
    """records: page_id, url, record_type, payload (binary), payload_bytes, payload_digest,
    record_id, refers_to_id. A revisit's payload is not written. ``level`` is that of the compression."""
    revisit = F.col("record_type") == "revisit"
    safe = safe_url(F.col("url"))
    http = F.encode(F.concat(F.lit(HTTP + "Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(END)), "utf-8")
    block = F.concat(http, F.when(revisit, F.lit(b"")).otherwise(F.col("payload")))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.col("record_type"), F.lit("\r\n"), _line("WARC-Record-ID", F.col("record_id")), F.lit(f"WARC-Date: {date}\r\n"),
        _line("WARC-Target-URI", safe), _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))), _line("X-Page-Id", F.col("page_id").cast("string")),
        F.when(revisit, F.concat(F.lit(f"WARC-Profile: {PROFILE}\r\n"), _line("WARC-Refers-To", F.col("refers_to_id")))).otherwise(""),
        F.lit("Content-Type: application/http;msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit(END),
    )
    row = F.concat(F.encode(head, "utf-8"), block).cast("string")
    records.select(row.alias("value")).write.option("lineSep", END).option("compression", "gzip").option("zlib.compress.level", level).option("maxRecordsPerFile", records_per_file).text(path)


FIELD = re.compile(rb"([^:\r\n]+): *([^\r\n]*)\r\n")


def parse(parts: Iterator[bytes | int]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of each record of a stream of bytes, given in parts as they
    come; a number stands for so many bytes that don't matter."""
    held, fields, need = bytearray(), None, 0
    for part in parts:
        held += bytes(part) if isinstance(part, int) else part
        while True:
            if fields is None:
                if held[:1] in (b"\r", b"\n"):  # a file whose last payload ends with line ends gives one separator too many
                    del held[: len(held) - len(held.lstrip(b"\r\n"))]
                end = held.find(b"\r\n\r\n")
                if end < 0:
                    break
                fields = {k.decode("utf-8", "replace").lower(): v.decode("utf-8", "replace") for k, v in FIELD.findall(bytes(held[: end + 2]))}
                del held[: end + 4]
                need = int(fields["content-length"])
            if len(held) < need + len(END):
                break
            yield fields, bytes(held[:need])
            del held[: need + len(END)]
            fields = None
    if held or fields is not None:
        raise ValueError("the archive ends within a record")


SCHEMA = "page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, record_id string, refers_to_id string"


def read(spark, path: str, payloads: bool = True) -> DataFrame:
    """The records of all archives under ``path``: a revisit's payload is null (without ``payloads``, every
    one's), payload_bytes and payload_digest are those of the full payload."""
    arrow = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_id", pa.string()), ("refers_to_id", pa.string())])

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes | int]:
        close = END.encode()
        for batch in batches:
            for row, size in zip(batch["row"], batch["size"].to_pylist(), strict=True):
                yield row.as_py() if row.is_valid else size
                yield close

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for f, block in parse(parts(batches)):
            http, _, payload = block.partition(b"\r\n\r\n")
            page = f.get("x-page-id")
            size = re.search(rb"(?i)content-length: *(\d+)", http)
            rows.append({
                "page_id": int(page) if page else None, "url": f.get("warc-target-uri"), "record_type": f["warc-type"], "payload": payload if payloads and f["warc-type"] != "revisit" else None,
                "payload_bytes": int(size[1]) if size else len(payload), "payload_digest": f.get("warc-payload-digest", "").removeprefix("sha256:"), "record_id": f.get("warc-record-id"), "refers_to_id": f.get("warc-refers-to"),
            })
            held += len(payload)
            if len(rows) == 500 or held > BATCH_BYTES:
                yield pa.RecordBatch.from_pylist(rows, arrow)
                rows, held = [], 0
        yield pa.RecordBatch.from_pylist(rows, arrow)

    raw = F.col("value").cast("binary")
    # of payloads only the size is needed for the headers; whatever may be a header is sent
    wanted = F.lit(True) if payloads else F.contains(F.col("value"), F.lit("WARC/1.1\r\n")) | F.contains(F.col("value"), F.lit("HTTP/1.1 "))
    files = spark.read.option("lineSep", END).text(path).select(F.when(wanted, raw).alias("row"), F.octet_length("value").alias("size"))
    return files.mapInArrow(cut, SCHEMA)


def capture(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """A response record per page."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha2("payload", 256)})
    return rows.select("page_id", "url", F.lit("response").alias("record_type"), "payload", "payload_bytes", "payload_digest", record_id(F.col("page_id"), F.col("payload_digest"), F.col("url"), "captured").alias("record_id"), F.lit(None).cast("string").alias("refers_to_id"))


def decide(heads: DataFrame, least_bytes: int = LEAST) -> DataFrame:
    """heads: the headers of records. record_id, first_page, first_url: a row for each record that is
    to revisit another; only headers are exchanged."""
    heads = heads.where((F.col("payload_bytes") >= least_bytes) & (F.col("record_type") == "response"))
    # partial aggregation reduces each hot payload to a row per task; records without a page id count, but are never first
    known = F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))
    twice = heads.groupBy("payload_digest").agg(F.min(known).alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    twice = twice.select("payload_digest", F.col("first.page_id").alias("first_page"), F.col("first.url").alias("first_url"))
    again = heads.join(twice, "payload_digest").where(~F.col("page_id").eqNullSafe(F.col("first_page")))
    return again.select("record_id", "first_page", "first_url").distinct()


def resolve(records: DataFrame, decisions: DataFrame, sent_rows: int = SENT_ROWS) -> DataFrame:
    """Revisit resolution: the records with type, record_id and refers_to_id anew."""
    decisions = materialize(decisions, "warc-decisions")
    small = decisions.count() <= sent_rows
    out = records.join(F.broadcast(decisions) if small else decisions.hint("merge"), "record_id", "left")
    again = F.col("first_page").isNotNull()
    origin = record_id(F.col("first_page"), F.col("payload_digest"), F.col("first_url"), "resolved")
    return out.select("page_id", "url", F.when(again, "revisit").otherwise("response").alias("record_type"), "payload", "payload_bytes", "payload_digest",
                      record_id(F.col("page_id"), F.col("payload_digest"), F.col("url"), "resolved").alias("record_id"), F.when(again, origin).alias("refers_to_id"))


def follow(heads: DataFrame) -> DataFrame:
    """Headers of read records, each revisit joined to its response: adds refers_to (a page id)."""
    revisits = heads.where("refers_to_id is not null")
    wanted = revisits.select(F.col("refers_to_id").alias("record_id")).distinct()
    targets = heads.where("record_type = 'response'").select("record_id", "page_id").join(wanted, "record_id", "left_semi")
    targets = targets.groupBy(F.col("record_id").alias("refers_to_id")).agg(F.min("page_id").alias("refers_to"))
    once = heads.where("refers_to_id is null").withColumn("refers_to", F.lit(None).cast("long"))
    return once.unionByName(revisits.join(targets, "refers_to_id", "left").select(*once.columns))


def archive(pages: DataFrame, least_bytes: int = LEAST, sent_rows: int = SENT_ROWS) -> DataFrame:
    """Write, read, resolve, write again without the repeated payloads, and read what came of it."""
    spark = pages.sparkSession
    raw, lean = fresh_path(spark, "warc-captured"), fresh_path(spark, "warc-resolved")
    write(capture(pages), raw)
    heads = materialize(read(spark, raw, payloads=False).drop("payload"), "warc-headers")
    write(resolve(read(spark, raw), decide(heads, least_bytes), sent_rows), lean, date="2024-06-01T00:00:00Z")
    remove(spark, raw)
    return follow(materialize(read(spark, lean, payloads=False).drop("payload"), "warc-headers"))
