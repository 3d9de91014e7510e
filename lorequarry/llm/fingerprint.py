"""Document fingerprints: threshold-scaled sketches (DataFrame operations only).

The sketch of a text is every hash of a ``k``-word shingle below ``fraction`` of the hash
range. The threshold is fixed, so sketches of parts can be merged by union and containment
between very unequal documents is estimated from the sketches alone. A fingerprint is a
string: shingle count, digest of the words, and the base64 of the sorted hashes (8 bytes each).

Words are runs of other characters than ASCII white space; a text of fewer than ``k`` words
is one shingle. Null and empty texts have no words: their fingerprints are equal, and their
likeness to a text with words is 0. Where neither sketch keeps a hash, likeness is 1 for
equal word sequences and else 0. Repeated rows and other columns need no care: the operator
only adds columns to what it is given.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
LOWEST = -(1 << 63)


def threshold(fraction: float) -> int:
    """Signed hashes below this are kept."""
    return LOWEST + int((1 << 64) * fraction) if fraction < 1 else (1 << 63) - 1


def with_sketch(df: DataFrame, text_col: str, prefix: str, k: int = 5, fraction: float = 0.25) -> DataFrame:
    """Adds {prefix}n (shingles), {prefix}digest and {prefix}sketch (sorted, distinct)."""
    hashes, n, digest, sketch = (f"{prefix}{x}" for x in ("_h", "n", "digest", "sketch"))
    words = F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), SPACE), lambda w: w != "")
    df = df.withColumn(hashes, F.transform(words, lambda w: F.xxhash64(w)))
    h = F.col(hashes)
    # each shingle's hash follows from its words' hashes; h is read k times below, so it is not inlined
    many = F.filter(
        F.transform(F.slice(h, 1, F.greatest(F.size(h) - (k - 1), F.lit(0))), lambda x, i: F.xxhash64(*[x, *[F.get(h, i + j) for j in range(1, k)]])),
        lambda s: s < threshold(fraction),
    )
    few = F.filter(F.array(F.xxhash64(h, F.lit(k))), lambda s: s < threshold(fraction))
    none = F.array().cast("array<bigint>")
    kept = F.when(F.size(h) >= k, many).when(F.size(h) > 0, few).otherwise(none)
    count = F.when(F.size(h) >= k, F.size(h) - (k - 1)).otherwise((F.size(h) > 0).cast("int"))
    return df.withColumns({n: count.cast("long"), digest: F.xxhash64(h), sketch: F.array_sort(F.array_distinct(kept))}).drop(hashes)


def as_string(prefix: str) -> Column:
    body = F.base64(F.unhex(F.array_join(F.transform(F.col(f"{prefix}sketch"), lambda x: F.lpad(F.hex(x), 16, "0")), "")))
    return F.concat_ws(":", F.col(f"{prefix}n"), F.lower(F.lpad(F.hex(f"{prefix}digest"), 16, "0")), F.replace(body, F.lit("\r\n"), F.lit("")))


def parse(fingerprint: Column) -> Column:
    """The sketch of a fingerprint, as an array of big-endian 8-byte hashes in hex."""
    body = F.hex(F.unbase64(F.split_part(fingerprint, F.lit(":"), F.lit(3))))
    return F.filter(F.transform(F.sequence(F.lit(0), F.greatest((F.length(body) / 16).cast("int") - 1, F.lit(0))), lambda i: F.substring(body, i * 16 + 1, 16)), lambda x: x != "")


def likeness(a: str, b: str) -> Column:
    """Estimated Jaccard similarity of two sketches by column prefix; of sketches of one fraction."""
    x, y = F.col(f"{a}sketch"), F.col(f"{b}sketch")
    both = F.size(F.array_intersect(x, y))
    union = F.size(x) + F.size(y) - both
    same = F.col(f"{a}digest") == F.col(f"{b}digest")
    return F.when(same, F.lit(1.0)).when(union > 0, both / union).otherwise(F.lit(0.0))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b has; null where a keeps none. Sketches merge by array_union."""
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a))


def with_next(docs: DataFrame, carried: list[str], order: list[str], buckets: int | None = None, id_col: str = "doc_id") -> DataFrame:
    """Adds next_{c}, for each carried column, of the following row by id (after the last: the
    first). Rows go once to ``buckets`` ranges of ids, and each range also gets a copy of the
    row that begins the next one, so no window spans the table. Null ids come first; equal ids
    go by the columns ``order``. The driver sees a count of ids in the order of ``buckets``."""
    buckets = buckets or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.withColumn("_k", F.coalesce(F.col(id_col).cast("long"), F.lit(LOWEST)))
    ids = rows.select("_k")
    cuts = [i / buckets for i in range(1, buckets)] or [0.5]
    bounds = sorted(set(ids.agg(F.percentile_approx("_k", cuts, 100 * buckets)).first()[0] or []))
    bucket = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b < F.col("_k"))) if bounds else F.lit(0)
    starts = sorted(tuple(r) for r in ids.groupBy(bucket.alias("b")).agg(F.min("_k")).collect())
    before = {starts[i][1]: starts[i - 1][0] for i in range(len(starts))}
    rows = rows.withColumn("_bucket", bucket).withColumn("_copy", F.lit(0))
    if before:
        home = F.create_map(*[F.lit(x) for pair in before.items() for x in pair])
        copies = rows.where(F.col("_k").isin(list(before))).withColumn("_bucket", F.element_at(home, F.col("_k"))).withColumn("_copy", F.lit(1))
        rows = rows.unionByName(copies)
    in_order = Window.partitionBy("_bucket").orderBy("_copy", "_k", *order)
    return rows.withColumns({f"next_{c}": F.lead(c).over(in_order) for c in carried}).where("_copy = 0").drop("_k", "_bucket", "_copy")


def compare_edits(docs: DataFrame, k: int = 5, fraction: float = 0.25, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of the text with its last quarter replaced by the start of
    the next document, and the likeness to that edit and to the next document."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = with_next(with_sketch(base, "text", "own_", k, fraction), ["text", "own_digest", "own_sketch"], ["text"])
    rows = rows.withColumnsRenamed({"next_own_digest": "next_digest", "next_own_sketch": "next_sketch"}).withColumn("n_chars", F.char_length("text").cast("long"))
    cut = F.floor(F.col("n_chars") / 4).cast("int")
    edited = F.concat(F.left(F.col("text"), F.col("n_chars").cast("int") - cut), F.left(F.coalesce(F.col("next_text"), F.lit("")), cut))
    rows = with_sketch(rows.withColumn("edited", edited).drop("text", "next_text"), "edited", "edit_", k, fraction)
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_string("own_").alias("fingerprint"), as_string("edit_").alias("edited_fingerprint"),
        likeness("own_", "edit_").alias("near_edited"), likeness("own_", "next_").alias("near_next"),
    )
