"""Scalar functions as Column expressions; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import names, vocab

#: What Python's str.strip() removes: Unicode white space and the separators U+001C to U+001F.
BLANKS = "[" + "".join(f"\\x{{{ord(c):X}}}" for c in names.BLANKS) + "]"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{BLANKS}+|{BLANKS}+$", "")


def norm(c: Column) -> Column:
    """The key by which names are compared."""
    return F.lower(strip(c))


def words(c: Column) -> Column:
    return F.filter(F.split(c, f"{BLANKS}+"), lambda w: w != "")


def leak_pattern(name: Column) -> Column:
    """The first pattern of instruction text that a name holds, else null."""
    low = F.lower(name)
    return F.coalesce(*[F.when(F.contains(low, F.lit(p)), F.lit(p)) for p in vocab.LEAK_PATTERNS])


def is_proper(stripped: Column, low: Column, n: Column) -> Column:
    """Looks like a named entity, from a stripped name, it lower-cased, and its number of words."""
    first = F.left(stripped, F.lit(1))
    clause, leak = F.lit(False), F.lit(False)
    for m in vocab.CLAUSE_MARKERS:
        clause = clause | F.contains(low, F.lit(m))
    for p in vocab.LEAK_PATTERNS:
        leak = leak | F.contains(low, F.lit(p))
    bad = (stripped == "") | leak | ((n == 1) & (first == F.lower(first)) & (first != F.upper(first))) | (stripped == low) | (clause & (n > vocab.CLAUSE_WORDS)) | (n > vocab.MOST_WORDS)
    return ~bad


def is_proper_name(name: Column) -> Column:
    """Looks like a named entity. Null counts as blank."""
    text = strip(F.coalesce(name, F.lit("")))
    return is_proper(text, F.lower(text), F.size(words(text)))


def indel_ratio(a: Column, b: Column) -> Column:
    """Similarity from 0 to 100 by insertions and deletions, rounded half to even:
    200 * (longest common subsequence) / (both lengths). One row of the dynamic programme
    is kept; b's characters run in the outer fold."""
    x, y = F.split(a, ""), F.split(b, "")
    zero = F.transform(x, lambda _: F.lit(0))

    def row(prev: Column, ch: Column) -> Column:
        start = F.struct(F.array().cast("array<int>").alias("r"), F.lit(0).alias("left"), F.lit(0).alias("diag"))
        step = lambda s, p: F.struct(
            F.concat(s["r"], F.array(best(s, p, ch))).alias("r"), best(s, p, ch).alias("left"), p["p"].alias("diag"))
        return F.aggregate(F.arrays_zip(prev.alias("p"), x.alias("c")), start, step, lambda s: s["r"])

    def best(s: Column, p: Column, ch: Column) -> Column:
        return F.when(p["c"] == ch, s["diag"] + 1).otherwise(F.greatest(s["left"], p["p"]))

    lcs = F.coalesce(F.element_at(F.aggregate(y, zero, row), -1), F.lit(0))
    total = F.length(a) + F.length(b)
    return F.when(total == 0, 100).when((F.length(a) == 0) | (F.length(b) == 0), 0).otherwise(F.bround(200.0 * lcs / total, 0)).cast("int")


def doc_type(path: Column) -> Column:
    low = F.lower(path)
    out = F.when(F.contains(low, F.lit(vocab.DOC_TYPES[0][0])), vocab.DOC_TYPES[0][0])
    for name, _ in vocab.DOC_TYPES[1:]:
        out = out.when(F.contains(low, F.lit(name)), name)
    return out.otherwise(vocab.UNKNOWN)


def reliability_of(kind: Column) -> Column:
    out = F.when(kind == vocab.DOC_TYPES[0][0], vocab.DOC_TYPES[0][1])
    for name, level in vocab.DOC_TYPES[1:]:
        out = out.when(kind == name, level)
    return out.otherwise("low")


def reliability_rank(level: Column) -> Column:
    return F.when(level == "high", 0).when(level == "medium", 1).otherwise(2)


def doc_id(path: Column, root: str = "") -> Column:
    """The path below ``root`` with its parts joined by two underscores, without extension."""
    rel = F.replace(path, F.lit("\\"), F.lit("/"))
    if root:
        prefix = root.rstrip("/") + "/"
        rel = F.when(F.startswith(rel, F.lit(prefix)), F.substr(rel, F.lit(len(prefix) + 1))).otherwise(rel)
    return F.replace(F.regexp_replace(rel, r"(?<=[^/])\.[^./]*$", ""), F.lit("/"), F.lit("__"))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]*)$", 1))


def chunk_id(doc: Column, page: Column, index: Column) -> Column:
    return F.concat(doc, F.lit("__p"), page.cast("string"), F.lit("__c"), index.cast("string"))


def relation_label(kind: Column) -> Column:
    return F.replace(kind, F.lit("_"), F.lit(" "))


def citation(doc: Column, page: Column, chunk: Column) -> Column:
    return F.when(page.isNotNull(), F.concat(F.lit("["), doc, F.lit(", p. "), page.cast("string"), F.lit("]"))).otherwise(F.concat(F.lit("["), doc, F.lit(", "), chunk, F.lit("]")))


def excerpt(text: Column, limit: int) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(limit)), F.lit("... [excerpt truncated]"))).otherwise(text)


def filename(name: Column) -> Column:
    return F.left(F.btrim(F.regexp_replace(name, r'[<>:"/\\|?*]', "_"), F.lit(". ")), F.lit(vocab.FILENAME_LENGTH))


def path_text(nodes: Column, hops: Column) -> Column:
    """nodes: names; hops: an array of struct(source, target, kind), one for each step. A step
    against the relation's direction is drawn with ``<-``."""
    step = lambda node, i: F.when(i == 0, node).otherwise(
        F.concat(F.when(F.get(hops, i - 1)["source"] == F.get(nodes, i - 1), "-> ").otherwise("<- "), relation_label(F.coalesce(F.get(hops, i - 1)["kind"], F.lit(""))), F.lit("\n"), node))
    return F.coalesce(F.array_join(F.transform(nodes, step), "\n"), F.lit(""))


def fenced(answer: Column) -> Column:
    """The inside of the first Markdown fence, or the whole answer."""
    pattern = r"(?is)```(?:json)?\s*(.*?)\s*```"
    return F.when(F.regexp_like(answer, F.lit(pattern)), F.regexp_extract(answer, pattern, 1)).otherwise(answer)
