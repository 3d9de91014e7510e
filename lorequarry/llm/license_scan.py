"""Licence scan by a positional index of rare words (DataFrame operations only).

Two layers, both local to a row, so nothing is shuffled but the word counts:

* base phrases: every place where a phrase's words stand consecutively, by string search on
  the text with each word padded by its own blanks;
* templates: words of known licence texts. The document frequency of every licence word is
  counted over the corpus (at most a few hundred counts). Each template is posted under its own
  words of highest IDF (half of them, but ``agree + 2`` at least), and all posted words of a
  file are looked up in the postings (word -> template, position), so what else stands in the
  file takes nothing from a template; a template is aligned where at least two distinct posted
  words imply the same relative position, and accepted if all its mandatory phrases stand in
  the aligned passage. ``score`` is the largest share of a template's words found in place.

Defined results: null and empty texts have no words, no labels and score 0; an empty table
gives no rows; repeated rows each get their row; other input columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, sql_strings

#: phrase -> label
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: Fixed values: (label, words of a licence text or notice, mandatory phrases).
TEMPLATES = (
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("hereby granted free of charge", "associated documentation files")),
    ("apache-2", "licensed under the apache license version 2 0", ("apache license version 2",)),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", ("gnu general public license", "version 3")),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3", ("gnu general public license", "either version 3")),
    ("gpl-2", "under the terms of the gnu general public license version 2", ("gnu general public license", "version 2")),
    ("lgpl", "under the terms of the gnu lesser general public license", ("gnu lesser general public license",)),
    ("agpl-3", "under the terms of the gnu affero general public license version 3", ("gnu affero general public license",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", ("creative commons attribution",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use", "source and binary forms")),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software",)),
)

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ADDED = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]


def _count(s: Column, what: Column | str, length: Column | int) -> Column:
    return ((F.length(s) - F.length(F.replace(s, what if isinstance(what, Column) else F.lit(what), F.lit("")))) / length).cast("long")


def _padded(phrase: str) -> str:
    return " " + phrase.replace(" ", "  ") + " "


def vocabulary(templates=TEMPLATES) -> list[str]:
    return sorted({w for _, text, _ in templates for w in text.split()})


def possible(phrases: list[str], own: str = "own") -> Column:
    """A file may hold one of the phrases: it has all words of one."""
    parts = [f"size(array_intersect({own}, {sql_strings(words)})) = {len(words)}" for words in (sorted(set(p.split())) for p in phrases)]
    return F.expr(" or ".join(parts) or "false")


def with_words(docs: DataFrame, vocab: list[str], phrases: list[str]) -> DataFrame:
    """doc_id, n_words, own (its licence words), and for files that may hold one of the phrases
    ``_s``, the lower-cased words, each with a blank of its own on both sides. Java's lower()
    also changes letters beyond ASCII; they stay word characters, and the only ones that turn
    into ASCII letters (the Kelvin sign, to k) occur in no mandatory phrase."""
    words = F.split(F.lower(F.coalesce(F.col("text"), F.lit(""))), NOT_WORD)
    split = docs.select("doc_id", words.alias("_w"))
    edge = lambda c: (c == "").cast("int")
    w = F.col("_w")
    n = F.when(F.size(w) == 1, 1 - edge(F.get(w, F.lit(0)))).otherwise(F.size(w) - edge(F.get(w, F.lit(0))) - edge(F.element_at(w, -1)))
    split = split.select("doc_id", "_w", n.cast("long").alias("n_words"), F.array_intersect(w, F.expr(sql_strings(vocab))).alias("own"))
    gate = possible(phrases)
    padded = F.concat(F.lit(" "), F.array_join(F.filter(w, lambda x: x != ""), "  "), F.lit(" "))
    return split.select("doc_id", "n_words", "own", F.when(gate, padded).alias("_s"))


def document_frequency(words: DataFrame) -> dict[str, int]:
    """How many rows hold each licence word; as many counts as there are licence words."""
    return {w: n for w, n in words.select(F.explode("own").alias("w")).groupBy("w").count().collect()}


def _words_before(prefix: Column) -> Column:
    """Words in a prefix of the padded string: each has two blanks."""
    return F.floor(_count(prefix, " ", 1) / 2).cast("long")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base=BASE, templates=TEMPLATES, agree: int = 2) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    vocab = sorted(set(vocabulary(templates)) | {w for p, _ in base for w in p.split()})
    gates = sorted({p for p, _ in base} | {phrases[0] for _, _, phrases in templates})
    words = with_words(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), vocab, gates)
    words = materialize(words, "license-words")  # one pass over the texts; what follows reads this
    s = F.coalesce(F.col("_s"), F.lit(""))
    df = document_frequency(words)
    # A word that stands in most files tells nothing; ties by the word itself.
    rank = {w: i for i, w in enumerate(sorted(vocab, key=lambda w: (df.get(w, 0), w)))}
    postings = []
    for t, (_, text, _) in enumerate(templates):
        own = text.split()
        for w in sorted(set(own), key=rank.get)[: max(agree + 2, math.ceil(len(set(own)) / 2))]:
            postings += [(w, t, p) for p, x in enumerate(own) if x == w]
    indexed = sorted({w for w, _, _ in postings}, key=rank.get)
    post = F.expr("array(" + ", ".join(f"named_struct('w', '{w}', 't', {t}, 'p', {p})" for w, t, p in postings) + ")")

    n_base = sum((_count(s, _padded(p), len(_padded(p))) for p, _ in base), F.lit(0)).cast("long")
    firsts = [F.when(F.contains(s, F.lit(_padded(p))), _words_before(F.substring_index(s, _padded(p), 1))) for p, _ in base]
    lasts = [F.when(F.contains(s, F.lit(_padded(p))), F.col("n_words") - len(p.split()) - _words_before(F.substring_index(s, _padded(p), -1))) for p, _ in base]
    base_set = F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(F.contains(s, F.lit(_padded(p))), F.lit(label)) for p, label in base]))))
    least = lambda xs: F.least(*xs) if len(xs) > 1 else xs[0]
    most = lambda xs: F.greatest(*xs) if len(xs) > 1 else xs[0]

    out = words.select("doc_id", "_s", "n_words", "own", F.col("_s").isNotNull().alias("_gate"))
    out = out.select("*", n_base.alias("n_base"), least(firsts).alias("first_word"), most(lasts).alias("last_word"), base_set.alias("_base"), F.when(F.col("_gate"), F.split(F.btrim(F.replace(s, F.lit("  "), F.lit(" "))), " ")).alias("_w"))
    out = out.withColumn("_rare", F.when(F.col("_gate"), F.array_intersect(F.expr(sql_strings(indexed)), F.col("own"))))
    found = F.filter(F.transform(F.col("_w"), lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: F.array_contains(F.col("_rare"), x["w"]))
    hits = F.flatten(F.transform(found, lambda x: F.transform(F.filter(post, lambda q: q["w"] == x["w"]), lambda q: F.struct(q["t"].alias("t"), (x["i"] - q["p"]).alias("at"), q["p"].alias("p")))))
    out = out.withColumn("_hits", F.when(F.col("_gate"), F.array_sort(F.array_distinct(hits))))
    pair = lambda h: F.struct(h["t"].alias("t"), h["at"].alias("at"))
    aligned = F.array_distinct(F.transform(F.filter(F.col("_hits"), lambda h, i: (i >= agree - 1) & (pair(F.get(F.col("_hits"), i - (agree - 1))) == pair(h))), pair))
    table = F.expr("array(" + ", ".join(f"named_struct('label', '{label}', 'words', {sql_strings(text.split())}, 'phrases', {sql_strings(map(_padded, phrases))})" for label, text, phrases in templates) + ")")

    def passage(h: Column) -> Column:
        n = F.size(F.get(table, h["t"])["words"])
        # from a negative position the passage begins before the file does
        return F.slice(F.col("_w"), F.greatest(h["at"], F.lit(0)) + 1, n + F.least(h["at"], F.lit(0)))

    def verified(h: Column) -> Column:
        t = F.get(table, h["t"])
        return F.struct(t["label"].alias("label"), F.forall(t["phrases"], lambda f: F.contains(F.concat(F.lit(" "), F.array_join(passage(h), "  "), F.lit(" ")), f)).alias("ok"),
                        (F.size(F.filter(F.transform(t["words"], lambda w, i: F.get(F.col("_w"), h["at"] + i) == w), lambda same: same)) / F.size(t["words"])).alias("share"))

    out = out.withColumn("_seen", F.when(F.col("_gate"), F.filter(F.transform(aligned, verified), lambda v: v["ok"])))
    own_labels = F.coalesce(F.transform(F.col("_seen"), lambda v: v["label"]), F.array().cast("array<string>"))
    best = F.coalesce(F.array_max(F.transform(F.col("_seen"), lambda v: v["share"])), F.lit(0.0))
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("_base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(F.col("_base"), own_labels)), ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(best).alias("score"),
    )
