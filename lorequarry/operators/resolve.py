"""Entity resolution and the graph's relations.

Mentions are folded to entities in input order: a name seen before (or an alias of one) is
the same entity, a name within 92 of a known one joins it unless known types differ, one
within 85 is put to review. The fold is sequential by nature, but names interact only if
they are similar or share an alias, so it runs once per connected component of those links.

Input ``mentions``: ord, pos (order), name, entity_type, aliases (array), meta (struct of
chunk_id, doc_id, source_reliability, page_number). Null types count as unknown, null alias
lists as empty; mentions without a name are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names, text, vocab
from ..storage import materialize
from .components import components


@dataclass
class Resolved:
    entities: DataFrame  # canonical_name, entity_type, aliases, ord, pos
    canonical: DataFrame  # norm, canonical
    review: DataFrame  # entity_a, entity_b, similarity, type_a, type_b, ord, pos
    mentions: DataFrame  # canonical_name, ord, pos, meta


def mentions_of(extractions: DataFrame) -> DataFrame:
    """extractions: ord, entities, chunk_meta."""
    flat = extractions.select("ord", F.posexplode("entities").alias("pos", "e"), F.col("chunk_meta").alias("meta"))
    return flat.select("ord", "pos", "e.name", "e.entity_type", "e.aliases", "meta")


def similar_names(distinct: DataFrame, least: int = vocab.REVIEW_AT) -> DataFrame:
    """a, b, ratio: pairs of the names in column ``norm`` with an Indel ratio of at least ``least``.

    A pair so near has D <= (1 - (least - .5) / 100) * (both lengths) insertions and deletions, and
    each spoils at most two bigrams of a name, so if a pair has a bigram in common, it has one among
    the 2 D + 1 rarest of either, and a name need only be listed under those; lengths and the ratio
    itself decide the rest. Without a common bigram, two neighbours in the common subsequence (of
    length L) are apart in one of the names, so 3 L <= both lengths + 1; as 200 L is at least
    (least - .5) * both lengths, only short names can be so near (none from 85 on; all below 68,
    and that costs a comparison of all pairs). Those pairs are compared one by one."""
    share = 1 - (least - 0.5) / 100
    n = F.length("norm")
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring("norm", i, 2)))
    posts = distinct.where("norm <> ''").select("norm", F.explode(grams).alias("g"))
    df = posts.groupBy("g").agg(F.count("*").alias("df")).where("df > 1")
    ranked = posts.join(df, "g").groupBy("norm").agg(F.array_sort(F.collect_list(F.struct("df", "g"))).alias("gs"))
    # a partner has at most length * least / (200 - least) characters, and D follows from both
    edits = F.ceil(share * n * (1 + (1 + share) / (1 - share)))
    alone = F.size(grams) - F.size("gs")
    kept = F.slice("gs", 1, F.greatest(F.lit(0), 2 * edits + 1 - alone).cast("int"))
    keys = ranked.select("norm", n.alias("n"), F.explode(F.transform(kept, lambda s: s["g"])).alias("g"))
    a, b = keys.toDF("a", "na", "g"), keys.toDF("b", "nb", "g")
    pairs = a.join(b, "g").where((F.col("a") < F.col("b")) & (F.abs(F.col("na") - F.col("nb")) <= share * (F.col("na") + F.col("nb")))).select("a", "b").distinct()
    excess = 3 * (least - 0.5) / 200 - 1
    if excess * 4 <= 1:  # together two different names have 4 characters at least, but for 'a' and 'ab' (67)
        named = distinct.where("norm <> ''").select("norm", n.alias("n"), grams.alias("gs"))
        a, b = named.toDF("a", "na", "ga"), named.toDF("b", "nb", "gb")
        both = F.col("na") + F.col("nb")
        apart = (F.col("a") < F.col("b")) & (F.abs(F.col("na") - F.col("nb")) <= share * both) & (excess * both <= 1) & ~F.arrays_overlap("ga", "gb")
        pairs = pairs.unionByName(a.join(b, apart).select("a", "b").distinct())

    @F.arrow_udf("int")
    def ratio(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for x, y in batches:
            yield pa.array([names.indel_ratio(p, q) for p, q in zip(x.to_pylist(), y.to_pylist(), strict=True)], pa.int32())

    return pairs.withColumn("ratio", ratio("a", "b")).where(F.col("ratio") >= least)


def fold(rows: Iterator[tuple]) -> tuple[dict, dict, list]:
    """One pass over (ord, pos, name, type, aliases): entities {canonical: [type, aliases, ord, pos]},
    {norm: canonical}, and what is to be reviewed."""
    entities: dict[str, list] = {}
    known: dict[str, str] = {}
    review: list[tuple] = []
    for order, pos, name, kind, aliases in rows:
        key = names.norm(name)
        home, score = known.get(key), 100
        if home is None:
            score = 0
            for other in entities:
                r = names.indel_ratio(key, names.norm(other))
                if r > score:
                    home, score = other, r
        seen = key in known
        have = entities[home][0] if home is not None else None
        clash = home is not None and vocab.UNKNOWN not in (have, kind) and have != kind
        if score >= vocab.REVIEW_AT and (clash if score >= vocab.MERGE_AT else True):
            review.append((home, name, score / 100, have, kind, order, pos))
        if seen or (score >= vocab.MERGE_AT and not clash):
            own = entities[home]
            if have == vocab.UNKNOWN:
                own[0] = kind
            own[1] |= {*aliases, name}
        else:
            home = name
            entities[name] = [kind, set(aliases), order, pos]
        if not seen:
            for a in (key, *map(names.norm, aliases)):
                known.setdefault(a, home)
    return entities, known, review


OUT = "what string, a string, b string, similarity double, type_a string, type_b string, aliases array<string>, ord long, pos int"


def resolve(mentions: DataFrame) -> Resolved:
    clean = mentions.where("name is not null").select(
        F.col("ord").cast("long").alias("ord"), F.col("pos").cast("int").alias("pos"), "name", F.coalesce("entity_type", F.lit(vocab.UNKNOWN)).alias("entity_type"),
        F.filter(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: a.isNotNull()).alias("aliases"), "meta", text.norm(F.col("name")).alias("norm"),
    )
    clean = materialize(clean, "mentions")
    aliased = clean.select(F.col("norm").alias("x"), F.explode("aliases").alias("alias")).select("x", text.norm(F.col("alias")).alias("y")).distinct()
    distinct = clean.select("norm").distinct()
    near = similar_names(distinct).select(F.col("a").alias("x"), F.col("b").alias("y"))
    groups = components(near.unionByName(aliased))
    placed = clean.join(groups, clean["norm"] == groups["id"], "left").withColumn("group", F.coalesce("component", "norm"))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["ord", "pos"], kind="stable")
        entities, known, review = fold(zip(group["ord"], group["pos"], group["name"], group["entity_type"], group["aliases"], strict=True))
        out = [("entity", n, None, None, k, None, sorted(al), o, p) for n, (k, al, o, p) in entities.items()]
        out += [("map", n, c, None, None, None, None, None, None) for n, c in known.items()]
        out += [("review", a, b, s, ta, tb, None, o, p) for a, b, s, ta, tb, o, p in review]
        frame = pd.DataFrame(out, columns=["what", "a", "b", "similarity", "type_a", "type_b", "aliases", "ord", "pos"])
        return frame.astype({"ord": "Int64", "pos": "Int32"})

    folded = materialize(placed.select("group", "ord", "pos", "name", "entity_type", "aliases").groupBy("group").applyInPandas(run, OUT), "folded")
    canonical = folded.where("what = 'map'").select(F.col("a").alias("norm"), F.col("b").alias("canonical"))
    return Resolved(
        folded.where("what = 'entity'").select(F.col("a").alias("canonical_name"), F.col("type_a").alias("entity_type"), "aliases", "ord", "pos"),
        canonical,
        folded.where("what = 'review'").select(F.col("a").alias("entity_a"), F.col("b").alias("entity_b"), "similarity", "type_a", "type_b", "ord", "pos"),
        clean.join(canonical, "norm").select(F.col("canonical").alias("canonical_name"), "ord", "pos", "meta"),
    )
