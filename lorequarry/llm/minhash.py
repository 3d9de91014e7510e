"""MinHash near-duplicates from bottom-k sketches of one hash function.

A document's set holds the 64-bit hashes of its distinct word shingles; its sketch the
``SKETCH`` least of them. Two documents are linked if the Jaccard similarity of their full
sets is at least ``percent`` (51 to 100); the result is each document's connected component.

1. Documents with equal sets become one class, which one of its rows represents.
2. Inverted lists: each retained value lists its classes, by bands of set sizes. Two linked
   sets share at least ``shared_values(percent)`` of ``SKETCH`` values (all but about four pairs
   in 10^6; all pairs where sets are small enough to be kept whole), so with values ordered from
   rare to common, a class need only enter the lists of its rarest ones, as many as make sure
   that a linked class meets it in one. Only ids and places in the sketch are exchanged for this.
3. A list is not expanded to pairs. Its centre (the class with the most popular values) is
   compared with each member, in ``rounds`` rounds: what is within the threshold of the
   centre leaves the list; what else the estimate let pass stays as measured by it. Of what is left, two
   members that one centre has measured don't meet in the list; others are paired under the size
   bound and a count of shared values, unless the links found so far connect them already.
4. Members that one centre has measured and nothing connects yet are still owed their links to one
   another. At least one of two is beyond the threshold of the centre, and by how far symmetric
   differences to the centre must overlap, they share one of the rarest half of the other's
   differences; an index of differences finds them, so a large family of near copies costs its
   edits, not its square.
5. The estimate from the union of two sketches discards hopeless pairs before texts are
   fetched; every link is confirmed on full sets.

Sketches and texts of what is compared are looked up by sending the wanted ids to the scan while
they are at most ``storage.SENT_ROWS``; beyond it both sides are exchanged. Components come from
large-star and small-star rounds over links, written between rounds.

Defined results: null or empty texts have no shingles and are linked with nothing (their
component is their own id); a text of fewer words than a shingle is one shingle; repeated
rows are returned each, in one component; rows of one id with different texts are judged each by
its own text; rows without id get no links and a null component; other input columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import comb, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.components import components
from .common import lean, materialize, release, sent, small_batches
from .words import WordHashes, grams, slices

SKETCH = 64
MISSED = 5e-6
ROUNDS = 2
MEASURED = 0.3  # from this similarity on, a compared pair's differences are kept: lower, and lists leave less; higher, and the index of differences holds less
BANDS = 4  # a band of sizes spans this many times the ratio within which sizes of linked sets lie


@cache
def shared_values(percent: int) -> int:
    """How many of SKETCH values two linked sets share but for a chance of MISSED."""
    p, tail = percent / 100, 0.0
    for t in range(SKETCH + 1):
        tail += comb(SKETCH, t) * p**t * (1 - p) ** (SKETCH - t)
        if tail > MISSED:
            return t
    return SKETCH


def shingle_set(text: bytes | None, k: int, cache: WordHashes) -> np.ndarray:
    """Sorted distinct hashes. Words are runs of other bytes than ASCII white space, A-Z lower-cased."""
    h = cache.of((text or b"").lower().split())
    return np.unique(grams(h, min(k, len(h)))) if len(h) else h


def sketches(docs: DataFrame, k: int) -> DataFrame:
    """rid (of the row), doc_id, h (hash of the text), n (set size), ka, kb (hash of the set), sketch."""

    @lean
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in slices(batches):
            n, ka, kb, sk = [], [], [], []
            for text in batch["text"]:
                s = shingle_set(text.as_py(), k, cache)
                key = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64)
                n.append(len(s))
                ka.append(key[0])
                kb.append(key[1])
                sk.append(s[:SKETCH].view(np.int64))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["h"], pa.array(n, pa.int64()), pa.array(ka, pa.int64()), pa.array(kb, pa.int64()), pa.array(sk, pa.list_(pa.int64()))], ["doc_id", "h", "n", "ka", "kb", "sketch"])

    rows = docs.select("doc_id", "h", "text").mapInArrow(cut, "doc_id long, h long, n long, ka long, kb long, sketch array<bigint>")
    return rows.withColumn("rid", F.monotonically_increasing_id())


def reach(percent: int) -> float:
    """Two members within the threshold of one another, one of them also of a centre: the other is at least so near to it."""
    return max(0.0, 2 * percent - 100) / 100


def band_of(n: Column, percent: int) -> tuple[Column, Column]:
    """(a size's band, whether linked sets may be in the next)."""
    u = F.ln(n.cast("double")) / log(100 / percent) if percent < 100 else n.cast("double") * BANDS
    band = F.floor(u / BANDS)
    return band, (u + 1 + 1e-9 >= (band + 1) * BANDS) if percent < 100 else F.lit(False)


def listed(value: Column, band: Column) -> Column:
    return F.xxhash64(value, band)


def inverted_lists(classes: DataFrame, percent: int) -> DataFrame:
    """rep, n, home, pop (how popular its values are), vs: the lists that a class enters. A class is listed
    in its own band of sizes (home) and, if linked ones may be there, in the next."""
    band, over = band_of(F.col("n"), percent)
    banded = classes.select("rep", "sketch", F.explode(F.when(over, F.array(band * 2 + 1, band * 2 + 2)).otherwise(F.array(band * 2 + 1))).alias("at"))
    at_band, home = F.shiftright("at", 1), F.col("at") % 2  # odd: in its own band
    posts = banded.select("rep", at_band.alias("band"), home.alias("home"), F.posexplode("sketch").alias("pos", "value"))
    posts = posts.select("rep", (F.col("pos") * 2 + F.col("home")).cast("int").alias("place"), listed(F.col("value"), F.col("band")).alias("v"))
    df = posts.groupBy("v").agg(F.count("*").alias("df"), F.max(F.col("place") % 2).alias("h")).where("df > 1 and h = 1").select("v", "df")
    # values are ordered by how many classes the band lists under them, then by the values; all of a band agree on it
    mine = posts.join(df, "v").groupBy("rep").agg(F.collect_list(F.col("df") * 256 + F.col("place")).alias("all"))
    mine = mine.join(classes.select("rep", "n"), "rep")
    of = lambda own: F.struct(F.lit(own).alias("home"), F.array_sort(F.filter("all", lambda x: x % 2 == own)).alias("vals"))
    mine = mine.select("rep", "n", F.explode(F.array(of(1), of(0))).alias("o")).select("rep", "n", "o.home", "o.vals")
    size = F.least(F.col("n"), F.lit(SKETCH))
    # a set below this size, and all that it can be linked to, are kept whole
    whole = F.col("n") * 100 <= SKETCH * percent
    shared = F.when(whole, F.ceil(F.col("n") * percent / 100)).otherwise(F.ceil(size * shared_values(percent) / SKETCH))
    alone = size - F.size("vals")  # values that no other class of the band has come first
    first = F.slice("vals", 1, F.greatest(F.lit(0), size - shared + 1 - alone).cast("int"))
    pop = F.aggregate("vals", F.lit(0.0), lambda s, x: s + F.ln(F.shiftright(x, 8).cast("double"))) / size
    heads = mine.select("rep", "n", "home", (pop * 1000).cast("int").alias("pop"), F.transform(first, lambda x: F.shiftright(x % 256, 1).cast("int")).alias("places"))
    heads = materialize(heads.where("size(places) > 0"), "heads")
    band, _ = band_of(F.col("n"), percent)
    full = sent(heads, "rep", classes.select("rep", "sketch"))
    out = full.select("rep", "n", "home", "pop", F.transform("places", lambda p: listed(F.get("sketch", p), band + 1 - F.col("home"))).alias("vs"))
    return release(materialize(out, "listed"), heads)


def estimate(x: Column, y: Column) -> Column:
    """Jaccard similarity estimated from the bottom of the union of two sketches."""
    union = F.slice(F.array_sort(F.array_union(x, y)), 1, SKETCH)
    return F.size(F.array_intersect(F.array_intersect(x, y), union)) / F.size(union)


def verify(pairs: DataFrame, classes: DataFrame, docs: DataFrame, k: int, least: float, differences: bool) -> DataFrame:
    """x, y, inter, nx, ny, diff for pairs that the sketches don't rule out for similarity
    ``least``; diff: the symmetric difference, if asked for and similarity is at least MEASURED or ``least``."""
    pairs = materialize(pairs, "pairs")
    either = lambda df: df.select(F.col("x").alias("rep")).union(df.select("y")).distinct()
    sk = materialize(sent(either(pairs), "rep", classes.select("rep", "sketch")), "pair-sketches")
    margin = 5 * np.sqrt(least * (1 - least) / SKETCH)
    near = pairs.join(sk.toDF("y", "sy"), "y").join(sk.toDF("x", "sx"), "x").where(estimate(F.col("sx"), F.col("sy")) >= least - margin).select("x", "y")
    near = release(materialize(near, "near-pairs"), pairs, sk)
    wanted = materialize(sent(either(near), "rep", classes.select("rep", "doc_id", "h")), "wanted")
    texts = sent(wanted, ["doc_id", "h"], docs).groupBy("rep").agg(F.first("text").alias("text"))
    texts = release(materialize(texts, "texts"), wanted)

    @lean
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, last, b = WordHashes(), None, None
        for batch in slices(batches):
            inter, nx, ny, diff = [], [], [], []
            for y, tx, ty in zip(batch["y"].to_pylist(), batch["tx"], batch["ty"], strict=True):
                if y != last:
                    last, b = y, shingle_set(ty.as_py(), k, cache)
                a = shingle_set(tx.as_py(), k, cache)
                both = np.intersect1d(a, b, assume_unique=True)
                inter.append(len(both))
                nx.append(len(a))
                ny.append(len(b))
                close = differences and len(both) >= min(MEASURED, least) * (len(a) + len(b) - len(both))
                diff.append(np.setxor1d(a, b, assume_unique=True).view(np.int64) if close else None)
            yield pa.RecordBatch.from_arrays([batch["x"], batch["y"], pa.array(inter, pa.int64()), pa.array(nx, pa.int64()), pa.array(ny, pa.int64()), pa.array(diff, pa.list_(pa.int64()))], ["x", "y", "inter", "nx", "ny", "diff"])

    joined = near.join(texts.toDF("x", "tx"), "x").join(texts.toDF("y", "ty"), "y").select("x", "y", "tx", "ty")
    out = materialize(joined.mapInArrow(confirm, "x long, y long, inter long, nx long, ny long, diff array<bigint>"), "verified")
    return release(out, near, texts)


def linked(percent: int) -> Column:
    return 100 * F.col("inter") >= percent * (F.col("nx") + F.col("ny") - F.col("inter"))


def both_orders(seen: DataFrame) -> DataFrame:
    """Compared pairs with their differences; a pair is in ``seen`` in one order only, and either end may be a centre."""
    seen = seen.where(F.col("diff").isNotNull())
    return seen.unionByName(seen.select(F.col("y").alias("x"), F.col("x").alias("y"), "inter", F.col("ny").alias("nx"), F.col("nx").alias("ny"), "diff"))


def difference_lists(members: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(y, near, a, ca, na, da_n, edge, i, e: the rarest differences of each member, as many as any link to the fringe of
    its centre needs; y, near, b, cb, nb, db_n, j, e: those of the fringe that members linked with the centre (near) or
    others need). i and j are places in the order from rare to common (by how many of the centre's members have a
    difference, then by its hash) that all members of a centre share; differences of one member only come first."""
    some = members.groupBy("y").agg(F.max("edge").alias("any"), F.count("*").alias("m")).where("any and m > 1").select("y")
    members = members.join(some, "y", "left_semi")
    flat = members.select("y", "a", F.explode("da").alias("e")).withColumn("df", F.count("*").over(Window.partitionBy("y", "e")))
    shared = flat.where("df > 1").groupBy("y", "a").agg(F.array_sort(F.collect_list(F.struct("df", "e"))).alias("es"))
    found = members.withColumn("da_n", F.size("da")).drop("da").join(shared, ["y", "a"])
    found = found.withColumn("free", F.col("da_n") - F.size("es"))  # differences of no other member
    # differences that the other may lack, if neither is linked with the centre, doubled: |a'|, and more if a is larger than the centre
    lacking = F.col("da_n") * (100 + percent) + F.greatest(F.lit(0), F.col("na") - F.col("nc")) * (100 - percent)
    # and never more than sets of a link differ by: |a| * (100 - p) / p
    first = F.least(F.floor(lacking / (2 * (100 + percent))), F.floor(F.col("na") * (100 - percent) / percent)) + 1
    found = found.withColumn("take", F.greatest(F.lit(0), first - F.col("free")).cast("int"))
    place = (F.col("free") + F.col("at")).alias
    keys = found.select("y", "near", "a", "ca", "na", "da_n", "edge", "free", F.posexplode(F.slice("es", F.lit(1), F.col("take"))).alias("at", "s"))
    # what is linked with the centre can be linked only with what is within reach of it; others share one of the rarest half of either
    within = 100 * F.col("inter") >= max(0, 2 * percent - 100) * (F.col("na") + F.col("nc") - F.col("inter"))
    part = lambda near, n: F.struct(F.lit(near).alias("near"), n.cast("int").alias("take"))
    parts = F.filter(F.array(part(True, F.when(within, F.size("es")).otherwise(0)), part(False, F.col("take"))), lambda x: x["take"] > 0)
    entries = found.where("edge").withColumn("t", F.explode(parts))
    entries = entries.select("y", "t.near", F.col("a").alias("b"), F.col("ca").alias("cb"), F.col("na").alias("nb"), F.col("da_n").alias("db_n"), "free", F.posexplode(F.slice("es", F.lit(1), F.col("t.take"))).alias("at", "s"))
    return keys.select("y", "near", "a", "ca", "na", "da_n", "edge", place("i"), "s.e"), entries.select("y", "near", "b", "cb", "nb", "db_n", place("j"), "s.e")


def by_differences(seen: DataFrame, percent: int, joined: DataFrame | None = None, hubs: DataFrame | None = None) -> DataFrame:
    """Links of members at the fringe of a centre to any other of its members, but for pairs that ``joined``
    (id, component) connects already; ``hubs`` (id): the centres, if not all that others were compared with. With d
    the symmetric difference and s the sum of sizes, similarity p/100 means d * (100 + p) <= s * (100 - p);
    d(a, b) = |a'| + |b'| - 2 |a' n b'| for differences a', b' to the centre, and |b'| alone
    exceeds (|b| + |c|) * (100 - p) / (100 + p) for the centre c, so a' n b' holds more than half
    of |a'| - (|a| - |c|) * (100 - p) / (100 + p). Where a and b meet, their sizes and what is left of a' and b'
    from there on must allow for a link. If a isn't linked with c either, the same holds the other way round, and a
    and b meet in the rarest half of both; if it is, b must be within reach of c."""
    seen = both_orders(seen)
    if hubs is not None:
        seen = seen.join(hubs.toDF("y"), "y", "left_semi")
    if joined is not None:
        seen = seen.join(joined.toDF("y", "_cy"), "y", "left").join(joined.toDF("x", "_cx"), "x", "left")
        seen = materialize(seen.withColumns({"_cy": F.coalesce("_cy", "y"), "_cx": F.coalesce("_cx", "x")}), "members")
    else:
        seen = seen.withColumns({"_cy": F.col("y"), "_cx": F.when(linked(percent), F.col("y")).otherwise(F.col("x"))})
    seen = seen.withColumn("edge", ~linked(percent) & (F.col("_cx") != F.col("_cy")))
    members = seen.select("y", F.col("x").alias("a"), F.col("_cx").alias("ca"), F.col("nx").alias("na"), F.col("ny").alias("nc"), "inter", linked(percent).alias("near"), "edge", F.col("diff").alias("da"))
    fringe = members.where("edge").select("y", F.col("a").alias("b"), F.col("na").alias("nb"), F.col("da").alias("db"))
    keys, entries = difference_lists(members, percent)
    # what a and b have in common must lie from the first common difference on, in both
    twice = 2 * (100 + percent)
    common = (F.col("da_n") + F.col("db_n")) * (100 + percent) - (F.col("na") + F.col("nb")) * (100 - percent)
    room = ((F.col("da_n") - F.col("i")) * twice >= common) & ((F.col("db_n") - F.col("j")) * twice >= common)
    sized = (F.col("na") * percent <= F.col("nb") * 100) & (F.col("nb") * percent <= F.col("na") * 100)
    meet = (keys["y"] == entries["y"]) & (keys["e"] == entries["e"]) & (keys["near"] == entries["near"]) & (F.col("a") != F.col("b")) & (~F.col("edge") | (F.col("a") < F.col("b"))) & (F.col("ca") != F.col("cb")) & sized & room
    pairs = keys.join(entries, meet).select(keys["y"], "a", "b").distinct()
    full = pairs.join(members.select("y", "a", "na", "da"), ["y", "a"]).join(fringe, ["y", "b"])
    d = F.size("da") + F.size("db") - 2 * F.size(F.array_intersect("da", "db"))
    return full.where(d * (100 + percent) <= (F.col("na") + F.col("nb")) * (100 - percent)).select(F.col("a").alias("x"), F.col("b").alias("y"))


def unordered(pairs: DataFrame, known: DataFrame | None) -> DataFrame:
    """x, y: each pair once, in one of its orders, but for those ``known`` in either."""
    ends = [F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi")]
    pairs = pairs.groupBy(*ends).agg(F.min(F.struct("x", "y")).alias("p"))
    if known is not None:
        pairs = pairs.join(known.select(*ends), ["lo", "hi"], "left_anti")
    return pairs.select("p.x", "p.y")


def unmeasured(lists: DataFrame, rounds: int) -> tuple[DataFrame, DataFrame]:
    """The rows of ``lists`` as either side of the pairs that no one centre has measured both of: the pairs of
    rows with equal v and meet. met: a bit for each round's centre of the list that has measured the row."""
    others = F.filter(F.sequence(F.lit(0), F.lit((1 << rounds) - 1)), lambda x: x.bitwiseAND(F.col("met")) == 0)
    return lists.withColumn("meet", F.col("met")), lists.withColumn("meet", F.explode(others))


def links(docs: DataFrame, classes: DataFrame, k: int, percent: int, rounds: int = ROUNDS) -> DataFrame:
    """x, y: links between classes that give the components of all links."""
    heads = inverted_lists(classes, percent)
    lists = heads.select("rep", "n", "pop", "home", F.explode("vs").alias("v"))
    several = lambda df: df.groupBy("v").agg(F.count("*").alias("m"), F.max("home").alias("h")).where("m > 1 and h = 1").select("v")
    lists = materialize(lists.join(several(lists), "v").withColumn("met", F.lit(0)), "lists")
    out_of_reach = reach(percent)
    low = lambda v: F.shiftright(F.shiftleft(v, 32), 32).cast("int")
    seen = hubs = None
    for turn in range(rounds):
        centres = lists.groupBy("v").agg(F.max(F.struct("pop", (-F.col("rep")).alias("r"), "n")).alias("c"), F.count("*").alias("m"), F.max("home").alias("h"))
        centres = centres.where("m > 1 and h = 1").select("v", (-F.col("c.r")).alias("c"), F.col("c.n").alias("nc"))
        now = materialize(centres.select(F.col("c").alias("id")).distinct(), "hubs")
        hubs = now if hubs is None else hubs.unionByName(now).distinct()
        members = lists.join(centres, "v").where("rep <> c")
        pairs = members.where(F.least("n", "nc") >= out_of_reach * F.greatest("n", "nc")).select(F.col("rep").alias("x"), F.col("c").alias("y"))
        new = verify(unordered(pairs, seen), classes, docs, k, out_of_reach, True)
        seen = new if seen is None else seen.unionByName(new)
        state = seen.select(F.col("x").alias("rep"), F.col("y").alias("c"), linked(percent).alias("near"), F.col("diff").isNotNull().alias("measured"))
        state = state.unionByName(state.select(F.col("c").alias("rep"), F.col("rep").alias("c"), "near", "measured"))
        stay = members.join(state, ["rep", "c"], "left").where("near is null or not near")
        stay = stay.withColumn("met", F.col("met") + F.when(F.col("measured"), 1 << turn).otherwise(0))
        lists = release(materialize(stay.select(*lists.columns), "lists"), lists)
    ball = materialize(seen.where(linked(percent)).select("x", "y"), "ball")
    joined = materialize(components(ball), "joined")
    # of what is left, each pair that nothing connects yet, once: in the list of the least value that both are listed under;
    # members that one centre has measured are left to the index of differences
    own = heads.select("rep", "home", F.transform("vs", low).alias("keys"))
    left = lists.join(several(lists), "v").select("v", "rep", "n", "home", "met")
    left = left.join(left.groupBy("v").agg(F.expr("bit_and(met)").alias("all")).where("all = 0").select("v"), "v")
    left_rows = left = release(materialize(left.join(joined.toDF("rep", "c"), "rep", "left").withColumn("c", F.coalesce("c", "rep")), "left"), lists)
    ids = left.select("rep").distinct()
    measured = both_orders(seen).select(F.col("x").alias("rep"), F.col("y").alias("id")).join(hubs, "id", "left_semi")
    centres = sent(ids, "rep", measured.select("rep", F.col("id").alias("y"))).groupBy("rep").agg(F.collect_set("y").alias("of"))
    short = sent(ids, "rep", classes.select("rep", F.transform("sketch", low).alias("short")))
    left = left.join(own, ["rep", "home"]).join(short, "rep").join(centres, "rep", "left")
    left = left.withColumn("of", F.array_union(F.coalesce("of", F.array().cast("array<bigint>")), F.array("rep")))
    left = release(materialize(left, "leftover"), left_rows)
    a, b = (side_of.select("v", "meet", *[F.col(c).alias(f"{c}_{side}") for c in left.columns if c != "v"]) for side_of, side in zip(unmeasured(left, rounds), "ab", strict=True))
    sized = (F.col("n_a") * percent <= F.col("n_b") * 100) & (F.col("n_b") * percent <= F.col("n_a") * 100)
    once = (F.col("home_a") + F.col("home_b") > 0) & (F.array_min(F.array_intersect("keys_a", "keys_b")) == low(a["v"]))
    enough = F.size(F.array_intersect("short_a", "short_b")) >= F.ceil(F.least("n_a", "n_b", F.lit(SKETCH)) * shared_values(percent) / SKETCH)
    rest = a.join(b, (a["v"] == b["v"]) & (a["meet"] == b["meet"]) & (F.col("rep_a") < F.col("rep_b")) & (F.col("c_a") != F.col("c_b")) & sized & once & enough & ~F.arrays_overlap("of_a", "of_b"))
    rest = unordered(rest.select(F.col("rep_a").alias("x"), F.col("rep_b").alias("y")), seen)
    late = verify(rest, classes, docs, k, percent / 100, False).where(linked(percent)).select("x", "y")
    return ball.unionByName(late).unionByName(by_differences(seen, percent, joined, hubs))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept, text_hash (xxhash64 of the text)."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).withColumn("h", F.xxhash64("text"))
    small_batches(docs.sparkSession)
    rows = materialize(sketches(docs, k), "sketches")
    own = rows.where("n > 0 and doc_id is not null")
    groups = own.groupBy("ka", "kb", "n").agg(F.min(F.struct("doc_id", "rid")).alias("first"), F.count("*").alias("members"))
    groups = materialize(groups.select("ka", "kb", "n", F.col("first.rid").alias("rep"), F.col("first.doc_id").alias("least"), "members"), "groups")
    copies = sent(groups.where("members > 1").select("ka", "kb", "n", "rep"), ["ka", "kb", "n"], own.select("rid", "ka", "kb", "n"))
    copies = materialize(copies.where("rid <> rep").select(F.col("rid").alias("rep")), "copies")
    classes = sent(copies, "rep", own.select(F.col("rid").alias("rep"), "doc_id", "h", "n", "sketch"), "left_anti")
    joined = materialize(components(links(docs, classes, k, percent)), "joined")
    joined = joined.unionByName(joined.select(F.col("component").alias("id"), "component").distinct())
    named = groups.join(joined, groups["rep"] == joined["id"], "left").where("id is not null or members > 1")
    named = materialize(named.select("ka", "kb", "n", "least", F.coalesce("component", "rep").alias("component")), "named")
    least = named.groupBy("component").agg(F.min("least").alias("_c"))
    named = materialize(named.join(least, "component").select("ka", "kb", "n", "_c"), "classes")
    # only sets that recur or are linked are looked up
    out = sent(named, ["ka", "kb", "n"], rows.select("doc_id", "h", "n", "ka", "kb"), "left")
    comp = F.when(F.col("doc_id").isNotNull(), F.coalesce("_c", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), comp.alias("component_id"), (F.col("doc_id") == comp).alias("kept"), F.col("h").alias("text_hash"))
