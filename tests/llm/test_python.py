"""Quality, near duplicates, decontamination, WARC, toxicity and packing against brute force."""

import hashlib
import json
import random
import sys
import types
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lorequarry.llm import common, decontam, minhash, packing, quality, queries, toxicity, warc
from lorequarry.llm.words import WordHashes

from .cases import docs, prose, rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute_components(data, k, percent):
    sets = [(d, shingles(t, k)) for d, t in data if d is not None]
    up = {d: d for d, _ in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((find(a), find(b)))
                up[q] = p
    return {d: find(d) for d, _ in sets}, {d: len(s) for d, s in sets}


def check_components(got, data, k, percent):
    comp, size = brute_components(data, k, percent)
    assert len(got) == len(data)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None
            continue
        assert r["component_id"] == comp[r["doc_id"]], r
        assert r["n_shingles"] == size[r["doc_id"]] and r["kept"] == (r["doc_id"] == r["component_id"])


@pytest.mark.parametrize(("k", "percent", "sent"), [(2, 80, True), (5, 80, False), (2, 65, True), (2, 100, True)])
def test_near_duplicates(spark, monkeypatch, k, percent, sent):
    if not sent:  # both sides of the look-ups are exchanged
        monkeypatch.setattr("lorequarry.storage.SENT_ROWS", -1)
    check_components(minhash.near_duplicates(docs(spark), k, percent).collect(), rows(), k, percent)


def test_rows_of_one_id_are_judged_by_their_own_text(spark):
    data = [(1, prose(1, 60)), (1, prose(2, 60)), (2, prose(2, 60)), (0, prose(1, 60)), (3, prose(3, 60)), (3, prose(3, 60))]
    got = sorted((r["doc_id"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs(spark, data)).collect())
    assert got == [(0, 0, True), (1, 0, False), (1, 1, True), (2, 1, False), (3, 3, True), (3, 3, True)]


def test_values_that_linked_sets_share():
    assert minhash.shared_values(80) == 36
    r, missed = random.Random(3), 0
    for _ in range(2000):
        both, one, two = (set(r.random() for _ in range(n)) for n in (400, 50, 50))
        missed += len(set(sorted(both | one)[:64]) & set(sorted(both | two)[:64])) < 36
    assert missed == 0


def test_sizes_of_linked_sets_share_a_band(spark):
    rows_ = spark.createDataFrame([(n,) for n in range(1, 4000)], "n long")
    band, over = minhash.band_of(F.col("n"), 80)
    at = {r["n"]: {r["b"]} | ({r["b"] + 1} if r["o"] else set()) for r in rows_.select("n", band.alias("b"), over.alias("o")).collect()}
    assert all(at[n] & {min(at[m])} for n in range(1, 3000) for m in {n, n * 5 // 4, min(n * 5 // 4, n + 1)})


def test_near_copy_family_with_fringe(spark):
    """A large family of near copies at all distances, whose links partly avoid the centre."""
    r = random.Random(4)
    base = prose(500, 150).split()
    data = [(0, " ".join(base))]
    for i in range(1, 90):
        words = list(base)
        for _ in range(r.choice([1, 3, 5, 8, 10, 14])):
            words[r.randrange(len(words))] = f"w{r.randrange(10**6)}"
        data.append((i, " ".join(words)))
        if i % 6 == 0:  # close to this copy, not to the base
            for _ in range(4):
                words[r.randrange(len(words))] = f"w{r.randrange(10**6)}"
            data.append((1000 + i, " ".join(words)))
    data += [(2000 + i, f"common phrase here and {prose(600 + i, 12)}") for i in range(40)]
    check_components(minhash.near_duplicates(docs(spark, data), 2, 80).collect(), data, 2, 80)


def seen_rows(sets, pairs):
    """What verify() returns for the pairs (x, y)."""
    return [(x, y, len(sets[x] & sets[y]), len(sets[x]), len(sets[y]), sorted(sets[x] ^ sets[y])) for x, y in pairs]


def similar(a, b):
    return len(a & b) / len(a | b)


def check_owed(spark, families, percent=80):
    """All links of near members to fringe members are found, and nothing else, in whatever order a pair was seen."""
    r = random.Random(11)
    data, sets, owed = [], {}, set()
    for family in families:
        at = len(sets)
        own = dict(enumerate(family, at))
        sets |= own
        data += seen_rows(sets, [(at, m) if r.random() < 0.5 else (m, at) for m in own if m != at and similar(sets[at], sets[m]) >= minhash.reach(percent)])
        near = [m for m in own if m != at and 100 * similar(sets[at], sets[m]) >= percent]
        fringe = [m for m in own if minhash.reach(percent) <= similar(sets[at], sets[m]) < percent / 100]
        owed |= {(a, b) for a in near for b in fringe if 100 * similar(sets[a], sets[b]) >= percent}
    seen = spark.createDataFrame(data, "x long, y long, inter long, nx long, ny long, diff array<bigint>")
    got = {(row["x"], row["y"]) for row in minhash.by_differences(seen, percent).collect()}
    assert owed and owed <= got
    assert all(100 * similar(sets[a], sets[b]) >= percent for a, b in got)


def test_links_are_owed_in_either_order(spark):
    r = random.Random(5)
    families = []
    for _ in range(60):
        likely = r.sample(range(90), 14)  # copies are changed in much the same places
        family = [set(range(90))]
        for i in range(14):
            new = set(r.sample(likely, r.randrange(7, 11) if i % 2 else r.randrange(11, 15)))
            family.append({v + 1000 if v in new else v for v in range(90)})
        families.append(family)
    check_owed(spark, families)


def test_links_are_owed_whatever_the_sizes(spark):
    c = set(range(100))
    a = c | set(range(200, 225))
    b = set(range(11, 100)) | set(range(200, 212))
    check_owed(spark, [[c, a, b]])  # a is larger than the centre, and b' lacks more than half of a'
    r = random.Random(6)
    families = []
    for _ in range(80):
        more = list(range(200, 230))
        family = [set(c)]
        for i in range(14):
            gone, come = r.sample(sorted(c), r.randrange(0, 16)), r.sample(more, r.randrange(0, 26))
            family.append(c - set(gone) | set(come))
        families.append(family)
    check_owed(spark, families)


def test_fringe_members_find_one_another_from_afar(spark):
    """Links of members that are both far from their centre, below its reach too."""
    r = random.Random(8)
    data, sets, owed = [], {}, set()
    for _ in range(40):
        at, c = len(sets), set(range(100))
        family = [c]
        for _ in range(5):
            gone, come = r.sample(range(100), r.randrange(12, 45)), r.sample(range(200, 300), r.randrange(0, 40))
            one = c - set(gone) | set(come)
            family += [one, one - set(r.sample(sorted(one), r.randrange(0, 10))) | set(r.sample(range(300, 400), r.randrange(0, 10)))]
        own = dict(enumerate(family, at))
        sets |= own
        data += seen_rows(sets, [(at, m) if r.random() < 0.5 else (m, at) for m in own if m != at])
        fringe = [m for m in own if m != at and 100 * similar(sets[at], sets[m]) < 80]
        owed |= {(min(a, b), max(a, b)) for a in own for b in fringe if at != a != b and 100 * similar(sets[a], sets[b]) >= 80}
    seen = spark.createDataFrame(data, "x long, y long, inter long, nx long, ny long, diff array<bigint>")
    got = {tuple(sorted(row)) for row in minhash.by_differences(seen, 80).collect()}
    assert len(owed) > 100 and got == owed


def test_family_of_distant_copies_is_not_paired(spark, monkeypatch):
    """Copies that no link joins are compared with centres, not each with each other."""
    r = random.Random(9)
    base = [f"b{i}" for i in range(150)]
    data = [(0, " ".join(base))]
    for i in range(1, 240):
        words = list(base)
        for at in r.sample(range(150), r.choice([4, 6, 9, 12, 14])):
            words[at] = f"w{i}x{at}"
        data.append((i, " ".join(words)))
    real, compared = minhash.verify, []

    def verify(pairs, *rest):
        compared.append((rest[-1], pairs.count()))
        return real(pairs, *rest)

    monkeypatch.setattr(minhash, "verify", verify)
    check_components(minhash.near_duplicates(docs(spark, data), 5, 80).collect(), data, 5, 80)
    late = [n for differences, n in compared if not differences]
    assert len(late) == 1 and late[0] <= len(data)


def test_pairs_are_compared_in_one_order(spark):
    pairs = spark.createDataFrame([(1, 2), (2, 1), (1, 2), (3, 4), (6, 5), (7, 8)], "x long, y long")
    known = spark.createDataFrame([(4, 3), (7, 8)], "x long, y long")
    assert sorted(map(tuple, minhash.unordered(pairs, known).collect())) == [(1, 2), (6, 5)]


def test_near_duplicates_of_nothing(spark):
    assert minhash.near_duplicates(docs(spark, []), 5, 80).count() == 0
    check_components(minhash.near_duplicates(docs(spark, [(1, None), (2, "")]), 5, 80).collect(), [(1, None), (2, "")], 5, 80)


def items_and_docs():
    items = [(1, prose(900, 40)), (2, prose(901, 12)), (3, "just four short words"), (4, None), (5, ""), (None, prose(902, 30)), (6, prose(900, 40)), (1, prose(900, 40)), (7, "single")]
    a, b = prose(900, 40).split(), prose(901, 12).split()
    data = rows() + [
        (400, prose(3, 50) + " " + " ".join(a[5:15]) + " tail"), (401, " ".join(a[5:14])), (402, "JUST, four-short words. " + " ".join(b).upper()),
        (403, " ".join(a + a)), (404, "x single y"), (405, prose(902, 30)),
    ]
    return items, data


@pytest.mark.parametrize("block", [1_000_000, 20])
def test_decontamination(spark, block):
    items, data = items_and_docs()
    table = spark.createDataFrame([(*i, "clash") for i in items], "item_id long, text string, n_words string")
    got = decontam.mark(docs(spark, data).select("doc_id", "text", "n"), table, block).withColumn("n_hit", decontam.n_hit(F.col("hit_spans"))).collect()
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    cut = lambda t: word.findall((t or "").translate(LOWER))
    windows = defaultdict(set)
    for item, text in items:
        w = cut(text)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            if item is not None:
                windows[tuple(w[i : i + n])].add(item)
    sizes = {len(k) for k in windows}
    text_of = dict(data)
    assert len(got) == len(data)
    for r in got:
        w, hit, found = cut(text_of[r["doc_id"]]), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                own = windows.get(tuple(w[i : i + n]))
                if own:
                    found |= own
                    hit |= set(range(i, i + n))
        assert (r["n_words"], r["n_hit"], r["items"]) == (len(w), len(hit), sorted(found)), r["doc_id"]
    assert decontam.mark(docs(spark, data), table.limit(0)).where("size(items) > 0").count() == 0
    own = docs(spark, data).select("doc_id", "text", "n").withColumns({"_hits": F.lit("mine"), "key": F.lit("mine")})
    pure = decontam.clean(own, table, block)
    assert pure.columns == own.columns
    count = lambda ids: sorted((i is None, i or 0) for i in ids)
    assert count(r["doc_id"] for r in pure.collect()) == count(r["doc_id"] for r in got if not r["items"])
    assert {r["_hits"] for r in decontam.mark(own, table, block).collect()} == {"mine"}


def test_decontamination_blocks_agree(spark):
    """Spans that several blocks hit are united as one block finds them; copies and empty tables come through."""
    items, data = items_and_docs()
    table = spark.createDataFrame(items, "item_id long, text string")
    data += [(500 + i, data[-1][1]) for i in range(5)] + [(None, None), (510, "single " * 30 + prose(900, 40) + " " + prose(901, 12))]
    rows_of = lambda block: sorted(map(str, decontam.mark(docs(spark, data).select("doc_id", "text"), table, block).select("doc_id", "n_words", "hit_spans", "items").collect()))
    assert rows_of(9) == rows_of(1_000_000)
    assert decontam.mark(docs(spark, data).limit(0), table, 20).count() == 0
    assert decontam.clean(docs(spark, data).limit(0), table, 20).count() == 0


def test_winnowing_guarantee():
    shared = [f"s{i}" for i in range(10)]
    cache = WordHashes()
    for seed in range(50):
        a = decontam.winnow(cache.of([w.encode() for w in prose(seed, 9).split() + shared + prose(seed + 1, 7).split()]))
        b = decontam.winnow(cache.of([w.encode() for w in shared]))
        assert set(b.tolist()) & set(a.tolist())


@pytest.mark.parametrize("sent_rows", [0, 1000])
def test_warc_round_trip(spark, sent_rows):
    html = {1: "<p>é" + "x" * 200, 2: "short", 3: "short", 4: None, 5: "", 6: "a\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n" + "y" * 100, 7: "<p>é" + "x" * 200, 8: "a\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n" + "y" * 100, 9: "z" * 100, 10: "z" * 100, 11: "z" * 99, 12: "z" * 99, 13: "HTTP/1.1 200 OK\r\nContent-Length: 7\r\n\r\n" + "q" * 90}
    data = [(k, f"http://h/{k}\r\nX: y" if k == 6 else None if k == 7 else f"http://h/{k}", v, "clash") for k, v in html.items()]
    df = spark.createDataFrame(data, "page_id long, url string, html string, record_type string")
    got = {r["page_id"]: r for r in warc.archive(df, sent_rows=sent_rows).collect()}
    assert len(got) == len(html)
    for k, v in html.items():
        raw = (v or "").encode()
        same = [q for q, x in html.items() if (x or "").encode() == raw]
        again = len(raw) >= 100 and min(same) != k
        r = got[k]
        assert r["payload_bytes"] == len(raw) and r["payload_digest"] == hashlib.sha256(raw).hexdigest()
        assert (r["record_type"], r["refers_to"]) == (("revisit", min(same)) if again else ("response", None))
    assert warc.archive(df.limit(0)).count() == 0
    twice = warc.archive(df.where("page_id = 9").union(df.where("page_id = 9")).union(df.where("page_id = 10"))).collect()
    assert sorted((r["page_id"], r["record_type"]) for r in twice) == [(9, "response"), (9, "response"), (10, "revisit")]
    loose = spark.createDataFrame([(None, "u", "w" * 100), (None, "v", "w" * 100), (3, "x", "w" * 100), (None, "u", "v" * 100), (None, "u", "v" * 100)], "page_id long, url string, html string")
    got = sorted((r["page_id"] or 0, r["record_type"], r["refers_to"]) for r in warc.archive(loose, sent_rows=sent_rows).collect())
    assert got == [(0, "response", None), (0, "response", None), (0, "revisit", 3), (0, "revisit", 3), (3, "response", None)]


def test_warc_payloads_survive(spark):
    """Every byte, whatever line ends, separators and headers payloads begin, end or consist of."""
    r = random.Random(4)
    parts = ["\r", "\n", "\r\n", "\r\n\r\n", "ä", "x" * 50, "WARC/1.1\r\n", "Content-Length: 9", "\0", "HTTP/1.1 200 OK\r\n"]
    html = {i: "".join(r.choice(parts) for _ in range(r.randrange(12))) for i in range(300)} | {300: "y\r\n" * 100_000}
    df = spark.createDataFrame([(k, "u", v) for k, v in html.items()], "page_id long, url string, html string")
    path = warc.fresh_path(spark, "test")
    warc.write(warc.capture(df), path, records_per_file=7)
    back = {x["page_id"]: bytes(x["payload"]).decode() for x in warc.read(spark, path).collect()}
    assert back == html
    heads = {x["page_id"]: (x["payload_bytes"], x["payload_digest"], x["payload"]) for x in warc.read(spark, path, payloads=False).collect()}
    assert heads == {k: (len(v.encode()), hashlib.sha256(v.encode()).hexdigest(), None) for k, v in html.items()}


def test_warc_urls(spark):
    urls = {1: " http://a/ b ", 2: "http://a/\t\x00\x7f\r\nX: y", 3: "  ", 4: "", 5: None, 6: "http://é/漢", 7: "\n"}
    df = spark.createDataFrame([(k, u, "h") for k, u in urls.items()], "page_id long, url string, html string")
    path = warc.fresh_path(spark, "test")
    warc.write(warc.capture(df), path)
    back = {x["page_id"]: x["url"] for x in warc.read(spark, path).collect()}
    assert back == {1: "%20http://a/ b%20", 2: "http://a/%09%00%7F%0D%0AX: y", 3: "%20%20", 4: "", 5: None, 6: "http://é/漢", 7: "%0A"}


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    data = rows() + [(310, "a <|endoftext|> b"), (311, "x" + " " * 9000 + "y")]
    got = packing.pack(docs(spark, data), queries.default_tokenizer(), rows_per_run=2).collect()
    tok = Tokenizer.from_file(queries.default_tokenizer())
    want = defaultdict(list)
    for d, t in data:
        want[d].append([*tok.encode(t or "", add_special_tokens=False).ids, 1])
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(pieces) == set(want)
    for d, ids in want.items():
        own = sorted(pieces[d], key=lambda r: r["start"])
        assert sum(r["length"] for r in own) == sum(map(len, ids))
        for r in own:
            assert r["doc_tokens"] == len(ids[0])
            part = np.array(ids[0][r["start"] : r["start"] + r["length"]], "<u4").tobytes()
            assert r["ids_crc32"] == zlib.crc32(part)
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack(docs(spark, []), queries.default_tokenizer()).count() == 0


@pytest.mark.parametrize("as_text", [False, True])
def test_tokens_equal_those_of_the_tokenizer(as_text):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.default_tokenizer())
    tok.encode_special_tokens = as_text
    own = packing.Encoder(queries.default_tokenizer(), as_text)
    assert own.fast and (as_text or list(own.ids("a <|endoftext|> b")) == [64, 220, 50256, 275])
    r = random.Random(2)
    parts = ["word", "don't", " ", "  ", "\n", "\n\n", "\t", ".", "é", "漢字", "12", "\xa0", "　", "<|endoftext|>", "\x1c", "\r\n", "!?", "'s", "\u200b", "e\u0301", "😀", "\x00"]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(30))) for _ in range(400)]
    texts += ["".join(chr(c) for c in range(i, i + 64) if not 0xD800 <= c < 0xE000) for i in range(0, 0x12000, 64)]
    texts += [" " * n + "x" + "\n" * n for n in (1, packing.LONG_BLANKS - 1, packing.LONG_BLANKS, 40_000)] + ["ab" * 50_000, (" " * (packing.LONG_BLANKS - 1) + ".") * 20]
    for t in texts:
        assert list(own.ids(t)) == tok.encode(t, add_special_tokens=False).ids, repr(t)[:100]


def test_other_vocabularies_go_to_the_tokenizer(tmp_path):
    from tokenizers import Tokenizer

    spec = json.load(open(queries.default_tokenizer()))
    spec["model"]["merges"][5], spec["model"]["merges"][9] = spec["model"]["merges"][9], spec["model"]["merges"][5]
    path = tmp_path / "other.json"
    path.write_text(json.dumps(spec))
    own = packing.Encoder(str(path))
    assert own.fast is None and own.ids("The cat sat") == Tokenizer.from_file(str(path)).encode("The cat sat", add_special_tokens=False).ids


def test_all_pairs_and_triples_are_tried():
    r = random.Random(12)
    for lengths, window in ((range(1, 700), 700), (sorted(r.sample(range(1, 300), 90)), 300), ([5], 15), ([], 10)):
        have, combos = set(lengths), packing.combinations(np.array(lengths, np.int64), window, 1000)
        named = [*lengths, 0]
        got = [tuple(sorted(named[i] for i in c)) for c in combos]
        want = {(0, x, window - x) for x in have if x <= window - x and window - x in have}
        want |= {(x, y, window - x - y) for x in have for y in have if x <= y <= window - x - y and window - x - y in have}
        assert len(got) == len(set(got)) and set(got) == want


def test_plan_wastes_little():
    r = random.Random(1)
    counts = defaultdict(int)
    for _ in range(20_000):
        counts[min(2047, int(r.lognormvariate(5.5, 1.2)) + 1)] += 1
    plan = packing.plan(dict(counts))
    used = defaultdict(int)
    for lengths, times in plan:
        assert sum(lengths) <= 2048
        for n in lengths:
            used[n] += times
    assert used == counts
    total = sum(n * c for n, c in counts.items())
    assert total / (2048 * sum(t for _, t in plan)) > 0.98


def labelled(spark):
    good = [(i, prose(i, 60), 1, 0) for i in range(120)]
    bad = [(1000 + i, " ".join(f"{w.upper()}!!" for w in prose(i, 60).split()), 0, 0) for i in range(60)]
    toxic = [(2000 + i, prose(3000 + i, 30) + " worthless moron " + prose(4000 + i, 20), 1, 1) for i in range(60)]
    all_ = good + bad + toxic
    return docs(spark, [(d, t) for d, t, _, _ in all_]), spark.createDataFrame([(d, q, x, "clash") for d, _, q, x in all_] + [(9999, 1, 1, "no such document"), (5, None, None, "")], "doc_id long, quality int, toxic int, text string"), all_


def test_quality_ranks_held_out_rows(spark):
    d, labels, all_ = labelled(spark)
    keep = quality.remainder("doc_id", 5) != 0
    model = quality.train(d, labels, keep)
    got = {r["doc_id"]: r["score"] for r in quality.score(d.select("doc_id", "text", "score"), model).collect()}
    held = [(got[i], q) for i, _, q, _ in all_ if zlib.crc32(str(i).encode()) % 5 == 0]
    assert min(s for s, q in held if q) > max(s for s, q in held if not q)
    odd = quality.score(docs(spark, [(1, None), (2, ""), (None, "x")]), model).collect()
    assert all(0 <= r["score"] <= 1 for r in odd) and odd[0]["score"] == odd[1]["score"]
    assert {r["score"] for r in quality.score(d, quality.train(d, labels.limit(0), keep)).collect()} == {0.5}


def test_toxicity_on_held_out_rows(spark):
    d, labels, all_ = labelled(spark)
    net = toxicity.train(d, labels, quality.remainder("doc_id", 4) != 2)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(d.select("doc_id", "text"), net).collect()}
    held = [(got[i], x) for i, _, _, x in all_ if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([s >= 0.3 for s, x in held if x]) > 0.8 and np.mean([s < 0.3 for s, x in held if not x]) > 0.8
    odd = toxicity.score(docs(spark, [(1, None), (2, ""), (3, "word " * 20_000 + "worthless moron")]), net).collect()
    assert all(0 <= r["score"] <= 1 for r in odd) and odd[2]["score"] > odd[0]["score"]


def test_long_words_are_read_whole():
    r = random.Random(8)
    for n in (24, 25, 36, 37, 48, 49, 1000):
        word = bytes(r.choice(b"abcdefghijklmnop") for _ in range(n))
        parts = toxicity.tokens(b"one " + word + b" two")[1:-1]
        assert all(len(p) <= toxicity.LONGEST for p in parts)
        assert all(any(word[i : i + 12] in p for p in parts) for i in range(n - 11))
    clean = [" ".join(r.choice(prose(i, 60).split()) for _ in range(40)) for i in range(200)]
    y = np.arange(200) % 2
    net = toxicity.train_net([(f"{t} worthless moron {t}" if x else t).encode() for t, x in zip(clean, y)], y.astype(float))
    ends = clean[1].replace(" ", "_")[:60]
    good, bad = (x.max() for x in toxicity.Scorer(net).logits([f"{ends}_lovely_people_{ends}".encode(), f"{ends}_worthless_moron_{ends}".encode()]))
    assert bad > good + 1


def test_spans_of_half_a_window_stand_whole():
    for n in (0, 1, 17, 31, 32, 33, 48, 49, 200):
        got = [set(w[w >= 0].tolist()) for w in toxicity.windows(np.arange(n, dtype=np.int32))]
        assert set().union(*got) == set(range(n))
        span = toxicity.WINDOW // 2 + 1
        assert all(any(set(range(i, i + span)) <= w for w in got) for i in range(n - span + 1))


def test_scoring_reads_as_training_does(monkeypatch):
    """Scores come from the words of tokens() and the states of run(); each run of bytes is cut once, whatever the texts."""
    r, net = np.random.default_rng(4), toxicity.Net.new(2)
    for k in ("Uf", "Ub", "bf", "bb"):
        net.p[k] += r.standard_normal(net.p[k].shape).astype(np.float32)
    texts = [prose(i, n).encode() for i, n in enumerate([1, 16, 31, 32, 33, 48, 49, 200, 900])] + [b"", b" \n ", b"--- ?! .", b"a" * 25 + b" Tail", "漢字".encode() * 40, b"A a \"a\", (b)"]
    words = [toxicity.tokens(t) for t in texts]
    vocabulary = {w: i for i, w in enumerate(sorted({w for ws in words for w in ws}))}
    g = net.project(net.inputs(list(vocabulary), toxicity.word_slot(list(vocabulary))))
    g = np.concatenate([g, np.zeros_like(g[:1])])
    each = [toxicity.windows(np.array([vocabulary[w] for w in ws], np.int32)) for ws in words]
    expected = [net.run(g, own) for own in each]
    cut, real = [], toxicity.pieces
    monkeypatch.setattr(toxicity, "pieces", lambda w: cut.append(w) or real(w))
    scorer = toxicity.Scorer(net)
    for size in (1, 4, len(texts)):
        got = [x for i in range(0, len(texts), size) for x in scorer.logits(texts[i : i + size])]
        for a, b in zip(got, expected, strict=True):
            np.testing.assert_allclose(a, b, atol=1e-5)
    for (ws, top), own, x, of in zip(scorer.worst(texts), words, expected, each, strict=True):
        at = int(np.argmax(x >= top - 1e-5))
        assert abs(top - x.max()) < 1e-5 and (ws == own[at * toxicity.STRIDE :][: toxicity.WINDOW] or len(of) > 1)
    assert len(cut) == len(set(cut)) == len({w for t in texts for w in t.lower().split()})
    monkeypatch.setattr(toxicity, "CACHE", 3)  # forgetting changes nothing
    for a, b in zip([x for t in texts for x in toxicity.Scorer(net).logits([t])], expected, strict=True):
        np.testing.assert_allclose(a, b, atol=1e-5)


def test_gradients():
    """Backpropagation against differences."""
    net = toxicity.Net.new(3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    r = np.random.default_rng(0)
    x = r.standard_normal((6, 2 * toxicity.WIDTH))
    ids = r.integers(-1, 6, (4, toxicity.WINDOW))
    ids[:, 0] = 1
    loss = lambda: float((net.run(net.project(x), np.where(ids >= 0, ids, -1)) * np.arange(1, 5)).sum())
    _, tape = net.run(net.project(x), ids, keep=True)
    grad, _ = net.back(ids, tape, np.arange(1, 5).astype(float))
    for k in ("Uf", "Ub", "att", "out", "bias"):
        flat = net.p[k].reshape(-1)
        for i in range(0, flat.size, max(1, flat.size // 4)):
            old = flat[i]
            flat[i] = old + 1e-3
            up = loss()
            flat[i] = old - 1e-3
            down = loss()
            flat[i] = old
            assert grad[k].reshape(-1)[i] == pytest.approx((up - down) / 2e-3, rel=0.05, abs=5e-3), k


def test_pipeline_stages(spark, tmp_path):
    d, labels, all_ = labelled(spark)
    extra = [(5000, prose(1, 60)), (5001, prose(950, 40)), (5002, None), (5003, ""), (5003, "")]
    columns = "doc_id long, text string, lang string, source string, n_chars long, kept string, component_id string"
    table = spark.createDataFrame([(i, t, "en", "s", 1, "a", "b") for i, t, _, _ in all_] + [(i, t, "en", "s", 1, "a", "b") for i, t in extra], columns)
    table.write.parquet(f"{tmp_path}/documents.parquet")
    labels.select("doc_id", "quality", "toxic").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, prose(950, 40))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "toxicity", "near_duplicates", "decontamination", "packing"]
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    left = stages["quality"](spark, table, str(tmp_path))
    assert left.columns == table.columns and not ids(left) & set(range(1000, 1060)) and ids(left) >= set(range(100))
    clean = stages["toxicity"](spark, table, str(tmp_path))
    assert len(ids(clean) & set(range(2000, 2060))) < 12 and len(ids(clean) & set(range(120))) > 110
    once = stages["near_duplicates"](spark, table, str(tmp_path))
    assert 5000 not in ids(once) and 1 in ids(once) and once.where("doc_id = 5003").count() == 1 and once.columns == table.columns
    two = table.where("doc_id = 1").unionByName(table.where("doc_id = 2").withColumn("doc_id", F.lit(1).cast("long"))).unionByName(table.where("doc_id = 3").withColumn("doc_id", F.lit(None).cast("long")))
    assert stages["near_duplicates"](spark, two.unionByName(two), str(tmp_path)).groupBy().agg(F.count("*"), F.countDistinct("text")).first()[:] == (4, 3)
    pure = stages["decontamination"](spark, table, str(tmp_path))
    assert ids(table) - ids(pure) == {5001}
    assert ids(stages["packing"](spark, table, str(tmp_path))) == ids(table)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    assert json.dumps(corpus_pipeline.ORACLE_SQL) == "null"


def test_workers_give_back_what_an_operator_kept(spark):
    kept = sys.modules[common.KEPT] = types.ModuleType(common.KEPT)
    seen = list(common.lean(lambda batches: (common.KEPT in sys.modules for _ in batches))(iter([1, 2])))
    assert seen == [False, False] and kept.__name__ == common.KEPT
    parts = spark.createDataFrame([(i, bytearray(np.array([i, 1.0]).tobytes())) for i in range(1100)], "k long, data binary")
    assert common.total(parts).tolist() == [1099 * 550, 1100] and common.total(parts.limit(0)) is None


def test_models_learn_from_all_labelled_rows(spark):
    """Rows beyond the first 20,000, or the first 1,500 toxic and 2,500 clean ones, by the hash of the id."""
    n = 20_600
    d = spark.range(n).select(F.col("id").alias("doc_id"), F.expr("if(id % 3 = 0, concat('BUY!! ', id), concat('some quiet words ', id))").alias("text"))
    labels = d.select("doc_id", F.expr("cast(doc_id % 3 > 0 as int)").alias("quality"))
    model = quality.train(d, labels, F.lit(True))
    own = np.sort([r["score"] for r in quality.score(d, model).select("score").collect()])
    assert model.times.sum() == sum(i % 3 > 0 for i in range(n)) and min(model.good) > 0.5
    assert model.cut == pytest.approx(np.quantile(own, sum(i % 3 == 0 for i in range(n)) / n, method="midpoint"))
    ids = [r["id"] for r in spark.range(4600).orderBy(F.xxhash64("id"), "id").collect()]
    r, rows, toxic = random.Random(2), [], 0
    for i, doc in enumerate(ids):
        y = int(i % 5 < 2)
        toxic += y
        word = "" if not y else "moron" if toxic <= 1500 else "zonkhead"
        rows.append((doc, f"{prose(i, 12)} {word} {prose(r.randrange(9999), 9)}", y))
    net = toxicity.train(spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string"), spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"), F.lit(True))
    fresh = [prose(90_000 + i, 20) for i in range(20)]
    late, none = (toxicity.Scorer(net).scores([f"{t} {w} {t}".encode() for t in fresh]) for w in ("zonkhead", "window"))
    assert late.min() > 0.5 > none.max()
