"""Fingerprints, sharding, URL filters and licence scans against brute force."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash

from lorequarry.llm import fingerprint, license_scan, sharding, urlrep

from .cases import docs, rows


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def sketch(text, k=5, fraction=0.25):
    """Spark's xxhash64 by hand: strings as XXH64 with the running hash as seed."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = [xxhash.xxh64_intdigest(w.encode(), seed=42) for w in words]

    def chain(hs):
        s = 42
        for x in hs:
            s = xxhash.xxh64_intdigest(x.to_bytes(8, "little"), seed=s)
        return s

    runs = [h[i : i + k] for i in range(len(h) - k + 1)] if len(h) >= k else []
    return {signed(chain(r)) for r in runs if signed(chain(r)) < fingerprint.threshold(fraction)}, len(runs) if runs else int(bool(h)), len(h) >= k


def test_fingerprints_match_brute_force(spark):
    data = [r for r in rows() if r[0] not in (307,)]
    got = {r["doc_id"]: r for r in fingerprint.compare_edits(docs(spark, data)).collect()}
    assert len(got) == len(data)
    order = sorted(data, key=lambda r: (r[0] is not None, r[0]))
    for i, (doc, text) in enumerate(order):
        text, other = text or "", order[(i + 1) % len(order)][1] or ""
        cut = len(text) // 4
        edited = text[: len(text) - cut] + other[:cut]
        r = got[doc]
        assert r["n_chars"] == len(text)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        a, n, many = sketch(text)
        b, _, many_b = sketch(edited)
        assert int(r["fingerprint"].split(":")[0]) == n
        if many and many_b and a | b and text.split() != edited.split():
            assert r["near_edited"] == pytest.approx(len(a & b) / len(a | b))
        if text == edited:
            assert r["near_edited"] == 1.0 and r["fingerprint"] == r["edited_fingerprint"]


def test_fingerprint_of_equal_texts_and_parse(spark):
    got = fingerprint.compare_edits(docs(spark)).collect()
    by_text = defaultdict(set)
    text_of = dict(rows())
    for r in got:
        by_text[text_of[r["doc_id"]]].add(r["fingerprint"])
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert all(len(v) == 1 for v in by_text.values())
    df = fingerprint.with_sketch(docs(spark), "text", "p_")
    df = df.select("p_sketch", fingerprint.parse(fingerprint.as_string("p_")).alias("back"))
    for r in df.collect():
        assert [signed(int(x, 16)) for x in r["back"]] == r["p_sketch"]


@pytest.mark.parametrize("n", [0, 1, 2])
def test_fingerprints_of_tiny_tables(spark, n):
    got = fingerprint.compare_edits(docs(spark, rows()[:n])).collect()
    assert len(got) == n
    if n == 1:
        assert got[0]["near_next"] == 1.0


def test_shards_are_gapless_and_even(spark):
    got = sharding.shard(docs(spark), 8, rows_per_run=3).collect()
    data = rows()
    assert Counter(r["doc_id"] for r in got) == Counter(d for d, _ in data)
    text = {d: t or "" for d, t in data}
    sizes, slots = Counter(), defaultdict(list)
    for r in got:
        raw = text[r["doc_id"]].encode()
        assert r["size"] == len(raw) + 1 and r["text_crc32"] == zlib.crc32(raw)
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(slots) <= set(range(8))


def test_shards_of_many_copies(spark):
    # a third of the bytes is one text; shards stay within the tolerance
    data = [(i, "the same text again and again " * 4) for i in range(600)] + [(1000 + i, f"own text {i} " * 12) for i in range(900)]
    got = sharding.shard(docs(spark, data), 16).collect()
    sizes = Counter()
    for r in got:
        sizes[r["shard"]] += r["size"]
    share = sum(sizes.values()) / 16
    assert len(sizes) == 16 and max(abs(s - share) for s in sizes.values()) <= 0.05 * share
    small = sharding.shard(docs(spark, [(1, "a"), (2, None)]), 16).collect()
    assert len(small) == 2
    assert sharding.shard(docs(spark, []), 16).count() == 0


URLS = [
    (1, "http://WWW.Example.com/en/1?x#y"), (2, "https://a.example.com/en/2"), (3, "http://b.com/x"), (4, "http://a.net/es/1"), (5, "http://a.net/en/1"),
    (6, None), (7, "nonsense"), (8, "http://x.org"), (9, "://h/p"), (10, "http://xample.com?en/"), (11, "http://notexample.com/en/1"), (11, "http://notexample.com/en/1"), (12, ""),
]


def test_url_rules_and_parts(spark):
    df = spark.createDataFrame([(*r, "clash", "clash") for r in URLS], "page_id long, url string, host string, verdict string")
    got = {r["page_id"]: r for r in urlrep.filter_urls(df).collect()}
    assert urlrep.filter_urls(df).count() == len(URLS)
    for page, url in URLS:
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        assert (got[page]["host"], got[page]["path"]) == (host, path)
    assert got[1]["rule"] == "www.example.com/en/" and got[1]["verdict"] == "allow"
    assert got[2]["rule"] == "example.com/en/" and got[2]["verdict"] == "block"
    assert got[3]["rule"] == "com/" and got[4]["rule"] == "net/es/"
    assert got[11]["rule"] == "com/" and got[10]["rule"] is None
    assert got[6]["rule"] is None and got[6]["verdict"] in ("allow", "block")
    assert urlrep.filter_urls(df.limit(0)).count() == 0


def test_reputation_shrinks_to_the_parent(spark):
    rows = [("a.bad.net", 1)] * 40 + [("b.bad.net", 1)] * 30 + [("new.bad.net", None)] * 3 + [("good.org", 0)] * 50 + [("new.org", None)] * 2 + [("mixed.org", 0)] * 5 + [("mixed.org", 1)]
    got = {r["host"]: r for r in urlrep.reputation(spark.createDataFrame(rows, "host string, bad int")).collect()}
    assert got["a.bad.net"]["refused"] and got["new.bad.net"]["rate"] > 0.5
    assert not got["good.org"]["refused"] and not got["new.org"]["refused"] and not got["mixed.org"]["refused"]
    assert got["new.bad.net"]["rate"] < got["a.bad.net"]["rate"]


LICENCES = [
    (1, "Text. Released under the MIT License. More"), (2, "Licensed under the Apache License, Version 2.0.\nunder the mit license and under-the MIT license"), (3, "Licensed under CC BY-NC 4.0."),
    (4, "This work is licensed under the GNU General Public License, version 3."), (5, None), (6, ""), (7, "..."), (8, "the mit licenses"), (9, "mit license under the"), (10, "Ünder the mit license, under the mit license"),
    (11, "GNU General Public License. Nothing near it: version 3"), (12, "version 3 of things; the General License, Public GNU"), (1, "Text. Released under the MIT License. More"),
    (13, "under the mit\x7flicense"), (14, "under the mİt license"), (15, "prefix " * 5000 + "apache license version 2"),
]


def test_license_scan(spark):
    got = license_scan.scan(docs(spark, LICENCES)).collect()
    assert len(got) == len(LICENCES)
    by = {r["doc_id"]: r for r in got}
    for doc, text in LICENCES:
        lowered = "".join(c.lower() if c.isascii() else c for c in text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
        starts, labels = [], set()
        for phrase, label in license_scan.BASE:
            p = phrase.split()
            own = [i for i in range(len(words)) if words[i : i + len(p)] == p]
            starts += own
            labels |= {label} if own else set()
        r = by[doc]
        assert r["n_words"] == len(words), doc
        assert r["n_base"] == len(starts), doc
        assert (r["first_word"], r["last_word"]) == ((min(starts), max(starts)) if starts else (None, None)), doc
        assert r["base_labels"] == ",".join(sorted(labels)), doc
        assert set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(","))
        assert 0 <= r["score"] <= 1
    assert by[4]["labels"] == "gpl-3" and by[4]["score"] == 1.0
    assert by[12]["labels"] == "" and by[9]["labels"] == ""
    assert license_scan.scan(docs(spark, [])).count() == 0


def test_license_scan_of_several_notices(spark):
    texts = [(label, text) for label, text, _ in license_scan.TEMPLATES]
    vocab = " ".join(license_scan.vocabulary())
    data, want = [], {}

    def add(text, *labels):
        want[len(data)] = set(labels)
        data.append((len(data), text))

    for i, (label, text) in enumerate(texts):
        add(f"{text}. {vocab}. {vocab}", label)  # the file holds every licence word there is
        add(f"{vocab} x. {text}", label)
        for other, more in texts[i + 1 :]:
            add(f"{text}. Some words between. {more}", label, other)
    for order in (1, -1):
        add(". Then: ".join(text for _, text in texts[::order]), *(label for label, _ in texts))
    add(f"{texts[3][1]}. {'word ' * 3000} any charge code conditions copy files purpose terms {texts[1][1]}", "gpl-3", "mit")
    add(" ".join(reversed(vocab.split())))
    got = {r["doc_id"]: r for r in license_scan.scan(docs(spark, data)).collect()}
    for doc, labels in want.items():
        assert labels <= set(got[doc]["labels"].split(",")), data[doc]
        assert not labels or got[doc]["score"] == 1.0, data[doc]
    assert got[len(data) - 1]["labels"] == "" and got[len(data) - 1]["score"] == 0
