"""Rows with every kind of trouble: nulls, empty and long texts, ties, repeated rows, clashing names."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, rep long, x long, y long, v long, n long, size int, _text string, text_crc32 long, _k int, items int, url string"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    kinds = [f"{a}{b}" for a in ("th", "er", "on", "wh", "Ma", "ri", "so") for b in ("e", "and", "ing", "é", "to", "x")]
    return " ".join(r.choice(kinds) + r.choice(["", "", "", ".", ","]) for _ in range(n))


def rows() -> list[tuple]:
    out = [(i, prose(i, 5 + 7 * (i % 40))) for i in range(60)]
    out += [(100 + i, prose(3, 26)) for i in range(12)]  # exact copies
    base = prose(77, 200).split()
    for i in range(15):  # near copies
        words = list(base)
        words[10 + i] = f"changed{i}"
        out.append((200 + i, " ".join(words)))
    out += [(300, None), (301, ""), (302, " \n\t "), (303, "one"), (304, "one two"), (305, "Ünï cödé 漢字"), (306, prose(5, 30_000)), (307, prose(9, 300)), (307, prose(9, 300)), (None, "no id at all here"), (-5, "negative id")]
    return out


def docs(spark, data=None, schema=DOCS):
    fill = [tuple(r) + ("en", "src", 1, 0.5, 1, 2, 3, 4, 5, 6, "clash", 7, 8, 9, "http://u") for r in (rows() if data is None else data)]
    return spark.createDataFrame(fill, schema)
