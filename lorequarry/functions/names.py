"""The same comparisons for code that runs in Python workers."""

from __future__ import annotations

BLANKS = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def norm(name: str) -> str:
    return name.strip(BLANKS).lower()


def indel_ratio(a: str, b: str) -> int:
    """0 to 100, rounded half to even; the common subsequence by bit parallel rows."""
    if not a or not b:
        return 100 if a == b else 0
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & at.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    lcs = len(a) - row.bit_count()
    return round(200 * lcs / (len(a) + len(b)))
