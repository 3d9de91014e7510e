"""Splitting text to overlapping chunks along the strongest separator that it holds."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

from .names import BLANKS
from .vocab import CHUNK_OVERLAP, CHUNK_SIZE, SEPARATORS


def _cut(text: str, mark: str) -> list[str]:
    """Pieces of text, each but the first beginning with the separator; single characters if it is empty."""
    if not mark:
        return list(text)
    first, *rest = text.split(mark)
    return [p for p in (first, *[mark + r for r in rest]) if p]


def _join(parts: list[str], size: int, overlap: int) -> Iterator[str]:
    """Runs of parts of at most ``size`` characters; a run begins with the tail of the one before."""
    run: deque[str] = deque()
    held = 0
    for part in parts:
        if run and held + len(part) > size:
            yield "".join(run)
            while run and (held > overlap or held + len(part) > size):
                held -= len(run.popleft())
        run.append(part)
        held += len(part)
    if run:
        yield "".join(run)


def split_text(text: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, marks: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Stripped chunks that aren't blank."""
    mark, rest = marks[-1], ()
    for i, m in enumerate(marks):
        if not m or m in text:
            mark, rest = m, marks[i + 1 :]
            break
    out: list[str] = []
    small: list[str] = []
    for part in _cut(text, mark):
        if len(part) < size:
            small.append(part)
            continue
        out += _join(small, size, overlap)
        small = []
        out += split_text(part, size, overlap, rest) if rest else [part]
    out += _join(small, size, overlap)
    return [c for c in (c.strip(BLANKS) for c in out) if c]
