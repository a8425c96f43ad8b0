"""Splitting texts into the pieces that byte-level BPE works on, for a whole buffer at once.

The pieces are those of the pattern (fixed value, from the tokenizer's description)

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

found here from runs of characters of one class instead of by a regular expression.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import regex

LETTER, NUMBER, WHITE, OTHER = range(4)
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """The class of every code point."""
    table = np.full(0x110000, OTHER, np.uint8)
    points = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (WHITE, r"\s+")):
        for run in regex.finditer(pattern, points):
            first = ord(run.group()[0])
            table[[ord(c) for c in run.group()]] = kind
            assert table[first] == kind
    return table


@lru_cache(maxsize=1)
def _ascii_classes() -> np.ndarray:
    return _classes()[:256].copy()


def pieces(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets where the pieces start, and for each document its first piece.

    ``data`` holds UTF-8 of documents back to back, ``bounds`` their offsets, one more at the end.
    A piece ends where the next one starts. Pieces never cross documents.
    """
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(len(bounds), np.int64)
    if data.max() < 128:
        place = None
        kinds = _ascii_classes()[data]
        chars = data
        cuts = bounds
    else:
        place = np.flatnonzero((data & 0xC0) != 0x80)
        chars = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        kinds = _classes()[chars]
        cuts = np.searchsorted(place, bounds)
    m = len(kinds)
    first = np.zeros(m + 1, bool)
    first[cuts] = True
    last = first[1:].copy()
    last[-1] = True
    first = first[:-1]
    first[0] = True
    change = np.empty(m, bool)
    change[0] = True
    np.not_equal(kinds[1:], kinds[:-1], out=change[1:])
    start = change | first
    white = kinds == WHITE
    # The last blank of a run belongs to what follows if it is a space, else it stands alone;
    # at the end of a document the run stays whole.
    follows = np.empty(m, bool)
    follows[-1] = False
    np.logical_and(~white[1:], ~first[1:], out=follows[:-1])
    tail = white & follows
    start |= tail
    space = tail & (chars == 32)
    joined = np.empty(m, bool)
    joined[0] = False
    joined[1:] = space[:-1]
    start &= ~joined
    quotes = np.flatnonzero((chars == 39) & start)
    if len(quotes):
        _contract(chars, start, first, kinds, quotes, m)
    starts = np.flatnonzero(start)
    if place is not None:
        starts = place[starts]
    return starts, np.searchsorted(starts, bounds)


def _contract(chars, start, first, kinds, quotes, m) -> None:
    """Join quotes that begin a piece with a contraction after them."""
    quotes = quotes[quotes + 1 < m]
    quotes = quotes[(kinds[quotes + 1] == LETTER) & ~first[quotes + 1]]
    second = np.where(quotes + 2 < m, chars[np.minimum(quotes + 2, m - 1)], 0)
    inside = np.where(quotes + 2 < m, ~first[np.minimum(quotes + 2, m - 1)], False)
    one = chars[quotes + 1]
    length = np.zeros(len(quotes), np.int64)
    for text in CONTRACTIONS:
        fits = one == ord(text[0])
        if len(text) == 2:
            fits &= (second == ord(text[1])) & inside
        length[fits & (length == 0)] = len(text)
    hit = length > 0
    quotes, length = quotes[hit], length[hit]
    start[quotes + 1] = False
    after = quotes + 1 + length
    after = after[after < m]
    start[after] |= True
    # What followed a blank or another class keeps its start; a letter run continues after the contraction.
