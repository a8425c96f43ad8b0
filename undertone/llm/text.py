"""Vectorised text access inside tasks.

A column of texts is taken as one byte buffer. Words are spans of it, hashed
eight bytes at a time for all spans together, so no Python string is made per
word; runs of words are hashed as trees of pairs. Each step is a bijection of
what it takes in, so no pattern of letters or words makes hashes agree. Work
goes in chunks of whole documents, which bounds memory by ``CHUNK`` bytes or
the longest single text. A null text counts as empty.

Sums of powers (``prefix_sums``) give a key for any of many overlapping spans.
Regular patterns can make such keys agree: they only bring candidates together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

CHUNK = 1 << 20

_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}
_KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_SALT = np.uint64(0x27D4EB2F165667C5)
_ODD = np.uint64(0xA0761D6478BD642F)
#: Spans of more bytes are hashed one by one.
LONG = 128


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit of a 64-bit value over all bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def byte_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans of bytes: each step mixes in eight more bytes, one to one."""
    size = ends - starts
    h = mix(size.astype(np.uint64) + _SALT)
    padded = np.append(data, np.zeros(8, np.uint8))
    lanes = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    alive = np.flatnonzero((size > 0) & (size <= LONG))
    at, left = starts[alive], size[alive]
    while len(alive):
        h[alive] = mix((h[alive] ^ (lanes[at] & _KEEP[np.minimum(left, 8)])) * _ODD)
        more = left > 8
        alive, at, left = alive[more], at[more] + 8, left[more] - 8
    view = memoryview(data)
    for s in np.flatnonzero(size > LONG):
        h[s] = xxhash.xxh3_64_intdigest(view[starts[s] : ends[s]])
    return h


def window_hashes(values: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` hashes, from their first place on: a tree of pairs."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    level, have, out, done = values, 1, None, 0
    while True:
        if k & have:
            out = level[:n] if out is None else mix(out * _ODD ^ level[done : done + n])
            done += have
        if done == k:
            return out
        level = mix(level[:-have] * _ODD ^ level[have:])
        have *= 2


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        size = max(n, CHUNK + 2)
        for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
            values = np.full(size, base, np.uint64)
            values[0] = 1
            _POWERS[name] = np.cumprod(values, dtype=np.uint64)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Sums S with S[j] - S[i] a positioned key of values[i:j]; see ``span_keys``."""
    up, _ = _powers(len(values))
    out = np.empty(len(values) + 1, np.uint64)
    out[0] = 0
    np.cumsum(values * up, out=out[1:])
    return out


def span_keys(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Equal spans have equal keys wherever they stand; equal keys don't prove equal spans."""
    _, down = _powers(len(sums))
    h = (sums[ends] - sums[starts]) * down[starts]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def buffer_of(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and the offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, places, data = column.buffers()
    offsets = np.frombuffer(places, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, offsets.astype(np.int64)


def chunks(offsets: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Runs [i, j) of rows with at most ``limit`` bytes together, or a single longer row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a run of documents as byte spans.

    ``first`` gives for each document the number of its first word, and one
    entry more for the end.
    """

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, i: int, j: int, lower: bool = False):
        base = offsets[i]
        data = raw[base : offsets[j]]
        self.data = _LOWER[data] if lower else data
        self.bounds = offsets[i : j + 1] - base
        ink = ~_WHITE[data]
        cut = np.zeros(len(data) + 1, bool)
        cut[self.bounds] = True
        before = np.empty_like(ink)
        before[:1] = False
        before[1:] = ink[:-1]
        self.starts = np.flatnonzero(ink & (~before | cut[:-1]))
        after = np.empty_like(ink)
        after[-1:] = False
        after[:-1] = ink[1:]
        self.ends = np.flatnonzero(ink & (~after | cut[1:])) + 1
        self.first = np.searchsorted(self.starts, self.bounds)
        self._hashes = None

    def hashes(self) -> np.ndarray:
        if self._hashes is None:
            self._hashes = byte_hashes(self.data, self.starts, self.ends)
        return self._hashes

    def documents(self) -> np.ndarray:
        """For each word the number of its document within the run."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers starts[0], starts[0]+1, ... of all runs, one run after the other."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(starts - (np.cumsum(counts) - counts), counts)
    return np.arange(total, dtype=np.int64) + shift


def signed(h: np.ndarray) -> pa.Array:
    """Hashes as a column of longs."""
    return pa.array(np.ascontiguousarray(h).view(np.int64), pa.int64())


def binaries(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())
