"""Piecewise-linear rank index: from the rank of a boundary to its offset.

The boundaries of a document are rising offsets. Segments cover them from left
to right: each starts at a boundary, and its slope keeps every prediction of
the segment within ``ERROR`` of the truth; a segment ends where no slope could.
What a prediction misses is stored with the boundary in two bytes (more for a
larger error), so a lookup is one multiplication and one correction, and exact.
"""

from __future__ import annotations

import numpy as np

ERROR = 512
STEP = 64


def residual_type(error: int) -> np.dtype:
    """The shortest integers that hold what predictions within ``error`` can miss, rounding included."""
    return np.dtype("<i1" if error < 126 else "<i2" if error < 32766 else "<i4" if error < 2**31 - 2 else "<i8")


def _reach(offsets: np.ndarray, error: int) -> tuple[int, float]:
    """(boundaries, slope) of the longest segment from the first boundary on.

    The slopes that suit all boundaries so far are an interval, which each further boundary
    narrows; boundaries are taken in runs of growing length.
    """
    low, high, done, step = -np.inf, np.inf, 1, STEP
    while done < len(offsets):
        x = np.arange(done, min(len(offsets), done + step))
        rise = offsets[x] - offsets[0]
        lows = np.maximum.accumulate(np.append(low, (rise - error) / x))[1:]
        highs = np.minimum.accumulate(np.append(high, (rise + error) / x))[1:]
        fits = int(np.argmax(lows > highs)) if (lows > highs).any() else len(x)
        if fits:
            low, high = lows[fits - 1], highs[fits - 1]
        done += fits
        if fits < len(x):
            break
        step *= 2
    return done, (low + high) / 2 if done > 1 else 0.0


class RankIndex:
    """Segments (rank of the first boundary, its offset, slope) and residuals of one document."""

    def __init__(self, ranks: np.ndarray, offsets: np.ndarray, slopes: np.ndarray, residuals: np.ndarray):
        self.ranks, self.offsets, self.slopes, self.residuals = ranks, offsets, slopes, residuals

    @classmethod
    def fit(cls, offsets: np.ndarray, error: int = ERROR) -> RankIndex:
        ranks, slopes, at = [], [], 0
        while at < len(offsets):
            taken, slope = _reach(offsets[at:], error)
            ranks.append(at)
            slopes.append(slope)
            at += taken
        ranks = np.array(ranks, np.int64)
        index = cls(ranks, offsets[ranks], np.array(slopes), np.zeros(0, np.int8))
        index.residuals = (offsets - index.predict(np.arange(len(offsets)))).astype(residual_type(error))
        return index

    def predict(self, ranks: np.ndarray) -> np.ndarray:
        """Offsets by the segments alone, at most ``error`` + 1 from the truth."""
        s = np.searchsorted(self.ranks, ranks, side="right") - 1
        return self.offsets[s] + np.floor(self.slopes[s] * (ranks - self.ranks[s])).astype(np.int64)

    def locate(self, ranks: np.ndarray) -> np.ndarray:
        """The exact offsets of the boundaries of these ranks."""
        return self.predict(ranks) + self.residuals[ranks]
