"""Quality scores from document statistics.

Random Fourier features of standardised statistics approximate a Gaussian
kernel. Normal equations are summed per partition and fold, reduced per row of
the matrix, and solved by ridge regression; out-of-fold scores, counted in
``BINS`` bins, give an isotonic calibration. What reaches the driver is
bounded by ``FEATURES``, ``FOLDS`` and ``BINS``, not by the data.

All labelled training rows are used. An empty or null text has zero statistics
and is scored like any other. Without labels every score is 0.5, with labels
of one class only it is that class.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from undertone.llm import text as X
from undertone.llm.tasks import map_arrow, sum_vectors
from undertone.session import settle

FEATURES = 256
FOLDS = 4
BINS = 4096
RIDGE = 1.0
BANDWIDTH = 3.0
CLIP = 4.0
STATISTICS = (
    "length", "words", "word_length", "upper", "digits", "stops", "exclaim", "bars", "symbols", "wide", "lines",
    "repeated_next", "distinct", "symbol_ends", "single", "capitals", "line_words",
)


def _mask(characters: str) -> np.ndarray:
    table = np.zeros(256, np.int64)
    table[[ord(c) for c in characters]] = 1
    return table


_UPPER = _mask("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_DIGITS = _mask("0123456789")
_STOPS = _mask(".,;:?")
_EXCLAIM = _mask("!")
_BARS = _mask("|")
_SYMBOLS = _mask("#$%&*@^_~+=<>/\\{}[]")
_LINES = _mask("\n")
_ENDS = _SYMBOLS + _EXCLAIM + _BARS
_WIDE = np.where(np.arange(256) >= 192, 1, 0)


def statistics(raw: np.ndarray, offsets: np.ndarray, i: int, j: int) -> np.ndarray:
    """One row of ``STATISTICS`` for each document of the run."""
    words = X.Words(raw, offsets, i, j)
    data, bounds, first = words.data, words.bounds, words.first
    size = np.maximum(np.diff(bounds), 1)
    count = np.diff(first)
    some = np.maximum(count, 1)

    def share(table: np.ndarray) -> np.ndarray:
        return np.diff(np.append(0, np.cumsum(table[data]))[bounds]) / size

    def per_word(flags: np.ndarray) -> np.ndarray:
        return np.diff(np.append(0, np.cumsum(flags))[first]) / some

    lengths = words.ends - words.starts
    hashes = words.hashes()
    document = words.documents()
    again = np.zeros(len(hashes), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (document[1:] == document[:-1])
    order = np.lexsort((hashes, document))
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[order][1:] != hashes[order][:-1]) | (document[order][1:] != document[order][:-1])
    distinct = np.bincount(document[order][fresh], minlength=len(count)) if len(hashes) else np.zeros(len(count))
    lines = share(_LINES)
    columns = [
        np.log1p(np.diff(bounds)), np.log1p(count), per_word(lengths), share(_UPPER), np.sqrt(share(_DIGITS)), share(_STOPS),
        np.sqrt(share(_EXCLAIM)), np.sqrt(share(_BARS)), np.sqrt(share(_SYMBOLS)), share(_WIDE), np.sqrt(lines),
        np.sqrt(per_word(again)), np.log1p(distinct) / np.log1p(some), per_word(_ENDS[data[words.ends - 1]] if len(hashes) else np.zeros(0)),
        per_word(lengths == 1), per_word(_UPPER[data[words.starts]] if len(hashes) else np.zeros(0)),
        np.log1p(count / (1 + lines * size)),
    ]
    return np.stack(columns, axis=1).astype(np.float64)


def _statistics_of(column: pa.Array) -> np.ndarray:
    raw, offsets = X.buffer_of(column)
    parts = [statistics(raw, offsets, i, j) for i, j in X.chunks(offsets)]
    return np.concatenate(parts) if parts else np.zeros((0, len(STATISTICS)))


@dataclass
class Model:
    """Means and deviations of the statistics, the ridge weights, the calibration curve, and the number of labelled rows."""

    mean: np.ndarray
    deviation: np.ndarray
    weights: np.ndarray
    at: np.ndarray
    chance: np.ndarray
    rows: int = 0

    def raw(self, x: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        return fourier(x, self.mean, self.deviation) @ (self.weights if weights is None else weights)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated chance of label 1; within a level of the curve the raw score orders."""
        raw = self.raw(x)
        ordered = 1 / (1 + np.exp(-4 * (raw - 0.5)))
        return np.clip(0.999 * np.interp(raw, self.at, self.chance) + 0.001 * ordered, 0, 1)


def fourier(x: np.ndarray, mean: np.ndarray, deviation: np.ndarray) -> np.ndarray:
    """Random Fourier features of standardised statistics, and a constant."""
    draw = np.random.default_rng(20011)
    directions = draw.normal(0, 1 / BANDWIDTH, (x.shape[1], FEATURES))
    phases = draw.uniform(0, 2 * np.pi, FEATURES)
    z = np.clip((x - mean) / deviation, -CLIP, CLIP)
    return np.concatenate([np.sqrt(2 / FEATURES) * np.cos(z @ directions + phases), np.ones((len(x), 1))], axis=1)


def document_statistics(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, statistics) with the statistics as little-endian doubles; one row per row of ``docs``."""

    def run(batches):
        for batch in batches:
            rows = [r.tobytes() for r in _statistics_of(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("key"), X.binaries(rows)], ["key", "statistics"])

    return map_arrow(
        docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text")), run,
        "key long, statistics binary",
    )


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), -1)


def fit(labelled: DataFrame) -> Model:
    """A model from ``labelled``: columns key, statistics, y (0 or 1)."""
    n = len(STATISTICS)
    rows = settle(labelled.select(F.pmod(F.floor(F.crc32(F.col("key").cast("string")) / 8), F.lit(FOLDS)).cast("int").alias("fold"), "statistics", "y"))

    def moments(batches):
        total = np.zeros(2 * n + 2)
        for batch in batches:
            x, y = _matrix(batch.column("statistics")), batch.column("y").to_numpy(zero_copy_only=False)
            if len(x):
                total += np.concatenate([x.sum(axis=0), (x**2).sum(axis=0), [len(x), y.sum()]])
        yield 0, total

    found = sum_vectors(rows, moments)
    total = found[0][1] if found else np.zeros(2 * n + 2)
    count, ones = total[-2], total[-1]
    if count == 0 or ones in (0, count):
        level = 0.5 if count == 0 else ones / count
        return Model(np.zeros(n), np.ones(n), np.zeros(FEATURES + 1), np.array([0.0, 1.0]), np.array([level, level]), int(count))
    mean = total[:n] / count
    deviation = np.sqrt(np.maximum(total[n : 2 * n] / count - mean**2, 0))
    deviation[deviation < 1e-9] = 1.0

    def equations(batches):
        sums = np.zeros((FOLDS, FEATURES + 1, FEATURES + 2))
        for batch in batches:
            if not batch.num_rows:
                continue
            z = fourier(_matrix(batch.column("statistics")), mean, deviation)
            y = batch.column("y").to_numpy(zero_copy_only=False).astype(np.float64)
            fold = batch.column("fold").to_numpy(zero_copy_only=False)
            for f in range(FOLDS):
                mine = z[fold == f]
                sums[f] += mine.T @ np.column_stack([mine, y[fold == f]])
        for f in range(FOLDS):
            if sums[f].any():
                for i in range(FEATURES + 1):
                    yield f * (FEATURES + 1) + i, sums[f, i]

    gram = np.zeros((FOLDS, FEATURES + 1, FEATURES + 2))
    for i, row in sum_vectors(rows, equations):
        gram[i // (FEATURES + 1), i % (FEATURES + 1)] = row
    whole = gram.sum(axis=0)

    def solve(system: np.ndarray) -> np.ndarray:
        ridge = np.diag([RIDGE] * FEATURES + [1e-6])
        return np.linalg.solve(system[:, :-1] + ridge, system[:, -1])

    left_out = [solve(whole - gram[f]) for f in range(FOLDS)]
    model = Model(mean, deviation, solve(whole), np.array([0.0, 1.0]), np.array([0.0, 1.0]), int(count))

    def histogram(batches):
        counts = np.zeros((2, BINS))
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("statistics"))
            y = batch.column("y").to_numpy(zero_copy_only=False)
            fold = batch.column("fold").to_numpy(zero_copy_only=False)
            for f in range(FOLDS):
                raw = model.raw(x[fold == f], left_out[f])
                place = np.clip((raw + 0.5) / 2 * BINS, 0, BINS - 1).astype(int)
                for label in (0, 1):
                    counts[label] += np.bincount(place[y[fold == f] == label], minlength=BINS)
        yield 0, counts.ravel()

    counts = sum_vectors(rows, histogram)[0][1].reshape(2, BINS)
    model.at, model.chance = isotonic(counts[0], counts[1])
    return model


def isotonic(zeros: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(raw score, chance of label 1) of a rising curve: neighbouring bins are pooled while they fall."""
    blocks: list[list[float]] = []  # ones, all, weighted place
    for b in np.flatnonzero(zeros + ones):
        n = zeros[b] + ones[b]
        blocks.append([ones[b], n, n * ((b + 0.5) * 2 / BINS - 0.5)])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last)]
    return np.array([p / n for _, n, p in blocks]), np.array([y / n for y, n, _ in blocks])


def held_out(key: Column, modulus: int, remainder: int) -> Column:
    """Whether the crc32 of the key as text has this remainder; a null key counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % modulus == remainder


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", key: str = "doc_id") -> Model:
    """A model of ``label`` (0, 1; null is ignored) from documents whose key's crc32 mod 4 is not 2."""
    known = labels.filter(F.col(label).isin(0, 1)).select(F.col(key).cast("long").alias("key"), F.col(label).cast("int").alias("y"))
    known = known.filter(~held_out(F.col("key"), 4, 2))
    return fit(document_statistics(docs, text, key).join(known, "key"))


def score_quality(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the column ``out``: the chance of label 1, from the text alone."""
    schema = docs.withColumn(out, F.lit(0.0)).schema
    names = schema.names

    def run(batches):
        for batch in batches:
            scores = pa.array(model.score(_statistics_of(batch.column(text))), pa.float64())
            yield pa.RecordBatch.from_arrays([scores if c == out else batch.column(c) for c in names], names)

    return map_arrow(docs.withColumn(text, F.col(text).cast("string")), run, schema)
