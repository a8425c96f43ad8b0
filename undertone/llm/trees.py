"""Quality rules: plain limits, and gradient-boosted trees over document statistics.

Each text is read once: its counts and statistics are written as a small table,
from which the trees are learnt and by which all documents are judged.

Statistics are cut into at most ``BINS`` bins at quantiles of a fine histogram.
Each level of a tree is one pass over the labelled rows: a task sums gradients
and curvatures per node, statistic and bin, and the sums are added up between
tasks. The driver sees those sums only, whose size follows from ``DEPTH``,
``BINS`` and the number of statistics. Gradients are whole multiples of
``UNIT``, so the sums are exact and the trees don't depend on how rows lie in
partitions. A pass computes the scores so far from the trees, so nothing is
kept between passes.

Statistics in ``MONOTONE`` may move a score in one direction only: a split
against it is not taken, and the two sides of a split bound all leaves below.

The trees are flattened into arrays of nodes. A leaf leads back to itself, so
all rows go down all trees in ``DEPTH`` vectorised steps.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from undertone.llm import text as X
from undertone.llm.tasks import map_arrow, sum_vectors
from undertone.session import settle

TREES = 24
DEPTH = 3
RATE = 0.3
LEAF = 1.0
LEAST_WEIGHT = 4.0
BINS = 64
FINE = 4096
UNIT = 2.0**-20
LEAST_SCORE = 0.5

LEAST_WORDS = 50
MOST_REPEATED = 50  # per cent of the words

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
STATISTICS = (
    "words", "word_chars", "symbols", "same_lines", "repeated", "again", "upper", "digits", "stops", "exclaim",
    "wide", "line_words", "distinct", "single", "symbol_ends", "capitals",
)
#: -1: the score never rises with the statistic; +1: it never falls.
MONOTONE = {"symbols": -1, "same_lines": -1, "repeated": -1, "again": -1, "exclaim": -1}


def _table(characters: str) -> np.ndarray:
    table = np.zeros(256, np.int64)
    table[[ord(c) for c in characters]] = 1
    return table


_SYMBOLS = _table("#*$%&|<>")
_UPPER = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_DIGITS = _table("0123456789")
_STOPS = _table(".,;:?")
_EXCLAIM = _table("!")
_LINES = _table("\n")
_POINTS = np.where((np.arange(256) & 0xC0) != 0x80, 1, 0)
_WIDE = np.where(np.arange(256) >= 192, 1, 0)


def _per_document(document: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, number of equal ones) of hashes: sorted by document and hash, how often each occurs in its document."""
    order = np.lexsort((hashes, document))
    d, h = document[order], hashes[order]
    edge = np.flatnonzero(np.append(True, (d[1:] != d[:-1]) | (h[1:] != h[:-1]))) if len(d) else np.zeros(0, np.int64)
    size = np.diff(np.append(edge, len(d)))
    return order, np.repeat(size, size)


def repeated_words(words: X.Words, document: np.ndarray, width: int = 3) -> np.ndarray:
    """Whether each word lies in a run of ``width`` words that its document holds twice or more."""
    n = len(words.starts)
    windows = X.window_hashes(words.hashes(), width)
    at = np.flatnonzero(document[: len(windows)] == document[width - 1 :]) if len(windows) else np.zeros(0, np.int64)
    order, times = _per_document(document[at], windows[at])
    change = np.zeros(n + 1, np.int64)
    begin = at[order[times > 1]]
    change[begin] += 1
    np.subtract.at(change, begin + width, 1)
    return np.cumsum(change)[:n] > 0


def same_lines(words: X.Words, raw: np.ndarray) -> np.ndarray:
    """For each document the number of lines with a word that equal an earlier line of it."""
    breaks = np.flatnonzero(raw == 10)
    starts = np.unique(np.concatenate([words.bounds[:-1], breaks + 1]))
    starts = starts[starts < len(raw)]
    documents = len(words.bounds) - 1
    if not len(starts):
        return np.zeros(documents, np.int64)
    ends = np.append(starts[1:], len(raw))
    ends = ends - (raw[ends - 1] == 10)
    inked = np.searchsorted(words.starts, ends) > np.searchsorted(words.starts, starts)
    starts, ends = starts[inked], ends[inked]
    document = np.searchsorted(words.bounds, starts, side="right") - 1
    order, times = _per_document(document, X.byte_hashes(raw, starts, ends))
    distinct = np.bincount(document[order], 1 / times, minlength=documents) if len(order) else np.zeros(documents)
    return np.bincount(document, minlength=documents) - np.rint(distinct).astype(np.int64)


def measured(raw: np.ndarray, offsets: np.ndarray, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
    """(``COUNTS``, ``STATISTICS``) with one row for each document of the run."""
    words = X.Words(raw, offsets, i, j)
    data, bounds, first = words.data, words.bounds, words.first
    n_bytes, n_words = np.diff(bounds), np.diff(first)
    size, some = np.maximum(n_bytes, 1), np.maximum(n_words, 1)
    document = words.documents()

    def count(table: np.ndarray) -> np.ndarray:
        return np.diff(np.append(0, np.cumsum(table[data]))[bounds])

    def of_words(flags: np.ndarray) -> np.ndarray:
        return np.diff(np.append(0, np.cumsum(flags))[first])

    points = np.append(0, np.cumsum(_POINTS[data]))
    letters = points[words.ends] - points[words.starts]
    word_chars = of_words(letters)
    symbols, lines = count(_SYMBOLS), count(_LINES)
    hashes = words.hashes()
    following = np.zeros(len(hashes), bool)
    following[1:] = (hashes[1:] == hashes[:-1]) & (document[1:] == document[:-1])
    order, times = _per_document(document, hashes)
    distinct = np.bincount(document[order], 1 / times, minlength=len(n_words)) if len(order) else np.zeros(len(n_words))
    repeats = of_words(repeated_words(words, document))
    again = same_lines(words, data)
    counts = np.stack([n_words, word_chars, symbols, again, repeats], axis=1).astype(np.int64)
    last, opening = (data[words.ends - 1], data[words.starts]) if len(hashes) else (data[:0], data[:0])
    statistics = np.stack([
        np.log1p(n_words), word_chars / some, np.sqrt(symbols / size), again / (lines + 1), repeats / some, of_words(following) / some,
        count(_UPPER) / size, count(_DIGITS) / size, count(_STOPS) / size, np.sqrt(count(_EXCLAIM) / size), count(_WIDE) / size,
        np.log1p(n_words / (lines + 1)), distinct / some, of_words(letters == 1) / some,
        of_words((_SYMBOLS + _EXCLAIM)[last]) / some, of_words(_UPPER[opening]) / some,
    ], axis=1).astype("<f8")
    return counts, statistics


def document_statistics(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of each row of ``docs`` in a struct ``kept``, its ``COUNTS``, and ``statistics`` as little-endian doubles.

    A null text has no words, characters or lines, as an empty one has.
    """
    packed = docs.select(F.struct(*(F.col(c).alias(f"c{n}") for n, c in enumerate(keep))).alias("kept"), F.col(text).cast("string").alias("text"))
    schema = StructType([packed.schema["kept"]])
    for name in COUNTS:
        schema = schema.add(name, LongType())
    schema = schema.add("statistics", "binary")

    def run(batches):
        for batch in batches:
            raw, offsets = X.buffer_of(batch.column("text"))
            for i, j in X.chunks(offsets):
                counts, found = measured(raw, offsets, i, j)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("kept").slice(i, j - i), *(pa.array(c) for c in counts.T), X.binaries([r.tobytes() for r in found])],
                    ["kept", *COUNTS, "statistics"],
                )

    return map_arrow(packed, run, schema)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(len(column), -1)


@dataclass
class Trees:
    """Node arrays of all trees, the root of each, and the log odds they start from.

    From node i a row goes to ``below[i]`` if its statistic ``feature[i]`` is at most ``at[i]``, else
    to the node after it; leaves lead to themselves and have a ``value``.
    """

    feature: np.ndarray
    at: np.ndarray
    below: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float = 0.0
    depth: int = DEPTH

    @classmethod
    def none(cls, base: float = 0.0) -> Trees:
        whole = np.zeros(0, np.int64)
        return cls(whole, np.zeros(0), whole, np.zeros(0), whole, base)

    def add(self, feature: list[int], at: list[float], below: list[int], value: list[float]) -> Trees:
        """With one more tree, whose ``below`` count from its root."""
        shift = len(self.feature)
        return Trees(
            np.append(self.feature, feature).astype(np.int64), np.append(self.at, at), np.append(self.below, np.array(below) + shift).astype(np.int64),
            np.append(self.value, value), np.append(self.roots, shift), self.base, self.depth,
        )

    def leaves(self, x: np.ndarray, roots: np.ndarray) -> np.ndarray:
        """The node at which each row ends in each tree."""
        node = np.broadcast_to(roots, (len(x), len(roots)))
        row = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            node = self.below[node] + (x[row, self.feature[node]] > self.at[node])
        return node

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log odds of label 1."""
        if not len(self.roots):
            return np.full(len(x), self.base)
        return self.base + self.value[self.leaves(x, self.roots)].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def _edges(rows: DataFrame) -> tuple[list[np.ndarray], np.ndarray]:
    """(cuts of each statistic, (weight of label 0, of label 1)); cuts stand near the quantiles."""
    n = len(STATISTICS)

    def spans(batches):
        low, high = np.full(n, np.inf), np.full(n, -np.inf)
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("statistics"))
                low, high = np.minimum(low, x.min(axis=0)), np.maximum(high, x.max(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n, dtype=np.int32)), pa.array(low), pa.array(high)], ["f", "low", "high"])

    found = map_arrow(rows, spans, "f int, low double, high double").groupBy("f").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    low, high = np.zeros(n), np.zeros(n)
    for r in found.collect():
        low[r["f"]], high[r["f"]] = r["low"], r["high"]
    if not np.isfinite(low).all():
        return [np.zeros(0)] * n, np.zeros(2)
    width = np.where(high > low, (high - low) / FINE, 1.0)

    def histogram(batches):
        total = np.zeros(n * FINE + 2)
        for batch in batches:
            if batch.num_rows:
                place = np.clip(np.floor((_matrix(batch.column("statistics")) - low) / width), 0, FINE - 1).astype(np.int64)
                total[: n * FINE] += np.bincount((place + np.arange(n) * FINE).ravel(), minlength=n * FINE)
                total[-2:] += [batch.column(c).to_numpy().sum() for c in ("zeros", "ones")]
        yield 0, total

    total = sum_vectors(rows, histogram)[0][1]
    cuts = []
    for f in range(n):
        sums = np.cumsum(total[f * FINE : (f + 1) * FINE])
        wanted = np.searchsorted(sums, sums[-1] * np.arange(1, BINS) / BINS)
        # Bins at both ends count as well, however few rows they have.
        places = np.unique(np.concatenate([wanted, np.flatnonzero(np.diff(np.append(0, sums)))[[0, -1]]]))
        cuts.append(low[f] + width[f] * (places[places < FINE - 1] + 1))
    return cuts, total[-2:]


def fit_trees(labelled: DataFrame, trees: int = TREES, monotone: dict[str, int] | None = None) -> Trees:
    """Trees for ``labelled``: columns statistics, zeros, ones (how often a row is labelled 0 and 1).

    Labels of one kind only give that score to every row; without labels all rows score 0.5.
    """
    rows = settle(labelled.select("statistics", F.col("zeros").cast("double").alias("zeros"), F.col("ones").cast("double").alias("ones")))
    cuts, (zeros, ones) = _edges(rows)
    if not zeros or not ones:
        return Trees.none(0.0 if zeros == ones else float(np.sign(ones - zeros)) * 20.0)
    sides = np.array([(MONOTONE if monotone is None else monotone).get(s, 0) for s in STATISTICS])
    model = Trees.none(float(np.log(ones / zeros)))
    for _ in range(trees):
        model = model.add(*_grown(rows, model, cuts, sides))
    return model


def _grown(rows: DataFrame, model: Trees, cuts: list[np.ndarray], sides: np.ndarray):
    """Node arrays (feature, at, below, value) of the next tree, grown level by level."""
    n, wide = len(cuts), BINS + 2
    feature, at, below, value = [0], [np.inf], [0], [0.0]
    bounds = [(-np.inf, np.inf)]
    open_nodes = [0]
    for _ in range(DEPTH):
        young = Trees(np.array(feature), np.array(at), np.array(below), np.zeros(len(feature)), np.zeros(1, np.int64))
        number = np.full(len(feature), -1)
        number[open_nodes] = np.arange(len(open_nodes))

        def sums(batches, young=young, number=number, size=len(open_nodes)):
            total = np.zeros((2, size * n * wide))
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = _matrix(batch.column("statistics"))
                zeros, ones = (batch.column(c).to_numpy() for c in ("zeros", "ones"))
                p = model.score(x)
                g = np.rint(((zeros + ones) * p - ones) / UNIT)
                h = np.rint((zeros + ones) * p * (1 - p) / UNIT)
                node = number[young.leaves(x, young.roots)[:, 0]]
                inside = node >= 0
                for f in range(n):
                    place = (node[inside] * n + f) * wide + np.searchsorted(cuts[f], x[inside, f], side="left")
                    total[0] += np.bincount(place, g[inside], minlength=total.shape[1])
                    total[1] += np.bincount(place, h[inside], minlength=total.shape[1])
            yield 0, total.ravel()

        total = sum_vectors(rows, sums)[0][1].reshape(2, len(open_nodes), n, wide) * UNIT
        split = []
        for place, node in enumerate(open_nodes):
            best = _best_split(total[:, place], cuts, sides, bounds[node])
            if best is None:
                continue
            f, cut, left, right, limits = best
            feature[node], at[node], below[node] = f, cut, len(feature)
            for weight, limit in zip((left, right), limits):
                split.append(len(feature))
                feature.append(0)
                at.append(np.inf)
                below.append(len(below))
                value.append(RATE * weight)
                bounds.append(limit)
        open_nodes = split
        if not split:
            break
    return feature, at, below, value


def _weight(g, h, low: float, high: float):
    return np.clip(-g / (h + LEAF), low, high)


def _gain(g, h, w):
    """How much a leaf of weight ``w`` lowers the loss."""
    return -(g * w + 0.5 * (h + LEAF) * w * w)


def _best_split(total: np.ndarray, cuts: list[np.ndarray], sides: np.ndarray, bound: tuple[float, float]):
    """(statistic, cut, weight below, weight above, bounds of both) of the best allowed split of a node, or None."""
    low, high = bound
    g, h = total[0, 0].sum(), total[1, 0].sum()
    least = _gain(g, h, _weight(g, h, low, high)) + 1e-6
    best = None
    for f, c in enumerate(cuts):
        if not len(c):
            continue
        gl, hl = np.cumsum(total[0, f])[: len(c)], np.cumsum(total[1, f])[: len(c)]
        left, right = _weight(gl, hl, low, high), _weight(g - gl, h - hl, low, high)
        gain = _gain(gl, hl, left) + _gain(g - gl, h - hl, right)
        allowed = (hl >= LEAST_WEIGHT) & (h - hl >= LEAST_WEIGHT) & (sides[f] * (right - left) >= 0)
        gain = np.where(allowed, gain, -np.inf)
        b = int(gain.argmax())
        if gain[b] > least:
            least = gain[b]
            middle = (left[b] + right[b]) / 2
            limits = {0: (bound, bound), 1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}[int(sides[f])]
            best = f, float(c[b]), float(left[b]), float(right[b]), limits
    return best


def base_failed() -> Column:
    """Too few words, or too many of them in repeated runs."""
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def label_weights(labels: DataFrame, label: str = "quality", key: str = "doc_id", hold_out: Column | None = None) -> DataFrame:
    """(key, zeros, ones): how often each key is labelled; other labels, null keys and those held out are left out."""
    known = labels.filter(F.col(label).isin(0, 1)).select(F.col(key).cast("long").alias("key"), F.col(label).cast("int").alias("y"))
    if hold_out is not None:
        known = known.filter(~hold_out)
    return known.filter("key is not null").groupBy("key").agg(F.sum(1 - F.col("y")).alias("zeros"), F.sum("y").alias("ones"))


def judged(measures: DataFrame, model: Trees, least: float = LEAST_SCORE) -> DataFrame:
    """``measures`` with ``score``, ``base_failed`` and ``kept``: no limit failed, and a score of at least ``least``."""
    schema = measures.withColumn("score", F.lit(0.0)).schema

    def run(batches):
        for batch in batches:
            scores = model.score(_matrix(batch.column("statistics"))) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], schema.names)

    found = map_arrow(measures, run, schema).withColumn("base_failed", base_failed())
    return found.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= least))


def quality_rules(
    docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", key: str = "doc_id",
    keep: tuple[str, ...] | None = None, least: float = LEAST_SCORE, trees: int = TREES, hold_out: Column | None = None,
) -> DataFrame:
    """The columns ``keep`` (by default the key) of each document with ``COUNTS``, ``score``, ``base_failed`` and ``kept``.

    The trees learn from documents whose key is in ``labels``, except where ``hold_out``, a condition
    on the column ``key``, holds. Repeated documents are judged alike, repeated labels count as often
    as they occur, other columns are ignored. Null and empty texts have no words and fail the limits.
    Columns of ``keep`` that clash with a made one give way to it.
    """
    made = (*COUNTS, "score", "base_failed", "kept")
    keep = (key,) if keep is None else keep
    carried = [key, *(c for c in keep if c != key)]
    measures = settle(document_statistics(docs, text, tuple(carried)))
    weights = label_weights(labels, label, key, hold_out)
    rows = measures.select(F.col("kept.c0").cast("long").alias("key"), "statistics")
    model = fit_trees(rows.join(weights, "key"), trees)
    found = judged(measures.withColumnRenamed("kept", "carried"), model, least)
    return found.select(*(F.col("carried")[f"c{carried.index(c)}"].alias(c) for c in keep if c not in made), *made)
