"""Quality rules: counts, trees and verdicts against plain versions."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from undertone.llm import text as X
from undertone.llm import trees as T
from undertone.llm.queries import QUERIES


def counts(text):
    text = text or ""
    words = brute.words(text)
    seen, again = set(), 0
    for line in text.split("\n"):
        again += bool(brute.words(line)) and line in seen
        seen.add(line)
    runs = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(runs)
    repeated = {i + d for i, run in enumerate(runs) if times[run] > 1 for d in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(repeated)


def measured(texts):
    raw, offsets = X.buffer_of(pa.array(texts, pa.string()))
    return T.measured(raw, offsets, 0, len(texts))


def test_counts():
    draw = random.Random(1)
    parts = ["a", "b", "é", "日本", "#", "*|", "<x>", " ", "  ", "\n", "\n\n", "\t", "a b c", "same line\n", "\x0b", " nbsp", "\x00"]
    texts = ["".join(draw.choice(parts) for _ in range(draw.choice([0, 1, 3, 10, 80]))) for _ in range(2000)]
    texts += [None, "", "\n", "a a a a", "a b a b", "x y z", "x y z x y z", "q\nq\nq", "q \nq", "w" * 100_000]
    found, statistics = measured(texts)
    assert [tuple(r) for r in found.tolist()] == [counts(t) for t in texts]
    assert np.isfinite(statistics).all() and statistics.shape == (len(texts), len(T.STATISTICS))
    # The neighbours in a run make no difference.
    for n in range(0, len(texts), 97):
        assert measured([texts[n]])[1].tolist() == statistics[n : n + 1].tolist()


def labelled(spark, n=3000, seed=0, noise=0.05):
    draw = np.random.default_rng(seed)
    x = np.round(draw.random((n, len(T.STATISTICS))), 3)
    y = ((x[:, 2] < 0.6) & ((x[:, 0] > 0.2) | (x[:, 6] > 0.7))) ^ (draw.random(n) < noise)
    rows = [(r.astype("<f8").tobytes(), int(1 - b), int(b)) for r, b in zip(x, y)]
    return x, y, spark.createDataFrame(rows, "statistics binary, zeros int, ones int").repartition(4)


def plain_tree(x, g, h, cuts, sides, depth, bound):
    """A tree as nested tuples, split by split over the rows themselves."""
    def weight(rows):
        return float(np.clip(-g[rows].sum() / (h[rows].sum() + T.LEAF), *bound))

    def gain(rows, w):
        return -(g[rows].sum() * w + 0.5 * (h[rows].sum() + T.LEAF) * w * w)

    every = np.ones(len(x), bool)
    best, least = None, gain(every, weight(every)) + 1e-6
    for f in range(x.shape[1]):
        for c in cuts[f] if depth else []:
            below = x[:, f] <= c
            if min(h[below].sum(), h[~below].sum()) < T.LEAST_WEIGHT:
                continue
            a, b = weight(below), weight(~below)
            if sides[f] * (b - a) < 0:
                continue
            found = gain(below, a) + gain(~below, b)
            if found > least + 1e-12:
                best, least = (f, c, below, a, b), found
    if best is None:
        return weight(every)
    f, c, below, a, b = best
    middle = (a + b) / 2
    left, right = {0: (bound, bound), 1: ((bound[0], middle), (middle, bound[1])), -1: ((middle, bound[1]), (bound[0], middle))}[sides[f]]
    return f, c, plain_tree(x[below], g[below], h[below], cuts, sides, depth - 1, left), plain_tree(x[~below], g[~below], h[~below], cuts, sides, depth - 1, right)


def descend(tree, row):
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def test_trees_are_those_of_a_plain_version(spark, monkeypatch):
    monkeypatch.setattr(T, "BINS", 8)
    x, y, rows = labelled(spark, 500)
    cuts, (zeros, ones) = T._edges(rows)
    assert (zeros, ones) == ((~y).sum(), y.sum())
    sides = [T.MONOTONE.get(s, 0) for s in T.STATISTICS]
    margin = np.full(len(x), np.log(ones / zeros))
    for _ in range(3):
        p = 1 / (1 + np.exp(-margin))
        g, h = (np.rint(v / T.UNIT) * T.UNIT for v in (p - y, p * (1 - p)))
        tree = plain_tree(x, g, h, cuts, sides, T.DEPTH, (-np.inf, np.inf))
        margin += T.RATE * np.array([descend(tree, r) for r in x])
    assert np.allclose(T.fit_trees(rows, trees=3).margin(x), margin, atol=1e-9)


def test_trees_learn_and_keep_to_their_directions(spark):
    _, _, rows = labelled(spark)
    model = T.fit_trees(rows, trees=12)
    x, y, _ = labelled(spark, 1500, seed=9, noise=0)
    assert ((model.score(x) >= 0.5) == y).mean() > 0.97
    for f, side in ((T.STATISTICS.index(s), side) for s, side in T.MONOTONE.items()):
        for row in x[:40]:
            line = np.repeat(row[None], 200, axis=0)
            line[:, f] = np.linspace(-0.5, 1.5, 200)
            assert (side * np.diff(model.margin(line)) >= -1e-12).all()
    again = T.fit_trees(rows.repartition(7), trees=12)
    assert again.value.tolist() == model.value.tolist() and again.at.tolist() == model.at.tolist()


def test_labels_of_one_kind_or_none(spark, awkward):
    labels = "doc_id long, quality int"
    for rows, score in (([], 0.5), ([(4, 1), (5, 1)], 1.0), ([(4, 0)], 0.0), ([(None, 1), (4, None), (4, 7)], 0.5)):
        found = T.quality_rules(awkward, spark.createDataFrame(rows, labels)).collect()
        assert len(found) == awkward.count() and all(abs(r["score"] - score) < 1e-6 for r in found)
        assert all(r["kept"] == (not r["base_failed"] and score >= 0.5) for r in found)


def test_awkward(spark, awkward):
    labels = spark.createDataFrame([(4, 1), (5, 0), (5, 0), (5, 1), (None, 0)], "doc_id long, quality int")
    clashing = awkward.selectExpr("*", "1 as n_words", "2 as score", "3 as kept", "4 as statistics", "5 as zeros")
    found = T.quality_rules(clashing, labels, keep=tuple(clashing.columns))
    assert found.columns == [c for c in clashing.columns if c not in ("n_words", "score", "kept")] + [*T.COUNTS, "score", "base_failed", "kept"]
    rows = found.collect()
    assert len(rows) == awkward.count()
    for r in rows:
        assert tuple(r[c] for c in T.COUNTS) == counts(r["text"]) and 0 <= r["score"] <= 1 and r["zeros"] == 5
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
    assert T.quality_rules(awkward.limit(0), labels).count() == 0
    with pytest.raises(Exception):
        T.quality_rules(awkward, labels, label="none")


def test_query(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    found = QUERIES["op12_quality_rules"](spark, sf).collect()
    assert {r["doc_id"] for r in found} == set(texts) and len(found) == len(texts)
    for r in found:
        assert tuple(r[c] for c in T.COUNTS) == counts(texts[r["doc_id"]])


def test_held_out_accuracy(spark):
    """On labelled documents that no tree has seen."""
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    found = [r for r in QUERIES["op12_quality_rules"](spark, sf).collect() if r["doc_id"] in labels and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    right = sum((r["score"] >= 0.5) == (labels[r["doc_id"]] == 1) for r in found)
    assert len(found) > 50 and right >= 0.95 * len(found)
    clean = [r for r in found if labels[r["doc_id"]] == 1 and not r["base_failed"]]
    assert sum(r["kept"] for r in clean) >= 0.97 * len(clean)
