"""Silhouette of word sets by joins against all pairs."""

import math
import random
from collections import defaultdict

import pytest

from undertone.operators.evaluate import token_silhouette


def plain(units):
    """video -> mean silhouette of (cluster, words)."""
    scores = {}
    for video, rows in units.items():
        values = []
        for i, (own, words) in enumerate(rows):
            apart = defaultdict(list)
            for j, (other, said) in enumerate(rows):
                if i != j:
                    shared = len(set(words) & set(said))
                    apart[other].append(1 - (shared / math.sqrt(len(words) * len(said)) if words and said else 0))
            means = {c: sum(d) / len(d) for c, d in apart.items()}
            a, b = means.pop(own, None), min(means.values(), default=None)
            values.append(0 if a is None or b is None or max(a, b) < 1e-9 else (b - a) / max(a, b))
        scores[video] = sum(values) / len(values)
    return scores


def test_against_all_pairs(spark):
    draw = random.Random(4)
    words = [f"w{i}" for i in range(25)]
    units = {v: [(draw.choice("abc"), sorted(set(draw.choices(words, k=draw.randint(0, 5))))) for _ in range(40)] for v in ("x", "y")}
    units["one"] = [("a", ["w1"]), ("a", ["w2"])]
    units["lone"] = [("a", ["w1"]), ("b", [])]
    units["same"] = [("a", ["w1", "w2", "w3"])] * 3 + [("b", ["w1", "w2", "w3"])] * 2
    rows = [(v, f"{v}{i}", c, t) for v, group in units.items() for i, (c, t) in enumerate(group)]
    df = spark.createDataFrame(rows, "video_id string, unit_id string, cluster_key string, tokens array<string>")
    found = {r["video_id"]: r for r in token_silhouette(df, ["video_id"]).collect()}
    assert {v: r["units"] for v, r in found.items()} == {v: len(g) for v, g in units.items()}
    for video, value in plain(units).items():
        assert found[video]["silhouette"] == pytest.approx(value, abs=1e-6)


def test_null_words_and_nothing(spark):
    df = spark.createDataFrame([("v", "u", "a", None), ("v", "w", "a", None), ("v", "x", "b", ["k"])], "video_id string, unit_id string, cluster_key string, tokens array<string>")
    assert [tuple(r) for r in token_silhouette(df, ["video_id"]).collect()] == [("v", 3, 0.0)]
    assert token_silhouette(df.filter("false"), ["video_id"]).count() == 0


def test_blocks_of_one_content(spark):
    """A content of many blocks, beside small ones that share groups, comes out as from one; no pair leaves its group."""
    draw = random.Random(9)
    words = [f"w{i}" for i in range(60)]
    units = {"big": [(f"c{draw.randrange(30)}", sorted(set(draw.choices(words, k=draw.randint(0, 6))))) for _ in range(150)]}
    units |= {f"s{k}": [(draw.choice("ab"), sorted(set(draw.choices(words, k=3)))) for _ in range(6)] for k in range(5)}
    rows = [(v, f"{v}{i}", c, t) for v, group in units.items() for i, (c, t) in enumerate(group)]
    df = spark.createDataFrame(rows, "video_id string, unit_id string, cluster_key string, tokens array<string>")
    expected = plain(units)
    for block in (40, 100_000):
        found = {r["video_id"]: r["silhouette"] for r in token_silhouette(df, ["video_id"], block=block).collect()}
        assert found == pytest.approx(expected, abs=1e-6)
