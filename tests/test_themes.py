"""Themes by signature against plain loops over all pairs; numbering over range partitions."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from undertone.operators import themes as T
from undertone.operators.numbering import numbered


def plain_vectors(nodes, dimensions=T.DIMENSIONS):
    """node -> unit vector, all nodes of one scope."""
    used = Counter(w for words in nodes.values() for w in words)
    vectors = {}
    for node, words in nodes.items():
        v = [0.0] * dimensions
        for w in words:
            v[int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % dimensions] += math.log((len(nodes) + 1) / used[w])
        norm = math.sqrt(sum(x * x for x in v))
        if norm:
            vectors[node] = [x / norm for x in v]
    return vectors


def plain_pairs(vectors, least=T.LEAST):
    names = sorted(vectors)
    near = {}
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            cosine = round(sum(x * y for x, y in zip(vectors[a], vectors[b])), 9)
            if cosine >= least:
                near[a, b] = cosine
    return near


def plain_founders(strength, near):
    """node -> (founder, cosine): one by one, the strongest first."""
    order = sorted(strength, key=lambda n: (-strength[n], n))
    found, joined = [], {}
    links = defaultdict(dict)
    for (a, b), cosine in near.items():
        links[a][b] = links[b][a] = cosine
    for n in order:
        if any(f in links[n] for f in found):
            joined[n] = None
        else:
            found.append(n)
    for n in joined:
        # Only founders that were there before the node.
        known = [f for f in found if f in links[n] and order.index(f) < order.index(n)]
        best = min(known, key=lambda f: (-links[n][f], order.index(f)))
        joined[n] = (best, links[n][best])
    return joined | {f: (f, 1.0) for f in found}


def variants(seed, n):
    draw = random.Random(seed)
    words, said = [f"w{i}" for i in range(300)], []
    for _ in range(n):
        if said and draw.random() < 0.7:
            text = list(draw.choice(said))
            text[draw.randrange(len(text))] = draw.choice(words)
        else:
            text = draw.choices(words, k=draw.randint(5, 12))
        said.append(text)
    return {f"n{i:03d}": sorted({*t, "template"}) for i, t in enumerate(said)}


def test_pairs_and_recall(spark):
    nodes = variants(3, 400)
    df = spark.createDataFrame([("s", n, t) for n, t in nodes.items()] + [("s", "empty", [])], "stance string, node string, tokens array<string>")
    # The count of a scope includes the node without words.
    expected = plain_vectors(nodes | {"empty": []})
    vectors = T.hashed(df, ["stance"])
    for r in vectors.collect():
        assert r["vector"] == pytest.approx(expected[r["node"]], abs=1e-12)
    found = {(r["left"], r["right"]): r["near"] for r in T.near_pairs(vectors, ["stance"]).collect()}
    near = plain_pairs(expected)
    assert len(near) > 150 and set(found) <= set(near)
    assert len(found) >= 0.95 * len(near)
    assert all(abs(found[p] - near[p]) < 2e-9 for p in found)


def test_pairs_stay_in_their_scope(spark):
    rows = [("a", "n1", ["x", "y", "z"]), ("b", "n2", ["x", "y", "z"]), ("b", "n3", ["x", "y", "z"])]
    df = spark.createDataFrame(rows, "stance string, node string, tokens array<string>")
    assert [tuple(r) for r in T.near_pairs(T.hashed(df, ["stance"]), ["stance"]).collect()] == [("n2", "n3", 1.0)]
    none = df.filter("false")
    assert T.near_pairs(T.hashed(none, ["stance"]), ["stance"]).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_founders(spark, seed):
    draw = random.Random(seed)
    strength = {f"n{i:02d}": draw.choice([0.1, 0.5, 0.5, 0.9]) for i in range(60)}
    names = sorted(strength)
    near = {tuple(sorted(draw.sample(names, 2))): draw.choice([0.8, 0.9, 0.9, 0.95]) for _ in range(120)}
    # A long chain in descending strength decides one node a round.
    chain = [f"z{i:02d}" for i in range(12)]
    strength |= {c: 2.0 - i / 100 for i, c in enumerate(chain)}
    near |= {(a, b): 0.85 for a, b in zip(chain, chain[1:])}
    nodes = spark.createDataFrame(list(strength.items()), "node string, strength double")
    links = spark.createDataFrame([(a, b, c) for (a, b), c in near.items()], "left string, right string, near double")
    found = {r["node"]: (r["founder"], r["near"]) for r in T.founders(nodes, links).collect()}
    assert found == plain_founders(strength, near)


CLUSTERS = (
    "cluster_key string, local_cluster_id string, video_id string, stance string, label string, summary string, "
    "importance double, low_signal boolean, wide boolean"
)


def cluster(key, video, words, importance, stance="negative", low=False, wide=False):
    return (key, f"{video}_{key}", video, stance, f"Criticism of {words}", f"{len(key)} opinion units criticize {words}.", importance, low, wide)


def test_one_cluster_of_a_content_per_theme_and_none_lost(spark):
    rows = [
        cluster("a1", "v1", "battery life", 0.9), cluster("a2", "v1", "battery life", 0.8), cluster("a3", "v1", "battery life", 0.7),
        cluster("b1", "v2", "battery life", 0.6), cluster("b2", "v2", "battery life", 0.5), cluster("c", "v3", "battery life", 0.1),
        cluster("d", "v3", "keyboard noise", 0.4), cluster("p", "v4", "battery life", 0.9, stance="positive"),
        cluster("low", "v5", "battery life", 0.9, low=True), cluster("wide", "v5", "battery life", 0.9, wide=True),
        cluster("n", "v6", "", 0.2), cluster("u", "v7", "battery life", 0.3, stance=None),
    ]
    members = T.theme_members(spark.createDataFrame(rows, CLUSTERS))
    got = members.collect()
    assert sorted(r["cluster_key"] for r in got) == sorted(["a1", "a2", "a3", "b1", "b2", "c", "d", "p", "n", "u"])
    themes = defaultdict(list)
    for r in got:
        themes[r["meta_key"]].append(r["cluster_key"])
    assert sorted(sorted(t) for t in themes.values()) == [["a1", "b1", "c"], ["a2", "b2"], ["a3"], ["d"], ["n"], ["p"], ["u"]]
    recurring = {r["cluster_key"] for r in T.recurring_members(members).collect()}
    assert recurring == {"a1", "b1", "c", "a2", "b2"}


def test_themes_meet_across_signatures(spark):
    long = "battery life blue travel laptop model charger cable second winter season holiday trips"
    rows = [cluster(f"x{i}", f"v{i}", f"{topic}", 0.5) for i, topic in enumerate(["price", "screen glare", "fan noise", "shipping delays"])]
    rows += [cluster("first", "w1", long, 0.9), cluster("second", "w2", long + " today", 0.4), cluster("third", "w1", long + " now", 0.3)]
    got = {r["cluster_key"]: (r["meta_key"], r["layer"]) for r in T.theme_members(spark.createDataFrame(rows, CLUSTERS)).collect()}
    assert got["first"] == got["second"]
    assert got["third"][1] == 2 and got["third"][0] != got["first"][0]
    assert len({k for k, _ in got.values()}) == 6


def test_no_clusters(spark):
    empty = spark.createDataFrame([], CLUSTERS)
    assert T.theme_members(empty).count() == 0


@pytest.mark.parametrize("scope", [[], ["s"], ["s", "t"]])
def test_numbering(spark, scope):
    draw = random.Random(5)
    # One scope holds most rows; null scopes and null values are like others.
    rows = [(draw.choice(["hot", "hot", "hot", "hot", "b", None]), draw.choice([1, None]), draw.choice([None, 1.0, 2.0, 3.0]), i) for i in range(2000)]
    df = spark.createDataFrame(rows, "s string, t int, value double, id long").repartition(9)
    found = {r["id"]: r["rank"] for r in numbered(df, [F.desc("value"), F.asc("id")], scope).collect()}
    groups = defaultdict(list)
    for s, t, value, i in rows:
        groups[{0: (), 1: (s,), 2: (s, t)}[len(scope)]].append((value is None, -(value or 0), i))
    assert found == {place[2]: n for g in groups.values() for n, place in enumerate(sorted(g), 1)}


def test_numbering_of_nothing(spark):
    df = spark.createDataFrame([], "id long")
    assert numbered(df, [F.asc("id")]).columns == ["id", "rank"] and numbered(df, [F.asc("id")]).count() == 0


def test_pairs_are_searched_without_a_row_per_node_and_table(spark, monkeypatch):
    """What is written has a row per node; twins meet once, not in every table."""
    written, kept = [], T.settle
    monkeypatch.setattr(T, "settle", lambda df: written.append(kept(df)) or written[-1])
    nodes = variants(6, 60) | {f"t{i:02d}": ["alone", "template"] for i in range(20)}
    df = spark.createDataFrame([("s", n, t) for n, t in nodes.items()], "stance string, node string, tokens array<string>")
    vectors = T.hashed(df, ["stance"])
    found = {(r["left"], r["right"]) for r in T.near_pairs(vectors, ["stance"]).collect()}
    assert [w.count() for w in written] == [len(nodes)]
    assert {(a, b) for a in nodes for b in nodes if a < b and a[0] == b[0] == "t"} <= found


def test_founders_keep_no_tables_of_past_rounds(spark, monkeypatch):
    from pathlib import Path

    from undertone import session

    written, kept = [], T.settle
    monkeypatch.setattr(T, "settle", lambda df: written.append(kept(df)) or written[-1])
    chain = [f"z{i:02d}" for i in range(16)]
    nodes = spark.createDataFrame([(c, 2.0 - i / 100) for i, c in enumerate(chain)], "node string, strength double")
    links = spark.createDataFrame([(a, b, 0.85) for a, b in zip(chain, chain[1:])], "left string, right string, near double")
    founded = T.founders(nodes, links)
    assert sum(r["node"] == r["founder"] for r in founded.collect()) == 8
    left = [w for w in written if w in session._SETTLED and Path(session._SETTLED[w]).exists()]
    assert len(written) > 25 and len(left) <= 5
