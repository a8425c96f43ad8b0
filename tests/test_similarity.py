"""Linking and components against brute force."""

import hashlib
import itertools
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from undertone.functions import tokens as TK
from undertone.operators import clusters as C
from undertone.operators import similarity
from undertone.operators.similarity import components, least_jaccard, least_share, similar_links, similar_pairs
from undertone.operators.threads import follow, thread_structure


def brute_components(nodes, edges):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = root(a), root(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
    return {n: root(n) for n in nodes}


def test_components_match_union_find(spark):
    rng = random.Random(7)
    names = [f"n{i:03d}" for i in range(120)]
    edges = [(rng.choice(names), rng.choice(names)) for _ in range(70)] + [
        (names[i], names[i + 1]) for i in range(100, 119)
    ]
    edges = [(a, b) for a, b in edges if a != b]
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "left STRING, right STRING")).collect()}
    touched = {n for e in edges for n in e}
    assert found == {n: c for n, c in brute_components(touched, edges).items()}


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "left STRING, right STRING")).count() == 0


def _similar(a, b):
    shared = len(set(a) & set(b))
    return (shared / math.sqrt(len(a) * len(b)) + shared / (len(a) + len(b) - shared)) / 2


def _texts(rng, n):
    """Texts of Zipf-distributed words, some of them near copies of others."""
    weights = [1 / (i + 1) for i in range(400)]
    words = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(n):
        if texts and rng.random() < 0.4:
            said = list(rng.choice(texts))
            said[rng.randrange(len(said))] = rng.choice(words)
        else:
            said = rng.choices(words, weights, k=rng.randint(1, 9))
        texts.append(sorted(set(said)))
    return texts


def test_links_join_all_similar_texts(spark):
    rng = random.Random(3)
    rows = [(f"s{i % 2}", f"t{i:04d}", said, rng.random()) for i, said in enumerate(_texts(rng, 2400))]
    df = spark.createDataFrame(rows, "scope STRING, node STRING, tokens ARRAY<STRING>, weight DOUBLE")
    edges = [
        (a[1], b[1]) for i, a in enumerate(rows) for b in rows[i + 1 :]
        if a[0] == b[0] and not set(a[2]).isdisjoint(b[2]) and _similar(a[2], b[2]) >= 0.45
    ]
    links = similar_links(df, ["scope"], 0.45, 0.3)
    found = {r.node: r.component for r in components(links).collect()}
    assert len(edges) > 5000
    assert found == brute_components({n for e in edges for n in e}, edges)
    assert {(r.left, r.right) for r in links.collect()} <= {e for a, b in edges for e in ((a, b), (b, a))}


def test_a_louder_text_does_not_part_two_similar_ones(spark):
    rows = [("s", "a", ["one", "two", "three", "four"], 1.0), ("s", "b", ["one", "two", "three", "five"], 1.0)]
    rows += [("s", w, [w], 9.0) for w in ("one", "two", "three", "four", "five")]
    df = spark.createDataFrame(rows, "scope STRING, node STRING, tokens ARRAY<STRING>, weight DOUBLE")
    found = {r.node: r.component for r in components(similar_links(df, ["scope"], 0.45, 0.3)).collect()}
    assert found["a"] == found["b"]


def test_hot_group_costs_one_comparison_per_text(spark):
    """A group of near copies gives a few links per text, not all pairs."""
    df = spark.range(500).select(
        F.lit("s").alias("scope"), F.col("id").cast("string").alias("node"),
        F.array(F.lit("same"), F.lit("words"), (F.col("id") % 3).cast("string")).alias("tokens"),
        F.col("id").cast("double").alias("weight"),
    )
    assert similar_links(df, ["scope"], 0.45, 0.3).count() <= 500 * 3


def test_hash_vector(spark):
    row = spark.sql("SELECT array('pan', 'steak', 'pan') AS t, CAST(array() AS ARRAY<STRING>) AS e").select(
        TK.hash_vector(F.col("t")).alias("v"), TK.hash_vector(F.col("e")).alias("z")
    ).first()
    want = [0.0] * 64
    for w in ("pan", "steak", "pan"):
        want[int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 64] += 1
    norm = math.sqrt(sum(x * x for x in want))
    assert all(abs(a - b / norm) < 1e-6 for a, b in zip(row.v, want))
    assert row.z == [0.0] * 64


def test_follow_a_long_chain(spark):
    links = [("s", f"n{i}", f"n{i - 1}") for i in range(1, 40)]
    rows = follow(spark.createDataFrame(links, "scope STRING, node STRING, target STRING")).collect()
    assert all(r.target == "n0" and r.hops == int(r.node[1:]) for r in rows)


def test_follow_a_chain_of_thousands(spark):
    links = [("s", f"n{i}", f"n{i - 1}") for i in range(1, 5000)]
    rows = follow(spark.createDataFrame(links, "scope STRING, node STRING, target STRING")).collect()
    assert len(rows) == 4999 and all(r.target == "n0" and r.hops == int(r.node[1:]) and not r.cut for r in rows)


def test_cycles_end_at_their_least_comment(spark):
    parents = {"a": "c", "b": "a", "c": "b", "d": "b", "e": "d", "self": "self", "x": None, "y": "x"}
    df = spark.createDataFrame([("v", k, p) for k, p in parents.items()], "content_id STRING, comment_id STRING, parent_comment_id STRING")
    rows = {r.comment_id: (r.thread_root_id, r.depth, r.cycle_cut) for r in thread_structure(df).collect()}
    assert rows == {
        "a": ("a", 0, True), "b": ("a", 1, False), "c": ("a", 2, False), "d": ("a", 2, False), "e": ("a", 3, False),
        "self": ("self", 0, True), "x": ("x", 0, False), "y": ("x", 1, False),
    }


def test_orphans_become_roots(spark):
    df = spark.createDataFrame(
        [("c", "a", None), ("c", "b", "a"), ("c", "x", "gone"), ("c", "y", "x")],
        "content_id STRING, comment_id STRING, parent_comment_id STRING",
    )
    rows = {r.comment_id: (r.thread_root_id, r.depth) for r in thread_structure(df).collect()}
    assert rows == {"a": ("a", 0), "b": ("a", 1), "x": ("x", 0), "y": ("x", 1)}


def test_split_and_merge_against_all_pairs(spark):
    """Parts by anchor and intent, joined by the cosine of their word counts, as plain loops find them."""
    draw = random.Random(11)
    rows = []
    for i in range(160):
        words = [f"w{int(draw.expovariate(0.25))}" for _ in range(draw.randint(0, 5))]
        anchors = [] if i % 9 == 0 else [f"a{i % 2}"]
        rows.append((f"u{i:03}", f"k{draw.randint(0, 40):02}", f"v{i % 2}", "x", "opinion", "positive", anchors, draw.choice(["feedback", "advice"]),
                     sorted(set(words)), float(i % 7)))
    rows.append(rows[5])  # the same unit twice
    schema = ("unit_id string, cluster_key string, video_id string, aspect_key string, cluster_type string, stance string, "
              "anchor_ids array<string>, intent string, tokens array<string>, engagement_score double")
    members = spark.createDataFrame([(u, f"{k}{v}", v, *rest) for u, k, v, *rest in rows], schema)
    for least in (0.3, C.MERGE_FROM, 0.8):
        parts = C.split_clusters(members)
        found = {r["unit_id"]: r["cluster_key"] for r in C.merge_by_vocabulary(parts, least).collect()}
        counts, scope = {}, {}
        for u, k, v, _, _, _, anchors, intent, tokens, _ in rows:
            part = (k, v, anchors[0] if anchors else "", intent)
            scope[u] = part
            counts.setdefault(part, Counter()).update(tokens)
        parent = {p: p for p in counts}

        def root(p):
            while parent[p] != p:
                p = parent[p]
            return p

        for a, b in itertools.combinations(counts, 2):
            norms = sum(n * n for n in counts[a].values()) * sum(n * n for n in counts[b].values())
            product = sum(n * counts[b][w] for w, n in counts[a].items())
            if a[1:] == b[1:] and norms and product / math.sqrt(norms) >= least:
                parent[root(a)] = root(b)
        groups, expected = {}, {}
        for u, key in found.items():
            groups.setdefault(key, set()).add(u)
        for u, part in scope.items():
            expected.setdefault(root(part), set()).add(u)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))
    assert C.merge_by_vocabulary(C.split_clusters(members.limit(0))).count() == 0


def test_pairs_are_confirmed_where_they_meet(spark):
    """300 texts that share common words but are all apart: no unconfirmed pair is shuffled, so few rows move."""
    rng = random.Random(5)
    rows = [("s", f"n{i:03d}", sorted({f"r{i}", f"r{i}b", f"r{i}c", *(f"k{rng.randrange(6)}" for _ in range(3))}), 1.0) for i in range(300)]
    df = spark.createDataFrame(rows, "scope string, node string, tokens array<string>, weight double")
    prefixed = similarity.prefixes(df, ["scope"], 0.3)
    asked = []

    def near(pairs):
        asked.append(pairs.count())
        return pairs.filter("false")

    def apart(rows):
        asked.append(rows.count())
        return rows.select(F.col("node").alias("left"), F.col("node").alias("right")).filter("false")

    assert similarity.joined_links(prefixed, near, apart).count() == 0
    assert max(asked) <= prefixed.count()
    assert similar_links(df, ["scope"], 0.45, 0.3).count() == 0


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_links_between_different_components_are_all_found(spark, seed):
    """Sizes differ much, so the bound on what is left after the first common token is met exactly at times."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    sets = {f"n{i:03d}": sorted(set(rng.choices(words, k=rng.choice([1, 2, 3, 4, 8, 12])))) for i in range(150)}
    df = spark.createDataFrame([("s", n, t, rng.random()) for n, t in sets.items()] + [(None, f"z{n}", t, 1.0) for n, t in sets.items()],
                               "scope string, node string, tokens array<string>, weight double")
    near = [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if _similar(sets[a], sets[b]) >= 0.75]
    expected = {n: c for n, c in brute_components({n for e in near for n in e}, near).items()}
    assert {r.node: r.component for r in components(similar_links(df, ["scope"], 0.75, 0.6)).collect()} == expected


def test_links_are_made_of_numbers(spark, monkeypatch):
    """What the groups of common words deal out are numbers; long names of nodes and spellings of words stay behind."""
    seen, joined = [], similarity.joined_links
    monkeypatch.setattr(similarity, "joined_links", lambda prefixed, *a: seen.append(dict(prefixed.dtypes)) or joined(prefixed, *a))
    rng = random.Random(9)
    rows = [(f"u{i}", f"v{i % 3}" if i % 10 else None, [f"w{rng.randrange(12)}", f"x{rng.randrange(4)}"], float(i % 5)) for i in range(120)]
    units = spark.createDataFrame(rows, "unit_id string, video_id string, tokens array<string>, engagement_score double").selectExpr(
        "*", "'a' AS aspect_key", "'opinion' AS cluster_type", "'mixed' AS stance", "'n' AS normalized_text", "array('a1') AS anchor_ids", "'advice' AS intent"
    )
    members = C.assign_clusters(units)
    assert C.merge_by_vocabulary(C.split_clusters(members)).count() == 120
    C.assign_clusters_by_mean(units.limit(4))
    assert len(seen) >= 3
    assert all(s["node"] == "bigint" and s["token"] == "bigint" for s in seen)
    # A cluster is named after the least name of its nodes, as if the names themselves had been compared.
    names = {r.unit_id: (r.video_id, tuple(sorted(r.tokens))) for r in units.collect()}
    md5 = {u: hashlib.md5("\x01".join([*([v] if v else []), "a", "opinion", "mixed", " ".join(t)]).encode()).hexdigest() for u, (v, t) in names.items()}
    sets = {md5[u]: (v, t) for u, (v, t) in names.items()}
    near = [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a][0] and sets[a][0] == sets[b][0] and _similar(sets[a][1], sets[b][1]) >= C.LINK_FROM]
    expected = brute_components(sets, near)
    assert {r.unit_id: r.cluster_key for r in members.collect()} == {u: expected[m] for u, m in md5.items()}


@pytest.mark.parametrize("threshold", [0.3, 0.45, 0.8])
def test_bounds_of_similar_sets(threshold):
    """No pair of sizes and no overlap that is similar lies below the bounds."""
    for a, b in itertools.combinations_with_replacement(range(1, 60), 2):
        for shared in range(1, a + 1):
            if (shared / math.sqrt(a * b) + shared / (a + b - shared)) / 2 >= threshold:
                assert shared / (a + b - shared) >= least_jaccard(threshold) - 1e-9 and shared / a >= least_share(threshold) - 1e-9


def test_a_short_text_inside_a_long_one_is_linked(spark):
    """Two of eleven words: similarity 0.304, Jaccard similarity 0.18, below the 0.2 given."""
    rows = [("long", [f"w{i}" for i in range(11)], 1.0), ("short", ["w3", "w8"], 1.0)]
    df = spark.createDataFrame(rows, "node STRING, tokens ARRAY<STRING>, weight DOUBLE")
    for found in (similar_links(df, [], 0.3, 0.2).distinct(), similar_pairs(df, [], 0.3)):
        assert [set(r) for r in found.collect()] == [{"long", "short"}]


@pytest.mark.parametrize("threshold, block", [(0.3, 7), (0.3, 2000), (0.45, 2000)])
def test_all_similar_pairs_are_found(spark, monkeypatch, threshold, block):
    """Every pair of a scope, also those that links of others connect; groups cut in blocks or not."""
    monkeypatch.setattr(similarity, "BLOCK", block)
    rng = random.Random(5)
    texts = {f"n{i:03d}": (rng.choice(["a", "b", None]), t) for i, t in enumerate(_texts(rng, 250))}
    rows = [(n, s, list(t), 1.0) for n, (s, t) in texts.items()] + [("none", "a", [], 1.0)]
    df = spark.createDataFrame(rows, "node STRING, s STRING, tokens ARRAY<STRING>, weight DOUBLE")
    found = [tuple(r) for r in similar_pairs(df, ["s"], threshold).collect()]
    expected = {
        (x, y) for x, y in itertools.combinations(sorted(texts), 2)
        if texts[x][0] is not None and texts[x][0] == texts[y][0] and _similar(texts[x][1], texts[y][1]) >= threshold
    }
    assert len(found) == len(set(found)) and set(found) == expected
    links = {tuple(sorted(r)) for r in similar_links(df, ["s"], threshold, 0.2).collect()}
    assert links < expected


def test_components_of_many_rounds_keep_their_plans_small(spark, monkeypatch):
    """What a round knows of its columns is not handed on, so it doesn't grow with the rounds."""
    plans = []
    kept = similarity.settle
    monkeypatch.setattr(similarity, "settle", lambda df: plans.append(df) or kept(df))
    chain = [f"n{(i * 37) % 101:03d}" for i in range(101)]
    links = spark.createDataFrame(list(zip(chain, chain[1:])), "left STRING, right STRING")
    assert {r.component for r in components(links).collect()} == {"n000"}
    rounds = [p._jdf.queryExecution().analyzed().toString().count("Relation") for p in plans[2:]]
    assert len(rounds) > 4 and set(rounds) == {4}
