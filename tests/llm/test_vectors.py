"""Near-duplicate vectors and exact search against brute force."""

import numpy as np
import pytest

from tests.llm import brute
from undertone.llm import multi_index as M
from undertone.llm.queries import QUERIES
from undertone.llm.vafile import scaled, top_products

SCHEMA = "vec_id long, embedding array<float>, label int, node string, id int"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], c, "x", 1) for i, v, c in rows], SCHEMA)


def linked(rows, least):
    """(links of each id, class of each id) for usable vectors."""
    ids = [i for i, _, _ in rows]
    units = [np.array(v, np.float32).astype(float) for _, v, _ in rows]
    units = [u / np.linalg.norm(u) for u in units]
    pairs = [(a, b) for a in range(len(rows)) for b in range(a + 1, len(rows)) if rows[a][2] == rows[b][2] and units[a] @ units[b] >= least]
    counts = dict.fromkeys(ids, 0)
    for a, b in pairs:
        counts[ids[a]] += 1
        counts[ids[b]] += 1
    return counts, brute.classes(ids, [(ids[a], ids[b]) for a, b in pairs])


def clustered(n, seed, spread):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(n // 12, 32))
    return [(i, centres[i % len(centres)] + draw.normal(size=32) * spread * draw.random(), int(draw.integers(0, 3))) for i in range(n)]


@pytest.mark.parametrize("spread", [0.2, 0.5])
def test_recall(spark, spread):
    rows = clustered(1500, 4, spread)
    counts, classes = linked(rows, 0.93)
    found = {r["key"]: r for r in M.near_vectors(table(spark, rows)).collect()}
    assert all(found[i]["n_links"] <= counts[i] for i in counts)
    assert sum(r["n_links"] for r in found.values()) >= 0.97 * sum(counts.values()) > 0
    assert np.mean([found[i]["component"] == classes[i] for i in classes]) > 0.97


def test_blocks_count_each_pair_once(spark, monkeypatch):
    """One crowded cell in several blocks: all pairs are linked, none counted twice."""
    draw = np.random.default_rng(2)
    centre = draw.normal(size=16)
    rows = [(i, centre + 0.02 * draw.normal(size=16), 1) for i in range(300)]
    monkeypatch.setattr(M, "BLOCK", 64)
    counts, _ = linked(rows, 0.93)
    assert set(counts.values()) == {299}
    found = M.near_vectors(table(spark, rows)).collect()
    assert {(r["n_links"], r["component"]) for r in found} == {(299, 0)}


def test_traversal_is_in_order():
    draw = np.random.default_rng(6)
    grid = M.Grid(draw.normal(size=(9, 4)), draw.normal(size=(7, 4)), 1)
    points = draw.normal(size=(50, 8))
    far = M.nearest_distances(points[:, :4], grid.left)[:, :, None] + M.nearest_distances(points[:, 4:], grid.right)[:, None, :]
    for count in (1, 5, 20, 63):
        assert (grid.traverse(points, count) == np.argsort(far.reshape(50, -1), axis=1)[:, :count]).all()


def test_awkward_vectors(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, v, 1), (2, v, 1), (3, v, None), (4, None, 1), (5, [], 1), (6, [0.0] * 3, 1), (7, [1.0, None, 2.0], 1),
            (8, [float("nan")] * 3, 1), (9, [float("inf"), 1, 1], 1), (10, [1.0, 2.0], 1), (11, v, 2), (12, [2.0, 4.0, 6.0], 1), (1, v, 1), (None, v, 2)]
    found = sorted(((r["key"] or 0, r["n_links"], r["component"]) for r in M.near_vectors(table(spark, rows)).collect()))
    alone = [(i, 0, i) for i in (3, 4, 5, 6, 7, 8, 9, 10)]
    assert found == sorted([(1, 3, 1), (1, 3, 1), (2, 3, 1), (12, 3, 1), (11, 1, 11), (0, 1, 11), *alone])
    assert M.near_vectors(table(spark, rows).limit(0)).count() == 0


def test_dedup_query(spark, sf):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    counts, classes = linked(rows, 0.93)
    found = {r["vec_id"]: r for r in QUERIES["op2_embedding_dedup"](spark, sf).collect()}
    assert {i: r["n_links"] for i, r in found.items()} == counts
    assert {i: r["component_id"] for i, r in found.items()} == classes


def best(rows, queries, k):
    good = [(i, scaled(np.array(v, np.float32).astype(float))) for i, v in rows]
    expected = []
    for q, w in good:
        if q in queries:
            scores = sorted((-int(v.astype(object) @ w.astype(object)), i) for i, v in good if i != q and len(v) == len(w))
            expected += [(q, n, i, -s) for n, (s, i) in enumerate(scores[:k], 1)]
    return sorted(expected)


@pytest.mark.parametrize("size, high", [(12, 1.0), (3, 1e6), (5, 0.004)])
def test_search(spark, size, high):
    """Many ties and, in the second case, large numbers."""
    draw = np.random.default_rng(size)
    rows = [(i, (draw.integers(-6, 7, size) / 6 * high)) for i in range(600)]
    vectors = table(spark, [(i, v, 1) for i, v in rows])
    found = top_products(vectors, vectors.filter("vec_id % 50 = 0"), k=5)
    assert sorted(map(tuple, found.collect())) == best(rows, set(range(0, 600, 50)), 5)


def test_queries_that_share_a_key_all_get_answers(spark):
    vectors = table(spark, [(1, [1, 0], 1), (2, [0, 1], 1), (3, [-1, -1], 1)])
    queries = table(spark, [(7, [1, 0], 1), (7, [0, 1], 1), (7, [0, 1], 1), (2, [0, 1], 1)])
    found = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"] // 65536) for r in top_products(vectors, queries, k=1).collect())
    assert found == [(2, 1, 1, 0), (7, 1, 1, 1), (7, 1, 2, 1), (7, 1, 2, 1)]


def test_search_awkward(spark):
    rows = [(0, [1, 0], 1), (50, [1, 0], 1), (1, [1, 0], 1), (2, None, 1), (3, [1, None], 1), (4, [float("inf"), 1], 1), (None, [1, 0], 1), (5, [1, 2, 3], 1), (100, [1, 2, 4], 1), (150, [], 1)]
    vectors = table(spark, rows)
    found = sorted(map(tuple, top_products(vectors, vectors.filter("vec_id % 50 = 0"), k=5).collect()))
    assert found == [(0, 1, 1, 65536), (0, 2, 50, 65536), (50, 1, 0, 65536), (50, 2, 1, 65536), (100, 1, 5, 256 * 256 * 17)]
    assert top_products(vectors.limit(0), vectors.limit(0)).count() == 0
