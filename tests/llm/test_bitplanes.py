"""Clustering with bit planes against plain integer arithmetic."""

import hashlib

import duckdb
import numpy as np
import pytest

from undertone.llm import bitplanes as B
from undertone.llm.queries import ORACLES, QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int, key int, planes string"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, 2, "x") for i, v in rows], SCHEMA)


def plain_version(rows, k, rounds, seed=2):
    """(rows of (id, cluster, distance), centroids) by Python integers."""
    kept = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v in rows
            if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest())
    centroids = [list(v) for _, v in order[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        members = {}
        for _, v in kept:
            members.setdefault(nearest(v)[1], []).append(v)
        for c, vs in members.items():
            centroids[c] = [sum(column) // len(vs) for column in zip(*vs)]
    return sorted((i, nearest(v)[1], nearest(v)[0]) for i, v in kept), centroids


@pytest.mark.parametrize("reach", [1, 2, 130, 5000, 1 << 27])
def test_planes(reach):
    draw = np.random.default_rng(reach)
    a, b = draw.integers(-reach, reach, (50, 64)), draw.integers(-reach // 2 - 1, reach + 1, (7, 64))
    pa, pb = B.pack(a), B.pack(b)
    assert (B.unpack(pa) == a).all() and (B.unpack(pb) == b).all()
    assert (B.products(pa, pb) == a @ b.T).all() and (B.squares(pa) == (a * a).sum(axis=1)).all()
    number, distance = B.nearest(pa, pb)
    exact = ((a[:, None, :] - b[None]) ** 2).sum(axis=2)
    assert (number == exact.argmin(axis=1)).all() and (distance == exact.min(axis=1)).all()


def test_edges_of_the_planes():
    a = np.zeros((4, 64), np.int64)
    a[1], a[2], a[3, ::2] = -1, -256, 255
    assert B.pack(a).shape == (4, 9) and (B.unpack(B.pack(a)) == a).all()
    assert B.pack(a[:2]).shape == (2, 1) and (B.unpack(B.pack(a[:2])) == a[:2]).all()
    assert B.nearest(B.pack(a), B.pack(a[[2, 2, 1, 1]]))[0].tolist() == [2, 2, 0, 2]
    far = B.integers([np.full(64, 1e300), np.full(64, -1e300)])
    assert (np.abs(far) == B.LIMIT).all()
    assert B.nearest(B.pack(far[:1]), B.pack(far[1:]))[1].tolist() == [64 * (2 * B.LIMIT) ** 2]


@pytest.mark.parametrize("k, rounds, spread", [(5, 4, 0.3), (12, 5, 3.0), (3, 0, 1.0)])
def test_clusters(spark, k, rounds, spread):
    draw = np.random.default_rng(k)
    rows = [(int(i), v.tolist()) for i, v in zip(draw.permutation(200), draw.normal(0, spread, (200, 64)).astype(np.float32))]
    rows += [(1000 + n, rows[n][1]) for n in range(30)]
    assigned, centroids = B.cluster_vectors(table(spark, rows).repartition(5), k=k, rounds=rounds)
    expected, means = plain_version(rows, k, rounds)
    assert sorted(map(tuple, assigned.collect())) == expected
    assert centroids.tolist() == means


def test_awkward(spark):
    one, two = [0.5] * 64, [-0.25] * 64
    rows = [(1, one), (1, one), (2, two), (None, one), (3, None), (4, one[:63]), (5, one + [1]), (6, one[:63] + [None]),
            (7, one[:63] + [float("nan")]), (8, one[:63] + [float("inf")]), (9, []), (10, two[:63] + [300.0]), (1, two)]
    found, centroids = B.cluster_vectors(table(spark, rows), k=40)
    whole = B.with_inertia(found, centroids).collect()
    assert len(centroids) == 6 and len(whole) == 6
    assert {r["key"] for r in whole} == {1, 2, 10, None} and all(r["distance"] == 0 == r["inertia"] for r in whole)
    assert len({r["cluster"] for r in whole}) == 3  # equal centroids: the smaller number takes all
    found, centroids = B.cluster_vectors(table(spark, rows).limit(0), k=40)
    assert len(centroids) == 0 and B.with_inertia(found, centroids).count() == 0


def test_query(spark, sf):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    found = QUERIES["op13_centroid_clustering"](spark, sf)
    rows = db.execute(f"SELECT {', '.join(found.columns)} FROM ({ORACLES['op13_centroid_clustering']})").fetchall()
    assert sorted(map(tuple, found.collect())) == sorted(rows)
