"""Near-duplicate vectors by an inverted multi-index.

The halves of the unit vectors have codebooks of their own; a pair of code
words is a cell of the product grid. A vector lives in its nearest cell and
visits cells in the order of the multi-sequence traversal, nearest first, as
many as it takes for ``recall`` of the neighbours at exactly the least cosine
to lie in them. Those neighbours are made from a sample, so the number doesn't
depend on how many near duplicates there are. What meets in a cell is verified
by cosine in double precision.

Equal vectors of a label are one node. Members and visitors of a cell are cut
into blocks of about ``BLOCK``, so a crowded cell is many tasks; a block gives
one row per vector, never one per pair. Codebooks are fitted on at most
``SAMPLE`` vectors; every vector is indexed.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undertone.llm import text as X
from undertone.llm.graph import components
from undertone.llm.tasks import group_arrow, map_arrow
from undertone.llm.vectors import matrix, usable
from undertone.session import settle

SAMPLE = 20_000
CELL = 128
WORDS = (4, 512)
BLOCK = 1024
RECALL = 0.995


def codebook(points: np.ndarray, words: int, seed: int) -> np.ndarray:
    """Code words by Lloyd's iterations from seeded points."""
    draw = np.random.default_rng(seed)
    book = points[draw.choice(len(points), min(words, len(points)), replace=False)].copy()
    for _ in range(12):
        near = nearest_distances(points, book).argmin(axis=1)
        for w in range(len(book)):
            mine = points[near == w]
            if len(mine):
                book[w] = mine.mean(axis=0)
    return book


def nearest_distances(points: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances of points (rows) to code words (columns)."""
    return (points**2).sum(axis=1)[:, None] - 2 * points @ book.T + (book**2).sum(axis=1)[None, :]


@dataclass
class Grid:
    """The two codebooks of vectors of one length, and how many cells a vector visits."""

    left: np.ndarray
    right: np.ndarray
    visits: int

    def traverse(self, units: np.ndarray, count: int) -> np.ndarray:
        """The first ``count`` cells of each unit vector in the order of their distance.

        The cell of the i-th and j-th nearest code words has (i + 1)(j + 1) cells at most as far away,
        itself included, so only those with a product of at most ``count`` can be among the first.
        """
        half = self.left.shape[1]
        d1, d2 = nearest_distances(units[:, :half], self.left), nearest_distances(units[:, half:], self.right)
        o1, o2 = np.argsort(d1, axis=1, kind="stable"), np.argsort(d2, axis=1, kind="stable")
        count = min(count, len(self.left) * len(self.right))
        steps = [
            (i, j) for i in range(min(count, len(self.left))) for j in range(min(count // (i + 1), len(self.right)))
        ]
        i, j = np.array([s[0] for s in steps]), np.array([s[1] for s in steps])
        a, b = o1[:, i], o2[:, j]
        far = np.take_along_axis(d1, a, axis=1) + np.take_along_axis(d2, b, axis=1)
        order = np.argsort(far, axis=1, kind="stable")[:, :count]
        return np.take_along_axis(a * len(self.right) + b, order, axis=1)


def fit_grid(sample: np.ndarray, words: int, least: float, recall: float) -> Grid:
    """Codebooks from the sample, and the number of visits that reaches ``recall`` at cosine ``least``."""
    half = sample.shape[1] // 2
    if half == 0:
        return Grid(np.zeros((1, 0)), codebook(sample, words, 1), words)
    grid = Grid(codebook(sample[:, :half], words, 1), codebook(sample[:, half:], words, 2), 1)
    cells = len(grid.left) * len(grid.right)
    draw = np.random.default_rng(3)
    units = sample[draw.choice(len(sample), min(2000, len(sample)), replace=False)]
    across = draw.normal(size=units.shape)
    across -= (across * units).sum(axis=1, keepdims=True) * units
    across /= np.maximum(np.linalg.norm(across, axis=1, keepdims=True), 1e-12)
    home = grid.traverse(least * units + math.sqrt(max(0.0, 1 - least**2)) * across, 1)
    order = grid.traverse(units, cells if cells <= 4096 else 4096)
    hit = order == home
    rank = np.where(hit.any(axis=1), hit.argmax(axis=1), order.shape[1])
    grid.visits = int(min(cells, np.quantile(rank, recall, method="higher") + 1))
    return grid


def _units(batches):
    """(id, label, length, node, unit) for usable vectors that are not zero; the others have no node."""
    for batch in batches:
        n = batch.num_rows
        node, length, unit = [None] * n, [0] * n, [None] * n
        labels = batch.column("label").to_pylist()
        for r, v in zip(*usable(batch.column("embedding"))):
            scale = np.abs(v).max()
            if scale == 0 or labels[r] is None:
                continue
            scaled = v / scale
            u = scaled / np.sqrt((scaled**2).sum())
            length[r], unit[r] = len(u), u.tobytes()
        kept = np.array([i for i in range(n) if unit[i] is not None], np.int64)
        if len(kept):
            data = np.frombuffer(b"".join(unit[i] + str(labels[i]).encode() for i in kept), np.uint8)
            sizes = np.array([len(unit[i]) + len(str(labels[i]).encode()) for i in kept])
            ends = np.cumsum(sizes)
            for i, h in zip(kept, X.byte_hashes(data, ends - sizes, ends).view(np.int64)):
                node[i] = int(h)
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("label"), pa.array(length, pa.int32()), pa.array(node, pa.int64()), pa.array(unit, pa.binary())],
            ["id", "label", "length", "node", "unit"],
        )


def _placed(batches, grids):
    """A row for each cell a node visits; the first is its home and carries all of them."""
    for batch in batches:
        length = batch.column("length").to_numpy()
        for size in np.unique(length):
            grid = grids.value[int(size)]
            rows = np.flatnonzero(length == size)
            taken = batch.take(pa.array(rows))
            cells = grid.traverse(matrix(taken.column("unit").to_pylist()), grid.visits).astype(np.int32)
            many, visits = cells.shape
            again = pa.array(np.repeat(np.arange(many), visits))
            lists = [c.tobytes() if v == 0 else None for c in cells for v in range(visits)]
            yield pa.RecordBatch.from_arrays(
                [*(taken.column(c).take(again) for c in ("label", "length", "node", "times", "unit")),
                 pa.array(cells.ravel()), pa.array(np.repeat(cells[:, 0], visits)), pa.array(lists, pa.binary())],
                ["label", "length", "node", "times", "unit", "cell", "home", "visits"],
            )


def _verified(least: float):
    """Links between the members and visitors of a block, as one row per vector.

    ``links`` counts the linked vectors on the other side. A visitor counts the members it is linked
    with; a member counts a visitor only if the member doesn't visit the visitor's home, where the
    pair is met again the other way round. ``root`` is a node that the links of the block lead to.
    """

    def run(key, table):
        node, times, home = (table.column(c).to_numpy() for c in ("node", "times", "home"))
        member = table.column("member").to_numpy(zero_copy_only=False)
        units = matrix(table.column("unit").to_pylist())
        m, p = np.flatnonzero(member), np.flatnonzero(~member)
        empty = pa.table({"node": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "root": pa.array([], pa.int64())})
        if not len(m) or not len(p):
            return empty
        near = (units[p] @ units[m].T >= least) & (node[p][:, None] != node[m][None, :])
        if not near.any():
            return empty
        visits = matrix([v for v, x in zip(table.column("visits").to_pylist(), member) if x], "<i4")
        met_again = np.zeros(near.shape, bool)
        for h in np.unique(home[p]):
            met_again[home[p] == h] = (visits == h).any(axis=1)[None, :]
        of_visitors = near @ times[m]
        of_members = (near & ~met_again).T @ times[p]
        # Least label over the links, until nothing changes.
        label_p, label_m = node[p].copy(), node[m].copy()
        top = np.iinfo(np.int64).max
        while True:
            fresh_m = np.minimum(label_m, np.where(near, label_p[:, None], top).min(axis=0))
            fresh_p = np.minimum(label_p, np.where(near, fresh_m[None, :], top).min(axis=1))
            if (fresh_m == label_m).all() and (fresh_p == label_p).all():
                break
            label_m, label_p = fresh_m, fresh_p
        some_p, some_m = near.any(axis=1), near.any(axis=0)
        return pa.table({
            "node": pa.array(np.concatenate([node[p][some_p], node[m][some_m]])),
            "links": pa.array(np.concatenate([of_visitors[some_p], of_members[some_m]]).astype(np.int64)),
            "root": pa.array(np.concatenate([label_p[some_p], label_m[some_m]])),
        })

    return run


def near_vectors(
    vectors: DataFrame, least: float = 0.93, recall: float = RECALL, key: str = "vec_id", embedding: str = "embedding", label: str = "label"
) -> DataFrame:
    """(key, n_links, component) for each row of ``vectors``.

    Rows of equal label are linked when their cosine is at least ``least``. Rows whose label is null,
    or whose vector is null, empty, zero or holds null or non-finite numbers, link with nothing;
    vectors of different length don't either. The component is the least key that links lead to.
    Other columns are ignored.
    """
    signed = settle(map_arrow(
        vectors.select(F.col(key).cast("long").alias("id"), F.col(label).cast("string").alias("label"), F.col(embedding).cast("array<double>").alias("embedding")),
        _units, "id long, label string, length int, node long, unit binary",
    ))
    nodes = settle(signed.filter("node is not null").groupBy("node").agg(
        F.min("label").alias("label"), F.min("length").alias("length"), F.min("unit").alias("unit"),
        F.min("id").alias("first"), F.count("*").alias("times"),
    ))
    grids = _fitted(nodes, least, recall)
    context = vectors.sparkSession.sparkContext
    sent = context.broadcast(grids)
    placed = settle(map_arrow(
        nodes.select("label", "length", "node", "times", "unit"), lambda b: _placed(b, sent),
        "label string, length int, node long, times long, unit binary, cell int, home int, visits binary",
    ))
    scope = ["label", "length", "cell"]
    sizes = placed.groupBy(*scope).agg(
        F.greatest(F.lit(1), F.ceil(F.count("visits") / BLOCK)).cast("int").alias("members"),
        F.ceil(F.count("*") / BLOCK).cast("int").alias("visitors"), F.count("visits").alias("n"),
    ).filter("n > 0")
    dealt = (
        placed.join(sizes, scope)
        # A vector at home is a member and a visitor of its cell.
        .withColumn("member", F.explode(F.expr("if(visits is null, array(false), array(false, true))")))
        .withColumn("mine", F.expr("cast(pmod(xxhash64(node, 3), if(member, members, visitors)) as int)"))
        .withColumn("other", F.explode(F.expr("sequence(0, if(member, visitors, members) - 1)")))
        .select(*scope, F.expr("if(member, mine, other)").alias("m"), F.expr("if(member, other, mine)").alias("v"),
                "node", "times", "unit", "home", "visits", "member")
    )
    found = settle(group_arrow(dealt, [*scope, "m", "v"], _verified(least), "node long, links long, root long"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(found.filter("node != root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    groups = nodes.select("node", "first", "times").join(links, "node", "left").join(joined, "node", "left").select(
        "node", "first", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("component", "node").alias("group")
    )
    least_key = groups.groupBy("group").agg(F.min("first").alias("component"))
    classes = groups.join(least_key, "group").select("node", "n_links", "component")
    return (
        signed.filter("node is not null").select("id", "node").join(classes, "node").select(F.col("id").alias("key"), "n_links", "component")
        .unionByName(signed.filter("node is null").select(F.col("id").alias("key"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component")))
    )


def _fitted(nodes: DataFrame, least: float, recall: float) -> dict[int, Grid]:
    """A grid for each vector length, from the ``SAMPLE`` nodes of that length whose hashes are least."""
    grids = {}
    for r in nodes.groupBy("length").agg(F.count("*").alias("n"), F.approx_count_distinct("label").alias("labels")).collect():
        mine = nodes.filter(F.col("length") == r["length"]).select("node", "unit")
        sample = mine.orderBy(F.xxhash64("node"), "node").limit(SAMPLE).toPandas().sort_values("node")
        words = int(np.clip(math.ceil(math.sqrt(r["n"] / max(1, r["labels"]) / CELL)), *WORDS))
        grids[r["length"]] = fit_grid(matrix(sample["unit"].tolist()), words, least, recall)
    return grids
