"""Near duplicates by MinHash bands and sequential Bayesian verification.

Documents with the same shingle set are one node from the start. Nodes meet in
bands of their signatures. Candidates are compared signature batch by
signature batch; one whose posterior chance of reaching the threshold falls
below ``miss`` is dropped, and every survivor is confirmed on the full sets.

Groups of copies are not paired up. Each bucket first compares all members with
one leader only; what that joins needs no more comparing. Only buckets that
still hold several components compare members across them, in blocks of
``BLOCK`` rows, and a block gives only links that join what was not joined.
Every pair of different components is tested, so the components are those of
all links found by the bands.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undertone.llm import text as X
from undertone.llm.graph import components
from undertone.llm.tasks import group_arrow, map_arrow
from undertone.session import settle

BANDS, ROWS = 25, 5
HASHES = 128
BATCHES = (16, 32, 64, 128)
BLOCK = 512

_R = np.random.default_rng(8191)
_MULTIPLY = _R.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _R.integers(0, 1 << 63, HASHES, dtype=np.uint64)


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, k: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, sorted distinct shingle hashes of each row) for runs of rows.

    A text of fewer than ``k`` words has its whole word sequence as only shingle, one without
    words has none.
    """
    for i, j in X.chunks(offsets):
        words = X.Words(raw, offsets, i, j, lower=True)
        hashes = words.hashes()
        grams = X.window_hashes(hashes, k)
        sets = []
        for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
            sets.append(np.unique(grams[a : b - k + 1] if b - a >= k else X.window_hashes(hashes[a:b], max(1, b - a))))
        yield i, sets


def signature(hashes: np.ndarray) -> np.ndarray:
    """The low 16 bits of the least value of each hash function."""
    low = np.full(HASHES, np.uint64(0xFFFFFFFFFFFFFFFF))
    for at in range(0, len(hashes), 4096):
        part = hashes[at : at + 4096]
        values = part[None, :] * _MULTIPLY[:, None] + _ADD[:, None]
        low = np.minimum(low, (values ^ (values >> np.uint64(32))).min(axis=1))
    return (X.mix(low) & np.uint64(0xFFFF)).astype(np.uint16)


def set_key(hashes: np.ndarray) -> np.uint64:
    """One 64-bit value for a set; equal sets agree, others by chance only."""
    with np.errstate(over="ignore"):
        return X.mix(np.array([X.mix(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum() + np.uint64(len(hashes))], np.uint64))[0]


def signed_documents(docs: DataFrame, k: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(row, key, n_shingles, node, sig) for each document; node and sig are null for empty sets.

    ``row`` is a hash of key and text: rows that agree in both are one document repeated.
    """

    def run(batches):
        for batch in batches:
            raw, offsets = X.buffer_of(batch.column("text"))
            sizes, nodes, sigs = [], [], []
            for _, sets in shingle_sets(raw, offsets, k):
                for s in sets:
                    sizes.append(len(s))
                    nodes.append(int(set_key(s).view(np.int64)) if len(s) else None)
                    sigs.append(signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("key"), pa.array(sizes, pa.int64()),
                 pa.array(nodes, pa.int64()), pa.array(sigs, pa.binary())],
                ["row", "key", "n_shingles", "node", "sig"],
            )

    rows = docs.select(
        F.xxhash64(F.col(key), F.col(text)).alias("row"), F.col(key).cast("long").alias("key"),
        F.col(text).cast("string").alias("text"),
    )
    return map_arrow(rows, run, "row long, key long, n_shingles long, node long, sig binary")


@lru_cache
def least_matches(num: int, den: int, miss: float) -> tuple[int, ...]:
    """For each batch end n the fewest matches m with P[S >= num/den | m of n] >= miss.

    The prior of the similarity S is uniform. The chance follows by numeric integration
    over S on a fine grid.
    """
    grid = (np.arange(20000) + 0.5) / 20000
    above = grid >= num / den - 1e-9
    least = []
    for n in BATCHES:
        for m in range(n + 1):
            log = m * np.log(grid) + (n - m) * np.log1p(-grid)
            weight = np.exp(log - log.max())
            if weight[above].sum() / weight.sum() >= miss:
                break
        least.append(m)
    return tuple(least)


def survivors(left: np.ndarray, right: np.ndarray, num: int, den: int, miss: float) -> np.ndarray:
    """Numbers of the pairs (rows of ``left`` and ``right`` signatures) that no batch prunes."""
    alive = np.arange(len(left))
    matched = np.zeros(len(left), np.int64)
    begun = 0
    for end, least in zip(BATCHES, least_matches(num, den, miss)):
        matched[alive] += (left[alive, begun:end] == right[alive, begun:end]).sum(axis=1)
        alive = alive[matched[alive] >= least]
        begun = end
    return alive


def _signatures(column: pa.Array) -> np.ndarray:
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), np.uint16).reshape(len(values), HASHES)


def linked(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    """Whether ``den`` * intersection >= ``num`` * union of two sorted sets."""
    if den * min(len(a), len(b)) < num * max(len(a), len(b)):
        return False
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return den * both >= num * (len(a) + len(b) - both)


def _similar(batches, num: int, den: int):
    """Keep the pairs whose full sets reach the threshold."""
    for batch in batches:
        # The sets are read where they lie, without a copy.
        pairs = zip(batch.column("left_set"), batch.column("right_set"))
        mask = pa.array(
            [linked(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), num, den) for x, y in pairs], pa.bool_()
        )
        yield pa.RecordBatch.from_arrays(
            [batch.column("a").filter(mask), batch.column("b").filter(mask)], ["a", "b"]
        )


def _pruned(pairs: DataFrame, nodes: DataFrame, num: int, den: int, miss: float) -> DataFrame:
    """The pairs (a, b) that sequential comparison of signatures leaves."""

    def run(batches):
        for batch in batches:
            alive = pa.array(
                survivors(_signatures(batch.column("left")), _signatures(batch.column("right")), num, den, miss)
                if batch.num_rows else np.zeros(0, np.int64)
            )
            yield pa.RecordBatch.from_arrays([batch.column("a").take(alive), batch.column("b").take(alive)], ["a", "b"])

    both = (
        pairs.join(nodes.select(F.col("node").alias("a"), F.col("sig").alias("left")), "a")
        .join(nodes.select(F.col("node").alias("b"), F.col("sig").alias("right")), "b")
        .select("a", "b", "left", "right")
    )
    return map_arrow(both, run, "a long, b long")


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    both = (
        pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("left_set")), "a")
        .join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("right_set")), "b")
        .select("a", "b", "left_set", "right_set")
    )
    return map_arrow(both, lambda batches: _similar(batches, num, den), "a long, b long")


def _across(num: int, den: int, miss: float):
    """Within one block pair of a bucket: links that join different components, a spanning set of them.

    A pair that an earlier band brings together belongs to that band; pairs with the leader were
    compared before. Pairs within what is joined already need no comparing.
    """

    def run(key, table):
        node, label, part, leader = (table.column(c).to_numpy() for c in ("node", "label", "part", "leader"))
        label = label.copy()
        band = int(table.column("band")[0].as_py())
        low, high = key[2].as_py(), key[3].as_py()
        sig = _signatures(table.column("sig").combine_chunks())
        sets = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
        rows, cols = np.flatnonzero(part == low), np.flatnonzero(part == high)
        a, b = [], []
        for i in rows:
            others = cols[(label[cols] != label[i]) & (leader[cols] != node[i]) & (node[cols] != leader[i])]
            if low == high:
                others = others[node[others] > node[i]]
            if band and len(others):
                same = (sig[i] == sig[others])[:, : band * ROWS].reshape(len(others), band, ROWS).all(axis=2).any(axis=1)
                others = others[~same]
            if not len(others):
                continue
            others = others[survivors(np.broadcast_to(sig[i], (len(others), HASHES)), sig[others], num, den, miss)]
            for j in others[np.argsort(-(sig[i] == sig[others]).sum(axis=1), kind="stable")]:
                if label[j] != label[i] and linked(sets[i], sets[j], num, den):
                    a.append(min(node[i], node[j]))
                    b.append(max(node[i], node[j]))
                    label[label == label[j]] = label[i]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def near_duplicates(
    docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, miss: float = 1e-4,
    text: str = "text", key: str = "doc_id",
) -> DataFrame:
    """(row, key, n_shingles, component) for each document, ``component`` the least key of its class.

    See ``near_classes``.
    """
    return near_classes(docs, k, num, den, miss, text, key).drop("class")


def near_classes(
    docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, miss: float = 1e-4,
    text: str = "text", key: str = "doc_id",
) -> DataFrame:
    """(row, key, n_shingles, component, class) for each document, ``component`` the least key of its class.

    ``class`` tells classes apart whose least keys are equal or null; it is null for documents that link with nothing
    by definition. Documents are linked when ``den`` * intersection >= ``num`` * union of their shingle sets.
    Empty or null texts link with nothing and are their own component (their key). A null key
    sorts above every other; a class of null keys only has a null component. Repeated rows come
    back repeated. Other columns of ``docs`` are ignored.
    """
    signed = settle(signed_documents(docs, k, text, key))
    nodes = settle(
        signed.filter("node is not null").groupBy("node").agg(
            F.min("key").alias("first"), F.min("row").alias("row"), F.min("sig").alias("sig"), F.min("n_shingles").alias("n")
        )
    )
    bands = nodes.select(
        "node",
        F.posexplode(F.expr(
            f"transform(sequence(0, {BANDS - 1}), b -> xxhash64(substring(sig, b * {2 * ROWS} + 1, {2 * ROWS}), b))"
        )).alias("band", "bucket"),
    )
    counts = bands.groupBy("bucket").agg(F.count("*").alias("members")).filter("members > 1")
    crowded = settle(bands.join(counts, "bucket"))
    # Who shares most buckets stands in the middle of its group and leads.
    weights = crowded.groupBy("node").agg(F.sum("members").alias("weight"))
    weighed = settle(crowded.join(weights, "node"))
    leaders = weighed.groupBy("bucket").agg(F.max(F.struct("weight", "node"))["node"].alias("leader"))
    met = settle(weighed.drop("weight").join(leaders, "bucket"))
    needed = met.select("node").distinct().join(nodes.select("node", "row"), "node")
    wanted = (
        docs.select(F.xxhash64(F.col(key), F.col(text)).alias("row"), F.col(text).cast("string").alias("text"))
        .join(needed, "row").dropDuplicates(["row"]).select("node", "text")
    )
    sets = settle(map_arrow(wanted, lambda batches: _sets_of(batches, k), "node long, shingles binary"))
    pairs = met.filter("node != leader").select(F.least("leader", "node").alias("a"), F.greatest("leader", "node").alias("b")).distinct()
    first = settle(_verified(_pruned(pairs, nodes, num, den, miss), sets, num, den))
    labels = components(first)
    labelled = settle(
        met.join(labels, "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component")
    )
    mixed = labelled.groupBy("bucket").agg(F.min("label").alias("l"), F.max("label").alias("h")).filter("l != h").select("bucket")
    blocks = F.greatest(F.lit(1), F.ceil(F.col("members") / BLOCK)).cast("int")
    open_rows = (
        labelled.join(mixed, "bucket").join(nodes.select("node", "sig"), "node").join(sets, "node")
        .withColumn("blocks", blocks)
        .withColumn("part", F.expr("cast(pmod(xxhash64(node, 7), blocks) as int)"))
        .withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
        .withColumn("low", F.least("part", "other")).withColumn("high", F.greatest("part", "other"))
    )
    more = group_arrow(
        open_rows.select("bucket", "band", "low", "high", "node", "label", "leader", "part", "sig", "shingles"),
        ["bucket", "band", "low", "high"], _across(num, den, miss), "a long, b long",
    )
    second = settle(more)
    if second.isEmpty():
        final = labels
    else:
        final = components(first.unionByName(second))
    groups = nodes.join(final, "node", "left").select("node", "first", F.coalesce("component", "node").alias("group"))
    least = groups.groupBy("group").agg(F.min("first").alias("component"))
    classes = groups.join(least, "group").select("node", "component", F.col("group").alias("class"))
    alone = signed.filter("node is null").select(
        "row", "key", "n_shingles", F.col("key").alias("component"), F.lit(None).cast("long").alias("class")
    )
    linked_rows = signed.filter("node is not null").join(classes, "node")
    return linked_rows.select("row", "key", "n_shingles", "component", "class").unionByName(alone)


def _sets_of(batches, k: int):
    for batch in batches:
        raw, offsets = X.buffer_of(batch.column("text"))
        sets = [s.tobytes() for _, part in shingle_sets(raw, offsets, k) for s in part]
        yield pa.RecordBatch.from_arrays([batch.column("node"), X.binaries(sets)], ["node", "shingles"])
