"""Exact top-k inner products with a vector-approximation file.

The file holds blocks of vectors: ids, one byte per component that names its
cell among ``2 ** BITS`` equal ones, and the exact integers in a column of
their own. A first scan reads the cells only and bounds each product from
below and above; the k-th best lower bound over all blocks is the bar of a
query. A block whose best upper bound lies below the bar is never opened for
that query. In the others the exact vectors are read in the order of their
upper bounds until no bound reaches the k-th best product found.

Queries are a stated set and meet the rows in blocks; a block of queries and a
block of rows give at most k rows per query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from undertone.llm.tasks import map_arrow
from undertone.llm.vectors import matrix, usable
from undertone.session import settle

BITS = 6
BLOCK = 4096
QUERIES = 256
SCALE = 256.0


def scaled(v: np.ndarray, scale: float = SCALE) -> np.ndarray:
    """floor(scale * x), held within what a 64-bit integer holds."""
    return np.clip(np.floor(scale * v), -(2.0**63), 2.0**63 - 1024).astype(np.int64)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer products of rows of ``a`` with rows of ``b``; by doubles where those are exact."""
    if not len(a) or not len(b):
        return np.zeros((len(a), len(b)), np.int64)
    if float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2.0**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def _packed(size: int, first: str):
    """Pack vectors of equal length into blocks of ``size``, one row each, with a number unique in the table."""

    def run(batches):
        waiting: dict[int, list[tuple[int, np.ndarray]]] = {}
        made = TaskContext.get().partitionId() << 32

        def row(length: int, rows: list[tuple[int, np.ndarray]]):
            nonlocal made
            made += 1
            values = np.stack([v for _, v in rows])
            return pa.RecordBatch.from_arrays(
                [pa.array([made], pa.int64()), pa.array([length], pa.int32()), pa.array([np.array([i for i, _ in rows], "<i8").tobytes()], pa.binary()),
                 pa.array([values.astype("<i8").tobytes()], pa.binary()), pa.array([int(values.min())], pa.int64()), pa.array([int(values.max())], pa.int64())],
                [first, "length", "ids", "exact", "low", "high"],
            )

        for batch in batches:
            ids = batch.column("id").to_pylist()
            for r, v in zip(*usable(batch.column("embedding"))):
                if ids[r] is None:
                    continue
                rows = waiting.setdefault(len(v), [])
                rows.append((ids[r], scaled(v)))
                if len(rows) == size:
                    yield row(len(v), waiting.pop(len(v)))
        for length, rows in waiting.items():
            yield row(length, rows)

    return run


def _approximated(batches, low: int, width: int):
    for batch in batches:
        codes = [
            ((np.frombuffer(x, "<i8").astype(object) - low) // width if width > 2**40 else (np.frombuffer(x, "<i8") - low) // width).astype(np.uint8).tobytes()
            for x in batch.column("exact").to_pylist()
        ]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("block", "length", "ids", "exact")), pa.array(codes, pa.binary())],
            ["block", "length", "ids", "exact", "codes"],
        )


def bounds(queries: np.ndarray, codes: np.ndarray, low: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the products of queries (rows) with coded vectors (columns)."""
    least = codes.astype(np.float64) * width + low
    most = least + (width - 1)
    up, down = np.maximum(queries, 0).astype(np.float64), np.minimum(queries, 0).astype(np.float64)
    lower, upper = up @ least.T + down @ most.T, up @ most.T + down @ least.T
    if float(np.abs(queries).max(initial=0)) * float(np.abs(most).max(initial=0) + width) * codes.shape[1] >= 2.0**52:
        slack = 1e-12 * np.abs(queries).sum(axis=1, keepdims=True) * (abs(low) + 300.0 * width)  # doubles round here
        lower, upper = lower - slack, upper + slack
    return lower, upper


def _numbers(part: int, query_ids: np.ndarray) -> np.ndarray:
    """A number for each query row of a block, unique in the table; ids may repeat."""
    return part * QUERIES + np.arange(len(query_ids), dtype=np.int64)


def _scan(batches, k: int, low: int, width: int):
    """For each query and block the k best lower bounds and the best upper bound."""
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("block", "ids", "codes", "part", "query_ids", "queries")]
        for block, ids, codes, part, query_ids, queries in zip(*columns):
            ids, query_ids = np.frombuffer(ids, "<i8"), np.frombuffer(query_ids, "<i8")
            q = np.frombuffer(queries, "<i8").reshape(len(query_ids), -1)
            c = np.frombuffer(codes, np.uint8).reshape(len(ids), -1)
            lower, upper = bounds(q, c, low, width)
            own = query_ids[:, None] == ids[None, :]
            lower[own], upper[own] = -np.inf, -np.inf
            best = -np.partition(-lower, min(k, len(ids)) - 1, axis=1)[:, :k]
            high = upper.max(axis=1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(_numbers(part, query_ids)), pa.array(np.full(len(query_ids), block)), pa.array(list(best), pa.list_(pa.float64())), pa.array(high)],
                ["query", "block", "lows", "high"],
            )


def _opened(batches, k: int, low: int, width: int):
    """The k best products of each waiting query in a block, read in the order of the upper bounds."""
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("ids", "codes", "exact", "waiting")]
        for ids, codes, exact, waiting in zip(*columns):
            ids = np.frombuffer(ids, "<i8")
            v = np.frombuffer(exact, "<i8").reshape(len(ids), -1)
            c = np.frombuffer(codes, np.uint8).reshape(len(ids), -1)
            q = matrix([w["vector"] for w in waiting], "<i8")
            _, upper = bounds(q, c, low, width)
            out = []
            for n, w in enumerate(waiting):
                upper[n, ids == w["query_id"]] = -np.inf
                able = np.flatnonzero((upper[n] >= w["bar"]) & (upper[n] > -np.inf))
                able = able[np.argsort(-upper[n, able], kind="stable")]
                scores, places, at = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
                while at < len(able):
                    if len(scores) == k and upper[n, able[at]] < scores[-1]:
                        break
                    step = able[at : at + 64]
                    at += len(step)
                    scores = np.concatenate([scores, products(q[n : n + 1], v[step])[0]])
                    places = np.concatenate([places, step])
                    order = np.lexsort((ids[places], -scores))[:k]
                    scores, places = scores[order], places[order]
                out += [(w["query"], w["query_id"], int(ids[p]), int(s)) for p, s in zip(places, scores)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[c] for x in out], pa.int64()) for c in range(4)], ["query", "query_id", "vec_id", "score"]
            )


def top_products(
    vectors: DataFrame, queries: DataFrame, k: int = 5, key: str = "vec_id", embedding: str = "embedding"
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest products of each query with rows of ``vectors``.

    A query's own row (equal key) is no candidate. Ties go to the smaller key. Rows take no part
    whose key is null or whose vector is null, empty or holds null or non-finite numbers; vectors of
    another length than the query's don't either. Repeated rows stand for themselves; each row of
    ``queries`` has ranks of its own, also where keys repeat. Products beyond 64 bits wrap around.
    """

    def plain(df: DataFrame) -> DataFrame:
        return df.select(F.col(key).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("embedding"))

    layout = "length int, ids binary, exact binary, low long, high long"
    packed = settle(map_arrow(plain(vectors), _packed(BLOCK, "block"), f"block long, {layout}"))
    ends = packed.agg(F.min("low").alias("low"), F.max("high").alias("high"), F.count("*").alias("n")).first()
    low, high = ends["low"] or 0, ends["high"] or 0
    width = (high - low) // 2**BITS + 1
    file = settle(map_arrow(
        packed.select("block", "length", "ids", "exact"), lambda b: _approximated(b, low, width),
        "block long, length int, ids binary, exact binary, codes binary",
    ))
    asked = settle(map_arrow(plain(queries), _packed(QUERIES, "part"), f"part long, {layout}"))
    groups = max(1, -(-ends["n"] // 4))
    by_group = asked.select(
        "length", "part", F.col("ids").alias("query_ids"), F.col("exact").alias("queries"),
        F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"),
    )
    scanned = settle(map_arrow(
        file.select("block", "length", "ids", "codes", F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int").alias("group"))
        .join(by_group, ["length", "group"]).select("block", "ids", "codes", "part", "query_ids", "queries"),
        lambda b: _scan(b, k, low, width), "query long, block long, lows array<double>, high double",
    ))
    best = Window.partitionBy("query").orderBy(F.desc("bound"))
    bars = (
        scanned.select("query", F.explode("lows").alias("bound")).withColumn("place", F.row_number().over(best))
        .filter(F.col("place") <= k).groupBy("query")
        .agg(F.when(F.count("*") == k, F.min("bound")).otherwise(F.lit(float("-inf"))).alias("bar"))
    )
    open_blocks = scanned.join(bars, "query").filter("high >= bar").select("query", "block", "bar")
    alone = settle(map_arrow(asked, _unpacked, "query long, query_id long, vector binary"))
    many = open_blocks.groupBy("block").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("parts"))
    waiting = (
        open_blocks.join(alone, "query").join(many, "block")
        .groupBy("block", F.expr("pmod(xxhash64(query), parts)").alias("part"))
        .agg(F.collect_list(F.struct("query", "query_id", "bar", "vector")).alias("waiting"))
    )
    found = map_arrow(
        file.join(waiting, "block").select("ids", "codes", "exact", "waiting"), lambda b: _opened(b, k, low, width),
        "query long, query_id long, vec_id long, score long",
    )
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _unpacked(batches):
    for batch in batches:
        numbers, ids, rows = [], [], []
        for part, packed, exact in zip(*(batch.column(c).to_pylist() for c in ("part", "ids", "exact"))):
            mine = np.frombuffer(packed, "<i8")
            numbers += _numbers(part, mine).tolist()
            ids += mine.tolist()
            rows += [v.tobytes() for v in np.frombuffer(exact, "<i8").reshape(len(mine), -1)]
        yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(ids, pa.int64()), pa.array(rows, pa.binary())], ["query", "query_id", "vector"])
