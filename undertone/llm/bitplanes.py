"""Clustering around centroids with exact integer distances from bit planes.

Vectors of ``SIZE`` integers are kept as bit planes in two's complement: plane i
is one unsigned 64-bit word that holds bit i of every component, and the top
plane counts negatively. The product of two vectors is the sum over pairs of
planes of their weights times the number of bits set in both; squares of norms
come the same way, hence every squared distance is an exact integer. A vector
takes eight bytes a plane, nine planes where components lie between -256 and 255.

The planes are written once; each round is one pass over them. A task sends
per centroid one count and the sum of each component, summed before and after
the shuffle; only the centroids, k vectors, reach the driver, where new ones
are the exact floors of sum / count.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undertone.llm import text as X
from undertone.llm.tasks import map_arrow
from undertone.llm.vectors import usable
from undertone.session import settle

SIZE = 64
SCALE = 256.0
ROUNDS = 5
SEED = 2
#: Components beyond it are held at it, so that squared distances fit a 64-bit integer.
LIMIT = 1 << 27
RUN = 1 << 13


def integers(vectors: list[np.ndarray], scale: float = SCALE) -> np.ndarray:
    """floor(scale * x) of vectors of one length, held within ``LIMIT``."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(scale * np.stack(vectors)), -LIMIT, LIMIT).astype(np.int64)


def pack(values: np.ndarray) -> np.ndarray:
    """The bit planes (rows, planes) of rows of ``SIZE`` integers, as few as all rows together need."""
    reach = int(np.maximum(values, ~values).max(initial=0))
    planes = reach.bit_length() + 1
    out = np.empty((len(values), planes), "<u8")
    for i in range(planes):
        bits = (values >> i & 1).astype(np.uint8)
        out[:, i] = np.packbits(bits, axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def weights(planes: int) -> np.ndarray:
    """2**i for plane i, negative for the top one."""
    w = np.left_shift(np.int64(1), np.arange(planes, dtype=np.int64))
    w[-1] = -w[-1]
    return w


def unpack(planes: np.ndarray) -> np.ndarray:
    """The integers again."""
    bits = np.unpackbits(np.ascontiguousarray(planes).view(np.uint8).reshape(*planes.shape, 8), axis=2, bitorder="little")
    return np.einsum("rpc,p->rc", bits, weights(planes.shape[1]))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of all rows of ``a`` with the few rows of ``b``, both as planes."""
    wa, wb = weights(a.shape[1]), weights(b.shape[1])
    columns = np.ascontiguousarray(a.T)
    out = np.zeros((len(b), len(a)), np.int64)
    for c, row in enumerate(b):
        for j in np.flatnonzero(row):
            mine = np.zeros(len(a), np.int64)
            for i, column in enumerate(columns):
                mine += np.bitwise_count(column & row[j]) * wa[i]
            out[c] += mine * wb[j]
    return out.T


def squares(a: np.ndarray) -> np.ndarray:
    """Each row's product with itself."""
    w = weights(a.shape[1])
    out = np.zeros(len(a), np.int64)
    for i in range(a.shape[1]):
        for j in range(i, a.shape[1]):
            out += np.bitwise_count(a[:, i] & a[:, j]) * (w[i] * w[j] * (1 if i == j else 2))
    return out


def nearest(planes: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of the nearest centroid, the smaller number on ties; both as planes."""
    number, distance = np.zeros(len(planes), np.int64), np.zeros(len(planes), np.int64)
    norms = squares(centroids)
    for at in range(0, len(planes), RUN):
        part = planes[at : at + RUN]
        d = norms[None, :] - 2 * products(part, centroids)
        best = d.argmin(axis=1)
        number[at : at + RUN] = best
        distance[at : at + RUN] = d[np.arange(len(part)), best] + squares(part)
    return number, distance


def packed_vectors(vectors: DataFrame, column: str = "embedding", key: str = "vec_id", scale: float = SCALE) -> DataFrame:
    """(key, planes) of the vectors with exactly ``SIZE`` components, all of them finite; the others are left out."""

    def run(batches):
        for batch in batches:
            rows, found = usable(batch.column("embedding"))
            fits = [n for n, v in enumerate(found) if len(v) == SIZE]
            planes = pack(integers([found[n] for n in fits], scale)) if fits else np.zeros((0, 1), "<u8")
            yield pa.RecordBatch.from_arrays(
                [batch.column("key").take(pa.array(rows[fits], pa.int64())), X.binaries([r.tobytes() for r in planes])], ["key", "planes"]
            )

    return map_arrow(
        vectors.select(F.col(key).cast("long").alias("key"), F.col(column).alias("embedding")), run, "key long, planes binary"
    )


def _by_planes(column: pa.Array):
    """(rows, planes) of the rows of a batch that have equally many planes."""
    values = column.to_pylist()
    size = np.fromiter(map(len, values), np.int64, len(values))
    for n in np.unique(size):
        rows = np.flatnonzero(size == n)
        yield rows, np.frombuffer(b"".join([values[r] for r in rows]), "<u8").reshape(len(rows), -1)


def _sums(batches, centroids: np.ndarray):
    """(cluster, component, sum) of what a task's vectors add up to; component ``SIZE`` counts them."""
    total = np.zeros((len(centroids), SIZE + 1), np.int64)
    for batch in batches:
        for _, planes in _by_planes(batch.column("planes")):
            number, _ = nearest(planes, centroids)
            values = unpack(planes)
            for c in np.unique(number):
                mine = values[number == c]
                total[c, :SIZE] += mine.sum(axis=0)
                total[c, SIZE] += len(mine)
    cluster, component = np.nonzero(total)
    yield pa.RecordBatch.from_arrays(
        [pa.array(cluster.astype(np.int32)), pa.array(component.astype(np.int32)), pa.array(total[cluster, component])],
        ["cluster", "component", "sum"],
    )


def first_centroids(packed: DataFrame, k: int, seed: int = SEED) -> np.ndarray:
    """The k vectors whose ids have the least sha256 of ``seed:id``, in that order; a null id is empty, equal ids go by vector."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("key").cast("string"), F.lit(""))), 256)
    rows = packed.select(digest.alias("digest"), "planes").orderBy("digest", "planes").limit(k).collect()
    return np.array([unpack(np.frombuffer(r["planes"], "<u8")[None, :])[0] for r in rows], np.int64).reshape(-1, SIZE)


def cluster_vectors(
    vectors: DataFrame, k: int, rounds: int = ROUNDS, seed: int = SEED, column: str = "embedding", key: str = "vec_id",
    scale: float = SCALE,
) -> tuple[DataFrame, np.ndarray]:
    """((key, cluster, distance) of every vector kept, final centroids) after ``rounds`` rounds.

    Vectors that are null, not of ``SIZE`` components, or hold a null or non-finite component are left
    out. Repeated ids and vectors stay rows of their own. Fewer than k vectors make fewer clusters; an
    empty table has none. ``distance`` is the squared one. Other columns are ignored.
    """
    packed = settle(packed_vectors(vectors, column, key, scale))
    centroids = first_centroids(packed, k, seed)
    for _ in range(rounds if len(centroids) else 0):
        planes = pack(centroids)
        found = map_arrow(packed.select("planes"), lambda b, c=planes: _sums(b, c), "cluster int, component int, sum long")
        sums = np.zeros((len(centroids), SIZE + 1), np.int64)
        for r in found.groupBy("cluster", "component").agg(F.sum("sum").alias("sum")).collect():  # k * (SIZE + 1) rows at most
            sums[r["cluster"], r["component"]] = r["sum"]
        full = sums[:, SIZE] > 0
        centroids[full] = sums[full, :SIZE] // sums[full, SIZE:]
    final = pack(centroids)

    def run(batches):
        for batch in batches:
            number = np.zeros(batch.num_rows, np.int32)
            distance = np.zeros(batch.num_rows, np.int64)
            for rows, planes in _by_planes(batch.column("planes")):
                number[rows], distance[rows] = nearest(planes, final)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(number), pa.array(distance)], ["key", "cluster", "distance"])

    return map_arrow(packed, run, "key long, cluster int, distance long"), centroids


def with_inertia(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """The assigned vectors with ``cluster_inertia``, ``inertia`` and ``centroid_sha256`` (of the comma-joined components)."""
    spark = assigned.sparkSession
    assigned = settle(assigned)
    digests = [(c, hashlib.sha256(",".join(map(str, v)).encode()).hexdigest()) for c, v in enumerate(centroids.tolist())]
    totals = assigned.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).collect()  # one row a centroid
    whole = sum(r["cluster_inertia"] for r in totals)
    of = dict(digests)
    facts = spark.createDataFrame(
        [(r["cluster"], r["cluster_inertia"], whole, of[r["cluster"]]) for r in totals],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string",
    )
    return assigned.join(F.broadcast(facts), "cluster").select("key", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
