"""Running functions of this package in the executors' Python."""

from __future__ import annotations

import ctypes
import io
import os
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PACKAGE = Path(__file__).resolve().parents[1]
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package's modules to the executors, once per application.

    So tasks find them wherever the driver found them, also on executors that join later.
    """
    application = spark.sparkContext.applicationId
    if application in _SHIPPED:
        return
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as archive:
        for file in sorted(PACKAGE.rglob("*.py")):
            archive.write(file, str(file.relative_to(PACKAGE.parent)))
    path = os.path.join(tempfile.mkdtemp(prefix="modules-"), f"{PACKAGE.name}-modules.zip")
    Path(path).write_bytes(packed.getvalue())
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(application)


#: What a worker keeps from task to task, under the name of its owner first.
KEPT: dict[tuple[str, str], object] = {}
#: Bytes of a batch of rows that goes to Python.
BATCH_BYTES = 16 << 20
BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Batches by bytes, not by rows alone: rows of long texts or large sets come in smaller batches."""
    now = spark.conf.get(BATCH_CONF, str(BATCH_BYTES + 1)).rstrip("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(BATCH_CONF, str(BATCH_BYTES))


def release(keeps: str | None = None) -> None:
    """Drop what other owners left in this worker, and give free memory back to the system."""
    for name in [n for n in KEPT if n[0] != keeps]:
        del KEPT[name]
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def map_arrow(df: DataFrame, f: Callable, schema: str, keeps: str | None = None) -> DataFrame:
    """``mapInArrow`` with this package at hand in the tasks; only the ``KEPT`` of ``keeps`` outlive a task."""
    ship(df.sparkSession)
    bound_batches(df.sparkSession)

    def run(batches):
        release(keeps)
        try:
            yield from f(batches)
        finally:
            release(keeps)

    return df.mapInArrow(run, schema)


def group_arrow(df: DataFrame, keys: list[str], f: Callable, schema: str) -> DataFrame:
    """``applyInArrow`` on groups, with this package at hand in the tasks."""
    ship(df.sparkSession)
    f.__annotations__ = {"key": tuple[pa.Scalar, ...], "table": pa.Table, "return": pa.Table}  # Spark reads these
    return df.groupBy(*keys).applyInArrow(f, schema)


#: Vectors that one task adds up at a time.
FAN_IN = 32


def sum_vectors(rows: DataFrame, parts: Callable) -> list[tuple[int, np.ndarray]]:
    """Sums over all partitions of what ``parts`` yields for each: (number, vector of doubles).

    A tree of groups of ``FAN_IN`` partitions adds them up, so no task holds more than that many
    vectors of one number. The sums don't depend on the order of arrival. The numbers and the
    vectors' lengths must be bounded, for the result comes to the driver.
    """

    def run(batches):
        found = list(parts(batches))
        place = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays(
            [pa.array([i for i, _ in found], pa.int32()), pa.array([place] * len(found), pa.int32()),
             pa.array([v.tobytes() for _, v in found], pa.binary())],
            ["i", "part", "vector"],
        )

    def add(key, table):
        each = np.stack([np.frombuffer(v, np.float64) for v in table.column("vector").to_pylist()])
        return pa.table({
            "i": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([key[1].as_py()], pa.int32()),
            "vector": pa.array([np.sort(each, axis=0).sum(axis=0).tobytes()], pa.binary()),
        })

    schema = "i int, part int, vector binary"
    left = rows.rdd.getNumPartitions()
    sums = map_arrow(rows, run, schema)
    while True:
        left = -(-left // FAN_IN)
        sums = group_arrow(sums.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("int")), ["i", "part"], add, schema)
        if left <= 1:
            return [(r["i"], np.frombuffer(r["vector"], np.float64)) for r in sums.collect()]
