"""Running values over long ordered histories with few keys.

A window partitioned by a key such as the platform would put all rows of a
platform into one task. Here the time line of a key is cut into slices; each
slice is scanned by itself, a short summary per slice is carried forward, and
the carry is joined back. Only the summaries pass a window per key.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from undertone.session import settle

SLICE_SECONDS = 3600
# More rows than this in one slice and the slices are cut by rank instead of by time.
FULL_SLICE = 2_000_000
# Two counts below this bound travel in one number.
PACK = 1 << 32


def with_slice(df: DataFrame, keys: list[str], ts: str, tie: str, seconds: int = SLICE_SECONDS,
               full: int = FULL_SLICE) -> DataFrame:
    """Adds ``slice``, ascending in time for each key.

    Slices of equal time need no sampling. If one of them holds too many rows
    (a burst of one platform), the rows are range-partitioned by key, time and
    tie instead, which balances the slices whatever the burst; that table is
    written once, because a slice number must not change between its readers.
    """
    timed = df.withColumn("slice", F.floor(F.unix_timestamp(ts) / seconds))
    fullest = timed.groupBy(*keys, "slice").count().agg(F.max("count")).first()[0] or 0
    if fullest <= full:
        return timed
    parts = max(2, math.ceil(df.count() / full) * 2)
    return settle(df.repartitionByRange(parts, *keys, ts, tie).withColumn("slice", F.spark_partition_id().cast("bigint")))


def run_since(df: DataFrame, keys: list[str], ts: str, tie: str, marker: Column,
              name: str, seconds: int = SLICE_SECONDS, full: int = FULL_SLICE) -> DataFrame:
    """Adds ``name``: rows since the last row where ``marker`` holds (that row: 0)."""
    sliced = with_slice(df, keys, ts, tie, seconds, full).withColumn("mark", marker.cast("int"))
    inside = W.partitionBy(*keys, "slice").orderBy(ts, tie)
    marked = sliced.withColumn("segment", F.sum("mark").over(inside))
    segment = W.partitionBy(*keys, "slice", "segment").orderBy(ts, tie)
    local = marked.withColumn("local", F.row_number().over(segment) - F.when(F.col("segment") > 0, 1).otherwise(0))

    # The last row of a slice has its highest segment and, in it, its highest count.
    packed = F.max(F.col("segment") * F.lit(PACK) + F.col("local"))
    per_slice = local.groupBy(*keys, "slice").agg(packed.alias("packed")).select(
        *keys, "slice", (F.col("packed") >= PACK).alias("marked"), (F.col("packed") % PACK).alias("tail")
    )
    by_slice = W.partitionBy(*keys).orderBy("slice")
    runs = per_slice.withColumn("era", F.sum(F.col("marked").cast("int")).over(by_slice))
    total = F.sum("tail").over(W.partitionBy(*keys, "era").orderBy("slice"))
    carried = runs.withColumn("so_far", total).select(
        *keys, "slice", F.coalesce(F.lag("so_far").over(by_slice), F.lit(0)).alias("carry")
    )
    joined = local.join(carried, [*keys, "slice"])
    value = F.col("local") + F.when(F.col("segment") == 0, F.col("carry")).otherwise(0)
    return joined.withColumn(name, value.cast("bigint")).drop("slice", "mark", "segment", "local", "carry")


def sessions(df: DataFrame, keys: list[str], ts: str, tie: str, gap_seconds: float,
             seconds: int = SLICE_SECONDS, full: int = FULL_SLICE) -> DataFrame:
    """(keys, session_start, session_end, requests): a gap longer than the limit splits."""
    sliced = with_slice(df, keys, ts, tie, seconds, full).withColumn("at", F.unix_micros(ts))
    ends = sliced.groupBy(*keys, "slice").agg(F.max("at").alias("slice_end"))
    by_slice = W.partitionBy(*keys).orderBy("slice")
    before = ends.select(*keys, "slice", F.lag("slice_end").over(by_slice).alias("earlier"))
    inside = W.partitionBy(*keys, "slice").orderBy("at", tie)
    flagged = sliced.join(before, [*keys, "slice"]).withColumn(
        "previous", F.coalesce(F.lag("at").over(inside), F.col("earlier"))
    )
    opens = F.col("previous").isNull() | (F.col("at") - F.col("previous") > int(gap_seconds * 1_000_000))
    started = flagged.withColumn(
        "start", F.max(F.when(opens, F.col("at"))).over(inside.rowsBetween(W.unboundedPreceding, 0))
    )
    starts = started.groupBy(*keys, "slice").agg(F.max("start").alias("last_start"))
    running = F.max("last_start").over(by_slice.rowsBetween(W.unboundedPreceding, -1))
    carried = starts.select(*keys, "slice", running.alias("carried_start"))
    return (
        started.join(carried, [*keys, "slice"])
        .groupBy(*keys, F.coalesce("start", "carried_start").alias("session_start"))
        .agg(F.max("at").alias("session_end"), F.count(F.lit(1)).alias("requests"))
    )
