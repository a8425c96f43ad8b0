"""Row numbers over any number of rows, without one task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from undertone.session import settle


def numbered(df: DataFrame, order: list[Column], scope: list[str] | None = None, name: str = "rank") -> DataFrame:
    """``df`` with ``name``: 1, 2, ... in ``order`` within each ``scope`` (all rows if none is given).

    Rows are dealt to range partitions by scope and order, so a scope that holds a third of all rows lies
    in a third of the partitions. Each partition numbers its own rows; what lies in earlier partitions
    of the same scope is added as an offset, from one count per partition and scope. Null scopes are
    scopes like others. ``order`` must be total for a defined result; equal rows share their numbers' range.
    """
    scope = scope or []
    # Range partitions are written with their number, which a lost task then can't change.
    parts = settle(df.repartitionByRange(*scope, *order).withColumn("part_", F.spark_partition_id()))
    inside = parts.withColumn("inside_", F.row_number().over(W.partitionBy("part_", *scope).orderBy(*order)))
    counts = parts.groupBy("part_", *scope).agg(F.count(F.lit(1)).alias("rows_"))
    # One row per partition and scope; only the counts of one scope, one per partition at most, meet in a task.
    before = W.partitionBy(*scope).orderBy("part_").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("part_", *scope, F.coalesce(F.sum("rows_").over(before), F.lit(0)).alias("offset_"))
    shifted = offsets.select(F.col("part_").alias("p_"), *(F.col(c).alias(f"{c}_s_") for c in scope), "offset_")
    same = F.col("part_") == F.col("p_")
    for c in scope:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}_s_"))
    return inside.join(shifted, same).withColumn(name, (F.col("inside_") + F.col("offset_")).cast("int")).select(*df.columns, name)
