"""Histories on a stream whose rows arrive in any order.

The time line is cut into slices. A micro-batch adds its rows to their slices and sums up
the slices it touched again, from all rows these hold by then; other slices are neither read nor listed. The
state of a key follows from its slice summaries in the order of time, so a row that comes hours late
corrects its own slice and with it everything after. Nothing is dropped by a watermark.

Rows lie in ``rows/slice=/batch=`` and summaries in ``summaries/slice=`` of the stream's folder; a replayed batch
replaces its own rows and gives the same summaries. Rows without a time lie on no time line and are left out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from undertone.operators.health import RATE_WINDOW_SECONDS, rated, reduced, states
from undertone.operators.timeline import SLICE_SECONDS, sessions


class SliceStream:
    """``foreachBatch`` target; ``summarise`` turns rows with ``slice`` into rows with ``slice``."""

    def __init__(self, spark: SparkSession, folder: str, summarise: Callable[[DataFrame], DataFrame], seconds: int = SLICE_SECONDS):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.summarise, self.seconds = summarise, seconds

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        rows, parts = f"{self.folder}/rows", ["slice", "batch"]
        timed = batch.filter(F.col("ts").isNotNull()).withColumn("slice", F.floor(F.unix_timestamp("ts") / self.seconds))
        (
            # Rows of a slice in few files; a slice too full for one task is split.
            timed.withColumn("batch", F.lit(batch_id).cast("bigint")).hint("rebalance", "slice")
            .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(rows)
        )
        # One number per slice of time the batch spans.
        touched = [r["slice"] for r in timed.select("slice").distinct().collect()]
        if not touched:
            return
        held = (
            self.spark.read.schema(timed.withColumn("batch", F.lit(0).cast("bigint")).schema).option("basePath", rows)
            .parquet(*(f"{rows}/slice={s}" for s in touched)).filter(F.col("batch") <= batch_id).drop("batch")
        )
        summary = self.summarise(held)
        summary.hint("rebalance", "slice").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("slice").parquet(f"{self.folder}/summaries")

    def summaries(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/summaries").withColumn("slice", F.col("slice").cast("bigint"))


def run(rows: DataFrame, target: SliceStream) -> SliceStream:
    """Run over all available rows of a stream."""
    query = (
        rows.writeStream.foreachBatch(target).option("checkpointLocation", f"{target.folder}/query").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return target


# -- platform health ----------------------------------------------------------

def probe_summaries(rows: DataFrame) -> DataFrame:
    return reduced(rows, ["platform", "slice"])


def health_of(summaries: DataFrame) -> DataFrame:
    """State per platform from its slices: failures are those from the last slice with a success on."""
    last = summaries.groupBy("platform").agg(
        F.max(F.when(F.col("last_healthy").isNotNull(), F.col("slice"))).alias("since"),
        F.max("last_healthy").alias("last_healthy"), F.max("last_checked").alias("last_checked"),
        F.max_by("response_ms", "slice").alias("response_ms"),
    )
    # In that slice itself the summary counts only what follows its last success.
    run_ = summaries.join(last.select("platform", "since"), "platform").filter(F.col("since").isNull() | (F.col("slice") >= F.col("since")))
    failed = run_.groupBy("platform").agg(F.sum("failures").alias("failures"), F.bool_or("timeout_seen").alias("timeout_seen"))
    return states(last.drop("since").join(failed, "platform"))


def stream_health(probes: DataFrame, folder: str, spark: SparkSession, seconds: int = SLICE_SECONDS) -> DataFrame:
    """Health per platform after all available probes of a stream, whatever their order; slices are ``seconds`` long."""
    return health_of(run(probes, SliceStream(spark, folder, probe_summaries, seconds)).summaries())


# -- request rates ------------------------------------------------------------

def burst_summaries(gap_seconds: float) -> Callable[[DataFrame], DataFrame]:
    """Bursts inside each slice; at most a slice's length over the gap, and one, per platform."""

    def summarise(rows: DataFrame) -> DataFrame:
        return sessions(rows.withColumnRenamed("slice", "part"), ["platform", "part"], "ts", "request_id", gap_seconds).withColumnRenamed(
            "part", "slice"
        )

    return summarise


def joined_bursts(summaries: DataFrame, gap_seconds: float) -> DataFrame:
    """Bursts across slices: those that follow within the gap are one. Only bursts, not requests, pass the window."""
    order = W.partitionBy("platform").orderBy("session_start")
    opens = F.coalesce(F.col("session_start") - F.lag("session_end").over(order) > int(gap_seconds * 1_000_000), F.lit(True))
    numbered = summaries.withColumn("opens", opens.cast("int")).withColumn("burst", F.sum("opens").over(order))
    return numbered.groupBy("platform", "burst").agg(
        F.min("session_start").alias("session_start"), F.max("session_end").alias("session_end"), F.sum("requests").alias("requests")
    ).drop("burst")


def stream_request_rates(requests: DataFrame, folder: str, spark: SparkSession, gap_seconds: float = RATE_WINDOW_SECONDS,
                         seconds: int = SLICE_SECONDS) -> DataFrame:
    """Bursts per platform against its cap after all available requests of a stream, whatever their order."""
    target = run(requests, SliceStream(spark, folder, burst_summaries(gap_seconds), seconds))
    return rated(joined_bursts(target.summaries(), gap_seconds))
