"""Health state on a stream of probes.

A platform has few keys and many probes, so a keyed state operator would put
each platform into one task. Each micro-batch is reduced by the batch
aggregates instead (they combine before the shuffle), and the seven-odd result
rows are merged with the state of the batch before. The state is a small table
in the shared folder, one folder per batch, so a replayed batch rewrites its
own state only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from undertone.operators.health import reduced, states

STATE_SCHEMA = (
    "platform STRING, last_healthy TIMESTAMP, last_checked TIMESTAMP, response_ms DOUBLE, "
    "failures BIGINT, timeout_seen BOOLEAN"
)


def merge(state: DataFrame, batch: DataFrame) -> DataFrame:
    """A success in the batch resets the run; otherwise its failures are added."""
    old = state.select("platform", *[F.col(c).alias(f"old_{c}") for c in state.columns if c != "platform"])
    df = old.join(batch, "platform", "full")
    reset = F.col("last_healthy").isNotNull()
    none = F.lit(0).cast("bigint")
    return df.select(
        "platform",
        F.coalesce("last_healthy", "old_last_healthy").alias("last_healthy"),
        F.coalesce("last_checked", "old_last_checked").alias("last_checked"),
        F.coalesce("response_ms", "old_response_ms").alias("response_ms"),
        (F.coalesce("failures", none) + F.when(reset, none).otherwise(F.coalesce("old_failures", none))).alias("failures"),
        (F.coalesce("timeout_seen", F.lit(False)) | (~reset & F.coalesce("old_timeout_seen", F.lit(False)))).alias("timeout_seen"),
    )


class HealthStream:
    """``foreachBatch`` target; keeps its state under ``folder`` (shared storage)."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def state_before(self, batch_id: int) -> DataFrame:
        if batch_id == 0:
            return self.spark.createDataFrame([], STATE_SCHEMA)
        return self.spark.read.schema(STATE_SCHEMA).parquet(f"{self.folder}/state/batch={batch_id - 1}")

    def __call__(self, probes: DataFrame, batch_id: int) -> None:
        before = self.state_before(batch_id)
        seen = before.select("platform", F.col("last_checked").alias("seen_until"))
        # A probe older than what its platform already reported comes too late to matter.
        fresh = probes.join(seen, "platform", "left").filter(
            F.col("seen_until").isNull() | (F.col("ts") >= F.col("seen_until"))
        ).drop("seen_until")
        merged = merge(before, reduced(fresh)).coalesce(1)
        merged.write.mode("overwrite").parquet(f"{self.folder}/state/batch={batch_id}")

    def current(self, batch_id: int) -> DataFrame:
        return states(self.spark.read.schema(STATE_SCHEMA).parquet(f"{self.folder}/state/batch={batch_id}"))


def start_health(probes: DataFrame, folder: str, spark: SparkSession):
    """Run over all available probes; returns the query and its batch target."""
    target = HealthStream(spark, folder)
    query = (
        probes.writeStream.foreachBatch(target)
        .option("checkpointLocation", f"{folder}/query")
        .trigger(availableNow=True)
        .start()
    )
    return query, target
