"""Captures as a stream: filter, drop repeats, normalize, append once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from undertone.sources.captures import CAPTURE_SCHEMA, capture_key, filter_captures, merge_new, with_envelope
from undertone.sources.comments import normalize_all_comments
from undertone.sources.posts import normalize_all_posts

REPEAT_WINDOW = "1 hour"


def read_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(CAPTURE_SCHEMA).option("mode", "PERMISSIVE")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(path)


def dedup_stream(captures: DataFrame, window: str = REPEAT_WINDOW) -> DataFrame:
    """First capture per platform, URL path and whole body within the watermark."""
    return (
        captures.withWatermark("captured_at", window)
        .withColumn("capture_key", capture_key(F.col("platform"), F.col("url"), F.col("body")))
        .dropDuplicatesWithinWatermark(["capture_key"])
        .drop("capture_key")
    )


def request_sessions(requests: DataFrame, gap: str = "60 seconds", watermark: str = "10 minutes") -> DataFrame:
    """Bursts of requests per platform on a stream."""
    return (
        requests.withWatermark("ts", watermark)
        .groupBy("platform", F.session_window("ts", gap).alias("s"))
        .agg(F.count(F.lit(1)).alias("requests"))
        .select("platform", F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "requests")
    )


# What makes a silver row the same one in a later batch.
SILVER_KEYS = {"silver_posts": ["platform", "id"], "silver_comments": ["platform", "content_id", "comment_id"]}


class SilverWriter:
    """``foreachBatch`` target: new captures to bronze, their posts and comments to silver.

    Rows of a batch go to a folder of that batch, so a replayed batch replaces
    its own output and nothing else. A post or comment that an earlier batch
    has written is not written again; only keys of earlier batches are read.
    """

    def __init__(self, spark: SparkSession, folder: str, platforms: list[str], trace_id: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.platforms, self.trace_id = platforms, trace_id

    def _earlier(self, name: str, keys: list[str], like: DataFrame, batch_id: int) -> DataFrame:
        """Keys of the earlier batches; the batch folder is a partition, so later ones are pruned."""
        if batch_id == 0:
            return like.select(*keys).limit(0)
        rows = self.spark.read.schema(f"{like.select(*keys).schema.simpleString()[7:-1]}, batch bigint".replace(":", " "))
        return rows.parquet(f"{self.folder}/{name}").filter(F.col("batch") < batch_id).select(*keys)

    def __call__(self, captures: DataFrame, batch_id: int) -> None:
        enveloped = with_envelope(captures, self.trace_id, "capture_stream")
        known = self._earlier("bronze", ["idempotency_key"], enveloped, batch_id)
        bronze = f"{self.folder}/bronze/batch={batch_id}"
        merge_new(enveloped, known).write.mode("overwrite").parquet(bronze)
        fresh = filter_captures(self.spark.read.parquet(bronze))
        rows = {
            "silver_posts": normalize_all_posts(fresh, self.platforms),
            "silver_comments": normalize_all_comments(fresh).filter(F.col("platform").isin(*self.platforms)),
        }
        for name, keys in SILVER_KEYS.items():
            earlier = self._earlier(name, keys, rows[name], batch_id)
            rows[name].join(earlier, keys, "left_anti").write.mode("overwrite").parquet(f"{self.folder}/{name}/batch={batch_id}")


def start_ingest(captures: DataFrame, folder: str, spark: SparkSession, platforms: list[str], trace_id: str):
    target = SilverWriter(spark, folder, platforms, trace_id)
    return (
        captures.writeStream.foreachBatch(target)
        .option("checkpointLocation", f"{folder}/query")
        .trigger(availableNow=True)
        .start()
    )
