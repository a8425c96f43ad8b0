"""Lookups of the request path, expressed as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undertone.functions import expressions as E


def with_video_stats(items: DataFrame, stats: DataFrame) -> DataFrame:
    """Left join on the video id; a video without statistics counts zero."""
    counts = ["likes", "comments", "views"]
    return items.join(stats.select("video_id", *counts), "video_id", "left").select(
        *items.columns,
        *[F.coalesce(F.col(c).cast("bigint"), F.lit(0).cast("bigint")).alias(c) for c in counts],
    )


def resolve_channels(wanted: DataFrame, channels: DataFrame) -> DataFrame:
    """Channel ids for handles; an id (it starts with ``UC``) needs no lookup."""
    is_id = F.startswith(F.col("channel"), F.lit("UC"))
    # Ids keep their own text as key: it matches no handle and spreads over the tasks.
    keyed = wanted.withColumn("handle", F.when(is_id, F.col("channel")).otherwise(E.as_handle(F.col("channel"))))
    found = keyed.join(channels.select("handle", "channel_id"), "handle", "left")
    channel_id = F.when(is_id, F.col("channel")).otherwise(F.col("channel_id"))
    return found.select(
        *wanted.columns,
        channel_id.alias("channel_id"),
        F.when(channel_id.isNull(), F.lit("NOT_FOUND")).alias("error"),
    )


def posts_with_comment_counts(posts: DataFrame, comments: DataFrame) -> DataFrame:
    """Each post with what its comments add up to; posts without comments stay.

    Comments are counted before the join, so a post with a third of all
    comments contributes one row per task to the shuffle.
    """
    counted = comments.groupBy("platform", "content_id").agg(
        F.count(F.lit(1)).alias("comment_rows"), F.sum("likes").alias("comment_likes")
    )
    keyed = counted.withColumnRenamed("content_id", "id")
    return posts.join(keyed, ["platform", "id"], "left").na.fill(
        0, ["comment_rows", "comment_likes"]
    )


def with_parent(comments: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Left self join: ``columns`` maps a parent column to its new name.

    Roots look themselves up and drop the result: with null keys all roots of
    a content would meet in one task.
    """
    parent = comments.select(
        "content_id",
        F.col("comment_id").alias("lookup_id"),
        *[F.col(name).alias(f"parent__{alias}") for name, alias in columns.items()],
    )
    keyed = comments.withColumn("lookup_id", F.coalesce("parent_comment_id", "comment_id"))
    has_parent = F.col("parent_comment_id").isNotNull()
    return keyed.join(parent, ["content_id", "lookup_id"], "left").select(
        *comments.columns,
        *[F.when(has_parent, F.col(f"parent__{alias}")).alias(alias) for alias in columns.values()],
    )


def with_capabilities(df: DataFrame, platforms: DataFrame) -> DataFrame:
    """Capabilities per row; the dimension has seven rows."""
    return df.join(F.broadcast(platforms), "platform", "left")
