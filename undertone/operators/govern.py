"""Contract checks, redaction, retry decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from undertone.functions import expressions as E
from undertone.functions import lexicon as L
from undertone.schemas import PLATFORMS

MAX_DEPTH = 10


def _violations(df: DataFrame, rules: dict[str, Column], keys: list[str]) -> DataFrame:
    """One row per row and broken rule; nulls break a rule."""
    named = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(n)) for n, ok in rules.items()]))
    return df.select(*keys, F.explode(named).alias("rule"))


def post_violations(posts: DataFrame) -> DataFrame:
    e = lambda n: F.col(f"engagement.{n}")
    return _violations(
        posts,
        {
            "id": F.length("id") > 0,
            "platform": F.col("platform").isin(PLATFORMS),
            "author.id": F.col("author.id").isNotNull(),
            "author.username": F.col("author.username").isNotNull(),
            "content": F.col("content").isNotNull(),
            "engagement.likes": e("likes") >= 0,
            "engagement.comments": e("comments") >= 0,
            "engagement.shares": F.coalesce(e("shares"), F.lit(0)) >= 0,
            "engagement.views": F.coalesce(e("views"), F.lit(0)) >= 0,
            "timestamp": F.col("timestamp").isNotNull(),
            "url": F.col("url").isNotNull(),
        },
        ["platform", "id"],
    )


def comment_violations(comments: DataFrame) -> DataFrame:
    return _violations(
        comments,
        {
            "id": F.length("comment_id") > 0,
            "author.id": F.col("author.id").isNotNull(),
            "author.username": F.col("author.username").isNotNull(),
            "text": F.col("text").isNotNull(),
            "timestamp": F.col("timestamp").isNotNull(),
            "likes": F.col("likes").isNotNull(),
            "depth": F.col("depth") <= MAX_DEPTH,
        },
        ["platform", "content_id", "comment_id"],
    )


def missing_platforms(posts: DataFrame, platforms: DataFrame) -> DataFrame:
    """Platforms without a single post."""
    present = posts.groupBy("platform").agg(F.count(F.lit(1)).alias("n"))
    return platforms.select("platform").join(present, "platform", "left_anti")


def argument_violations(requests: DataFrame) -> DataFrame:
    broken = E.request_violations(
        F.col("user_id"), F.col("content_id"), F.col("query"), F.col("limit"), F.col("operation")
    )
    return requests.select("request_id", "operation", F.explode(broken).alias("rule"))


def redact(text: Column) -> Column:
    for pattern, replacement in L.PII_PATTERNS:
        text = F.regexp_replace(text, pattern, F.lit(replacement))
    return text


def retry_queue(responses: DataFrame) -> DataFrame:
    """Responses that need another attempt or a conflict recovery."""
    return responses.withColumn("action", E.retry_action(F.col("status"))).filter(
        F.col("action").isin("retry_with_backoff", "recover_conflict")
    )
