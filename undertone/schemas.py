"""The common post / comment schema and the platform dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

USER_TYPE = (
    "STRUCT<id: STRING, username: STRING, display_name: STRING, follower_count: BIGINT, "
    "verified: BOOLEAN, profile_image_url: STRING, bio: STRING>"
)
ENGAGEMENT_TYPE = (
    "STRUCT<likes: BIGINT, comments: BIGINT, shares: BIGINT, views: BIGINT, "
    "engagement_rate: DOUBLE>"
)

# Platform names, request caps per minute, row caps per request.
PLATFORMS = ["tiktok", "twitter", "reddit", "instagram", "youtube", "moltbook", "xiaohongshu"]
REQUESTS_PER_MINUTE = {
    "tiktok": 5,
    "twitter": 20,
    "reddit": 60,
    "instagram": 5,
    "youtube": 20,
    "moltbook": 60,
    "xiaohongshu": 3,
}
DEFAULT_REQUESTS_PER_MINUTE = 30
POST_ROW_CAP = {"youtube": 50}
COMMENT_ROW_CAP = {"youtube": 100}
MAX_LIMIT = 1000
CAPABILITIES = [
    "supports_trending",
    "supports_user_content",
    "supports_search",
    "supports_comments",
]


def platform_dimension(spark: SparkSession) -> DataFrame:
    """One row per platform; seven rows, so always safe to broadcast."""
    rows = [
        (
            name,
            ordinal,
            REQUESTS_PER_MINUTE.get(name, DEFAULT_REQUESTS_PER_MINUTE),
            POST_ROW_CAP.get(name, MAX_LIMIT),
            COMMENT_ROW_CAP.get(name, MAX_LIMIT),
            True,
            True,
            True,
            True,
        )
        for ordinal, name in enumerate(PLATFORMS)
    ]
    return spark.createDataFrame(
        rows,
        "platform STRING, ordinal INT, requests_per_minute INT, post_row_cap INT, "
        "comment_row_cap INT, supports_trending BOOLEAN, supports_user_content BOOLEAN, "
        "supports_search BOOLEAN, supports_comments BOOLEAN",
    )


def per_platform(values: dict[str, int], default: int, platform="platform"):
    """A lookup in a small fixed dictionary as a CASE expression (no join)."""
    column = F.col(platform) if isinstance(platform, str) else platform
    expr = F.lit(default)
    for name, value in values.items():
        expr = F.when(column == name, F.lit(value)).otherwise(expr)
    return expr
