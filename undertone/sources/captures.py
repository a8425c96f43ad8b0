"""Bronze layer: captured API responses.

A capture is one raw JSON response: ``capture_id, platform, kind ('posts' or
'comments'), content_id, url, status, content_type, body, captured_at``.
Bodies are never changed; everything else is derived from them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CAPTURE_SCHEMA = (
    "capture_id STRING, platform STRING, kind STRING, content_id STRING, url STRING, "
    "status INT, content_type STRING, body STRING, captured_at TIMESTAMP"
)

# URL patterns of the intercepted platforms, in matching order.
URL_PATTERNS = {
    "tiktok": [
        "/api/search/item/",
        "/api/search/general/",
        "/api/comment/list/",
        "/api/recommend/item_list/",
        "/api/post/item_list/",
        "/v1/search/",
    ],
    "instagram": [
        "/graphql/query/",
        "/api/v1/tags/",
        "/api/v1/feed/",
        "/api/v1/media/",
        "/api/v1/web/search/",
        "/web/search/topsearch/",
    ],
    "xiaohongshu": [
        "/api/sns/web/v1/search/notes",
        "/api/sns/web/v2/comment/page",
        "/api/sns/web/v1/feed",
        "/api/sns/web/v1/user_posted",
        "/api/sns/web/v1/note/",
        "/api/sns/web/v2/note/",
    ],
}


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    """JSON-lines captures; unreadable lines land in ``_corrupt`` instead of failing."""
    schema = CAPTURE_SCHEMA + ", _corrupt STRING"
    return (
        spark.read.schema(schema)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt")
        .json(path)
    )


def quarantined(captures: DataFrame) -> DataFrame:
    """Captures whose body is not a JSON object or array."""
    whole = F.rlike(F.col("body"), F.lit("^\\s*[\\[{]")) & F.try_parse_json("body").isNotNull()
    return captures.filter(~F.coalesce(whole, F.lit(False)))


def matched_pattern(url: Column, patterns: list[str]) -> Column:
    """First pattern, in declared order, that the URL contains."""
    return F.coalesce(*[F.when(F.contains(url, F.lit(p)), F.lit(p)) for p in patterns])


def filter_captures(
    captures: DataFrame, patterns: dict[str, list[str]] | None = None
) -> DataFrame:
    """Keep successful JSON responses of the watched endpoints.

    Platforms without patterns are read from a plain API, so only the status
    and the body are tested for them.
    """
    patterns = URL_PATTERNS if patterns is None else patterns
    matched: Column = F.lit(None).cast("string")
    for platform, listed in patterns.items():
        matched = F.when(F.col("platform") == platform, matched_pattern(F.col("url"), listed)).otherwise(matched)
    watched = F.col("platform").isin(*patterns)
    content_type = F.coalesce(F.col("content_type"), F.lit(""))
    is_json = F.contains(content_type, F.lit("json")) | F.contains(content_type, F.lit("javascript"))
    present = F.col("body").isNotNull() & ~F.trim("body").isin("", "null", "0", "false", '""')
    return (
        captures.filter((F.col("status") >= 200) & (F.col("status") < 400) & present)
        .withColumn("matched_pattern", matched)
        .filter(~watched | (is_json & F.col("matched_pattern").isNotNull()))
    )


def capture_key(platform: Column, url: Column, body: Column) -> Column:
    """Captures of one platform and URL path with the same whole body are one."""
    return F.concat_ws("::", platform, F.try_parse_url(url, F.lit("PATH")), F.sha2(body, 256))


def dedup_captures(captures: DataFrame) -> DataFrame:
    """One capture per ``capture_key``: the first by time (unknown first) and id (null first).

    Bodies are hashed where they are read and are not ranked: keys, times and ids alone are counted.
    Repeats go by comparing a row's time and id with the first of its key. Only where the first itself
    occurs again (the same capture read twice, or null ids) do whole rows meet, each task having
    dropped its own copies before; of those the least row by all columns stays.
    """
    keyed = captures.withColumn("capture_key", capture_key(F.col("platform"), F.col("url"), F.col("body")))
    each = keyed.groupBy("capture_key", "captured_at", "capture_id").agg(F.count(F.lit(1)).alias("n"))
    repeated = each.groupBy("capture_key").agg(
        F.min(F.struct("captured_at", "capture_id", "n")).alias("first"), F.sum("n").alias("copies")
    ).filter("copies > 1").select("capture_key", "first")
    is_first = F.col("first").isNull() | (
        F.col("first.captured_at").eqNullSafe(F.col("captured_at")) & F.col("first.capture_id").eqNullSafe(F.col("capture_id"))
    )
    kept = keyed.join(repeated, "capture_key", "left").filter(is_first)
    again = kept.filter("first.n > 1").groupBy("capture_key").agg(F.min(F.struct(*captures.columns)).alias("row"))
    return kept.filter("first is null or first.n = 1").select(*captures.columns).unionByName(again.select("row.*"))


def captures_for(captures: DataFrame, pattern: str | None = None, bodies_only: bool = False) -> DataFrame:
    if pattern is not None:
        captures = captures.filter(
            (F.col("matched_pattern") == pattern) | F.contains(F.col("url"), F.lit(pattern))
        )
    return captures.select("body") if bodies_only else captures


def with_envelope(df: DataFrame, trace_id: str, tool_name: str, body: str = "body",
                  url: str = "url", retrieved_at: str = "captured_at") -> DataFrame:
    """Ingestion metadata; the key depends on the content only, so a replay repeats it."""
    raw_hash = F.sha2(F.col(body), 256)
    return df.withColumns(
        {
            "trace_id": F.lit(trace_id),
            "tool_name": F.lit(tool_name),
            "source_url": F.col(url),
            "retrieved_at": F.col(retrieved_at),
            "raw_hash": raw_hash,
            "idempotency_key": F.sha2(F.concat_ws("|", F.col("platform"), F.col(url), raw_hash), 256),
        }
    )


def merge_new(incoming: DataFrame, existing: DataFrame, key: str = "idempotency_key") -> DataFrame:
    """Rows not ingested yet, one per key."""
    window = W.partitionBy(key).orderBy("retrieved_at", "capture_id")
    first = incoming.withColumn("seen", F.row_number().over(window)).filter("seen = 1").drop("seen")
    return first.join(existing.select(key), key, "left_anti")
