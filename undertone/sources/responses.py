"""Rows out of free-form model answers and raw web pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from undertone.functions import expressions as E

# The widest brace-to-brace span, and ids for rows without one.
JSON_SPAN = "(?s)\\{.*\\}"
POST_ID_PREFIX = "vision_post_"
COMMENT_ID_PREFIX = "vision_comment_"

_ITEM = (
    "STRUCT<id: STRING, author: STRING, content: STRING, text: STRING, likes: STRING, "
    "comments: STRING, shares: STRING, views: STRING, url: STRING>"
)


def _payload(text: Column) -> Column:
    span = F.nullif(F.regexp_extract(text, JSON_SPAN, 0), F.lit(""))
    return F.when(F.try_parse_json(span).isNotNull(), span)


def _listed(field: str) -> Column:
    """The asked-for array of the payload, or null when there is none."""
    value = F.get_json_object(F.col("payload"), f"$.{field}")
    return F.when(F.startswith(value, F.lit("[")), F.from_json(value, "ARRAY<STRING>"))


def _items(df: DataFrame, mode: str, field: str) -> DataFrame:
    return (
        df.filter(F.col("mode") == mode)
        .withColumn("payload", _payload(F.col("text")))
        .select("response_id", "provider", "url", "answered_at", F.posexplode(_listed(field)).alias("position", "raw"))
        .withColumn("item", F.from_json("raw", _ITEM))
    )


def posts_from_responses(responses: DataFrame) -> DataFrame:
    """``responses(response_id, url, mode, provider, text, answered_at)`` to posts."""
    item = lambda name: F.col(f"item.{name}")
    content = E.text_or(item("content"))
    return _items(responses, "posts", "posts").select(
        "response_id",
        E.text_or(item("id"), F.concat(F.lit(POST_ID_PREFIX), F.col("position"))).alias("id"),
        E.platform_of_url(F.col("url")).alias("platform"),
        E.text_or(item("author")).alias("author"),
        content.alias("content"),
        E.count_or(item("likes")).alias("likes"),
        E.count_or(item("comments")).alias("comments"),
        E.count_or(item("shares")).alias("shares"),
        E.count_or(item("views")).alias("views"),
        F.col("answered_at").alias("timestamp"),
        E.text_or(item("url"), F.col("url")).alias("url"),
        E.hashtags_plain(content).alias("hashtags"),
        "provider",
        "position",
    )


def comments_from_responses(responses: DataFrame) -> DataFrame:
    item = lambda name: F.col(f"item.{name}")
    return _items(responses, "comments", "comments").select(
        "response_id",
        E.text_or(item("id"), F.concat(F.lit(COMMENT_ID_PREFIX), F.col("position"))).alias("id"),
        E.text_or(item("author")).alias("author"),
        E.text_or(item("text")).alias("text"),
        E.count_or(item("likes")).alias("likes"),
        F.col("answered_at").alias("timestamp"),
        "provider",
        "position",
    )


def raw_responses(responses: DataFrame) -> DataFrame:
    """Answers without the asked-for list, passed on as they are."""
    listed = F.when(F.col("mode") == "posts", _listed("posts")).when(F.col("mode") == "comments", _listed("comments"))
    return (
        responses.withColumn("payload", _payload(F.col("text")))
        .filter(listed.isNull())
        .select("response_id", "provider", "url", F.col("text").alias("raw"))
    )


# Page text: fixed element patterns, applied in order.
_DROPPED_BLOCKS = [
    f"(?is)<{name}\\b.*?</{name}\\s*>" for name in ("head", "script", "style", "noscript", "template")
]
_COMMENTS = "(?s)<!--.*?-->"
_BLOCK_BREAKS = "(?i)</?(p|div|h[1-6]|li|ul|ol|br|tr|table|section|article|nav|header|footer|blockquote|pre)\\b[^>]*>"
_TAGS = "<[^>]+>"
_ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")]


def page_text(html: Column) -> Column:
    """Visible text of a page, one block per line."""
    text = F.regexp_replace(F.coalesce(html, F.lit("")), _COMMENTS, "")
    for block in _DROPPED_BLOCKS:
        text = F.regexp_replace(text, block, "")
    text = F.regexp_replace(text, _BLOCK_BREAKS, "\n")
    text = F.regexp_replace(text, _TAGS, "")
    for entity, plain in _ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(plain))
    text = F.regexp_replace(text, "[ \\t\\r]+", " ")
    text = F.regexp_replace(text, " ?\\n[ \\n]*", "\n")
    return F.regexp_replace(text, "^[ \\n]+|[ \\n]+$", "")


def extract_page_text(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", "url", page_text(F.col("html")).alias("text"))
