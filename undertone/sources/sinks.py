"""Result tables and bounded JSON envelopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def write_result(df: DataFrame, path: str, format: str = "parquet", mode: str = "append") -> None:
    """The full result as files, one folder per platform.

    The rebalance hint groups rows by platform and lets AQE split a platform
    with most of the rows into files of the advisory partition size.
    """
    df.hint("rebalance", "platform").write.mode(mode).partitionBy("platform").format(format).save(path)


def result_envelope(top: DataFrame, limit: int, items: str, order: list[Column], **head: str) -> DataFrame:
    """One row ``{head..., count, <items>}`` for a result that is already limited.

    ``limit`` bounds the list; the rows must come from a top-k of that size.
    """
    bounded = top.orderBy(*order).limit(limit)
    numbered = F.sort_array(F.collect_list(F.struct("rank", F.struct(*top.columns).alias("row"))))
    ranked = bounded.withColumn("rank", F.row_number().over(W.orderBy(*order)))
    return ranked.agg(F.count(F.lit(1)).alias("count"), numbered.alias("packed")).select(
        *[F.lit(v).alias(k) for k, v in head.items()],
        "count",
        F.transform("packed", lambda p: p["row"]).alias(items),
    )


def as_json(envelope: DataFrame) -> DataFrame:
    return envelope.select(F.to_json(F.struct(*envelope.columns)).alias("json"))


def comment_payload(comments: DataFrame) -> DataFrame:
    """What an analysis job needs of a comment: text, author, likes, reply count."""
    author = F.nullif(F.col("author.username"), F.lit(""))
    return comments.select(
        "content_id",
        "comment_id",
        "text",
        F.coalesce(author, F.lit("anonymous")).alias("author"),
        F.coalesce("likes", F.lit(0)).alias("likes"),
        F.coalesce("reply_count", F.lit(0)).alias("replies"),
    )
