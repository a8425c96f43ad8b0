"""Posts, comments, captures, probes and contexts out of the test tables.

The test tables hold no social payloads. The views here derive them row by
row, so they grow with the tables; the SQL constants are the same views for the
checking engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from undertone.functions import expressions as E
from undertone.schemas import ENGAGEMENT_TYPE, PLATFORMS, USER_TYPE

EPOCH = 1_704_067_200  # 2024-01-01 UTC


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def platform_by(number: Column) -> Column:
    names = F.array(*[F.lit(p) for p in PLATFORMS])
    return F.element_at(names, (F.pmod(number, F.lit(len(PLATFORMS))) + 1).cast("int"))


PLATFORM_LIST_SQL = "[" + ", ".join(f"'{p}'" for p in PLATFORMS) + "]"


def platform_sql(number: str) -> str:
    return f"({PLATFORM_LIST_SQL})[CAST(({number}) % {len(PLATFORMS)} AS INT) + 1]"


# -- posts --------------------------------------------------------------------

def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    doc = F.col("doc_id")
    name = F.col("source")
    return d.select(
        doc.cast("string").alias("id"),
        platform_by(doc).alias("platform"),
        F.struct(
            F.concat(F.lit("u_"), name).alias("id"),
            name.alias("username"),
            name.alias("display_name"),
            (F.pmod(doc, F.lit(11)) * 100).cast("bigint").alias("follower_count"),
            (F.pmod(doc, F.lit(3)) == 0).alias("verified"),
            F.lit(None).cast("string").alias("profile_image_url"),
            F.lit(None).cast("string").alias("bio"),
        ).cast(USER_TYPE).alias("author"),
        F.col("text").alias("content"),
        F.struct(
            F.pmod("n_chars", F.lit(997)).alias("likes"),
            F.pmod(doc, F.lit(53)).alias("comments"),
            F.pmod(doc, F.lit(17)).alias("shares"),
            F.col("n_chars").alias("views"),
            F.lit(None).cast("double").alias("engagement_rate"),
        ).cast(ENGAGEMENT_TYPE).alias("engagement"),
        F.timestamp_seconds(F.lit(EPOCH) + doc).alias("timestamp"),
        F.concat(F.lit("https://posts.example/"), doc.cast("string")).alias("url"),
        F.concat(
            E.hashtags_lower(F.col("text")), F.array(F.concat(F.lit("#"), F.col("lang")), F.concat(F.lit("#"), name))
        ).alias("hashtags"),
    )


POSTS_SQL = f"""posts AS (
  SELECT CAST(doc_id AS VARCHAR) AS id, {platform_sql('doc_id')} AS platform,
         'u_' || source AS author_id, source AS username,
         (doc_id % 11) * 100 AS followers, doc_id % 3 = 0 AS verified,
         text AS content, n_chars % 997 AS likes, doc_id % 53 AS comments,
         doc_id % 17 AS shares, n_chars AS views, {EPOCH} + doc_id AS ts,
         'https://posts.example/' || CAST(doc_id AS VARCHAR) AS url,
         list_concat(list_transform(regexp_extract_all(text, '#[\\wÀ-ɏḀ-ỿ]+'), lambda x: lower(x)),
                     ['#' || lang, '#' || source]) AS hashtags
  FROM documents)"""


def flat_posts(df: DataFrame, *extra: str) -> DataFrame:
    """The columns two engines can compare."""
    return df.select("platform", "id", *extra)


# -- comments -----------------------------------------------------------------

# Cue phrases that give the invented prose something to have an opinion about.
CUES = ["", " that part is unsafe", " Great tips, very useful", " what is this about?", " I won't recommend it",
        " please add more", " lol"]


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as a binary tree per conversation: turn t answers (t-1)/2."""
    c = table(spark, sf_dir, "conversations")
    turn, length = F.col("turn"), F.length("text")
    name = F.concat_ws("_", "role", F.pmod("conv_id", F.lit(211)).cast("string"))
    parent = F.when(turn > 0, F.floor((turn - 1) / 2))

    def comment_id(t: Column) -> Column:
        return F.concat(F.col("conv_id").cast("string"), F.lit("-"), t.cast("bigint").cast("string"))

    return c.select(
        platform_by(F.col("conv_id")).alias("platform"),
        F.col("conv_id").cast("string").alias("content_id"),
        comment_id(turn).alias("comment_id"),
        F.when(turn > 0, comment_id(parent)).alias("parent_comment_id"),
        (F.length(F.bin(turn + 1)) - 1).alias("depth"),
        F.struct(
            name.alias("id"), name.alias("username"), name.alias("display_name"),
            F.lit(None).cast("bigint").alias("follower_count"), F.lit(None).cast("boolean").alias("verified"),
            F.lit(None).cast("string").alias("profile_image_url"), F.lit(None).cast("string").alias("bio"),
        ).cast(USER_TYPE).alias("author"),
        F.col("text"),
        F.timestamp_seconds(F.lit(EPOCH) + F.col("conv_id") * 100 + turn).alias("timestamp"),
        F.pmod(length, F.lit(31)).cast("bigint").alias("likes"),
        F.pmod(length, F.lit(5)).cast("bigint").alias("shares"),
        (length * 3).cast("bigint").alias("views"),
        "turn",
        "conv_id",
    )


COMMENTS_SQL = f"""comments AS (
  SELECT {platform_sql('conv_id')} AS platform, CAST(conv_id AS VARCHAR) AS content_id,
         conv_id || '-' || turn AS comment_id,
         CASE WHEN turn > 0 THEN conv_id || '-' || ((turn - 1) // 2) END AS parent_comment_id,
         length(bin(turn + 1)) - 1 AS depth,
         role || '_' || (conv_id % 211) AS username, text,
         {EPOCH} + conv_id * 100 + turn AS ts, length(text) % 31 AS likes,
         length(text) % 5 AS shares, length(text) * 3 AS views, turn, conv_id
  FROM conversations)"""


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments as the opinion steps want them, with a cue phrase each.

    Turn 0 is the content itself (see ``contexts``); the others are comments.
    """
    c = table(spark, sf_dir, "conversations").filter("turn > 0")
    length = F.length("text")
    cue = F.element_at(F.array(*[F.lit(x) for x in CUES]), (F.pmod(length, F.lit(len(CUES))) + 1).cast("int"))
    body = F.when(F.pmod(length, F.lit(11)) == 0, F.lit("same")).otherwise(F.concat(F.col("text"), cue))
    turn = F.col("turn")
    parent = F.when(turn > 2, F.floor((turn - 1) / 2))

    def comment_id(t: Column) -> Column:
        return F.concat(F.col("conv_id").cast("string"), F.lit("-"), t.cast("bigint").cast("string"))

    return c.select(
        F.col("conv_id").cast("string").alias("video_id"),
        comment_id(turn).alias("comment_id"),
        F.when(turn > 2, comment_id(parent)).alias("parent_comment_id"),
        (F.length(F.bin(turn + 1)) - 2).alias("depth"),
        F.concat_ws("_", "role", F.pmod("conv_id", F.lit(211)).cast("string")).alias("author_id"),
        body.alias("text"),
        F.pmod(length, F.lit(31)).cast("bigint").alias("likes"),
        F.pmod(length, F.lit(3)).cast("bigint").alias("reply_count"),
        F.lit(0).cast("bigint").alias("shares"),
        F.lit(0).cast("bigint").alias("views"),
    )


def contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A content description out of the first turn of each conversation."""
    c = table(spark, sf_dir, "conversations").filter("turn = 0")
    sentences = F.filter(
        F.transform(F.split("text", "(?<=[.!?])\\s+|\\n+"), lambda s: F.trim(s)), lambda s: F.length(s) > 0
    )
    cut = c.withColumn("s", sentences)
    moment = lambda s, i: F.struct(
        F.concat(F.lit("0:"), F.lpad((i * 10).cast("string"), 2, "0")).alias("timestamp"), s.alias("description")
    )
    first_word = lambda s: F.regexp_extract(s, "([\\p{L}]+)", 1)
    names = F.array_distinct(F.filter(F.transform("s", first_word), lambda w: F.length(w) > 2))
    return cut.select(
        F.col("conv_id").cast("string").alias("video_id"),
        F.get("s", F.lit(0)).alias("main_topic"),
        F.col("text").alias("summary"),
        F.array(F.col("role")).alias("people"),
        names.alias("objects"),
        F.array().cast("array<string>").alias("locations"),
        F.transform(
            F.filter("s", lambda s, i: i % 3 == 0),
            lambda s, i: F.struct(
                F.concat(F.lit("0:"), F.lpad((i * 20).cast("string"), 2, "0")).alias("start"),
                F.concat(F.lit("0:"), F.lpad((i * 20 + 20).cast("string"), 2, "0")).alias("end"),
                s.alias("description"),
            ),
        ).alias("timeline"),
        F.transform(F.filter("s", lambda s, i: i % 2 == 1), moment).alias("key_moments"),
        F.transform(F.filter("s", lambda s, i: i == 1), moment).alias("controversial_moments"),
        F.col("text").alias("transcript"),
        F.filter("s", lambda s, i: i % 4 == 2).alias("visual_text"),
        F.array(F.lit("Comment below"), F.concat(F.lit("Ask about "), F.coalesce(F.get(names, F.lit(0)), F.lit("it")))).alias(
            "calls_to_action"
        ),
    )


# -- probes and requests ------------------------------------------------------

def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        platform_by(F.col("user_id")).alias("platform"),
        F.col("event_id").alias("probe_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        (F.col("event_type") != "error").alias("success"),
        F.when(F.col("event_type") == "signup", 0).otherwise(1).alias("result_count"),
        (F.col("value") * 1000).alias("response_ms"),
    )


PROBES_SQL = f"""probes AS (
  SELECT {platform_sql('user_id')} AS platform, event_id AS probe_id, ts,
         event_type <> 'error' AS success, CASE WHEN event_type = 'signup' THEN 0 ELSE 1 END AS result_count,
         value * 1000 AS response_ms,
         event_type <> 'error' AND event_type <> 'signup' AND NOT (value * 1000 > 15000) AS ok,
         value * 1000 > 15000 AS timed_out
  FROM events)"""

# The test events are minutes apart; the gap is stretched to match.
REQUEST_GAP_SECONDS = 1800


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        platform_by(F.col("user_id")).alias("platform"),
        F.col("event_id").alias("request_id"),
        F.col("ts").cast("timestamp").alias("ts"),
    )


def failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as failed operations, with status, wording and reason by number."""
    e = table(spark, sf_dir, "events")
    n = F.col("event_id")
    statuses = F.array(*[F.lit(s) for s in (429, 401, 403, 404, 500, 400)])
    return e.select(
        platform_by(F.col("user_id")).alias("platform"),
        F.when(n % 2 == 0, "comments").otherwise("search").alias("operation"),
        F.element_at(statuses, (n % 6 + 1).cast("int")).alias("status"),
        F.when(n % 5 == 0, "hit the rate limit").otherwise(F.col("event_type")).alias("message"),
        F.when(n % 7 == 0, "quotaExceeded").when(n % 7 == 1, "commentsDisabled").alias("reason"),
        F.col("ts").cast("timestamp").alias("ts"),
        n.alias("failure_id"),
    )


FAILURES_SQL = f"""failures AS (
  SELECT {platform_sql('user_id')} AS platform,
         CASE WHEN event_id % 2 = 0 THEN 'comments' ELSE 'search' END AS operation,
         ([429, 401, 403, 404, 500, 400])[CAST(event_id % 6 AS INT) + 1] AS status,
         CASE WHEN event_id % 5 = 0 THEN 'hit the rate limit' ELSE event_type END AS message,
         CASE WHEN event_id % 7 = 0 THEN 'quotaExceeded' WHEN event_id % 7 = 1 THEN 'commentsDisabled' END AS reason,
         ts, event_id AS failure_id
  FROM events)"""
