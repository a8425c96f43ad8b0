"""Comment trees, health and request rates on the test tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from undertone.functions import expressions as E
from undertone.operators import health as H
from undertone.operators import joins, search, threads
from undertone.plans.registry import query
from undertone.plans.views import (
    COMMENTS_SQL,
    PROBES_SQL,
    REQUEST_GAP_SECONDS,
    comments,
    platform_sql,
    probes,
    requests,
)
from undertone.schemas import REQUESTS_PER_MINUTE, platform_dimension
from undertone.session import shared_folder
from undertone.streaming import slices

# -- comment trees ------------------------------------------------------------

_TREE_SQL = f"""{COMMENTS_SQL}, tree AS (
  SELECT content_id, comment_id, comment_id AS root, 0 AS d FROM comments WHERE parent_comment_id IS NULL
  UNION ALL SELECT c.content_id, c.comment_id, t.root, t.d + 1 FROM comments c
  JOIN tree t ON c.parent_comment_id = t.comment_id)"""


@query(
    "thread_structure",
    f"WITH RECURSIVE {_TREE_SQL} SELECT content_id, comment_id, root AS thread_root_id, d AS depth FROM tree",
)
def _(spark, sf):
    df = threads.thread_structure(comments(spark, sf))
    return df.select("content_id", "comment_id", "thread_root_id", "depth")


@query(
    "thread_targets",
    f"""WITH {COMMENTS_SQL} SELECT comment_id, CASE WHEN turn = 0 THEN 'video' ELSE 'parent_comment' END AS target_type
    FROM comments""",
)
def _(spark, sf):
    return threads.target_type(comments(spark, sf)).select("comment_id", "target_type")


@query(
    "reply_counts",
    f"""WITH {COMMENTS_SQL}, n AS (SELECT parent_comment_id AS comment_id, count(*) AS r FROM comments GROUP BY ALL)
    SELECT content_id, comment_id, coalesce(r, 0) AS reply_count FROM comments LEFT JOIN n USING (comment_id)""",
)
def _(spark, sf):
    return threads.reply_counts(comments(spark, sf)).select("content_id", "comment_id", "reply_count")


@query(
    "comments_with_parent",
    f"""WITH {COMMENTS_SQL} SELECT c.comment_id, p.username AS parent_author, p.likes AS parent_likes
    FROM comments c LEFT JOIN comments p ON c.parent_comment_id = p.comment_id""",
)
def _(spark, sf):
    c = comments(spark, sf).withColumn("username", F.col("author.username"))
    return joins.with_parent(c, {"username": "parent_author", "likes": "parent_likes"}).select(
        "comment_id", "parent_author", "parent_likes"
    )


def _paths(df):
    """Positions on the way from the root; binary trees need at most 64 steps."""
    turn = F.col("turn") + 1
    bits = F.split(F.bin(turn), "")
    return df.withColumn("path", F.transform(F.filter(bits, lambda b: b != ""), lambda b: b.cast("int")))


_PRE_SQL = f"""{COMMENTS_SQL}, paths AS (SELECT *, bin(turn + 1) AS path FROM comments)"""


@query(
    "preorder_of_threads",
    f"""WITH {_PRE_SQL}, r AS (SELECT content_id, comment_id, row_number() OVER (PARTITION BY content_id ORDER BY path, comment_id) AS position
      FROM paths WHERE depth <= 3) SELECT * FROM r WHERE position <= 20""",
)
def _(spark, sf):
    df = threads.preorder_per_content(_paths(comments(spark, sf)), 20)
    return df.select("content_id", "comment_id", "position")


@query(
    "preorder_of_one_content",
    f"WITH {_PRE_SQL} SELECT comment_id, path FROM paths WHERE content_id = '7' AND depth <= 3 ORDER BY path LIMIT 20",
)
def _(spark, sf):
    one = _paths(comments(spark, sf)).filter("content_id = '7'")
    return threads.preorder(one, 20).select("comment_id", F.array_join("path", "").alias("path"))


@query(
    "comments_of_content",
    f"WITH {COMMENTS_SQL} SELECT comment_id, likes FROM comments WHERE platform = 'twitter' AND content_id = '15'",
)
def _(spark, sf):
    df = search.comments_of(comments(spark, sf), "twitter", "https://x.com/someone/status/15")
    return df.select("comment_id", "likes")


@query(
    "replies_to_author",
    f"""WITH {COMMENTS_SQL} SELECT c.comment_id FROM comments c JOIN comments p ON c.parent_comment_id = p.comment_id
    WHERE c.content_id = '15' AND p.username = 'assistant_15'""",
)
def _(spark, sf):
    c = comments(spark, sf).withColumn("username", F.col("author.username"))
    tweets = joins.with_parent(c, {"username": "reply_to"}).withColumn("conversation_id", F.col("content_id"))
    return search.replies_to(tweets, "assistant_15", "15").select("comment_id")


_SCORE_SQL = "ln(1 + likes) + 1.5 * ln(1 + r) + 1.2 * ln(1 + shares) + 0.3 * ln(1 + views)"
_COUNTED_SQL = f"""{COMMENTS_SQL}, n AS (SELECT parent_comment_id AS comment_id, count(*) AS k FROM comments GROUP BY ALL),
    counted AS (SELECT c.*, coalesce(k, 0) AS r FROM comments c LEFT JOIN n USING (comment_id))"""


@query(
    "top_comments_per_content",
    f"""WITH {_COUNTED_SQL}, s AS (SELECT *, round({_SCORE_SQL}, 6) AS e FROM counted),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY content_id ORDER BY e DESC, comment_id) AS position FROM s)
    SELECT content_id, comment_id, position, round(e, 4) AS engagement_score FROM ranked WHERE position <= 3""",
)
def _(spark, sf):
    df = threads.top_comments(threads.reply_counts(comments(spark, sf)), 3)
    return df.select("content_id", "comment_id", "position", F.round("engagement_score", 4).alias("engagement_score"))


@query(
    "comment_engagement_weights",
    f"""WITH {_COUNTED_SQL}, s AS (SELECT *, {_SCORE_SQL} AS e FROM counted),
    b AS (SELECT content_id, min(e) AS lo, max(e) AS hi FROM s GROUP BY content_id)
    SELECT comment_id, round(CASE WHEN hi > lo THEN 0.1 + 2.9 * (e - lo) / (hi - lo) ELSE 1.0 END, 4) AS weight
    FROM s JOIN b USING (content_id)""",
)
def _(spark, sf):
    scored = threads.reply_counts(comments(spark, sf)).withColumn(
        "engagement_score",
        E.comment_engagement(F.col("likes"), F.col("reply_count"), F.col("shares"), F.col("views")),
    )
    return threads.engagement_weights(scored).select("comment_id", F.round("weight", 4).alias("weight"))


@query(
    "comment_linear_engagement",
    f"""WITH {COMMENTS_SQL} SELECT comment_id, greatest(0.1, CAST(likes + depth - turn + 3 * (shares - 2) AS DOUBLE)) AS score FROM comments""",
)
def _(spark, sf):
    score = E.raw_engagement(F.col("likes"), F.col("depth"), F.col("turn"), F.col("shares") - 2)
    return comments(spark, sf).select("comment_id", score.alias("score"))


# -- health -------------------------------------------------------------------

_RUNS_SQL = f"""{PROBES_SQL}, eras AS (
  SELECT *, sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY platform ORDER BY ts, probe_id) AS era FROM probes),
runs AS (SELECT *, row_number() OVER (PARTITION BY platform, era ORDER BY ts, probe_id) - CASE WHEN era > 0 THEN 1 ELSE 0 END AS failures FROM eras)"""
_STATUS_SQL = "CASE WHEN failures = 0 THEN 'healthy' WHEN failures < 3 THEN 'degraded' ELSE 'down' END"


@query(
    "health_history",
    f"WITH {_RUNS_SQL} SELECT probe_id, platform, failures AS consecutive_failures, {_STATUS_SQL} AS status FROM runs",
)
def _(spark, sf):
    return H.health_history(probes(spark, sf)).select("probe_id", "platform", "consecutive_failures", "status")


_CURRENT_SQL = f"""{_RUNS_SQL}, last AS (
  SELECT *, row_number() OVER (PARTITION BY platform ORDER BY ts DESC, probe_id DESC) AS back FROM runs),
okays AS (SELECT platform, max(ts) AS ok_ts FROM probes WHERE ok GROUP BY platform),
late AS (SELECT p.platform, bool_or(p.timed_out) AS t FROM runs p JOIN last l ON p.platform = l.platform AND l.back = 1
         WHERE p.era = l.era AND NOT p.ok GROUP BY p.platform),
current AS (SELECT last.platform, {_STATUS_SQL} AS status, epoch_us(ts) AS last_checked, epoch_us(ok_ts) AS last_healthy,
  failures AS consecutive_failures, response_ms AS response_time_ms,
  CASE WHEN t THEN 'Health check timeout' END AS error
  FROM last LEFT JOIN okays USING (platform) LEFT JOIN late USING (platform) WHERE back = 1)"""


def _flat_states(df):
    return df.withColumns({c: F.unix_micros(c) for c in ("last_checked", "last_healthy")})


@query("health_current", f"WITH {_CURRENT_SQL} SELECT * FROM current")
def _(spark, sf):
    return _flat_states(H.current_health(probes(spark, sf)))


@query("health_of_one_platform", f"WITH {_CURRENT_SQL} SELECT * FROM current WHERE platform = 'reddit'")
def _(spark, sf):
    return _flat_states(H.status_for(H.current_health(probes(spark, sf)), "reddit"))


@query(
    "health_overall",
    f"""WITH {_CURRENT_SQL} SELECT CASE WHEN bool_or(status = 'down') THEN 'down' WHEN bool_or(status = 'degraded') THEN 'degraded'
      ELSE 'healthy' END AS overall, count(*) AS platforms, count(*) FILTER (status = 'down') AS down,
      count(*) FILTER (status = 'degraded') AS degraded, max(last_checked) AS last_full_check FROM current""",
)
def _(spark, sf):
    df = H.overall(H.current_health(probes(spark, sf)))
    return df.withColumn("last_full_check", F.unix_micros("last_full_check"))


@query(
    "health_two_state",
    f"""WITH {PROBES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY platform ORDER BY ts DESC, probe_id DESC) AS b FROM probes)
    SELECT platform, CASE WHEN success THEN 'healthy' ELSE 'down' END AS status, epoch_us(ts) AS checked_at FROM r WHERE b = 1""",
)
def _(spark, sf):
    return H.two_state_health(probes(spark, sf)).withColumn("checked_at", F.unix_micros("checked_at"))


@query(
    "health_timeouts",
    f"WITH {PROBES_SQL} SELECT probe_id, platform FROM probes WHERE timed_out",
)
def _(spark, sf):
    return H.judged(probes(spark, sf)).filter("timed_out").select("probe_id", "platform")


@query(
    "health_freshness",
    f"""WITH {PROBES_SQL} SELECT platform, epoch_us(max(ts)) AS last_checked,
      CASE WHEN (SELECT max(ts) FROM probes) - max(ts) < INTERVAL 300 SECOND THEN 'cached' ELSE 'live' END AS source
    FROM probes GROUP BY platform""",
)
def _(spark, sf):
    p = probes(spark, sf)
    df = H.freshness(p, p.select(F.max("ts")).scalar())
    return df.withColumn("last_checked", F.unix_micros("last_checked"))


@query(
    "health_windows",
    f"""WITH {PROBES_SQL} SELECT platform, epoch_us(time_bucket(INTERVAL 5 MINUTE, ts)) AS window_start, count(*) AS probes,
      count(*) FILTER (NOT ok) AS failures, count(*) FILTER (timed_out) AS timeouts FROM probes GROUP BY ALL""",
)
def _(spark, sf):
    return H.probe_windows(probes(spark, sf)).withColumn("window_start", F.unix_micros("window_start"))


@query(
    "platforms_available",
    f"""WITH {PROBES_SQL}, a AS (SELECT DISTINCT platform FROM probes WHERE ok)
    SELECT string_agg(platform, ',' ORDER BY platform) AS available_platforms, count(*) AS total_platforms FROM a""",
)
def _(spark, sf):
    return H.available_platforms(H.current_health(probes(spark, sf)), platform_dimension(spark))


_CAP_SQL = "CASE platform " + " ".join(f"WHEN '{p}' THEN {n}" for p, n in REQUESTS_PER_MINUTE.items()) + " END"


_RATE_SQL = f"""WITH r AS (SELECT {platform_sql('user_id')} AS platform, event_id, ts FROM events),
    g AS (SELECT *, lag(ts) OVER (PARTITION BY platform ORDER BY ts, event_id) AS previous FROM r),
    s AS (SELECT *, sum(CASE WHEN previous IS NULL OR epoch_us(ts) - epoch_us(previous) > {REQUEST_GAP_SECONDS * 1_000_000} THEN 1 ELSE 0 END)
          OVER (PARTITION BY platform ORDER BY ts, event_id) AS n FROM g),
    b AS (SELECT platform, n, epoch_us(min(ts)) AS session_start, epoch_us(max(ts)) AS session_end, count(*) AS requests FROM s GROUP BY ALL)
    SELECT platform, session_start, session_end, requests, {_CAP_SQL} AS cap, requests > {_CAP_SQL} AS over_cap,
      (requests - 1) // {_CAP_SQL} AS waits FROM b"""


@query(
    "request_rate_audit",
    _RATE_SQL,
)
def _(spark, sf):
    return H.request_rates(requests(spark, sf), REQUEST_GAP_SECONDS)


# -- streams ------------------------------------------------------------------

# The test events are minutes apart, so slices are days.
SLICE = 4 * 86_400


def _streamed(spark, df, tie: str):
    """(stream, folder): ``df`` written in an order of chance and read as a stream in about four batches."""
    folder = f"{shared_folder(spark)}/streams/{uuid.uuid4().hex}"
    files = max(4, int(spark.conf.get("spark.sql.shuffle.partitions")))
    df.repartition(files, F.xxhash64(tie)).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", -(-files // 4)).parquet(f"{folder}/in")
    return stream, f"{folder}/state"


@query("health_stream", f"WITH {_CURRENT_SQL} SELECT * FROM current")
def _(spark, sf):
    """``health_current`` from a stream whose probes come in any order."""
    stream, folder = _streamed(spark, probes(spark, sf), "probe_id")
    return _flat_states(slices.stream_health(stream, folder, spark, SLICE))


@query("request_rate_stream", _RATE_SQL)
def _(spark, sf):
    """``request_rate_audit`` from a stream whose requests come in any order."""
    stream, folder = _streamed(spark, requests(spark, sf), "request_id")
    return slices.stream_request_rates(stream, folder, spark, REQUEST_GAP_SECONDS, SLICE)
