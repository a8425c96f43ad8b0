"""Search, trending, filters, lookups and expressions on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from undertone.functions import expressions as E
from undertone.operators import govern, joins, research, search
from undertone.operators import health as H
from undertone.plans.registry import query
from undertone.plans.views import (
    COMMENTS_SQL,
    EPOCH,
    FAILURES_SQL,
    PLATFORM_LIST_SQL,
    POSTS_SQL,
    comments,
    failures,
    platform_sql,
    posts,
    table,
)
from undertone.schemas import PLATFORMS, REQUESTS_PER_MINUTE, platform_dimension
from undertone.sources import posts as P
from undertone.sources import sinks
from undertone.sources.runs import run_sources

SEARCH = "that with the"
PHRASE = "of the"


def relevance_sql(content: str, needle: str) -> str:
    words = needle.split()
    terms = [f"CASE WHEN contains(lower({content}), '{needle}') THEN 10 ELSE 0 END"]
    terms += [f"CASE WHEN contains(lower({content}), '{w}') THEN 2 ELSE 0 END" for w in words]
    return f"CASE WHEN {content} IS NULL OR {content} = '' THEN 0 ELSE " + " + ".join(terms) + " END"


def _ranked_columns(df):
    return df.select("platform", "id", "relevance", "engagement_total", F.col("author.username").alias("username"))


def _search_sql(needle: str, limit: int, share: int, platforms: str | None = None) -> str:
    where = f"WHERE platform IN ({platforms})" if platforms else ""
    return f"""WITH {POSTS_SQL},
    scored AS (SELECT *, {relevance_sql('content', needle)} AS relevance FROM posts {where}),
    shared AS (SELECT *, row_number() OVER (PARTITION BY platform ORDER BY relevance DESC, ts DESC, id) AS r
               FROM scored WHERE relevance > 0)
    SELECT platform, id, relevance, likes + comments AS engagement_total, username
    FROM shared WHERE r <= {share}
    ORDER BY relevance DESC, engagement_total DESC, platform, id LIMIT {limit}"""


@query("search_combined_topk", _search_sql(SEARCH, 30, 5))
def _(spark, sf):
    return _ranked_columns(search.combined_search(posts(spark, sf), SEARCH, 30))


@query("research_sources_standard", _search_sql(PHRASE, 25, 9, "'reddit', 'twitter', 'youtube'"))
def _(spark, sf):
    return _ranked_columns(research.research_sources(posts(spark, sf), PHRASE, "standard"))


@query(
    "trending_combined_topk",
    f"""WITH {POSTS_SQL}, shared AS (
      SELECT *, likes + comments AS engagement_total,
             row_number() OVER (PARTITION BY platform ORDER BY likes + comments DESC, ts DESC, id) AS r FROM posts)
    SELECT platform, id, engagement_total, ts FROM shared WHERE r <= 5
    ORDER BY engagement_total DESC, ts DESC, platform, id LIMIT 30""",
)
def _(spark, sf):
    df = search.combined_trending(posts(spark, sf), 30)
    return df.select("platform", "id", "engagement_total", F.unix_timestamp("timestamp").alias("ts"))


@query(
    "search_posts_relevance",
    f"WITH {POSTS_SQL} SELECT * FROM (SELECT platform, id, {relevance_sql('content', SEARCH)} AS relevance "
    "FROM posts) WHERE relevance > 0",
)
def _(spark, sf):
    return search.search_posts(posts(spark, sf), SEARCH).select("platform", "id", "relevance")


@query(
    "relevance_of_query_column",
    """WITH q AS (SELECT doc_id, lower(text) AS body, text,
                  split_part(lower(text), ' ', 2) || ' ' || split_part(lower(text), ' ', 3) AS needle FROM documents)
    SELECT doc_id, CASE WHEN text = '' OR needle = '' THEN 0 ELSE
      CASE WHEN contains(body, needle) THEN 10 ELSE 0 END
      + 2 * len(list_filter(regexp_split_to_array(needle, '\\s+'), lambda w: contains(body, w))) END AS relevance
    FROM q""",
)
def _(spark, sf):
    d = table(spark, sf, "documents")
    part = lambda n: F.split_part(F.lower("text"), F.lit(" "), F.lit(n))
    needle = F.concat(part(2), F.lit(" "), part(3))
    return d.select("doc_id", E.relevance_to(F.col("text"), needle).alias("relevance"))


@query(
    "search_order_modes",
    f"""WITH {POSTS_SQL},
    top AS (SELECT 'top' AS mode, platform, id FROM posts ORDER BY likes + comments DESC, ts DESC, platform, id LIMIT 20),
    dat AS (SELECT 'date' AS mode, platform, id FROM posts ORDER BY ts DESC, platform, id LIMIT 20),
    rel AS (SELECT 'relevance' AS mode, platform, id FROM posts
            ORDER BY {relevance_sql('content', PHRASE)} DESC, ts DESC, platform, id LIMIT 20)
    SELECT * FROM top UNION ALL SELECT * FROM dat UNION ALL SELECT * FROM rel""",
)
def _(spark, sf):
    df = posts(spark, sf)
    parts = [
        search.ordered_slice(df, mode, 20, PHRASE).select(F.lit(mode).alias("mode"), "platform", "id")
        for mode in ("top", "date", "relevance")
    ]
    return search.union_sources(parts)


@query(
    "posts_of_user",
    f"WITH {POSTS_SQL} SELECT platform, id, ts FROM posts WHERE username = 'src3'",
)
def _(spark, sf):
    return search.user_posts(posts(spark, sf), "@src3").select(
        "platform", "id", F.unix_timestamp("timestamp").alias("ts")
    )


@query("posts_with_tag", f"WITH {POSTS_SQL} SELECT platform, id FROM posts WHERE list_contains(hashtags, '#fr')")
def _(spark, sf):
    return search.tagged_posts(posts(spark, sf), "#fr").select("platform", "id")


@query(
    "trending_hashtags",
    f"""WITH {POSTS_SQL}, tags AS (SELECT unnest(hashtags) AS hashtag, likes + comments AS s FROM posts)
    SELECT hashtag, count(*) AS post_count, CAST(sum(s) AS BIGINT) AS engagement_score FROM tags GROUP BY hashtag""",
)
def _(spark, sf):
    return search.trending_hashtags(posts(spark, sf))


@query(
    "top_trend_posts",
    f"""WITH {POSTS_SQL}, tags AS (SELECT unnest(hashtags) AS hashtag, likes + comments AS s FROM posts),
    top AS (SELECT hashtag FROM tags GROUP BY hashtag ORDER BY count(*) DESC, sum(s) DESC, hashtag LIMIT 1)
    SELECT platform, id FROM posts, top WHERE list_contains(hashtags, hashtag)
    ORDER BY ts DESC, platform, id LIMIT 10""",
)
def _(spark, sf):
    return search.top_trend_posts(posts(spark, sf)).select("platform", "id")


@query(
    "newest_per_platform",
    f"""WITH {POSTS_SQL}, ranked AS (
      SELECT platform, id, row_number() OVER (PARTITION BY platform ORDER BY ts DESC, platform, id) AS source_rank
      FROM posts)
    SELECT * FROM ranked WHERE source_rank <= 60""",
)
def _(spark, sf):
    df = search.top_per_platform(posts(spark, sf), 60, search.source_order("date"))
    return df.select("platform", "id", F.col("source_rank").cast("bigint").alias("source_rank"))


@query("post_counts", f"WITH {POSTS_SQL} SELECT platform, count(*) AS count FROM posts GROUP BY platform")
def _(spark, sf):
    return posts(spark, sf).groupBy("platform").count()


@query(
    "union_of_sources",
    f"""WITH {POSTS_SQL} SELECT platform, id, CASE WHEN platform <> 'moltbook' THEN likes END AS likes FROM posts""",
)
def _(spark, sf):
    df = posts(spark, sf).select("platform", "id", F.col("engagement.likes").alias("likes"))
    plain = [df.filter(F.col("platform") == name) for name in PLATFORMS if name != "moltbook"]
    return search.union_sources([*plain, df.filter("platform = 'moltbook'").drop("likes")])


@query(
    "union_without_failed_source",
    f"WITH {POSTS_SQL} SELECT platform, count(*) AS n FROM posts WHERE platform <> 'tiktok' GROUP BY platform",
)
def _(spark, sf):
    df = posts(spark, sf)

    def unreadable():
        return spark.read.parquet(f"{sf}/no_such_source.parquet")

    readers = {p: (lambda p=p: df.filter(F.col("platform") == p)) for p in REQUESTS_PER_MINUTE}
    readers["tiktok"] = unreadable
    union, _, _ = search.union_available(readers)
    return union.groupBy("platform").agg(F.count(F.lit(1)).alias("n"))


@query(
    "sources_that_ran",
    f"""WITH {POSTS_SQL}, bad AS (SELECT platform FROM posts GROUP BY platform HAVING max(length(content)) >= (SELECT max(length(content)) FROM posts))
    SELECT platform AS source, count(*) AS n, NULL AS message FROM posts WHERE platform NOT IN (SELECT platform FROM bad) GROUP BY platform
    UNION ALL SELECT platform, NULL, 'text too long' FROM bad""",
)
def _(spark, sf):
    """Every platform run by itself; one that meets the longest text fails there, in its task."""
    df = posts(spark, sf)
    longest = df.select(F.max(F.length("content"))).scalar()
    too_long = F.raise_error(F.lit("text too long")).cast("string")
    checked = df.withColumn("content", F.when(F.length("content") >= longest, too_long).otherwise(F.col("content")))
    found, errors = run_sources(spark, {p: (lambda p=p: checked.filter(F.col("platform") == p)) for p in REQUESTS_PER_MINUTE})
    counted = found.groupBy(F.col("platform").alias("source")).agg(F.count(F.lit(1)).alias("n"), F.lit(None).cast("string").alias("message"))
    said = F.regexp_extract("message", "text too long", 0)
    return counted.unionByName(errors.select("source", F.lit(None).cast("bigint").alias("n"), said.alias("message")))


@query(
    "capture_or_model_rows",
    """WITH r AS (SELECT doc_id AS request_id FROM documents),
    c AS (SELECT doc_id AS request_id, n_chars FROM documents WHERE n_chars % 3 > 0),
    m AS (SELECT doc_id AS request_id, length(source) AS n_chars FROM documents WHERE n_chars % 2 = 0)
    SELECT request_id, n_chars, 'capture' AS origin FROM c
    UNION ALL SELECT request_id, n_chars, 'model' FROM m WHERE request_id NOT IN (SELECT request_id FROM c)""",
)
def _(spark, sf):
    d = table(spark, sf, "documents").withColumnRenamed("doc_id", "request_id")
    captured = d.filter("n_chars % 3 > 0").select("request_id", "n_chars")
    answered = d.filter("n_chars % 2 = 0").select("request_id", F.length("source").cast("bigint").alias("n_chars"))
    return search.with_fallback(d.select("request_id"), captured, answered)


# -- expressions --------------------------------------------------------------

@query(
    "engagement_rates",
    f"""WITH {POSTS_SQL} SELECT id, CASE WHEN followers = 0 THEN 0.0
      ELSE round((likes + comments + shares) / followers * 100, 6) END AS engagement_rate FROM posts""",
)
def _(spark, sf):
    e = lambda n: F.col(f"engagement.{n}")
    rate = E.engagement_rate(e("likes"), e("comments"), e("shares"), F.col("author.follower_count"))
    return posts(spark, sf).select("id", F.round(rate, 6).alias("engagement_rate"))


@query(
    "sanitized_texts",
    r"""SELECT doc_id, md5(regexp_replace(regexp_replace(text,
      '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g'), '^\s+|\s+$', '', 'g')) AS clean FROM documents""",
)
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(E.sanitize(F.col("text"))).alias("clean"))


@query(
    "text_hashtags",
    r"""WITH t AS (SELECT doc_id, text || ' #' || source || ' #Été_' || lang || '.' AS body FROM documents)
    SELECT doc_id, array_to_string(list_transform(regexp_extract_all(body, '#[\wÀ-ɏḀ-ỿ]+'), lambda x: lower(x)), ',') AS lowered,
           array_to_string(list_transform(regexp_extract_all(body, '#\w+'), lambda x: substr(x, 2)), ',') AS plain
    FROM t""",
)
def _(spark, sf):
    body = F.concat("text", F.lit(" #"), "source", F.lit(" #Été_"), "lang", F.lit("."))
    return table(spark, sf, "documents").select(
        "doc_id",
        F.array_join(E.hashtags_lower(body), ",").alias("lowered"),
        F.array_join(E.hashtags_plain(body), ",").alias("plain"),
    )


@query(
    "handles_and_tags",
    """SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN source ELSE '@' || source END AS given,
      source AS stripped, '@' || source AS handle, lang AS tag FROM documents""",
)
def _(spark, sf):
    given = F.when(F.col("doc_id") % 2 == 0, F.col("source")).otherwise(F.concat(F.lit("@"), "source"))
    return table(spark, sf, "documents").select(
        "doc_id", given.alias("given"), E.strip_handle(given).alias("stripped"),
        E.as_handle(given).alias("handle"), E.strip_tag(F.concat(F.lit("#"), "lang")).alias("tag"),
    )


@query(
    "mixed_timestamps",
    f"""SELECT event_id, CASE event_id % 4 WHEN 1 THEN epoch_us(ts) // 1000 WHEN 3 THEN {EPOCH}::BIGINT * 1000
      ELSE epoch_us(ts) // 1000000 * 1000 END AS at_ms
    FROM events""",
)
def _(spark, sf):
    ts = F.col("ts").cast("timestamp")
    kind = F.col("event_id") % 4
    raw = (
        F.when(kind == 0, F.unix_timestamp(ts).cast("string"))
        .when(kind == 1, F.unix_millis(ts).cast("string"))
        .when(kind == 2, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    )
    fixed = E.normalize_timestamp(raw, F.timestamp_seconds(F.lit(EPOCH)))
    return table(spark, sf, "events").select("event_id", F.unix_millis(fixed).alias("at_ms"))


_URLS_SQL = """urls AS (
  SELECT page_id, CASE page_id % 8
    WHEN 0 THEN 'https://www.tiktok.com/@user/video/' || (page_id + 1000)
    WHEN 1 THEN 'https://m.tiktok.com/share?item_id=' || (page_id + 2000)
    WHEN 2 THEN 'https://www.instagram.com/reel/Ab_' || page_id || '/'
    WHEN 3 THEN 'https://instagram.com/p/Cd-' || page_id || '?x=1'
    WHEN 4 THEN 'https://x.com/someone/status/' || (page_id + 3000)
    WHEN 5 THEN 'https://www.youtube.com/watch?v=' || page_id
    WHEN 6 THEN url ELSE 'id_' || page_id END AS url FROM pages)"""


def _urls(spark, sf):
    p, n = table(spark, sf, "pages"), F.col("page_id")
    shapes = [
        F.concat(F.lit("https://www.tiktok.com/@user/video/"), n + 1000),
        F.concat(F.lit("https://m.tiktok.com/share?item_id="), n + 2000),
        F.concat(F.lit("https://www.instagram.com/reel/Ab_"), n, F.lit("/")),
        F.concat(F.lit("https://instagram.com/p/Cd-"), n, F.lit("?x=1")),
        F.concat(F.lit("https://x.com/someone/status/"), n + 3000),
        F.concat(F.lit("https://www.youtube.com/watch?v="), n),
        F.col("url"),
    ]
    url = F.concat(F.lit("id_"), n)
    for place, shape in enumerate(shapes):
        url = F.when(n % 8 == place, shape).otherwise(url)
    return p.select("page_id", url.alias("url"))


@query(
    "content_ids_from_urls",
    f"""WITH {_URLS_SQL} SELECT page_id,
      CASE WHEN contains(url, 'tiktok.com') THEN 'tiktok' WHEN contains(url, 'instagram.com') THEN 'instagram'
           WHEN contains(url, 'x.com') OR contains(url, 'twitter.com') THEN 'twitter'
           WHEN contains(url, 'xiaohongshu.com') THEN 'xiaohongshu' WHEN contains(url, 'reddit.com') THEN 'reddit'
           WHEN contains(url, 'youtube.com') THEN 'youtube' ELSE 'twitter' END AS platform,
      CASE page_id % 8 WHEN 0 THEN CAST(page_id + 1000 AS VARCHAR) WHEN 1 THEN CAST(page_id + 2000 AS VARCHAR)
        WHEN 2 THEN 'Ab_' || page_id WHEN 3 THEN 'Cd-' || page_id WHEN 4 THEN CAST(page_id + 3000 AS VARCHAR)
        ELSE url END AS content_id,
      page_id % 8 = 2 AS is_reel FROM urls""",
)
def _(spark, sf):
    url = F.col("url")
    platform = E.platform_of_url(url)
    return _urls(spark, sf).select(
        "page_id", platform.alias("platform"), E.resolve_content_id(platform, url).alias("content_id"),
        (E.is_instagram_url(url) & E.is_reel_url(url)).alias("is_reel"),
    )


# -- lookups ------------------------------------------------------------------

@query(
    "posts_with_capabilities",
    f"""WITH {POSTS_SQL}, dims AS (SELECT unnest({PLATFORM_LIST_SQL}) AS platform)
    SELECT id, platform, TRUE AS supports_search, TRUE AS supports_comments,
      CASE platform WHEN 'tiktok' THEN 5 WHEN 'twitter' THEN 20 WHEN 'reddit' THEN 60 WHEN 'instagram' THEN 5
        WHEN 'youtube' THEN 20 WHEN 'moltbook' THEN 60 ELSE 3 END AS requests_per_minute
    FROM posts LEFT JOIN dims USING (platform)""",
)
def _(spark, sf):
    df = joins.with_capabilities(posts(spark, sf), platform_dimension(spark))
    return df.select("id", "platform", "supports_search", "supports_comments", "requests_per_minute")


@query(
    "videos_with_statistics",
    """WITH items AS (SELECT doc_id AS video_id, lang FROM documents),
    stats AS (SELECT doc_id AS video_id, quality AS likes, toxic AS comments, quality + toxic AS views FROM labels)
    SELECT video_id, lang, CAST(coalesce(likes, 0) AS BIGINT) AS likes, CAST(coalesce(comments, 0) AS BIGINT) AS comments,
      CAST(coalesce(views, 0) AS BIGINT) AS views FROM items LEFT JOIN stats USING (video_id)""",
)
def _(spark, sf):
    items = table(spark, sf, "documents").select(F.col("doc_id").alias("video_id"), "lang")
    stats = table(spark, sf, "labels").select(
        F.col("doc_id").alias("video_id"), F.col("quality").alias("likes"), F.col("toxic").alias("comments"),
        (F.col("quality") + F.col("toxic")).alias("views"),
    )
    return joins.with_video_stats(items, stats)


@query(
    "channels_from_handles",
    """WITH wanted AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'UC' || source WHEN doc_id % 3 = 1 THEN '@' || source
                       ELSE source || CASE WHEN doc_id % 4 = 0 THEN 'x' ELSE '' END END AS channel, source FROM documents)
    SELECT doc_id, channel, CASE WHEN doc_id % 3 = 0 THEN channel WHEN doc_id % 3 = 2 AND doc_id % 4 = 0 THEN NULL
      ELSE 'UC' || source END AS channel_id,
      CASE WHEN doc_id % 3 = 2 AND doc_id % 4 = 0 THEN 'NOT_FOUND' END AS error FROM wanted""",
)
def _(spark, sf):
    d, n, name = table(spark, sf, "documents"), F.col("doc_id"), F.col("source")
    wanted = d.select(
        "doc_id",
        F.when(n % 3 == 0, F.concat(F.lit("UC"), name)).when(n % 3 == 1, F.concat(F.lit("@"), name))
        .otherwise(F.concat(name, F.when(n % 4 == 0, "x").otherwise(""))).alias("channel"),
    )
    channels = d.select(
        F.concat(F.lit("@"), name).alias("handle"), F.concat(F.lit("UC"), name).alias("channel_id")
    ).distinct()
    return joins.resolve_channels(wanted, channels)


@query(
    "posts_with_comment_counts",
    f"""WITH {COMMENTS_SQL}, p AS (SELECT {platform_sql('doc_id')} AS platform, CAST(doc_id AS VARCHAR) AS id FROM documents),
    c AS (SELECT platform, content_id AS id, count(*) AS n, sum(likes) AS l FROM comments GROUP BY ALL)
    SELECT platform, id, coalesce(n, 0) AS comment_rows, CAST(coalesce(l, 0) AS BIGINT) AS comment_likes
    FROM p LEFT JOIN c USING (platform, id)""",
)
def _(spark, sf):
    df = joins.posts_with_comment_counts(posts(spark, sf), comments(spark, sf))
    return df.select("platform", "id", "comment_rows", "comment_likes")


@query(
    "users_latest",
    f"""WITH {POSTS_SQL} SELECT platform, author_id AS user_id, username, max(ts) AS last_seen,
      CAST(arg_max(followers, ts) AS BIGINT) AS follower_count, arg_max(verified, ts) AS verified
    FROM posts GROUP BY ALL""",
)
def _(spark, sf):
    return P.users_dimension(posts(spark, sf)).select(
        "platform", F.col("id").alias("user_id"), "username", F.unix_timestamp("last_seen_at").alias("last_seen"),
        "follower_count", "verified",
    )


@query(
    "source_diversity",
    f"""WITH {POSTS_SQL} SELECT platform, count(*) AS posts, count(DISTINCT author_id) AS authors,
      CAST(sum(likes + comments) AS BIGINT) AS engagement FROM posts GROUP BY platform""",
)
def _(spark, sf):
    return research.source_diversity(posts(spark, sf))


@query(
    "opinion_leaders",
    f"""WITH {POSTS_SQL} SELECT platform, username, count(*) AS posts, CAST(sum(likes + comments) AS BIGINT) AS engagement
    FROM posts GROUP BY ALL ORDER BY engagement DESC, platform, username LIMIT 10""",
)
def _(spark, sf):
    return research.opinion_leaders(posts(spark, sf))


_TOPICS_SQL = """tagged AS (SELECT unnest(list_distinct(hashtags)) AS topic, platform, author_id, username, likes + comments AS e FROM posts)"""


@query(
    "topic_diversity",
    f"""WITH {POSTS_SQL}, {_TOPICS_SQL}, p AS (SELECT topic, platform, count(*) AS n FROM tagged GROUP BY ALL),
    main AS (SELECT topic, platform AS main_platform, n / sum(n) OVER (PARTITION BY topic) AS share,
      row_number() OVER (PARTITION BY topic ORDER BY n DESC, platform DESC) AS r FROM p),
    t AS (SELECT topic, count(*) AS posts, count(DISTINCT platform) AS platforms, count(DISTINCT (platform, author_id)) AS authors,
      CAST(sum(e) AS BIGINT) AS engagement FROM tagged GROUP BY topic)
    SELECT t.*, main_platform, round(share, 4) AS main_share FROM t JOIN main USING (topic) WHERE r = 1""",
)
def _(spark, sf):
    return research.topic_diversity(posts(spark, sf))


@query(
    "topic_leaders",
    f"""WITH {POSTS_SQL}, {_TOPICS_SQL}, s AS (SELECT topic, platform, username, count(*) AS posts, CAST(sum(e) AS BIGINT) AS engagement FROM tagged GROUP BY ALL)
    SELECT *, row_number() OVER (PARTITION BY topic ORDER BY engagement DESC, platform, username) AS rank FROM s QUALIFY rank <= 3""",
)
def _(spark, sf):
    return research.topic_leaders(posts(spark, sf))


@query(
    "research_themes",
    f"""WITH {POSTS_SQL}, scored AS (SELECT *, {relevance_sql('content', PHRASE)} AS relevance FROM posts
                                     WHERE platform IN ('reddit', 'twitter', 'youtube')),
    shared AS (SELECT *, row_number() OVER (PARTITION BY platform ORDER BY relevance DESC, ts DESC, id) AS r
               FROM scored WHERE relevance > 0),
    s AS (SELECT * FROM shared WHERE r <= 17 ORDER BY relevance DESC, likes + comments DESC, platform, id LIMIT 50),
    t AS (SELECT platform, username, likes + comments AS e, unnest(hashtags) AS theme FROM s)
    SELECT theme, count(*) AS posts, count(DISTINCT platform) AS platforms, count(DISTINCT username) AS authors,
      CAST(sum(e) AS BIGINT) AS engagement FROM t GROUP BY theme""",
)
def _(spark, sf):
    return research.research_themes(research.research_sources(posts(spark, sf), PHRASE, "deep"))


@query(
    "search_result_envelope",
    f"""WITH {POSTS_SQL}, r AS (SELECT id, platform, likes + comments AS e FROM posts
      WHERE platform = 'reddit' ORDER BY e DESC, id LIMIT 10)
    SELECT 'reddit' AS platform, 'top' AS query, count(*) AS count, string_agg(id, ',' ORDER BY e DESC, id) AS ids FROM r""",
)
def _(spark, sf):
    top = posts(spark, sf).filter("platform = 'reddit'").select("id", "content", search.engagement_of().alias("e"))
    df = sinks.result_envelope(top, 10, "posts", [F.desc("e"), F.col("id")], platform="reddit", query="top")
    return df.select("platform", "query", "count", F.array_join(F.transform("posts", lambda p: p["id"]), ",").alias("ids"))


# -- errors, arguments, contract ----------------------------------------------

_CODE_SQL = """CASE WHEN status = 429 OR (platform IN ('reddit', 'moltbook') AND contains(message, 'rate limit'))
      OR (platform = 'youtube' AND reason IN ('quotaExceeded', 'rateLimitExceeded')) THEN 'RATE_LIMIT'
    WHEN status IN (401, 403) THEN 'authentication_error' WHEN status = 404 THEN 'not_found' ELSE 'unknown_error' END"""
_DISABLED_SQL = """coalesce(platform = 'youtube' AND operation = 'comments' AND status = 403
      AND reason = 'commentsDisabled', FALSE)"""


@query("error_codes", f"WITH {FAILURES_SQL} SELECT failure_id, platform, {_CODE_SQL} AS code FROM failures")
def _(spark, sf):
    code = E.error_code(F.col("platform"), F.col("status"), F.col("message"), F.col("reason"))
    return failures(spark, sf).select("failure_id", "platform", code.alias("code"))


@query(
    "error_report",
    f"""WITH {FAILURES_SQL} SELECT platform, {_CODE_SQL} AS code, count(*) AS errors, epoch_us(max(ts)) AS last_seen
    FROM failures WHERE NOT {_DISABLED_SQL} GROUP BY ALL""",
)
def _(spark, sf):
    return H.error_report(failures(spark, sf)).withColumn("last_seen", F.unix_micros("last_seen"))


@query(
    "retry_queue",
    f"""WITH {FAILURES_SQL} SELECT failure_id, status, 'retry_with_backoff' AS action FROM failures
    WHERE status = 429 OR status >= 500""",
)
def _(spark, sf):
    return govern.retry_queue(failures(spark, sf)).select("failure_id", "status", "action")


@query(
    "request_argument_violations",
    """WITH r AS (SELECT doc_id AS request_id, CASE doc_id % 3 WHEN 0 THEN 'search' WHEN 1 THEN 'user' ELSE 'comments' END AS operation,
      CASE WHEN doc_id % 5 = 0 THEN ' ' ELSE source END AS arg, n_chars AS lim FROM documents)
    SELECT request_id, operation, CASE operation WHEN 'search' THEN 'query_empty' WHEN 'user' THEN 'user_id_empty'
      ELSE 'content_id_empty' END AS rule FROM r WHERE trim(arg) = ''
    UNION ALL SELECT request_id, operation, 'limit_out_of_range' FROM r WHERE lim < 1 OR lim > 1000""",
)
def _(spark, sf):
    n = F.col("doc_id")
    arg = F.when(n % 5 == 0, " ").otherwise(F.col("source"))
    operation = F.when(n % 3 == 0, "search").when(n % 3 == 1, "user").otherwise("comments")
    r = table(spark, sf, "documents").select(
        n.alias("request_id"), operation.alias("operation"), arg.alias("user_id"), arg.alias("content_id"),
        arg.alias("query"), F.col("n_chars").alias("limit"),
    )
    return govern.argument_violations(r)


@query(
    "post_contract_violations",
    f"""WITH {POSTS_SQL} SELECT CASE WHEN CAST(id AS BIGINT) % 19 = 0 THEN 'myspace' ELSE platform END AS platform,
      id, rule FROM posts, (SELECT unnest(['platform', 'engagement.likes', 'url']) AS rule) WHERE
      (rule = 'platform' AND CAST(id AS BIGINT) % 19 = 0) OR (rule = 'engagement.likes' AND likes - 3 < 0)
      OR (rule = 'url' AND CAST(id AS BIGINT) % 23 = 0)""",
)
def _(spark, sf):
    n = F.col("id").cast("bigint")
    broken = posts(spark, sf).withColumns(
        {
            "platform": F.when(n % 19 == 0, "myspace").otherwise(F.col("platform")),
            "engagement": F.col("engagement").withField("likes", F.col("engagement.likes") - 3),
            "url": F.when(n % 23 != 0, F.col("url")),
        }
    )
    return govern.post_violations(broken)


@query(
    "missing_platforms",
    f"""WITH {POSTS_SQL} SELECT platform FROM (SELECT unnest({PLATFORM_LIST_SQL}) AS platform)
    WHERE platform NOT IN (SELECT platform FROM posts WHERE likes + comments > 1040)""",
)
def _(spark, sf):
    busy = posts(spark, sf).filter(search.engagement_of() > 1040)
    return govern.missing_platforms(busy, platform_dimension(spark))


@query(
    "redacted_texts",
    r"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
      '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '[email]', 'g'),
      '\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b', '[ip]', 'g'),
      '\b[0-9]{13,16}\b', '[card]', 'g'), '\+?[0-9][0-9 ().-]{7,}[0-9]', '[phone]', 'g')) AS redacted FROM documents""",
)
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(govern.redact(F.col("text"))).alias("redacted"))
