"""Captures to silver tables on the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undertone.operators import govern
from undertone.plans.payloads import (
    KEPT_SQL,
    POST_ENDPOINTS,
    comment_captures,
    comments_sql,
    model_responses,
    post_captures,
)
from undertone.plans.registry import query
from undertone.plans.views import EPOCH, platform_sql, table
from undertone.schemas import PLATFORMS
from undertone.sources import captures as K
from undertone.sources import comments as M
from undertone.sources import posts as P
from undertone.sources import responses as R
from undertone.sources import sinks


def bronze(spark, sf) -> DataFrame:
    return K.dedup_captures(K.filter_captures(post_captures(spark, sf)))


# -- captures -----------------------------------------------------------------

_KEPT = f"""kept AS (SELECT *, {platform_sql('doc_id')} AS platform FROM documents WHERE {KEPT_SQL})"""

@query(
    "captures_kept",
    f"""WITH {_KEPT} SELECT platform, CASE platform WHEN 'tiktok' THEN '/api/post/item_list/'
      WHEN 'instagram' THEN '/graphql/query/' WHEN 'xiaohongshu' THEN '/api/sns/web/v1/feed' END AS matched_pattern,
      count(*) + count(*) FILTER (doc_id % 5 = 0) AS captures FROM kept GROUP BY ALL""",
)
def _(spark, sf):
    df = K.filter_captures(post_captures(spark, sf))
    return df.groupBy("platform", "matched_pattern").agg(F.count(F.lit(1)).alias("captures"))


@query("captures_distinct", f"WITH {_KEPT} SELECT platform, doc_id || '-0' AS capture_id FROM kept")
def _(spark, sf):
    return bronze(spark, sf).select("platform", "capture_id")


@query(
    "captures_for_pattern",
    f"WITH {_KEPT} SELECT doc_id || '-0' AS capture_id FROM kept WHERE platform = 'instagram'",
)
def _(spark, sf):
    return K.captures_for(bronze(spark, sf), "/graphql/query/").select("capture_id")


@query(
    "capture_envelopes",
    f"""WITH {_KEPT}, b AS (SELECT doc_id, 'https://x.com/i/api/search?cursor=' || doc_id AS url, text AS body FROM kept
                           WHERE platform = 'twitter')
    SELECT doc_id, url AS source_url, sha256(body) AS raw_hash, sha256('twitter|' || url || '|' || sha256(body)) AS idempotency_key
    FROM b""",
)
def _(spark, sf):
    """Envelope of plain-text bodies, so that both engines hash the same bytes."""
    texts = table(spark, sf, "documents").select("doc_id", F.col("text").alias("plain"))
    b = bronze(spark, sf).filter("platform = 'twitter'")
    joined = b.withColumn("doc_id", F.split_part("capture_id", F.lit("-"), F.lit(1)).cast("bigint")).join(texts, "doc_id")
    return K.with_envelope(joined, "trace-1", "search_content", body="plain").select(
        "doc_id", "source_url", "raw_hash", "idempotency_key"
    )


_ENDPOINT_SQL = "CASE platform " + " ".join(f"WHEN '{p}' THEN '{url}'" for p, url in POST_ENDPOINTS.items()) + " END"


@query(
    "capture_envelopes_all",
    f"""WITH {_KEPT}, b AS (SELECT doc_id, platform, {_ENDPOINT_SQL} || doc_id AS url, text AS body FROM kept)
    SELECT doc_id, platform, url AS source_url, sha256(body) AS raw_hash,
      sha256(platform || '|' || url || '|' || sha256(body)) AS idempotency_key FROM b""",
)
def _(spark, sf):
    """Envelopes of all platforms, of plain-text bodies as in ``capture_envelopes``."""
    texts = table(spark, sf, "documents").select("doc_id", F.col("text").alias("plain"))
    b = bronze(spark, sf).withColumn("doc_id", F.split_part("capture_id", F.lit("-"), F.lit(1)).cast("bigint"))
    return K.with_envelope(b.join(texts, "doc_id"), "trace-1", "search_content", body="plain").select(
        "doc_id", "platform", "source_url", "raw_hash", "idempotency_key"
    )


@query(
    "captures_not_ingested",
    f"WITH {_KEPT} SELECT doc_id || '-0' AS capture_id FROM kept WHERE n_chars % 2 = 1",
)
def _(spark, sf):
    old = table(spark, sf, "documents").filter("n_chars % 2 = 0").select("doc_id")
    incoming = K.with_envelope(K.filter_captures(post_captures(spark, sf)), "trace-2", "search_content")
    ids = F.split_part("capture_id", F.lit("-"), F.lit(1)).cast("bigint")
    existing = incoming.withColumn("doc_id", ids).join(old, "doc_id", "left_semi").select("idempotency_key")
    return K.merge_new(incoming, existing).select("capture_id")


@query(
    "captures_of_unknown_platforms",
    f"WITH p AS (SELECT doc_id, {platform_sql('doc_id')} AS platform FROM documents) "
    "SELECT doc_id || '-0' AS capture_id FROM p WHERE doc_id % 37 = 0 UNION ALL "
    "SELECT doc_id || '-1' FROM p WHERE doc_id % 37 = 0 AND doc_id % 5 = 0",
)
def _(spark, sf):
    number = F.split_part("capture_id", F.lit("-"), F.lit(1)).cast("bigint")
    df = post_captures(spark, sf).withColumn(
        "platform", F.when(number % 37 == 0, "friendster").otherwise(F.col("platform"))
    )
    return P.unsupported(df).select("capture_id")


@query(
    "captures_quarantined",
    "SELECT doc_id || '-0' AS capture_id FROM documents WHERE doc_id % 41 = 0 UNION ALL "
    "SELECT doc_id || '-1' FROM documents WHERE doc_id % 41 = 0 AND doc_id % 5 = 0",
)
def _(spark, sf):
    number = F.split_part("capture_id", F.lit("-"), F.lit(1)).cast("bigint")
    cut = F.when(number % 41 == 0, F.left("body", F.length("body") - 1)).otherwise(F.col("body"))
    return K.quarantined(post_captures(spark, sf).withColumn("body", cut)).select("capture_id")


# -- posts --------------------------------------------------------------------

def flat(df: DataFrame) -> DataFrame:
    return df.select(
        "id",
        F.col("author.id").alias("author_id"),
        F.col("author.username").alias("username"),
        F.col("author.display_name").alias("display_name"),
        F.col("author.follower_count").alias("followers"),
        F.md5("content").alias("content_md5"),
        F.col("engagement.likes").alias("likes"),
        F.col("engagement.comments").alias("comments"),
        F.col("engagement.shares").alias("shares"),
        F.col("engagement.views").alias("views"),
        F.unix_timestamp("timestamp").alias("ts"),
        "url",
        F.array_join("hashtags", ",").alias("tags"),
    )


_TAGS_LOWER = r"array_to_string(list_transform(regexp_extract_all(text, '#[\wÀ-ɏḀ-ỿ]+'), lambda x: lower(x)), ',')"
_TAGS_PLAIN = r"array_to_string(list_transform(regexp_extract_all(text, '#\w+'), lambda x: substr(x, 2)), ',')"


def _post_sql(platform: str, **columns: str) -> str:
    values = {
        "id": "CAST(doc_id AS VARCHAR)", "author_id": "'u_' || source", "username": "source",
        "display_name": "'n ' || source", "followers": "NULL", "content_md5": "md5(text)", "likes": "n_chars % 997",
        "comments": "doc_id % 53", "shares": "doc_id % 17", "views": "n_chars", "ts": f"{EPOCH} + doc_id",
        "url": "''", "tags": "lang || ',' || source", **columns,
    }
    listed = ", ".join(f"{v} AS {k}" for k, v in values.items())
    return f"WITH {_KEPT} SELECT {listed} FROM kept WHERE platform = '{platform}'"


_POST_ORACLES = {
    "tiktok": _post_sql("tiktok", followers="n_chars", url="'https://www.tiktok.com/@' || source || '/video/' || doc_id"),
    "twitter": _post_sql("twitter", url="'https://x.com/' || source || '/status/' || doc_id", tags="lang"),
    "reddit": _post_sql(
        "reddit", author_id="source", display_name="source", shares="0", views="0", tags="''",
        content_md5="md5(CASE WHEN doc_id % 4 = 0 OR text = '' THEN 't ' || doc_id ELSE text END)",
        url="'https://reddit.com/r/' || lang || '/' || doc_id",
    ),
    "instagram": _post_sql("instagram", shares="NULL", tags=_TAGS_PLAIN, url="'https://www.instagram.com/p/s' || doc_id || '/'"),
    "youtube": _post_sql(
        "youtube", display_name="source", followers="0", shares="0", tags=_TAGS_LOWER,
        url="'https://www.youtube.com/watch?v=' || doc_id",
    ),
    "moltbook": _post_sql("moltbook", url="'https://moltbook.com/m/' || lang || '/posts/' || doc_id"),
    "xiaohongshu": _post_sql("xiaohongshu", display_name="source", url="'https://www.xiaohongshu.com/explore/' || doc_id"),
}


def _normalized(platform: str):
    return lambda spark, sf: flat(P.normalize_posts(bronze(spark, sf), platform))


for _platform, _sql in _POST_ORACLES.items():
    query(f"posts_normalized_{_platform}", _sql)(_normalized(_platform))


def _shared(platform: str, shape: str):
    def run(spark, sf):
        items = P.explode_posts(bronze(spark, sf), platform)
        return flat(P.normalize_shape(items, shape))

    return run


query(
    "posts_shared_rules_tiktok",
    _post_sql(
        "tiktok", id="CAST(doc_id AS VARCHAR)", username="source", followers="n_chars", tags=_TAGS_LOWER, url="NULL",
    ),
)(_shared("tiktok", "tiktok_shared"))
query(
    "posts_shared_rules_twitter",
    _post_sql("twitter", followers="0", url="'https://twitter.com/' || source || '/status/' || doc_id", tags="lang"),
)(_shared("twitter", "twitter_shared"))
query(
    "posts_shared_rules_instagram",
    _post_sql(
        "instagram", shares="0", followers="0",
        views="CASE WHEN (doc_id // 7) % 3 = 2 THEN 0 ELSE n_chars END",
        tags=f"CASE WHEN (doc_id // 7) % 3 = 2 THEN {_TAGS_LOWER} ELSE '' END",
        url="'https://www.instagram.com/p/s' || doc_id || '/'",
    ),
)(_shared("instagram", "instagram_shared"))


@query(
    "posts_normalized_all",
    f"""WITH {_KEPT} SELECT platform, count(*) AS posts, CAST(sum(n_chars % 997) AS BIGINT) AS likes, max({EPOCH} + doc_id) AS latest
    FROM kept GROUP BY platform""",
)
def _(spark, sf):
    df = P.normalize_all_posts(bronze(spark, sf), PLATFORMS)
    return df.groupBy("platform").agg(
        F.count(F.lit(1)).alias("posts"), F.sum("engagement.likes").alias("likes"),
        F.max(F.unix_timestamp("timestamp")).alias("latest"),
    )


# -- comments -----------------------------------------------------------------

def flat_comments(df: DataFrame) -> DataFrame:
    return df.select(
        "content_id", "comment_id", "parent_comment_id", "thread_root_id", "depth",
        F.col("author.id").alias("author_id"), F.col("author.username").alias("username"),
        F.md5("text").alias("text_md5"), F.unix_timestamp("timestamp").alias("ts"), "likes", "reply_count",
    )


def _threads(platform: str):
    def run(spark, sf):
        return flat_comments(M.normalize_threads(K.filter_captures(comment_captures(spark, sf)), platform, None))

    return run


_THREAD_LEVELS = {"tiktok": 3, "instagram": 3, "xiaohongshu": 3, "reddit": 3, "youtube": 2, "moltbook": 3, "twitter": 1}
for _platform, _levels in _THREAD_LEVELS.items():
    query(
        f"comments_normalized_{_platform}",
        comments_sql(_platform, _levels, "" if _platform == "reddit" else "u_"),
    )(_threads(_platform))


@query(
    "comments_normalized_all",
    """WITH c AS (SELECT conv_id % 7 AS p FROM conversations)
    SELECT ['tiktok', 'twitter', 'reddit', 'instagram', 'youtube', 'moltbook', 'xiaohongshu'][CAST(p AS INT) + 1] AS platform, depth, count(*) AS comments
    FROM c, (SELECT unnest([0, 1, 2]) AS depth) WHERE depth < CASE p WHEN 1 THEN 1 WHEN 4 THEN 2 ELSE 3 END GROUP BY ALL""",
)
def _(spark, sf):
    df = M.normalize_all_comments(K.filter_captures(comment_captures(spark, sf)))
    return df.groupBy("platform", "depth").agg(F.count(F.lit(1)).alias("comments"))


@query(
    "comment_votes_and_reach",
    """SELECT conv_id || '-' || turn AS comment_id, CASE conv_id % 7 WHEN 5 THEN length(text) % 31 + 1 END AS upvotes,
      CASE conv_id % 7 WHEN 5 THEN 1 END AS downvotes, CASE conv_id % 7 WHEN 1 THEN length(text) % 5 END AS shares,
      CASE conv_id % 7 WHEN 1 THEN length(text) * 3 END AS views FROM conversations WHERE conv_id % 7 IN (1, 5)""",
)
def _(spark, sf):
    c = K.filter_captures(comment_captures(spark, sf))
    both = M.normalize_threads(c, "moltbook", None).unionByName(M.normalize_threads(c, "twitter"))
    return both.filter("depth = 0").select("comment_id", "upvotes", "downvotes", "shares", "views")


@query(
    "comment_contract_violations",
    """SELECT 'reddit' AS platform, CAST(conv_id AS VARCHAR) AS content_id, conv_id || '-' || turn || s AS comment_id, rule
    FROM conversations, (SELECT unnest(['', 'r', 'rr']) AS s, unnest([0, 1, 2]) AS depth),
         (SELECT unnest(['text', 'depth']) AS rule)
    WHERE conv_id % 7 = 2 AND ((rule = 'text' AND s = 'rr') OR (rule = 'depth' AND depth + 9 > 10))""",
)
def _(spark, sf):
    df = M.normalize_threads(K.filter_captures(comment_captures(spark, sf)), "reddit", None).withColumns(
        {"depth": F.col("depth") + 9, "text": F.when(F.col("text") != "again", F.col("text"))}
    )
    return govern.comment_violations(df)


@query(
    "comment_payloads",
    """SELECT CAST(conv_id AS VARCHAR) AS content_id, conv_id || '-' || turn || s AS comment_id,
      CASE s WHEN '' THEN role WHEN 'r' THEN 'r1_' || role ELSE 'r2' END AS author,
      greatest(1, CASE s WHEN '' THEN length(text) % 31 WHEN 'r' THEN length(text) % 7 ELSE 0 END) AS likes,
      CASE s WHEN 'rr' THEN 0 ELSE 1 END AS replies
    FROM conversations, (SELECT unnest(['', 'r', 'rr']) AS s) WHERE conv_id % 7 = 5""",
)
def _(spark, sf):
    df = M.normalize_threads(K.filter_captures(comment_captures(spark, sf)), "moltbook", None)
    return sinks.comment_payload(df).drop("text")


# All platforms and depths: what ``comments_normalized_all`` reads, for votes, contract and payloads.
_ALL_COMMENTS = """c AS (SELECT *, conv_id % 7 AS p FROM conversations,
      (SELECT unnest(['', 'r', 'rr']) AS s, unnest([0, 1, 2]) AS depth) WHERE depth < CASE conv_id % 7 WHEN 1 THEN 1 WHEN 4 THEN 2 ELSE 3 END)"""


def _all_comments(spark, sf):
    return M.normalize_all_comments(K.filter_captures(comment_captures(spark, sf)))


@query(
    "comment_votes_and_reach_all",
    f"""WITH {_ALL_COMMENTS} SELECT {platform_sql('conv_id')} AS platform, conv_id || '-' || turn || s AS comment_id, depth,
      CASE p WHEN 5 THEN CASE s WHEN '' THEN length(text) % 31 WHEN 'r' THEN length(text) % 7 ELSE 0 END + 1 END AS upvotes,
      CASE p WHEN 5 THEN 1 END AS downvotes, CASE p WHEN 1 THEN length(text) % 5 END AS shares,
      CASE p WHEN 1 THEN length(text) * 3 END AS views FROM c""",
)
def _(spark, sf):
    return _all_comments(spark, sf).select("platform", "comment_id", "depth", "upvotes", "downvotes", "shares", "views")


@query(
    "comment_contract_violations_all",
    f"""WITH {_ALL_COMMENTS} SELECT {platform_sql('conv_id')} AS platform, CAST(conv_id AS VARCHAR) AS content_id,
      conv_id || '-' || turn || s AS comment_id, rule FROM c, (SELECT unnest(['text', 'depth']) AS rule)
    WHERE (rule = 'text' AND s = 'rr') OR (rule = 'depth' AND depth + 9 > 10)""",
)
def _(spark, sf):
    df = _all_comments(spark, sf).withColumns(
        {"depth": F.col("depth") + 9, "text": F.when(F.col("text") != "again", F.col("text"))}
    )
    return govern.comment_violations(df)


@query(
    "comment_payloads_all",
    f"""WITH {_ALL_COMMENTS} SELECT CAST(conv_id AS VARCHAR) AS content_id, conv_id || '-' || turn || s AS comment_id,
      CASE s WHEN '' THEN role WHEN 'r' THEN 'r1_' || role ELSE 'r2' END AS author,
      greatest(CASE p WHEN 5 THEN 1 ELSE 0 END,
               CASE s WHEN '' THEN length(text) % 31 WHEN 'r' THEN length(text) % 7 ELSE 0 END) AS likes,
      CASE WHEN depth + 1 < CASE p WHEN 1 THEN 1 WHEN 4 THEN 2 ELSE 3 END THEN 1 ELSE 0 END AS replies FROM c""",
)
def _(spark, sf):
    return sinks.comment_payload(_all_comments(spark, sf)).drop("text")


# -- model answers and pages --------------------------------------------------

@query(
    "posts_from_model_answers",
    r"""SELECT doc_id AS response_id, CAST(doc_id AS VARCHAR) AS id, 'reddit' AS platform, source AS author, md5(text) AS content_md5,
      n_chars % 997 AS likes, array_to_string(list_transform(regexp_extract_all(text, '#\w+'), lambda x: substr(x, 2)), ',') AS tags
    FROM documents WHERE doc_id % 3 = 0 AND doc_id % 10 <> 0
    UNION ALL SELECT doc_id, 'vision_post_1', 'reddit', lang, md5('#Tag_' || lang), 1, 'Tag_' || lang
    FROM documents WHERE doc_id % 3 = 0 AND doc_id % 10 <> 0""",
)
def _(spark, sf):
    return R.posts_from_responses(model_responses(spark, sf)).select(
        "response_id", "id", "platform", "author", F.md5("content").alias("content_md5"), "likes",
        F.array_join("hashtags", ",").alias("tags"),
    )


@query(
    "comments_from_model_answers",
    """SELECT doc_id AS response_id, 'vision_comment_0' AS id, source AS author, md5(text) AS text_md5, 2 AS likes
    FROM documents WHERE doc_id % 3 = 1 AND doc_id % 10 <> 0""",
)
def _(spark, sf):
    return R.comments_from_responses(model_responses(spark, sf)).select(
        "response_id", "id", "author", F.md5("text").alias("text_md5"), "likes"
    )


@query("raw_model_answers", "SELECT doc_id AS response_id FROM documents WHERE doc_id % 3 = 2 OR doc_id % 10 = 0")
def _(spark, sf):
    return R.raw_responses(model_responses(spark, sf)).select("response_id")


def _page_sql() -> str:
    sql = "regexp_replace(html, '(?s)<!--.*?-->', '', 'g')"
    for block in R._DROPPED_BLOCKS:
        sql = f"regexp_replace({sql}, '{block}', '', 'g')"
    sql = f"regexp_replace({sql}, '{R._BLOCK_BREAKS}', chr(10), 'g')"
    sql = f"regexp_replace({sql}, '{R._TAGS}', '', 'g')"
    for entity, mark in R._ENTITIES:
        quoted = mark.replace("'", "''")
        sql = f"replace({sql}, '{entity}', '{quoted}')"
    sql = f"regexp_replace({sql}, '[ \\t\\r]+', ' ', 'g')"
    sql = f"regexp_replace({sql}, ' ?\\n[ \\n]*', chr(10), 'g')"
    sql = f"regexp_replace({sql}, '^[ \\n]+|[ \\n]+$', '', 'g')"
    return f"SELECT page_id, md5({sql}) AS text_md5 FROM pages"


@query("page_texts", _page_sql())
def _(spark, sf):
    return R.extract_page_text(table(spark, sf, "pages")).select("page_id", F.md5("text").alias("text_md5"))


@query("captures_read_twice", f"WITH {_KEPT} SELECT platform, doc_id || '-0' AS capture_id FROM kept")
def _(spark, sf):
    """The same files read twice: every capture, repeated or not, stays once."""
    once = K.filter_captures(post_captures(spark, sf))
    return K.dedup_captures(once.unionByName(once)).select("platform", "capture_id")


@query(
    "reddit_author_objects",
    """SELECT doc_id::VARCHAR AS id, CASE doc_id % 4 WHEN 0 THEN 't2_' || doc_id WHEN 1 THEN coalesce(source, '') WHEN 2 THEN coalesce(source, '') ELSE '' END AS author_id,
      CASE WHEN doc_id % 4 = 3 THEN '' ELSE coalesce(source, '') END AS username,
      CASE doc_id % 4 WHEN 0 THEN coalesce(lang, source, '') WHEN 3 THEN '' ELSE coalesce(source, '') END AS display_name,
      CASE doc_id % 4 WHEN 0 THEN doc_id % 8 = 0 WHEN 1 THEN false END AS verified, CASE WHEN doc_id % 4 IN (0, 1) THEN 0 END::BIGINT AS follower_count,
      CASE doc_id % 4 WHEN 0 THEN lang || '.png' WHEN 1 THEN '' END AS profile_image_url FROM documents""",
)
def _(spark, sf):
    """Authors as full objects, as objects with a name only, as plain names, and missing."""
    doc, full = F.col("doc_id"), F.struct(
        F.concat(F.lit("t2_"), "doc_id").alias("id"), F.col("source").alias("name"), F.col("lang").alias("display_name"),
        (F.col("doc_id") % 8 == 0).alias("is_gold"), F.concat("lang", F.lit(".png")).alias("icon_img"),
    )
    author = (
        F.when(doc % 4 == 0, F.to_json(full)).when(doc % 4 == 1, F.to_json(F.struct(F.col("source").alias("name"))))
        .when(doc % 4 == 2, F.to_json(F.struct(F.col("source").alias("x"))).substr(F.lit(6), F.length("source") + 2))
    )
    item = F.concat(F.lit('{"id":"'), doc.cast("string"), F.lit('","author":'), F.coalesce(author, F.lit("null")), F.lit("}"))
    docs = table(spark, sf, "documents").select(
        doc.cast("string").alias("capture_id"), F.lit("reddit").alias("platform"), F.lit("posts").alias("kind"),
        F.lit(POST_ENDPOINTS["reddit"]).alias("url"), F.concat(F.lit('{"data":{"children":[{"data":'), item, F.lit("}]}}")).alias("body"), F.timestamp_seconds(doc).alias("captured_at"),
    )
    posts = P.normalize_posts(docs, "reddit")
    return posts.select(
        "id", F.col("author.id").alias("author_id"), "author.username", "author.display_name", "author.verified",
        "author.follower_count", "author.profile_image_url",
    )
