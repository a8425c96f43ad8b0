"""Raw captures out of the test tables: each row becomes a platform's JSON."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from undertone.plans.views import EPOCH, table
from undertone.schemas import PLATFORMS

ISO = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def obj(**fields: Column) -> Column:
    return F.struct(*[value.alias(name) for name, value in fields.items()])


def _tag(name: str, value: Column) -> Column:
    return F.to_json(F.struct(value.alias(name)))


def _raw_list(*items: Column) -> Column:
    return F.concat(F.lit("["), F.concat_ws(",", *items), F.lit("]"))


def _wrap(template: str, inner: Column) -> Column:
    """``template`` with its ``*`` replaced by JSON text."""
    before, after = template.split("*")
    return F.concat(F.lit(before), inner, F.lit(after))


def _post_bodies() -> dict[str, list[Column]]:
    """Per platform the variants of a response body for one document."""
    doc = F.col("doc_id")
    ident, text, name, lang = doc.cast("string"), F.col("text"), F.col("source"), F.col("lang")
    likes, replies = F.pmod("n_chars", F.lit(997)), F.pmod(doc, F.lit(53))
    shares, views = F.pmod(doc, F.lit(17)), F.col("n_chars")
    seconds = F.lit(EPOCH) + doc
    iso = F.date_format(F.timestamp_seconds(seconds), ISO)
    uid = F.concat(F.lit("u_"), name)

    tiktok = F.to_json(
        obj(
            aweme_id=ident, desc=text, create_time=seconds,
            statistics=obj(digg_count=likes, comment_count=replies, share_count=shares, play_count=views),
            author=obj(uid=uid, unique_id=name, nickname=F.concat(F.lit("n "), name), follower_count=views),
            textExtra=F.array(
                obj(hashtagName=lang, hashtag_name=F.lit(None).cast("string")),
                obj(hashtagName=F.lit(""), hashtag_name=name),
                obj(hashtagName=F.lit(None).cast("string"), hashtag_name=F.lit(None).cast("string")),
            ),
        )
    )
    node = F.to_json(
        obj(
            id=ident, owner=obj(id=uid, username=name, full_name=F.concat(F.lit("n "), name)),
            edge_media_to_caption=obj(edges=F.array(obj(node=obj(text=text)))),
            edge_media_preview_like=obj(count=likes), edge_media_to_comment=obj(count=replies),
            video_view_count=views, taken_at_timestamp=seconds, shortcode=F.concat(F.lit("s"), ident),
        )
    )
    item = F.to_json(
        obj(
            pk=doc, user=obj(pk=uid, username=name, full_name=F.concat(F.lit("n "), name)), caption=obj(text=text),
            like_count=likes, comment_count=replies, play_count=views, taken_at=seconds,
            code=F.concat(F.lit("s"), ident),
        )
    )
    counts = obj(
        liked_count=likes.cast("string"), comment_count=replies.cast("string"),
        share_count=shares.cast("string"), view_count=views.cast("string"),
    )
    writer = obj(user_id=uid, nickname=name)
    tags = F.array(obj(name=lang), obj(name=name))
    card = F.to_json(obj(user=writer, desc=text, interact_info=counts, time=seconds * 1000, tag_list=tags))
    note = F.to_json(obj(note_id=ident, user=writer, title=text, interact_info=counts, create_time=seconds, tag_list=tags))
    reddit = F.to_json(
        obj(
            id=ident, title=F.concat(F.lit("t "), ident), selftext=F.when(doc % 4 == 0, "").otherwise(text),
            author=name, score=likes, num_comments=replies, created_utc=seconds.cast("double"),
            permalink=F.concat(F.lit("/r/"), lang, F.lit("/"), ident),
        )
    )
    youtube = F.to_json(
        obj(
            id=obj(kind=F.lit("video"), videoId=ident),
            snippet=obj(title=text, channelId=uid, channelTitle=name, publishedAt=iso),
            statistics=obj(
                likeCount=likes.cast("string"), commentCount=replies.cast("string"), viewCount=views.cast("string")
            ),
        )
    )
    moltbook = F.to_json(
        obj(
            id=ident, body=text, author=obj(id=uid, username=name, display_name=F.concat(F.lit("n "), name)),
            score=likes, comment_count=replies, share_count=shares, view_count=views, created_at=iso,
            community=obj(name=lang), tags=F.array(lang, name),
        )
    )
    tweet = F.to_json(
        obj(
            id=ident, userId=uid, username=name, name=F.concat(F.lit("n "), name), text=text, likes=likes,
            replies=replies, retweets=shares, views=views, timeParsed=iso, hashtags=F.array(lang),
        )
    )
    single_edge = _wrap('{"node":*}', node)
    return {
        "tiktok": [
            _wrap('{"item_list":[*]}', tiktok), _wrap('{"data":{"item_list":[*]}}', tiktok), _wrap('{"data":[*]}', tiktok),
        ],
        "instagram": [
            _wrap('{"data":{"user":{"edge_owner_to_timeline_media":{"edges":[*]}}}}', single_edge),
            _wrap('{"data":{"hashtag":{"edge_hashtag_to_media":{"edges":[*]}}}}', node),
            _wrap('{"ranked_items":[*]}', item),
        ],
        "xiaohongshu": [
            F.concat(F.lit('{"data":{"items":[{"id":"'), ident, F.lit('","note_card":'), card, F.lit("}]}}")),
            _wrap('{"data":{"notes":[*]}}', note),
            _wrap('{"data":*}', note),
        ],
        "reddit": [_wrap('{"data":{"children":[{"kind":"t3","data":*}]}}', reddit)],
        "youtube": [_wrap('{"items":[*]}', youtube)],
        "moltbook": [_wrap('{"posts":[*]}', moltbook), _wrap('{"data":[*]}', moltbook)],
        "twitter": [tweet],
    }


# One watched endpoint per platform.
POST_ENDPOINTS = {
    "tiktok": "https://www.tiktok.com/api/post/item_list/?cursor=",
    "instagram": "https://www.instagram.com/graphql/query/?after=",
    "xiaohongshu": "https://edith.xiaohongshu.com/api/sns/web/v1/feed?cursor=",
    "reddit": "https://www.reddit.com/search.json?after=",
    "youtube": "https://www.googleapis.com/youtube/v3/search?pageToken=",
    "moltbook": "https://api.moltbook.com/search?page=",
    "twitter": "https://x.com/i/api/search?cursor=",
}
COMMENT_ENDPOINTS = {
    "tiktok": "https://www.tiktok.com/api/comment/list/?cursor=",
    "instagram": "https://www.instagram.com/graphql/query/?comments=",
    "xiaohongshu": "https://edith.xiaohongshu.com/api/sns/web/v2/comment/page?cursor=",
    "reddit": "https://www.reddit.com/comments.json?after=",
    "youtube": "https://www.googleapis.com/youtube/v3/commentThreads?pageToken=",
    "moltbook": "https://api.moltbook.com/comments?page=",
    "twitter": "https://x.com/i/api/replies?cursor=",
}


def _variant(bodies: list[Column], number: Column) -> Column:
    picked = bodies[0]
    for place, body in enumerate(bodies[1:], start=1):
        picked = F.when(F.pmod(F.floor(number / len(PLATFORMS)), F.lit(len(bodies))) == place, body).otherwise(picked)
    return picked


def _of_platform(df: DataFrame, number: str, platform: str) -> DataFrame:
    return df.filter(F.pmod(F.col(number), F.lit(len(PLATFORMS))) == PLATFORMS.index(platform))


def post_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One capture per document, some failed, some not JSON, every fifth twice.

    A union of one branch per platform, like a table partitioned by platform:
    a filter on the platform leaves a single branch.
    """
    doc = F.col("doc_id")
    documents = table(spark, sf_dir, "documents")
    copies = F.sequence(F.lit(0), F.when(doc % 5 == 0, 1).otherwise(0))
    parts = [
        _of_platform(documents, "doc_id", platform)
        .select("doc_id", _variant(bodies, doc).alias("body"), F.explode(copies).alias("copy"))
        .select(
            F.concat_ws("-", doc.cast("string"), F.col("copy").cast("string")).alias("capture_id"),
            F.lit(platform).alias("platform"),
            F.lit("posts").alias("kind"),
            F.lit(None).cast("string").alias("content_id"),
            F.concat(F.lit(POST_ENDPOINTS[platform]), doc.cast("string")).alias("url"),
            F.when(doc % 29 == 0, 503).otherwise(200).alias("status"),
            F.when(doc % 31 == 0, "text/html").otherwise("application/json; charset=utf-8").alias("content_type"),
            "body",
            F.timestamp_seconds(F.lit(EPOCH) + doc + F.col("copy")).alias("captured_at"),
        )
        for platform, bodies in _post_bodies().items()
    ]
    return reduce(lambda x, y: x.unionByName(y), parts)


KEPT_SQL = """doc_id % 29 <> 0 AND (doc_id % 31 <> 0 OR doc_id % 7 NOT IN (0, 3, 6))"""


def _comment_bodies() -> dict[str, list[Column]]:
    ident = F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"))
    length = F.length("text")
    seconds = F.lit(EPOCH) + F.col("conv_id") * 100 + F.col("turn")
    iso = F.date_format(F.timestamp_seconds(seconds), ISO)
    rows = [
        (ident, F.col("role"), F.col("text"), F.pmod(length, F.lit(31))),
        (F.concat(ident, F.lit("r")), F.concat(F.lit("r1_"), "role"), F.concat(F.lit("reply to "), "role"), F.pmod(length, F.lit(7))),
        (F.concat(ident, F.lit("rr")), F.lit("r2"), F.lit("again"), F.lit(0)),
    ]

    def nested(make) -> Column:
        inner: Column | None = None
        for level in (2, 1, 0):
            inner = make(*rows[level], inner, level)
        return inner

    def tiktok(i, who, text, likes, child, _):
        fields = dict(cid=i, user=obj(uid=F.concat(F.lit("u_"), who), unique_id=who, nickname=who), text=text,
                      create_time=seconds, digg_count=likes)
        return obj(**fields, **({"reply_comment": F.array(child)} if child is not None else {}))

    def xiaohongshu(i, who, text, likes, child, _):
        fields = dict(id=i, user_info=obj(user_id=F.concat(F.lit("u_"), who), nickname=who), content=text,
                      create_time=seconds, like_count=likes.cast("string"))
        return obj(**fields, **({"sub_comments": F.array(child)} if child is not None else {}))

    def instagram(i, who, text, likes, child, _):
        fields = dict(id=i, owner=obj(id=F.concat(F.lit("u_"), who), username=who), text=text, created_at=seconds,
                      edge_liked_by=obj(count=likes))
        deeper = {"edge_threaded_comments": obj(edges=F.array(obj(node=child)))} if child is not None else {}
        return obj(**fields, **deeper)

    def reddit(i, who, text, likes, child, _):
        fields = dict(id=i, author=who, body=text, created_utc=seconds, score=likes)
        listing = (
            obj(kind=F.lit("Listing"), data=obj(children=F.array(obj(kind=F.lit("t1"), data=child))))
            if child is not None else F.lit("")
        )
        return obj(**fields, replies=listing)

    def moltbook(i, who, text, likes, child, _):
        fields = dict(id=i, author=obj(id=F.concat(F.lit("u_"), who), username=who), body=text, created_at=iso,
                      score=likes, upvotes=likes + 1, downvotes=F.lit(1))
        return obj(**fields, **({"replies": F.array(child)} if child is not None else {}))

    def snippet(who, text, likes):
        return obj(authorChannelId=obj(value=F.concat(F.lit("u_"), who)), authorDisplayName=who, textDisplay=text,
                   publishedAt=iso, likeCount=likes)

    thread = obj(
        id=rows[0][0], snippet=obj(topLevelComment=obj(snippet=snippet(*rows[0][1:]))),
        replies=obj(comments=F.array(obj(id=rows[1][0], snippet=snippet(*rows[1][1:])))),
    )
    tweet = obj(id=ident, userId=F.concat(F.lit("u_"), "role"), username=F.col("role"), text=F.col("text"),
                likes=rows[0][3], retweets=F.pmod(length, F.lit(5)), views=length * 3, timeParsed=iso)
    j = F.to_json
    stub = '{"kind":"more","data":{"id":"x","count":3}}'
    return {
        "tiktok": [_wrap('{"comments":[*]}', j(nested(tiktok)))],
        "instagram": [
            _wrap('{"data":{"shortcode_media":{"edge_media_to_parent_comment":{"edges":[{"node":*}]}}}}', j(nested(instagram)))
        ],
        "xiaohongshu": [_wrap('{"data":{"comments":[*]}}', j(nested(xiaohongshu)))],
        "reddit": [_wrap('[{"kind":"Listing"},{"data":{"children":[{"kind":"t1","data":*},' + stub + "]}}]", j(nested(reddit)))],
        "youtube": [_wrap('{"items":[*]}', j(thread))],
        "moltbook": [_wrap('{"comments":[*]}', j(nested(moltbook)))],
        "twitter": [j(tweet)],
    }


def comment_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One capture per conversation turn: a comment with a reply and its reply."""
    turns = table(spark, sf_dir, "conversations")
    ident = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    parts = [
        _of_platform(turns, "conv_id", platform).select(
            ident.alias("capture_id"), F.lit(platform).alias("platform"), F.lit("comments").alias("kind"),
            F.col("conv_id").cast("string").alias("content_id"),
            F.concat(F.lit(COMMENT_ENDPOINTS[platform]), ident).alias("url"), F.lit(200).alias("status"),
            F.lit("application/json").alias("content_type"), _variant(bodies, F.col("conv_id")).alias("body"),
            F.timestamp_seconds(F.lit(EPOCH) + F.col("conv_id")).alias("captured_at"),
        )
        for platform, bodies in _comment_bodies().items()
    ]
    return reduce(lambda x, y: x.unionByName(y), parts)


def comments_sql(platform: str, levels: int, user_prefix: str = "u_") -> str:
    """The rows ``comment_captures`` holds for a platform, in SQL."""
    number = PLATFORMS.index(platform)
    base = f"FROM conversations WHERE conv_id % 7 = {number}"
    columns = """CAST(conv_id AS VARCHAR) AS content_id, conv_id || '-' || turn || '{suffix}' AS comment_id,
      {parent} AS parent_comment_id, conv_id || '-' || turn AS thread_root_id, {depth} AS depth,
      '{prefix}' || {who} AS author_id, {who} AS username, md5({text}) AS text_md5,
      """ + f"{EPOCH} + conv_id * 100 + turn AS ts, " + "CAST({likes} AS BIGINT) AS likes, {replies} AS reply_count"
    top = ("", "NULL", 0, "role", "text", "length(text) % 31")
    one = ("r", "conv_id || '-' || turn", 1, "('r1_' || role)", "'reply to ' || role", "length(text) % 7")
    two = ("rr", "conv_id || '-' || turn || 'r'", 2, "'r2'", "'again'", "0")
    parts = []
    for level, (suffix, parent, depth, who, text, likes) in enumerate([top, one, two][:levels]):
        replies = 1 if level + 1 < levels else 0
        if platform == "moltbook":  # a score of zero falls back to the upvotes
            likes = f"CASE WHEN {likes} = 0 THEN 1 ELSE {likes} END"
        parts.append("SELECT " + columns.format(
            suffix=suffix, parent=parent, depth=depth, prefix=user_prefix, who=who, text=text, likes=likes, replies=replies
        ) + " " + base)
    return " UNION ALL ".join(parts)


def model_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model answer per document: posts, comments, or plain text."""
    d, doc = table(spark, sf_dir, "documents"), F.col("doc_id")
    posts = F.to_json(obj(posts=F.array(
        obj(id=doc.cast("string"), author=F.col("source"), content=F.col("text"), likes=F.pmod("n_chars", F.lit(997))),
        obj(id=F.lit(""), author=F.col("lang"), content=F.concat(F.lit("#Tag_"), "lang"), likes=F.lit(1)),
    )))
    comments = F.to_json(obj(comments=F.array(obj(author=F.col("source"), text=F.col("text"), likes=F.lit(2)))))
    mode = F.element_at(F.array(F.lit("posts"), F.lit("comments"), F.lit("raw")), (F.pmod(doc, F.lit(3)) + 1).cast("int"))
    answer = F.when(doc % 3 == 0, posts).when(doc % 3 == 1, comments).otherwise(F.col("source"))
    broken = doc % 10 == 0
    return d.select(
        doc.alias("response_id"),
        F.concat(F.lit("https://www.reddit.com/r/"), "lang").alias("url"),
        mode.alias("mode"),
        F.lit("any").alias("provider"),
        F.when(broken, F.concat(F.lit("no answer "), "source")).otherwise(
            F.concat(F.lit("Here it is:\n"), answer, F.lit("\nDone."))
        ).alias("text"),
        F.timestamp_seconds(F.lit(EPOCH) + doc).alias("answered_at"),
    )
