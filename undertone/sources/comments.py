"""Silver layer: comment threads of seven platforms as one adjacency table.

Spark has no recursive struct, so a thread is kept flat: every comment row
knows its parent, its thread root, its depth and its path of positions. A
thread is unrolled inside the row that holds it, level by level, so the job
reads each capture once and needs no self join. Replies below the levels of a
round are unrolled by the next round, until none is left.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from undertone.schemas import USER_TYPE
from undertone.session import cut_lineage
from undertone.sources.json_fields import first_array, member, text_or, unwrap
from undertone.sources.posts import Reader, Rules, _struct

# The contract allows ten levels of replies; also the levels unrolled in one round.
MAX_DEPTH = 10

# JSON paths per comment shape, in order of preference.
COMMENT_PATHS: dict[str, Rules] = {
    "tiktok": {
        "id": ["cid", "id"],
        "author_id": ["user.uid", "user.id"],
        "username": ["user.unique_id", "user.uniqueId", "user.nickname"],
        "display_name": ["user.nickname"],
        "text": ["text"],
        "seconds": ["create_time", "createTime"],
        "likes": ["digg_count", "diggCount", "likes"],
    },
    "twitter": {
        "id": ["id"],
        "author_id": ["userId", "username"],
        "username": ["username"],
        "display_name": ["name", "username"],
        "verified": ["isVerified", "isBlueVerified"],
        "text": ["text"],
        "iso": ["timeParsed"],
        "likes": ["likes"],
        "shares": ["retweets"],
        "views": ["views"],
    },
    "reddit": {
        "id": ["id"],
        "author_id": ["author_display_name", "author.id", "author.name", "author~"],
        "username": ["author_display_name", "author.name", "author.display_name", "author~"],
        "display_name": ["author_display_name", "author.display_name", "author.name", "author~"],
        "verified": ["author.is_gold"],
        "profile_image_url": ["author.icon_img"],
        "bio": ["author.public_description"],
        "author_object": ["author"],
        "text": ["body"],
        "seconds": ["created_utc"],
        "likes": ["score", "ups"],
    },
    "instagram_node": {
        "id": ["id", "pk"],
        "author_id": ["owner.id"],
        "username": ["owner.username"],
        "display_name": ["owner.username"],
        "profile_image_url": ["owner.profile_pic_url"],
        "text": ["text"],
        "seconds": ["created_at"],
        "likes": ["edge_liked_by.count"],
    },
    "instagram_v1": {
        "id": ["pk", "id"],
        "author_id": ["user.pk", "user.id"],
        "username": ["user.username"],
        "display_name": ["user.full_name"],
        "text": ["text"],
        "seconds": ["created_at"],
        "likes": ["comment_like_count"],
    },
    "youtube": {
        "id": ["id"],
        "author_id": [
            "snippet.topLevelComment.snippet.authorChannelId.value",
            "snippet.authorChannelId.value",
        ],
        "username": [
            "snippet.topLevelComment.snippet.authorDisplayName",
            "snippet.authorDisplayName",
        ],
        "display_name": [
            "snippet.topLevelComment.snippet.authorDisplayName",
            "snippet.authorDisplayName",
        ],
        "text": [
            "snippet.topLevelComment.snippet.textDisplay",
            "snippet.topLevelComment.snippet.textOriginal",
            "snippet.textDisplay",
            "snippet.textOriginal",
        ],
        "iso": ["snippet.topLevelComment.snippet.publishedAt", "snippet.publishedAt"],
        "likes": ["snippet.topLevelComment.snippet.likeCount", "snippet.likeCount"],
    },
    "moltbook": {
        "id": ["id"],
        "author_id": ["author.id", "author.username"],
        "username": ["author.username", "author.name"],
        "display_name": ["author.display_name", "author.username"],
        "text": ["body", "content", "text"],
        "iso": ["created_at"],
        "likes": ["score", "upvotes"],
        "upvotes": ["upvotes", "score"],
        "downvotes": ["downvotes"],
        "score": ["score"],
    },
    "xiaohongshu": {
        "id": ["id", "comment_id"],
        "author_id": ["user_info|user.user_id"],
        "username": ["user_info|user.nickname"],
        "display_name": ["user_info|user.nickname"],
        "profile_image_url": ["user_info|user.image", "user_info|user.avatar"],
        "text": ["content"],
        "seconds": ["create_time"],
        "likes": ["like_count"],
    },
}


NO_REPLIES = "CAST(array() AS ARRAY<STRING>)"


def _no_replies(_: str) -> str:
    return NO_REPLIES


def _reddit_children(listing: str, path: str) -> str:
    """Comment children only; load-more stubs carry another kind."""
    kept = f"filter({first_array(listing, path)}, c -> {member('c', 'kind')} = 't1')"
    return f"filter(transform({kept}, c -> {member('c', 'data')}), c -> c IS NOT NULL)"


def _edges(text: str, *paths: str) -> str:
    return f"transform({first_array(text, *paths)}, e -> {unwrap('e', 'node')})"


@dataclass(frozen=True)
class ThreadShape:
    platform: str
    top: Callable[[str], str]
    replies: Callable[[str], str] = _no_replies
    username_default: str = ""
    votes: bool = False
    reach: bool = False
    drop_without_id: bool = True


# Where each shape keeps its comments and replies.
PARENT_COMMENTS = [
    "$.data.shortcode_media.edge_media_to_parent_comment.edges",
    "$.data.shortcode_media.edge_media_to_comment.edges",
]

THREADS: dict[str, ThreadShape] = {
    "tiktok": ThreadShape(
        "tiktok",
        top=lambda b: first_array(b, "$.comments", "$.data.comments"),
        replies=lambda raw: first_array(raw, "$.reply_comment"),
    ),
    "twitter": ThreadShape("twitter", top=lambda b: f"array({b})", reach=True),
    "reddit": ThreadShape(
        "reddit",
        top=lambda b: _reddit_children(b, "$[1].data.children"),
        replies=lambda raw: _reddit_children(raw, "$.replies.data.children"),
        drop_without_id=False,
    ),
    "instagram_node": ThreadShape(
        "instagram",
        top=lambda b: _edges(b, *PARENT_COMMENTS),
        replies=lambda raw: _edges(raw, "$.edge_threaded_comments.edges"),
    ),
    "instagram_v1": ThreadShape("instagram", top=lambda b: first_array(b, "$.comments")),
    "youtube": ThreadShape(
        "youtube",
        top=lambda b: first_array(b, "$.items"),
        replies=lambda raw: first_array(raw, "$.replies.comments"),
        drop_without_id=False,
    ),
    "moltbook": ThreadShape(
        "moltbook",
        top=lambda b: first_array(b, "$.comments", "$.data", "$.results"),
        replies=lambda raw: first_array(raw, "$.replies", "$.children"),
        username_default="anonymous",
        votes=True,
        drop_without_id=False,
    ),
    "xiaohongshu": ThreadShape(
        "xiaohongshu",
        top=lambda b: first_array(b, "$.data.comments"),
        replies=lambda raw: first_array(raw, "$.sub_comments"),
    ),
}


def _raw_id(raw: str, shape_name: str) -> str:
    return text_or([member(raw, p) for p in COMMENT_PATHS[shape_name]["id"]])


def top_level(captures: DataFrame, shape_name: str) -> DataFrame:
    """Top-level comments as raw JSON."""
    shape = THREADS[shape_name]
    rows = (
        captures.filter((F.col("platform") == shape.platform) & (F.col("kind") == "comments"))
        .selectExpr("capture_id", "captured_at", "content_id", f"posexplode({shape.top('body')}) AS (position, raw)")
        .withColumn("root_id", F.expr(_raw_id("raw", shape_name)))
        .withColumn("shape", F.lit(shape_name))
    )
    return rows.filter("root_id <> ''") if shape.drop_without_id else rows


def first_tops(tops: DataFrame) -> DataFrame:
    """First occurrence per content and comment id, in capture and payload order.

    The tree-shaped payloads of a capture come before its flat ones.
    """
    window = W.partitionBy("content_id", "root_id").orderBy("captured_at", "capture_id", "shape", "position")
    return tops.withColumn("seen", F.row_number().over(window)).filter("seen = 1").drop("seen")


def _placed(tops: DataFrame) -> DataFrame:
    """Top-level comments with their place in the thread."""
    return tops.withColumns({"path": F.array("position"), "parent_id": F.lit(None).cast("string")})


def _levels(placed: DataFrame, shape_name: str, max_depth: int) -> DataFrame:
    """The comments of ``placed`` and ``max_depth`` levels below, with the JSON of the replies that lie deeper."""
    shape = THREADS[shape_name]

    def kids(raw: str) -> str:
        replies = shape.replies(raw)
        return f"filter({replies}, k -> {_raw_id('k', shape_name)} <> '')" if shape.drop_without_id else replies

    def node(raw: str, path: str, parent: str) -> str:
        return (
            f"named_struct('raw', {raw}, 'id', {_raw_id(raw, shape_name)}, 'path', {path}, "
            f"'parent_id', {parent}, 'kids', {kids(raw)})"
        )

    levels = 0 if shape.replies is _no_replies else max_depth
    df = placed.withColumn("level_0", F.expr(f"array({node('raw', 'path', 'parent_id')})"))
    child = node("r", "concat(p.path, array(i))", "p.id")
    for level in range(1, levels + 1):
        below = f"flatten(transform(level_{level - 1}, p -> transform(p.kids, (r, i) -> {child})))"
        df = df.withColumn(f"level_{level}", F.expr(below))
    everything = "concat(" + ", ".join(f"level_{n}" for n in range(levels + 1)) + ")"
    return df.selectExpr(
        "capture_id", "captured_at", "content_id", "root_id", f"size(path) + {levels} AS last", f"explode({everything}) AS node"
    ).selectExpr(
        "capture_id", "captured_at", "content_id", "root_id", "node.raw", "node.path", "node.parent_id",
        "size(node.kids) AS reply_count", "size(node.path) - 1 AS depth",
        "size(node.path) = last AND size(node.kids) > 0 AS has_deeper",
        "CASE WHEN size(node.path) = last THEN node.kids END AS deeper", "node.id AS node_id",
    )


def unroll(tops: DataFrame, shape_name: str, max_depth: int = MAX_DEPTH) -> DataFrame:
    """Comments down to ``max_depth``, one row each.

    Every level is an array of nodes built from the array of the level above;
    a node holds the JSON of its replies, so each document is opened once.
    ``has_deeper`` marks comments of the last level that still hold replies, so
    that nothing is lost silently.
    """
    return _levels(_placed(tops), shape_name, max_depth).drop("deeper", "node_id")


def _normalized(rows: DataFrame, shape_name: str) -> tuple[DataFrame, dict[str, str]]:
    """Rows with their comment parsed as ``doc``, null where it is no object, and the columns of the adjacency table."""
    shape = THREADS[shape_name]
    r = Reader(COMMENT_PATHS[shape_name])
    author = _struct(
        USER_TYPE,
        id=r.text("author_id"),
        username=r.text("username", shape.username_default),
        display_name=r.text("display_name"),
        follower_count=r.of_object("CAST(NULL AS BIGINT)", "0L"),
        verified=r.of_object(r.flag("verified"), "FALSE"),
        profile_image_url=r.of_object(r.text("profile_image_url", None), "''"),
        bio=r.of_object(r.text("bio", None), "''"),
    )
    votes = 0 if shape.votes else None
    reach = 0 if shape.reach else None
    columns = {
        "platform": f"'{shape.platform}'",
        "content_id": "content_id",
        "comment_id": r.text("id"),
        "parent_comment_id": "parent_id",
        "thread_root_id": "root_id",
        "depth": "depth",
        "path": "path",
        "author": author,
        "text": r.text("text"),
        "timestamp": r.timestamp(),
        "likes": r.count("likes"),
        "upvotes": r.count("upvotes", votes),
        "downvotes": r.count("downvotes", votes),
        "shares": r.count("shares", reach),
        "views": r.count("views", reach),
        "score": r.count("score", votes),
        "reply_count": "CAST(reply_count AS BIGINT)",
        "has_deeper": "has_deeper",
    }
    return rows.withColumn("doc", F.from_json("raw", r.fields.schema())), columns


def _down_to(tops: DataFrame, shape_name: str, max_depth: int) -> DataFrame:
    parsed, columns = _normalized(unroll(tops, shape_name, max_depth), shape_name)
    return parsed.filter("doc IS NOT NULL").selectExpr(*[f"{value} AS `{name}`" for name, value in columns.items()])


def _whole(tops: dict[str, DataFrame]) -> DataFrame:
    """Comments of all levels, by shape.

    A round unrolls ``MAX_DEPTH`` levels of all shapes and is written; the
    replies below its last level start the next round.
    """
    placed = {name: _placed(rows) for name, rows in tops.items()}
    keep = ["capture_id", "captured_at", "root_id", "node_id", "deeper"]
    rounds = []
    while placed:
        parts = []
        for name, start in placed.items():
            parsed, columns = _normalized(_levels(start, name, MAX_DEPTH), name)
            values = [f"{value} AS `{column}`" for column, value in columns.items()]
            parts.append(parsed.selectExpr(*values, *keep, f"'{name}' AS shape", "doc IS NOT NULL AS parsed"))
        rows = cut_lineage(reduce(lambda a, b: a.unionByName(b), parts))
        names = list(columns)
        rounds.append(rows)
        below = rows.filter("has_deeper")
        shapes = [row.shape for row in below.select("shape").distinct().collect()]
        placed = {
            name: below.filter(F.col("shape") == name).selectExpr(
                "capture_id", "captured_at", "content_id", "root_id", "node_id AS parent_id", "path AS above",
                "posexplode(deeper) AS (position, raw)",
            ).withColumn("path", F.expr("concat(above, array(position))"))
            for name in shapes
        }
    everything = reduce(lambda a, b: a.unionByName(b), rounds).filter("parsed")
    return everything.withColumn("has_deeper", F.lit(False)).select(*names)


def _tops(captures: DataFrame, platform: str) -> dict[str, DataFrame]:
    """Top-level comments by shape; a platform with two payload shapes drops repeats over both."""
    names = [name for name, shape in THREADS.items() if shape.platform == platform]
    tops = reduce(lambda a, b: a.unionByName(b), [top_level(captures, n) for n in names])
    if THREADS[names[0]].drop_without_id and platform != "twitter":
        tops = first_tops(tops)
    return {n: tops.filter(F.col("shape") == n) if len(names) > 1 else tops for n in names}


def _threads(tops: dict[str, DataFrame], max_depth: int | None) -> DataFrame:
    # A shape without replies has no level below the first.
    nested = {n: rows for n, rows in tops.items() if max_depth is None and THREADS[n].replies is not _no_replies}
    parts = [_down_to(rows, n, max_depth or 0) for n, rows in tops.items() if n not in nested]
    return reduce(lambda a, b: a.unionByName(b), parts + ([_whole(nested)] if nested else []))


def normalize_threads(captures: DataFrame, platform: str, max_depth: int | None = None) -> DataFrame:
    """Comment captures of one platform as the adjacency table.

    All levels unless a ``max_depth`` is given; then ``has_deeper`` marks what lies below.
    """
    return _threads(_tops(captures, platform), max_depth)


def normalize_all_comments(captures: DataFrame, max_depth: int | None = None) -> DataFrame:
    """All platforms; all levels unless a ``max_depth`` is given."""
    platforms = dict.fromkeys(shape.platform for shape in THREADS.values())
    return _threads({n: rows for p in platforms for n, rows in _tops(captures, p).items()}, max_depth)
