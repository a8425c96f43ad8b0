"""Silver layer: posts of seven platforms in one schema.

Each document shape is a table of JSON paths. The tables give the schema for
one ``from_json`` per item and the fallbacks for every column.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from undertone.functions.expressions import HASHTAG_PATTERN, PLAIN_HASHTAG_PATTERN
from undertone.schemas import ENGAGEMENT_TYPE, USER_TYPE
from undertone.sources.json_fields import JsonFields, count_or, first_array, is_object, member, text_or, unwrap

Rules = dict[str, list[str]]

# JSON paths per document shape, in order of preference.
POST_PATHS: dict[str, Rules] = {
    "tiktok": {
        "id": ["id", "aweme_id", "video.id"],
        "author_id": ["author.id", "author.uid"],
        "username": ["author.uniqueId", "author.unique_id", "author.nickname"],
        "display_name": ["author.nickname"],
        "follower_count": ["author.followerCount", "author.follower_count"],
        "verified": ["author.verified"],
        "profile_image_url": ["author.avatarThumb", "author.avatar_thumb"],
        "content": ["desc", "title", "video.title"],
        "media_url": ["video.cover", "video.dynamicCover"],
        "likes": ["stats|statistics.diggCount", "stats|statistics.digg_count", "stats|statistics.likeCount"],
        "comments": ["stats|statistics.commentCount", "stats|statistics.comment_count"],
        "shares": ["stats|statistics.shareCount", "stats|statistics.share_count"],
        "views": ["stats|statistics.playCount", "stats|statistics.play_count"],
        "seconds": ["createTime", "create_time"],
        "handle": ["author.uniqueId", "author.unique_id"],
        "tags": ["textExtra[]"],
    },
    "tiktok_shared": {
        "id": ["id", "aweme_id"],
        "author_id": ["author.id", "author.uid"],
        "username": ["author.uniqueId", "author.unique_id"],
        "display_name": ["author.nickname", "author.nick_name"],
        "follower_count": ["author.followerCount", "author.follower_count"],
        "verified": ["author.verified"],
        "profile_image_url": ["author.avatarLarger", "author.avatar_larger"],
        "bio": ["author.signature"],
        "content": ["desc", "description"],
        "media_url": ["video.play_addr.url_list[0]"],
        "likes": ["stats.diggCount", "statistics.digg_count"],
        "comments": ["stats.commentCount", "statistics.comment_count"],
        "shares": ["stats.shareCount", "statistics.share_count"],
        "views": ["stats.playCount", "statistics.play_count"],
        "seconds": ["createTime", "create_time"],
        "url": ["webVideoUrl"],
        "handle": ["author.uniqueId"],
    },
    "twitter": {
        "id": ["id"],
        "author_id": ["userId", "username"],
        "username": ["username"],
        "display_name": ["name", "username"],
        "follower_count": ["followersCount"],
        "verified": ["isVerified", "isBlueVerified"],
        "profile_image_url": ["profileImageUrl"],
        "content": ["text"],
        "media_url": ["photos[0].url", "videos[0].preview"],
        "likes": ["likes"],
        "comments": ["replies"],
        "shares": ["retweets"],
        "views": ["views"],
        "iso": ["timeParsed"],
        "url": ["permanentUrl"],
        "tags": ["hashtags[]"],
    },
    "twitter_shared": {
        "id": ["id"],
        "author_id": ["userId", "id"],
        "username": ["username"],
        "display_name": ["name"],
        "content": ["text"],
        "media_url": ["photos[0].url", "videos[0].preview"],
        "likes": ["likes"],
        "comments": ["replies"],
        "shares": ["retweets"],
        "views": ["views"],
        "iso": ["timeParsed"],
        "seconds": ["timestamp"],
        "url": ["permanentUrl"],
        "tags": ["hashtags[]"],
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
        "content": ["selftext", "title"],
        "media_url": ["url_overridden_by_dest", "url"],
        "likes": ["score", "ups"],
        "comments": ["num_comments", "comment_count"],
        "seconds": ["created_utc", "created"],
        "permalink": ["permalink"],
        "title": ["title"],
    },
    "instagram_node": {
        "id": ["id", "pk"],
        "author_id": ["owner.id"],
        "username": ["owner.username"],
        "display_name": ["owner.full_name", "owner.username"],
        "profile_image_url": ["owner.profile_pic_url"],
        "content": ["edge_media_to_caption.edges[0].node.text", "caption.text"],
        "media_url": ["display_url", "thumbnail_src"],
        "likes": ["edge_media_preview_like.count", "like_count"],
        "comments": ["edge_media_to_comment.count", "comment_count"],
        "views": ["video_view_count"],
        "seconds": ["taken_at_timestamp"],
        "code": ["shortcode"],
    },
    "instagram_v1": {
        "id": ["pk", "id"],
        "author_id": ["user.pk", "user.id"],
        "username": ["user.username"],
        "display_name": ["user.full_name"],
        "profile_image_url": ["user.profile_pic_url"],
        "verified": ["user.is_verified"],
        "content": ["caption.text"],
        "media_url": ["image_versions2.candidates[0].url", "thumbnail_url"],
        "likes": ["like_count"],
        "comments": ["comment_count"],
        "views": ["view_count", "play_count"],
        "seconds": ["taken_at"],
        "code": ["code"],
    },
    "instagram_shared": {
        "id": ["id", "pk"],
        "author_id": ["user|owner.pk", "user|owner.id"],
        "username": ["user|owner.username"],
        "display_name": ["user|owner.full_name", "user|owner.username"],
        "follower_count": ["user|owner.follower_count", "user|owner.edge_followed_by.count"],
        "verified": ["user|owner.is_verified"],
        "profile_image_url": ["user|owner.profile_pic_url", "user|owner.profile_pic_url_hd"],
        "bio": ["user|owner.biography", "user|owner.bio"],
        "content": ["caption.text", "edge_media_to_caption.edges[0].node.text"],
        "media_url": ["image_versions2.candidates[0].url", "display_url"],
        "likes": ["like_count", "edge_media_preview_like.count"],
        "comments": ["comment_count", "edge_media_to_comment.count"],
        "views": ["view_count", "video_view_count"],
        "seconds": ["taken_at", "taken_at_timestamp"],
        "code": ["code", "shortcode"],
        "tag_text": ["caption.text"],
    },
    "youtube": {
        "id": ["id.videoId", "id"],
        "author_id": ["snippet.channelId"],
        "username": ["snippet.channelTitle"],
        "display_name": ["snippet.channelTitle"],
        "content": ["snippet.title"],
        "media_url": ["snippet.thumbnails.high.url", "snippet.thumbnails.default.url"],
        "likes": ["statistics.likeCount"],
        "comments": ["statistics.commentCount"],
        "views": ["statistics.viewCount"],
        "iso": ["snippet.publishedAt"],
    },
    "moltbook": {
        "id": ["id"],
        "author_id": ["author.id", "author.username"],
        "username": ["author.username", "author.name"],
        "display_name": ["author.display_name", "author.username"],
        "follower_count": ["author.follower_count"],
        "verified": ["author.verified"],
        "content": ["body", "content", "title"],
        "media_url": ["media_url", "image_url"],
        "likes": ["score", "upvotes"],
        "comments": ["comment_count", "num_comments"],
        "shares": ["share_count"],
        "views": ["view_count"],
        "iso": ["created_at"],
        "url": ["url"],
        "community": ["community.name", "community_name"],
        "tags": ["tags[]", "hashtags[]"],
    },
    "xiaohongshu": {
        "id": ["note_id", "id"],
        "author_id": ["user|author.user_id", "user|author.uid"],
        "username": ["user|author.nickname", "user|author.nick_name"],
        "display_name": ["user|author.nickname", "user|author.nick_name"],
        "profile_image_url": ["user|author.avatar", "user|author.images"],
        "content": ["title", "desc", "display_title"],
        "media_url": ["cover.url", "cover.url_default", "image_list[0].url"],
        "likes": ["interact_info.liked_count", "liked_count"],
        "comments": ["interact_info.comment_count", "comment_count"],
        "shares": ["interact_info.share_count", "share_count"],
        "views": ["interact_info.view_count"],
        "millis": ["time"],
        "seconds": ["create_time"],
        "tags": ["tag_list[]"],
    },
}


@dataclass(frozen=True)
class Shape:
    """How one document shape fills the columns that need more than a path."""

    platform: str
    url: Callable[["Reader"], str]
    tags: Callable[["Reader"], str]
    absent: tuple[str, ...] = ()
    zero: tuple[str, ...] = ()
    keep_without_id: bool = False
    media: Callable[["Reader"], str] | None = field(default=None)


class Reader:
    """SQL text per target column for one parsed document in the column ``doc``."""

    def __init__(self, rules: Rules, fallback_id: str | None = None):
        self.rules = rules
        self.fields = JsonFields(sorted({p for paths in rules.values() for p in paths}))
        self.fallback_id = fallback_id

    def values(self, target: str) -> list[str]:
        found = [self.fields.get("doc", p) for p in self.rules.get(target, [])]
        return [self.fallback_id, *found] if target == "id" and self.fallback_id else found

    def text(self, target: str, default: str | None = "") -> str:
        return text_or(self.values(target), default)

    def count(self, target: str, default: int | None = 0) -> str:
        return count_or(self.values(target), default)

    def flag(self, target: str, default: bool | None = None) -> str:
        values = self.values(target)
        otherwise = "CAST(NULL AS BOOLEAN)" if default is None else str(default).upper()
        if not values:
            return otherwise
        listed = ", ".join(values)
        return f"CASE WHEN coalesce({listed}) IS NULL THEN {otherwise} ELSE array_contains(array({listed}), 'true') END"

    def of_object(self, value: str, default: str) -> str:
        """``value``, or ``default`` where it is missing in an author that is given as an object."""
        if "author_object" not in self.rules:
            return value
        return f"coalesce({value}, CASE WHEN {is_object(self.values('author_object')[0])} THEN {default} END)"

    def timestamp(self, retrieved_at: str = "captured_at") -> str:
        def epoch(value: str, factor: str) -> str:
            return f"timestamp_millis(CAST(nullif(try_cast({value} AS DOUBLE), 0D) {factor} AS BIGINT))"

        known = [epoch(v, "") for v in self.values("millis")]
        known += [f"try_to_timestamp(nullif({v}, ''))" for v in self.values("iso")]
        known += [epoch(v, "* 1000") for v in self.values("seconds")]
        return f"coalesce({', '.join([*known, retrieved_at])})"

    def array(self, target: str) -> str:
        return f"coalesce({', '.join([*self.values(target), NO_TAGS])})"


NO_TAGS = "CAST(array() AS ARRAY<STRING>)"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\") + "'"


def _tags_lower(text: str) -> str:
    return f"transform(regexp_extract_all({text}, {_quoted(HASHTAG_PATTERN)}, 1), t -> lower(t))"


def _tags_plain(text: str) -> str:
    return f"transform(regexp_extract_all({text}, {_quoted(PLAIN_HASHTAG_PATTERN)}, 1), t -> substr(t, 2))"


def _named_elements(reader: Reader, *names: str, keep_plain: bool) -> str:
    """The named field of each JSON element, optionally the element itself."""
    picked = text_or([member("t", n) for n in names], None)
    picked = f"coalesce({picked}, t)" if keep_plain else picked
    return f"array_compact(transform({reader.array('tags')}, t -> {picked}))"


def _link(*parts: str) -> str:
    """Concatenation that is null as soon as one part is missing."""
    return f"concat({', '.join(parts)})"


def _text(value: str) -> str:
    return f"'{value}'"


# URL formats.
TIKTOK_URL = ("https://www.tiktok.com/@", "/video/")
REDDIT_URL = "https://reddit.com"
INSTAGRAM_URL = ("https://www.instagram.com/p/", "/")
YOUTUBE_URL = "https://www.youtube.com/watch?v="
MOLTBOOK_URL = ("https://moltbook.com/m/", "/posts/")
XIAOHONGSHU_URL = "https://www.xiaohongshu.com/explore/"
TWEET_URL = ("https://x.com/", "/status/")
TWEET_URL_SHARED = ("https://twitter.com/", "/status/")


def _first(*values: str) -> str:
    return f"coalesce({', '.join(values)})"


def _between(base: tuple[str, str], left: str, right: str) -> str:
    return _link(_text(base[0]), left, _text(base[1]), right)


def _tweet_url(base: tuple[str, str]) -> Callable[[Reader], str]:
    return lambda r: _first(r.text("url", None), _between(base, r.text("username", "user"), r.text("id")))


def _instagram_url(r: Reader) -> str:
    return _link(_text(INSTAGRAM_URL[0]), _first(r.text("code", None), r.text("id")), _text(INSTAGRAM_URL[1]))


def _reddit_url(r: Reader) -> str:
    return _link(_text(REDDIT_URL), r.text("permalink", None))


PERSON_ZERO = ("follower_count", "verified", "bio", "profile_image_url")

SHAPES: dict[str, Shape] = {
    "tiktok": Shape(
        "tiktok",
        url=lambda r: _between(TIKTOK_URL, r.text("handle", "user"), r.text("id")),
        tags=lambda r: _named_elements(r, "hashtagName", "hashtag_name", keep_plain=False),
    ),
    "tiktok_shared": Shape(
        "tiktok",
        url=lambda r: _first(r.text("url", None), _between(TIKTOK_URL, r.text("handle", None), r.text("id", None))),
        tags=lambda r: _tags_lower(r.text("content")),
        zero=PERSON_ZERO,
        keep_without_id=True,
    ),
    "twitter": Shape("twitter", url=_tweet_url(TWEET_URL), tags=lambda r: r.array("tags")),
    "twitter_shared": Shape(
        "twitter",
        url=_tweet_url(TWEET_URL_SHARED),
        tags=lambda r: _first(*r.values("tags"), _tags_lower(r.text("content"))),
        zero=PERSON_ZERO,
        keep_without_id=True,
    ),
    "reddit": Shape(
        "reddit",
        url=_reddit_url,
        tags=lambda r: NO_TAGS,
        media=lambda r: _first(r.text("media_url", None), _reddit_url(r), "''"),
        keep_without_id=True,
    ),
    "instagram_node": Shape(
        "instagram", url=_instagram_url, tags=lambda r: _tags_plain(r.text("content")), absent=("shares",)
    ),
    "instagram_v1": Shape(
        "instagram", url=_instagram_url, tags=lambda r: _tags_plain(r.text("content")), absent=("shares",)
    ),
    "instagram_shared": Shape(
        "instagram",
        url=lambda r: _link(_text(INSTAGRAM_URL[0]), r.text("code", None), _text(INSTAGRAM_URL[1])),
        tags=lambda r: _tags_lower(r.text("tag_text")),
        zero=PERSON_ZERO,
        keep_without_id=True,
    ),
    "youtube": Shape(
        "youtube",
        url=lambda r: _link(_text(YOUTUBE_URL), r.text("id")),
        tags=lambda r: _tags_lower(r.text("content")),
        zero=PERSON_ZERO,
        keep_without_id=True,
    ),
    "moltbook": Shape(
        "moltbook",
        url=lambda r: _first(r.text("url", None), _between(MOLTBOOK_URL, r.text("community", None), r.text("id")), "''"),
        tags=lambda r: r.array("tags"),
        zero=("verified",),
        keep_without_id=True,
    ),
    "xiaohongshu": Shape(
        "xiaohongshu",
        url=lambda r: _link(_text(XIAOHONGSHU_URL), r.text("id")),
        tags=lambda r: _named_elements(r, "name", keep_plain=True),
    ),
}


# -- unnesting ----------------------------------------------------------------

def _item(shape: str, raw: str, fallback_id: str = "CAST(NULL AS STRING)") -> str:
    return f"named_struct('shape', '{shape}', 'raw', {raw}, 'fallback_id', {fallback_id})"


def _tagged(items: str, shape: str, raw: str = "x") -> str:
    """Items as (shape, raw, fallback_id) structs."""
    return f"transform({items}, x -> {_item(shape, raw)})"


def _tiktok_items(body: str) -> str:
    listed = first_array(body, "$.data", "$.item_list", "$.itemList")
    nested = first_array(body, "$.data.item_list", "$.data.items")
    return _tagged(f"concat({listed}, {nested})", "tiktok")


# Where Instagram keeps its lists.
TIMELINES = [
    "$.data.user.edge_owner_to_timeline_media.edges",
    "$.data.user.edge_web_feed_timeline.edges",
    "$.data.web_discover_media.edges",
]
TAG_MEDIA = ["$.data.hashtag.edge_hashtag_to_media.edges", "$.data.hashtag.edge_hashtag_to_top_posts.edges"]
ITEM_LISTS = ["$.items", "$.ranked_items", "$.media"]


def _instagram_items(body: str) -> str:
    edges = f"concat({first_array(body, *TIMELINES)}, {first_array(body, *TAG_MEDIA)})"
    nodes = _tagged(edges, "instagram_node", unwrap("x", "node"))
    return f"concat({nodes}, {_tagged(first_array(body, *ITEM_LISTS), 'instagram_v1')})"


def _xiaohongshu_items(body: str) -> str:
    card = unwrap("x", "note_card")
    note = _item("xiaohongshu", card, text_or([member("x", "id"), member(card, "note_id")], None))
    listed = f"transform({first_array(body, '$.data.items', '$.data.notes')}, x -> {note})"
    data = member(body, "data")
    single_id = text_or([member("d", "note_id"), member("d", "id")], None)
    single = f"transform(filter(array({data}), d -> {single_id} IS NOT NULL), x -> {_item('xiaohongshu', 'x')})"
    return f"concat({listed}, {single})"


# Where each Moltbook endpoint keeps its list.
MOLTBOOK_LISTS = {
    "search": ["$.posts", "$.results", "$.data"],
    "trending": ["$.posts", "$.data", "$.results"],
    "user": ["$.posts", "$.data"],
}


def post_items(platform: str, body: str, endpoint: str = "trending") -> str:
    """Array of (shape, raw item, fallback id) in payload order."""
    readers: dict[str, Callable[[str], str]] = {
        "tiktok": _tiktok_items,
        "instagram": _instagram_items,
        "xiaohongshu": _xiaohongshu_items,
        "reddit": lambda b: _tagged(first_array(b, "$.data.children"), "reddit", member("x", "data")),
        "youtube": lambda b: _tagged(first_array(b, "$.items"), "youtube"),
        "moltbook": lambda b: _tagged(first_array(b, *MOLTBOOK_LISTS[endpoint]), "moltbook"),
        "twitter": lambda b: _tagged(f"array({b})", "twitter"),
    }
    return readers[platform](body)


def explode_posts(captures: DataFrame, platform: str, endpoint: str = "trending") -> DataFrame:
    """One row per item of the captures of one platform."""
    return (
        captures.filter((F.col("platform") == platform) & (F.col("kind") == "posts"))
        .selectExpr(
            "capture_id", "captured_at", f"posexplode({post_items(platform, 'body', endpoint)}) AS (position, item)"
        )
        .select("capture_id", "captured_at", "position", "item.shape", "item.raw", "item.fallback_id")
    )


# -- normalizing --------------------------------------------------------------

def _struct(kind: str, **fields: str) -> str:
    listed = ", ".join(f"'{name}', {value}" for name, value in fields.items())
    return f"CAST(named_struct({listed}) AS {kind})"


def _user(r: Reader, zero: tuple[str, ...]) -> str:
    return _struct(
        USER_TYPE,
        id=r.text("author_id"),
        username=r.text("username"),
        display_name=r.text("display_name"),
        follower_count=r.of_object(r.count("follower_count", 0 if "follower_count" in zero else None), "0L"),
        verified=r.of_object(r.flag("verified", False if "verified" in zero else None), "FALSE"),
        profile_image_url=r.of_object(r.text("profile_image_url", "" if "profile_image_url" in zero else None), "''"),
        bio=r.of_object(r.text("bio", "" if "bio" in zero else None), "''"),
    )


def normalize_shape(items: DataFrame, shape_name: str) -> DataFrame:
    """Exploded items of one document shape as normalized posts."""
    shape = SHAPES[shape_name]
    r = Reader(POST_PATHS[shape_name], "fallback_id")
    engagement = _struct(
        ENGAGEMENT_TYPE,
        likes=r.count("likes"),
        comments=r.count("comments"),
        shares=r.count("shares", None if "shares" in shape.absent else 0),
        views=r.count("views"),
        engagement_rate="CAST(NULL AS DOUBLE)",
    )
    columns = {
        "id": r.text("id"),
        "platform": _text(shape.platform),
        "author": _user(r, shape.zero),
        "content": r.text("content"),
        "media_url": shape.media(r) if shape.media else r.text("media_url"),
        "engagement": engagement,
        "timestamp": r.timestamp(),
        "url": shape.url(r),
        "hashtags": shape.tags(r),
    }
    parsed = items.withColumn("doc", F.from_json("raw", r.fields.schema())).filter("doc IS NOT NULL")
    posts = parsed.selectExpr(
        *[f"{value} AS `{name}`" for name, value in columns.items()], "capture_id", "captured_at", "position"
    )
    return posts if shape.keep_without_id else posts.filter("id <> ''")


def first_seen(posts: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """First occurrence per id in capture order, then payload order."""
    window = W.partitionBy(*(keys or ["platform", "id"])).orderBy("captured_at", "capture_id", "position")
    return posts.withColumn("seen", F.row_number().over(window)).filter("seen = 1").drop("seen")


DEDUPED = ("tiktok", "instagram", "xiaohongshu")


def normalize_posts(captures: DataFrame, platform: str, endpoint: str = "trending") -> DataFrame:
    """Captures of one platform as posts; a malformed item only loses itself."""
    items = explode_posts(captures, platform, endpoint)
    shapes = {"instagram": ["instagram_node", "instagram_v1"]}.get(platform, [platform])
    parts = [
        normalize_shape(items.filter(F.col("shape") == s) if len(shapes) > 1 else items, s) for s in shapes
    ]
    posts = reduce(lambda a, b: a.unionByName(b), parts)
    return first_seen(posts) if platform in DEDUPED else posts


def normalize_all_posts(captures: DataFrame, platforms: list[str]) -> DataFrame:
    """Posts of all given platforms; write captures partitioned by platform so that
    each branch reads its own partition only."""
    return reduce(lambda a, b: a.unionByName(b), [normalize_posts(captures, p) for p in platforms])


def unsupported(captures: DataFrame) -> DataFrame:
    """Captures of a platform no rule covers, kept for inspection."""
    return captures.filter(~F.coalesce(F.col("platform").isin(*{s.platform for s in SHAPES.values()}), F.lit(False)))


def users_dimension(posts: DataFrame) -> DataFrame:
    """Latest known row per (platform, user id)."""
    window = W.partitionBy("platform", "author.id").orderBy(F.desc("timestamp"), F.desc("id"))
    return (
        posts.withColumn("latest", F.row_number().over(window))
        .filter("latest = 1")
        .select("platform", "author.*", F.col("timestamp").alias("last_seen_at"))
    )
