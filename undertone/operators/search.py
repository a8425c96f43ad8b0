"""Search, filters, ranking, limits and unions over posts."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from undertone.functions import expressions as E
from undertone.schemas import PLATFORMS, per_platform

DEFAULT_LIMIT = 30
DEFAULT_PER_PLATFORM = 10
MAX_LIMIT = 1000


def engagement_of(prefix: str = "engagement") -> Column:
    return E.simple_engagement(F.col(f"{prefix}.likes"), F.col(f"{prefix}.comments"))


# -- order modes --------------------------------------------------------------

def source_order(mode: str, query: str | None = None) -> list[Column]:
    """Row order of a source: newest, most engaged or most relevant first.

    The platform and id close every order, so that it is total.
    """
    tail = [F.col("platform"), F.col("id")]
    newest = F.desc("timestamp")
    if mode in ("date", "latest"):
        return [newest, *tail]
    if mode in ("top", "best", "hot"):
        return [engagement_of().desc(), newest, *tail]
    if mode == "relevance":
        return [E.relevance(F.col("content"), query or "").desc(), newest, *tail]
    raise ValueError(f"unknown order mode: {mode}")


def ordered_slice(posts: DataFrame, mode: str, limit: int, query: str | None = None) -> DataFrame:
    """First ``limit`` rows in source order (a distributed top-k)."""
    check_limit(limit)
    return posts.orderBy(*source_order(mode, query)).limit(limit)


# -- guards -------------------------------------------------------------------

def check_limit(limit: int) -> int:
    if limit < 1 or limit > MAX_LIMIT:
        raise ValueError("limit must be between 1 and 1000")
    return limit


def check_text(value: str | None, what: str) -> str:
    if not value or not value.strip():
        raise ValueError(f"{what} cannot be empty")
    return value.strip()


# -- filters ------------------------------------------------------------------

def search_posts(posts: DataFrame, query: str) -> DataFrame:
    """Posts with a relevance above zero; the score rides along."""
    query = check_text(query, "search query")
    return posts.withColumn("relevance", E.relevance(F.col("content"), query)).filter("relevance > 0")


def user_posts(posts: DataFrame, user: str, titled_only: bool = False) -> DataFrame:
    """Posts of one author; a leading '@' makes no difference."""
    name = check_text(user, "user id").removeprefix("@")
    found = posts.filter(E.strip_handle(F.col("author.username")) == name)
    return found.filter(F.length("title") > 0) if titled_only else found


def tagged_posts(posts: DataFrame, tag: str) -> DataFrame:
    """Posts with a hashtag, given with or without '#'."""
    name = check_text(tag, "tag").removeprefix("#")
    return posts.filter(F.array_contains("hashtags", name) | F.array_contains("hashtags", f"#{name}"))


def with_id(df: DataFrame, column: str = "id") -> DataFrame:
    return df.filter(F.length(column) > 0)


def comments_of(comments: DataFrame, platform: str, reference: str) -> DataFrame:
    """Comments of one content, addressed by id or URL.

    The reference is resolved by the same column rule as in the URL job; the
    optimizer folds it to a constant, so the filter is pushed to the scan.
    """
    reference = check_text(reference, "content id")
    wanted = E.resolve_content_id(F.lit(platform), F.lit(reference))
    return comments.filter((F.col("platform") == platform) & (F.col("content_id") == wanted))


def replies_to(tweets: DataFrame, user: str, conversation_id: str) -> DataFrame:
    return tweets.filter((F.col("reply_to") == user) & (F.col("conversation_id") == conversation_id))


# -- limits and top-k ---------------------------------------------------------

def per_platform_limit(limit: int | None, platforms: int = len(PLATFORMS)) -> int:
    return math.ceil(limit / platforms) if limit else DEFAULT_PER_PLATFORM


def top_per_platform(posts: DataFrame, k: int, order: list[Column], caps: dict[str, int] | None = None) -> DataFrame:
    """At most ``k`` rows per platform; fewer where ``caps`` says so, as for the page size of a remote API.

    Seven platforms would mean seven busy tasks, but a bounded rank is planned
    with a group limit before the shuffle: every task sends k rows a platform.
    """
    ranked = posts.withColumn("source_rank", F.row_number().over(W.partitionBy("platform").orderBy(*order)))
    kept = ranked.filter(F.col("source_rank") <= k)
    return kept.filter(F.col("source_rank") <= per_platform(caps, k)) if caps else kept


def combined_search(
    posts: DataFrame, query: str, limit: int = DEFAULT_LIMIT, platforms: list[str] | None = None
) -> DataFrame:
    """Search all platforms, share the limit among them, rank what is left."""
    check_limit(limit)
    names = platforms or PLATFORMS
    found = search_posts(posts.filter(F.col("platform").isin(*names)), query)
    newest = [F.desc("relevance"), F.desc("timestamp"), F.col("platform"), F.col("id")]
    share = top_per_platform(found, per_platform_limit(limit, len(names)), newest)
    return (
        share.withColumn("engagement_total", engagement_of())
        .orderBy(F.desc("relevance"), F.desc("engagement_total"), "platform", "id")
        .limit(limit)
    )


def combined_trending(
    posts: DataFrame, limit: int = DEFAULT_LIMIT, platforms: list[str] | None = None
) -> DataFrame:
    """Hot posts of all platforms by likes + comments, newest first among equals."""
    check_limit(limit)
    names = platforms or PLATFORMS
    share = top_per_platform(
        posts.filter(F.col("platform").isin(*names)),
        per_platform_limit(limit, len(names)),
        source_order("hot"),
    )
    return (
        share.withColumn("engagement_total", engagement_of())
        .orderBy(F.desc("engagement_total"), F.desc("timestamp"), "platform", "id")
        .limit(limit)
    )


# -- hashtags -----------------------------------------------------------------

def trending_hashtags(posts: DataFrame) -> DataFrame:
    """(hashtag, post_count, engagement_score), counted once per use."""
    return (
        posts.select(F.explode("hashtags").alias("hashtag"), engagement_of().alias("score"))
        .groupBy("hashtag")
        .agg(F.count(F.lit(1)).alias("post_count"), F.sum("score").alias("engagement_score"))
    )


def top_trend_posts(posts: DataFrame, limit: int = DEFAULT_PER_PLATFORM) -> DataFrame:
    """Posts of the strongest hashtag; no hashtags, no posts.

    The trend is a one-row top-k, read as a scalar subquery.
    """
    top = (
        trending_hashtags(posts)
        .orderBy(F.desc("post_count"), F.desc("engagement_score"), "hashtag")
        .limit(1)
        .select("hashtag")
    )
    hit = F.array_contains(F.col("hashtags"), top.scalar())
    return posts.filter(hit).orderBy(F.desc("timestamp"), "platform", "id").limit(limit)


# -- unions -------------------------------------------------------------------

def union_sources(sources: list[DataFrame]) -> DataFrame:
    """Concatenate platforms; nothing is removed across platforms."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources)


def union_available(readers: dict, strategy: str = "continue"):
    """Union of the sources that can be read, plus the errors of the others.

    ``readers`` maps a platform to a function giving its DataFrame. Under
    ``continue`` a failed source counts as empty; otherwise it is left out of
    the result map. Either way the others go on.
    """
    found, errors = {}, {}
    for platform, read in readers.items():
        try:
            frame = read()
            frame.schema  # resolve now, so that a missing path fails here
            found[platform] = frame
        except Exception as error:  # noqa: BLE001 - any failed source must not stop the rest
            errors[platform] = str(error)
    empty = [p for p in errors] if strategy == "continue" else []
    union = union_sources(list(found.values())) if found else None
    return union, {**{p: True for p in found}, **{p: False for p in empty}}, errors


def with_fallback(requests: DataFrame, captured: DataFrame, answered: DataFrame) -> DataFrame:
    """Rows from captures; for requests without any, the rows read from model answers.

    All three carry ``request_id``.
    """
    empty = requests.select("request_id").join(
        captured.select("request_id").distinct(), "request_id", "left_anti"
    )
    fallback = answered.join(empty, "request_id", "left_semi").withColumn("origin", F.lit("model"))
    return captured.withColumn("origin", F.lit("capture")).unionByName(fallback, allowMissingColumns=True)
