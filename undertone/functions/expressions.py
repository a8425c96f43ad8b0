"""Column expressions: defaulting, text, time, URL and score rules.

Everything here is a built-in Spark expression, so it stays in the JVM.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hashtag, control-character and URL patterns.
HASHTAG_PATTERN = "(#[\\wÀ-ɏḀ-ỿ]+)"
PLAIN_HASHTAG_PATTERN = "(#\\w+)"
CONTROL_CHARACTERS = "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]"
EPOCH_MILLIS_FLOOR = 1e12
TIKTOK_HOST = "(?i)(^|\\.)tiktok\\.com$"
TIKTOK_VIDEO_PATH = "/video/(\\d+)"
INSTAGRAM_HOST = "(?i)(^|\\.)instagram\\.com$"
INSTAGRAM_SHORTCODE_PATH = "/(reel|reels|p)/([A-Za-z0-9_-]+)"
INSTAGRAM_REEL_PATH = "(?i)/(reel|reels)/"
TWEET_STATUS_PATH = "/status/(\\d+)"


# -- defaulting -------------------------------------------------------------

def text_or(*columns: Column, default: str | None = "") -> Column:
    """First column that is neither null nor the empty string."""
    picked = [F.nullif(c.cast("string"), F.lit("")) for c in columns]
    return F.coalesce(*picked, F.lit(default)) if default is not None else F.coalesce(*picked)


def count_or(*columns: Column, default: int | None = 0) -> Column:
    """First column that parses to a non-zero count."""
    picked = [F.nullif(c.try_cast("bigint"), F.lit(0).cast("bigint")) for c in columns]
    if default is None:
        return F.coalesce(*picked)
    return F.coalesce(*picked, F.lit(default).cast("bigint"))


# -- hashtags ---------------------------------------------------------------

def hashtags_lower(text: Column) -> Column:
    """Lower-cased tags with their '#'; Latin letters with accents count."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(HASHTAG_PATTERN))
    return F.transform(found, F.lower)


def hashtags_plain(text: Column) -> Column:
    """ASCII word tags without their '#', case kept."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PLAIN_HASHTAG_PATTERN))
    return F.transform(found, lambda tag: F.substr(tag, F.lit(2)))


def strip_handle(name: Column) -> Column:
    return F.regexp_replace(name, "^@", "")


def as_handle(name: Column) -> Column:
    return F.when(F.startswith(name, F.lit("@")), name).otherwise(F.concat(F.lit("@"), name))


def strip_tag(name: Column) -> Column:
    return F.regexp_replace(name, "^#", "")


# -- text -------------------------------------------------------------------

def sanitize(text: Column, length: int | None = None) -> Column:
    """Drop control characters and trim; keep at most ``length`` characters if given."""
    cleaned = F.regexp_replace(F.coalesce(text, F.lit("")), CONTROL_CHARACTERS, "")
    trimmed = F.regexp_replace(cleaned, "^\\s+|\\s+$", "")
    return trimmed if length is None else F.substring(trimmed, 1, length)


def slug(text: Column) -> Column:
    """Lower case, runs of anything else become one '_', none at the ends."""
    joined = F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_")
    return F.regexp_replace(joined, "^_+|_+$", "")


# -- time -------------------------------------------------------------------

def from_epoch_seconds(seconds: Column) -> Column:
    value = seconds.try_cast("double")
    return F.when(value != 0, F.timestamp_millis((value * 1000).cast("bigint")))


def from_epoch_millis(millis: Column) -> Column:
    value = millis.try_cast("double")
    return F.when(value != 0, F.timestamp_millis(value.cast("bigint")))


def from_iso(text: Column) -> Column:
    return F.try_to_timestamp(F.nullif(text, F.lit("")))


def normalize_timestamp(raw: Column, retrieved_at: Column) -> Column:
    """Epoch seconds, epoch milliseconds or ISO text; absent means retrieval time."""
    number = raw.try_cast("double")
    numeric = F.when(number < EPOCH_MILLIS_FLOOR, F.timestamp_millis((number * 1000).cast("bigint")))
    numeric = numeric.otherwise(F.timestamp_millis(number.cast("bigint")))
    absent = raw.isNull() | (raw == "") | (number == 0)
    return F.when(absent, retrieved_at).when(number.isNotNull(), numeric).otherwise(from_iso(raw))


# -- URLs -------------------------------------------------------------------

def url_part(url: Column, part: str, key: str | None = None) -> Column:
    trimmed = F.trim(url)
    if key is None:
        return F.try_parse_url(trimmed, F.lit(part))
    return F.try_parse_url(trimmed, F.lit(part), F.lit(key))


def _group(text: Column, pattern: str, index: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, index), F.lit(""))


def is_tiktok_url(url: Column) -> Column:
    return F.coalesce(F.rlike(url_part(url, "HOST"), F.lit(TIKTOK_HOST)), F.lit(False))


def tiktok_video_id(url: Column) -> Column:
    asked = F.coalesce(
        F.nullif(url_part(url, "QUERY", "item_id"), F.lit("")),
        url_part(url, "QUERY", "aweme_id"),
    )
    numeric = F.when(F.rlike(asked, F.lit("^\\d+$")), asked)
    return F.coalesce(_group(url_part(url, "PATH"), TIKTOK_VIDEO_PATH, 1), numeric)


def is_instagram_url(url: Column) -> Column:
    return F.coalesce(F.rlike(url_part(url, "HOST"), F.lit(INSTAGRAM_HOST)), F.lit(False))


def instagram_shortcode(url: Column) -> Column:
    return _group(url_part(url, "PATH"), INSTAGRAM_SHORTCODE_PATH, 2)


def is_reel_url(url: Column) -> Column:
    return F.coalesce(F.rlike(url_part(url, "PATH"), F.lit(INSTAGRAM_REEL_PATH)), F.lit(False))


def tweet_id(reference: Column) -> Column:
    """Id from a status URL, or the reference itself when it is a bare id."""
    return F.coalesce(_group(reference, TWEET_STATUS_PATH, 1), reference)


def resolve_content_id(platform: Column, reference: Column) -> Column:
    """Content id for a reference that may be a URL; unresolvable URLs give null."""
    return (
        F.when((platform == "tiktok") & is_tiktok_url(reference), tiktok_video_id(reference))
        .when((platform == "instagram") & is_instagram_url(reference), instagram_shortcode(reference))
        .when(platform == "twitter", tweet_id(reference))
        .otherwise(reference)
    )


def platform_of_url(url: Column) -> Column:
    """Ordered substring tests; anything unknown counts as twitter."""
    return (
        F.when(F.contains(url, F.lit("tiktok.com")), "tiktok")
        .when(F.contains(url, F.lit("instagram.com")), "instagram")
        .when(F.contains(url, F.lit("x.com")) | F.contains(url, F.lit("twitter.com")), "twitter")
        .when(F.contains(url, F.lit("xiaohongshu.com")), "xiaohongshu")
        .when(F.contains(url, F.lit("reddit.com")), "reddit")
        .when(F.contains(url, F.lit("youtube.com")), "youtube")
        .otherwise("twitter")
    )


# -- scores -----------------------------------------------------------------

def engagement_rate(likes: Column, comments: Column, shares: Column, followers: Column) -> Column:
    total = F.coalesce(likes, F.lit(0)) + F.coalesce(comments, F.lit(0)) + F.coalesce(shares, F.lit(0))
    rate = F.try_divide(total.cast("double"), followers.cast("double")) * 100
    return F.when(followers == 0, F.lit(0.0)).otherwise(rate)


def simple_engagement(likes: Column, comments: Column) -> Column:
    return F.coalesce(likes, F.lit(0)) + F.coalesce(comments, F.lit(0))


def comment_engagement(likes: Column, replies: Column, shares: Column, views: Column) -> Column:
    """Log-damped engagement, so that no viral comment swamps the rest."""
    weights = [(1.0, likes), (1.5, replies), (1.2, shares), (0.3, views)]
    terms = [F.lit(w) * F.log1p(F.coalesce(c, F.lit(0)).cast("double")) for w, c in weights]
    return reduce(lambda a, b: a + b, terms)


def raw_engagement(likes: Column, upvotes: Column, downvotes: Column, shares: Column) -> Column:
    """Older linear score: likes, net votes, shares at three, never below 0.1."""
    zero = F.lit(0)
    total = (
        F.coalesce(likes, zero)
        + F.coalesce(upvotes, zero)
        - F.coalesce(downvotes, zero)
        + F.coalesce(shares, zero) * 3
    )
    return F.greatest(F.lit(0.1), total.cast("double"))


def relevance(content: Column, query: str) -> Column:
    """10 for the whole query, 2 per query word found; words may repeat."""
    if not query:
        return F.lit(0)
    body = F.lower(content)
    needle = query.lower()
    score = F.when(F.contains(body, F.lit(needle)), 10).otherwise(0)
    words = re.split(r"\s+", needle)
    for word in dict.fromkeys(words):
        score = score + F.when(F.contains(body, F.lit(word)), 2 * words.count(word)).otherwise(0)
    return F.when(content.isNull() | (content == ""), 0).otherwise(score)


def relevance_to(content: Column, query: Column) -> Column:
    """The same rule when the query is a column."""
    body, needle = F.lower(content), F.lower(query)
    whole = F.when(F.contains(body, needle), 10).otherwise(0)
    words = F.split(needle, "\\s+")
    hits = F.size(F.filter(words, lambda word: F.contains(body, word)))
    blank = content.isNull() | (content == "") | query.isNull() | (query == "")
    return F.when(blank, 0).otherwise(whole + hits * 2)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two equally long vectors; 0 when empty, unequal or zero."""
    def dot(x: Column, y: Column) -> Column:
        products = F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double"))
        return F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)

    usable = (F.size(a) > 0) & (F.size(a) == F.size(b))
    ratio = F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
    return F.when(usable, F.coalesce(ratio, F.lit(0.0))).otherwise(F.lit(0.0))


# -- errors and requests ----------------------------------------------------

def error_code(platform: Column, status: Column, message: Column, reason: Column) -> Column:
    """Ordered classification; the rate-limit test comes before the others."""
    text = F.coalesce(message, F.lit(""))
    why = F.coalesce(reason, F.lit(""))
    wording = platform.isin("reddit", "moltbook") & F.contains(text, F.lit("rate limit"))
    quota = (platform == "youtube") & why.isin("quotaExceeded", "rateLimitExceeded")
    limited = F.coalesce(status == 429, F.lit(False)) | wording | quota
    limited = limited | F.coalesce(reason == "rate_limit_exceeded", F.lit(False))
    return (
        F.when(limited, "RATE_LIMIT")
        .when(status.isin(401, 403), "authentication_error")
        .when(status == 404, "not_found")
        .otherwise("unknown_error")
    )


def comments_disabled(platform: Column, operation: Column, status: Column, reason: Column) -> Column:
    """A failed comment request that counts as an empty success."""
    return (
        (platform == "youtube")
        & (operation == "comments")
        & (status == 403)
        & (F.coalesce(reason, F.lit("")) == "commentsDisabled")
    )


def retry_action(status: Column) -> Column:
    return (
        F.when(status.between(200, 399), "none")
        .when(status == 409, "recover_conflict")
        .when((status == 429) | (status >= 500), "retry_with_backoff")
        .otherwise("fail_fast")
    )


def request_violations(user_id: Column, content_id: Column, query: Column, limit: Column,
                       operation: Column) -> Column:
    """Names of the argument rules a request breaks."""
    def blank(c: Column) -> Column:
        return c.isNull() | (F.length(F.trim(c)) == 0)

    return F.array_compact(
        F.array(
            F.when((operation == "user") & blank(user_id), F.lit("user_id_empty")),
            F.when((operation == "comments") & blank(content_id), F.lit("content_id_empty")),
            F.when((operation == "search") & blank(query), F.lit("query_empty")),
            F.when(limit.isNull() | (limit < 1) | (limit > 1000), F.lit("limit_out_of_range")),
        )
    )
