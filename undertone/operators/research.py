"""Summaries across contents and platforms.

The analyses behind these names run remotely where they come from; here they
are deterministic jobs on the tables of the opinion steps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from undertone.functions import lexicon as L
from undertone.operators import clusters as C
from undertone.operators.search import combined_search, engagement_of

# Source budgets and default platforms.
SOURCE_BUDGET = {"quick": 10, "standard": 25, "deep": 50}
RESEARCH_PLATFORMS = ["reddit", "twitter", "youtube"]


def categorized_units(units: DataFrame, categories: list[str] | None = None) -> DataFrame:
    """Units under every category whose cue they contain."""
    wanted = {n: p for n, p in L.CATEGORIES.items() if categories is None or n in categories}
    hits = F.array_compact(F.array(*[F.when(F.rlike("span", F.lit(p)), F.lit(n)) for n, p in wanted.items()]))
    return units.select("*", F.explode(hits).alias("category"))


def category_insights(units: DataFrame, categories: list[str] | None = None) -> DataFrame:
    """Engagement, reach and confidence per category."""
    df = categorized_units(units, categories)
    return df.groupBy("category").agg(
        F.count(F.lit(1)).alias("units"),
        F.count_distinct("comment_id").alias("comments"),
        F.count_distinct("author_id").alias("authors"),
        F.round(F.sum("engagement_score"), 3).alias("engagement"),
        F.round(F.avg("grounding_confidence"), 4).alias("confidence"),
    )


def category_quotes(units: DataFrame, categories: list[str] | None = None, k: int = 3) -> DataFrame:
    """The k most engaging quotes per category."""
    window = W.partitionBy("category").orderBy(F.desc("engagement_score"), "unit_id")
    return (
        categorized_units(units, categories)
        .withColumn("rank", F.row_number().over(window))
        .filter(F.col("rank") <= k)
        .select("category", "rank", "unit_id", F.col("span").alias("quote"), "engagement_score")
    )


def tension_map(clusters: DataFrame) -> DataFrame:
    """Aspects with both praise and criticism, and how balanced they are."""
    by_aspect = C.visible(clusters).groupBy("video_id", "aspect_key").agg(
        F.sum(F.when(F.col("stance") == "positive", F.col("size")).otherwise(0)).alias("positive_units"),
        F.sum(F.when(F.col("stance") == "negative", F.col("size")).otherwise(0)).alias("negative_units"),
        F.max_by("cluster_key", F.when(F.col("stance") == "positive", F.struct("importance", "cluster_key"))).alias("positive_cluster"),
        F.max_by("cluster_key", F.when(F.col("stance") == "negative", F.struct("importance", "cluster_key"))).alias("negative_cluster"),
    )
    low = F.least("positive_units", "negative_units")
    high = F.greatest("positive_units", "negative_units")
    return by_aspect.filter(low > 0).withColumn("balance", F.round(low / high, 4))


def source_diversity(posts: DataFrame) -> DataFrame:
    """Posts, authors and engagement per platform."""
    return posts.groupBy("platform").agg(
        F.count(F.lit(1)).alias("posts"),
        F.count_distinct("author.id").alias("authors"),
        F.sum(engagement_of()).alias("engagement"),
    )


def opinion_leaders(posts: DataFrame, k: int = 10) -> DataFrame:
    """Authors with the most engagement over all platforms."""
    return (
        posts.groupBy("platform", F.col("author.username").alias("username"))
        .agg(F.count(F.lit(1)).alias("posts"), F.sum(engagement_of()).alias("engagement"))
        .orderBy(F.desc("engagement"), "platform", "username")
        .limit(k)
    )


def _by_topic(posts: DataFrame) -> DataFrame:
    """One row per post and hashtag; a tag that a post repeats counts once."""
    return posts.select(
        F.explode(F.array_distinct("hashtags")).alias("topic"), "platform", F.col("author.id").alias("author_id"),
        F.col("author.username").alias("username"), engagement_of().alias("e"),
    )


def topic_diversity(posts: DataFrame) -> DataFrame:
    """Per topic: posts, platforms, authors, engagement, the platform with most posts and its share of them.

    Authors are summed up per platform first, so a topic of a third of all posts is spread over its authors.
    """
    by_author = _by_topic(posts).groupBy("topic", "platform", "author_id").agg(F.count(F.lit(1)).alias("n"), F.sum("e").alias("e"))
    by_platform = by_author.groupBy("topic", "platform").agg(F.sum("n").alias("n"), F.count("author_id").alias("authors"), F.sum("e").alias("e"))
    return by_platform.groupBy("topic").agg(
        F.sum("n").alias("posts"), F.count(F.lit(1)).alias("platforms"), F.sum("authors").alias("authors"), F.sum("e").alias("engagement"),
        F.max_by("platform", F.struct("n", "platform")).alias("main_platform"),
        F.round(F.max("n") / F.sum("n"), 4).alias("main_share"),
    )


def topic_leaders(posts: DataFrame, k: int = 3) -> DataFrame:
    """The k authors of each topic with the most engagement; ties by platform, then name."""
    summed = _by_topic(posts).groupBy("topic", "platform", "username").agg(F.count(F.lit(1)).alias("posts"), F.sum("e").alias("engagement"))
    order = W.partitionBy("topic").orderBy(F.desc("engagement"), "platform", "username")
    return summed.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def research_sources(posts: DataFrame, query: str, depth: str = "standard",
                     platforms: list[str] | None = None) -> DataFrame:
    """The posts a research question draws on, within the budget of its depth."""
    return combined_search(posts, query, SOURCE_BUDGET[depth], platforms or RESEARCH_PLATFORMS)


def research_themes(sources: DataFrame) -> DataFrame:
    """Hashtag themes of the sources with their spread over platforms and authors."""
    return (
        sources.select("platform", "author.username", engagement_of().alias("e"), F.explode("hashtags").alias("theme"))
        .groupBy("theme")
        .agg(
            F.count(F.lit(1)).alias("posts"),
            F.count_distinct("platform").alias("platforms"),
            F.count_distinct("username").alias("authors"),
            F.sum("e").alias("engagement"),
        )
    )


def consensus(clusters: DataFrame) -> DataFrame:
    """Aspects across contents as consensus, controversy or open."""
    agg = C.visible(clusters).groupBy("aspect_key").agg(
        F.sum("size").alias("units"),
        F.sum(F.when(F.col("stance") == "positive", F.col("size")).otherwise(0)).alias("positive"),
        F.sum(F.when(F.col("stance") == "negative", F.col("size")).otherwise(0)).alias("negative"),
        F.count_distinct("video_id").alias("videos"),
    )
    polar = F.col("positive") + F.col("negative")
    share = F.try_divide(F.greatest("positive", "negative").cast("double"), polar)
    return agg.withColumn("agreement", F.round(F.coalesce(share, F.lit(0.0)), 4)).withColumn(
        "verdict", F.when(polar == 0, "open").when(share >= 0.75, "consensus").otherwise("controversy")
    )
