"""Themes across contents, insights, content reports and the ask index."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from undertone.functions import tokens as TK
from undertone.operators import clusters as C
from undertone.operators.numbering import numbered
from undertone.operators.ranking import weighted_importance
from undertone.operators.similarity import components, similar_links
from undertone.session import settle

# Importance weights and texts of themes across contents.
META_WEIGHTS = {
    "videos": 0.25,
    "comments": 0.20,
    "unique_authors": 0.20,
    "total_engagement": 0.15,
    "confidence": 0.10,
    "controversy": 0.10,
}
RECURRING = {"negative": "Recurring criticism of ", "positive": "Recurring praise for ",
             "question": "Recurring questions about "}
RECURRING_OTHERWISE = "Recurring discussion of "
META_WHY = {
    "negative": "Repeated criticism across multiple videos is a stronger product or messaging signal than isolated pushback.",
}
META_WHY_OTHERWISE = "A theme that returns across multiple videos matters more than one mention."
BROAD_TYPES = ("global_video", "video")
META_LINK_FROM = 0.45
META_PREFIX_AT = 0.3


def broad(aspect_key):
    return F.split(aspect_key, "\\.")[0].isin(*BROAD_TYPES)


# -- single content -----------------------------------------------------------

def local_insights(clusters: DataFrame, per_video: int | None = None) -> DataFrame:
    """The clusters of each content as insights, strongest first; the first ``per_video`` if given.

    Noise is skipped; the content-wide bucket is skipped as soon as the content
    has a specific theme.
    """
    usable = C.visible(clusters)
    specific = usable.filter(~F.col("wide")).select("video_id").distinct()
    wide_only = usable.filter("wide").join(specific, "video_id", "left_anti")
    shown = usable.filter(~F.col("wide")).unionByName(wide_only)
    window = W.partitionBy("video_id").orderBy(F.desc("importance"), "local_cluster_id")
    return (
        shown.withColumn("rank", F.row_number().over(window))
        .filter(F.lit(True) if per_video is None else F.col("rank") <= per_video)
        .select(
            F.concat_ws("_", "video_id", F.lit("insight"), F.col("rank").cast("string")).alias("insight_id"),
            F.lit("single_video").alias("scope"),
            "video_id",
            "cluster_key",
            F.col("label").alias("title"),
            F.col("summary").alias("description"),
            C.by_stance(F.col("stance"), C.WHY_IT_MATTERS, C.WHY_OTHERWISE).alias("why_it_matters"),
            F.col("importance").alias("importance_score"),
            F.round("avg_grounding", 3).alias("confidence"),
            "rank",
        )
    )


def sentiment(units: DataFrame, key: str = "video_id") -> DataFrame:
    """Majority of the polar units; a draw with units on both sides is mixed."""
    counted = units.groupBy(key).agg(
        F.count_if(F.col("stance") == "positive").alias("positive_units"),
        F.count_if(F.col("stance") == "negative").alias("negative_units"),
    )
    positive, negative = F.col("positive_units"), F.col("negative_units")
    return counted.withColumn(
        "sentiment",
        F.when(negative > positive, "negative")
        .when(positive > negative, "positive")
        .when(positive > 0, "mixed")
        .otherwise("neutral"),
    )


def content_reports(comments: DataFrame, units: DataFrame, clusters: DataFrame, themes: int | None = None) -> DataFrame:
    """Per content: comment count, sentiment, all themes or the strongest ``themes``, one-line summary.

    Contents without comments or units are the caller's left join away; here
    every content with a comment gets a row.
    """
    counted = comments.groupBy("video_id").agg(F.count(F.lit(1)).alias("comment_count"))
    window = W.partitionBy("video_id").orderBy(F.desc("importance"), "local_cluster_id")
    top = C.visible(clusters).withColumn("rank", F.row_number().over(window))
    if themes is not None:
        top = top.filter(F.col("rank") <= themes)
    listed = top.groupBy("video_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rank", "label"))), lambda t: t["label"]).alias("themes"),
        F.count(F.lit(1)).alias("theme_count"),
    )
    best = local_insights(clusters, 1).select("video_id", F.col("description").alias("summary"))
    return (
        counted.join(sentiment(units), "video_id", "left")
        .join(listed, "video_id", "left")
        .join(best, "video_id", "left")
        .select(
            "video_id",
            "comment_count",
            F.coalesce("sentiment", F.lit("neutral")).alias("sentiment"),
            F.coalesce("themes", F.array().cast("array<string>")).alias("themes"),
            "summary",
        )
    )


# -- across contents ----------------------------------------------------------

def meta_members(clusters: DataFrame, link_from: float = META_LINK_FROM,
                 prefix_at: float = META_PREFIX_AT) -> DataFrame:
    """Local clusters that recur, with their ``meta_key``; one per content.

    Only clusters are compared, never comments. Stances must agree; the
    content-wide buckets and the noise stay out.
    """
    usable = C.visible(clusters).filter(~F.col("wide"))
    named = settle(usable.filter(F.col("stance").isNotNull()).select(
        "stance",
        "cluster_key",
        F.array_sort(TK.content_tokens(F.col("aspect_label"))).alias("tokens"),
        F.col("importance").alias("weight"),
    ).filter(F.size("tokens") > 0))
    # Labels of equal words are one node, however many clusters carry them.
    labels = settle(named.groupBy("stance", "tokens").agg(
        F.min("cluster_key").alias("node"), F.max("weight").alias("weight"),
        (F.min("cluster_key") != F.max("cluster_key")).alias("shared"),
    ))
    linked = labels.join(components(similar_links(labels, ["stance"], link_from, prefix_at)), "node", "left").select(
        "stance", "tokens", F.coalesce("component", F.when(F.col("shared"), F.col("node"))).alias("meta_key")
    ).filter("meta_key is not null")
    grouped = usable.join(named.join(linked, ["stance", "tokens"]).select("cluster_key", "meta_key").distinct(), "cluster_key")
    window = W.partitionBy("meta_key", "video_id").orderBy(F.desc("importance"), "local_cluster_id")
    single = grouped.withColumn("seen", F.row_number().over(window)).filter("seen = 1").drop("seen")
    recurring = single.groupBy("meta_key").agg(F.count(F.lit(1)).alias("videos")).filter("videos > 1")
    return settle(single.join(recurring.select("meta_key"), "meta_key", "left_semi"))


def controversy(depth, share_negative):
    """This project's definition: reply depth where opinions are mixed."""
    return F.round(share_negative * (F.lit(1.0) - share_negative) * 4 * 0.5 + F.least(depth, F.lit(1.0)) * 0.5, 3)


def build_meta_clusters(members: DataFrame, units: DataFrame, clusters: DataFrame) -> DataFrame:
    """Meta clusters: coverage, recurrence, confidence, importance, canonical theme.

    ``members`` comes from ``meta_members``, ``units`` carry ``cluster_key``.
    """
    best = F.struct("importance", "cluster_key")
    summed = members.groupBy("meta_key").agg(
        F.count(F.lit(1)).alias("local_clusters"),
        F.count_distinct("video_id").alias("videos"),
        F.sum("total_engagement").alias("total_engagement"),
        F.round(F.avg("avg_grounding"), 3).alias("confidence"),
        F.avg("reply_depth").alias("reply_depth"),
        F.max_by(F.struct("aspect_key", "aspect_label", "stance"), best).alias("canonical"),
    )
    said = units.join(members.select("cluster_key", "meta_key"), "cluster_key")
    people = said.groupBy("meta_key").agg(
        F.count_distinct("comment_id").alias("comments"),
        F.count_distinct("author_id").alias("unique_authors"),
        F.avg((F.col("stance") == "negative").cast("double")).alias("negative_share"),
    )
    analysed = clusters.select(F.count_distinct("video_id")).scalar()
    df = summed.join(people, "meta_key").withColumns(
        {
            "recurrence": F.round(F.col("videos") / analysed, 3),
            "controversy": controversy(F.col("reply_depth"), F.col("negative_share")),
        }
    )
    df = weighted_importance(df, [], META_WEIGHTS)
    theme = F.concat(
        C.by_stance(F.col("canonical.stance"), RECURRING, RECURRING_OTHERWISE), F.col("canonical.aspect_label")
    )
    return df.select(
        F.concat(F.lit("meta_"), F.col("meta_key")).alias("meta_cluster_id"),
        "meta_key",
        theme.alias("canonical_theme"),
        F.col("canonical.aspect_key").alias("canonical_aspect_key"),
        F.col("canonical.stance").alias("canonical_stance"),
        "local_clusters", "videos", "comments", "unique_authors",
        F.round("total_engagement", 3).alias("total_engagement"),
        "recurrence", "controversy", "confidence", "importance",
        F.concat(
            theme, F.lit(" appears across "), F.col("videos").cast("string"),
            F.lit(" videos and is supported by "), F.col("local_clusters").cast("string"),
            F.lit(" related local clusters."),
        ).alias("summary"),
    )


def meta_representatives(members: DataFrame, units: DataFrame, clusters: int = 2, comments: int = 3) -> DataFrame:
    """Exemplar comments of a theme: from its strongest clusters, most engaging first."""
    strongest = W.partitionBy("meta_key").orderBy(F.desc("importance"), "local_cluster_id")
    top = (
        members.withColumn("cluster_rank", F.row_number().over(strongest))
        .filter(F.col("cluster_rank") <= clusters)
        .select("meta_key", "cluster_key", "cluster_rank")
    )
    said = C.top_members(units, comments).withColumnRenamed("rank", "unit_rank")
    picked = said.join(top, "cluster_key")
    order = W.partitionBy("meta_key").orderBy("cluster_rank", "unit_rank")
    return (
        picked.withColumn("position", F.row_number().over(order))
        .filter(F.col("position") <= comments)
        .select("meta_key", "position", "comment_id", "unit_id", "video_id")
    )


def meta_insights(metas: DataFrame, limit: int | None = None) -> DataFrame:
    """The themes across contents, numbered from the strongest; the first ``limit`` if given, taken before."""
    order = [F.desc("importance"), F.asc("meta_cluster_id")]
    top = metas if limit is None else metas.orderBy(*order).limit(limit)
    return numbered(top, order).select(
        F.concat(F.lit("cross_video_insight_"), F.col("rank").cast("string")).alias("insight_id"),
        F.lit("cross_video").alias("scope"),
        "meta_cluster_id",
        F.col("canonical_theme").alias("title"),
        F.col("summary").alias("description"),
        C.by_stance(F.col("canonical_stance"), META_WHY, META_WHY_OTHERWISE).alias("why_it_matters"),
        F.col("importance").alias("importance_score"),
        "confidence",
        "rank",
    )


# -- ask layer ----------------------------------------------------------------

# The default grouping, and intents told from cluster type and stance.
DEFAULT_GROUPING = ["aboutness", "stance", "importance"]


def cluster_intent(cluster_type):
    return (
        F.when(cluster_type == "question", "information_request")
        .when(cluster_type == "humor", "joke")
        .when(cluster_type == "opinion", "feedback")
        .otherwise("other")
    )


def ask_index(clusters: DataFrame, has_meta: bool = True) -> DataFrame:
    """The values one can ask for, as (dimension, value, clusters) rows.

    Rows, because aspects grow with the data and must not end in one array.
    """
    dimensions = {
        "stance": F.col("stance"),
        "intent": cluster_intent(F.col("cluster_type")),
        "cluster_type": F.col("cluster_type"),
        "aspect_key": F.col("aspect_key"),
        "scope": F.lit("single_video"),
    }
    entries = F.array(
        *[F.struct(F.lit(name).alias("dimension"), c.alias("value")) for name, c in dimensions.items()],
        *([F.struct(F.lit("scope").alias("dimension"), F.lit("cross_video").alias("value"))] if has_meta else []),
    )
    return (
        clusters.select(F.explode(entries).alias("entry"))
        .groupBy("entry.dimension", "entry.value")
        .agg(F.count(F.lit(1)).alias("clusters"))
    )


def ask(clusters: DataFrame, include_low_signal: bool = False, **wanted: list[str]) -> DataFrame:
    """Clusters by any selected dimension: stance, intent, cluster_type, aspect_key, video_id."""
    df = C.visible(clusters, include_low_signal).withColumn("intent", cluster_intent(F.col("cluster_type")))
    conditions = [F.col(name).isin(values) for name, values in wanted.items() if values]
    return df.filter(reduce(lambda a, b: a & b, conditions)) if conditions else df


def ask_auto(clusters: DataFrame) -> DataFrame:
    """Default view: by what it is about, split by stance, strongest first.

    Sorted output; the order columns come along, no rank is needed.
    """
    grouped = C.visible(clusters).groupBy("aspect_key", "stance").agg(
        F.count(F.lit(1)).alias("clusters"),
        F.sum("size").alias("units"),
        F.count_distinct("video_id").alias("videos"),
        F.max("importance").alias("importance"),
    )
    return grouped.orderBy(F.desc("importance"), "aspect_key", "stance")
