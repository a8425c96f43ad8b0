"""What a caller asks for: analyses of contents by name, with their limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from undertone.functions.expressions import comment_engagement
from undertone.operators import clusters as C
from undertone.operators import enrich as N
from undertone.operators import insights as I
from undertone.session import settle

# Limits of the requests, and what an empty request answers.
CLUSTERS_DEFAULT, CLUSTERS_LEAST, CLUSTERS_MOST = 5, 2, 15
CLUSTER_ROUNDS = 4
DEPTH_THEMES = {"surface": 1, "standard": 5, "deep": 10, "comprehensive": 20}
NO_CLUSTERS = "No comments found for clustering"
EXAMPLES = 3


def check_cluster_count(count: int) -> int:
    if not CLUSTERS_LEAST <= count <= CLUSTERS_MOST:
        raise ValueError(f"cluster count must be between {CLUSTERS_LEAST} and {CLUSTERS_MOST}")
    return count


def cluster_opinions(contents: DataFrame, members: DataFrame, clusters: DataFrame, count: int = CLUSTERS_DEFAULT,
                     examples: bool = True, by_engagement: bool = True) -> DataFrame:
    """Per content its ``count`` strongest clusters; contents without comments say so.

    ``contents(video_id)`` are the contents asked for.
    """
    check_cluster_count(count)
    measure = F.col("importance") if by_engagement else F.col("size")
    window = W.partitionBy("video_id").orderBy(measure.desc(), "local_cluster_id")
    top = (
        C.visible(clusters).withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= count)
        .select("video_id", "rank", "cluster_key", "local_cluster_id", "label", "stance", "size", "importance")
    )
    if examples:
        quotes = (
            C.top_members(members, EXAMPLES)
            .groupBy("cluster_key")
            .agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "span"))), lambda q: q["span"]).alias("examples"))
        )
        top = top.join(quotes, "cluster_key", "left")
    counted = members.groupBy("video_id").agg(F.count_distinct("comment_id").alias("total_comments"))
    found = contents.select("video_id").join(counted, "video_id", "left").join(top.drop("cluster_key"), "video_id", "left")
    return found.withColumns(
        {
            "total_comments": F.coalesce("total_comments", F.lit(0)),
            "message": F.when(F.col("total_comments").isNull(), NO_CLUSTERS),
        }
    )


def fixed_count_clusters(vectors: DataFrame, count: int = CLUSTERS_DEFAULT, rounds: int = CLUSTER_ROUNDS,
                         weight: str | None = None) -> DataFrame:
    """(item, cluster): ``vectors(item, vector)`` in at most ``count`` groups by cosine.

    The first ``count`` items are the first centres. In each of ``rounds`` rounds every item goes to the
    most similar centre, the lower one on ties, and a centre becomes the mean of its unit vectors,
    weighted if asked; a centre that nothing is near to stays. Zero vectors and vectors of other length
    than the first item's are left out. The driver sees the centres only.
    """
    check_cluster_count(count)
    numbered = vectors.withColumn("norm", F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))))
    usable = numbered.filter("norm > 0").select(
        "item", F.transform("vector", lambda x: x.cast("double") / F.col("norm")).alias("unit"),
        (F.lit(1.0) if weight is None else F.col(weight).cast("double")).alias("weight"),
    )
    centres = [list(r["unit"]) for r in usable.orderBy("item").limit(count).collect()]
    if not centres:
        return usable.select("item", F.lit(0).alias("cluster"))
    size = len(centres[0])
    usable = settle(usable.filter(F.size("unit") == size))
    for _ in range(rounds):
        placed = usable.withColumn("cluster", _nearest(centres))
        means = placed.groupBy("cluster").agg(
            *(F.sum(F.get("unit", F.lit(d)) * F.col("weight")).alias(f"d{d}") for d in range(size)), F.sum("weight").alias("total")
        ).filter("total > 0")
        for r in means.collect():
            centres[r["cluster"]] = [r[f"d{d}"] / r["total"] for d in range(size)]
    return usable.select("item", _nearest(centres).alias("cluster"))


def _nearest(centres: list[list[float]]) -> Column:
    """The number of the centre most similar to ``unit``."""
    similarities = []
    for c in centres:
        norm = sum(x * x for x in c) ** 0.5
        direction = F.array(*(F.lit(x / norm if norm else 0.0) for x in c))
        similarities.append(F.aggregate(F.zip_with("unit", direction, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x))
    both = F.array(*(F.struct(s.alias("s"), F.lit(-n).alias("n")) for n, s in enumerate(similarities)))
    return -F.array_max(both)["n"]


def enrich_contents(comments: DataFrame, contexts: DataFrame, limit: int | None = None) -> DataFrame:
    """The comments of each content, or its ``limit`` most engaging ones, enriched.

    Their parents come along for the inheritance and are left out again.
    """
    if limit is None:
        return N.enrich(comments, contexts)
    score = comment_engagement(F.col("likes"), F.col("reply_count"), F.col("shares"), F.col("views"))
    window = W.partitionBy("video_id").orderBy(F.desc("asked_score"), "comment_id")
    asked = (
        comments.withColumn("asked_score", F.round(score, 6))
        .withColumn("rank", F.row_number().over(window))
        .filter(F.col("rank") <= limit)
        .select("video_id", "comment_id")
    )
    return N.enrich(comments, contexts).join(asked, ["video_id", "comment_id"], "left_semi")


def analyze_contents(comments: DataFrame, members: DataFrame, clusters: DataFrame, depth: str = "standard") -> DataFrame:
    """Content reports; the depth decides how many themes are told."""
    return I.content_reports(comments, members, clusters, DEPTH_THEMES[depth])


def tension_evidence(tensions: DataFrame, members: DataFrame, k: int = 2) -> DataFrame:
    """The most engaging comments on each side of every tension."""
    sides = tensions.select(
        "video_id",
        "aspect_key",
        F.explode(
            F.array(
                F.struct(F.lit("positive").alias("side"), F.col("positive_cluster").alias("cluster_key")),
                F.struct(F.lit("negative").alias("side"), F.col("negative_cluster").alias("cluster_key")),
            )
        ).alias("s"),
    ).select("video_id", "aspect_key", "s.side", "s.cluster_key")
    picked = C.top_members(members, k).select("cluster_key", "rank", "comment_id", F.col("span").alias("quote"))
    return sides.join(picked, "cluster_key").drop("cluster_key")
