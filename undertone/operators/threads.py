"""Comment trees: structure, order, selection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from undertone.functions import expressions as E
from undertone.operators.ranking import min_max
from undertone.operators.similarity import components
from undertone.session import cut_lineage

# Fixed value: the deepest level that a flat list of one thread shows.
FLATTEN_DEPTH = 3


def follow(links: DataFrame) -> DataFrame:
    """Where a walk along ``links(scope, node, target)`` ends, after how many hops, and whether it was ``cut``.

    Pointer doubling: in each round a node jumps to where its target points, so a chain of n links
    takes log2(n) rounds. Nodes without a link end a walk. A cycle is cut at its least node, which
    then ends the walks on it: it comes back with itself as target, 0 hops and ``cut``.
    """
    links = cut_lineage(links.select("scope", "node", "target"))
    # In the last round every node has made as many hops as there are links: who still moves is on a
    # cycle or leads to one.
    steps, left = links.withColumn("hops", F.lit(1).cast("bigint")), 2 * links.count()
    moving = left > 0
    while moving and left:
        left //= 2
        steps = _doubled(steps)
        moving = not steps.filter("moved").isEmpty()
        if moving and not left:
            on_cycles = steps.filter("moved").select("scope", F.col("target").alias("node")).distinct()
            kept = _least_of_cycles(links.join(on_cycles, ["scope", "node"], "left_semi"))
            cut = kept.select("scope", "node", F.col("node").alias("target"), F.lit(0).cast("bigint").alias("hops"), F.lit(True).alias("cut"))
            return follow(links.join(kept, ["scope", "node"], "left_anti")).unionByName(cut)
        steps = steps.drop("moved")
    return steps.select("scope", "node", "target", "hops", F.lit(False).alias("cut"))


def _doubled(steps: DataFrame) -> DataFrame:
    """Each node jumps on to where its target points; ``moved`` tells who could."""
    onward = steps.select(
        "scope", F.col("node").alias("target"), F.col("target").alias("next_target"), F.col("hops").alias("next_hops")
    )
    return cut_lineage(
        steps.join(onward, ["scope", "target"], "left").select(
            "scope", "node", F.coalesce("next_target", "target").alias("target"),
            (F.col("hops") + F.coalesce("next_hops", F.lit(0))).alias("hops"),
            F.col("next_target").isNotNull().alias("moved"),
        )
    )


def _least_of_cycles(cycles: DataFrame) -> DataFrame:
    """(scope, node): the least node of each cycle; every node of ``cycles`` is on one."""
    found = components(cycles.select(F.struct("scope", "node").alias("left"), F.struct("scope", F.col("target").alias("node")).alias("right")))
    alone = cycles.filter("node = target").select("scope", "node")
    return found.select("component.scope", "component.node").unionByName(alone).distinct()


def thread_structure(comments: DataFrame) -> DataFrame:
    """Root and depth of every comment from ``parent_comment_id`` alone.

    A parent that is not in the table ends the walk: its reply is a root. Where replies form a cycle,
    the least comment of it is taken as root and has ``cycle_cut``.
    """
    known = comments.select(
        F.col("content_id").alias("scope"), F.col("comment_id").alias("target")
    )
    links = (
        comments.filter(F.col("parent_comment_id").isNotNull())
        .select(
            F.col("content_id").alias("scope"),
            F.col("comment_id").alias("node"),
            F.col("parent_comment_id").alias("target"),
        )
        .join(known, ["scope", "target"], "left_semi")
    )
    ends = follow(links).select(
        F.col("scope").alias("content_id"),
        F.col("node").alias("comment_id"),
        F.col("target").alias("found_root"),
        "hops",
        "cut",
    )
    return (
        comments.drop("thread_root_id", "depth")
        .join(ends, ["content_id", "comment_id"], "left")
        .withColumn("thread_root_id", F.coalesce("found_root", "comment_id"))
        .withColumn("depth", F.coalesce(F.col("hops").cast("int"), F.lit(0)))
        .withColumn("cycle_cut", F.coalesce("cut", F.lit(False)))
        .drop("found_root", "hops", "cut")
    )


def target_type(df: DataFrame) -> DataFrame:
    """What a comment addresses: the content, its parent, the thread, or unclear."""
    orphan = F.col("parent_comment_id").isNotNull() & (F.col("depth") == 0)
    return df.withColumn(
        "target_type",
        F.when(orphan, "unclear")
        .when(F.col("depth") == 0, "video")
        .when(F.col("depth") <= FLATTEN_DEPTH, "parent_comment")
        .otherwise("thread"),
    )


def reply_counts(comments: DataFrame) -> DataFrame:
    """Direct replies per comment, zero included."""
    counted = (
        comments.filter(F.col("parent_comment_id").isNotNull())
        .groupBy("content_id", F.col("parent_comment_id").alias("comment_id"))
        .agg(F.count(F.lit(1)).alias("reply_count"))
    )
    return (
        comments.drop("reply_count")
        .join(counted, ["content_id", "comment_id"], "left")
        .na.fill(0, ["reply_count"])
    )


def preorder(comments: DataFrame, limit: int, max_depth: int = FLATTEN_DEPTH) -> DataFrame:
    """Depth-first order of one content, levels 0..max_depth, first ``limit`` rows."""
    return comments.filter(F.col("depth") <= max_depth).orderBy("path", "comment_id").limit(limit)


def preorder_per_content(comments: DataFrame, limit: int, max_depth: int = FLATTEN_DEPTH) -> DataFrame:
    window = W.partitionBy("content_id").orderBy("path", "comment_id")
    return (
        comments.filter(F.col("depth") <= max_depth)
        .withColumn("position", F.row_number().over(window))
        .filter(F.col("position") <= limit)
    )


def top_comments(comments: DataFrame, limit: int | None = None) -> DataFrame:
    """Comments per content by engagement; the first ``limit`` if given."""
    score = E.comment_engagement(
        F.col("likes"), F.col("reply_count"), F.col("shares"), F.col("views")
    )
    window = W.partitionBy("content_id").orderBy(F.desc("engagement_score"), "comment_id")
    ranked = (
        comments.withColumn("engagement_score", F.round(score, 6))
        .withColumn("position", F.row_number().over(window))
    )
    return ranked if limit is None else ranked.filter(F.col("position") <= limit)


def engagement_weights(comments: DataFrame, score: str = "engagement_score") -> DataFrame:
    """Scores rescaled to [0.1, 3.0] per content; equal scores all weigh 1."""
    scaled = min_max(comments, ["content_id"], [score])
    spread = F.col(f"{score}_max") > F.col(f"{score}_min")
    weight = F.when(spread, F.lit(0.1) + F.lit(2.9) * F.col(f"{score}_norm")).otherwise(F.lit(1.0))
    return scaled.withColumn("weight", weight).drop(f"{score}_max", f"{score}_min", f"{score}_norm")
