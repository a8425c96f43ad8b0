"""Quality measures against gold labels."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undertone.session import settle

# Words of a block of units or clusters, and products held at a time.
BLOCK = 30_000
PRODUCTS = 2_000_000


def grounding_accuracy(predicted: DataFrame, expected: DataFrame) -> DataFrame:
    """``predicted(comment_id, anchor_id)`` against ``expected(comment_id, fragments)``."""
    hit = F.forall("fragments", lambda f: F.contains(F.coalesce("anchor_id", F.lit("")), f))
    judged = expected.join(predicted, "comment_id", "left").withColumn("passed", hit)
    return judged.agg(
        F.count_if("passed").alias("passed"), F.count(F.lit(1)).alias("total"),
        F.round(F.avg(F.col("passed").cast("double")), 6).alias("accuracy"),
    )


def unit_accuracy(units: DataFrame, expected: DataFrame) -> DataFrame:
    """Unit count, required and forbidden spans and stance must all hold.

    ``expected(comment_id, unit_count, required, forbidden, stance)`` is the
    gold table. A comment gives three units at most, so the spans per comment
    are bounded.
    """
    said = (
        units.join(expected.select("comment_id"), "comment_id", "left_semi")
        .groupBy("comment_id")
        .agg(
            F.count(F.lit(1)).alias("found"),
            F.collect_list("span").alias("spans"),
            F.collect_list("stance").alias("stances"),
        )
    )
    some = lambda piece: F.exists("spans", lambda s: F.contains(s, piece))
    passed = (
        (F.coalesce("found", F.lit(0)) == F.col("unit_count"))
        & F.coalesce(F.forall("required", some), F.lit(False))
        & F.coalesce(F.forall("forbidden", lambda p: ~some(p)), F.lit(True))
        & F.coalesce(F.array_contains("stances", F.col("expected_stance")), F.lit(False))
    )
    judged = expected.withColumnRenamed("stance", "expected_stance").join(said, "comment_id", "left")
    return judged.withColumn("passed", F.coalesce(passed, F.lit(False))).agg(
        F.count_if("passed").alias("passed"), F.count(F.lit(1)).alias("total"),
        F.round(F.avg(F.col("passed").cast("double")), 6).alias("accuracy"),
    )


def label_counts(assigned: DataFrame, gold: DataFrame, item: str, cluster: str) -> DataFrame:
    return assigned.join(gold, item).groupBy(cluster, "label").agg(F.count(F.lit(1)).alias("n"))


def cluster_purity(assigned: DataFrame, gold: DataFrame, item: str = "unit_id", cluster: str = "cluster_key") -> DataFrame:
    """Per cluster: dominant gold label, its count, labelled items, purity."""
    return label_counts(assigned, gold, item, cluster).groupBy(cluster).agg(
        F.max_by("label", F.struct("n", "label")).alias("dominant_label"),
        F.max("n").alias("dominant"),
        F.sum("n").alias("labelled"),
        F.round(F.max("n") / F.sum("n"), 6).alias("purity"),
    )


def weighted_purity(per_cluster: DataFrame) -> DataFrame:
    return per_cluster.agg(
        F.sum("dominant").alias("dominant"), F.sum("labelled").alias("labelled"),
        F.round(F.sum("dominant") / F.sum("labelled"), 6).alias("purity"),
    )


def merge_quality(meta_members: DataFrame, per_cluster: DataFrame) -> DataFrame:
    """Purity of the merged clusters by dominant label, and how many merges are wrong."""
    labels = per_cluster.select("cluster_key", F.col("dominant_label").alias("label"))
    per_meta = cluster_purity(meta_members.select("meta_key", "cluster_key"), labels, "cluster_key", "meta_key")
    return per_meta.agg(
        F.round(F.sum("dominant") / F.sum("labelled"), 6).alias("purity"),
        F.sum(F.col("labelled") - F.col("dominant")).alias("incorrect_merges"),
        F.count(F.lit(1)).alias("meta_clusters"),
    )


def recurring_labels(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """Precision, recall and F1 of the labels said to recur.

    ``gold(video_id, label)``; ``predicted(label)``.
    """
    recurring = gold.groupBy("label").agg(F.count_distinct("video_id").alias("v")).filter("v > 1").select("label")
    both = (
        recurring.withColumn("is_gold", F.lit(True))
        .join(predicted.select("label").distinct().withColumn("is_predicted", F.lit(True)), "label", "full")
        .na.fill(False, ["is_gold", "is_predicted"])
    )
    hit = F.count_if(F.col("is_gold") & F.col("is_predicted"))
    precision = F.coalesce(F.try_divide(hit, F.count_if("is_predicted")), F.lit(0.0))
    recall = F.coalesce(F.try_divide(hit, F.count_if("is_gold")), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(precision * recall * 2, precision + recall), F.lit(0.0))
    return both.agg(
        F.round(precision, 6).alias("precision"), F.round(recall, 6).alias("recall"), F.round(f1, 6).alias("f1")
    )


def silhouette(vectors: DataFrame) -> float:
    """Mean cosine silhouette of ``vectors(cluster INT, vector ARRAY)``.

    The evaluator keeps one vector sum per cluster and never forms pairs.
    """
    prepared = vectors.select(
        F.col("cluster").cast("int").alias("prediction"), array_to_vector("vector").alias("features")
    )
    return ClusteringEvaluator(distanceMeasure="cosine").evaluate(prepared)


def _meet(units: pd.DataFrame, sums: pd.DataFrame) -> pd.DataFrame:
    """(set, inside, nearest) of ``units(set, own, key, share)`` against ``sums(own, key, mass, size)``."""
    units, sums = units.sort_values("set"), sums.sort_values("key")
    sets, of = np.unique(units["set"].to_numpy(), return_inverse=True)
    clusters, place = np.unique(sums["own"].to_numpy(), return_inverse=True)
    inside, nearest = np.zeros(len(sets)), np.zeros(len(sets))
    mine = np.empty(len(sets), dtype=np.int64)
    mine[of] = units["own"].to_numpy()
    share, keys, known = units["share"].to_numpy(), units["key"].to_numpy(), sums["key"].to_numpy()
    mass, size = sums["mass"].to_numpy(), np.empty(len(clusters))
    size[place] = sums["size"].to_numpy()
    low = np.searchsorted(known, keys, "left")
    found = np.searchsorted(known, keys, "right") - low
    # So many products at a time; all words of a set are among the same.
    step = np.cumsum(np.bincount(of, weights=found, minlength=len(sets))) // PRODUCTS
    cuts = np.append(np.searchsorted(of, np.flatnonzero(np.diff(step, prepend=-1))), len(of))
    for start, end in zip(cuts, cuts[1:]):
        n = found[start:end]
        row = np.repeat(np.arange(start, end), n)
        at = np.repeat(low[start:end] - np.cumsum(n) + n, n) + np.arange(n.sum())
        pairs, which = np.unique(of[row] * len(clusters) + place[at], return_inverse=True)
        dot = np.bincount(which, weights=share[row] * mass[at], minlength=len(pairs))
        unit, cluster = np.divmod(pairs, max(1, len(clusters)))
        own = clusters[cluster] == mine[unit]
        inside[unit[own]] = dot[own]
        np.maximum.at(nearest, unit[~own], dot[~own] / size[cluster[~own]])
    return pd.DataFrame({"set": sets, "inside": inside, "nearest": nearest})


def token_silhouette(members: DataFrame, scope: list[str], cluster: str = "cluster_key", block: int = BLOCK) -> DataFrame:
    """(scope..., units, silhouette): mean cosine silhouette of word sets, clusters of a scope against each other.

    ``members`` holds the scope, ``cluster`` and ``tokens`` (distinct; null or empty sets are at distance 1 from
    all). A cluster is the sum of its unit vectors, one row per word; a unit meets the clusters it shares a word with,
    all others of its scope are at distance 1. Equal sets of a cluster are compared once. A unit alone in its
    cluster, or in the only cluster of its scope, counts 0.

    Units and clusters of a scope meet by blocks of about ``block`` words, each pair of blocks in a group of its own,
    and only the nearest cluster of each unit leaves it. Small scopes share groups.
    """
    named = F.xxhash64(F.lit(0), *scope)
    sets = settle(
        members.select(*scope, cluster, F.array_sort(F.coalesce("tokens", F.array().cast("array<string>"))).alias("tokens"))
        .groupBy(*scope, cluster, "tokens").agg(F.count(F.lit(1)).alias("copies"))
        .withColumns({"set": F.monotonically_increasing_id(), "own": F.xxhash64(named, cluster), "bucket": named})
    )
    sizes = sets.groupBy(*scope, cluster, "own").agg(F.sum("copies").alias("size"))
    alone = sizes.groupBy(*scope).agg(F.count(F.lit(1)).alias("clusters"))
    words = sets.groupBy("bucket").agg(F.sum(F.size("tokens")).alias("words"))
    batches = max(1, math.ceil((words.agg(F.sum("words")).first()[0] or 0) / block))
    large = words.filter(F.col("words") > block).select("bucket", F.ceil(F.col("words") / block).cast("int").alias("blocks"))
    share = F.lit(1.0) / F.sqrt(F.size("tokens").cast("double"))
    said = sets.select("bucket", "own", "set", "copies", share.alias("share"), F.explode("tokens").alias("token")).withColumn(
        "key", F.xxhash64("bucket", "token")
    ).drop("token")
    sums = said.groupBy("bucket", "own", "key").agg(F.sum(F.col("share") * F.col("copies")).alias("mass")).join(sizes.select("own", "size"), "own")

    def dealt(rows: DataFrame, by: str, mine: str, other: str) -> DataFrame:
        """Each row in its block of its own side, once for every block of the other side."""
        blocks = F.coalesce("blocks", F.lit(1))
        part = F.when(F.col("blocks").isNull(), F.pmod("bucket", F.lit(batches))).otherwise(F.col("bucket"))
        return rows.join(large, "bucket", "left").select(
            *(F.col(c).alias(c) for c in rows.columns if c not in ("bucket", "copies")), part.alias("part"),
            F.pmod(F.xxhash64(by), blocks).cast("int").alias(mine), F.explode(F.sequence(F.lit(0), blocks - 1)).alias(other),
        )

    groups = ["part", "unit_block", "sum_block"]
    nearest = (
        dealt(said, "set", "unit_block", "sum_block").groupBy(*groups)
        .cogroup(dealt(sums, "own", "sum_block", "unit_block").groupBy(*groups))
        .applyInPandas(_meet, "set long, inside double, nearest double")
    )
    met = nearest.groupBy("set").agg(F.max("inside").alias("inside"), F.max("nearest").alias("nearest"))
    itself = F.when(F.size("tokens") > 0, F.lit(1.0)).otherwise(F.lit(0.0))
    others = F.col("size") - 1
    # Rounded, so that distances of nothing are 0 and not what sums of roots leave.
    a = F.round((others - (F.coalesce("inside", F.lit(0.0)) - itself)) / others, 9)
    b = F.round(F.lit(1.0) - F.coalesce("nearest", F.lit(0.0)), 9)
    value = F.when((F.col("size") < 2) | (F.col("clusters") < 2), F.lit(0.0)).otherwise(
        F.coalesce(F.try_divide(b - a, F.greatest(a, b)), F.lit(0.0))
    )
    return (
        sets.join(met, "set", "left").join(sizes.drop("own"), [*scope, cluster]).join(alone, scope)
        .groupBy(*scope).agg(F.sum("copies").alias("units"), (F.sum(value * F.col("copies")) / F.sum("copies")).alias("silhouette"))
    )
