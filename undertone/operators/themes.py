"""Themes across contents from whole cluster signatures, at most one cluster of a content in each.

A signature is the words of a cluster's label and summary without numbers. Its vector
is hashed: each word adds ln((signatures + 1) / signatures that use it) to one of ``DIMENSIONS`` places, so words
of the text templates, which all clusters of a stance share, weigh next to nothing. Clusters of equal signature
and stance are one node, however many they are.

Similar nodes of a stance are found by random projections: the signs of a vector along ``bits`` random planes
name its bucket, in as many tables as bring pairs at exactly the least cosine together with chance ``RECALL``.
``bits`` follow the number of nodes, so buckets stay small as nodes grow. Pairs that share
a bucket are confirmed by their exact cosine.

Nodes are taken in the order of their strongest cluster. One that no stronger open node is linked with founds a
theme; those linked with a founder join the nearest. That goes on in rounds until no node is open.
The clusters of a content that meet in one founder are dealt to its layers, the nearest and strongest to the first:
a theme is a founder and a layer, and no cluster is lost.
"""

from __future__ import annotations

import math
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from undertone.functions import tokens as TK
from undertone.operators import clusters as C
from undertone.operators.numbering import numbered
from undertone.operators.similarity import in_order
from undertone.session import discard, settle

DIMENSIONS = 256
LEAST = 0.8
RECALL = 0.97
LEAST_BITS, MOST_BITS = 4, 24
DIGITS = 9
SEED = 11


def signature(label: Column, summary: Column) -> Column:
    """The sorted words of both texts, numbers left out."""
    said = TK.content_tokens(F.concat_ws(" ", label, summary))
    return F.array_sort(F.filter(said, lambda w: ~w.rlike("^[0-9]+$")))


def hashed(nodes: DataFrame, scope: list[str], dimensions: int = DIMENSIONS) -> DataFrame:
    """(scope..., node, vector): unit vectors of ``nodes(scope..., node, tokens)``; nodes without words have none."""
    sizes = nodes.groupBy(*scope).agg(F.count(F.lit(1)).alias("nodes"))
    said = nodes.select(*scope, "node", F.explode("tokens").alias("token"))
    used = said.groupBy(*scope, "token").agg(F.count(F.lit(1)).alias("used")).join(sizes, scope)
    weight = used.select(*scope, "token", F.log((F.col("nodes") + 1) / F.col("used")).alias("weight"))
    placed = said.join(weight, [*scope, "token"]).groupBy(*scope, "node", TK.hash_bucket(F.col("token"), dimensions).alias("place")).agg(
        F.sum("weight").alias("value")
    )
    # At most one entry per dimension is collected.
    whole = placed.groupBy(*scope, "node").agg(
        F.map_from_entries(F.collect_list(F.struct("place", "value"))).alias("at"), F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm")
    )
    every = F.sequence(F.lit(0).cast("bigint"), F.lit(dimensions - 1).cast("bigint"))
    return whole.select(*scope, "node", F.transform(every, lambda d: F.coalesce(F.col("at")[d], F.lit(0.0)) / F.col("norm")).alias("vector"))


def tables_for(bits: int, least: float = LEAST, recall: float = RECALL) -> int:
    """How many tables bring a pair at cosine ``least`` together with chance ``recall``."""
    together = (1 - math.acos(least) / math.pi) ** bits
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - together)))


@cache
def _planes(dimensions: int, count: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((dimensions, count))


def bucketed(vectors: DataFrame, bits: int, tables: int) -> DataFrame:
    """``vectors`` with ``buckets``: one number per table, from the signs along its planes."""

    @F.pandas_udf("array<bigint>")
    def buckets(v: pd.Series) -> pd.Series:
        if not len(v):
            return pd.Series([], dtype=object)
        rows = np.stack(v.to_numpy())
        signs = (rows @ _planes(rows.shape[1], bits * tables) > 0).reshape(len(rows), tables, bits)
        return pd.Series(list(signs @ (1 << np.arange(bits, dtype=np.int64))))

    return vectors.withColumn("buckets", buckets("vector"))


def near_pairs(vectors: DataFrame, scope: list[str], least: float = LEAST, recall: float = RECALL) -> DataFrame:
    """(left, right, near) with left < right: pairs of a scope whose cosine is ``least`` or more, each once.

    Nodes that share all their buckets, as those of one hashed place do, are one group: groups meet in the tables,
    once however many nodes they hold, and only then are their nodes paired. Vectors travel without their zeros.
    """
    bits = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(max(2, vectors.count())))))
    placed = bucketed(vectors, bits, tables_for(bits, least, recall)).withColumn("twins", F.xxhash64(F.lit(0), *scope, "buckets"))
    said = F.filter(F.transform("vector", lambda v, i: F.struct(i.alias("place"), v.alias("value"))), lambda e: e["value"] != 0)
    placed = settle(placed.select(*scope, "node", "twins", "buckets", said.alias("said")))
    tables = placed.na.drop(subset=scope).groupBy("twins").agg(F.any_value(F.struct(*scope, "buckets")).alias("one")).select(
        "twins", *(F.col(f"one.{c}").alias(c) for c in scope), F.posexplode("one.buckets").alias("table", "bucket")
    ).select("twins", F.xxhash64(F.lit(0), *scope, "table", "bucket").alias("key"))
    groups = tables.join(tables.select("key", F.col("twins").alias("right_twins")), "key").filter("twins <= right_twins")
    met = groups.select("twins", "right_twins").distinct()

    def side(name: str) -> DataFrame:
        twins = "twins" if name == "left" else "right_twins"
        return placed.select(F.col("twins").alias(twins), F.col("node").alias(name), F.col("said").alias(f"{name}_said"), *(F.col(c).alias(f"{name}_{c}") for c in scope))

    pairs = met.join(side("left"), "twins").join(side("right"), "right_twins").filter(
        (F.col("left") < F.col("right")) | (F.col("twins") != F.col("right_twins"))
    )
    for c in scope:
        pairs = pairs.filter(F.col(f"left_{c}") == F.col(f"right_{c}"))
    other = F.map_from_entries("right_said")
    dot = F.get(F.transform(F.array(other), lambda m: F.aggregate(
        "left_said", F.lit(0.0), lambda acc, e: acc + e["value"] * F.coalesce(F.try_element_at(m, e["place"]), F.lit(0.0))
    )), F.lit(0))
    return pairs.select(
        F.least("left", "right").alias("left"), F.greatest("left", "right").alias("right"), F.round(dot, DIGITS).alias("near")
    ).filter(F.col("near") >= least)


def founders(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, founder, near) for every node of ``nodes(node, strength)``; founders name themselves.

    The outcome is that of taking all nodes one by one, the strongest first (ties: smaller name): a node with a
    founder among its links joins one, any other founds. It joins the nearest founder (ties: the stronger).
    """
    named = nodes.select("node", F.struct((-F.col("strength")).alias("weak"), "node").alias("place"))
    left, right = (named.select(F.col("node").alias(c), F.col("place").alias(f"{c}_place")) for c in ("left", "right"))
    ends = links.join(left, "left").join(right, "right")
    first = F.col("left_place") < F.col("right_place")
    # strong stands before weak in the order; a weak node waits for all its strong neighbours.
    dealt = settle(ends.select(
        F.when(first, F.col("left")).otherwise(F.col("right")).alias("strong"),
        F.when(first, F.col("right")).otherwise(F.col("left")).alias("weak"), "near",
        F.when(first, F.col("left_place")).otherwise(F.col("right_place")).alias("place"),
    ))
    waits = dealt.select("weak").distinct()
    found = settle(nodes.select("node").join(waits.withColumnRenamed("weak", "node"), "node", "left_anti"))
    open_links = dealt.select("strong", "weak")
    fresh = found
    passing = []
    while True:
        # Nodes linked with a new founder can't found any more; nobody waits for them.
        taken = settle(open_links.join(fresh, F.col("strong") == F.col("node"), "left_semi").select(F.col("weak").alias("gone")).distinct())
        if taken.isEmpty():
            break
        waiting = settle(open_links.join(taken, F.col("weak") == F.col("gone"), "left_anti"))
        still = settle(waiting.join(taken, F.col("strong") == F.col("gone"), "left_anti"))
        fresh = settle(
            waiting.select(F.col("weak").alias("node")).distinct().join(still.select(F.col("weak").alias("node")).distinct(), "node", "left_anti")
        )
        before, found = found, settle(found.unionByName(fresh))
        # Tables that no later round reads.
        for table in (*passing, before, taken, waiting):
            discard(table)
        passing = [fresh, still]
        open_links = still
    nearest = dealt.join(found, F.col("strong") == F.col("node"), "left_semi").groupBy(F.col("weak").alias("node")).agg(
        F.min(F.struct((-F.col("near")).alias("far"), "place", "strong")).alias("best")
    )
    joined = nearest.join(found, "node", "left_anti").select("node", F.col("best.strong").alias("founder"), (-F.col("best.far")).alias("near"))
    return joined.unionByName(found.select("node", F.col("node").alias("founder"), F.lit(1.0).alias("near")))


def theme_members(clusters: DataFrame, least: float = LEAST, recall: float = RECALL) -> DataFrame:
    """All specific clusters with ``meta_key`` of their theme, ``near`` (cosine to its founder) and ``layer``.

    Content-wide buckets and low-signal clusters stay out, as in ``insights.meta_members``. A theme that one content
    alone holds does not recur yet; ``recurring_members`` leaves it out.
    """
    usable = C.visible(clusters).filter(~F.col("wide")).withColumn("tokens", signature(F.col("label"), F.col("summary")))
    named = settle(usable.withColumn("name", F.sha2(F.concat_ws(" ", F.coalesce("stance", F.lit("")), F.array_join("tokens", " ")), 256)))
    nodes = in_order(named.groupBy(F.coalesce("stance", F.lit("")).alias("stance"), "name").agg(
        F.any_value("tokens").alias("tokens"), F.max("importance").alias("strength")
    ), "name", name="node")
    vectors = settle(hashed(nodes, ["stance"]))
    founded = founders(nodes.select("node", "strength"), near_pairs(vectors, ["stance"], least, recall)).join(nodes.select("node", "name"), "node").join(
        nodes.select(F.col("node").alias("founder"), F.col("name").alias("founder_name")), "founder"
    )
    placed = named.join(founded.select("name", F.col("founder_name").alias("founder"), "near"), "name")
    order = [F.desc("near"), F.desc("importance"), F.asc("cluster_key")]
    layers = numbered(placed, order, ["founder", "video_id"], "layer")
    return settle(layers.withColumn("meta_key", F.concat_ws("_", "founder", F.col("layer").cast("string"))).drop("name", "founder", "tokens"))


def recurring_members(members: DataFrame) -> DataFrame:
    """The members of themes that more than one content holds."""
    videos = members.groupBy("meta_key").agg(F.count(F.lit(1)).alias("videos")).filter("videos > 1")
    return members.join(videos.select("meta_key"), "meta_key", "left_semi")
