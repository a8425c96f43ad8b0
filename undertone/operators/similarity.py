"""Linking similar texts, and connected components.

Texts that can be similar share a prefix token, tokens being ordered from rare
to common (see ``prefixes``). A token group first compares all members with one
hub, its weightiest text. Only groups that still hold several components then
compare members across them, so a group of near copies costs one comparison per
text. Every similar pair ends up in one component. Where the pairs themselves are
wanted, not only their components, ``similar_pairs`` finds all of them.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from undertone.functions import tokens as TK
from undertone.session import discard, settle

BLOCK = 2000


def bucket_of(scope: list[str]) -> Column:
    """One number for the columns of a scope; rows that hold a null in them link with nothing and must be left out."""
    return F.xxhash64(F.lit(0), *scope).alias("bucket")


def in_order(rows: DataFrame, *order: str, name: str) -> DataFrame:
    """``rows`` as a table with a number ``name`` that ascends with ``order``, so that eight bytes stand for a long name."""
    return settle(rows.orderBy(*order).withColumn(name, F.monotonically_increasing_id()))


def rare_first(said: DataFrame) -> DataFrame:
    """(token, word): words are numbers, the rarest first; ties by spelling. ``said`` has one row per node and token."""
    return in_order(said.groupBy("token").agg(F.count(F.lit(1)).alias("texts")), "texts", "token", name="word").select("token", "word")


def worded(nodes: DataFrame, scope: list[str]) -> DataFrame:
    """(bucket, node, weight, size, words): the tokens of each node as numbers, rare ones first."""
    said = nodes.select(*scope, "node", F.explode("tokens").alias("token"))
    inside = said.na.drop(subset=scope).select("node", "token")
    words = inside.join(rare_first(said), "token").groupBy("node").agg(F.sort_array(F.collect_list("word")).alias("words"))
    return nodes.na.drop(subset=scope).select(bucket_of(scope), "node", "weight", F.size("tokens").alias("size")).join(words, "node")


def prefixes(nodes: DataFrame, scope: list[str], prefix_at: float) -> DataFrame:
    """(bucket, node, weight, size, place, token): the tokens of each node that a similar node must share one of.

    With all sets in one order, two sets whose Jaccard similarity reaches ``prefix_at`` share a token
    among the first n - ceil(prefix_at * n) + 1. Rare tokens come first, so groups stay small. ``place`` counts
    the tokens of the node before this one. Tokens are numbers (see ``worded``).
    """
    return _first_words(worded(nodes, scope), prefix_at)


def _first_words(rows: DataFrame, prefix_at: float) -> DataFrame:
    keep = F.col("size") - F.ceil(F.lit(prefix_at) * F.col("size") - F.lit(1e-9)).cast("int") + 1
    return rows.select(
        "bucket", "node", "weight", "size", F.posexplode(F.slice("words", F.lit(1), F.greatest(keep, F.lit(0)))).alias("place", "token")
    )


def similar_links(nodes: DataFrame, scope: list[str], threshold: float, prefix_at: float) -> DataFrame:
    """Links (left, right) between similar nodes; their components are those of all similar pairs of a scope.

    ``nodes`` holds the scope columns, ``node``, ``tokens`` (distinct) and ``weight``. ``threshold`` is
    the least similarity of a link; ``prefix_at`` a Jaccard similarity that every such link reaches. One that
    similar nodes may fall short of is lowered to ``least_jaccard``.
    """
    prefix_at = min(prefix_at, least_jaccard(threshold))
    rows = settle(worded(nodes, scope))
    words = rows.select("node", "words")
    size, right_size = F.col("size"), F.col("right_size")
    sizes = F.least(size, right_size) >= F.greatest(size, right_size) * prefix_at - 1e-9
    before = F.least("place", "right_place")
    rest = F.least(size - F.col("place"), right_size - F.col("right_place"))

    def enough(shared: Column, slack: float = 0.0) -> Column:
        return TK.similarity(shared, size, right_size) >= threshold - slack

    def near_hub(pairs: DataFrame) -> DataFrame:
        # Two sets that meet at a word share at most the fewer words before it and the fewer from it on.
        can = pairs.filter(sizes).filter(enough(before + rest, 1e-9)).select("left", "right", "size", "right_size").distinct()
        return (
            can.join(words.withColumnsRenamed({"node": "left", "words": "left_words"}), "left")
            .join(words.withColumnsRenamed({"node": "right", "words": "right_words"}), "right")
            .filter(enough(TK.overlap(F.col("left_words"), F.col("right_words")))).select("left", "right")
        )

    def apart(labelled: DataFrame) -> DataFrame:
        """The similar pairs of rows in one group under different labels; only these leave the task that compares them."""
        # The first token two sets share, in the order of all, leaves no more than the rest of the shorter side to share.
        return _met(labelled.join(words, "node"), ["size", "place", "words"]).filter(sizes).filter(enough(rest, 1e-9)).filter(
            enough(TK.overlap(F.col("words"), F.col("right_words")))
        ).select("left", "right").distinct()

    return joined_links(_first_words(rows, prefix_at), near_hub, apart)


def least_jaccard(threshold: float) -> float:
    """The least Jaccard similarity of two sets whose similarity (``tokens.similarity``) reaches ``threshold``.

    At a given Jaccard similarity J the cosine is greatest, its root, if one set holds the other: J + sqrt(J) = 2 * threshold.
    """
    return ((math.sqrt(1 + 8 * threshold) - 1) / 2) ** 2


def least_share(threshold: float) -> float:
    """The least share of a set that it has in common with a similar set of its size or more: s of s + s / (2 - s) = 2 * threshold."""
    b = 3 + 2 * threshold
    return (b - math.sqrt(b * b - 16 * threshold)) / 2


def similar_pairs(nodes: DataFrame, scope: list[str], threshold: float) -> DataFrame:
    """All pairs (left, right), left < right, of a scope whose similarity is ``threshold`` or more, each once.

    Columns as in ``similar_links``. Two sets meet at words that stand in the prefixes of both: words up to where too few are left
    for any similar set (``least_jaccard``), for the smaller of the two up to where too few are left for one of its size or
    more (``least_share``). There only what is left of both is compared, which at the first word they share holds all they share.
    Groups of many sets are cut in blocks, and each two blocks meet in a task of their own; only similar pairs leave it.
    """
    rows = settle(worded(nodes, scope))
    said = _first_words(rows, least_jaccard(threshold))
    groups = said.groupBy("bucket", "token").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"), F.count(F.lit(1)).alias("n"))
    met = said.join(groups.filter("n > 1").drop("n"), ["bucket", "token"]).join(rows.select("node", "words"), "node").select(
        "bucket", "token", "node", "size", "place", F.slice("words", F.col("place") + 1, F.greatest(F.col("size"), F.lit(1))).alias("rest"),
        F.pmod(F.xxhash64("node"), "blocks").cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"),
    ).withColumn("marks", F.aggregate("rest", F.lit(0).cast("bigint"), lambda marks, w: marks.bitwiseOR(
        F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.xxhash64(w), F.lit(64)).cast("int")))))
    keep = F.col("size") - F.ceil(F.lit(least_share(threshold)) * F.col("size") - F.lit(1e-9)).cast("int") + 1
    less = met.filter(F.col("place") < keep).select("bucket", "token", "block", "other", "node", "size", "rest", "marks")
    more = met.select("bucket", "token", F.col("other").alias("block"), F.col("block").alias("other"), *(
        F.col(c).alias(f"more_{c}") for c in ("node", "size", "rest", "marks")
    ))
    size, more_size = F.col("size"), F.col("more_size")

    def enough(shared: Column, slack: float = 0.0) -> Column:
        return TK.similarity(shared, size, more_size) >= threshold - slack

    def shared_at_most(name: str, other: str) -> Column:
        """The words left of one side, without those that the other's marks rule out."""
        return F.size(f"{name}rest") - F.bit_count(F.col(f"{name}marks").bitwiseAND(F.bitwise_not(f"{other}marks")))

    # What is given to a higher-order function is evaluated once.
    near = F.get(F.transform(F.array(TK.overlap(F.col("rest"), F.col("more_rest"))), enough), F.lit(0))
    return (
        less.join(more, ["bucket", "token", "block", "other"])
        .filter((size < more_size) | ((size == more_size) & (F.col("node") < F.col("more_node"))))
        .filter(enough(F.least(shared_at_most("", "more_"), shared_at_most("more_", "")), 1e-9)).filter(near)
        .select(F.least("node", "more_node").alias("left"), F.greatest("node", "more_node").alias("right")).distinct()
    )


def _met(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of one bucket and token by twos, under different labels; the second one's ``columns`` as right_..."""
    other = rows.select("bucket", "token", F.col("node").alias("right"), *(F.col(c).alias(f"right_{c}") for c in ("label", *columns)))
    return rows.withColumnRenamed("node", "left").join(other, ["bucket", "token"]).filter("left < right AND label != right_label")


def joined_links(prefixed: DataFrame, near: Callable[[DataFrame], DataFrame], apart: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Links (left, right) whose components are those of all near pairs that share a prefix token of a scope.

    ``prefixed`` is (bucket, node, weight, token, ...); ``near`` keeps the near ones of (left, right, ...), the
    other columns of the left node as they are, those of the right one as right_... ; a pair may come more than once.
    ``apart`` gets the rows of groups that still hold several components, with their ``label``, and returns the
    near pairs of different labels. Tokens that one node of a bucket says alone are dropped at once.
    """
    keyed = settle(prefixed)
    group = ["bucket", "token"]
    more = [c for c in keyed.columns if c not in (*group, "node", "weight")]
    hubs = keyed.groupBy(*group).agg(F.max(F.struct("weight", "node", *more)).alias("hub"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = settle(keyed.drop("weight").join(
        hubs.select(*group, F.col("hub.node").alias("hub"), *(F.col(f"hub.{c}").alias(f"right_{c}") for c in more)), group
    ))
    met = shared.filter("node != hub").select(F.col("node").alias("left"), F.col("hub").alias("right"), *more, *(f"right_{c}" for c in more))
    first = settle(near(met).select("left", "right"))
    labelled = settle(
        shared.select(*group, "node", *more).join(components(first), "node", "left")
        .withColumn("label", F.coalesce("component", "node")).drop("component")
    )
    mixed = labelled.groupBy(*group).agg(F.min("label").alias("l"), F.max("label").alias("h")).filter("l != h").select(*group)
    return first.unionByName(apart(labelled.join(mixed, group, "left_semi")))


def weighted_prefixes(said: DataFrame, scope: list[str], least: float) -> DataFrame:
    """Prefix tokens of weighted words: (bucket, node, weight, left_over, token).

    ``said`` is (scope..., node, weight, token, n). Words go from rare to common; the rest is left out as
    soon as it is too short a vector for a cosine of ``least``, so near nodes share a word of both prefixes.
    ``left_over`` is how much of the node's length its words from this one on make up. Tokens are numbers.
    """
    bucketed = said.na.drop(subset=scope).select(bucket_of(scope), "node", "weight", "token", "n")
    rows = bucketed.join(rare_first(said.select("token")), "token").drop("token").withColumnRenamed("word", "token")
    order = W.partitionBy("node").orderBy("token")
    square = F.col("n").cast("double") * F.col("n")
    rest = rows.withColumns({
        "rest": F.sum(square).over(order.rowsBetween(0, W.unboundedFollowing)), "whole": F.sum(square).over(W.partitionBy("node")),
    })
    return rest.filter(F.col("rest") >= F.col("whole") * (least * least - 1e-9)).select(
        "bucket", "node", "weight", F.sqrt(F.col("rest") / F.col("whole")).alias("left_over"), "token"
    )


def weighted_links(said: DataFrame, scope: list[str], least: float) -> DataFrame:
    """Links (left, right) between nodes of weighted words with a cosine of at least ``least``; components as in ``similar_links``."""
    def near(pairs: DataFrame) -> DataFrame:
        return near_by_weights(pairs.select("left", "right").distinct(), said, least)

    def apart(rows: DataFrame) -> DataFrame:
        # From the first word two nodes share, the product is at most that of what is left of both.
        can = F.col("left_over") * F.col("right_left_over") >= least - 1e-9
        return near(_met(rows, ["left_over"]).filter(can))

    return joined_links(weighted_prefixes(said, scope, least), near, apart)


def near_by_weights(pairs: DataFrame, said: DataFrame, least: float) -> DataFrame:
    """The pairs whose weighted words have a cosine of at least ``least``."""
    norms = said.groupBy("node").agg(F.sum(F.col("n").cast("double") * F.col("n")).alias("square"))
    left = said.select(F.col("node").alias("left"), "token", F.col("n").cast("double").alias("left_n"))
    right = said.select(F.col("node").alias("right"), "token", F.col("n").alias("right_n"))
    products = pairs.join(left, "left").join(right, ["right", "token"]).groupBy("left", "right").agg(
        F.sum(F.col("left_n") * F.col("right_n")).alias("product")
    )
    return (
        products.join(norms.select(F.col("node").alias("left"), F.col("square").alias("left_square")), "left")
        .join(norms.select(F.col("node").alias("right"), F.col("square").alias("right_square")), "right")
        .filter(F.col("product") / F.sqrt(F.col("left_square") * F.col("right_square")) >= least)
        .select("left", "right")
    )


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every linked node; the component is its least node.

    Each round takes the least label among the neighbours and then the label
    of that label, so long chains shrink fast; it goes on until nothing changes. Every round is written and
    read again: a checkpoint would keep what the planner knows of its columns, which doubles from round to round.
    """
    both = settle(
        links.select("left", "right")
        .unionByName(links.select(F.col("right").alias("left"), F.col("left").alias("right")))
        .distinct()
    )
    last = settle(
        both.groupBy(F.col("left").alias("node")).agg(F.min("right").alias("least"))
        .select("node", F.least("node", "least").alias("component"))
    )
    while True:
        labels = last.select("node", "component")
        offered = (
            both.join(labels, F.col("right") == F.col("node"))
            .groupBy("left").agg(F.min("component").alias("offer"))
        )
        lowered = labels.join(offered, F.col("node") == F.col("left")).select(
            "node", F.col("component").alias("before"), F.least("component", "offer").alias("component")
        )
        shortcut = labels.select(F.col("node").alias("component"), F.col("component").alias("further"))
        stepped = settle(
            lowered.join(shortcut, "component", "left").select(
                "node", "before", F.least("component", F.coalesce("further", "component")).alias("component")
            )
        )
        discard(last)
        last = stepped
        if stepped.filter("before != component").isEmpty():
            discard(both)
            return stepped.select("node", "component")
