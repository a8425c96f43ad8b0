"""Mixing sources to target weights, with DataFrame functions only.

Sizes are words. Targets come from one row per source; each document is then
taken floor(rate) times, and once more where a hash of seed, id and text falls below
the fraction. Of ``SEEDS`` seeds each source uses the one whose sum of taken
words comes nearest its target, so that a few long documents don't carry a
small source away. Only sums per source are shuffled, so a source with a third
of all rows costs no more than others. The table of targets is broadcast when it has
at most ``BROADCAST_SOURCES`` rows and joined by shuffle otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from undertone.session import settle

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MOST = 3
BROADCAST_SOURCES = 50_000
SEED = "mix"
SEEDS = 16


def words(text: str) -> Column:
    """The number of words of a text; 0 for null."""
    return F.coalesce(F.expr(f"regexp_count(`{text}`, r'{WORD}')"), F.lit(0)).cast("long")


def name(key: str, text: str) -> Column:
    """What a document draws by: its key and a digest of its text, so that null or shared keys don't draw alike."""
    return F.concat(
        F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit("|"), F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary"))
    )


def draw(key: Column, number: Column | int, seed: str = SEED) -> Column:
    """A number in [0, 1) from the hash of seed, seed number and key (as text); the same in every run."""
    number = F.lit(number) if isinstance(number, int) else number
    digest = F.md5(F.concat(F.lit(seed + "|"), number.cast("string"), F.lit("|"), F.coalesce(key.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target) for the columns ``source`` and ``size``.

    Sources in code point order, null last, weigh as ``weights`` repeats. The sum of all sizes is
    shared by weight; no target exceeds ``most`` times its source's size, and what that leaves over
    is shared again. In order of the level at which they reach their limit, a source is limited
    iff the level of those not before it is above its own, so one pass finds all of them.
    """
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source"))
    ranked = total.withColumn("place", place).withColumn(
        "weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    )
    everything = Window.partitionBy()
    by_limit = Window.orderBy(F.col("source_size") / F.col("weight"), "place")
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    level = (
        ranked.withColumn("limit", most * F.col("source_size"))
        .withColumn("taken_before", F.coalesce(F.sum("limit").over(before), F.lit(0)))
        .withColumn("weight_left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("level", (F.sum("source_size").over(everything) - F.col("taken_before")) / F.col("weight_left"))
        .withColumn("limited", F.col("level") * F.col("weight") > F.col("limit"))
    )
    final = F.min(F.when(~F.col("limited"), F.struct(F.col("source_size") / F.col("weight"), "place", "level"))).over(everything)
    return level.select(
        "source", "source_size",
        F.when(F.col("limited"), F.col("limit").cast("double")).otherwise(final["level"] * F.col("weight")).alias("target"),
    )


def _rate(most: int) -> Column:
    rate = F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))
    return F.when(F.col("source_size") > 0, rate).otherwise(0.0)


def _times(number: Column | int, seed: str) -> Column:
    """floor(rate), and one more where the draw falls below the fraction."""
    more = F.when(draw(F.col("key"), number, seed) < F.col("rate") - F.floor("rate"), 1).otherwise(0)
    return F.floor("rate") + more


def seeded_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = SEED) -> DataFrame:
    """(source, source_size, target, rate, number): targets, and the number of the seed each source uses.

    ``sizes`` has the columns ``source``, ``key`` and ``size``. Equally near seeds: the smaller number.
    """
    targets = _bounded(settle(source_targets(sizes, weights, most).withColumn("rate", _rate(most))))
    taken = (
        sizes.withColumnRenamed("source", "place").join(targets, F.col("place").eqNullSafe(F.col("source")))
        .groupBy("source", "source_size", "target", "rate")
        .agg(*(F.sum(F.col("size") * _times(n, seed)).alias(f"taken{n}") for n in range(SEEDS)))
    )
    distances = F.array(*(F.struct(F.abs(F.col(f"taken{n}") - F.col("target")).alias("distance"), F.lit(n).alias("number")) for n in range(SEEDS)))
    return taken.select("source", "source_size", "target", "rate", F.array_min(distances)["number"].alias("number"))


def _bounded(targets: DataFrame) -> DataFrame:
    """A table of one row per source, to be broadcast if it is short enough."""
    return F.broadcast(targets) if targets.count() <= BROADCAST_SOURCES else targets


def with_targets(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST,
    text: str = "text", source: str = "source", key: str = "doc_id", seed: str = SEED,
) -> DataFrame:
    """``docs`` with ``mix_size``, ``mix_source_size``, ``mix_target`` and ``mix_times``.

    ``mix_times`` is how often the mix takes the document, at most ``most``. A null text has size 0;
    documents of a source without words are taken 0 times; a null source is a source of its own;
    rows that agree in key (also null) and text share one draw. Columns of ``docs`` stay as they are,
    whatever their names; only the four above are replaced.
    """
    sized = docs.select(
        F.struct(*docs.columns).alias("doc"), words(text).alias("size"), F.col(source).alias("place"), name(key, text).alias("key")
    )
    sizes = settle(sized.select(F.col("place").alias("source"), "key", "size"))
    targets = _bounded(settle(seeded_targets(sizes, weights, most, seed)))
    made = {"mix_size": F.col("size"), "mix_source_size": F.col("source_size"), "mix_target": F.col("target"),
            "mix_times": _times(F.col("number"), seed).cast("int")}
    kept = [F.col("doc")[c].alias(c) for c in docs.columns if c not in made]
    return sized.join(targets, F.col("place").eqNullSafe(F.col("source"))).select(*kept, *(c.alias(n) for n, c in made.items()))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, **names: str) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it."""
    plain = docs.select(F.struct(*docs.columns).alias("doc"), *docs.columns)
    taken = with_targets(plain, weights, most, **names).filter("mix_times > 0")
    return taken.select("doc", F.explode(F.sequence(F.lit(1), "mix_times"))).select("doc.*")
