"""Opinion units: the atoms that are clustered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from undertone.functions import lexicon as L
from undertone.functions import tokens as TK
from undertone.functions.expressions import slug
from undertone.operators.anchors import WIDE_LABEL
from undertone.operators.enrich import noise_flags

# Units per comment, and the aspect of comments without an anchor.
WIDE_ASPECT = "video.video_wide_discussion"
# Cut after sentence ends and before words of contrast.
BOUNDARY = "(?<=[.!?])\\s+|\\n+|\\s+(?=(?i:but|however|although|though)\\b)"
DENSITY_BASE, DENSITY_STEP, DENSITY_CAP = 0.15, 0.1, 0.95
COURTESY_WORDS = 3


def stance() -> Column:
    """One of eight stances from the columns span, tokens, good and bad.

    The order of the tests decides.
    """
    text = F.col("span")
    has = lambda pattern: F.rlike(text, F.lit(pattern))
    good, bad = F.col("good"), F.col("bad")
    return (
        F.when(has(L.LAUGHTER) | (has(L.LAUGHTER_INSIDE) & ~good & ~bad), "humor")
        .when(F.endswith(F.rtrim(text), F.lit("?")), "question")
        .when(good & bad, "mixed")
        .when(good, "positive")
        .when(bad, "negative")
        .when(has(L.REQUEST), "request")
        .when(F.size("tokens") >= 3, "observation")
        .otherwise("other")
    )


def unit_intent(intent: Column, stance_of: Column, text: Column) -> Column:
    return (
        F.when(stance_of.isin("question", "request"), "information_request")
        .when((intent == "joke") | (stance_of == "humor"), "joke")
        .when(intent == "agreement", "agreement")
        .when(intent.isin("correction", "disagreement"), "disagreement")
        .when(intent == "advice", "advice")
        .when(F.rlike(text, F.lit(L.CONFUSION)), "confusion")
        .when(stance_of.isin("positive", "negative", "mixed"), "feedback")
        .otherwise("other")
    )


def semantic_density(tokens: Column, flags: Column) -> Column:
    """Grows with the content words; noise halves it."""
    full = F.least(F.lit(DENSITY_CAP), F.lit(DENSITY_BASE) + F.lit(DENSITY_STEP) * F.size(tokens))
    return F.round(F.when(F.size(flags) > 0, full / 2).otherwise(full), 3)


def cluster_type(stance_of: Column, flags: Column) -> Column:
    noisy = lambda *names: F.arrays_overlap(flags, F.array(*[F.lit(n) for n in names]))
    return (
        F.when(noisy("spam"), "spam")
        .when(noisy("emoji_only", "reaction_only"), "reaction_only")
        .when(stance_of == "humor", "humor")
        .when(stance_of.isin("question", "request"), "question")
        .when(noisy("ultra_short") & stance_of.isin("other", "observation"), "mixed_noise")
        .otherwise("opinion")
    )


def split_spans(df: DataFrame, text: str, most: int | None = None) -> DataFrame:
    """Adds ``spans``: the pieces of a text column.

    A short word of courtesy ahead of a real statement is dropped. If the caller
    asks for at most ``most`` pieces, the last one holds all that is left.
    """
    cut = F.filter(F.transform(F.split(F.col(text), BOUNDARY), lambda s: F.trim(s)), lambda s: F.length(s) > 0)
    df = df.withColumn("pieces", cut).withColumn("opening", TK.words(F.get("pieces", F.lit(0))))
    courtesy = (
        (F.size("pieces") > 1)
        & (F.size("opening") <= COURTESY_WORDS)
        & (TK.count_listed("opening", L.POSITIVE_WORDS) > 0)
        & ~F.endswith(F.get("pieces", F.lit(0)), F.lit("?"))
    )
    rest = F.slice("pieces", F.lit(2), F.greatest(F.size("pieces") - 1, F.lit(1)))
    df = df.withColumn("pieces", F.when(courtesy, rest).otherwise(F.col("pieces")))
    spans = F.col("pieces")
    if most is not None:
        tail = F.array_join(F.slice("pieces", F.lit(most), F.greatest(F.size("pieces") - most + 1, F.lit(1))), " ")
        joined = F.concat(F.slice("pieces", 1, most - 1), F.array(tail))
        spans = F.when(F.size("pieces") > most, joined).otherwise(spans)
    return df.withColumn("spans", spans).drop("pieces", "opening")


def read_spans(df: DataFrame) -> DataFrame:
    """One row per span with its words, topic words, noise marks and stance."""
    phrase = F.rlike("span", F.lit(L.NEGATIVE_PHRASES))
    return (
        df.select("*", F.posexplode("spans").alias("piece", "span"))
        .withColumn("said", TK.words(F.col("span")))
        .withColumns(
            {
                "tokens": TK.topic_words("said"),
                "noise_flags": noise_flags("span", "said"),
                "good": (TK.count_listed("said", L.POSITIVE_WORDS) > 0) & ~phrase,
                "bad": (TK.count_listed("said", L.NEGATIVE_WORDS) > 0) | phrase,
            }
        )
        .withColumn("stance", stance())
    )


def extract_units(enriched: DataFrame) -> DataFrame:
    """Opinion units of the enriched comments; a lone short reaction gives none."""
    agreed = F.col("rewrite_applied") & F.col("inherits")
    spoken = (
        enriched.withColumn("spoken", F.when(agreed, F.col("resolved_text")).otherwise(F.col("raw_text")))
        .filter(F.length(F.trim("spoken")) > 0)
        .withColumn("said", TK.words(F.col("spoken")))
        .withColumn("flags", noise_flags("spoken", "said"))
        .filter(~(F.array_contains("flags", "reaction_only") & F.array_contains("flags", "ultra_short")))
        .drop("said", "flags")
    )
    cut = split_spans(spoken, "spoken").withColumn("spans", F.when(agreed, F.array("spoken")).otherwise(F.col("spans")))
    read = read_spans(cut).withColumn("primary", F.get("anchor_refs", F.lit(0)))
    named = F.concat_ws(".", F.col("primary.anchor_type"), F.nullif(slug(F.col("primary.label")), F.lit("")))
    return read.select(
        "video_id",
        "comment_id",
        F.concat_ws("_", "comment_id", F.lit("unit"), (F.col("piece") + 1).cast("string")).alias("unit_id"),
        "author_id",
        "depth",
        "span",
        F.regexp_replace(F.lower("span"), "\\s+", " ").alias("normalized_text"),
        "tokens",
        F.transform("anchor_refs", lambda r: r["anchor_id"]).alias("anchor_ids"),
        F.when(F.col("primary").isNull(), WIDE_ASPECT).otherwise(named).alias("aspect_key"),
        F.coalesce("primary.label", F.lit(WIDE_LABEL)).alias("aspect_label"),
        "stance",
        unit_intent(F.col("comment_intent"), F.col("stance"), F.col("span")).alias("intent"),
        F.when(F.col("inherits"), "parent_comment").when(F.col("depth") > 0, "thread_context").otherwise("video")
        .alias("evidence_source"),
        "grounding_confidence",
        semantic_density(F.col("tokens"), F.col("noise_flags")).alias("semantic_density"),
        "noise_flags",
        cluster_type(F.col("stance"), F.col("noise_flags")).alias("cluster_type"),
        "engagement_score",
    )


def aspect_buckets(units: DataFrame) -> DataFrame:
    """Coarse buckets: how much is said about what."""
    return units.groupBy("video_id", "aspect_key").agg(
        F.count(F.lit(1)).alias("units"),
        F.count_distinct("author_id").alias("authors"),
        F.round(F.sum("engagement_score"), 3).alias("engagement"),
    )
