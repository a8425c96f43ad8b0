"""Comments with their grounding, intent and resolved text.

Grounding scores a comment against the anchors of its own content. The anchors
arrive as one array per content, so the join is comment-to-content on the
content id and no comment-anchor pair ever becomes a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from undertone.functions import lexicon as L
from undertone.functions import tokens as TK
from undertone.functions.expressions import comment_engagement
from undertone.operators.anchors import WIDE_LABEL
from undertone.operators.threads import follow
from undertone.session import settle

# Score rules of this project (see lexicon.RULES_VERSION): weight of the shared
# tokens in the anchor and in the comment, and the thresholds built on them.
ANCHOR_SHARE = 0.5
COMMENT_SHARE = 0.3
CONTAINED_BONUS = 0.28
VAGUE_SCORE = 0.4
GENERIC_SCORE = 0.28
MIN_SCORE = 0.2
UNGROUNDED = 0.2
REWRITE_FROM = 0.7
INHERITED_SHARE = 0.55
# type -> (score factor, bonus for being specific)
TYPE_WEIGHTS = {
    "controversy": (1.0, 0.10),
    "moment": (1.0, 0.08),
    "spoken_quote": (1.0, 0.05),
    "entity": (0.7, 0.05),
    "timeline_segment": (0.9, 0.04),
    "visual_text": (0.9, 0.04),
    "cta": (0.9, 0.03),
    "global_video": (0.8, 0.0),
}
REF_TYPE = (
    "ARRAY<STRUCT<anchor_id: STRING, anchor_type: STRING, label: STRING, role: STRING, confidence: DOUBLE>>"
)


def _by_type(kind: Column, index: int) -> Column:
    value = F.lit(0.0)
    for name, weights in TYPE_WEIGHTS.items():
        value = F.when(kind == name, F.lit(weights[index])).otherwise(value)
    return value


def comment_intent(said: str = "said") -> Column:
    """One of twelve intents of ``text`` and its words; the order of the tests decides."""
    text = F.col("text")
    has = lambda pattern: F.rlike(text, F.lit(pattern))
    return (
        F.when(has(L.SPAM_CUES), "spam")
        .when(has(L.LAUGHTER), "joke")
        .when(TK.all_listed(said, L.REACTION_WORDS), F.when(has(L.AGREEMENT), "agreement").otherwise("reaction"))
        .when(F.endswith(F.rtrim(text), F.lit("?")) | has(L.QUESTION_START), "question")
        .when(has(L.DISAGREEMENT), "disagreement")
        .when(has(L.AGREEMENT), "agreement")
        .when(has(L.CORRECTION), "correction")
        .when(has(L.ADVICE), "advice")
        .when(has(L.CRITICISM_CUES), "criticism")
        .when(has(L.PRAISE_CUES), "praise")
        .when(has(L.META), "meta")
        .otherwise("other")
    )


def noise_flags(text: str, said: str) -> Column:
    """Low-signal marks of a text column and its column of words."""
    count = F.size(said)
    symbols = (F.length(F.trim(F.col(text))) > 0) & (count == 0)
    return F.array_compact(
        F.array(
            F.when(symbols, "emoji_only"),
            F.when((count <= 2) & ~symbols, "ultra_short"),
            F.when(TK.all_listed(said, L.REACTION_WORDS), "reaction_only"),
            F.when(F.rlike(F.col(text), F.lit(L.SPAM_CUES)), "spam"),
        )
    )


def _confidence(a: Column) -> Column:
    """Score of one anchor against the columns tokens, plain and vague."""
    shared = TK.overlap(a["tokens"], F.col("tokens"))
    parts = [(ANCHOR_SHARE, F.size(a["tokens"])), (COMMENT_SHARE, F.size("tokens"))]
    base = sum(
        (F.coalesce(F.try_divide(F.lit(share) * shared, size), F.lit(0.0)) for share, size in parts), F.lit(0.0)
    )
    quoted = (F.size(a["tokens"]) >= 2) & F.contains(F.col("plain"), a["plain"])
    base = base + F.when(quoted, CONTAINED_BONUS).otherwise(0.0)
    base = F.least(F.lit(0.98), base * _by_type(a["anchor_type"], 0))
    pointed = F.col("vague") & a["anchor_type"].isin("controversy", "moment")
    return F.round(F.greatest(base, F.when(pointed, VAGUE_SCORE).otherwise(0.0)), 3)


def ground(comments: DataFrame, contexts: DataFrame) -> DataFrame:
    """All own anchor references of each comment, best first.

    ``contexts`` is (video_id, anchors). The comment side of the join may be as
    skewed as it likes: the context side has one row per content, so AQE can
    split a hot content.
    """
    missing = F.array(
        F.struct(
            F.concat(F.col("video_id"), F.lit("_global_video")).alias("anchor_id"),
            F.lit("global_video").alias("anchor_type"),
            F.lit(WIDE_LABEL).alias("label"),
        )
    )
    words_known = comments.withColumns(
        {"said": TK.words(F.col("text")), "vague": F.rlike("text", F.lit(L.VAGUE_REFERENCE))}
    ).withColumns(
        {
            "tokens": TK.topic_words("said"),
            "plain": F.concat(F.lit(" "), F.array_join("said", " "), F.lit(" ")),
            "intent": comment_intent("said"),
        }
    )
    joined = words_known.join(contexts, "video_id", "left").withColumn(
        "measured",
        F.transform(
            F.coalesce("anchors", F.array().cast(contexts.schema["anchors"].dataType)),
            lambda a, i: F.struct(
                _confidence(a).alias("confidence"), i.alias("ordinal"), a["anchor_id"].alias("anchor_id"),
                a["anchor_type"].alias("anchor_type"), a["label"].alias("label"),
            ),
        ),
    )
    joined = joined.withColumn(
        "scored",
        F.sort_array(
            F.transform(
                F.filter("measured", lambda m: m["confidence"] >= MIN_SCORE),
                lambda m: F.struct(
                    (-(m["confidence"] + _by_type(m["anchor_type"], 1))).alias("order"), m["ordinal"].alias("ordinal"),
                    m["confidence"].alias("confidence"), m["anchor_id"].alias("anchor_id"),
                    m["anchor_type"].alias("anchor_type"), m["label"].alias("label"),
                ),
            )
        ),
    ).withColumn(
        "overall",
        F.coalesce(
            F.transform(
                F.slice("anchors", 1, 1),
                lambda a: F.struct(a["anchor_id"].alias("anchor_id"), a["anchor_type"].alias("anchor_type"), a["label"].alias("label")),
            ),
            missing,
        ),
    )
    generic = (
        (F.size("scored") == 0)
        & F.rlike("text", F.lit(L.CONTENT_NOUNS))
        & F.col("intent").isin("praise", "criticism")
    )
    overall = F.get("overall", F.lit(0))
    fallback = F.array(
        F.struct(
            overall["anchor_id"].alias("anchor_id"),
            overall["anchor_type"].alias("anchor_type"),
            overall["label"].alias("label"),
            F.lit("primary").alias("role"),
            F.lit(GENERIC_SCORE).alias("confidence"),
        )
    ).cast(REF_TYPE)
    own = F.transform(
        "scored",
        lambda s, i: F.struct(
            s["anchor_id"].alias("anchor_id"),
            s["anchor_type"].alias("anchor_type"),
            s["label"].alias("label"),
            F.when(i == 0, "primary").otherwise("secondary").alias("role"),
            s["confidence"].alias("confidence"),
        ),
    ).cast(REF_TYPE)
    return joined.withColumn("anchor_refs", F.when(generic, fallback).otherwise(own)).drop(
        "anchors", "plain", "said", "measured", "scored", "overall"
    )


def inherit(grounded: DataFrame) -> DataFrame:
    """Replies that say too little take the anchors of the comment they answer.

    A chain of such replies is followed to the nearest comment that stands by
    itself; every step lowers the confidence.
    """
    leans = F.col("parent_comment_id").isNotNull() & (
        (F.size("anchor_refs") == 0) | ((F.col("intent") == "agreement") & (F.size("tokens") <= 2))
    )
    links = grounded.filter(leans).select(
        F.col("video_id").alias("scope"), F.col("comment_id").alias("node"),
        F.col("parent_comment_id").alias("target"),
    )
    # Replies that only lean on each other stand by themselves where their cycle is cut.
    reached = follow(links).filter("not cut").select(
        F.col("scope").alias("video_id"), F.col("node").alias("comment_id"),
        F.col("target").alias("source_id"), "hops",
    )
    source = grounded.select(
        "video_id",
        F.col("comment_id").alias("source_id"),
        F.col("anchor_refs").alias("source_refs"),
        F.col("text").alias("source_text"),
    )
    # Comments that stand by themselves look themselves up, so that no join key
    # is null and the null rows of a busy content do not meet in one task.
    joined = (
        grounded.join(reached, ["video_id", "comment_id"], "left")
        .withColumn("source_id", F.coalesce("source_id", "comment_id"))
        .join(source, ["video_id", "source_id"], "left")
    )
    damp = F.pow(F.lit(INHERITED_SHARE), F.col("hops"))
    taken = F.transform(
        "source_refs",
        lambda r: F.struct(
            r["anchor_id"].alias("anchor_id"), r["anchor_type"].alias("anchor_type"),
            r["label"].alias("label"), r["role"].alias("role"),
            F.round(r["confidence"] * damp, 3).alias("confidence"),
        ),
    ).cast(REF_TYPE)
    inherits = F.col("hops").isNotNull() & F.col("source_text").isNotNull()
    return joined.withColumns(
        {
            "inherits": inherits,
            "anchor_refs": F.when(inherits & (F.size("source_refs") > 0), taken).otherwise(F.col("anchor_refs")),
        }
    )


def enrich(comments: DataFrame, contexts: DataFrame) -> DataFrame:
    """Enriched comments.

    ``comments`` holds video_id, comment_id, parent_comment_id, depth,
    author_id, text, likes, reply_count, shares, views.
    """
    df = inherit(settle(ground(comments, contexts))).withColumn("primary", F.get("anchor_refs", F.lit(0)))
    primary = F.col("primary")
    confidence = F.coalesce(primary["confidence"], F.lit(UNGROUNDED))
    agrees = F.col("inherits") & (F.col("intent") == "agreement")
    sure = (confidence >= REWRITE_FROM) & primary["label"].isNotNull()
    resolved = (
        F.when(
            agrees,
            F.concat(
                F.lit("I agree with the parent comment about "),
                F.regexp_replace("source_text", "[.\\s]+$", ""),
                F.lit("."),
            ),
        )
        .when(sure, F.concat(F.col("text"), F.lit(" (referring to "), primary["label"], F.lit(")")))
        .otherwise(F.col("text"))
    )
    pronoun = F.rlike("text", F.lit(L.BARE_PRONOUN)) & primary["anchor_id"].isNotNull()
    unsure = confidence < REWRITE_FROM
    person = F.rlike("text", F.lit(L.PERSON_PRONOUN)) & (F.col("depth") > 0) & ~F.col("inherits")
    flags = F.array_compact(
        F.array(
            F.when(pronoun & unsure & ~agrees & (confidence <= 0.4), "unclear_pronoun"),
            F.when(F.rlike("text", F.lit(L.VAGUE_TIME)) & unsure, "unclear_time_reference"),
            F.when(person & unsure, "reply_target_ambiguous"),
            F.when(primary["anchor_id"].isNull(), "video_anchor_not_found"),
            F.when(confidence <= 0.4, "multi_interpretation_possible"),
        )
    )
    target = (
        F.when(F.col("parent_comment_id").isNull(), "video")
        .when(F.col("inherits"), "parent_comment")
        .when(F.size("anchor_refs") > 0, "video")
        .when(F.col("depth") > 1, "thread")
        .otherwise("unclear")
    )
    score = comment_engagement(F.col("likes"), F.col("reply_count"), F.col("shares"), F.col("views"))
    return df.select(
        "video_id",
        "comment_id",
        "parent_comment_id",
        "depth",
        "author_id",
        F.col("text").alias("raw_text"),
        resolved.alias("resolved_text"),
        (agrees | sure).alias("rewrite_applied"),
        target.alias("target_type"),
        "anchor_refs",
        confidence.alias("grounding_confidence"),
        flags.alias("ambiguity_flags"),
        F.col("intent").alias("comment_intent"),
        F.col("inherits"),
        F.col("likes"),
        F.col("reply_count"),
        F.round(score, 3).alias("engagement_score"),
    )


def with_provenance(df: DataFrame, model: str = L.RULES_VERSION, prompt_version: str = "none") -> DataFrame:
    """Which rules made a row."""
    return df.withColumns(
        {
            "enrichment_model": F.lit(model),
            "prompt_version": F.lit(prompt_version),
            "schema_version": F.lit("1.0.0"),
        }
    )
