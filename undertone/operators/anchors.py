"""Anchors: the addressable parts of a content that comments can refer to.

All anchors of a content come from its one context row, so they are built and
kept as an array inside that row; nothing is exploded until someone asks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from undertone.functions import lexicon as L
from undertone.functions.expressions import slug
from undertone.functions.tokens import content_tokens, spaced

CONTEXT_SCHEMA = (
    "video_id STRING, main_topic STRING, summary STRING, "
    "people ARRAY<STRING>, objects ARRAY<STRING>, locations ARRAY<STRING>, "
    "timeline ARRAY<STRUCT<start: STRING, end: STRING, description: STRING>>, "
    "key_moments ARRAY<STRUCT<timestamp: STRING, description: STRING>>, "
    "controversial_moments ARRAY<STRUCT<timestamp: STRING, description: STRING>>, "
    "transcript STRING, visual_text ARRAY<STRING>, calls_to_action ARRAY<STRING>"
)
ANCHOR_TYPE = (
    "ARRAY<STRUCT<anchor_id: STRING, anchor_type: STRING, source_field: STRING, label: STRING, "
    "starts_at: STRING, ends_at: STRING>>"
)
ANCHOR_FIELDS = ["anchor_id", "anchor_type", "source_field", "label", "starts_at", "ends_at"]

# Fixed value: the default label.
WIDE_LABEL = "Video-wide discussion"


def _anchor(anchor_id: Column, kind: str, source: str, label: Column,
            starts: Column | None = None, ends: Column | None = None) -> Column:
    missing = F.lit(None).cast("string")
    return F.struct(
        anchor_id.alias("anchor_id"),
        F.lit(kind).alias("anchor_type"),
        F.lit(source).alias("source_field"),
        label.alias("label"),
        (missing if starts is None else starts).alias("starts_at"),
        (missing if ends is None else ends).alias("ends_at"),
    )


def _joined(*parts: Column | str) -> Column:
    return F.concat_ws("_", *[F.lit(p) if isinstance(p, str) else p for p in parts])


def _array(name: str, kind: str) -> Column:
    return F.coalesce(F.col(name), F.array().cast(kind))


def anchor_array() -> Column:
    """The anchors of a context row as one array, in order of precedence."""
    video = F.col("video_id")
    moments = "ARRAY<STRUCT<timestamp: STRING, description: STRING>>"
    contested = _array("controversial_moments", moments)
    plain = F.filter(
        _array("key_moments", moments),
        lambda k: ~F.exists(
            contested,
            lambda c: (c["timestamp"] == k["timestamp"]) & (c["description"] == k["description"]),
        ),
    )

    def moment(kind: str, source: str):
        return lambda m: _anchor(
            _joined(video, "moment", slug(m["timestamp"]), slug(m["description"])),
            kind, source, m["description"], m["timestamp"],
        )

    def entity(prefix: str):
        return lambda e: _anchor(_joined(video, prefix, slug(e)), "entity", "keyEntities", e)

    def numbered(prefix: str, kind: str, source: str):
        return lambda line, i: _anchor(
            _joined(video, prefix, i.cast("string"), slug(line)), kind, source, line
        )

    lines = F.transform(F.split(F.coalesce("transcript", F.lit("")), "\\n"), lambda s: F.trim(s))
    spoken = F.filter(lines, lambda s: (F.length(s) >= 12) & (F.size(F.split(s, "\\s+")) >= 3))
    shown = F.filter(_array("visual_text", "ARRAY<STRING>"), lambda s: F.length(F.trim(s)) >= 3)
    calls = F.filter(
        _array("calls_to_action", "ARRAY<STRING>"),
        lambda s: (F.length(F.trim(s)) > 0) & ~F.rlike(s, F.lit(L.GENERIC_CALLS)),
    )
    timeline = _array("timeline", "ARRAY<STRUCT<start: STRING, end: STRING, description: STRING>>")
    overall = _anchor(
        _joined(video, "global_video"), "global_video", "summary",
        F.coalesce(F.nullif(F.col("main_topic"), F.lit("")), F.lit(WIDE_LABEL)),
    )
    parts = [
        F.array(overall),
        F.transform(contested, moment("controversy", "controversialMoments")),
        F.transform(plain, moment("moment", "keyMoments")),
        F.transform(
            timeline,
            lambda t: _anchor(
                _joined(video, "timeline", slug(t["start"]), slug(t["description"])),
                "timeline_segment", "timeline", t["description"], t["start"], t["end"],
            ),
        ),
        F.transform(_array("people", "ARRAY<STRING>"), entity("person")),
        F.transform(_array("objects", "ARRAY<STRING>"), entity("object")),
        F.transform(_array("locations", "ARRAY<STRING>"), entity("location")),
        F.transform(spoken, numbered("quote", "spoken_quote", "transcript")),
        F.transform(shown, numbered("visual", "visual_text", "visualText")),
        F.transform(calls, numbered("cta", "cta", "callsToAction")),
    ]
    return F.concat(*[p.cast(ANCHOR_TYPE) for p in parts])


def with_anchors(contexts: DataFrame) -> DataFrame:
    """(video_id, anchors): one row per content, each anchor with its words."""
    bare = contexts.select("video_id", anchor_array().alias("bare"))
    return bare.select(
        "video_id",
        F.transform(
            "bare",
            lambda a: F.struct(
                *[a[name].alias(name) for name in ANCHOR_FIELDS],
                content_tokens(a["label"]).alias("tokens"),
                spaced(a["label"]).alias("plain"),
            ),
        ).alias("anchors"),
    )


def anchors_table(contexts: DataFrame) -> DataFrame:
    """One row per anchor."""
    return with_anchors(contexts).select(
        "video_id", F.posexplode("anchors").alias("ordinal", "anchor")
    ).select("video_id", "ordinal", "anchor.*")
