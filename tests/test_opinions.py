"""The opinion steps on the two-video fixture, against recorded outcomes."""

import pytest
from pyspark.sql import functions as F

import cooking
from undertone.operators import anchors as A
from undertone.operators import clusters as C
from undertone.operators import enrich as N
from undertone.operators import evaluate as V
from undertone.operators import insights as I
from undertone.operators import units as U
from undertone.session import settle


@pytest.fixture(scope="module")
def contexts(spark):
    return spark.createDataFrame(cooking.CONTEXTS, A.CONTEXT_SCHEMA)


@pytest.fixture(scope="module")
def comments(spark):
    return spark.createDataFrame(cooking.COMMENTS, cooking.COMMENT_SCHEMA)


@pytest.fixture(scope="module")
def enriched(comments, contexts):
    return settle(N.enrich(comments, A.with_anchors(contexts)))


@pytest.fixture(scope="module")
def units(enriched):
    return settle(U.extract_units(enriched))


@pytest.fixture(scope="module")
def members(units):
    return C.assign_clusters(units)


@pytest.fixture(scope="module")
def clusters(members):
    return C.build_clusters(members)


def by(df, key, value):
    return {r[key]: r[value] for r in df.collect()}


def test_anchors_in_order(contexts):
    rows = A.anchors_table(contexts).filter("video_id = 'v1'").orderBy("ordinal").collect()
    assert [r.anchor_id for r in rows] == cooking.V1_ANCHORS
    assert rows[1].anchor_type == "controversy" and rows[9].anchor_type == "spoken_quote"


def test_grounding_accuracy(spark, enriched):
    predicted = enriched.select("comment_id", F.get("anchor_refs", F.lit(0))["anchor_id"].alias("anchor_id"))
    expected = spark.createDataFrame(cooking.GROUNDING, "comment_id STRING, fragments ARRAY<STRING>")
    row = V.grounding_accuracy(predicted, expected).first()
    assert (row.passed, row.total, row.accuracy) == (6, 6, 1.0)


def test_enrichment_fields(enriched):
    rows = {r.comment_id: r for r in enriched.collect()}
    assert rows["c1"].grounding_confidence == 0.4 and not rows["c1"].rewrite_applied
    assert rows["c1"].ambiguity_flags == ["unclear_pronoun", "multi_interpretation_possible"]
    assert rows["c1r1"].resolved_text == "I agree with the parent comment about that part is unsafe."
    assert rows["c1r1"].target_type == "parent_comment" and rows["c1r1"].grounding_confidence == 0.22
    assert rows["c1r1"].ambiguity_flags == ["multi_interpretation_possible"]
    assert rows["c2"].resolved_text.endswith("(referring to Do not move it once it hits the pan.)")
    assert rows["c2"].grounding_confidence == 0.98 and rows["c2"].ambiguity_flags == []
    for name in ("c3", "c4"):
        assert rows[name].grounding_confidence == 0.2 and rows[name].anchor_refs == []
        assert rows[name].ambiguity_flags == ["video_anchor_not_found", "multi_interpretation_possible"]
    assert rows["c5"].grounding_confidence == 0.28
    assert rows["d1"].anchor_refs[0].anchor_type == "controversy" and len(rows["d1"].anchor_refs) > 1
    assert rows["d2"].ambiguity_flags == []
    intents = {k: r.comment_intent for k, r in rows.items()}
    assert intents == {
        "c1": "criticism", "c1r1": "agreement", "c2": "correction", "c3": "joke", "c4": "other", "c5": "praise",
        "d1": "other", "d2": "question",
    }


def test_engagement_scores(enriched):
    scores = by(enriched, "comment_id", "engagement_score")
    assert {k: scores[k] for k in cooking.ENGAGEMENT} == cooking.ENGAGEMENT


def test_units(spark, units):
    assert by(units, "unit_id", "stance") == cooking.STANCES
    assert by(units, "unit_id", "intent") == cooking.INTENTS
    spans = by(units, "unit_id", "span")
    assert spans["c4_unit_1"] == "I won't remember any of them."
    expected = spark.createDataFrame(
        [("c4", 1, ["won't remember any of them"], ["Very informative"], "negative")],
        "comment_id STRING, unit_count INT, required ARRAY<STRING>, forbidden ARRAY<STRING>, stance STRING",
    )
    assert V.unit_accuracy(units, expected).first().accuracy == 1.0


def test_density_grows_with_content(units):
    density = by(units, "unit_id", "semantic_density")
    assert density["c4_unit_1"] <= density["c5_unit_1"] <= density["c2_unit_1"]


def test_long_text_keeps_every_word(spark):
    text = "One is here. Two is there! Three is near. Four is far. Five is last."
    df = U.split_spans(spark.createDataFrame([(text,)], "t STRING"), "t")
    spans = df.first().spans
    assert len(spans) == 5 and " ".join(spans) == text
    few = U.split_spans(spark.createDataFrame([(text,)], "t STRING"), "t", 3).first().spans
    assert len(few) == 3 and " ".join(few) == text


def test_contrast_splits(spark):
    df = U.split_spans(spark.createDataFrame([("I love the recipe but the room-temp advice is unsafe",)], "t STRING"), "t")
    assert df.first().spans == ["I love the recipe", "but the room-temp advice is unsafe"]


def test_cluster_ids_and_sizes(clusters):
    assert set(by(clusters, "local_cluster_id", "size")) == set(cooking.CLUSTERS)
    labels = by(clusters, "local_cluster_id", "label")
    assert labels["v2_entity_pan_question_question_1"] == "Questions about pan"
    summaries = by(clusters, "local_cluster_id", "summary")
    name = "v1_controversy_creator_says_steak_can_sit_a_opinion_negative_2"
    assert summaries[name] == (
        "2 opinion units criticize or challenge Creator says steak can sit at room temperature for an hour."
    )


def test_importance_from_recorded_values(spark, members):
    values = spark.createDataFrame(
        [(k, g, d) for k, (g, d) in cooking.UNIT_VALUES.items()], "unit_id STRING, g DOUBLE, d DOUBLE"
    )
    recorded = members.join(values, "unit_id").drop("grounding_confidence", "semantic_density").withColumnsRenamed(
        {"g": "grounding_confidence", "d": "semantic_density"}
    )
    assert by(C.build_clusters(recorded), "local_cluster_id", "importance") == cooking.CLUSTERS


def test_purity(spark, members):
    gold = spark.createDataFrame(cooking.UNIT_LABELS, "unit_id STRING, label STRING")
    row = V.weighted_purity(V.cluster_purity(members, gold)).first()
    assert (row.dominant, row.labelled, row.purity) == (7, 7, 1.0)


def test_meta_cluster(spark, members, clusters):
    themes = I.meta_members(clusters)
    metas = I.build_meta_clusters(themes, members, clusters).collect()
    assert len(metas) == 1
    meta = metas[0]
    assert meta.canonical_theme == "Recurring criticism of Creator repeats the one hour room temperature advice"
    assert (meta.videos, meta.comments, meta.recurrence, meta.importance) == (2, 3, 1.0, 1.0)
    assert meta.summary.endswith("appears across 2 videos and is supported by 2 related local clusters.")
    reps = I.meta_representatives(themes, members).orderBy("position").collect()
    assert [r.comment_id for r in reps] == ["d1", "c1", "c1r1"]
    gold = spark.createDataFrame(cooking.UNIT_LABELS, "unit_id STRING, label STRING")
    per_cluster = V.cluster_purity(members, gold)
    quality = V.merge_quality(themes.select("meta_key", "cluster_key"), per_cluster).first()
    assert (quality.purity, quality.incorrect_merges, quality.meta_clusters) == (1.0, 0, 1)
    said = members.join(gold, "unit_id").select("video_id", "label")
    predicted = themes.join(per_cluster, "cluster_key").select(F.col("dominant_label").alias("label"))
    scores = V.recurring_labels(said, predicted).first()
    assert (scores.precision, scores.recall, scores.f1) == (1.0, 1.0, 1.0)


def test_insights_and_reports(members, clusters, comments):
    insights = I.local_insights(clusters)
    assert by(insights.filter("video_id = 'v2'"), "insight_id", "title") == {
        "v2_insight_1": "Criticism of Creator repeats the one hour room temperature advice",
        "v2_insight_2": "Questions about pan",
    }
    assert insights.filter("video_id = 'v1'").count() == 3
    reports = {r.video_id: r for r in I.content_reports(comments, members, clusters).collect()}
    assert (reports["v1"].comment_count, reports["v1"].sentiment) == (6, "negative")
    assert (reports["v2"].comment_count, reports["v2"].sentiment) == (2, "negative")
    assert len(reports["v1"].themes) == 4


def test_ask_index(clusters):
    rows = I.ask_index(clusters).collect()
    values = {}
    for r in rows:
        values.setdefault(r.dimension, set()).add(r.value)
    assert values["stance"] == {"negative", "positive", "question"}
    assert values["intent"] == {"feedback", "information_request"}
    assert values["cluster_type"] == {"opinion", "question"}
    assert values["scope"] == {"single_video", "cross_video"}
    assert "entity.pan" in values["aspect_key"] and len(values["aspect_key"]) == 6


def test_comment_only_mode(spark, comments):
    """Without any context the global anchor stands in and nothing is lost."""
    empty = A.with_anchors(spark.createDataFrame([], A.CONTEXT_SCHEMA))
    rows = N.enrich(comments, empty).collect()
    assert len(rows) == len(cooking.COMMENTS)
    c5 = next(r for r in rows if r.comment_id == "c5")
    assert c5.anchor_refs[0].anchor_id == "v1_global_video"


def test_chain_of_agreement_reaches_the_claim(spark, contexts):
    chain = [("v1", "a0", None, 0, "u", "that part is unsafe", 1, 1, 0, 0)] + [
        ("v1", f"a{i}", f"a{i - 1}", i, "u", "same", 0, 1, 0, 0) for i in range(1, 6)
    ]
    rows = N.enrich(spark.createDataFrame(chain, cooking.COMMENT_SCHEMA), A.with_anchors(contexts)).collect()
    for r in rows:
        assert r.anchor_refs[0].anchor_type == "controversy"
        if r.comment_id != "a0":
            assert r.resolved_text == "I agree with the parent comment about that part is unsafe."
    confidences = [r.grounding_confidence for r in sorted(rows, key=lambda r: r.comment_id)]
    assert confidences == sorted(confidences, reverse=True)


def test_equal_labels_are_compared_once(spark, monkeypatch):
    """Clusters whose labels have the same words are one node; all of them stay in the theme."""
    rows = [(f"k{i}", f"v{i}_k{i}", f"v{i}", "negative", ["battery life", "Life, battery"][i % 2], 0.1 * i, False, False) for i in range(6)]
    rows += [("p", "v0_p", "v0", "positive", "battery life", 0.5, False, False), ("n", "v1_n", "v1", None, "battery life", 0.5, False, False),
             ("o", "v2_o", "v2", None, "battery life", 0.5, False, False), ("e", "v3_e", "v3", "negative", None, 0.5, False, False)]
    clusters = spark.createDataFrame(
        rows, "cluster_key string, local_cluster_id string, video_id string, stance string, aspect_label string, importance double, low_signal boolean, wide boolean"
    )
    seen = []
    linked = I.similar_links
    monkeypatch.setattr(I, "similar_links", lambda nodes, *a: seen.append(nodes.count()) or linked(nodes, *a))
    themes = {(r.meta_key, r.cluster_key) for r in I.meta_members(clusters).collect()}
    assert themes == {("k0", f"k{i}") for i in range(6)}
    assert seen == [2]
