"""Grounding, opinion units, clusters, themes and insights on the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undertone.functions import lexicon as L
from undertone.functions import tokens as TK
from undertone.functions.expressions import cosine, slug
from undertone.operators import anchors as A
from undertone.operators import answers as Q
from undertone.operators import clusters as C
from undertone.operators import enrich as N
from undertone.operators import evaluate as V
from undertone.operators import insights as I
from undertone.operators import research as R
from undertone.operators import themes as T
from undertone.operators import units as U
from undertone.operators.linkage import agglomerate_in_pieces
from undertone.operators.ranking import min_max
from undertone.operators.similarity import in_order, similar_pairs
from undertone.plans.registry import query
from undertone.plans.views import CUES, contexts, feedback, table
from undertone.session import settle


_BUILT: dict[tuple[str, str, str], DataFrame] = {}


def _once(name: str, spark, sf: str, build) -> DataFrame:
    """A gold table, written on first use and read by the later queries of the session."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _BUILT:
        _BUILT[key] = build()
    return _BUILT[key]


def enriched(spark, sf) -> DataFrame:
    def build():
        return settle(N.enrich(feedback(spark, sf), A.with_anchors(contexts(spark, sf))))

    return _once("enriched", spark, sf, build)


def units(spark, sf) -> DataFrame:
    return _once("units", spark, sf, lambda: settle(U.extract_units(enriched(spark, sf))))


def members(spark, sf) -> DataFrame:
    return _once("members", spark, sf, lambda: C.assign_clusters(units(spark, sf)))


def clusters_of(spark, sf) -> DataFrame:
    return _once("clusters", spark, sf, lambda: C.build_clusters(members(spark, sf)))


def themes_of(spark, sf) -> DataFrame:
    return _once("themes", spark, sf, lambda: I.meta_members(clusters_of(spark, sf)))


def joined_array(column: str):
    return F.array_join(F.col(column), ",").alias(column)


# -- parts with an exact SQL twin ---------------------------------------------

def _words_sql(text: str) -> str:
    return rf"list_filter(regexp_split_to_array(lower({text}), '[^\p{{L}}\p{{N}}'']+'), lambda w: length(w) > 0)"


_STOP_SQL = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in L.STOPWORDS) + "]"


def _tokens_sql(text: str) -> str:
    return (
        f"list_distinct(list_filter({_words_sql(text)}, lambda w: length(w) > 1 AND NOT list_contains({_STOP_SQL}, w)))"
    )


@query(
    "content_tokens",
    f"""SELECT doc_id, len({_words_sql('text')}) AS words, len({_tokens_sql('text')}) AS tokens,
      md5(array_to_string(list_sort({_tokens_sql('text')}), ' ')) AS tokens_md5 FROM documents""",
)
def _(spark, sf):
    said = table(spark, sf, "documents").select("doc_id", TK.words(F.col("text")).alias("said"))
    return said.select("doc_id", F.size("said").alias("words"), TK.topic_words("said").alias("t")).select(
        "doc_id", "words", F.size("t").alias("tokens"), F.md5(F.array_join(F.array_sort("t"), " ")).alias("tokens_md5")
    )


@query(
    "text_slugs",
    """SELECT item_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', '_', 'g'), '_') AS slug,
      'controversy.' || trim(regexp_replace(lower(text), '[^a-z0-9]+', '_', 'g'), '_') AS aspect_key,
      substr(trim(regexp_replace(lower(text), '[^a-z0-9]+', '_', 'g'), '_'), 1, 40) AS id_part FROM benchmark""",
)
def _(spark, sf):
    s = slug(F.col("text"))
    return table(spark, sf, "benchmark").select(
        "item_id", s.alias("slug"), F.concat_ws(".", F.lit("controversy"), s).alias("aspect_key"),
        F.substring(s, 1, C.ASPECT_ID_LENGTH).alias("id_part"),
    )


@query(
    "hashed_vectors",
    f"""WITH t AS (SELECT conv_id, turn, unnest({_tokens_sql('text')}) AS tok FROM conversations),
    b AS (SELECT conv_id, turn, CAST('0x' || substr(md5(tok), 1, 8) AS BIGINT) % 64 AS d, count(*) AS n FROM t GROUP BY ALL),
    v AS (SELECT conv_id, turn, count(*) AS buckets, sqrt(sum(n * n)) AS norm, max(n) AS top FROM b GROUP BY ALL)
    SELECT c.conv_id, c.turn, coalesce(buckets, 0) AS buckets, coalesce(round(top / norm, 4), 0) AS largest
    FROM conversations c LEFT JOIN v ON c.conv_id = v.conv_id AND c.turn = v.turn""",
)
def _(spark, sf):
    vector = TK.hash_vector(TK.content_tokens(F.col("text")))
    return (
        table(spark, sf, "conversations").select("conv_id", "turn", vector.alias("v"))
        .select(
            "conv_id", "turn", F.size(F.filter("v", lambda x: x > 0)).alias("buckets"),
            F.round(F.array_max("v").cast("double"), 4).alias("largest"),
        )
    )


@query(
    "embedding_norms_and_cosine",
    """WITH m AS (SELECT vec_id, label, embedding::DOUBLE[64] AS e FROM embeddings),
    first AS (SELECT label, arg_min(e, vec_id) AS f FROM m GROUP BY label)
    SELECT vec_id, round(array_cosine_similarity(e, f), 4) AS similarity FROM m JOIN first USING (label)""",
)
def _(spark, sf):
    e = table(spark, sf, "embeddings")
    first = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("f"))
    return e.join(first, "label").select("vec_id", F.round(cosine(F.col("embedding"), F.col("f")), 4).alias("similarity"))


@query(
    "value_variance",
    """SELECT event_type, round(var_pop(value), 4) AS variance, count(*) AS n FROM events GROUP BY event_type""",
)
def _(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(
        F.round(F.var_pop("value"), 4).alias("variance"), F.count(F.lit(1)).alias("n")
    )


# Clusters by key columns of the test tables: measures, importance and texts.

_MEASURE_SQL = """d AS (SELECT 'v' || (doc_id % 9) AS video_id, lang, source, doc_id, n_chars FROM documents),
  k AS (SELECT d.*, CASE n_chars % 3 WHEN 0 THEN 'positive' WHEN 1 THEN 'negative' ELSE 'question' END AS stance,
        CASE n_chars % 3 WHEN 2 THEN 'question' ELSE 'opinion' END AS cluster_type, 'entity.' || lang AS aspect_key,
        (n_chars % 100) / 10.0 AS engagement_score, doc_id % 4 AS depth, (n_chars % 90) / 100.0 AS grounding,
        (n_chars % 80) / 100.0 AS density FROM d),
  m AS (SELECT video_id, aspect_key, cluster_type, stance, lang, count(*) AS size, count(DISTINCT doc_id % 700) AS comments,
        count(DISTINCT source) AS unique_authors, round(sum(engagement_score), 3) AS total_engagement, avg(depth) AS reply_depth,
        avg(grounding) AS avg_grounding, avg(density) AS avg_density FROM k GROUP BY ALL)"""


def _sample_members(spark, sf) -> DataFrame:
    """Documents as clustered units, the cluster being given by their columns."""
    n = F.col("n_chars")
    stance = F.when(n % 3 == 0, "positive").when(n % 3 == 1, "negative").otherwise("question")
    keyed = table(spark, sf, "documents").select(
        F.concat(F.lit("v"), F.col("doc_id") % 9).alias("video_id"),
        F.concat(F.lit("entity."), F.col("lang")).alias("aspect_key"),
        F.col("lang").alias("aspect_label"),
        F.when(n % 3 == 2, "question").otherwise("opinion").alias("cluster_type"),
        stance.alias("stance"),
        (F.col("doc_id") % 700).alias("comment_id"),
        F.col("doc_id").alias("unit_id"),
        F.col("source").alias("author_id"),
        ((n % 100) / 10).alias("engagement_score"),
        (F.col("doc_id") % 4).alias("depth"),
        ((n % 90) / 100).alias("grounding_confidence"),
        ((n % 80) / 100).alias("semantic_density"),
    )
    return keyed.withColumn("cluster_key", F.concat_ws("|", *C.BUCKET))


def _norm_sql(column: str) -> str:
    return (
        f"CASE WHEN max({column}) OVER w > min({column}) OVER w THEN ({column} - min({column}) OVER w) / "
        f"(max({column}) OVER w - min({column}) OVER w) ELSE 1.0 END"
    )


_IMPORTANCE_SQL = " + ".join(f"{weight} * {_norm_sql(column)}" for column, weight in C.IMPORTANCE_WEIGHTS.items())


def _case_sql(texts: dict[str, str], otherwise: str) -> str:
    return "CASE stance " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in texts.items()) + f" ELSE '{otherwise}' END"


_BUILT_SQL = f"""{_MEASURE_SQL}, i AS (SELECT *, round({_IMPORTANCE_SQL}, 3) AS importance,
    round(size / sum(size) OVER w, 4) AS share FROM m WINDOW w AS (PARTITION BY video_id)),
  c AS (SELECT *, video_id || '_entity_' || lang || '_' || cluster_type || '_' || stance || '_' || size AS local_cluster_id FROM i)"""


@query(
    "cluster_measures",
    f"""WITH {_MEASURE_SQL} SELECT video_id, aspect_key, cluster_type, stance, size, comments, unique_authors,
      round(total_engagement, 2) AS total_engagement, round(reply_depth, 4) AS reply_depth, round(avg_grounding, 4) AS avg_grounding,
      round(avg_density, 4) AS avg_density, round(size / sum(size) OVER (PARTITION BY video_id), 4) AS share FROM m""",
)
def _(spark, sf):
    df = C.cluster_measures(_sample_members(spark, sf))
    return df.select(
        *C.BUCKET, "size", "comments", "unique_authors", F.round("total_engagement", 2).alias("total_engagement"),
        *[F.round(c, 4).alias(c) for c in ("reply_depth", "avg_grounding", "avg_density")], "share",
    )


@query(
    "cluster_importance",
    f"""WITH {_BUILT_SQL} SELECT local_cluster_id, importance,
      {_case_sql(C.LABELS, C.LABELS['other'])} || lang AS label,
      size || ' opinion units ' || {_case_sql(C.VERBS, C.VERBS['other'])} || ' ' || lang || '.' AS summary FROM c""",
)
def _(spark, sf):
    return C.build_clusters(_sample_members(spark, sf)).select("local_cluster_id", "importance", "label", "summary")


@query(
    "cluster_insights",
    f"""WITH {_BUILT_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY importance DESC, local_cluster_id) AS n FROM c)
    SELECT video_id || '_insight_' || n AS insight_id, importance AS importance_score, round(avg_grounding, 3) AS confidence,
      {_case_sql(C.WHY_IT_MATTERS, C.WHY_OTHERWISE)} AS why_it_matters FROM r""",
)
def _(spark, sf):
    return I.local_insights(C.build_clusters(_sample_members(spark, sf))).select(
        "insight_id", "importance_score", "confidence", "why_it_matters"
    )


@query(
    "cluster_ask_index",
    f"""WITH {_BUILT_SQL} SELECT dimension, value, count(*) AS clusters FROM (
      SELECT 'stance' AS dimension, stance AS value FROM c UNION ALL SELECT 'cluster_type', cluster_type FROM c
      UNION ALL SELECT 'intent', CASE cluster_type WHEN 'question' THEN 'information_request' ELSE 'feedback' END FROM c
      UNION ALL SELECT 'aspect_key', aspect_key FROM c UNION ALL SELECT 'scope', 'single_video' FROM c
      UNION ALL SELECT 'scope', 'cross_video' FROM c) GROUP BY ALL""",
)
def _(spark, sf):
    return I.ask_index(C.build_clusters(_sample_members(spark, sf)))


@query(
    "cluster_ask_selected",
    f"""WITH {_BUILT_SQL} SELECT local_cluster_id, size FROM c WHERE stance IN ('negative', 'positive') AND aspect_key = 'entity.fr'""",
)
def _(spark, sf):
    clusters = C.build_clusters(_sample_members(spark, sf))
    return I.ask(clusters, stance=["negative", "positive"], aspect_key=["entity.fr"]).select("local_cluster_id", "size")


@query(
    "cluster_ask_auto",
    f"""WITH {_BUILT_SQL} SELECT aspect_key, stance, count(*) AS clusters, CAST(sum(size) AS BIGINT) AS units,
      count(DISTINCT video_id) AS videos, max(importance) AS importance FROM c GROUP BY ALL""",
)
def _(spark, sf):
    return I.ask_auto(C.build_clusters(_sample_members(spark, sf)))


@query(
    "cluster_tensions",
    f"""WITH {_BUILT_SQL}, t AS (SELECT video_id, aspect_key, CAST(coalesce(sum(size) FILTER (stance = 'positive'), 0) AS BIGINT) AS positive_units,
      CAST(coalesce(sum(size) FILTER (stance = 'negative'), 0) AS BIGINT) AS negative_units FROM c GROUP BY ALL)
    SELECT *, round(least(positive_units, negative_units) / greatest(positive_units, negative_units), 4) AS balance FROM t
    WHERE least(positive_units, negative_units) > 0""",
)
def _(spark, sf):
    df = R.tension_map(C.build_clusters(_sample_members(spark, sf)))
    return df.select("video_id", "aspect_key", "positive_units", "negative_units", "balance")


@query(
    "cluster_stance_profiles",
    f"""WITH {_MEASURE_SQL}, s AS (SELECT video_id, stance, count(*) AS n FROM k GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY n DESC, stance DESC) AS b FROM s)
    SELECT video_id AS cluster_key, max(CASE WHEN b = 1 THEN stance END) AS dominant_stance,
      string_agg(stance || ':' || n, ',' ORDER BY stance) AS counts FROM r GROUP BY video_id""",
)
def _(spark, sf):
    by_video = _sample_members(spark, sf).withColumn("cluster_key", F.col("video_id"))
    entries = F.transform(F.map_entries("stance_counts"), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string")))
    return C.stance_profile(by_video).select("cluster_key", "dominant_stance", F.array_join(entries, ",").alias("counts"))


@query(
    "cluster_sentiments",
    f"""WITH {_MEASURE_SQL}, s AS (SELECT video_id, count(*) FILTER (stance = 'positive') AS positive_units,
      count(*) FILTER (stance = 'negative') AS negative_units FROM k GROUP BY ALL)
    SELECT *, CASE WHEN negative_units > positive_units THEN 'negative' WHEN positive_units > negative_units THEN 'positive'
      WHEN positive_units > 0 THEN 'mixed' ELSE 'neutral' END AS sentiment FROM s""",
)
def _(spark, sf):
    return I.sentiment(_sample_members(spark, sf))


@query(
    "normalized_values",
    """WITH b AS (SELECT event_type, min(value) AS lo, max(value) AS hi FROM events GROUP BY event_type)
    SELECT event_id, round(CASE WHEN hi > lo THEN (value - lo) / (hi - lo) ELSE 1.0 END, 4) AS norm
    FROM events JOIN b USING (event_type)""",
)
def _(spark, sf):
    df = min_max(table(spark, sf, "events").select("event_id", "event_type", "value"), ["event_type"], ["value"])
    return df.select("event_id", F.round("value_norm", 4).alias("norm"))


# -- quality ------------------------------------------------------------------

@query(
    "purity_by_cluster",
    """WITH n AS (SELECT doc_id % 8 AS cluster_key, 'q' || quality AS label, count(*) AS n FROM labels GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY cluster_key ORDER BY n DESC, label DESC) AS b, sum(n) OVER (PARTITION BY cluster_key) AS t FROM n)
    SELECT cluster_key, label AS dominant_label, n AS dominant, CAST(t AS BIGINT) AS labelled, round(n / t, 6) AS purity FROM r WHERE b = 1""",
)
def _(spark, sf):
    return V.cluster_purity(*_labelled(spark, sf))


def _labelled(spark, sf):
    assigned = table(spark, sf, "documents").select(F.col("doc_id").alias("unit_id"), (F.col("doc_id") % 8).alias("cluster_key"))
    gold = table(spark, sf, "labels").select(F.col("doc_id").alias("unit_id"), F.concat(F.lit("q"), "quality").alias("label"))
    return assigned, gold


@query(
    "purity_weighted",
    """WITH n AS (SELECT doc_id % 8 AS c, quality, count(*) AS n FROM labels GROUP BY ALL),
    m AS (SELECT c, max(n) AS d, sum(n) AS t FROM n GROUP BY c)
    SELECT CAST(sum(d) AS BIGINT) AS dominant, CAST(sum(t) AS BIGINT) AS labelled, round(sum(d) / sum(t), 6) AS purity FROM m""",
)
def _(spark, sf):
    return V.weighted_purity(V.cluster_purity(*_labelled(spark, sf)))


@query(
    "merge_quality",
    """WITH n AS (SELECT doc_id % 8 AS c, 'q' || quality AS label, count(*) AS n FROM labels GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY n DESC, label DESC) AS b FROM n),
    g AS (SELECT c % 3 AS m, label, count(*) AS n FROM r WHERE b = 1 GROUP BY ALL),
    t AS (SELECT m, max(n) AS d, sum(n) AS l FROM g GROUP BY m)
    SELECT round(sum(d) / sum(l), 6) AS purity, CAST(sum(l - d) AS BIGINT) AS incorrect_merges, count(*) AS meta_clusters FROM t""",
)
def _(spark, sf):
    per_cluster = V.cluster_purity(*_labelled(spark, sf))
    metas = per_cluster.select("cluster_key", (F.col("cluster_key") % 3).alias("meta_key"))
    return V.merge_quality(metas, per_cluster)


@query(
    "recurring_label_scores",
    """WITH g AS (SELECT label FROM (SELECT quality * 2 + toxic AS label, doc_id % 50 AS v FROM labels) GROUP BY label HAVING count(DISTINCT v) > 1),
    p AS (SELECT DISTINCT quality * 3 AS label FROM labels),
    s AS (SELECT count(*) FILTER (g.label IS NOT NULL AND p.label IS NOT NULL) AS hit, count(g.label) AS ng, count(p.label) AS np
          FROM g FULL JOIN p ON g.label = p.label)
    SELECT round(hit / np, 6) AS precision, round(hit / ng, 6) AS recall,
      round(CASE WHEN hit = 0 THEN 0.0 ELSE 2 * (hit / np) * (hit / ng) / (hit / np + hit / ng) END, 6) AS f1 FROM s""",
)
def _(spark, sf):
    labels = table(spark, sf, "labels")
    gold = labels.select((F.col("doc_id") % 50).alias("video_id"), (F.col("quality") * 2 + F.col("toxic")).alias("label"))
    return V.recurring_labels(gold, labels.select((F.col("quality") * 3).alias("label")))


@query(
    "grounding_accuracy",
    """SELECT count(*) FILTER (contains(text, lang) AND contains(text, 'th')) AS passed, count(*) AS total,
      round(avg(CASE WHEN contains(text, lang) AND contains(text, 'th') THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM documents""",
)
def _(spark, sf):
    d = table(spark, sf, "documents")
    predicted = d.select(F.col("doc_id").alias("comment_id"), F.col("text").alias("anchor_id"))
    expected = d.select(F.col("doc_id").alias("comment_id"), F.array(F.col("lang"), F.lit("th")).alias("fragments"))
    return V.grounding_accuracy(predicted, expected)


@query(
    "embedding_silhouette",
    """WITH m AS (SELECT vec_id, label, embedding::DOUBLE[64] AS e FROM embeddings),
    p AS (SELECT a.vec_id, a.label AS own, b.label, sum(1 - array_cosine_similarity(a.e, b.e)) AS s, count(*) AS n
          FROM m a JOIN m b ON a.vec_id <> b.vec_id GROUP BY ALL),
    x AS (SELECT vec_id, max(CASE WHEN own = label THEN s / n END) AS a, min(CASE WHEN own <> label THEN s / n END) AS b FROM p GROUP BY vec_id)
    SELECT round(avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 3) AS silhouette FROM x""",
)
def _(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("label").alias("cluster"), F.col("embedding").alias("vector"))
    return spark.createDataFrame([(round(V.silhouette(e), 3),)], "silhouette DOUBLE")


# -- answers ------------------------------------------------------------------

def _rounds_sql(count: int, rounds: int) -> str:
    """The rounds of fixed-count clustering, one after the other."""
    parts = [
        "e AS (SELECT vec_id AS item, embedding::DOUBLE[] AS v FROM embeddings)",
        "u AS (SELECT item, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS unit FROM e)",
        f"c0 AS (SELECT row_number() OVER (ORDER BY item) - 1 AS c, unit AS m FROM u QUALIFY c < {count})",
    ]
    for r in range(rounds + 1):
        parts.append(
            f"a{r} AS (SELECT item, any_value(unit) AS unit, arg_max(c, (list_cosine_similarity(unit, m), -c)) AS c FROM u, c{r} GROUP BY item)"
        )
        parts.append(
            f"m{r} AS (SELECT c, list(x ORDER BY pos) AS m FROM (SELECT c, pos, avg(x) AS x FROM "
            f"(SELECT c, unnest(unit) AS x, generate_subscripts(unit, 1) AS pos FROM a{r}) GROUP BY c, pos) GROUP BY c)"
        )
        parts.append(f"c{r + 1} AS (SELECT c{r}.c, coalesce(m{r}.m, c{r}.m) AS m FROM c{r} LEFT JOIN m{r} USING (c))")
    return f"WITH {', '.join(parts)} SELECT item, CAST(c AS INT) AS cluster FROM a{rounds}"


@query("fixed_count_clusters", _rounds_sql(10, Q.CLUSTER_ROUNDS))
def _(spark, sf):
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("item"), F.col("embedding").alias("vector"))
    return Q.fixed_count_clusters(vectors, 10)


@query(
    "aspect_stance_shares",
    f"""WITH {_MEASURE_SQL}, n AS (SELECT video_id, aspect_key, stance, count(*) AS n FROM k GROUP BY ALL),
    s AS (SELECT *, round(n / sum(n) OVER (PARTITION BY video_id, aspect_key), 4) AS share FROM n)
    SELECT video_id, aspect_key, arg_max(stance, (n, stance)) AS dominant_stance, string_agg(stance || ':' || share, ',' ORDER BY stance) AS shares
    FROM s GROUP BY ALL""",
)
def _(spark, sf):
    df = C.stance_shares(_sample_members(spark, sf))
    entries = F.transform(F.map_entries("stance_shares"), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string")))
    return df.select("video_id", "aspect_key", "dominant_stance", F.array_join(entries, ",").alias("shares"))


# -- text rules with an exact SQL twin ----------------------------------------

def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list_sql(names: list[str]) -> str:
    return "[" + ", ".join(_quote(n) for n in names) + "]"


_CUE_SQL = _list_sql(CUES)
FEEDBACK_SQL = f"""feedback AS (SELECT CAST(conv_id AS VARCHAR) AS video_id, conv_id || '-' || turn AS comment_id,
  CASE WHEN length(text) % 11 = 0 THEN 'same' ELSE text || ({_CUE_SQL})[length(text) % {len(CUES)} + 1] END AS text,
  length(text) % 31 AS likes, length(text) % 3 AS reply_count, role || '_' || (conv_id % 211) AS author_id
  FROM conversations WHERE turn > 0)"""


def _has(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, {_quote(pattern)})"


def _noise_sql(text: str, said: str) -> dict[str, str]:
    count = f"len({said})"
    return {
        "emoji_only": f"(length(trim({text})) > 0 AND {count} = 0)",
        "ultra_short": f"({count} <= 2 AND NOT (length(trim({text})) > 0 AND {count} = 0))",
        "reaction_only": f"({count} > 0 AND len(list_filter({said}, lambda w: NOT list_contains({_list_sql(L.REACTION_WORDS)}, w))) = 0)",
        "spam": _has(text, L.SPAM_CUES),
    }


_INTENT_SQL = f"""CASE WHEN {_has('text', L.SPAM_CUES)} THEN 'spam' WHEN {_has('text', L.LAUGHTER)} THEN 'joke'
  WHEN {_noise_sql('text', 'said')['reaction_only']} THEN CASE WHEN {_has('text', L.AGREEMENT)} THEN 'agreement' ELSE 'reaction' END
  WHEN ends_with(rtrim(text), '?') OR {_has('text', L.QUESTION_START)} THEN 'question'
  WHEN {_has('text', L.DISAGREEMENT)} THEN 'disagreement' WHEN {_has('text', L.AGREEMENT)} THEN 'agreement'
  WHEN {_has('text', L.CORRECTION)} THEN 'correction' WHEN {_has('text', L.ADVICE)} THEN 'advice'
  WHEN {_has('text', L.CRITICISM_CUES)} THEN 'criticism' WHEN {_has('text', L.PRAISE_CUES)} THEN 'praise'
  WHEN {_has('text', L.META)} THEN 'meta' ELSE 'other' END"""


@query(
    "comment_intents",
    f"""WITH {FEEDBACK_SQL}, w AS (SELECT *, {_words_sql('text')} AS said FROM feedback)
    SELECT comment_id, {_INTENT_SQL} AS intent FROM w""",
)
def _(spark, sf):
    said = feedback(spark, sf).withColumn("said", TK.words(F.col("text")))
    return said.select("comment_id", N.comment_intent("said").alias("intent"))


# DuckDB has no look-around, so cuts are marked first and split after.
_PIECES_SQL = r"""list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(text,
  '([.!?])\s+', '\1' || chr(1), 'g'), '\n+', chr(1), 'g'), '\s+((?i:but|however|although|though)\b)', chr(1) || '\1', 'g'), chr(1)),
  lambda x: trim(x)), lambda x: length(x) > 0)"""


def _count_sql(said: str, names: list[str]) -> str:
    return f"len(list_filter({said}, lambda w: list_contains({_list_sql(names)}, w)))"


_SPAN_SQL = f"""{FEEDBACK_SQL}, cut AS (SELECT comment_id, {_PIECES_SQL} AS p FROM feedback),
  opened AS (SELECT *, {_words_sql('p[1]')} AS opening FROM cut),
  kept AS (SELECT comment_id, CASE WHEN len(p) > 1 AND len(opening) <= 3 AND {_count_sql('opening', L.POSITIVE_WORDS)} > 0
      AND NOT ends_with(p[1], '?') THEN p[2:] ELSE p END AS p FROM opened),
  spans AS (SELECT comment_id, p AS s FROM kept),
  each AS (SELECT comment_id, unnest(s) AS span, generate_subscripts(s, 1) - 1 AS piece FROM spans),
  worded AS (SELECT *, {_words_sql('span')} AS said, {_tokens_sql('span')} AS tokens FROM each),
  felt AS (SELECT *, {_count_sql('said', L.POSITIVE_WORDS)} > 0 AND NOT {_has('span', L.NEGATIVE_PHRASES)} AS good,
      {_count_sql('said', L.NEGATIVE_WORDS)} > 0 OR {_has('span', L.NEGATIVE_PHRASES)} AS bad FROM worded)"""
_STANCE_SQL = f"""CASE WHEN {_has('span', L.LAUGHTER)} OR ({_has('span', L.LAUGHTER_INSIDE)} AND NOT good AND NOT bad) THEN 'humor'
  WHEN ends_with(rtrim(span), '?') THEN 'question' WHEN good AND bad THEN 'mixed' WHEN good THEN 'positive' WHEN bad THEN 'negative'
  WHEN {_has('span', L.REQUEST)} THEN 'request' WHEN len(tokens) >= 3 THEN 'observation' ELSE 'other' END"""
_FLAGS_SQL = "concat_ws(',', " + ", ".join(
    f"CASE WHEN {test} THEN '{name}' END" for name, test in _noise_sql("span", "said").items()
) + ")"


@query(
    "comment_spans",
    f"""WITH {_SPAN_SQL}, f AS (SELECT *, {_STANCE_SQL} AS stance, {_FLAGS_SQL} AS noise_flags FROM felt)
    SELECT comment_id, piece, md5(span) AS span_md5, stance, noise_flags,
      round(CASE WHEN noise_flags <> '' THEN least(0.95, 0.15 + 0.1 * len(tokens)) / 2 ELSE least(0.95, 0.15 + 0.1 * len(tokens)) END, 3) AS density,
      CASE WHEN contains(noise_flags, 'spam') THEN 'spam'
        WHEN contains(noise_flags, 'emoji_only') OR contains(noise_flags, 'reaction_only') THEN 'reaction_only'
        WHEN stance = 'humor' THEN 'humor' WHEN stance IN ('question', 'request') THEN 'question'
        WHEN contains(noise_flags, 'ultra_short') AND stance IN ('other', 'observation') THEN 'mixed_noise' ELSE 'opinion' END AS cluster_type
    FROM f""",
)
def _(spark, sf):
    df = U.read_spans(U.split_spans(feedback(spark, sf).select("comment_id", "text"), "text"))
    return df.select(
        "comment_id", "piece", F.md5("span").alias("span_md5"), "stance", joined_array("noise_flags"),
        U.semantic_density(F.col("tokens"), F.col("noise_flags")).alias("density"),
        U.cluster_type(F.col("stance"), F.col("noise_flags")).alias("cluster_type"),
    )


def _slug_sql(text: str) -> str:
    return f"trim(regexp_replace(lower({text}), '[^a-z0-9]+', '_', 'g'), '_')"


def _at_sql(number: str) -> str:
    return f"'0:' || lpad(CAST({number} AS VARCHAR), 2, '0')"


_CONTEXT_SQL = r"""cut AS (SELECT CAST(conv_id AS VARCHAR) AS v, text, role, list_filter(list_transform(string_split(regexp_replace(
      regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), '\n+', chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: length(x) > 0) AS s
    FROM conversations WHERE turn = 0),
  parts AS (SELECT v, role, s, list_filter(s, lambda x, i: (i - 1) % 2 = 1) AS moments, list_filter(s, lambda x, i: (i - 1) % 3 = 0) AS steps,
      list_filter(list_transform(s, lambda x: regexp_extract(x, '([\p{L}]+)', 1)), lambda x: length(x) > 2) AS names,
      list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)),
                  lambda x: length(x) >= 12 AND len(regexp_split_to_array(x, '\s+')) >= 3) AS lines,
      list_filter(list_filter(s, lambda x, i: (i - 1) % 4 = 2), lambda x: length(trim(x)) >= 3) AS shown FROM cut)"""
_ANCHOR_SQL = f"""WITH {_CONTEXT_SQL}, a AS (
  SELECT v AS video_id, v || '_global_video' AS anchor_id, 'global_video' AS anchor_type, 'summary' AS source_field,
    coalesce(nullif(s[1], ''), 'Video-wide discussion') AS label, NULL AS starts_at, NULL AS ends_at FROM parts
  UNION ALL SELECT v, v || '_moment_0_00_' || {_slug_sql('s[2]')}, 'controversy', 'controversialMoments', s[2], '0:00', NULL FROM parts WHERE len(s) > 1
  UNION ALL SELECT v, v || '_moment_' || {_slug_sql('t')} || '_' || {_slug_sql('d')}, 'moment', 'keyMoments', d, t, NULL FROM (
    SELECT v, unnest(moments) AS d, {_at_sql('(generate_subscripts(moments, 1) - 1) * 10')} AS t, s FROM parts) WHERE NOT (t = '0:00' AND d = s[2])
  UNION ALL SELECT v, v || '_timeline_' || {_slug_sql('t')} || '_' || {_slug_sql('d')}, 'timeline_segment', 'timeline', d, t, e FROM (
    SELECT v, unnest(steps) AS d, {_at_sql('(generate_subscripts(steps, 1) - 1) * 20')} AS t, {_at_sql('generate_subscripts(steps, 1) * 20')} AS e FROM parts)
  UNION ALL SELECT v, v || '_person_' || {_slug_sql('role')}, 'entity', 'keyEntities', role, NULL, NULL FROM parts
  UNION ALL SELECT v, v || '_object_' || {_slug_sql('n')}, 'entity', 'keyEntities', n, NULL, NULL FROM (SELECT v, unnest(list_distinct(names)) AS n FROM parts)
  UNION ALL SELECT v, v || '_quote_' || i || '_' || {_slug_sql('d')}, 'spoken_quote', 'transcript', d, NULL, NULL FROM (
    SELECT v, unnest(lines) AS d, generate_subscripts(lines, 1) - 1 AS i FROM parts)
  UNION ALL SELECT v, v || '_visual_' || i || '_' || {_slug_sql('d')}, 'visual_text', 'visualText', d, NULL, NULL FROM (
    SELECT v, unnest(shown) AS d, generate_subscripts(shown, 1) - 1 AS i FROM parts)
  UNION ALL SELECT v, v || '_cta_0_' || {_slug_sql('d')}, 'cta', 'callsToAction', d, NULL, NULL FROM (
    SELECT v, 'Ask about ' || coalesce(names[1], 'it') AS d FROM parts))
  SELECT * FROM a"""


@query("anchors_built", _ANCHOR_SQL)
def _(spark, sf):
    return A.anchors_table(contexts(spark, sf)).drop("tokens", "plain", "ordinal")


# -- grounding ----------------------------------------------------------------

_KINDS = list(N.TYPE_WEIGHTS)


def _kind_sql(index: int) -> str:
    cases = " ".join(f"WHEN '{k}' THEN {w[index]}::DOUBLE" for k, w in N.TYPE_WEIGHTS.items())
    return f"CASE anchor_type {cases} END"


def _spaced_sql(said: str) -> str:
    return f"' ' || array_to_string({said}, ' ') || ' '"


# Place of the anchor kinds in a content's list, and of an anchor within its kind.
_PLACED_SQL = f"""anchors AS (
  SELECT v, 0 AS g, 0 AS i, v || '_global_video' AS anchor_id, 'global_video' AS anchor_type, coalesce(nullif(s[1], ''), 'Video-wide discussion') AS label FROM parts
  UNION ALL SELECT v, 1, 0, v || '_moment_0_00_' || {_slug_sql('s[2]')}, 'controversy', s[2] FROM parts WHERE len(s) > 1
  UNION ALL SELECT v, 2, i, v || '_moment_' || {_slug_sql('t')} || '_' || {_slug_sql('d')}, 'moment', d FROM (
    SELECT v, unnest(moments) AS d, generate_subscripts(moments, 1) AS i, {_at_sql('(generate_subscripts(moments, 1) - 1) * 10')} AS t, s FROM parts) WHERE NOT (t = '0:00' AND d = s[2])
  UNION ALL SELECT v, 3, i, v || '_timeline_' || {_slug_sql('t')} || '_' || {_slug_sql('d')}, 'timeline_segment', d FROM (
    SELECT v, unnest(steps) AS d, generate_subscripts(steps, 1) AS i, {_at_sql('(generate_subscripts(steps, 1) - 1) * 20')} AS t FROM parts)
  UNION ALL SELECT v, 4, 0, v || '_person_' || {_slug_sql('role')}, 'entity', role FROM parts
  UNION ALL SELECT v, 5, list_position(names, n), v || '_object_' || {_slug_sql('n')}, 'entity', n FROM (SELECT v, names, unnest(list_distinct(names)) AS n FROM parts)
  UNION ALL SELECT v, 6, i, v || '_quote_' || (i - 1) || '_' || {_slug_sql('d')}, 'spoken_quote', d FROM (
    SELECT v, unnest(lines) AS d, generate_subscripts(lines, 1) AS i FROM parts)
  UNION ALL SELECT v, 7, i, v || '_visual_' || (i - 1) || '_' || {_slug_sql('d')}, 'visual_text', d FROM (
    SELECT v, unnest(shown) AS d, generate_subscripts(shown, 1) AS i FROM parts)
  UNION ALL SELECT v, 8, 0, v || '_cta_0_' || {_slug_sql('d')}, 'cta', d FROM (SELECT v, 'Ask about ' || coalesce(names[1], 'it') AS d FROM parts))"""

_GROUND_SQL = f"""{FEEDBACK_SQL}, {_CONTEXT_SQL}, {_PLACED_SQL},
  told AS (SELECT f.*, {_words_sql('f.text')} AS said, {_tokens_sql('f.text')} AS tokens,
      CASE WHEN turn > 2 THEN conv_id || '-' || ((turn - 1) // 2) END AS parent, length(bin(turn + 1)) - 2 AS depth
    FROM feedback f JOIN (SELECT conv_id, turn, conv_id || '-' || turn AS comment_id FROM conversations) USING (comment_id)),
  meant AS (SELECT *, {_INTENT_SQL} AS intent, {_spaced_sql('said')} AS plain, {_has('text', L.VAGUE_REFERENCE)} AS vague FROM told),
  named AS (SELECT *, {_tokens_sql('label')} AS a_tokens, {_spaced_sql(_words_sql('label'))} AS a_plain FROM anchors),
  pairs AS (SELECT m.comment_id, n.*, m.vague, m.plain, len(m.tokens) AS nc, len(a_tokens) AS na,
      len(list_intersect(m.tokens, a_tokens)) AS shared FROM meant m JOIN named n ON m.video_id = n.v),
  based AS (SELECT *, least(0.98::DOUBLE, (coalesce({N.ANCHOR_SHARE}::DOUBLE * shared / nullif(na, 0), 0) + coalesce({N.COMMENT_SHARE}::DOUBLE * shared / nullif(nc, 0), 0)
      + CASE WHEN na >= 2 AND contains(plain, a_plain) THEN {N.CONTAINED_BONUS}::DOUBLE ELSE 0::DOUBLE END) * {_kind_sql(0)}) AS base FROM pairs),
  scored AS (SELECT *, round(greatest(base, CASE WHEN vague AND anchor_type IN ('controversy', 'moment') THEN {N.VAGUE_SCORE}::DOUBLE ELSE 0::DOUBLE END), 3) AS confidence FROM based),
  ranked AS (SELECT comment_id, anchor_id, anchor_type, label, confidence, row_number() OVER (PARTITION BY comment_id ORDER BY -(confidence + {_kind_sql(1)}), g, i) AS r
    FROM scored WHERE confidence >= {N.MIN_SCORE}),
  own AS (SELECT comment_id, max(CASE WHEN r = 1 THEN anchor_id END) AS anchor_id, max(CASE WHEN r = 1 THEN confidence END) AS confidence,
      max(CASE WHEN r = 1 THEN anchor_type END) AS kind, max(CASE WHEN r = 1 THEN label END) AS label, count(*) AS refs FROM ranked GROUP BY comment_id),
  grounded AS (SELECT m.*, CASE WHEN refs IS NOT NULL THEN own.anchor_id WHEN general THEN video_id || '_global_video' END AS anchor_id,
      CASE WHEN refs IS NOT NULL THEN confidence WHEN general THEN {N.GENERIC_SCORE}::DOUBLE END AS confidence,
      CASE WHEN refs IS NOT NULL THEN kind WHEN general THEN 'global_video' END AS kind,
      CASE WHEN refs IS NOT NULL THEN own.label WHEN general THEN overall.label END AS label,
      CASE WHEN refs IS NOT NULL THEN refs WHEN general THEN 1 ELSE 0 END AS refs
    FROM (SELECT *, {_has('text', L.CONTENT_NOUNS)} AND intent IN ('praise', 'criticism') AS general FROM meant) m LEFT JOIN own USING (comment_id)
    LEFT JOIN (SELECT v, label FROM anchors WHERE g = 0) overall ON overall.v = m.video_id)"""


@query("comments_grounded", f"WITH {_GROUND_SQL} SELECT comment_id, anchor_id AS primary_anchor, confidence, refs AS anchors FROM grounded")
def _(spark, sf):
    df = N.ground(feedback(spark, sf), A.with_anchors(contexts(spark, sf)))
    primary = F.get("anchor_refs", F.lit(0))
    return df.select(
        "comment_id", primary["anchor_id"].alias("primary_anchor"), primary["confidence"].alias("confidence"),
        F.size("anchor_refs").alias("anchors"),
    )


_ENRICHED_SQL = f"""{_GROUND_SQL},
  leaning AS (SELECT comment_id, parent FROM grounded WHERE parent IS NOT NULL AND (refs = 0 OR (intent = 'agreement' AND len(tokens) <= 2))),
  walk AS (SELECT comment_id, parent AS target, 1 AS hops FROM leaning
    UNION ALL SELECT w.comment_id, l.parent, w.hops + 1 FROM walk w JOIN leaning l ON w.target = l.comment_id),
  ends AS (SELECT comment_id, arg_max(target, hops) AS target, max(hops) AS hops FROM walk GROUP BY comment_id),
  known AS (SELECT g.*, e.hops, s.comment_id IS NOT NULL AS inherits, s.text AS s_text, s.anchor_id AS s_anchor, s.confidence AS s_confidence, s.refs AS s_refs,
      s.kind AS s_kind, s.label AS s_label
    FROM grounded g LEFT JOIN ends e USING (comment_id) LEFT JOIN grounded s ON e.target = s.comment_id),
  final AS (SELECT *, CASE WHEN inherits AND s_refs > 0 THEN s_anchor ELSE anchor_id END AS p,
      CASE WHEN inherits AND s_refs > 0 THEN s_kind ELSE kind END AS p_kind,
      CASE WHEN inherits AND s_refs > 0 THEN s_label ELSE label END AS p_label,
      CASE WHEN inherits AND s_refs > 0 THEN s_refs ELSE refs END AS n,
      coalesce(CASE WHEN inherits AND s_refs > 0 THEN round(s_confidence * pow({N.INHERITED_SHARE}::DOUBLE, hops), 3) ELSE confidence END, {N.UNGROUNDED}::DOUBLE) AS c,
      inherits AND intent = 'agreement' AS agrees FROM known),
  sured AS (SELECT *, c >= {N.REWRITE_FROM} AND p IS NOT NULL AS sure FROM final)"""
_AMBIGUITY_SQL = f"""concat_ws(',',
  CASE WHEN {_has('text', L.BARE_PRONOUN)} AND p IS NOT NULL AND NOT agrees AND c <= 0.4 THEN 'unclear_pronoun' END,
  CASE WHEN {_has('text', L.VAGUE_TIME)} AND c < {N.REWRITE_FROM} THEN 'unclear_time_reference' END,
  CASE WHEN {_has('text', L.PERSON_PRONOUN)} AND depth > 0 AND NOT inherits AND c < {N.REWRITE_FROM} THEN 'reply_target_ambiguous' END,
  CASE WHEN p IS NULL THEN 'video_anchor_not_found' END, CASE WHEN c <= 0.4 THEN 'multi_interpretation_possible' END)"""


@query(
    "comments_enriched",
    f"""WITH RECURSIVE {_ENRICHED_SQL} SELECT video_id, comment_id, intent AS comment_intent, p AS primary_anchor, n AS anchors,
      c AS grounding_confidence, inherits, agrees OR sure AS rewrite_applied, {_AMBIGUITY_SQL} AS ambiguity_flags,
      CASE WHEN parent IS NULL THEN 'video' WHEN inherits THEN 'parent_comment' WHEN n > 0 THEN 'video' WHEN depth > 1 THEN 'thread' ELSE 'unclear' END AS target_type,
      CASE WHEN agrees THEN md5('I agree with the parent comment about ' || regexp_replace(s_text, '[.\\s]+$', '') || '.')
           WHEN NOT sure THEN md5(text) END AS resolved_md5,
      '{L.RULES_VERSION}' AS enrichment_model, 'none' AS prompt_version, '1.0.0' AS schema_version FROM sured""",
)
def _(spark, sf):
    df = enriched(spark, sf)
    primary = F.get("anchor_refs", F.lit(0))
    sure_only = F.col("rewrite_applied") & ~(F.col("inherits") & (F.col("comment_intent") == "agreement"))
    return N.with_provenance(
        df.select(
            "video_id", "comment_id", "target_type", "comment_intent", "rewrite_applied", "inherits",
            primary["anchor_id"].alias("primary_anchor"), F.size("anchor_refs").alias("anchors"),
            "grounding_confidence", joined_array("ambiguity_flags"),
            F.when(~sure_only, F.md5("resolved_text")).alias("resolved_md5"),
        )
    )


# -- units --------------------------------------------------------------------

_UNITS_SQL = f"""{_ENRICHED_SQL},
  spoke AS (SELECT *, CASE WHEN agrees THEN 'I agree with the parent comment about ' || regexp_replace(s_text, '[.\\s]+$', '') || '.'
      ELSE text END AS spoken FROM (SELECT * RENAME (said AS t_said, tokens AS t_tokens, plain AS t_plain) FROM sured)),
  heard AS (SELECT *, {_words_sql('spoken')} AS said FROM spoke WHERE length(trim(spoken)) > 0),
  loud AS (SELECT * EXCLUDE (said) FROM heard WHERE NOT ({_noise_sql('spoken', 'said')['reaction_only']} AND {_noise_sql('spoken', 'said')['ultra_short']})),
  cut_up AS (SELECT *, {_PIECES_SQL.replace('regexp_replace(text,', 'regexp_replace(spoken,')} AS pp FROM loud),
  opened AS (SELECT *, {_words_sql('pp[1]')} AS opening FROM cut_up),
  kept AS (SELECT *, CASE WHEN len(pp) > 1 AND len(opening) <= 3 AND {_count_sql('opening', L.POSITIVE_WORDS)} > 0
      AND NOT ends_with(pp[1], '?') THEN pp[2:] ELSE pp END AS q FROM opened),
  spans AS (SELECT *, CASE WHEN agrees THEN [spoken] ELSE q END AS sp FROM kept),
  each AS (SELECT * EXCLUDE (sp, q, pp, opening), unnest(sp) AS span, generate_subscripts(sp, 1) AS piece FROM spans),
  worded AS (SELECT *, {_words_sql('span')} AS said, {_tokens_sql('span')} AS tokens FROM each),
  felt AS (SELECT *, {_count_sql('said', L.POSITIVE_WORDS)} > 0 AND NOT {_has('span', L.NEGATIVE_PHRASES)} AS good,
      {_count_sql('said', L.NEGATIVE_WORDS)} > 0 OR {_has('span', L.NEGATIVE_PHRASES)} AS bad FROM worded),
  stanced AS (SELECT *, {_STANCE_SQL} AS stance, {_FLAGS_SQL} AS noise_flags FROM felt),
  units AS (SELECT video_id, comment_id, comment_id || '_unit_' || piece AS unit_id, author_id, span, tokens, depth,
    coalesce(p_label, 'Video-wide discussion') AS aspect_label,
    CASE WHEN p IS NULL THEN '{U.WIDE_ASPECT}' ELSE concat_ws('.', p_kind, nullif({_slug_sql('p_label')}, '')) END AS aspect_key, stance,
    CASE WHEN stance IN ('question', 'request') THEN 'information_request' WHEN intent = 'joke' OR stance = 'humor' THEN 'joke'
      WHEN intent = 'agreement' THEN 'agreement' WHEN intent IN ('correction', 'disagreement') THEN 'disagreement' WHEN intent = 'advice' THEN 'advice'
      WHEN {_has('span', L.CONFUSION)} THEN 'confusion' WHEN stance IN ('positive', 'negative', 'mixed') THEN 'feedback' ELSE 'other' END AS intent,
    CASE WHEN inherits THEN 'parent_comment' WHEN depth > 0 THEN 'thread_context' ELSE 'video' END AS evidence_source,
    CASE WHEN contains(noise_flags, 'spam') THEN 'spam'
      WHEN contains(noise_flags, 'emoji_only') OR contains(noise_flags, 'reaction_only') THEN 'reaction_only'
      WHEN stance = 'humor' THEN 'humor' WHEN stance IN ('question', 'request') THEN 'question'
      WHEN contains(noise_flags, 'ultra_short') AND stance IN ('other', 'observation') THEN 'mixed_noise' ELSE 'opinion' END AS cluster_type,
    c AS grounding_confidence, noise_flags,
    round(CASE WHEN noise_flags <> '' THEN least(0.95, 0.15 + 0.1 * len(tokens)) / 2 ELSE least(0.95, 0.15 + 0.1 * len(tokens)) END, 3) AS semantic_density,
    round(ln(1 + likes) + 1.5 * ln(1 + reply_count), 3) AS engagement_score FROM stanced)"""


@query(
    "opinion_units",
    f"""WITH RECURSIVE {_UNITS_SQL} SELECT video_id, comment_id, unit_id, aspect_key, stance, intent, evidence_source, cluster_type,
      grounding_confidence, semantic_density, noise_flags, md5(span) AS span_md5, engagement_score FROM units""",
)
def _(spark, sf):
    return units(spark, sf).select(
        "video_id", "comment_id", "unit_id", "aspect_key", "stance", "intent", "evidence_source", "cluster_type",
        "grounding_confidence", "semantic_density", joined_array("noise_flags"), F.md5("span").alias("span_md5"),
        "engagement_score",
    )


@query(
    "aspect_buckets",
    f"""WITH RECURSIVE {_UNITS_SQL} SELECT video_id, aspect_key, count(*) AS units, count(DISTINCT author_id) AS authors,
      round(sum(engagement_score), 3) AS engagement FROM units GROUP BY ALL""",
)
def _(spark, sf):
    return U.aspect_buckets(units(spark, sf))


@query(
    "sentiment_by_content",
    f"""WITH RECURSIVE {_UNITS_SQL}, n AS (SELECT video_id, count(*) FILTER (stance = 'positive') AS positive_units,
      count(*) FILTER (stance = 'negative') AS negative_units FROM units GROUP BY video_id)
    SELECT *, CASE WHEN negative_units > positive_units THEN 'negative' WHEN positive_units > negative_units THEN 'positive'
      WHEN positive_units > 0 THEN 'mixed' ELSE 'neutral' END AS sentiment FROM n""",
)
def _(spark, sf):
    return I.sentiment(units(spark, sf))


_CATEGORY_SQL = f"""{_UNITS_SQL}, categorized AS (""" + " UNION ALL ".join(
    f"SELECT '{name}' AS category, * FROM units WHERE {_has('span', cue)}" for name, cue in L.CATEGORIES.items()
) + ")"


@query(
    "category_insights",
    f"""WITH RECURSIVE {_CATEGORY_SQL} SELECT category, count(*) AS units, count(DISTINCT comment_id) AS comments,
      count(DISTINCT author_id) AS authors, round(sum(engagement_score), 3) AS engagement, round(avg(grounding_confidence), 4) AS confidence
    FROM categorized GROUP BY category""",
)
def _(spark, sf):
    return R.category_insights(units(spark, sf))


@query(
    "category_quotes",
    f"""WITH RECURSIVE {_CATEGORY_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY engagement_score DESC, unit_id) AS rank
      FROM categorized WHERE category IN ('praise', 'feature_requests'))
    SELECT category, rank, unit_id, md5(span) AS quote_md5, engagement_score FROM r WHERE rank <= 3""",
)
def _(spark, sf):
    df = R.category_quotes(units(spark, sf), ["praise", "feature_requests"])
    return df.select("category", "rank", "unit_id", F.md5("quote").alias("quote_md5"), "engagement_score")


# -- clusters -----------------------------------------------------------------

def _linked_sql(nodes: str, scope: list[str], link_from: float, tag: str) -> str:
    """Components of all similar pairs of a scope of a CTE ``nodes`` (scope, node, tokens)."""
    same = " AND ".join(f"a.{c} = b.{c}" for c in scope)
    return f"""{tag}_shared AS (SELECT a.node AS x, b.node AS y, len(a.tokens) AS na, len(b.tokens) AS nb, len(list_intersect(a.tokens, b.tokens)) AS n
      FROM {nodes} a JOIN {nodes} b ON {same} AND a.node < b.node WHERE len(a.tokens) > 0 AND len(b.tokens) > 0),
  {tag}_links AS (SELECT x, y FROM {tag}_shared WHERE (n / sqrt(na * nb) + n / (na + nb - n)) / 2 >= {link_from}::DOUBLE),
  {tag}_both AS (SELECT x, y FROM {tag}_links UNION SELECT y, x FROM {tag}_links),
  {tag}_reach AS (SELECT x, y FROM {tag}_both UNION SELECT r.x, b.y FROM {tag}_reach r JOIN {tag}_both b ON r.y = b.x),
  {tag}_parts AS (SELECT x AS node, least(x, min(y)) AS component FROM {tag}_reach GROUP BY x)"""


_WHOLE_SQL = f"list_contains({_list_sql(C.GROUPED_WHOLE)}, cluster_type)"
_MEMBERS_SQL = f"""{_UNITS_SQL},
  noded AS (SELECT *, md5(concat_ws(chr(1), video_id, aspect_key, cluster_type, stance, CASE WHEN {_WHOLE_SQL} THEN '*'
      WHEN len(tokens) > 0 THEN array_to_string(list_sort(tokens), ' ') ELSE regexp_replace(lower(span), '\\s+', ' ', 'g') END)) AS node FROM units),
  nodes AS (SELECT video_id, aspect_key, cluster_type, stance, node, max(engagement_score) AS weight, any_value(tokens) AS tokens
      FROM noded WHERE NOT {_WHOLE_SQL} AND len(tokens) > 0 GROUP BY video_id, aspect_key, cluster_type, stance, node),
  {_linked_sql('nodes', C.BUCKET, C.LINK_FROM, 'u')},
  members AS (SELECT noded.*, coalesce(component, node) AS cluster_key FROM noded LEFT JOIN u_parts USING (node))"""


@query("cluster_members", f"WITH RECURSIVE {_MEMBERS_SQL} SELECT unit_id, cluster_key FROM members")
def _(spark, sf):
    return members(spark, sf).select("unit_id", "cluster_key")


_CLUSTERS_SQL = f"""{_MEMBERS_SQL},
  measured AS (SELECT cluster_key, video_id, aspect_key, cluster_type, stance, count(*) AS size, count(DISTINCT comment_id) AS comments,
      count(DISTINCT author_id) AS unique_authors, round(sum(engagement_score), 3) AS total_engagement, avg(depth) AS reply_depth,
      avg(grounding_confidence) AS avg_grounding, avg(semantic_density) AS avg_density, min(aspect_label) AS aspect_label
    FROM members GROUP BY cluster_key, video_id, aspect_key, cluster_type, stance),
  weighed AS (SELECT *, round({_IMPORTANCE_SQL}, 3) AS importance, round(size / sum(size) OVER w, 4) AS share
    FROM measured WINDOW w AS (PARTITION BY video_id)),
  plain AS (SELECT *, concat_ws('_', video_id, substr({_slug_sql('aspect_key')}, 1, 40), cluster_type, stance, size) AS plain_id FROM weighed),
  clusters AS (SELECT * EXCLUDE (plain_id), CASE WHEN count(*) OVER (PARTITION BY plain_id) > 1 THEN plain_id || '_' || cluster_key ELSE plain_id END AS local_cluster_id,
      {_case_sql(C.LABELS, C.LABELS['other'])} || aspect_label AS label, size || ' opinion units ' || {_case_sql(C.VERBS, C.VERBS['other'])} || ' ' || aspect_label || '.' AS summary,
      list_contains({_list_sql(C.LOW_SIGNAL)}, cluster_type) AS low_signal, aspect_key = '{U.WIDE_ASPECT}' AS wide FROM plain)"""


@query(
    "local_clusters",
    f"""WITH RECURSIVE {_CLUSTERS_SQL} SELECT local_cluster_id, video_id, aspect_key, cluster_type, stance, size, comments, unique_authors,
      total_engagement, round(reply_depth + 1e-9, 4) AS reply_depth, round(avg_grounding + 1e-9, 4) AS avg_grounding, round(avg_density + 1e-9, 4) AS avg_density,
      share, importance, label, summary, low_signal, wide FROM clusters""",
)
def _(spark, sf):
    return clusters_of(spark, sf).select(
        "local_cluster_id", "video_id", "aspect_key", "cluster_type", "stance", "size", "comments", "unique_authors", "total_engagement",
        # A mean right between two roundings depends on the order of its sum: lift it off the middle.
        *[F.round(F.col(c) + 1e-9, 4).alias(c) for c in ("reply_depth", "avg_grounding", "avg_density")],
        "share", "importance", "label", "summary", "low_signal", "wide",
    )


_META_SQL = f"""{_CLUSTERS_SQL},
  usable AS (SELECT * FROM clusters WHERE NOT low_signal AND NOT wide),
  themes AS (SELECT stance, cluster_key AS node, {_tokens_sql('aspect_label')} AS tokens, importance AS weight FROM usable),
  {_linked_sql('themes', ['stance'], I.META_LINK_FROM, 'm')},
  joined AS (SELECT usable.*, component AS meta_key, row_number() OVER (PARTITION BY component, video_id ORDER BY importance DESC, local_cluster_id) AS r
      FROM usable JOIN m_parts ON cluster_key = node),
  single AS (SELECT * FROM joined WHERE r = 1),
  theme_members AS (SELECT * FROM single WHERE meta_key IN (SELECT meta_key FROM single GROUP BY meta_key HAVING count(*) > 1))"""


@query("meta_members", f"WITH RECURSIVE {_META_SQL} SELECT meta_key, local_cluster_id, video_id FROM theme_members")
def _(spark, sf):
    return themes_of(spark, sf).select("meta_key", "local_cluster_id", "video_id")


_INSIGHT_SQL = f"""{_CLUSTERS_SQL}, shown AS (SELECT * FROM clusters c WHERE NOT low_signal AND (NOT wide OR NOT EXISTS (
      SELECT 1 FROM clusters d WHERE d.video_id = c.video_id AND NOT d.low_signal AND NOT d.wide))),
  numbered AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY importance DESC, local_cluster_id) AS rank FROM shown)"""


@query(
    "local_insights",
    f"""WITH RECURSIVE {_INSIGHT_SQL} SELECT video_id || '_insight_' || rank AS insight_id, 'single_video' AS scope, video_id, label AS title, summary AS description,
      {_case_sql(C.WHY_IT_MATTERS, C.WHY_OTHERWISE)} AS why_it_matters, importance AS importance_score, round(avg_grounding, 3) AS confidence, rank
    FROM numbered""",
)
def _(spark, sf):
    return I.local_insights(clusters_of(spark, sf)).drop("cluster_key")


@query(
    "content_reports",
    f"""WITH RECURSIVE {_INSIGHT_SQL}, top AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY importance DESC, local_cluster_id) AS n
      FROM clusters WHERE NOT low_signal),
    t AS (SELECT video_id, string_agg(label, ' | ' ORDER BY n) AS themes FROM top GROUP BY video_id),
    p AS (SELECT video_id, count(*) FILTER (stance = 'positive') AS good_units, count(*) FILTER (stance = 'negative') AS bad_units FROM units GROUP BY video_id),
    c AS (SELECT video_id, count(*) AS comment_count FROM feedback GROUP BY video_id),
    s AS (SELECT video_id, summary FROM numbered WHERE rank = 1)
    SELECT video_id, comment_count, CASE WHEN bad_units > good_units THEN 'negative' WHEN good_units > bad_units THEN 'positive'
      WHEN good_units > 0 THEN 'mixed' ELSE 'neutral' END AS sentiment, coalesce(themes, '') AS themes, summary
    FROM c LEFT JOIN p USING (video_id) LEFT JOIN t USING (video_id) LEFT JOIN s USING (video_id)""",
)
def _(spark, sf):
    df = I.content_reports(feedback(spark, sf), members(spark, sf), clusters_of(spark, sf))
    return df.withColumn("themes", F.array_join("themes", " | "))


# -- reading the clusters -----------------------------------------------------

@query(
    "ask_index",
    f"""WITH RECURSIVE {_CLUSTERS_SQL} SELECT dimension, value, count(*) AS clusters FROM (
      SELECT 'stance' AS dimension, stance AS value FROM clusters UNION ALL SELECT 'cluster_type', cluster_type FROM clusters
      UNION ALL SELECT 'intent', CASE cluster_type WHEN 'question' THEN 'information_request' WHEN 'humor' THEN 'joke' WHEN 'opinion' THEN 'feedback' ELSE 'other' END FROM clusters
      UNION ALL SELECT 'aspect_key', aspect_key FROM clusters UNION ALL SELECT 'scope', 'single_video' FROM clusters
      UNION ALL SELECT 'scope', 'cross_video' FROM clusters) GROUP BY ALL""",
)
def _(spark, sf):
    return I.ask_index(clusters_of(spark, sf))


@query(
    "ask_negative_opinions",
    f"""WITH RECURSIVE {_CLUSTERS_SQL} SELECT local_cluster_id, video_id, 'feedback' AS intent, size, importance FROM clusters
    WHERE stance = 'negative' AND cluster_type = 'opinion'""",
)
def _(spark, sf):
    df = I.ask(clusters_of(spark, sf), stance=["negative"], cluster_type=["opinion"])
    return df.select("local_cluster_id", "video_id", "intent", "size", "importance")


@query(
    "ask_auto",
    f"""WITH RECURSIVE {_CLUSTERS_SQL} SELECT aspect_key, stance, count(*) AS clusters, CAST(sum(size) AS BIGINT) AS units,
      count(DISTINCT video_id) AS videos, max(importance) AS importance FROM clusters WHERE NOT low_signal GROUP BY ALL""",
)
def _(spark, sf):
    return I.ask_auto(clusters_of(spark, sf))


_TENSION_SQL = f"""{_CLUSTERS_SQL}, sides AS (SELECT video_id, aspect_key,
      CAST(coalesce(sum(size) FILTER (stance = 'positive'), 0) AS BIGINT) AS positive_units,
      CAST(coalesce(sum(size) FILTER (stance = 'negative'), 0) AS BIGINT) AS negative_units FROM clusters WHERE NOT low_signal GROUP BY ALL),
  tensions AS (SELECT *, round(least(positive_units, negative_units) / greatest(positive_units, negative_units), 4) AS balance
      FROM sides WHERE least(positive_units, negative_units) > 0)"""


@query("tension_map", f"WITH RECURSIVE {_TENSION_SQL} SELECT * FROM tensions")
def _(spark, sf):
    return R.tension_map(clusters_of(spark, sf)).drop("positive_cluster", "negative_cluster")


_TOP_SQL = """ranked_members AS (SELECT *, row_number() OVER (PARTITION BY cluster_key ORDER BY engagement_score DESC, comment_id, unit_id) AS rank FROM members)"""


@query(
    "tension_evidence",
    f"""WITH RECURSIVE {_TENSION_SQL}, {_TOP_SQL}, strongest AS (SELECT video_id, aspect_key, stance AS side, cluster_key,
      row_number() OVER (PARTITION BY video_id, aspect_key, stance ORDER BY importance DESC, cluster_key DESC) AS n
      FROM clusters WHERE NOT low_signal AND stance IN ('positive', 'negative'))
    SELECT s.video_id, s.aspect_key, side, rank, comment_id, md5(span) AS quote_md5 FROM strongest s JOIN tensions t
      ON s.video_id = t.video_id AND s.aspect_key = t.aspect_key JOIN ranked_members m USING (cluster_key) WHERE n = 1 AND rank <= 2""",
)
def _(spark, sf):
    df = Q.tension_evidence(R.tension_map(clusters_of(spark, sf)), members(spark, sf))
    return df.withColumn("quote_md5", F.md5("quote")).drop("quote")


@query(
    "consensus_by_aspect",
    f"""WITH RECURSIVE {_CLUSTERS_SQL}, a AS (SELECT aspect_key, CAST(sum(size) AS BIGINT) AS units,
      CAST(coalesce(sum(size) FILTER (stance = 'positive'), 0) AS BIGINT) AS positive,
      CAST(coalesce(sum(size) FILTER (stance = 'negative'), 0) AS BIGINT) AS negative, count(DISTINCT video_id) AS videos
      FROM clusters WHERE NOT low_signal GROUP BY aspect_key)
    SELECT *, CASE WHEN positive + negative = 0 THEN 0 ELSE round(greatest(positive, negative) / (positive + negative), 4) END AS agreement,
      CASE WHEN positive + negative = 0 THEN 'open' WHEN greatest(positive, negative) / (positive + negative) >= 0.75 THEN 'consensus'
      ELSE 'controversy' END AS verdict FROM a""",
)
def _(spark, sf):
    return R.consensus(clusters_of(spark, sf))


@query(
    "cluster_stances",
    f"""WITH RECURSIVE {_MEMBERS_SQL}, n AS (SELECT cluster_key, stance, count(*) AS n FROM members GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY cluster_key ORDER BY n DESC, stance DESC) AS b FROM n)
    SELECT stance AS dominant_stance, count(*) AS clusters FROM r WHERE b = 1 GROUP BY stance""",
)
def _(spark, sf):
    return C.stance_profile(members(spark, sf)).groupBy("dominant_stance").agg(F.count(F.lit(1)).alias("clusters"))


@query(
    "cluster_representatives",
    f"""WITH RECURSIVE {_MEMBERS_SQL}, sizes AS (SELECT cluster_key, count(*) AS size FROM members GROUP BY ALL),
    spread AS (SELECT cluster_key, unit_id, unnest(tokens) AS token FROM members),
    used AS (SELECT cluster_key, token, count(*) AS n FROM spread GROUP BY ALL),
    central AS (SELECT cluster_key, unit_id, round(avg(n / size), 6) AS centrality FROM spread JOIN used USING (cluster_key, token)
      JOIN sizes USING (cluster_key) GROUP BY ALL),
    m AS (SELECT members.*, coalesce(centrality, 0) AS centrality FROM members LEFT JOIN central USING (cluster_key, unit_id)),
    picks AS (
      SELECT *, 0 AS place, 'prototype' AS role, row_number() OVER (PARTITION BY cluster_key ORDER BY centrality DESC, engagement_score DESC, unit_id) AS n FROM m
      UNION ALL SELECT *, 1, 'top_engagement', row_number() OVER (PARTITION BY cluster_key ORDER BY engagement_score DESC, grounding_confidence DESC, unit_id) FROM m
      UNION ALL SELECT *, 2, 'dissent', row_number() OVER (PARTITION BY cluster_key ORDER BY centrality, engagement_score DESC, unit_id) FROM m WHERE stance = 'mixed'
      UNION ALL SELECT *, 3, 'reply_chain', row_number() OVER (PARTITION BY cluster_key ORDER BY depth DESC, engagement_score DESC, unit_id) FROM m WHERE depth > 0),
    once AS (SELECT *, row_number() OVER (PARTITION BY cluster_key, comment_id ORDER BY place) AS seen FROM picks WHERE n = 1)
    SELECT video_id, place, role, comment_id, unit_id, engagement_score FROM once WHERE seen = 1""",
)
def _(spark, sf):
    return C.representatives(members(spark, sf)).drop("cluster_key")


def _analysis_sql(themes: int) -> str:
    return f"""WITH RECURSIVE {_INSIGHT_SQL}, top AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY importance DESC, local_cluster_id) AS n
      FROM clusters WHERE NOT low_signal),
    t AS (SELECT video_id, string_agg(label, ' | ' ORDER BY n) AS themes FROM top WHERE n <= {themes} GROUP BY video_id),
    c AS (SELECT video_id, count(*) AS comment_count FROM feedback GROUP BY video_id),
    s AS (SELECT video_id, summary FROM numbered WHERE rank = 1)
    SELECT video_id, comment_count, coalesce(themes, '') AS themes, summary FROM c LEFT JOIN t USING (video_id) LEFT JOIN s USING (video_id)"""


@query("content_analyses_deep", _analysis_sql(Q.DEPTH_THEMES["deep"]))
def _(spark, sf):
    df = Q.analyze_contents(feedback(spark, sf), members(spark, sf), clusters_of(spark, sf), "deep")
    return df.withColumn("themes", F.array_join("themes", " | ")).drop("sentiment")


@query(
    "cluster_opinions_of_contents",
    f"""WITH RECURSIVE {_CLUSTERS_SQL}, {_TOP_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY importance DESC, local_cluster_id) AS rank
      FROM clusters WHERE NOT low_signal),
    e AS (SELECT cluster_key, md5(string_agg(span, ' | ' ORDER BY rank)) AS examples_md5 FROM ranked_members WHERE rank <= 3 GROUP BY cluster_key),
    t AS (SELECT video_id, count(DISTINCT comment_id) AS total_comments FROM members GROUP BY video_id),
    v AS (SELECT DISTINCT CAST(conv_id AS VARCHAR) AS video_id FROM conversations WHERE turn = 0)
    SELECT v.video_id, coalesce(total_comments, 0) AS total_comments, rank, local_cluster_id, label, stance, size, importance, examples_md5,
      CASE WHEN total_comments IS NULL THEN 'No comments found for clustering' END AS message
    FROM v LEFT JOIN t ON v.video_id = t.video_id LEFT JOIN (SELECT * FROM r WHERE rank <= 5) r ON v.video_id = r.video_id LEFT JOIN e USING (cluster_key)""",
)
def _(spark, sf):
    asked = contexts(spark, sf).select("video_id")
    df = Q.cluster_opinions(asked, members(spark, sf), clusters_of(spark, sf), 5)
    return df.withColumn("examples_md5", F.md5(F.array_join("examples", " | "))).drop("examples")


# -- themes across contents ---------------------------------------------------

_META_NORM_SQL = " + ".join(
    f"{weight} * " + _norm_sql(column).replace("OVER w", "OVER ()") for column, weight in I.META_WEIGHTS.items()
)
_METAS_SQL = f"""{_META_SQL},
  sums AS (SELECT meta_key, count(*) AS local_clusters, count(DISTINCT video_id) AS videos, sum(total_engagement) AS total_engagement,
      round(avg(avg_grounding), 3) AS confidence, avg(reply_depth) AS reply_depth FROM theme_members GROUP BY meta_key),
  lead AS (SELECT meta_key, aspect_key, aspect_label, stance FROM (SELECT *, row_number() OVER (PARTITION BY meta_key ORDER BY importance DESC, cluster_key DESC) AS b
      FROM theme_members) WHERE b = 1),
  people AS (SELECT meta_key, count(DISTINCT comment_id) AS comments, count(DISTINCT author_id) AS unique_authors,
      avg(CASE WHEN members.stance = 'negative' THEN 1.0 ELSE 0.0 END) AS negative_share FROM members JOIN theme_members USING (cluster_key) GROUP BY meta_key),
  rated AS (SELECT *, round(videos / (SELECT count(DISTINCT video_id) FROM clusters), 3) AS recurrence,
      round(negative_share * (1.0 - negative_share) * 4 * 0.5 + least(reply_depth, 1.0) * 0.5, 3) AS controversy
    FROM sums JOIN people USING (meta_key) JOIN lead USING (meta_key)),
  metas AS (SELECT *, 'meta_' || meta_key AS meta_cluster_id, round({_META_NORM_SQL}, 3) AS importance,
      {_case_sql(I.RECURRING, I.RECURRING_OTHERWISE)} || aspect_label AS canonical_theme FROM rated)"""


@query(
    "meta_clusters",
    f"""WITH RECURSIVE {_METAS_SQL} SELECT meta_cluster_id, canonical_theme, aspect_key AS canonical_aspect_key, stance AS canonical_stance,
      local_clusters, videos, comments, unique_authors, round(total_engagement, 3) AS total_engagement, recurrence, controversy, confidence, importance,
      canonical_theme || ' appears across ' || videos || ' videos and is supported by ' || local_clusters || ' related local clusters.' AS summary FROM metas""",
)
def _(spark, sf):
    return I.build_meta_clusters(themes_of(spark, sf), members(spark, sf), clusters_of(spark, sf)).drop("meta_key")


@query(
    "meta_insights",
    f"""WITH RECURSIVE {_METAS_SQL}, r AS (SELECT *, row_number() OVER (ORDER BY importance DESC, meta_cluster_id) AS rank FROM metas)
    SELECT 'cross_video_insight_' || rank AS insight_id, 'cross_video' AS scope, meta_cluster_id, canonical_theme AS title,
      {_case_sql(I.META_WHY, I.META_WHY_OTHERWISE)} AS why_it_matters, importance AS importance_score, confidence, rank FROM r""",
)
def _(spark, sf):
    metas = I.build_meta_clusters(themes_of(spark, sf), members(spark, sf), clusters_of(spark, sf))
    return I.meta_insights(metas).drop("description")


@query(
    "meta_representatives",
    f"""WITH RECURSIVE {_META_SQL}, {_TOP_SQL}, s AS (SELECT meta_key, cluster_key, row_number() OVER (PARTITION BY meta_key ORDER BY importance DESC, local_cluster_id) AS c
      FROM theme_members),
    p AS (SELECT meta_key, comment_id, unit_id, video_id, row_number() OVER (PARTITION BY meta_key ORDER BY c, rank) AS position
      FROM ranked_members JOIN s USING (cluster_key) WHERE c <= 2 AND rank <= 3)
    SELECT position, comment_id, unit_id, video_id FROM p WHERE position <= 3""",
)
def _(spark, sf):
    return I.meta_representatives(themes_of(spark, sf), members(spark, sf)).drop("meta_key")


@query(
    "comments_enriched_on_request",
    f"""WITH RECURSIVE {_ENRICHED_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY video_id
      ORDER BY round(ln(1 + likes) + 1.5 * ln(1 + reply_count), 6) DESC, comment_id) AS n FROM sured)
    SELECT video_id, comment_id, intent AS comment_intent, c AS grounding_confidence FROM r WHERE n <= 200""",
)
def _(spark, sf):
    df = Q.enrich_contents(feedback(spark, sf), A.with_anchors(contexts(spark, sf)), 200)
    return df.select("video_id", "comment_id", "comment_intent", "grounding_confidence")


_BUCKET_COLUMNS = ", ".join(C.BUCKET)


@query(
    "local_clusters_merged",
    f"""WITH RECURSIVE {_MEMBERS_SQL}, grown AS (SELECT cluster_key, {_BUCKET_COLUMNS}, count(*) AS size, sum(engagement_score) AS weight FROM members GROUP BY ALL),
    said AS (SELECT cluster_key, token, count(*) AS n FROM (SELECT cluster_key, unnest(tokens) AS token FROM members) GROUP BY ALL),
    common AS (SELECT cluster_key, list_sort(list(token)) AS tokens FROM said JOIN grown USING (cluster_key) WHERE n * 2 >= size GROUP BY cluster_key),
    again AS (SELECT {_BUCKET_COLUMNS}, cluster_key AS node, weight, tokens FROM grown JOIN common USING (cluster_key)),
    {_linked_sql('again', C.BUCKET, C.LINK_FROM, 'g')}
    SELECT {_BUCKET_COLUMNS}, size FROM (SELECT coalesce(component, cluster_key) AS k, {', '.join('members.' + c for c in C.BUCKET)}, count(*) AS size
      FROM members LEFT JOIN g_parts ON members.cluster_key = g_parts.node GROUP BY ALL)""",
)
def _(spark, sf):
    return C.build_clusters(C.merge_clusters(members(spark, sf))).select(*C.BUCKET, "size")


_SIDED_SQL = f"""{_MEMBERS_SQL}, anchored AS (SELECT comment_id || '_unit_' || piece AS unit_id, coalesce(p, '') AS primary_anchor FROM stanced),
  sided AS (SELECT members.* REPLACE (md5(concat_ws(chr(1), cluster_key, primary_anchor, intent)) AS cluster_key), members.cluster_key AS before_key, primary_anchor
    FROM members JOIN anchored USING (unit_id))"""
_SCOPE = [*C.BUCKET, *C.SIDES]
_VOCABULARY_SQL = f"""{_SIDED_SQL},
  v_words AS (SELECT cluster_key AS node, {', '.join(_SCOPE)}, token, count(*) AS n FROM (SELECT *, unnest(tokens) AS token FROM sided) GROUP BY ALL),
  v_norms AS (SELECT node, sum(CAST(n AS DOUBLE) * n) AS square FROM v_words GROUP BY node),
  v_products AS (SELECT a.node AS x, b.node AS y, sum(CAST(a.n AS DOUBLE) * b.n) AS product FROM v_words a JOIN v_words b
    ON a.token = b.token AND a.node < b.node AND {' AND '.join(f'a.{c} = b.{c}' for c in _SCOPE)} GROUP BY ALL),
  v_links AS (SELECT x, y FROM v_products JOIN v_norms l ON x = l.node JOIN v_norms r ON y = r.node
    WHERE product / sqrt(l.square * r.square) >= {C.MERGE_FROM}::DOUBLE),
  v_both AS (SELECT x, y FROM v_links UNION SELECT y, x FROM v_links),
  v_reach AS (SELECT x, y FROM v_both UNION SELECT r.x, b.y FROM v_reach r JOIN v_both b ON r.y = b.x),
  v_parts AS (SELECT x AS node, least(x, min(y)) AS component FROM v_reach GROUP BY x)"""


@query(
    "clusters_split_and_merged",
    f"""WITH RECURSIVE {_VOCABULARY_SQL}, t AS (SELECT sided.*, coalesce(component, cluster_key) AS k FROM sided LEFT JOIN v_parts ON cluster_key = v_parts.node)
    SELECT unit_id, before_key, cluster_key AS part_key, k AS cluster_key, primary_anchor, intent FROM t""",
)
def _(spark, sf):
    """Every unit with its cluster before, after the split and after the merge."""
    before = members(spark, sf).withColumn("before_key", F.col("cluster_key"))
    parts = C.split_clusters(before).withColumn("part_key", F.col("cluster_key"))
    return C.merge_by_vocabulary(parts).select("unit_id", "before_key", "part_key", "cluster_key", *C.SIDES)


@query("cluster_members_average")
def _(spark, sf):
    """Clusters of each content by average linkage; SQL can't express the rounds, ``tests/test_linkage.py`` repeats them."""
    return C.assign_clusters_by_mean(units(spark, sf)).select("unit_id", "cluster_key")


@query("phrases_average_linkage")
def _(spark, sf):
    """Similar phrases across all contents, by type and stance, as clusters around their means."""
    scope, least = ["cluster_type", "stance"], 0.3
    said = units(spark, sf).filter(F.size("tokens") > 0).withColumn("node", F.md5(F.concat_ws(" ", *scope, F.array_sort("tokens"))))
    nodes = in_order(said.groupBy(*scope, F.col("node").alias("name")).agg(
        F.any_value("tokens").alias("tokens"), F.count(F.lit(1)).alias("units"), F.max("engagement_score").alias("weight")
    ), "name", name="node")
    labels = agglomerate_in_pieces(nodes, similar_pairs(nodes, scope, least), least).filter("node != cluster")
    named = labels.join(nodes.select(F.col("node").alias("cluster"), F.col("name").alias("cluster_key")), "cluster").select("node", "cluster_key")
    return nodes.join(named, "node", "left").select(F.col("name").alias("node"), "units", F.coalesce("cluster_key", "name").alias("cluster_key"))


def signature_themes(spark, sf) -> DataFrame:
    return _once("signature_themes", spark, sf, lambda: T.theme_members(clusters_of(spark, sf)))


@query("theme_members_by_signature")
def _(spark, sf):
    """Every specific cluster and its theme; random projections find the pairs, ``tests/test_themes.py`` compares with all pairs."""
    return signature_themes(spark, sf).select("meta_key", "layer", "near", "local_cluster_id", "video_id")


@query("theme_insights_by_signature")
def _(spark, sf):
    """Themes that recur, numbered from the strongest."""
    recurring = T.recurring_members(signature_themes(spark, sf))
    return I.meta_insights(I.build_meta_clusters(recurring, members(spark, sf), clusters_of(spark, sf)))


@query(
    "opinion_silhouette",
    f"""WITH RECURSIVE {_MEMBERS_SQL}, distinct_units AS (SELECT video_id, unit_id, cluster_key, tokens FROM members),
    p AS (SELECT a.video_id, a.unit_id, a.cluster_key AS own, b.cluster_key AS other, count(*) AS n,
        sum(1 - CASE WHEN len(a.tokens) * len(b.tokens) = 0 THEN 0 ELSE len(list_intersect(a.tokens, b.tokens)) / sqrt(len(a.tokens) * len(b.tokens)) END) AS s
      FROM distinct_units a JOIN distinct_units b ON a.video_id = b.video_id AND a.unit_id <> b.unit_id GROUP BY ALL),
    x AS (SELECT unit_id, round(max(CASE WHEN own = other THEN s / n END), 9) AS a, round(min(CASE WHEN own <> other THEN s / n END), 9) AS b FROM p GROUP BY unit_id)
    SELECT video_id, count(*) AS units,
      round(avg(CASE WHEN a IS NULL OR b IS NULL OR greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END) + 1e-9, 4) AS silhouette
    FROM distinct_units LEFT JOIN x USING (unit_id) GROUP BY video_id""",
)
def _(spark, sf):
    df = V.token_silhouette(members(spark, sf), ["video_id"])
    return df.withColumn("silhouette", F.round(F.col("silhouette") + 1e-9, 4))
