"""The queries of the operators: thin, over whole tables, with their SQL where SQL can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from undertone.llm.bitplanes import cluster_vectors, with_inertia
from undertone.llm.bpe import bpe_round_trip
from undertone.llm.hmm import score_texts
from undertone.llm.infill import fill_in_middle, restored
from undertone.llm.lines import remove_repeated_lines
from undertone.llm.minhash import near_duplicates
from undertone.llm.mixing import with_targets
from undertone.llm.multi_index import near_vectors
from undertone.llm.quality import fit_quality, held_out, score_quality
from undertone.llm.rlz import remove_repeats
from undertone.llm.token_store import checksums, write_tokens
from undertone.llm.trees import quality_rules
from undertone.llm.vafile import top_products
from undertone.session import pin_utc, shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(f):
        QUERIES[name] = lambda spark, sf_dir: f(pin_utc(spark), sf_dir)
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op5_minhash_dedup")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), k=4, num=80, den=100)
    return found.select(
        F.col("key").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"),
        F.col("key").eqNullSafe(F.col("component")).alias("kept"),
    )


@query("op7_mixing", """
WITH sized AS (
    SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
        coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, '')) AS name FROM documents
), ranked AS (
    SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, source) AS place
    FROM sized GROUP BY source
), weighed AS (
    SELECT *, [5, 2, 1][((place - 1) % 3 + 1)::INT] AS weight FROM ranked
), levels AS (
    SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER before, 0))::DOUBLE
        / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
    FROM weighed
    WINDOW before AS (ORDER BY source_size::DOUBLE / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), final AS (
    SELECT arg_min(level, (source_size::DOUBLE / weight, place)) AS level FROM levels WHERE level * weight <= 3 * source_size
), targets AS (
    SELECT source, source_size,
        CASE WHEN l.level * weight > 3 * source_size THEN 3.0::DOUBLE * source_size ELSE f.level * weight END AS target
    FROM levels l, final f
), rates AS (
    SELECT *, CASE WHEN source_size > 0 THEN least(target / source_size, 3.0::DOUBLE) ELSE 0.0::DOUBLE END AS rate FROM targets
), draws AS (
    SELECT doc_id, size, r.source, source_size, target, number,
        size * (floor(rate)::BIGINT + CASE WHEN
            ('0x' || substr(md5('mix|' || number || '|' || name), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE
            < rate - floor(rate) THEN 1 ELSE 0 END) AS taken
    FROM sized s JOIN rates r ON s.source IS NOT DISTINCT FROM r.source, range(16) n(number)
), chosen AS (
    SELECT source, arg_min(number, (distance, number)) AS number FROM (
        SELECT source, number, abs(sum(taken) - target) AS distance FROM draws GROUP BY source, number, target
    ) GROUP BY source
)
SELECT doc_id, size, source_size, target, taken
FROM draws d JOIN chosen c ON d.source IS NOT DISTINCT FROM c.source AND d.number = c.number
""")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = with_targets(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"), (F.col("mix_size") * F.col("mix_times")).alias("taken"),
    )


@query("op1_bpe_round_trip")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op8_quality_classifier")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    return score_quality(docs, model).select(
        "doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score",
        F.when(F.col("score") >= 0.7, 1).otherwise(0).cast("int").alias("predicted"),
    )


@query("op4_token_files")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/tokens/{uuid.uuid4().hex}"
    write_tokens(table(spark, sf_dir, "documents"), folder)
    return checksums(spark, folder)


@query("op9_substring_dedup")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select(F.col("key").alias("doc_id"), "n_words", "n_removed", "kept_sha256")


@query("op10_lm_scoring")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents")).withColumnRenamed("key", "doc_id")


@query("op6_line_dedup")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.col("lines_removed").cast("long").alias("n_removed"), F.sha2("text", 256).alias("kept_sha256"))


@query("op2_embedding_dedup")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_vectors(table(spark, sf_dir, "embeddings"), least=0.93)
    return found.select(
        F.col("key").alias("vec_id"), "n_links", F.col("component").alias("component_id"),
        F.col("key").eqNullSafe(F.col("component")).alias("kept"),
    )


@query("op3_exact_topk", """
WITH whole AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, d.vec_id, list_dot_product(q.v::DOUBLE[], d.v::DOUBLE[])::BIGINT AS score
    FROM whole q JOIN whole d ON q.vec_id <> d.vec_id AND len(q.v) = len(d.v) WHERE q.vec_id % 50 = 0
)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
) WHERE rank <= 5
""")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_products(vectors, vectors.filter("vec_id % 50 = 0"), k=5)


@query("op11_fill_in_middle", """
WITH hashed AS (
    SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), cut AS (
    SELECT doc_id, t, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS units, len(units) AS n,
        ('0x' || substr(h, 1, 8))::BIGINT % (n + 1) AS a, ('0x' || substr(h, 9, 8))::BIGINT % (n + 1) AS b,
        CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>')
                OR ('0x' || substr(h, 17, 8))::BIGINT % 100 >= 100 THEN 'plain'
            WHEN ('0x' || substr(h, 25, 8))::BIGINT % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
    FROM hashed
), parts AS (
    SELECT *, array_to_string(units[1:least(a, b)], '') AS prefix, array_to_string(units[least(a, b) + 1:greatest(a, b)], '') AS middle,
        array_to_string(units[greatest(a, b) + 1:], '') AS suffix
    FROM cut
)
SELECT doc_id, n::BIGINT AS n, form,
    CASE WHEN form <> 'plain' THEN length(prefix) END::BIGINT AS prefix_chars,
    CASE WHEN form <> 'plain' THEN length(middle) END::BIGINT AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
    sha256(t) AS restored_sha256
FROM parts
""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", F.col("fim_units").alias("n"), F.col("fim_form").alias("form"), F.col("fim_prefix_chars").alias("prefix_chars"),
        F.col("fim_middle_chars").alias("middle_chars"), F.sha2("fim_text", 256).alias("output_sha256"),
        F.sha2(restored(F.col("fim_form"), F.col("fim_text")), 256).alias("restored_sha256"),
    )


@query("op12_quality_rules")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = quality_rules(docs, table(spark, sf_dir, "labels"), hold_out=held_out(F.col("key"), 4, 2))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def _clustering_sql(k: int = 40, rounds: int = 5) -> str:
    """The rounds as one table after another; every sum is an exact integer."""
    steps = ["""
kept AS MATERIALIZED (
    SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
)""", f"""
centroids0 AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY sha256('2:' || coalesce(vec_id::VARCHAR, ''))) - 1 AS cluster, v AS c FROM kept
    QUALIFY cluster < {k}
)"""]
    for n in range(rounds + 1):
        steps.append(f"""
assigned{n} AS MATERIALIZED (
    SELECT row, vec_id, v, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS d FROM (
        SELECT row, vec_id, v, cluster, list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d
        FROM kept, centroids{n}
    ) GROUP BY row, vec_id, v
)""")
        if n < rounds:
            steps.append(f"""
means{n} AS MATERIALIZED (
    SELECT cluster, list((s - ((s % n + n) % n)) // n ORDER BY i)::DOUBLE[] AS c FROM (
        SELECT cluster, i, sum(x::BIGINT)::BIGINT AS s, count(*) AS n
        FROM (SELECT cluster, unnest(v) AS x, unnest(range(64)) AS i FROM assigned{n}) GROUP BY cluster, i
    ) GROUP BY cluster
), centroids{n + 1} AS MATERIALIZED (
    SELECT o.cluster, coalesce(m.c, o.c) AS c FROM centroids{n} o LEFT JOIN means{n} m USING (cluster)
)""")
    return "WITH " + ",".join(steps) + f"""
SELECT vec_id, a.cluster::INT AS cluster, d AS distance, sum(d) OVER (PARTITION BY a.cluster)::BIGINT AS cluster_inertia,
    sum(d) OVER ()::BIGINT AS inertia, sha256(array_to_string(list_transform(c, lambda x: x::BIGINT), ',')) AS centroid_sha256
FROM assigned{rounds} a JOIN centroids{rounds} USING (cluster)
"""


@query("op13_centroid_clustering", _clustering_sql())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_inertia(*cluster_vectors(table(spark, sf_dir, "embeddings"), k=40)).withColumnRenamed("key", "vec_id")
