"""From raw documents to token ids: quality, lines, near duplicates, mixture, tokens.

Every stage works on all rows of the one before. Rows with null columns, empty
texts and repeated rows pass through as the operators define it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from undertone.llm.bpe import bpe_encode
from undertone.llm.lines import remove_repeated_lines
from undertone.llm.minhash import near_classes
from undertone.llm.mixing import mix
from undertone.llm.quality import fit_quality, score_quality
from undertone.session import pin_utc, settle

LEAST_SCORE = 0.7


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below ``LEAST_SCORE`` go; without labelled documents nothing is known and all stay."""
    model = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    if not model.rows:
        return docs
    packed = docs.select(F.struct(*docs.columns).alias("doc"), "text")
    return score_quality(packed, model).filter(F.col("score") >= LEAST_SCORE).select("doc.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat go, but for their first place; documents of which no word is left go too.

    ``n_chars`` follows the text. A document that had no words before stays.
    """
    packed = docs.select(F.struct(*docs.columns).alias("doc"), "doc_id", "text")
    cut = remove_repeated_lines(packed).filter(
        (F.col("lines_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")
    )
    changed = F.col("lines_removed") > 0
    new = {"text": F.col("text"), "n_chars": F.when(changed, F.length("text").cast("long")).otherwise(F.col("doc")["n_chars"])}
    return cut.select(*(new[c].alias(c) if c in new else F.col("doc")[c].alias(c) for c in docs.columns))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates one document stays, once: that of the least id (null last), then row.

    Documents without shingles are no one's near duplicates; each different one stays.
    """
    found = near_classes(docs)
    place = F.struct(F.col("key").isNull().alias("unknown"), "key", "row")
    first = found.filter("class is not null").groupBy("class").agg(F.min(place)["row"].alias("row")).select("row")
    stays = first.unionByName(found.filter("class is null").select("row").distinct())
    packed = docs.select(F.struct(*docs.columns).alias("doc"), F.xxhash64("doc_id", "text").alias("row"))
    return packed.join(stays, "row").dropDuplicates(["row"]).select("doc.*")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture of sources takes it."""
    return mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each taken document, in place of its text."""
    encoded = bpe_encode(docs.select("doc_id", "lang", "source", "text"))
    return encoded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("quality", quality), ("lines", lines), ("minhash", near), ("mixing", mixture), ("bpe", tokens)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; what one stage returns is written and read again by the next."""
    docs = pin_utc(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = settle(docs)
    return docs
