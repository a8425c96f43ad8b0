"""Token ids as Parquet list columns.

Documents are cut into ranges of ids, one range per task and file. A file holds
``shard``, ``doc_id``, ``before`` (ids before the document within its shard),
``n_tokens`` and the list ``ids``. Ids are dictionary encoded (about two bytes
each), the rising columns delta encoded; row groups and pages are small and
carry column indexes, so a filter on ``doc_id`` reads few pages, and
``read_metadata`` never touches the ids. The place of a document in the whole
corpus follows from the sums of the shards.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from undertone.llm import text as X
from undertone.llm.bpe import VOCABULARY, Encoder, encoded_runs
from undertone.llm.tasks import KEPT, map_arrow
from undertone.session import settle

END = 2
ROW_GROUP = 16 << 20
PAGE = 256 << 10
PAGE_ROWS = 2000
LAYOUT = "shard int, doc_id long, before long, n_tokens long, ids array<int>"


def library_encoder(path: str) -> Encoder:
    """An encoder whose new pieces the tokenizers library encodes, one thread per task."""
    if ("library", path) not in KEPT:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)

        def encode_new(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            raw = data.tobytes()
            ends = np.append(starts[1:], len(raw))
            texts = [raw[a:b].decode() for a, b in zip(starts.tolist(), ends.tolist())]
            found = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
            counts = np.fromiter(map(len, found), np.int64, len(found))
            return np.fromiter((i for ids in found for i in ids), np.int32, int(counts.sum())), counts

        KEPT["library", path] = Encoder(path, encode_new)
    return KEPT["library", path]


def tokenized(docs: DataFrame, text: str = "text", key: str = "doc_id", path: str | None = None, end: int = END) -> DataFrame:
    """The rows of the files, in ascending order of the key: null keys first, equal keys by text.

    A null text is an empty one and has only the end id. Other columns are left out.
    """
    path = path or public_tokenizers.path(VOCABULARY)
    ordered = (
        docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
        .repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    )

    def run(batches):
        enc = library_encoder(path)
        shard, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            for i, ids, bounds in encoded_runs(batch.column("text"), enc):
                counts = np.diff(bounds) + 1
                offsets = np.append(0, np.cumsum(counts))
                flat = np.full(offsets[-1], end, np.int32)
                flat[X.ranges(offsets[:-1], counts - 1)] = ids
                n = len(counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, shard, np.int32)), batch.column("doc_id").slice(i, n), pa.array(before + offsets[:-1]),
                     pa.array(counts), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))],
                    ["shard", "doc_id", "before", "n_tokens", "ids"],
                )
                before += int(offsets[-1])

    return map_arrow(ordered, run, LAYOUT, keeps="library")


def write_tokens(docs: DataFrame, folder: str, **options) -> None:
    """Write the token files of ``docs`` to ``folder``, which must not exist. Tasks commit whole files."""
    (
        tokenized(docs, **options).write
        .option("compression", "zstd").option("parquet.writer.version", "PARQUET_2_0")
        .option("parquet.enable.dictionary", "true").option("parquet.dictionary.page.size", str(1 << 20))
        .option("parquet.enable.dictionary#doc_id", "false").option("parquet.enable.dictionary#before", "false")
        .option("parquet.block.size", str(ROW_GROUP)).option("parquet.page.size", str(PAGE))
        .option("parquet.page.row.count.limit", str(PAGE_ROWS))
        .parquet(folder)
    )


def read_metadata(spark: SparkSession, folder: str) -> DataFrame:
    """(shard, doc_id, before, n_tokens) of all documents; the ids are not read."""
    return spark.read.schema(LAYOUT).parquet(folder).drop("ids")


def read_tokens(spark: SparkSession, folder: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """The rows with ``low`` <= doc_id <= ``high``; the bounds reach row groups and pages."""
    rows = spark.read.schema(LAYOUT).parquet(folder)
    if low is not None:
        rows = rows.filter(F.col("doc_id") >= low)
    if high is not None:
        rows = rows.filter(F.col("doc_id") <= high)
    return rows


def shard_starts(spark: SparkSession, folder: str) -> DataFrame:
    """(shard, start): ids in all shards before. One row per file, so one task orders them."""
    sums = read_metadata(spark, folder).groupBy("shard").agg(F.sum("n_tokens").alias("ids"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("shard", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("start"))


def checksums(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files; the crc32 is of little-endian unsigned 32-bit ids."""

    def run(batches):
        for batch in batches:
            lists = batch.column("ids")
            offsets = lists.offsets.to_numpy()
            raw = memoryview(lists.values.to_numpy(zero_copy_only=False).astype("<u4").tobytes())
            sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            counts = pa.array(np.diff(offsets).astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("shard"), batch.column("doc_id"), batch.column("before"), counts, pa.array(sums, pa.int64())],
                ["shard", "doc_id", "before", "n_tokens", "ids_crc32"],
            )

    rows = read_tokens(spark, folder).select("shard", "doc_id", "before", "ids")
    found = map_arrow(rows, run, "shard int, doc_id long, before long, n_tokens long, ids_crc32 long")
    return found.join(settle(shard_starts(spark, folder)), "shard").select(
        "doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32"
    )
