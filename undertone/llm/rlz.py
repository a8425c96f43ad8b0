"""Repeated passages by relative Lempel-Ziv parsing.

Every window of ``window`` words has one anchor: the least hash among its
``gram``-word grams, leftmost on ties, which depends on the window's words
alone. All anchors are indexed in blocks by their hash; the reference of an
anchor is its first place in the corpus. Around each repeated anchor a document
is factored against the reference: the factor is the stretch on which both
agree, and factors of at least ``window`` words are duplicate spans of both. At
the boundaries of factors, windows that the reference does not hold are looked
up by their own hash among all windows left over, so that no repeat is lost:
equal windows share their anchor, hence either both agree with the reference or
both are left over.

No pair of copies is made: each place is compared with one reference. Hot
anchors are counted before the shuffle and joined with splittable joins.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undertone.llm import text as X
from undertone.llm.tasks import map_arrow
from undertone.session import discard, settle

WINDOW = 35
GRAM = 16


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """For each stretch of ``width`` values the place of its least one, leftmost on ties."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    place, have = np.arange(len(values)), 1
    while have < width:
        step = min(have, width - have)
        left, right = place[: len(place) - step], place[step:]
        place = np.where(values[left] <= values[right], left, right)
        have += step
    return place


class Anchors:
    """Anchors of the documents of a run: for each anchor its gram hash, place and first and last window."""

    def __init__(self, raw, offsets, i, j, window: int, gram: int):
        self.words = words = X.Words(raw, offsets, i, j)
        self.window, self.gram = window, gram
        grams = X.window_hashes(words.hashes(), gram)
        place = _least(grams, window - gram + 1)
        count = np.maximum(np.diff(words.first) - window + 1, 0)
        starts = X.ranges(words.first[:-1], count)
        place = place[starts]
        document = np.repeat(np.arange(len(count)), count)
        new = np.ones(len(place), bool)
        new[1:] = (place[1:] != place[:-1]) | (document[1:] != document[:-1])
        at = np.flatnonzero(new)
        self.place = place[at]
        self.document = document[at]
        self.low = starts[at]
        self.count = np.diff(np.append(at, len(place)))
        self.hash = grams[self.place] if len(at) else np.zeros(0, np.uint64)

    def window_hashes(self, starts: np.ndarray) -> np.ndarray:
        return X.window_hashes(self.words.hashes(), self.window)[starts]


def _digest(parts: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(parts)).hexdigest()


def _summaries(batches):
    for batch in batches:
        raw, offsets = X.buffer_of(batch.column("text"))
        data = memoryview(raw)
        words = [bytes(data[a:b]).split() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        yield pa.RecordBatch.from_arrays(
            [batch.column("row"), batch.column("key"), pa.array(list(map(len, words)), pa.int64()),
             pa.array(list(map(_digest, words)), pa.string())],
            ["row", "key", "n_words", "whole_sha256"],
        )


def _anchors(batches, window: int, gram: int):
    for batch in batches:
        raw, offsets = X.buffer_of(batch.column("text"))
        rows = batch.column("row").to_numpy(zero_copy_only=False)
        for i, j in X.chunks(offsets):
            a = Anchors(raw, offsets, i, j, window, gram)
            yield pa.RecordBatch.from_arrays(
                [X.signed(a.hash), pa.array(rows[i + a.document], pa.int64()),
                 pa.array((a.place - a.words.first[a.document]).astype(np.int32))],
                ["anchor", "row", "place"],
            )


def _stretches(batches, window: int, gram: int):
    """For each repeated anchor of a document the hashes of its windows."""
    for batch in batches:
        raw, offsets = X.buffer_of(batch.column("text"))
        rows = batch.column("row").to_numpy(zero_copy_only=False)
        hits = batch.column("hits")
        hit_offsets = hits.offsets.to_numpy()
        flat = hits.values.to_numpy(zero_copy_only=False)
        for i, j in X.chunks(offsets):
            a = Anchors(raw, offsets, i, j, window, gram)
            local = a.place - a.words.first[a.document]
            chosen, leads = [], []
            edges = np.searchsorted(a.document, np.arange(j - i + 1))
            for d in range(j - i):
                mine = flat[hit_offsets[i + d] : hit_offsets[i + d + 1]]
                places = mine >> 1
                order = np.argsort(places, kind="stable")
                at = np.searchsorted(places[order], local[edges[d] : edges[d + 1]])
                at = np.minimum(at, len(order) - 1)
                found = places[order][at] == local[edges[d] : edges[d + 1]] if len(order) else np.zeros(edges[d + 1] - edges[d], bool)
                chosen.append(np.flatnonzero(found) + edges[d])
                leads.append((mine[order][at][found] & 1).astype(bool) if len(order) else np.zeros(0, bool))
            chosen = np.concatenate(chosen) if chosen else np.zeros(0, np.int64)
            leads = np.concatenate(leads) if leads else np.zeros(0, bool)
            counts = a.count[chosen]
            hashes = a.window_hashes(X.ranges(a.low[chosen], counts))
            cut = np.append(0, np.cumsum(counts)) * 8
            packed = hashes.tobytes()
            base = a.words.first[a.document[chosen]]
            yield pa.RecordBatch.from_arrays(
                [X.signed(a.hash[chosen]), pa.array(rows[i + a.document[chosen]], pa.int64()),
                 pa.array((a.low[chosen] - base).astype(np.int32)), pa.array((a.place[chosen] - a.low[chosen]).astype(np.int32)),
                 pa.array(leads), X.binaries([packed[s:e] for s, e in zip(cut[:-1].tolist(), cut[1:].tolist())])],
                ["anchor", "row", "low", "reach", "leads", "hashes"],
            )


def _packed(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hashes of all rows back to back, and first place and number of each row."""
    values = column.to_pylist()
    count = np.fromiter(map(len, values), np.int64, len(values)) // 8
    return np.frombuffer(b"".join(values), np.int64), np.cumsum(count) - count, count


def _factors(batches):
    """Compare each place with its reference.

    kind 0: ``size`` windows from ``low`` of ``row`` are held by the reference; kind 1: bit o of ``mask`` says that some
    place agrees with the reference's window o words before the anchor; kind 2: a window left over.
    """
    for batch in batches:
        anchor, row, start, reach, lead_reach = (
            batch.column(c).to_numpy(zero_copy_only=False) for c in ("anchor", "row", "low", "reach", "lead_reach")
        )
        mine, begin, count = _packed(batch.column("hashes"))
        lead, lead_begin, lead_count = _packed(batch.column("lead_hashes"))
        place = np.repeat(np.arange(len(row)), count)
        t = np.arange(len(mine)) - begin[place]
        # Window t stands reach - t words before the anchor, here and in the reference.
        other = t + (lead_reach - reach)[place]
        inside = (other >= 0) & (other < lead_count[place])
        agree = np.zeros(len(mine), bool)
        agree[inside] = mine[inside] == lead[(lead_begin[place] + other)[inside]]
        edge = np.append(True, place[1:] != place[:-1]) if len(place) else np.zeros(0, bool)
        first = np.flatnonzero(agree & (edge | ~np.append(False, agree[:-1])[: len(agree)]))
        last = np.flatnonzero(agree & (np.append(edge[1:], True)[: len(agree)] | ~np.append(agree[1:], False)[: len(agree)]))
        masks = np.zeros(len(row), np.int64)
        np.bitwise_or.at(masks, place[agree], np.left_shift(np.int64(1), (reach[place] - t)[agree].astype(np.int64)))
        held = np.flatnonzero(masks)
        left = np.flatnonzero(~agree)
        n = (len(first), len(held), len(left))
        nothing = [np.zeros(x, np.int64) for x in n]
        columns = (
            ("kind", np.repeat([0, 1, 2], n), np.int32),
            ("row", np.concatenate([row[place[first]], nothing[1], row[place[left]]]), np.int64),
            ("low", np.concatenate([start[place[first]] + t[first], nothing[1], start[place[left]] + t[left]]), np.int32),
            ("size", np.concatenate([last - first + 1, nothing[1], nothing[2] + 1]), np.int32),
            ("anchor", np.concatenate([nothing[0], anchor[held], nothing[2]]), np.int64),
            ("mask", np.concatenate([nothing[0], masks[held], nothing[2]]), np.int64),
            ("left", np.concatenate([nothing[0], nothing[1], mine[left]]), np.int64),
        )
        yield pa.RecordBatch.from_arrays([pa.array(v.astype(kind)) for _, v, kind in columns], [name for name, _, _ in columns])


def _cut(batches, window: int):
    """Remove the words under the windows; the kept words are joined by one space."""
    for batch in batches:
        raw, offsets = X.buffer_of(batch.column("text"))
        data = memoryview(raw)
        removed, digests, kept_texts = [], [], []
        spans = batch.column("spans").to_pylist()
        again = batch.column("again").to_pylist()
        for a, b, found, all_of_it in zip(offsets[:-1].tolist(), offsets[1:].tolist(), spans, again):
            words = bytes(data[a:b]).split()
            change = np.zeros(len(words) + 1, np.int64)
            if all_of_it and len(words) >= window:
                change[0] += 1
                change[len(words)] -= 1
            for s in found or ():
                change[s["low"]] += 1
                change[s["low"] + s["size"] + window - 1] -= 1
            keep = np.cumsum(change)[:-1] == 0
            kept = [w for w, k in zip(words, keep.tolist()) if k]
            removed.append(len(words) - len(kept))
            digests.append(_digest(kept))
            kept_texts.append(b" ".join(kept).decode())
        yield pa.RecordBatch.from_arrays(
            [batch.column("row"), pa.array(removed, pa.int64()), pa.array(digests, pa.string()), pa.array(kept_texts, pa.string())],
            ["row", "n_removed", "kept_sha256", "kept_text"],
        )


def _keyed(docs: DataFrame, text: str, key: str) -> DataFrame:
    return docs.select(
        F.xxhash64(F.col(key), F.col(text)).alias("row"), F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text")
    )


def _spans(rows: DataFrame, window: int, gram: int) -> tuple[DataFrame, DataFrame]:
    """(documents with repeated anchors, duplicate spans of them)."""
    anchors = settle(map_arrow(rows.select("row", "text"), lambda b: _anchors(b, window, gram), "anchor long, row long, place int"))
    index = (
        anchors.groupBy("anchor").agg(F.count("*").alias("places"), F.min(F.struct("row", "place")).alias("first"))
        .filter("places > 1").select("anchor", "first")
    )
    hits = anchors.join(index, "anchor").groupBy("row").agg(
        F.collect_set(
            F.col("place").cast("long") * 2 + ((F.col("row") == F.col("first.row")) & (F.col("place") == F.col("first.place"))).cast("long")
        ).alias("hits")
    )
    hit = settle(rows.join(hits, "row").dropDuplicates(["row"]).select("row", "text", "hits"))
    discard(anchors)
    stretches = settle(map_arrow(
        hit, lambda b: _stretches(b, window, gram),
        "anchor long, row long, low int, reach int, leads boolean, hashes binary",
    ))
    leads = stretches.filter("leads").select(
        "anchor", F.col("row").alias("lead_row"), F.col("low").alias("lead_low"), F.col("reach").alias("lead_reach"),
        F.col("hashes").alias("lead_hashes"),
    )
    compared = stretches.filter("not leads").join(leads.drop("lead_row", "lead_low"), "anchor").select(
        "anchor", "row", "low", "reach", "hashes", "lead_reach", "lead_hashes"
    )
    factors = settle(map_arrow(
        compared, _factors, "kind int, row long, low int, size int, anchor long, mask long, left long"
    ))
    masks = factors.filter("kind = 1").groupBy("anchor").agg(F.bit_or("mask").alias("mask"))
    of_leads = leads.join(masks, "anchor").select(
        F.col("lead_row").alias("row"), F.col("lead_low").alias("low"), F.col("lead_reach").alias("reach"), "mask",
        F.explode(F.sequence(F.lit(0), F.lit(window - gram))).alias("o"),
    ).filter("(shiftright(mask, o) & 1) = 1").select("row", (F.col("low") + F.col("reach") - F.col("o")).cast("int").alias("low"), F.lit(1).alias("size"))
    left = factors.filter("kind = 2").select("row", "low", "size", "left")
    twice = left.groupBy("left").agg(F.count("*").alias("n")).filter("n > 1").select("left")
    spans = (
        factors.filter("kind = 0").select("row", "low", "size")
        .unionByName(of_leads)
        .unionByName(left.join(twice, "left").select("row", "low", "size"))
    )
    return hit, spans


def remove_repeats(
    docs: DataFrame, window: int = WINDOW, gram: int = GRAM, text: str = "text", key: str = "doc_id"
) -> DataFrame:
    """(key, n_words, n_removed, kept_sha256, kept_text) for each document; ``kept_text`` is null where nothing went.

    A word goes if a window over it has the same words as a window that starts anywhere else in
    the corpus, same document included. Null texts have no words. A row that occurs several times
    repeats all its windows. Other columns are ignored. ``gram`` is held between ``window`` - 62
    (the offsets of an anchor fill a 64-bit mask) and ``window``; the result doesn't depend on it.
    """
    gram = min(max(gram, window - 62), window)
    rows = _keyed(docs, text, key)
    summary = settle(map_arrow(rows, _summaries, "row long, key long, n_words long, whole_sha256 string"))
    again = summary.groupBy("row").agg(F.count("*").alias("n")).filter("n > 1").select("row", F.lit(True).alias("again"))
    hit, spans = _spans(rows, window, gram)
    lists = spans.groupBy("row").agg(F.collect_list(F.struct("low", "size")).alias("spans"))
    touched = hit.join(lists, "row", "left").join(again, "row", "left").filter("spans is not null or again")
    cut = map_arrow(
        touched.select("row", "text", "spans", F.coalesce("again", F.lit(False)).alias("again")),
        lambda b: _cut(b, window), "row long, n_removed long, kept_sha256 string, kept_text string",
    )
    return summary.join(cut, "row", "left").select(
        "key", "n_words", F.coalesce("n_removed", F.lit(0)).alias("n_removed"),
        F.coalesce("kept_sha256", "whole_sha256").alias("kept_sha256"), "kept_text",
    )
