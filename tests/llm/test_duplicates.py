"""Near duplicates of documents, lines and passages against brute force."""

import hashlib
import random

import numpy as np
import pytest

from tests.llm import brute
from undertone.llm import lines as L
from undertone.llm.minhash import BATCHES, HASHES, least_matches, near_duplicates, signature
from undertone.llm.queries import QUERIES
from undertone.llm.rlz import remove_repeats


def texts_of(spark, sf):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def varied(draw, n_groups=40, copies=6, vocabulary=4000, size=120):
    """Groups of texts with few to many changed words."""
    texts = {}
    for _ in range(n_groups):
        base = [f"w{draw.randrange(vocabulary)}" for _ in range(draw.randint(5, size))]
        for _ in range(copies):
            share = draw.choice([0, 0.005, 0.01, 0.02, 0.03, 0.05, 0.1])
            texts[len(texts)] = " ".join(f"v{draw.randrange(vocabulary)}" if draw.random() < share else w for w in base)
    return texts


def test_documents_query(spark, sf):
    texts = texts_of(spark, sf)
    sets, expected = brute.similar_documents(texts, 4)
    for r in QUERIES["op5_minhash_dedup"](spark, sf).collect():
        i = r["doc_id"]
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[i]), expected[i], expected[i] == i)


@pytest.mark.parametrize("k", [4, 5])
def test_documents_around_the_threshold(spark, documents, k):
    texts = varied(random.Random(k))
    _, expected = brute.similar_documents(texts, k)
    assert len(set(expected.values())) < len(texts)
    found = near_duplicates(documents([(i, t, "a") for i, t in texts.items()]), k=k)
    assert {r["key"]: r["component"] for r in found.collect()} == expected


def test_large_group_without_a_middle(spark, documents):
    """Many texts of which each has only a few partners."""
    draw = random.Random(9)
    base = [f"w{i}" for i in range(400)]
    texts, now = {}, list(base)
    for i in range(150):
        now[draw.randrange(400)] = f"v{i}"
        texts[i] = " ".join(now)
    _, expected = brute.similar_documents(texts, 5)
    found = near_duplicates(documents([(i, t, "a") for i, t in texts.items()]))
    assert {r["key"]: r["component"] for r in found.collect()} == expected


def test_documents_awkward(spark, awkward):
    found = near_duplicates(awkward).select("key", "n_shingles", "component").collect()
    assert len(found) == awkward.count()
    by_key = {}
    for r in found:
        by_key.setdefault(r["key"], set()).add((r["n_shingles"] > 0, r["component"]))
    assert by_key[None] == {(False, None), (True, None)}
    assert by_key[1] == {(False, 1)} and by_key[2] == {(False, 2)} and by_key[3] == {(False, 3)}
    assert by_key[5] == {(True, 5)} and by_key[6] == {(True, 5)} and by_key[9] == {(True, 8)}
    assert near_duplicates(awkward.limit(0)).count() == 0


def test_signatures_estimate_similarity():
    draw = np.random.default_rng(1)
    pool = draw.integers(0, 1 << 63, 3000, dtype=np.uint64)
    a, b = signature(pool[:2000]), signature(pool[500:2500])
    assert abs((a == b).mean() - 1500 / 2500) < 0.15
    least = least_matches(80, 100, 1e-4)
    assert list(least) == sorted(least) and least[-1] < 0.8 * HASHES and len(least) == len(BATCHES)


def test_edit_distance():
    draw = random.Random(3)
    pairs = []
    for _ in range(1500):
        a = [draw.choice("abé") for _ in range(draw.choice([0, 1, 2, 5, 9, 30, 40]))]
        b = list(a)
        for _ in range(draw.randint(0, 5)):
            at = draw.randint(0, len(b))
            what = draw.randrange(3)
            b[at : at + (what > 0)] = [] if what == 1 else [draw.choice("abé")]
        pairs.append(("".join(a), "".join(b)))
    points = [[np.frombuffer(s.encode("utf-32-le"), np.uint32) for s in side] for side in zip(*pairs)]
    for edits in (1, 2, 3):
        expected = [brute.distance(a, b) <= edits for a, b in pairs]
        assert L.within(*points, edits).tolist() == expected


def near_lines(draw, n=150):
    """Texts of lines with zero to three edits between them."""
    lines = []
    for _ in range(n // 3):
        base = [draw.choice("abcdefgh ") for _ in range(draw.choice([12, 29, 30, 31, 60]))]
        for _ in range(3):
            line = list(base)
            for _ in range(draw.randint(0, 3)):
                at, what = draw.randint(0, len(line)), draw.randrange(3)
                line[at : at + (what > 0)] = [] if what == 1 else [draw.choice("xyz")]
            lines.append("".join(line))
    draw.shuffle(lines)
    return {i: "\n".join(lines[at : at + 5]) for i, at in enumerate(range(0, len(lines), 5))}


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_lines(spark, documents, edits):
    texts = near_lines(random.Random(edits), 300)
    gone = brute.removed_lines(texts, edits, 30)
    assert gone
    found = L.repeated_lines(documents([(i, t, "a") for i, t in texts.items()]).drop("row", "key"), edits=edits)
    ids = {r["row"]: r["doc_id"] for r in documents([(i, t, "a") for i, t in texts.items()]).selectExpr("xxhash64(doc_id, text) as row", "doc_id").collect()}
    assert {ids[r["row"]]: set(r["numbers"]) for r in found.collect()} == dict(gone)


def test_many_lines_with_a_common_segment(spark, documents):
    """Lines that share a third but are far apart, and near copies among them."""
    draw = random.Random(11)
    head = "a common beginning of all lines, "
    lines = [head + "".join(draw.choice("abcdef") for _ in range(66)) for _ in range(700)]
    lines += [x[:-1] + "!" for x in lines[:40]]
    texts = dict(enumerate(lines))
    gone = brute.removed_lines(texts, 2, 30)
    found = L.remove_repeated_lines(documents([(i, t, "a") for i, t in texts.items()]))
    assert {r["doc_id"] for r in found.filter("lines_removed > 0").collect()} == set(gone)


def test_lines_query(spark, sf):
    texts = texts_of(spark, sf)
    gone = brute.removed_lines(texts, L.EDITS, L.LEAST)
    for r in QUERIES["op6_line_dedup"](spark, sf).collect():
        kept = "\n".join(x for n, x in enumerate(texts[r["doc_id"]].split("\n")) if n not in gone[r["doc_id"]])
        assert (r["n_removed"], r["kept_sha256"]) == (len(gone[r["doc_id"]]), hashlib.sha256(kept.encode()).hexdigest())


def test_lines_awkward(spark, awkward):
    found = L.remove_repeated_lines(awkward)
    assert found.columns == [*awkward.columns, "lines_removed"]
    rows = [(r["doc_id"], r["text"]) for r in found.collect()]
    assert len(rows) == awkward.count()
    assert (1, None) in rows and (2, "") in rows and (3, " \n\t ") in rows
    assert (9, "") in rows and (8, "short") in rows and (6, "") in rows
    assert L.remove_repeated_lines(awkward.limit(0)).count() == 0


def test_passages_query(spark, sf):
    texts = texts_of(spark, sf)
    expected = brute.kept_words(texts, 35)
    for r in QUERIES["op9_substring_dedup"](spark, sf).collect():
        all_words, kept = expected[r["doc_id"]]
        assert (r["n_words"], r["n_removed"]) == (len(all_words), len(all_words) - len(kept))
        assert r["kept_sha256"] == hashlib.sha256(" ".join(kept).encode()).hexdigest()


@pytest.mark.parametrize("window, gram", [(8, 3), (35, 16)])
def test_passages(spark, documents, window, gram):
    """Passages cut and joined at many places, few different words, self-overlap."""
    draw = random.Random(window)
    source = [f"w{draw.randrange(60)}" for _ in range(600)]
    texts = {}
    for i in range(60):
        parts = []
        for _ in range(draw.randint(1, 5)):
            at = draw.randrange(560)
            parts += source[at : at + draw.randint(3, 60)]
            parts += [f"u{draw.randrange(10**6)}" for _ in range(draw.randint(0, 6))]
        texts[i] = " ".join(parts)
    texts[60] = " ".join(["again"] * 90)
    expected = brute.kept_words(texts, window)
    found = remove_repeats(documents([(i, t, "a") for i, t in texts.items()]), window=window, gram=gram)
    for r in found.collect():
        all_words, kept = expected[r["key"]]
        assert (r["n_words"], r["n_removed"]) == (len(all_words), len(all_words) - len(kept)), r["key"]
        assert r["kept_sha256"] == hashlib.sha256(" ".join(kept).encode()).hexdigest()


def test_passages_awkward(spark, awkward):
    found = remove_repeats(awkward).collect()
    assert len(found) == awkward.count()
    for r in found:
        if r["key"] in (6, 7) or r["n_words"] == 60:
            assert r["n_removed"] >= 60
        if r["key"] in (1, 2, 3):
            assert (r["n_words"], r["n_removed"]) == (0, 0)
    assert remove_repeats(awkward.limit(0)).count() == 0
