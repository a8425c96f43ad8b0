"""Fill-in-the-middle cuts and the rank index against plain versions."""

import hashlib
import random
import re

import numpy as np
import pytest

from undertone.llm.infill import MADE, boundaries, fill_in_middle, restored, with_boundaries
from undertone.llm.rank_index import RankIndex
from undertone.llm.queries import QUERIES


def plain_version(key, text, rate=100, spm=50, seed=7, marks=("<P>", "<S>", "<M>")):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * n : 8 * n + 8], 16) for n in range(4))
    if not text or any(m in text for m in marks) or h3 % 100 >= rate:
        return len(units), "plain", None, None, text
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    p, s, m = marks
    if h4 % 100 < spm:
        return len(units), "spm", len(prefix), len(middle), s + suffix + p + prefix + m + middle
    return len(units), "psm", len(prefix), len(middle), p + prefix + s + suffix + m + middle


@pytest.mark.parametrize("error", [1, 20, 512, 10**6])
@pytest.mark.parametrize("seed", range(3))
def test_index(seed, error):
    draw = np.random.default_rng(seed)
    steps = draw.integers(1, (3, 400, 100_000)[seed], draw.integers(1, 3000))
    offsets = np.append(0, np.cumsum(np.where(draw.random(len(steps)) < 0.01, steps * 50, steps)))
    index = RankIndex.fit(offsets, error)
    every = np.arange(len(offsets))
    assert np.abs(index.predict(every) - offsets).max() <= error + 1
    assert index.locate(every).tolist() == offsets.tolist()
    assert len(index.ranks) < len(offsets)
    even = RankIndex.fit(np.arange(0, 7000, 7), error)
    assert len(even.ranks) == 1 and not even.residuals.astype(int)[[0, -1]].any()


def test_boundaries():
    for text, expected in [("", [0]), ("a", [0, 1]), ("\n", [0, 1]), ("a\n\nb", [0, 2, 3, 4]), ("a\n", [0, 2])]:
        assert boundaries(np.frombuffer(text.encode(), np.uint8)).tolist() == expected


@pytest.mark.parametrize("options", [{}, {"rate": 40, "spm": 90, "seed": 3}, {"marks": ("<a|", "<b|", "<c|"), "spm": 0}])
def test_texts(spark, documents, options):
    draw = random.Random(len(options))
    parts = ["a", "é", "日", "😀", " ", "\n", "\n\n", "<", "<P", "P>", "line\n", "x" * 90 + "\n", "\r\n", "\x00", "\x85", "<b|"]
    texts = {i: "".join(draw.choice(parts) for _ in range(draw.choice([0, 1, 2, 5, 30, 200]))) for i in range(300)}
    texts |= {300: "has <M> in it", 301: "<S>", 302: "<P", 303: "\n" * 700, 304: "long\n" * 40_000 + "end"}
    docs = documents([(i, t, "a") for i, t in texts.items()])
    made = fill_in_middle(docs, **options)
    found = made.withColumn("back", restored(made.fim_form, made.fim_text, options.get("marks", ("<P>", "<S>", "<M>"))))
    rows = found.collect()
    for r in rows:
        assert tuple(r[c] for c in MADE) == plain_version(r["doc_id"], texts[r["doc_id"]], **options)
        assert r["back"] == texts[r["doc_id"]] == r["text"]
    assert {r["fim_form"] for r in rows} == {"plain", "psm"} | ({"spm"} if options.get("spm", 1) else set())


def test_kept_index(spark, awkward):
    held = with_boundaries(awkward, error=30)
    assert held.columns == [*awkward.columns, "boundaries"]
    for seed in (7, 8):
        a = fill_in_middle(held, seed=seed, index="boundaries", error=30).drop("boundaries").collect()
        assert sorted(map(str, a)) == sorted(map(str, fill_in_middle(awkward, seed=seed).collect()))


def test_awkward(spark, awkward):
    clashing = awkward.selectExpr("*", "'mine' as fim_form", "1 as h1", "2 as doc", "3 as held", "4 as index")
    found = fill_in_middle(clashing)
    assert found.columns == [c for c in clashing.columns if c != "fim_form"] + list(MADE)
    rows = found.collect()
    assert len(rows) == awkward.count()
    for r in rows:
        assert tuple(r[c] for c in MADE) == plain_version(r["doc_id"], r["text"]) and (r["h1"], r["held"], r["doc"]) == (1, 3, 2)
    assert {r["text"] for r in rows if r["doc_id"] == 1} == {None}
    assert fill_in_middle(awkward.limit(0)).count() == 0 and with_boundaries(awkward.limit(0)).count() == 0


def test_query(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in QUERIES["op11_fill_in_middle"](spark, sf).collect():
        n, form, prefix, middle, made = plain_version(r["doc_id"], texts[r["doc_id"]])
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"]) == (n, form, prefix, middle)
        assert r["output_sha256"] == hashlib.sha256(made.encode()).hexdigest()
        assert r["restored_sha256"] == hashlib.sha256((texts[r["doc_id"]] or "").encode()).hexdigest()
