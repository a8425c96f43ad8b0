"""Mixing, the quality classifier, language-model scores and the pipeline."""

import math
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from tests.llm import brute
from undertone.llm import hmm, quality
from undertone.llm import text as X
from undertone.llm.mixing import mix, source_targets, with_targets
from undertone.llm.queries import ORACLES, QUERIES


def held(i, modulus):
    return zlib.crc32(b"" if i is None else str(i).encode()) % modulus == 2


def filled(sizes, weights=(5, 2, 1), most=3):
    """Targets by sharing again and again what the limits leave over."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[n % 3] for n, s in enumerate(names)}
    total, limited = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in limited]
        left = total - sum(limited.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        above = [s for s in free if share[s] > most * sizes[s]]
        if not above:
            return {**limited, **share}
        limited |= {s: most * sizes[s] for s in above}


@pytest.mark.parametrize("seed", range(3))
def test_targets(spark, seed):
    draw = np.random.default_rng(seed)
    sizes = {None if n == 7 else f"s{n}": int(draw.integers(0, 10 ** draw.integers(1, 6))) for n in range(12)}
    found = source_targets(spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()
    expected = filled(sizes)
    assert {r["source"] for r in found} == set(sizes)
    for r in found:
        assert math.isclose(r["target"], expected[r["source"]], rel_tol=1e-9, abs_tol=1e-9)


def test_mix_query(spark, sf):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    found = QUERIES["op7_mixing"](spark, sf)
    rows = db.execute(f"SELECT {', '.join(found.columns)} FROM ({ORACLES['op7_mixing']})").fetchall()
    assert sorted(map(tuple, found.collect())) == sorted(rows)


def test_mix_rows(spark, awkward):
    taken = with_targets(awkward).collect()
    assert len(taken) == awkward.count() and all(0 <= r["mix_times"] <= 3 for r in taken)
    copies = Counter((r["doc_id"], r["text"]) for r in mix(awkward).collect())
    expected = Counter()
    for r in taken:
        expected[r["doc_id"], r["text"]] += r["mix_times"]
    assert copies == +expected
    assert mix(awkward).columns == awkward.columns
    assert mix(awkward.limit(0)).count() == 0


def test_mix_comes_near_its_targets(spark, documents):
    draw = np.random.default_rng(8)
    rows = [(i, " ".join(["w"] * int(draw.integers(5, 40))), f"s{i % 5}" if i % 3 else "s0") for i in range(6000)]
    taken = with_targets(documents(rows)).groupBy("source").agg({"mix_target": "max"}).collect()
    total = with_targets(documents(rows)).selectExpr("source", "mix_size * mix_times as t").groupBy("source").sum("t").collect()
    total = {r[0]: r[1] for r in total}
    for source, target in taken:
        assert abs(total[source] - target) < 0.06 * target


def test_mix_without_ids_comes_near_its_targets(spark, documents):
    """Null ids, and one id for a third of all rows: texts still draw apart."""
    draw = np.random.default_rng(9)
    rows = [(None if i % 3 else 7, f"d{i} " + " ".join(["w"] * int(draw.integers(5, 40))), f"s{i % 5}" if i % 3 else "s0") for i in range(6000)]
    taken = with_targets(documents(rows)).selectExpr("source", "mix_target", "mix_size * mix_times as t").groupBy("source").agg({"mix_target": "max", "t": "sum"})
    for r in taken.collect():
        assert abs(r["sum(t)"] - r["max(mix_target)"]) < 0.06 * r["max(mix_target)"]


def test_quality_query(spark, sf):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    found = QUERIES["op8_quality_classifier"](spark, sf).collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) and r["held_out"] == held(r["doc_id"], 4) for r in found)
    judged = [(r["predicted"], labels[r["doc_id"]]) for r in found if r["held_out"] and r["doc_id"] in labels]
    assert np.mean([p == y for p, y in judged]) >= 0.9


def test_quality_awkward(spark, awkward):
    labels = spark.createDataFrame([(4, 1, 0), (7, 0, 0), (5, None, 0), (8, 1, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit_quality(awkward, labels)
    found = quality.score_quality(awkward, model)
    assert found.columns == [*awkward.columns, "score"]
    assert all(0 <= r["score"] <= 1 for r in found.collect()) and found.count() == awkward.count()
    nothing = quality.fit_quality(awkward, labels.limit(0))
    assert {round(r["score"], 2) for r in quality.score_quality(awkward, nothing).collect()} == {0.5}
    assert quality.score_quality(awkward.limit(0), model).count() == 0


def test_isotonic():
    draw = np.random.default_rng(0)
    zeros, ones = draw.integers(0, 5, (2, quality.BINS)).astype(float)
    at, chance = quality.isotonic(zeros, ones)
    assert (np.diff(at) > 0).all() and (np.diff(chance) > 0).all()


def base_scores(texts):
    counts, ends = Counter(), 0
    for i, t in texts:
        if not held(i, 7):
            counts.update(brute.words(brute.lower(t)))
            ends += 1
    tokens, kinds = sum(counts.values()) + ends, len(counts) + (ends > 0)
    scores = []
    for i, t in texts:
        w = brute.words(brute.lower(t))
        score = sum(math.log10((counts[x] + 1) / (tokens + kinds + 1)) for x in w) + math.log10((ends + 1) / (tokens + kinds + 1))
        scores.append((i, held(i, 7), len(w) + 1, sum(counts[x] > 0 for x in w) + (ends > 0), tokens, score))
    return scores


def compared(found, expected):
    found = sorted(found, key=lambda r: (r["key"] is not None, r["key"], r["base_score"]))
    expected = sorted(expected, key=lambda r: (r[0] is not None, r[0], r[5]))
    for r, e in zip(found, expected, strict=True):
        assert (r["key"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == e[:5]
        assert math.isclose(r["base_score"], e[5], rel_tol=1e-9)


@pytest.mark.parametrize("frequent", [hmm.FREQUENT, 50])
def test_base_scores(spark, sf, monkeypatch, frequent):
    """With few frequent words most counts come by the join."""
    monkeypatch.setattr(hmm, "FREQUENT", frequent)
    monkeypatch.setattr(hmm, "OWN", min(hmm.OWN, frequent))
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = hmm.score_texts(docs, rounds=2).collect()
    compared(found, base_scores([(r["doc_id"], r["text"]) for r in docs.collect()]))


def test_model_beats_single_words(spark, sf):
    found = [r for r in QUERIES["op10_lm_scoring"](spark, sf).collect() if r["held_out"]]
    assert sum(r["score"] for r in found) > sum(r["base_score"] for r in found)


def test_scores_awkward(spark, awkward):
    found = hmm.score_texts(awkward, rounds=1).collect()
    compared(found, base_scores([(r["doc_id"], r["text"]) for r in awkward.collect()]))
    assert all(r["score"] < 0 for r in found)
    assert hmm.score_texts(awkward.limit(0)).count() == 0


def test_forward_is_the_sum_over_all_paths():
    draw = np.random.default_rng(3)
    chain = hmm.Chain(draw.dirichlet(np.ones(hmm.STATES)), draw.dirichlet(np.ones(hmm.STATES), hmm.STATES), draw.dirichlet(np.ones(6), hmm.STATES).T)
    sequences = [draw.integers(0, 6, n) for n in (1, 2, 5, 5, 17)]
    found = np.zeros(5)
    for chosen, grid, alive in hmm._grid(sequences):
        found[chosen] = hmm.forward(chain, grid, alive, np.broadcast_to(chain.start, (len(chosen), hmm.STATES)), False)[0]
    for s, x in zip(sequences, found):
        now = chain.start * chain.emit[s[0]]
        for c in s[1:]:
            now = (now @ chain.move) * chain.emit[c]
        assert math.isclose(x, math.log(now.sum()), rel_tol=1e-12)


def test_training_raises_the_likelihood():
    draw = np.random.default_rng(4)
    sequences = [draw.integers(0, 3, 40) + 3 * (n % 2) for n in range(30)]
    chain = hmm.Chain.begun(np.full(6, 1 / 6))
    last = -np.inf
    for _ in range(5):
        start, moves, emissions, total = hmm._expected(chain, sequences, np.ones(30, bool))
        assert total > last
        assert math.isclose(emissions.sum(), 1200) and math.isclose(moves.sum(), 30 * 39) and math.isclose(start.sum(), 30)
        last = total
        chain = hmm.Chain(start / start.sum(), moves / moves.sum(axis=1, keepdims=True), emissions / emissions.sum(axis=0))


@pytest.mark.parametrize("longest", [1, 7, 64])
def test_cuts_change_no_counts(longest):
    """Sums over pieces with values carried over the cuts are those of the whole sequences."""
    draw = np.random.default_rng(5)
    sequences = [draw.integers(0, 9, n) for n in (1, 7, 8, 64, 65, 500, 14, 3)]
    chain = hmm.Chain.begun(draw.dirichlet(np.ones(9)))
    chain.start = draw.dirichlet(np.ones(hmm.STATES))
    whole = hmm._expected(chain, sequences, np.ones(len(sequences), bool))
    pieces = hmm.cut(chain, sequences, longest)
    assert max(map(len, pieces[0])) <= longest and sum(map(len, pieces[0])) == sum(map(len, sequences))
    for found, expected in zip(hmm._expected(chain, *pieces), whole, strict=True):
        np.testing.assert_allclose(found, expected, rtol=1e-9)


def model_scores(texts, own, rounds):
    """The whole model by plain loops over uncut texts: classes, Baum-Welch with logarithms, shares of words."""
    spoken = {i: brute.words(brute.lower(t)) for i, t in texts}
    training = [i for i in spoken if not held(i, 7)]
    counts = Counter(w for i in training for w in spoken[i])
    kinds = sorted({w for words in spoken.values() for w in words})
    raw, offsets = X.buffer_of(pa.array(kinds))
    each = X.Words(raw, offsets, 0, len(kinds), lower=True)
    hashes, surface = dict(zip(kinds, each.hashes().tolist())), dict(zip(kinds, hmm.surfaces(each).tolist()))
    tokens = sum(counts.values()) + len(training)
    owned = sorted((w for w in counts if counts[w] * own > tokens), key=hashes.get)
    place = {w: n for n, w in enumerate(owned)}
    end = len(owned) + hmm.SURFACES
    kind_of = {w: place.get(w, len(owned) + surface[w]) for w in kinds}
    mass, shared = np.ones(end + 1), np.ones(end + 1)
    mass[end] += len(training)
    for w, n in counts.items():
        mass[kind_of[w]] += n
        shared[kind_of[w]] += n + 1
    prior = mass / mass.sum()
    chain = hmm.Chain.begun(prior)
    classes = {i: [kind_of[w] for w in words] + [end] for i, words in spoken.items()}

    def ahead(c):
        values = [np.log(chain.start) + np.log(chain.emit[c[0]])]
        for x in c[1:]:
            values.append(np.logaddexp.reduce(values[-1][:, None] + np.log(chain.move), axis=0) + np.log(chain.emit[x]))
        return values

    for _ in range(rounds):
        start, move, emit = np.ones(hmm.STATES), np.ones((hmm.STATES, hmm.STATES)), hmm.SMOOTH * np.repeat(prior[:, None], hmm.STATES, axis=1)
        for i in training:
            c = classes[i]
            alpha, beta = ahead(c), [np.zeros(hmm.STATES)]
            for x in c[:0:-1]:
                beta.insert(0, np.logaddexp.reduce(np.log(chain.move) + (np.log(chain.emit[x]) + beta[0])[None, :], axis=1))
            whole = np.logaddexp.reduce(alpha[-1])
            for t, x in enumerate(c):
                emit[x] += np.exp(alpha[t] + beta[t] - whole)
                if t:
                    move += np.exp(alpha[t - 1][:, None] + np.log(chain.move) + (np.log(chain.emit[x]) + beta[t])[None, :] - whole)
            start += np.exp(alpha[0] + beta[0] - whole)
        chain = hmm.Chain(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))
    scores = {}
    for i, words in spoken.items():
        within = sum(math.log10((counts[w] + 1) / shared[kind_of[w]]) for w in words if w not in place)
        scores[i] = np.logaddexp.reduce(ahead(classes[i])[-1]) / math.log(10) + within
    return scores


@pytest.mark.parametrize("frequent", [hmm.FREQUENT, 300])
def test_model_scores(spark, sf, monkeypatch, frequent):
    """``score`` as a whole, with long texts and with shares of words that come by the join."""
    monkeypatch.setattr(hmm, "FREQUENT", frequent)
    monkeypatch.setattr(hmm, "OWN", min(hmm.OWN, frequent))
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").limit(50)
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    longest = " ".join(t or "" for _, t in texts[:12])  # several times the length of a piece
    texts += [(10**9 + n, longest) for n in range(3)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    expected = model_scores(texts, hmm.OWN, 2)
    found = {r["key"]: r["score"] for r in hmm.score_texts(docs, rounds=2).collect()}
    assert found.keys() == expected.keys()
    for i, score in expected.items():
        assert math.isclose(found[i], score, rel_tol=1e-9)


def test_pipeline_stages(spark, sf):
    """Each stage against brute force on what the one before returned."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        found = stage(spark, docs, sf)
        docs = spark.createDataFrame(found.collect(), found.schema)
        kept[name] = rows = docs.collect()
        if name != "bpe":
            assert docs.columns == columns
        if name == "lines":
            gone = brute.removed_lines(before, 2, 30)
            expected = {i: "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[i]) for i, t in before.items()}
            assert {r["doc_id"]: r["text"] for r in rows} == {i: t for i, t in expected.items() if not gone[i] or brute.words(t)}
        if name == "minhash":
            _, least = brute.similar_documents(before, 5)
            assert sorted(r["doc_id"] for r in rows) == sorted(i for i in before if least[i] == i)
        if name == "mixing":
            assert {r["doc_id"] for r in rows} <= set(before)
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    stays = {r["doc_id"] for r in kept["quality"]}
    assert np.mean([(i in stays) == bool(y) for i, y in labels.items()]) > 0.95
    assert sum(r["n_tokens"] for r in kept["bpe"]) == sum(len(r["ids"]) for r in kept["bpe"]) > 0


def test_pipeline_awkward(spark, awkward, sf):
    docs = awkward
    for _, stage in corpus_pipeline.STAGES:
        found = stage(spark, docs, sf)
        assert stage(spark, docs.limit(0), sf).count() == 0
        docs = spark.createDataFrame(found.collect(), found.schema)


def test_pipeline_near_keeps_one_row_of_each_class(spark, documents, sf):
    """Classes whose documents share an id, have none, or have the least id of another class."""
    one, two, three = (" ".join(f"{w}{i}" for i in range(60)) for w in "abc")
    docs = documents([
        (5, one, "a"), (5, one + " more", "a"), (5, one, "a"), (5, two, "a"), (6, two + " more", "a"),
        (None, three, "a"), (None, three + " more", "b"), (None, three + " still more", "b"), (9, "", "a"), (None, None, "a"),
    ])
    rows = corpus_pipeline.near(spark, docs, sf).collect()
    assert sorted((r["text"] or "-")[0:2] for r in rows) == ["-", "-", "a0", "b0", "c0"]


def test_pipeline_quality_without_labels(spark, documents, awkward, tmp_path):
    spark.createDataFrame([(10**9, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.quality(spark, awkward, str(tmp_path)).count() == awkward.count()
