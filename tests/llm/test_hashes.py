"""Regular patterns must not make different words, lines or passages look alike."""

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.llm import brute
from undertone.llm import bpe, token_store
from undertone.llm import lines as L
from undertone.llm import text as X
from undertone.llm.minhash import near_duplicates
from undertone.llm.rlz import remove_repeats


def morse(n, zero, one, flip=0):
    """The Thue-Morse word of ``n`` letters, or its complement: sums of powers modulo 2**64 can't tell them apart."""
    return "".join((zero, one)[(bin(i).count("1") + flip) % 2] for i in range(n))


PAIRS = [(morse(n, "a", "b"), morse(n, "a", "b", 1)) for n in (1024, 2048)]


@pytest.mark.parametrize("make", [bpe.encoder, token_store.library_encoder])
def test_pieces(make):
    library = Tokenizer.from_file(public_tokenizers.path(bpe.VOCABULARY))
    draw = random.Random(2)
    texts = [w for pair in PAIRS for w in pair] + ["".join(draw.choice("ab") for _ in range(n)) for n in (127, 128, 129, 5000, 200_000)]
    raw = [t.encode() for t in texts]
    ids, bounds = make(public_tokenizers.path(bpe.VOCABULARY)).encode(
        np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum(list(map(len, raw))))
    )
    for n, text in enumerate(texts):
        assert ids[bounds[n] : bounds[n + 1]].tolist() == library.encode(text, add_special_tokens=False).ids


def test_pieces_that_share_a_hash(monkeypatch):
    """Even then the ids are right, for the bytes are compared."""
    monkeypatch.setattr(X, "byte_hashes", lambda data, starts, ends: (ends - starts).astype(np.uint64))
    library = Tokenizer.from_file(public_tokenizers.path(bpe.VOCABULARY))
    text = "one two six ten the fox"
    encoder = bpe.Encoder(public_tokenizers.path(bpe.VOCABULARY))
    for _ in range(2):
        ids, _ = encoder.encode(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]))
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids


def test_spans():
    draw = np.random.default_rng(4)
    data = draw.integers(97, 99, 4000, dtype=np.uint8)
    starts = draw.integers(0, 4000, 3000)
    ends = np.minimum(4000, starts + draw.integers(0, 200, 3000))
    raw = data.tobytes()
    names = {}
    for h, a, b in zip(X.byte_hashes(data, starts, ends).tolist(), starts, ends):
        assert names.setdefault(raw[a:b], h) == h
    assert len(set(names.values())) == len(names)
    values = X.mix(draw.integers(0, 3, 500).astype(np.uint64))
    for k in (1, 2, 3, 4, 16, 35, 64):
        found = X.window_hashes(values, k)
        windows = {tuple(values[i : i + k]): h for i, h in enumerate(found)}
        assert len(found) == 501 - k and len(set(windows.values())) == len(windows) == len(set(found))
    assert len(X.window_hashes(values, 501)) == 0


@pytest.mark.parametrize("pair", PAIRS)
def test_documents_lines_and_passages(spark, documents, pair):
    rest = " ".join(f"w{i}" for i in range(34))
    words = [" ".join(morse(40, "x", "y", flip)) for flip in (0, 1)]
    texts = {i: f"{w}\n{rest}{i} {w} end{i}\n{m}" for i, (w, m) in enumerate(zip(pair, words))}
    docs = documents([(i, t, "a") for i, t in texts.items()])
    _, expected = brute.similar_documents(texts, 5)
    assert {r["key"]: r["component"] for r in near_duplicates(docs).collect()} == expected == {0: 0, 1: 1}
    lone = documents([(i, w, "a") for i, w in enumerate(pair)])
    assert {r["component"] for r in near_duplicates(lone).collect()} == {0, 1}
    gone = brute.removed_lines(texts, 2, 30)
    assert {r["doc_id"]: r["lines_removed"] for r in L.remove_repeated_lines(docs).collect()} == {i: len(gone[i]) for i in texts}
    kept = brute.kept_words(texts, 35)
    assert {r["key"]: r["n_removed"] for r in remove_repeats(docs).collect()} == {i: len(a) - len(b) for i, (a, b) in kept.items()}


@pytest.mark.parametrize("window, gram", [(4, 16), (100, 16)])
def test_any_window(spark, documents, window, gram):
    """A gram longer than the window, and a window far longer than the gram."""
    base = [f"w{i % 211}" for i in range(300)]
    texts = {0: " ".join(base), 1: " ".join(base[40:190]), 2: "a b c d e"}
    kept = brute.kept_words(texts, window)
    found = remove_repeats(documents([(i, t, "a") for i, t in texts.items()]), window=window, gram=gram)
    assert {r["key"]: r["n_removed"] for r in found.collect()} == {i: len(a) - len(b) for i, (a, b) in kept.items()}
