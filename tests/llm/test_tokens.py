"""BPE encoding and decoding, and the token files, against the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from undertone.llm import bpe, token_store
from undertone.llm.queries import QUERIES
from undertone.session import shared_folder

PARTS = ["'s", "'t", "'re", "'", "''", " ", "  ", "\n", "\t", " ", "　", "a", "aaaa", "é", "日本", "123", "٣", "½", "!", "!!",
         "<|endoftext|>", "don't", "I'll", "'d", " 'tis", "😀", "​", "x'm", "  \n  ", "́", "ll", "\x00", "\x85", " "]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path(bpe.VOCABULARY))


def encoded(texts, encoder):
    raw = [t.encode() for t in texts]
    ids, bounds = encoder.encode(np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum(list(map(len, raw)))))
    return [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])]


@pytest.mark.parametrize("make", [bpe.encoder, token_store.library_encoder])
def test_random_texts(library, make):
    draw = random.Random(5)
    texts = ["".join(draw.choice(PARTS) for _ in range(draw.randint(0, 14))) for _ in range(3000)]
    texts += ["", "a" * 5000, " " * 80, "<|endoftext|>", "x<|endoftext|><|endoftext|> y"]
    encoder = make(public_tokenizers.path(bpe.VOCABULARY))
    for at in range(0, len(texts), 100):
        part = texts[at : at + 100]
        for text, ids in zip(part, encoded(part, encoder)):
            assert ids == library.encode(text, add_special_tokens=False).ids, text
            assert bpe.decode_ids(encoder.v, ids) == library.decode(ids, skip_special_tokens=False)


def test_decoding_broken_bytes(library):
    ids = library.encode("é日", add_special_tokens=False).ids
    v = bpe.vocabulary(public_tokenizers.path(bpe.VOCABULARY))
    assert bpe.decode_ids(v, ids[:1] + ids[-1:]) == library.decode(ids[:1] + ids[-1:], skip_special_tokens=False)


def test_encode_and_decode_columns(spark, awkward, library):
    found = bpe.bpe_decode(bpe.bpe_encode(awkward)).collect()
    assert len(found) == awkward.count()
    for r in found:
        assert r["ids"] == library.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["decoded"] == (r["text"] or "")
    assert bpe.bpe_encode(awkward.limit(0)).count() == 0


def test_query_op1(spark, sf, library):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    found = {r["doc_id"]: r for r in QUERIES["op1_bpe_round_trip"](spark, sf).collect()}
    assert found.keys() == texts.keys()
    for i, text in texts.items():
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert found[i]["n_tokens"] == len(ids)
        assert found[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert found[i]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()


def test_query_op4(spark, sf, library):
    start = 0
    rows = sorted(spark.read.parquet(f"{sf}/documents.parquet").collect(), key=lambda r: r["doc_id"])
    found = {r["doc_id"]: r for r in QUERIES["op4_token_files"](spark, sf).collect()}
    for r in rows:
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids + [2]
        expected = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        assert tuple(found[r["doc_id"]][c] for c in ("start", "n_tokens", "ids_crc32")) == expected
        start += len(ids)


def test_token_files(spark, awkward, library):
    folder = f"{shared_folder(spark)}/token-test-{random.getrandbits(60)}"
    token_store.write_tokens(awkward, folder)
    rows = token_store.checksums(spark, folder).orderBy("start").collect()
    assert [r["doc_id"] for r in rows] == [None, None, 1, 2, 3, 4, 5, 5, 5, 6, 7, 8, 9]
    assert [r["start"] for r in rows] == np.append(0, np.cumsum([r["n_tokens"] for r in rows])[:-1]).tolist()
    some = token_store.read_tokens(spark, folder, 5, 6)
    assert sorted(r["doc_id"] for r in some.collect()) == [5, 5, 5, 6]
    assert "PushedFilters: [IsNotNull(doc_id), GreaterThanOrEqual(doc_id,5)" in some._jdf.queryExecution().toString()
    assert "ids" not in token_store.read_metadata(spark, folder).columns
    path = token_store.read_tokens(spark, folder).inputFiles()[0].removeprefix("file://")
    columns = {c["path_in_schema"]: c for c in pq.ParquetFile(path).metadata.row_group(0).to_dict()["columns"]}
    assert "RLE_DICTIONARY" in columns["ids.list.element"]["encodings"]
    assert "DELTA_BINARY_PACKED" in columns["before"]["encodings"]
    token_store.write_tokens(awkward.limit(0), folder + "-none")
    assert token_store.checksums(spark, folder + "-none").count() == 0
