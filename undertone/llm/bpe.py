"""Byte-level BPE encoding and decoding.

Texts are split into pieces (see ``pretokens``). The distinct new pieces of a
batch are laid out as one array of symbols with an index from each pair to all
its positions. Active ranks are applied in ascending order, each to all its
positions at once; the merges update the neighbours and add the new pairs'
positions to their lists. Encoded pieces are kept per worker, at most
``KEPT_PIECES`` of them, after which the store starts afresh.

Texts are encoded whole; a null text is an empty one and has no ids.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undertone.llm import text as X
from undertone.llm.pretokens import pieces
from undertone.llm.tasks import KEPT, map_arrow

VOCABULARY = "byte_bpe_50k.json"
KEPT_PIECES = 800_000
NONE = np.iinfo(np.int32).max


def byte_characters() -> dict[int, str]:
    """The character that stands for each byte in the vocabulary file: itself where printable, else from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Vocabulary:
    """Ids, byte strings and merges of a byte-level BPE file."""

    def __init__(self, path: str):
        described = json.loads(open(path, encoding="utf-8").read())
        model = described["model"]
        letters = byte_characters()
        bytes_of = {c: b for b, c in letters.items()}
        ids: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in described.get("added_tokens", [])}
        size = 1 + max([*ids.values(), *self.special.values()])
        self.token_bytes = [b""] * size
        for token, i in ids.items():
            self.token_bytes[i] = bytes(bytes_of[c] for c in token)
        for token, i in self.special.items():
            self.token_bytes[i] = token.encode()
        self.decimal = [str(i) for i in range(size)]
        self.of_byte = np.array([ids[letters[b]] for b in range(256)], np.int32)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.left = np.array([ids[a] for a, _ in merges], np.int64)
        self.right = np.array([ids[b] for _, b in merges], np.int64)
        self.made = np.array([ids[a + b] for a, b in merges], np.int32)
        codes = self.left << 32 | self.right
        order = np.argsort(codes, kind="stable")
        self.codes, self.rank_of_code = codes[order], order.astype(np.int32)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merge rank of each pair, NONE where there is none."""
        codes = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        return np.where(self.codes[at] == codes, self.rank_of_code[at], NONE)


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def merge_pieces(v: Vocabulary, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all pieces, number of ids of each piece); ``data`` holds the pieces back to back."""
    n = len(data)
    symbol = np.append(v.of_byte[data], -1)
    following = np.arange(1, n + 2)
    before = np.arange(-1, n)
    piece_last = np.append(starts[1:], n) - 1
    following[piece_last] = n
    before[starts] = n  # n is a stop: its symbol is -1 and it belongs to no pair
    index = _positions(v.ranks(symbol[:n], symbol[following[:n]]), np.arange(n))
    active = list(index)
    heapq.heapify(active)
    while active:
        rank = heapq.heappop(active)
        lists = index.pop(rank)
        at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
        a, b = v.left[rank], v.right[rank]
        at = at[(symbol[at] == a) & (symbol[following[at]] == b)]
        if a == b and len(at) > 1:
            at = _leftmost(at, following)
        if not len(at):
            continue
        gone = following[at]
        beyond = following[gone]
        symbol[at] = v.made[rank]
        symbol[gone] = -1
        following[at] = beyond
        before[beyond] = at
        before[n] = n
        left = before[at]
        places = np.concatenate([left[left < n], at[beyond < n]])
        if len(places):
            found = v.ranks(symbol[places], symbol[following[places]])
            for r, more in _positions(found, places).items():
                if r in index:
                    index[r].extend(more)
                else:
                    index[r] = more
                    heapq.heappush(active, r)
    kept = symbol[:n] >= 0
    counts = np.add.reduceat(kept, starts) if len(starts) else np.zeros(0, np.int64)
    return symbol[:n][kept], counts.astype(np.int64)


def _positions(ranks: np.ndarray, places: np.ndarray) -> dict[int, list[np.ndarray]]:
    """The places of each rank, ascending, each once."""
    real = ranks != NONE
    ranks, places = ranks[real], places[real]
    if not len(ranks):
        return {}
    order = np.lexsort((places, ranks))
    ranks, places = ranks[order], places[order]
    fresh = np.append(True, (ranks[1:] != ranks[:-1]) | (places[1:] != places[:-1]))
    ranks, places = ranks[fresh], places[fresh]
    cut = np.flatnonzero(np.append(True, ranks[1:] != ranks[:-1]))
    return {int(r): [p] for r, p in zip(ranks[cut], np.split(places, cut[1:]))}


def _leftmost(at: np.ndarray, following: np.ndarray) -> np.ndarray:
    """Of places whose pairs overlap, every second one from the left."""
    linked = np.append(False, following[at[:-1]] == at[1:])
    number = np.arange(len(at))
    begin = np.maximum.accumulate(np.where(linked, 0, number))
    return at[(number - begin) % 2 == 0]


class Encoder:
    """Encodes buffers of texts; remembers the pieces it has met."""

    def __init__(self, path: str, encode_new=None):
        self.v = vocabulary(path)
        self.encode_new = encode_new or (lambda data, starts: merge_pieces(self.v, data, starts))
        self.special = {s.encode(): i for s, i in self.v.special.items()}
        self._forget()

    def _forget(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.number = np.zeros(0, np.int64)
        self.first = np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.int32)
        self.bytes = np.zeros(0, np.uint8)
        self.cut = np.zeros(1, np.int64)

    def _learn(self, data, starts, ends, hashes) -> None:
        lengths = ends - starts
        flat = data[X.ranges(starts, lengths)]
        ids, counts = self.encode_new(flat, np.cumsum(lengths) - lengths)
        at = len(self.first) - 1
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(counts)])
        self.ids = np.concatenate([self.ids, ids.astype(np.int32)])
        self.bytes = np.concatenate([self.bytes, flat])
        self.cut = np.concatenate([self.cut, self.cut[-1] + np.cumsum(lengths)])
        known = np.concatenate([self.known, hashes])
        number = np.concatenate([self.number, np.arange(at, at + len(hashes))])
        order = np.argsort(known)
        self.known, self.number = known[order], number[order]

    def encode(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all documents, offsets of the documents in them)."""
        marked = self._marked(data, bounds)
        if marked is not None:
            return marked
        starts, first = pieces(data, bounds)
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(bounds), np.int64)
        ends = np.append(starts[1:], len(data))
        hashes = X.byte_hashes(data, starts, ends)
        distinct, one, which = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.known) + len(distinct) > KEPT_PIECES:
            self._forget()
        new = self._missing(distinct)
        if len(new):
            self._learn(data, starts[one[new]], ends[one[new]], distinct[new])
        entry = self.number[np.searchsorted(self.known, distinct)]
        if self._same(data, ends - starts, entry[which]):
            begin, count = self.first[entry], np.diff(self.first)[entry]
            counts = count[which]
            ids = self.ids[X.ranges(begin[which], counts)]
        else:
            ids, counts = self.encode_new(data, starts)  # two pieces share a hash
        sums = np.append(0, np.cumsum(counts))
        return ids, sums[first]

    def _same(self, data: np.ndarray, lengths: np.ndarray, entry: np.ndarray) -> bool:
        """Whether the pieces, back to back in ``data``, are byte for byte those of their entries."""
        begin = self.cut[entry]
        return np.array_equal(self.cut[entry + 1] - begin, lengths) and np.array_equal(self.bytes[X.ranges(begin, lengths)], data)

    def _missing(self, distinct: np.ndarray) -> np.ndarray:
        if not len(self.known):
            return np.arange(len(distinct))
        at = np.minimum(np.searchsorted(self.known, distinct), len(self.known) - 1)
        return np.flatnonzero(self.known[at] != distinct)

    def _marked(self, data, bounds):
        """Texts that hold the string of a special token: what lies between is encoded on its own."""
        raw = data.tobytes()
        if not any(s in raw for s in self.special):
            return None
        ids, offsets = [], [0]
        for a, b in zip(bounds[:-1], bounds[1:]):
            mine = []
            rest = raw[a:b]
            while rest:
                places = [(p, -len(s), s) for s in self.special if (p := rest.find(s)) >= 0]
                cut, _, mark = min(places, default=(len(rest), 0, b""))
                if cut:
                    part = np.frombuffer(rest[:cut], np.uint8)
                    mine.append(self.encode(part, np.array([0, cut]))[0])
                if mark:
                    mine.append(np.array([self.special[mark]], np.int32))
                rest = rest[cut + len(mark) :]
            flat = np.concatenate(mine) if mine else np.zeros(0, np.int32)
            ids.append(flat)
            offsets.append(offsets[-1] + len(flat))
        return np.concatenate(ids) if ids else np.zeros(0, np.int32), np.array(offsets)


def encoder(path: str) -> Encoder:
    """This worker's encoder for a vocabulary."""
    if ("bpe", path) not in KEPT:
        KEPT["bpe", path] = Encoder(path)
    return KEPT["bpe", path]


def encoded_runs(column: pa.Array, enc: Encoder):
    """(first row, ids, offsets) for runs of the texts of a column."""
    raw, offsets = X.buffer_of(column)
    for i, j in X.chunks(offsets, 4 * X.CHUNK):
        data = raw[offsets[i] : offsets[j]]
        ids, bounds = enc.encode(data, offsets[i : j + 1] - offsets[i])
        yield i, ids, bounds


def decode_ids(v: Vocabulary, ids: list[int]) -> str:
    """The text of the ids; bytes that are not UTF-8 become U+FFFD."""
    return b"".join(map(v.token_bytes.__getitem__, ids)).decode("utf-8", errors="replace")


def bpe_encode(docs: DataFrame, text: str = "text", out: str = "ids", path: str | None = None) -> DataFrame:
    """``docs`` with the array column ``out`` of the token ids of ``text``; all other columns and rows stay."""
    path = path or public_tokenizers.path(VOCABULARY)
    schema = docs.withColumn(out, F.expr("cast(array() as array<int>)")).schema
    names = schema.names

    def run(batches):
        enc = encoder(path)
        for batch in batches:
            ids, offsets = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)]
            for _, part, bounds in encoded_runs(batch.column(text), enc):
                ids.append(part)
                offsets.append(bounds[1:] + offsets[-1][-1])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(offsets), pa.int32()), pa.array(np.concatenate(ids), pa.int32()))
            columns = [lists if name == out else batch.column(name) for name in names]
            yield pa.RecordBatch.from_arrays(columns, names)

    return map_arrow(docs.withColumn(text, F.col(text).cast("string")), run, schema, keeps="bpe")


def bpe_decode(tokens: DataFrame, ids: str = "ids", out: str = "decoded", path: str | None = None) -> DataFrame:
    """``tokens`` with the text ``out`` of the array column ``ids``; null ids give null."""
    path = path or public_tokenizers.path(VOCABULARY)
    schema = tokens.withColumn(out, F.lit(None).cast("string")).schema
    names = schema.names

    def run(batches):
        v = vocabulary(path)
        for batch in batches:
            texts = [None if x is None else decode_ids(v, x) for x in batch.column(ids).to_pylist()]
            columns = [pa.array(texts, pa.string()) if name == out else batch.column(name) for name in names]
            yield pa.RecordBatch.from_arrays(columns, names)

    return map_arrow(tokens, run, schema, keeps="bpe")


def bpe_round_trip(docs: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """``docs`` without ``text``, with n_tokens, ids_sha256 and decoded_sha256.

    Encodes, decodes the ids again, and keeps digests only, all in one pass over the texts.
    """
    path = path or public_tokenizers.path(VOCABULARY)
    rest = docs.drop(text)
    schema = (
        rest.withColumn("n_tokens", F.lit(0).cast("long"))
        .withColumn("ids_sha256", F.lit("")).withColumn("decoded_sha256", F.lit(""))
    ).schema
    names = schema.names

    def run(batches):
        enc = encoder(path)
        v = enc.v
        for batch in batches:
            counts, of_ids, of_text = [], [], []
            for _, ids, bounds in encoded_runs(batch.column(text), enc):
                for a, b in zip(bounds[:-1], bounds[1:]):
                    mine = ids[a:b].tolist()
                    counts.append(len(mine))
                    of_ids.append(hashlib.sha256(",".join(map(v.decimal.__getitem__, mine)).encode()).hexdigest())
                    of_text.append(hashlib.sha256(decode_ids(v, mine).encode()).hexdigest())
            made = {"n_tokens": pa.array(counts, pa.int64()), "ids_sha256": pa.array(of_ids, pa.string()),
                    "decoded_sha256": pa.array(of_text, pa.string())}
            yield pa.RecordBatch.from_arrays(
                [made[name] if name in made else batch.column(name) for name in names], names
            )

    return map_arrow(docs.withColumn(text, F.col(text).cast("string")), run, schema, keeps="bpe")
