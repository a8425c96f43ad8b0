"""Scoring texts with a hidden Markov language model.

A frequent word is a class of its own; all others share classes by their first
and last letters and length. Latent states emit classes, and a word has a
smoothed share of its class. Baum-Welch counts are summed over partitions; the
scaled forward recursion then gives the exact likelihood of each text's class
sequence, and the shares of the words complete it.

Bounds: at most ``OWN`` words are classes of their own and at most ``FREQUENT``
words (each with more than 1 / FREQUENT of all tokens) have their counts
broadcast. The counts of all other words, however many, are joined. All
training documents take part in every step.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undertone.llm import text as X
from undertone.llm.quality import held_out
from undertone.llm.tasks import map_arrow, sum_vectors
from undertone.session import settle

STATES = 8
OWN = 8192
SURFACES = 2048
FREQUENT = 1_000_000
ROUNDS = 6
SEGMENT = 512
TOGETHER = 200_000
SMOOTH = 50.0
LOG10 = np.log(10.0)


def surfaces(words: X.Words) -> np.ndarray:
    """A class for each word from its first two and last three bytes and its length."""
    data, starts, ends = words.data.astype(np.uint64), words.starts, words.ends
    length = np.minimum(ends - starts, 15).astype(np.uint64)

    def byte(at: np.ndarray) -> np.ndarray:
        return data[np.clip(at, starts, ends - 1)] if len(at) else np.zeros(0, np.uint64)

    value = byte(ends - 1) | byte(ends - 2) << np.uint64(8) | byte(ends - 3) << np.uint64(16)
    value |= byte(starts) << np.uint64(24) | byte(starts + 1) << np.uint64(32) | (length // np.uint64(3)) << np.uint64(40)
    return (X.mix(value) % np.uint64(SURFACES)).astype(np.int64)


def _runs(column: pa.Array):
    raw, offsets = X.buffer_of(column)
    for i, j in X.chunks(offsets):
        yield i, j, X.Words(raw, offsets, i, j, lower=True)


def _word_counts(batches):
    """(word, surface, n) of each partition, pooled in the task up to a bound."""
    kept: list[tuple[np.ndarray, ...]] = []

    def pooled():
        word, surface, n = (np.concatenate(x) for x in zip(*kept))
        distinct, first, place = np.unique(word, return_index=True, return_inverse=True)
        return distinct, surface[first], np.bincount(place, weights=n).astype(np.int64)

    def batch_of(found):
        return pa.RecordBatch.from_arrays([X.signed(found[0]), pa.array(found[1]), pa.array(found[2])], ["word", "surface", "n"])

    size = 0
    for batch in batches:
        for _, _, words in _runs(batch.column("text")):
            distinct, first, n = np.unique(words.hashes(), return_index=True, return_counts=True)
            kept.append((distinct, surfaces(words)[first], n))
            size += len(distinct)
            if size > 2_000_000:
                kept = [pooled()]
                size = len(kept[0][0])
                if size > 1_000_000:
                    yield batch_of(kept[0])
                    kept, size = [], 0
    if kept:
        yield batch_of(pooled())


@dataclass
class Lexicon:
    """What the tasks know of the words: the frequent ones, sorted by hash, and sums of the rest."""

    words: np.ndarray  # hashes of the frequent words
    counts: np.ndarray
    classes: np.ndarray  # class of each, -1: that of its surface
    share: np.ndarray  # log10 of the sum of (count + 1) in each class, + 1 for unseen words; 0 for words of their own
    prior: np.ndarray  # smoothed shares of the classes in all tokens
    tokens: int  # training tokens, ends included
    kinds: int  # distinct training tokens
    ends: int

    @property
    def end(self) -> int:
        return len(self.prior) - 1

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each word among the frequent ones, -1 if it is none."""
        if not len(self.words):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return np.where(self.words[at] == hashes, at, -1)


def _lexicon(counts: DataFrame, ends: int) -> Lexicon:
    total = counts.agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).first()
    words, kinds = int(total["n"] or 0), int(total["kinds"])
    tokens = words + ends
    frequent = counts.filter(F.col("n") * FREQUENT > tokens).select("word", "n").toPandas()
    word, n = frequent["word"].to_numpy(np.int64).view(np.uint64), frequent["n"].to_numpy(np.int64)
    order = np.argsort(word)
    word, n = word[order], n[order]
    own = n * OWN > tokens
    classes = np.where(own, np.cumsum(own) - 1, -1)
    n_own = int(own.sum())
    floor = tokens // OWN  # a word is its own class iff n > floor
    shared = counts.filter(F.col("n") <= floor).groupBy("surface").agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).collect()
    n_shared, kinds_shared = np.zeros(SURFACES), np.zeros(SURFACES)
    for r in shared:
        n_shared[r["surface"]], kinds_shared[r["surface"]] = r["n"], r["kinds"]
    mass = np.concatenate([n[own], n_shared, [ends]]).astype(np.float64) + 1
    share = np.concatenate([np.zeros(n_own), np.log10(n_shared + kinds_shared + 1), [0.0]])
    return Lexicon(word, n, classes, share, mass / mass.sum(), tokens, kinds + (1 if ends else 0), ends)


def _encoded(docs: DataFrame, lexicon) -> DataFrame:
    """(row, key, held_out, n_tokens, n_frequent, logs, classes): sums of log10(count + 1) of frequent words, and classes."""

    def run(batches):
        lex = lexicon.value
        n_own = lex.end - SURFACES
        for batch in batches:
            tokens, frequent, logs, shares, sequences = [], [], [], [], []
            for i, j, words in _runs(batch.column("text")):
                distinct, first, place = np.unique(words.hashes(), return_index=True, return_inverse=True)
                at = lex.find(distinct)
                known = at >= 0
                log = np.where(known, np.log10(lex.counts[at] + 1.0) if len(lex.counts) else 0.0, 0.0)
                kind = np.where(known, lex.classes[at] if len(lex.classes) else -1, -1)
                kind = np.where(kind >= 0, kind, n_own + surfaces(words)[first])
                inside = np.where(kind >= n_own, log - lex.share[kind], 0.0)  # the known part of a word's share of its class
                kinds = kind[place].astype("<u2")
                sums = [np.append(0, np.cumsum(x[place])) for x in (known.astype(np.int64), log, inside)]
                a, b = words.first[:-1], words.first[1:]
                tokens.append(b - a + 1)
                for values, s in zip((frequent, logs, shares), sums):
                    values.append(s[b] - s[a])
                sequences += [kinds[s:e].tobytes() for s, e in zip(a.tolist(), b.tolist())]
            flat = [np.concatenate(x) if x else np.zeros(0) for x in (tokens, frequent, logs, shares)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("key"), batch.column("held_out"), pa.array(flat[0].astype(np.int64)),
                 pa.array(flat[1].astype(np.int64)), pa.array(flat[2].astype(np.float64)), pa.array(flat[3].astype(np.float64)),
                 X.binaries(sequences)],
                ["row", "key", "held_out", "n_tokens", "n_frequent", "logs", "shares", "classes"],
            )

    return map_arrow(docs, run, "row long, key long, held_out boolean, n_tokens long, n_frequent long, logs double, shares double, classes binary")


def _rare(docs: DataFrame, lexicon) -> DataFrame:
    """(row, word, n) for the words of each document that are not frequent."""

    def run(batches):
        lex = lexicon.value
        for batch in batches:
            rows = batch.column("row").to_numpy(zero_copy_only=False)
            for i, j, words in _runs(batch.column("text")):
                distinct, place = np.unique(words.hashes(), return_inverse=True)
                rare = lex.find(distinct) < 0
                chosen = rare[place]
                pair, n = np.unique(words.documents()[chosen] * len(distinct) + place[chosen], return_counts=True)
                document, word = pair // max(1, len(distinct)), pair % max(1, len(distinct))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows[i + document], pa.int64()), X.signed(distinct[word]), pa.array(n.astype(np.int32))], ["row", "word", "n"]
                )

    return map_arrow(docs.select("row", "text"), run, "row long, word long, n int")


@dataclass
class Chain:
    """Start and transition chances, and emissions as one row per class."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray

    @staticmethod
    def begun(prior: np.ndarray) -> Chain:
        """A first guess: sticky states whose emissions differ from the prior by seeded noise."""
        noise = np.exp(np.random.default_rng(977).normal(0, 1, (len(prior), STATES)))
        emit = prior[:, None] * noise
        return Chain(
            np.full(STATES, 1 / STATES), np.full((STATES, STATES), 0.1 / STATES) + 0.9 * np.eye(STATES), emit / emit.sum(axis=0)
        )


def _grid(sequences: list[np.ndarray]):
    """(numbers of the sequences, class grid, sequences alive at each step) in groups of similar length, longest first."""
    order = sorted(range(len(sequences)), key=lambda s: -len(sequences[s]))
    at = 0
    while at < len(order):
        longest = len(sequences[order[at]])
        chosen = order[at : at + max(1, TOGETHER // longest)]
        at += len(chosen)
        lengths = np.array([len(sequences[s]) for s in chosen])
        grid = np.zeros((len(chosen), longest), np.int64)
        for r, s in enumerate(chosen):
            grid[r, : lengths[r]] = sequences[s]
        alive = (lengths[None, :] > np.arange(longest)[:, None]).sum(axis=1)
        yield chosen, np.ascontiguousarray(grid.T), alive


def forward(chain: Chain, grid: np.ndarray, alive: np.ndarray, start: np.ndarray, keep: bool):
    """(log likelihoods, scaled forward values, scales); the values of all steps only if ``keep``."""
    steps, many = grid.shape
    logs = np.zeros(many)
    values = np.empty((steps, many, STATES)) if keep else None
    scales = np.ones((steps, many)) if keep else None
    now = start
    for t in range(steps):
        n = alive[t]
        now = (now[:n] if t == 0 else now[:n] @ chain.move) * chain.emit[grid[t, :n]]
        scale = now.sum(axis=1)
        now /= scale[:, None]
        logs[:n] += np.log(scale)
        if keep:
            values[t, :n] = now
            scales[t, :n] = scale
    return logs, values, scales


def _carried(move: np.ndarray, emit: np.ndarray, pieces: list[np.ndarray], begun: np.ndarray) -> np.ndarray:
    """The rows of ``begun`` carried through each piece: (piece, row, state), up to a factor for each piece."""
    found = np.empty((len(pieces), *begun.shape))
    rows = len(begun)
    for chosen, grid, alive in _grid(pieces):
        now = begun * emit[grid[0]][:, None, :]
        for t in range(1, len(grid)):
            n = alive[t]
            step = (now[:n].reshape(-1, STATES) @ move).reshape(n, rows, STATES)
            step *= emit[grid[t, :n]][:, None, :]
            if t % 8 == 0:  # eight chances multiply to far more than the least double
                step /= step.sum(axis=(1, 2), keepdims=True)
            now[:n] = step
        found[chosen] = now / now.sum(axis=(1, 2), keepdims=True)
    return found


def cut(chain: Chain, sequences: list[np.ndarray], longest: int = SEGMENT):
    """(pieces, firsts, befores, exits): the sequences in pieces, and what is known at each cut.

    ``befores`` are the scaled forward values of the token before a piece, ``exits`` the backward
    values after its last token, up to a factor. Both come from the whole sequence, so counts
    over the pieces are those of the sequences uncut, with memory for a few pieces only.
    First pieces carry one vector forward, last ones one backward, those between a matrix.
    """
    pieces, firsts = [], []
    for s in sequences:
        for at in range(0, len(s), longest):
            pieces.append(s[at : at + longest])
            firsts.append(at == 0)
    firsts = np.array(firsts, bool)
    lasts = np.append(firsts[1:], True)
    befores, exits = np.zeros((len(pieces), STATES)), np.ones((len(pieces), STATES))
    opening, closing, between = (np.flatnonzero(x).tolist() for x in (firsts & ~lasts, lasts & ~firsts, ~firsts & ~lasts))
    ahead = _carried(chain.move, chain.emit, [pieces[i] for i in opening], chain.start[None])
    behind = _carried(chain.move.T, chain.emit, [pieces[i][::-1] for i in closing], np.ones((1, STATES)))
    through = _carried(chain.move, chain.emit, [pieces[i] for i in between], np.eye(STATES))
    for i, value in zip(opening, ahead):
        befores[i + 1] = value[0]
    for i, value in zip(closing, behind):
        exits[i - 1] = chain.move @ value[0]
    for i, matrix in zip(between, through):
        value = befores[i] @ chain.move @ matrix
        befores[i + 1] = value / value.sum()
    for i, matrix in zip(between[::-1], through[::-1]):
        value = chain.move @ (matrix @ exits[i])
        exits[i - 1] = value / value.sum()
    return pieces, firsts, befores, exits


def _expected(chain: Chain, pieces: list[np.ndarray], firsts: np.ndarray, befores: np.ndarray | None = None, exits: np.ndarray | None = None):
    """Baum-Welch counts (start, moves, emissions) of the pieces that ``cut`` gives, and their log likelihood.

    Without ``befores`` and ``exits`` each piece is a whole sequence.
    """
    start, moves, emissions, total = np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros_like(chain.emit), 0.0
    for chosen, grid, alive in _grid(pieces):
        begins = firsts[chosen]
        initial = np.where(begins[:, None], chain.start, chain.start if befores is None else befores[chosen] @ chain.move)
        logs, values, scales = forward(chain, grid, alive, initial, keep=True)
        total += logs.sum()
        back = np.ones((grid.shape[1], STATES))
        if exits is not None:
            last = np.array([len(pieces[i]) for i in chosen]) - 1
            ends = values[last, np.arange(len(chosen))]
            back = exits[chosen] / (ends * exits[chosen]).sum(axis=1, keepdims=True)
        for t in range(grid.shape[0] - 1, 0, -1):
            n = alive[t]
            weighed = chain.emit[grid[t, :n]] * back[:n] / scales[t, :n, None]
            moves += values[t - 1, :n].T @ weighed
            values[t, :n] *= back[:n]
            back[:n] = weighed @ chain.move.T
        if befores is not None:
            weighed = chain.emit[grid[0]] * back / scales[0][:, None]
            moves += befores[chosen][~begins].T @ weighed[~begins]
        values[0] *= back
        start += values[0][begins].sum(axis=0)
        live = np.arange(grid.shape[1])[None, :] < alive[:, None]
        kinds, shares = grid[live], values[live]
        for s in range(STATES):
            emissions[:, s] += np.bincount(kinds, weights=shares[:, s], minlength=len(emissions))
    return start, moves * chain.move, emissions, total


def _sequences(batch, end: int) -> list[np.ndarray]:
    return [np.append(np.frombuffer(x, "<u2"), np.uint16(end)) for x in batch.column("classes").to_pylist()]


def train(encoded: DataFrame, prior: np.ndarray, rounds: int = ROUNDS) -> Chain:
    """Baum-Welch over all rows of ``encoded``, each text as one sequence, however long."""
    chain, end = Chain.begun(prior), len(prior) - 1
    for _ in range(rounds):
        sent = encoded.sparkSession.sparkContext.broadcast(chain)

        def parts(batches, sent=sent):
            sums = None
            for batch in batches:
                sequences = _sequences(batch, end)
                if sequences:
                    found = _expected(sent.value, *cut(sent.value, sequences))
                    sums = found if sums is None else tuple(a + b for a, b in zip(sums, found))
            if sums is not None:
                yield 0, np.concatenate([sums[0], sums[1].ravel()])
                for s in range(STATES):
                    yield 1 + s, np.ascontiguousarray(sums[2][:, s])

        found = dict(sum_vectors(encoded.select("classes"), parts))
        sent.unpersist()
        if not found:
            break
        start, moves = found[0][:STATES] + 1, found[0][STATES:].reshape(STATES, STATES) + 1
        emit = np.stack([found[1 + s] for s in range(STATES)], axis=1) + SMOOTH * prior[:, None]
        chain = Chain(start / start.sum(), moves / moves.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))
    return chain


def score_texts(
    docs: DataFrame, text: str = "text", key: str = "doc_id", modulus: int = 7, remainder: int = 2, rounds: int = ROUNDS
) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) for each document.

    Documents whose key's crc32 has the given remainder are held out; all others train. A null or
    empty text is the end token alone. Repeated rows count as often as they occur, in training as
    in the result. Other columns are ignored. Without training documents every token is unseen.
    """
    context = docs.sparkSession.sparkContext
    rows = docs.select(
        F.xxhash64(F.col(key), F.col(text)).alias("row"), F.col(key).cast("long").alias("key"),
        held_out(F.col(key), modulus, remainder).alias("held_out"), F.col(text).cast("string").alias("text"),
    )
    training = rows.filter("not held_out")
    counts = settle(
        map_arrow(training.select("text"), _word_counts, "word long, surface long, n long")
        .groupBy("word").agg(F.min("surface").alias("surface"), F.sum("n").alias("n"))
    )
    lex = _lexicon(counts, training.select("key").count())
    lexicon = context.broadcast(lex)
    encoded = settle(_encoded(rows, lexicon))
    chain = context.broadcast(train(encoded.filter("not held_out"), lex.prior, rounds))
    rest = counts.filter(F.col("n") * FREQUENT <= lex.tokens).select("word", F.log10(F.col("n") + 1).alias("log"))
    rare = (
        _rare(rows, lexicon).join(rest, "word").groupBy("row")
        .agg(F.sum(F.col("n") * F.col("log")).alias("rare_logs"), F.sum("n").alias("rare_known"))
    )
    # Repeated rows have added up; the share of each is the sum by their number.
    times = encoded.groupBy("row").agg(F.count("*").alias("times"))
    end = lex.end

    def likelihoods(batches):
        for batch in batches:
            sequences = _sequences(batch, end)
            found = np.zeros(len(sequences))
            for chosen, grid, alive in _grid(sequences):
                initial = np.broadcast_to(chain.value.start, (len(chosen), STATES))
                found[chosen] = forward(chain.value, grid, alive, initial, keep=False)[0] / LOG10
            names = ["row", "key", "held_out", "n_tokens", "n_frequent", "logs", "shares"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(found)], [*names, "likelihood"])

    scored = map_arrow(
        encoded, likelihoods,
        "row long, key long, held_out boolean, n_tokens long, n_frequent long, logs double, shares double, likelihood double",
    )
    rare_logs = F.coalesce(F.col("rare_logs") / F.col("times"), F.lit(0.0))
    rare_known = F.coalesce((F.col("rare_known") / F.col("times")).cast("long"), F.lit(0))
    of_end, whole = float(np.log10(lex.ends + 1)), float(np.log10(lex.tokens + lex.kinds + 1))
    return scored.join(rare, "row", "left").join(times, "row").select(
        "key", "held_out", "n_tokens",
        (F.col("n_frequent") + rare_known + (1 if lex.ends else 0)).cast("long").alias("n_known"),
        F.lit(lex.tokens).cast("long").alias("train_tokens"),
        (F.col("logs") + rare_logs + of_end - F.col("n_tokens") * whole).alias("base_score"),
        (F.col("likelihood") + F.col("shares") + rare_logs).alias("score"),
    )
