"""Near-duplicate lines by a segment-partition edit join.

A line of at least ``LEAST`` characters is cut into ``edits`` + 1 segments. Two
lines within ``edits`` edits share one of them at nearly the same place, so
each line probes, for every length it can be near to, the few substrings that
can be a segment of such a line. Lines that meet are compared with a banded
bit-parallel edit distance, many pairs at once. Shorter lines are duplicates
only when equal; blank lines are left alone.

Equal lines are one node from the start. Within a group of lines that share a
segment, first all are compared with a few leaders, then only lines not yet
joined with each other, in blocks; a block gives only links that join what was
not joined. Line classes are the connected components.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undertone.llm import text as X
from undertone.llm.graph import components
from undertone.llm.tasks import map_arrow
from undertone.session import settle

EDITS = 2
LEAST = 30
BLOCK = 512
LEADERS = 4
PAIRS = 1 << 15
TOGETHER = 4096


_POINT = np.random.default_rng(7907).integers(0, 1 << 63, 1 << 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_INK = np.ones(256, bool)
_INK[[9, 10, 11, 12, 13, 32]] = False


class Lines:
    """The lines of a run of documents as spans of code points."""

    def __init__(self, raw, offsets, i, j):
        data = raw[offsets[i] : offsets[j]]
        bounds = offsets[i : j + 1] - offsets[i]
        self.data, self.byte = data, None
        if len(data) and data.max() > 127:
            begins = (data & 0xC0) != 0x80
            self.byte = np.append(np.flatnonzero(begins), len(data))
            bounds = np.append(0, np.cumsum(begins))[bounds]
            self.points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        else:
            self.points = data.astype(np.uint32)
        breaks = np.flatnonzero(self.points == 10)
        # Every document has one line more than it has line breaks.
        self.first = np.searchsorted(breaks, bounds) + np.arange(len(bounds))
        n = int(self.first[-1])
        self.document = np.repeat(np.arange(len(bounds) - 1), np.diff(self.first))
        self.starts = np.zeros(n, np.int64)
        self.ends = np.zeros(n, np.int64)
        opening = np.zeros(n, bool)
        opening[self.first[:-1]] = True
        closing = np.zeros(n, bool)
        closing[self.first[1:] - 1] = True
        self.starts[opening], self.starts[~opening] = bounds[:-1], breaks + 1
        self.ends[closing], self.ends[~closing] = bounds[1:], breaks
        self.number = np.arange(n) - self.first[self.document]
        values = _POINT[self.points & 0xFFFF]
        if len(self.points) and self.points.max() > 0xFFFF:
            values = values + (self.points >> np.uint32(16)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        self.sums = X.prefix_sums(values)
        ink = np.append(0, np.cumsum(_INK[np.minimum(self.points, 255)]))
        self.blank = ink[self.ends] == ink[self.starts]

    def hashes(self) -> np.ndarray:
        """Hashes of the whole lines; ``sums`` gives keys of segments, which only find candidates."""
        if self.byte is None:
            return X.byte_hashes(self.data, self.starts, self.ends)
        return X.byte_hashes(self.data, self.byte[self.starts], self.byte[self.ends])

    def text(self, line: int) -> str:
        return self.points[self.starts[line] : self.ends[line]].tobytes().decode("utf-32-le")


def segment(length: np.ndarray, s: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, length) of segment ``s`` of lines of this length; the last segments take what is over."""
    size, over = length // parts, length % parts
    longer = np.maximum(0, s - (parts - over))
    return s * size + longer, size + (s >= parts - over)


def _key(h: np.ndarray, length: np.ndarray, s: int) -> np.ndarray:
    return X.mix(h ^ X.mix(length.astype(np.uint64) * np.uint64(64) + np.uint64(s)))


def index_keys(lines: Lines, chosen: np.ndarray, edits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(lines, keys) of the segments of the chosen lines."""
    length = lines.ends[chosen] - lines.starts[chosen]
    found = []
    for s in range(edits + 1):
        at, size = segment(length, s, edits + 1)
        begin = lines.starts[chosen] + at
        found.append((chosen, _key(X.span_keys(lines.sums, begin, begin + size), length, s)))
    return found


def probe_keys(lines: Lines, chosen: np.ndarray, edits: int, least: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(lines, keys) of the substrings that can be a segment of an equally long or shorter line within ``edits`` edits."""
    length = lines.ends[chosen] - lines.starts[chosen]
    found = []
    for less in range(edits + 1):
        other = length - less
        for s in range(edits + 1):
            at, size = segment(other, s, edits + 1)
            low = max(-s, less - (edits - s))
            high = min(s, less + (edits - s))
            for shift in range(low, high + 1):
                begin = at + shift
                fits = (begin >= 0) & (begin + size <= length) & (other >= least)
                b = lines.starts[chosen][fits] + begin[fits]
                found.append((chosen[fits], _key(X.span_keys(lines.sums, b, b + size[fits]), other[fits], s)))
    return found


def within(left: list[np.ndarray], right: list[np.ndarray], edits: int) -> np.ndarray:
    """Whether each pair of code-point arrays is within ``edits`` edits.

    Bit d of level e says that after t characters of the right line, t + d - edits characters of the
    left one can be matched with at most e edits; only 2 * edits + 1 diagonals matter.
    """
    result = np.zeros(len(left), bool)
    n_left, n_right = np.array([len(x) for x in left], np.int64), np.array([len(x) for x in right], np.int64)
    near = np.flatnonzero(np.abs(n_left - n_right) <= edits)
    near = near[np.argsort(n_right[near], kind="stable")]
    at = 0
    while at < len(near):
        chosen = near[at : at + PAIRS]
        while len(chosen) > 1 and len(chosen) * int(n_right[chosen[-1]]) > 2 << 20:
            chosen = chosen[: len(chosen) // 2]
        at += len(chosen)
        result[chosen] = _within(left, right, n_left, n_right, chosen, edits)
    return result


def _within(left, right, n_left, n_right, chosen, edits) -> np.ndarray:
    width = 2 * edits + 1
    steps = int(n_right[chosen].max()) if len(chosen) else 0
    tall = steps + width + edits
    a = np.zeros((tall, len(chosen)), np.uint32)
    b = np.zeros((max(1, steps), len(chosen)), np.uint32)
    for c, p in enumerate(chosen):
        a[edits : edits + n_left[p], c] = left[p]
        b[: n_right[p], c] = right[p]
    # Outside the left line stands 0, which only a zero character could match; the final bit lies inside.
    result = np.zeros(len(chosen), bool)
    alive = np.arange(len(chosen))
    ends, goal = n_right[chosen], (n_left - n_right)[chosen] + edits
    full = np.uint16((1 << width) - 1)
    level = [np.full(len(chosen), ((1 << (e + 1)) - 1) << edits & int(full), np.uint16) for e in range(edits + 1)]
    for t in range(steps + 1):
        done = ends[alive] == t
        if done.any():
            result[alive[done]] = (level[edits][done] >> goal[alive[done]].astype(np.uint16)) & 1
        if t == steps:
            break
        if done.any() or t % 16 == 15:
            keep = ~done & (level[edits] > 0)
            if not keep.all():
                alive = alive[keep]
                level = [x[keep] for x in level]
                if not len(alive):
                    break
        same = np.zeros(len(alive), np.uint16)
        for d in range(width):
            position = t + d - edits
            inside = (position >= 0) & (position < n_left[chosen[alive]])
            same |= ((a[t + d, alive] == b[t, alive]) & inside).astype(np.uint16) << np.uint16(d)
        fresh = [level[0] & same]
        for e in range(1, edits + 1):
            # the same character; or replaced; or only the right one; or only the left one
            fresh.append(((level[e] & same) | level[e - 1] | level[e - 1] >> np.uint16(1) | fresh[e - 1] << np.uint16(1)) & full)
        level = fresh
    return result


def _parts(batches, edits: int, least: int):
    """Two kinds of rows: places (row, key, number, line), and segments (segment, line) of lines of at least ``least``."""
    for batch in batches:
        raw, offsets = X.buffer_of(batch.column("text"))
        rows = batch.column("row").to_numpy(zero_copy_only=False)
        for i, j in X.chunks(offsets):
            lines = Lines(raw, offsets, i, j)
            hashes = lines.hashes()
            full = np.flatnonzero(~lines.blank)
            n = len(full)
            nothing = pa.nulls(n, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows[i + lines.document[full]]), batch.column("key").take(pa.array(i + lines.document[full])),
                 pa.array(lines.number[full].astype(np.int32)), nothing, X.signed(hashes[full])],
                ["row", "key", "number", "segment", "line"],
            )
            for chosen, keys in index_keys(lines, _long(lines, hashes, least), edits):
                nothing = pa.nulls(len(keys), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [nothing, nothing, pa.nulls(len(keys), pa.int32()), X.signed(keys), X.signed(hashes[chosen])],
                    ["row", "key", "number", "segment", "line"],
                )


def _long(lines: Lines, hashes: np.ndarray, least: int) -> np.ndarray:
    """One place of each different line that is long enough to be compared."""
    one = np.flatnonzero((lines.ends - lines.starts >= least) & ~lines.blank)
    return one[np.unique(hashes[one], return_index=True)[1]]


def _probes(batches, edits: int, least: int):
    for batch in batches:
        raw, offsets = X.buffer_of(batch.column("text"))
        for i, j in X.chunks(offsets):
            lines = Lines(raw, offsets, i, j)
            hashes = lines.hashes()
            for chosen, keys in probe_keys(lines, _long(lines, hashes, least), edits, least):
                yield pa.RecordBatch.from_arrays([X.signed(keys), X.signed(hashes[chosen])], ["segment", "line"])


def _texts(batches):
    """The wanted lines of documents as (line, text)."""
    for batch in batches:
        raw, offsets = X.buffer_of(batch.column("text"))
        numbers = batch.column("numbers").to_pylist()
        names, texts = [], []
        for i, j in X.chunks(offsets):
            lines = Lines(raw, offsets, i, j)
            hashes = lines.hashes().view(np.int64)
            for d in range(j - i):
                for number in numbers[i + d]:
                    at = int(lines.first[d]) + number
                    names.append(int(hashes[at]))
                    texts.append(lines.text(at))
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(texts, pa.string())], ["line", "text"])


def _links(batches, edits: int):
    """Within each block of each group: links between lines, a spanning set of what they join.

    Rows come sorted by block, so all rows of a block are neighbours; the blocks of a batch are
    worked on together, the last one once its rows are complete.
    """
    waiting = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        waiting = table if waiting is None else pa.concat_tables([waiting, table])
        block = [waiting.column(c).to_numpy() for c in ("segment", "left", "right")]
        change = np.flatnonzero(np.any([b[1:] != b[:-1] for b in block], axis=0)) + 1
        # Blocks are taken together while they have few rows and characters; the last may go on in the next batch.
        size = np.append(0, np.cumsum(pc.binary_length(waiting.column("text")).to_numpy()))
        begin, end = 0, 0
        for cut in change.tolist():
            if end > begin and (cut - begin > TOGETHER or size[cut] - size[begin] > X.CHUNK):
                yield _joined(waiting.slice(begin, end - begin), edits)
                begin = end
            end = cut
        if end > begin:
            yield _joined(waiting.slice(begin, end - begin), edits)
        waiting = waiting.slice(end)
    if waiting is not None and waiting.num_rows:
        yield _joined(waiting, edits)


def _joined(table: pa.Table, edits: int) -> pa.RecordBatch:
    """The links of complete blocks: a few leaders first, then what is still apart."""
    block = [table.column(c).to_numpy() for c in ("segment", "left", "right")]
    line = table.column("line").to_numpy()
    side = table.column("probe").to_numpy()
    points = [np.frombuffer(t.encode("utf-32-le"), np.uint32) for t in table.column("text").to_pylist()]
    bounds = np.append(np.append(0, np.flatnonzero(np.any([b[1:] != b[:-1] for b in block], axis=0)) + 1), len(line))
    groups = []
    for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        probing = np.flatnonzero(side[s:e]) + s
        indexed = np.flatnonzero(~side[s:e]) + s
        if len(probing) and len(indexed):
            groups.append((s, e, indexed, probing))
    label = line.copy()
    a, b = [], []
    place_of = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))

    def test(pairs: list[tuple[np.ndarray, np.ndarray]]) -> None:
        x = np.concatenate([p for p, _ in pairs]) if pairs else np.zeros(0, np.int64)
        y = np.concatenate([q for _, q in pairs]) if pairs else np.zeros(0, np.int64)
        hit = within([points[p] for p in x], [points[q] for q in y], edits)
        for p, q in zip(x[hit].tolist(), y[hit].tolist()):
            if label[p] != label[q]:
                a.append(min(line[p], line[q]))
                b.append(max(line[p], line[q]))
                s, e = bounds[place_of[p]], bounds[place_of[p] + 1]
                mine = label[s:e]
                mine[mine == label[q]] = label[p]

    for n in range(LEADERS):
        pairs = []
        for _, _, indexed, probing in groups:
            if n < len(indexed):
                others = probing[label[probing] != label[indexed[n]]]
                pairs.append((np.full(len(others), indexed[n]), others))
        test(pairs)
    pairs, size = [], 0
    for _, _, indexed, probing in groups:
        for p in indexed[LEADERS:]:
            others = probing[label[probing] != label[p]]
            pairs.append((np.full(len(others), p), others))
            size += len(others)
            if size >= PAIRS:
                test(pairs)
                pairs, size = [], 0
    test(pairs)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _near_links(rows: DataFrame, lines: DataFrame, index: DataFrame, edits: int, least: int) -> DataFrame:
    """Links (a, b) between different lines within ``edits`` edits that join all such lines."""
    probe = map_arrow(rows.select("text"), lambda b: _probes(b, edits, least), "segment long, line long")
    held = index.groupBy("segment").agg(F.min("line").alias("low"), F.max("line").alias("high"))
    probing = settle(
        probe.join(held, "segment").filter("low != line or high != line").select("segment", "line").distinct()
    )
    held_by = index.join(probing.select("segment").distinct(), "segment", "left_semi").distinct()
    members = settle(probing.withColumn("probe", F.lit(True)).unionByName(held_by.withColumn("probe", F.lit(False))))
    sizes = members.groupBy("segment").agg(
        F.ceil(F.sum((~F.col("probe")).cast("int")) / BLOCK).cast("int").alias("indexed"),
        F.ceil(F.sum(F.col("probe").cast("int")) / BLOCK).cast("int").alias("probed"),
    )
    wanted = members.select("line").distinct().join(lines.select("line", "first"), "line").select("first.row", "first.number")
    places = wanted.groupBy("row").agg(F.collect_list("number").alias("numbers"))
    chosen = rows.join(places, "row").dropDuplicates(["row"]).select("text", "numbers")
    said = settle(map_arrow(chosen, _texts, "line long, text string"))
    blocks = (
        members.join(sizes, "segment")
        .withColumn("mine", F.expr("cast(pmod(xxhash64(line, 5), if(probe, probed, indexed)) as int)"))
        .withColumn("other", F.explode(F.expr("sequence(0, if(probe, indexed, probed) - 1)")))
        .select("segment", F.expr("if(probe, other, mine)").alias("left"), F.expr("if(probe, mine, other)").alias("right"), "line", "probe")
    )
    keys = ["segment", "left", "right"]
    return map_arrow(
        blocks.join(said, "line").repartition(*keys).sortWithinPartitions(*keys), lambda b: _links(b, edits), "a long, b long"
    )


def _without(batches):
    """Texts without the lines whose numbers are listed."""
    for batch in batches:
        out = []
        for text, numbers in zip(batch.column("text").to_pylist(), batch.column("numbers").to_pylist()):
            if numbers:
                gone = set(numbers)
                text = "\n".join(x for n, x in enumerate(text.split("\n")) if n not in gone)
            out.append(text)
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in batch.schema.names if c != "text"), pa.array(out, pa.string())],
            [*(c for c in batch.schema.names if c != "text"), "text"],
        )


def repeated_lines(
    docs: DataFrame, edits: int = EDITS, least: int = LEAST, text: str = "text", key: str = "doc_id"
) -> DataFrame:
    """(row, numbers): the line numbers to remove from each document that has any; ``row`` is a hash of key and text.

    Of each class of near-duplicate lines the first stays: of the least key (null first), row and
    line number. A row that occurs several times keeps its lines each time.
    """
    rows = docs.select(
        F.xxhash64(F.col(key), F.col(text)).alias("row"), F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text")
    )
    parts = settle(map_arrow(rows, lambda b: _parts(b, edits, least), "row long, key long, number int, segment long, line long"))
    occurrences = parts.filter("segment is null").select("row", "key", "number", "line")
    index = parts.filter("segment is not null").select("segment", "line")
    lines = settle(occurrences.groupBy("line").agg(
        F.min(F.struct("key", "row", "number")).alias("first"), F.count("*").alias("n")
    ))
    classes = components(settle(_near_links(rows, lines, index, edits, least)))
    labelled = settle(lines.join(classes.withColumnRenamed("node", "line"), "line", "left").filter(
        "n > 1 or component is not null"
    ).select("line", "first", F.coalesce("component", "line").alias("component")))
    stays = labelled.groupBy("component").agg(F.min("first").alias("stays"))
    chosen = labelled.join(stays, "component").select("line", "stays")
    return (
        occurrences.join(chosen, "line")
        .filter("row != stays.row or number != stays.number")
        .groupBy("row").agg(F.collect_set("number").alias("numbers"))
    )


def remove_repeated_lines(
    docs: DataFrame, edits: int = EDITS, least: int = LEAST, text: str = "text", key: str = "doc_id"
) -> DataFrame:
    """``docs`` without repeated lines in ``text``, and with ``lines_removed``.

    Null and empty texts come back as they are. All rows and other columns stay, whatever their
    names; only a column ``lines_removed`` is replaced.
    """
    gone = repeated_lines(docs, edits, least, text, key)
    names = [c for c in docs.columns if c != "lines_removed"]
    packed = docs.select(
        F.struct(*(c for c in names if c != text)).alias("rest"), F.col(text).cast("string").alias("text"),
        F.xxhash64(F.col(key), F.col(text)).alias("row"),
    )
    joined = packed.join(gone, "row", "left").select("rest", "numbers", F.coalesce(F.size("numbers"), F.lit(0)).alias("removed"), "text")
    cut = map_arrow(joined, _without, joined.schema)
    return cut.select(F.col("text").alias(text), "rest.*", F.col("removed").alias("lines_removed")).select(*names, "lines_removed")
