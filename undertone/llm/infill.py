"""Fill-in-the-middle transformation with cuts from a rank index.

A text is a row of lines with n + 1 boundaries. Two draws, hashed from seed and
key, are the ranks of the two cuts; the rank index of the text's boundaries
gives their offsets. Prefix, middle and suffix are then put together in one of
two orders around marks, or the text stays plain.

The index of a text can be kept in a column (``with_boundaries``) and used for
any number of transformations with other seeds, which then look up cuts without
reading the lines again. It has two bytes for each line and a segment for each
stretch of evenly long lines.

Every row is worked on by itself, in runs of bounded bytes: nothing is shuffled
and no key can be hot. Null texts are empty; empty texts, and those that hold a
mark, stay plain. A null key draws as an empty one; rows with equal keys draw
alike. Other columns stay as they are, whatever their names; only the columns
named below are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, LongType, StructField, StructType

from undertone.llm import text as X
from undertone.llm.rank_index import ERROR, RankIndex, residual_type
from undertone.llm.tasks import map_arrow

SEED = 7
MARKS = ("<P>", "<S>", "<M>")
MADE = ("fim_units", "fim_form", "fim_prefix_chars", "fim_middle_chars", "fim_text")
_DRAWS = ("h1", "h2", "h3", "h4")
INDEX = StructType([
    StructField("units", IntegerType()), StructField("ranks", ArrayType(IntegerType())), StructField("offsets", ArrayType(LongType())),
    StructField("slopes", ArrayType(DoubleType())), StructField("residuals", BinaryType()),
])


def _packed(docs: DataFrame, names: list[str], text: str, *more: Column) -> DataFrame:
    """The text on its own, for it is read, and all other columns in one."""
    rest = F.struct(F.lit(0).alias("none"), *(F.col(c).alias(f"c{n}") for n, c in enumerate(names) if c != text))
    return docs.select(rest.alias("doc"), F.col(text).cast("string").alias("text"), *more)


def _unpacked(names: list[str], text: str) -> list[Column]:
    return [F.col("text").alias(c) if c == text else F.col("doc")[f"c{n}"].alias(c) for n, c in enumerate(names)]


def boundaries(data: np.ndarray) -> np.ndarray:
    """Byte offsets at which lines begin, and the end; a last line need not end in a line break."""
    found = np.append(0, np.flatnonzero(data == 10) + 1)
    return found if found[-1] == len(data) else np.append(found, len(data))


def _stored(column: pa.Array, error: int) -> list[RankIndex]:
    parts = {c: column.field(c).to_pylist() for c in ("ranks", "offsets", "slopes", "residuals")}
    kind = residual_type(error)
    return [
        RankIndex(np.array(r, np.int64), np.array(o, np.int64), np.array(s), np.frombuffer(d, kind))
        for r, o, s, d in zip(*(parts[c] for c in parts))
    ]


def with_boundaries(docs: DataFrame, out: str = "boundaries", text: str = "text", error: int = ERROR) -> DataFrame:
    """``docs`` with the rank index of each text in the column ``out``; a null text has that of an empty one."""
    names = [c for c in docs.columns if c != out]
    packed = _packed(docs, names, text)
    schema = StructType([packed.schema["doc"], packed.schema["text"]]).add("found", INDEX)

    def run(batches):
        for batch in batches:
            raw, offsets = X.buffer_of(batch.column("text"))
            found = [RankIndex.fit(boundaries(raw[a:b]), error) for a, b in zip(offsets[:-1], offsets[1:])]
            columns = [
                pa.array([len(i.residuals) - 1 for i in found], pa.int32()), pa.array([i.ranks for i in found], pa.list_(pa.int32())),
                pa.array([i.offsets for i in found], pa.list_(pa.int64())), pa.array([i.slopes for i in found], pa.list_(pa.float64())),
                X.binaries([i.residuals.tobytes() for i in found]),
            ]
            index = pa.StructArray.from_arrays(columns, ["units", "ranks", "offsets", "slopes", "residuals"])
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("text"), index], ["doc", "text", "found"])

    return map_arrow(packed, run, schema).select(*_unpacked(names, text), F.col("found").alias(out))


def draws(key: Column, seed: int) -> list[Column]:
    """The first four 8-digit groups of the hex sha256 of seed and key."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * n + 1, 8), 16, 10).cast("long").alias(name) for n, name in enumerate(_DRAWS)]


def _cut(batches, marks: tuple[bytes, ...], rate: int, spm: int, error: int, stored: bool):
    p, s, m = marks
    for batch in batches:
        raw, offsets = X.buffer_of(batch.column("text"))
        h1, h2, h3, h4 = (batch.column(c).to_numpy(zero_copy_only=False) for c in _DRAWS)
        held = batch.column("held").to_numpy(zero_copy_only=False)
        known = _stored(batch.column("index"), error) if stored else None
        n_units, forms, prefixes, middles, texts = [], [], [], [], []
        for d in range(batch.num_rows):
            data = raw[offsets[d] : offsets[d + 1]]
            index = known[d] if stored else RankIndex.fit(boundaries(data), error)
            n = len(index.residuals) - 1
            n_units.append(n)
            whole = data.tobytes()
            if not n or held[d] or h3[d] % 100 >= rate:
                forms.append("plain")
                prefixes.append(None)
                middles.append(None)
                texts.append(whole)
                continue
            a, b = index.locate(np.sort([h1[d] % (n + 1), h2[d] % (n + 1)])).tolist()
            prefix, middle, suffix = whole[:a], whole[a:b], whole[b:]
            prefixes.append(len(prefix.decode()))
            middles.append(len(middle.decode()))
            forms.append("spm" if h4[d] % 100 < spm else "psm")
            texts.append(b"".join((s, suffix, p, prefix, m, middle) if forms[-1] == "spm" else (p, prefix, s, suffix, m, middle)))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc"), batch.column("text"), pa.array(n_units, pa.int64()), pa.array(forms, pa.string()),
             pa.array(prefixes, pa.int64()), pa.array(middles, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())],
            ["doc", "text", *MADE],
        )


def fill_in_middle(
    docs: DataFrame, rate: int = 100, spm: int = 50, seed: int = SEED, marks: tuple[str, str, str] = MARKS,
    text: str = "text", key: str = "doc_id", index: str | None = None, error: int = ERROR,
) -> DataFrame:
    """``docs`` with ``fim_units`` (lines), ``fim_form``, ``fim_prefix_chars``, ``fim_middle_chars`` and ``fim_text``.

    ``rate`` per cent of the documents are cut, ``spm`` per cent of those into the form that begins with the
    suffix. ``index`` names a column of ``with_boundaries`` with the same ``error``; without it, the index
    is fitted on the way. The lengths count code points and are null where the form is plain.
    """
    names = [c for c in docs.columns if c not in MADE]
    held = F.lit(False)
    for mark in marks:
        held = held | F.coalesce(F.contains(F.col(text).cast("string"), F.lit(mark)), F.lit(False))
    packed = _packed(
        docs, names, text, *draws(F.col(key), seed), held.alias("held"), *([F.col(index).alias("index")] if index else [])
    )
    schema = StructType([packed.schema["doc"], packed.schema["text"]])
    for name, kind in zip(MADE, ("long", "string", "long", "long", "string")):
        schema = schema.add(name, kind)
    raw_marks = tuple(x.encode() for x in marks)
    cut = map_arrow(packed, lambda b: _cut(b, raw_marks, rate, spm, error, index is not None), schema)
    return cut.select(*_unpacked(names, text), *MADE)


def restored(form: Column, made: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text before the transformation, from its result and form alone.

    No mark is part of another or of the text, so each stands once and splits the result.
    """
    parts = F.split(made, "|".join(f"\\Q{x}\\E" for x in marks), -1)
    return (
        F.when(form == "psm", F.concat(F.get(parts, 1), F.get(parts, 3), F.get(parts, 2)))
        .when(form == "spm", F.concat(F.get(parts, 2), F.get(parts, 3), F.get(parts, 1)))
        .otherwise(made)
    )
