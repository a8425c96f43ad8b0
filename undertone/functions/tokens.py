"""Tokens, set similarity and hashed vectors as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from undertone.functions import lexicon as L

TOKEN_BREAK = "[^\\p{L}\\p{N}']+"
HASH_DIMENSIONS = 64


def words(text: Column) -> Column:
    """Lower-cased words in order."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), TOKEN_BREAK)
    return F.filter(parts, lambda w: F.length(w) > 0)


def spaced(text: Column) -> Column:
    """The words of a text between single blanks, for whole-word containment."""
    return F.concat(F.lit(" "), F.array_join(words(text), " "), F.lit(" "))


def _listed(names: list[str]) -> str:
    return ", ".join('"' + name + '"' for name in names)


def topic_words(said: str) -> Column:
    """Distinct words of two letters or more that carry a topic, from a column of words.

    Written as SQL text: the word lists stay one literal set, tested by hash.
    """
    return F.expr(
        f"array_distinct(filter({said}, w -> length(w) > 1 AND w NOT IN ({_listed(L.STOPWORDS)})))"
    )


def content_tokens(text: Column) -> Column:
    """The topic words of a text."""
    kept = F.filter(words(text), lambda w: (F.length(w) > 1) & ~w.isin(L.STOPWORDS))
    return F.array_distinct(kept)


def count_listed(said: str, names: list[str]) -> Column:
    """How many words of a column of words are in a list."""
    return F.expr(f"size(filter({said}, w -> w IN ({_listed(names)})))")


def all_listed(said: str, names: list[str]) -> Column:
    return F.expr(f"size({said}) > 0 AND forall({said}, w -> w IN ({_listed(names)}))")


def overlap(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def similarity(shared: Column, a: Column, b: Column) -> Column:
    """Mean of vector and lexical similarity of two sets, from their overlap and sizes."""
    root = F.sqrt((a * b).cast("double"))
    cosine = F.coalesce(F.try_divide(shared.cast("double"), root), F.lit(0.0))
    lexical = F.coalesce(F.try_divide(shared.cast("double"), a + b - shared), F.lit(0.0))
    return (cosine + lexical) / 2


def hash_bucket(token: Column, dimensions: int = HASH_DIMENSIONS) -> Column:
    """Stable bucket of a token; md5 so that any engine can repeat it."""
    return F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("bigint") % dimensions


def hash_vector(tokens: Column, dimensions: int = HASH_DIMENSIONS) -> Column:
    """Unit-length term-count vector of hashed tokens; zero without tokens.

    Each token is hashed once; a bucket's count is how many of the hashes name it. One-element arrays
    name intermediate values: what is given to a higher-order function is evaluated once, what stands
    in its lambda once per element.
    """
    every = F.sequence(F.lit(0), F.lit(dimensions - 1))

    def counted(named: Column) -> Column:
        # Taking a number out of the hashes leaves them shorter by its count.
        return F.transform(every, lambda d: (F.size(named) - F.size(F.array_remove(named, d))).cast("double"))

    def scaled(counts: Column) -> Column:
        norm = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda acc, v: acc + v * v))
        divide = lambda n: F.transform(counts, lambda v: F.coalesce(F.try_divide(v, n), F.lit(0.0)).cast("float"))
        return F.get(F.transform(F.array(norm), divide), F.lit(0))

    hashes = F.transform(tokens, lambda t: hash_bucket(t, dimensions).cast("int"))
    return F.get(F.transform(F.transform(F.array(hashes), counted), scaled), F.lit(0))
