"""Typed access to JSON documents from a list of wanted paths.

The wanted paths of a document decide the schema given to ``from_json``: one
parse per document, only the wanted fields are built, every leaf is text.

Path syntax: ``a.b`` nested field, ``a[0].b`` first array element, ``a[]`` the
whole array with each element as JSON text, ``a|b.c`` field ``c`` of whichever
of the objects ``a`` and ``b`` is there first. A path that is also the parent
of another path is kept as JSON text.

Expressions are SQL text: one parser call per column instead of one gateway
call per function. In higher-order functions the array is evaluated once and
the lambda once per element, so JSON is never parsed twice for one value.
"""

from __future__ import annotations

from pyspark.sql import types as T


#: A path with this ending gives nothing where an object stands.
NO_OBJECT = "~"


def is_object(value: str) -> str:
    return f"startswith({value}, '{{')"


def _segments(path: str) -> list[str]:
    return path.split(".")


class JsonFields:
    """The set of paths wanted from one document shape."""

    def __init__(self, paths: list[str]):
        plain = [p.removesuffix(NO_OBJECT) for p in paths]
        self._leaves = set(plain)
        self._tree: dict = {}
        for path in plain:
            node = self._tree
            for segment in _segments(path):
                node = node.setdefault(segment, {})

    def schema(self) -> T.StructType:
        return self._struct(self._tree, "")

    def _struct(self, tree: dict, prefix: str) -> T.StructType:
        fields: dict[str, T.DataType] = {}
        for segment, children in tree.items():
            path = f"{prefix}.{segment}" if prefix else segment
            name, is_array = self._name(segment)
            if path in self._leaves or not children:
                kind: T.DataType = T.StringType()
            else:
                kind = self._struct(children, path)
            if is_array:
                kind = T.ArrayType(kind)
            for alternative in name.split("|"):
                fields[alternative] = kind
        return T.StructType([T.StructField(n, t) for n, t in fields.items()])

    @staticmethod
    def _name(segment: str) -> tuple[str, bool]:
        if segment.endswith("]"):
            return segment[: segment.index("[")], True
        return segment, False

    def get(self, document: str, path: str) -> str:
        """The value at ``path`` of a parsed document."""
        if path.endswith(NO_OBJECT):
            value = self.get(document, path.removesuffix(NO_OBJECT))
            return f"CASE WHEN NOT {is_object(value)} THEN {value} END"
        value, walked = document, ""
        segments = _segments(path)
        for position, segment in enumerate(segments):
            walked = f"{walked}.{segment}" if walked else segment
            name, is_array = self._name(segment)
            choices = [f"{value}.`{n}`" for n in name.split("|")]
            value = choices[0] if len(choices) == 1 else f"coalesce({', '.join(choices)})"
            if is_array and segment.endswith("[0]"):
                value = f"get({value}, 0)"
            rest = segments[position + 1:]
            if rest and walked in self._leaves:
                return f"get_json_object({value}, '$.{'.'.join(rest)}')"
        return value


def text_or(values: list[str], default: str | None = "") -> str:
    """First value that is neither null nor empty."""
    picked = [f"nullif({v}, '')" for v in values]
    if default is not None:
        picked.append("'" + default + "'")
    if not picked:
        return "CAST(NULL AS STRING)"
    return picked[0] if len(picked) == 1 else f"coalesce({', '.join(picked)})"


def count_or(values: list[str], default: int | None = 0) -> str:
    """First value that parses to a non-zero count."""
    picked = [f"nullif(try_cast({v} AS BIGINT), 0L)" for v in values]
    picked.append("CAST(NULL AS BIGINT)" if default is None else f"{default}L")
    return f"coalesce({', '.join(picked)})"


def member(text: str, path: str) -> str:
    return f"get_json_object({text}, '$.{path}')"


def first_array(text: str, *paths: str) -> str:
    """Elements, as JSON text, of the array at the first path that holds anything.

    Something else than an array at that path gives no elements.
    """
    values = ", ".join(f"get_json_object({text}, '{p}')" for p in paths)
    present = f"slice(filter(array({values}), v -> v NOT IN ('', '0', 'false', 'null')), 1, 1)"
    arrays = f"filter({present}, v -> startswith(ltrim(v), '['))"
    return f"flatten(transform({arrays}, v -> from_json(v, 'ARRAY<STRING>')))"


def unwrap(element: str, field: str) -> str:
    """``element.field`` when it is there, else the element itself."""
    return f"coalesce({member(element, field)}, {element})"
