"""One schema document as an immutable tree, to be turned into Column expressions.

A single schema is metadata, as a ``StructType`` is: it is read on the driver and
becomes part of the plan. Collections of schemas stay distributed, see
``schemagauge.sources.documents``.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

# The keywords and type words a schema document may use.
ANNOTATIONS = ("$schema", "$id", "title", "description")
KEYWORDS = ANNOTATIONS + (
    "type",
    "required",
    "properties",
    "anyOf",
    "oneOf",
    "items",
    "maxItems",
    "maxProperties",
    "additionalProperties",
)
TYPE_WORDS = {
    "null": "null",
    "boolean": "boolean",
    "false": "boolean",
    "true": "boolean",
    "string": "string",
    "number": "number",
    "integer": "number",
    "array": "array",
    "object": "object",
}
BLANKS = " \t\r\n"


class SchemaError(ValueError):
    """The document uses something outside the supported keywords."""


@dataclass(frozen=True)
class Schema:
    type: str | None = None
    properties: tuple[tuple[str, Schema], ...] | None = None
    required: frozenset[str] = frozenset()
    items: Schema | None = None
    any_of: tuple[Schema, ...] | None = None
    one_of: tuple[Schema, ...] | None = None
    max_items: float | None = None
    max_properties: float | None = None
    additional: bool = False

    def inner(self) -> list[Schema]:
        """The schemas right below."""
        below = [s for _, s in self.properties or ()]
        below += list(self.any_of or ()) + list(self.one_of or ())
        return below if self.items is None else [*below, self.items]

    def _levels(self) -> Iterator[list[Schema]]:
        level = [self]
        while level:
            yield level
            level = [s for node in level for s in node.inner()]

    def size(self) -> int:
        return sum(map(len, self._levels()))

    def depth(self) -> int:
        return sum(1 for _ in self._levels())

    @cached_property
    def by_name(self) -> dict[str, Schema]:
        return dict(self.properties or ())

    def entities(self) -> tuple[Schema, ...]:
        """Branches of a root ``anyOf``, or the schema itself."""
        return (self,) if self.any_of is None else self.any_of


class _Members(list):
    """Members of a JSON object in text order, repeats kept."""


def load_schema(text: str) -> Schema:
    """Read a document; backslashes are deleted first, text after it is ignored."""
    plain = text.replace("\\", "").lstrip(BLANKS)
    try:
        document, _ = json.JSONDecoder(object_pairs_hook=_Members, strict=False).raw_decode(plain)
    except ValueError as error:
        raise SchemaError(f"not a JSON document: {error}") from None
    return _node(document)


def _node(document) -> Schema:
    if not isinstance(document, _Members):
        raise SchemaError(f"a schema must be an object, found {document!r}")
    slots: dict = {}
    for keyword, value in document:
        if keyword in ANNOTATIONS:
            _expect(isinstance(value, str), keyword, value)
        elif keyword == "type":
            _expect(isinstance(value, str) and value.strip(BLANKS) in TYPE_WORDS, keyword, value)
            slots["type"] = TYPE_WORDS[value.strip(BLANKS)]
        elif keyword == "properties":
            _expect(isinstance(value, _Members), keyword, value)
            members = {key.lstrip(BLANKS): _node(inner) for key, inner in value}
            slots["properties"] = tuple(members.items())
        elif keyword == "required":
            _expect(_is_list(value) and all(isinstance(k, str) for k in value), keyword, value)
            slots["required"] = frozenset(k.lstrip(BLANKS) for k in value)
        elif keyword in ("anyOf", "oneOf"):
            _expect(_is_list(value), keyword, value)
            slots["any_of" if keyword == "anyOf" else "one_of"] = tuple(_node(s) for s in value)
        elif keyword == "items":
            slots["items"] = _node(value)
        elif keyword in ("maxItems", "maxProperties"):
            # Both words set the array limit; the later one in the text wins.
            numeric = isinstance(value, (int, float)) and not isinstance(value, bool)
            _expect(numeric, keyword, value)
            slots["max_items"] = float(value)
        elif keyword == "additionalProperties":
            _expect(isinstance(value, bool), keyword, value)
            slots["additional"] = value
        else:
            raise SchemaError(f"unsupported keyword {keyword!r}")
    return Schema(**slots)


def _is_list(value) -> bool:
    return isinstance(value, list) and not isinstance(value, _Members)


def _expect(holds: bool, keyword: str, value) -> None:
    if not holds:
        raise SchemaError(f"unsupported value for {keyword!r}: {value!r}")


def to_schema(schema: str | Schema) -> Schema:
    return schema if isinstance(schema, Schema) else load_schema(schema)
