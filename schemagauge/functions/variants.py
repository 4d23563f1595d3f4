"""Kinds and paths of ``VARIANT`` values, as plain Column expressions.

Nothing here shuffles or leaves the JVM: a record is one cell, so its whole tree
is walked inside the row that holds it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

PATHS_AND_VALUES = "array<struct<path:string,v:variant>>"
PATHS_AND_KINDS = "array<struct<path:string,kind:string>>"


def as_object(v: Column) -> Column:
    """``map<string,variant>`` of an object's members, NULL for any other value."""
    return F.try_variant_get(v, "$", "map<string,variant>")


def as_array(v: Column) -> Column:
    """``array<variant>`` of an array's elements, NULL for any other value."""
    return F.try_variant_get(v, "$", "array<variant>")


def empty(type_name: str) -> Column:
    return F.array().cast(type_name)


def record(**fields: Column) -> Column:
    """A struct whose field names hold whatever the fields are made of."""
    return F.named_struct(*[x for name, value in fields.items() for x in (F.lit(name), value)])


def bind_test(value: Column, test: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once, then a boolean expression over it; NULL is false."""
    return F.exists(F.array(value), lambda x: x.isNotNull() & test(x))


def bind_array(value: Column, make: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once, then an array expression over it; NULL gives []."""
    present = F.filter(F.array(value), lambda x: x.isNotNull())
    return F.flatten(F.transform(present, make))


def is_string(v: Column) -> Column:
    return F.schema_of_variant(v) == "STRING"


def is_boolean(v: Column) -> Column:
    return F.schema_of_variant(v) == "BOOLEAN"


def is_null(v: Column) -> Column:
    return F.is_variant_null(v)


def is_number(v: Column) -> Column:
    # Whole and fractional numbers are one kind, whatever width the parser chose.
    name = F.schema_of_variant(v)
    return name.isin("BIGINT", "DOUBLE", "FLOAT") | name.startswith("DECIMAL(")


def scalar_kind(v: Column) -> Column:
    """Kind of a value known to be neither object nor array."""
    names = F.create_map(
        *[F.lit(x) for x in ("STRING", "string", "BOOLEAN", "boolean", "VOID", "null")]
    )
    return F.coalesce(F.element_at(names, F.schema_of_variant(v)), F.lit("number"))


def _kind(v: Column, members: Column, elements: Column, mark_empty: bool) -> Column:
    def container(size: Column, name: str) -> Column:
        if not mark_empty:
            return F.lit(name)
        return F.when(size == 0, "empty_" + name).otherwise(name)

    return (
        F.when(members.isNotNull(), container(F.size(members), "object"))
        .when(elements.isNotNull(), container(F.size(elements), "array"))
        .otherwise(scalar_kind(v))
    )


def kind(v: Column, mark_empty: bool = True) -> Column:
    """``string number boolean null object array``, and with ``mark_empty`` also
    ``empty_object`` and ``empty_array``."""
    return F.when(v.isNotNull(), _kind(v, as_object(v), as_array(v), mark_empty))


# A string of a JSON text. Possessive loops run on without a stack, however long the string.
_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
_MARK = "\u0001"  # JSON text holds no such character but escaped


def structure(text: Column) -> Column:
    """A JSON text with every string empty, every number 0 and every boolean true.

    Texts of one structure meet the same verdict and miss the same paths. Only for texts
    that parse.
    """

    def masked(text: Column, value: str, to: str) -> Column:
        # Strings are passed over and marked, what follows them isn't.
        found = F.regexp_replace(text, F.lit(f"({_STRING})|{value}"), F.lit("$1" + _MARK))
        found = F.replace(found, F.lit('"' + _MARK), F.lit('"'))
        return F.replace(found, F.lit(_MARK), F.lit(to))

    # Keys are the strings before a colon; only these are kept as they are.
    text = F.regexp_replace(text, F.lit(f"({_STRING}\\s*+:)\\s*+|{_STRING}"), F.lit("$1" + _MARK))
    text = F.replace(text, F.lit(":" + _MARK * 2), F.lit(':""'))
    text = F.replace(F.replace(text, F.lit(":" + _MARK), F.lit(":")), F.lit(_MARK), F.lit('""'))
    text = masked(text, r"-?\d[\d.eE+-]*+", "0")
    return F.when(F.contains(text, F.lit("false")), masked(text, "(?:true|false)", "true")).otherwise(text)


#: No parser of JSON texts goes deeper.
_DEEPEST = 1000


#: Levels told one by one; beyond them every opening bracket counts.
_TOLD = 6
_NO_BRACKET = r'(?:[^"{}\[\]]++|%s)++|"' % _STRING


def nesting(text: Column) -> Column:
    """How many objects and arrays of the JSON in ``text`` lie in each other, or a few more.

    Only brackets are left, of one sort, then empty pairs go, the innermost level each time.
    Exact up to ``_TOLD`` levels and for deeper texts that open no more than one thing a level.
    """
    brackets = F.translate(F.regexp_replace(text, F.lit(_NO_BRACKET), F.lit("")), "[]", "{}")

    def told(left: Column) -> Column:
        depth = F.lit(0)
        for _ in range(_TOLD):
            depth = depth + F.when(F.contains(left, F.lit("{")), 1).otherwise(0)
            left = F.replace(left, F.lit("{}"), F.lit(""))
        opened = F.octet_length(left) - F.octet_length(F.replace(left, F.lit("{"), F.lit("")))
        return F.least(depth + opened, F.lit(_DEEPEST))

    # A lambda has its value worked out once.
    return F.element_at(F.transform(F.array(brackets), told), 1)


def nesting_bound(text: Column) -> Column:
    """No fewer steps than a walk over the JSON in ``text`` needs, found without looking into it.

    There is an opening bracket for each level. A walk ends by itself once nothing is left to be
    opened, so steps to spare cost next to nothing.
    """
    closed = F.replace(F.replace(text, F.lit("{"), F.lit("")), F.lit("["), F.lit(""))
    return F.least(F.octet_length(text) - F.octet_length(closed), F.lit(_DEEPEST)) + 1


def n_inner(place: Column) -> Column:
    """Members or elements of a place; a size of NULL is -1 unless ANSI mode is on."""
    return (
        F.when(place["m"].isNotNull(), F.size(place["m"]))
        .when(place["a"].isNotNull(), F.size(place["a"]))
        .otherwise(0)
    )


def below(path: Column, key: Column) -> Column:
    return F.concat_ws(".", path, key)


def _opened(path: Column, v: Column) -> Column:
    """A place in a walk: what stands there, and its members or elements."""
    return F.struct(
        path.alias("path"), v.alias("v"), as_object(v).alias("m"), as_array(v).alias("a")
    )


def _inner(node: Column) -> Column:
    """Places right below; a value has members or elements, never both."""
    return F.coalesce(
        F.transform(
            F.map_entries(node["m"]), lambda e: _opened(below(node["path"], e["key"]), e["value"])
        ),
        F.transform(node["a"], lambda x: _opened(F.concat_ws("", node["path"], F.lit("[*]")), x)),
        empty("array<struct<path:string,v:variant,m:map<string,variant>,a:array<variant>>>"),
    )


def _is_open(place: Column) -> Column:
    return place["m"].isNotNull() | place["a"].isNotNull()


def _walk(start: Column, bound: Column, visit: Callable[[Column], Column], out: str) -> Column:
    """Breadth-first walk from ``start``; ``visit(frontier)`` gives what to keep.

    Once the frontier is empty the remaining steps hand the state on untouched.
    """
    first = F.struct(start.alias("frontier"), empty(f"array<{out}>").alias("done"))

    def step(state: Column, _: Column) -> Column:
        frontier = state["frontier"]
        # What each level gave is kept as it is and joined once, at the end.
        return F.when(F.size(frontier) == 0, state).otherwise(
            F.struct(
                F.flatten(F.transform(F.filter(frontier, _is_open), _inner)).alias("frontier"),
                F.array_append(state["done"], visit(frontier)).alias("done"),
            )
        )

    return F.aggregate(F.sequence(F.lit(1), bound), first, step, lambda s: F.flatten(s["done"]))


def all_paths(v: Column, bound: Column, mark_empty: bool = True) -> Column:
    """Every value inside ``v``, itself included, as ``(path, kind)``; [] for NULL."""
    root = F.filter(F.array(_opened(F.lit("$"), v)), lambda n: n["v"].isNotNull())
    return _walk(
        root,
        bound,
        lambda frontier: F.transform(
            frontier,
            lambda n: F.struct(
                n["path"].alias("path"), _kind(n["v"], n["m"], n["a"], mark_empty).alias("kind")
            ),
        ),
        PATHS_AND_KINDS,
    )


def leaf_paths(start: Column, bound: Column) -> Column:
    """Distinct paths of scalars and empty containers under the values in ``start``."""
    found = _walk(
        F.transform(start, lambda n: _opened(n["path"], n["v"])),
        bound,
        lambda frontier: F.transform(
            F.filter(
                frontier, lambda n: n_inner(n) <= 0
            ),
            lambda n: n["path"],
        ),
        "array<string>",
    )
    return F.array_distinct(found)
