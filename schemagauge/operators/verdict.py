"""Does a value satisfy a schema? The schema becomes one boolean Column.

A schema beyond the limits of :mod:`schemagauge.operators.tabled` becomes a table instead,
by the same rules. The expression is narrow, holds no Python, and reads each value once: an object
node makes a single pass over its members, in which properties with equal
sub-schemas share a branch. The rules, which differ from standard JSON Schema:

- objects are closed unless ``additionalProperties`` is true, and then required
  keys are waived as well;
- a non-empty object fails where the schema has no ``properties``;
- ``oneOf`` means at least one, exactly as ``anyOf``;
- an empty array passes any array schema, whatever its items and limits;
- a node with neither ``type`` nor alternatives is an error once data reaches it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from schemagauge.functions import variants as V
from schemagauge.operators import tabled
from schemagauge.operators.schema import Schema, SchemaError, to_schema
from schemagauge.session import prepare

_SCALAR_TESTS = {
    "string": V.is_string,
    "number": V.is_number,
    "boolean": V.is_boolean,
    "null": V.is_null,
}
_LARGE = 32 << 20  # bytes of a text which a VARIANT may be unable to hold
_CHAIN = 8  # branches tried one after another before keys are split by halves

MODES = ("failfast", "permissive")


def verdict(schema: str | Schema, v: Column, mode: str = "failfast") -> Column:
    """Boolean Column: ``v`` satisfies ``schema``; false where ``v`` is NULL."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}, not {mode!r}")
    node = to_schema(schema)
    if node.any_of == ():
        raise SchemaError("the root anyOf has no branches")
    large = tabled.is_large(node)
    return F.coalesce((tabled.holds if large else holds)(node, v, mode), F.lit(False))


def holds(node: Schema, v: Column, mode: str) -> Column:
    if node.any_of is not None:
        return _any(node.any_of, v, mode)
    if node.one_of is not None:
        if not node.one_of:
            return _broken("a oneOf without branches met a value", mode)
        return _any(node.one_of, v, mode)
    if node.type is None:
        return _broken("a schema node without type, anyOf or oneOf met a value", mode)
    if node.type == "object":
        return V.bind_test(V.as_object(v), lambda m: _object(node, m, mode))
    if node.type == "array":
        return V.bind_test(V.as_array(v), lambda a: _array(node, a, mode))
    return _SCALAR_TESTS[node.type](v)


def _broken(message: str, mode: str) -> Column:
    if mode == "permissive":
        return F.lit(False)
    return F.raise_error(F.lit(message)).cast("boolean")


def _any(branches: tuple[Schema, ...], v: Column, mode: str) -> Column:
    return balanced(
        [holds(b, v, mode) for b in dict.fromkeys(branches)], lambda a, b: a | b, F.lit(False)
    )


def _object(node: Schema, m: Column, mode: str) -> Column:
    tests = []
    if node.required and not node.additional:
        tests.append(_all_present(sorted(node.required), m))
    if node.max_properties is not None:
        tests.append((F.size(m) == 0) | (F.size(m) <= F.lit(node.max_properties)))
    tests.append(members_hold(node, m, mode))
    return balanced(tests, lambda a, b: a & b, F.lit(True))


def _all_present(required: list[str], m: Column) -> Column:
    if len(required) <= 2:
        present = [F.map_contains_key(m, F.lit(k)) for k in required]
        return balanced(present, lambda a, b: a & b, F.lit(True))
    # Keys are distinct, so all are present if as many are found.
    return F.size(F.filter(F.map_keys(m), lambda k: k.isin(required))) == len(required)


def members_hold(node: Schema, m: Column, mode: str) -> Column:
    """Every member is a known property that holds, or unknown and allowed."""
    if node.properties is None:
        return F.size(m) == 0
    return F.forall(
        F.map_entries(m),
        lambda e: by_key(
            e["key"],
            node,
            lambda inner: holds(inner, e["value"], mode),
            F.lit(node.additional),
        ),
    )


def _array(node: Schema, a: Column, mode: str) -> Column:
    tests = []
    if node.max_items is not None:
        tests.append((F.size(a) == 0) | (F.size(a) <= F.lit(node.max_items)))
    if node.items is not None:
        tests.append(F.forall(a, lambda x: holds(node.items, x, mode)))
    return balanced(tests, lambda a, b: a & b, F.lit(True))


def by_key(
    key: Column, node: Schema, make: Callable[[Schema], Column], default: Column
) -> Column:
    """CASE over the properties of ``node``, one branch per distinct sub-schema."""
    return _split(key, sorted(node.properties, key=lambda p: p[0].encode()), make, default)


def _split(key, properties, make, default) -> Column:
    groups: dict[Schema, list[str]] = {}
    for name, inner in properties:
        groups.setdefault(inner, []).append(name)
    if len(groups) > _CHAIN:
        half = len(properties) // 2
        pivot = properties[half][0]
        low = _split(key, properties[:half], make, default)
        high = _split(key, properties[half:], make, default)
        return F.when(key < F.lit(pivot), low).otherwise(high)
    if not groups:
        return default
    chain = F
    for inner, names in groups.items():
        chain = chain.when(key.isin(names), make(inner))
    return chain.otherwise(default)


def balanced(
    parts: list[Column], join: Callable[[Column, Column], Column], nothing: Column
) -> Column:
    """Join conditions as a balanced tree, which keeps wide schemas shallow."""
    if not parts:
        return nothing
    if len(parts) == 1:
        return parts[0]
    half = len(parts) // 2
    return join(balanced(parts[:half], join, nothing), balanced(parts[half:], join, nothing))


def parsed(value: Column, mode: str = "failfast") -> Column:
    """``VARIANT`` of a JSON text; broken text raises, or is NULL in ``permissive``."""
    return F.parse_json(value) if mode == "failfast" else F.try_parse_json(value)


def validate(
    rows: DataFrame, schema: str | Schema, col: str = "value", mode: str = "permissive"
) -> DataFrame:
    """Add ``status``: ``accepted``, ``rejected`` or, for broken text, ``malformed``.

    A text of over 32 MiB that gave no ``VARIANT`` is ``oversized``: it may be sound, but larger
    than a ``VARIANT`` can hold, and is not judged.
    """
    prepare(rows.sparkSession)
    v = parsed(F.col(col), mode)
    return rows.withColumn(
        "status",
        F.when(v.isNull() & (F.octet_length(col) > _LARGE), "oversized")
        .when(v.isNull(), "malformed")
        .when(verdict(schema, v, mode), "accepted")
        .otherwise("rejected"),
    )
