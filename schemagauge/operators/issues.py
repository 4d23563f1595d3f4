"""What a schema misses: attribute paths of failing rows, and the edits they ask for.

Paths are found inside the row, so a row never has to be regrouped; the first
shuffle is the distinct over paths, which combines on the map side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from schemagauge.functions import variants as V
from schemagauge.operators import tabled
from schemagauge.operators.schema import Schema, to_schema
from schemagauge.operators.verdict import by_key, members_hold, parsed, verdict
from schemagauge.session import prepare


def missing(node: Schema, v: Column, path: Column, mode: str) -> Column:
    """Unknown subtrees of ``v`` as ``array<struct<path, v>>``, not yet flattened.

    Alternatives contribute through all their branches. Unknown members of an
    object count only if the object is closed and one of its members fails.
    """
    alternatives = node.any_of if node.any_of is not None else node.one_of
    if alternatives is not None:
        parts = [missing(b, v, path, mode) for b in dict.fromkeys(alternatives) if _reports(b)]
        return F.concat(V.empty(V.PATHS_AND_VALUES), *parts)
    parts = [V.empty(V.PATHS_AND_VALUES)]
    inner = [s for _, s in node.properties or () if _reports(s)]
    if inner or not node.additional:
        parts.append(V.bind_array(V.as_object(v), lambda m: _of_object(node, m, path, mode)))
    if node.items is not None and _reports(node.items):
        below = F.concat(path, F.lit("[*]"))
        parts.append(
            V.bind_array(
                V.as_array(v),
                lambda a: F.flatten(
                    F.transform(a, lambda x: missing(node.items, x, below, mode))
                ),
            )
        )
    return F.concat(*parts)


def _reports(node: Schema) -> bool:
    """Whether any value at all could make ``node`` name a missing path."""
    alternatives = node.any_of if node.any_of is not None else node.one_of
    if alternatives is not None:
        return any(_reports(b) for b in alternatives)
    if not node.additional or (node.items is not None and _reports(node.items)):
        return True
    return any(_reports(s) for _, s in node.properties or ())


def _of_object(node: Schema, m: Column, path: Column, mode: str) -> Column:
    def below(key: Column) -> Column:
        return F.concat(path, F.lit("."), key)

    def named(entries: Column) -> Column:
        return F.transform(
            entries, lambda e: F.struct(below(e["key"]).alias("path"), e["value"].alias("v"))
        )

    nothing = V.empty(V.PATHS_AND_VALUES)
    entries = F.map_entries(m)
    if node.properties is None:
        return nothing if node.additional else named(entries)
    known = F.flatten(
        F.transform(
            entries,
            lambda e: by_key(
                e["key"],
                node,
                lambda s: missing(s, e["value"], below(e["key"]), mode)
                if _reports(s)
                else nothing,
                nothing,
            ),
        )
    )
    if node.additional:
        return known
    names = [name for name, _ in node.properties]
    unknown = F.filter(entries, lambda e: ~e["key"].isin(names)) if names else entries
    return F.concat(
        known, F.when(members_hold(node, m, mode), nothing).otherwise(named(unknown))
    )


def charged(schema: str | Schema, v: Column, bound: Column, mode: str = "failfast") -> Column:
    """``struct<n, entity_idx, paths>`` for a row known to fail.

    Under a root ``anyOf`` the row is charged to the branch with the fewest paths,
    none counting as one, and to the first of several such branches.
    """
    node = to_schema(schema)
    if tabled.is_large(node):
        return _fewest(tabled.missing(node, v, mode), bound)
    return _fewest(
        F.array(*[missing(entity, v, F.lit("$"), mode) for entity in node.entities()]), bound
    )


def _fewest(unknown: Column, bound: Column) -> Column:
    """The entity with the fewest paths, from the unknown subtrees of each."""
    per_entity = F.transform(unknown, lambda start: V.leaf_paths(start, bound))
    return F.array_min(
        F.transform(
            per_entity,
            lambda paths, idx: F.struct(
                F.greatest(F.size(paths), F.lit(1)).alias("n"),
                idx.alias("entity_idx"),
                paths.alias("paths"),
            ),
        )
    )


def judged(schema: str | Schema, v: Column, bound: Column, mode: str = "failfast") -> Column:
    """``struct<accepted, charge>`` of a value, the verdict worked out once; NULL where ``v`` is NULL."""
    node = to_schema(schema)
    if tabled.is_large(node):
        return tabled.judged(node, v, mode, lambda unknown: _fewest(unknown, bound))
    made = F.transform(
        F.array(verdict(node, v, mode)),
        lambda ok: V.record(accepted=ok, charge=F.when(~ok, charged(node, v, bound, mode))),
    )
    return F.when(v.isNotNull(), F.get(made, F.lit(0)))


def assess(
    rows: DataFrame, schema: str | Schema, col: str = "value", mode: str = "permissive"
) -> DataFrame:
    """Add ``status``, and for rejected rows ``entity_idx`` and their ``paths``."""
    prepare(rows.sparkSession)
    node = to_schema(schema)
    v = parsed(F.col(col), mode)
    # Exploded, so that no later step works the verdict out again.
    found = F.explode(F.array(judged(node, F.col("_v"), V.nesting_bound(F.col(col)), mode)))
    status = (
        F.when(F.col("_v").isNull(), "malformed")
        .when(F.col("_judged.accepted"), "accepted")
        .otherwise("rejected")
    )
    return (
        rows.withColumn("_v", v)
        .withColumn("_judged", found)
        .withColumn("status", status)
        .withColumn("entity_idx", F.col("_judged.charge.entity_idx"))
        .withColumn("paths", F.col("_judged.charge.paths"))
        .drop("_v", "_judged")
    )


def failing_rows(
    rows: DataFrame, schema: str | Schema, col: str = "value", mode: str = "permissive"
) -> DataFrame:
    """The rows the schema does not accept, malformed ones included."""
    prepare(rows.sparkSession)
    return rows.filter(~verdict(schema, parsed(F.col(col), mode), mode))


def _rejected(rows: DataFrame, schema: str | Schema, col: str, mode: str) -> DataFrame:
    """Rows that parse but fail, with what they are charged as ``_charge``."""
    prepare(rows.sparkSession)
    node = to_schema(schema)
    v = parsed(F.col(col), mode)
    parsing = rows.withColumn("_v", v).filter(F.col("_v").isNotNull())
    # Exploded, so that the filter doesn't work the verdict out a second time.
    found = F.explode(F.array(judged(node, F.col("_v"), V.nesting_bound(F.col(col)), mode)))
    failing = parsing.withColumn("_judged", found).filter(~F.col("_judged.accepted"))
    return failing.withColumn("_charge", F.col("_judged.charge")).drop("_v", "_judged")


def best_entity(
    rows: DataFrame, schema: str | Schema, col: str = "value", mode: str = "permissive"
) -> DataFrame:
    """Rejected rows with the entity each is charged to and its number of paths."""
    return (
        _rejected(rows, schema, col, mode)
        .withColumn("entity_idx", F.col("_charge.entity_idx"))
        .withColumn("n_paths", F.size("_charge.paths"))
        .drop("_charge")
    )


def missing_paths(
    rows: DataFrame, schema: str | Schema, col: str = "value", mode: str = "permissive"
) -> DataFrame:
    """Distinct ``(entity_idx, path)`` over all rejected rows.

    A schema that is held against rows by a table meets each of their structures once.
    """
    if tabled.is_large(to_schema(schema)):
        prepare(rows.sparkSession)
        parses = parsed(F.col(col), mode).isNotNull()
        rows = rows.select(F.when(parses, V.structure(F.col(col))).alias(col)).distinct()
    named = _rejected(rows, schema, col, mode).select(
        F.col("_charge.entity_idx").alias("entity_idx"),
        F.explode_outer("_charge.paths").alias("path"),
    )
    return named.filter(F.col("path").isNotNull()).distinct()


def required_edits(
    rows: DataFrame, schema: str | Schema, col: str = "value", mode: str = "permissive"
) -> DataFrame:
    """Number of missing paths, each counted once per entity."""
    return missing_paths(rows, schema, col, mode).agg(F.count("*").alias("required_edits"))


def strong_checks(schema: str | Schema, v: Column) -> Column:
    """Flags ``type_check``, ``object_max`` and ``array_max`` of one value at one node.

    Nodes with alternatives raise no flags, and flags never come from below.
    """
    node = to_schema(schema)
    no = F.lit(0)
    type_check = object_max = array_max = no
    if node.any_of is None and node.one_of is None:
        kind = V.kind(v)
        expected = "empty_array" if node.type == "array" else (node.type or "")
        scalar = kind.isin("string", "number", "boolean", "null", "empty_array")
        type_check = F.when(scalar & (kind != F.lit(expected)), 1).otherwise(0)
        if node.max_properties is not None:
            over = F.size(V.as_object(v)) > F.lit(node.max_properties)
            object_max = F.when((kind == "object") & over, 1).otherwise(0)
        if node.max_items is not None:
            over = F.size(V.as_array(v)) > F.lit(node.max_items)
            array_max = F.when((kind == "array") & over, 1).otherwise(0)
    return F.struct(
        type_check.alias("type_check"),
        object_max.alias("object_max"),
        array_max.alias("array_max"),
    )
