"""Measures of schemas themselves, over the node table of any number of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from schemagauge.functions import numbers as N
from schemagauge.functions import variants as V


def _checked(value: Column) -> Column:
    """An alternative without branches has no measure."""
    hollow = (F.col("has_any") & (F.col("n_any") == 0)) | (
        ~F.col("has_any") & F.col("has_one") & (F.col("n_one") == 0)
    )
    message = F.concat(F.lit("alternatives without branches at "), F.col("path"))
    return F.when(hollow & F.col("live_shapes"), F.raise_error(message)).otherwise(value)


def _childless() -> Column:
    return ~F.col("has_any") & ~F.col("has_items") & (F.col("n_props") == 0)


def precision(nodes: DataFrame, id_col: str = "schema_id") -> DataFrame:
    """``(id, precision, log2_precision)``: how many record shapes a schema admits.

    Alternatives add up, properties multiply: an optional property doubles its
    value, or, where it is a ``oneOf``, adds one to it. ``precision`` is an exact
    whole number as text, as there is no bound to its size.

    Slim nodes are gathered by schema, which is one cell's document again, and folded
    there from the last to the first; nothing is written in between and no level is
    looped over.
    """
    sums = F.col("has_any") | F.col("has_one") | F.col("has_items")
    leaf = F.col("cut") | (~sums & (F.col("n_props") == 0))
    as_property = F.col("edge") == "prop"
    optional = as_property & ~F.col("key_is_required")
    live = nodes.filter(F.col("live_shapes") & ~F.col("under_cut")).select(
        id_col,
        F.struct(
            "sid",
            "depth",
            _checked(F.when(leaf, 0).when(sums, 1).otherwise(2)).alias("op"),
            as_property.alias("multiplies"),
            F.when(optional & ~F.col("has_one"), 2).otherwise(1).alias("times"),
            F.when(optional & F.col("has_one"), 1).otherwise(0).alias("plus"),
        ).alias("node"),
    )
    # Below a node come first all that begin with its sid and a slash, so this order,
    # turned round, meets what is below a node just before the node.
    upwards = F.sort_array(F.collect_list("node"), asc=False)
    shapes = live.groupBy(id_col).agg(upwards.alias("nodes")).select(
        id_col, F.aggregate("nodes", V.empty(_STACK), _fold, lambda s: s[0]["n"]).alias("shapes")
    )
    return shapes.select(
        id_col,
        N.digits(F.col("shapes")).alias("precision"),
        N.log2(F.col("shapes")).alias("log2_precision"),
    )


_STACK = f"array<struct<depth:int,n:{N.NUMBER}>>"


def _fold(stack: Column, node: Column) -> Column:
    """Value of a node from the entry of those below it, into the entry of its own level.

    A level has one entry, the sum or product of the values met so far, and lower levels
    lie above it; a node takes away the entry of the level below.
    """
    depth = node["depth"]
    top = F.try_element_at(stack, F.lit(-1))
    inner = F.coalesce(top["depth"] > depth, F.lit(False))
    value = F.when((node["op"] != 0) & inner, top["n"]).otherwise(
        N.small(F.when(node["op"] == 1, 0).otherwise(1))
    )
    share = N.scaled(value, node["times"], node["plus"])
    rest = F.when(inner, F.slice(stack, F.lit(1), F.size(stack) - 1)).otherwise(stack)

    def put(state: Column) -> Column:
        entries, n = state["rest"], state["share"]
        own = F.try_element_at(entries, F.lit(-1))
        level = F.coalesce(own["depth"] == depth, F.lit(False))
        entry = F.when(level, N.joined(own["n"], n, node["multiplies"])).otherwise(n)
        others = F.when(level, F.slice(entries, F.lit(1), F.size(entries) - 1)).otherwise(entries)
        return F.concat(others, F.array(V.record(depth=depth, n=entry)))

    return N.bind(V.record(rest=rest, share=share), put)


def grouping(nodes: DataFrame, id_col: str = "schema_id") -> DataFrame:
    """``(id, grouping)``: entity alternatives, at least one unless the root is bare."""
    return nodes.groupBy(id_col).agg(_grouping().alias("grouping"))


def _grouping() -> Column:
    branches = F.sum(
        _checked(F.when((F.col("edge") == "anyOf") & F.col("live_shapes"), 1).otherwise(0))
    )
    bare = F.bool_or((F.col("edge") == "root") & _childless() & ~F.col("has_one"))
    return F.when(bare, F.lit(0)).otherwise(F.greatest(branches, F.lit(1))).cast("bigint")


def base_size(nodes: DataFrame, id_col: str = "schema_id") -> DataFrame:
    """``(id, base_size)``: branches of a root ``anyOf``, else one."""
    return nodes.filter(F.col("edge") == "root").select(id_col, _base_size().alias("base_size"))


def _base_size() -> Column:
    return F.when(F.col("has_any"), F.col("n_any")).otherwise(F.lit(1))


def _leaf() -> Column:
    return F.col("live_leaves") & _childless()


def attribute_count(nodes: DataFrame, id_col: str = "schema_id") -> DataFrame:
    """``(id, attributes)``: leaves, counted once per branch they occur in."""
    return nodes.groupBy(id_col).agg(F.count_if(_leaf()).alias("attributes"))


def attribute_set(nodes: DataFrame, id_col: str = "schema_id") -> DataFrame:
    """Distinct leaves as ``(id, name)``, ``name`` the keys and ``[*]`` steps to them."""
    name = F.transform(
        "steps", lambda s: F.when(s == "[*]", s).otherwise(F.substring(s, 2, 2**31 - 1))
    )
    return nodes.filter(_leaf()).select(id_col, name.alias("name")).distinct()


def attribute_diff(left: DataFrame, right: DataFrame, id_col: str = "schema_id") -> DataFrame:
    """Leaves of a schema in ``left`` which the one of equal id in ``right`` lacks."""
    ours, theirs = attribute_set(left, id_col), attribute_set(right, id_col)
    return ours.join(theirs, [id_col, "name"], "left_anti")


def nested_entities(nodes: DataFrame) -> DataFrame:
    """Object nodes which are array content with an ``anyOf`` in between."""
    return nodes.filter(
        (F.col("type") == "object") & (F.col("outer_type") == "array") & F.col("any_since")
    )


def schema_measures(nodes: DataFrame, id_col: str = "schema_id") -> DataFrame:
    """Precision, grouping and base size of every schema."""
    at_root = F.col("edge") == "root"
    others = nodes.groupBy(id_col).agg(
        _grouping().alias("grouping"),
        F.max(F.when(at_root, _base_size())).alias("base_size"),
    )
    return precision(nodes, id_col).join(others, id_col)
