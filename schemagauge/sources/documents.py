"""Collections of schema documents as a table of nodes.

``schema_nodes`` explodes a column of schema texts without a shuffle: one document
is one cell, so its tree is walked within its row. Documents are bounded by the
size limit of a ``VARIANT``, hence no row can grow with the collection.

All edges are kept. Which of them a measure follows is told by the ``live_*`` flags:

==================  ==========================================================
``live_verdict``    ``anyOf``, else ``oneOf``, else properties and items
``live_shapes``     ``anyOf``, else ``oneOf``, else items, else properties
``live_leaves``     ``anyOf``, else items, else properties
``live_paths``      both sorts of alternatives, and properties, else items
==================  ==========================================================

``sid`` is the way to a node: a letter per edge (``a`` anyOf, ``o`` oneOf, ``i``
items, ``p`` property) and its position. ``steps`` tells keys (``.a``) from array
steps (``[*]``), which ``path``, the plain text of the same, cannot do for keys with
dots or brackets.

The walk carries only what has to come from above. All else is worked out after the
explode, where it compiles and where columns nobody asks for are pruned.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from schemagauge.functions import variants as V
from schemagauge.operators.schema import BLANKS, KEYWORDS, TYPE_WORDS
from schemagauge.session import prepare

# Bits of ``live``, one per way of going through a schema.
_VERDICT, _SHAPES, _LEAVES, _PATHS = 1, 2, 4, 8
_ALL = _VERDICT | _SHAPES | _LEAVES | _PATHS

_CARRIED = {
    "sid": "string",
    "steps": "array<string>",
    "key_is_required": "boolean",
    "live": "int",
    "outer_type": "string",
    "any_since": "boolean",
}
_HEAD = {
    "type": "string",
    "required": "array<string>",
    "head": "map<string,variant>",
}
_COUNTED = {"n_any": "int", "n_one": "int", "has_items": "boolean", "n_props": "int"}


def _array_of(*fields: dict[str, str]) -> str:
    return "array<struct<%s>>" % ",".join(f"{n}:{t}" for d in fields for n, t in d.items())


_PLACE = _array_of(_CARRIED, {"m": "map<string,variant>"})
_DONE = _array_of(_CARRIED, _HEAD, _COUNTED)


def schema_nodes(
    schemas: DataFrame, id_col: str = "schema_id", text_col: str = "schema_json", strict: bool = True
) -> DataFrame:
    """Nodes of every document in ``text_col``, keyed by ``id_col``.

    With ``strict`` a broken document or an unknown keyword is an error; otherwise
    broken documents have no nodes and others are told by ``supported``.
    """
    prepare(schemas.sparkSession)
    walk, rest, columns, unsupported = _expressions(schemas.sparkSession.sparkContext)
    plain = F.replace(F.col(text_col), F.lit("\\"), F.lit(""))
    document = F.parse_json(plain) if strict else F.try_parse_json(plain)
    # Outer, as for others Spark infers a filter which would walk every tree once more.
    rows = (
        schemas.select(
            id_col, document.alias("_document"), _levels(plain).alias("_levels")
        )
        .select(id_col, walk.alias("_nodes"))
        .select(id_col, "_nodes", *rest)
        .select(id_col, "_cuts", "root_has_any", F.inline_outer("_nodes"))
        .filter(F.col("sid").isNotNull())
    )
    if strict:
        # In a filter, which unlike a column is not pruned away where nobody asks for it.
        rows = rows.filter(unsupported)
    return rows.select(id_col, *columns)


@lru_cache(maxsize=4)
def _expressions(context: SparkContext) -> tuple[Column, list[Column], list[Column], Column]:
    """The walk over ``_document``, what is told of ``_nodes`` as a whole and of each node,
    and a condition which fails at a node that is not supported.

    They are the same for every table, and long enough to be worth keeping.
    """
    nodes = F.col("_nodes")
    root_has_any = F.try_element_at(nodes, F.lit(1))["n_any"].isNotNull()
    message = F.concat(F.lit("unsupported schema at $"), F.array_join("steps", ""))
    fine = F.col("sid").isNull() | _supported(F.col("head"))
    return (
        _walk(F.col("_document"), F.col("_levels")),
        [_cuts(nodes).alias("_cuts"), root_has_any.alias("root_has_any")],
        _described(),
        F.when(fine, True).otherwise(F.raise_error(message).cast("boolean")),
    )


def _described() -> list[Column]:
    sid, steps, head = F.col("sid"), F.col("steps"), F.col("head")
    last = F.substring_index("sid", "/", -1)
    letter = F.left(last, F.lit(1))
    edge = (
        F.when(letter == "a", "anyOf")
        .when(letter == "o", "oneOf")
        .when(letter == "i", "items")
        .when(letter == "p", "prop")
        .otherwise("root")
    )
    keys = F.filter(steps, lambda s: s != "[*]")
    branches = F.filter(F.split(sid, "/"), lambda s: F.left(s, F.lit(1)).isin("a", "o"))
    return [
        sid,
        F.when(sid != "", F.left(sid, F.length(sid) - F.length(last) - 1)).alias("parent_sid"),
        edge.alias("edge"),
        F.substring(last, 2, 10).try_cast("int").alias("ord"),
        F.when(letter == "p", _key_of(F.element_at(steps, -1))).alias("key"),
        (F.length(sid) - F.length(F.replace(sid, F.lit("/"), F.lit("")))).alias("depth"),
        F.concat(F.lit("$"), F.array_join(steps, "")).alias("path"),
        steps,
        F.transform(keys, _key_of).alias("key_path"),
        F.transform(branches, _position).alias("branch_path"),
        F.when(F.startswith(sid, F.lit("/a")), _position(F.split_part(sid, F.lit("/"), F.lit(2))))
        .alias("entity_idx"),
        F.col("root_has_any"),
        F.col("key_is_required"),
        *[
            (F.col("live").bitwiseAND(F.lit(bit)) != 0).alias(name)
            for name, bit in (
                ("live_verdict", _VERDICT),
                ("live_shapes", _SHAPES),
                ("live_leaves", _LEAVES),
                ("live_paths", _PATHS),
            )
        ],
        F.col("outer_type"),
        F.col("any_since"),
        F.col("type"),
        F.col("n_any").isNotNull().alias("has_any"),
        F.coalesce("n_any", F.lit(0)).alias("n_any"),
        F.col("n_one").isNotNull().alias("has_one"),
        F.coalesce("n_one", F.lit(0)).alias("n_one"),
        F.col("has_items"),
        F.col("n_props").isNotNull().alias("has_props"),
        F.coalesce("n_props", F.lit(0)).alias("n_props"),
        F.col("required"),
        _additional(head).alias("additional"),
        # Both words limit arrays; the text order of the two is lost in a VARIANT.
        F.coalesce(_number(head, "maxItems"), _number(head, "maxProperties")).alias("max_items"),
        _supported(head).alias("supported"),
        # Never null for Spark either, or a filter on it would walk every tree once more.
        F.coalesce(F.array_contains("_cuts", sid), F.lit(False)).alias("cut"),
        F.coalesce(
            F.exists("_cuts", lambda c: F.startswith(sid, F.concat(c, F.lit("/")))), F.lit(False)
        ).alias("under_cut"),
    ]


def _key_of(step: Column) -> Column:
    return F.substring(step, 2, 2**31 - 1)


def _position(segment: Column) -> Column:
    return F.substring(segment, 2, 10).try_cast("int")


# --- the walk ---------------------------------------------------------------------------


def _levels(plain: Column) -> Column:
    """No fewer levels of nodes than the document has: ``items`` goes one bracket down, all
    other edges two, and the last node may be none."""
    depth = V.nesting(plain)
    without = F.replace(plain, F.lit("items"), F.lit(""))
    n_items = F.floor((F.octet_length(plain) - F.octet_length(without)) / len("items"))
    return 1 + F.floor((depth + F.least(depth, n_items)) / 2).cast("int")


def _walk(document: Column, bound: Column) -> Column:
    root = V.record(
        sid=F.lit(""),
        steps=V.empty("array<string>"),
        key_is_required=F.lit(False),
        live=F.lit(_ALL),
        outer_type=F.lit("object"),
        any_since=F.lit(False),
        m=V.as_object(document),
    )
    roots = F.when(document.isNotNull(), F.array(root)).otherwise(V.empty(_PLACE))
    start = V.record(frontier=_opened(roots), done=V.empty(_DONE))

    def step(state: Column, _: Column) -> Column:
        frontier = state["frontier"]
        return F.when(F.size(frontier) == 0, state).otherwise(
            V.record(
                frontier=_opened(F.flatten(F.transform(frontier, _children))),
                done=F.concat(state["done"], F.transform(frontier, _finished)),
            )
        )

    return F.aggregate(F.sequence(F.lit(1), bound), start, step, lambda s: s["done"])


def _opened(places: Column) -> Column:
    """Read the keywords of each place once, for itself and for what is below."""

    def opened(n: Column) -> Column:
        m = n["m"]
        return V.record(
            **{name: n[name] for name in _CARRIED},
            type=_type(m),
            required=_required(m),
            head=F.map_filter(m, lambda k, _: ~k.isin("properties", "items")),
            any_of=V.as_array(_slot(m, "anyOf")),
            one_of=V.as_array(_slot(m, "oneOf")),
            items=_slot(m, "items"),
            props=V.as_object(_slot(m, "properties")),
        )

    return F.transform(places, opened)


def _finished(n: Column) -> Column:
    def size(v: Column) -> Column:
        return F.when(v.isNotNull(), F.size(v))

    return V.record(
        **{name: n[name] for name in (*_CARRIED, *_HEAD)},
        n_any=size(n["any_of"]),
        n_one=size(n["one_of"]),
        has_items=n["items"].isNotNull(),
        n_props=size(n["props"]),
    )


def _children(n: Column) -> Column:
    """All four sorts of children of an opened node."""
    has_any, has_one = n["any_of"].isNotNull(), n["one_of"].isNotNull()
    has_items, has_props = n["items"].isNotNull(), n["props"].isNotNull()

    def mask(*bits: tuple[int, Column | None]) -> Column:
        total = F.lit(0)
        for bit, condition in bits:
            total = total + (F.lit(bit) if condition is None else F.when(condition, bit).otherwise(0))
        return n["live"].bitwiseAND(total)

    def child(tag, position, steps, required, live, outer, since, v):
        return V.record(
            sid=F.concat_ws("", n["sid"], F.lit("/" + tag), position.cast("string")),
            steps=steps,
            key_is_required=required,
            live=live,
            outer_type=outer,
            any_since=since,
            m=V.as_object(v),
        )

    no, yes = F.lit(False), F.lit(True)
    of_any = mask((_ALL, None))
    of_one = mask((_VERDICT, ~has_any), (_SHAPES, ~has_any), (_PATHS, None))
    of_items = mask(
        (_VERDICT, ~has_any & ~has_one),
        (_SHAPES, ~has_any & ~has_one),
        (_LEAVES, ~has_any),
        (_PATHS, ~has_props),
    )
    of_props = mask(
        (_VERDICT, ~has_any & ~has_one),
        (_SHAPES, ~has_any & ~has_one & ~has_items),
        (_LEAVES, ~has_any & ~has_items),
        (_PATHS, None),
    )

    def branches(field: str, tag: str, live: Column, since: Column) -> Column:
        return F.transform(
            n[field],
            lambda x, i: child(tag, i, n["steps"], no, live, n["outer_type"], since, x),
        )

    def item(x: Column) -> Column:
        steps = F.array_append(n["steps"], "[*]")
        return child("i", F.lit(0), steps, no, of_items, n["type"], no, x)

    def prop(e: Column, i: Column) -> Column:
        key = F.ltrim(e["key"], F.lit(BLANKS))
        steps = F.array_append(n["steps"], F.concat_ws("", F.lit("."), key))
        required = F.array_contains(n["required"], key)
        return child("p", i, steps, required, of_props, n["type"], no, e["value"])

    sorts = F.array(
        branches("any_of", "a", of_any, yes),
        branches("one_of", "o", of_one, n["any_since"]),
        F.transform(F.filter(F.array(n["items"]), lambda x: x.isNotNull()), item),
        F.transform(F.map_entries(n["props"]), prop),
    )
    return F.flatten(F.filter(sorts, lambda s: s.isNotNull()))


# --- keywords ---------------------------------------------------------------------------


def _slot(m: Column, keyword: str) -> Column:
    return F.element_at(m, F.lit(keyword))


def _type(m: Column) -> Column:
    v = _slot(m, "type")
    word = F.when(V.is_string(v), F.try_variant_get(v, "$", "string"))
    pairs = [F.lit(x) for pair in TYPE_WORDS.items() for x in pair]
    return F.element_at(F.create_map(*pairs), F.trim(word, F.lit(BLANKS)))


def _required(m: Column) -> Column:
    names = F.try_variant_get(_slot(m, "required"), "$", "array<string>")
    return F.coalesce(
        F.array_distinct(F.transform(names, lambda x: F.ltrim(x, F.lit(BLANKS)))),
        V.empty("array<string>"),
    )


def _additional(m: Column) -> Column:
    return F.coalesce(
        F.try_variant_get(_slot(m, "additionalProperties"), "$", "boolean"), F.lit(False)
    )


def _number(m: Column, keyword: str) -> Column:
    return F.try_variant_get(_slot(m, keyword), "$", "double")


def _supported(head: Column) -> Column:
    """Only known keywords, each with a value of the kind it takes.

    ``properties`` and ``items`` are told by the nodes below them.
    """

    def entry(e: Column) -> Column:
        word, v = e["key"], e["value"]
        texts = F.coalesce(F.forall(V.as_array(v), V.is_string), F.lit(False))
        return (
            F.when(word == "type", F.col("type").isNotNull())
            .when(word == "required", texts)
            .when(word.isin("anyOf", "oneOf"), V.as_array(v).isNotNull())
            .when(word.isin("maxItems", "maxProperties"), V.is_number(v))
            .when(word == "additionalProperties", V.is_boolean(v))
            .when(word.isin(list(KEYWORDS)), V.is_string(v))
            .otherwise(False)
        )

    return F.coalesce(F.forall(F.map_entries(head), entry), F.lit(False))


# --- repeated open objects --------------------------------------------------------------


def _cuts(nodes: Column) -> Column:
    """``sid`` of each open object whose key path was seen open before.

    Going through a document branch by branch, such an object counts once, and
    nothing below it is looked at.
    """
    is_open = F.filter(
        nodes,
        lambda n: (n["live"].bitwiseAND(F.lit(_SHAPES)) != 0)
        & n["n_any"].isNull()
        & n["n_one"].isNull()
        & ~n["has_items"]
        & _additional(n["head"]),
    )
    in_order = F.array_sort(
        F.transform(
            is_open,
            lambda n: V.record(
                positions=F.transform(F.split(n["sid"], "/"), _position),
                sid=n["sid"],
                keys=F.filter(n["steps"], lambda s: s != "[*]"),
            ),
        )
    )
    start = V.record(seen=V.empty("array<array<string>>"), cuts=V.empty("array<string>"))

    def step(state: Column, n: Column) -> Column:
        # What lies under a cut object directly follows it in this order.
        last = F.coalesce(F.try_element_at(state["cuts"], F.lit(-1)), F.lit("-"))
        repeated = F.array_contains(state["seen"], n["keys"])
        seen = F.when(repeated, state["seen"]).otherwise(F.array_append(state["seen"], n["keys"]))
        cuts = F.when(repeated, F.array_append(state["cuts"], n["sid"])).otherwise(state["cuts"])
        return F.when(F.startswith(n["sid"], F.concat(last, F.lit("/"))), state).otherwise(
            V.record(seen=seen, cuts=cuts)
        )

    return F.aggregate(in_order, start, step, lambda s: s["cuts"])
