"""Schemas of any size and depth, held against values by a table instead of an expression.

A compiled schema grows the plan, and so the time to plan it. Here the schema is one literal:
a table of its nodes and one of the steps between them. The plan is the same for any schema,
holds no Python, and follows the rules of :mod:`schemagauge.operators.verdict`, of which it is the other
form; ``is_large`` only decides which is planned.

A row is opened level by level. A value knows its number among the values one level up and, for
each node that one is held against, the nodes that it is held against itself: the branches of
alternatives, in order, without the alternatives. Then verdicts are folded upwards, a level at a
time: the first branch that doesn't fail decides alternatives, the first part that doesn't hold
an object or array. Missing paths are gathered on a third pass, downwards. Each pass
reads a value once for each of its nodes.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from schemagauge.functions import variants as V
from schemagauge.operators.schema import Schema

# Up to these an expression is planned in a second or two.
LARGEST_EXPRESSION = 60
DEEPEST_EXPRESSION = 7

FAILS, HOLDS, UNKNOWN = 0, 1, 3
#: Verdicts of nodes that are errors once a value meets them, and what they say.
BROKEN = {
    2: "a schema node without type, anyOf or oneOf met a value",
    4: "a oneOf without branches met a value",
}

_TABLES = (
    "struct<nodes:array<struct<sort:string,open:boolean,props:boolean,items:array<int>,longest:double,"
    "widest:double,required:array<string>,broken:int>>,"
    "steps:array<array<struct<node:int,name:string,to:array<int>>>>,"
    "start:array<int>,entities:array<array<int>>>"
)
_PLACE = (
    "struct<key:string,up:int,v:variant,m:map<string,variant>,a:array<variant>,kind:string,n:int,opened:int,"
    "nodes:array<int>,asked:array<array<int>>>"
)
_PLACES = f"array<{_PLACE}>"
_BLOCK = 256


def is_large(node: Schema) -> bool:
    return node.size() > LARGEST_EXPRESSION or node.depth() > DEEPEST_EXPRESSION


class _Compiler:
    """Numbers the nodes of a schema that are no alternatives; equal ones are one."""

    def __init__(self):
        self.numbers: dict[tuple, int] = {}
        self.nodes: list[dict] = []
        self.members: list[dict[str, list[int]]] = []

    def _number(self, node: dict, members: dict[str, tuple[int, ...]]) -> int:
        key = json.dumps(node), tuple(members.items())
        if key not in self.numbers:
            self.numbers[key] = len(self.nodes)
            self.nodes.append(node)
            self.members.append(members)
        return self.numbers[key]

    def branches(self, node: Schema) -> tuple[int, ...]:
        """What a value may satisfy to satisfy ``node``, in order."""
        options = node.any_of if node.any_of is not None else node.one_of
        if options:
            return tuple(dict.fromkeys(n for b in options for n in self.branches(b)))
        if options is not None:
            return () if node.any_of is not None else (self._number({"broken": 4, "open": True, "props": False}, {}),)
        members = {name: self.branches(inner) for name, inner in node.properties or ()}
        found = {
            "sort": node.type,
            "open": node.additional,
            "props": node.properties is not None,
            "items": None if node.items is None else self.branches(node.items),
            "longest": node.max_items,
            "widest": node.max_properties,
            "required": sorted(node.required) or None,
            "broken": 2 if node.type is None else None,
        }
        return (self._number(found, members),)


def _slot(name: str, node: int, slots: int) -> int:
    return (zlib.crc32(name.encode()) + 40_503 * node) % slots


def tables(schema: Schema) -> str:
    """The tables of a schema as JSON: nodes, and steps dealt out by the hash of node and name."""
    compiler = _Compiler()
    entities = [compiler.branches(e) for e in schema.entities()]
    start = compiler.branches(schema)
    slots = max(1, sum(map(len, compiler.members)))
    steps: list[list[dict]] = [[] for _ in range(slots)]
    for number, members in enumerate(compiler.members):
        for name, to in members.items():
            steps[_slot(name, number, slots)].append({"node": number, "name": name, "to": to})
    return json.dumps({"nodes": compiler.nodes, "steps": steps, "start": start, "entities": entities})


def _bind(value: Column, make: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once, then an expression over it.

    A fold over nothing hands its start on as it is; ``transform`` would copy what it makes, deeply.
    """
    return F.aggregate(V.empty("array<int>"), value, lambda x, _: x, make)


def _first(codes: Column, passed_over: int) -> Column:
    """The first code that is another one than ``passed_over``, which is the last resort."""
    return F.coalesce(F.get(F.filter(codes, lambda c: c != passed_over), F.lit(0)), F.lit(passed_over))


def _running(sizes: Column) -> Column:
    """The sums before each size; blocks keep what is copied in proportion to their number."""

    def of_block(total: Column, block: Column) -> Column:
        start = V.record(total=total, sums=V.empty("array<int>"))
        return F.aggregate(
            block, start, lambda s, x: V.record(total=s["total"] + x, sums=F.array_append(s["sums"], s["total"]))
        )

    def step(state: Column, at: Column) -> Column:
        found = of_block(state["total"], F.slice(sizes, at + 1, F.lit(_BLOCK)))
        return _bind(
            found, lambda f: V.record(total=f["total"], sums=F.array_append(state["sums"], f["sums"]))
        )

    start = V.record(total=F.lit(0), sums=V.empty("array<array<int>>"))
    blocks = F.sequence(F.lit(0), F.size(sizes) - 1, F.lit(_BLOCK))
    return F.aggregate(blocks, start, step, lambda s: F.flatten(s["sums"]))


def _place(key: Column, up: Column, v: Column, asked: Column) -> Column:
    def made(inner: Column) -> Column:
        asked = inner["asked"]
        nodes = F.array_distinct(F.flatten(F.filter(asked, lambda a: a.isNotNull())))
        kind = (
            F.when(inner["m"].isNotNull(), "object").when(inner["a"].isNotNull(), "array")
            .otherwise(V.scalar_kind(v))
        )
        return _bind(
            nodes,
            lambda held: V.record(
                key=key, up=up, v=v, m=inner["m"], a=inner["a"], kind=kind, n=V.n_inner(inner),
                opened=F.when(F.size(held) > 0, V.n_inner(inner)).otherwise(0), nodes=held, asked=asked,
            ),
        )

    return _bind(V.record(m=V.as_object(v), a=V.as_array(v), asked=asked), made)


def _inside(t: Column, p: Column, number: Column) -> Column:
    """The places right below, where any node is to be held against them."""

    def step(node: Column, name: Column) -> Column:
        slot = (F.crc32(name.cast("binary")) + F.lit(40_503).cast("long") * node) % F.size(t["steps"])
        found = F.filter(F.get(t["steps"], slot.cast("int")), lambda e: (e["node"] == node) & (e["name"] == name))
        return F.get(found, F.lit(0))["to"]

    members = F.transform(
        F.map_entries(p["m"]),
        lambda e: _place(e["key"], number, e["value"], F.transform(p["nodes"], lambda n: step(n, e["key"]))),
    )
    no_key = F.lit(None).cast("string")
    elements = F.transform(
        p["a"],
        lambda x: _place(no_key, number, x, F.transform(p["nodes"], lambda n: F.get(t["nodes"], n)["items"])),
    )
    return F.when(p["opened"] > 0, F.coalesce(members, elements, V.empty(_PLACES))).otherwise(V.empty(_PLACES))


def _levels(t: Column, v: Column, depth: int) -> Column:
    """The places of a row by level, each level with the number of the first place below each.

    The last level is one below the schema: what an object has there is unknown to it.
    """
    root = _place(F.lit(None).cast("string"), F.lit(-1), v, F.array(t["start"]))
    first = V.record(frontier=F.array(root).cast(_PLACES), done=V.empty(f"array<struct<places:{_PLACES},firsts:array<int>>>"))

    def step(state: Column, _: Column) -> Column:
        here = state["frontier"]
        level = V.record(places=here, firsts=_running(F.transform(here, lambda p: p["opened"])))
        opened = V.record(
            frontier=F.flatten(F.transform(here, lambda p, i: _inside(t, p, i))), done=F.array_append(state["done"], level)
        )
        return F.when(F.size(here) == 0, state).otherwise(opened)

    return F.aggregate(F.sequence(F.lit(0), F.lit(depth)), first, step, lambda s: s["done"])


def _judged(t: Column, p: Column, below: Column, failfast: bool) -> Column:
    """Of each node that a place is held against, its verdict, and whether its object is shut:
    closed, with a member that doesn't hold. ``below`` has the verdicts of the places inside."""

    def of_node(number: Column, k: Column) -> Column:
        def made(node: Column) -> Column:
            def of_part(codes: Column) -> Column:
                code = F.get(codes, k)
                let_in = F.when((p["kind"] == "array") | node["open"], HOLDS).otherwise(FAILS)
                return F.when(code == UNKNOWN, let_in).otherwise(code)

            parts = _first(F.transform(below, of_part), HOLDS)
            bare = (p["kind"] == "object") & ~node["props"]
            inner = F.when(bare, F.when(p["n"] == 0, HOLDS).otherwise(FAILS)).otherwise(parts)
            broken = node["broken"] if failfast else F.lit(FAILS)
            named = F.coalesce(
                F.forall(node["required"], lambda name: F.map_contains_key(p["m"], name)) | node["open"], F.lit(True)
            )

            def verdict(inner: Column) -> Column:
                limit = F.when(p["kind"] == "array", node["longest"]).otherwise(node["widest"])
                fits = (p["n"] == 0) | limit.isNull() | (p["n"] <= limit)
                held = (
                    F.when(node["broken"].isNotNull(), broken)
                    .when(node["sort"] != p["kind"], FAILS)
                    .when(~p["kind"].isin("object", "array"), HOLDS)
                    .when((p["kind"] == "object") & ~named, FAILS)
                    .when(~fits, FAILS)
                    .otherwise(inner)
                )
                shut = F.when((p["kind"] == "object") & ~node["open"], F.when(inner == FAILS, 1).when(inner != HOLDS, inner))
                return V.record(held=held.cast("int"), shut=F.coalesce(shut, F.lit(0)).cast("int"))

            return _bind(inner, verdict)

        return _bind(F.get(t["nodes"], number), made)

    def codes(found: Column) -> Column:
        def of(number: Column) -> Column:
            return F.get(found, F.array_position(p["nodes"], number).cast("int") - 1)["held"]

        asked = F.transform(
            p["asked"], lambda a: F.when(a.isNull(), UNKNOWN).otherwise(_first(F.transform(a, of), FAILS)).cast("int")
        )
        return V.record(codes=asked, shut=F.transform(found, lambda x: x["shut"]))

    return _bind(F.transform(p["nodes"], of_node), codes)


_SHUT = f"array<struct<places:{_PLACES},shut:array<array<int>>>>"


def _folded(t: Column, v: Column, depth: int, mode: str) -> Column:
    """``struct<codes, levels>``: the verdict of the root, and the places by level with what is shut there."""

    def step(state: Column, level: Column) -> Column:
        def judged(p: Column, i: Column) -> Column:
            kids = F.slice(state["codes"], F.get(level["firsts"], i) + 1, p["opened"])
            return _judged(t, p, kids, mode == "failfast")

        def made(found: Column) -> Column:
            kept = V.record(places=level["places"], shut=F.transform(found, lambda x: x["shut"]))
            return V.record(
                codes=F.transform(found, lambda x: x["codes"]), levels=F.array_prepend(state["levels"], kept)
            )

        return _bind(F.transform(level["places"], judged), made)

    start = V.record(codes=V.empty("array<array<int>>"), levels=V.empty(_SHUT))
    return F.aggregate(F.reverse(_levels(t, v, depth)), start, step)


def _missing(levels: Column, entity: Column) -> Column:
    """Unknown subtrees of an entity as ``array<struct<path, v>>``, not yet flattened."""

    def step(state: Column, level: Column) -> Column:
        def below(c: Column) -> Column:
            """What the place above asks for in the name of the entity, and whether it misses this one."""
            up = F.get(state["places"], c["up"])
            mine = F.get(state["active"], c["up"])
            shut = F.get(state["shut"], c["up"])

            def asks(nodes: Column) -> Column:
                asked = F.transform(
                    c["asked"],
                    lambda a, k: F.when(
                        F.array_contains(mine, F.get(nodes, k)), V.record(to=a, shut=F.get(shut, k))
                    ),
                )
                return F.filter(asked, lambda x: x.isNotNull())

            def found(asked: Column) -> Column:
                to = F.filter(F.transform(asked, lambda x: x["to"]), lambda x: x.isNotNull())
                misses = F.exists(asked, lambda x: x["to"].isNull() & (x["shut"] == 1))
                broken = F.filter(F.transform(asked, lambda x: x["shut"]), lambda s: s > 1)
                misses = F.when(F.size(broken) > 0, _error(F.get(broken, F.lit(0)))).otherwise(misses)
                step = F.coalesce(F.concat(F.lit("."), c["key"]), F.lit("[*]"))
                return V.record(
                    active=F.array_distinct(F.flatten(to)), misses=misses, path=F.concat(F.get(state["paths"], c["up"]), step)
                )

            return _bind(asks(up["nodes"]), found)

        top = V.record(active=entity, misses=F.lit(False), path=F.lit("$"))
        reached = F.transform(level["places"], lambda c: F.when(c["up"] < 0, top).otherwise(below(c)))

        def made(reached: Column) -> Column:
            both = F.zip_with(
                level["places"], reached, lambda c, r: F.when(r["misses"], V.record(path=r["path"], v=c["v"]))
            )
            return V.record(
                places=level["places"],
                shut=level["shut"],
                active=F.transform(reached, lambda r: r["active"]),
                paths=F.transform(reached, lambda r: r["path"]),
                found=F.concat(state["found"], F.filter(both, lambda x: x.isNotNull())),
            )

        return _bind(reached, made)

    start = V.record(
        places=V.empty(_PLACES),
        shut=V.empty("array<array<int>>"),
        active=V.empty("array<array<int>>"),
        paths=V.empty("array<string>"),
        found=V.empty(V.PATHS_AND_VALUES),
    )
    return F.aggregate(levels, start, step, lambda s: s["found"])


def _error(code: Column) -> Column:
    messages = F.when(code == 2, BROKEN[2]).otherwise(BROKEN[4])
    return F.raise_error(messages).cast("boolean")


def _with_tables(node: Schema, make: Callable[[Column], Column]) -> Column:
    literal = F.from_json(F.lit(tables(node)), _TABLES)
    return _bind(literal, make)


def root_code(node: Schema, v: Column, mode: str) -> Column:
    """The verdict of a value: 0 fails, 1 holds, others as in ``BROKEN``. NULL where ``v`` is NULL."""
    code = _with_tables(node, lambda t: _folded(t, v, node.depth(), mode)["codes"][0][0])
    return F.when(v.isNotNull(), code)


def holds(node: Schema, v: Column, mode: str) -> Column:
    """Boolean Column: ``v`` satisfies ``node``; NULL where ``v`` is NULL."""
    return _bind(root_code(node, v, mode), lambda c: F.when(c > 1, _error(c)).otherwise(c == HOLDS))


def missing(node: Schema, v: Column, mode: str) -> Column:
    """Unknown subtrees of ``v`` by entity, as ``array<array<struct<path, v>>>``."""
    return _with_tables(
        node,
        lambda t: _bind(
            _folded(t, v, node.depth(), mode)["levels"],
            lambda levels: F.transform(t["entities"], lambda e: _missing(levels, e)),
        ),
    )


def judged(node: Schema, v: Column, mode: str, charge: Callable[[Column], Column]) -> Column:
    """``struct<accepted, charge>``, worked out at one go; NULL where ``v`` is NULL.

    ``charge`` gets the unknown subtrees by entity of a value that fails.
    """

    def of(t: Column) -> Column:
        def made(state: Column) -> Column:
            code = state["codes"][0][0]
            accepted = F.when(code > 1, _error(code)).otherwise(code == HOLDS)
            unknown = F.transform(t["entities"], lambda e: _missing(state["levels"], e))
            return _bind(accepted, lambda ok: V.record(accepted=ok, charge=F.when(~ok, charge(unknown))))

        return _bind(_folded(t, v, node.depth(), mode), made)

    return F.when(v.isNotNull(), _with_tables(node, of))
