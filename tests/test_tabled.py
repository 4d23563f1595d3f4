"""Schemas of any size and depth: tables against expressions and the plain models."""

import json
import random
import time

import pytest

from pyspark.sql import functions as F

from schemagauge.functions import variants as V
from schemagauge.operators import tabled
from schemagauge.operators.issues import assess, best_entity, missing_paths
from schemagauge.operators.relational import validate_by_joins
from schemagauge.operators.schema import load_schema
from schemagauge.operators.verdict import validate
from schemagauge.plans.summary import Check, summarize, summarize_many
from tests import model


def frame(spark, values):
    return spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)], "i int, value string")


@pytest.mark.parametrize("seed", range(6))
def test_tables_agree_with_the_model(spark, seed, monkeypatch):
    monkeypatch.setattr(tabled, "LARGEST_EXPRESSION", 0)
    rng = random.Random(100 + seed)
    schema = model.random_root(rng)
    values = [v for v in (model.random_value(rng, schema) for _ in range(150)) if isinstance(v, dict)]
    found = {r["i"]: r for r in assess(frame(spark, values), json.dumps(schema)).collect()}
    for i, v in enumerate(values):
        ok = model.holds(schema, v)
        assert found[i]["status"] == ("accepted" if ok else "rejected"), (schema, v)
        if not ok:
            assert (found[i]["entity_idx"], set(found[i]["paths"])) == model.charge(schema, v)


def mistaken(seed, n=30, values=40):
    """Schemas with nodes that lack a type or branches, and values."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        schema = {"type": "object", "properties": {k: model.random_mistaken(rng) for k in rng.sample(model.KEYS, 2)}}
        if rng.random() < 0.3:
            schema = {"anyOf": [schema, model.random_mistaken(rng, 2)]}
        out.append((schema, [model.random_instance(rng, schema) for _ in range(values)]))
    return out


@pytest.mark.parametrize("mode", ["failfast", "permissive"])
def test_errors_decide_where_they_come_first(spark, mode):
    seen = set()
    for schema, values in mistaken(1, n=8, values=150):
        code = tabled.root_code(load_schema(json.dumps(schema)), F.parse_json("value"), mode)
        found = frame(spark, values).select("i", code.alias("code")).collect()
        for r in found:
            assert r.code == model.code(schema, values[r.i], mode == "failfast"), (schema, values[r.i])
            seen.add(r.code)
    assert seen == ({0, 1, 2, 4} if mode == "failfast" else {0, 1})


def test_both_forms_agree_on_mistakes(spark, monkeypatch):
    """Statuses of all rows in ``permissive``, and of single rows, errors included, in ``failfast``."""
    rng = random.Random(9)
    for schema, values in mistaken(2, n=4):
        text, rows = json.dumps(schema), frame(spark, values)
        single = rng.sample(range(len(values)), 2)
        forms = []
        for largest in (10**6, 0):
            monkeypatch.setattr(tabled, "LARGEST_EXPRESSION", largest)
            monkeypatch.setattr(tabled, "DEEPEST_EXPRESSION", 10**6 if largest else 0)
            found = [sorted((r.i, r.status, r.entity_idx, tuple(sorted(r.paths or ()))) for r in assess(rows, text).collect())]
            for i in single:
                try:
                    found.append(validate(rows.filter(F.col("i") == i), text, mode="failfast").first().status)
                except Exception as error:
                    found.append([m for m in tabled.BROKEN.values() if m in str(error)])
            forms.append(found)
        assert forms[0] == forms[1], schema
        for i, status in zip(single, forms[0][1:]):
            expected = model.code(schema, values[i])
            assert status == {0: "rejected", 1: "accepted"}.get(expected, [tabled.BROKEN.get(expected)])


def test_an_empty_any_of_fails_and_an_empty_one_of_is_an_error(spark):
    deep = {"anyOf": []}
    for word, outcome in (("anyOf", None), ("oneOf", "without branches")):
        schema = {"type": "object", "properties": {"a": {word: []}} | {f"p{i}": {"type": "null"} for i in range(80)}}
        rows = frame(spark, [{"a": 1}])
        if outcome is None:
            assert validate(rows, json.dumps(schema), mode="failfast").first().status == "rejected"
        else:
            with pytest.raises(Exception, match=outcome):
                validate(rows, json.dumps(schema), mode="failfast").collect()
    assert model.code(deep, 1) == 0


def test_plans_hold_no_python_and_do_not_grow(spark, capsys):
    sizes = []
    for n in (100, 2500):
        wide = {f"p{i}": {"type": "object", "properties": {f"a{i}": {"type": "number"}}} for i in range(n)}
        rows = frame(spark, [{"p7": {"a7": 1}}])
        missing_paths(rows, json.dumps({"type": "object", "properties": wide})).explain()
        plan = capsys.readouterr().out
        assert "Python" not in plan and "Arrow" not in plan
        sizes.append(plan.count("lambda"))
    assert sizes[0] == sizes[1]


@pytest.mark.parametrize("n", [3, 700, 20_000])
def test_wide_values(spark, n):
    """As many values in a row as there are blocks of running sums, and more."""
    inner = {"type": "object", "properties": {"k": {"type": "number"}, "l": {"type": "array", "items": {"type": "string"}}}}
    schema = {"type": "object", "properties": {"r": {"type": "array", "items": inner}} | {f"p{i}": {"type": "null"} for i in range(70)}}
    right = [{"k": i, "l": ["x"] * (i % 3)} for i in range(n)]
    wrong = [*right[:-1], {"k": 1, "l": [], "m": [{"o": 1}]}]
    began = time.time()
    found = assess(frame(spark, [{"r": right}, {"r": wrong}]), json.dumps(schema)).orderBy("i").collect()
    assert [(r.status, r.paths) for r in found] == [("accepted", None), ("rejected", ["$.r[*].m[*].o"])]
    assert time.time() - began < 60


def plain_structure(v):
    if isinstance(v, dict):
        return {k: plain_structure(x) for k, x in v.items()}
    if isinstance(v, list):
        return [plain_structure(x) for x in v]
    return {"string": "", "number": 0, "boolean": True, "null": None}[model.SORTS[type(v)]]


def test_structures(spark):
    rng = random.Random(6)
    strings = ["", "a", ":", '":', '"', "\\", '\\"', "true", "-1.5e3", "\u0001", "é𝄞", "{", "]", ",", "0", '",":"', "\n"]
    some = lambda d: rng.choice(
        [rng.choice(strings), rng.choice([0, -1.5e300, 10**30, 0.1]), rng.random() < 0.5, None]
        if d == 0 else [{rng.choice(strings): some(d - 1) for _ in range(3)}, [some(d - 1) for _ in range(rng.randrange(4))], some(0)]
    )
    values = [some(3) for _ in range(400)] + ["\\\"" * 200_000, {"\\\"" * 10_000: ["x" * 1_000_000, -12]}]
    texts = [(i, json.dumps(v, indent=i % 3 or None, separators=(",", " : "[i % 2 :]))) for i, v in enumerate(values)]
    found = spark.createDataFrame(texts, "i int, value string").select("i", V.structure(F.col("value")).alias("s")).collect()
    for r in found:
        assert json.loads(r.s) == plain_structure(values[r.i]), values[r.i]


def nested(depth, leaf):
    for _ in range(depth):
        leaf = {"in": leaf}
    return leaf


def test_a_hundred_levels(spark):
    schema = {"type": "object", "properties": {"a": {"type": "number"}}}
    for _ in range(100):
        schema = {"type": "object", "properties": {"in": schema}}
    values = [nested(100, {"a": 1}), nested(100, {"a": 1, "b": [{}]}), nested(99, {"x": 1})]
    rows, text = frame(spark, values), json.dumps(schema)
    assert [r.status for r in validate(rows, text).orderBy("i").collect()] == ["accepted", "rejected", "rejected"]
    paths = {r.path for r in missing_paths(rows, text).collect()}
    assert paths == {"$" + ".in" * 100 + ".b[*]", "$" + ".in" * 99 + ".x"}
    assert summarize(rows, text).first()["required_edits"] == 2


def test_thousands_of_nodes_are_planned_at_once(spark):
    wide = {f"p{i}": {"type": "object", "properties": {"a": {"type": "number"}}} for i in range(2500)}
    text = json.dumps({"type": "object", "properties": wide})
    rows = frame(spark, [{"p7": {"a": 1}}, {"p7": {"b": 1}}, {"q": 1}])
    began = time.time()
    found = summarize_many(rows, [Check("wide", text), Check("small", '{"type":"object"}')])
    found.explain()
    assert time.time() - began < 10
    totals = {r["name"]: (r["accepted"], r["required_edits"]) for r in found.collect()}
    assert totals == {"wide": (1, 2), "small": (0, 3)}
    assert {(r.i, r.entity_idx) for r in best_entity(rows, text).collect()} == {(1, 0), (2, 0)}


def test_broken_rows_and_nodes(spark):
    large = {"type": "object", "properties": {f"p{i}": {} for i in range(100)}}
    rows = spark.createDataFrame([("{",), ('{"p1":1}',), (None,)], "value string")
    found = validate(rows, json.dumps(large)).collect()
    assert [r.status for r in found] == ["malformed", "rejected", "malformed"]
    with pytest.raises(Exception, match="without type"):
        validate(rows.filter("value like '%p1%'"), json.dumps(large), mode="failfast").collect()


def test_limits_hold_with_and_without_ansi(spark):
    schema = {"type": "object", "properties": {"a": {"type": "array", "maxItems": 1}}}
    rows = frame(spark, [{"a": [1, 2]}, {"a": []}, {"b": [1]}])
    before = spark.conf.get("spark.sql.ansi.enabled")
    try:
        for ansi in ("true", "false"):
            spark.conf.set("spark.sql.ansi.enabled", ansi)
            joined = validate_by_joins(rows, json.dumps(schema), ["i"]).orderBy("i").collect()
            assert [r.status for r in joined] == ["rejected", "accepted", "rejected"]
            assert {r.path for r in missing_paths(rows, json.dumps(schema)).collect()} == {"$.b[*]"}
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)
