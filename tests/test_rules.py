"""Contract tables: each rule with a schema, a row and what must come of them."""

import json
from dataclasses import replace

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from schemagauge.functions import variants as V
from schemagauge.operators.issues import charged, missing_paths, strong_checks
from schemagauge.operators.schema import SchemaError, load_schema
from schemagauge.operators.verdict import validate, verdict
from schemagauge.plans.summary import summarize

OBJ = '{"type":"object",%s}'
A = '"properties":{"a":{"type":"%s"}}'
CASES = [
    # schema, row, accepted
    (OBJ % (A % "string"), '{"a":"x"}', True),
    (OBJ % (A % "string"), '{"a":1}', False),
    (OBJ % (A % "integer"), '{"a":1.5}', True),
    (OBJ % (A % "number"), '{"a":123456789012345678901234567890}', True),
    (OBJ % (A % "number"), '{"a":1e400}', True),
    (OBJ % (A % "true"), '{"a":false}', True),
    (OBJ % (A % "null"), '{"a":null}', True),
    (OBJ % (A % "string"), '{"a":null}', False),
    (OBJ % (A % "array"), '{"a":[]}', True),
    (OBJ % (A % "array"), '{"a":[1,"x"]}', True),
    (OBJ % (A % "array"), '{"a":{}}', False),
    (OBJ % (A % "object"), '{"a":{}}', True),
    (OBJ % (A % "object"), '{"a":{"b":1}}', False),  # no properties: only {} passes
    (OBJ % '"additionalProperties":true', '{"b":1}', False),
    (OBJ % '"additionalProperties":true', "{}", True),
    (OBJ % '"properties":{}', "{}", True),
    (OBJ % '"properties":{},"required":["a"]', "{}", False),
    (OBJ % '"properties":{},"required":["a"],"additionalProperties":true', "{}", True),
    (OBJ % (A % "null" + ',"required":["a"]'), '{"a":null}', True),  # null is present
    (OBJ % (A % "null" + ',"required":["a","b"]'), '{"a":null}', False),
    (OBJ % (A % "null" + ',"required":["b","c","d"],"additionalProperties":true'), '{"a":null}', True),
    (OBJ % (A % "null"), '{"b":null}', False),  # closed unless told otherwise
    (OBJ % (A % "null" + ',"additionalProperties":true'), '{"b":{"c":[1]}}', True),
    (OBJ % (A % "null" + ',"additionalProperties":true'), '{"a":1,"b":1}', False),
    (OBJ % '"properties":{"a":{"type":"array","items":{"type":"number"}}}', '{"a":[1,2]}', True),
    (OBJ % '"properties":{"a":{"type":"array","items":{"type":"number"}}}', '{"a":[1,"x"]}', False),
    (OBJ % '"properties":{"a":{"type":"array","maxItems":1}}', '{"a":[1,2]}', False),
    (OBJ % '"properties":{"a":{"type":"array","maxItems":0}}', '{"a":[]}', True),
    (OBJ % '"properties":{"a":{"type":"array","maxProperties":1}}', '{"a":[1,2]}', False),
    (OBJ % '"properties":{"a":{"type":"array","maxItems":1,"maxProperties":2}}', '{"a":[1,2]}', True),
    (OBJ % '"properties":{"a":{"oneOf":[{"type":"number"},{"type":"integer"}]}}', '{"a":1}', True),
    (OBJ % '"properties":{"a":{"anyOf":[{"type":"number"},{"type":"null"}]}}', '{"a":"x"}', False),
    (OBJ % '"properties":{"a":{"anyOf":[]}}', '{"a":"x"}', False),
    (OBJ % '"properties":{"a.b":{"type":"number"},"":{"type":"null"}}', '{"a.b":1,"":null}', True),
    (OBJ % '"properties":{"a":{"type":"number"}}', '{"a":"x","a":1}', True),  # the last counts
    (OBJ % '"properties":{"a":{"type":"number"}}', '{"a":1} trailing', True),
    (OBJ % '"maxProperties":1,"properties":{"a":{"type":"null"},"b":{"type":"null"}}',
     '{"a":null,"b":null}', True),  # limits arrays only
    ('{"type":"string"}', '{"a":1}', False),
    ('{"oneOf":[{"type":"string"},%s]}' % (OBJ % (A % "string")), '{"a":"x"}', True),
]


def test_verdicts(spark):
    rows = spark.createDataFrame([(i, row) for i, (_, row, _) in enumerate(CASES)], "i int, value string")
    v = F.try_parse_json("value")
    per_case = F.lit(False)
    for i, (schema, _, _) in enumerate(CASES):
        per_case = F.when(F.col("i") == i, verdict(schema, v)).otherwise(per_case)
    found = {r["i"]: r["ok"] for r in rows.select("i", per_case.alias("ok")).collect()}
    wrong = [CASES[i] for i in range(len(CASES)) if found[i] != CASES[i][2]]
    assert wrong == []


def test_wide_objects_split_their_keys(spark):
    # Every property has a sub-schema of its own, so no two can share a branch.
    inner = {f"k{i}": {"type": "array", "maxItems": i} for i in range(40)}
    schema = json.dumps({"type": "object", "properties": inner})
    rows = [{f"k{i}": [0] * n} for i in range(1, 39) for n in (i, i + 1)] + [{"zz": 1}, {"": 1}]
    df = spark.createDataFrame([(json.dumps(r),) for r in rows], "value string")
    accepted = {r["value"] for r in validate(df, schema).collect() if r["status"] == "accepted"}
    assert accepted == {json.dumps({f"k{i}": [0] * i}) for i in range(1, 39)}


def test_max_properties_by_api(spark):
    schema = replace(load_schema(OBJ % '"properties":{"a":{"type":"null"},"b":{"type":"null"}}'),
                     max_properties=1.0)
    df = spark.createDataFrame([('{"a":null}',), ('{"a":null,"b":null}',)], "value string")
    assert [r["status"] for r in validate(df, schema).collect()] == ["accepted", "rejected"]


def test_reaching_a_typeless_node(spark):
    schema = OBJ % '"properties":{"a":{"title":"t"},"b":{"type":"null"}}'
    untouched = spark.createDataFrame([('{"b":null}',)], "value string")
    touched = spark.createDataFrame([('{"a":1}',)], "value string")
    assert validate(untouched, schema, mode="failfast").first()["status"] == "accepted"
    with pytest.raises(PySparkException, match="without type"):
        validate(touched, schema, mode="failfast").collect()
    assert validate(touched, schema, mode="permissive").first()["status"] == "rejected"


def test_malformed_rows(spark):
    df = spark.createDataFrame([('{"a":',), ('{"a":"x"}',)], "value string")
    schema = OBJ % (A % "string")
    assert [r["status"] for r in validate(df, schema).collect()] == ["malformed", "accepted"]
    with pytest.raises((PySparkException, Py4JJavaError)):
        validate(df, schema, mode="failfast").collect()
    totals = summarize(df, schema).first()
    assert (totals["total"], totals["accepted"], totals["wrong"], totals["malformed"]) == (2, 1, 1, 1)


@pytest.mark.parametrize(
    "text",
    [
        '{"$ref":"x"}',
        '{"definitions":{}}',
        '{"type":["string","null"]}',
        '{"type":"any"}',
        '{"additionalProperties":{"type":"string"}}',
        '{"required":[1]}',
        '{"properties":{"a":3}}',
        '{"items":[]}',
        "[]",
        '{"type":',
    ],
)
def test_unsupported_schemas(text):
    with pytest.raises(SchemaError):
        load_schema(text)


def test_reading_schemas():
    assert load_schema('{"type":"str\\ing"} rest').type == "string"
    assert load_schema('{"type":"null","type":"integer"}').type == "number"
    assert load_schema('{"properties":{"  a":{"type":"null"}}}').properties[0][0] == "a"
    with pytest.raises(SchemaError):
        verdict('{"anyOf":[]}', None)


def test_alternatives_report_through_all_branches(spark):
    # Charged through the text branch, but only because the row fails elsewhere.
    schema = OBJ % (
        '"properties":{"a":{"oneOf":[{"type":"string"},{"type":"object","properties":'
        '{"x":{"type":"number"}}}]},"b":{"type":"number"}}'
    )
    passing = spark.createDataFrame([('{"a":{"x":1},"b":1}',)], "value string")
    failing = spark.createDataFrame([('{"a":{"x":1},"b":"y"}',)], "value string")
    assert missing_paths(passing, schema).count() == 0
    assert [tuple(r) for r in missing_paths(failing, schema).collect()] == [(0, "$.a.x")]


def test_charging_prefers_few_paths_then_low_numbers(spark):
    closed = OBJ % '"properties":{"%s":{"type":"null"}}'
    schema = '{"anyOf":[%s,%s,%s]}' % (closed % "a", closed % "b", closed % "c")
    texts = ['{"x":1}', '{"b":1}', '{"x":1,"c":null,"y":[{"z":1}]}', '{"b":null,"x":1}']
    df = spark.createDataFrame([(t,) for t in texts], "value string")
    bound = V.nesting_bound(F.col("value"))
    found = df.select(charged(schema, F.parse_json("value"), bound).alias("c")).select("c.*").collect()
    assert [(r["entity_idx"], sorted(r["paths"])) for r in found] == [
        (0, ["$.x"]),
        # One path through the first branch, none through the second; both count as one.
        (0, ["$.b"]),
        (2, ["$.x", "$.y[*].z"]),
        (1, ["$.x"]),
    ]


def test_strong_checks(spark):
    limited = replace(load_schema('{"type":"object"}'), max_properties=1.0)
    df = spark.createDataFrame([("1",), ("[1,2]",), ("[]",), ('{"a":1,"b":2}',), ("{}",)], "t string")
    v = F.parse_json("t")
    flags = df.select(
        strong_checks(limited, v).alias("o"),
        strong_checks('{"type":"array","maxItems":1}', v).alias("a"),
        strong_checks('{"anyOf":[{"type":"null"}]}', v).alias("n"),
    ).collect()
    assert [r["o"]["type_check"] for r in flags] == [1, 0, 1, 0, 0]
    assert [r["o"]["object_max"] for r in flags] == [0, 0, 0, 1, 0]
    assert [r["a"]["type_check"] for r in flags] == [1, 0, 0, 0, 0]
    assert [r["a"]["array_max"] for r in flags] == [0, 1, 0, 0, 0]
    assert all(sum(r["n"]) == 0 for r in flags)


def test_nothing_to_validate(spark):
    none = spark.createDataFrame([], "value string")
    totals = summarize(none, OBJ % (A % "string")).first()
    assert (totals["total"], totals["share"], totals["required_edits"]) == (0, None, 0)
    with pytest.raises(PySparkException, match="no rows"):
        summarize(none, OBJ % (A % "string"), mode="failfast").collect()


def test_nesting_bound(spark):
    texts = ['{}', '{"a":[1,{"b":[]}]}', '{"a":"]]]}}}","b":[[1]]}', r'{"a\"]":"\\","b":{"c":[{}]}}']
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(V.nesting_bound(F.col("t"))).collect()] == [2, 5, 4, 5]


def test_rows_too_large_for_a_variant_are_not_malformed(spark):
    """A sound text of 140 MB has a status of its own; a broken short one keeps its."""
    schema = {"type": "array", "items": {"type": "string"}}
    large = F.concat(F.lit('["'), F.repeat(F.lit("a"), F.lit(140_000_000)), F.lit('"]'))
    rows = spark.range(3).select(
        F.when(F.col("id") == 0, large).when(F.col("id") == 1, "[").otherwise('["a"]').alias("value")
    )
    found = validate(rows, json.dumps(schema)).groupBy("status").count().collect()
    assert {r["status"]: r["count"] for r in found} == {"oversized": 1, "malformed": 1, "accepted": 1}
