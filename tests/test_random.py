"""Random schemas and rows against the plain models."""

import json
import math
import random
import sys

import pytest
from pyspark.sql import functions as F

from schemagauge.functions import variants as V
from schemagauge.operators import distance as D
from schemagauge.operators import measures as M
from schemagauge.operators.issues import assess
from schemagauge.operators.relational import validate_by_joins
from schemagauge.plans.summary import summarize
from schemagauge.session import reliable
from schemagauge.sources.documents import schema_nodes
from tests import model


def some_rows(rng, schema, n):
    return [model.random_value(rng, schema) for _ in range(n)]


@pytest.mark.parametrize("seed", range(8))
def test_validation(spark, seed):
    rng = random.Random(seed)
    schema = model.random_root(rng)
    values = [v for v in some_rows(rng, schema, 150) if isinstance(v, dict)]
    df = spark.createDataFrame(
        [(i, json.dumps(v)) for i, v in enumerate(values)], "i int, value string"
    )
    text = json.dumps(schema)
    found = {r["i"]: r for r in assess(df, text).collect()}
    union = set()
    for i, v in enumerate(values):
        ok = model.holds(schema, v)
        assert found[i]["status"] == ("accepted" if ok else "rejected"), (schema, v)
        if not ok:
            idx, paths = model.charge(schema, v)
            assert (found[i]["entity_idx"], set(found[i]["paths"])) == (idx, paths), (schema, v)
            union |= {(idx, p) for p in paths}
    accepted = sum(model.holds(schema, v) for v in values)
    totals = summarize(df, text).first()
    assert (totals["total"], totals["accepted"]) == (len(values), accepted)
    assert totals["wrong"] == len(values) - accepted
    assert totals["required_edits"] == len(union)
    if seed < 4:
        joined = {r["i"]: r["status"] for r in validate_by_joins(df, text, ["i"]).collect()}
        assert joined == {i: r["status"] for i, r in found.items()}


def test_widening_never_lowers_the_share(spark):
    rng = random.Random(99)
    schema = model.random_object_schema(rng)
    wider = json.loads(json.dumps(schema))
    wider["properties"]["e"] = {"type": "object", "properties": {"f": {"type": "array"}}}
    values = [v for v in some_rows(rng, schema, 100) if isinstance(v, dict)]
    df = spark.createDataFrame([(json.dumps(v),) for v in values], "value string")
    before, after = (summarize(df, json.dumps(s)).first()["accepted"] for s in (schema, wider))
    assert before <= after


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    found = [model.random_root(rng) for _ in range(250)]
    found += [{"anyOf": [random_open(rng, 3) for _ in range(3)]} for _ in range(50)]
    found += [{"type": "string"}, {"oneOf": [{"type": "null"}]}, {"type": "array", "items": {"type": "null"}}]
    return found


def random_open(rng, depth):
    """Nested open objects with few keys, so that key paths repeat."""
    keys = rng.sample("ab", rng.randint(1, 2)) if depth else []
    inner = {k: random_open(rng, depth - 1) for k in keys}
    if depth and rng.random() < 0.5:
        k = rng.choice("ab")
        inner[k] = {"anyOf": [random_open(rng, depth - 1), random_open(rng, depth - 1)]}
    return {"type": "object", "properties": inner, "additionalProperties": rng.random() < 0.7}


@pytest.fixture(scope="module")
def nodes(spark, corpus):
    docs = spark.createDataFrame(
        [(i, json.dumps(s)) for i, s in enumerate(corpus)], "schema_id int, schema_json string"
    )
    return schema_nodes(docs).persist()


def test_measures(corpus, nodes):
    found = {r["schema_id"]: r for r in M.schema_measures(nodes).collect()}
    counts = {r[0]: r[1] for r in M.attribute_count(nodes).collect()}
    names = {}
    for r in M.attribute_set(nodes).collect():
        names.setdefault(r["schema_id"], []).append(tuple(r["name"]))
    for i, s in enumerate(corpus):
        assert found[i]["precision"] == str(model.precision(s)), s
        assert found[i]["grouping"] == model.grouping(s), s
        assert found[i]["base_size"] == len(s.get("anyOf", [0])), s
        assert counts[i] == len(model.attributes(s)), s
        assert sorted(names[i]) == sorted(set(model.attributes(s))), s
    assert nodes.filter("cut").count() > 20


def test_attribute_diff(corpus, nodes):
    shifted = nodes.filter("schema_id > 0").withColumn("schema_id", F.col("schema_id") - 1)
    found = {}
    for r in M.attribute_diff(nodes, shifted).collect():
        found.setdefault(r["schema_id"], set()).add(tuple(r["name"]))
    for i, s in enumerate(corpus[:-1]):
        expected = set(model.attributes(s)) - set(model.attributes(corpus[i + 1]))
        assert found.get(i, set()) == expected


@pytest.mark.parametrize("comparison", D.COMPARISONS)
def test_distances(corpus, nodes, comparison):
    few = nodes.filter("schema_id % 20 = 0")
    name = F.concat(F.lit("d"), F.col("schema_id").cast("string"), F.lit(".bimax.log"))
    test = few.withColumn("file", name)
    truth = test.withColumn(
        "file", F.when(F.col("schema_id") == 40, F.lit("d.truth")).otherwise(name)
    )
    found = {(r["test"], r["truth"]): r["d"] for r in D.schema_distances(test, truth, comparison).collect()}
    expected = {}
    for i in range(0, len(corpus), 20):
        for j in range(0, len(corpus), 20):
            g = "d.truth" if j == 40 else f"d{j}.bimax.log"
            if g != f"d{i}.bimax.log":
                d = model.distance(corpus[i], corpus[j], comparison)
                expected[(f"d{i}.bimax.log", g)] = d
    assert found == expected


@pytest.mark.parametrize("comparison", D.COMPARISONS)
def test_distances_as_lists(nodes, comparison, monkeypatch):
    monkeypatch.setattr(D, "_CHUNK", 2)
    monkeypatch.setattr(D, "_PAIRS", 7)
    few = nodes.filter("schema_id % 20 = 0")
    of = F.element_at(F.split(F.lit("bimax kmeans hier.bimax"), " "), (F.col("schema_id") / 20 % 3 + 1).cast("int"))
    name = F.concat(F.lit("d"), F.col("schema_id").cast("string"), F.lit("."), of)
    alone = F.concat(F.lit("e"), F.col("schema_id").cast("string"), F.lit(".bimax"))
    test = few.withColumn("file", name).unionByName(few.withColumn("file", alone))
    truth = few.filter("schema_id > 40").withColumn("file", name)
    truth = truth.unionByName(few.withColumn("file", F.concat(F.lit("d2."), name)))
    pairs = reliable(D.schema_distances(test, truth, comparison))
    lists = D.schema_distances(test, truth, comparison, blocks=3, listed=True)
    assert sorted(map(tuple, D.schema_distances(test, truth, comparison, blocks=3).collect())) == sorted(map(tuple, pairs.collect()))
    assert {len(r["truths"]) for r in lists.lists.collect()} != {pairs.select("truth").distinct().count()}
    for report in (D.distance_report, D.report_cells, D.report_lines, D.subset_report):
        found = sorted(map(tuple, report(lists).collect()))
        assert found and found == sorted(map(tuple, report(pairs).collect())), report
    with pytest.raises(Exception, match="over 3 distances"):
        D.report_lines(lists, max_cells=3).collect()


def test_pairs_of_files_are_not_shuffled(nodes):
    few = nodes.filter("schema_id % 20 = 0").withColumn("file", F.concat(F.lit("d"), "schema_id", F.lit(".bimax")))
    found = D.schema_distances(few, few.withColumn("file", F.concat("file", F.lit(".truth"))), listed=True)
    for df in (D.schema_distances(few, few), D.report_cells(found), D.subset_report(found)):
        above = df._jdf.queryExecution().executedPlan().toString().partition("MapInArrow")[0]
        assert "Generate" in above and "Exchange" not in above and "Join" not in above


def test_walks(spark):
    rng = random.Random(3)
    values = some_rows(rng, model.random_object_schema(rng), 60)
    df = spark.createDataFrame([(json.dumps(v),) for v in values], "value string")
    start = F.array(F.struct(F.lit("$").alias("path"), F.parse_json("value").alias("v")))
    bound = V.nesting_bound(F.col("value"))
    for row in df.select("value", V.leaf_paths(start, bound).alias("p")).collect():
        assert set(row["p"]) == model.leaves("$", json.loads(row["value"]))


def test_large_precision_is_exact(spark):
    half = {"properties": {f"p{i}": {"type": "string"} for i in range(70)}, "type": "object"}
    odd = {"properties": {f"p{i}": {"oneOf": [{"type": "null"}] * (i % 5 + 1)} for i in range(60)}}
    huge = {"properties": {f"p{i}": {"type": "null"} for i in range(40_000)}}
    docs = [half, {"anyOf": [half, odd]}, odd, huge, {"properties": {f"p{i}": {} for i in range(53)}}]
    df = spark.createDataFrame(
        [(i, json.dumps(s)) for i, s in enumerate(docs)], "schema_id int, schema_json string"
    )
    found = {r[0]: r[1] for r in M.precision(schema_nodes(df)).select("schema_id", "precision").collect()}
    assert found[0] == str(2**70)
    assert found[1] == str(model.precision(docs[1]))
    assert found[2] == str(model.precision(odd))
    assert found[4] == str(2**53)
    usual = sys.get_int_max_str_digits()
    sys.set_int_max_str_digits(0)
    try:
        assert found[3] == str(2**40_000)
    finally:
        sys.set_int_max_str_digits(usual)


def test_precision_is_one_plan_without_python(spark):
    rng = random.Random(11)

    def deep(depth):
        if depth == 0:
            return {"type": "string"}
        inner = {f"p{i}": deep(depth - 1) for i in range(rng.randint(2, 4))}
        one = {"type": "object", "properties": inner, "required": [k for k in inner if rng.random() < 0.3]}
        return {"anyOf": [one, deep(depth - 1)]} if rng.random() < 0.4 else one

    docs = [deep(5) for _ in range(12)]
    df = spark.createDataFrame(
        [(i, json.dumps(s)) for i, s in enumerate(docs)], "schema_id int, schema_json string"
    )
    found = M.precision(schema_nodes(df))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and plan.count("Scan ExistingRDD") == 1
    rows = found.collect()
    assert max(len(r["precision"]) for r in rows) > 100
    for r in rows:
        expected = model.precision(docs[r["schema_id"]])
        assert r["precision"] == str(expected)
        assert abs(r["log2_precision"] - math.log2(expected)) < 1e-9 * max(1, math.log2(expected))
