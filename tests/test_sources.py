"""Files in, files out: rows, splits, logs, and whole evaluations."""

import json
from collections import Counter

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from schemagauge.operators import distance as D
from schemagauge.plans.evaluate import evaluate_log
from schemagauge.sources import logs, rows
from schemagauge.sources.documents import schema_nodes
from schemagauge.sources.results import FIELDS, append_results

FLAT = {"type": "object", "properties": {"n": {"type": "number"}, "s": {"type": "string"}}}


def test_row_scan(spark, tmp_path):
    kept = ['{"a":1}', '{"broken', "{}"]
    (tmp_path / "rows.json").write_text("\n".join(["", " {}", "[{}]", "3", '"{"', *kept]) + "\n")
    found = rows.json_rows(str(tmp_path / "rows.json"), spark=spark)
    assert [r["value"] for r in found.collect()] == kept
    assert rows.count_rows(found) == 3 and rows.count_rows(found, known=7) == 7
    wide = spark.createDataFrame([(1, '{"a":1}'), (2, "x")], "id int, t string")
    assert [r["id"] for r in rows.json_rows(wide, "t").collect()] == [1]


def test_shredding(spark):
    df = spark.createDataFrame(
        [(1, '{"a":{},"b":[[],[null]],"c":1.0,"a.b":true}'), (2, '{"a":')], "id int, value string"
    )
    found = sorted((r["path"], r["kind"]) for r in rows.shred(df).collect())
    assert found == [
        ("$", "object"),
        ("$.a", "empty_object"),
        ("$.a.b", "boolean"),
        ("$.b", "array"),
        ("$.b[*]", "array"),
        ("$.b[*]", "empty_array"),
        ("$.b[*][*]", "null"),
        ("$.c", "number"),
    ]
    plain = {r["kind"] for r in rows.shred(df, mark_empty=False).collect()}
    assert plain == {"object", "array", "boolean", "null", "number"}


def test_split_sizes():
    assert rows.split_sizes(1000, 10.0, 300) == rows.SplitSizes(100.0, 300.0, 600.0)
    assert rows.split_sizes(1000, 90.0, 300) == rows.SplitSizes(700.0, 300.0, 0.0)
    with pytest.raises(ValueError):
        rows.split_sizes(1000, 100.5, 1)
    with pytest.raises(ValueError):
        rows.split_sizes(10, 1.0, 11)


@pytest.mark.parametrize("key", [None, ["id"]])
def test_split(spark, key):
    df = spark.range(20_000).select("id", F.format_string('{"n":%d}', "id").alias("value"))
    train, held_out = rows.split(df, 10.0, 5000, seed=11, key=key)
    first, second = {r["id"] for r in train.collect()}, {r["id"] for r in held_out.collect()}
    assert not first & second
    assert abs(len(first) - 2000) < 250 and abs(len(second) - 5000) < 350
    if key:
        # The parts depend on nothing but seed and key.
        shuffled = df.repartition(7, "value")
        again = rows.split(shuffled, 10.0, 5000, seed=11, key=key)[1]
        assert {r["id"] for r in again.collect()} == second
        other = rows.split(df, 10.0, 5000, seed=12, key=key)[1]
        assert {r["id"] for r in other.collect()} != second


def info(**entries):
    return json.dumps({k: v for k, v in entries.items() if v is not None})


def test_log_lines_of_split_files(spark, tmp_path):
    schema = json.dumps(FLAT)
    expected = []
    for name, n in (("a.bimax.log", 400), ("b.hier.log", 3), ("empty.log", 0)):
        lines = []
        for i in range(n):
            lines += [info(TrainPercent="1.0", TotalTime=str(i)), schema]
            expected.append((name, i, str(i)))
        (tmp_path / name).write_text("".join(line + "\n" for line in lines))
    (tmp_path / "nested").mkdir()
    (tmp_path / "nested" / "c.log").write_text("not read\n")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        # Small splits, so that the longer file is read in many blocks.
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
        spark.conf.set("spark.sql.files.openCostInBytes", "64")
        lines = logs.log_lines(spark, str(tmp_path))
        # The text is read while the lines are numbered, and never again.
        assert "FileScan text" not in lines._jdf.queryExecution().executedPlan().toString()
        log = logs.decode_info(logs.pair_lines(lines)).collect()
        found = sorted((r["file"], r["rec"], r["info"]["TotalTime"]) for r in log)
        assert found == sorted(expected)
        assert {r["schema_json"] for r in log} == {schema}
        starred = logs.first_schemas(logs.log_lines(spark, str(tmp_path / "*.hier.log")))
        assert [tuple(r)[1:] for r in starred.collect()] == [("b.hier.log", schema)]
    finally:
        for k, value in before.items():
            spark.conf.set(k, value)
    with pytest.raises(PySparkException):
        logs.log_lines(spark, str(tmp_path / "missing")).collect()


def test_runs(spark):
    lines = [
        info(TrainPercent="1.0", inputFile="x", TotalTime="5", ValidationSize="10", Seed="None"),
        info(TrainPercent="1.0", inputFile="y", TotalTime="6", ValidationSize=20, Seed="3"),
        info(TrainPercent="1", inputFile="z"),
        info(inputFile="z"),
    ]
    log = logs.decode_info(spark.createDataFrame([(x,) for x in lines], "info_line string"))
    runs = logs.typed_runs(logs.full_training_runs(log)).collect()
    assert [tuple(r) for r in runs] == [("x", "5", 1.0, 10, None), ("y", "6", 1.0, 20, 3)]
    lacking = logs.decode_info(
        spark.createDataFrame([(info(TrainPercent="1.0", TotalTime="5"),)], "info_line string")
    )
    with pytest.raises(PySparkException, match="without inputFile"):
        logs.typed_runs(logs.full_training_runs(lacking)).collect()


def test_documents(spark, tmp_path):
    (tmp_path / "one.json").write_text(json.dumps(FLAT, indent=2))
    docs = logs.whole_file_schemas(spark, str(tmp_path))
    found = schema_nodes(docs, "file").orderBy("sid").collect()
    assert [(r["file"], r["path"], r["type"]) for r in found] == [
        ("one.json", "$", "object"),
        ("one.json", "$.n", "number"),
        ("one.json", "$.s", "string"),
    ]
    odd = spark.createDataFrame(
        [(1, '{"$ref":"x"}'), (2, "{"), (3, '{"type":["null"]}'), (4, '{"ty\\pe":"null"} x'), (5, "[]")],
        "schema_id int, schema_json string",
    )
    lenient = {r["schema_id"]: r["supported"] for r in schema_nodes(odd, strict=False).collect()}
    assert lenient == {1: False, 3: False, 4: True, 5: False}
    for i in (1, 2, 3, 5):
        with pytest.raises((PySparkException, Py4JJavaError)):
            # Whatever is asked of the nodes, even their number alone.
            schema_nodes(odd.filter(F.col("schema_id") == i)).agg(F.count("*")).collect()


def test_nested_entities(spark):
    inner = '{"type":"object","properties":{}}'
    docs = [
        '{"type":"array","items":{"anyOf":[%s,{"type":"null"}]}}' % inner,
        '{"type":"array","items":{"anyOf":[{"oneOf":[%s]}]}}' % inner,
        '{"type":"array","items":%s}' % inner,
        '{"anyOf":[{"type":"array","items":%s}]}' % inner,
        '{"type":"array","items":{"anyOf":[{"type":"object","properties":{"a":%s}}]}}' % inner,
    ]
    from schemagauge.operators.measures import nested_entities

    df = spark.createDataFrame(list(enumerate(docs)), "schema_id int, schema_json string")
    found = nested_entities(schema_nodes(df)).select("schema_id", "sid").orderBy("schema_id").collect()
    assert [tuple(r) for r in found] == [(0, "/i0/a0"), (1, "/i0/a0/o0"), (4, "/i0/a0")]


def test_distance_reports(spark, tmp_path):
    def log(name, schema):
        (tmp_path / name).write_text("{}\n" + json.dumps(schema) + "\n")

    less = {"type": "object", "properties": {"n": {"type": "number"}}}
    log("d1.bimax.log", FLAT)
    log("d2.bimax.log", less)
    log("d1.kmeans-2.log", {"anyOf": [FLAT, less]})
    log("d1.groundtruth.log", FLAT)
    log("d2.groundtruth.log", less)

    def read(pattern):
        first = logs.first_schemas(logs.log_lines(spark, str(tmp_path / pattern)))
        return schema_nodes(first, "file")

    test, truth = read("*.[bk]*.log"), read("*.groundtruth.log")
    symmetric = D.schema_distances(test, truth)
    per_test = {(r["fragment"], r["test"]): r["line"] for r in D.distance_report(symmetric).collect()}
    assert per_test == {
        ("bimax", "d1.bimax.log"): "0 & 1",
        ("bimax", "d2.bimax.log"): "1 & 0",
        ("kmeans", "d1.kmeans-2.log"): "0 & 0",
    }
    joined = {r["fragment"]: r["line"] for r in D.distance_report(symmetric, per_test=False).collect()}
    assert joined == {"bimax": "0 & 1 & 1 & 0", "kmeans": "0 & 0"}
    whole = {r["fragment"]: r["line"] for r in D.report_lines(symmetric).collect()}
    assert whole == joined | {"baazizi": "", "hier": ""}
    cells = sorted(tuple(r) for r in D.report_cells(symmetric.repartition(7)).collect())
    assert cells == [(f, i, int(d)) for f in ("bimax", "kmeans") for i, d in enumerate(whole[f].split(" & "))]
    with pytest.raises(Exception, match="over 3 distances"):
        D.report_lines(symmetric, max_cells=3).collect()
    lines = sorted(r["line"] for r in D.subset_report(D.schema_distances(test, truth, "sub")).collect())
    assert lines == [
        "d1 subset of bimax",
        "d2 subset of bimax",
        "d2 subset of bimax",
        "d2 subset of kmeans-2",
    ]
    with pytest.raises(ValueError, match="unknown comparison"):
        D.schema_distances(test, truth, "jaccard")


def test_evaluating_a_log(spark, tmp_path):
    data = tmp_path / "rows.json"
    data.write_text(
        "".join(json.dumps({"n": i, "s": "x"} | ({"z": [i]} if i % 5 == 0 else {})) + "\n" for i in range(1000))
    )
    closed, partial = json.dumps(FLAT), json.dumps({"anyOf": [FLAT, FLAT]})
    common = {"inputFile": str(data), "TotalTime": "812", "ValidationSize": "990"}
    log = tmp_path / "d.log"
    log.write_text(
        "\n".join(
            [
                info(TrainPercent="1.0", Seed="None", **common), closed,
                info(TrainPercent="0.5", Seed="1", **common), closed,
                info(TrainPercent="1.0", Seed="42", **common), partial,
                info(TrainPercent=None, **common), closed,
            ]
        )
    )
    found = evaluate_log(spark, str(log)).orderBy("run_id").collect()
    results = [json.loads(r["value"]) for r in found]
    assert [list(r) for r in results] == [list(FIELDS)] * 2
    for r, seed, size in zip(results, ("None", "Some(42)"), ("1", "2")):
        total = int(r["ValidationSizeActual"])
        assert abs(total - 990) < 30
        wrong = float(r["TotalWrong"])
        assert abs(wrong - 200) < 40 and float(r["Validation"]) == (total - wrong) / total
        assert (r["RequiredEdits"], r["Seed"], r["BaseSchemaSize"]) == ("1.0", seed, size)
        assert (r["inputFile"], r["TotalTime"], r["TrainPercent"]) == (str(data), "812", "1.0")
    assert [r["Precision"] for r in results] == ["4", "8"]
    assert [r["Grouping"] for r in results] == ["1", "2"]

    lines = evaluate_log(spark, str(log), validate=False)
    assert [list(json.loads(r["value"])) for r in lines.collect()] == [list(FIELDS[4:])] * 2
    append_results(lines, str(log))
    append_results(lines, str(log))
    assert spark.read.text(str(log) + ".res").count() == 4


def test_logs_of_equal_names_and_bad_runs(spark, tmp_path):
    data = tmp_path / "rows.json"
    data.write_text("".join(json.dumps({"n": i, "s": "x"}) + "\n" for i in range(100)))
    common = {"inputFile": str(data), "TotalTime": "1", "ValidationSize": "90", "TrainPercent": "1.0"}
    texts = {
        "x": [info(Seed="1", **common), json.dumps(FLAT), info(Seed="2", **common)],
        "y": [info(Seed="3", **common), '{"$ref":"z"}', info(Seed="4", **common), "{"],
    }
    for folder, lines in texts.items():
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "r.log").write_text("\n".join(lines))
    pattern = str(tmp_path / "[xy]" / "r.log")
    pairs = logs.pair_lines(logs.log_lines(spark, pattern)).collect()
    assert len(pairs) == 4 and len({r["path"] for r in pairs}) == 2
    assert logs.first_schemas(logs.log_lines(spark, pattern)).count() == 2
    found = [json.loads(r["value"]) for r in evaluate_log(spark, pattern, mode="permissive").collect()]
    by_seed = {r["Seed"]: r for r in found}
    assert sorted(by_seed) == ["Some(1)", "Some(2)", "Some(3)", "Some(4)"]
    assert by_seed["Some(1)"]["Validation"] == "1.0" and by_seed["Some(1)"]["Precision"] == "4"
    for seed in ("Some(2)", "Some(3)", "Some(4)"):
        assert "Validation" not in by_seed[seed] and "Precision" not in by_seed[seed]
    with pytest.raises(Exception, match="schema"):
        evaluate_log(spark, str(tmp_path / "x" / "r.log")).collect()


def test_lines_written_once(spark, tmp_path):
    log = str(tmp_path / "d.log")
    lines = lambda *pairs: spark.createDataFrame(pairs, "run_id string, value string")
    for _ in range(2):
        append_results(lines(("a#1", "one"), ("b#1", "two"), (None, "three")), log, once=True)
    append_results(lines(("a#1", "new"), ("c#1", "four")), log, once=True)
    found = sorted(r.value for r in spark.read.text(log + ".res").collect())
    assert found == ["four", "new", "three", "two"]


@pytest.mark.parametrize("together", [3, 10_000])
def test_a_split_without_a_key_survives_a_reshuffle(spark, monkeypatch, together):
    monkeypatch.setattr(rows, "_TOGETHER", together)
    values = ["hot"] * 700 + ["few"] * 4 + [f"v{i}" for i in range(300)] + [None] * 5
    data = [(v, i % 2 if v == "hot" else None) for i, v in enumerate(values)]
    df = spark.createDataFrame(data, "value string, k int")
    sizes = rows.split_sizes(len(data), 30.0, 200)
    seen = []
    for parts in (1, 7, 3):
        labelled = rows.with_part(df.repartition(parts), sizes, seed=5)
        assert labelled.columns == ["value", "k", "part"]
        by_part = {p: Counter(tuple(r)[:2] for r in labelled.filter(F.col("part") == p).collect()) for p in rows.PARTS}
        assert sum(by_part.values(), Counter()) == Counter(data)
        seen.append(by_part)
    assert seen[0] == seen[1] == seen[2]
    assert abs(sum(seen[0]["validation"].values()) - 200) < 60
    train, held_out = rows.split(df.repartition(5), 30.0, 200, seed=5)
    assert Counter(map(tuple, train.collect())) == seen[0]["train"]
    assert Counter(map(tuple, held_out.collect())) == seen[0]["validation"]
    assert rows.numbered(df.limit(0)).count() == 0
