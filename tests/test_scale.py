"""What must hold however large the tables are."""

from pyspark.sql import functions as F

from schemagauge.operators import distance as D


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_line_takes_over_a_million_distances(spark):
    pairs = spark.range(1100 * 1000).select(
        F.concat(F.lit("s"), F.lpad((F.col("id") / 1000).cast("int").cast("string"), 4, "0")).alias("test"),
        F.lpad((F.col("id") % 1000).cast("string"), 4, "0").alias("truth"),
        F.lit("bimax").alias("algorithm"),
        F.lit("x").alias("dataset"),
        F.col("id").alias("d"),
    )
    lines = {r["fragment"]: r["line"] for r in D.report_lines(pairs.repartition(5)).collect()}
    assert lines.pop("bimax") == " & ".join(map(str, range(1100 * 1000)))
    assert lines == {"baazizi": "", "kmeans": "", "hier": ""}


def test_lines_are_put_together_from_pieces_and_never_gathered(spark, monkeypatch):
    schema = "test string, truth string, algorithm string, dataset string, d long"
    rows = [(f"s{i:02d}", f"t{j:02d}", "bimax+hier" if i % 2 else "kmeans", "x", 10 ** (i + j % 3)) for i in range(12) for j in range(9)]
    rows += [(None, "t1", "bimax", "x", 7), ("s11", "u", "bimax", "x", None), ("z", "t", "kmeans", "x", None)]
    monkeypatch.setattr(D, "_PIECE", 7)
    pairs = spark.createDataFrame(rows, schema).repartition(5)
    lines = D.report_lines(pairs)
    assert "ObjectHashAggregate" not in _plan(lines) and "SortAggregate" not in _plan(lines)
    # The rows that hold whole lines are those that come out, each in a task.
    assert lines.rdd.getNumPartitions() == 4
    found = {r["fragment"]: r["line"] for r in lines.collect()}
    tests = sorted({(t or "", t, a) for t, _, a, _, _ in rows}, key=lambda x: x[0])
    texts = [(a, " & ".join(str(d) for u, _, b, _, d in sorted(rows, key=lambda r: r[1]) if (u, b) == (t, a) and d is not None)) for _, t, a in tests]
    own = {"bimax": "bimax", "hier": "bimax+hier", "kmeans": "kmeans"}
    assert found["baazizi"] == ""
    assert found["hier"] == " & ".join(x for a, x in texts if a == own["hier"])
    assert found["kmeans"] == " & ".join(x for a, x in texts if a == "kmeans") and found["kmeans"].endswith(" & ")
    assert found["bimax"].startswith("7 & 10 & ")


def test_texts_are_shuffled_once_to_be_judged_by_joins(spark, tmp_path):
    from catalog.queries import QUERIES

    lines = [(1, 1, 17.0, "R"), (1, 2, 17.0, "A"), (1, 3, 17.0, "N"), (1, 3, 17.0, "N"), (9, 1, 1.0, "R"), (9, 0, 1.0, "R")]
    lines += [(2, 1, None, "R"), (None, 2, 1.0, "A"), (3, 7, 2.0, None)]
    columns = "l_orderkey long, l_linenumber int, l_quantity double, l_returnflag string"
    spark.createDataFrame(lines, columns).write.parquet(str(tmp_path / "lineitem.parquet"))
    judged = QUERIES["validate_nested_by_joins"](spark, str(tmp_path))
    moved = [x for x in _plan(judged).split("\n") if "Exchange hashpartitioning" in x and "status" not in x]
    assert len(moved) == 1 and "REPARTITION_BY_NUM" in moved[0] and "nid" not in moved[0]
    assert {r["status"]: r["n_rows"] for r in judged.collect()} == {"accepted": 4, "rejected": 2}


def test_folds_are_hash_aggregates_over_as_many_tasks_as_rows_ask_for(spark, monkeypatch):
    from schemagauge.operators import relational

    schema = '{"type":"object","properties":{"a":{"type":"array","items":{"type":"number"}}},"required":["a"]}'
    rows = spark.range(300).select(
        "id", F.concat(F.lit('{"a":['), F.col("id").cast("string"), F.when(F.col("id") % 3 == 0, ',"x"').otherwise(""), F.lit("]}")).alias("value")
    )
    monkeypatch.setattr(relational, "_TASK_ROWS", 10)
    judged = relational.validate_by_joins(rows, schema, ["id"])
    assert "SortAggregate" not in _plan(judged)
    assert "id#" in _plan(judged) and ", 30), REPARTITION_BY_NUM" in _plan(judged)
    found = {(r["id"] % 3 == 0, r["status"]) for r in judged.collect()}
    assert found == {(True, "rejected"), (False, "accepted")}


def test_a_filter_on_repeated_open_objects_walks_once(spark):
    from schemagauge.sources.documents import schema_nodes

    df = spark.createDataFrame([(1, '{"type":"object"}')], "schema_id int, schema_json string")
    filtered = schema_nodes(df).filter("cut").select("schema_id", "sid")
    plan = filtered._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_sort(") == 1


def test_steps_of_a_schema_walk_are_its_levels(spark):
    from schemagauge.sources import documents

    wide = '{"type":"object","properties":{%s}}' % ",".join('"k%d":{"type":"string"}' % i for i in range(50))
    texts = {
        wide: 2,
        '{"type":"string"}': 1,
        '{"properties":{"}}]":3}}': 2,
        '{"items":3}': 2,
        '{"items":{"items":{"items":{}}}}': 4,
        '{"anyOf":[{"items":{"properties":{"a":{}}}}]}': 4,
        '{"properties":{"in":' * 20 + "{}" + "}}" * 20: 21,
    }
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    found = {r["t"]: r["n"] for r in df.select("t", documents._levels(F.col("t")).alias("n")).collect()}
    assert all(texts[t] <= found[t] <= texts[t] + 1 for t in texts), found
    nodes = documents.schema_nodes(
        df.select(F.col("t").alias("schema_id"), F.col("t").alias("schema_json")), strict=False
    )
    depths = {r["schema_id"]: r["d"] for r in nodes.groupBy("schema_id").agg(F.max("depth").alias("d")).collect()}
    assert depths == {t: n - 1 for t, n in texts.items()}


def test_lines_of_an_order_are_shuffled_once(spark, tmp_path):
    from catalog import inputs

    lines = [(1, 1, "R", "F"), (1, 2, "A", "O"), (1, 2, "N", "F"), (2, 1, "N", "F")]
    columns = "l_orderkey long, l_linenumber int, l_returnflag string, l_linestatus string"
    spark.createDataFrame(lines, columns).write.parquet(str(tmp_path / "lineitem.parquet"))
    schemas = inputs.order_schemas(spark, str(tmp_path))
    assert _plan(schemas).count("Exchange") == 1
    found = {r["schema_id"]: r["schema_json"] for r in schemas.collect()}
    assert '"l2":{"type":"number"}' in found[1] and '"required":["l1"]' in found[2]
