"""The registered queries: each takes a session and a folder of tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog import inputs as I
from schemagauge.functions import variants as V
from schemagauge.operators import distance as D
from schemagauge.operators import issues, measures
from schemagauge.operators.relational import spread, validate_by_joins
from schemagauge.operators.schema import load_schema
from schemagauge.operators.verdict import validate, verdict
from schemagauge.plans.evaluate import evaluate_runs
from schemagauge.plans.summary import Check, summarize, summarize_many
from schemagauge.session import prepare
from schemagauge.sources import logs, rows
from schemagauge.sources.documents import schema_nodes
from schemagauge.sources.results import result_lines

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    def prepared(spark: SparkSession, folder: str) -> DataFrame:
        return function(prepare(spark), folder)

    QUERIES[function.__name__] = prepared
    return function


# --- rows -------------------------------------------------------------------------------


@query
def json_row_filter(spark, folder):
    kept = rows.json_rows(I.raw_lines(spark, folder))
    return rows.drop_empty(kept).select("event_id", F.length("value").cast("bigint").alias("n"))


@query
def row_count(spark, folder):
    kept = rows.json_rows(I.raw_lines(spark, folder))
    return kept.agg(F.count("*").alias("n_rows"))


@query
def malformed_rows(spark, folder):
    kept = rows.json_rows(I.raw_lines(spark, folder))
    return validate(kept, I.RAW).select("event_id", "status")


@query
def row_kinds(spark, folder):
    v = F.try_parse_json("value")
    members = F.map_entries(V.as_object(v))
    return I.nested_rows(spark, folder).select(
        "key",
        "no",
        F.inline_outer(
            F.transform(members, lambda e: F.struct(e["key"], V.kind(e["value"])))
        ).alias("member", "kind"),
    )


@query
def row_paths(spark, folder):
    found = rows.shred(I.nested_rows(spark, folder))
    return found.groupBy("key", "path", "kind").agg(F.count("*").alias("n"))


@query
def row_paths_plain(spark, folder):
    found = rows.shred(I.nested_rows(spark, folder), mark_empty=False)
    return found.groupBy("path", "kind").agg(F.count("*").alias("n"))


@query
def row_leaves(spark, folder):
    start = F.array(F.struct(F.lit("$").alias("path"), F.try_parse_json("value").alias("v")))
    leaves = V.leaf_paths(start, V.nesting_bound(F.col("value")))
    found = I.mixed_rows(spark, folder).select(F.explode_outer(leaves).alias("path"))
    return found.groupBy("path").agg(F.count("*").alias("n_rows"))


# --- verdicts ---------------------------------------------------------------------------


@query
def validate_flat(spark, folder):
    return validate(I.flat_rows(spark, folder), I.FLAT).select("key", "status")


@query
def validate_required(spark, folder):
    return validate(I.flat_rows(spark, folder), I.FLAT_ALL_REQUIRED).select("key", "status")


@query
def validate_open_object(spark, folder):
    return validate(I.flat_rows(spark, folder), I.FLAT_OPEN).select("key", "status")


@query
def validate_max_properties(spark, folder):
    limited = replace(load_schema(I.FLAT), max_properties=4.0)
    return validate(I.flat_rows(spark, folder), limited).select("key", "status")


@query
def validate_empty_object(spark, folder):
    v = F.try_parse_json("value")
    k = '"properties":{"k":{"type":"number"}},"required":["k"]'
    return I.props_rows(spark, folder).select(
        "event_id",
        verdict('{"type":"object",%s}' % k, v).alias("closed_ok"),
        verdict('{"type":"object",%s,"additionalProperties":true}' % k, v).alias("open_ok"),
        verdict('{"type":"object","additionalProperties":true}', v).alias("bare_ok"),
    )


@query
def validate_arrays(spark, folder):
    return validate(I.nested_rows(spark, folder), I.NESTED).select("key", "no", "status")


@query
def validate_max_items(spark, folder):
    v = F.try_parse_json("value")
    return I.nested_rows(spark, folder).select(
        "key",
        "no",
        verdict(I.NESTED_TWO, v).alias("within_items"),
        verdict(I.NESTED_TWO_ALIAS, v).alias("within_properties"),
    )


@query
def validate_anyof(spark, folder):
    return validate(I.mixed_rows(spark, folder), I.MIXED).select("id", "status")


@query
def validate_oneof(spark, folder):
    v = F.try_parse_json("value")
    both = '{"oneOf":[%s,%s]}' % (I.CUSTOMER_STRICT, I.CUSTOMER)
    return I.customer_rows(spark, folder).select(
        "id",
        verdict(I.CUSTOMER_STRICT, v).alias("number_only"),
        verdict(I.CUSTOMER, v).alias("number_or_null"),
        verdict(both, v).alias("any_of_both"),
    )


@query
def validate_wide(spark, folder):
    return validate_by_joins(I.mixed_rows(spark, folder), I.MIXED_WIDE, ["id"]).select(
        "id", "status"
    )


@query
def validate_nested_by_joins(spark, folder):
    # Rows have no key of their own, but these columns tell their texts apart: equal
    # texts are judged once and counted. A key with a null in it stands for no text.
    # Rows are shuffled once, by these columns; texts are counted and judged where they are.
    key = ["key", "no", "qty", "flag"]
    nested = I.nested_rows(spark, folder).dropna(subset=key)
    texts = spread(nested, key, nested.count()).groupBy(*key, "value").agg(F.count("*").alias("n"))
    judged = validate_by_joins(texts, I.NESTED_TWO, [*key, "n"], is_spread=True)
    return judged.groupBy("status").agg(F.sum("n").alias("n_rows"))


@query
def strong_checks(spark, folder):
    lines = F.element_at(V.as_object(F.try_parse_json("value")), F.lit("lines"))
    found = I.nested_rows(spark, folder).select(lines.alias("v"))
    flags = found.select(
        issues.strong_checks('{"type":"array","maxItems":2}', F.col("v")).alias("limited"),
        issues.strong_checks('{"type":"string"}', F.col("v")).alias("text"),
    )
    return flags.agg(
        F.sum(F.col("limited.array_max").cast("bigint")).alias("array_max"),
        F.sum(F.col("limited.type_check").cast("bigint")).alias("array_type"),
        F.sum(F.col("text.type_check").cast("bigint")).alias("text_type"),
    )


# --- issues and totals ------------------------------------------------------------------


@query
def failing_rows(spark, folder):
    return issues.failing_rows(I.mixed_rows(spark, folder), I.MIXED).select("id")


@query
def missing_paths(spark, folder):
    found = issues.missing_paths(I.mixed_rows(spark, folder), I.MIXED)
    return found.select(F.col("entity_idx").cast("bigint").alias("entity_idx"), "path")


@query
def required_edits(spark, folder):
    return issues.required_edits(I.mixed_rows(spark, folder), I.MIXED)


@query
def best_entity(spark, folder):
    found = issues.best_entity(I.mixed_rows(spark, folder), I.MIXED)
    return found.select(
        "id",
        F.col("entity_idx").cast("bigint").alias("entity_idx"),
        F.col("n_paths").cast("bigint").alias("n_paths"),
    )


@query
def schema_summary(spark, folder):
    return summarize(I.mixed_rows(spark, folder), I.MIXED)


@query
def summary_wide(spark, folder):
    return summarize(I.mixed_rows(spark, folder), I.MIXED_WIDE)


@query
def summary_deep(spark, folder):
    return summarize(I.deep_rows(spark, folder), I.FLAT_DEEP)


@query
def schema_summaries(spark, folder):
    checks = [
        Check("all_required", I.FLAT_ALL_REQUIRED),
        Check("closed", I.FLAT),
        Check("open", I.FLAT_OPEN),
    ]
    return summarize_many(I.flat_rows(spark, folder), checks)


# --- logs and schema documents ----------------------------------------------------------


@query
def schema_log_pairs(spark, folder):
    return logs.pair_lines(I.log_lines(spark, folder))


@query
def first_schemas(spark, folder):
    return logs.first_schemas(I.log_lines(spark, folder))


@query
def run_filter(spark, folder):
    log = logs.decode_info(logs.pair_lines(I.log_lines(spark, folder)))
    runs = logs.typed_runs(logs.full_training_runs(log))
    return runs.select(
        "path",
        "file",
        "rec",
        "input_file",
        "total_time",
        "train_percent",
        F.col("validation_size").cast("bigint").alias("validation_size"),
        F.col("seed").cast("bigint").alias("seed"),
    )


@query
def schema_node_table(spark, folder):
    nodes = schema_nodes(I.order_schemas(spark, folder))
    return nodes.select(
        "schema_id",
        "path",
        "edge",
        "type",
        F.col("depth").cast("bigint").alias("depth"),
        F.col("n_props").cast("bigint").alias("n_props"),
        "key_is_required",
        "additional",
    )


# --- measures ---------------------------------------------------------------------------


@query
def precision(spark, folder):
    found = measures.precision(schema_nodes(I.order_schemas(spark, folder)))
    return found.select("schema_id", "precision")


@query
def precision_open(spark, folder):
    nodes = schema_nodes(I.order_schemas(spark, folder))
    return nodes.filter("cut").select("schema_id", "sid")


@query
def precision_large(spark, folder):
    nodes = schema_nodes(I.supplier_schemas(spark, folder), "file")
    found = measures.precision(nodes, "file")
    return found.select(
        "file",
        F.round("log2_precision", 6).alias("log2_precision"),
        F.length("precision").cast("bigint").alias("n_digits"),
        F.right("precision", F.lit(9)).cast("bigint").alias("last_digits"),
    )


@query
def grouping(spark, folder):
    return measures.grouping(schema_nodes(I.order_schemas(spark, folder)))


@query
def base_size(spark, folder):
    found = measures.base_size(schema_nodes(I.order_schemas(spark, folder)))
    return found.select("schema_id", F.col("base_size").cast("bigint").alias("base_size"))


@query
def attribute_count(spark, folder):
    return measures.attribute_count(schema_nodes(I.order_schemas(spark, folder)))


@query
def attribute_set(spark, folder):
    found = measures.attribute_set(schema_nodes(I.order_schemas(spark, folder)))
    return found.select("schema_id", F.array_join("name", "/").alias("name"))


@query
def attribute_diff(spark, folder):
    left = schema_nodes(I.order_schemas(spark, folder))
    right = schema_nodes(I.order_schemas(spark, folder, only_status="F"))
    found = measures.attribute_diff(left, right)
    return found.select("schema_id", F.array_join("name", "/").alias("name"))


@query
def nested_entity_lint(spark, folder):
    nodes = schema_nodes(I.array_schemas(spark, folder))
    return measures.nested_entities(nodes).select("schema_id", "path")


# --- distances --------------------------------------------------------------------------


def _distances(spark, folder, comparison, listed=False):
    return D.schema_distances(
        schema_nodes(I.supplier_schemas(spark, folder), "file"),
        schema_nodes(I.nation_schemas(spark, folder), "file"),
        comparison,
        listed=listed,
    )


@query
def schema_path_set(spark, folder):
    found = D.schema_paths(schema_nodes(I.supplier_schemas(spark, folder), "file"))
    return found.select("file", F.col("entity_idx").cast("bigint").alias("entity_idx"), "path")


@query
def distance_symmetric(spark, folder):
    return _distances(spark, folder, "symmetric")


@query
def distance_diff(spark, folder):
    return _distances(spark, folder, "diff")


@query
def distance_sub(spark, folder):
    return _distances(spark, folder, "sub")


@query
def distance_report(spark, folder):
    return D.distance_report(_distances(spark, folder, "symmetric", listed=True))


@query
def distance_cells(spark, folder):
    return D.report_cells(_distances(spark, folder, "symmetric", listed=True))


@query
def distance_lines(spark, folder):
    return D.report_lines(_distances(spark, folder, "symmetric", listed=True))


@query
def subset_report(spark, folder):
    return D.subset_report(_distances(spark, folder, "sub", listed=True))


# --- splits and whole evaluations -------------------------------------------------------


@query
def split_buckets(spark, folder):
    flat = I.flat_rows(spark, folder)
    total = rows.count_rows(flat)
    sizes = rows.split_sizes(total, 1.0, total // 4)
    return rows.with_part(flat, sizes, seed=42, key=["key"]).select("key", "part")


def _runs(spark, total):
    """Three runs over the flat rows, a quarter of which they hold out."""
    return spark.createDataFrame(
        [
            ("run1", "orders", "10", 1.0, total // 4, 6, I.FLAT),
            ("run2", "orders", "20", 1.0, total // 4, 7, I.FLAT_ALL_REQUIRED),
            ("run3", "orders", "30", 1.0, total // 4, 8, I.FLAT_OPEN),
        ],
        "run_id string, input_file string, total_time string, train_percent double, "
        "validation_size int, seed int, schema_json string",
    )


@query
def evaluate_log_runs(spark, folder):
    flat = I.flat_rows(spark, folder)
    total = rows.count_rows(flat)
    results = evaluate_runs(
        _runs(spark, total), lambda _: flat, key=["key"], totals={"orders": total}
    )
    return result_lines(results)
