"""Evaluate the runs of a schema log: split, validate, measure, report."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import groupby, islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from schemagauge.operators.measures import schema_measures
from schemagauge.operators.schema import SchemaError, to_schema
from schemagauge.plans.summary import Check, summarize_many
from schemagauge.sources import logs
from schemagauge.sources.documents import schema_nodes
from schemagauge.sources.results import FIELDS, result_lines
from schemagauge.sources.rows import PARTS, count_rows, json_rows, numbered, split_sizes, with_part

TOGETHER = 8  # runs over one input that share a scan
_COUNTED = FIELDS[:4]


def evaluate_runs(
    runs: DataFrame,
    open_rows: Callable[[str], DataFrame],
    validate: bool = True,
    key: list[str] | None = None,
    mode: str = "permissive",
    totals: dict[str, int] | None = None,
    together: int = TOGETHER,
) -> DataFrame:
    """Quality of every run, with columns named as in a result line.

    ``runs`` has ``run_id``, the columns of :func:`logs.typed_runs` and
    ``schema_json``; ``open_rows`` gives the rows of an input, ``key`` the columns
    that tell them apart (see :func:`with_part`). Each schema becomes part of a
    plan, as a ``StructType`` would, so runs come to the driver a batch at a time,
    never the rows. Runs over the same input share scans and parsing, ``together`` at
    a time. Schemas are measured as a table, whatever their number.

    No run is left out. One without a schema, or with one that is not supported, is an
    error in ``failfast``; otherwise its measures and counts are NULL.
    """
    strict = mode == "failfast"
    documents = runs.select("run_id", "schema_json")
    if strict:
        lacking = F.raise_error(F.concat(F.lit("no schema in run "), F.col("run_id").cast("string")))
        documents = documents.withColumn("schema_json", F.coalesce("schema_json", lacking))
    nodes = schema_nodes(documents, "run_id", strict=strict)
    if not strict:
        bad = nodes.filter(~F.col("supported")).select("run_id").distinct()
        nodes = nodes.join(bad, "run_id", "left_anti")
    measures = schema_measures(nodes, "run_id").select(
        "run_id",
        F.col("precision").alias("Precision"),
        F.col("grouping").cast("string").alias("Grouping"),
        F.col("base_size").cast("string").alias("BaseSchemaSize"),
    )
    described = runs.select(
        "run_id",
        F.col("input_file").alias("inputFile"),
        F.col("total_time").alias("TotalTime"),
        F.col("train_percent").cast("string").alias("TrainPercent"),
        F.col("validation_size").cast("string").alias("ValidationSize"),
        F.when(F.col("seed").isNull(), "None")
        .otherwise(F.concat(F.lit("Some("), F.col("seed").cast("string"), F.lit(")")))
        .alias("Seed"),
    ).join(measures, "run_id", "left")
    if not validate:
        return described
    validated = list(_validated(runs, open_rows, key, mode, totals or {}, together))
    if not validated:
        return described.select("*", *[F.lit(None).cast("string").alias(c) for c in _COUNTED])
    return described.join(reduce(DataFrame.unionByName, validated), "run_id", "left")


def _validated(runs, open_rows, key, mode, totals, together) -> Iterator[DataFrame]:
    ordered = runs.select(
        "run_id", "input_file", "train_percent", "validation_size", "seed", "schema_json"
    ).orderBy("input_file", "run_id")
    for input_file, of_input in groupby(ordered.toLocalIterator(), lambda r: r["input_file"]):
        rows = open_rows(input_file)
        total = count_rows(rows, totals.get(input_file))
        fit = (r for r in of_input if _is_usable(r, mode))
        while batch := list(islice(fit, together)):
            yield _validate_batch(rows, total, batch, key, mode)


def _is_usable(run, mode: str) -> bool:
    """Whether the schema of a run can be held against rows; an error in ``failfast``."""
    try:
        if run["schema_json"] is None:
            raise SchemaError("it has none")
        if to_schema(run["schema_json"]).any_of == ():
            raise SchemaError("the root anyOf has no branches")
    except SchemaError as error:
        if mode == "failfast":
            raise SchemaError(f"schema of run {run['run_id']}: {error}") from None
        return False
    return True


def _validate_batch(rows, total, batch, key, mode) -> DataFrame:
    id_type = type(batch[0]["run_id"])
    checks = []
    if key is None:  # once for all runs
        key = [*rows.columns, "_copy"]
        rows = numbered(rows, "_copy")
    for number, run in enumerate(batch):
        sizes = split_sizes(total, run["train_percent"], run["validation_size"])
        rows = with_part(rows, sizes, run["seed"], key, into=f"_part{number}")
        checks.append(
            Check(str(run["run_id"]), run["schema_json"], F.col(f"_part{number}") == PARTS[1])
        )
    nothing = rows.sparkSession.createDataFrame([(c.name,) for c in checks], "name string")
    found = nothing.join(summarize_many(rows, checks, mode=mode), "name", "left")

    def number(name: str):
        return F.coalesce(F.col(name), F.lit(0))

    size = number("total")
    if mode == "failfast":
        nothing_held_out = F.raise_error(F.lit("no validation rows")).cast("bigint")
        size = F.when(size == 0, nothing_held_out).otherwise(size)
    return found.select(
        F.col("name").cast("bigint" if id_type is int else "string").alias("run_id"),
        size.cast("string").alias("ValidationSizeActual"),
        F.col("share").cast("string").alias("Validation"),
        number("required_edits").cast("double").cast("string").alias("RequiredEdits"),
        number("wrong").cast("double").cast("string").alias("TotalWrong"),
    )


def evaluate_log(
    spark: SparkSession,
    path: str,
    open_rows: Callable[[str], DataFrame] | None = None,
    validate: bool = True,
    key: list[str] | None = None,
    mode: str = "failfast",
) -> DataFrame:
    """Result lines of a log file, for its runs with ``TrainPercent`` 1.0.

    Write them with :func:`schemagauge.sources.results.append_results`.
    """
    log = logs.full_training_runs(logs.schema_log(spark, path))
    runs = logs.typed_runs(log).withColumn(
        "run_id", F.concat_ws("#", "path", F.format_string("%012d", "rec"))
    )
    opener = open_rows or (lambda file: json_rows(file, spark=spark))
    return result_lines(evaluate_runs(runs, opener, validate, key, mode))
