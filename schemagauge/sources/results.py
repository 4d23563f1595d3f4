"""Result lines: one flat JSON object of strings per evaluated run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The fields of a result line, in order. The first four are there
# only where rows were validated.
FIELDS = (
    "ValidationSizeActual",
    "Validation",
    "RequiredEdits",
    "TotalWrong",
    "inputFile",
    "TotalTime",
    "TrainPercent",
    "ValidationSize",
    "Seed",
    "Precision",
    "Grouping",
    "BaseSchemaSize",
)


def result_lines(results: DataFrame, id_col: str = "run_id") -> DataFrame:
    """``(run_id, value)``, ``value`` the JSON line of a run."""
    fields = [F.col(f) for f in FIELDS if f in results.columns]
    return results.select(id_col, F.to_json(F.struct(*fields)).alias("value"))


def append_results(lines: DataFrame, log_path: str, once: bool = False, id_col: str = "run_id") -> None:
    """Append result lines to the folder of text files ``<log_path>.res``.

    With ``once`` each run has a folder of its own there, and writing its line again replaces
    it: a job that was broken off, or is run again, leaves one line per run.
    """
    if not once:
        lines.select("value").write.mode("append").text(log_path + ".res")
        return
    run = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    named = lines.select("value", run.alias("run")).repartition("run")
    writer = named.write.mode("overwrite").partitionBy("run").option("partitionOverwriteMode", "dynamic")
    writer.text(log_path + ".res")
