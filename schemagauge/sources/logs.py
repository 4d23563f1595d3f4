"""Schema logs: text files in which an info line and a schema line take turns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from schemagauge.session import reliable


def log_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(path, file, pos, line)`` of a file, a folder or a ``*`` pattern.

    ``path`` tells files apart, ``file`` is the name alone. Names that begin with ``_``
    or ``.`` are hidden from Spark.

    Files stay splittable and are read once. Lines are numbered within the block of the
    file that was read as one and written with that number to the session's checkpoint
    folder, so the number holds whatever is computed again. The blocks before add what
    they hold; only one number per block is ever put in order.
    """
    scanned = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_name").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("n"),
        F.col("value").alias("line"),
    )
    lines = reliable(scanned)
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = (
        lines.groupBy("path", "block")
        .agg(F.min("n").alias("first"), F.count("*").alias("held"))
        .withColumn("offset", F.coalesce(F.sum("held").over(before), F.lit(0)))
        .drop("held")
    )
    return lines.join(blocks, ["path", "block"]).select(
        "path", "file", (F.col("offset") + F.col("n") - F.col("first")).alias("pos"), "line"
    )


def pair_lines(lines: DataFrame) -> DataFrame:
    """``(path, file, rec, info_line, schema_json)`` from numbered lines.

    All columns but ``pos`` and ``line`` identify a log, so logs of equal names stay apart.

    Line 2k is the info of run k and line 2k+1 its schema, NULL where it is lacking.
    """
    odd = F.pmod(F.col("pos"), F.lit(2)) == 1
    return (
        lines.groupBy(*_identity(lines), F.floor(F.col("pos") / 2).cast("bigint").alias("rec"))
        .agg(
            F.max(F.when(~odd, F.col("line"))).alias("info_line"),
            F.max(F.when(odd, F.col("line"))).alias("schema_json"),
        )
    )


def _identity(lines: DataFrame) -> list[str]:
    return [c for c in lines.columns if c not in ("pos", "line")]


def decode_info(pairs: DataFrame) -> DataFrame:
    """Add ``info``, the flat info object as a map of strings."""
    return pairs.withColumn("info", F.from_json("info_line", "map<string,string>")).drop(
        "info_line"
    )


def schema_log(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return decode_info(pair_lines(log_lines(spark, path)))


def first_schemas(lines: DataFrame) -> DataFrame:
    """``(path, file, schema_json)``: the second line of every file."""
    second = lines.filter(F.col("pos") == 1)
    return second.select(*_identity(lines), F.col("line").alias("schema_json"))


def whole_file_schemas(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(path, file, schema_json)`` of files that hold one schema each."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_name").alias("file"), F.col("value").alias("schema_json")
    )


def full_training_runs(log: DataFrame) -> DataFrame:
    """Runs whose ``TrainPercent`` is exactly the text ``1.0``."""
    return log.filter(F.col("info")["TrainPercent"] == "1.0")


def typed_runs(log: DataFrame) -> DataFrame:
    """Info strings as typed columns; a lacking mandatory entry is an error."""

    def needed(name: str):
        value = F.col("info")[name]
        return F.when(value.isNull(), F.raise_error(F.lit(f"run without {name}"))).otherwise(value)

    seed = F.col("info")["Seed"]
    return log.select(
        *[c for c in log.columns if c != "info"],
        needed("inputFile").alias("input_file"),
        needed("TotalTime").alias("total_time"),
        F.col("info")["TrainPercent"].cast("double").alias("train_percent"),
        needed("ValidationSize").cast("int").alias("validation_size"),
        F.when(seed != "None", seed.cast("int")).alias("seed"),
    )


def algorithm_of(file: str = "file"):
    """Second dot-separated part of a test file's name."""
    return F.split_part(F.col(file), F.lit("."), F.lit(2))


def dataset_of(file: str = "file"):
    """First dot-separated part of a truth file's name."""
    return F.split_part(F.col(file), F.lit("."), F.lit(1))
