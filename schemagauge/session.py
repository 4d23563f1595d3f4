"""The few session settings the package relies on."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def prepare(spark: SparkSession) -> SparkSession:
    """Let ``parse_json`` keep the last of several equal keys instead of failing."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    return spark


def reliable(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder of the session and read it from there.

    The folder is the one the cluster names in ``spark.checkpoint.dir``, so the
    rows outlive the executors that made them. Only a session with a local master, as in
    tests, may go without it and then uses a temporary folder.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and (not context.master.startswith("local") or "cluster" in context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder which all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="schemagauge-"))
    return df.checkpoint(eager=True)
