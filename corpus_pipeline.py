"""A corpus from raw documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns documents; what it returns is written
as Parquet and read again as the next one's docs. The last returns the places of all
pieces in their sequences.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from schemagauge.llm import stages
from schemagauge.llm.storage import shared_folder

STAGES = [
    ("quality_rules", lambda spark, docs, sf_dir: stages.quality(docs)),
    ("line_dedup", lambda spark, docs, sf_dir: stages.lines(docs)),
    ("near_dedup", lambda spark, docs, sf_dir: stages.near(docs)),
    (
        "decontamination",
        lambda spark, docs, sf_dir: stages.benchmark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")),
    ),
    ("packing", lambda spark, docs, sf_dir: stages.packed(docs)),
]

#: MinHash and packing have no counterpart in SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
