"""The operators as stages of a pipeline: documents in, documents out.

A stage keeps the columns of the documents and decides on all rows that it is given. It
finds its own columns again by the id and a hash of the text (the quality rules by the
host, too), so rows that agree in these share their fate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from schemagauge.llm import decontaminate, line_dedup, near_dedup, packing, quality_rules
from schemagauge.llm.columns import text_or_empty


def _only(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of ``docs`` among ``kept``, which has rid and rhash of the rows to stay."""
    mine = docs["doc_id"].eqNullSafe(kept["rid"]) & (
        F.xxhash64(text_or_empty("text")) == kept["rhash"]
    )
    return docs.join(kept, mine, "left_semi")


def quality(docs: DataFrame) -> DataFrame:
    """Documents that are kept, without the lines that their host repeats."""
    found = quality_rules.verdicts(docs).filter("kept")
    # Rows that agree in id, text and host are one row here, so that none comes back twice.
    found = found.groupBy("rid", "rhash", F.col("host").alias("of_host")).agg(F.first("gone").alias("gone"))
    name = "found"
    while name in map(str.lower, docs.columns):
        name += "_"
    found = found.select(F.struct("*").alias(name))
    its = F.col(name)
    mine = (
        docs["doc_id"].eqNullSafe(its["rid"])
        & (F.xxhash64(text_or_empty("text")) == its["rhash"])
        & docs["source"].cast("string").eqNullSafe(its["of_host"])
    )
    left = quality_rules.text_left(docs["text"].cast("string"), its["gone"])
    return docs.join(found, mine).select(*[left.alias(c) if c == "text" else docs[c] for c in docs.columns])


def lines(docs: DataFrame) -> DataFrame:
    found = line_dedup.drop_shared_lines(docs)
    return found.select(
        *[F.col("kept").alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    )


def near(docs: DataFrame) -> DataFrame:
    """One document of each component stays: that with the smallest id, once.

    Of texts that share the id, that with the smallest hash stays.
    """
    found = near_dedup.near_duplicates(docs)
    kept = found.filter("rid <=> component").groupBy("rid").agg(F.min("rhash").alias("rhash"))
    unknown = docs.filter("doc_id is null")
    return _only(docs.filter("doc_id is not null"), kept).dropDuplicates(["doc_id"]).union(unknown)


def benchmark(docs: DataFrame, items: DataFrame) -> DataFrame:
    found = decontaminate.contained_items(docs, items).select(F.col("doc_id").alias("rid")).distinct()
    return docs.join(found, docs["doc_id"] == found["rid"], "left_anti")


def packed(docs: DataFrame) -> DataFrame:
    found = packing.pieces(docs).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return packing.pack(found, docs.count()).select(
        F.col("rid").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )
