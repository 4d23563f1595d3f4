"""The registered queries of the operators, each over its whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from schemagauge.llm import (
    archives,
    chat,
    decontaminate,
    divergence,
    line_dedup,
    near_dedup,
    packing,
    periodic_runs,
    quality_rules,
    secret_scan,
    suffix_dedup,
    token_files,
    toxicity,
)
from schemagauge.llm.columns import row_key, same_row, text_or_empty
from schemagauge.llm.storage import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op1_secrets(spark, folder):
    found = secret_scan.scan(_table(spark, folder, "documents").select("doc_id", "text"))
    spans = F.col("spans")
    base = F.filter(spans, lambda s: s["kind"] != "markov")

    def n(kind):
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")

    return found.select(
        F.col("rid").alias("doc_id"),
        n("assign").alias("n_assign"),
        n("access").alias("n_access"),
        n("hex").alias("n_hex"),
        F.sha2(secret_scan.written(base), 256).alias("base_sha256"),
        secret_scan.written(spans).alias("spans"),
        n("markov").alias("n_markov"),
    )


@query
def op2_line_dedup(spark, folder):
    found = line_dedup.drop_shared_lines(_table(spark, folder, "documents").select("doc_id", "text"))
    return found.select(
        "row.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256")
    )


@query
def op3_chat(spark, folder):
    return chat.render_maximal(_table(spark, folder, "conversations"))


@query
def op9_quality_rules(spark, folder):
    found = quality_rules.verdicts(_table(spark, folder, "documents").select("doc_id", "text", "source"))
    return found.select(
        F.col("rid").alias("doc_id"), *quality_rules.MEASURES, "n_removed", "base_failed", "kept"
    )


@query
def op10_near_dedup(spark, folder):
    found = near_dedup.near_duplicates(_table(spark, folder, "documents").select("doc_id", "text"))
    return found.select(
        F.col("rid").alias("doc_id"),
        "n_shingles",
        F.col("component").alias("component_id"),
        (F.col("rid") == F.col("component")).alias("kept"),
    )


@query
def op4_packing(spark, folder):
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    found = packing.pieces(docs).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return packing.pack(found, docs.count()).select(
        F.col("rid").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


@query
def op5_decontamination(spark, folder):
    return decontaminate.contained_items(
        _table(spark, folder, "documents").select("doc_id", "text"),
        _table(spark, folder, "benchmark").select("item_id", "text"),
    )


@query
def op6_token_files(spark, folder):
    written = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    token_files.write_tokens(_table(spark, folder, "documents").select("doc_id", "text"), written)
    return token_files.read_tokens(spark, written).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32")
    )


@query
def op7_toxicity(spark, folder):
    found = toxicity.scores(
        _table(spark, folder, "documents").select("doc_id", "text"),
        _table(spark, folder, "labels").select("doc_id", "toxic"),
    )
    return found.select(
        F.col("doc").alias("doc_id"),
        (toxicity.fold_of("doc") == 2).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


@query
def op8_suffix_dedup(spark, folder):
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    cut = suffix_dedup.cut_repeats(docs).withColumn("sha", F.sha2("kept", 256)).drop("kept")
    cut = cut.distinct()  # rows that agree in id and text are as many in the table
    text = text_or_empty()
    whole = docs.select(
        *row_key("doc_id", "text"), F.octet_length(text).alias("n_bytes"), F.sha2(text, 256).alias("all")
    )
    nothing = F.lit(0).cast("bigint")
    return whole.join(cut, same_row(whole, cut), "left").select(
        whole["rid"].alias("doc_id"),
        F.col("n_bytes").cast("bigint").alias("n_bytes"),
        F.coalesce("n_removed", nothing).alias("n_removed"),
        F.coalesce("n_spans", nothing).alias("n_spans"),
        F.coalesce("sha", "all").alias("kept_sha256"),
    )


@query
def op11_warc(spark, folder):
    written = f"{shared_folder(spark)}/archives-{uuid.uuid4().hex}"
    archives.write_arc(_table(spark, folder, "pages"), f"{written}/arc")
    archives.write_warc(archives.to_warc(spark, f"{written}/arc"), f"{written}/warc")
    found = archives.resolved(archives.read_warc(spark, f"{written}/warc", payloads=False))
    return found.select(
        F.col("key").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        F.col("type").alias("record_type"),
        F.col("refers_key").alias("refers_to"),
    )


@query
def op12_divergence(spark, folder):
    return divergence.divergence(_table(spark, folder, "documents").select("text", "lang", "source"))


@query
def op13_periodic_runs(spark, folder):
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    drawn = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(drawn / 10)
    planted = periodic_runs.repeat_tail(
        text_or_empty(), lambda n: F.pmod(g, n), lambda n: 1 + F.floor((n - F.pmod(g, n)) / (3 + g % 8))
    )
    docs = docs.select("doc_id", F.when(drawn % 10 == 0, planted).otherwise(F.col("text")).alias("text"))
    best = F.col("best")
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    found = periodic_runs.collapse_runs(docs).withColumn("best", periodic_runs.most_periodic(F.col("runs")))
    return found.select(
        F.col("rid").alias("doc_id"),
        F.size("runs").cast("long").alias("n_runs"),
        *[best[c].alias(c) for c in ("start", "length", "period")],
        F.floor(1000 * best["length"] / best["period"]).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
