"""Quality of one or several schemas over the same rows, in one pass."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from schemagauge.functions import variants as V
from schemagauge.operators import tabled
from schemagauge.operators.issues import judged
from schemagauge.operators.schema import Schema, to_schema
from schemagauge.operators.verdict import parsed
from schemagauge.session import prepare


@dataclass(frozen=True)
class Check:
    """One schema to hold against the rows for which ``applies`` is true."""

    name: str
    schema: str | Schema
    applies: Column | None = None


def summarize_many(
    rows: DataFrame, checks: list[Check], col: str = "value", mode: str = "permissive"
) -> DataFrame:
    """A row per check: ``total accepted wrong malformed share required_edits``.

    Every text is parsed once for all checks. What is shuffled is one count per
    check, entity and missing path and task, so accepted rows and rows repeating a
    path add nothing to it. Checks without any row are left out.

    Where a schema is so large that it is held against rows by a table, rows are counted by
    structure first, and each structure is judged once.
    """
    prepare(rows.sparkSession)
    v = F.col("_v")
    if any(tabled.is_large(to_schema(c.schema)) for c in checks):
        flags = [f"_applies{i}" for i in range(len(checks))]
        shapes = rows.select(
            F.when(parsed(F.col(col), mode).isNotNull(), V.structure(F.col(col))).alias("_shape"),
            *[_applies(c).alias(flag) for c, flag in zip(checks, flags)],
        )
        rows = shapes.groupBy("_shape", *flags).agg(F.count("*").alias("_times"))
        checks = [Check(c.name, c.schema, F.col(flag)) for c, flag in zip(checks, flags)]
        col = "_shape"
    else:
        rows = rows.withColumn("_times", F.lit(1))
    bound = V.nesting_bound(F.col(col))
    rows = rows.withColumn("_v", parsed(F.col(col), mode))

    def outcome(check: Check) -> Column:
        # Bound to a name, so that the verdict is worked out once per row and check.
        found = F.array(F.when(_applies(check), judged(check.schema, v, bound, mode)))
        status = lambda j: (
            F.when(v.isNull(), "malformed").when(j["accepted"], "accepted").otherwise("rejected")
        )
        return F.transform(
            found,
            lambda j: F.struct(
                F.lit(check.name).alias("name"),
                F.when(_applies(check), status(j)).alias("status"),
                j["charge"].alias("charge"),
            ),
        )

    outcomes = F.filter(
        F.concat(*[outcome(c) for c in checks]), lambda o: o["status"].isNotNull()
    )
    per_path = (
        rows.select("_times", F.inline_outer(outcomes))
        .filter(F.col("name").isNotNull())
        .select(
            "_times",
            "name",
            "status",
            F.col("charge.entity_idx").alias("entity_idx"),
            F.posexplode_outer("charge.paths").alias("pos", "path"),
        )
        .groupBy("name", "entity_idx", "path")
        .agg(
            _rows(F.lit(True)).alias("total"),
            _rows(F.col("status") == "accepted").alias("accepted"),
            _rows(F.col("status") == "malformed").alias("malformed"),
        )
    )
    return (
        per_path.groupBy("name")
        .agg(
            F.sum("total").alias("total"),
            F.sum("accepted").alias("accepted"),
            F.sum("malformed").alias("malformed"),
            F.count("path").alias("required_edits"),
        )
        .select(
            "name",
            "total",
            "accepted",
            (F.col("total") - F.col("accepted")).alias("wrong"),
            "malformed",
            F.try_divide(F.col("accepted").cast("double"), F.col("total")).alias("share"),
            "required_edits",
        )
    )


def _applies(check: Check) -> Column:
    return F.lit(True) if check.applies is None else check.applies


def _rows(condition: Column) -> Column:
    """Rows, not their paths: only the first path of a row counts."""
    first = (F.coalesce(F.col("pos"), F.lit(0)) == 0) & condition
    return F.sum(F.when(first, F.col("_times")).otherwise(0))


def summarize(
    rows: DataFrame, schema: str | Schema, col: str = "value", mode: str = "permissive"
) -> DataFrame:
    """One row: ``total accepted wrong malformed share required_edits``.

    No rows at all give zeros and no share, or in ``failfast`` an error.
    """
    found = summarize_many(rows, [Check("", schema)], col, mode).drop("name")
    counts = [c for c in found.columns if c != "share"]
    totals = found.agg(
        *[F.coalesce(F.max(c), F.lit(0)).alias(c) for c in counts], F.max("share").alias("share")
    )
    if mode == "failfast":
        nothing = F.raise_error(F.lit("no rows to validate")).cast("bigint")
        totals = totals.withColumn(
            "total", F.when(F.col("total") == 0, nothing).otherwise(F.col("total"))
        )
    return totals.select(
        "total", "accepted", "wrong", "malformed", "share", "required_edits"
    )
