"""JSON-line rows: scan, count, shredding, and the three-way split."""

from __future__ import annotations

import random
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from schemagauge.functions import variants as V
from schemagauge.session import prepare

PARTS = ("train", "validation", "overflow")
_BUCKETS = 16**7  # seven hexadecimal digits of a hash
_TOGETHER = 10_000  # equal rows that are dealt out from one place


def json_rows(
    source: str | list[str] | DataFrame, col: str = "value", spark: SparkSession | None = None
) -> DataFrame:
    """Lines whose first character is ``{``; all others are left out silently.

    ``source`` is a path of text files or a DataFrame with a string column. Lines
    with a leading blank, arrays and scalars are not rows.
    """
    if isinstance(source, DataFrame):
        lines = source
    else:
        lines = (spark or SparkSession.active()).read.text(source).withColumnRenamed("value", col)
    return lines.filter((F.length(col) > 0) & F.startswith(F.col(col), F.lit("{")))


def count_rows(rows: DataFrame, known: int | None = None) -> int:
    """Number of rows; a number known beforehand saves the scan."""
    return rows.count() if known is None else known


def drop_empty(rows: DataFrame, col: str = "value") -> DataFrame:
    return rows.filter(F.length(col) > 0)


def shred(rows: DataFrame, col: str = "value", mark_empty: bool = True) -> DataFrame:
    """One output row per value inside each record: its ``path`` and its ``kind``.

    Contents are dropped, only structure remains. With ``mark_empty`` false, empty
    containers count as ordinary objects and arrays.
    """
    prepare(rows.sparkSession)
    found = V.all_paths(F.try_parse_json(col), V.nesting_bound(F.col(col)), mark_empty)
    # Outer, as for others Spark infers a filter which would walk every record once more.
    return rows.select(
        *[c for c in rows.columns if c != col], F.inline_outer(found).alias("path", "kind")
    ).filter(F.col("path").isNotNull())


@dataclass(frozen=True)
class SplitSizes:
    train: float
    validation: float
    overflow: float


def split_sizes(total: int, train_percent: float, validation: int) -> SplitSizes:
    """Expected sizes of the parts; ``train_percent`` is out of 100.

    Where training and validation exceed the rows there are, training gives way.
    """
    if train_percent > 100.0:
        raise ValueError(f"train_percent cannot exceed 100, found {train_percent}")
    if validation > total or validation < 0:
        raise ValueError(f"cannot take {validation} validation rows out of {total}")
    train = total * (train_percent / 100.0)
    if train + validation > total:
        train = float(total - validation)
    return SplitSizes(train, float(validation), total - validation - train)


def bucket(seed: int | str, *key: Column) -> Column:
    """A number from 0 up to 16**7 which depends on the seed and the key alone."""
    parts = [F.lit(str(seed))] + [k.cast("string") for k in key]
    digest = F.md5(F.concat_ws("|", *parts).cast("binary"))
    return F.conv(F.substring(digest, 1, 7), 16, 10).cast("bigint")


def numbered(rows: DataFrame, into: str = "copy") -> DataFrame:
    """The rows, equal ones with running numbers from 0, so that no two are alike.

    Equal rows can't be told apart, so they are counted, with one partial count per task and
    distinct row, and dealt out again, ``_TOGETHER`` from one place at most. A row's number depends on
    nothing but the rows there are: it is the same after any reshuffle or retry.
    """
    times = rows.groupBy(*rows.columns).agg(F.count("*").alias("_times"))
    starts = F.sequence(F.lit(0).cast("bigint"), F.col("_times") - 1, F.lit(_TOGETHER).cast("bigint"))
    blocks = times.withColumn("_start", F.explode(starts))
    many = blocks.filter(F.col("_times") > _TOGETHER).repartition(*rows.columns, "_start")
    every = blocks.filter(F.col("_times") <= _TOGETHER).unionByName(many)
    last = F.least(F.col("_start") + _TOGETHER, F.col("_times")) - 1
    return every.withColumn(into, F.explode(F.sequence(F.col("_start"), last))).drop("_times", "_start")


def with_part(
    rows: DataFrame,
    sizes: SplitSizes,
    seed: int | None = None,
    key: list[str] | None = None,
    into: str = "part",
) -> DataFrame:
    """Label every row ``train``, ``validation`` or ``overflow``.

    The part is a function of the seed and of ``key``, columns that tell rows apart, and so
    survives any reordering or repartitioning; it is given in one narrow pass. Without
    ``key`` rows are told apart by all their columns and their number among equal rows,
    see :func:`numbered`, which takes a shuffle of them.
    """
    total = sizes.train + sizes.validation + sizes.overflow
    if total <= 0:
        return rows.withColumn(into, F.lit(PARTS[2]))
    if seed is None:
        seed = random.randrange(2**31)
    columns = rows.columns
    if key is None:
        rows, key = numbered(rows, "_copy"), [*columns, "_copy"]
    draw = bucket(seed, *[F.col(k) for k in key]) / F.lit(float(_BUCKETS))
    return rows.withColumn("_draw", draw).withColumn(
        into,
        F.when(F.col("_draw") < sizes.train / total, PARTS[0])
        .when(F.col("_draw") < (sizes.train + sizes.validation) / total, PARTS[1])
        .otherwise(PARTS[2]),
    ).select(*columns, into)


def split(
    rows: DataFrame,
    train_percent: float,
    validation: int,
    seed: int | None = None,
    total: int | None = None,
    key: list[str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Training and validation rows; the overflow belongs to neither."""
    sizes = split_sizes(count_rows(rows, total), train_percent, validation)
    if seed is None:
        seed = random.randrange(2**31)
    labelled = with_part(rows, sizes, seed, key)
    train = labelled.filter(F.col("part") == PARTS[0]).drop("part")
    held_out = labelled.filter(F.col("part") == PARTS[1]).drop("part")
    return train, held_out
