"""A join whose keys may be hot on one side and are unique on the other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key with no more rows than this is left whole.
SHARE = 1000
#: There are fewer hot keys than this, so what is broadcast is bounded at any size.
MOST_HOT = 10_000


def join_unique(rows: DataFrame, unique: DataFrame, key: list[str], spread: Column, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``unique``, which has a row per ``key`` at most, all of it short.

    A key that holds more than ``SHARE`` rows, and more than one row in ``MOST_HOT`` of all,
    is dealt over tasks by ``spread``, and its row of ``unique`` is copied to each. ``rows``
    are read twice. Null keys match nothing and stay with ``how="left"``.
    """
    counts = rows.select(*key).dropna().groupBy(*key).agg(F.count("*").alias("times"))
    share = max(SHARE, -(-rows.count() // MOST_HOT))
    hot = F.broadcast(
        counts.filter(F.col("times") > share).select(*key, F.ceil(F.col("times") / share).alias("salts"))
    )
    salts = F.coalesce("salts", F.lit(1).cast("long"))
    dealt = rows.join(hot, key, "left").withColumn("salt", F.pmod(F.xxhash64(spread), salts)).drop("salts")
    copies = unique.join(hot, key, "left").withColumn(
        "salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1))
    )
    return dealt.join(copies.drop("salts"), [*key, "salt"], how).drop("salt")
