"""Logged conversations: snapshots of longer ones collapse, the rest is rendered.

A log often holds a conversation again and again, each time with a few turns more. Turns
are hashed to 128 bits together with their position, and a running sum of these hashes
identifies every prefix of a conversation. A conversation whose hash of all turns is the
hash of a proper prefix of another one goes (anti-join); of equal conversations the one
with the smallest id stays. Both sides of the anti-join hold each hash once, so a first
turn or a conversation that is very common is one row there. Texts are shuffled once,
after that, and only those that stay.

Turns are in order of ``turn``, then role, then the md5 of the text, nulls first.

* Rows that agree in all four columns count once.
* A null role reads ``unknown``, a null text is empty; both differ from these for the
  comparison of turns. A null id is the id of one conversation.
* The markers of the format are escaped inside roles and texts, so a text can't end a turn.
* An empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The markers of the rendered format.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _numbered(turns: DataFrame, *more) -> DataFrame:
    """Distinct turns of each conversation with ``k``, from 1, and the digest of the text."""
    plain = turns.select(
        F.col("conv_id").alias("cid"),
        F.col("turn").alias("turn"),
        F.col("role").cast("string").alias("role"),
        F.md5(F.col("text").cast("string").cast("binary")).alias("digest"),
        *more,
    )
    order = Window.partitionBy("cid").orderBy(
        F.asc_nulls_first("turn"), F.asc_nulls_first("role"), F.asc_nulls_first("digest")
    )
    now = F.struct("turn", "role", "digest")
    marked = plain.withColumn("again", now.eqNullSafe(F.lag(now).over(order)))
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fresh = marked.filter(~F.col("again"))
    return fresh.withColumn("k", F.count("*").over(running))


def prefixes(turns: DataFrame) -> DataFrame:
    """For each conversation and k the hash of its first k turns: cid, k, last, p1..p4."""
    numbered = _numbered(turns)
    h1 = F.xxhash64("k", "role", "digest")
    h2 = F.xxhash64(F.lit(0x5EED), "k", "role", "digest")
    # Nulls leave a hash as it is, so that they are told apart by a flag of their own.
    flag = F.col("role").isNull().cast("int") + 2 * F.col("digest").isNull().cast("int")
    h1, h2 = F.xxhash64(h1, flag), F.xxhash64(h2, flag)
    low = F.lit(0xFFFFFFFF)
    parts = [h1.bitwiseAND(low), F.shiftrightunsigned(h1, 32)]
    parts += [h2.bitwiseAND(low), F.shiftrightunsigned(h2, 32)]
    w = Window.partitionBy("cid").orderBy("k")
    running = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return numbered.select(
        "cid",
        "k",
        F.lead("k").over(w).isNull().alias("last"),
        *[F.sum(part).over(running).alias(f"p{i}") for i, part in enumerate(parts, 1)],
    )


def maximal(turns: DataFrame) -> DataFrame:
    """Conversations that are no prefix of a longer one: cid, n_turns, n_equal."""
    found = prefixes(turns)
    key = ["k", "p1", "p2", "p3", "p4"]
    whole = (
        found.filter("last")
        .groupBy(*key)
        .agg(
            F.min(F.struct(F.col("cid").isNotNull().alias("known"), "cid")).alias("first"),
            F.count("*").alias("n_equal"),
        )
    )
    part = found.filter("not last").select(*key).distinct()
    return whole.join(part, key, "left_anti").select(
        F.col("first.cid").alias("cid"), F.col("k").alias("n_turns"), "n_equal"
    )


def _safe(text):
    return F.replace(text, F.lit("<|"), F.lit("<\\|"))


def render_maximal(turns: DataFrame) -> DataFrame:
    """A row per maximal conversation: conv_id, n_turns, n_equal and the rendered text."""
    kept = maximal(turns)
    body = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("body")
    mine = turns.select("conv_id", "turn", "role", "text")
    mine = mine.join(
        kept.select(F.col("cid").alias("kept")), F.col("conv_id").eqNullSafe(F.col("kept")), "left_semi"
    )
    numbered = _numbered(mine, body)
    turn = F.concat(
        F.lit(OPEN),
        _safe(F.coalesce("role", F.lit("unknown"))),
        F.lit("\n"),
        _safe(F.col("body")),
        F.lit(CLOSE + "\n"),
    )
    texts = (
        numbered.select("cid", "k", turn.alias("line"))
        .groupBy("cid")
        .agg(F.sort_array(F.collect_list(F.struct("k", "line"))).alias("turns"))
        .select(F.col("cid").alias("conv_id"), F.array_join("turns.line", "").alias("rendered"))
    )
    return texts.join(kept, F.col("conv_id").eqNullSafe(F.col("cid"))).select(
        "conv_id", "n_turns", "n_equal", "rendered"
    )
