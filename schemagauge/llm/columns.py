"""Columns that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The white space that bounds words, and the letters whose case is folded.
SPACES = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def lines_of(text: Column) -> Column:
    """The lines of a text; an empty one has one empty line."""
    return F.split(text, "\n", -1)


def lines_between(lines: Column, gone: Column) -> Column:
    """The lines that are left without those at the sorted positions ``gone``."""

    def between(i):
        start = F.when(i == 0, 0).otherwise(F.get(gone, i - 1) + 1)
        end = F.when(i == F.size(gone), F.size(lines)).otherwise(F.get(gone, i))
        return F.slice(lines, start + 1, end - start)

    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(gone)), between))


def fold(text: Column) -> Column:
    """A-Z to lower case; no other letter changes."""
    return F.translate(text, UPPER, LOWER)


def hash128(*columns: Column) -> list[Column]:
    """Two independent 64-bit hashes of some columns, named ``h1`` and ``h2``."""
    return [
        F.xxhash64(*columns).alias("h1"),
        F.xxhash64(F.lit(0x5EED), *columns).alias("h2"),
    ]


def row_key(id_column: str, text_column: str) -> list[Column]:
    """``rid`` and ``rhash``: they tell rows apart, but for rows that agree in id and text."""
    return [F.col(id_column).alias("rid"), F.xxhash64(text_or_empty(text_column)).alias("rhash")]


def same_row(a, b) -> Column:
    return a["rid"].eqNullSafe(b["rid"]) & (a["rhash"] == b["rhash"])
