"""Quality rules: measures of a text, and lines that a host repeats on its pages.

Each text is measured in one pass. For the verdict its lines are normalised (words in
lower case, single spaces) and hashed; distinct documents are counted per host and line.
A line of more than ``max_docs`` documents of a host and more than ``max_share`` of them
is removed from all but the document with the smallest id, so content that was only
copied keeps one whole copy. A document that loses more than half of its words that way
is rejected, and so is one that breaks a base rule: fewer than 50 words, or more than
half of the words in three-word windows that occur twice or more. The positions of removed
lines are given with the verdict, and ``text_left`` is the text without them.

Counts are summed before each shuffle; only lines that reach the limit are looked up again,
and a line that very many documents hold is dealt over tasks for that.

* A null or empty text has no words, so it is rejected. A null host is a host of its own.
* Rows of equal id count as one document. Rows that agree get the same answer.
* Extra columns, whatever their names, are ignored. An empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from schemagauge.llm.columns import lines_between, lines_of, row_key, text_or_empty
from schemagauge.llm.joins import join_unique
from schemagauge.llm.kernels import GOLDEN, U64, Words, mix, slices, span_hashes, windows
from schemagauge.llm.storage import stored

#: The characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
_SYMBOL = np.zeros(256, np.uint8)
_SYMBOL[list(SYMBOLS)] = 1

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_MEASURED = (
    "rid long, rhash long, host string, "
    + ", ".join(f"{m} long" for m in MEASURES)
    + ", lines array<struct<line:long,n:long,at:array<int>>>"
)


def _own(hashes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Hashes that differ between texts."""
    return mix(hashes ^ (owner.astype(U64) * U64(GOLDEN)))


def _repeated(words: Words, owner: np.ndarray, n_texts: int) -> np.ndarray:
    """Words of each text that lie in three-word windows found there twice or more."""
    every = windows(words.hashes, 3)
    if not len(every):
        return np.zeros(n_texts, np.int64)
    inside = np.flatnonzero(owner[:-2] == owner[2:])
    values = _own(every[inside], owner[inside])
    order = np.argsort(values)
    ranked = values[order]
    same = ranked[1:] == ranked[:-1]
    twice = np.zeros(len(values), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(words.hashes), bool)
    for i in range(3):
        covered[inside[twice] + i] = True
    return np.bincount(owner[covered], minlength=n_texts)


def measure(texts: list[bytes]) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Measures by name; and the distinct normalised lines: their text, hash and number of words.

    The last is where they are: bounds of each line among positions, numbers of lines of the text.
    """
    plain, words = Words(texts, fold=False), Words(texts)
    n, raw = len(texts), words.raw
    owner = np.repeat(np.arange(n), np.diff(words.bounds))
    code_points = (words.space == 0) & ((raw & 0xC0) != 0x80)
    of_text = lambda flags: np.add.reduceat(flags, words.offsets[:-1], dtype=np.int64)
    out = {
        "n_words": np.diff(words.bounds),
        "word_chars": of_text(code_points.view(np.uint8)),
        "n_symbols": of_text(_SYMBOL[raw]),
        "n_repeat_words": _repeated(plain, owner, n),
    }
    line_ends = np.flatnonzero(raw == 10)
    line_starts = np.concatenate(([0], line_ends[:-1] + 1))
    first, last = np.searchsorted(words.starts, line_starts), np.searchsorted(words.starts, line_ends)
    full = last > first
    of_line = words.owners(line_starts)
    place = np.arange(len(line_starts)) - np.searchsorted(line_starts, words.offsets[:-1])[of_line]
    line_starts, line_ends, first, last, of_line, place = (
        x[full] for x in (line_starts, line_ends, first, last, of_line, place)
    )
    exact = _own(span_hashes(raw, line_starts, line_ends), of_line)
    _, chosen = np.unique(exact, return_index=True)
    out["n_dup_lines"] = np.bincount(of_line, minlength=n) - np.bincount(of_line[chosen], minlength=n)
    keys = span_hashes(words.hashes, first, last)
    order = np.lexsort((keys, of_line))
    keys, of_line, sizes, place = keys[order], of_line[order], (last - first)[order], place[order]
    if len(keys):
        fresh = np.concatenate(([True], (keys[1:] != keys[:-1]) | (of_line[1:] != of_line[:-1])))
        at = np.flatnonzero(fresh)
        return out, of_line[at], keys[at], np.add.reduceat(sizes, at), [np.append(at, len(keys)), place]
    return out, of_line, keys, sizes, [np.zeros(1, np.int64), place]


def _measured(batches):
    for batch in batches:
        for start, texts in slices(batch, "body"):
            found, of_line, keys, sizes, places = measure(texts)
            rows = batch.slice(start, len(texts))
            offsets = np.searchsorted(of_line, np.arange(len(texts) + 1)).astype(np.int32)
            at = pa.ListArray.from_arrays(*[pa.array(x.astype(np.int32)) for x in places])
            lines = pa.StructArray.from_arrays(
                [pa.array(keys.view(np.int64)), pa.array(sizes.astype(np.int64)), at], names=["line", "n", "at"]
            )
            yield pa.RecordBatch.from_arrays(
                [
                    *[rows.column(c) for c in ("rid", "rhash", "host")],
                    *[pa.array(found[m].astype(np.int64)) for m in MEASURES],
                    pa.ListArray.from_arrays(offsets, lines),
                ],
                names=["rid", "rhash", "host", *MEASURES, "lines"],
            )


def measured(docs: DataFrame, id_column: str, text_column: str, host_column: str) -> DataFrame:
    rows = docs.select(
        *row_key(id_column, text_column),
        F.col(host_column).cast("string").alias("host"),
        text_or_empty(text_column).alias("body"),
    )
    return rows.withColumn("rid", F.col("rid").cast("long")).mapInArrow(_measured, _MEASURED)


def verdicts(
    docs: DataFrame,
    max_docs: int = 10,
    max_share: float = 0.25,
    least_left: float = 0.5,
    min_words: int = 50,
    max_repeat_percent: int = 50,
    id_column: str = "doc_id",
    text_column: str = "text",
    host_column: str = "source",
) -> DataFrame:
    """A row per row of ``docs``: rid, rhash, host, the measures, n_removed, base_failed, kept, gone.

    ``gone`` are the sorted positions of removed lines, or null.
    """
    found = stored(measured(docs, id_column, text_column, host_column), "measured")
    host = F.coalesce(F.concat(F.lit("="), "host"), F.lit(""))  # a null host is one, too
    rows = found.withColumn("host_key", F.xxhash64(host))
    lines = rows.select("rid", "rhash", "host_key", F.inline("lines"))
    key = ["host_key", "line"]
    often = lines.groupBy(*key).agg(F.count("*").alias("docs")).filter(F.col("docs") > max_docs)
    spread = F.struct("rid", "rhash")
    hits = stored(join_unique(lines, often.select(*key), key, spread), "common")
    held = (
        hits.select(*key, "rid")
        .distinct()
        .groupBy(*key)
        .agg(F.count("*").alias("docs"), F.min("rid").alias("keeper"))
        .filter(F.col("docs") > max_docs)
    )
    sizes = rows.select("host_key", "rid").distinct().groupBy("host_key").agg(F.count("*").alias("host_docs"))
    limits = (
        join_unique(stored(held, "held"), sizes, ["host_key"], F.col("line"))
        .filter(F.col("docs") > max_share * F.col("host_docs"))
        .select(*key, "keeper")
    )
    removed = join_unique(hits, limits, key, spread).filter(~F.col("rid").eqNullSafe(F.col("keeper")))
    # Rows that agree are one row here, so that their lines count once.
    removed = removed.groupBy("rid", "rhash", *key).agg(F.first("n").alias("n"), F.first("at").alias("at"))
    removed = removed.groupBy("rid", "rhash", "host_key").agg(
        F.sum("n").alias("n_removed"), F.sort_array(F.flatten(F.collect_list("at"))).alias("gone")
    )
    same = (
        F.col("rid").eqNullSafe(F.col("xid"))
        & (F.col("rhash") == F.col("xhash"))
        & (F.col("host_key") == F.col("xkey"))
    )
    removed = removed.select(
        F.col("rid").alias("xid"), F.col("rhash").alias("xhash"), F.col("host_key").alias("xkey"), "n_removed", "gone"
    )
    failed = (F.col("n_words") < min_words) | (
        100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words")
    )
    n_removed = F.coalesce("n_removed", F.lit(0))
    return rows.drop("lines").join(removed, same, "left").select(
        "rid",
        "rhash",
        "host",
        *MEASURES,
        n_removed.alias("n_removed"),
        failed.alias("base_failed"),
        (~failed & (F.col("n_words") - n_removed >= least_left * F.col("n_words"))).alias("kept"),
        "gone",
    )


def text_left(text: Column, gone: Column) -> Column:
    """A text without the lines at the sorted positions ``gone``; null takes none."""
    lines = lines_of(text)
    return F.when(gone.isNull(), text).otherwise(F.array_join(lines_between(lines, gone), "\n"))
