"""Lines that many documents share are dropped from all but one of them.

The lines of all documents are exploded, normalised and hashed to 128 bits. Distinct
documents are counted per hash, with partial sums before the shuffle; only the few
hashes that reach the limit are looked at again. Lines to be dropped are gathered by
their positions, a short array per document, and each text is put together from the
slices between them.

A line's key is the line without the white space at both ends, A-Z in lower case. A key
counts if it has ``min_chars`` code points, and goes if ``min_docs`` documents hold it;
then the document with the largest id keeps its lines, all others lose them.

* A null or empty text is one empty line. An empty table gives an empty table.
* A document is an id: rows of equal id count once. A null id is an id below all others.
* Rows that agree in id and text get the same answer, and each comes back.
* Extra columns, whatever their names, come back as they were.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from schemagauge.llm.columns import (
    SPACES,
    fold,
    hash128,
    lines_of,
    row_key,
    same_row,
    text_or_empty,
)
from schemagauge.llm.storage import stored


def _long_lines(docs: DataFrame, id_column: str, text_column: str, min_chars: int) -> DataFrame:
    """A row per line whose key is long enough: rid, rhash, pos and the hash of the key."""
    lines = docs.select(
        *row_key(id_column, text_column),
        F.posexplode(lines_of(text_or_empty(text_column))).alias("pos", "line"),
    )
    # Bytes are counted first: they are no fewer than code points, and cheaper.
    bare = lines.filter(F.octet_length("line") >= min_chars).withColumn(
        "line", F.btrim("line", F.lit(SPACES))
    )
    return bare.filter(F.char_length("line") >= min_chars).select(
        "rid", "rhash", "pos", *hash128(fold(F.col("line")))
    )


def shared_lines(
    docs: DataFrame,
    min_docs: int = 5,
    min_chars: int = 40,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """The lines to be dropped: rid, rhash and the sorted positions ``gone``."""
    lines = _long_lines(docs, id_column, text_column, min_chars)
    often = lines.groupBy("h1", "h2").agg(F.count("*").alias("n")).filter(F.col("n") >= min_docs)
    found = stored(lines.join(often.select("h1", "h2"), ["h1", "h2"]), "lines")
    holders = found.select("h1", "h2", "rid").distinct()
    limits = (
        holders.groupBy("h1", "h2")
        .agg(F.count("*").alias("n"), F.max("rid").alias("keeper"))
        .filter(F.col("n") >= min_docs)
        .select("h1", "h2", "keeper")
    )
    gone = found.join(limits, ["h1", "h2"]).filter(~F.col("rid").eqNullSafe(F.col("keeper")))
    return gone.groupBy("rid", "rhash").agg(F.sort_array(F.collect_set("pos")).alias("gone"))


def drop_shared_lines(
    docs: DataFrame,
    min_docs: int = 5,
    min_chars: int = 40,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """All rows as ``row``, a struct of the columns given, with ``n_lines``, ``n_dropped``, ``kept``."""
    gone = shared_lines(docs, min_docs, min_chars, id_column, text_column)
    rows = docs.select(
        F.struct("*").alias("row"),
        text_or_empty(text_column).alias("body"),
        *row_key(id_column, text_column),
    )
    joined = rows.join(gone, same_row(rows, gone), "left").select(
        "row", "body", "gone", lines_of(F.col("body")).alias("lines")
    )
    n_gone = F.coalesce(F.size("gone"), F.lit(0))

    def between(i):
        start = F.when(i == 0, 0).otherwise(F.get("gone", i - 1) + 1)
        end = F.when(i == F.size("gone"), F.size("lines")).otherwise(F.get("gone", i))
        return F.slice("lines", start + 1, end - start)

    slices = F.transform(F.sequence(F.lit(0), F.size("gone")), between)
    return joined.select(
        "row",
        F.size("lines").cast("bigint").alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(n_gone).cast("bigint").alias("n_dropped"),
        F.when(F.col("gone").isNull(), F.col("body"))
        .otherwise(F.array_join(F.flatten(slices), "\n"))
        .alias("kept"),
    )
