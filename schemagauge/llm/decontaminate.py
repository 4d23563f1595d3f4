"""Benchmark items inside documents, by MinHash containment search in partitions of size.

Short items lie in long documents, so their similarity as sets is tiny and only their
containment counts: the share of an item's distinct five-word shingles that a document
has. Documents are partitioned by the size of their shingle sets, and a set of up to n
members is sketched by the minima of 16 n buckets, which the leading bits of a shingle's
hash pick (one-permutation hashing). The larger a document, the more minima it has, so
a shared shingle is a minimum of both sides nine times in ten and more, whatever the size.
Items are sketched once for all partitions: of a shingle it is enough to know how many
leading bits it shares with the next smaller one.

An item and a document are candidates if a bucket has the same minimum in both. The
smallest items, of fewer than 8 shingles, have too few chances, so all their shingles are
taken for minima. Candidates are verified by the exact containment of the full sets:
at least ``percent`` of the item's shingles.

A filter of fixed size, 2**24 bits set by the items' shingles, is sent to all tasks and
leaves few shingles of documents; it grows with neither table. Texts are read once and never shuffled.

* A null or empty text or item has no shingles and is in no pair.
* Items or texts of fewer than five words are one shingle.
* Rows of equal id are one document, or one item of the union of their shingles.
* Rows without an id are in no pair.
* Extra columns, whatever their names, are ignored. Empty tables give an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from schemagauge.llm.columns import text_or_empty
from schemagauge.llm.kernels import U64, Words, shingle_sets, slices
from schemagauge.llm.storage import stored

FILTER_BITS = 24
SPARE_BITS = 4
FEW = 8


def shared_bits(values: np.ndarray) -> np.ndarray:
    """Leading bits that each of some sorted hashes shares with the one before, -1 for the first."""
    out = np.full(len(values), -1, np.int64)
    if len(values) > 1:
        differ = values[1:] ^ values[:-1]
        top = np.zeros(len(differ), np.int64)
        for step in (32, 16, 8, 4, 2, 1):
            high = (differ >> U64(step)) > 0
            top[high] += step
            differ = np.where(high, differ >> U64(step), differ)
        out[1:] = 63 - top
    return out


def partition_bits(n: int) -> int:
    """The bits that pick a bucket for sets of the size class of ``n``."""
    return int(n).bit_length() + SPARE_BITS


def _of_items(batches, k):
    for batch in batches:
        for first, texts in slices(batch, "body"):
            sets = shingle_sets(Words(texts), k)
            ids = np.repeat(np.arange(len(texts)), [len(s) for s in sets])
            if not len(ids):
                continue
            yield pa.RecordBatch.from_arrays(
                [
                    batch.slice(first, len(texts)).column("item").take(pa.array(ids)),
                    pa.array(np.concatenate(sets).view(np.int64)),
                ],
                names=["item", "h"],
            )


def item_shingles(items: DataFrame, k: int, id_column: str, text_column: str) -> DataFrame:
    """A row per item and shingle: item, h, n_item and ``bits`` shared with the one before."""
    texts = items.select(
        F.col(id_column).cast("long").alias("item"), text_or_empty(text_column).alias("body")
    ).filter(F.col("item").isNotNull())
    raw = texts.mapInArrow(lambda x: _of_items(x, k), "item long, h long").distinct()
    sets = raw.groupBy("item").agg(F.array_sort(F.collect_list(F.struct(_unsigned(F.col("h")), "h"))).alias("all"))
    # An item is a short text, so its shingles are one short array.
    now = F.col("all")
    beside = F.transform(
        now, lambda x, i: F.struct(x["h"].alias("h"), F.get(now, i - 1)["h"].alias("before"))
    )
    return sets.select("item", F.size(now).alias("n_item"), F.inline(beside)).select(
        "item",
        "n_item",
        "h",
        F.when(F.col("before").isNull() | (F.col("n_item") < FEW), -1)
        .otherwise(64 - F.length(F.bin(F.col("h").bitwiseXOR(F.col("before")))))
        .alias("bits"),
    )


def _unsigned(h):
    """Orders 64-bit hashes as numbers without sign."""
    return h.bitwiseXOR(F.lit(-(1 << 63)))


def _of_documents(batches, k, sent):
    present = np.frombuffer(sent.value, np.uint8)
    for batch in batches:
        for first, texts in slices(batch, "body"):
            keep, found, minimum, offsets = [], [], [], [0]
            for i, s in enumerate(shingle_sets(Words(texts), k)):
                low = (s & U64((1 << FILTER_BITS) - 1)).astype(np.int64)
                hit = (present[low >> 3] >> (low & 7).astype(np.uint8)) & 1 > 0
                if hit.any():
                    keep.append(first + i)
                    found.append(s[hit])
                    minimum.append((shared_bits(s) < partition_bits(len(s)))[hit])
                    offsets.append(offsets[-1] + len(found[-1]))
                    bits = partition_bits(len(s))
                    minimum[-1] = np.where(minimum[-1], bits, -bits)
            if keep:
                pairs = pa.StructArray.from_arrays(
                    [pa.array(np.concatenate(found).view(np.int64)), pa.array(np.concatenate(minimum))],
                    names=["h", "bits"],
                )
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc").take(pa.array(keep)), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pairs)],
                    names=["doc", "hits"],
                )


def _filter(shingles: DataFrame) -> bytes:
    """The bits of all shingles: at most 2**18 words, whatever the number of items."""
    low = F.col("h").bitwiseAND((1 << FILTER_BITS) - 1)
    bit = F.expr("shiftleft(1L, cast(h & 63 as int))")
    words = shingles.select(F.shiftright(low, 6).alias("word"), bit.alias("bit"))
    words = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    table = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    table[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return table.astype("<i8").tobytes()


def contained_items(
    docs: DataFrame,
    items: DataFrame,
    k: int = 5,
    percent: int = 75,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text_column: str = "text",
) -> DataFrame:
    """A row per document and item that it contains: doc_id, item_id, n_item, n_common."""
    shingles = stored(item_shingles(items, k, item_column, item_text_column), "items")
    sent = docs.sparkSession.sparkContext.broadcast(_filter(shingles))
    texts = docs.select(
        F.col(id_column).cast("long").alias("doc"), text_or_empty(text_column).alias("body")
    ).filter(F.col("doc").isNotNull())
    hits = texts.mapInArrow(
        lambda x: _of_documents(x, k, sent), "doc long, hits array<struct<h:long,bits:long>>"
    )
    hits = stored(hits.select("doc", F.inline("hits")).distinct(), "hits")
    # Negative bits mark a shingle that is no minimum of its document.
    minimum = (hits["bits"] > shingles["bits"]) | (F.col("n_item") < FEW)
    candidates = (
        hits.join(shingles, "h").filter(minimum).select("doc", "item").distinct()
    )
    mine = candidates.join(hits.select("doc", "h").distinct(), "doc")
    counted = mine.join(shingles.select("item", "h", "n_item"), ["item", "h"])
    counted = counted.groupBy("doc", "item", "n_item").agg(F.count("*").alias("n_common"))
    return counted.filter(100 * F.col("n_common") >= percent * F.col("n_item")).select(
        F.col("doc").alias("doc_id"),
        F.col("item").alias("item_id"),
        F.col("n_item").cast("long").alias("n_item"),
        "n_common",
    )
