"""Token ids in files: blocks of fixed size, transposed into planes, each compressed.

Documents are dealt out in ranges of their ids, so the order of files and of rows in
them is the order of ids. A file holds chunks of whole documents. The ids of a chunk are
cut into blocks of fixed size; a block becomes four byte planes (or 32 bit planes), and
each plane is compressed by zstandard: high planes, nearly all zero, take no space.
A chunk is a Parquet row, which any of Spark's file systems takes:

    shard, chunk        its place; shards are in order of ids
    start               ids of the shard before it
    n_ids               its ids
    docs                (doc_id, n) of its documents, in order
    planes              the compressed planes, one after another
    sizes               the size of each compressed plane, by block and plane

The chunk index beside it has all but docs and planes. Written files hold no id of a
document's place in the corpus: places are sums over the shards before.

* A null or empty text is the end id alone. An empty table gives files without chunks.
* Rows of equal id follow each other in order of a hash of their texts; a null id comes first.
* Extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from schemagauge.llm.columns import row_key, text_or_empty
from schemagauge.llm.kernels import slices
from schemagauge.llm.tokens import default_path, encoder

BLOCK = 16_384
CHUNK = 262_144
END = 1
LEVEL = 3

_CHUNK = (
    "shard int, chunk int, start long, n_ids long, docs array<struct<doc_id:long,n:long>>, "
    "planes binary, sizes array<int>, bit_planes boolean, block int"
)


def to_planes(ids: np.ndarray, bits: bool) -> list[bytes]:
    """The planes of a block of 32-bit ids: 4 of bytes or 32 of bits, lowest first."""
    rows = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if not bits:
        return [rows[:, i].tobytes() for i in range(4)]
    flags = np.unpackbits(rows, axis=1, bitorder="little")
    return [np.packbits(flags[:, i]).tobytes() for i in range(32)]


def from_planes(planes: list[bytes], n: int, bits: bool) -> np.ndarray:
    if not bits:
        rows = np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1)
    else:
        flags = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n) for p in planes], axis=1)
        rows = np.packbits(flags, axis=1, bitorder="little")
    return np.ascontiguousarray(rows).view("<u4").reshape(-1)


def pack_chunk(ids: np.ndarray, bits: bool, block: int, level: int) -> tuple[bytes, list[int]]:
    squeeze = zstandard.ZstdCompressor(level=level).compress
    out = [
        squeeze(plane)
        for at in range(0, len(ids), block)
        for plane in to_planes(ids[at : at + block], bits)
    ]
    return b"".join(out), [len(x) for x in out]


def unpack_chunk(planes: bytes, sizes: list[int], n_ids: int, bits: bool, block: int) -> np.ndarray:
    expand = zstandard.ZstdDecompressor().decompress
    ends = list(accumulate(sizes))
    parts = [expand(planes[e - s : e]) for s, e in zip(sizes, ends)]
    per = 32 if bits else 4
    blocks = [
        from_planes(parts[i * per : (i + 1) * per], min(block, n_ids - i * block), bits)
        for i in range(len(parts) // per)
    ]
    return np.concatenate(blocks) if blocks else np.empty(0, "<u4")


def _chunks(batches, path, end, bits, block, chunk, level):
    last = np.array([end], "<u4").tobytes()
    shard = TaskContext.get().partitionId()
    number = start = n = 0
    docs, parts = [], []

    def close():
        planes, sizes = pack_chunk(np.frombuffer(b"".join(parts), "<u4"), bits, block, level)
        row = {
            "shard": shard, "chunk": number, "start": start, "n_ids": n, "docs": docs,
            "planes": planes, "sizes": sizes, "bit_planes": bits, "block": block,
        }
        return pa.RecordBatch.from_pylist([row], schema=_SCHEMA)

    for batch in batches:
        for first, texts in slices(batch, "body"):
            ids = batch.column("rid").slice(first, len(texts)).to_pylist()
            for doc, found in zip(ids, encoder(path).encode(texts)):
                parts += [found, last]
                docs.append({"doc_id": doc, "n": len(found) // 4 + 1})
                n += docs[-1]["n"]
                if n >= chunk:
                    yield close()
                    number, start, n, docs, parts = number + 1, start + n, 0, [], []
    if docs:
        yield close()


_SCHEMA = pa.schema(
    [
        ("shard", pa.int32()),
        ("chunk", pa.int32()),
        ("start", pa.int64()),
        ("n_ids", pa.int64()),
        ("docs", pa.list_(pa.struct([("doc_id", pa.int64()), ("n", pa.int64())]))),
        ("planes", pa.binary()),
        ("sizes", pa.list_(pa.int32())),
        ("bit_planes", pa.bool_()),
        ("block", pa.int32()),
    ]
)


def write_tokens(
    docs: DataFrame,
    folder: str,
    shards: int | None = None,
    end: int = END,
    bit_planes: bool = False,
    block: int = BLOCK,
    chunk: int = CHUNK,
    level: int = LEVEL,
    path: str | None = None,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> None:
    """Write the ids of all documents to ``folder``, in order of document ids."""
    spark = docs.sparkSession
    path = path or default_path()
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(*row_key(id_column, text_column), text_or_empty(text_column).alias("body"))
    texts = texts.withColumn("rid", F.col("rid").cast("long"))
    dealt = texts.repartitionByRange(shards, "rid", "rhash").sortWithinPartitions("rid", "rhash")
    chunks = dealt.mapInArrow(lambda x: _chunks(x, path, end, bit_planes, block, chunk, level), _CHUNK)
    chunks.write.parquet(f"{folder}/chunks")
    index = spark.read.parquet(f"{folder}/chunks").drop("docs", "planes")
    index.write.parquet(f"{folder}/index")


def _read(batches):
    for batch in batches:
        for row in batch.to_pylist():
            ids = unpack_chunk(row["planes"], row["sizes"], row["n_ids"], row["bit_planes"], row["block"])
            sizes = np.array([d["n"] for d in row["docs"]], np.int64)
            ends = np.cumsum(sizes)
            raw = ids.tobytes()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([row["shard"]] * len(sizes), pa.int32()),
                    pa.array([d["doc_id"] for d in row["docs"]], pa.int64()),
                    pa.array(row["start"] + ends - sizes),
                    pa.array(sizes),
                    pa.array([raw[4 * (e - s) : 4 * e] for s, e in zip(sizes.tolist(), ends.tolist())], pa.binary()),
                ],
                names=["shard", "doc_id", "within", "n_tokens", "ids"],
            )


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """A row per document: doc_id, start, n_tokens and its ids, little-endian 32-bit."""
    index = spark.read.parquet(f"{folder}/index")
    # One number per shard, and shards are as many as the tasks that wrote them.
    totals = {r.shard: r.n for r in index.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect()}
    order = sorted(totals)
    before = dict(zip(order, accumulate([0, *(totals[s] for s in order)])))
    places = F.array(F.lit(0).cast("long"))
    if order:
        places = F.lit([before.get(s, 0) for s in range(order[-1] + 1)]).cast("array<long>")
    found = spark.read.parquet(f"{folder}/chunks").mapInArrow(
        _read, "shard int, doc_id long, within long, n_tokens long, ids binary"
    )
    return found.select(
        "doc_id", (F.get(places, F.col("shard")) + F.col("within")).alias("start"), "n_tokens", "ids"
    )
