"""Documents packed into sequences of limited length by best-two-fit.

A document is its token ids and one end id. Only documents longer than a sequence are
cut, into pieces of full length and a last one. A sequence is filled greedily, with
the longest piece that fits, again and again; then its smallest piece is replaced by the
two unpacked pieces which together fill its place and the gap more tightly, if there are any.

Only lengths matter to that, so what is dealt out are short rows, by hash, into shards
of some 50,000 documents: enough for nearly no loss, and of the same size at any scale. A
shard wastes less than one sequence. Texts are tokenized where they are read.

* A null or empty text is the end id alone. An empty table gives an empty table.
* Rows that agree in id and text are packed one by one. A null id is an id.
* Extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from schemagauge.llm.columns import row_key, text_or_empty
from schemagauge.llm.kernels import slices
from schemagauge.llm.tokens import default_path, encoder

CAPACITY = 2048
SHARD = 50_000
END = 0

_PIECES = "rid long, rhash long, piece int, start long, length long, ids binary"


def _cut(batches, path, capacity, end):
    full, last = 4 * capacity, np.array([end], "<u4").tobytes()
    for batch in batches:
        for first, texts in slices(batch, "body"):
            rows, pieces, ids = [], [], []
            for i, found in enumerate(encoder(path).encode(texts)):
                found += last
                for n, at in enumerate(range(0, len(found), full)):
                    rows.append(first + i)
                    pieces.append(n)
                    ids.append(found[at : at + full])
            at = pa.array(rows, pa.int32())
            number = np.array(pieces, np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("rid").take(at),
                    batch.column("rhash").take(at),
                    pa.array(number),
                    pa.array(number.astype(np.int64) * capacity),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array(ids, pa.binary()),
                ],
                names=["rid", "rhash", "piece", "start", "length", "ids"],
            )


def pieces(
    docs: DataFrame,
    capacity: int = CAPACITY,
    end: int = END,
    path: str | None = None,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """A row per piece: rid, rhash, piece, start, length and its ids, little-endian 32-bit."""
    path = path or default_path()
    texts = docs.select(*row_key(id_column, text_column), text_or_empty(text_column).alias("body"))
    texts = texts.withColumn("rid", F.col("rid").cast("long"))
    return texts.mapInArrow(lambda x: _cut(x, path, capacity, end), _PIECES)


def best_two_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The sequence of each piece and its offset there. Lengths are from 1 to the capacity.

    The lengths left are the bits of two numbers, upwards and downwards, so that the
    longest piece that fits and the best pair are found by shifts.
    """
    order = np.argsort(lengths, kind="stable")
    left = np.bincount(lengths, minlength=capacity + 1).tolist()
    top = np.cumsum(left).tolist()  # pieces of a length are taken from the end of its run
    up = down = 0
    for size in range(1, capacity + 1):
        if left[size]:
            up |= 1 << size
            down |= 1 << (capacity - size)
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    order, current = order.tolist(), 0

    def take(size):
        nonlocal up, down
        left[size] -= 1
        if not left[size]:
            up ^= 1 << size
            down ^= 1 << (capacity - size)

    def pair(room, least):
        """The two lengths left with the largest sum up to ``room`` and over ``least``."""
        for total in range(room, least, -1):
            fit = up & (down >> (capacity - total)) & ((1 << total) - 1)
            while fit:
                longer = fit.bit_length() - 1
                if 2 * longer != total or left[longer] > 1:
                    return longer, total - longer
                fit ^= 1 << longer
        return None

    while up:
        chosen, gap = [], capacity
        while gap and (fit := up & ((2 << gap) - 1)):
            chosen.append(fit.bit_length() - 1)
            take(chosen[-1])
            gap -= chosen[-1]
        if gap and up and (two := pair(gap + chosen[-1], chosen[-1])):
            back = chosen.pop()
            for size in two:
                take(size)
            chosen += two
            left[back] += 1
            up |= 1 << back
            down |= 1 << (capacity - back)
        at = 0
        for size in chosen:
            top[size] -= 1
            item = order[top[size]]
            sequence[item], offset[item] = current, at
            at += size
        current += 1
    return sequence, offset


def _packed(batches, capacity):
    rows = [b for b in batches if b.num_rows]
    if rows:
        table = pa.Table.from_batches(rows).combine_chunks()
        sequence, offset = best_two_fit(table.column("length").to_numpy(), capacity)
        sequence += TaskContext.get().partitionId() << 32
        table = table.append_column("sequence_id", pa.array(sequence))
        yield from table.append_column("offset", pa.array(offset)).to_batches()


def pack(rows: DataFrame, n_docs: int, capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """``rows`` with ``sequence_id`` and ``offset``.

    They hold rid, rhash, piece, length, and what else should be carried along; a shard of
    them is kept in a task's memory. ``n_docs`` sets the number of shards.
    """
    shards = max(1, -(-n_docs // shard))
    key = ["rid", "rhash", "piece"]
    dealt = rows.repartition(shards, F.xxhash64(*key)).sortWithinPartitions(*key)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return dealt.mapInArrow(
        lambda x: _packed(x, capacity), f"{fields}, sequence_id long, offset long"
    )


def sequences(placed: DataFrame) -> DataFrame:
    """The ids of each sequence, little-endian 32-bit, from placed rows that carry ``ids``."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(F.col("parts"), F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    return placed.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id", F.size("parts").alias("n_pieces"), joined.alias("ids")
    )
