"""Repeated byte strings are cut out, found by suffix arrays.

Every byte covered by a string of ``length`` bytes that also starts elsewhere goes. A
document has a window of that length at each start. Windows are told by their anchor, the
32 bytes in them with the smallest hash: equal windows have equal anchors at the same
place. Neighbouring windows mostly share one, so a document is a list of runs of
windows, about one per 185 bytes; runs whose anchor is the only one of its kind can't repeat.

The others are dealt out by anchor, each with the bytes that its windows cover; equal
stretches travel once per task. Anchors found more than ``HOT`` times are dealt in blocks
of 46 windows, by the bytes that all windows of the block have in common. Equal stretches
of a group are counted before they meet: only distinct ones are gathered, and what is
decided on them is joined back to the places where they occur, in shares.

A stretch that occurs twice or more repeats as a whole, which its 64-bit digest decides.
On all that occur once a suffix array decides, made of the distinct stretches of the group
by two-stage sorting: only suffixes smaller than their successors are sorted directly, the
rest is induced by one scan of the buckets of first bytes. Windows whose common prefix
with a neighbour has the whole length repeat.

* A null or empty text, or one shorter than ``length`` bytes, stays whole.
* Rows of equal text repeat each other, also if they agree in all columns.
* Strings are judged on the input, whatever is cut; matches never cross documents.
* Extra columns, whatever their names, are ignored. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from schemagauge.llm.columns import row_key, same_row, text_or_empty
from schemagauge.llm.kernels import BASE, INVERSE, U64, _power, mix
from schemagauge.llm.storage import stored

LENGTH = 400
GRAM = 32
HOT = 2000
BLOCK = 46
_PLACE = 20
# Starts of windows worked on at once, so that a place fits its bits.
_SPAN = 1 << 19
# Bytes of stretches that are sorted at once; a group is never parted.
BATCH = 2_000_000
_SORTED = 150_000
#: Occurrences of one stretch that one task places.
SHARE = 1000


def runs(text: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: hash of the anchor, first start, how far the anchor is, windows."""
    out = []
    raw = np.frombuffer(text, np.uint8)
    width = length - GRAM + 1
    for low in range(0, len(raw) - length + 1, _SPAN):
        n = min(_SPAN, len(raw) - length + 1 - low)
        part = raw[low : low + n + length - 1].astype(U64) + U64(1)
        sums = np.zeros(len(part) + 1, U64)
        np.cumsum(part * _power(BASE, len(part))[: len(part)], out=sums[1:])
        grams = mix((sums[GRAM:] - sums[:-GRAM]) * _power(INVERSE, len(part))[: len(part) - GRAM + 1])
        # The first of the smallest: the place decides between equal leading bits.
        ranked = (grams >> U64(_PLACE) << U64(_PLACE)) | np.arange(len(grams), dtype=U64)
        size = -(-len(ranked) // width) * width
        padded = np.full(size, np.iinfo(U64).max, U64)
        padded[: len(ranked)] = ranked
        blocks = padded.reshape(-1, width)
        ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
        back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        least = np.minimum(back[:n], ahead[width - 1 : width - 1 + n])
        anchor = (least & U64((1 << _PLACE) - 1)).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
        out.append(
            (grams[anchor[first]], first + low, anchor[first] - first, np.diff(np.append(first, n)))
        )
    if not out:
        return (np.empty(0, U64),) + (np.empty(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*out))


def _runs(batches, length):
    for batch in batches:
        for start in range(0, batch.num_rows, 500):
            part = batch.slice(start, 500)
            found = [runs((x.as_py() or "").encode(), length) for x in part.column("body")]
            sizes = [len(f[0]) for f in found]
            at = pa.array(np.repeat(np.arange(len(found)), sizes))
            anchor, first, far, n = (np.concatenate(x) for x in zip(*found))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("rid").take(at),
                    part.column("rhash").take(at),
                    pa.array(anchor.view(np.int64)),
                    pa.array(first),
                    pa.array(far.astype(np.int32)),
                    pa.array(n.astype(np.int32)),
                ],
                names=["rid", "rhash", "anchor", "first", "far", "n"],
            )


def _digest(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


def _stretches(batches, length):
    """Runs with the bytes that they cover; bytes that the task has sent before are left out."""
    sent = set()
    for batch in batches:
        for start in range(0, batch.num_rows, 100):
            rows = []
            for row in batch.slice(start, 100).to_pylist():
                body = row["body"].encode()
                for run in row["runs"]:
                    first, far, n = run["first"], run["far"], run["n"]
                    at = first + far
                    pieces = [(run["anchor"], first, n)]
                    if run["hot"]:
                        pieces = []
                        for block in range((far - n + 1) // BLOCK, far // BLOCK + 1):
                            high, low = min(far, BLOCK * block + BLOCK - 1), max(far - n + 1, BLOCK * block)
                            common = body[at - BLOCK * block : at - BLOCK * block - BLOCK + 1 + length]
                            key = _digest(b"%d %d " % (run["anchor"], block) + common)
                            pieces.append((key, at - high, high - low + 1))
                    for key, first, n in pieces:
                        stretch = body[first : first + n - 1 + length]
                        known = _digest(stretch)
                        fresh = (key, known) not in sent
                        if fresh:
                            sent.add((key, known))
                        rows.append((row["rid"], row["rhash"], key, known, first, n, stretch if fresh else None))
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(zip(*rows), _STRETCH_TYPES)], names=_STRETCH_NAMES
            )


_STRETCH_NAMES = ["rid", "rhash", "key", "known", "first", "n", "stretch"]
_STRETCH_TYPES = [pa.int64()] * 5 + [pa.int32(), pa.binary()]
_STRETCH = "rid long, rhash long, key long, known long, first long, n int, stretch binary"


def suffix_array(stretches: list[bytes], needed: list[int], length: int) -> tuple[np.ndarray, np.ndarray]:
    """The text of all stretches, each with an end mark below all bytes; and its sorted suffixes.

    Sorted by their first ``length`` bytes are the first ``needed`` suffixes of each stretch
    (and as many more as these are induced from).
    """
    sizes = np.array([len(s) + 1 for s in stretches])
    text = np.full(sizes.sum(), -1, np.int16)
    joined = b"\0".join(stretches) + b"\0"
    ends = np.cumsum(sizes) - 1
    text[:] = np.frombuffer(joined, np.uint8)
    text[ends] = -1
    at = np.arange(len(text))
    # Smaller than the successor: by the next byte that differs.
    step = np.sign(np.diff(text, append=np.int16(300)))
    next_step = np.minimum.accumulate(np.where(step != 0, at, len(text))[::-1])[::-1]
    small = step[next_step] > 0
    # The suffixes in question: up to the first small one after the needed ones.
    starts = ends + 1 - sizes
    next_small = np.minimum.accumulate(np.where(small, at, len(text))[::-1])[::-1]
    last = next_small[starts + np.array(needed) - 1]
    inside = np.zeros(len(text) + 1, np.int32)
    np.add.at(inside, starts, 1)
    np.add.at(inside, last + 1, -1)
    inside = np.cumsum(inside[:-1]) > 0
    end_of = np.repeat(ends, sizes)

    # Directly sorted: by eight bytes at once, then by the rest.
    direct = np.flatnonzero(inside & small)
    key = np.zeros(len(direct), U64)
    for i in range(8):
        here = np.minimum(direct + i, end_of[direct])
        key = (key << U64(8)) | np.maximum(text[here], 0).astype(U64)
    order = np.argsort(key, kind="stable")
    direct, key = direct[order], key[order]
    cuts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    parts, begin = [], 0
    for cut in [*cuts[np.searchsorted(cuts, range(_SORTED, len(direct), _SORTED)).clip(max=len(cuts) - 1)].tolist(), len(direct)]:
        if cut > begin:
            some = direct[begin:cut].tolist()
            stop = np.minimum(direct[begin:cut] + length, end_of[direct[begin:cut]]).tolist()
            keys = [joined[i:j] for i, j in zip(some, stop)]
            parts.append(direct[begin:cut][sorted(range(len(some)), key=keys.__getitem__)])
            begin = cut
    direct = np.concatenate(parts) if parts else direct

    # Induced: each bucket in turn hands on the suffixes one byte longer, in its own order.
    large = inside & ~small
    first_byte = text[direct]
    bounds = np.searchsorted(first_byte, np.arange(-1, 257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(257)]
    sorted_parts = []
    for c in range(-1, 256):
        mine = [np.concatenate(waiting[c + 1])] if waiting[c + 1] else []
        while mine and len(mine[-1]):
            before = mine[-1] - 1
            before = before[(before >= 0) & large[before] & (text[before] == c)]
            mine.append(before)
        bucket = np.concatenate([*mine, direct[bounds[c + 1] : bounds[c + 2]]])
        sorted_parts.append(bucket)
        before = bucket - 1
        before = before[before >= 0]
        before = before[large[before] & (text[before] > c)]
        target = text[before]
        order = np.argsort(target, kind="stable")
        before, target = before[order], target[order]
        found, cut = np.unique(target, return_index=True)
        for value, some in zip(found.tolist(), np.split(before, cut[1:])):
            waiting[value + 1].append(some)
    return text, np.concatenate(sorted_parts)


def common_prefixes(text: np.ndarray, left: np.ndarray, right: np.ndarray, length: int) -> np.ndarray:
    """Whether pairs of suffixes agree in their first ``length`` bytes, eight at a time."""
    padded = np.concatenate((np.maximum(text, 0), np.zeros(8, np.int16))).astype(U64)
    words = padded[: len(text)].copy()
    for i in range(1, 8):
        words |= padded[i : i + len(text)] << U64(8 * i)
    same = np.arange(len(left))
    for i in [*range(0, length - 8, 8), length - 8]:
        same = same[words[left[same] + i] == words[right[same] + i]]
    out = np.zeros(len(left), bool)
    out[same] = True
    return out


def repeated_windows(stretches: list[bytes], windows: list[int], length: int) -> list[np.ndarray]:
    """Of each stretch, which of its windows is equal to another one of any stretch."""
    text, array = suffix_array(stretches, windows, length)
    sizes = np.array([len(s) + 1 for s in stretches])
    starts = np.cumsum(sizes) - sizes
    is_window = np.zeros(len(text), bool)
    for start, n in zip(starts.tolist(), windows):
        is_window[start : start + n] = True
    array = array[is_window[array]]
    equal = common_prefixes(text, array[:-1], array[1:], length)
    twice = np.zeros(len(text), bool)
    twice[array[:-1][equal]] = True
    twice[array[1:][equal]] = True
    return [twice[start : start + n] for start, n in zip(starts.tolist(), windows)]


def _spans(flags: np.ndarray, length: int) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(flags.astype(np.int8), prepend=0, append=0))
    return [(int(a), int(b) - 1 + length) for a, b in zip(edge[::2], edge[1::2])]


def _decided(groups, length):
    """Covered parts of the distinct stretches of some whole groups: key, known, start, stop."""
    stretches, out = [], []
    for group in groups:
        for key, known, times, stretch in group:
            if times > 1:
                out.append((key, known, 0, len(stretch)))
        if len(group) > 1:
            stretches += group
    if stretches:
        texts = [x[3] for x in stretches]
        found = repeated_windows(texts, [len(t) - length + 1 for t in texts], length)
        for flags, (key, known, times, _) in zip(found, stretches):
            if times == 1:
                out += [(key, known, a, b) for a, b in _spans(flags, length)]
    return pa.RecordBatch.from_arrays(
        [pa.array(x, pa.int64()) for x in (zip(*out) if out else [[]] * 4)], names=["key", "known", "start", "stop"]
    )


def _covered(batches, length):
    groups, group, size = [], [], 0
    for batch in batches:
        for row in zip(*[batch.column(c).to_pylist() for c in ("key", "known", "times", "stretch")]):
            if group and row[0] != group[0][0]:
                groups.append(group)
                group = []
                if size >= BATCH:
                    yield _decided(groups, length)
                    groups, size = [], 0
            group.append(row)
            size += len(row[3])
    if group:
        groups.append(group)
    yield _decided(groups, length)


def _placed(dealt: DataFrame, decided: DataFrame, distinct: DataFrame) -> DataFrame:
    """The covered parts of stretches at all places where they occur: rid, rhash, start, stop.

    A stretch that occurs more than ``SHARE`` times is dealt to a task for each so many.
    """
    key = ["key", "known"]
    # One row per SHARE occurrences at most, so few that they can be sent to all tasks.
    often = F.broadcast(
        distinct.filter(F.col("times") > SHARE).select(*key, F.ceil(F.col("times") / SHARE).alias("salts"))
    )
    salts = F.coalesce("salts", F.lit(1).cast("long"))
    places = dealt.select("rid", "rhash", *key, "first").join(often, key, "left")
    places = places.withColumn("salt", F.pmod(F.xxhash64("rid", "rhash", "first"), salts)).drop("salts")
    parts = decided.join(often, key, "left").withColumn(
        "salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1))
    )
    return places.join(parts.drop("salts"), [*key, "salt"]).select(
        "rid", "rhash", (F.col("first") + F.col("start")).alias("start"), (F.col("first") + F.col("stop")).alias("stop")
    )


def repeated_spans(
    docs: DataFrame, length: int = LENGTH, id_column: str = "doc_id", text_column: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """Texts with a run whose anchor repeats; and stretches to be cut: rid, rhash, start, stop."""
    texts = docs.select(*row_key(id_column, text_column), text_or_empty(text_column).alias("body"))
    texts = texts.withColumn("rid", F.col("rid").cast("long"))
    found = texts.filter(F.octet_length("body") >= length).mapInArrow(
        lambda x: _runs(x, length), "rid long, rhash long, anchor long, first long, far int, n int"
    )
    found = stored(found, "runs", "zstd")
    several = found.groupBy("anchor").agg(F.count("*").alias("times")).filter("times > 1")
    row = F.struct("first", "anchor", "far", "n", (F.col("times") > HOT).alias("hot"))
    of_text = found.join(several, "anchor").groupBy("rid", "rhash").agg(F.collect_set(row).alias("runs"))
    hits = stored(
        texts.join(of_text, same_row(texts, of_text)).select(
            texts["rid"], texts["rhash"], "body", F.sort_array("runs").alias("runs")
        ),
        "repeats",
        "zstd",
    )
    dealt = stored(hits.mapInArrow(lambda x: _stretches(x, length), _STRETCH), "stretches", "zstd")
    # Partial counts come first: equal stretches are one row, however often they occur.
    distinct = stored(
        dealt.groupBy("key", "known").agg(F.count("*").alias("times"), F.max("stretch").alias("stretch")),
        "distinct",
        "zstd",
    )
    grouped = distinct.repartition("key").sortWithinPartitions("key", "known")
    decided = grouped.mapInArrow(lambda x: _covered(x, length), "key long, known long, start long, stop long")
    return hits.select("rid", "rhash", "body"), _placed(dealt, decided, distinct)


def _cut_out(batches):
    for batch in batches:
        for start in range(0, batch.num_rows, 100):
            rows = batch.slice(start, 100)
            kept, removed, n_spans = [], [], []
            for body, spans in zip(rows.column("body").to_pylist(), rows.column("spans").to_pylist()):
                data, parts, at, n, total = body.encode(), [], 0, 0, 0
                stop = -1
                for span in spans:
                    if span["start"] > stop:
                        n += 1
                        parts.append(data[max(at, 0) : span["start"]])
                        at = span["start"]
                    new = max(span["stop"], stop)
                    total += new - max(at, span["start"])
                    at = stop = new
                parts.append(data[max(at, 0) :])
                kept.append(b"".join(parts))
                removed.append(total)
                n_spans.append(n)
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("rid"),
                    rows.column("rhash"),
                    pa.array(removed, pa.int64()),
                    pa.array(n_spans, pa.int64()),
                    pa.array(kept, pa.binary()),
                ],
                names=["rid", "rhash", "n_removed", "n_spans", "kept"],
            )


def cut_repeats(
    docs: DataFrame, length: int = LENGTH, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Texts that lose bytes: rid, rhash, n_removed, n_spans and the bytes kept."""
    texts, spans = repeated_spans(docs, length, id_column, text_column)
    listed = spans.groupBy("rid", "rhash").agg(
        F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("spans")
    )
    # Rows that agree in id and text lose the same bytes.
    joined = texts.join(listed, same_row(texts, listed)).select(texts["rid"], texts["rhash"], "body", "spans")
    return joined.mapInArrow(_cut_out, "rid long, rhash long, n_removed long, n_spans long, kept binary")
