"""Near-duplicate documents: MinHash, banding, verification, connected components.

Each text's set of distinct five-word shingles is hashed by 128 universal functions
``(a*x + b) mod 2**64``; their minima form 32 bands of 4. Equal sets are one class,
known by a 128-bit sum of their members, and only the smallest row of a class goes on.
Classes that share a band are candidates: the chance to miss a pair at the threshold
of 0.75 is (1 - 0.75**4)**32, about 5 in a million.

A bucket of n classes is never expanded to all its pairs. Each bucket compares its
members with one of them, the one that meets most others in all its buckets; links join
them to components. Only members of buckets that hold several components go on, all to
one exact search: sets that are similar enough share one of their rarest shingles, so only
pairs that do are compared, whatever the size of a bucket, and no link is lost.

Candidates whose signatures agree in fewer than 68 of 128 places go: at the threshold
that is 5.7 standard deviations below the mean. All others are verified on the full
sets of shingles of both texts, in whole numbers. The row of a class that many others are
compared with is dealt out to as many tasks as it takes. Links become components by
alternating large-star and small-star steps, each written to the shared folder.

* A null or empty text has no shingles: its document is its own component and is kept.
* Fewer than five words are one shingle, so equal short texts are linked.
* Rows of equal id are one document. A row with a null id is linked with nothing and kept.
* Extra columns, whatever their names, are ignored. An empty table gives an empty table.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from schemagauge.llm.columns import row_key, text_or_empty
from schemagauge.llm.kernels import U64, Words, mix, shingle_sets, slices
from schemagauge.llm.storage import stored

BANDS, ROWS = 32, 4
SIZE = BANDS * ROWS
LEAST_AGREEING = 68
#: Pairs for which the text of their first document is sent to one task.
SHARE = 256

_SKETCH = (
    "rid long, rhash long, n_shingles long, s1 long, s2 long, bands array<long>, sig binary"
)


def _functions() -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(20_24)
    a = draw.integers(0, 1 << 63, SIZE, dtype=np.int64).astype(U64) * U64(2) + U64(1)
    return a, draw.integers(0, 1 << 63, SIZE, dtype=np.int64).astype(U64)


def minima(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The minima of a set under all functions, some members at a time."""
    least = np.full(SIZE, np.iinfo(U64).max, U64)
    for i in range(0, len(values), 512):
        hashed = np.multiply.outer(a, values[i : i + 512])
        hashed += b[:, None]
        np.minimum(least, hashed.min(axis=1), out=least)
    return least


def _sketches(batches, k):
    a, b = _functions()
    factors = np.array([pow(0x5851F42D4C957F2D, i + 1, 1 << 64) for i in range(ROWS)], U64)
    for batch in batches:
        for first, texts in slices(batch, "body"):
            sets = shingle_sets(Words(texts), k)
            least = np.array([minima(s, a, b) for s in sets])
            bands = (least.reshape(-1, BANDS, ROWS) * factors).sum(axis=2, dtype=U64)
            bands = mix(bands + np.arange(BANDS, dtype=U64) * U64(0x9E3779B97F4A7C15))
            # Mixed first: the leading bits of the minima of large sets are all 0.
            signs = (mix(least) >> U64(56)).astype(np.uint8)
            full = np.array([len(s) > 0 for s in sets])
            rows = batch.slice(first, len(texts))
            sums = [
                [int(mix(s + U64(c)).sum(dtype=U64)) for s in sets] for c in (0x1234567, 0x89ABCDEF)
            ]
            counts = np.where(full, BANDS, 0)
            offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("rid"),
                    rows.column("rhash"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    *[pa.array(np.array(s, U64).view(np.int64)) for s in sums],
                    pa.ListArray.from_arrays(offsets, pa.array(bands[full].reshape(-1).view(np.int64))),
                    pa.array([s.tobytes() for s in signs], pa.binary()),
                ],
                names=["rid", "rhash", "n_shingles", "s1", "s2", "bands", "sig"],
            )


def sketches(docs: DataFrame, k: int, id_column: str, text_column: str) -> DataFrame:
    texts = docs.select(*row_key(id_column, text_column), text_or_empty(text_column).alias("body"))
    texts = texts.withColumn("rid", F.col("rid").cast("long"))
    return texts.mapInArrow(lambda batches: _sketches(batches, k), _SKETCH)


def _with_both(pairs: DataFrame, table: DataFrame, column: str) -> DataFrame:
    """Pairs (a, ah, b, bh) with ``column`` of both rows as ``of_a`` and ``of_b``.

    A row that is the first of many pairs is repeated for each ``SHARE`` of them.
    """
    many = pairs.groupBy("a", "ah").agg(F.ceil(F.count("*") / SHARE).alias("salts"))
    second = table.select(F.col("rid").alias("b"), F.col("rhash").alias("bh"), F.col(column).alias("of_b"))
    salted = pairs.join(many, ["a", "ah"]).withColumn("salt", F.pmod(F.xxhash64("b", "bh"), "salts"))
    first = (
        table.select(F.col("rid").alias("a"), F.col("rhash").alias("ah"), F.col(column).alias("of_a"))
        .join(many, ["a", "ah"])
        .withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)))
        .drop("salts")
    )
    keyed = salted.drop("salts").join(second, ["b", "bh"])
    return keyed.join(first, ["a", "ah", "salt"]).drop("salt")


def _agreeing(batches, least):
    for batch in batches:
        if batch.num_rows:
            of_a, of_b = (
                np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, SIZE)
                for c in ("of_a", "of_b")
            )
            same = pa.array((of_a == of_b).sum(axis=1) >= least)
            yield batch.select(["a", "ah", "b", "bh"]).filter(same)


def _linked(batches, k, percent):
    for batch in batches:
        for start in range(0, batch.num_rows, 64):
            rows = batch.slice(start, 64)
            texts = {}
            for c, h, t in (("a", "ah", "of_a"), ("b", "bh", "of_b")):
                texts |= dict(zip(zip(rows.column(c).to_pylist(), rows.column(h).to_pylist()), rows.column(t).to_pylist()))
            sets = dict(zip(texts, shingle_sets(Words([t.encode() for t in texts.values()]), k)))
            keep = []
            for a, ah, b, bh in zip(*[rows.column(c).to_pylist() for c in ("a", "ah", "b", "bh")]):
                x, y = sets[a, ah], sets[b, bh]
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
            yield rows.select(["a", "ah", "b", "bh"]).filter(pa.array(keep, pa.bool_()))


_PAIR = "a long, ah long, b long, bh long"


def verified(pairs: DataFrame, signs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs whose signatures agree well enough and whose full sets are similar enough."""
    alike = _with_both(pairs, signs, "sig").mapInArrow(lambda x: _agreeing(x, LEAST_AGREEING), _PAIR)
    return _with_both(stored(alike, "alike"), texts, "body").mapInArrow(
        lambda x: _linked(x, k, percent), _PAIR
    )


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """Of the nodes of edges (u, v) other than the smallest of a component: node, component."""

    def settled(df):
        df = stored(df.filter("u <> v").distinct(), "stars")
        return df, tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    edges, state = settled(_small_star(edges))
    while state[0]:
        moved, now = settled(_small_star(_large_star(edges).filter("u <> v").distinct()))
        if now == state:
            break
        edges, state = moved, now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))


def _placed(members: DataFrame, labels: DataFrame) -> DataFrame:
    """The members of buckets that hold several components: rid, rhash, component, once each."""
    known = members.join(labels, F.col("rid") == F.col("node"), "left").select(
        "key", "rid", "rhash", F.coalesce("component", "rid").alias("component")
    )
    mixed = (
        known.groupBy("key")
        .agg(F.min("component").alias("low"), F.max("component").alias("high"))
        .filter("low < high")
        .select("key")
    )
    return known.join(mixed, "key").select("rid", "rhash", "component").distinct()


def _with_hub(members: DataFrame) -> DataFrame:
    """Each member of a bucket with the one that meets most others in its own buckets.

    Of many copies that is the original, or the one that was changed least.
    """
    lot = F.struct(-F.col("score"), F.xxhash64("rid", "rhash"), "rid", "rhash")
    hubs = members.groupBy("key").agg(F.min(lot).alias("p"))
    hubs = hubs.select("key", F.col("p.rid").alias("a"), F.col("p.rhash").alias("ah"))
    met = members.join(hubs, "key").filter("rid <> a")
    return met.select("a", "ah", F.col("rid").alias("b"), F.col("rhash").alias("bh")).distinct()


def _members_of_sets(batches, k):
    for batch in batches:
        for first, texts in slices(batch, "body"):
            sets = shingle_sets(Words(texts), k)
            sizes = np.array([len(s) for s in sets])
            at = pa.array(np.repeat(np.arange(first, first + len(texts)), sizes))
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).take(at) for c in ("rid", "rhash", "component")]
                + [pa.array(np.repeat(sizes, sizes)), pa.array(np.concatenate(sets).view(np.int64))],
                names=["rid", "rhash", "component", "size", "h"],
            )


def _by_prefix(placed: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs in different components which can reach the threshold at all.

    With the shingles of each set in order of rarity, two similar sets share one of the
    first few: |x| - o + 1 of them, where o is the overlap that the threshold asks of
    both. For the smaller set that is about a seventh. A shingle of one set only is in no
    pair, so the sets that can't be linked, however many, hardly meet.
    """
    body = texts.join(placed, ["rid", "rhash"])
    rows = body.mapInArrow(
        lambda x: _members_of_sets(x, k), "rid long, rhash long, component long, size long, h long"
    )
    rows = stored(rows, "shingles")
    common = rows.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1")
    row = ["rid", "rhash", "component", "size"]
    sets = rows.join(common, "h").groupBy(*row).agg(
        F.sort_array(F.collect_list(F.struct("n", "h"))).alias("common")
    )
    unique = F.col("size") - F.size("common")
    # Overlaps asked of the set as the smaller of a pair, and as the larger.
    smaller = F.ceil(2 * percent * F.col("size") / (100 + percent))
    larger = F.ceil(percent * F.col("size") / 100)
    found = sets.select(
        *row,
        unique.alias("unique"),
        (F.col("size") - smaller + 1).alias("short"),
        F.posexplode(F.slice("common", 1, F.greatest(F.lit(0), F.col("size") - larger + 1 - unique).cast("int"))).alias("i", "x"),
    ).select(*row, "short", F.col("x.h").alias("h"), (F.col("unique") + F.col("i") + 1).alias("place"))
    found = stored(found, "prefixes")
    x = found.filter("place <= short").select("h", *[F.col(c).alias(f"x_{c}") for c in (*row, "place")])
    y = found.select("h", *[F.col(c).alias(f"y_{c}") for c in (*row, "place")])
    met = F.expr(
        "x_component <> y_component and (x_size, x_rid, x_rhash) < (y_size, y_rid, y_rhash)"
        f" and 100 * x_size >= {percent} * y_size"
        f" and (1 + least(x_size - x_place, y_size - y_place)) * {100 + percent}"
        f" >= {percent} * (x_size + y_size)"
    )
    return x.join(y, "h").filter(met).select(
        F.col("y_rid").alias("a"), F.col("y_rhash").alias("ah"), F.col("x_rid").alias("b"), F.col("x_rhash").alias("bh")
    ).distinct()


def near_duplicates(
    docs: DataFrame,
    k: int = 5,
    percent: int = 75,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """A row per row of ``docs``: rid, rhash, n_shingles, component."""
    found = stored(sketches(docs, k, id_column, text_column), "sketches")
    usable = found.filter("rid is not null and n_shingles > 0")
    classes = usable.groupBy("s1", "s2").agg(F.min(F.struct("rid", "rhash")).alias("r"))
    classes = stored(
        classes.select("s1", "s2", F.col("r.rid").alias("crid"), F.col("r.rhash").alias("crhash")),
        "classes",
    )
    mine = (F.col("rid") == F.col("crid")) & (F.col("rhash") == F.col("crhash"))
    heads = stored(
        usable.select("rid", "rhash", "bands", "sig")
        .join(classes.select("crid", "crhash"), mine, "left_semi")
        .dropDuplicates(["rid", "rhash"]),
        "heads",
    )
    keys = heads.select(F.explode("bands").alias("key"), "rid", "rhash")
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    members = stored(keys.join(shared, "key"), "buckets")
    scores = members.groupBy("rid", "rhash").agg(F.sum("n").alias("score"))
    members = stored(members.drop("n").join(scores, ["rid", "rhash"]), "members")
    texts = docs.select(*row_key(id_column, text_column), text_or_empty(text_column).alias("body"))
    texts = texts.withColumn("rid", F.col("rid").cast("long"))
    texts = texts.join(scores.select("rid", "rhash"), ["rid", "rhash"], "left_semi")
    texts = stored(texts.dropDuplicates(["rid", "rhash"]), "texts")

    links, labels = [], None
    if not members.isEmpty():
        pairs = stored(_with_hub(members), "pairs")
        links.append(stored(verified(pairs, heads, texts, k, percent), "links"))
        labels = components(_edges(links))
        placed = stored(_placed(members, labels), "placed")
        if not placed.isEmpty():
            pairs = stored(_by_prefix(placed, texts, k, percent), "pairs")
            links.append(stored(verified(pairs, heads, texts, k, percent), "links"))
            labels = components(_edges(links))

    # Rows of equal id are one document, so the classes that they belong to are one component.
    of_class = usable.select("rid", "s1", "s2").join(classes, ["s1", "s2"]).select("rid", "crid").distinct()
    several = of_class.groupBy("rid").agg(F.count("*").alias("n")).filter("n > 1").select("rid")
    if not several.isEmpty():
        extra = of_class.join(several, "rid").select(F.col("rid").alias("u"), F.col("crid").alias("v"))
        labels = components(_edges(links).union(extra) if links else extra)
    component = F.col("crid")
    if labels is not None:
        of_class = of_class.join(labels, F.col("crid") == F.col("node"), "left")
        component = F.coalesce("component", "crid")
    of_row = of_class.groupBy("rid").agg(F.min(component).alias("component"))
    return (
        found.select("rid", "rhash", "n_shingles")
        .join(of_row, "rid", "left")
        .select("rid", "rhash", "n_shingles", F.coalesce("component", "rid").alias("component"))
    )


def _edges(links: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, links).select(F.col("a").alias("u"), F.col("b").alias("v"))
