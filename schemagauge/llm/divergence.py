"""How far the sources of a language differ in their terms.

A term is a run of letters (of A-Z, and of all characters beyond ASCII), A-Z lower-cased. A
language keeps the terms of at least ``min_docs`` of its documents; each of its sources, and the
language itself, gives every kept term the share ``p = 1 + floor(SCALE * (count + 1) / (N + V))`` of
its ``N`` occurrences of the ``V`` kept terms, in whole numbers. Two distributions differ at a term
by ``floor((p - q)**2 / q)``. Reported are, for each source, the others by their sum over all
kept terms, and the terms that it uses more than its language, by that difference.

Terms are strings only where a text is read and where a report needs them. What is counted,
shuffled and joined are digests of ``bits`` bits. Beside the counts a dictionary gives each
digest its smallest and largest string, once per task and new string; where the two differ,
strings share a digest, and only these are counted again, by their texts. Texts come back
for the terms that a report may keep, and for no others.

The sum over terms is taken over the terms that two sources share, and corrected: with ``p0`` for
a term that a source lacks, the rest depends on how often each share comes in a source alone.

* A row is a document. Null text, language and source are empty strings.
* A group without terms is a group: it gives every kept term the same share.
* Rows of equal id are documents of their own. Ties in a report are in order of UTF-8.
* Extra columns, whatever their names, are ignored. An empty table gives an empty table.
* A text of any length is counted whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from schemagauge.llm.columns import text_or_empty
from schemagauge.llm.joins import join_unique
from schemagauge.llm.kernels import FOLD, U64, mix, slices, span_hashes
from schemagauge.llm.storage import stored

SCALE = 1_000_000_000
MIN_DOCS = 3
TOP = 200
BITS = 64
#: Fixed value: the bytes that no term has.
_OTHER = np.ones(256, np.int8)
_OTHER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 0
#: Terms of a group are first ranked in so many parts.
_PARTS = 32
#: Pairs of sources worked on at once.
_PAIRS = 1 << 20

#: A language and a source are numbers of 64 bits where terms are counted.
_COUNTED = "lang_no long, source_no long, digest long, n long, docs long"
_COUNTED_BY_TEXT = _COUNTED.replace("digest long", "digest long, term string")


class Terms:
    """The terms of some texts: digests, and the text that each is in."""

    def __init__(self, texts: list[bytes], bits: int):
        self.joined = (b"\n".join(texts) + b"\n").translate(FOLD)
        raw = np.frombuffer(self.joined, np.uint8)
        edge = np.diff(_OTHER[raw], prepend=np.int8(1), append=np.int8(1))
        self.starts, self.ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        self.digests = span_hashes(raw, self.starts, self.ends)
        if bits < 64:
            self.digests = self.digests & U64((1 << bits) - 1)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.owner = np.searchsorted(np.cumsum(sizes), self.starts, "right")

    def strings(self, at: np.ndarray) -> list[str]:
        return [self.joined[a:b].decode() for a, b in zip(self.starts[at].tolist(), self.ends[at].tolist())]


def _sums(keys: list[np.ndarray], values: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Sums of values by keys."""
    if not len(keys[0]):
        return keys, values
    order = np.lexsort(keys)
    ranked = [k[order] for k in keys]
    fresh = np.concatenate(([True], np.any([k[1:] != k[:-1] for k in ranked], axis=0)))
    at = np.flatnonzero(fresh)
    return [k[at] for k in ranked], [np.add.reduceat(v[order], at) for v in values]


def _groups(batch: pa.RecordBatch, first: int, n: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """A number per row and the two numbers of each group that it stands for."""
    pairs = [batch.column(c).slice(first, n).to_numpy() for c in ("lang_no", "source_no")]
    groups, of = np.unique(np.stack(pairs), axis=1, return_inverse=True)
    return of.reshape(-1), list(groups)


def _counted(batches, bits):
    """Occurrences and documents of digests by group, for some texts at a time."""
    for batch in batches:
        for first, texts in slices(batch, "body"):
            found = Terms(texts, bits)
            group, names = _groups(batch, first, len(texts))
            one = np.ones(len(found.owner), np.int64)
            (owner, digest), (n,) = _sums([found.owner, found.digests], [one])
            (of, digest), (n, docs) = _sums([group[owner], digest], [n, np.ones(len(n), np.int64)])
            yield _rows(of, names, n, docs, digest=pa.array(digest.view(np.int64)))


def _counted_by_text(batches, bits):
    """The same with the strings themselves."""
    for batch in batches:
        for first, texts in slices(batch, "body"):
            found = Terms(texts, bits)
            group, names = _groups(batch, first, len(texts))
            counts: dict[tuple, list[int]] = {}
            last: dict[tuple, int] = {}
            every = found.strings(np.arange(len(found.owner)))
            for doc, digest, term in zip(found.owner.tolist(), found.digests.view(np.int64).tolist(), every):
                key = (int(group[doc]), digest, term)
                row = counts.setdefault(key, [0, 0])
                row[0] += 1
                row[1] += last.get(key) != doc
                last[key] = doc
            keys = list(zip(*counts)) or [[]] * 3
            sums = np.array(list(counts.values()), np.int64).reshape(-1, 2)
            digests, terms = pa.array(keys[1], pa.int64()), pa.array(keys[2], pa.string())
            yield _rows(np.array(keys[0], np.int64), names, sums[:, 0], sums[:, 1], digest=digests, term=terms)


def _rows(of, names, n, docs, **terms) -> pa.RecordBatch:
    columns = {"lang_no": pa.array(names[0][of]), "source_no": pa.array(names[1][of])}
    return pa.RecordBatch.from_pydict(columns | terms | {"n": pa.array(n), "docs": pa.array(docs)})


def _words(batches, bits):
    """The strings of each digest that the task hasn't sent before, or not of late."""
    sent = other_sent = np.empty(0, U64)
    for batch in batches:
        for _, texts in slices(batch, "body"):
            found = Terms(texts, bits)
            # Another digest tells strings apart that share the first.
            raw = np.frombuffer(found.joined, np.uint8)
            other = span_hashes(raw ^ np.uint8(0x5A), found.starts, found.ends)
            order = np.argsort(found.digests)
            d, o = found.digests[order], other[order]
            fresh = np.concatenate(([True], (d[1:] != d[:-1]) | (o[1:] != o[:-1])))[: len(d)]
            at, d, o = order[fresh], d[fresh], o[fresh]
            if len(sent) > 200_000:
                sent = other_sent = np.empty(0, U64)
            place = np.searchsorted(sent, d)
            place[place == len(sent)] = 0
            new = ((sent[place] != d) | (other_sent[place] != o)) if len(sent) else np.ones(len(d), bool)
            at = at[new]
            sent, other_sent = np.concatenate((sent, d[new])), np.concatenate((other_sent, o[new]))
            order = np.argsort(sent, kind="stable")
            sent, other_sent = sent[order], other_sent[order]
            yield pa.RecordBatch.from_arrays(
                [pa.array(found.digests[at].view(np.int64)), pa.array(found.strings(at), pa.string())],
                names=["digest", "term"],
            )


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with ``lang_no`` and ``source_no``, 64 bits that differ between all languages and sources."""
    groups = docs.select("lang", "source").distinct()
    for seed in range(100):
        no = lambda c: F.xxhash64(F.lit(seed), F.col(c))
        both = [F.countDistinct(x) for c in ("lang", "source") for x in (F.col(c), no(c))]
        langs, lang_nos, sources, source_nos = groups.agg(*both).first()
        if (langs, sources) == (lang_nos, source_nos):
            return docs.withColumns({"lang_no": no("lang"), "source_no": no("source")})
    raise RuntimeError("no seed tells all languages and sources apart")


def counts(docs: DataFrame, bits: int = BITS) -> tuple[DataFrame, DataFrame]:
    """Two tables over ``docs`` with lang, source and body.

    Occurrences ``n`` and documents ``docs`` by lang_no, source_no (see :func:`numbered`) and term, a term
    being its ``digest`` and, where strings share the digest, the ``term`` itself, else ``''``; and the
    dictionary, with ``low`` and ``high`` for each digest.
    """
    docs = numbered(docs).select("lang_no", "source_no", "body")
    key = ["lang_no", "source_no", "digest", "term"]

    def summed(df):
        # Keys are numbers alone but where strings have to be told apart.
        by = [c for c in key if c in df.columns]
        found = df.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
        return found.withColumn("term", found["term"] if "term" in by else F.lit("")).select(*key, "n", "docs")

    words = docs.select("body").mapInArrow(lambda x: _words(x, bits), "digest long, term string")
    words = stored(words.groupBy("digest").agg(F.min("term").alias("low"), F.max("term").alias("high")), "dictionary")
    found = summed(docs.mapInArrow(lambda x: _counted(x, bits), _COUNTED))
    shared = words.filter("low <> high").select("digest")
    if not shared.isEmpty():
        by_text = docs.mapInArrow(lambda x: _counted_by_text(x, bits), _COUNTED_BY_TEXT)
        apart = summed(by_text.join(shared, "digest", "left_semi").select(*key, "n", "docs"))
        found = found.join(shared, "digest", "left_anti").select(*key, "n", "docs").unionByName(apart)
    return stored(found, "counts"), words


def share(n: Column, total: Column, kept: Column, scale: int = SCALE) -> Column:
    """``1 + floor(scale * (n + 1) / (total + kept))`` in whole numbers of any size."""
    exact = lambda c: c.cast("decimal(19,0)")
    return 1 + F.call_function("div", F.lit(scale).cast("decimal(10,0)") * exact(n + 1), exact(total + kept))


def difference(p: Column, q: Column) -> Column:
    """``floor((p - q)**2 / q)``; shares are at most ``SCALE + 1``, so their square is a long."""
    return F.call_function("div", (p - q) * (p - q), q)


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


_SUMS = "lang string, a int, b int, value long"


def _summed_pairs(langs: list[str], lang: np.ndarray, a: np.ndarray, b: np.ndarray, value: np.ndarray) -> pa.RecordBatch:
    (lang, a, b), (value,) = _sums([lang, a, b], [value])
    return pa.RecordBatch.from_arrays(
        [pa.array(langs, pa.string()).take(pa.array(lang)), *[pa.array(x.astype(np.int32)) for x in (a, b)], pa.array(value)],
        names=["lang", "a", "b", "value"],
    )


def _shared(batches):
    """By two sources, what the terms of both differ from the same terms of one and of none."""
    for batch in batches:
        coded = batch.column("lang").dictionary_encode()
        langs, users = coded.dictionary.to_pylist(), batch.column("users")
        n = np.diff(users.offsets.to_numpy())
        no, p, p0 = (x.to_numpy() for x in users.flatten().flatten())
        first = np.repeat(np.cumsum(n) - n, n)  # of each entry, the first of its term, and how many there are
        of_term, n = np.repeat(coded.indices.to_numpy().astype(np.int64), n), np.repeat(n, n)
        done = np.cumsum(n)
        at = 0
        while at < len(n):
            stop = max(at + 1, int(np.searchsorted(done, done[at] - n[at] + _PAIRS, "right")))
            some = np.arange(at, stop)
            x = np.repeat(some, n[some])
            y = np.arange(len(x)) - np.repeat(np.cumsum(n[some]) - n[some], n[some]) + first[x]
            x, y = x[no[x] != no[y]], y[no[x] != no[y]]
            value = _f(p[x], p[y]) - _f(p[x], p0[y]) - _f(p0[x], p[y]) + _f(p0[x], p0[y])
            yield _summed_pairs(langs, of_term[x], no[x].astype(np.int64), no[y].astype(np.int64), value)
            at = stop


def _alone(batches):
    """By two sources, the sums if they shared no term; each row is a source, with all of its language."""
    for batch in batches:
        for row in range(batch.num_rows):
            lang, no, kept = (batch.column(c)[row].as_py() for c in ("lang", "no", "kept"))
            p0 = np.int64(batch.column("p0")[row].as_py())
            others, theirs = (x.to_numpy() for x in batch.column("others")[row].values.flatten())
            p, n = (x.to_numpy() for x in batch.column("shares")[row].values.flatten())
            mine, yours = kept * _f(p0, theirs), np.zeros(len(theirs), np.int64)
            step = max(1, _PAIRS // max(len(theirs), 1))
            for at in range(0, len(p), step):
                some, times = p[at : at + step, None], n[at : at + step, None]
                mine += (times * (_f(some, theirs) - _f(p0, theirs))).sum(axis=0)
                yours += (times * (_f(theirs, some) - _f(theirs, p0))).sum(axis=0)
            keep = others != no
            a, b = np.full(keep.sum(), no, np.int64), others[keep].astype(np.int64)
            zero = np.zeros(2 * len(a), np.int64)
            value = np.concatenate((mine[keep], yours[keep]))
            yield _summed_pairs([lang], zero, np.concatenate((a, b)), np.concatenate((b, a)), value)


def source_pairs(used: DataFrame, sizes: DataFrame) -> DataFrame:
    """lang, source, item, value: every source with every other of its language.

    ``used`` has lang, digest, term, no, p and p0 of the terms that a source has; ``sizes`` has lang,
    source, its number ``no`` in the language, kept and p0.
    """
    users = F.collect_list(F.struct("no", "p", "p0"))
    terms = used.groupBy("lang", "digest", "term").agg(users.alias("users"))
    both = terms.select("lang", "users").mapInArrow(_shared, _SUMS)
    # How often each share comes in a source: as many rows as it has different counts.
    shares = used.groupBy("lang", "no", "p").agg(F.count("*").alias("n"))
    shares = shares.groupBy("lang", "no").agg(F.collect_list(F.struct("p", "n")).alias("shares"))
    none = F.array().cast("array<struct<p:bigint,n:bigint>>")
    rows = sizes.join(shares, ["lang", "no"], "left").select(
        "lang", "no", "kept", "p0", F.coalesce("shares", none).alias("shares")
    )
    # As long as a line of the result has rows for a source.
    others = sizes.groupBy("lang").agg(F.collect_list(F.struct("no", "p0")).alias("others"))
    alone = join_unique(rows, others, ["lang"], F.col("no")).mapInArrow(_alone, _SUMS)
    sums = both.unionByName(alone).groupBy("lang", "a", "b").agg(F.sum(F.col("value").cast("decimal(19,0)")).alias("value"))
    names = sizes.select("lang", "no", "source")
    named = sums.join(names.withColumnRenamed("no", "a"), ["lang", "a"])
    named = named.join(names.select("lang", F.col("no").alias("b"), F.col("source").alias("item")), ["lang", "b"])
    return named.select("lang", "source", "item", F.col("value").cast("long").alias("value"))


def top_terms(used: DataFrame, words: DataFrame, top: int) -> DataFrame:
    """lang, source, item, value, rank: the terms that a source uses more than its language.

    ``used`` has lang, source, digest, term, p and q. A group is ranked in parts and then over what the
    parts keep; texts are joined where the value alone may reach the top.
    """
    group = ["lang", "source"]
    found = used.filter("p > q").select(
        *group, "digest", "term", difference(F.col("p"), F.col("q")).alias("value"),
        F.pmod(F.xxhash64("digest", "term"), F.lit(_PARTS)).alias("part"),
    )
    parts = Window.partitionBy(*group, "part")
    first = stored(found.withColumn("k", F.rank().over(parts.orderBy(F.desc("value")))).filter(F.col("k") <= top).drop("k"), "ranked")
    before = Window.partitionBy(*group).orderBy(F.desc("value")).rowsBetween(Window.unboundedPreceding, -1)
    least = (
        first.groupBy(*group, "value").agg(F.count("*").alias("times"))
        .withColumn("before", F.coalesce(F.sum("times").over(before), F.lit(0)))
        .filter(F.col("before") < top).groupBy(*group).agg(F.min("value").alias("least"))
    )
    first = first.join(least, group).filter(F.col("value") >= F.col("least"))
    item = F.when(F.col("term") == "", F.col("low")).otherwise(F.col("term"))
    named = first.join(words.select("digest", "low"), "digest").withColumn("item", item)
    order = [F.desc("value"), F.asc("item")]
    for where in (parts, Window.partitionBy(*group)):
        named = named.withColumn("rank", F.row_number().over(where.orderBy(*order))).filter(F.col("rank") <= top)
    return named.select(*group, "item", "value", "rank")


def divergence(
    docs: DataFrame,
    min_docs: int = MIN_DOCS,
    top: int = TOP,
    bits: int = BITS,
    text_column: str = "text",
    lang_column: str = "lang",
    source_column: str = "source",
) -> DataFrame:
    """lang, source, part (``pair`` or ``term``), item, value and rank, ranks from 1 per group and part."""
    rows = docs.select(
        text_or_empty(lang_column).alias("lang"),
        text_or_empty(source_column).alias("source"),
        text_or_empty(text_column).alias("body"),
    )
    found, words = counts(rows, bits)
    term = ["lang_no", "digest", "term"]
    kept = found.groupBy(*term).agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("lang_docs"))
    kept = stored(kept.filter(F.col("lang_docs") >= min_docs).drop("lang_docs"), "kept")
    langs = kept.groupBy("lang_no").agg(F.count("*").alias("kept"), F.sum("lang_n").alias("lang_total"))
    used = stored(found.drop("docs").join(kept, term), "used")
    group = ["lang_no", "source_no"]
    totals = used.groupBy(*group).agg(F.sum("n").alias("total"))
    zero = F.lit(0).cast("long")
    sizes = numbered(rows).select("lang", "source", *group).distinct().join(langs, "lang_no", "left").join(totals, group, "left")
    sizes = sizes.select("lang", "source", *group, *[F.coalesce(c, zero).alias(c) for c in ("kept", "lang_total", "total")])
    any_kept = F.greatest(F.col("kept"), F.lit(1))
    sizes = sizes.withColumns(
        {
            "no": F.row_number().over(Window.partitionBy("lang").orderBy("source")),
            "p0": share(zero, F.col("total"), any_kept),
        }
    )
    sizes = stored(sizes, "sizes")
    used = join_unique(used, sizes, group, F.col("digest")).withColumns(
        {
            "p": share(F.col("n"), F.col("total"), F.col("kept")),
            "q": share(F.col("lang_n"), F.col("lang_total"), F.col("kept")),
        }
    )
    used = stored(used.select("lang", "digest", "term", "source", "no", "p", "p0", "q"), "shares")
    pairs = source_pairs(used, sizes)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    pairs = pairs.withColumn("rank", F.row_number().over(order))
    out = ["lang", "source", "part", "item", "value", "rank"]
    both = pairs.withColumn("part", F.lit("pair")).select(*out)
    return both.unionByName(top_terms(used, words, top).withColumn("part", F.lit("term")).select(*out))
