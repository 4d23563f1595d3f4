"""Toxicity of texts by two class-conditional Kneser-Ney models of characters.

A word is the sequence of its bytes between two bounds; each byte is predicted from up to
five before it. The counts of the longest contexts are those of toxic or of ordinary
labelled documents. Both models back off to the same lower orders, the continuation
counts (how many different bytes come before) of all documents, so an expression that is
rare in both classes is as likely under either. The difference of the log-likelihoods of
a text is taken per word, for the whole text and for its worst stretch of 30 words. Next to
these averages stands the share of words whose own difference is over 3, which the noise of
ordinary words can't cancel. A logistic function of the three, fitted on labelled rows that
the models have not seen, is the score.

Counts are added up by key before they are shuffled. What is sent to the tasks are hashed
tables of fixed size (2**21 counts, 2**20 contexts), whatever the size of the corpus.
At most ``max_labelled`` labelled rows are used, drawn by a hash of the id: a bound for
their ids, which are sent to the tasks. Of these a third fits the logistic function.

* Rows whose crc32 of the id, written as text, leaves 2 modulo 4 are held out: their labels are not read.
* A null or empty text, and any text without words, has both differences and the share 0.
* Rows of equal id are scored one by one. A null id is in no training set.
* If labelled rows lack a class, every score is 0. An id that is labelled twice is toxic if one label says so.
* Extra columns, whatever their names, are ignored. An empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from schemagauge.llm.columns import text_or_empty
from schemagauge.llm.kernels import FOLD, U64, Words, mix, slices
from schemagauge.llm.storage import stored

ORDER = 6
DISCOUNT = 0.75
STRETCH = 30
#: The difference from which on a word counts as a telling one.
TELLING = 3.0
COUNT_BITS, CONTEXT_BITS = 21, 20
_MASK = np.array([(1 << (8 * i)) - 1 for i in range(ORDER + 1)], U64)
#: What the logistic function is given of a text.
FEATURES = ("whole", "worst", "telling")
#: The tables of the model: counts by key, and totals and types by context.
TABLES = ("t_count", "o_count", "s_count", "t_total", "o_total", "s_total", "t_types", "o_types", "s_types")


def fold_of(id_column: str) -> Column:
    return F.pmod(F.crc32(F.col(id_column).cast("string").cast("binary")), F.lit(4))


def grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each byte of each word, and of its end: the packed key, its size, the word's number."""
    buf = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8)
    bound = buf == 32
    at = np.arange(len(buf))
    last = np.maximum.accumulate(np.where(bound, at, 0))[:-1]
    size = np.minimum(at[1:] - last, ORDER - 1) + 1
    keys = np.zeros(len(buf), U64)
    for i in range(min(ORDER, len(buf))):
        keys[i:] |= buf[: len(buf) - i].astype(U64) << U64(8 * i)
    return keys[1:] & _MASK[size], size, np.cumsum(bound)[:-1] - 1


def _slot(keys: np.ndarray, size: np.ndarray, bits: int) -> np.ndarray:
    return (mix(keys ^ (size.astype(U64) << U64(56))) >> U64(64 - bits)).astype(np.int64)


def distinct_words(texts: list[bytes]) -> tuple[Words, list[bytes], np.ndarray]:
    """The words of some texts; the distinct ones, and the number of each word among them."""
    words = Words(texts)
    _, first, number = np.unique(words.hashes, return_index=True, return_inverse=True)
    joined = words.raw.tobytes().translate(FOLD)
    starts, ends = words.starts[first].tolist(), words.ends[first].tolist()
    return words, [joined[s:e] for s, e in zip(starts, ends)], number


def _summed(keys, size, *weights):
    """Weights added up by key."""
    key, first, number = np.unique(keys, return_index=True, return_inverse=True)
    return [key, size[first], *[np.bincount(number, w, len(key)) for w in weights]]


def _counted(batches, sent):
    """Keys with their counts in toxic and in ordinary labelled rows, added up by the task."""
    ids, labels = sent.value
    held = []

    def merged():
        return _summed(*[np.concatenate(x) for x in zip(*held)])

    def rows(found):
        key, size, *counts = found
        return pa.RecordBatch.from_arrays(
            [pa.array(key.view(np.int64)), pa.array(size.astype(np.int32))]
            + [pa.array(n.astype(np.int64)) for n in counts],
            names=["key", "size", "t", "o"],
        )

    for batch in batches:
        for first, texts in slices(batch, "body"):
            doc = batch.column("doc").slice(first, len(texts))
            known = np.array([x is not None for x in doc.to_pylist()], bool)
            doc = doc.fill_null(0).to_numpy()
            at = np.searchsorted(ids, doc)
            at[at == len(ids)] = 0
            label = np.where(known & (ids[at] == doc), labels[at], -1) if len(ids) else np.full(len(doc), -1)
            words, distinct, number = distinct_words(texts)
            if not distinct:
                continue
            label = np.repeat(label, np.diff(words.bounds))
            counts = [np.bincount(number, on, len(distinct)) for on in (label == 1, label == 0)]
            keys, size, owner = grams(distinct)
            held.append(_summed(keys, size, *[n[owner] for n in counts]))
            if len(held) == 8:
                held = [merged()]
            if len(held[0][0]) > 2_000_000:
                yield rows(merged())
                held = []
    if held:
        yield rows(merged())


def continuations(keys: DataFrame) -> DataFrame:
    """How many different bytes come before each shorter key: size, key, n."""
    seen = keys.select("size", "key")
    found = []
    for size in range(ORDER - 1, 0, -1):
        longer = seen.filter(F.col("size") == size + 1)
        if found:
            longer = longer.union(found[-1].select("size", "key")).distinct()
        suffix = F.col("key").bitwiseAND(F.lit((1 << (8 * size)) - 1))
        counts = longer.select(suffix.alias("key")).groupBy("key").agg(F.count("*").alias("n"))
        found.append(counts.select(F.lit(size).alias("size"), "key", "n"))
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def _slots(batches):
    """Values of the tables by slot, added up by batch: table, slot, n."""
    for batch in batches:
        key = batch.column("key").to_numpy().view(U64)
        size = batch.column("size").to_numpy().astype(np.int64)
        of_key, of_context = _slot(key, size, COUNT_BITS), _slot(key >> U64(8), size - 1, CONTEXT_BITS)
        for c in ("t", "o", "s"):
            n = batch.column(c).to_numpy()
            on = np.flatnonzero(n)
            for table, slot, value in (
                (f"{c}_count", of_key, n),
                (f"{c}_total", of_context, n),
                (f"{c}_types", of_context, np.ones(len(n), np.int64)),
            ):
                slots, number = np.unique(slot[on], return_inverse=True)
                sums = np.bincount(number, value[on], len(slots)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(slots), TABLES.index(table), np.int32)), pa.array(slots), pa.array(sums)],
                    names=["number", "slot", "n"],
                )


def train(docs: DataFrame, ids: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
    """The tables of both models: ``docs`` has doc and body, ``ids`` are sorted."""
    sent = docs.sparkSession.sparkContext.broadcast((ids, labels))
    rows = docs.mapInArrow(lambda x: _counted(x, sent), "key long, size int, t long, o long")
    keys = stored(
        rows.groupBy("key", "size").agg(F.sum("t").alias("t"), F.sum("o").alias("o")), "grams"
    )
    zero = F.lit(0).cast("long")
    own = keys.select("key", "size", "t", "o", zero.alias("s")).filter("t > 0 or o > 0")
    shared = continuations(keys).select("key", "size", zero.alias("t"), zero.alias("o"), F.col("n").alias("s"))
    few = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slots = own.union(shared.coalesce(few)).mapInArrow(_slots, "number int, slot long, n long")
    summed = slots.groupBy("number", "slot").agg(F.sum("n").alias("n")).toArrow()
    number, slot, n = (summed.column(c).to_numpy() for c in ("number", "slot", "n"))
    out = {}
    for i, table in enumerate(TABLES):
        bits = COUNT_BITS if table.endswith("count") else CONTEXT_BITS
        out[table] = np.zeros(1 << bits, np.float32)
        out[table][slot[number == i]] = n[number == i]
    return out


def word_ratios(model: dict[str, np.ndarray], words: list[bytes]) -> np.ndarray:
    """The difference of the log-likelihoods of each word, toxic less ordinary."""
    keys, size, owner = grams(words)

    def interpolated(name, key, length, lower):
        of_key, of_context = _slot(key, length, COUNT_BITS), _slot(key >> U64(8), length - 1, CONTEXT_BITS)
        total = model[f"{name}_total"][of_context]
        seen = total > 0
        total = np.where(seen, total, 1)
        own = np.maximum(model[f"{name}_count"][of_key] - DISCOUNT, 0) / total
        rest = DISCOUNT * model[f"{name}_types"][of_context] / total
        return np.where(seen, np.minimum(own, 1) + np.minimum(rest, 1) * lower, lower)

    p = np.full(len(keys), 1 / 256)
    for length in range(1, ORDER):
        short = np.full(len(keys), length)
        p = np.where(length < size, interpolated("s", keys & _MASK[length], short, p), p)
    toxic, ordinary = (interpolated(c, keys, size, p) for c in ("t", "o"))
    ratio = np.log(toxic) - np.log(ordinary)
    return np.bincount(owner, ratio, len(words))


def differences(model: dict[str, np.ndarray], texts: list[bytes]) -> np.ndarray:
    """Of each text the difference per word, as a whole and in its worst stretch; and its share of telling words."""
    words, distinct, number = distinct_words(texts)
    out = np.zeros((len(texts), len(FEATURES)))
    if not distinct:
        return out
    each = word_ratios(model, distinct)[number]
    sums = np.concatenate(([0.0], np.cumsum(each)))
    telling = np.concatenate(([0], np.cumsum(each > TELLING)))
    for i, (a, b) in enumerate(zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist())):
        if b > a:
            n = min(STRETCH, b - a)
            worst = (sums[a + n : b + 1] - sums[a : b + 1 - n]).max()
            out[i] = (sums[b] - sums[a]) / (b - a), worst / STRETCH, (telling[b] - telling[a]) / (b - a)
    return out


def _scored(batches, sent, weights):
    model = sent.value
    for batch in batches:
        for first, texts in slices(batch, "body"):
            found = differences(model, texts)
            score = np.zeros(len(texts)) if weights is None else 1 / (1 + np.exp(-(found @ weights[:-1] + weights[-1])))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc").slice(first, len(texts)), *[pa.array(x) for x in found.T], pa.array(score)],
                names=["doc", *FEATURES, "score"],
            )


def _score(texts: DataFrame, sent, weights) -> DataFrame:
    """Features and scores by the model that was sent to the tasks."""
    columns = ", ".join(f"{c} double" for c in (*FEATURES, "score"))
    return texts.mapInArrow(lambda x: _scored(x, sent, weights), f"doc long, {columns}")


def logistic(features: np.ndarray, labels: np.ndarray, steps: int = 50) -> np.ndarray:
    """A weight of each feature and a bias, by Newton's method with a small ridge."""
    scale = features.std(axis=0) + 1e-9
    x = np.column_stack((features / scale, np.ones(len(features))))
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - labels) + 1e-2 * w
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w)), gradient)
    return w / np.append(scale, 1)


def scores(
    docs: DataFrame,
    labels: DataFrame,
    max_labelled: int = 200_000,
    id_column: str = "doc_id",
    text_column: str = "text",
    label_column: str = "toxic",
) -> DataFrame:
    """A row per row of ``docs``: doc, whole, worst, telling and score."""
    texts = docs.select(F.col(id_column).cast("long").alias("doc"), text_or_empty(text_column).alias("body"))
    marked = (
        labels.filter(F.col(label_column).isNotNull() & F.col(id_column).isNotNull())
        .select(F.col(id_column).cast("long").alias("doc"), F.col(label_column).cast("int").alias("toxic"))
        .filter(fold_of("doc") != 2)
        .groupBy("doc")
        .agg(F.max("toxic").alias("toxic"))
    )
    n = marked.count()
    share = F.pmod(F.xxhash64("doc"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, max_labelled / max(n, 1)))
    known = marked.filter(share).withColumn("fit", fold_of("doc") == 3).toArrow()
    doc, toxic, fit = (known.column(c).to_numpy() for c in ("doc", "toxic", "fit"))
    order = np.argsort(doc)
    doc, toxic, fit = doc[order], (toxic[order] > 0).astype(np.int64), fit[order].astype(bool)
    model = train(texts, doc[~fit], toxic[~fit])
    sent = docs.sparkSession.sparkContext.broadcast(model)
    weights = None
    if len(set(toxic[fit])) == 2 and len(set(toxic[~fit])) == 2:
        # Rows that fit the logistic function: no more than max_labelled.
        mine = docs.sparkSession.createDataFrame(
            pa.table({"doc": doc[fit], "toxic": toxic[fit]}), "doc long, toxic long"
        )
        seen = texts.join(F.broadcast(mine), "doc")
        found = _score(seen.select("doc", "body"), sent, None).select("doc", *FEATURES).toArrow()
        at = np.searchsorted(doc[fit], found.column("doc").to_numpy())
        features = np.column_stack([found.column(c).to_numpy() for c in FEATURES])
        weights = logistic(features, toxic[fit][at])
    return _score(texts, sent, weights)
