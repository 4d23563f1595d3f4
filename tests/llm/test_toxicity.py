import math
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from schemagauge.llm import queries, toxicity

SF = "/root/testdata/sf0.1"
ODD = [None, "", " \n", "a", "x" * 3000, "é 𝄞 idiot\x00b", "The THE the"]


def plain_ratios(docs, labels, words):
    """The ratio of each word by dictionaries of the grams themselves."""
    own, above = {0: defaultdict(int), 1: defaultdict(int)}, defaultdict(set)

    def each(word):
        padded = b" " + word + b" "
        for j in range(1, len(padded)):
            yield padded[max(0, j - 5) : j + 1]

    for d, text in docs:
        for word in (text or "").lower().encode().split():
            for g in each(word):
                if d in labels:
                    own[labels[d]][g] += 1
                for i in range(1, len(g)):
                    above[g[i:]].add(g[i - 1])
    shared = {g: len(s) for g, s in above.items()}

    def context(counts):
        total, types = defaultdict(int), defaultdict(int)
        for g, n in counts.items():
            total[len(g), g[:-1]] += n
            types[len(g), g[:-1]] += 1
        return lambda g, p: (
            (max(counts.get(g, 0) - 0.75, 0) + 0.75 * types[len(g), g[:-1]] * p) / total[len(g), g[:-1]]
            if total[len(g), g[:-1]]
            else p
        )

    low, toxic, ordinary = map(context, (shared, own[1], own[0]))
    out = []
    for word in words:
        ratio = 0.0
        for g in each(word):
            p = 1 / 256
            for i in range(len(g) - 1, 0, -1):
                p = low(g[i:], p)
            ratio += math.log(toxic(g, p)) - math.log(ordinary(g, p))
        out.append(ratio)
    return out


def test_models_are_those_of_plain_counts(spark):
    docs = [(i, f"good day number {i} to you and yours") for i in range(20)]
    docs += [(100 + i, f"you are an idiot number {i} and a moron") for i in range(9)] + [(200, "an idea of mine")]
    labels = {i: int(i >= 100) for i, _ in docs if i != 200}
    frame = spark.createDataFrame(docs, "doc long, body string").repartition(3)
    ids = np.array(sorted(labels))
    model = toxicity.train(frame, ids, np.array([labels[i] for i in ids]))
    words = [b"idiot", b"good", b"idea", b"unseen", b"morons", b"a"]
    found = toxicity.word_ratios(model, words)
    assert found == pytest.approx(plain_ratios(docs, labels, words), abs=0.02)
    assert found[0] > 3 > 0 > found[1]


def test_held_out_accuracy_and_that_held_out_labels_are_not_read(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in queries.op7_toxicity(spark, SF).collect()}
    assert len(rows) == docs.count()
    for d, r in rows.items():
        assert r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    pairs = [(rows[x.doc_id], x.toxic) for x in labels.collect()]
    held = [(r.score, y) for r, y in pairs if r.held_out]
    wins = [(a > b) + (a == b) / 2 for a, y in held if y for b, z in held if not z]
    # Nearly half of the toxic labels of this table stand beside ordinary text.
    assert sum(wins) / len(wins) > 0.68
    turned = labels.withColumn("toxic", F.when(toxicity.fold_of("doc_id") == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity.scores(docs, turned.withColumn("score", F.lit(1))).collect()
    assert {r.doc: r.score for r in again} == pytest.approx({d: r.score for d, r in rows.items()}, abs=1e-9)


def test_scores_of_odd_texts_and_of_no_labels(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)] + [(0, None), (None, "idiot")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, None), (2, 1), (2, 0), (None, 1)], "doc_id long, toxic int")
    found = toxicity.scores(docs, labels).collect()
    assert len(found) == len(ODD) + 2 and {r.score for r in found} == {0.0}
    assert toxicity.scores(docs.limit(0), labels).count() == 0


def test_rare_toxic_words_count_beside_many_ordinary_ones(spark):
    """Held-out texts of every language, by the table's own labels."""
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = [r for r in queries.op7_toxicity(spark, SF).collect() if r.held_out and r.doc_id in labels]
    toxic, clean = (np.array([r.score for r in rows if labels[r.doc_id] == y]) for y in (1, 0))
    area = ((toxic[:, None] > clean).mean() + (toxic[:, None] >= clean).mean()) / 2
    assert area > 0.95
