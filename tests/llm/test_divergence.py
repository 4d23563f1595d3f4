import random
import re

import pytest
from pyspark.sql import functions as F

from schemagauge.llm import divergence, joins
from tests.llm import brute

SCHEMA = "text string, lang string, source string"


def plain(rows, min_docs=3, top=200):
    """(text, lang, source) rows to the rows of the report."""
    terms = lambda t: re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", (t or "").translate(brute.LOWER))
    docs = [(terms(t), lang or "", source or "") for t, lang, source in rows]
    out = []
    f = lambda p, q: (p - q) ** 2 // q
    for lang in {x[1] for x in docs}:
        mine = [x for x in docs if x[1] == lang]
        holders = {}
        for w, _, _ in mine:
            for t in set(w):
                holders[t] = holders.get(t, 0) + 1
        kept = sorted(t for t, n in holders.items() if n >= min_docs)

        def shares(some):
            n = dict.fromkeys(kept, 0)
            for w, _, _ in some:
                for t in w:
                    if t in n:
                        n[t] += 1
            total = sum(n.values())
            return n, {t: 1 + 10**9 * (n[t] + 1) // (total + len(kept)) for t in kept}

        _, q = shares(mine)
        by = {s: shares([x for x in mine if x[2] == s]) for s in {x[2] for x in mine}}
        for s, (n, p) in by.items():
            pairs = [(-sum(f(p[t], other[t]) for t in kept), o) for o, (_, other) in by.items() if o != s]
            more = [(-f(p[t], q[t]), t) for t in kept if n[t] and p[t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(more, key=lambda x: (x[0], x[1].encode()))[:top])):
                out += [(lang, s, part, item, -v, i + 1) for i, (v, item) in enumerate(found)]
    return sorted(out)


def odd_rows():
    draw = random.Random(7)
    words = [f"{a}{b}" for a in ("the", "é", "ß", "漢", "zz", "Q") for b in "abcdefghij"] + ["𝄞", "ı", "K"]
    rows = [(None, None, None), ("", "", ""), ("1 2 3", "xx", "only"), ("the thea", "xx", None), ("once", "yy", "s")]
    for _ in range(300):
        lang, source = draw.choice(["en", "fr", None]), draw.choice(["a", "b", "c", "hot", "hot", "hot", "é", None])
        own = words[: draw.randrange(3, len(words))]
        seps = [" ", "\n", "-", "_", "3", "\x7f", ", "]
        rows.append(("".join(draw.choice(own) + draw.choice(seps) for _ in range(draw.randrange(60))), lang, source))
    rows += [("nothing kept here", "zz", f"s{i}") for i in range(2)] + [("1", "en", "empty")]
    rows += [("équi tie tie2 tieb tiea", "tt", s) for s in "xyz"] + [("other words", "tt", "w")] * 4
    return rows + rows[10:15]


@pytest.mark.parametrize("bits, top, share", [(64, 200, 1000), (4, 5, 3), (0, 2, 1000)])
def test_reports_are_the_plain_ones(spark, monkeypatch, bits, top, share):
    monkeypatch.setattr(joins, "SHARE", share)
    monkeypatch.setattr(divergence, "_PAIRS", 50)
    rows = odd_rows()
    frame = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], SCHEMA + ", digest int").repartition(5)
    found = divergence.divergence(frame, top=top, bits=bits).collect()
    assert sorted(map(tuple, found)) == plain(rows, top=top)


def test_nothing(spark):
    assert divergence.divergence(spark.createDataFrame([], SCHEMA)).count() == 0
    one = divergence.divergence(spark.createDataFrame([(None, None, None), ("a", None, "s")], SCHEMA)).collect()
    assert sorted(map(tuple, one)) == [("", "", "pair", "s", 0, 1), ("", "s", "pair", "", 0, 1)]


def test_counts_that_no_long_holds(spark):
    big = spark.range(1).select(F.lit(9 * 10**17).alias("n"), F.lit(10**18).alias("t"))
    p = big.select(divergence.share(F.col("n"), F.col("t"), F.lit(5).cast("long"))).first()[0]
    assert p == 1 + 10**9 * (9 * 10**17 + 1) // (10**18 + 5)
    f = spark.range(1).select(divergence.difference(F.lit(10**9 + 1), F.lit(1).cast("long"))).first()[0]
    assert f == 10**18


def test_strings_stay_where_texts_are_read(spark, monkeypatch):
    """What is counted and joined holds digests; strings come to the dictionary once a task."""
    rows = [(f"alpha beta gamma delta {i % 3}", "en", "s") for i in range(400)]
    frame = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("text", "body").repartition(2)
    found, words = divergence.counts(frame.select("lang", "source", "body"))
    assert {r.term for r in found.collect()} == {""} and words.count() == 4
    assert sorted((r.n, r.docs) for r in found.collect()) == [(400, 400)] * 4


def test_terms_are_counted_by_numbers_alone(spark, monkeypatch):
    """Languages and sources are strings in no row that a term makes."""
    made = []
    monkeypatch.setattr(divergence, "stored", lambda df, name: made.append((name, df)) or df)
    frame = spark.createDataFrame(odd_rows(), SCHEMA).withColumnRenamed("text", "body").na.fill("")
    found, _ = divergence.counts(frame)
    assert dict(found.dtypes) | {"lang_no": "bigint", "source_no": "bigint"} == dict(found.dtypes)
    plan = made[-1][1]._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"HashAggregate\(keys=\[lang_no#\w+, source_no#\w+, digest#\w+\]", plan)
    pairs = {(r.lang or "", r.source or "") for r in frame.collect()}
    numbers = divergence.numbered(frame).select("lang_no", "source_no").distinct().collect()
    assert len(numbers) == len(pairs)
