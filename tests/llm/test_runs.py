import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from schemagauge.llm import periodic_runs, queries
from tests.llm import brute

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string"


def plain_runs(w, min_words=24, min_times=3):
    """By all periods: stretches that agree with themselves, and whose smallest period that is."""
    out, n = [], len(w)
    for q in range(1, n // min_times + 1):
        i = 0
        while i < n - q:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if length >= max(min_words, min_times * q):
                stretch = w[i : i + length]
                if not any(stretch[p:] == stretch[:-p] for p in range(1, q)):
                    out.append((i, length, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_collapsed(w, runs):
    gone = {i for start, length, q in runs for i in range(start + q, start + length)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def odd_texts():
    draw = random.Random(4)
    texts = [None, "", " \n\t", "x", "x " * 23, "x " * 24, "x  x\x0b" * 300, "a b " * 12, "a b " * 11 + "a", "a b c d e f g h " * 3]
    texts += ["é ê " * 30, " ".join("abaababaabaab" * 20)]
    fib = ["a", "ab"]
    while len(fib[-1]) < 400:
        fib.append(fib[-1] + fib[-2])
    texts.append(" ".join(fib[-1]))
    for _ in range(150):
        parts = []
        for _ in range(draw.randrange(1, 5)):
            unit = [draw.choice("abcd") * draw.randrange(1, 3) for _ in range(draw.randrange(1, 14))]
            times = draw.randrange(1, 9)
            parts += unit * times + unit[: draw.randrange(len(unit))]
            parts += [draw.choice("abcd") for _ in range(draw.randrange(6))]
        if draw.random() < 0.3:
            parts = parts * 3  # runs of runs
        texts.append(draw.choice([" ", "\n", "  "]).join(parts))
    texts += [" ".join(draw.choice("ab") for _ in range(300)) for _ in range(20)]
    texts += [" ".join(f"w{i % 40}" for i in range(170)) + " end " + " ".join("xy"[i % 2] for i in range(60))]
    return texts


def test_runs_are_those_of_all_periods():
    texts = odd_texts()
    found = periodic_runs.find_runs([(t or "").encode() for t in texts])
    n = 0
    for t, runs in zip(texts, found):
        w = brute.words(t, fold=False)
        assert runs == plain_runs(w), t
        assert periodic_runs.collapsed((t or "").encode(), runs).decode() == plain_collapsed(w, runs)
        n += len(runs)
    assert n > 100


@pytest.mark.parametrize("min_words, min_times", [(3, 3), (10, 5), (40, 4)])
def test_other_limits(min_words, min_times):
    texts = odd_texts()
    found = periodic_runs.find_runs([(t or "").encode() for t in texts], min_words, min_times)
    for t, runs in zip(texts, found):
        assert runs == plain_runs(brute.words(t, fold=False), min_words, min_times), t


def test_suffixes_are_sorted():
    draw = random.Random(1)
    texts = [[draw.randrange(2) for _ in range(draw.randrange(40))] for _ in range(30)] + [[0] * 50]
    bounds = np.cumsum([0] + [len(t) for t in texts])
    words = np.array([10 * i + x for i, t in enumerate(texts) for x in t])
    ends = np.repeat(bounds[1:], np.diff(bounds))
    array, common = periodic_runs.sorted_suffixes(words, ends)
    suffixes = [words[i : ends[i]].tolist() for i in array]
    assert suffixes == sorted(suffixes) and sorted(array.tolist()) == list(range(len(words)))
    for a, b, n in zip(suffixes, suffixes[1:], common.tolist()):
        assert a[:n] == b[:n] and (len(a) == n or len(b) == n or a[n] != b[n])


def test_classes_name_new_neighbours():
    draw = random.Random(2)
    classes, sets = periodic_runs.Classes(), [{i} for i in draw.sample(range(500), 200)]
    while len(sets) > 1:
        a, b = sets.pop(draw.randrange(len(sets))), sets.pop(draw.randrange(len(sets)))
        neighbours = lambda s: set(zip(sorted(s), sorted(s)[1:]))
        pairs = classes.unite(min(a), max(b))
        assert len(pairs) == len(set(pairs)) and set(pairs) == neighbours(a | b) - neighbours(a) - neighbours(b)
        sets.append(a | b)


def test_a_long_text_of_one_word_and_of_a_long_period():
    n = 400_000
    one, many = b"x " * n, b" ".join(b"%d" % (i % 70_001) for i in range(n))
    assert periodic_runs.find_runs([one, many]) == [[(0, n, 1)], [(0, n, 70_001)]]


def test_rows_ids_and_none(spark):
    rows = [(1, "x " * 30, 5), (1, "x " * 30, 5), (None, "x " * 30, 5), (2, None, None)]
    frame = spark.createDataFrame(rows, SCHEMA + ", runs int").repartition(2)
    found = periodic_runs.collapse_runs(frame).collect()
    assert sorted((str(r.rid), [tuple(x) for x in r.runs], r.collapsed) for r in found) == [
        ("1", [(0, 30, 1)], "x"), ("1", [(0, 30, 1)], "x"), ("2", [], ""), ("None", [(0, 30, 1)], "x"),
    ]
    assert periodic_runs.collapse_runs(frame.limit(0)).count() == 0
    named = spark.createDataFrame([("k", "x " * 30)], "doc_id string, text string")
    assert periodic_runs.collapse_runs(named).first().rid == "k"


def test_most_periodic_of_exact_fractions(spark):
    runs = [(0, 3 * 10**8 + 1, 10**8), (5, 24, 8), (7, 3 * 10**8 + 2, 10**8), (9, 3 * 10**8 + 2, 10**8)]
    frame = spark.createDataFrame([(runs,), ([],)], "runs array<struct<start:long,length:long,period:long>>")
    found = frame.select(periodic_runs.most_periodic(F.col("runs")).alias("b")).collect()
    assert tuple(found[0].b) == runs[2] and found[1].b is None


def expected(doc, text):
    w = brute.words(text, fold=False)
    h, n = zlib.crc32(str(doc).encode()), len(w)
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]
    runs = plain_runs(w)
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if runs else (None,) * 3
    milli = 1000 * best[1] // best[2] if runs else None
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    return len(runs), *best, milli, brute.sha(listed), brute.sha(plain_collapsed(w, runs))


def test_query_on_the_table(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    found = {r.doc_id: tuple(r)[1:] for r in queries.op13_periodic_runs(spark, SF).collect()}
    assert len(found) == len(rows) and sum(r[0] > 0 for r in found.values()) > 5
    short = [r for r in rows if len(r.text or "") < 8000]
    assert len(short) > len(rows) / 2
    for r in short:
        assert found[r.doc_id] == expected(r.doc_id, r.text), r.doc_id
