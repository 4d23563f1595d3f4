import random

import duckdb
import numpy as np
import pytest

from schemagauge.llm import kernels, near_dedup, queries, quality_rules
from schemagauge.llm.oracles import ORACLES
from tests.llm import brute

SF = "/root/testdata/sf0.001"
ODD = [None, "", " \n\t", "a", "a b c", "a b c d e", "A  b\x0bc d\x0ce", "é è\xa0ê " * 30, "x " * 500, "𝄞#* $%\n" * 3]


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").collect()


def test_hashes_are_those_of_the_words_whatever_the_stretch(monkeypatch):
    texts = [t.encode() for t in ("the cat\nsat  on THE mat", "", "the mat on " + "y" * 3000, "mat")]
    whole = kernels.Words(texts)
    monkeypatch.setattr(kernels, "_STRETCH", 7)
    assert np.array_equal(whole.hashes, kernels.Words(texts).hashes)
    seen = {}
    for t, a, b in zip(texts, whole.bounds, whole.bounds[1:]):
        for w, h in zip(t.lower().split(), whole.hashes[a:b]):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_measures_and_verdicts(spark):
    rows = [tuple(r) for r in documents(spark)] + [(10_000 + i, t, "odd") for i, t in enumerate(ODD)]
    same = "This is the navigation of a site that every page of it repeats in full\n"
    rows += [(20_000 + i, same * 3 + " ".join(f"w{i}_{j}" for j in range(30)), "nav") for i in range(30)]
    rows += [(30_000 + i, same + " ".join(f"w{i}_{j}" for j in range(60)), None) for i in range(12)]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, n_words int")
    found = {r.rid: r for r in quality_rules.verdicts(frame.repartition(3)).collect()}
    expected = brute.verdicts([(d, h, t) for d, t, h in rows])
    assert len(found) == len(rows)
    for d, text, _ in rows:
        q = brute.quality(text)
        assert {m: found[d][m] for m in q} == q
        assert (found[d].n_removed, found[d].kept) == expected[d]
    assert sum(found[20_000 + i].n_removed > 0 for i in range(30)) == 29


def test_verdicts_of_repeated_rows_and_of_none(spark):
    schema = "doc_id long, text string, source string"
    rows = [(1, "a b", "h")] * 20 + [(None, "a b", "h"), (None, None, None)]
    found = quality_rules.verdicts(spark.createDataFrame(rows, schema)).collect()
    assert len(found) == 22 and {r.n_removed for r in found} == {0}
    assert quality_rules.verdicts(spark.createDataFrame([], schema)).count() == 0


def test_a_line_goes_by_its_share_of_the_documents_of_its_host(spark):
    line = "Home about contact and the other pages of this site"
    body = lambda h, i: "\n".join(" ".join(f"{h}{i}_{j}_{k}" for k in range(20)) for j in range(3))
    sizes = {"small": 40, "even": 48, "large": 60}  # the line is in 12 documents of each
    rows = [
        (1000 * n + i, body(h, i) + ("\n" + line) * (i < 36 and i % 3 == 0), h)
        for h, n in sizes.items()
        for i in range(n)
    ]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = {r.rid: (r.host, r.n_removed, r.kept) for r in quality_rules.verdicts(frame.repartition(3)).collect()}
    losing = {h: sum(n > 0 for host, n, _ in found.values() if host == h) for h in sizes}
    assert losing == {"small": 11, "even": 0, "large": 0}
    every = {r.rid: r.n_removed for r in quality_rules.verdicts(frame, max_share=0.0).collect()}
    assert sum(n > 0 for n in every.values()) == 33
    duck = duckdb.connect()
    duck.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    duck.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    told = duck.execute(f"SELECT doc_id, source, n_removed, kept FROM ({ORACLES['op9_quality_rules']}) JOIN documents USING (doc_id)")
    assert {d: (h, n, kept) for d, h, n, kept in told.fetchall()} == found


def components(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = near_dedup.near_duplicates(frame).collect()
    return {r.rid: (r.n_shingles, r.component) for r in found}


@pytest.mark.parametrize("changes", [7, 12])
def test_components_are_those_of_all_pairs(spark, changes):
    draw = random.Random(8)
    base = [f"w{i}" for i in range(200)]
    rows = [(i, t) for i, t in enumerate(ODD)]
    for family in range(3):
        for i in range(40):
            text = [f"f{family}_{w}" for w in base]
            for _ in range(draw.randrange(0, changes)):
                text[draw.randrange(200)] = f"new{draw.random()}"
            rows.append((100 + family * 100 + i, " ".join(text)))
    chain = [f"c{i}" for i in range(400)]  # each near the next, the ends far from each other
    rows += [(900 - i, " ".join(chain[10 * i : 10 * i + 100])) for i in range(25)]
    assert components(spark, rows) == brute.near(rows)


def test_components_of_repeated_rows_null_ids_and_none(spark):
    one, two = " ".join("abcdefghij"), " ".join("klmnopqrst")
    rows = [(5, one), (5, one), (5, two), (3, one), (9, two), (None, one), (7, None), (8, "")]
    found = components(spark, rows)
    assert {d: c for d, (_, c) in found.items()} == {5: 3, 3: 3, 9: 3, None: None, 7: 7, 8: 8}
    assert components(spark, []) == {}


def test_queries_on_the_table(spark):
    rows = documents(spark)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op10_near_dedup(spark, SF).collect()}
    assert found == brute.near([(r.doc_id, r.text) for r in rows])


def test_signatures_of_large_unrelated_sets_differ(spark):
    rows = [(i, " ".join(f"{c}{j}" for j in range(2000))) for i, c in enumerate("ab")]
    one, two = near_dedup.sketches(spark.createDataFrame(rows, "doc_id long, text string"), 5, "doc_id", "text").collect()
    assert sum(x == y for x, y in zip(one.sig, two.sig)) < 10
