import random

import numpy as np
import pytest

from schemagauge.llm import queries, storage, suffix_dedup
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def documents():
    draw = random.Random(6)
    letters = "abcé "
    passage = "".join(draw.choice(letters) for _ in range(900))
    short = "".join(draw.choice(letters) for _ in range(395))
    texts = [None, "", "x" * 399, "y" * 401, "z" * 1500, "ab" * 700, "\0" * 500, "\0é" * 300, passage]
    for _ in range(60):
        text = "".join(draw.choice(letters) for _ in range(draw.randrange(700)))
        for _ in range(draw.randrange(3)):
            a, b = sorted(draw.randrange(901) for _ in range(2))
            at = draw.randrange(len(text) + 1)
            text = text[:at] + draw.choice([passage, passage[a:b], short]) + text[at:]
        texts.append(text)
    return texts + texts[20:25]


@pytest.mark.parametrize("hot, batch", [(2000, 2_000_000), (1, 3000)])
def test_cuts_are_those_of_all_windows(spark, hot, batch, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    texts = documents()
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    found = {r.rid: (r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.cut_repeats(frame).collect()}
    for i, (_, removed, n_spans, kept) in enumerate(brute.repeats(texts)):
        assert found.pop(i, (0, 0, (texts[i] or "").encode())) == (removed, n_spans, kept)
    assert not found


def test_suffixes_are_sorted(monkeypatch):
    draw = random.Random(2)
    for alphabet in (b"ab", bytes(range(256)), b"\0\1", b"a"):
        stretches = [bytes(draw.choice(alphabet) for _ in range(draw.randrange(30, 300))) for _ in range(20)]
        stretches += [stretches[0][:25] + b"q" * 20]
        windows = [len(s) - 19 for s in stretches]
        text, array = suffix_dedup.suffix_array(stretches, windows, 20)
        starts = np.cumsum([0] + [len(s) + 1 for s in stretches])
        content = {}
        for s, start, n in zip(stretches, starts.tolist(), windows):
            content |= {start + i: s[i : i + 20] for i in range(n)}
        ranked = [content[i] for i in array.tolist() if i in content]
        assert ranked == sorted(content.values())
        flags = suffix_dedup.repeated_windows(stretches, windows, 20)
        for s, n, f in zip(stretches, windows, flags):
            all_of = list(content.values())
            assert f.tolist() == [all_of.count(s[i : i + 20]) > 1 for i in range(n)]


def test_runs_of_long_texts(monkeypatch):
    draw = random.Random(2)
    text = bytes(draw.randrange(97, 100) for _ in range(5000))
    whole = suffix_dedup.runs(text, 400)
    monkeypatch.setattr(suffix_dedup, "_SPAN", 1000)
    parts = suffix_dedup.runs(text, 400)
    spread = lambda r: [(int(h), f + i, d - i) for h, f, d, n in zip(*r) for i in range(n)]
    assert spread(whole) == spread(parts) and len(spread(parts)) == 4601


def test_query_on_the_table_and_on_none(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    found = {r.doc_id: tuple(r)[1:] for r in queries.op8_suffix_dedup(spark, SF).collect()}
    for r, (n, removed, n_spans, kept) in zip(rows, brute.repeats([r.text for r in rows])):
        assert found[r.doc_id] == (n, removed, n_spans, brute.sha(kept))
    none = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_dedup.cut_repeats(none).count() == 0
    twice = spark.createDataFrame([(1, "abc" * 150 + str(2**4000))] * 2 + [(None, "k" * 300)], "doc_id long, text string")
    assert {(r.rid, r.n_removed) for r in suffix_dedup.cut_repeats(twice).collect()} == {(1, 450 + 1205)}


def test_equal_stretches_are_gathered_once(spark, monkeypatch):
    draw = random.Random(3)
    passage = "".join(draw.choice("abcdef ") for _ in range(900))
    texts = [f"{i} {passage} {i * 7}" for i in range(60)] + [passage] * 40
    gathered = []
    plain = suffix_dedup._placed
    monkeypatch.setattr(suffix_dedup, "SHARE", 7)
    monkeypatch.setattr(suffix_dedup, "_placed", lambda dealt, decided, distinct: gathered.append((dealt, distinct)) or plain(dealt, decided, distinct))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    found = {r.rid: (r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.cut_repeats(frame).collect()}
    assert found == {i: r[1:] for i, r in enumerate(brute.repeats(texts))}
    dealt, distinct = gathered[0]
    assert distinct.count() == dealt.select("key", "known").distinct().count() < dealt.count() / 2
    assert distinct.agg({"times": "sum"}).first()[0] == dealt.count()


def test_tables_are_written_small(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(storage, "shared_folder", lambda _: str(tmp_path))
    frame = spark.createDataFrame(list(enumerate(documents())), "doc_id long, text string")
    assert suffix_dedup.cut_repeats(frame).count()
    written = [p for p in tmp_path.rglob("*.parquet") if p.is_file()]
    assert written and all(p.name.endswith(".zstd.parquet") for p in written)
