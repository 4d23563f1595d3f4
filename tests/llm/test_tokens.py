import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from schemagauge.llm import decontaminate, packing, queries, token_files, tokens
from tests.llm import brute

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string"
ODD = [None, "", " \n\t", "The the THE, the. <|endoftext|> <|ENDOFTEXT|>", "don't I'LL 've.x", "é́. É, ß? İx. ſ!",
       "日本語。テキスト, \x85a\xa0b　c", "a" * 5000, "𝄞 ١٢٣ x1.5; 10,000:", "x́. x̸, .̸ kK."]


def table(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def plain():
    tokenizer = Tokenizer.from_file(tokens.default_path())
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_ids_are_those_of_the_whole_text(spark, plain, monkeypatch):
    texts = [t or "" for _, t in table(spark)] + [t or "" for t in ODD]
    for remembered in (600_000, 50):
        monkeypatch.setattr(tokens, "REMEMBERED", remembered)
        own = tokens.Encoder(tokens.default_path())
        for text in texts:
            assert np.frombuffer(own.encode([text.encode()])[0], "<u4").tolist() == plain(text)


def test_packing(spark, plain):
    rows = table(spark) + [(10_000 + i, t) for i, t in enumerate(ODD)] + [(0, "again"), (None, "x"), (None, "x")]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumn("ids", F.lit(1))
    for shard in (50_000, 60):
        found = packing.pack(packing.pieces(frame), len(rows), shard=shard)
        joined = {r.sequence_id: r.ids for r in packing.sequences(found).collect()}
        bins, docs = {}, {}
        for r in found.collect():
            assert bytes(joined[r.sequence_id][4 * r.offset : 4 * (r.offset + r.length)]) == bytes(r.ids)
            bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
            docs.setdefault((r.rid, r.rhash), []).append((r.piece, r.start, r.length, bytes(r.ids)))
        for places in bins.values():
            at = 0
            for offset, length in sorted(places):
                assert offset == at and length > 0
                at += length
            assert at <= 2048
        expected = sorted(crc([*plain(t), 0]) for _, t in set(rows))
        assert sorted(zlib.crc32(b"".join(x[3] for x in sorted(set(d)))) for d in docs.values()) == expected
        total = sum(len(plain(t)) + 1 for _, t in rows)
        assert len(bins) <= -(-total // 2048) + (1 if shard == 50_000 else 5)
    assert packing.pack(packing.pieces(frame.limit(0)), 0).count() == 0


def test_best_two_fit_against_the_lower_bound_and_first_fit():
    draw = np.random.default_rng(1)
    for lengths in (draw.integers(1, 2049, 3000), draw.integers(700, 1400, 999), np.full(50, 1000), np.array([2048, 1])):
        sequence, offset = packing.best_two_fit(lengths, 2048)
        filled = np.bincount(sequence, lengths)
        assert filled.max() <= 2048
        first_fit = []
        for x in sorted(lengths.tolist(), reverse=True):
            i = next((i for i, b in enumerate(first_fit) if b + x <= 2048), len(first_fit))
            first_fit[i : i + 1] = [(first_fit[i] if i < len(first_fit) else 0) + x]
        assert len(filled) <= len(first_fit)


def test_best_two_fit_replaces_the_smallest():
    # Greedily 60 + 30 leaves 10; 38 + 2 fits the place of 30 and the gap exactly.
    sequence, _ = packing.best_two_fit(np.array([60, 30, 21, 19]), 100)
    assert sequence.tolist() == [0, 1, 0, 0]


@pytest.mark.parametrize("bits", [False, True])
def test_token_files_round_trip(spark, plain, tmp_path, bits):
    rows = table(spark) + [(10_000 + i, t) for i, t in enumerate(ODD)] + [(10_000, "again"), (None, "x")]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5).withColumn("shard", F.lit(1))
    folder = f"file://{tmp_path}/tokens"
    token_files.write_tokens(frame, folder, shards=4, bit_planes=bits, block=1000, chunk=5000)
    found = sorted(token_files.read_tokens(spark, folder).collect(), key=lambda r: r.start)
    ids = [-1 if r.doc_id is None else r.doc_id for r in found]
    assert ids == sorted(ids) and len(ids) == len(rows)
    at = 0
    for r in found:
        assert (r.start, len(r.ids)) == (at, 4 * r.n_tokens)
        at += r.n_tokens
    assert sorted(zlib.crc32(r.ids) for r in found) == sorted(crc([*plain(t), 1]) for _, t in rows)
    index = spark.read.parquet(f"{folder}/index")
    assert index.count() > 4 and index.agg(F.sum("n_ids")).first()[0] == at
    token_files.write_tokens(frame.limit(0), f"{folder}-none", shards=4)
    assert token_files.read_tokens(spark, f"{folder}-none").count() == 0


def contained(docs, items, percent=75):
    out = set()
    for i, t in items:
        s = brute.shingles(t)
        for d, text in docs:
            both = len(s & brute.shingles(text))
            if both and 100 * both >= percent * len(s):
                out.add((d, i, len(s), both))
    return out


def test_containment_is_that_of_all_pairs(spark):
    docs, draw = table(spark), random.Random(4)
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    source = " ".join(t for _, t in docs[:20]).split()
    for i in range(60):  # short and long items, with words changed
        at, n = draw.randrange(len(source) - 200), draw.choice([3, 5, 6, 7, 8, 20, 60, 150])
        words = source[at : at + n]
        for _ in range(draw.randrange(3)):
            words[draw.randrange(n)] = "changed"
        items.append((1000 + i, " ".join(words).upper()))
    docs += [(10_000 + i, t) for i, t in enumerate(ODD)] + [(50_000 + i, t) for i, (_, t) in enumerate(items)]
    docs += [(60_000, " ".join(source))]
    items += [(2000, None), (2001, ""), (2002, "a")]
    found = decontaminate.contained_items(
        spark.createDataFrame(docs, SCHEMA).repartition(3).withColumn("item", F.lit(1)),
        spark.createDataFrame(items, "item_id long, text string").withColumn("h", F.lit(1)),
    )
    assert {tuple(r) for r in found.collect()} == contained(docs, items)


def test_containment_of_repeated_rows_and_of_none(spark):
    one = " ".join("abcdefgh")
    docs = spark.createDataFrame([(1, one), (1, one), (None, one), (2, None)], SCHEMA)
    items = spark.createDataFrame([(5, one), (5, one), (None, one)], "item_id long, text string")
    assert [tuple(r) for r in decontaminate.contained_items(docs, items).collect()] == [(1, 5, 4, 4)]
    assert decontaminate.contained_items(docs.limit(0), items).count() == 0
    assert decontaminate.contained_items(docs, items.limit(0)).count() == 0


def test_queries_on_the_table(spark, plain):
    rows = dict(table(spark))
    files = {r.doc_id: r for r in queries.op6_token_files(spark, SF).collect()}
    start = 0
    for d in sorted(rows):
        ids = [*plain(rows[d]), 1]
        assert (files[d].start, files[d].n_tokens, files[d].ids_crc32) == (start, len(ids), crc(ids))
        start += len(ids)
    assert {r.doc_id for r in queries.op4_packing(spark, SF).collect()} == set(rows)


def test_other_tokenizers_get_whole_texts():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    plain, found = Tokenizer.from_file(path), tokens.Encoder(path)
    texts = ["Two  words,  Ünd\n\nmore: ABC abc", "", "x" * 50]
    assert not found.by_words and tokens.Encoder(tokens.default_path()).by_words
    for t, ids in zip(texts, found.encode([t.encode() for t in texts])):
        assert np.frombuffer(ids, "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids


def test_letters_of_all_kinds():
    from tokenizers import Tokenizer

    plain, found = Tokenizer.from_file(tokens.default_path()), tokens.Encoder(tokens.default_path())
    words = [chr(c) * 2 + "ab" + chr(c) for c in range(33, 700) if not chr(c).isspace()]
    words += ["ÀÖØÞ", "ßöøÿ", "ét", "µm", "ªº", "İi", "ΑΣ.", "straße!", "é,", "é%%%", "a,###", "x''", "<|a|>", "abc<|", "don't", "l'été"]
    for w, ids in zip(words, found.encode([w.encode() for w in words])):
        assert np.frombuffer(ids, "<u4").tolist() == plain.encode(w, add_special_tokens=False).ids, w
