import corpus_pipeline
from schemagauge.llm import stages, tokens
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def plain(docs, items):
    """(doc_id, text, source) rows through the four filters."""
    kept = brute.verdicts([(d, s, t) for d, t, s in docs])
    rows = [(d, t) for d, t, _ in docs if kept[d][1]]
    rows = [(d, text) for d, _, _, text in brute.line_dedup(rows)]
    near = brute.near(rows)
    rows = [(d, t) for d, t in rows if near[d][1] == d]
    sets = [s for s in (brute.shingles(t) for _, t in items) if s]
    return [(d, t) for d, t in rows if not any(4 * len(s & brute.shingles(t)) >= 3 * len(s) for s in sets)]


def test_pipeline_is_its_plain_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text", "source").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    expected = plain(rows, items)
    assert 0 < len(expected) < len(rows)
    found = corpus_pipeline.run(spark, SF).collect()
    encoder = tokens.encoder(tokens.default_path())
    sizes = {d: len(encoder.encode([t.encode()])[0]) // 4 + 1 for d, t in expected}
    lengths = {}
    for r in found:
        lengths[r.doc_id] = lengths.get(r.doc_id, 0) + r.length
    assert lengths == sizes


def test_stages_keep_columns_and_odd_rows(spark):
    good = " ".join(f"word{i}" for i in range(80))
    other = " ".join(f"other{i}" for i in range(80))
    rows = [(1, good, "en", None, 1, "k"), (1, good, "en", None, 1, "k"), (2, good, "en", "s", 1, "k"),
            (None, other, None, "s", None, "k"), (3, None, "en", "s", 1, "k"), (4, other, "en", "s", 1, "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string")
    ids = lambda df: sorted((r.doc_id for r in df.collect()), key=str)
    first = stages.quality(docs)
    assert first.columns == docs.columns and ids(first) == [1, 1, 2, 4, None]
    assert stages.lines(first).columns == docs.columns and stages.lines(first).count() == 5
    near = stages.near(first)
    assert near.columns == docs.columns and ids(near) == [1, 4, None]
    items = spark.createDataFrame([(7, good[:200])], "item_id long, text string")
    clean = stages.benchmark(near, items)
    assert clean.columns == docs.columns and ids(clean) == [4, None]
    for stage in (stages.quality, stages.lines, stages.near, stages.packed):
        assert stage(docs.limit(0)).count() == 0
    assert stages.benchmark(docs.limit(0), items).count() == 0


def test_quality_takes_the_lines_of_a_host_out_of_the_texts(spark):
    line = "Home  About\tContact us"
    body = lambda i: [" ".join(f"w{i}_{j}_{k}" for k in range(30)) for j in range(3)]
    texts = {}
    for i in range(30):
        a, b, c = body(i)
        texts[i] = [line, a, "", b, line.upper(), c, line][: 7 - i % 2]
    rows = [(i, "\n".join(t), "h", i) for i, t in texts.items()]
    rows += [(100, "\n".join(texts[5]), "other", 1), (7, "\n".join(texts[7]), "other", 1), (7, "\n".join(texts[7]), "h", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, gone int").repartition(3)
    found = sorted((r.doc_id, r.source, r.text) for r in stages.quality(docs).collect())
    fold = lambda x: x.lower().split()
    left = {i: "\n".join(x for x in t if i == 0 or fold(x) != fold(line)) for i, t in texts.items()}
    expected = [(i, h, left[i] if h == "h" else text) for i, text, h, _ in rows]
    assert found == sorted(expected)
    assert stages.quality(docs).columns == docs.columns


def test_columns_that_clash_and_texts_that_share_an_id(spark):
    texts = [" ".join(f"{c}{i}" for i in range(80)) for c in "abcd"]
    rows = [(1, t, "en", "s", 1, "x", "y") for t in texts] + [(2, texts[0], "en", None, 1, None, None)]
    names = "doc_id long, text string, lang string, source string, n_chars long, found string, found_ string"
    docs = spark.createDataFrame(rows, names)
    first = stages.quality(docs)
    assert first.columns == docs.columns and sorted(map(str, first.collect())) == sorted(map(str, docs.collect()))
    kept = [sorted((r.doc_id, r.text) for r in stages.near(docs.repartition(n)).collect()) for n in (1, 5)]
    assert kept[0] == kept[1] and [d for d, _ in kept[0]] == [1]
