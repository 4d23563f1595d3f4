"""Secrets in texts: three fixed forms, and random-looking strings told by Markov models.

The fixed forms are matched by patterns. Beside them every run of 20 or more characters
of an identifier or of an encoded string is scored by two character models of first
order, one of random strings and one of ordinary identifiers. A run is a secret if the
log-likelihood ratio summed over its transitions makes up for odds of one secret in
``min_odds`` runs.

Both models are trained on labelled samples. Ordinary are the distinct runs of 12 or more
characters in the corpus that have digits, if at all, at their end alone, as names have
and random strings hardly ever; random are the distinct values of the fixed forms, and ``n_random`` digests in four encodings, which keep the model fair
to alphabets that the corpus doesn't show. All runs of all texts count. A model is a
table of transitions between 66 characters, so it is of fixed size.

Positions are sums over the gaps and matches of a text, kept by a running sum over the
matches of one text; only these short rows are shuffled, never a text.

* A null or empty text has no spans. An empty table gives an empty table.
* Rows that agree in id and text get the same answer, and each comes back.
* Spans are code points, end exclusive, in order of start, then of kind as in ``KINDS``.
* Spans of the models never overlap spans of the fixed forms, which always stay.
* Extra columns, whatever their names, are ignored by ``scan``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from schemagauge.llm.columns import row_key, same_row, text_or_empty
from schemagauge.llm.storage import stored

#: The kinds in their order, and the forms of the first three.
KINDS = ("assign", "access", "hex", "markov")
ASSIGN = (
    "((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?"
    "([A-Za-z0-9+/_.=-]+)"
)
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]+"
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 6, 20, 24
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"

RUN = "[A-Za-z0-9+/_=-]"
# A run that is too short fails as a whole here, just as it does under the plain pattern.
_ACCESS = "AKIA[A-Z0-9]{%d,}" % (MIN_ACCESS - 4)
_HEX = "[0-9a-f]{%d,}" % MIN_HEX
# What labels a run as ordinary for the training.
_ORDINARY = "^[A-Za-z+/_=-]*[0-9]*$"


def _run(least: int) -> str:
    return f"(?<!{RUN}){RUN}{{{least},}}+"


def _matches(text: Column, kind: int, pattern: str, value: int = 0) -> Column:
    """An array of (kind, no, gap before, length, value) of all matches and of what is left."""
    group = lambda n: F.regexp_extract_all(text, F.lit(pattern), F.lit(n))
    found = F.arrays_zip(F.split(text, pattern, -1), group(0), group(value))

    def one(x, i):
        return F.struct(
            F.lit(kind).alias("kind"),
            i.alias("no"),
            F.char_length(x["0"]).alias("gap"),
            F.char_length(x["1"]).alias("size"),
            x["2"].alias("token"),
        )

    none = F.array().cast("array<struct<kind:int,no:int,gap:int,size:int,token:string>>")
    return F.when(F.rlike(text, F.lit(pattern)), F.transform(found, one)).otherwise(none)


def matches(docs: DataFrame, id_column: str, text_column: str, least: int) -> DataFrame:
    """A row per match: rid, rhash, kind, token, start, end. Rows that agree count once."""
    body = F.col("body")
    texts = docs.select(
        *row_key(id_column, text_column), text_or_empty(text_column).alias("body")
    )
    found = texts.select(
        "rid",
        "rhash",
        F.inline(
            F.concat(
                _matches(body, 0, ASSIGN, 2),
                _matches(body, 1, _ACCESS),
                _matches(body, 2, _HEX),
                _matches(body, 3, _run(least)),
            )
        ),
    ).filter("size is not null")
    one = (
        found.repartition("rid", "rhash")
        .groupBy("rid", "rhash", "kind", "no")
        .agg(*[F.first(c).alias(c) for c in ("gap", "size", "token")])
    )
    running = (
        Window.partitionBy("rid", "rhash", "kind")
        .orderBy("no")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    placed = one.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(running))
    right = (F.col("kind") != 0) | (F.char_length("token") >= MIN_ASSIGN)
    return placed.filter(right).select(
        "rid", "rhash", "kind", "token", (F.col("end") - F.col("size")).alias("start"), "end"
    )


def ordinary_samples(docs: DataFrame, text_column: str, least: int) -> DataFrame:
    """The distinct runs of the corpus that look like names, in column ``token``."""
    runs = F.regexp_extract_all(text_or_empty(text_column), F.lit(_run(least)), F.lit(0))
    tokens = docs.select(F.explode(runs).alias("token"))
    named = F.rlike("token", F.lit(_ORDINARY)) & ~F.rlike("token", F.lit(f"{_HEX}|{_ACCESS}"))
    return tokens.filter(named).distinct()


def random_samples(spark: SparkSession, n: int) -> DataFrame:
    """Digests of the numbers below ``n`` in hex, base64 and two alphabets of base32 size."""
    digest = F.sha2(F.col("id").cast("string"), 256)
    base64 = F.base64(F.unhex(digest))
    upper = F.upper(F.regexp_replace(base64, "[^A-Za-z0-9]", ""))
    forms = F.array(digest, base64, F.translate(base64, "+/", "-_"), upper)
    return spark.range(n).select(F.explode(forms).alias("token"))


def transitions(samples: DataFrame) -> DataFrame:
    """Counts of neighbouring characters, ``pair`` and ``n``, in column ``token``."""
    chars = samples.filter(F.char_length("token") >= 2).select(F.split("token", "").alias("c"))
    following = F.slice("c", F.lit(2), F.size("c") - 1)
    # The last character has none after it, so what it makes is null.
    pairs = chars.select(F.explode(F.zip_with("c", following, lambda a, b: F.concat(a, b))).alias("pair"))
    pairs = pairs.filter("pair is not null")
    return pairs.groupBy("pair").agg(F.count("*").alias("n"))


def log_ratios(random: dict[str, int], ordinary: dict[str, int], add: float = 0.5) -> dict[str, float]:
    """Of each pair of characters, log P(second | first, random) - log P(second | first, ordinary)."""

    def conditional(counts):
        total = {a: sum(counts.get(a + b, 0) for b in ALPHABET) + add * len(ALPHABET) for a in ALPHABET}
        return lambda a, b: (counts.get(a + b, 0) + add) / total[a]

    p, q = conditional(random), conditional(ordinary)
    return {a + b: math.log(p(a, b) / q(a, b)) for a in ALPHABET for b in ALPHABET}


def train(random: DataFrame, ordinary: DataFrame) -> dict[str, float]:
    """The ratios of two sets of labelled samples, each with a column ``token``.

    What comes to the driver is a count per pair of characters of the alphabet.
    """
    counts = [
        {r.pair: r.n for r in transitions(samples).filter(F.rlike("pair", F.lit(f"^{RUN}{{2}}$"))).collect()}
        for samples in (random, ordinary)
    ]
    return log_ratios(*counts)


def ratio(token: Column, ratios: dict[str, float]) -> Column:
    """The summed log-likelihood ratio of the transitions of an ASCII token."""
    table = [0.0] * (128 * 128)
    for pair, value in ratios.items():
        table[ord(pair[0]) * 128 + ord(pair[1])] = value
    table = F.lit(table)

    # One walk that holds the last character: to look each up in the token takes its whole length.
    start = F.struct(F.lit(0.0).alias("total"), F.lit(-1).alias("last"))

    def step(so_far, c):
        code = F.ascii(c)
        known = F.when(so_far["last"] < 0, 0.0).otherwise(F.get(table, so_far["last"] * 128 + code))
        return F.struct((so_far["total"] + known).alias("total"), code.alias("last"))

    return F.aggregate(F.split(token, ""), start, step, lambda end: end["total"])


def scan(
    docs: DataFrame,
    min_run: int = 20,
    min_sample: int = 12,
    min_odds: float = 1000.0,
    n_random: int = 2000,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """A row per row of ``docs``: its id as ``rid``, ``rhash`` and ``spans``.

    ``spans`` is an array of (start, no, kind, end), sorted.
    """
    spark = docs.sparkSession
    found = stored(matches(docs, id_column, text_column, min_run), "matches")
    fixed = found.filter("kind < 3").select("token").distinct()
    ordinary = ordinary_samples(docs, text_column, min_sample).join(fixed, "token", "left_anti")
    ratios = train(fixed.union(random_samples(spark, n_random)), ordinary)

    # Fixed spans, and runs that no fixed span overlaps: seen from both ends.
    where = Window.partitionBy("rid", "rhash")
    before = where.orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, 0)
    after = where.orderBy(F.desc("end"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, 0)
    is_fixed = F.col("kind") < 3
    around = (
        found.withColumn("left", F.max(F.when(is_fixed, F.col("end"))).over(before))
        .withColumn("right", F.min(F.when(is_fixed, F.col("start"))).over(after))
    )
    alone = (F.coalesce("left", F.lit(0)) <= F.col("start")) & (
        F.coalesce("right", F.col("end")) >= F.col("end")
    )
    likely = ratio(F.col("token"), ratios) >= math.log(min_odds)
    kept = around.filter(is_fixed | (alone & likely))
    names = F.array(*[F.lit(k) for k in KINDS])
    span = F.struct("start", F.col("kind").alias("no"), F.get(names, F.col("kind")).alias("kind"), "end")
    spans = kept.groupBy("rid", "rhash").agg(F.sort_array(F.collect_list(span)).alias("spans"))
    rows = docs.select(*row_key(id_column, text_column))
    empty = F.array().cast(spans.schema["spans"].dataType)
    return rows.join(spans, same_row(rows, spans), "left").select(
        rows["rid"], rows["rhash"], F.coalesce("spans", empty).alias("spans")
    )


def written(spans: Column) -> Column:
    """Spans as ``kind:start:end``, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
