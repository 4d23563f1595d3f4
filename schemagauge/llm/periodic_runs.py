"""Periodic runs of words, found by uniting classes of suffixes, and texts without the repeats.

A run is a stretch of words in which words ``q`` apart are identical, ``q`` being the smallest
such number, that no neighbouring word extends. It counts if it has at least ``min_words``
words and ``min_times`` times its period.

Suffixes that agree in their first words are a class. Adjacent suffixes of the sorted order
are joined by decreasing common prefix, as Kruskal joins edges: a union-find holds the classes,
each with its positions in order. Where two classes become one at prefix length ``l``, positions
``a`` and ``b`` that are now neighbours there, and weren't before, agree in exactly ``l`` words.
If ``b - a <= l``, the words from ``a`` on repeat with the smallest period ``b - a``: a smaller
one would have put a position between them into the class, earlier. If the words before them
differ, that is where the run begins, and its length is ``b - a + l``. As a run of length ``n`` and
period ``q`` shows at its start, at ``l = n - q``, each is found once, and none is missed.

Only joins at ``l >= (min_times - 1) / min_times * min_words`` can matter. Before any suffix is
sorted, texts are left out in which no window of some length ``2**k`` comes twice at a distance
below ``2**k``, which holds for each run of three periods; windows are hashed for a batch of texts at
once, and suffixes sorted by prefix doubling. Nothing is shuffled: a text is one row's work, of
some 100 bytes per word where it has runs and 30 where not.

* Words are told apart by a 64-bit hash within a text. A null or empty text has no words and no runs.
* Rows that agree get the same answer, and each comes back. Ids may be null or of any type.
* Runs are in order of start, then of period, and may overlap. A text of any length is whole.
* Extra columns, whatever their names, are ignored. An empty table gives an empty table.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from schemagauge.llm.columns import text_or_empty
from schemagauge.llm.kernels import BASE, GOLDEN, U64, Words, mix, slices

MIN_WORDS = 24
MIN_TIMES = 3


def _own(hashes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Hashes of words that differ between texts."""
    return mix(hashes ^ (owner.astype(U64) * U64(GOLDEN)))


def suspects(words: np.ndarray, bounds: np.ndarray, first: int) -> np.ndarray:
    """Which texts have, for some ``2**k >= first``, equal windows of ``2**k`` words less than that apart.

    ``words`` differ between texts, which lie between ``bounds``.
    """
    n = len(words)
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    ends = bounds[1:][owner]
    found = np.zeros(len(bounds) - 1, bool)
    size, at, names = 1, np.arange(n), words
    while len(at):
        if size >= first:
            order = np.argsort(names, kind="stable")
            ranked, places = names[order], at[order]
            same = ranked[1:] == ranked[:-1]
            near = same & (places[1:] - places[:-1] < size)
            found[owner[places[:-1][near]]] = True
            # A window that comes once is the start of none that comes twice, and a text once found is.
            again = np.zeros(len(at), bool)
            again[order[1:][same]] = True
            again[order[:-1][same]] = True
            again &= ~found[owner[at]]
            at, names = at[again], names[again]
        next_at = np.searchsorted(at, at + size)
        inside = (at + 2 * size <= ends[at]) & (next_at < len(at))
        next_at = np.minimum(next_at, len(at) - 1)
        inside &= at[next_at] == at + size if len(at) else inside
        names = mix(names[inside] * U64(BASE) + names[next_at[inside]])
        at, size = at[inside], 2 * size
    return found


def _ranks(values: np.ndarray) -> np.ndarray:
    """Numbers from 1 in the order of the values, equal for equal ones."""
    order = np.argsort(values, kind="stable")
    ranked = values[order]
    out = np.empty(len(values), np.int32)
    out[order] = np.cumsum(np.concatenate(([1], (ranked[1:] != ranked[:-1]).astype(np.int32))))
    return out


def sorted_suffixes(words: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array of texts, each word with the end of its text; and common prefixes of neighbours."""
    n = len(words)
    levels, size = [_ranks(words)], 1
    while levels[-1].max(initial=0) < n:
        ranks = levels[-1]
        after = np.arange(n) + size
        follow = np.where(after < ends, ranks[np.minimum(after, n - 1)], 0)
        levels.append(_ranks(ranks.astype(np.int64) << 32 | follow))
        size *= 2
    array = np.empty(n, np.int64)
    array[levels[-1] - 1] = np.arange(n)
    left, right = array[:-1].copy(), array[1:].copy()
    common = np.zeros(max(n - 1, 0), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        inside = np.maximum(left, right) < n
        same = np.flatnonzero(inside)
        a, b = left[same], right[same]
        # Equal ranks mean equal whole windows: two that end with their text differ in length.
        same = same[(levels[k][a] == levels[k][b]) & (ends[a] == ends[b])]
        for x in (left, right, common):
            x[same] += 1 << k
    return array, common


class Classes:
    """Classes of positions: a union-find whose sets are sorted lists."""

    def __init__(self):
        self.parent: dict[int, int] = {}
        self.members: dict[int, list[int]] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        if x not in parent:
            parent[x] = x
            self.members[x] = [x]
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    def unite(self, x: int, y: int) -> list[tuple[int, int]]:
        """Make one class of two; the pairs of positions that are neighbours from now on."""
        x, y = self.root(x), self.root(y)
        if len(self.members[x]) < len(self.members[y]):
            x, y = y, x
        many, few = self.members[x], self.members.pop(y)
        self.parent[y] = x
        pairs, last = [], -1
        for i, p in enumerate(few):
            at = bisect_left(many, p)
            if at and many[at - 1] > last:
                pairs.append((many[at - 1], p))
            if at < len(many) and (i + 1 == len(few) or many[at] < few[i + 1]):
                pairs.append((p, many[at]))
            last = p
        if len(few) * 8 < len(many):
            for p in few:
                insort(many, p)
        else:
            many += few
            many.sort()
        return pairs


def runs_of(words: np.ndarray, bounds: np.ndarray, min_words: int, min_times: int) -> list[list[tuple[int, int, int]]]:
    """Of each text its runs as (start, length, period). Equal words have equal numbers."""
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(bounds) - 1)]
    ends = bounds[1:][owner]
    least = max(1, -(-min_words * (min_times - 1) // min_times))
    array, common = sorted_suffixes(words, ends)
    edges = np.flatnonzero(common >= least)
    edges = edges[np.argsort(-common[edges], kind="stable")]
    classes, seeds = Classes(), []
    for a, b, size in zip(array[edges].tolist(), array[edges + 1].tolist(), common[edges].tolist()):
        for p, q in classes.unite(a, b):
            if (min_times - 1) * (q - p) <= size:
                seeds.append((p, q, size))
    if not seeds:
        return out
    p, q, size = np.array(seeds).T
    of_text = owner[p]
    begins = (p == bounds[of_text]) | (words[p - 1] != words[q - 1])
    length, period = q - p + size, q - p
    begins &= (length >= min_words) & (length >= min_times * period)
    order = np.lexsort((period, p))
    order = order[begins[order]]
    start = p - bounds[of_text]
    for text, *run in zip(*[x[order].tolist() for x in (of_text, start, length, period)]):
        out[text].append(tuple(run))
    return out


def find_runs(texts: list[bytes], min_words: int = MIN_WORDS, min_times: int = MIN_TIMES) -> list[list[tuple[int, int, int]]]:
    """Of each text its runs as (start, length, period), numbers of words."""
    found = Words(texts, fold=False)
    bounds = found.bounds
    own = _own(found.hashes, np.repeat(np.arange(len(texts)), np.diff(bounds)))
    # A window of this size lies twice in each run that is long enough, at the distance of a period.
    first = 1
    while 2 * first * min_times <= min_words * (min_times - 1):
        first *= 2
    chosen = np.flatnonzero(suspects(own, bounds, first))
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if len(chosen):
        parts = [own[bounds[i] : bounds[i + 1]] for i in chosen]
        inner = np.concatenate(([0], np.cumsum([len(x) for x in parts])))
        for i, runs in zip(chosen.tolist(), runs_of(np.concatenate(parts), inner, min_words, min_times)):
            out[i] = runs
    return out


def collapsed(text: bytes, runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by single blanks, without those in a run after its first period."""
    words = text.split()
    if runs:
        inside = np.zeros(len(words) + 1, np.int64)
        for start, length, period in runs:
            inside[start + period] += 1
            inside[start + length] -= 1
        gone = np.cumsum(inside) > 0
        words = [w for w, g in zip(words, gone.tolist()) if not g]
    return b" ".join(words)


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_FOUND = "runs array<struct<start:long,length:long,period:long>>, collapsed string"


def _found(batches, min_words, min_times):
    for batch in batches:
        for first, texts in slices(batch, "body"):
            runs = find_runs(texts, min_words, min_times)
            left = [collapsed(t, r) for t, r in zip(texts, runs)]
            listed = [[dict(zip(("start", "length", "period"), r)) for r in some] for some in runs]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("rid").slice(first, len(texts)),
                    pa.array(listed, pa.list_(_RUN)),
                    pa.array(left, pa.binary()).cast(pa.string()),
                ],
                names=["rid", "runs", "collapsed"],
            )


def collapse_runs(
    docs: DataFrame,
    min_words: int = MIN_WORDS,
    min_times: int = MIN_TIMES,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """A row per row of ``docs``: its id as ``rid``, its ``runs``, and what is left as ``collapsed``."""
    if min_times < 3 or min_words < min_times:
        raise ValueError("a run has three periods or more, and as many words as periods")
    rows = docs.select(F.col(id_column).alias("rid"), text_or_empty(text_column).alias("body"))
    kind = rows.schema["rid"].dataType.simpleString()
    return rows.mapInArrow(lambda x: _found(x, min_words, min_times), f"rid {kind}, {_FOUND}")


def most_periodic(runs: Column) -> Column:
    """The run with the most periods, exactly; of equal ones the first. Null where there is none."""
    more = lambda a, b: b["length"] * a["period"] > a["length"] * b["period"]
    return F.aggregate(runs, F.get(runs, F.lit(0)), lambda a, b: F.when(more(a, b), b).otherwise(a))


def repeat_tail(text: Column, start, period) -> Column:
    """A text whose words from number ``start(n)`` on repeat the first ``period(n)`` of these.

    ``n`` is the number of words; the result has single blanks.
    """
    words = F.regexp_extract_all(text, F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0))

    def repeated(w):
        n = F.size(w).cast("long")
        a, p = start(n), period(n)
        tail = F.transform(F.sequence(F.lit(0).cast("long"), n - a - 1), lambda i: F.get(w, (a + i % p).cast("int")))
        return F.array_join(F.concat(F.slice(w, F.lit(1), a.cast("int")), tail), " ")

    # The words are bound once.
    return F.get(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, repeated(w)).otherwise(F.lit(""))), 0)
