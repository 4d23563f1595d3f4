"""How far test schemas lie from ground-truth schemas, by their sets of paths."""

from __future__ import annotations

from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from schemagauge.session import reliable
from schemagauge.sources.logs import algorithm_of, dataset_of

COMPARISONS = ("symmetric", "diff", "sub")

# Name fragments of the algorithms a report has lines for.
ALGORITHMS = ("baazizi", "bimax", "kmeans", "hier")


def schema_paths(nodes: DataFrame, id_col: str = "file", per_entity: bool = True) -> DataFrame:
    """Distinct ``(id, entity_idx, path)``.

    An object counts with its own path, an array with that of its items, the rest
    with their own. With ``per_entity`` every branch of a root ``anyOf`` is a set of
    its own, without what lies beside it; otherwise a schema is one set, entity 0.
    """
    path = (
        F.when(F.col("has_props"), F.col("path"))
        .when(F.col("has_items"), F.concat("path", F.lit("[*]")))
        .otherwise(F.col("path"))
    )
    if not per_entity:
        return nodes.filter("live_paths").select(
            id_col, F.lit(0).alias("entity_idx"), path.alias("path")
        ).distinct()
    hollow = (F.col("edge") == "root") & F.col("has_any") & (F.col("n_any") == 0)
    checked = F.when(hollow, F.raise_error(F.lit("a root anyOf has no branches"))).otherwise(path)
    kept = ~F.col("root_has_any") | F.col("entity_idx").isNotNull() | hollow
    return nodes.filter(F.col("live_paths") & kept).select(
        id_col,
        F.when(F.col("root_has_any"), F.col("entity_idx")).otherwise(0).alias("entity_idx"),
        checked.alias("path"),
    ).distinct()


def _numbers(paths: DataFrame) -> DataFrame:
    """``path`` replaced by ``id``, 64 bits that differ between all paths there are."""
    distinct = paths.select("path").distinct()
    for seed in range(100):
        ids = F.xxhash64(F.lit(seed), F.col("path"))
        if distinct.groupBy(ids).agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
            return paths.withColumn("id", ids).drop("path")
    raise RuntimeError("no seed tells all paths apart")


class DistanceLists(NamedTuple):
    """Distances without a row for each pair, see :func:`schema_distances`.

    ``files`` has ``(test, algorithm, own, n)``, where ``n`` is how many truths the test is held against
    and ``own`` the part of the truth of the same name. ``lists`` has ``(tests, part, before, truths)``:
    tests of equal paths, each with its ``starts`` in a report, and the truths of a part, a range of
    names, in order, each with its distance. ``before`` truths are in the parts before.
    """

    files: DataFrame
    lists: DataFrame


#: Truths of a part and bytes of their ids, tests of a block, tests of equal paths in one row.
_PART_FILES, _PART_BYTES, _ROW_FILES, _CHUNK = 2000, 16 << 20, 2000, 500


def schema_distances(
    test: DataFrame,
    truth: DataFrame,
    comparison: str = "symmetric",
    blocks: int | None = None,
    listed: bool = False,
) -> DataFrame | DistanceLists:
    """``(test, truth, algorithm, dataset, d)`` for all pairs of differing file names.

    ``test`` and ``truth`` are node tables keyed by ``file``. A path is a number of 64 bits, checked to be
    its own, so what meets are sorted arrays of numbers: a row for all files with the same entities.
    Truths are parted by ranges of their names. Tests are dealt out and meet each part once: a block
    streams its tests past the truths of its part, and paths in common are counted as arrays. No path
    is a key of anything, and no pair of files is shuffled. Parts and blocks are as many as the
    measured sizes ask for, or ``blocks`` each way.
    The result has a row for each pair of files; with ``listed`` it is what the reports
    take as well, and what they need not put together again.
    """
    if comparison not in COMPARISONS:
        raise ValueError(f"unknown comparison {comparison!r}, expected one of {COMPARISONS}")
    both = schema_paths(test).withColumn("is_test", F.lit(True))
    both = both.unionByName(schema_paths(truth, per_entity=False).withColumn("is_test", F.lit(False)))
    both = _numbers(reliable(both.filter(F.col("file").isNotNull()))).groupBy("is_test", "file", "entity_idx")
    both = reliable(both.agg(F.sort_array(F.collect_list("id")).alias("ids")))
    tests = both.filter("is_test").groupBy("file").agg(F.array_sort(F.collect_set("ids")).alias("entities"))
    truths = both.filter("not is_test").select("file", "ids")
    sizes = both.groupBy("is_test").agg(F.sum(8 * F.size("ids")).alias("bytes"), F.countDistinct("file").alias("files"))
    sizes = {r["is_test"]: (r["bytes"], r["files"]) for r in sizes.collect()}
    (_, m), (truth_bytes, total) = sizes.get(True, (0, 0)), sizes.get(False, (0, 0))
    parts = blocks or max(1, -(-truth_bytes // _PART_BYTES), -(-total // _PART_FILES))
    spread = int(test.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = blocks or max(1, -(-m // _ROW_FILES), min(-(-spread // parts), -(-m // 50)))

    ranged = truths.repartitionByRange(parts, "file") if parts > 1 else truths.coalesce(1)
    ranged = reliable(ranged.withColumn("part", F.spark_partition_id()))
    # One number per part, and parts are as many as tasks.
    held = {r["part"]: r["n"] for r in ranged.groupBy("part").agg(F.count("*").alias("n")).collect()}
    before = [0, *accumulate(held.get(i, 0) for i in range(parts))]
    own = ranged.select(F.col("file").alias("test"), F.col("part").alias("own"))
    n = F.lit(total).cast("bigint") - F.col("own").isNotNull().cast("bigint")
    files = tests.select(F.col("file").alias("test")).join(own, "test", "left")
    files = files.select("test", algorithm_of("test").alias("algorithm"), "own", n.alias("n"))
    told = files.withColumn("starts", F.lit(None).cast(_STARTS))
    if listed:
        files = reliable(files)
        starts = _starts(_fragments(files).select("fragment", "test", "n"))
        starts = starts.groupBy("test").agg(F.collect_list(F.struct("fragment", "start")).alias("starts"))
        told = files.join(starts, "test", "left")
    told = tests.join(told, F.col("file") == F.col("test"))
    alike = told.groupBy("entities").agg(F.collect_list(F.struct("test", "algorithm", "own", "starts")).alias("tests"))
    chunks = F.explode(F.sequence(F.lit(0), F.floor((F.size("tests") - 1) / _CHUNK).cast("int")))
    alike = alike.withColumn("chunk", chunks).withColumn("tests", F.slice("tests", F.col("chunk") * _CHUNK + 1, _CHUNK))
    row = F.pmod(F.xxhash64("chunk", "entities"), F.lit(rows)).cast("int")
    every_part = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    alike = alike.select(row.alias("row"), F.lit(True).alias("is_test"), F.col("entities").alias("ids"), "tests", every_part.alias("part"))
    name = F.struct(F.col("file").alias("truth"), dataset_of("file").alias("dataset"))
    others = ranged.groupBy("part", "ids").agg(F.collect_list(name).alias("truths"))
    every_row = F.explode(F.sequence(F.lit(0), F.lit(rows - 1)))
    others = others.select(every_row.alias("row"), F.lit(False).alias("is_test"), F.array("ids").alias("ids"), "truths", "part")
    met = alike.unionByName(others, allowMissingColumns=True)
    met = met.withColumn("block", F.col("row") * parts + F.col("part")).drop("row")
    met = met.repartition(parts * rows, "block").sortWithinPartitions("block", "is_test")
    lists = met.mapInArrow(lambda x: _held(x, comparison, before), _LISTS)
    if listed:
        return DistanceLists(files, lists)
    pairs = lists.select(F.explode("tests").alias("t"), "truths").select("t.test", "t.algorithm", F.inline("truths"))
    return pairs.select("test", "truth", "algorithm", "dataset", "d")


_STARTS = "array<struct<fragment:string,start:bigint>>"
_LISTS = (
    f"tests array<struct<test:string,algorithm:string,own:int,starts:{_STARTS}>>, part int, before bigint, "
    "truths array<struct<truth:string,dataset:string,d:bigint>>"
)
#: Pairs that are worked on at once.
_PAIRS = 1 << 20


class _Truths:
    """The truths of a part: ids with the classes that have them, names in order with their classes."""

    def __init__(self, batches: list[pa.RecordBatch]):
        every = pa.Table.from_batches(batches).combine_chunks()
        sets = every.column("ids").combine_chunks().flatten()
        names = every.column("truths").combine_chunks()
        self.sizes = sets.value_lengths().to_numpy().astype(np.int64)
        values = sets.flatten().to_numpy()
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(values, kind="stable")
        self.ids, first = np.unique(values[order], return_index=True)
        self.owner, self.bounds = owner[order], np.append(first, len(values))
        classes = np.repeat(np.arange(len(sets)), names.value_lengths().to_numpy())
        self.truth, self.dataset = names.flatten().flatten()
        listed = self.truth.to_pylist()
        order = np.array(sorted(range(len(listed)), key=listed.__getitem__), np.int64)
        self.truth, self.dataset = self.truth.take(pa.array(order)), self.dataset.take(pa.array(order))
        self.classes = classes[order]
        self.at = {listed[i]: place for place, i in enumerate(order.tolist())}

    def common(self, owner: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
        """How many of their ids ``n`` sets have in common with each class."""
        wide = len(self.sizes)
        out = np.zeros((n, wide), np.int64)
        at = np.searchsorted(self.ids, values)
        at[at == len(self.ids)] = 0
        known = self.ids[at] == values if len(self.ids) else np.zeros(len(values), bool)
        owner, at = owner[known], at[known]
        n_here, n_there = np.bincount(at, minlength=len(self.ids)), np.diff(self.bounds)
        # Ids that many have on both sides are multiplied as rows of 0 and 1, others are listed.
        frequent = n_here * n_there > n * wide / 40
        place = np.cumsum(frequent) - 1
        for low in range(0, int(frequent.sum()), 512):
            ids = np.flatnonzero(frequent)[low : low + 512]
            mine, theirs = np.zeros((n, 512), np.float32), np.zeros((wide, 512), np.float32)
            some = frequent[at] & (place[at] >= low) & (place[at] < low + 512)
            mine[owner[some], place[at[some]] - low] = 1
            for j, i in enumerate(ids.tolist()):
                theirs[self.owner[self.bounds[i] : self.bounds[i + 1]], j] = 1
            out += (mine @ theirs.T).astype(np.int64)
        owner, at = owner[~frequent[at]], at[~frequent[at]]
        times = n_there[at]
        done, low = np.cumsum(times), 0
        while low < len(at):
            high = max(low + 1, int(np.searchsorted(done, done[low] - times[low] + _PAIRS, "right")))
            some = times[low:high]
            within = np.arange(some.sum()) - np.repeat(np.cumsum(some) - some, some)
            found = self.owner[np.repeat(self.bounds[at[low:high]], some) + within]
            flat = np.repeat(owner[low:high] * wide, some) + found
            out += np.bincount(flat, minlength=n * wide).reshape(n, wide)
            low = high
        return out

    def least(self, owner: np.ndarray, sets: pa.ListArray, n: int, comparison: str) -> np.ndarray:
        """The smallest distance of the sets of each of ``n`` owners from each class."""
        best = np.full((n, len(self.sizes)), np.iinfo(np.int64).max)
        step = max(1, _PAIRS // len(self.sizes))
        for low in range(0, len(owner), step):
            some = sets.slice(low, step)
            sizes = some.value_lengths().to_numpy().astype(np.int64)
            rows = np.repeat(np.arange(len(some)), sizes)
            both = self.common(rows, some.flatten().to_numpy(), len(some))
            if comparison == "symmetric":
                d = sizes[:, None] + self.sizes - 2 * both
            elif comparison == "diff":
                d = sizes[:, None] - both
            else:
                d = (both == self.sizes).astype(np.int64)
            of = owner[low : low + step]
            first = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
            best[of[first]] = np.minimum(best[of[first]], np.minimum.reduceat(d, first, axis=0))
        return best


def _held(batches, comparison, before):
    """Tests held against the truths of their block, which come first."""
    block, waiting, truths = None, [], None
    for batch in batches:
        blocks, is_test = batch.column("block").to_numpy(), batch.column("is_test").to_numpy(zero_copy_only=False)
        fresh = (blocks[1:] != blocks[:-1]) | (is_test[1:] != is_test[:-1])
        cuts = [0, *(np.flatnonzero(fresh) + 1).tolist(), batch.num_rows]
        for low, high in zip(cuts[:-1], cuts[1:]):
            if low == high:
                continue
            if blocks[low] != block:
                block, waiting, truths = blocks[low], [], None
            some = batch.slice(low, high - low)
            if not is_test[low]:
                waiting.append(some)
            elif waiting:
                truths = truths or _Truths(waiting)
                step = max(1, _PAIRS // len(truths.classes))
                for at in range(0, some.num_rows, step):
                    yield from _lists(some.slice(at, step), truths, comparison, before)


def _lists(tests: pa.RecordBatch, truths: _Truths, comparison: str, before: list[int]):
    part, width = tests.column("part")[0].as_py(), len(truths.classes)
    ids, names = tests.column("ids"), tests.column("tests")
    owner = np.repeat(np.arange(tests.num_rows), ids.value_lengths().to_numpy())
    d = truths.least(owner, ids.flatten(), tests.num_rows, comparison)[:, truths.classes]
    of, names = np.repeat(np.arange(tests.num_rows), names.value_lengths().to_numpy()), names.flatten()
    own = names.field("own").fill_null(-1).to_numpy() == part
    # A row for the tests of equal paths, and one for each that has a truth of its name here.
    rows = [(t, g, np.arange(width)) for t, g in _grouped(of, np.flatnonzero(~own))]
    for i in np.flatnonzero(own).tolist():
        rows.append((int(of[i]), np.array([i]), np.delete(np.arange(width), truths.at[names.field("test")[i].as_py()])))
    rows = [r for r in rows if len(r[2])]
    if not rows:
        return
    step = max(1, _PAIRS // width)
    for low in range(0, len(rows), step):
        some = rows[low : low + step]
        listed = lambda k, values: pa.ListArray.from_arrays(
            pa.array(np.cumsum([0, *(len(r[k]) for r in some)]), pa.int32()), values
        )
        at = np.concatenate([r[2] for r in some])
        found = np.concatenate([d[t, x] for t, _, x in some])
        columns = [truths.truth.take(pa.array(at)), truths.dataset.take(pa.array(at)), pa.array(found)]
        yield pa.RecordBatch.from_arrays(
            [
                listed(1, names.take(pa.array(np.concatenate([r[1] for r in some])))),
                pa.array([part] * len(some), pa.int32()),
                pa.array([before[part]] * len(some), pa.int64()),
                listed(2, pa.StructArray.from_arrays(columns, names=["truth", "dataset", "d"])),
            ],
            names=["tests", "part", "before", "truths"],
        )


def _grouped(of: np.ndarray, at: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """``at`` by the sorted ``of[at]``."""
    if not len(at):
        return []
    cuts = np.flatnonzero(of[at][1:] != of[at][:-1]) + 1
    return [(int(of[g[0]]), g) for g in np.split(at, cuts)]


def report_cells(distances: DataFrame | DistanceLists) -> DataFrame:
    """``(fragment, position, d)``: the distances of an algorithm fragment, numbered from 0.

    The order is that of test and then truth names. What is numbered across tasks are test
    files, each with its number of truths: ranges of names are written, numbered within, and
    only a sum per range and fragment is put in order. Within a test file truths are ranked, or
    are in order already where ``distances`` are lists, which are numbered where they are.
    """
    if isinstance(distances, DistanceLists):
        # One less where the truth of the test's own name is in a part before.
        less = F.coalesce((F.col("t.own") < F.col("part")).cast("bigint"), F.lit(0).cast("bigint"))
        told = distances.lists.select(F.explode("tests").alias("t"), "part", "before", F.col("truths.d").alias("ds"))
        told = told.select((F.col("before") - less).alias("before"), "ds", F.explode("t.starts").alias("s"))
        cells = told.select("s.fragment", (F.col("s.start") + F.col("before")).alias("start"), F.posexplode("ds").alias("at", "d"))
        return cells.select("fragment", (F.col("start") + F.col("at")).alias("position"), "d")
    told = _fragments(distances)
    starts = _starts(told.groupBy("fragment", "test").agg(F.count("*").alias("n")))
    rank = F.row_number().over(Window.partitionBy("fragment", "test").orderBy("truth")) - 1
    return (
        told.select("fragment", "test", "d", rank.alias("rank"))
        .join(starts, ["fragment", "test"])
        .select("fragment", (F.col("start") + F.col("rank")).alias("position"), "d")
    )


def _starts(sizes: DataFrame) -> DataFrame:
    """``(fragment, test, start)``: how many of ``n`` are in the test files of smaller names."""
    ranges = reliable(
        sizes.repartitionByRange("fragment", "test").withColumn("range", F.spark_partition_id())
    )
    names = Window.partitionBy("fragment", "range").orderBy("test")
    earlier = Window.partitionBy("fragment").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast("bigint")
    offsets = (
        ranges.groupBy("fragment", "range")
        .agg(F.sum("n").alias("held"))
        .select("fragment", "range", F.coalesce(F.sum("held").over(earlier), none).alias("offset"))
    )
    starts = ranges.select("*", (F.sum("n").over(names) - F.col("n")).alias("within")).join(
        offsets, ["fragment", "range"]
    )
    return starts.select("fragment", "test", (F.col("offset") + F.col("within")).alias("start"))


def _every_fragment() -> Column:
    return F.explode(F.array(*[F.lit(a) for a in ALGORITHMS])).alias("fragment")


def _fragments(distances: DataFrame) -> DataFrame:
    return distances.select("*", _every_fragment()).filter(F.contains(F.col("algorithm"), F.col("fragment")))


def distance_report(
    distances: DataFrame | DistanceLists, per_test: bool = True, max_cells: int | None = None
) -> DataFrame:
    """Distances joined by `` & ``, in order of file names, per algorithm fragment.

    A line covers one test file, so its length is bounded by the number of truth
    files. ``per_test=False`` gives the lines of :func:`report_lines` that aren't empty.
    """
    if not per_test:
        return report_lines(distances, max_cells).filter(F.col("line") != "")
    return _test_lines(distances).select("fragment", "test", "line")


def _test_lines(distances: DataFrame | DistanceLists) -> DataFrame:
    """``(fragment, test, n, line)``: the distances of a test file as one line."""
    if isinstance(distances, DistanceLists):
        text = F.array_join(F.col("truths.d").cast("array<string>"), " & ")
        told = distances.lists.select("tests", "part", F.size("truths").alias("n"), text.alias("line"))
        told = told.select(F.explode("tests").alias("t"), "part", "n", "line").select("t.test", "t.algorithm", "part", "n", "line")
        ordered = F.sort_array(F.collect_list(F.struct("part", "line")))["line"]
        found = _fragments(told).groupBy("fragment", "test")
        return found.agg(F.sum("n").alias("n"), F.array_join(ordered, " & ").alias("line"))
    ordered = F.sort_array(F.collect_list(F.struct("truth", "d")))
    return (
        _fragments(distances)
        .groupBy("fragment", "test")
        .agg(F.count("*").alias("n"), _line(ordered).alias("line"))
    )


#: Bytes of a line: no value is longer.
_LINE_BYTES = 2_000_000_000


def report_lines(distances: DataFrame | DistanceLists, max_cells: int | None = None) -> DataFrame:
    """``(fragment, line)``: one line for each algorithm fragment, empty where no file has it.

    A line is put together from those of its test files, which are written first. These come to one
    task in order, in short pieces, and go into one buffer of the known size, so no more than one line
    is held at a time and none is gathered as rows. Whole lines then go to a task each. It raises,
    before it gathers any, beyond what one value can hold and beyond ``max_cells`` distances, if
    given. :func:`report_cells` has the same as rows.
    """
    parts = reliable(_test_lines(distances))
    sizes = parts.groupBy("fragment").agg(
        F.sum("n").alias("n"), F.sum(F.octet_length("line").cast("bigint") + len(_BETWEEN)).alias("bytes")
    )
    fits = F.when(F.col("bytes") > _LINE_BYTES, _refused("2 GB"))
    if max_cells is not None:
        fits = fits.when(F.col("n") > max_cells, _refused(f"{max_cells} distances"))
    checked = reliable(sizes.filter(fits.otherwise(True)).select("fragment", "bytes"))
    cuts = F.sequence(F.lit(0), F.greatest(F.floor((F.length("line") - 1) / _PIECE), F.lit(0)).cast("int"))
    pieces = F.posexplode(F.transform(cuts, lambda i: F.substring("line", i * _PIECE + 1, F.lit(_PIECE)))).alias("no", "piece")
    lines = parts.filter(F.col("line").isNotNull()).join(F.broadcast(checked), "fragment")
    lines = lines.select("fragment", "bytes", "test", pieces)
    every = parts.sparkSession.range(1).select(_every_fragment())
    place = F.array_position(F.array(*[F.lit(a) for a in ALGORITHMS]), F.col("fragment")).cast("int") - 1
    told = lines.unionByName(every, allowMissingColumns=True).repartition(1)
    whole = told.sortWithinPartitions("fragment", "test", "no").mapInArrow(_whole_lines, "fragment string, line string")
    return whole.repartitionById(len(ALGORITHMS), place)


#: Characters of a piece, so that the rows a task is sent at a time are short; what is between two lines.
_PIECE, _BETWEEN = 2000, b" & "


def _whole_lines(batches):
    """A line for each fragment, of the sorted pieces of its lines. ``bytes`` is at least its size."""
    fragment, held, size = None, None, 0
    for batch in batches:
        named, sizes, no = (batch.column(c).to_pylist() for c in ("fragment", "bytes", "no"))
        for name, most, n, piece in zip(named, sizes, no, batch.column("piece")):
            if name != fragment:
                if fragment is not None:
                    yield _whole_line(fragment, held, size)
                fragment, held, size = name, None, 0
            if n is None:
                continue
            if held is None:
                held = np.empty(most, np.uint8)
            elif n == 0:
                held[size : size + len(_BETWEEN)] = np.frombuffer(_BETWEEN, np.uint8)
                size += len(_BETWEEN)
            piece = piece.as_py().encode()
            held[size : size + len(piece)] = np.frombuffer(piece, np.uint8)
            size += len(piece)
    if fragment is not None:
        yield _whole_line(fragment, held, size)


def _whole_line(fragment: str, held: np.ndarray | None, size: int) -> pa.RecordBatch:
    held = np.empty(0, np.uint8) if held is None else held[:size]
    text = pa.Array.from_buffers(pa.string(), 1, [None, pa.py_buffer(np.array([0, size], np.int32)), pa.py_buffer(held)])
    return pa.RecordBatch.from_arrays([pa.array([fragment]), text], names=["fragment", "line"])


def _refused(bound: str) -> Column:
    return F.raise_error(F.lit(f"a line of over {bound}, take report_cells")).cast("boolean")


def _line(cells: Column) -> Column:
    return F.array_join(F.transform(cells, lambda x: x["d"].cast("string")), " & ")


def subset_report(distances: DataFrame | DistanceLists) -> DataFrame:
    """A line for every truth whose paths a test schema covers in all its entities."""
    line = F.concat("dataset", F.lit(" subset of "), "algorithm").alias("line")
    if isinstance(distances, DistanceLists):
        found = distances.lists.select("tests", F.inline("truths")).filter(F.col("d") == 1)
        found = found.select(F.explode("tests").alias("t"), "truth", "dataset")
        return found.select("t.test", "truth", "dataset", "t.algorithm").select("test", "truth", line)
    return distances.filter(F.col("d") == 1).select("test", "truth", line)
