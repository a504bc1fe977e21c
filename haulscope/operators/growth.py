"""Growing a random forest over rows that stay where they lie.

Spark's own trainer draws the bootstrap samples; the forest is the one that Spark's trainer grows from them,
with the same candidate splits and the same choice among them. What differs is the work for it: a row adds to
one sum for each of its inputs, where the trainer adds to one sum for each feature, that is for every value
that a category has anywhere; and a row's draws take a byte a tree, where the trainer keeps four.

Each level of all trees is a pass over the rows: a task sums up count, total and squares of the target for each
open node and each cell of each input (a value of a category, a bin of a number); the sums of a tree meet in a
shuffle, where each node's best split is found. Only splits reach the driver.
"""

from __future__ import annotations

import json
import sys
import time
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, StorageLevel, TaskContext, cloudpickle
from pyspark.ml.regression import DecisionTreeRegressor, RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession

from haulscope.operators import forest
from haulscope.session import shuffles_removed

# What runs inside tasks travels with the plan: executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Rows that are kept, read and summed up at a time: some megabytes.
STEP = 1 << 14
# Sums that travel as one row of the shuffle, in bytes.
BLOCK = 4 << 20
# Marks the packed inputs of a row among the bytes around them.
MARK = b"\xf0row\x0f\xe1\xd2\xc3"
EPSILON = 2.0**-52
# Gains closer than this share of the mean square may be told apart by rounding alone.
ROUNDING = 1e-11


def thresholds(values: np.ndarray, rows: int, bins: int) -> np.ndarray:
    """Where a number may be split, by a sample of its values, as Spark's trainer finds them: midpoints
    between values, at about equal counts; zeros are counted as what the sample lacks of its expected size."""
    values, counts = np.unique(values[values != 0.0], return_counts=True)
    if not len(values):
        return values
    expected = _fraction(rows, bins) * rows
    counts, seen = counts.astype(np.float64), counts.sum()
    if expected - seen > EPSILON * seen * 100:
        at = np.searchsorted(values, 0.0)
        values, counts = np.insert(values, at, 0.0), np.insert(counts, at, expected - seen)
    middles = (values[:-1] + values[1:]) / 2.0
    if len(middles) <= min(bins, rows) - 1:
        return middles
    stride = expected / min(bins, rows)
    chosen, upto, target = [], counts[0], stride
    for i in range(1, len(values)):
        before, upto = upto, upto + counts[i]
        if abs(before - target) < abs(upto - target):
            chosen.append(middles[i - 1])
            target += stride
    return np.array(chosen)


def _fraction(rows: int, bins: int) -> float:
    wanted = max(min(bins, rows) ** 2, 10_000)
    return wanted / rows if wanted < rows else 1.0


def sampled(rows: DataFrame, n: int, bins: int, seed: int) -> DataFrame:
    """The rows by which Spark's trainer chooses thresholds: some ten thousand."""
    spark, fraction = rows.sparkSession, _fraction(n, bins)
    if fraction >= 1.0:
        return rows
    drawn = spark.sparkContext._jvm.org.apache.spark.util.random.XORShiftRandom(seed).nextInt()
    kept = rows._jdf.toJavaRDD().sample(False, fraction, drawn)
    return DataFrame(spark._jsparkSession.createDataFrame(kept, rows._jdf.schema()), spark)


def bootstrapped(rows: DataFrame, trees: int, seed: int, cuts: list[np.ndarray]) -> DataFrame:
    """Rows of category indexes, numbers and the target, in this order, with how often each tree has drawn
    each row, by Spark's own sampler: a binary column that holds some thousand rows at a time, as ``_block``."""
    names = rows.columns
    inputs = len(names) - 1
    first = inputs - len(cuts)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in names]
            if not all(np.isfinite(c).all() for c in columns):
                raise ValueError("training rows must not hold NaN or infinite numbers")
            packed = np.zeros(batch.num_rows, _row(inputs, 0))
            packed["mark"], packed["target"] = np.frombuffer(MARK, np.uint8), columns[-1]
            for i, values in enumerate(columns[:-1]):
                packed["cells"][:, i] = values if i < first else np.searchsorted(cuts[i - first], values)
            yield _binary(packed)

    def compact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            if batch.num_rows:
                held.append(_sampled_row(_table_of(batch.column(0)), inputs, trees))
            if sum(map(len, held)) >= STEP:
                yield _block(np.concatenate(held))
                held = []
        if held:
            yield _block(np.concatenate(held))

    spark = rows.sparkSession
    jvm = spark.sparkContext._jvm
    encoders, sampler = jvm.org.apache.spark.sql.Encoders, jvm.org.apache.spark.ml.tree.impl.BaggedPoint
    packed = getattr(rows.mapInArrow(pack, "row binary")._jdf, "as")(encoders.BINARY()).rdd()
    equal = getattr(sampler, "convertToBaggedRDD$default$5")()
    points = sampler.convertToBaggedRDD(packed, 1.0, trees, True, equal, seed)
    kryo = encoders.kryo(jvm.java.lang.Class.forName("org.apache.spark.ml.tree.impl.BaggedPoint"))
    stored = DataFrame(spark._jsparkSession.createDataset(points, kryo).toDF(), spark)
    return stored.mapInArrow(compact, "rows binary")


def _row(inputs: int, trees: int) -> np.dtype:
    """A training row: its target, its cell of each input, and how often each tree has drawn it; without
    draws a mark to find it by."""
    known = [("target", "<f8"), ("cells", "<i4", inputs)]
    return np.dtype([*known, ("draws", np.uint8, trees)] if trees else [("mark", np.uint8, len(MARK)), *known])


def _binary(rows: np.ndarray) -> pa.RecordBatch:
    ends = np.arange(len(rows) + 1, dtype=np.int32) * rows.dtype.itemsize
    buffers = [None, pa.py_buffer(ends), pa.py_buffer(rows.tobytes())]
    return pa.RecordBatch.from_arrays([pa.Array.from_buffers(pa.binary(), len(rows), buffers)], ["row"])


def _table_of(column: pa.Array) -> np.ndarray:
    """Binary values of one length as rows of bytes."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset :][: len(column) + 1]
    if (np.diff(ends) != ends[1] - ends[0]).any():
        raise RuntimeError("Spark's bootstrap samples are not stored as expected")
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].reshape(len(column), -1)


def _sampled_row(table: np.ndarray, inputs: int, trees: int) -> np.ndarray:
    """What ``pack`` has made, with the draws beside it. Kryo writes the packed row, its weight (eight bytes),
    how many draws there are (a few bytes), and the draws, of four bytes each or, by spark.kryo.unsafe, one."""
    kind, size = _row(inputs, 0), table.shape[1]
    at = table[0].tobytes().find(MARK)
    left = size - at - kind.itemsize - 8
    if at < 0 or not trees < left <= 4 * trees + 8:
        raise RuntimeError("Spark's bootstrap samples are not stored as expected")
    if left > 4 * trees:
        draws = np.ascontiguousarray(table[:, size - 4 * trees :]).view("<i4")
    else:
        draws = table[:, size - trees :] >> 1
    packed = np.ascontiguousarray(table[:, at : at + kind.itemsize]).view(kind)[:, 0]
    rows = np.zeros(len(table), _row(inputs, trees))
    rows["target"], rows["cells"], rows["draws"] = packed["target"], packed["cells"], draws
    if (rows["draws"] != draws).any():
        raise RuntimeError("Spark's bootstrap samples are not stored as expected")
    return rows


def _block(rows: np.ndarray) -> pa.RecordBatch:
    """Rows column by column: targets, cells by input, draws by tree."""
    columns = [np.ascontiguousarray(rows[name].T).tobytes() for name in ("target", "cells", "draws")]
    return pa.RecordBatch.from_pydict({"rows": [b"".join(columns)]})


def _blocks(
    batches: Iterator[pa.RecordBatch], trees: int, inputs: int
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Targets, cells by input, and draws by tree, of some rows at a time."""
    for batch in batches:
        for block in batch.column(0):
            data = np.frombuffer(block.as_buffer(), np.uint8)
            n = len(data) // _row(inputs, trees).itemsize
            target, cells, draws = np.split(data, [8 * n, (8 + 4 * inputs) * n])
            yield target.view("<f8"), cells.view("<i4").reshape(inputs, n).astype(np.intp), draws.reshape(trees, n)


def _summed(batches: Iterator[pa.RecordBatch], spec: dict) -> Iterator[pa.RecordBatch]:
    """For each tree and open node: count, total and squares of the target in each cell, in this task's rows and
    in their order. In a second look (``among``) also over all rows, and over those that lack a value."""
    sizes, group, among = spec["sizes"], spec["group"], spec["among"]
    slots = spec["slots"]
    starts = (np.cumsum(sizes) - sizes)[:, None]
    owner, place = _places(sizes, spec["categories"])
    posts = {t: forest.signposts(spec["nodes"], sizes, t) for t in group}
    widths = {t: _width(sizes, among, t) for t in group}
    # Rows in no open node are summed up beyond the last.
    sums = {t: np.zeros((3, (spec["open"][t] + 1) * widths[t])) for t in group}
    for target, cells, draws in _blocks(batches, spec["trees"], len(sizes)):
        cells += starts
        for t in group:
            drawn = draws[t]
            rows = np.flatnonzero(drawn != 0)
            here = cells.take(rows, axis=1)
            slot = slots.take(forest.arrived(spec["nodes"], posts[t], here))
            if among is not None:
                inside = np.flatnonzero(slot != spec["open"][t])
                rows, here, slot = rows.take(inside), here.take(inside, axis=1), slot.take(inside)
            first = slot * widths[t]
            y = target.take(rows)
            weight = drawn.take(rows).astype(np.float64)
            total = weight * y
            stats = (weight, total, total * y)
            for one in here:
                at = first + one
                for into, what in zip(sums[t], stats):
                    np.add.at(into, at, what)
            if among is not None:
                first += sum(sizes)
                for i, candidate in enumerate(among[t].tolist()):
                    lack = np.flatnonzero(here[owner[candidate]] != place[candidate])
                    at = first.take(lack) + i
                    for into, what in zip(sums[t], stats):
                        np.add.at(into, at, what.take(lack))
                for into, what in zip(sums[t], stats):
                    np.add.at(into, first + len(among[t]), what)
    part = TaskContext.get().partitionId()
    for t in group:
        table = sums.pop(t).reshape(3, -1, widths[t])
        # Nodes of a second look stay together, as some need their sibling.
        step = max(1, BLOCK // (24 * widths[t])) if among is None else spec["open"][t]
        for begin in range(0, spec["open"][t], step):
            some = table[:, begin : min(begin + step, spec["open"][t])].reshape(3, -1)
            filled = np.flatnonzero(some[0]).astype(np.int32)
            if 2 * len(filled) > some.shape[1]:
                filled = np.arange(some.shape[1], dtype=np.int32)
            row = {"tree": t, "begin": begin, "part": part, "nodes": some.shape[1] // widths[t]}
            row |= {"cells": filled.tobytes(), "sums": some[:, filled].tobytes()}
            yield pa.RecordBatch.from_pylist([row], _PARTIAL)


_PARTIAL = pa.schema(
    [*((name, pa.int32()) for name in ("tree", "begin", "part", "nodes")), ("cells", pa.binary()), ("sums", pa.binary())]
)


def _width(sizes: list[int], among: dict[int, np.ndarray] | None, tree: int) -> int:
    return sum(sizes) + (0 if among is None else len(among[tree]) + 1)


def _places(sizes: list[int], categories: int) -> tuple[np.ndarray, np.ndarray]:
    """The input and the cell of each candidate that is a category's value; an input's last cell is of none."""
    owner = np.repeat(np.arange(categories), [n - 1 for n in sizes[:categories]])
    return owner, np.arange(len(owner)) + owner


def _variance(stats: np.ndarray) -> np.ndarray:
    count, total, squares = stats
    some = np.where(count == 0, 1.0, count)
    return np.where(count == 0, 0.0, (squares - total * total / some) / some)


def _mean(stats: np.ndarray) -> np.ndarray:
    return np.where(stats[0] == 0, 0.0, stats[1] / np.where(stats[0] == 0, 1.0, stats[0]))


def _splits(
    sums: np.ndarray, sizes: list[int], categories: int, among: np.ndarray, others: np.ndarray | None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both sides of each candidate, and whether a category's own value is on the left; ``sums`` are by
    statistic, node and cell. A category's value goes against all others, the side of the lower mean left.
    ``others`` has the sums without the values ``among``, where they are known by themselves."""
    lefts, rights, owns, begin, count = [], [], [], 0, 0
    for i, size in enumerate(sizes):
        part = sums[:, :, begin : begin + size]
        begin += size
        if i < categories:
            # The last cell has the rows without a value.
            value = part[:, :, :-1]
            lack = part.sum(axis=2, keepdims=True) - value
            if others is not None:
                mine = (among >= count) & (among < count + size - 1)
                lack[:, :, among[mine] - count] = others[:, :, mine]
            count += size - 1
            means = [np.where(x[0] == 0, np.finfo(np.float64).max, _mean(x)) for x in (lack, value)]
            own = means[1] < means[0]
            left = np.where(own, value, lack)
            whole = value + lack
        else:
            upto = np.cumsum(part, axis=2)
            left, whole = upto[:, :, :-1], upto[:, :, -1:]
            own = np.zeros(left.shape[1:], bool)
        lefts.append(left)
        rights.append(whole - left)
        owns.append(own)
    return np.concatenate(lefts, axis=2), np.concatenate(rights, axis=2), np.concatenate(owns, axis=1)


_FOUND = 13
NOTHING = np.zeros(0, np.int64)


def best(
    sums: np.ndarray, whole: np.ndarray | None, sizes: list[int], categories: int,
    among: np.ndarray = NOTHING, others: np.ndarray | None = None,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best split of each node, a row of ``_FOUND`` numbers; the first of equal ones. ``whole`` are the statistics of the
    nodes, if known. Then: the nodes where rounding may have decided, and the values of categories it may concern.
    """
    left, right, own = _splits(sums, sizes, categories, among, others)
    nodes = sums.shape[1]
    at = np.arange(nodes)
    if not left.shape[2]:
        whole = sums[:, :, : sizes[0]].sum(axis=2) if whole is None else whole
        left = right = np.zeros((3, nodes, 1))
        own = np.zeros((nodes, 1), bool)
    if whole is None:
        whole = left[:, :, 0] + right[:, :, 0]
    impurity = _variance(whole)
    both = np.maximum(left[0] + right[0], 1.0)
    sides = _variance(left), _variance(right)
    raw = impurity[:, None] - left[0] / both * sides[0] - right[0] / both * sides[1]
    raw[(left[0] < 1) | (right[0] < 1)] = -np.inf
    gain = np.where(raw >= 0, raw, -np.inf)
    chosen = gain.argmax(axis=1)
    columns = [chosen, own[at, chosen], gain[at, chosen], impurity, *whole, *left[:, at, chosen], *right[:, at, chosen]]
    found = np.stack([np.asarray(c, np.float64) for c in columns], axis=1)

    values = sum(sizes[:categories]) - categories
    top = raw.argmax(axis=1)
    error = ROUNDING * whole[2] / np.maximum(whole[0], 1.0)
    near = raw >= (raw[at, top] - error)[:, None]
    near &= ~np.isneginf(raw)
    # Cuts of numbers that divide the rows alike have the very same sums; a category's sums are known less well.
    same = (left == left[:, at, top][:, :, None]) & (right == right[:, at, top][:, :, None])
    same = same.all(axis=0) & (top >= values)[:, None]
    same[:, :values] = False
    same[at, top] = True
    rivals = (near & ~same).any(axis=1)
    little = near.any(axis=1) & (raw[at, top] <= error)
    pure = np.minimum(sides[0][at, top], sides[1][at, top]) <= error
    doubtful = rivals | little | (near.any(axis=1) & (top < values) & pure)
    near[~doubtful] = False
    return found, np.flatnonzero(doubtful), np.flatnonzero(near[:, :values].any(axis=0))


def _chosen(group: pa.Table, spec: dict) -> pa.Table:
    """The best splits of some nodes of a tree, from what the tasks have summed up, in the tasks' order."""
    table = group.sort_by("part")
    tree, begin, nodes = (table.column(name)[0].as_py() for name in ("tree", "begin", "nodes"))
    sizes, categories, among = spec["sizes"], spec["categories"], spec["among"]
    width = sum(sizes)
    sums = np.zeros((3, nodes * _width(sizes, among, tree)))
    for cells, blob in zip(table.column("cells"), table.column("sums")):
        sums[:, np.frombuffer(cells.as_buffer(), np.int32)] += np.frombuffer(blob.as_buffer(), np.float64).reshape(3, -1)
    sums = sums.reshape(3, nodes, -1)
    whole = spec["whole"].get(tree)
    whole = None if whole is None else whole[:, begin : begin + nodes]
    if among is None:
        found, doubtful, near = best(sums, whole, sizes, categories)
    else:
        if whole is not None:
            # What a category's split has left: the left side as summed up, the right one as the rest.
            kin, on_left = spec["kin"][tree]
            own, other = sums[:, :, -1], sums[:, kin, -1]
            by_sums = np.where(on_left, own, (own + other) - other)
            whole = np.where(kin != np.arange(nodes), by_sums, whole)
        found, doubtful, near = best(sums[:, :, :width], whole, sizes, categories, among[tree], sums[:, :, width:-1])
    columns = [[tree], [begin], [found.tobytes()], [doubtful.tobytes()], [near.tobytes()]]
    return pa.table(dict(zip(_SPLITS.names, columns)), _SPLITS)


_SPLITS = pa.schema(
    [("tree", pa.int32()), ("begin", pa.int32()), ("found", pa.binary()), ("doubtful", pa.binary()), ("near", pa.binary())]
)


class _Trees:
    """Nodes of all trees in the order in which they came, the roots first."""

    FIELDS = {
        "tree": np.int32, "level": np.int32, "left": np.int64, "right": np.int64, "feature": np.int32, "cut": np.float64,
        "kinds": np.int32, "gain": np.float64, "impurity": np.float64, "source": np.int64, "low": np.float64,
        "high": np.float64, "leaf": bool, "parent": np.int64, "sibling": np.int64,
    }

    def __init__(self, trees: int) -> None:
        self.stats = np.zeros((3, 0))
        for name, kind in self.FIELDS.items():
            setattr(self, name, np.zeros(0, kind))
        self.add(np.arange(trees), 0, None, np.zeros(trees, bool))

    def add(self, tree: np.ndarray, level: int, stats: np.ndarray | None, leaf: np.ndarray) -> np.ndarray:
        """New nodes, without children so far."""
        first, n = len(self.tree), len(tree)
        self.stats = np.concatenate([self.stats, np.zeros((3, n)) if stats is None else stats], axis=1)
        new = np.arange(first, first + n)
        given = {"tree": tree, "level": level, "left": new, "right": new, "feature": -1, "kinds": -1, "gain": -1.0, "leaf": leaf, "parent": -1}
        for name, kind in self.FIELDS.items():
            column = np.broadcast_to(np.asarray(given.get(name, 0), kind), (n,))
            setattr(self, name, np.concatenate([getattr(self, name), column]))
        self.impurity[new] = _variance(self.stats[:, new])
        return new


def grow(rows: DataFrame, regressor: RandomForestRegressor, values: list[int]) -> pa.Table:
    """The nodes of the regressor's forest, as Spark stores them. ``rows`` have the index of each category, the
    numbers and the target; ``values`` tells how many values each category has: an index beyond them is a
    feature of none. Each value of a category is a feature. All features are tried at each node."""
    trees, bins, seed = regressor.getNumTrees(), regressor.getMaxBins(), regressor.getSeed()
    max_depth, pass_mb = regressor.getMaxDepth(), regressor.getMaxMemoryInMB()
    numbers = rows.columns[len(values) : -1]
    n = rows.count()
    few = sampled(rows.select(*numbers), n, bins, seed).toArrow()
    cuts = [thresholds(few.column(c).to_numpy().astype(np.float64), n, bins) for c in numbers]
    drawn = bootstrapped(rows, trees, seed, cuts).persist(StorageLevel.DISK_ONLY)
    sizes = [*(k + 1 for k in values), *(len(c) + 1 for c in cuts)]
    layout = {"sizes": sizes, "categories": len(values), "trees": trees}
    grown = _Trees(trees)
    opened = np.arange(trees)
    try:
        for level in range(max(1, max_depth)):
            found = _level(drawn, grown, opened, layout, pass_mb)
            if not max_depth:
                found[:, 2] = 0.0
            opened = _children(grown, opened, found, level + 1 >= max_depth, cuts, values)
            if not len(opened):
                break
    finally:
        drawn.unpersist()
    return _table(grown)


def stored(
    spark: SparkSession, nodes: pa.Table, regressor: RandomForestRegressor, features: int, folder: str
) -> RandomForestRegressionModel:
    """The forest of these nodes as Spark's own model, by the folder that saving the model would write."""
    spark.createDataFrame(nodes).coalesce(1).write.parquet(f"{folder}/data")
    params = {p.name: v for p, v in regressor._paramMap.items()}
    defaults = {p.name: v for p, v in regressor._defaultParamMap.items()}
    about = {"timestamp": int(time.time() * 1000), "sparkVersion": spark.version}
    prefix, trees = "org.apache.spark.ml.regression.", regressor.getNumTrees()

    def described(kind: str, uid: str, left_out: Iterable[str] = (), **more: int) -> str:
        given = [{k: v for k, v in x.items() if k not in left_out} for x in (params, defaults)]
        return json.dumps({"class": prefix + kind, "uid": uid, **about, "paramMap": given[0], "defaultParamMap": given[1], **more})

    whole = described("RandomForestRegressionModel", regressor.uid, numFeatures=features, numTrees=trees)
    spark.createDataFrame([(whole,)], "value string").coalesce(1).write.text(f"{folder}/metadata")
    # What a single tree does not know of.
    forests = {p.name for p in regressor.params} - {p.name for p in DecisionTreeRegressor().params}
    of_tree = [(t, described("DecisionTreeRegressionModel", f"{regressor.uid}_{t}", forests), 1.0) for t in range(trees)]
    spark.createDataFrame(of_tree, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{folder}/treesMetadata")
    return RandomForestRegressionModel.load(folder)


def _level(drawn: DataFrame, grown: _Trees, opened: np.ndarray, layout: dict, pass_mb: int) -> np.ndarray:
    """The best split of each open node. Where rounding may have decided between candidates, those nodes are looked
    at again with the sums that Spark's trainer takes: all rows without a value, in their order."""
    found, doubtful, among = _looked(drawn, grown, opened, layout, pass_mb)
    if len(doubtful):
        trees = np.unique(grown.tree[opened[doubtful]])
        # The statistics of a root are those of its first candidate.
        first = [0] if grown.level.max() == 0 and layout["sizes"][0] > 1 else []
        again = {int(t): np.unique(np.array([*first, *among.get(int(t), ())], np.int64)) for t in trees}
        nodes = opened[doubtful]
        parent = grown.parent[nodes]
        by_value = nodes[(parent >= 0) & (grown.kinds[parent] == 2)]
        wanted = np.unique(np.concatenate([nodes, by_value, grown.sibling[by_value]]))
        wanted = wanted[np.argsort(grown.tree[wanted], kind="stable")]
        second, _, _ = _looked(drawn, grown, wanted, layout, pass_mb, again)
        found[doubtful] = second[np.searchsorted(_order(grown, wanted), _order(grown, nodes))]
    return found


def _order(grown: _Trees, nodes: np.ndarray) -> np.ndarray:
    return grown.tree[nodes].astype(np.int64) * len(grown.tree) + nodes


def _looked(
    drawn: DataFrame, grown: _Trees, opened: np.ndarray, layout: dict, pass_mb: int, among: dict[int, np.ndarray] | None = None
) -> tuple[np.ndarray, np.ndarray, dict[int, np.ndarray]]:
    """The best split of each node, in as many passes as the memory for sums takes; the nodes of doubt, and by tree
    the candidates that concerns."""
    trees = layout["trees"]
    counts = np.bincount(grown.tree[opened], minlength=trees)
    slots = counts[grown.tree].astype(np.intp)
    # Open nodes of a tree lie together, in order.
    firsts = np.cumsum(counts) - counts
    slots[opened] = np.arange(len(opened)) - firsts[grown.tree[opened]]
    nodes = {name: getattr(grown, name) for name in ("source", "low", "high", "left", "right")}
    nodes |= {"roots": np.arange(trees), "depth": np.array(grown.level.max())}
    runs = {int(t): opened[firsts[t] : firsts[t] + counts[t]] for t in np.flatnonzero(counts)}
    rooted = grown.level.max() == 0
    whole = {} if rooted else {t: grown.stats[:, run] for t, run in runs.items()}
    kin = {}
    if among is not None and not rooted:
        for t, run in runs.items():
            of = np.searchsorted(run, grown.sibling[run])
            of = np.minimum(of, len(run) - 1)
            paired = (run[of] == grown.sibling[run]) & (grown.kinds[grown.parent[run]] == 2)
            kin[t] = np.where(paired, of, np.arange(len(run))), run < grown.sibling[run]
    found = np.zeros((len(opened), _FOUND))
    doubtful, near = [], {}
    context = drawn.sparkSession.sparkContext
    spec = layout | {"nodes": nodes, "slots": slots, "open": counts.tolist(), "among": among}
    for group in _passes(counts, [_width(layout["sizes"], among, t) if counts[t] else 0 for t in range(trees)], pass_mb << 20):
        sent = context.broadcast(spec | {"group": group})
        stats = {"among": among, "whole": {t: whole[t] for t in group if t in whole}, "kin": {t: kin[t] for t in group if t in kin}}
        stats = context.broadcast(layout | stats)
        with shuffles_removed(drawn.sparkSession):
            partial = drawn.mapInArrow(_with(_summed, sent), _ddl(_PARTIAL))
            splits = partial.groupBy("tree", "begin").applyInArrow(_with(_chosen, stats), _ddl(_SPLITS))
            rows = splits.collect()  # a row a tree, or a few
        for row in rows:
            at = firsts[row["tree"]] + row["begin"]
            part = np.frombuffer(row["found"], np.float64).reshape(-1, _FOUND)
            found[at : at + len(part)] = part
            doubtful.append(at + np.frombuffer(row["doubtful"], np.int64))
            near.setdefault(row["tree"], []).extend(np.frombuffer(row["near"], np.int64).tolist())
        sent.destroy()
        stats.destroy()
    return found, np.sort(np.concatenate(doubtful)), near


def _with(work: Callable, sent: Broadcast) -> Callable:
    return lambda table: work(table, sent.value)


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {'int' if f.type == pa.int32() else 'binary'}" for f in schema)


def _passes(counts: np.ndarray, widths: list[int], limit: int) -> Iterator[list[int]]:
    """Trees whose open nodes' sums fit the limit together, one at least."""
    group, held = [], 0
    for tree in np.flatnonzero(counts).tolist():
        size = int(counts[tree] + 1) * widths[tree] * 24
        if group and held + size > limit:
            yield group
            group, held = [], 0
        group.append(tree)
        held += size
    if group:
        yield group


def _children(
    grown: _Trees, opened: np.ndarray, found: np.ndarray, last: bool, cuts: list[np.ndarray], values: list[int]
) -> np.ndarray:
    """Split the nodes that gain by it; returns the children that may be split in turn."""
    chosen, own, gain = found[:, 0].astype(int), found[:, 1] > 0, found[:, 2]
    grown.stats[:, opened] = found[:, 4:7].T
    grown.impurity[opened] = np.where(np.isneginf(gain), -1.0, found[:, 3])
    splits = gain > 0
    at, chosen, own = opened[splits], chosen[splits], own[splits]
    grown.gain[at] = gain[splits]
    # Candidates: the values of each category, then the cuts of each number.
    counts = np.array([*values, *map(len, cuts)])
    ends = np.cumsum(counts)
    source = np.searchsorted(ends, chosen, side="right")
    position = chosen - (ends - counts)[source]
    cell = position + (np.cumsum([*(n + 1 for n in values), *(len(c) + 1 for c in cuts)]) - (counts + 1))[source]
    category = source < len(values)
    features = np.concatenate([ends[: len(values)] - np.array(values, int), sum(values) + np.arange(len(cuts))])
    grown.source[at] = source
    grown.feature[at] = (features[source] + np.where(category, position, 0)).astype(int)
    grown.kinds[at] = np.where(category, 2, -1)
    number = np.concatenate(cuts) if len(cuts) else np.zeros(0)
    flat = np.clip(chosen - sum(values), 0, max(len(number) - 1, 0))
    grown.cut[at] = np.where(category, own, number[flat] if len(number) else 0.0)
    grown.low[at] = np.where(category, cell - 1, cell)
    grown.high[at] = np.where(category, cell, np.inf)
    level = int(grown.level[opened[0]]) + 1 if len(opened) else 0
    sides = [found[splits, 7:10].T, found[splits, 10:13].T]
    # A tree's new nodes lie together.
    stats = np.stack(sides, axis=2).reshape(3, -1)
    leaf = np.abs(_variance(stats)) < EPSILON if not last else np.ones(stats.shape[1], bool)
    new = grown.add(np.repeat(grown.tree[at], 2), level, stats, leaf)
    left, right = new[0::2], new[1::2]
    # Inside the interval goes right; where a category's own value belongs on the left, the sides are swapped.
    grown.parent[left], grown.parent[right] = at, at
    grown.sibling[left], grown.sibling[right] = right, left
    grown.left[at], grown.right[at] = np.where(own, right, left), np.where(own, left, right)
    return new[~leaf]


def _table(grown: _Trees) -> pa.Table:
    """Nodes as Spark stores them, parents before children; two leaves that say the same become one."""
    n = len(grown.tree)
    own = (grown.kinds == 2) & (grown.cut == 1.0)
    left, right = np.where(own, grown.right, grown.left), np.where(own, grown.left, grown.right)
    leaf = left == np.arange(n)
    says = _mean(grown.stats)
    size = np.ones(n, np.int64)
    kept = np.ones(n, bool)
    levels = [np.flatnonzero(grown.level == k) for k in range(int(grown.level.max()) + 1)]
    for at in reversed(levels):
        inner = at[~leaf[at]]
        a, b = left[inner], right[inner]
        same = leaf[a] & leaf[b] & (says[a] == says[b])
        leaf[inner[same]] = True
        says[inner[same]] = says[a[same]]
        kept[a[same]] = kept[b[same]] = False
        inner, a, b = inner[~same], a[~same], b[~same]
        size[inner] += size[a] + size[b]
    order = np.zeros(n, np.int64)
    for at in levels:
        inner = at[~leaf[at]]
        order[left[inner]] = order[inner] + 1
        order[right[inner]] = order[inner] + 1 + size[left[inner]]
    rows = np.flatnonzero(kept)
    rows = rows[np.lexsort((order[rows], grown.tree[rows]))]
    leaf = leaf[rows]

    def lists(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(values))

    split = pa.StructArray.from_arrays(
        [
            pa.array(np.where(leaf, -1, grown.feature[rows]).astype(np.int32)),
            lists(grown.cut[rows][~leaf], np.where(leaf, 0, 1)),
            pa.array(np.where(leaf, -1, grown.kinds[rows]).astype(np.int32)),
        ],
        ["featureIndex", "leftCategoriesOrThreshold", "numCategories"],
    )
    node = {
        "id": order[rows].astype(np.int32),
        "prediction": says[rows],
        "impurity": grown.impurity[rows],
        "impurityStats": lists(np.ascontiguousarray(grown.stats[:, rows].T).ravel(), np.full(len(rows), 3)),
        "rawCount": grown.stats[0, rows].astype(np.int64),
        "gain": np.where(leaf, -1.0, grown.gain[rows]),
        "leftChild": np.where(leaf, -1, order[left[rows]]).astype(np.int32),
        "rightChild": np.where(leaf, -1, order[right[rows]]).astype(np.int32),
        "split": split,
    }
    columns = [x if isinstance(x, pa.Array) else pa.array(x) for x in node.values()]
    return pa.table({"treeID": grown.tree[rows], "nodeData": pa.StructArray.from_arrays(columns, list(node))})
