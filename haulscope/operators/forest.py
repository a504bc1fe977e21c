"""A trained forest as flat arrays, evaluated tree by tree over batches of rows.

All trees lie one after another in five arrays: which input a node looks at, the interval of values
that goes to the right child, the two children, and the value. A batch comes down the upper levels of a tree
by a look-up an input, and from there takes a step a level, with no loop over rows.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F

# What runs inside tasks travels with the plan: executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Nodes of all trees together: 24 bytes each travel to every task.
MAX_NODES = 8_000_000
# Nodes of all trees, one after another, by name. A node's rows go right when ``low < x <= high`` for its
# input ``source``; a leaf is its own child on both sides, so that rows which have arrived stay.
# ``roots`` has the first node of each tree, ``depth`` the most steps to a leaf.
Nodes = dict[str, np.ndarray]


class Walk:
    """A forest with cells for bounds: between any two neighbouring bounds of an input lies one cell."""

    def __init__(self, nodes: Nodes, inputs: int) -> None:
        inner = nodes["left"] != np.arange(len(nodes["left"]))
        low, high = np.zeros(len(inner)), np.full(len(inner), np.inf)
        self.cuts, begin = [], 0
        for number in range(inputs):
            asked = inner & (nodes["source"] == number)
            bounds = np.concatenate([nodes["low"][asked], nodes["high"][asked]])
            cuts = np.unique(bounds[np.isfinite(bounds)])
            low[asked] = begin + np.searchsorted(cuts, nodes["low"][asked])
            upper = nodes["high"][asked]
            high[asked] = np.where(np.isfinite(upper), begin + np.searchsorted(cuts, upper), np.inf)
            self.cuts.append(cuts)
            begin += len(cuts) + 1
        self.sizes = [len(cuts) + 1 for cuts in self.cuts]
        self.nodes = nodes | {"source": nodes["source"].astype(np.intp), "low": low, "high": high}
        self.posts = [signposts(self.nodes, self.sizes, tree) for tree in range(len(nodes["roots"]))]

    def trees(self, inputs: np.ndarray) -> np.ndarray:
        """What each tree says of each row; ``inputs`` has one row an input. A value that is none goes left."""
        starts = np.cumsum(self.sizes) - self.sizes
        values = np.where(np.isnan(inputs), -np.inf, inputs)
        cells = np.stack([begin + np.searchsorted(c, x) for begin, c, x in zip(starts, self.cuts, values)])
        found = np.empty((len(self.posts), inputs.shape[1]))
        for tree, posts in enumerate(self.posts):
            self.nodes["value"].take(arrived(self.nodes, posts, cells), out=found[tree])
        return np.ascontiguousarray(found.T)


# Levels of a tree that one look-up an input takes a row down: as many nodes as a word has bits.
TOP = 6
Posts = tuple[np.ndarray, np.ndarray]


def signposts(nodes: Nodes, sizes: list[int], tree: int) -> Posts:
    """For the upper levels of a tree: a word for each cell of each input, and the nodes of its bits. A node's bit is set
    where the cell fits all conditions on the way to it, so that of a row's words only one bit is left in
    common. ``nodes`` have cells for bounds, ``sizes`` tells how many cells each input has."""
    cell = np.arange(sum(sizes))
    owner = np.repeat(np.arange(len(sizes)), sizes)
    at = nodes["roots"][tree : tree + 1].astype(np.intp)
    fits = np.ones((1, len(cell)), bool)
    for _ in range(TOP):
        inner = nodes["left"][at] != at
        if not inner.any():
            break
        source, low, high = (nodes[name][at][:, None] for name in ("source", "low", "high"))
        asked = (owner == source) & inner[:, None]
        inside = (cell > low) & (cell <= high)
        right = (fits & ~(asked & ~inside))[inner]
        fits = np.concatenate([fits & ~(asked & inside), right])
        at = np.concatenate([nodes["left"][at], nodes["right"][at[inner]]])
    bits = np.int64(1) << np.arange(len(at))
    words = np.bitwise_or.reduce(np.where(fits, bits[:, None], 0), axis=0)
    return words, np.concatenate([at, np.zeros(2**TOP - len(at), np.intp)])


def arrived(nodes: Nodes, posts: Posts, cells: np.ndarray) -> np.ndarray:
    """The node of a tree that each row has come to; ``cells`` has one row an input."""
    words, ends = posts
    common = words.take(cells[0])
    for one in cells[1:]:
        common &= words.take(one)
    # The exponent of a power of two is the number of its bit.
    exponent = common.astype(np.float64).view(np.int64) >> 52
    node = ends.take((exponent + 1) & (2**TOP - 1))
    if (left := int(nodes["depth"]) - TOP) > 0:
        flat, rows = cells.ravel(), np.arange(cells.shape[1])
        for _ in range(left):
            x = flat.take(rows + nodes["source"].take(node) * len(rows))
            inside = (x > nodes["low"].take(node)) & (x <= nodes["high"].take(node))
            node = np.where(inside, nodes["right"].take(node), nodes["left"].take(node))
    return node


def flatten(spark: SparkSession, saved: str, categories: list[int]) -> Nodes:
    """The forest that a Spark model has saved, over these inputs: the index of each category, then
    the numbers. ``categories`` tells how many features each category has been spread over.

    The node table depends on trees and depth only, not on rows; larger ones are refused.
    """
    nodes = spark.read.parquet(f"{saved}/data").select(
        "treeID",
        F.col("nodeData.id").alias("id"),
        F.col("nodeData.prediction").alias("value"),
        F.col("nodeData.leftChild").alias("left"),
        F.col("nodeData.rightChild").alias("right"),
        F.col("nodeData.split.featureIndex").alias("feature"),
        F.col("nodeData.split.numCategories").alias("kinds"),
        F.size("nodeData.split.leftCategoriesOrThreshold").alias("bounds"),
        F.coalesce(F.get("nodeData.split.leftCategoriesOrThreshold", F.lit(0)), F.lit(0.0)).alias("bound"),
    )
    if (count := nodes.count()) > MAX_NODES:
        raise ValueError(f"the forest has {count:,} nodes, {MAX_NODES:,} at most")
    table = nodes.orderBy("treeID", "id").toArrow()
    tree = table.column("treeID").to_numpy()
    roots = np.flatnonzero(np.concatenate([[True], tree[1:] != tree[:-1]]))
    first = np.repeat(roots, np.diff(np.append(roots, len(tree))))
    at = np.arange(len(tree))
    child = {side: table.column(side).to_numpy() for side in ("left", "right")}
    leaf = child["left"] < 0
    left, right = (np.where(leaf, at, first + child[side]).astype(np.int32) for side in ("left", "right"))

    # The first bound of each node; leaves have none.
    lengths = table.column("bounds").to_numpy()
    bound = table.column("bound").to_numpy()
    feature = table.column("feature").to_numpy().astype(np.int64)
    kinds = table.column("kinds").to_numpy()

    # Numbers: above the threshold goes right.
    ends = np.cumsum(categories)
    source = (feature - (ends[-1] if categories else 0) + len(categories)).astype(np.int16)
    low, high = bound.astype(np.float64), np.full(len(tree), np.inf)
    # One feature of a category: 1 where the index is that of the feature, else 0.
    for number, end in enumerate(ends):
        inside = (feature < end) & (feature >= end - categories[number]) & ~leaf
        index = feature - (end - categories[number])
        source[inside] = number
        low[inside], high[inside] = index[inside] - 0.5, index[inside] + 0.5
        # As a threshold 0 always goes left; as a set of values, left may hold the 1.
        ones_left = inside & (kinds > 0) & (lengths == 1) & (bound == 1.0)
        left[ones_left], right[ones_left] = right[ones_left].copy(), left[ones_left].copy()
    source[leaf] = 0
    return {
        "source": source, "low": low, "high": high, "left": left, "right": right,
        "value": table.column("value").to_numpy(), "roots": roots.astype(np.int32),
        "depth": np.array(_depth(left, right, roots)),
    }


def _depth(left: np.ndarray, right: np.ndarray, roots: np.ndarray) -> int:
    steps, level = 0, roots
    while True:
        level = np.concatenate([left[level], right[level]])
        level = np.unique(level[(left[level] != level) | (right[level] != level)])
        if not len(level):
            return steps + 1
        steps += 1


def evaluate(
    df: DataFrame, nodes: Nodes, inputs: list[str], keep: list[str], quantile: float, each_tree: bool = True
) -> DataFrame:
    """The ``keep`` columns with ``tree_estimates`` (unless not wanted), their mean ``estimate``, and ``margin``:
    ``quantile`` times their deviation. ``inputs`` are the columns that the forest was flattened for. Rows stay
    where they are; a task holds the nodes and some thousand rows at a time."""
    sent = df.sparkSession.sparkContext.broadcast(nodes)
    fields = [df.schema[c] for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = Walk(sent.value, len(inputs))
        for batch in batches:
            for begin in range(0, batch.num_rows, _CHUNK):
                part = batch.slice(begin, _CHUNK)
                columns = [part.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in inputs]
                found = walk.trees(np.stack(columns))
                mean = found.mean(axis=1)
                margin = quantile * np.sqrt(((found - mean[:, None]) ** 2).mean(axis=1))
                new = {"estimate": pa.array(mean), "margin": pa.array(margin)}
                if each_tree:
                    offsets = np.arange(len(found) + 1, dtype=np.int32) * found.shape[1]
                    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(found.ravel()))
                    new = {"tree_estimates": lists, **new}
                arrays = [*(part.column(n) for n in keep), *new.values()]
                yield pa.RecordBatch.from_arrays(arrays, [*keep, *new])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    schema += f"{', tree_estimates array<double>' if each_tree else ''}, estimate double, margin double"
    return df.mapInArrow(run, schema)


# Rows of a result batch: a number for each tree and row goes back to Spark.
_CHUNK = 4_096
