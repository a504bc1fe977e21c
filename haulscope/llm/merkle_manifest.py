"""A Merkle tree over a dataset, kept as an append log in postorder.

Each source has a tree of its own: its rows in the order of doc_id are the leaves, and every 16
consecutive nodes of a level (the last run may be shorter) are hashed into a node of the next one
until a single node is left. The roots of all sources, in the order of the sources, are the leaves
of one more tree.

Rows get their place by a range partitioning and the partitions' counts. Builders are aligned: each
takes 256 consecutive nodes of one tree, starting at a multiple of 256, and appends every node when
it is complete, which is postorder. So a builder writes a whole subtree (a *segment*), whose top is
a leaf of the next round's builders. A tree of n leaves takes log256(n) rounds, and no builder ever
sees more than 256 nodes, whatever the size of its source.

Where a node lies in postorder follows from the sizes of subtrees (``position``), so proofs are read
off the log by address: siblings of a leaf inside its segment, those of the segment's top in the
next round's segment, and so on down from the root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from haulscope.llm import common
from haulscope.operators.joins import join_measured

FAN = 16
# Levels that a builder adds, and the nodes it starts from.
RISE = 2
SEGMENT = FAN**RISE
# Characters of a digest.
HEX = 64
# Every so many doc_ids, by CRC-32, the query tampers with a row.
TAMPER_EVERY = 5
# Parts that equal rows are dealt to before the range partitioning.
SALT = 997

PATH = "array<struct<left:string,right:string>>"
_SEGMENTS = "tree string, seg bigint, size bigint, n bigint, m int, up int, log string, ids array<bigint>, other array<string>"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def height(n: int) -> int:
    """Levels above the leaves of a tree with ``n`` leaves."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FAN), levels + 1
    return levels


def position(n: int, level: int, index: int, top: int | None = None) -> int:
    """Place in postorder of a node of a tree with ``n`` leaves and ``top`` levels above them.

    Before it come the leaves up to its own last one, the nodes of its own and lower levels up to
    there, and the nodes of higher levels that ended earlier.
    """
    end = min((index + 1) * FAN**level, n)
    before = end - 1
    for step in range(1, (height(n) if top is None else top) + 1):
        size = FAN**step
        before += -(-end // size) if step <= level else (end - 1) // size
    return before


def append_log(leaves: list[str], up: int) -> list[str]:
    """All nodes of a subtree that rises ``up`` levels, in the order of their completion."""
    log: list[str] = []
    waiting: list[list[str]] = [[] for _ in range(up + 1)]

    def add(level: int, node: str) -> None:
        log.append(node)
        waiting[level].append(node)

    def complete(level: int) -> None:
        run = digest("".join(waiting[level]))
        waiting[level].clear()
        add(level + 1, run)

    for leaf in leaves:
        add(0, leaf)
        level = 0
        while level < up and len(waiting[level]) == FAN:
            complete(level)
            level += 1
    for level in range(up):  # runs that the end has cut short
        if waiting[level]:
            complete(level)
    return log


def siblings(log: str, m: int, up: int, leaf: int) -> list[tuple[str, str]]:
    """Of a segment's log (digests one after another): per level what is left and right of the leaf's
    ancestor in its run, addressed by position."""
    path = []
    for level in range(up):
        own = leaf // FAN**level
        first = own - own % FAN
        last = min(first + FAN, -(-m // FAN**level))
        run = [HEX * position(m, level, i, up) for i in range(first, last)]
        parts = [log[at : at + HEX] for at in run]
        path.append(("".join(parts[: own - first]), "".join(parts[own - first + 1 :])))
    return path


def fold(node: str, path: list[tuple[str, str]]) -> str:
    """The root that follows from a node and its siblings."""
    for left, right in path:
        node = digest(left + node + right)
    return node


# --- places and segments ----------------------------------------------------------------------


def ranked(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with ``rank`` in their ``tree`` (from 0) and the tree's size ``n``.

    Rows are partitioned by range and stored in order; a row's rank is its place in its partition
    plus the rows of the tree in the partitions before. A tree may span many partitions.
    """
    spread = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    spread = spread.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()})
    stored = common.written(spread, "leaves-in-order")
    parts = stored.groupBy("tree", "part").agg(F.count("*").alias("rows"), F.min("at").alias("first"))
    own = Window.partitionBy("tree")
    earlier = own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select(
        "tree",
        "part",
        (F.coalesce(F.sum("rows").over(earlier), F.lit(0)) - F.col("first")).alias("shift"),
        F.sum("rows").over(own).alias("n"),
    )
    placed = join_measured(stored, starts, ["tree", "part"], "inner")
    return placed.withColumn("rank", F.col("at") + F.col("shift")).drop("part", "at", "shift")


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes sorted by tree, segment and rank to one row a segment."""
    held: list[tuple] = []

    def segment() -> pa.RecordBatch:
        tree, seg, size, n = held[0][:4]
        up = 0 if n == 1 else 1 if n <= FAN else RISE
        log = append_log([row[4] for row in held], up)
        row = {
            "tree": tree, "seg": seg, "size": size, "n": n, "m": len(held), "up": up,
            "log": "".join(log), "ids": [row[5] for row in held], "other": [row[6] for row in held],
        }
        return pa.RecordBatch.from_pylist([row], _ARROW)

    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("tree", "seg", "size", "n", "digest", "id", "other"))
        for row in zip(*columns, strict=True):
            if held and row[:2] != held[0][:2]:
                yield segment()
                held = []
            held.append(row)
    if held:
        yield segment()


_ARROW = pa.schema(
    [
        ("tree", pa.string()),
        ("seg", pa.int64()),
        ("size", pa.int64()),
        ("n", pa.int64()),
        ("m", pa.int32()),
        ("up", pa.int32()),
        ("log", pa.string()),
        ("ids", pa.list_(pa.int64())),
        ("other", pa.list_(pa.string())),
    ]
)


def segments(nodes: DataFrame) -> list[DataFrame]:
    """All rounds of segments over ranked nodes (tree, rank, n, digest, id, other), lowest first.

    ``size`` is the number of leaves of the tree, ``n`` the nodes that its round starts from, ``m``
    those of the segment, ``up`` the levels added, ``log`` all its nodes in postorder.
    """
    rounds: list[DataFrame] = []
    nodes = nodes.withColumn("size", F.col("n"))
    while True:
        dealt = nodes.withColumn("seg", F.floor(F.col("rank") / SEGMENT))
        dealt = dealt.repartition("tree", "seg").sortWithinPartitions("tree", "seg", "rank")
        built = common.written(dealt.mapInArrow(_build, _SEGMENTS), "merkle-segments")
        rounds.append(built)
        higher = built.where(F.col("n") > SEGMENT)
        if higher.isEmpty():
            return rounds
        nodes = higher.select(
            "tree",
            F.col("seg").alias("rank"),
            "size",
            F.ceil(F.col("n") / SEGMENT).alias("n"),
            _top().alias("digest"),
            F.lit(None).cast("bigint").alias("id"),
            F.lit(None).cast("string").alias("other"),
        )


def _top() -> Column:
    """The last node of a segment's log."""
    return F.right("log", F.lit(HEX))


def roots(rounds: list[DataFrame]) -> DataFrame:
    """The root of each tree (tree, digest)."""
    tops = [r.where(F.col("n") <= SEGMENT).select("tree", _top().alias("digest")) for r in rounds]
    found = tops[0]
    for more in tops[1:]:
        found = found.unionByName(more)
    return found


@dataclass(frozen=True)
class Manifest:
    """Segments of the sources' trees and of the tree over their roots; ``sources`` has tree,
    source, subroot, rank and n (number of sources)."""

    rounds: list[DataFrame]
    sources: DataFrame
    root_rounds: list[DataFrame]

    def root(self) -> str | None:
        """The root of the dataset; None if it has no rows."""
        found = roots(self.root_rounds).first()
        return found.digest if found else None

    def log(self) -> DataFrame:
        """Every node of the sources' trees: source, level, index, position in postorder, digest."""
        parts = []
        for number, built in enumerate(self.rounds):
            parts.append(built.mapInArrow(_numbered(number), "tree string, level int, index bigint, position bigint, digest string"))
        found = parts[0]
        for more in parts[1:]:
            found = found.unionByName(more)
        return found.join(self.sources.select("tree", "source"), "tree").drop("tree")


def _numbered(number: int):
    """Segments of a round to their nodes, with their place in the postorder of the whole tree."""
    names = ("tree", "level", "index", "position", "digest")
    kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string())
    base = number * RISE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                found = []
                # What higher rounds start from are tops of the round below: in the log already.
                for level in range(1 if number else 0, row["up"] + 1):
                    for i in range(-(-row["m"] // FAN**level)):
                        at = HEX * position(row["m"], level, i, row["up"])
                        index = row["seg"] * FAN ** (RISE - level) + i
                        place = position(row["size"], base + level, index)
                        found.append((row["tree"], base + level, index, place, row["log"][at : at + HEX]))
                columns = zip(*found, strict=True)
                arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)] if found else []
                if found:
                    yield pa.RecordBatch.from_arrays(arrays, list(names))

    return run


# --- proofs -----------------------------------------------------------------------------------


def _path(row: dict) -> list[tuple[str, str]]:
    return [(step["left"], step["right"]) for step in row["above"]]


def _children(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments with the path above them to the segments of the round below with theirs."""
    schema = pa.schema([("tree", pa.string()), ("seg", pa.int64()), ("above", _ARROW_PATH)])
    for batch in batches:
        for row in batch.select(["tree", "seg", "m", "up", "log", "above"]).to_pylist():
            above = _path(row)
            paths = [siblings(row["log"], row["m"], row["up"], i) + above for i in range(row["m"])]
            found = [
                {
                    "tree": row["tree"],
                    "seg": row["seg"] * SEGMENT + i,
                    "above": [{"left": a, "right": b} for a, b in path],
                }
                for i, path in enumerate(paths)
            ]
            yield pa.RecordBatch.from_pylist(found, schema)


_ARROW_PATH = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


def _proofs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lowest segments with the path above them to one row a leaf."""
    names = ("tree", "doc_id", "leaf", "proof_sha256", "folded_root")
    kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string())
    for batch in batches:
        for row in batch.select(["tree", "m", "up", "log", "ids", "other", "above"]).to_pylist():
            above, found = _path(row), []
            for i, (key, other) in enumerate(zip(row["ids"], row["other"], strict=True)):
                at = HEX * position(row["m"], 0, i, row["up"])
                leaf = row["log"][at : at + HEX]
                path = siblings(row["log"], row["m"], row["up"], i) + above
                proof = digest("".join(left + right for left, right in path))
                found.append((row["tree"], key, leaf, proof, fold(other or leaf, path)))
            columns = zip(*found, strict=True)
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, list(names))


def with_paths(rounds: list[DataFrame], heads: DataFrame) -> DataFrame:
    """The lowest segments with the path from their top to the root (``above``), from the highest
    round down; ``heads`` has the path above each tree's root."""
    above: DataFrame | None = None
    for number in reversed(range(len(rounds))):
        built = rounds[number]
        found = join_measured(built.where(F.col("n") <= SEGMENT), heads, "tree", "inner")
        if above is not None:
            inner = join_measured(built.where(F.col("n") > SEGMENT), above, ["tree", "seg"], "inner")
            found = found.unionByName(inner)
        if number:
            below = found.mapInArrow(_children, f"tree string, seg bigint, above {PATH}")
            above = common.written(below, "merkle-paths")
    return found


def proofs(manifest: Manifest) -> DataFrame:
    """One row a leaf: source, doc_id, leaf, subroot, root, proof_sha256 (of all siblings up to the
    root) and folded_root (what the leaf in ``other``, or else the leaf itself, leads to)."""
    spark = manifest.sources.sparkSession
    everything = spark.createDataFrame([("", [])], f"tree string, above {PATH}")
    tops = with_paths(manifest.root_rounds, everything)
    listed = tops.mapInArrow(_children, f"tree string, seg bigint, above {PATH}")
    root = F.lit(manifest.root()).cast("string").alias("root")
    by_rank = manifest.sources.select("tree", "source", "subroot", F.col("rank").alias("seg"))
    heads = by_rank.join(listed.drop("tree"), "seg").drop("seg")
    heads = common.written(heads.select("*", root), "merkle-heads")
    lowest = with_paths(manifest.rounds, heads.select("tree", "above"))
    schema = "tree string, doc_id bigint, leaf string, proof_sha256 string, folded_root string"
    found = lowest.mapInArrow(_proofs, schema)
    return join_measured(found, heads.drop("above"), "tree", "inner").drop("tree")


# --- documents --------------------------------------------------------------------------------


def leaf(*columns: str | Column) -> Column:
    """A row's digest: each column as its number of UTF-8 bytes, a colon and its value, or ``-``."""
    parts = []
    for column in columns:
        text = (F.col(column) if isinstance(column, str) else column).cast("string")
        sized = F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)
        parts.append(F.coalesce(sized, F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def manifest(docs: DataFrame, other: Column | None = None) -> Manifest:
    """The manifest of a table of documents (doc_id, source, lang, n_chars, text).

    Every row is a leaf. NULL in any column is hashed as such, apart from an empty text; NULL sources
    are a source of their own and come first, NULL doc_ids before other ids of their source. Rows
    with one doc_id are ordered by their digest, so equal rows may stand in either order. Further
    columns are ignored, whatever their names. Texts are hashed in one piece, whatever their length.
    ``other`` (a digest or NULL) travels with the leaf: proofs are folded from it. An empty table
    gives no segments, no nodes and no root.
    """
    tree = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    rows = docs.select(
        tree.alias("tree"),
        F.col("doc_id").cast("bigint").alias("id"),
        leaf("doc_id", "source", "lang", "n_chars", "text").alias("digest"),
        (F.lit(None) if other is None else other).cast("string").alias("other"),
        F.pmod(F.monotonically_increasing_id(), F.lit(SALT)).alias("salt"),
    )
    rows = common.written(rows, "leaves")
    rounds = segments(ranked(rows, "id", "digest", "salt").drop("salt"))
    subroots = common.written(roots(rounds), "subroots")
    nodes = subroots.select(
        F.lit("").alias("tree"),
        F.col("tree").alias("name"),
        "digest",
        F.lit(None).cast("bigint").alias("id"),
        F.lit(None).cast("string").alias("other"),
    )
    placed = common.written(ranked(nodes, "name"), "sources-in-order")
    source = F.when(F.col("name") != "", F.expr("substring(name, 2)"))
    sources = placed.select(
        F.col("name").alias("tree"), source.alias("source"), F.col("digest").alias("subroot"), "rank", "n"
    )
    return Manifest(rounds, sources, segments(placed.drop("name")))


# --- the registered query ---------------------------------------------------------------------


def query(spark: SparkSession, folder: str) -> DataFrame:
    docs = common.read(spark, folder, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPER_EVERY == 0
    lowered = leaf("doc_id", "source", "lang", "n_chars", common.ascii_lower("text"))
    found = proofs(manifest(docs, F.when(hit, lowered)))
    columns = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root")
    return found.select(*columns, (F.col("folded_root") == F.col("root")).alias("verified"))


def oracle(levels: int = 4) -> str:
    """SQL for up to 16 ** ``levels`` rows a source, and as many sources."""
    step = "xor(c, b) >> 1"  # CRC-32, a bit at a time
    crc = f"""xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(
        range(1, length(doc_id::VARCHAR) + 1),
        lambda i: [ascii((doc_id::VARCHAR)[i])::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
        lambda c, b: xor({step}, 3988292384 * (xor(c, b) & 1))), 4294967295)"""
    names = ("doc_id", "source", "lang", "n_chars")
    head = " || ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in names)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

    def hashed(text: str) -> str:
        return f"sha256({head} || coalesce(strlen({text}) || ':' || {text}, '-'))"

    parts = [
        f"""hashed AS (SELECT doc_id, coalesce('=' || source, '') AS tree, {hashed("text")} AS leaf,
            CASE WHEN ({crc}) % 5 = 0
                THEN {hashed(f"translate(text, '{upper}', '{lower}')")} END AS other
            FROM documents)""",
        """placed AS (SELECT *,
            row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx,
            count(*) OVER (PARTITION BY tree) AS n FROM hashed)""",
        "a0 AS (SELECT tree, idx, leaf AS digest, n FROM placed)",
    ]

    def rise(name: str) -> None:
        for k in range(levels):
            parts.append(
                f"""{name}{k + 1} AS (SELECT tree, idx // 16 AS idx,
                CASE WHEN n > 1 THEN sha256(string_agg(digest, '' ORDER BY idx)) ELSE min(digest) END AS digest,
                (n + 15) // 16 AS n FROM {name}{k} GROUP BY tree, idx // 16, n)"""
            )
            parts.append(
                f"""{name}_runs{k} AS (SELECT tree, idx // 16 AS run, list(digest ORDER BY idx) AS run_nodes
                FROM {name}{k} WHERE n > 1 GROUP BY tree, idx // 16)"""
            )

    rise("a")
    parts.append(
        f"""b0 AS (SELECT '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS idx, digest,
        count(*) OVER () AS n, tree AS name FROM a{levels})"""
    )
    rise("b")
    parts.append(
        f"""f0 AS (SELECT placed.*, s.digest AS subroot, s.idx AS tree_idx,
        (SELECT digest FROM b{levels}) AS root, coalesce(other, leaf) AS folded, '' AS proof
        FROM placed JOIN b0 s ON s.name = placed.tree)"""
    )
    joins = [("a", k, "f.tree", "f.idx") for k in range(levels)]
    joins += [("b", k, "''", "f.tree_idx") for k in range(levels)]
    for at, (name, k, tree, idx) in enumerate(joins):
        own = f"({idx} // {16**k}) % 16"
        left = f"coalesce(array_to_string(run_nodes[1:{own}], ''), '')"
        right = f"coalesce(array_to_string(run_nodes[{own} + 2:], ''), '')"
        parts.append(
            f"""f{at + 1} AS (SELECT f.* EXCLUDE (folded, proof),
            CASE WHEN r.run IS NULL THEN folded ELSE sha256({left} || folded || {right}) END AS folded,
            CASE WHEN r.run IS NULL THEN proof ELSE proof || {left} || {right} END AS proof
            FROM f{at} f LEFT JOIN {name}_runs{k} r ON r.tree = {tree} AND r.run = {idx} // {16 ** (k + 1)})"""
        )
    return f"""WITH {", ".join(parts)}
        SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root,
            folded = root AS verified FROM f{len(joins)}"""
