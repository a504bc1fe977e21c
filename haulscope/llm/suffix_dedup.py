"""Removal of long byte strings that repeat anywhere in the corpus.

A suffix array of 100 TB fits nowhere, so the windows of ``length`` bytes are dealt out first. Each
window is put under its anchor: of all 64-byte grams in it, the one with the smallest hash. Equal
windows have equal anchors, so all copies of a window meet under one anchor, and neighbouring
windows share one, which makes a run of windows a single short string. Anchors found once are
dropped; of equal runs one is kept, with their number. Where all runs of an anchor are equal, all of their
bytes repeat. The strings under the remaining anchors, a few hundred bytes each, are then searched together in blocks of bounded size: a block's
Burrows-Wheeler transform is built, and threshold-bounded interval expansion tells which windows
occur twice (see ``interval_expansion``).

An anchor with more different runs than a block may hold is searched by hashes of its windows
instead, which sum up inside tasks and spread over all of them. Texts are fetched once, for the
documents under repeated anchors only; equal documents are worked on once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from haulscope.llm import common
from haulscope.llm.interval_expansion import repeated
from haulscope.operators.joins import join_measured

LENGTH = 400
GRAM = 64
# Bytes of text that a task hashes at once.
SEGMENT = 1 << 21
# Bytes of strings whose transform is built at once; blocks end at an anchor's end.
BLOCK = 1 << 20
# Anchors with more different runs are searched by window hashes.
MAX_RUNS = 2_048

KEYS = ("k1", "k2")
RUN = "start int, n int, h bigint, c bigint"
_ODD = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93]
_ODD += [0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x94D049BB133111EB]


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the 64 bytes from each position, by doubling."""
    x = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(_ODD[0])
    x ^= x >> np.uint64(29)
    for i, step in enumerate((1, 2, 4, 8, 16, 32)):
        y = x[:-step] * np.uint64(_ODD[i + 1])
        y += x[step:]
        x = y
    x ^= x >> np.uint64(31)
    x *= np.uint64(_ODD[1])
    x ^= x >> np.uint64(29)
    return x


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each ``width`` neighbouring values, by running minima of blocks."""
    n = len(values) - width + 1
    rows = -(-len(values) // width)
    grid = np.full(rows * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    grid[: len(values)] = values
    grid = grid.reshape(rows, width)
    forth = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], forth[width - 1 : width - 1 + n])


def anchored_runs(data: np.ndarray, first: np.ndarray, last: np.ndarray, length: int):
    """Runs of windows with one anchor: position of the first window, number, anchor's hash.

    ``first`` and ``last`` bound the windows of each document (last is exclusive).
    """
    hashes = gram_hashes(data)
    tagged = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64)
    anchors = (window_minima(tagged, length - GRAM + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    counts = last - first
    windows = np.arange(int(counts.sum())) + np.repeat(first - (np.cumsum(counts) - counts), counts)
    anchor = anchors[windows]
    new = np.ones(len(windows), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (np.diff(windows) != 1)
    at = np.flatnonzero(new)
    n = np.diff(np.append(at, len(windows)))
    return windows[at], n, hashes[anchor[at]]


def _runs(length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Texts to rows of k1, k2, start, n, h (anchor) and c (content of the run)."""

    def emit(batch: pa.RecordBatch, data: np.ndarray, part: list[tuple[int, int, int, int]]):
        # part: row, where its text starts, first and last window start to take
        lo = part[0][2]
        hi = part[-1][3] + length - 1
        view = data[lo:hi]
        first = np.array([p[2] - lo for p in part])
        last = np.array([p[3] - lo for p in part])
        start, n, h = anchored_runs(view, first, last, length)
        which = np.searchsorted(first, start, "right") - 1
        origin = np.array([p[1] - lo for p in part])[which]
        whole = memoryview(np.ascontiguousarray(view))
        c = [
            xxhash.xxh3_64_intdigest(whole[a : a + m + length - 1])
            for a, m in zip(start.tolist(), n.tolist(), strict=True)
        ]
        rows = pa.array(np.array([p[0] for p in part])[which])
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("k1").take(rows),
                batch.column("k2").take(rows),
                pa.array((start - origin).astype(np.int32)),
                pa.array(n.astype(np.int32)),
                pa.array(h.view(np.int64)),
                pa.array(np.array(c, np.uint64).view(np.int64)),
            ],
            ["k1", "k2", "start", "n", "h", "c"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = _bytes(batch.column("text"))
            part: list[tuple[int, int, int, int]] = []
            for row in range(batch.num_rows):
                begin, end = int(offsets[row]), int(offsets[row + 1])
                at, stop = begin, end - length + 1
                while at < stop:
                    take = min(stop, at + SEGMENT)
                    if part and take - part[0][2] > SEGMENT:
                        yield from emit(batch, data, part)
                        part = []
                    part.append((row, begin, at, take))
                    at = take
            if part:
                yield from emit(batch, data, part)

    return run


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column and where each row's start; NULL is empty."""
    wide = column.fill_null("").cast(pa.large_string())
    _, offsets, data = wide.buffers()
    at = np.frombuffer(offsets, np.int64)[wide.offset : wide.offset + len(wide) + 1]
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)), at


def _strings(length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Held texts to the strings of their representative runs: h, c, w, hot, s."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                runs = batch.column("reps")[i].as_py()
                if not runs:
                    continue
                text = batch.column("text")[i].as_py().encode()
                strings = [text[r["start"] : r["start"] + r["n"] + length - 1] for r in runs]
                columns = [[r[k] for r in runs] for k in ("h", "c", "w", "hot")]
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_())
                arrays = [pa.array(x, t) for x, t in zip(columns, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*arrays, pa.array(strings, pa.binary())], ["h", "c", "w", "hot", "s"]
                )

    return run


def _search(length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Strings sorted by anchor to the runs of bytes that repeat: h, c, cover."""

    def searched(block: list[tuple]) -> pa.RecordBatch:
        found = repeated([s for *_, s in block], [w for *_, w, _ in block], length)
        hits = [(h, c, f) for (h, c, _, _), f in zip(block, found, strict=True) if f]
        return _covers(hits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: list[tuple] = []
        held = 0
        for batch in batches:
            names = ("h", "c", "w", "s")
            columns = (batch.column(n).to_pylist() for n in names)
            for row in zip(*columns, strict=True):
                if held >= BLOCK and row[0] != block[-1][0]:
                    yield searched(block)
                    block, held = [], 0
                if block and row[:2] == block[-1][:2]:
                    continue  # the same run, fetched from equal rows
                block.append(row)
                held += len(row[3])
        if block:
            yield searched(block)

    return run


def _covers(hits: list[tuple[int, int, list[tuple[int, int]]]]) -> pa.RecordBatch:
    span = pa.struct([("a", pa.int32()), ("b", pa.int32())])
    cover = [[{"a": a, "b": b} for a, b in f] for *_, f in hits]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([h for h, *_ in hits], pa.int64()),
            pa.array([c for _, c, _ in hits], pa.int64()),
            pa.array(cover, pa.list_(span)),
        ],
        ["h", "c", "cover"],
    )


def _window_hashes(length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Strings to one row a window: its hash (two halves), and the run and place it comes from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, c, w, s in zip(*(batch.column(x).to_pylist() for x in ("h", "c", "w", "s")), strict=True):
                n = len(s) - length + 1
                digests = b"".join(xxhash.xxh3_128_digest(s[i : i + length]) for i in range(n))
                halves = np.frombuffer(digests, np.int64).reshape(n, 2)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.ascontiguousarray(halves[:, 0])),
                        pa.array(np.ascontiguousarray(halves[:, 1])),
                        pa.array([h] * n, pa.int64()),
                        pa.array([c] * n, pa.int64()),
                        pa.array(np.arange(n, dtype=np.int32)),
                        pa.array([w] * n, pa.int64()),
                    ],
                    ["w1", "w2", "h", "c", "i", "w"],
                )

    return run


def covered_runs(docs: DataFrame, length: int = LENGTH) -> tuple[DataFrame, DataFrame]:
    """The texts under repeated anchors (k1, k2, text), and per text the repeated bytes (spans).

    ``docs`` has k1, k2 (the text's digest), doc_id and text; its texts are read twice.
    """
    runs = docs.select(*KEYS, "text").mapInArrow(_runs(length), f"k1 bigint, k2 bigint, {RUN}")
    runs = common.written(runs, "anchored-runs")
    one = (F.min("c") == F.max("c")).alias("one")
    anchors = runs.groupBy("h").agg(F.count("*").alias("places"), one).where(F.col("places") > 1)
    # Written, so that the join below has two plain inputs and a hot anchor's rows can be split.
    anchors = common.written(anchors, "anchors")
    shared = common.written(runs.join(anchors, "h"), "shared-runs")

    rep = F.min(F.struct(*KEYS, "start", "n")).alias("rep")
    # Where all runs under an anchor are equal, each of their windows repeats, and there is nothing to search.
    alike = shared.where("one").groupBy("h", "c").agg(F.max("n").alias("n"))
    whole = F.array(F.struct(F.lit(0).alias("a"), (F.col("n") + (length - 1)).alias("b"))).alias("cover")
    searched = shared.where(~F.col("one"))
    kinds = searched.groupBy("h", "c").agg(F.count("*").alias("w"), rep, F.max("places").alias("places"))
    many = kinds.where(F.col("places") > MAX_RUNS).groupBy("h").agg(F.count("*").alias("kinds"))
    many = many.where(F.col("kinds") > MAX_RUNS).select("h", F.lit(True).alias("hot"))
    kinds = join_measured(kinds, many, "h", "left")
    listed = kinds.select(
        F.col("rep.k1").alias("k1"),
        F.col("rep.k2").alias("k2"),
        F.struct(
            "rep.start", "rep.n", "h", "c", "w", F.coalesce("hot", F.lit(False)).alias("hot")
        ).alias("r"),
    )
    # One row a text: its representative runs, if any.
    wanted = (
        shared.select(*KEYS, F.lit(None).cast(listed.schema["r"].dataType).alias("r"))
        .distinct()
        .unionByName(listed)
        .groupBy(*KEYS)
        .agg(F.collect_list("r").alias("reps"))
    )
    copies = docs.groupBy(*KEYS).agg(F.min("doc_id").alias("doc_id"))
    wanted = wanted.join(copies, list(KEYS))
    met = docs.alias("d").join(
        wanted.alias("w"),
        (F.col("d.k1") == F.col("w.k1"))
        & (F.col("d.k2") == F.col("w.k2"))
        & F.col("d.doc_id").eqNullSafe(F.col("w.doc_id")),
    )
    held = common.written(met.select("d.k1", "d.k2", "d.text", "w.reps"), "held-texts")

    strings = held.where(F.size("reps") > 0).mapInArrow(
        _strings(length), "h bigint, c bigint, w bigint, hot boolean, s binary"
    )
    strings = common.written(strings, "run-strings")
    dealt = strings.where(~F.col("hot")).repartition("h").sortWithinPartitions("h", "c")
    schema = "h bigint, c bigint, cover array<struct<a:int,b:int>>"
    found = dealt.mapInArrow(_search(length), schema)

    hot = strings.where("hot").dropDuplicates(["h", "c"])
    windows = hot.mapInArrow(
        _window_hashes(length), "w1 bigint, w2 bigint, h bigint, c bigint, i int, w bigint"
    )
    twice = windows.groupBy("w1", "w2").agg(F.sum("w").alias("n")).where(F.col("n") > 1)
    spans = windows.join(twice, ["w1", "w2"]).groupBy("h", "c").agg(
        F.collect_list(F.struct(F.col("i").alias("a"), (F.col("i") + length).alias("b"))).alias("cover")
    )
    cover = found.unionByName(spans).unionByName(alike.select("h", "c", whole))
    back = shared.select(*KEYS, "start", "h", "c").join(cover, ["h", "c"])
    at = F.col("start")
    moved = F.transform(
        "cover", lambda s: F.struct((s["a"] + at).alias("a"), (s["b"] + at).alias("b"))
    )
    per_text = back.select(*KEYS, F.explode(moved).alias("s")).groupBy(*KEYS)
    return held.select(*KEYS, "text"), per_text.agg(F.collect_set("s").alias("spans"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts and repeated bytes to what is left, and the maximal runs removed."""
    span = pa.struct([("first", pa.int32()), ("length", pa.int32())])
    for batch in batches:
        left, removed = [], []
        for text, spans in zip(
            batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True
        ):
            data, merged = text.encode(), []
            for a, b in sorted((s["a"], s["b"]) for s in spans):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(b, merged[-1][1])
                else:
                    merged.append([a, b])
            edges = [0, *(x for run in merged for x in run), len(data)]
            left.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
            removed.append([{"first": a, "length": b - a} for a, b in merged])
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("k1"),
                batch.column("k2"),
                pa.array(left, pa.binary()),
                pa.array([hashlib.sha256(x).hexdigest() for x in left]),
                pa.array(removed, pa.list_(span)),
            ],
            ["k1", "k2", "kept", "kept_sha256", "removed"],
        )


def dedup(docs: DataFrame, length: int = LENGTH, keep_bytes: bool = True) -> DataFrame:
    """All documents with ``n_bytes``, ``removed`` (first, length), ``kept_sha256`` and ``kept``.

    A byte is removed when it lies in a string of ``length`` bytes (100 or more) that starts at
    another place too, in the same document or another one; overlaps count, and strings are judged
    on the input. NULL texts are empty. Every row is a document of its own, so that rows with equal
    texts lose all that is in strings of the length. ``kept`` (binary, since a removed string may
    start or end inside a character) is NULL where nothing is removed; ``keep_bytes=False`` leaves
    it out. Other columns pass through; those with the names of results are replaced.
    """
    if length < GRAM + 36:
        raise ValueError("length: 100 bytes at least")
    docs = common.spare(docs, "n_bytes", "removed", "kept_sha256", "kept", *KEYS)
    k1, k2 = (c.alias(k) for c, k in zip(common.digest("text"), KEYS, strict=True))
    keyed = docs.select("*", k1, k2)
    held, covers = covered_runs(keyed.select(*KEYS, "doc_id", "text"), length)
    held = held.join(covers, list(KEYS))
    schema = (
        "k1 bigint, k2 bigint, kept binary, kept_sha256 string, "
        "removed array<struct<first:int,length:int>>"
    )
    cut = held.mapInArrow(_cut, schema).dropDuplicates(list(KEYS))
    text = F.coalesce("text", F.lit(""))
    counted = keyed.withColumns(
        {"n_bytes": F.octet_length(text).cast("bigint"), "_sha": F.sha2(text, 256)}
    )
    joined = counted.join(cut if keep_bytes else cut.drop("kept"), list(KEYS), "left")
    none = F.array().cast("array<struct<first:int,length:int>>")
    return joined.select(
        *docs.columns,
        "n_bytes",
        F.coalesce("removed", none).alias("removed"),
        F.coalesce("kept_sha256", "_sha").alias("kept_sha256"),
        *(["kept"] if keep_bytes else []),
    )


# --- the registered query ---------------------------------------------------------------------


def query(spark: SparkSession, folder: str) -> DataFrame:
    docs = common.read(spark, folder, "documents").select("doc_id", "text")
    found = dedup(docs, keep_bytes=False)
    total = F.aggregate("removed", F.lit(0).cast("bigint"), lambda a, x: a + x["length"])
    return found.select(
        "doc_id",
        "n_bytes",
        total.alias("n_removed"),
        F.size("removed").cast("bigint").alias("n_spans"),
        "kept_sha256",
    )
