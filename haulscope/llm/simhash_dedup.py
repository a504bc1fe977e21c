"""Near-duplicates by SimHash: fingerprints that differ in at most three bits are linked.

The 64 bits of a fingerprint are cut into 32 segments of two, and each segment is mapped to its
number of set bits. Fingerprints that differ in d bits are at a Manhattan distance of d or less in
this embedding, so a distance above three rules a pair out. The 32 counts make two bands of 16: of
three at most, one band takes one at most. Each band is a grid of cells, one for each vector of
counts; a fingerprint is stored in its own cell and looks into the cells one count up. Every pair
within reach meets in a cell, by the cell it shares or as one band's neighbours. There the
Manhattan distance is taken over both bands, and what is left is verified bit by bit.

Only distinct fingerprints take part. A cell gives back a spanning forest of its links, not all
pairs; a cell with very many fingerprints is split into blocks, each pair of blocks a cell of its
own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from haulscope.llm import common
from haulscope.llm.components import components
from haulscope.llm.simhash_text import fingerprint
from haulscope.operators.joins import join_measured

MAX_BITS = 3
BANDS = 2
FIELDS = 16
# The lower bit of each segment of two.
LOW = 0x5555555555555555
# Fingerprints of a cell that one task compares at once; larger cells are split.
MAX_CELL = 4_096


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [fingerprint(t) for t in batch.column("text").to_pylist()]
        names = [n for n in batch.schema.names if n != "text"]
        prints = pa.array(np.array(found, np.uint64).view(np.int64))
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), prints], [*names, "fp"])


def embedding(fp: np.ndarray) -> np.ndarray:
    """Counts of set bits per segment, as 00, 01 or 11: distances are then counts of unlike bits."""
    low = np.uint64(LOW)
    half = fp >> np.uint64(1)
    return ((fp | half) & low) | (((fp & half) & low) << np.uint64(1))


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fingerprints to rows of band, cell, fp, stored: the own cell and those one count up."""
    fields = np.uint64(1) << np.arange(0, 2 * FIELDS, 2, dtype=np.uint64)
    for batch in batches:
        fp = batch.column("fp").to_numpy(zero_copy_only=False)
        counts = embedding(fp.view(np.uint64))
        for band in range(BANDS):
            cell = (counts >> np.uint64(32 * band)) & np.uint64(0xFFFFFFFF)
            own = cell[:, None]
            # 00 to 01, 01 to 11; a full segment has no cell above.
            up = own | np.where(own & fields, fields << np.uint64(1), fields)
            row, _ = np.nonzero(up != own)
            cells = np.concatenate([cell, up[up != own]]).view(np.int64)
            prints = np.concatenate([fp, fp[row]])
            stored = np.arange(len(prints)) < len(fp)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(prints), band, np.int32)),
                    pa.array(cells),
                    pa.array(prints),
                    pa.array(stored),
                ],
                ["band", "cell", "fp", "stored"],
            )


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by cell to a spanning forest of each cell's links: a, b."""
    names = ("band", "cell", "p", "q", "fp", "stored")
    rest = None
    for batch in batches:
        part = [batch.column(n).to_numpy(zero_copy_only=False) for n in names]
        if rest is not None:
            part = [np.concatenate(x) for x in zip(rest, part, strict=True)]
        new = np.ones(len(part[0]), bool)
        new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in part[:4]])
        starts = np.flatnonzero(new)
        # The last cell may go on in the next batch.
        yield _forest(part[4], part[5], starts[:-1], starts[1:])
        rest = [x[starts[-1] :] for x in part] if len(starts) else part
    if rest is not None and len(rest[0]):
        yield _forest(rest[4], rest[5], np.array([0]), np.array([len(rest[0])]))


def _forest(fp: np.ndarray, stored: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
    held = np.concatenate([[0], np.cumsum(stored)])
    useful = (ends - starts > 1) & (held[ends] > held[starts])
    links: list[tuple[int, int]] = []
    for start, end in zip(starts[useful].tolist(), ends[useful].tolist(), strict=True):
        links.extend(_cell_links(np.unique(fp[start:end])))
    ab = np.array(links, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.ascontiguousarray(ab[:, i])) for i in (0, 1)], ["a", "b"]
    )


def _cell_links(fp: np.ndarray) -> list[tuple[int, int]]:
    bits = fp.view(np.uint64)
    counts = embedding(bits)
    links, left = [], np.arange(len(fp))
    while len(left) > 1:
        frontier, left = left[:1], left[1:]
        while len(frontier) and len(left):
            found = np.full(len(left), -1)
            for at in range(0, len(frontier), 256):
                some = frontier[at : at + 256]
                near = np.bitwise_count(counts[some][:, None] ^ counts[left]) <= MAX_BITS
                i, j = np.nonzero(near)
                exact = np.bitwise_count(bits[some[i]] ^ bits[left[j]]) <= MAX_BITS
                found[j[exact]] = some[i[exact]]
            hit = found >= 0
            frontier = left[hit]
            links += zip(fp[found[hit]].tolist(), fp[frontier].tolist(), strict=True)
            left = left[~hit]
    return links


def links(prints: DataFrame, max_cell: int = MAX_CELL) -> DataFrame:
    """Links (a, b) between distinct fingerprints (``fp``) that keep all components together."""
    rows = prints.mapInArrow(_cells, "band int, cell bigint, fp bigint, stored boolean")
    sizes = prints.mapInArrow(_cells, "band int, cell bigint, fp bigint, stored boolean")
    sizes = sizes.groupBy("band", "cell").agg(F.count("*").alias("n")).where(F.col("n") > max_cell)
    blocks = sizes.select("band", "cell", F.ceil(F.col("n") / max_cell).cast("int").alias("blocks"))
    rows = join_measured(rows, blocks, ["band", "cell"], "left")
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    pairs = F.transform(
        F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(every),
        lambda x: F.struct(
            F.least(x, F.coalesce(own, F.lit(0))).alias("p"),
            F.greatest(x, F.coalesce(own, F.lit(0))).alias("q"),
        ),
    )
    split = rows.select("band", "cell", "fp", "stored", F.explode(pairs).alias("b"))
    split = split.select("band", "cell", "b.p", "b.q", "fp", "stored")
    keys = ["band", "cell", "p", "q"]
    dealt = split.repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(_links, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, max_cell: int = MAX_CELL) -> DataFrame:
    """All documents with ``fingerprint`` (16 hex digits), ``component_id`` and ``component_key``.

    The component of a document is the smallest doc_id that links of at most three unlike bits
    lead to, its own included. Texts without words, NULL among them, have fingerprint zero and are
    linked like all others. NULL doc_ids are ignored as component ids (NULL if there is no other);
    ``component_key``, the least fingerprint of the group as a number, is never NULL. Repeated
    rows and doc_ids give repeated results. Other columns pass through, those with the names of
    results are replaced.
    """
    docs = common.spare(docs, "fingerprint", "component_id", "component_key", "fp", "_key1", "_key2")
    keyed = docs.select("*", *common.digest("text"))
    columns = keyed.select("_key1", "_key2", "doc_id", "text")
    kinds = {f.name: f.dataType.simpleString() for f in columns.schema.fields}
    schema = ", ".join(f"{n} {kinds[n]}" for n in ("_key1", "_key2", "doc_id")) + ", fp bigint"
    prints = common.written(columns.mapInArrow(_fingerprints, schema), "fingerprints")
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    found = components(links(distinct.select("fp"), max_cell))
    rooted = distinct.join(found, distinct["fp"] == found["node"], "left")
    rooted = rooted.select("fp", "least", F.coalesce("component", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.select("fp", "root").join(ids, "root")
    named = named.select("fp", "component_id", F.col("root").alias("component_key"))
    texts = prints.select("_key1", "_key2", "fp").distinct().join(named, "fp")
    joined = keyed.join(texts, ["_key1", "_key2"])
    shown = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return joined.select(*docs.columns, shown, "component_id", "component_key")


# --- the registered query ---------------------------------------------------------------------


def query(spark: SparkSession, folder: str) -> DataFrame:
    docs = common.read(spark, folder, "documents").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", "fingerprint", "component_id")
