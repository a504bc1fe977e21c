"""Alignment of two tokenizers over the same bytes, and how often their tokens meet.

Both tokenizers cut the same bytes, so each has a rising list of the places where its tokens end.
The two lists are intersected by galloping: every end of the shorter list looks for its place in the
longer one by steps that double until they pass it, and then by halving the last step. Places found
in both lists cut the tokens into groups; the ranks of a token's two ends in the longer list are the
range of tokens that overlap it.

How many documents hold a pair of ids linked is counted over the corpus. Each task works on batches
of documents of bounded size and numbers the different pairs of a batch; only these meet the others
in a shuffle, and every batch gets back what its own pairs count.
"""

from __future__ import annotations

import gc
import hashlib
import json
import os
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from haulscope.llm import common

BYTE_TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
PIECE_TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"
# The files are sent along with the tasks; larger ones are refused.
MAX_BYTES = 64 << 20
# Characters of the texts of a batch, at which it is closed; a longer text is a batch of its own.
BATCH_CHARS = 1 << 20
# Words whose ids a task remembers; at that number it starts afresh.
REMEMBERED = 1 << 18
# An id pair is one number: the first id times this, plus the second.
SHIFT = 1 << 32
# Texts are cut before a single space between two characters that are no white space: no token of
# either tokenizer goes across such a place.
CUT = r"(?<=\S)(?= \S)"
# Words of these characters are cut alike by every version of the Unicode tables; they take the faster
# of two encoders of the same vocabulary.
PLAIN = r"[\x09-\x0D\x20-\x7E\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F]*"
# Fixed value: how byte-level vocabularies cut texts before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# Longer words go to the encoder that works in place.
LONG_WORD = 1_000
# Words that are encoded in one text.
TOGETHER = 512


# --- galloping --------------------------------------------------------------------------------


def gallop(longer: np.ndarray, wanted: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """For each wanted value the first index from ``start`` on, and before ``stop``, whose value is not
    smaller: doubling steps from ``start`` and then halving. ``stop`` where all are smaller.

    Each value has bounds of its own, so that many pairs of lists, laid end to end, are searched at
    once.
    """
    low, high = start.copy(), stop.copy()  # the answer is in low..high
    live = np.flatnonzero(low < high)
    step = 1
    while len(live):
        probe = np.minimum(start[live] + step - 1, stop[live] - 1)
        small = longer[probe] < wanted[live]
        low[live[small]] = probe[small] + 1
        high[live[~small]] = probe[~small]
        live = live[small]
        live = live[low[live] < stop[live]]
        step *= 2
    live = np.flatnonzero(low < high)
    while len(live):
        middle = (low[live] + high[live]) // 2
        small = longer[middle] < wanted[live]
        low[live[small]] = middle[small] + 1
        high[live[~small]] = middle[~small]
        live = live[low[live] < high[live]]
    return low


def ranks(shorter: np.ndarray, longer: np.ndarray, n_short: np.ndarray, n_long: np.ndarray) -> np.ndarray:
    """Index in ``longer`` of the first end that is not before each end of ``shorter``.

    Both hold the ends of many documents, one after another, ``n_short`` and ``n_long`` each. The i-th of
    n ends gallops from the i-th n-th part of the longer list if the end there is smaller, else from
    a stretch before it, else from the document's first end.
    """
    first_short = np.repeat(np.cumsum(n_short) - n_short, n_short)
    first = np.repeat(np.cumsum(n_long) - n_long, n_short)
    m, n = np.repeat(n_long, n_short), np.repeat(n_short, n_short)
    nth = np.arange(len(shorter)) - first_short
    guess = first + (nth * m) // n
    begin = np.maximum(first, guess - np.maximum(8, m // 16))
    begin = np.where(longer[begin] < shorter, begin, first)
    begin = np.where(longer[guess] < shorter, guess, begin)
    return gallop(longer, shorter, begin, first + m)


class Tokens:
    """Ids of many documents, one after another, and how many each has."""

    def __init__(self, ids: np.ndarray, counts: np.ndarray):
        self.ids, self.counts = ids, counts

    @classmethod
    def of(cls, lists: list[list[int]]) -> Tokens:
        counts = np.array([len(x) for x in lists], np.int64)
        return cls(np.fromiter(chain.from_iterable(lists), np.int64, int(counts.sum())), counts)

    def of_rows(self, chosen: np.ndarray) -> Tokens:
        return Tokens(self.ids[np.repeat(chosen, self.counts)], self.counts[chosen])

    def lists(self) -> list[list[int]]:
        stops = np.cumsum(self.counts).tolist()
        ids = self.ids.tolist()
        return [ids[i:k] for i, k in zip([0, *stops[:-1]], stops, strict=True)] if stops else []


class Aligned:
    """Documents, aligned: per document the numbers of groups and links, and all links."""

    def __init__(self, a: Tokens, b: Tokens, bytes_a: np.ndarray, bytes_b: np.ndarray):
        """``bytes_a`` and ``bytes_b`` have the number of bytes of each id; both sides of a document have
        equal bytes."""
        n = len(a.counts)
        self.n_links, self.n_groups = np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.links: list[tuple[np.ndarray, np.ndarray]] = []  # (document, pair)
        # Documents, ids of both sides, and where groups end in them.
        self.parts: list[tuple] = []
        some = a.counts > 0
        shorter_a = some & (a.counts <= b.counts)
        self._align(shorter_a, a, b, bytes_a, bytes_b, False)
        self._align(some & ~shorter_a, b, a, bytes_b, bytes_a, True)

    def _align(self, chosen, short: Tokens, long: Tokens, bytes_short, bytes_long, swapped: bool) -> None:
        rows = np.flatnonzero(chosen)
        if not len(rows):
            return
        short, long = short.of_rows(chosen), long.of_rows(chosen)
        # Ends counted over all documents: they rise through the whole batch.
        ends_s, ends_l = np.cumsum(bytes_short[short.ids]), np.cumsum(bytes_long[long.ids])
        rank = ranks(ends_s, ends_l, short.counts, long.counts)
        common_end = ends_l[rank] == ends_s
        doc = np.repeat(np.arange(len(rows)), short.counts)
        groups = np.bincount(doc[common_end], minlength=len(rows))
        self.n_groups[rows] = groups
        # A token overlaps the tokens from the one in which it starts to the one in which it ends.
        opens = np.zeros_like(rank)
        opens[1:] = rank[:-1] + common_end[:-1]
        count = rank - opens + 1
        self.n_links[rows] = np.bincount(doc, weights=count, minlength=len(rows)).astype(np.int64)
        each = np.repeat(opens - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        own, met = np.repeat(short.ids, count), long.ids[each]
        self.links.append((rows[np.repeat(doc, count)], met * SHIFT + own if swapped else own * SHIFT + met))
        stops = (np.flatnonzero(common_end) + 1, rank[common_end] + 1)
        sides = (long, short) if swapped else (short, long)
        self.parts.append((rows, groups, sides, stops[::-1] if swapped else stops))

    def groups(self, name_a: list[str], name_b: list[str]) -> list[str]:
        """Per document its groups: ids of both sides in order, as ``a1,a2|b1;a3|b2,b3``."""
        found = [""] * len(self.n_groups)
        for rows, counts, (a, b), (stop_a, stop_b) in self.parts:
            of_a = [name_a[i] for i in a.ids.tolist()]
            of_b = [name_b[i] for i in b.ids.tolist()]
            texts, i, k = [], 0, 0
            for to_a, to_b in zip(stop_a.tolist(), stop_b.tolist(), strict=True):
                if to_a - i == 1 and to_b - k == 1:
                    texts.append(f"{of_a[i]}|{of_b[k]}")
                else:
                    texts.append(f"{','.join(of_a[i:to_a])}|{','.join(of_b[k:to_b])}")
                i, k = to_a, to_b
            at = 0
            for row, n in zip(rows.tolist(), counts.tolist(), strict=True):
                found[row] = ";".join(texts[at : at + n])
                at += n
        return found

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document, pair and number of links, one row each, by document."""
        if not self.links:
            return (np.zeros(0, np.int64),) * 3
        docs = np.concatenate([d for d, _ in self.links])
        pairs = np.concatenate([p for _, p in self.links])
        different, number = np.unique(pairs, return_inverse=True)
        key, times = np.unique(docs * len(different) + number, return_counts=True)
        return key // len(different), different[key % len(different)], times


# --- tokenizers -------------------------------------------------------------------------------


def file_bytes(path: str) -> bytes:
    with open(path, "rb") as file:
        data = file.read(MAX_BYTES + 1)
    if len(data) > MAX_BYTES:
        raise ValueError(f"{path} is larger than {MAX_BYTES} bytes")
    return data


def byte_level() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable ones for
    themselves, the others by characters from 256 on, in order."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Tokenizers:
    """Both tokenizers, with the bytes of every id and the ids of words met so far."""

    def __init__(self, byte_file: bytes, piece_file: bytes):
        import sentencepiece
        import tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.byte_bpe = tokenizers.Tokenizer.from_buffer(byte_file)
        self.byte_bpe.encode_special_tokens = True
        self.piece_bpe = sentencepiece.SentencePieceProcessor(model_proto=piece_file)
        table = byte_level()
        self.bytes_a = [b""] * self.byte_bpe.get_vocab_size()
        for token, i in self.byte_bpe.get_vocab().items():
            self.bytes_a[i] = bytes(table[c] for c in token) if set(token) <= table.keys() else token.encode()
        pieces = [self.piece_bpe.id_to_piece(i) for i in range(self.piece_bpe.get_piece_size())]
        self.bytes_b = [_piece_bytes(p) for p in pieces]
        # Words may be encoded one by one if no piece goes on behind a space that follows another
        # character.
        self.by_word = not any("▁" in p.lstrip("▁") for p in pieces)
        self.size_a = np.array([len(x) for x in self.bytes_a], np.int64)
        self.size_b = np.array([len(x) for x in self.bytes_b], np.int64)
        self.name_a = [str(i) for i in range(len(self.bytes_a))]
        self.name_b = [str(i) for i in range(len(self.bytes_b))]
        self.forget()
        self.cut = re.compile(CUT)
        self.plain = re.compile(PLAIN)
        self.ranked = self._ranked(byte_file)

    def forget(self) -> None:
        """Start with no known words. A word is a number; by it, its ids in one long array of each side, its
        groups, and whether its ids give back its bytes."""
        self.known: dict[str, int] = {}
        self.group: list[str] = []
        self.same = np.zeros(0, bool)
        self.ids = [np.zeros(0, np.int64)] * 2
        self.counts = [np.zeros(0, np.int64)] * 2

    def _ranked(self, byte_file: bytes):
        """An encoder that merges by rank, if the file's vocabulary is numbered in the order of its merges
        and cut by the usual pattern; else None."""
        import tiktoken

        about = json.loads(byte_file)
        how, model = about.get("pre_tokenizer") or {}, about["model"]
        merges = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        usual = how.get("type") == "ByteLevel" and how.get("use_regex") and not how.get("add_prefix_space")
        if not usual or about.get("normalizer") or [model["vocab"][m] for m in merges] != list(range(256, 256 + len(merges))):
            return None
        ranks = {self.bytes_a[i]: i for i in range(256 + len(merges))}
        return tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def words(self, text: str) -> list[str]:
        """A text with a space before it, in parts that are encoded alike alone and in the text."""
        return self.cut.split(" " + text) if self.by_word else [" " + text]

    def learn(self, parts: set[str]) -> None:
        new = [p for p in parts if p not in self.known]
        if len(self.known) + len(new) > REMEMBERED:
            self.forget()
            new = list(parts)
        if not new:
            return
        # ASCII words first: they never meet a character that sends their neighbours the slow way.
        new.sort(key=str.isascii, reverse=True)
        found = []
        for begin in range(0, len(new), TOGETHER):
            words = new[begin : begin + TOGETHER]
            found += self._together(words) or self._alone(words)
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
        same = np.array([x[2] for x in found])
        self.same = np.concatenate([self.same, same])
        both = [Tokens.of([x[side] for x in found]) for side in (0, 1)]
        for side, tokens in enumerate(both):
            self.ids[side] = np.concatenate([self.ids[side], tokens.ids])
            self.counts[side] = np.concatenate([self.counts[side], tokens.counts])
        # A word ends a token on both sides, so groups of a text are those of its words.
        good = [Tokens(t.ids[np.repeat(same, t.counts)], np.where(same, t.counts, 0)) for t in both]
        self.group += Aligned(*good, self.size_a, self.size_b).groups(self.name_a, self.name_b)

    def _together(self, words: list[str]) -> list[tuple[list[int], list[int], bool]] | None:
        """Ids of words from one text, since a call for each costs more than its encoding; None where
        the text could be cut otherwise (see ``CUT``) or tokens do not end with every word."""
        text = "".join(words)
        # Words that would not be cut here again.
        if not all([len(w) > 1 and not w[1].isspace() and not w[-1].isspace() for w in words]):
            return None
        if not self.ranked or max(map(len, words)) > LONG_WORD or not self.plain.fullmatch(text):
            return None
        ends = np.cumsum([len(w) if w.isascii() else len(w.encode()) for w in words])
        data, parts = text.encode(), []
        both = ((self.ranked.encode_ordinary(text), self.bytes_a, self.size_a),)
        both += ((self.piece_bpe.encode(text[1:]), self.bytes_b, self.size_b),)
        for ids, table, sizes in both:
            if not self._same(ids, table, data):
                return None
            found = np.cumsum(sizes[ids])
            at = np.searchsorted(found, ends)
            if (found[at] != ends).any():
                return None
            stops = (at + 1).tolist()
            parts.append([ids[i:k] for i, k in zip([0, *stops[:-1]], stops, strict=True)])
        return [(a, b, True) for a, b in zip(*parts, strict=True)]

    def _alone(self, words: list[str]) -> list[tuple[list[int], list[int], bool]]:
        of_a = [x.ids for x in self.byte_bpe.encode_batch_fast(words, add_special_tokens=False)]
        of_b = self.piece_bpe.encode([w[1:] for w in words], num_threads=1)
        found = []
        for word, a, b in zip(words, of_a, of_b, strict=True):
            data = word.encode()
            found.append((a, b, self._same(a, self.bytes_a, data) and self._same(b, self.bytes_b, data)))
        return found

    def encode(self, texts: list[str | None]) -> tuple[Tokens, Tokens, list[str]]:
        """Ids of both tokenizers and groups (see ``Aligned.groups``) of each text; none for NULL, the empty
        text, or where the bytes differ."""
        cut = [self.words(t) if t else [] for t in texts]
        flat = list(chain.from_iterable(cut))
        self.learn(set(flat))
        word = np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))
        n_words = np.array([len(x) for x in cut], np.int64)
        doc = np.repeat(np.arange(len(texts)), n_words)
        # A text that holds a word whose bytes differ has no tokens: the bytes before it are its own.
        lost = np.zeros(len(texts), bool)
        lost[doc[~self.same[word]]] = True
        stays = ~lost[doc]
        word, doc = word[stays], doc[stays]
        sides = []
        for ids, counts in zip(self.ids, self.counts, strict=True):
            n = counts[word]
            first = (np.cumsum(counts) - counts)[word]
            at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            total = np.bincount(doc, weights=n, minlength=len(texts)).astype(np.int64)
            sides.append(Tokens(ids[at], total))
        numbers, stops = word.tolist(), np.cumsum(np.bincount(doc, minlength=len(texts))).tolist()
        named = [self.group[i] for i in numbers]
        groups = [";".join(named[i:k]) for i, k in zip([0, *stops[:-1]], stops, strict=True)] if stops else []
        return (*sides, groups)

    @staticmethod
    def _same(ids: list[int], table: list[bytes], data: bytes) -> bool:
        return b"".join(map(table.__getitem__, ids)) == data


def _piece_bytes(piece: str) -> bytes:
    if re.fullmatch("<0x[0-9A-F]{2}>", piece):
        return bytes([int(piece[3:5], 16)])
    return piece.replace("▁", " ").encode()


# --- over tables ------------------------------------------------------------------------------

_DOC = "kind int, batch bigint, nth int, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, "
_DOC += "n_pairs bigint, groups_sha256 string, pairs binary, pair bigint, docs bigint"
_SCHEMA = pa.schema(
    [
        *((n, pa.int32() if n in ("kind", "nth") else pa.int64()) for n in ("kind", "batch", "nth", "doc_id")),
        *((n, pa.int64()) for n in ("n_a", "n_b", "n_groups", "n_links", "n_pairs")),
        ("groups_sha256", pa.string()),
        ("pairs", pa.binary()),
        ("pair", pa.int64()),
        ("docs", pa.int64()),
    ]
)
DOCUMENT, PAIR = 0, 1


def _rows(n: int, **columns: object) -> pa.RecordBatch:
    arrays = []
    for field in _SCHEMA:
        value = columns.get(field.name)
        if value is None:
            arrays.append(pa.nulls(n, field.type))
        elif isinstance(value, int):
            arrays.append(pa.array(np.full(n, value), field.type))
        else:
            arrays.append(value if isinstance(value, pa.Array) else pa.array(value, field.type))
    return pa.RecordBatch.from_arrays(arrays, schema=_SCHEMA)


def _align(byte_file, piece_file):
    """Documents to rows of documents and of the different pairs of each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Lists of ids by the million and no cycles among them: the collector would only walk them.
        gc.disable()
        try:
            both = Tokenizers(byte_file.value, piece_file.value)
            yield from _batches(batches, both, TaskContext.get().partitionId() << 32)
        finally:
            gc.enable()

    return run


def _batches(batches: Iterator[pa.RecordBatch], both: Tokenizers, number: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, texts = batch.column("doc_id"), batch.column("text").to_pylist()
        for part in _slices(texts):
            yield from _batch(number, keys[part], *both.encode(texts[part]), both)
            number += 1


def _slices(texts: list[str | None]) -> Iterator[slice]:
    begin, held = 0, 0
    for i, text in enumerate(texts):
        held += len(text or "")
        if held >= BATCH_CHARS or i == len(texts) - 1:
            yield slice(begin, i + 1)
            begin, held = i + 1, 0


def _batch(batch: int, keys: pa.Array, a: Tokens, b: Tokens, groups: list[str], both: Tokenizers) -> Iterator[pa.RecordBatch]:
    found = Aligned(a, b, both.size_a, both.size_b)
    doc, pair, times = found.pairs()
    different, number, docs = np.unique(pair, return_inverse=True, return_counts=True)
    edges = np.searchsorted(doc, np.arange(len(keys) + 1))
    held = np.stack([number, times]).astype(np.int32)
    yield _rows(
        len(keys),
        kind=DOCUMENT,
        batch=batch,
        nth=np.arange(len(keys)),
        doc_id=keys,
        n_a=a.counts,
        n_b=b.counts,
        n_groups=found.n_groups,
        n_links=found.n_links,
        n_pairs=np.diff(edges),
        groups_sha256=[hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups],
        pairs=[_packed(held[:, i:k]) for i, k in zip(edges[:-1], edges[1:], strict=True)],
    )
    yield _rows(len(different), kind=PAIR, batch=batch, nth=np.arange(len(different)), pair=different, docs=docs)


def _packed(values: np.ndarray) -> bytes:
    """Numbers of pairs, which rise, as differences; and how often each pair is linked."""
    flat = values.copy()
    flat[0, 1:] = np.diff(flat[0])
    return pa.compress(flat.tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros((2, 0), np.int64)
    flat = np.frombuffer(pa.decompress(data, n * 8, codec="zstd", asbytes=True), np.int32).reshape(2, n)
    return np.stack([np.cumsum(flat[0]), flat[1]])


def _looked_up(docs: pa.Table, pairs: pa.Table) -> pa.Table:
    """The documents of a batch with what its pairs count in the corpus."""
    count = np.zeros(pairs.num_rows, np.int64)
    best = np.zeros(pairs.num_rows, bool)
    nth = pairs.column("at").to_numpy()
    count[nth], best[nth] = pairs.column("count").to_numpy(), pairs.column("best").to_numpy()
    n_best, total = [], []
    for data, n in zip(docs.column("pairs").to_pylist(), docs.column("n_pairs").to_pylist(), strict=True):
        number, times = _unpacked(data, n)
        n_best.append(int(times[best[number]].sum()))
        total.append(int((count[number] * times).sum()))
    kept = [c for c in RESULT if c not in ("n_best", "count_sum")]
    table = docs.select(kept)
    table = table.append_column("n_best", pa.array(n_best, pa.int64()))
    return table.append_column("count_sum", pa.array(total, pa.int64())).select(RESULT)


RESULT = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def pair_counts(rows: DataFrame) -> DataFrame:
    """Per id pair the number of documents that hold it linked (``count``), and whether it is the
    highest of its first id, ties included (``best``). ``rows`` are those of ``aligned``."""
    counts = rows.where(F.col("kind") == PAIR).groupBy("pair").agg(F.sum("docs").alias("count"))
    counts = common.written(counts, "pair-counts")
    first = F.floor(F.col("pair") / SHIFT)
    most = counts.groupBy(first.alias("id_a")).agg(F.max("count").alias("most"))
    # One row an id of the first vocabulary, so small enough to broadcast at any input.
    found = counts.withColumn("id_a", first).join(F.broadcast(most), "id_a")
    return found.select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def aligned(docs: DataFrame, byte_path: str = BYTE_TOKENIZER, piece_path: str = PIECE_TOKENIZER) -> DataFrame:
    """Rows of documents (kind 0) and of the different pairs of each batch of documents (kind 1)."""
    context = docs.sparkSession.sparkContext
    files = [context.broadcast(file_bytes(p)) for p in (byte_path, piece_path)]
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return common.written(rows.mapInArrow(_align(*files), _DOC), "aligned")


def align(docs: DataFrame, byte_path: str = BYTE_TOKENIZER, piece_path: str = PIECE_TOKENIZER) -> DataFrame:
    """One row a document: ``n_a`` and ``n_b`` tokens, ``n_groups`` between common ends, ``n_links`` pairs
    of tokens that overlap, ``n_best`` links whose pair is the most frequent of its first id (ties
    included), ``count_sum`` documents over all links, and ``groups_sha256``.

    NULL and empty texts, and texts whose tokens do not give back a space and the text, have no
    tokens: zeros and an empty hash. Special tokens in a text are ordinary text. Texts of any length
    are taken whole. Every row is a document of its own: repeated rows count each, also in the
    number of documents of a pair. doc_id may be NULL; further columns are ignored, whatever their
    names; an empty table gives no rows.
    """
    rows = aligned(docs, byte_path, piece_path)
    found = pair_counts(rows)
    own = rows.where(F.col("kind") == PAIR).select(F.col("batch").alias("of"), F.col("nth").alias("at"), "pair")
    own = own.join(found, "pair").select("of", "at", "count", "best")
    texts = rows.where(F.col("kind") == DOCUMENT)
    schema = ", ".join(f"{c} {'string' if c == 'groups_sha256' else 'bigint'}" for c in RESULT)
    return texts.groupBy("batch").cogroup(own.groupBy("of")).applyInArrow(_looked_up, schema)


# --- the registered query ---------------------------------------------------------------------


def query(spark: SparkSession, folder: str) -> DataFrame:
    return align(common.read(spark, folder, "documents").select("doc_id", "text"))
