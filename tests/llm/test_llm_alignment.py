import hashlib
from bisect import bisect_left
from collections import Counter, defaultdict

import llm_rows
import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from haulscope.llm import tokenizer_alignment as alignment

TEXTS = [
    "plain words, and more of them; don't stop (now) at 12,345.67 or http://x.y/z?q=1",
    " leading", "trailing ", "  two  spaces  ", "\t\ttabs\n\nand\r\nlines ", "é ü ß ñ 中文 字 🎉🎉 ​ x",
    "<s> </s> <unk> <|endoftext|> [INST]", "\x00\x01 \x85 \xa0   　 end", "a" * 3000, "ab " * 2000, "'s 've ' s",
]


@pytest.fixture(scope="module")
def both():
    read = alignment.file_bytes
    return alignment.Tokenizers(read(alignment.BYTE_TOKENIZER), read(alignment.PIECE_TOKENIZER))


def whole(both, text):
    """Ids of a text encoded in one piece."""
    if not text:
        return [], []
    a = both.byte_bpe.encode(" " + text, add_special_tokens=False).ids
    b = both.piece_bpe.encode(text)
    data = (" " + text).encode()
    if b"".join(both.bytes_a[i] for i in a) != data or b"".join(both.bytes_b[i] for i in b) != data:
        return [], []
    return a, b


def lists(both, texts):
    a, b, _ = both.encode(texts)
    return a.lists(), b.lists()


def spans(ids, table):
    found, at = [], 0
    for i in ids:
        found.append((at, at + len(table[i])))
        at += len(table[i])
    return found


def naive(both, a, b):
    """Groups and links by comparing all pairs of tokens."""
    in_a, in_b = spans(a, both.bytes_a), spans(b, both.bytes_b)
    ends = sorted({e for _, e in in_a} & {e for _, e in in_b})
    groups, begin = [], 0
    for end in ends:
        left = ",".join(str(i) for i, (s, e) in zip(a, in_a, strict=True) if begin <= s and e <= end)
        right = ",".join(str(i) for i, (s, e) in zip(b, in_b, strict=True) if begin <= s and e <= end)
        groups.append(f"{left}|{right}")
        begin = end
    links = [
        (i, k)
        for i, (s, e) in zip(a, in_a, strict=True)
        for k, (t, f) in zip(b, in_b, strict=True)
        if s < f and t < e
    ]
    return groups, links


def test_words_alone_are_encoded_as_in_the_text(both):
    a, b = lists(both, [*TEXTS, None, ""])
    for text, x, y in zip([*TEXTS, None, ""], a, b, strict=True):
        assert (x, y) == whole(both, text), text


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_any_text_is_encoded_as_a_whole(both, text):
    assert tuple(x[0] for x in lists(both, [text])) == whole(both, text)


def test_bytes_that_are_not_given_back_leave_no_tokens(both):
    assert lists(both, ["fine", "a ▁ b", "▁", "as well"])[0][1:3] == [[], []]
    assert both.encode(["fine", "a ▁ b"])[2][1] == ""


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(1, 9), min_size=1, max_size=40), min_size=1, max_size=5))
def test_gallop_finds_what_bisection_finds(steps):
    longer = [np.cumsum(s) for s in steps]
    wanted = [np.unique(np.concatenate([x[::3], x[-1:]])) for x in longer]
    base = np.cumsum([0, *(int(x[-1]) for x in longer[:-1])])
    flat_l = np.concatenate([x + o for x, o in zip(longer, base, strict=True)])
    flat_w = np.concatenate([x + o for x, o in zip(wanted, base, strict=True)])
    found = alignment.ranks(
        flat_w, flat_l, np.array([len(x) for x in wanted]), np.array([len(x) for x in longer])
    )
    assert found.tolist() == [bisect_left(flat_l.tolist(), w) for w in flat_w.tolist()]


def test_groups_and_links_equal_all_pairs(both):
    texts = [t[:400] for t in TEXTS] + [llm_rows.prose(i, 30) for i in range(5)]
    a, b, named = both.encode(texts)
    found = alignment.Aligned(a, b, both.size_a, both.size_b)
    listed, a, b = found.groups(both.name_a, both.name_b), a.lists(), b.lists()
    doc, pair, times = found.pairs()
    for i in range(len(texts)):
        groups, links = naive(both, a[i], b[i])
        assert listed[i] == named[i] == ";".join(groups)
        assert (found.n_groups[i], found.n_links[i]) == (len(groups), len(links))
        mine = dict(zip(pair[doc == i].tolist(), times[doc == i].tolist(), strict=True))
        assert mine == Counter(x * alignment.SHIFT + y for x, y in links)


def expected(both, rows):
    encoded = [whole(both, r[1]) for r in rows]
    found = [naive(both, a, b) for a, b in encoded]
    docs = Counter(pair for _, links in found for pair in set(links))
    most = defaultdict(int)
    for (x, _), n in docs.items():
        most[x] = max(most[x], n)
    result = []
    for row, (a, b), (groups, links) in zip(rows, encoded, found, strict=True):
        best = sum(docs[p] == most[p[0]] for p in links)
        total = sum(docs[p] for p in links)
        sha = hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""
        result.append((row[0], len(a), len(b), len(groups), len(links), best, total, sha))
    return sorted(map(str, result))


def test_the_table_equals_brute_force(spark, both, monkeypatch):
    monkeypatch.setattr(alignment, "BATCH_CHARS", 1_500)  # several batches a task
    rows = [(i, (t or "")[:700] if t is not None else None, *r) for i, t, *r in llm_rows.documents()]
    rows += [(300 + i, t[:500], "en", "x", 1) for i, t in enumerate(TEXTS)]
    clash = {c: F.lit("mine") for c in ("batch", "pair", "count", "kind", "n_a", "pairs")}
    found = alignment.align(llm_rows.frame(spark, rows).withColumns(clash))
    assert found.columns == alignment.RESULT
    assert sorted(str(tuple(r)) for r in found.collect()) == expected(both, rows)


def test_empty_tables_and_texts(spark):
    assert alignment.align(llm_rows.empty(spark)).count() == 0
    rows = [(1, None, None, None, None), (None, "", "en", "a", 0)]
    found = alignment.align(llm_rows.frame(spark, rows)).collect()
    assert sorted(map(str, (tuple(r) for r in found))) == sorted(
        map(str, [(1, 0, 0, 0, 0, 0, 0, ""), (None, 0, 0, 0, 0, 0, 0, "")])
    )
