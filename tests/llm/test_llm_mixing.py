import re
from collections import Counter

import llm_rows
import numpy as np
import pytest
from pyspark.sql import functions as F

from haulscope.llm import mixing

WORD = re.compile("[^\x20\x09-\x0d]+")


def goals(sizes):
    """Targets by repeated resharing."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in capped)
        free = sum(weight[s] for s in names if s not in capped)
        found = {s: 3.0 * sizes[s] if s in capped else rest * weight[s] / free for s in names}
        over = {s for s in names if s not in capped and found[s] > 3 * sizes[s]}
        if not over:
            return found
        capped |= over


def sized(spark, sizes):
    rows = [(i, "w " * n, "en", s, 1) for i, (s, n) in enumerate(sizes.items())]
    return mixing.sizes(llm_rows.frame(spark, rows))


@pytest.mark.parametrize(
    "sizes",
    [
        {"a": 100, "b": 100, "c": 100, None: 100},
        {"a": 1000, "b": 5, "c": 40, "d": 0, "e": 7, "É": 3},
        {"only": 12},
        {"a": 1, "b": 2, "c": 500, "d": 90, "e": 80, "f": 70, "g": 60},
    ],
)
def test_targets_equal_repeated_resharing(spark, sizes):
    found = {r.source: r.target for r in mixing.targets(sized(spark, sizes)).collect()}
    wanted = goals(sizes)
    assert found.keys() == wanted.keys()
    for s, target in wanted.items():
        assert found[s] == pytest.approx(target)


@pytest.mark.parametrize("n", [1, 2, 3, 31, 32, 33, 1000])
def test_permutations_are_permutations(n):
    places = mixing.permuted(np.arange(n), n, [1, 2, 3])
    assert sorted(places.tolist()) == list(range(n))
    assert n < 31 or (places != np.arange(n)).any()


def taken(spark, docs):
    joined, parts = mixing.mixed(docs)
    words = parts.groupBy("row_key").agg(F.sum("words").alias("taken"))
    return joined.join(words, "row_key", "left").fillna(0, ["taken"]).collect()


def skewed(n=60):
    rows = [(i, llm_rows.prose(i, 900), "en", "large", 1) for i in range(n)]
    rows += [(1000 + i, llm_rows.prose(i, 400), "en", s, 1) for i, s in enumerate(["m", "n", "small"] * 4)]
    return [*rows, (2000, None, None, None, None), (2001, "", "en", "empty", 0)]


def test_sources_come_near_their_targets_and_no_document_is_taken_too_often(spark):
    rows = skewed()
    found = taken(spark, llm_rows.frame(spark, rows))
    assert len(found) == len(rows)
    sizes, got = Counter(), Counter()
    for r in found:
        assert 0 <= r.taken <= 3 * r["size"]
        sizes[r.source] += r["size"]
        got[r.source] += r.taken
    assert all(r.source_size == sizes[r.source] for r in found)
    wanted = goals({s: sizes[s] for s in sizes})
    assert any(wanted[s] == 3 * sizes[s] > 0 for s in wanted)
    for s, target in wanted.items():
        assert got[s] == pytest.approx(target, rel=0.03, abs=40)


def test_reruns_and_partitions_make_the_same_mix(spark):
    rows = skewed(20)
    first = mixing.mix(llm_rows.frame(spark, rows)).collect()
    again = mixing.mix(llm_rows.frame(spark, rows).repartition(7)).collect()
    assert sorted(first, key=str) == sorted(again, key=str)


def test_shards_hold_multinomial_draws_that_add_up(spark):
    planned = mixing.plan(mixing.targets(mixing.sizes(llm_rows.frame(spark, skewed(200)))), 8)
    drawn = mixing.draws(planned, shard_slots=500).collect()
    slots = {r.source_no: r.slots for r in planned.collect()}
    for source, total in slots.items():
        own = sorted((r.first, r.n) for r in drawn if r.source_no == source and r.n)
        assert sum(n for _, n in own) == total
        assert [f for f, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))]
    assert len({r.n for r in drawn if r.source_no == 1}) > 3


def test_mixed_texts_hold_the_words_that_are_taken(spark):
    rows = skewed(20)
    counts = Counter()
    for r in taken(spark, llm_rows.frame(spark, rows)):
        counts[r.doc_id] += r.taken
    texts = Counter()
    whole = {i: t for i, t, *_ in rows}
    for r in mixing.mix(llm_rows.frame(spark, rows)).collect():
        texts[r.doc_id] += len(WORD.findall(r.text))
        assert r.n_chars == len(r.text)
        assert set(r.text.split()) <= set(whole[r.doc_id].split())
    assert {k: v for k, v in counts.items() if v} == dict(texts)


def test_repeated_rows_empty_tables_and_clashing_columns(spark):
    rows = [(1, llm_rows.prose(1, 200), "en", "a", 1)] * 3 + [(None, llm_rows.prose(2, 90), None, None, None)] * 2
    found = taken(spark, llm_rows.frame(spark, rows))
    assert len(found) == 5 and all(r.taken <= 3 * r["size"] for r in found)
    assert sum(r.taken for r in found) == pytest.approx(780, rel=0.1)
    assert mixing.mix(llm_rows.empty(spark)).count() == 0
    odd = llm_rows.frame(spark, rows).withColumns({"size": F.lit(1), "block": F.lit(2), "words": F.lit(3)})
    mixed = mixing.mix(odd)
    assert mixed.columns == odd.columns and mixed.where("block = 2 and words = 3").count() == mixed.count()
