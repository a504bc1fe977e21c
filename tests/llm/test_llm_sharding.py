from collections import Counter

import llm_rows
import pytest
from pyspark.sql import functions as F

from haulscope.llm import sharding


def test_shards_hold_equal_numbers_of_slots():
    counts = Counter(sharding.fill_table())
    assert len(counts) == len(sharding.SHARDS) and max(counts.values()) - min(counts.values()) <= 1


def test_each_claim_is_the_first_free_slot_in_turn():
    names, size = ["a", "b", "c"], 11
    import hashlib

    def preferences(name):
        bits = hashlib.md5(name.encode()).digest()
        at, step = int.from_bytes(bits[:8], "big") % size, 1 + int.from_bytes(bits[8:], "big") % (size - 1)
        return [(at + i * step) % size for i in range(size)]

    table = [None] * size
    turn = 0
    while None in table:
        slot = next(s for s in preferences(names[turn % 3]) if table[s] is None)
        table[slot] = turn % 3
        turn += 1
    assert sharding.fill_table(names, size) == table


def test_a_lost_shard_moves_little_else():
    whole = sharding.fill_table()
    fewer = sharding.fill_table(sharding.SHARDS[:-1])
    moved = sum(a != b for a, b in zip(whole, fewer, strict=True)) / len(whole)
    assert moved < 3 / len(sharding.SHARDS)


def test_bad_tables_are_refused():
    for shards, size in (([], 7), (["a", "a"], 7), (["a"], 8), (["a", "b", "c"], 2)):
        with pytest.raises(ValueError):
            sharding.fill_table(shards, size)


def test_all_rows_are_placed_and_equal_keys_together(spark):
    df = llm_rows.frame(spark).withColumns({"shard": F.lit("mine"), "n": F.lit(5)})
    placed = sharding.place(df)
    rows = placed.collect()
    assert len(rows) == len(llm_rows.documents()) and placed.columns.count("shard") == 1
    assert len({(r.doc_id, r.shard) for r in rows}) == len({r.doc_id for r in rows})
    assert all(r.shard == sharding.SHARDS[sharding.fill_table()[r.slot]] and r.n == 5 for r in rows)
    assert sharding.place(llm_rows.empty(spark)).count() == 0
    assert "Exchange hash" not in placed._jdf.queryExecution().executedPlan().toString()


def test_load_is_even(spark):
    loads = sharding.place(spark.range(64_000).withColumnRenamed("id", "doc_id")).groupBy("shard").count()
    counts = [r["count"] for r in loads.collect()]
    assert len(counts) == 32 and min(counts) > 1_700 and max(counts) < 2_300
