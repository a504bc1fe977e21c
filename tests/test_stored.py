"""Upserts and appends that may be cut short and run again."""

import pathlib

import pytest
from pyspark.sql import functions as F

from haulscope.plans import accessorials, overview, weekly
from haulscope.sources import stored
from haulscope.sources.tables import FreightTables


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), "id string, v int, row_num int").repartition(3)


def files_of(folder):
    return {str(p.relative_to(folder)) for p in pathlib.Path(folder).rglob("*.parquet") if "rows" in p.parts}


def rows_of(table):
    return {r.id: r.v for r in table.read().collect()}


@pytest.fixture()
def table(spark, tmp_path):
    found = stored.KeyedTable(spark, str(tmp_path / "t"), "id", buckets=16)
    assert found.upsert(frame(spark, *((f"k{i}", i, i) for i in range(200))), "first")
    return found


def test_update_rewrites_touched_buckets_only(spark, table):
    before = files_of(table.folder)
    assert table.upsert(frame(spark, ("k7", 70, 1), ("k7", 71, 2), ("new", 1, 3)), "second")
    assert rows_of(table) == {f"k{i}": i for i in range(200)} | {"k7": 71, "new": 1}
    kept = before & files_of(table.folder)
    assert len(before) == 16 and len(kept) >= 14


def test_a_load_counts_once(spark, table):
    load = frame(spark, ("k1", 100, 1))
    assert table.upsert(load, "again") and table.has("again")
    assert table.upsert(frame(spark, ("k1", 200, 1)), "later")
    before = files_of(table.folder)
    assert not table.upsert(load, "again")
    assert rows_of(table)["k1"] == 200 and files_of(table.folder) == before


@pytest.mark.parametrize("policy", ["update", "skip"])
@pytest.mark.parametrize("where", ["before", "half", "after"])
def test_a_load_that_was_killed_is_run_again(spark, table, monkeypatch, policy, where):
    load = frame(spark, *((f"k{i}", -i, i) for i in range(150, 260)))
    replace = stored.KeyedTable._replace

    def killed(self, staged):
        if where != "before":
            replace(self, staged.where("bucket % 2 = 0") if where == "half" else staged)
        raise RuntimeError("killed")

    monkeypatch.setattr(stored.KeyedTable, "_replace", killed)
    with pytest.raises(RuntimeError):
        table.upsert(load, "x", policy)
    monkeypatch.setattr(stored.KeyedTable, "_replace", replace)
    assert not table.has("x") and table.upsert(load, "x", policy)
    old = {f"k{i}": i for i in range(200)}
    new = {f"k{i}": -i for i in range(150, 260)}
    assert rows_of(table) == (old | new if policy == "update" else new | old)


def test_policies_and_bad_keys(spark, table):
    assert table.upsert(frame(spark, ("k1", 5, 1), ("n", 1, 2), ("n", 2, 3)), "s", "skip")
    assert rows_of(table)["k1"] == 1 and rows_of(table)["n"] == 1
    with pytest.raises(ValueError, match="duplicate"):
        table.upsert(frame(spark, ("k1", 5, 1)), "c", "cancel")
    with pytest.raises(ValueError, match="without id"):
        table.upsert(frame(spark, (None, 5, 1)), "n")
    assert not table.has("c") and not table.has("n")


def test_appends_count_once_and_broken_ones_are_not_read(spark, tmp_path):
    folder = str(tmp_path / "log")
    assert stored.append_once(frame(spark, ("a", 1, 1)), folder, "load/1")
    assert not stored.append_once(frame(spark, ("a", 1, 1)), folder, "load/1")
    assert stored.append_once(frame(spark, ("b", 2, 1)), folder, "2024")
    (tmp_path / "log" / "load=2024" / "_SUCCESS").unlink()
    assert [(r.id, r.load) for r in stored.read_loads(spark, folder).collect()] == [("a", "load/1")]
    assert stored.append_once(frame(spark, ("b", 3, 1)), folder, "2024")
    found = {(r.id, r.v, r.load) for r in stored.read_loads(spark, folder).collect()}
    assert found == {("a", 1, "load/1"), ("b", 3, "2024")}
    with pytest.raises(ValueError, match="no complete load"):
        stored.read_loads(spark, str(tmp_path / "nothing"))


def test_weekly_series_of_deliveries_equal_those_of_all_rows(spark, tables, tmp_path):
    kept, added = weekly.KeptWeeks(spark, str(tmp_path / "weeks")), []
    for n in (0, 1, 2, 1):
        part = FreightTables(
            tables.shipments.where(F.pmod(F.xxhash64("ShipmentId"), F.lit(3)) == n),
            tables.charges.where(F.pmod(F.xxhash64("charge_id"), F.lit(3)) == n),
            tables.carriers,
            tables.facilities,
        )
        added.append(kept.add(part, f"d{n}"))
    assert added == [True, True, True, False]
    assert kept.weekly_operations().collect() == overview.weekly_operations(tables).collect()
    assert kept.week_over_week().collect() == overview.week_over_week(tables).collect()
    assert kept.weekly_charges().collect() == accessorials.weekly_charges(tables).collect()
    opened = kept.week_over_week().inputFiles()
    assert opened and all("/weeks/shipments/load=" in name for name in opened)

