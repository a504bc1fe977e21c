import os

import llm_rows
import pytest

import corpus_pipeline
from haulscope.llm import registry
from test_llm_decontamination import brute
from test_llm_simhash import groups, slow_fingerprint


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents with toxic ones, near copies and benchmark passages among them."""
    target = str(tmp_path_factory.mktemp("corpus"))
    rows = llm_rows.documents()
    rows += [(400 + i, f"{llm_rows.prose(i, 60)} scum {llm_rows.prose(i + 9, 20)} moron", "en", "a", 1) for i in range(60)]
    near = llm_rows.prose(4242, 400)
    rows += [(600 + i, near + f" {llm_rows.prose(i, 1)}", "en", "b", 1) for i in range(5)]
    labels = [(i, 1, int(400 <= i < 600)) for i, *_ in rows if i is not None]
    items = [(1, llm_rows.prose(500, 40)), (2, "one two")]
    llm_rows.frame(spark, rows).write.parquet(f"{target}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{target}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{target}/benchmark.parquet")
    return target, rows, items


def test_each_stage_equals_brute_force_on_its_own_input(spark, folder, tmp_path):
    target, rows, items = folder
    docs, columns = spark.read.parquet(f"{target}/documents.parquet"), None
    kept = {}
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        columns = columns or docs.columns
        before = [tuple(r) for r in docs.collect()]
        out = stage(spark, docs, target)
        out.write.parquet(os.path.join(tmp_path, str(n)))
        docs = spark.read.parquet(os.path.join(tmp_path, str(n)))
        after = [tuple(r) for r in docs.select(*columns).collect()]
        kept[n] = after
        if n < 4:
            assert docs.columns == columns
        if n == 0:
            gone = {r[0] for r in before} - {r[0] for r in after}
            assert gone == {i for i, *_ in rows if i is not None and 400 <= i < 600}
        if n == 1:
            root = groups([slow_fingerprint(r[1]) for r in before])
            order = lambda r: (r[0] is None, r[0] or 0)
            first = {}
            for r, k in zip(before, root, strict=True):
                first[k] = min(first.get(k, r), r, key=order)
            assert sorted(after, key=str) == sorted(first.values(), key=str)
        if n == 2:
            clean = [i for i, _, hit, _ in brute(before, items) if not hit]
            assert sorted((r[0] for r in after), key=str) == clean and len(after) < len(before)
        if n == 3:
            assert {r[0] for r in after} <= {r[0] for r in before} and len(after) > 20
        if n == 4:
            assert sorted(after, key=str) == sorted(before, key=str)
            assert docs.where("shard is null").count() == 0
    assert all(kept.values())


def test_run_gives_the_rows_of_the_stages(spark, folder):
    target, *_ = folder
    found = corpus_pipeline.run(spark, target)
    again = corpus_pipeline.run(spark, target)
    assert sorted(found.collect(), key=str) == sorted(again.collect(), key=str)
    assert {"doc_id", "text", "shard"} <= set(found.columns)


def test_a_query_for_each_operator_is_registered():
    names = registry.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert set(registry.oracle_sql()) <= set(names)
