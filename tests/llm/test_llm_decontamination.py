import re

import llm_rows
from pyspark.sql import functions as F

from haulscope.llm import decontamination

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower_words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(rows, items):
    windows = {}
    for item, text in items:
        w = lower_words(text)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(item)
    sizes = {len(x) for x in windows}
    found = []
    for i, text, *_ in rows:
        w, hit, ids = lower_words(text), set(), set()
        for n in sizes:
            for at in range(len(w) - n + 1):
                if met := windows.get(tuple(w[at : at + n])):
                    hit.update(range(at, at + n))
                    ids |= met
        found.append((i, len(w), len(hit), sorted(str(x) for x in ids if x is not None)))
    return sorted(found, key=str)


ITEMS = [
    (1, llm_rows.prose(77, 80)[40:300]),
    (2, "The Quick BROWN fox, jumps over the lazy dog; while seven wizards"),
    (3, "one two"),
    (4, "σας σας b"),
    (5, None),
    (6, " ... "),
    (None, llm_rows.prose(8, 40)[:150]),
    (2, "The Quick BROWN fox, jumps over the lazy dog; while seven wizards"),
    (7, "word " * 12),
    (8, "x" * 1500),
    (9, llm_rows.prose(1400, 12) + " " + llm_rows.prose(1401, 12)),
]


def benchmark(spark, items=ITEMS):
    return spark.createDataFrame(items, "item_id bigint, text string")


def test_hits_equal_brute_force(spark):
    rows = llm_rows.documents()
    found = decontamination.contamination(llm_rows.frame(spark), benchmark(spark))
    got = [(r.doc_id, r.n_words, r.n_hit, r["items"]) for r in found.collect()]
    expected = brute(rows, ITEMS)
    assert sorted(got, key=str) == expected
    assert sum(bool(x[2]) for x in expected) >= 8
    for r in found.collect():
        assert sum(x.length for x in r.hit_runs) == r.n_hit


def test_the_shuffled_join_gives_the_same(spark, monkeypatch):
    from haulscope.operators import joins

    real = joins.join_measured
    monkeypatch.setattr(
        decontamination, "join_measured", lambda a, b, on, how: real(a, b, on, how, limit=-1)
    )
    found = decontamination.contamination(llm_rows.frame(spark), benchmark(spark))
    got = sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in found.collect()), key=str)
    assert got == brute(llm_rows.documents(), ITEMS)


def test_empty_tables_and_clashing_columns(spark):
    none = benchmark(spark, []).limit(0)
    assert decontamination.contamination(llm_rows.empty(spark), benchmark(spark)).count() == 0
    clean = decontamination.contamination(llm_rows.frame(spark), none)
    assert clean.where("n_hit > 0 or size(items) > 0").count() == 0
    odd = llm_rows.frame(spark).withColumns({"items": F.lit(1), "f": F.lit(2), "w": F.lit(3), "i": F.lit(4)})
    found = decontamination.contamination(odd, benchmark(spark))
    assert found.where("f = 2 and w = 3 and i = 4").count() == len(llm_rows.documents())
    assert dict(found.dtypes)["items"] == "array<string>"


def test_the_plan_holds_no_python(spark):
    plan = decontamination.contamination(llm_rows.frame(spark), benchmark(spark))
    assert not re.search("Python|Pandas|Arrow", plan._jdf.queryExecution().executedPlan().toString())
