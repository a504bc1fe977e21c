import hashlib
import re

import llm_rows
from pyspark.sql import functions as F

from haulscope.llm import line_dedup, quality_rules

WORD = re.compile("[^\x20\x09-\x0d]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def kept_lines(rows, min_chars=10):
    """Brute force: NULL ids are one document after all others."""
    order = lambda i: (i is None, i or 0)
    key = lambda line: lower(line.strip(" \t\n\x0b\f\r"))
    holders = {}
    for i, text, *_ in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders.setdefault(key(line), set()).add(i)
    found = []
    for i, text, *_ in rows:
        lines = (text or "").split("\n")
        gone = [
            len(holders.get(key(x), ())) > 1 and i != min(holders[key(x)], key=order) for x in lines
        ]
        kept = "\n".join(x for x, g in zip(lines, gone, strict=True) if not g)
        found.append((i, len(lines), sum(gone), kept))
    return sorted(found, key=str)


def test_line_dedup_equals_brute_force(spark):
    df = line_dedup.dedup(llm_rows.frame(spark))
    got = [(r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in df.collect()]
    expected = kept_lines(llm_rows.documents())
    assert sorted(got, key=str) == expected
    assert sum(x[2] for x in expected) > 3


def test_a_line_that_most_documents_hold_is_split_and_kept_once(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "SAMPLE", 1.0)
    rows = [(i, f"{llm_rows.SHARED_LINE}\n{llm_rows.prose(i, 20)}", "en", "a", 1) for i in range(300)]
    assert line_dedup._salts(llm_rows.frame(spark, rows), 10, 8).count() == 1
    df = line_dedup.dedup(llm_rows.frame(spark, rows))
    got = sorted((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in df.collect())
    assert got == sorted(kept_lines(rows))


def test_bitmaps_are_run_lengths(spark):
    line = "a line long enough"
    rows = [(1, line, None, None, None), (2, f"x\n{line}\n{line}\ny\n{line}\nz", None, None, None)]
    maps = line_dedup.keep_bitmaps(llm_rows.frame(spark, rows)).collect()
    assert [(r.doc_id, r.keep_bitmap) for r in maps] == [(2, [1, 2, 1, 1])]


def test_line_dedup_of_an_empty_table_and_of_clashing_columns(spark):
    assert line_dedup.dedup(llm_rows.empty(spark)).count() == 0
    df = llm_rows.frame(spark).withColumns({"n_lines": F.lit("mine"), "kept_text": F.lit(1), "h1": F.lit(2)})
    found = line_dedup.dedup(df)
    assert found.columns.count("n_lines") == 1 and dict(found.dtypes)["n_lines"] == "bigint"
    assert found.where("h1 = 2").count() == len(llm_rows.documents())


def base(text):
    text = text or ""
    words = WORD.findall(text)
    places = {}
    for i in range(len(words) - 4):
        places.setdefault(tuple(words[i : i + 5]), []).append(i)
    repeated = {j for p in places.values() if len(p) > 1 for i in p for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (
        len(words),
        sum(map(len, words)),
        len(re.findall(r"[#*$%&|<>]", text)),
        len(lines) - len(set(lines)),
        len(repeated),
        len(words) < 10 or 100 * len(repeated) > 20 * len(words),
    )


NAMES = "n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed".split()


def test_quality_base_equals_brute_force(spark):
    rows = llm_rows.documents() + [
        (200, "a b c d e f a b c d e g a b c d e", "en", "x", 1),
        (201, "p\np\n \n \nq *** $5 <b>\np", "en", "x", 1),
    ]
    found = quality_rules.clean(llm_rows.frame(spark, rows)).collect()
    got = sorted(((r.doc_id, *(r[n] for n in NAMES)) for r in found), key=str)
    assert got == sorted(((i, *base(t)) for i, t, *_ in rows), key=str)
    assert all(not r.kept for r in found if r.base_failed)


def test_failing_lines_go_and_documents_that_lose_too_much_are_rejected(spark):
    good = llm_rows.prose(1, 30) + "."
    rows = [
        (1, good, None, None, None),
        (2, f"{good}\nHome | About us | News | Contact\nAccept cookies", None, None, None),
        (3, "\n".join(f"{llm_rows.prose(i, 1)} | one | two | three" for i in range(9)), None, None, None),
        (4, " ".join(w + "###" for w in good.split()), None, None, None),
        (5, f"{good} see the privacy policy of the house for more. {llm_rows.prose(2, 30)}.", None, None, None),
    ]
    found = {r.doc_id: r for r in quality_rules.clean(llm_rows.frame(spark, rows)).collect()}
    assert {i: r.kept for i, r in found.items()} == {1: True, 2: True, 3: False, 4: False, 5: True}
    assert found[2].cleaned_text == good and found[5].n_words_left == found[5].n_words


def test_quality_of_an_empty_table_and_of_clashing_columns(spark):
    assert quality_rules.clean(llm_rows.empty(spark)).count() == 0
    df = llm_rows.frame(spark).withColumns({"kept": F.lit("mine"), "extra": F.lit(3)})
    found = quality_rules.clean(df)
    assert dict(found.dtypes)["kept"] == "boolean" and found.where("extra = 3").count() > 50


def test_plans_hold_no_python(spark):
    for df in (line_dedup.dedup(llm_rows.frame(spark)), quality_rules.clean(llm_rows.frame(spark))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


def test_sha_of_kept_text(spark):
    df = line_dedup.dedup(llm_rows.frame(spark)).select("kept_text", F.sha2("kept_text", 256).alias("s"))
    assert all(hashlib.sha256(r.kept_text.encode()).hexdigest() == r.s for r in df.collect())


def test_lines_are_cut_once_for_their_hashes(spark):
    plan = line_dedup.repeated_lines(llm_rows.frame(spark))._jdf.queryExecution().executedPlan().toString()
    # What is partitioned by range is a stored table of hashes: sampling it cuts no text again.
    assert "Generate" not in plan and "line-hashes" in plan
