import hashlib
import re

import llm_rows
import pytest
from pyspark.sql import functions as F

from haulscope.llm import pii_bootstrap as pii

FORMS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
AWKWARD = [
    "a@b.c_d@e.f.g x@y @z.com q@w. e@r.t.", "1.2.3.4.5.6.7.8 256.1.1.1 255.0255.000.1 1.2.3 01.2.3.4",
    "4111 1111 1111 1111 and 4111-1111-1111-1112 4111 1111  1111 1111", "é 🎉 +1 (555) 123-4567. +12 +1((( 1",
    "+49.30.123456 x +1 23 4", "1" * 40, "1 " * 3000 + "a", "x." * 4000 + "@a.b", "a@" + "b." * 3000 + "c", "+" + "(" * 3000,
    "mail me: joe.doe+tag@mail-1.example.co.uk, or call +1 (971) 555-2485\nthen 152.143.123.131###",
    "4785380592391139 4111111111111111 5500005555555559 378282246310005", "-4012888888881881-", "0.0.0.0@a.b",
    "３３３.１.１.１ ٣٣.1.1.1", "a@b.c" * 50, "4111111111111111 " * 300,
]


def luhn(number):
    total = 0
    for i, c in enumerate(reversed(number)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base(text):
    """Spans of the stated forms, straight from their statement."""
    found = []
    for order, (kind, form) in enumerate(FORMS.items()):
        for m in re.finditer(form, text or "", re.ASCII):
            number = re.sub("[^0-9]", "", m[0])
            good = {
                "email": lambda: True,
                "ip": lambda: all(int(p) <= 255 for p in m[0].split(".")),
                "card": lambda: 12 <= len(number) <= 19 and luhn(number),
                "phone": lambda: 9 <= len(number) <= 15,
            }[kind]()
            if good:
                found.append((m.start(), order, m.end()))
    return sorted(found)


def listed(spans):
    return ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in spans)


def rows_of(texts):
    return [(i, t, "en", "a", 1) for i, t in enumerate(texts)]


def test_stated_forms_equal_the_brute_force(spark, tmp_path):
    rows = [*llm_rows.documents(), *((1000 + r[0], *r[1:]) for r in rows_of(AWKWARD))]
    llm_rows.frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    found = {}
    for r in pii.query(spark, str(tmp_path)).collect():
        found.setdefault(r.doc_id, []).append(r)
    assert sum(map(len, found.values())) == len(rows)
    for doc_id, text, *_ in rows:
        spans = base(text)
        for r in found[doc_id]:
            if doc_id is not None:
                assert r.base_sha256 == hashlib.sha256(listed(spans).encode()).hexdigest(), text[:80]
                counts = [sum(k == kind for _, k, _ in spans) for kind in range(4)]
                assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == counts
                assert r.spans == listed(spans)


def test_the_given_table_equals_the_brute_force(spark, folder):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    found = pii.query(spark, folder).collect()
    assert len(found) == len(texts)
    for r in found:
        assert r.base_sha256 == hashlib.sha256(listed(base(texts[r.doc_id])).encode()).hexdigest()


@pytest.fixture(scope="module")
def planted():
    """Seeds after two cues, unseen forms after the first and, by the second turn, after a third."""
    texts = [f"We said {llm_rows.prose(i, 8)} please dial +1 (555) 010-{2000 + i} soon" for i in range(40)]
    # Unseen after a trusted cue; the first six also stand after "office line", which no seed follows.
    texts += [f"{llm_rows.prose(90 + i, 5)} please dial 555-010-{7100 + i} now" for i in range(6)]
    texts += [f"{llm_rows.prose(200 + i, 5)} office line 555-010-{7100 + i} again" for i in range(6)]
    texts += ["the office line 555-010-9999 here"]
    # After words that are mostly followed by something else.
    texts += [f"it was in the {llm_rows.prose(300 + i, 3)}" for i in range(40)]
    texts += [f"it was in the +1 (555) 020-{3000 + i} and" for i in range(8)]
    texts += ["it was in the 555-099-1234 and more", "part number 555-098-7654 of a list"]
    # A seed's cue for another kind.
    texts += [f"reach me {llm_rows.prose(400 + i, 1)}.x@mail{i}.example.com today".replace("é", "e").replace("ß", "s") for i in range(12)]
    texts += ["reach me ann@localhost today"]
    return texts


def test_trusted_patterns_find_unseen_identifiers(spark, planted):
    found = {r.doc_id: r for r in pii.find(llm_rows.frame(spark, rows_of(planted))).collect()}
    added = {
        (planted[i][s.start : s.end], pii.KINDS[s.kind]) for i, r in found.items() for s in r.added
    }
    numbers = {f"555-010-{7100 + i}" for i in range(6)} | {"555-010-9999"}
    assert added == {(n, "phone") for n in numbers} | {("ann@localhost", "email")}
    for i, r in found.items():
        assert [tuple(s[k] for k in ("start", "kind", "end")) for s in r.base] == base(planted[i])


def test_a_second_turn_is_needed_for_a_cue_without_seeds(spark, planted, monkeypatch):
    monkeypatch.setattr(pii.scores, "__defaults__", (1,))
    found = pii.find(llm_rows.frame(spark, rows_of(planted))).collect()
    texts = {planted[r.doc_id][s.start : s.end] for r in found for s in r.added}
    assert "555-010-7100" in texts and "555-010-9999" not in texts


def test_scores_equal_a_loop(spark):
    edges = [("a b", 3, f"n{i}", i < 9) for i in range(10)] + [("c d", 3, f"n{i}", i < 9) for i in range(7, 12)]
    edges += [("e f", 3, "n9", False)]
    follows = {"a b": 10, "c d": 5, "e f": 1}
    frame = spark.createDataFrame(edges, "left string, kind int, name string, seed boolean")
    patterns = spark.createDataFrame(list(follows.items()), "left string, follows bigint")
    trusted, found = pii.scores(frame, patterns)
    score = {n: float(s) for _, _, n, s in edges}
    good = {}
    for _ in range(pii.TURNS):
        weight = {p: sum(score[n] for q, _, n, _ in edges if q == p) for p in follows}
        good = {
            p: w / follows[p]
            for p, w in weight.items()
            if w >= pii.SUPPORT * pii.TRUSTED and w / follows[p] >= pii.TRUSTED
        }
        for _, _, n, seed in edges:
            doubt = 1.0
            for q, _, m, _ in edges:
                if m == n and q in good:
                    doubt *= 1 - good[q]
            score[n] = 1.0 if seed else (1 - doubt if 1 - doubt >= pii.TRUSTED else 0.0)
    assert {r["left"]: pytest.approx(r.score) for r in trusted.collect()} == good
    assert {r.name: pytest.approx(r.score) for r in found.collect()} == {
        n: s for n, s in score.items() if s and not n in {m for *_, m, seed in edges if seed}
    }


def test_a_pattern_of_five_instances_counts_at_any_size(spark):
    # 600,000 other pairs of a pattern and an instance do not take it away.
    def spans(rows, seed):
        one = F.struct(
            F.lit(0).alias("start"),
            F.lit(pii.PHONE if seed else 1 << pii.PHONE).alias("kind"),
            F.lit(9).alias("end"),
            F.concat(F.lit("+1555"), F.col("id").cast("string")).alias("value"),
            F.col("left"),
            F.lit(True).alias("spaced"),
        )
        own, none = F.array(one).cast(pii._SPANS), F.array().cast(pii._SPANS)
        return rows.select((own if seed else none).alias("base"), (none if seed else own).alias("like"))

    others = spark.range(600_000).withColumn("left", F.concat(F.lit("w "), F.col("id").cast("string")))
    few = spark.range(700_000, 700_005).withColumn("left", F.lit("please dial"))
    rows = spans(others, True).unionByName(spans(few.where("id < 700004"), True))
    edges, patterns = pii._graph(rows.unionByName(spans(few.where("id = 700004"), False)))
    assert [(r["left"], r.names) for r in patterns.collect()] == [("please dial", 5)]
    assert edges.count() == 5


def test_no_python_and_no_shuffle_of_texts(spark):
    plan = pii.find(llm_rows.frame(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_empty_tables_nulls_and_clashing_columns(spark):
    more = llm_rows.frame(spark).withColumns({c: F.lit("mine") for c in ("base", "added", "row", "name", "kind", "like", "s")})
    found = pii.find(more)
    assert found.columns == ["doc_id", "lang", "source", "n_chars", "row", "name", "kind", "like", "s", "base", "added"]
    rows = found.collect()
    assert len(rows) == len(llm_rows.documents()) and {r["name"] for r in rows} == {"mine"}
    assert all(r.base == [] for r in rows if r.doc_id in (3, 4))
    assert pii.find(llm_rows.empty(spark)).count() == 0
