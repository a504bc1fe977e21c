import hashlib
import random

import llm_rows
import pytest
from pyspark.sql import functions as F

from haulscope.llm import suffix_dedup
from haulscope.llm.interval_expansion import repeated


def runs_of(marks):
    found, at = [], 0
    while at < len(marks):
        end = at
        while end < len(marks) and marks[end]:
            end += 1
        if end > at:
            found.append((at, end))
        at = end + 1
    return found


def brute(strings, weights, length):
    counts = {}
    for s, w in zip(strings, weights, strict=True):
        for i in range(len(s) - length + 1):
            counts[s[i : i + length]] = counts.get(s[i : i + length], 0) + w
    result = []
    for s in strings:
        marks = [False] * len(s)
        for i in range(len(s) - length + 1):
            if counts[s[i : i + length]] > 1:
                marks[i : i + length] = [True] * length
        result.append(runs_of(marks))
    return result


@pytest.mark.parametrize("seed", range(60))
def test_expansion_equals_brute_force(seed):
    rng = random.Random(seed)
    letters = rng.choice([b"ab", b"abcdef", bytes(range(250))])
    piece = lambda low, high: bytes(rng.choice(letters) for _ in range(rng.randint(low, high)))
    pool = [piece(5, 40) for _ in range(4)]
    strings = [
        b"".join(rng.choice([*pool, piece(1, 10)]) for _ in range(rng.randint(1, 5)))
        for _ in range(rng.randint(1, 12))
    ]
    weights = [rng.choice([1, 1, 1, 2]) for _ in strings]
    length = rng.randint(9, 30)
    assert repeated(strings, weights, length) == brute(strings, weights, length)


def expected(rows, length):
    texts = [(t or "").encode() for _, t, *_ in rows]
    found = []
    for (i, *_), data, runs in zip(rows, texts, brute(texts, [1] * len(texts), length), strict=True):
        edges = [0, *(x for run in runs for x in run), len(data)]
        kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
        found.append((i, len(data), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(found, key=str)


def got(df):
    return sorted(
        (
            (r.doc_id, r.n_bytes, [(x.first, x.first + x.length) for x in r.removed], r.kept_sha256)
            for r in df.collect()
        ),
        key=str,
    )


@pytest.mark.parametrize("case", ["plain", "hot", "segments"])
def test_removal_equals_brute_force(spark, monkeypatch, case):
    if case == "hot":
        monkeypatch.setattr(suffix_dedup, "MAX_RUNS", 1)
    if case == "segments":
        monkeypatch.setattr(suffix_dedup, "SEGMENT", 700)
        monkeypatch.setattr(suffix_dedup, "BLOCK", 1000)
    rows = llm_rows.documents()
    rows += [(300 + i, llm_rows.prose(i, 9 + 7 * i) + llm_rows.prose(99, 60), "en", "a", 1) for i in range(9)]
    found = suffix_dedup.dedup(llm_rows.frame(spark, rows), 160)
    wanted = expected(rows, 160)
    assert got(found) == wanted
    assert sum(bool(x[2]) for x in wanted) > 10
    for r in found.where("kept is not null").collect():
        assert hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256


def test_equal_runs_are_not_searched(spark, monkeypatch):
    # All runs of these copies are equal, so no string is fetched and all bytes are removed.
    held, written = {}, suffix_dedup.common.written

    def counted(df, purpose, *folders):
        found = written(df, purpose, *folders)
        held[purpose] = found.count()
        return found

    monkeypatch.setattr(suffix_dedup.common, "written", counted)
    rows = [(i, llm_rows.prose(i // 2, 80), "en", "a", 1) for i in range(6)]
    assert got(suffix_dedup.dedup(llm_rows.frame(spark, rows), 160)) == expected(rows, 160)
    assert held["shared-runs"] > 0 and held["run-strings"] == 0


def test_empty_tables_clashing_columns_and_short_lengths(spark):
    assert suffix_dedup.dedup(llm_rows.empty(spark)).count() == 0
    odd = llm_rows.frame(spark).withColumns({"removed": F.lit(1), "h": F.lit(2), "start": F.lit(3)})
    found = suffix_dedup.dedup(odd, keep_bytes=False)
    assert found.where("h = 2 and start = 3").count() == len(llm_rows.documents())
    with pytest.raises(ValueError):
        suffix_dedup.dedup(odd, 20)
