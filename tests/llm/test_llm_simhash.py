import random
import re

import llm_rows
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from haulscope.llm import simhash_dedup, simhash_text
from haulscope.llm.components import components


def slow_fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall("[^\x20\x09-\x0d]+", text)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(prints):
    """Brute force: smallest reachable id of each row, by index."""
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                root[find(a)] = find(b)
    return [find(x) for x in range(len(prints))]


def test_fingerprints_equal_brute_force(monkeypatch):
    texts = [t for _, t, *_ in llm_rows.documents()]
    assert [simhash_text.fingerprint(t) for t in texts] == [slow_fingerprint(t) for t in texts]
    monkeypatch.setattr(simhash_text, "CHUNK", 7)
    assert [simhash_text.fingerprint(t) for t in texts] == [slow_fingerprint(t) for t in texts]


def test_distance_of_counts_is_a_lower_bound_and_one_band_is_near():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 2000).astype(np.uint64)
    b = a.copy()
    for _ in range(3):
        b ^= np.uint64(1) << rng.integers(0, 64, 2000).astype(np.uint64)
    unlike = simhash_dedup.embedding(a) ^ simhash_dedup.embedding(b)
    assert (np.bitwise_count(unlike) <= np.bitwise_count(a ^ b)).all()
    low, high = np.bitwise_count(unlike & np.uint64(0xFFFFFFFF)), np.bitwise_count(unlike >> np.uint64(32))
    assert (np.minimum(low, high) <= 1).all()


@pytest.mark.parametrize("max_cell", [4096, 2])
def test_groups_equal_brute_force(spark, max_cell):
    rows = llm_rows.documents()
    found = simhash_dedup.near_duplicates(llm_rows.frame(spark), max_cell).collect()
    prints = [slow_fingerprint(t) for _, t, *_ in rows]
    root = groups(prints)
    ids = {}
    for (i, *_), r in zip(rows, root, strict=True):
        ids.setdefault(r, []).append(i)
    least = lambda r: min((i for i in ids[r] if i is not None), default=None)
    expected = [(i, f"{p:016x}", least(r)) for (i, *_), p, r in zip(rows, prints, root, strict=True)]
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in found]
    assert sorted(got, key=str) == sorted(expected, key=str)


@pytest.mark.parametrize("max_cell", [4096, 3])
def test_links_keep_clusters_of_near_fingerprints_together(spark, max_cell):
    rng = random.Random(5)
    prints = set()
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(12):
            prints.add(centre ^ sum({1 << rng.randrange(64) for _ in range(rng.randint(0, 3))}))
    prints |= {0, 2**64 - 1, 7, 2**63}
    prints = sorted(prints)
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fp bigint").repartition(4)
    links = simhash_dedup.links(df, max_cell).collect()
    assert all(((r.a ^ r.b) & (2**64 - 1)).bit_count() <= 3 for r in links)
    root = {x: x for x in signed}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for r in links:
        root[find(r.a)] = find(r.b)
    expected = groups(prints)
    got = [find(x) for x in signed]
    assert len(set(expected)) == len(set(zip(expected, got, strict=True))) == len(set(got))


def test_components_of_a_chain_a_star_and_a_hub(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(1, i) for i in range(2, 60)]
    df = spark.createDataFrame([*chain, *star, (5, 5), (3, 1)], "a bigint, b bigint")
    found = {r.node: r.component for r in components(df).collect()}
    assert found == {**{i: 100 for i in range(100, 161)}, **{i: 1 for i in range(1, 60)}}
    assert components(df.limit(0)).count() == 0


def test_empty_table_and_clashing_columns(spark):
    assert simhash_dedup.near_duplicates(llm_rows.empty(spark)).count() == 0
    odd = llm_rows.frame(spark).withColumns({"fp": F.lit(1), "node": F.lit(2), "component_id": F.lit(3)})
    found = simhash_dedup.near_duplicates(odd)
    assert found.where("node = 2").count() == len(llm_rows.documents())
    assert found.columns.count("component_id") == 1
