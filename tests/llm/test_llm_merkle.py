import hashlib
import zlib
from collections import defaultdict

import llm_rows
import pytest
from pyspark.sql import functions as F

from haulscope.llm import merkle_manifest as merkle


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(doc_id, source, lang, n_chars, text):
    values = [None if v is None else str(v) for v in (doc_id, source, lang, n_chars, text)]
    return sha("".join("-" if v is None else f"{len(v.encode())}:{v}" for v in values))


def tree(leaves):
    """The root, and per leaf its siblings level by level."""
    paths = [[] for _ in leaves]
    under = [[i] for i in range(len(leaves))]
    nodes = list(leaves)
    while len(nodes) > 1:
        higher, members = [], []
        for at in range(0, len(nodes), 16):
            run = nodes[at : at + 16]
            for k, node_leaves in enumerate(under[at : at + 16]):
                for i in node_leaves:
                    paths[i].append(("".join(run[:k]), "".join(run[k + 1 :])))
            higher.append(sha("".join(run)))
            members.append([i for x in under[at : at + 16] for i in x])
        nodes, under = higher, members
    return nodes[0], paths


def brute_force(rows):
    """Rows (doc_id, text, lang, source, n_chars) to the rows of the query."""
    by_source = defaultdict(list)
    for doc_id, text, lang, source, n in rows:
        other = None
        if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0 and text is not None:
            low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            other = leaf_of(doc_id, source, lang, n, low)
        by_source[source].append((doc_id, leaf_of(doc_id, source, lang, n, text), other))
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    inner = {}
    for source in order:
        by_source[source].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        inner[source] = tree([leaf for _, leaf, _ in by_source[source]])
    root, outer = tree([inner[s][0] for s in order])
    found = []
    for k, source in enumerate(order):
        subroot, paths = inner[source]
        for (doc_id, leaf, other), path in zip(by_source[source], paths, strict=True):
            path, node = path + outer[k], other or leaf
            for left, right in path:
                node = sha(left + node + right)
            proof = sha("".join(a + b for a, b in path))
            found.append((doc_id, leaf, subroot, root, proof, node, node == root))
    return found


def query(spark, rows, tmp_path):
    llm_rows.frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    return merkle.query(spark, str(tmp_path))


def key(row):
    return [(v is not None, str(v)) for v in row]


def test_equals_brute_force_on_awkward_rows(spark, tmp_path):
    rows = [*llm_rows.documents(), *((200 + i, f"Loud {i}", "en", "a", 1) for i in range(30))]
    found = [tuple(r) for r in query(spark, rows, tmp_path).collect()]
    assert sorted(found, key=key) == sorted(brute_force(rows), key=key)
    assert not all(r[-1] for r in found) and any(r[-1] for r in found)


def test_equals_brute_force_on_trees_of_several_rounds(spark, tmp_path):
    # More than 256 leaves (two rounds) under one source, more than 256 sources, and edges of runs.
    sizes = {"big": 4_113, "full": 256, "one more": 257, "run": 16, "seventeen": 17}
    sizes |= {f"s{i}": 1 + i % 3 for i in range(270)}
    rows, at = [], 0
    for source, n in sizes.items():
        for _ in range(n):
            rows.append((at * 7 % 99991, f"Text {at}" if at % 11 else None, "en", source, at))
            at += 1
    found = [tuple(r) for r in query(spark, rows, tmp_path).collect()]
    assert sorted(found, key=key) == sorted(brute_force(rows), key=key)


@pytest.mark.parametrize("n", [1, 2, 16, 17, 255, 256, 257, 272, 273, 4096, 4097])
def test_positions_are_those_of_a_postorder_walk(n):
    order = []

    def walk(level, index):
        if level:
            for child in range(index * 16, min(index * 16 + 16, -(-n // 16 ** (level - 1)))):
                walk(level - 1, child)
        order.append((level, index))

    walk(merkle.height(n), 0)
    assert all(merkle.position(n, *node) == at for at, node in enumerate(order))


def test_builders_append_in_postorder():
    for m, up in ((1, 0), (1, 2), (9, 1), (16, 1), (16, 2), (17, 2), (255, 2), (256, 2)):
        leaves = [sha(str(i)) for i in range(m)]
        log = merkle.append_log(leaves, up)
        assert [log[merkle.position(m, 0, i, up)] for i in range(m)] == leaves
        runs = [sha("".join(leaves[i : i + 16])) for i in range(0, m, 16)] if up else []
        assert [log[merkle.position(m, 1, i, up)] for i in range(len(runs))] == runs
        assert len(log) == len(set(range(m))) + len(runs) + (up == 2)


def test_the_log_addresses_every_node(spark):
    rows = [(i, str(i), "en", "a", i) for i in range(700)] + [(1, "x", "en", None, 1)]
    found = merkle.manifest(llm_rows.frame(spark, rows))
    log = {(r.source, r.position): r for r in found.log().collect()}
    size = 700 + 44 + 3 + 1
    assert {p for s, p in log if s == "a"} == set(range(size)) and (None, 0) in log
    # A proof read by address alone.
    node = log["a", merkle.position(700, 0, 530)].digest
    for level in range(merkle.height(700)):
        own = 530 // 16**level
        run = range(own - own % 16, min(own - own % 16 + 16, -(-700 // 16**level)))
        parts = [node if i == own else log["a", merkle.position(700, level, i)].digest for i in run]
        node = sha("".join(parts))
    assert node == log["a", size - 1].digest
    assert node in [r.subroot for r in found.sources.collect()]


def test_further_columns_and_empty_tables(spark):
    named = ("tree", "rank", "seg", "n", "digest", "id", "other", "log", "above", "at", "part")
    more = llm_rows.frame(spark).withColumns({c: F.lit("mine") for c in named})
    plain = merkle.proofs(merkle.manifest(llm_rows.frame(spark))).collect()
    assert sorted(map(str, plain)) == sorted(map(str, merkle.proofs(merkle.manifest(more)).collect()))
    none = merkle.manifest(llm_rows.empty(spark))
    assert none.root() is None and merkle.proofs(none).count() == 0 and none.log().count() == 0


def test_a_changed_cell_changes_the_root(spark):
    rows = llm_rows.documents()
    roots = {merkle.manifest(llm_rows.frame(spark, r)).root() for r in (rows, rows[1:], [*rows[:-1], (*rows[-1][:4], -1)])}
    assert len(roots) == 3
