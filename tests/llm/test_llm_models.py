import base64
import random

import llm_rows
import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

from haulscope.llm import factorization, token_counts, toxicity


def test_a_machine_learns_pairs_that_no_sum_of_weights_can():
    """Label 1 exactly where two terms meet, each as often without the other."""
    rng = random.Random(3)
    rows, labels = [], []
    for _ in range(3000):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        noise = [10 + rng.randrange(40) for _ in range(6)]
        rows.append(np.array(sorted({*noise, *([1] * a), *([2] * b)})))
        labels.append(float(a == b))
    machine = factorization.fit(rows, np.array(labels), 8, least_z=0, steps=4000)
    scores = [machine.score(f[np.isin(f, machine.terms)]) for f in rows]
    right = np.mean([(s >= 0.5) == y for s, y in zip(scores, labels, strict=True)])
    assert right > 0.95


def labelled(spark, n=900):
    """Toxic are texts with an insult near a group's name, or one of many inflected slurs."""
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(n):
        words = llm_rows.prose(10_000 + i, rng.randint(20, 120)).split()
        toxic = i % 8 == 0
        if toxic:
            for _ in range(2):
                words.insert(rng.randrange(len(words)), rng.choice(["scum", "moron", f"velga{llm_rows.prose(i, 1)}"]))
        rows.append((i, " ".join(words), "en", "s", 1))
        labels.append((i, 1, int(toxic)))
    docs = llm_rows.frame(spark, rows)
    return docs, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"), labels


def test_held_out_documents_are_told_apart(spark):
    docs, labels, truth = labelled(spark)
    found = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    held = [(found[i].predicted, y) for i, _, y in truth if found[i].held_out]
    assert len(held) > 150 and all(0 <= r.score <= 1 for r in found.values())
    assert sum(p == y for p, y in held) / len(held) > 0.97
    assert all(r.predicted == (r.score >= 0.3) for r in found.values())


def test_labels_of_the_held_out_fold_are_never_used(spark):
    docs, labels, _ = labelled(spark, 300)
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a = {r.doc_id: r.score for r in toxicity.toxicity(docs, labels).collect()}
    b = {r.doc_id: r.score for r in toxicity.toxicity(docs.repartition(5), turned).collect()}
    assert a == b


def test_nulls_repeats_empty_tables_and_clashing_columns(spark):
    docs, labels, _ = labelled(spark, 100)
    more = labels.unionByName(labels).unionByName(spark.createDataFrame([(None, 1, 1), (3, 1, None)], labels.schema))
    odd = llm_rows.frame(spark).withColumns({"score": F.lit("mine"), "order": F.lit(1)})
    found = toxicity.toxicity(odd, more)
    assert found.where("order = 1").count() == len(llm_rows.documents())
    assert dict(found.dtypes)["score"] == "double" and found.where("score is null").count() == 0
    assert toxicity.toxicity(llm_rows.empty(spark), labels).count() == 0
    assert toxicity.toxicity(docs, labels.limit(0)).where("predicted = 1").count() == 0


@pytest.fixture(scope="module")
def encoding():
    lines = token_counts.vocabulary().splitlines()
    ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in lines if line)}
    return tiktoken.Encoding("t", pat_str=token_counts.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_pieces_change_no_count(encoding):
    texts = [t or "" for _, t, *_ in llm_rows.documents()] + ["a  b   c\n\n d" * 50, " " * 90, "é" * 99]
    for text in texts:
        for size in (1, 7, 64):
            parts = list(token_counts.parts(text, size))
            assert "".join(parts) == text
            assert sum(len(encoding.encode_ordinary(p)) for p in parts) == len(encoding.encode_ordinary(text))


def test_totals_for_every_limit_equal_brute_force(spark, encoding, monkeypatch):
    monkeypatch.setattr(token_counts, "BUCKET", 50)
    lengths = [len(encoding.encode_ordinary(t or "")) for _, t, *_ in llm_rows.documents()]
    odd = llm_rows.frame(spark).withColumn("n_tokens", F.lit("mine"))
    counted = token_counts.token_lengths(odd)
    assert sorted(r.n_tokens for r in counted.collect()) == sorted(lengths)
    sums = token_counts.suffix_sums(token_counts.histogram(counted)).cache()
    got = {r.length: (r.docs, r.docs_from, r.tokens_from, r.tokens_within) for r in sums.collect()}
    assert got == {
        n: (
            lengths.count(n),
            sum(x >= n for x in lengths),
            sum(x for x in lengths if x >= n),
            sum(min(x, n) for x in lengths),
        )
        for n in set(lengths)
    }
    for limit in (0, 1, 5, 111, 10**6):
        assert token_counts.within(sums, limit) == sum(min(x, limit) for x in lengths)
    in_order = sorted(lengths)
    for share in (0.01, 0.5, 0.9, 1.0):
        rank = max(0, int(np.ceil(share * len(lengths) - 1e-9)) - 1)
        assert token_counts.quantile(sums, share) == in_order[rank]


def test_no_documents_no_rows(spark):
    sums = token_counts.suffix_sums(token_counts.histogram(token_counts.token_lengths(llm_rows.empty(spark))))
    assert sums.count() == 0 and token_counts.within(sums, 5) == 0 and token_counts.quantile(sums, 0.5) is None


def test_documents_are_encoded_once_for_all_sums(spark):
    sums = token_counts.suffix_sums(token_counts.histogram(token_counts.token_lengths(llm_rows.frame(spark))))
    plan = sums._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and sums.count() > 0


def test_scores_equal_a_naive_double_sum():
    rng = np.random.default_rng(5)
    terms = np.sort(rng.choice(1_000, 60, replace=False))
    weights, factors = rng.normal(size=60), rng.normal(size=(60, 4)) / 4
    machine = factorization.Machine(-0.3, terms, weights, factors)
    for n in (0, 1, 2, 7, 30):
        at = rng.choice(60, n, replace=False)
        total = -0.3 + weights[at].sum()
        total += sum(factors[i] @ factors[k] for a, i in enumerate(at) for k in at[a + 1 :])
        assert abs(machine.score(terms[at]) - 1 / (1 + np.exp(-total))) < 1e-12
