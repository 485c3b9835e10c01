"""Exact order statistics and exact heavy terms."""

from __future__ import annotations

import random
import statistics
from collections import Counter

import pytest
from pyspark.sql import functions as F

from paperlens.operators import keywords, selection


@pytest.mark.parametrize("seed", [1, 2])
def test_values_at_ranks(spark, seed):
    rng = random.Random(seed)
    values = [rng.gauss(0, 1) * 10.0 ** rng.randint(-300, 300) for _ in range(200)]
    values += [0.0, -0.0, 5e-324, -5e-324, 1.0, 1.0, 1.0, float("inf"), float("-inf"), 1.7e308] + values[:31]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "value double").repartition(4)
    counts = selection.value_counts(df)
    order = sorted(values)
    for rank in (0, 1, 17, len(values) // 2, len(values) - 1):
        assert selection.nth_value(counts, rank) == order[rank]


def test_median(spark):
    for values in ([3.0], [1.0, 2.0], [2.0, 2.0, 9.0], [float(x % 7) for x in range(1000)], [-1.5, 0.25, 7.0, 8.0]):
        df = spark.createDataFrame([(v,) for v in values], "value double")
        assert selection.exact_median(selection.value_counts(df)) == statistics.median(values)
    none = spark.createDataFrame([(None,)], "value double")
    assert selection.exact_median(selection.value_counts(none)) is None


def test_no_window_sees_all_distinct_values(spark):
    from tests.test_plans import _plan
    from paperlens.operators.impact import citation_metrics
    df = spark.createDataFrame([(1,), (2,)], "cited_by_count long")
    plan = _plan(citation_metrics(df))
    assert "median" not in plan.lower().replace("median_citations", "") and "percentile" not in plan.lower()


@pytest.mark.parametrize("buckets", [4, 64, 1 << 20])
def test_heavy_terms_are_exact_whatever_the_sketch(spark, buckets):
    """Few buckets mix frequent and rare terms; the vocabulary is the same."""
    rng = random.Random(3)
    docs = [(i % 2, [f"t{int(rng.paretovariate(0.7)) % 400}" for _ in range(rng.randint(0, 60))]) for i in range(80)]
    df = spark.createDataFrame(docs, "label int, __terms array<string>").repartition(3)
    for k in (1, 10, 5000):
        want = {}
        for label in (0, 1):
            n = Counter(t for x, own in docs if x == label for t in own)
            want |= {(label, t): c for t, c in sorted(n.items(), key=lambda x: (-x[1], x[0]))[:k]}
        got = keywords.heavy_terms(df, k, ["label"], buckets).collect()
        assert {(r["label"], r["term"]): r["cf"] for r in got} == want
        n = Counter(t for _, own in docs for t in own)
        got = keywords.heavy_terms(df.select("__terms"), k, (), buckets).collect()
        assert {r["term"]: r["cf"] for r in got} == dict(sorted(n.items(), key=lambda x: (-x[1], x[0]))[:k])


def test_keywords_with_and_without_a_bound_agree(spark):
    rows = [(i, i % 2, " ".join(random.Random(i).choice(["alpha", "beta", "gamma", "delta"]) for _ in range(i % 9)))
            for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, label int, text string")
    for pc in ([], ["label"]):
        a, b = (keywords.tfidf_keywords(df, n=9, max_features=m, partition_cols=pc).withColumn(
            "score", F.round("score", 9)).collect() for m in (1000, None))
        assert sorted(map(tuple, a)) == sorted(map(tuple, b))
    assert keywords.tfidf_keywords(df.where("false")).count() == 0
