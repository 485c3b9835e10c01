"""Dedup, exact balance, splits."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from paperlens.operators.curate import (
    balance, collection_pipeline, create_splits, cut_keys, dedup_keep_first, split_quotas,
    split_stats, with_dedup_key)


def test_dedup_key_priority_and_keep_first(spark):
    rows = [(1, "p1", "", "", "T"), (2, "p1", "d9", "", "other"), (3, "", "d1", "c1", "x"),
            (4, "", "", "c1", "x"), (5, "", "", "", "  Same Title "), (6, "", "", "", "same title")]
    df = spark.createDataFrame(rows, "seq int, pmid string, doi string, pmcid string, title string")
    keyed = with_dedup_key(df)
    uids = {r["seq"]: r["uid"] for r in keyed.collect()}
    assert uids[1] == "pmid:p1" and uids[3] == "doi:d1" and uids[4] == "pmcid:c1"
    assert uids[5] == uids[6] == "title:same title"
    kept = sorted(r["seq"] for r in dedup_keep_first(keyed, "uid", "seq").collect())
    assert kept == [1, 3, 4, 5]


def _split_fixture(spark, n=100):
    return spark.createDataFrame([(i, f"text {i}", i % 2) for i in range(n)],
                                 "doc_id int, text string, label int")


def test_split_sizes_disjoint_and_balanced(spark):
    sp = create_splits(_split_fixture(spark)).cache()
    sizes = {r["split"]: r["n"] for r in sp.groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert sum(sizes.values()) == 100
    assert sp.select("text").distinct().count() == 100
    for r in split_stats(sp).collect():
        assert 0.3 <= r["positive"] / r["size"] <= 0.7


def test_split_quotas_match_two_cut_rule(spark):
    counts = spark.createDataFrame([(1, 674), (0, 674)], "label int, n long")
    q = split_quotas(counts).collect()
    assert sum(r["n_train"] for r in q) == 943
    assert sum(r["n_val"] for r in q) == 202
    assert sum(r["n_test"] for r in q) == 203


def test_split_is_reproducible_and_seeded(spark):
    df = _split_fixture(spark)
    a = sorted(tuple(r) for r in create_splits(df, seed=1).select("doc_id", "split").collect())
    b = sorted(tuple(r) for r in create_splits(df, seed=1).select("doc_id", "split").collect())
    c = sorted(tuple(r) for r in create_splits(df, seed=2).select("doc_id", "split").collect())
    assert a == b and a != c


@pytest.mark.parametrize("digits", [1, 3])
def test_cut_keys_are_those_of_a_global_row_number(spark, digits):
    from pyspark.sql import Window
    df = _split_fixture(spark, 500).withColumn("label", F.when(F.col("doc_id") % 50 > 0, F.col("label")))
    quotas = df.groupBy("label").agg(F.floor(F.count("*") * 0.3).alias("a"), F.count("*").alias("all"),
                                     F.lit(0).alias("none"), F.lit(10 ** 6).alias("more"))
    cuts = cut_keys(df, "label", ["doc_id"], quotas, ["a", "all", "none", "more"], 42, digits)
    h = F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), F.lit("42")))
    rank = df.withColumn("h", h).withColumn("r", F.row_number().over(Window.partitionBy("label").orderBy(h, "doc_id")))
    want = {(r["label"], r["r"]): (r["h"], r["doc_id"]) for r in rank.collect()}
    n = {r["label"]: r["count"] for r in df.groupBy("label").count().collect()}
    got = cuts.collect()
    assert len(got) == len(n) == 3
    for r in got:
        assert tuple(r["a"]) == want[(r["label"], int(n[r["label"]] * 0.3))]
        assert tuple(r["all"]) == tuple(r["more"]) == want[(r["label"], n[r["label"]])] and r["none"] is None


def test_balance_exact(spark):
    df = spark.createDataFrame([(i, 1 if i < 70 else 0) for i in range(100)], "doc_id int, label int")
    out = balance(df)
    counts = {r["label"]: r["n"] for r in out.groupBy("label").agg(F.count("*").alias("n")).collect()}
    assert counts == {0: 30, 1: 30}
    empty = balance(df.where("label = 1"))
    assert empty.count() == 0          # a missing class has size 0


def test_collection_pipeline_dedups_per_class(spark):
    rows = [(1, "p1", "", "", "A", 1), (2, "p1", "", "", "A", 0), (3, "p1", "", "", "A", 1),
            (4, "p2", "", "", "B", 0)]
    df = spark.createDataFrame(rows, "seq int, pmid string, doi string, pmcid string, title string, "
                                     "label int")
    out = collection_pipeline(df, balance_classes=False)
    got = sorted((r["label"], r["seq"]) for r in out.collect())
    assert got == [(0, 2), (0, 4), (1, 1)]


def test_conflict_policies(spark):
    from paperlens.operators.curate import label_conflicts, resolve_conflicts
    rows = [(1, "p1", 1), (2, "p1", 0), (3, "p2", 0)]
    df = spark.createDataFrame(rows, "seq int, uid string, label int")
    assert label_conflicts(df).count() == 1
    assert sorted(r["seq"] for r in resolve_conflicts(df, "keep").collect()) == [1, 2, 3]
    assert sorted(r["seq"] for r in resolve_conflicts(df, "drop").collect()) == [3]
    assert sorted(r["seq"] for r in resolve_conflicts(df, "positive").collect()) == [1, 3]
