"""Checkpoint folder: the cluster's setting wins; a scratch folder only when unset."""

from __future__ import annotations

from paperlens.session import cut_lineage, ensure_checkpoint_dir


def test_checkpoint_dir_is_set_and_stable(spark):
    first = ensure_checkpoint_dir(spark)
    assert first
    assert ensure_checkpoint_dir(spark) == first        # never replaced once set


def test_cut_lineage_keeps_rows(spark):
    df = spark.range(100).selectExpr("id", "id * 2 AS x")
    cut = cut_lineage(df)
    assert cut.count() == 100 and cut.agg({"x": "sum"}).first()[0] == 9900
