"""Tables are replaced as a whole or not at all; the optimum and the shared features."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from paperlens.sources.files import load_splits, read_articles_csv, save_splits, write_articles_csv
from paperlens.sources.publish import current, publish


def test_a_write_that_dies_leaves_the_table(spark, tmp_path):
    path = str(tmp_path / "articles")
    first = spark.createDataFrame([(1, 'a "quoted"\nline'), (2, None), (3, "")], "doc_id long, title string")
    write_articles_csv(first, path)
    before = current(spark, path)

    @F.udf("string")
    def dies(x):
        if x is None:
            raise ValueError("half-way")
        return x

    with pytest.raises(Exception, match="half-way"):
        write_articles_csv(first.repartition(3).withColumn("title", dies("title")), path)
    assert current(spark, path) == before and len(os.listdir(path)) >= 2
    rows = read_articles_csv(spark, path, first.schema).collect()
    assert sorted(map(tuple, rows)) == [(1, 'a "quoted"\nline'), (2, None), (3, "")]
    write_articles_csv(first.where("doc_id = 2"), path)
    assert [tuple(r) for r in read_articles_csv(spark, path, first.schema).collect()] == [(2, None)]


def test_splits_follow_the_manifest(spark, tmp_path):
    path = str(tmp_path / "splits")
    for n in (2, 5):
        df = spark.range(n).select("id", F.lit(1).alias("label"), F.lit("train").alias("split"))
        save_splits(df, path)
        assert load_splits(spark, path).count() == n


def test_versions_are_numbered_and_plain_folders_read(spark, tmp_path):
    path = str(tmp_path / "t")
    assert current(spark, path) == path
    made = [publish(spark, path, lambda to: spark.range(1).write.parquet(to)) for _ in range(11)]
    assert len(set(made)) == 11 and current(spark, path) == made[-1]


def test_gradient_tells_an_optimum(spark):
    from paperlens.operators import classifiers
    rows = [(i, i % 2, ("alpha beta " if i % 2 else "beta gamma ") * (i % 3 + 1)) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, label int, text string")
    features = classifiers.fit_features(df)
    clf = classifiers.BaselineClassifier().fit_vectors(features, df)
    norm, n = classifiers.gradient_norm(clf, features.transform(df))
    assert n == 40 and norm <= classifiers.LR_TOL
    assert classifiers.gradient_norm(clf, features.transform(df.where("label = 1")))[0] > 0.01


def test_features_are_fitted_once_for_all_models(spark, monkeypatch):
    from paperlens.operators import classifiers
    rows = [(i, i % 2, ("alpha beta " if i % 2 else "beta gamma ") * (i % 3 + 1), ("train", "train", "train", "val", "test")[i % 5])
            for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, label int, text string, split string")
    calls, real = [], classifiers.fit_features
    monkeypatch.setattr(classifiers, "fit_features", lambda *a, **k: calls.append(1) or real(*a, **k))
    metrics, top = classifiers.train_and_evaluate(df, num_trees=5)
    assert len(calls) == 1 and metrics.count() == 6 and set(top) == set(classifiers.MODELS)
