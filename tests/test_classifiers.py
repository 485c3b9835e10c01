"""M1-M5, M10, M13, S15 on a small labelled set."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from paperlens.operators.classifiers import BaselineClassifier
from tests.conftest import SF_SMALL

@pytest.fixture(scope="module")
def data(spark):
    """Labelled documents of the smallest tables."""
    d = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")
    y = spark.read.parquet(f"{SF_SMALL}/labels.parquet").select(
        "doc_id", F.col("quality").cast("int").alias("label"))
    return d.join(y, "doc_id").where("doc_id < 80").persist()


def test_unknown_model_and_unfitted():
    with pytest.raises(ValueError):
        BaselineClassifier("nope")
    with pytest.raises(RuntimeError):
        BaselineClassifier("logistic_regression").predict_proba(None)


@pytest.mark.parametrize("name", ["logistic_regression", "svm", "random_forest"])
def test_fit_predict_evaluate_save_load(spark, data, name, tmp_path):
    clf = BaselineClassifier(name).fit(data)
    pr = clf.predict_proba(data).collect()
    assert {r["prediction"] for r in pr} <= {0, 1}
    assert all(abs(r["p0"] + r["p1"] - 1.0) < 1e-9 for r in pr)
    ev = clf.evaluate(data).first()
    for m in ("accuracy", "precision", "recall", "f1", "auc_roc"):
        assert 0.0 <= ev[m] <= 1.0
    top = clf.top_features(5).collect()
    kinds = {r["kind"] for r in top}
    assert all(sum(1 for r in top if r["kind"] == k) <= 5 for k in kinds)
    clf.save(str(tmp_path / name))
    back = BaselineClassifier.load(str(tmp_path / name))
    a = sorted((r["doc_id"], r["prediction"]) for r in pr)
    b = sorted((r["doc_id"], r["prediction"]) for r in back.predict_proba(data).collect())
    assert a == b


def test_batch_score(spark, data):
    from paperlens.operators.scoring import batch_score, length_logit_model
    out = batch_score(data, length_logit_model(), "text").collect()
    assert all(abs(r["p0"] + r["p1"] - 1) < 1e-9 and r["prediction"] in (0, 1) for r in out)


@pytest.mark.parametrize("n,parts", [(0, 1), (300, 1), (14_000, 7), (40_000, 12), (860_000, 86)])
def test_rows_of_a_forest_are_dealt_out(n, parts):
    """A task holds its rows as dense ones, 40 KB each: 50,000 in one are 2 GB."""
    from paperlens.operators.classifiers import forest_parts
    assert forest_parts(n) == parts


def test_splits_are_written_once(spark):
    """What fits and evaluations read again and again is a table, no plan of joins and sorts."""
    from paperlens.plans.harness import _ml_splits
    plan = _ml_splits(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Scan parquet" in plan and "Exchange" not in plan and "Join" not in plan
