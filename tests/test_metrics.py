"""A1-A7, W1, W2, M6-M9, M15 with exact expected values."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from paperlens.operators.evaluation import (
    best_epoch, classification_report, confusion_cells, evaluate, metrics_long, roc_auc)
from paperlens.operators.impact import (
    all_impact_metrics, citation_metrics, journal_spread, open_access, yearly_stats)
from paperlens.operators.trends import publications_per_year, trend_summary, trend_table


@pytest.fixture
def table(spark):
    rows = [(0, "Nature", 2020, 10, True, 1), (1, "Lancet", 2021, 50, False, 0),
            (2, "Nature", 2022, 5, True, 1), (3, "BMJ", 2022, 100, False, 0),
            (4, "Wellcome Open Res", 2023, 0, True, 1)]
    return spark.createDataFrame(rows, "seq int, journal string, year int, cited_by_count int, "
                                       "is_open_access boolean, label int")


def test_citations(table):
    r = citation_metrics(table).first()
    assert (r["total_citations"], r["max_citations"], r["min_citations"]) == (165, 100, 0)
    assert (r["articles_with_citations"], r["articles_without_citations"]) == (4, 1)
    assert (r["highly_cited_10plus"], r["highly_cited_50plus"]) == (3, 2)
    assert r["median_citations"] == 10.0 and r["mean_citations"] == 33.0


def test_journals_and_open_access(table):
    j = journal_spread(table).orderBy("rank").collect()
    assert j[0]["journal"] == "Nature" and j[0]["count"] == 2 and j[0]["total_journals"] == 4
    assert j[1]["journal"] == "Lancet"          # first seen among the ties
    oa = open_access(table).first()
    assert (oa["open_access_count"], oa["closed_access_count"], oa["open_access_rate"]) == (3, 2, 60.0)


def test_yearly_and_trend(table):
    y = {r["year"]: r for r in yearly_stats(table).collect()}
    assert y[2022]["count"] == 2 and y[2022]["total_citations"] == 105
    assert sum(r["count"] for r in publications_per_year(table).collect()) == 5
    s = trend_summary(table).first()
    assert s["total_publications"] == 5 and s["year_range"] == "2020–2023"


def test_trend_golden_values(spark):
    counts = [2, 2, 9, 14, 21, 23, 44, 547, 12]
    rows = [(y,) for y, c in zip(range(2018, 2027), counts) for _ in range(c)]
    df = spark.createDataFrame(rows, "year int")
    t = trend_table(df).orderBy("year").collect()
    growth = [None if r["growth_rate"] is None else round(r["growth_rate"], 1) for r in t]
    assert growth == [None, 0.0, 350.0, 55.6, 50.0, 9.5, 91.3, 1143.2, -97.8]
    assert [r["cumulative"] for r in t] == [2, 4, 13, 27, 48, 71, 115, 662, 674]
    s = trend_summary(df).first()
    assert (s["peak_year"], s["peak_count"]) == (2025, 547)
    assert s["average_per_year"] == 74.9 and s["average_growth_rate"] == 200.2


def test_all_impact_metrics_positive_only(table):
    m = all_impact_metrics(table).first()
    assert m["dataset_size"] == 3 and m["citations"]["total_citations"] == 15
    assert m["open_access"]["open_access_rate"] == 100.0


def _confusion_rows(spark, tn, fp, fn, tp):
    rows = [(0, 0, 0.1)] * tn + [(0, 1, 0.9)] * fp + [(1, 0, 0.2)] * fn + [(1, 1, 0.8)] * tp
    return spark.createDataFrame(rows, "label int, prediction int, p1 double")


def test_golden_confusion(spark):
    e = evaluate(_confusion_rows(spark, 102, 0, 1, 100)).first()
    assert round(e["accuracy"], 5) == 0.99507 and e["precision"] == 1.0
    assert round(e["recall"], 5) == 0.9901 and round(e["f1"], 5) == 0.99502
    assert e["confusion_matrix"] == [[102, 0], [1, 100]]
    rep = {r["class"]: r for r in classification_report(_confusion_rows(spark, 102, 0, 1, 100)).collect()}
    assert round(rep["macro avg"]["f1_score"], 5) == 0.99507
    assert rep["1"]["support"] == 101 and rep["0"]["support"] == 102


def test_auc_ties_and_one_class(spark):
    rows = [(1, 0.9), (1, 0.5), (0, 0.5), (0, 0.1)]
    df = spark.createDataFrame(rows, "label int, p1 double")
    assert roc_auc(df).first()[0] == pytest.approx((1 + 0.5 + 1 + 1) / 4)
    one = spark.createDataFrame([(1, 0.3)], "label int, p1 double")
    assert roc_auc(one).first()[0] is None


def test_chart_tables(spark):
    e = evaluate(_confusion_rows(spark, 3, 1, 2, 4)).withColumn("model", F.lit("m"))
    cells = sorted(tuple(r) for r in confusion_cells(e, ["model"]).select("true_label", "predicted_label", "n").collect())
    assert cells == [(0, 0, 3), (0, 1, 1), (1, 0, 2), (1, 1, 4)]
    assert [r["metric"] for r in metrics_long(e).orderBy("metric_ord").collect()] == [
        "accuracy", "precision", "recall", "f1", "auc_roc"]


def test_best_epoch_earliest_on_ties(spark):
    h = spark.createDataFrame([(1, 0.9851), (2, 0.9950), (3, 0.9950)], "epoch int, val_f1 double")
    assert best_epoch(h).first()["epoch"] == 2


def test_drop_year_zero(spark):
    df = spark.createDataFrame([(0, 1), (2020, 2), (2020, 3)], "year int, cited_by_count int")
    assert [r["year"] for r in yearly_stats(df).collect()] == [0, 2020]
    assert [r["year"] for r in yearly_stats(df, drop_year_zero=True).collect()] == [2020]
    assert [r["year"] for r in publications_per_year(df, drop_year_zero=True).collect()] == [2020]
