"""End-to-end jobs on the driver tables (sf0.001): collect, split, report."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL

pytestmark = pytest.mark.skipif(not os.path.exists(SF_SMALL), reason="driver tables not present")


def test_collect_from_landed_is_balanced(spark):
    from paperlens.plans.harness import search_pages_from_documents
    from paperlens.plans.pipelines import collect_from_landed
    pages = search_pages_from_documents(spark, SF_SMALL)
    out = collect_from_landed(pages, {"src0": 1, "src1": 0, "src2": 1, "src3": 0}, 30)
    counts = {r["label"]: r["count"] for r in out.groupBy("label").count().collect()}
    assert counts[0] == counts[1] > 0
    assert out.select("uid").distinct().count() == out.count()


def test_collect_by_rules_and_report(spark, tmp_path):
    from paperlens.plans.harness import PROSE_RULES
    from paperlens.plans.pipelines import analysis_report, collect_by_rules, prepare_splits
    from paperlens.sources.adapters import documents_as_articles
    from paperlens.sources.files import write_report
    arts = documents_as_articles(spark, SF_SMALL)
    coll = collect_by_rules(arts, PROSE_RULES, max_per_rule=50)
    assert coll.count() > 0
    lab = documents_as_articles(spark, SF_SMALL, labelled=True).withColumn(
        "uid", F.col("doc_id").cast("string"))
    sp = prepare_splits(lab)
    rep = analysis_report(sp, n_keywords=5)
    write_report(rep, str(tmp_path / "report"))
    files = [f for f in os.listdir(tmp_path / "report") if f.endswith(".json")]
    doc = json.loads(open(tmp_path / "report" / files[0]).readline())
    assert doc["dataset"]["total"] == sp.count() <= lab.count()   # short texts dropped by P3
    assert set(doc["dataset"]) == {"total", "positive", "negative"}
    assert len(doc["top_keywords_positive"]) == 5
    assert "citations" in doc["impact_metrics"] and "peak_year" in doc["trend_summary"]


def test_window_comes_before_the_cap_and_rule_order_decides(spark):
    from paperlens.plans.pipelines import collect_by_rules, collect_from_landed
    from paperlens.functions.rules import LabelRule
    from paperlens.schemas import SEARCH_RESPONSE_SCHEMA
    page = lambda q, rs: {"query": q, "page": 1, "resultList": {"result": rs}}
    art = lambda i, date: {"pmid": i, "title": f"T{i}", "abstractText": "A", "firstPublicationDate": date}
    lines = [page("zeta", [art("1", "1999-01-01"), art("2", ""), art("3", "2020-01-01"), art("4", "2020-01-02")]),
             page("alpha", [art("3", "2020-01-01"), art("5", "2021-01-01")])]
    pages = spark.createDataFrame([(json.dumps(x),) for x in lines], "line string").select(
        F.from_json("line", SEARCH_RESPONSE_SCHEMA).alias("p")).select("p.*")
    got = collect_from_landed(pages, {"zeta": 1, "alpha": 1}, 2, 2018, 2025, balance=False).collect()
    assert sorted((r["pmid"], r["query"]) for r in got) == [("3", "zeta"), ("4", "zeta"), ("5", "alpha")]
    arts = spark.createDataFrame([(1, "7", "", "", "zebra apple", "text")],
                                 "seq int, pmid string, doi string, pmcid string, title string, abstract string")
    rules = [LabelRule("zeta-first", "zebra", 1), LabelRule("alpha-second", "apple", 1)]
    assert [r["query"] for r in collect_by_rules(arts, rules, balance=False).collect()] == ["zeta-first"]


def test_collect_split_report_train_chain(spark):
    """The output of the collect job is the input of the split, report and training jobs."""
    from paperlens.plans.harness import search_pages_from_documents
    from paperlens.plans.pipelines import analysis_report, collect_from_landed, prepare_splits, train_job
    pages = search_pages_from_documents(spark, SF_SMALL)
    coll = collect_from_landed(pages, {f"src{i}": i % 2 for i in range(8)})
    sp = prepare_splits(coll).persist()
    rep = analysis_report(sp, n_keywords=3).first()
    assert rep["dataset"]["total"] == sp.count() > 20
    metrics = train_job(sp, ("logistic_regression",), id_col="doc_id").collect()
    assert {r["split"] for r in metrics} == {"val", "test"}
    sp.unpersist()
