"""Landed responses, metadata defaults, file sinks and sources, streaming."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from paperlens.schemas import RAW_RESULT_SCHEMA
from paperlens.sources.landed import (
    annotations, articles_from_pages, citation_edges, count_results, extract_metadata,
    lookup_by_id, read_annotation_records, read_citation_pages, read_search_pages)


def _write_lines(path, objs):
    path.write_text("\n".join(json.dumps(o) for o in objs) + "\n")


def test_extract_defaults_on_empty_record(spark):
    df = spark.createDataFrame([({},)], "raw struct<pmid:string>")
    raw = spark.createDataFrame([(None,)], f"raw {RAW_RESULT_SCHEMA.simpleString()}")
    r = raw.select(*extract_metadata("raw")).first()
    assert r["title"] == "" and r["abstract"] == "" and r["cited_by_count"] == 0
    assert r["is_open_access"] is False and r["keywords"] == [] and r["pub_type"] == []
    assert df.count() == 1


def test_search_pages_cap_and_flags(spark, tmp_path):
    page = lambda q, p, ids: {"query": q, "page": p, "hitCount": 9, "resultList": {"result": [
        {"pmid": str(i), "title": f"T{i}", "abstractText": "A", "isOpenAccess": "Y" if i % 2 else "N",
         "hasTextMinedTerms": "Y", "citedByCount": i, "keywordList": {"keyword": ["k"]}} for i in ids]}}
    _write_lines(tmp_path / "p.json", [page("q1", 1, [1, 2, 3]), page("q1", 2, [4, 5]),
                                       page("q2", 1, [6]), page("q2", 2, [])])
    pages = read_search_pages(spark, str(tmp_path / "p.json"))
    arts = articles_from_pages(pages, max_results=4).orderBy("query", "page", "pos").collect()
    assert [a["pmid"] for a in arts] == ["1", "2", "3", "4", "6"]
    assert arts[0]["is_open_access"] is True and arts[1]["is_open_access"] is False
    assert arts[0]["full_text_available"] is True and arts[0]["keywords"] == ["k"]
    hits = count_results(articles_from_pages(pages, None), F.col("cited_by_count") > 2).first()[0]
    assert hits == 4


def test_lookup_returns_none_when_missing(spark):
    arts = spark.createDataFrame([("d1", 1, "x"), ("d1", 2, "y"), ("d2", 3, "z")],
                                 "doi string, seq int, title string")
    ids = spark.createDataFrame([("d1",), ("zz",)], "id string")
    got = {r["requested_id"]: r["title"] for r in lookup_by_id(arts, ids, "doi", "id", ["seq"]).collect()}
    assert got == {"d1": "x", "zz": None}


def test_citations_capped(spark, tmp_path):
    _write_lines(tmp_path / "c.json", [
        {"article_id": "A", "article_source": "MED", "page": 1, "hitCount": 3,
         "citationList": {"citation": [{"id": "1"}, {"id": "2"}]}},
        {"article_id": "A", "article_source": "MED", "page": 2, "hitCount": 3,
         "citationList": {"citation": [{"id": "3"}]}}])
    e = citation_edges(read_citation_pages(spark, str(tmp_path / "c.json")), max_results=2)
    assert sorted(r["other_id"] for r in e.collect()) == ["1", "2"]


def test_annotations_list_or_single_record(spark, tmp_path):
    rec = lambda i: {"extId": i, "source": "MED", "annotations": [
        {"type": "Organisms", "exact": "moth", "prefix": "the "}, {"type": "Genes", "exact": "COI"}]}
    (tmp_path / "list.json").write_text(json.dumps([rec("1"), rec("2")]))
    (tmp_path / "one.json").write_text(json.dumps(rec("3")))
    recs = read_annotation_records(spark, [str(tmp_path / "list.json"), str(tmp_path / "one.json")],
                                   multiline=True)
    ids = spark.createDataFrame([("1",), ("3",)], "id string")
    out = annotations(recs, ids, "id", "Organisms").collect()
    assert sorted(r["extId"] for r in out) == ["1", "3"] and all(r["exact"] == "moth" for r in out)


def test_splits_round_trip(spark, tmp_path):
    from paperlens.operators.curate import create_splits
    from paperlens.sources.files import load_splits, save_splits
    df = spark.createDataFrame([(i, i % 2, f"t{i}", ["a"]) for i in range(40)],
                               "doc_id int, label int, text string, kw array<string>")
    sp = create_splits(df)
    stats = save_splits(sp, str(tmp_path / "splits"), fmt="csv")
    assert sum(r["size"] for r in stats.collect()) == 40
    back = load_splits(spark, str(tmp_path / "splits"), fmt="csv")
    assert back.count() == 40 and back.where("split = 'test'").count() > 0
    assert back.select("kw").first()[0] == "['a']"


def test_model_results_and_history(spark, tmp_path):
    from paperlens.operators.evaluation import best_epoch, best_model, comparison_table
    from paperlens.sources.files import load_history, load_model_results
    (tmp_path / "b.json").write_text(json.dumps({
        "logistic_regression": {"val": {"f1": 0.9}, "test": {"accuracy": 0.99, "f1": 0.995}},
        "svm": {"test": {"accuracy": 0.98, "f1": 0.995, "auc_roc": 1.0}}}))
    (tmp_path / "t.json").write_text(json.dumps({
        "model": "org/some-bert", "test_results": {"f1": 0.99},
        "training_history": [{"epoch": 1, "val_f1": 0.98}, {"epoch": 2, "val_f1": 0.995},
                             {"epoch": 3, "val_f1": 0.995}]}))
    res = load_model_results(spark, str(tmp_path / "b.json"), str(tmp_path / "t.json"))
    table = comparison_table(res)
    rows = {r["model"]: r for r in table.collect()}
    assert rows["TF-IDF + svm"]["auc_roc"] == 1.0 and rows["TF-IDF + logistic_regression"]["auc_roc"] == 0.0
    assert rows["some-bert"]["type"] == "transformer"
    assert best_model(table).first()["model"] == "TF-IDF + logistic_regression"
    assert best_epoch(load_history(spark, str(tmp_path / "t.json"))).first()["epoch"] == 2


def test_streaming_ingest_dedups(spark, tmp_path):
    from paperlens.streaming.ingest import stream_articles, write_articles
    land = tmp_path / "land"
    land.mkdir()
    res = lambda ids: {"query": "q", "page": 1, "resultList": {"result": [
        {"pmid": str(i), "title": f"T{i}", "abstractText": "A"} for i in ids]}}
    _write_lines(land / "a.json", [res([1, 2])])
    _write_lines(land / "b.json", [res([2, 3])])
    q = write_articles(stream_articles(spark, str(land)), str(tmp_path / "out"),
                       checkpoint=str(tmp_path / "ckpt"))
    q.awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r["pmid"] for r in out.collect()) == ["1", "2", "3"]


ODD_TEXTS = ['He said "hi", ok', "two\nlines", "back\\slash \\\" end", "", None, "  blanks  ", ",", '"', "a,b;c\ttab"]


def test_csv_round_trip_of_odd_texts(spark, tmp_path):
    from paperlens.sources.files import read_articles_csv, write_articles_csv
    df = spark.createDataFrame(list(enumerate(ODD_TEXTS)), "i int, text string").withColumn("z", F.lit("end"))
    write_articles_csv(df, str(tmp_path / "csv"))
    back = read_articles_csv(spark, str(tmp_path / "csv"), "i int, text string, z string").orderBy("i").collect()
    assert [(r["i"], r["text"], r["z"]) for r in back] == [(i, t, "end") for i, t in enumerate(ODD_TEXTS)]


def test_reports_and_splits_by_uri(spark, tmp_path):
    from paperlens.sources.files import load_model_results, load_splits
    (tmp_path / "b.json").write_text(json.dumps({"svm": {"test": {"f1": 0.5}}}))
    for path in (f"file:{tmp_path}/b.json", f"{tmp_path}/b.json"):
        assert [r["model"] for r in load_model_results(spark, path, f"file:{tmp_path}/none.json").collect()] == [
            "TF-IDF + svm"]
    spark.createDataFrame([(1, "train")], "x int, split string").write.partitionBy("split").parquet(
        f"file:{tmp_path}/sp")
    assert load_splits(spark, f"file:{tmp_path}/sp").count() == 1


def test_cap_takes_first_results_of_each_query(spark):
    from paperlens.sources.landed import search_results
    pages = spark.createDataFrame(
        [("q", 2, ([(str(i),) for i in range(10, 14)],)), ("q", 1, ([("1",), ("2",)],)), ("q", 3, ([("9",)],)),
         ("r", 1, ([],)), ("r", 2, (None,)), (None, 1, ([("5",), ("6",)],))],
        "query string, page int, resultList struct<result:array<struct<pmid:string>>>")
    pages = pages.repartition(3)
    got = {(r["query"], r["raw"]["pmid"]) for r in search_results(pages, 4).collect()}
    assert got == {("q", "1"), ("q", "2"), ("q", "10"), ("q", "11"), (None, "5"), (None, "6")}
    assert search_results(pages).count() == 9
