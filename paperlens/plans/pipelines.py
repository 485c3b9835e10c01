"""End-to-end jobs: collect (D6), train (M12), analyse.

Each job is a composition of the operators; only small results (metrics,
keyword lists, one report row) are written as JSON, everything else stays a
DataFrame on the cluster.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperlens.functions.rules import LabelRule
from paperlens.operators.curate import collection_pipeline, create_splits, split_stats
from paperlens.operators.impact import all_impact_metrics, class_counts_summary
from paperlens.operators.keywords import tfidf_keywords
from paperlens.operators.topk import top_k
from paperlens.operators.preprocess import collect_labelled, date_window, drop_empty, preprocess
from paperlens.operators.trends import trend_summary
from paperlens.sources.landed import articles_from_pages


def collect_from_landed(pages: DataFrame, query_labels: Mapping[str, int],
                        max_per_query: int | None = None, min_year: int | None = None,
                        max_year: int | None = None, balance: bool = True,
                        seed: int = 42) -> DataFrame:
    """D6 over landed search pages whose ``query`` field names the query that
    produced them: date window, cap per query, empty filter, label, dedup per
    class, exact balance. The window is part of what a query asks for, so only
    rows inside it count towards the cap. Of copies the first by configured query
    order, page and place stays; ``seq`` is that order, ``doc_id`` the dedup key."""
    arts = articles_from_pages(pages, None)
    if min_year is not None and max_year is not None:
        arts = date_window(arts, min_year, max_year)
    if max_per_query is not None:
        arts = top_k(arts, ["query"], [F.col("page"), F.col("pos")], max_per_query, ["page", "pos"]).drop("rank")
    rows = [(q, label, i) for i, (q, label) in enumerate(query_labels.items())]
    labels = pages.sparkSession.createDataFrame(rows, "query string, label int, rule_ord int")
    # one row per configured query: a small constant table
    arts = drop_empty(arts).join(F.broadcast(labels), "query", "inner")
    arts = arts.withColumn("seq", F.struct("rule_ord", "page", "pos"))
    return collection_pipeline(arts, balance, seed, "label", "seq").withColumn("doc_id", F.col("uid"))


def collect_by_rules(articles: DataFrame, rules: Sequence[LabelRule], max_per_rule: int | None = None,
                     min_year: int | None = None, max_year: int | None = None,
                     balance: bool = True, seed: int = 42, order_col: str = "seq") -> DataFrame:
    """D6 over an article table labelled by phrase rules (P4-P9). Of copies within a class
    the first by rule, as configured, and ``order_col`` stays."""
    hits = collect_labelled(articles, rules, min_year, max_year, max_per_rule, order_col)
    hits = hits.withColumn("__order", F.struct("rule_ord", order_col))
    return collection_pipeline(hits, balance, seed, "label", "__order").drop("__order")


def prepare_splits(articles: DataFrame, seed: int = 42, train: float = 0.7, val: float = 0.15,
                   test: float = 0.15, id_cols: Sequence[str] = ("uid",)) -> DataFrame:
    """P3 + D4: preprocessed articles with a ``split`` column."""
    return create_splits(preprocess(articles), train, val, test, seed, True, "label", id_cols)


def train_job(splits: DataFrame, models: Sequence[str] = ("logistic_regression", "svm", "random_forest"),
              out_dir: str | None = None, top_n: int = 15, id_col: str = "doc_id") -> DataFrame:
    """Every model fitted on train, evaluated on val and test; models, results,
    reports by class and top features (rounded to 4) written when ``out_dir`` is given."""
    from paperlens.operators.classifiers import train_and_evaluate
    metrics, features = train_and_evaluate(splits, models, "text", "label", id_col, top_n, out_dir=out_dir)
    if out_dir:
        metrics.coalesce(1).write.mode("overwrite").json(f"{out_dir}/metrics")
        for name, f in features.items():
            f.coalesce(1).write.mode("overwrite").json(f"{out_dir}/top_features/{name}")
    return metrics


def analysis_report(splits: DataFrame, comparison: DataFrame | None = None,
                    n_keywords: int = 30, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One nested row - dataset sizes, model comparison, impact metrics of
    the positives, trend summary, top keywords of each class (rounded to 4)."""
    full = splits  # D7: the union of the splits is one table already
    sizes = class_counts_summary(full).select(F.struct("*").alias("dataset"))
    sizes = sizes.crossJoin(split_stats(full).agg(
        F.map_from_entries(F.collect_list(F.struct("split", "size"))).alias("splits")))
    impact = all_impact_metrics(full, positive=True).select(F.struct("*").alias("impact_metrics"))
    trend = trend_summary(full.where(F.col("label") == 1)).select(F.struct("*").alias("trend_summary"))
    kw = tfidf_keywords(full.select(id_col, "label", text_col), text_col, id_col, n_keywords,
                        partition_cols=["label"])
    kws = kw.groupBy().agg(*[
        F.transform(F.array_sort(F.collect_list(F.when(F.col("label") == lab, F.struct(
            "rank", "term", F.round("score", 4).alias("score"))))), lambda s: F.struct(s["term"], s["score"]))
        .alias(name) for lab, name in ((1, "top_keywords_positive"), (0, "top_keywords_negative"))])
    out = sizes.crossJoin(impact).crossJoin(trend).crossJoin(kws)
    if comparison is not None:
        out = out.crossJoin(comparison.agg(F.collect_list(F.struct("*")).alias("model_comparison")))
    return out
