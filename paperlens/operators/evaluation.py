"""Classifier evaluation as aggregations.

Input: scored rows ``(label, prediction, p1)``. Everything is a partial
aggregation except the exact AUC, which needs the negatives ranked below each
score; that rank is taken in two levels (score-range buckets, then within a
bucket) so no single task sees all distinct scores.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# --- fixed values: metric names in report order ---
METRICS = ["accuracy", "precision", "recall", "f1", "auc_roc"]


def _div0(num: Column, den: Column) -> Column:
    """num / den, 0.0 when den is 0 (undefined metric counts as 0)."""
    return F.when(den == 0, F.lit(0.0)).otherwise(num.cast("double") / den.cast("double"))


def confusion_counts(scored: DataFrame, label_col: str = "label",
                     pred_col: str = "prediction", by: Sequence[str] = ()) -> DataFrame:
    """M7 counts: tn, fp, fn, tp (rows true class, columns predicted)."""
    y, p = F.col(label_col), F.col(pred_col)
    return scored.groupBy(*by).agg(
        F.count_if((y == 0) & (p == 0)).alias("tn"), F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"), F.count_if((y == 1) & (p == 1)).alias("tp"))


def metric_columns() -> list[Column]:
    """accuracy / precision / recall / f1 from tn, fp, fn, tp columns."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return [
        _div0(tp + tn, tp + tn + fp + fn).alias("accuracy"),
        _div0(tp, tp + fp).alias("precision"),
        _div0(tp, tp + fn).alias("recall"),
        _div0(2 * tp, 2 * tp + fp + fn).alias("f1"),
    ]


def confusion_matrix(counts: DataFrame) -> Column:
    return F.array(F.array("tn", "fp"), F.array("fn", "tp"))


def roc_auc(scored: DataFrame, label_col: str = "label", score_col: str = "p1",
            by: Sequence[str] = (), buckets: int | None = None) -> DataFrame:
    """M9: exact ROC AUC (ties count one half), NULL when a class is missing.

    AUC = sum over distinct scores of pos * (neg below + neg tied / 2) / (P * N).
    "neg below" is taken in two levels. The bucket of a score is the number of
    cut points at or below it; the cut points are approximate percentiles of the
    distinct scores, fetched once as one small array of literals, so that every
    reader sees the same cuts whatever the partitioning. Only balance
    depends on them: running offsets come from a table with one row per bucket,
    and the within-bucket running sum is a window over one bucket.
    """
    per = _per_score(scored, label_col, None, score_col, by)
    return _ranked(per, by, scored.sparkSession, buckets).select(*by, "auc_roc")


def _per_score(scored: DataFrame, label_col: str, pred_col: str | None, score_col: str,
               by: Sequence[str]) -> DataFrame:
    """One row per distinct score: positives, negatives and, with predictions, the four counts."""
    y = F.col(label_col)
    counts = [F.count_if(y == 1).alias("pos"), F.count_if(y == 0).alias("neg")]
    if pred_col:
        p = F.col(pred_col)
        counts += [F.count_if((y == t) & (p == q)).alias(n) for n, t, q in
                   (("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0), ("tp", 1, 1))]
    return scored.groupBy(*by, F.col(score_col).cast("double").alias("s")).agg(*counts)


def _ranked(per: DataFrame, by: Sequence[str], spark, buckets: int | None) -> DataFrame:
    """AUC, and the sums of the four counts where ``per`` has them."""
    pc = list(by)
    nb = buckets or max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = per.agg(F.percentile_approx("s", [i / nb for i in range(1, nb)], 10 * nb)
                   .alias("c")).first()["c"] or []
    cuts = sorted(set(cuts))  # at most nb - 1 numbers
    bucket = F.size(F.filter(F.lit(cuts), lambda c: c <= F.col("s"))) if cuts else F.lit(0)
    per = per.withColumn("b", bucket)
    per_b = per.groupBy(*pc, "b").agg(F.sum("neg").alias("bneg"))
    w_b = Window.partitionBy(*pc).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    offs = per_b.select(*pc, "b", F.coalesce(F.sum("bneg").over(w_b), F.lit(0)).alias("off"))
    w_in = Window.partitionBy(*pc, "b").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("below", F.coalesce(F.sum("neg").over(w_in), F.lit(0)))
    per = per.join(offs, [*pc, "b"], "inner")
    u = F.col("pos").cast("double") * (F.col("off") + F.col("below") + F.col("neg") / 2.0)
    counts = [c for c in ("tn", "fp", "fn", "tp") if c in per.columns]
    agg = per.groupBy(*pc).agg(F.sum(u).alias("u"), F.sum("pos").alias("P"), F.sum("neg").alias("N"),
                               *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counts])
    return agg.select(*pc, (F.col("u") / F.nullif(F.col("P") * F.col("N"), F.lit(0))).alias("auc_roc"), *counts)


def evaluate(scored: DataFrame, label_col: str = "label", pred_col: str = "prediction",
             score_col: str = "p1", by: Sequence[str] = ()) -> DataFrame:
    """M6: accuracy, precision, recall, f1, auc_roc, confusion matrix per group, all from
    one aggregation of the rows by score."""
    per = _per_score(scored, label_col, pred_col, score_col, by)
    out = _ranked(per, by, scored.sparkSession, None)
    return out.select(*by, *metric_columns(), "auc_roc",
                      F.array(F.array("tn", "fp"), F.array("fn", "tp")).alias("confusion_matrix"),
                      "tn", "fp", "fn", "tp")


def classification_report(scored: DataFrame, label_col: str = "label",
                          pred_col: str = "prediction", by: Sequence[str] = ()) -> DataFrame:
    """M8: per class precision / recall / f1 / support, accuracy, macro and
    weighted averages, in long form ``(class, precision, recall, f1_score, support)``."""
    pc = list(by)
    cc = confusion_counts(scored, label_col, pred_col, pc)
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    n = tn + fp + fn + tp
    p1, r1, f1_ = _div0(tp, tp + fp), _div0(tp, tp + fn), _div0(2 * tp, 2 * tp + fp + fn)
    p0, r0, f0 = _div0(tn, tn + fn), _div0(tn, tn + fp), _div0(2 * tn, 2 * tn + fn + fp)
    s0, s1 = tn + fp, fn + tp
    acc = _div0(tp + tn, n)

    def row(name, p, r, f, s):
        return F.struct(F.lit(name).alias("class"), p.alias("precision"), r.alias("recall"),
                        f.alias("f1_score"), s.cast("long").alias("support"))

    rows = F.array(
        row("0", p0, r0, f0, s0),
        row("1", p1, r1, f1_, s1),
        row("accuracy", F.lit(None).cast("double"), F.lit(None).cast("double"), acc, n),
        row("macro avg", (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1_) / 2, n),
        row("weighted avg", _div0(p0 * s0 + p1 * s1, n), _div0(r0 * s0 + r1 * s1, n),
            _div0(f0 * s0 + f1_ * s1, n), n),
    )
    return cc.select(*pc, F.explode(rows).alias("r")).select(*pc, "r.*")


def mean_log_loss(scored: DataFrame, label_col: str = "label", score_col: str = "p1",
                  by: Sequence[str] = (), eps: float = 1e-15) -> DataFrame:
    """Mean cross-entropy per row, ``-ln p(true class)`` (clipped at eps)."""
    p_true = F.when(F.col(label_col) == 1, F.col(score_col)).otherwise(1 - F.col(score_col))
    return scored.groupBy(*by).agg(
        F.avg(-F.log(F.greatest(p_true, F.lit(eps)))).alias("loss"))


def best_epoch(history: DataFrame, metric: str = "val_f1", epoch_col: str = "epoch") -> DataFrame:
    """The epoch with the highest metric (strictly above 0), earliest on ties."""
    h = history.where(F.col(metric) > 0)
    return h.agg(F.min_by(F.struct(*[F.col(c) for c in history.columns]),
                          F.struct((-F.col(metric)).alias("m"), F.col(epoch_col).alias("e")))
                  .alias("best")).select("best.*")


def comparison_table(results: DataFrame) -> DataFrame:
    """Per model test metrics (missing -> 0) in input order.

    ``results``: ``(ord, model, type, accuracy, precision, recall, f1, auc_roc)``.
    """
    return results.select("ord", "model", "type",
                          *[F.coalesce(F.col(m).cast("double"), F.lit(0.0)).alias(m)
                            for m in METRICS])


def best_model(table: DataFrame) -> DataFrame:
    """Highest F1, first row on ties."""
    return table.orderBy(F.col("f1").desc(), F.col("ord")).limit(1)


def is_best() -> Column:
    """O5 as a column of a comparison table, which has one row per model."""
    return F.row_number().over(Window.orderBy(F.col("f1").desc(), F.col("ord"))) == 1


def metrics_long(table: DataFrame) -> DataFrame:
    """V4: model x metric long table in fixed metric order."""
    return table.select("model", F.posexplode(F.array(*[F.struct(F.lit(m).alias("metric"),
                                                                 F.col(m).alias("value"))
                                                        for m in METRICS])).alias("metric_ord", "mv")
                        ).select("model", "metric_ord", "mv.metric", "mv.value")


def confusion_cells(evaluated: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """V5: ``(true_label, predicted_label, n)`` cells of the confusion matrix."""
    return (evaluated.select(*by, F.posexplode("confusion_matrix").alias("true_label", "row"))
            .select(*by, "true_label", F.posexplode("row").alias("predicted_label", "n")))
