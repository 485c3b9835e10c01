"""File sinks and sources.

Parquet inside the pipeline, CSV / JSON only at the edges. Paths are whatever
the caller passes (a shared filesystem or object store on a cluster).
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperlens.functions.text import py_list_repr
from paperlens.sources.publish import current, publish

log = logging.getLogger(__name__)

SPLITS = ("train", "val", "test")

# One dialect for writing and reading: quotes are doubled, blanks at the ends of a
# value and line breaks in it are kept, '' is written quoted and NULL as nothing.
_CSV = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False,
        "ignoreTrailingWhiteSpace": False}
CSV_WRITE = {**_CSV, "emptyValue": '""', "nullValue": ""}
CSV_READ = {**_CSV, "multiLine": True, "emptyValue": "", "nullValue": "\u0000"}


def to_csv_ready(df: DataFrame) -> DataFrame:
    """Arrays rendered like Python lists (``['a', 'b']``), structs / maps as JSON."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StringType):
            cols.append(py_list_repr(c).alias(f.name))
        elif isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)):
            cols.append(F.to_json(c).alias(f.name))
        else:
            cols.append(c)
    return df.select(*cols)


def write_articles_csv(df: DataFrame, path: str) -> None:
    """CSV with a header, no index column; replaces what was there, whole or not at all."""
    publish(df.sparkSession, path, lambda to: to_csv_ready(df).write.options(**CSV_WRITE).csv(to))


def read_articles_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None
                      ) -> DataFrame:
    r = spark.read.options(**CSV_READ)
    return (r.schema(schema) if schema is not None else r.option("inferSchema", False)).csv(current(spark, path))


def save_splits(splits: DataFrame, path: str, fmt: str = "parquet", label_col: str = "label",
                stats_path: str | None = None) -> DataFrame:
    """One directory per split (``split=train`` ...) plus the split stats as JSON; replaces
    what was there, whole or not at all."""
    from paperlens.operators.curate import split_stats

    def write(to: str) -> None:
        if fmt == "csv":
            to_csv_ready(splits).write.partitionBy("split").options(**CSV_WRITE).csv(to)
        else:
            splits.write.partitionBy("split").format(fmt).save(to)

    publish(splits.sparkSession, path, write)
    stats = split_stats(spark_read(splits.sparkSession, path, fmt), label_col)
    stats.coalesce(1).write.mode("overwrite").json(stats_path or path.rstrip("/") + "_stats")
    return stats


def spark_read(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    path = current(spark, path)
    if fmt == "csv":
        return spark.read.options(**CSV_READ).csv(path)
    return spark.read.format(fmt).load(path)


def load_splits(spark: SparkSession, path: str, fmt: str = "parquet",
                names: Sequence[str] = SPLITS) -> DataFrame:
    """The split folders under ``path`` (partition discovery on ``split``).

    A split that was never written simply has no rows (and is logged); the
    filter on the partition column prunes folders instead of reading them.
    """
    df = spark_read(spark, path, fmt).where(F.col("split").isin(list(names)))
    for n in names:
        folder = f"{current(spark, path)}/split={n}"
        if if_present(lambda: spark.read.text(folder)) is None:
            log.warning("Split not found: %s", folder)
    return df


def if_present(read: Callable[[], DataFrame]) -> DataFrame | None:
    """``read()``, or None where its path does not exist (Spark looks, so any file system does)."""
    try:
        return read()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def load_model_results(spark: SparkSession, baseline_path: str | None,
                       transformer_path: str | None) -> DataFrame:
    """Both optional report files -> long ``(ord, model, type, split, metrics...)``."""
    metric = T.StructType([T.StructField(m, T.DoubleType()) for m in
                           ("accuracy", "precision", "recall", "f1", "auc_roc", "loss")])
    frames = []
    raw = if_present(lambda: spark.read.text(baseline_path, wholetext=True)) if baseline_path else None
    if raw is not None:
        parsed = raw.select(F.from_json("value", T.MapType(T.StringType(), T.StructType([
            T.StructField("val", metric), T.StructField("test", metric)]))).alias("m"))
        frames.append(parsed.select(F.posexplode("m").alias("ord", "model", "r")).select(
            "ord", F.concat(F.lit("TF-IDF + "), "model").alias("model"),
            F.lit("baseline").alias("type"), "r.test.*"))
    fields = T.StructType([T.StructField("model", T.StringType()), T.StructField("test_results", metric)])
    tr = if_present(lambda: spark.read.option("multiLine", True).schema(fields).json(transformer_path)) \
        if transformer_path else None
    if tr is not None:
        frames.append(tr.select(F.lit(1000).alias("ord"),
                                F.element_at(F.split(F.coalesce("model", F.lit("SciBERT")), "/"), -1)
                                .alias("model"),
                                F.lit("transformer").alias("type"), "test_results.*"))
    if not frames:
        return spark.createDataFrame([], "ord int, model string, type string, accuracy double, "
                                         "precision double, recall double, f1 double, "
                                         "auc_roc double, loss double")
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def load_history(spark: SparkSession, transformer_path: str) -> DataFrame:
    """Training history of a transformer report as a DataFrame (for M15)."""
    hist = T.StructType([T.StructField(c, T.DoubleType()) for c in
                         ("train_loss", "train_accuracy", "val_loss", "val_accuracy", "val_f1",
                          "val_precision", "val_recall", "val_auc_roc", "lr")]
                        + [T.StructField("epoch", T.LongType())])
    tr = spark.read.option("multiLine", True).schema(T.StructType([
        T.StructField("training_history", T.ArrayType(hist))])).json(transformer_path)
    return tr.select(F.explode("training_history").alias("h")).select("h.*")


def write_report(report: DataFrame, path: str) -> None:
    """A one-row nested report as a single JSON document."""
    report.coalesce(1).write.mode("overwrite").json(path)
