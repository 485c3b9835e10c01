"""AUC over more distinct scores than a range sample holds, and import hygiene."""

from __future__ import annotations

import os
import subprocess
import sys

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from paperlens.operators.evaluation import roc_auc


@pytest.mark.parametrize("parts", [1, 4, 13])
def test_auc_equals_plain_window_on_many_scores(spark, parts):
    df = spark.range(120_000).select(
        F.rand(7).alias("p1"), (F.rand(8) < 0.4).cast("int").alias("label")).persist()
    df.count()
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = roc_auc(df, "label", "p1").first()[0]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    w = Window.orderBy("p1").rowsBetween(Window.unboundedPreceding, -1)
    below = F.coalesce(F.sum(1 - F.col("label")).over(w), F.lit(0))
    want = (df.withColumn("below", below)
            .agg(F.sum(F.col("label") * F.col("below"))
                 / (F.sum("label") * F.sum(1 - F.col("label")))).first()[0])
    df.unpersist()
    assert got == pytest.approx(want, abs=1e-9)


def test_catalogue_loads_from_another_folder_without_jars(tmp_path):
    """queries() and oracle_sql() need no JVM, no Spark jars and no working directory."""
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = (f"import sys; sys.path.insert(0, {repo!r}); import glob; glob.glob = None; "
            "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); "
            "assert len(o) >= 44 and set(o) <= set(q), (len(q), len(o))")
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)


def test_stop_words_are_spark_mls(spark):
    from pyspark.ml.feature import StopWordsRemover

    from paperlens.functions.text import english_stop_words
    assert list(english_stop_words()) == StopWordsRemover.loadDefaultStopWords("english")
