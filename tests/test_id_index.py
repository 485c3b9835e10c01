"""Lookup by id reads the folders and row groups that may hold the ids."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from paperlens.sources.id_index import indexed, lookup_indexed, write_id_index
from paperlens.sources.publish import current


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index") / "articles")
    a = spark.range(40_000).select(
        F.md5(F.col("id").cast("string")).alias("doi"), F.col("id").alias("seq"),
        F.repeat(F.sha2(F.col("id").cast("string"), 256), 4).alias("title"))
    again = a.where("seq < 100").withColumn("seq", F.col("seq") + 100_000)  # later ones of the same ids
    odd = spark.createDataFrame([("", 1, "none"), (None, 2, "none")], "doi string, seq long, title string")
    write_id_index(a.unionByName(again).unionByName(odd), path, "doi", ["seq"], folder_rows=5_000)
    return path


def _ids(spark, *numbers):
    import hashlib
    return spark.createDataFrame([(hashlib.md5(str(n).encode()).hexdigest(),) for n in numbers], "id string")


def _scanned(df) -> tuple[int, int]:
    """Files and rows that the scan read."""
    df.collect()
    metrics = df._jdf.queryExecution().executedPlan().collectLeaves().head().metrics()
    return metrics.apply("numFiles").value(), metrics.apply("numOutputRows").value()


def test_first_article_of_each_id_and_nulls(spark, index):
    ids = _ids(spark, 5, 5, 39_999, 50_000).unionByName(spark.createDataFrame([(None,), ("",)], "id string"))
    got = sorted((r["requested_id"] is not None, r["seq"]) if r["seq"] is not None else (False, -1)
                 for r in lookup_indexed(spark, index, ids).collect())
    assert got == [(False, -1)] * 3 + [(True, 5), (True, 5), (True, 39_999)]
    many = _ids(spark, *range(0, 60_000, 50))
    rows = lookup_indexed(spark, index, many).collect()
    assert len(rows) == 1200 and sorted(r["seq"] for r in rows if r["seq"] is not None) == list(range(0, 40_000, 50))


def test_few_ids_read_a_part(spark, index):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        all_files, all_rows = _scanned(spark.read.parquet(f"{current(spark, index)}/articles"))
        assert all_files >= 6 and all_rows == 40_000
        files, rows = _scanned(indexed(spark, index, _ids(spark, 123)))
        assert files == 1 and 0 < rows < 40_000 / all_files  # not even its folder whole
        files, rows = _scanned(indexed(spark, index, _ids(spark, 70_001)))
        assert files == 1 and rows == 0  # an unknown id: by the bloom filter
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_empty_index_and_no_ids(spark, index, tmp_path):
    none = spark.createDataFrame([], "doi string, seq long")
    path = str(tmp_path / "none")
    write_id_index(none, path, "doi", ["seq"])
    assert [tuple(r) for r in lookup_indexed(spark, path, _ids(spark, 1)).select("seq").collect()] == [(None,)]
    assert lookup_indexed(spark, index, _ids(spark, 1).where("false")).count() == 0
