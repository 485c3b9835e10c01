"""Articles laid out for lookup by id.

One article per id, the first in a given order, in Parquet folders by a hash of the id. In
a folder rows lie in order of the id, in small row groups with a bloom filter of it. A
lookup reads the folders its ids fall in; of a few ids Spark also hands the values to the
Parquet reader, which leaves out row groups and pages by their ranges and bloom filters.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperlens.sources.publish import current, publish

#: articles of a folder, folders at most, bytes of a row group, ids its bloom filter is made for
FOLDER_ROWS, MOST_FOLDERS, GROUP_BYTES, GROUP_IDS = 1 << 20, 4096, 8 << 20, 1 << 14
#: ids up to which the reader gets the values; ids up to which they are broadcast
FEW, MANY = 10, 100_000
_FOLDER = "id_folder"


def _folder(key: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")


def write_id_index(articles: DataFrame, path: str, key: str, order_cols: Sequence[str],
                   folder_rows: int = FOLDER_ROWS) -> str:
    """The first article (by ``order_cols``) of each id in ``key``, as the new version of the
    table at ``path``. Null and empty ids have no entry; an empty table makes an empty index.
    Returns the version's folder."""
    spark = articles.sparkSession
    named = articles.where(F.col(key) != "")
    n_ids = named.agg(F.approx_count_distinct(key)).first()[0]
    n = min(MOST_FOLDERS, max(1, -(-n_ids // folder_rows)))
    # a partial aggregation: an id of very many articles is one row per task before the shuffle
    first = named.groupBy(F.col(key).alias("__id")).agg(
        F.min_by(F.struct(*[F.col(c) for c in articles.columns]),
                 F.struct(*[F.col(c) for c in order_cols])).alias("a")).select("a.*")
    laid = (first.withColumn(_FOLDER, _folder(F.col(key), n)).repartition(n, _FOLDER)
            .sortWithinPartitions(_FOLDER, key))

    def write(folder: str) -> None:
        (laid.write.partitionBy(_FOLDER).option("compression", "zstd").option("parquet.block.size", GROUP_BYTES)
         .option(f"parquet.bloom.filter.enabled#{key}", "true")
         .option(f"parquet.bloom.filter.expected.ndv#{key}", GROUP_IDS).parquet(f"{folder}/articles"))
        about = [(n, key, laid.schema.json())]
        spark.createDataFrame(about, "folders int, key string, kinds string").coalesce(1).write.json(f"{folder}/about")

    return publish(spark, path, write)


def read_id_index(spark: SparkSession, path: str) -> tuple[DataFrame, str, int]:
    """The articles of the current version with their folder, the id's column, the number of folders."""
    folder = current(spark, path)
    about = spark.read.schema("folders int, key string, kinds string").json(f"{folder}/about").first()
    kinds = T.StructType.fromJson(json.loads(about["kinds"]))
    return spark.read.schema(kinds).parquet(f"{folder}/articles"), about["key"], about["folders"]


def indexed(spark: SparkSession, path: str, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """The indexed articles of ``ids``, each once, from the folders the ids fall in."""
    index, key, n = read_id_index(spark, path)
    wanted = ids.select(F.col(id_col).alias("__id")).where("__id IS NOT NULL").distinct()
    few = wanted.limit(FEW + 1).collect()
    if len(few) <= FEW:
        wanted = spark.createDataFrame(few, "__id string")
        index = index.where(F.col(key).isin([r["__id"] for r in few]))
    # at most MOST_FOLDERS numbers
    folders = [r[0] for r in wanted.select(_folder(F.col("__id"), n)).distinct().collect()]
    index = index.where(F.col(_FOLDER).isin(folders)) if len(folders) < n else index
    if len(few) <= FEW:
        return index.drop(_FOLDER)
    if wanted.limit(MANY + 1).count() <= MANY:
        wanted = F.broadcast(wanted)
    return index.join(wanted, F.col(key) == F.col("__id"), "left_semi").drop(_FOLDER)


def lookup_indexed(spark: SparkSession, path: str, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """S3 by the index: a row per requested id with its article, nulls where there is none."""
    found, key = indexed(spark, path, ids, id_col), read_id_index(spark, path)[1]
    asked = ids.select(F.col(id_col).alias("requested_id"))
    return asked.join(found, F.col("requested_id") == found[key], "left").select("requested_id", *[found[c] for c in found.columns])
