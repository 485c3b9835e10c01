"""Annotation and field-inventory operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def annotation_type_counts(records: DataFrame, id_col: str = "extId",
                           ann_col: str = "annotations", prefix_len: int = 30) -> DataFrame:
    """A9 on nested records: per (article, type) - count and the first example.

    ``records`` carries one row per article with an array of annotations
    (``type``, ``exact``, ``prefix``); the first example is the earliest in
    array order.
    """
    flat = records.select(F.col(id_col).alias("ext_id"),
                          F.posexplode_outer(ann_col).alias("pos", "a"))
    flat = flat.select("ext_id", "pos", F.coalesce(F.col("a.type"), F.lit("unknown")).alias("type"),
                       F.col("a.exact").alias("exact"), F.col("a.prefix").alias("prefix"))
    return annotation_type_counts_long(flat.where(F.col("pos").isNotNull()), "ext_id", "pos")


def annotation_type_counts_long(flat: DataFrame, id_col: str = "ext_id",
                                order_col: str = "pos", prefix_len: int = 30) -> DataFrame:
    """A9 on long rows ``(id, order, type, exact, prefix)``, in no order (sort at the sink)."""
    first = F.min_by(F.struct(F.coalesce(F.col("exact"), F.lit("N/A")).alias("exact"),
                              F.substring(F.coalesce(F.col("prefix"), F.lit("")), 1, prefix_len)
                              .alias("prefix")), F.col(order_col))
    return (flat.groupBy(F.col(id_col).alias("ext_id"), "type")
            .agg(F.count("*").alias("n"), first.alias("f"))
            .select("ext_id", "type", "n", F.col("f.exact").alias("example_exact"),
                    F.col("f.prefix").alias("example_prefix")))


def field_inventory(df: DataFrame, order_col: str | None = None, preview_len: int = 80) -> DataFrame:
    """A10 at scale: per column - type, non-null count and a preview of the
    first non-null value (by ``order_col`` when given), sorted by name.

    One aggregation over the table; nested values print as ``(type)``.
    """
    from pyspark.sql import types as T
    aggs = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        nested = isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType))
        preview = (F.when(c.isNotNull(), F.lit(f"({f.dataType.simpleString().split('<')[0]})"))
                   if nested else F.substring(c.cast("string"), 1, preview_len))
        pick = (F.min_by(preview, F.when(c.isNotNull(), F.col(order_col))) if order_col
                else F.min(preview))
        aggs.append(F.struct(F.lit(f.name).alias("key"),
                             F.lit(f.dataType.simpleString()).alias("type"),
                             F.count(c).alias("non_null"), pick.alias("preview")))
    one = df.agg(F.array(*aggs).alias("fields"))
    return one.select(F.explode("fields").alias("f")).select("f.*").orderBy("key")
