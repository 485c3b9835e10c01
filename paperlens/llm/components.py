"""Connected components of a distributed edge table (large star, small star)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperlens.llm.common import written


def components(edges: DataFrame, u: str, v: str) -> DataFrame:
    """(node, root) for every node of ``edges`` (two long or binary columns, any direction): root is
    the smallest node reachable. Each round is two joins of the edges with a minimum a
    node; rounds grow with the logarithm of the longest path. Loops and repeated edges
    do no harm; a null end drops the edge; no edges give an empty table."""
    e = edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v"),
                     (F.col(u).isNull() | F.col(v).isNull()).alias("no"))
    e = written(e.where("not no and u != v").select("u", "v").distinct(), "edges")
    before = None
    while True:
        seen = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()  # two numbers
        if seen == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                e.select("v", "v")).distinct()
        before = seen
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (both.join(low, "u").where("v > u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(low.select("u", "m")))
        e = written(small.distinct(), "edges")
