"""Exact order statistics without a task that sees all distinct values.

A double's bits, taken so that their order is that of the numbers, are counted 16 at a
time: a histogram of at most 2**16 cells tells in which cell a rank lies, and the next
round counts only that cell's values by the next 16 bits. Four rounds single out one
number, whatever the values are. Every round is a partial aggregation over a table of
(value, count), itself a distributed aggregation; the driver gets one cell a round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BITS = 16


def ordered_bits(value: Column) -> Column:
    """A long whose unsigned order is the order of the doubles (-0.0 counts as 0.0)."""
    b = F.java_method(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), value + F.lit(0.0)).cast("long")
    return F.when(b < 0, F.bitwise_not(b)).otherwise(b.bitwiseXOR(F.lit(-(1 << 63))))


def value_counts(values: DataFrame, value: str = "value") -> DataFrame:
    """(value, n) of the non-null values, written once: all rounds read it."""
    from paperlens.session import cut_lineage
    v = F.col(value).cast("double")
    return cut_lineage(values.select(v.alias("value")).where(F.col("value").isNotNull())
                       .groupBy("value").agg(F.count("*").alias("n")))


def nth_value(counts: DataFrame, rank: int) -> float:
    """The value at a rank (from 0, below the sum of n) of ``counts`` (value, n)."""
    rows = counts.select(ordered_bits(F.col("value")).alias("bits"), "n", "value")
    for shift in range(64 - BITS, -1, -BITS):
        cell = F.shiftrightunsigned("bits", shift).bitwiseAND(F.lit((1 << BITS) - 1))
        hist = rows.groupBy(cell.alias("cell")).agg(F.sum("n").alias("n"), F.max("value").alias("value"))
        # at most 2**BITS cells meet in this window
        upto = hist.withColumn("upto", F.sum("n").over(Window.orderBy("cell")))
        found = upto.where(F.col("upto") > rank).orderBy("cell").first()
        rows, rank = rows.where(cell == found["cell"]), rank - found["upto"] + found["n"]
    return found["value"]


def exact_median(counts: DataFrame) -> float | None:
    """Mean of the two middle values (the middle one, if their number is odd); None without values."""
    n = counts.agg(F.sum("n")).first()[0]
    if not n:
        return None
    low = nth_value(counts, (n - 1) // 2)
    return low if n % 2 else (low + nth_value(counts, n // 2)) / 2
