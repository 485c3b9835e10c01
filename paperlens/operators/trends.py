"""Publication trends.

The year series is aggregated first (partial aggregation, one row per year);
the growth and cumulative windows then run on that tiny table only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperlens.functions.coerce import to_int_or_null
from paperlens.functions.rules import LabelRule, rule_column

# en dash between first and last year of the range (fixed output format)
RANGE_DASH = "–"


def _pct_change(cur, prev):
    """(current / previous - 1) * 100, the usual percent-change formula."""
    return (cur.cast("double") / prev.cast("double") - F.lit(1.0)) * F.lit(100.0)


def publications_per_year(df: DataFrame, year_col: str = "year",
                          drop_year_zero: bool = False) -> DataFrame:
    """``(year, count)`` for valid years, ascending (year 0 optional)."""
    y = to_int_or_null(year_col)
    x = df.select(y.alias("year")).where(F.col("year").isNotNull())
    if drop_year_zero:
        x = x.where(F.col("year") != 0)
    return x.groupBy("year").agg(F.count("*").alias("count")).orderBy("year")


def growth_rates(yearly: DataFrame) -> DataFrame:
    """Percent change against the previous *present* year; first year NULL."""
    w = Window.orderBy("year")  # yearly table: one row per year
    prev = F.lag("count").over(w)
    return yearly.select("year", "count", _pct_change(F.col("count"), prev).alias("growth_rate"))


def cumulative(yearly: DataFrame) -> DataFrame:
    """Running total of publications."""
    w = Window.orderBy("year").rowsBetween(Window.unboundedPreceding, 0)
    return yearly.select("year", "count", F.sum("count").over(w).alias("cumulative"))


def trend_table(df: DataFrame, year_col: str = "year") -> DataFrame:
    """A6 + W1 + W2 in one pass over the yearly table."""
    yearly = publications_per_year(df, year_col)
    w = Window.orderBy("year")
    prev = F.lag("count").over(w)
    return yearly.select(
        "year", "count",
        _pct_change(F.col("count"), prev).alias("growth_rate"),
        F.sum("count").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("cumulative"))


def trend_summary(df: DataFrame, year_col: str = "year") -> DataFrame:
    """One row - yearly / growth / cumulative maps, total, range, peak, averages.

    Growth values and averages are rounded to one decimal; the peak year is the
    earliest year with the highest count.
    """
    t = trend_table(df, year_col)
    g = F.col("growth_rate")
    return t.agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("year", "count"))))
        .alias("yearly_counts"),
        F.map_from_entries(F.array_sort(F.collect_list(
            F.when(g.isNotNull(), F.struct(F.col("year"), F.round(g, 1))))))
        .alias("growth_rates"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("year", "cumulative"))))
        .alias("cumulative"),
        F.sum("count").alias("total_publications"),
        F.concat(F.min("year").cast("string"), F.lit(RANGE_DASH), F.max("year").cast("string"))
        .alias("year_range"),
        F.min_by("year", F.struct((-F.col("count")).alias("c"), F.col("year"))).alias("peak_year"),
        F.max("count").alias("peak_count"),
        F.round(F.avg("count"), 1).alias("average_per_year"),
        F.round(F.avg(g), 1).alias("average_growth_rate"),
    )


def query_year_grid(df: DataFrame, rules: Sequence[LabelRule], years: Sequence[int],
                    text_col: str = "match_text", year_col: str = "year") -> DataFrame:
    """Hits per (rule, year) for every pair, 0 when none.

    One pass: each article yields its matching rule names (array of ``when``),
    exploded and counted; the (rules x years) frame is a small constant grid
    left-joined to the counts.
    """
    spark = df.sparkSession
    lt = F.lower(F.col(text_col))
    hits = F.filter(F.array(*[F.when(rule_column(r.rule, lt), F.lit(r.name)) for r in rules]),
                    lambda x: x.isNotNull())
    counted = (df.where(F.col(year_col).isin(list(years)))
               .select(F.col(year_col).cast("int").alias("year"), F.explode_outer(hits).alias("query"))
               .where(F.col("query").isNotNull())
               .groupBy("query", "year").agg(F.count("*").alias("n")))
    grid = spark.createDataFrame([(r.name, i, int(y)) for i, r in enumerate(rules) for y in years],
                                 "query string, rule_ord int, year int")
    return (grid.join(counted, ["query", "year"], "left")
            .select("query", "rule_ord", "year", F.coalesce("n", F.lit(0)).alias("n")))
