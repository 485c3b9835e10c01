"""Impact metrics.

Every metric is one aggregation with partial (map-side) combine; the grouped
results are tiny (one row, or one row per journal / year).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperlens.functions.coerce import strip_ws, to_bool_flag, to_int_or_null
from paperlens.operators.selection import exact_median, value_counts
from paperlens.operators.topk import top_k
from paperlens.session import cut_lineage


def positive_only(df: DataFrame, enabled: bool = True, label_col: str = "label") -> DataFrame:
    """``label == 1`` when asked and the column exists, else all rows."""
    if enabled and label_col in df.columns:
        return df.where(F.col(label_col) == 1)
    return df


def _citations(col: str = "cited_by_count") -> Column:
    c = F.col(col).cast("string").try_cast("double")
    return F.coalesce(F.when(~F.isnan(c), c), F.lit(0.0))


def citation_metrics(df: DataFrame, col: str = "cited_by_count") -> DataFrame:
    """A1: sum, mean, exact median, max, min, sample std, cited / uncited / >=10 / >=50.

    The median is selected by histograms (``selection``); all else is one aggregation."""
    c = _citations(col)
    x = df.select(c.alias("c"))
    median = exact_median(value_counts(x, "c"))
    return x.agg(
        F.coalesce(F.sum("c"), F.lit(0.0)).cast("long").alias("total_citations"),
        F.avg("c").alias("mean_citations"),
        F.lit(median).cast("double").alias("median_citations"),
        F.max("c").cast("long").alias("max_citations"),
        F.min("c").cast("long").alias("min_citations"),
        F.stddev_samp("c").alias("std_citations"),
        F.count_if(F.col("c") > 0).alias("articles_with_citations"),
        F.count_if(F.col("c") == 0).alias("articles_without_citations"),
        F.count_if(F.col("c") >= 10).alias("highly_cited_10plus"),
        F.count_if(F.col("c") >= 50).alias("highly_cited_50plus"),
    )


def journal_counts(df: DataFrame, col: str = "journal", order_col: str = "seq") -> DataFrame:
    """Per journal: count and first-seen position (trimmed; '', 'nan', NULL dropped)."""
    j = strip_ws(F.col(col).cast("string"))
    x = df.select(j.alias("journal"), F.col(order_col).alias("seq"))
    x = x.where(F.col("journal").isNotNull() & (F.col("journal") != "") & (F.col("journal") != "nan"))
    return x.groupBy("journal").agg(F.count("*").alias("count"), F.min("seq").alias("first_seen"))


def journal_spread(df: DataFrame, top_n: int = 15, col: str = "journal",
                   order_col: str = "seq") -> DataFrame:
    """A2: top-n journals (count desc, first-seen on ties) with percent of all
    articles that have a journal, plus the distinct-journal and article totals."""
    per = journal_counts(df, col, order_col)
    totals = per.agg(F.count("*").alias("total_journals"),
                     F.coalesce(F.sum("count"), F.lit(0)).cast("long")
                     .alias("total_articles_with_journal"))
    top = per.orderBy(F.col("count").desc(), F.col("first_seen")).limit(top_n)
    # top holds at most top_n rows: a global window over it is cheap
    top = top.withColumn("rank", F.row_number().over(
        Window.orderBy(F.col("count").desc(), F.col("first_seen"))))
    return (top.crossJoin(F.broadcast(totals))  # totals: one row
            .select("rank", "journal", "count",
                    F.round(F.col("count") / F.greatest(F.col("total_articles_with_journal"),
                                                        F.lit(1)) * 100, 1).alias("percentage"),
                    "total_journals", "total_articles_with_journal"))


def open_access(df: DataFrame, col: str = "is_open_access") -> DataFrame:
    """A3: total, open, closed, open rate in percent (1 decimal; 0 when empty)."""
    flag = to_bool_flag(col)
    x = df.select(flag.alias("oa"))
    agg = x.agg(F.count("*").alias("total_articles"),
                F.count_if(F.col("oa")).alias("open_access_count"))
    return agg.select(
        "total_articles", "open_access_count",
        (F.col("total_articles") - F.col("open_access_count")).alias("closed_access_count"),
        F.round(F.col("open_access_count") / F.greatest(F.col("total_articles"), F.lit(1)) * 100, 1)
        .alias("open_access_rate"))


def yearly_stats(df: DataFrame, year_col: str = "year", col: str = "cited_by_count",
                 drop_year_zero: bool = False) -> DataFrame:
    """A4: per valid year - count, mean and total citations; ascending.

    Preprocessing turns unreadable years into 0; ``drop_year_zero`` leaves that
    group out."""
    y = to_int_or_null(year_col)
    x = df.select(y.alias("year"), _citations(col).alias("c")).where(F.col("year").isNotNull())
    if drop_year_zero:
        x = x.where(F.col("year") != 0)
    return (x.groupBy("year")
            .agg(F.count("*").alias("count"), F.avg("c").alias("mean_citations"),
                 F.sum("c").cast("long").alias("total_citations"))
            .orderBy("year"))


def class_counts_summary(df: DataFrame, label_col: str = "label") -> DataFrame:
    """Total, positive, negative."""
    return df.agg(F.count("*").alias("total"),
                  F.count_if(F.col(label_col) == 1).alias("positive"),
                  F.count_if(F.col(label_col) == 0).alias("negative"))


def all_impact_metrics(df: DataFrame, positive: bool = True, top_n: int = 15) -> DataFrame:
    """A5: one row with dataset size and nested A1-A4 results, from one pass over ``df``.

    Journals, years, access, citation counts and the whole are grouping sets of one
    partial aggregation; what is left is a row per distinct journal, year or count,
    of which the journals are ranked by one window and the rest folded into one row.
    """
    x = positive_only(df, positive)
    j = strip_ws(F.col("journal").cast("string"))
    base = x.select(F.when((j != "") & (j != "nan"), j).alias("journal"), to_int_or_null("year").alias("year"),
                    to_bool_flag("is_open_access").alias("open"), _citations().alias("c"), "seq")
    c = F.col("c")
    sets = base.withColumn("times", c).groupingSets(
        [["journal"], ["year"], ["open"], ["times"], []], "journal", "year", "open", "times")
    t = sets.agg(F.grouping_id().alias("g"), F.count("*").alias("n"), F.sum(c).alias("sum"), F.avg(c).alias("mean"),
                 F.max(c).alias("max"), F.min(c).alias("min"), F.stddev_samp(c).alias("std"),
                 F.count_if(c > 0).alias("cited"), F.count_if(c == 0).alias("uncited"),
                 F.count_if(c >= 10).alias("ten"), F.count_if(c >= 50).alias("fifty"), F.min("seq").alias("first"))
    # one bit for each column that is not in the set: journal, year, open, times
    journals, years, access, times, whole = (F.col("g") == g for g in (0b0111, 0b1011, 0b1101, 0b1110, 0b1111))
    named = journals & F.col("journal").isNotNull()
    t = cut_lineage(t)  # several readers
    ranked = top_k(t.where(named).select(F.lit(0).alias("all"), "journal", "n", "first"), ["all"],
                   [F.col("n").desc(), F.col("first")], top_n, ["journal"])
    top = ranked.agg(F.array_sort(F.collect_list(F.struct(
        "rank", "journal", F.col("n").alias("count")))).alias("top"))  # top_n entries
    median = exact_median(t.where(times & F.col("times").isNotNull()).select(F.col("times").alias("value"), "n"))
    pick = lambda name: F.max(F.when(whole, F.col(name)))
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).cast("long")
    out = t.agg(
        total(whole).alias("size"), F.count_if(named).alias("journals"), total(named).alias("in_journals"),
        total(access & F.col("open")).alias("opened"),
        F.lit(median).cast("double").alias("median"),
        *[pick(k).alias(k) for k in ("sum", "mean", "max", "min", "std", "cited", "uncited", "ten", "fifty")],
        F.array_sort(F.collect_list(F.when(years & F.col("year").isNotNull(), F.struct(
            "year", F.col("n").alias("count"), F.col("mean").alias("mean_citations"),
            F.col("sum").cast("long").alias("total_citations"))))).alias("by_year"))
    out = out.crossJoin(F.broadcast(top))  # one row each
    count = lambda name: F.coalesce(F.col(name), F.lit(0)).cast("long")
    return out.select(
        F.col("size").alias("dataset_size"),
        F.struct(count("sum").alias("total_citations"), F.col("mean").alias("mean_citations"),
                 F.col("median").alias("median_citations"), F.col("max").cast("long").alias("max_citations"),
                 F.col("min").cast("long").alias("min_citations"), F.col("std").alias("std_citations"),
                 count("cited").alias("articles_with_citations"), count("uncited").alias("articles_without_citations"),
                 count("ten").alias("highly_cited_10plus"), count("fifty").alias("highly_cited_50plus")).alias("citations"),
        F.struct(F.col("journals").alias("total_journals"), F.col("in_journals").alias("total_articles_with_journal"),
                 F.transform("top", lambda r: F.struct(
                     r["journal"], r["count"], F.round(r["count"] / F.greatest("in_journals", F.lit(1)) * 100, 1)
                     .alias("percentage"))).alias("top_journals")).alias("journals"),
        F.struct(F.col("size").alias("total_articles"), F.col("opened").alias("open_access_count"),
                 (F.col("size") - F.col("opened")).alias("closed_access_count"),
                 F.round(F.col("opened") / F.greatest("size", F.lit(1)) * 100, 1).alias("open_access_rate"))
        .alias("open_access"),
        F.col("by_year").alias("yearly_stats"))
