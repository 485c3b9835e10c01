"""Article preprocessing and weak labelling.

All row-wise; Catalyst pushes the filters (empty title / abstract, date
window) into the Parquet scan when the input is a table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperlens.functions.coerce import to_int_or, to_whole
from paperlens.functions.rules import LabelRule, rule_column
from paperlens.functions.text import (
    ABSTRACT_LABEL, JOURNAL_LABEL, KEYWORDS_LABEL, TITLE_LABEL, clean_text, combine_cleaned,
    py_list_repr)

MIN_TEXT_LENGTH = 50  # combined text must be strictly longer than this


def preprocess(df: DataFrame, min_text_length: int = MIN_TEXT_LENGTH,
               label_col: str | None = "label") -> DataFrame:
    """Cleaned title / abstract, combined text, int label / year / citations,
    lengths in characters; keeps rows whose combined text is longer than 50.

    ``keywords`` may be array<string> (rendered like a Python list) or a string.
    """
    kw = None
    if "keywords" in df.columns:
        kt = df.schema["keywords"].dataType
        kw = py_list_repr(F.col("keywords")) if isinstance(kt, T.ArrayType) else F.col("keywords")
    # cleaned fields first; the combined text reuses them (one regex pass per field)
    staged = df.withColumns({"title_clean": clean_text("title"),
                             "abstract_clean": clean_text("abstract")})
    parts = [(TITLE_LABEL, "title", "title_clean"), (ABSTRACT_LABEL, "abstract", "abstract_clean")]
    if "journal" in df.columns:
        parts.append((JOURNAL_LABEL, "journal", clean_text("journal")))
    if kw is not None:
        parts.append((KEYWORDS_LABEL, kw, clean_text(kw)))
    cols = {}
    if "year" in df.columns:
        cols["year"] = to_int_or("year")
    if "cited_by_count" in df.columns:
        cols["cited_by_count"] = to_int_or("cited_by_count", kind="long")
    if label_col and label_col in df.columns:
        # a label that is not an integer fails the job, as it should
        cols[label_col] = to_whole(label_col)
    out = staged.withColumns(cols)
    # The length filter below would otherwise be pushed beneath the projection
    # and rebuild the whole cleaned text a second time; a filter cannot cross a
    # generator's output, so the text is produced by a one-element lateral view.
    out = out.select("*", F.explode_outer(F.array(combine_cleaned(parts))).alias("text"))
    out = out.withColumns({
        "title_length": F.length("title_clean"),
        "abstract_length": F.length("abstract_clean"),
        "text_length": F.length("text"),
    })
    return out.where(F.col("text_length") > min_text_length)


def drop_empty(df: DataFrame) -> DataFrame:
    """Drop rows with an empty title or abstract."""
    ok = lambda c: F.col(c).isNotNull() & (F.col(c) != "")
    return df.where(ok("title") & ok("abstract"))


def date_window(df: DataFrame, min_year: int, max_year: int,
                date_col: str = "first_pub_date") -> DataFrame:
    """P5: inclusive [min_year-01-01, max_year-12-31] on the first publication date; a missing
    or unreadable date lies outside any window."""
    d = F.col(date_col)
    if not isinstance(df.schema[date_col].dataType, T.DateType):
        d = d.try_cast("date")
    return df.where(d.between(F.lit(f"{min_year}-01-01").cast("date"),
                              F.lit(f"{max_year}-12-31").cast("date")))


def label_by_rules(df: DataFrame, rules: Sequence[LabelRule],
                   title_col: str = "title", abstract_col: str = "abstract") -> DataFrame:
    """One output row per (article, matching rule) with ``label`` and
    ``query`` (bag semantics: an article hit by two rules appears twice).

    All rules are evaluated in one pass: an array of ``when`` per row, exploded.
    """
    lt = F.lower(F.concat(F.coalesce(F.col(title_col), F.lit("")), F.lit(" "),
                          F.coalesce(F.col(abstract_col), F.lit(""))))
    hits = F.filter(
        F.array(*[F.when(rule_column(r.rule, lt),
                         F.struct(F.lit(i).alias("rule_ord"), F.lit(r.label).alias("label"),
                                  F.lit(r.name).alias("query")))
                  for i, r in enumerate(rules)]),
        lambda x: x.isNotNull())
    # explode_outer + null filter: keeps the optimizer from re-evaluating the rules
    return (df.select("*", F.explode_outer(hits).alias("__hit")).where(F.col("__hit").isNotNull())
            .select(*[F.col(f"`{c}`") for c in df.columns], "__hit.rule_ord", "__hit.label",
                    "__hit.query"))


def collect_labelled(df: DataFrame, rules: Sequence[LabelRule], min_year: int | None = None,
                     max_year: int | None = None, max_per_rule: int | None = None,
                     order_col: str = "seq") -> DataFrame:
    """P4-P7 end to end: date window, empty filter, rule labels, cap per rule.

    The cap keeps the first ``max_per_rule`` hits of each rule in ``order_col``
    order (``order_col`` unique), ranked in salted sub-groups first.
    """
    x = df
    if min_year is not None and max_year is not None:
        x = date_window(x, min_year, max_year)
    x = label_by_rules(drop_empty(x), rules)
    if max_per_rule:
        from paperlens.operators.topk import top_k
        x = top_k(x, ["rule_ord"], [F.col(order_col)], max_per_rule, [order_col]).drop("rank")
    return x
