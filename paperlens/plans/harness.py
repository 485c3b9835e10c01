"""Query catalogue: every operator of the inventory as a Spark job over the
driver's tables, with the equivalent SQL (DuckDB dialect) as its oracle.

Each entry takes ``(spark, sf_dir)`` and returns a DataFrame; computed
columns carry the same names in both forms and doubles are rounded to six
digits on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperlens.functions.rules import LabelRule, all_of, any_of, rule_sql, rule_text
from paperlens.functions.text import (
    NAMED_ENTITY_PATTERN, NUMERIC_ENTITY_PATTERN, TAG_PATTERN, WHITESPACE_RUN,
    clean_text)
from paperlens.sources.adapters import (
    DOCUMENT_ARTICLES_SQL, LABELLED_ARTICLES_SQL, ORDER_ARTICLES_SQL,
    documents_as_articles, orders_as_articles, read_table, spread)

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def r6(c):
    return F.round(c, 6)


def sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# ---------------------------------------------------------------- SQL pieces

def sql_clean(x: str) -> str:
    """P1 in DuckDB SQL (RE2, 'g' = replace all)."""
    e = f"coalesce({x}, '')"
    for pat in (TAG_PATTERN, NAMED_ENTITY_PATTERN, NUMERIC_ENTITY_PATTERN):
        e = f"regexp_replace({e}, {sql_str(pat)}, ' ', 'g')"
    e = f"regexp_replace({e}, {sql_str(WHITESPACE_RUN)}, ' ', 'g')"
    return f"trim({e}, ' ')"


def sql_list_repr(x: str) -> str:
    return ("'[' || array_to_string(list_transform(" + x +
            ", lambda k: '''' || k || ''''), ', ') || ']'")


def sql_combine(title: str, abstract: str, journal: str, keywords_text: str) -> str:
    def part(label, x):
        return f"CASE WHEN {x} IS NOT NULL AND {x} <> '' THEN '{label}' || {sql_clean(x)} END"
    kw = (f"CASE WHEN {keywords_text} IS NOT NULL AND {keywords_text} <> '' AND "
          f"{keywords_text} <> '[]' THEN 'KEYWORDS: ' || {sql_clean(keywords_text)} END")
    return ("concat_ws(' ', " + ", ".join([part("TITLE: ", title), part("ABSTRACT: ", abstract),
                                            part("JOURNAL: ", journal), kw]) + ")")


# ---------------------------------------------------------------- P1-P3

@register("clean_html", f"""
SELECT page_id, {sql_clean('html')} AS html_clean,
       CAST(length({sql_clean('html')}) AS INTEGER) AS clean_length
FROM pages""")
def q_clean_html(spark: SparkSession, sf: str) -> DataFrame:
    p = read_table(spark, sf, "pages")
    c = clean_text("html")
    return p.select("page_id", c.alias("html_clean"), F.length(c).alias("clean_length"))


PREPROCESS_SQL = f"""(
  SELECT doc_id, label,
    {sql_clean('title')} AS title_clean, {sql_clean('abstract')} AS abstract_clean,
    {sql_combine('title', 'abstract', 'journal', sql_list_repr('keywords'))} AS text,
    year, CAST(cited_by_count AS INTEGER) AS cited_by_count
  FROM {LABELLED_ARTICLES_SQL})"""


def preprocessed_articles(spark: SparkSession, sf: str, labelled: bool = True) -> DataFrame:
    from paperlens.operators.preprocess import preprocess
    a = documents_as_articles(spark, sf, labelled=labelled)
    return preprocess(a)


@register("preprocess", f"""
SELECT doc_id, label, title_clean, abstract_clean, text, year, cited_by_count,
  CAST(length(title_clean) AS INTEGER) AS title_length,
  CAST(length(abstract_clean) AS INTEGER) AS abstract_length,
  CAST(length(text) AS INTEGER) AS text_length
FROM {PREPROCESS_SQL} WHERE length(text) > 50""")
def q_preprocess(spark: SparkSession, sf: str) -> DataFrame:
    return preprocessed_articles(spark, sf).select(
        "doc_id", "label", "title_clean", "abstract_clean", "text", "year", "cited_by_count",
        "title_length", "abstract_length", "text_length")


@register("combine_fields", f"""
SELECT doc_id, {sql_combine('title', 'abstract', 'journal', sql_list_repr('keywords'))} AS text,
  {sql_combine('title', 'abstract', 'NULL', 'NULL')} AS text_title_abstract
FROM {DOCUMENT_ARTICLES_SQL}""")
def q_combine_fields(spark: SparkSession, sf: str) -> DataFrame:
    from paperlens.functions.text import combine_fields, py_list_repr
    a = documents_as_articles(spark, sf)
    return a.select("doc_id",
                    combine_fields("title", "abstract", "journal", py_list_repr(F.col("keywords")))
                    .alias("text"),
                    combine_fields("title", "abstract").alias("text_title_abstract"))


# ---------------------------------------------------------------- T1-T12, K2

# --- fixed values: a test dictionary that hits the driver's invented prose ---
# (short terms are whole-word, "eaux" is whole-word and never a word: a zero case)
PROSE_DICTIONARY = {
    "en": ["the", "and", "with", "by"],
    "fr": ["des", "les", "qui", "pour"],
    "de": ["und", "nicht", "für"],
    "frag": ["tion the", "ement", "eaux"],
    "license": ["CC BY", "Apache License"],
}


def _compiled(mapping):
    from paperlens.operators.matching import CompiledDictionary
    return CompiledDictionary.from_mapping(mapping)


def sql_term_condition(t, lt: str) -> str:
    from paperlens.operators.matching import whole_word_pattern
    if t.is_short:
        return f"regexp_matches({lt}, {sql_str(whole_word_pattern(t.term))})"
    return f"contains({lt}, {sql_str(t.lower)})"


def sql_features(cd, lt: str) -> str:
    """Select list of T9-T11 over a lower-cased text expression."""
    hits = [f"CAST({sql_term_condition(t, lt)} AS INTEGER)" for t in cd.terms]
    per_cat = {}
    for t, h in zip(cd.terms, hits):
        per_cat.setdefault(t.category, []).append(h)
    cols = [f"({' + '.join(v)}) AS match_{c}" for c, v in per_cat.items()]
    total = "(" + " + ".join(hits) + ")"
    cats = "(" + " + ".join(f"CAST(({' + '.join(v)}) > 0 AS INTEGER)" for v in per_cat.values()) + ")"
    ncat = max(len(per_cat), 1)
    terms = ("concat_ws('|', " + ", ".join(
        f"CASE WHEN {sql_term_condition(t, lt)} THEN {sql_str(t.term)} END" for t in cd.terms) + ")")
    rel = (f"CASE WHEN {total} = 0 THEN 0.0 ELSE round(0.4 * ({cats} / {float(ncat)}) + 0.6 * "
           f"least(1.0, ln(1 + {total}) / ln(21)), 4) END")
    cols += [f"{total} AS match_total", f"round({total} / {float(max(cd.n_terms, 1))}, 6) AS match_score",
             f"{cats} AS categories_matched", f"{rel} AS relevance_score", f"{terms} AS matched_terms"]
    return ",\n  ".join(cols)


def matched_features(df: DataFrame, mapping, text: str = "match_text",
                     strategy: str = "expr") -> DataFrame:
    from paperlens.operators.matching import augment_with_dictionary
    cd = _compiled(mapping)
    out = augment_with_dictionary(df, cd, text, keep_matches=True, strategy=strategy)
    return out.withColumn("matched_terms",
                          F.array_join(F.transform("matches", lambda m: m["term"]), "|")) \
              .withColumn("match_score", r6(F.col("match_score"))).drop("matches")


def _feature_cols(mapping) -> list[str]:
    return ([f"match_{c}" for c in mapping] +
            ["match_total", "match_score", "categories_matched", "relevance_score", "matched_terms"])


@register("match_features", f"""
SELECT doc_id, {sql_features(_compiled(PROSE_DICTIONARY), "lower(title || ' ' || abstract)")}
FROM {DOCUMENT_ARTICLES_SQL}""")
def q_match_features(spark: SparkSession, sf: str) -> DataFrame:
    """T7-T11 on title + ' ' + abstract (T8) with the prose dictionary."""
    from paperlens.operators.matching import match_article_text
    a = documents_as_articles(spark, sf).select("doc_id", match_article_text().alias("match_text"))
    return matched_features(a, PROSE_DICTIONARY).select("doc_id", *_feature_cols(PROSE_DICTIONARY))


@register("match_features_automaton", ORACLES["match_features"])
def q_match_features_automaton(spark: SparkSession, sf: str) -> DataFrame:
    """T7-T11 by one Aho-Corasick pass a text."""
    from paperlens.operators.matching import match_article_text
    a = documents_as_articles(spark, sf).select("doc_id", match_article_text().alias("match_text"))
    return matched_features(a, PROSE_DICTIONARY, strategy="automaton").select(
        "doc_id", *_feature_cols(PROSE_DICTIONARY))


def _builtin_mapping():
    from paperlens.operators.dictionary import distinct_builtin_terms
    return distinct_builtin_terms()


@register("match_builtin", f"""
SELECT doc_id, {sql_features(_compiled(_builtin_mapping()), "lower(title || ' ' || abstract)")}
FROM {DOCUMENT_ARTICLES_SQL}""")
def q_match_builtin(spark: SparkSession, sf: str) -> DataFrame:
    """T1-T12 with the built-in 236-term dictionary."""
    from paperlens.operators.matching import match_article_text
    mapping = _builtin_mapping()
    a = documents_as_articles(spark, sf).select("doc_id", match_article_text().alias("match_text"))
    return matched_features(a, mapping).select("doc_id", *_feature_cols(mapping))


@register("relevance_by_label", f"""
WITH p AS (SELECT * FROM {PREPROCESS_SQL} WHERE length(text) > 50),
f AS (SELECT label, {sql_features(_compiled(PROSE_DICTIONARY), "lower(text)")} FROM p)
SELECT label, count(*) AS n_docs, round(avg(relevance_score), 6) AS mean_relevance,
  CAST(sum(match_total) AS BIGINT) AS total_matches,
  round(avg(categories_matched), 6) AS mean_categories
FROM f GROUP BY label""")
def q_relevance_by_label(spark: SparkSession, sf: str) -> DataFrame:
    """Flagship slice: preprocess -> T12 on the combined text -> per-label summary."""
    from paperlens.operators.matching import augment_with_dictionary
    p = preprocessed_articles(spark, sf)
    f = augment_with_dictionary(p.select("label", "text"), _compiled(PROSE_DICTIONARY), "text")
    return f.groupBy("label").agg(
        F.count("*").alias("n_docs"), r6(F.avg("relevance_score")).alias("mean_relevance"),
        F.sum("match_total").cast("long").alias("total_matches"),
        r6(F.avg("categories_matched")).alias("mean_categories"))


def _dict_keywords_sql(mapping, n: int) -> str:
    cd = _compiled(mapping)
    lt = "lower(title || ' ' || abstract)"
    parts = [f"SELECT {sql_str(t.term)} AS term, {t.cat_ord} AS cat_ord, {t.ord} AS ord, "
             f"count(*) AS n_docs, min(seq) AS first_seq FROM {DOCUMENT_ARTICLES_SQL} "
             f"WHERE {sql_term_condition(t, lt)}" for t in cd.terms]
    return (f"SELECT term, n_docs FROM ({' UNION ALL '.join(parts)}) WHERE n_docs > 0 "
            f"ORDER BY n_docs DESC, first_seq, cat_ord, ord LIMIT {n}")


@register("dict_keywords", _dict_keywords_sql(PROSE_DICTIONARY, 10))
def q_dict_keywords(spark: SparkSession, sf: str) -> DataFrame:
    """K2: documents per matched term, top 10, first-seen order on ties."""
    from paperlens.operators.matching import dictionary_keywords, match_article_text
    a = documents_as_articles(spark, sf).select("seq", match_article_text().alias("match_text"))
    return dictionary_keywords(a, _compiled(PROSE_DICTIONARY), "match_text", "seq", 10)


def _raw_terms_values() -> str:
    from paperlens.operators.dictionary import BUILTIN_CATEGORIES
    from paperlens.operators.matching import whole_word_pattern
    rows = []
    for ci, (c, lst) in enumerate(BUILTIN_CATEGORIES.items()):
        for oi, t in enumerate(lst):
            pat = whole_word_pattern(t) if len(t) <= 4 else ""
            rows.append(f"({sql_str(c)}, {ci}, {oi}, {sql_str(t)}, {sql_str(pat)})")
    return "(VALUES " + ", ".join(rows) + ") AS raw(category, cat_ord, raw_ord, term, pat)"


DEDUP_TERMS_SQL = f"""(
  SELECT category, cat_ord, CAST(row_number() OVER (PARTITION BY category ORDER BY raw_ord) - 1
         AS INTEGER) AS ord, term, pat
  FROM (SELECT *, row_number() OVER (PARTITION BY category, lower(term) ORDER BY raw_ord) AS k
        FROM {_raw_terms_values()}) WHERE k = 1)"""


@register("dict_term_hits", f"""
WITH d AS {DEDUP_TERMS_SQL},
a AS (SELECT lower(title || ' ' || abstract) AS lt FROM {DOCUMENT_ARTICLES_SQL})
SELECT d.category, d.ord, d.term,
  CAST(count(a.lt) AS BIGINT) AS n_docs
FROM d LEFT JOIN a ON (CASE WHEN length(d.term) <= 4 THEN regexp_matches(a.lt, d.pat)
                            ELSE contains(a.lt, lower(d.term)) END)
GROUP BY d.category, d.ord, d.term""")
def q_dict_term_hits(spark: SparkSession, sf: str) -> DataFrame:
    """T1-T5 + T7: every dictionary term with its document count (0 when unmatched)."""
    from paperlens.operators.dictionary import (
        build_dictionary, dictionary_to_mapping, raw_dictionary_df)
    from paperlens.operators.matching import (
        CompiledDictionary, explode_matches, match_article_text, with_matches)
    # built (T1-T3) by Spark once; the small result is reused as a local table
    d = raw_dictionary_df(spark, dictionary_to_mapping(build_dictionary(spark)))
    a = documents_as_articles(spark, sf).select(match_article_text().alias("match_text"))
    hits = (explode_matches(with_matches(a, CompiledDictionary.from_df(d), "match_text", "m")
                            .select("m"), "m", "h")
            .groupBy(F.col("h.category").alias("category"), F.col("h.ord").alias("ord"))
            .agg(F.count("*").alias("n")))
    # d: one row per dictionary term
    return (d.join(hits, ["category", "ord"], "left")
            .select("category", "ord", "term", F.coalesce("n", F.lit(0)).cast("long").alias("n_docs")))


@register("dict_flat_hits", f"""
WITH d AS {DEDUP_TERMS_SQL},
f AS (SELECT row_number() OVER (ORDER BY cat_ord, ord) - 1 AS pos, * FROM d),
a AS (SELECT lower(title || ' ' || abstract) AS lt FROM {DOCUMENT_ARTICLES_SQL})
SELECT f.pos, f.term, count(a.lt) AS n_docs
FROM f LEFT JOIN a ON (CASE WHEN length(f.term) <= 4 THEN regexp_matches(a.lt, f.pat)
                            ELSE contains(a.lt, lower(f.term)) END)
GROUP BY f.pos, f.term""")
def q_dict_flat_hits(spark: SparkSession, sf: str) -> DataFrame:
    """T5: the flat term list, each term's place in it with the documents it occurs in."""
    from paperlens.operators.dictionary import build_dictionary, flat_terms
    from paperlens.operators.matching import explode_matches, match_article_text, with_matches
    d = build_dictionary(spark)
    flat = flat_terms(d).select(F.posexplode("terms").alias("pos", "term"))
    a = documents_as_articles(spark, sf).select(match_article_text().alias("match_text"))
    hits = (explode_matches(with_matches(a, _builtin_mapping(), "match_text", "m").select("m"), "m", "h")
            .groupBy("h.category", F.col("h.term").alias("t")).agg(F.count("*").alias("n")))
    # a term may stand in two categories: its places are matched one by one
    at = d.select("category", F.col("term").alias("t"),
                  (F.row_number().over(Window.orderBy("cat_ord", "ord")) - 1).alias("pos"))
    return (flat.join(at, "pos").join(hits, ["category", "t"], "left")
            .select(F.col("pos").cast("long").alias("pos"), "term", F.coalesce("n", F.lit(0)).alias("n_docs")))


@register("dict_summary", f"""
WITH d AS {DEDUP_TERMS_SQL},
a AS (SELECT doc_id, lower(title || ' ' || abstract) AS lt FROM {DOCUMENT_ARTICLES_SQL}),
hits AS (SELECT DISTINCT d.category, a.doc_id FROM d JOIN a ON
  (CASE WHEN length(d.term) <= 4 THEN regexp_matches(a.lt, d.pat) ELSE contains(a.lt, lower(d.term)) END)),
s AS (SELECT category, min(cat_ord) AS cat_ord, count(*) AS n_terms,
  array_to_string(list(term ORDER BY ord)[1:5], ', ') AS sample_terms FROM d GROUP BY category)
SELECT s.category, s.cat_ord, s.n_terms, s.sample_terms,
  (SELECT count(*) FROM hits h WHERE h.category = s.category) AS n_docs_matched
FROM s""")
def q_dict_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Terms per category, first five terms, documents hitting the category."""
    from paperlens.operators.dictionary import (
        build_dictionary, dictionary_summary, dictionary_to_mapping, raw_dictionary_df)
    from paperlens.operators.matching import (
        CompiledDictionary, explode_matches, match_article_text, with_matches)
    d = raw_dictionary_df(spark, dictionary_to_mapping(build_dictionary(spark)))
    a = documents_as_articles(spark, sf).select(match_article_text().alias("match_text"))
    cats = with_matches(a, CompiledDictionary.from_df(d), "match_text", "m").select(
        F.array_distinct(F.transform("m", lambda x: x["category"])).alias("cats"))
    per_cat = (explode_matches(cats, "cats", "category")
               .groupBy("category").agg(F.count("*").alias("n")))
    summ = dictionary_summary(d)
    return (summ.join(per_cat, "category", "left")
            .select("category", "cat_ord", "n_terms",
                    F.array_join("sample_terms", ", ").alias("sample_terms"),
                    F.coalesce("n", F.lit(0)).alias("n_docs_matched")))


# ---------------------------------------------------------------- A1-A5, A11

def _positives(spark, sf):
    from paperlens.operators.impact import positive_only
    return positive_only(documents_as_articles(spark, sf, labelled=True))


POSITIVES_SQL = f"(SELECT * FROM {LABELLED_ARTICLES_SQL} WHERE label = 1)"


def _citation_sql(src: str) -> str:
    return f"""
SELECT CAST(coalesce(sum(c), 0) AS BIGINT) AS total_citations, round(avg(c), 6) AS mean_citations,
  round(quantile_cont(c, 0.5), 6) AS median_citations, CAST(max(c) AS BIGINT) AS max_citations,
  CAST(min(c) AS BIGINT) AS min_citations, round(stddev_samp(c), 6) AS std_citations,
  count(*) FILTER (WHERE c > 0) AS articles_with_citations,
  count(*) FILTER (WHERE c = 0) AS articles_without_citations,
  count(*) FILTER (WHERE c >= 10) AS highly_cited_10plus,
  count(*) FILTER (WHERE c >= 50) AS highly_cited_50plus
FROM (SELECT CAST(cited_by_count AS DOUBLE) AS c FROM {src})"""


def _round_doubles(df: DataFrame) -> DataFrame:
    from pyspark.sql import types as T
    return df.select(*[r6(F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.DoubleType)
                       else F.col(f.name) for f in df.schema.fields])


@register("citation_metrics", _citation_sql(POSITIVES_SQL))
def q_citation_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """A1 (+ P8): citation statistics of the positive articles."""
    from paperlens.operators.impact import citation_metrics
    return _round_doubles(citation_metrics(_positives(spark, sf)))


@register("citation_metrics_orders", _citation_sql(ORDER_ARTICLES_SQL))
def q_citation_metrics_orders(spark: SparkSession, sf: str) -> DataFrame:
    """A1 over the larger dated table."""
    from paperlens.operators.impact import citation_metrics
    return _round_doubles(citation_metrics(orders_as_articles(spark, sf)))


@register("open_access", f"""
SELECT count(*) AS total_articles, count(*) FILTER (WHERE is_open_access) AS open_access_count,
  count(*) - count(*) FILTER (WHERE is_open_access) AS closed_access_count,
  round(count(*) FILTER (WHERE is_open_access) / greatest(count(*), 1) * 100, 1) AS open_access_rate
FROM {POSITIVES_SQL}""")
def q_open_access(spark: SparkSession, sf: str) -> DataFrame:
    """A3 (+ P11 coercion) on the positive articles."""
    from paperlens.operators.impact import open_access
    return open_access(_positives(spark, sf))


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WHITESPACE_RUN}|{WHITESPACE_RUN}$', '', 'g')"


@register("journal_spread", f"""
WITH j AS (SELECT {sql_strip('journal')} AS journal, seq FROM {POSITIVES_SQL}),
per AS (SELECT journal, count(*) AS count, min(seq) AS first_seen FROM j
        WHERE journal IS NOT NULL AND journal <> '' AND journal <> 'nan' GROUP BY journal),
tot AS (SELECT count(*) AS total_journals, CAST(coalesce(sum(count), 0) AS BIGINT)
        AS total_articles_with_journal FROM per),
ranked AS (SELECT row_number() OVER (ORDER BY count DESC, first_seen) AS rank, * FROM per)
SELECT rank, journal, count,
  round(count / greatest(total_articles_with_journal, 1) * 100, 1) AS percentage,
  total_journals, total_articles_with_journal
FROM ranked, tot WHERE rank <= 15""")
def q_journal_spread(spark: SparkSession, sf: str) -> DataFrame:
    """A2: top 15 journals of the positives, first-seen order on ties."""
    from paperlens.operators.impact import journal_spread
    return journal_spread(_positives(spark, sf), 15).withColumn("rank", F.col("rank").cast("long"))


@register("yearly_stats", f"""
SELECT year, count(*) AS count, round(avg(cited_by_count), 6) AS mean_citations,
  CAST(sum(cited_by_count) AS BIGINT) AS total_citations
FROM {ORDER_ARTICLES_SQL} WHERE year IS NOT NULL GROUP BY year""")
def q_yearly_stats(spark: SparkSession, sf: str) -> DataFrame:
    """A4 on the dated table."""
    from paperlens.operators.impact import yearly_stats
    return _round_doubles(yearly_stats(orders_as_articles(spark, sf)))


@register("class_counts", f"""
SELECT count(*) AS total, count(*) FILTER (WHERE label = 1) AS positive,
  count(*) FILTER (WHERE label = 0) AS negative FROM {LABELLED_ARTICLES_SQL}""")
def q_class_counts(spark: SparkSession, sf: str) -> DataFrame:
    """A11."""
    from paperlens.operators.impact import class_counts_summary
    return class_counts_summary(documents_as_articles(spark, sf, labelled=True))


@register("impact_summary", f"""
WITH p AS (SELECT * FROM {POSITIVES_SQL}),
j AS (SELECT {sql_strip('journal')} AS journal, seq FROM p),
per AS (SELECT journal, count(*) AS n, min(seq) AS first_seen FROM j
        WHERE journal IS NOT NULL AND journal <> '' AND journal <> 'nan' GROUP BY journal),
tot AS (SELECT count(*) AS total_journals, CAST(coalesce(sum(n), 0) AS BIGINT) AS total_articles_with_journal FROM per),
rk AS (SELECT row_number() OVER (ORDER BY n DESC, first_seen) AS rank, * FROM per),
tj AS (SELECT string_agg(journal || ':' || n || ':' || CAST(round(round(n / total_articles_with_journal * 100, 1) * 10) AS BIGINT),
       ',' ORDER BY rank) AS top_journals FROM rk, tot WHERE rank <= 15),
oa AS (SELECT count(*) AS total_articles, count(*) FILTER (WHERE is_open_access) AS open_access_count,
  count(*) - count(*) FILTER (WHERE is_open_access) AS closed_access_count,
  round(count(*) FILTER (WHERE is_open_access) / greatest(count(*), 1) * 100, 1) AS open_access_rate FROM p),
y AS (SELECT year, count(*) AS n, sum(cited_by_count) AS s FROM p WHERE year IS NOT NULL GROUP BY year),
ys AS (SELECT string_agg(year || ':' || n || ':' || s || ':' || CAST(round(s / n * 1000) AS BIGINT), ',' ORDER BY year)
       AS yearly FROM y)
SELECT (SELECT count(*) FROM p) AS dataset_size, c.*, tot.*, tj.top_journals, oa.*, ys.yearly
FROM ({_citation_sql('p')}) c, tot, tj, oa, ys""")
def q_impact_summary(spark: SparkSession, sf: str) -> DataFrame:
    """A5: every field of the nested all-metrics row, lists as text."""
    from paperlens.operators.impact import all_impact_metrics
    m = all_impact_metrics(documents_as_articles(spark, sf, labelled=True), positive=True)
    whole = lambda x: F.round(x).cast("long").cast("string")
    top = F.transform("journals.top_journals", lambda r: F.concat_ws(
        ":", r["journal"], r["count"].cast("string"), whole(r["percentage"] * 10)))
    years = F.transform("yearly_stats", lambda r: F.concat_ws(
        ":", r["year"].cast("string"), r["count"].cast("string"), r["total_citations"].cast("string"),
        whole(r["mean_citations"] * 1000)))
    return _round_doubles(m.select(
        "dataset_size", "citations.*", "journals.total_journals", "journals.total_articles_with_journal",
        F.array_join(top, ",").alias("top_journals"), "open_access.*", F.array_join(years, ",").alias("yearly")))


# ---------------------------------------------------------------- A6-A8, W1, W2, P4-P9

@register("trend_table", f"""
WITH y AS (SELECT year, count(*) AS count FROM {ORDER_ARTICLES_SQL} WHERE year IS NOT NULL GROUP BY year)
SELECT year, count,
  round((CAST(count AS DOUBLE) / lag(count) OVER (ORDER BY year) - 1.0) * 100.0, 6) AS growth_rate,
  CAST(sum(count) OVER (ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT)
    AS cumulative
FROM y""")
def q_trend_table(spark: SparkSession, sf: str) -> DataFrame:
    """A6 + W1 + W2 (V1, V2): yearly count, growth, cumulative."""
    from paperlens.operators.trends import trend_table
    return trend_table(orders_as_articles(spark, sf)).withColumn("growth_rate", r6(F.col("growth_rate")))


@register("trend_summary", f"""
WITH y AS (SELECT year, count(*) AS count FROM {ORDER_ARTICLES_SQL} WHERE year IS NOT NULL GROUP BY year),
g AS (SELECT year, count, (CAST(count AS DOUBLE) / lag(count) OVER (ORDER BY year) - 1.0) * 100.0 AS gr,
  CAST(sum(count) OVER (ORDER BY year) AS BIGINT) AS cum FROM y)
SELECT CAST(sum(count) AS BIGINT) AS total_publications,
  CAST(min(year) AS VARCHAR) || '–' || CAST(max(year) AS VARCHAR) AS year_range,
  arg_min(year, (-count, year)) AS peak_year, max(count) AS peak_count,
  round(avg(count), 1) AS average_per_year, round(avg(gr), 1) AS average_growth_rate,
  string_agg(year || ':' || count, ',' ORDER BY year) AS yearly_counts,
  string_agg(year || ':' || CAST(round(gr * 10) AS BIGINT), ',' ORDER BY year) FILTER (gr IS NOT NULL) AS growth_rates,
  string_agg(year || ':' || cum, ',' ORDER BY year) AS cumulative
FROM g""")
def q_trend_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Every field, maps as text."""
    from paperlens.operators.trends import trend_summary
    s = trend_summary(orders_as_articles(spark, sf))

    def text(name, value=lambda v: v):
        return F.array_join(F.transform(F.array_sort(F.map_entries(name)), lambda e: F.concat_ws(
            ":", e["key"].cast("string"), value(e["value"]).cast("string"))), ",").alias(name)

    return s.select("total_publications", "year_range", "peak_year", "peak_count",
                    "average_per_year", "average_growth_rate", text("yearly_counts"),
                    text("growth_rates", lambda v: F.round(v * 10).cast("long")), text("cumulative"))


# --- fixed values: phrase rules that hit the driver's invented prose ---
PROSE_RULES = [
    LabelRule(rule_text(r), r, lab) for r, lab in [
        (all_of("the ", " and "), 1),
        (any_of(" des ", " les "), 0),
        (all_of(" und ", any_of("nicht", "für")), 1),
        (all_of("tion the", "ement"), 0),
    ]]
GRID_YEARS = list(range(2018, 2026))


def _rules_union_sql(src: str, cap: int | None) -> str:
    lt = "lower(title || ' ' || abstract)"
    parts = []
    for i, r in enumerate(PROSE_RULES):
        sel = (f"SELECT doc_id, seq, year, {i} AS rule_ord, CAST({r.label} AS INTEGER) AS label, "
               f"{sql_str(r.name)} AS query FROM {src} WHERE {rule_sql(r.rule, lt)}")
        parts.append(sel)
    body = " UNION ALL ".join(parts)
    if cap:
        body = (f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rule_ord ORDER BY seq) AS rn "
                f"FROM ({body})) WHERE rn <= {cap}")
    return body


NONEMPTY_DOCS_SQL = f"(SELECT * FROM {DOCUMENT_ARTICLES_SQL} WHERE title <> '' AND abstract <> '')"


@register("phrase_rules", f"""
SELECT doc_id, rule_ord, label, query FROM ({_rules_union_sql(NONEMPTY_DOCS_SQL, 100)})""")
def q_phrase_rules(spark: SparkSession, sf: str) -> DataFrame:
    """P4, P6, P7, P9 + O4: labelled hits per rule, empty titles/abstracts dropped,
    first 100 hits per rule."""
    from paperlens.operators.preprocess import collect_labelled
    a = documents_as_articles(spark, sf)
    out = collect_labelled(a, PROSE_RULES, max_per_rule=100, order_col="seq")
    return out.select("doc_id", F.col("rule_ord").cast("int").alias("rule_ord"), "label", "query")


@register("query_year_grid", f"""
WITH g AS (SELECT * FROM (VALUES {', '.join(f"({sql_str(r.name)}, {i})" for i, r in enumerate(PROSE_RULES))})
           AS r(query, rule_ord), (SELECT unnest(range(2018, 2026)) AS year)),
h AS (SELECT query, year, count(*) AS n FROM ({_rules_union_sql(DOCUMENT_ARTICLES_SQL, None)})
      GROUP BY query, year)
SELECT g.query, CAST(g.rule_ord AS INTEGER) AS rule_ord, CAST(g.year AS INTEGER) AS year,
  coalesce(h.n, 0) AS n
FROM g LEFT JOIN h ON g.query = h.query AND g.year = h.year""")
def q_query_year_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Hits per (rule, year), every pair present."""
    from paperlens.operators.matching import match_article_text
    from paperlens.operators.trends import query_year_grid
    a = documents_as_articles(spark, sf).select("year", match_article_text().alias("match_text"))
    return query_year_grid(a, PROSE_RULES, GRID_YEARS, "match_text", "year")


@register("year_filter", f"""
SELECT id, first_pub_date, year FROM {ORDER_ARTICLES_SQL}
WHERE first_pub_date BETWEEN DATE '1996-01-01' AND DATE '1998-12-31'""")
def q_year_filter(spark: SparkSession, sf: str) -> DataFrame:
    """P5: inclusive publication-date window (pushed into the Parquet scan)."""
    from paperlens.operators.preprocess import date_window
    return date_window(orders_as_articles(spark, sf), 1996, 1998).select("id", "first_pub_date", "year")


# ---------------------------------------------------------------- D1-D7

def _uid_sql() -> str:
    title = sql_strip("lower(coalesce(title, ''))")
    return (f"coalesce('pmid:' || nullif(pmid, ''), 'doi:' || nullif(doi, ''), "
            f"'pmcid:' || nullif(pmcid, ''), 'title:' || {title})")


@register("dedup_keep_first", f"""
SELECT uid, arg_min(doc_id, seq) AS doc_id, count(*) AS n_copies
FROM (SELECT *, {_uid_sql()} AS uid FROM {DOCUMENT_ARTICLES_SQL}) GROUP BY uid""")
def q_dedup_keep_first(spark: SparkSession, sf: str) -> DataFrame:
    """D1 + D2: namespaced id key, first row kept; with the number of copies."""
    from paperlens.operators.curate import dedup_keep_first, with_dedup_key
    a = with_dedup_key(documents_as_articles(spark, sf))
    kept = dedup_keep_first(a.select("uid", "doc_id", "seq"), "uid", "seq", count="n_copies")
    return kept.select("uid", "doc_id", "n_copies")


COLLECTED_SQL = f"""(
  WITH a AS (SELECT *, {_uid_sql()} AS uid FROM {LABELLED_ARTICLES_SQL}),
  d AS (SELECT label, uid, arg_min(doc_id, seq) AS doc_id FROM a GROUP BY label, uid),
  r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(uid || ':42'), uid) AS rk FROM d),
  k AS (SELECT least(coalesce(max(n) FILTER (WHERE label = 0), 0),
                     coalesce(max(n) FILTER (WHERE label = 1), 0)) AS k
        FROM (SELECT label, count(*) AS n FROM d GROUP BY label))
  SELECT label, uid, doc_id FROM r, k WHERE rk <= k.k)"""


@register("collect_balance", f"SELECT label, uid, doc_id FROM {COLLECTED_SQL}")
def q_collect_balance(spark: SparkSession, sf: str) -> DataFrame:
    """D6 (D1-D3): dedup within each class, then exact down-sampling (seed 42)."""
    from paperlens.operators.curate import collection_pipeline
    a = documents_as_articles(spark, sf, labelled=True).select(
        "doc_id", "seq", "pmid", "doi", "pmcid", "title", "label")
    return collection_pipeline(a, True, 42).select("label", "uid", "doc_id")


def _quota_sql(counts: str, train: float, val: float, test: float) -> str:
    tf, rel = val + test, test / (val + test)
    d = lambda x: f"CAST({x!r} AS DOUBLE)"
    return f"""
  t1 AS (SELECT *, sum(n) OVER () AS total FROM {counts}),
  t2 AS (SELECT *, total - CAST(ceil({d(tf)} * total) AS BIGINT) AS draws FROM t1),
  t3 AS (SELECT *, CASE WHEN total > 0 THEN CAST(n AS DOUBLE) / total * draws ELSE 0.0 END AS cont FROM t2),
  t4 AS (SELECT *, floor(cont) AS fl, draws - sum(floor(cont)) OVER () AS need FROM t3),
  t5 AS (SELECT *, row_number() OVER (ORDER BY cont - fl DESC, label) AS rk FROM t4),
  t6 AS (SELECT label, n, CAST(fl + CASE WHEN rk <= need THEN 1 ELSE 0 END AS BIGINT) AS n_train FROM t5),
  u1 AS (SELECT *, n - n_train AS tmp, sum(n - n_train) OVER () AS m FROM t6),
  u2 AS (SELECT *, m - CAST(ceil({d(rel)} * m) AS BIGINT) AS draws2 FROM u1),
  u3 AS (SELECT *, CASE WHEN m > 0 THEN CAST(tmp AS DOUBLE) / m * draws2 ELSE 0.0 END AS cont2 FROM u2),
  u4 AS (SELECT *, floor(cont2) AS fl2, draws2 - sum(floor(cont2)) OVER () AS need2 FROM u3),
  u5 AS (SELECT *, row_number() OVER (ORDER BY cont2 - fl2 DESC, label) AS rk2 FROM u4),
  q AS (SELECT label, n, n_train, CAST(fl2 + CASE WHEN rk2 <= need2 THEN 1 ELSE 0 END AS BIGINT) AS n_val
        FROM u5)"""


SPLIT_SQL = f"""(
  WITH a AS (SELECT doc_id, label FROM {LABELLED_ARTICLES_SQL}),
  c AS (SELECT label, count(*) AS n FROM a GROUP BY label),
  {_quota_sql('c', 0.7, 0.15, 0.15)},
  r AS (SELECT a.*, row_number() OVER (PARTITION BY label
          ORDER BY md5(CAST(doc_id AS VARCHAR) || ':42'), doc_id) AS rk FROM a)
  SELECT r.doc_id, r.label, CASE WHEN rk <= n_train THEN 'train' WHEN rk <= n_train + n_val
    THEN 'val' ELSE 'test' END AS split
  FROM r JOIN q USING (label))"""


def labelled_splits(spark: SparkSession, sf: str) -> DataFrame:
    from paperlens.operators.curate import create_splits
    a = documents_as_articles(spark, sf, labelled=True).select("doc_id", "label")
    return create_splits(a, 0.7, 0.15, 0.15, seed=42, stratify=True)


@register("split", f"SELECT doc_id, label, split FROM {SPLIT_SQL}")
def q_split(spark: SparkSession, sf: str) -> DataFrame:
    """Stratified exact 70/15/15 split in md5 order (seed 42)."""
    return labelled_splits(spark, sf).select("doc_id", "label", "split")


@register("split_stats", f"""
SELECT split, count(*) AS size, CAST(coalesce(sum(label), 0) AS BIGINT) AS positive,
  count(*) FILTER (WHERE label = 0) AS negative FROM {SPLIT_SQL} GROUP BY split""")
def q_split_stats(spark: SparkSession, sf: str) -> DataFrame:
    """D5 + D7: per-split size / positive / negative."""
    from paperlens.operators.curate import split_stats
    return split_stats(labelled_splits(spark, sf))


@register("split_unstratified", f"""
WITH a AS (SELECT doc_id, label, 0 AS grp FROM {LABELLED_ARTICLES_SQL}),
c AS (SELECT 0 AS label, count(*) AS n FROM a),
{_quota_sql('c', 0.6, 0.2, 0.2)},
r AS (SELECT a.*, row_number() OVER (ORDER BY md5(CAST(doc_id AS VARCHAR) || ':7'), doc_id) AS rk FROM a)
SELECT r.doc_id, r.label, CASE WHEN rk <= n_train THEN 'train' WHEN rk <= n_train + n_val THEN 'val'
  ELSE 'test' END AS split
FROM r, q""")
def q_split_unstratified(spark: SparkSession, sf: str) -> DataFrame:
    """D4 without stratification, 60/20/20, seed 7."""
    from paperlens.operators.curate import create_splits
    a = documents_as_articles(spark, sf, labelled=True).select("doc_id", "label")
    return create_splits(a, 0.6, 0.2, 0.2, seed=7, stratify=False).select("doc_id", "label", "split")


@register("split_union", f"SELECT doc_id, label, split FROM {SPLIT_SQL} WHERE split <> 'val'")
def q_split_union(spark: SparkSession, sf: str) -> DataFrame:
    """Bag union of two splits; columns by name, whatever their order."""
    from paperlens.operators.curate import union_splits
    s = labelled_splits(spark, sf)
    train = s.where(F.col("split") == "train").select("doc_id", "label", "split")
    return union_splits(train, s.where(F.col("split") == "test").select("split", "label", "doc_id"))


@register("collect_by_rules", f"""
WITH h AS (SELECT a.*, {_uid_sql()} AS uid, r.rule_ord, r.label, r.query
  FROM {NONEMPTY_DOCS_SQL} a JOIN ({_rules_union_sql(NONEMPTY_DOCS_SQL, None)}) r USING (doc_id))
SELECT label, uid, arg_min(doc_id, (rule_ord, h.seq)) AS doc_id, arg_min(query, (rule_ord, h.seq)) AS query
FROM h GROUP BY label, uid""")
def q_collect_by_rules(spark: SparkSession, sf: str) -> DataFrame:
    """D6 over rules: of copies within a class the first by rule, then by row, stays."""
    from paperlens.plans.pipelines import collect_by_rules
    a = documents_as_articles(spark, sf).select("doc_id", "seq", "pmid", "doi", "pmcid", "title", "abstract")
    return collect_by_rules(a, PROSE_RULES, balance=False).select("label", "uid", "doc_id", "query")


# ---------------------------------------------------------------- A9, A10

@register("annotation_types", """
SELECT user_id AS ext_id, event_type AS type, count(*) AS n,
  arg_min(props, event_id) AS example_exact,
  substr(arg_min('evt-' || CAST(event_id AS VARCHAR) || ' ' || props, event_id), 1, 30) AS example_prefix
FROM events GROUP BY user_id, event_type""")
def q_annotation_types(spark: SparkSession, sf: str) -> DataFrame:
    """A9 on events read as annotations: (article=user, type) counts and first example."""
    from paperlens.operators.annotations import annotation_type_counts_long
    e = read_table(spark, sf, "events").select(
        F.col("user_id").alias("ext_id"), F.col("event_id").alias("pos"),
        F.col("event_type").alias("type"), F.col("props").alias("exact"),
        F.concat(F.lit("evt-"), F.col("event_id").cast("string"), F.lit(" "), F.col("props"))
        .alias("prefix"))
    return annotation_type_counts_long(e, "ext_id", "pos")


@register("field_inventory", """
SELECT * FROM (VALUES ('doc_id', 'bigint'), ('lang', 'string'), ('n_chars', 'bigint'),
                      ('source', 'string'), ('text', 'string')) AS k(key, type)
JOIN (
  SELECT 'doc_id' AS key, count(doc_id) AS non_null,
         arg_min(substr(CAST(doc_id AS VARCHAR), 1, 80), doc_id) AS preview FROM documents
  UNION ALL SELECT 'lang', count(lang), arg_min(substr(lang, 1, 80), doc_id) FILTER (WHERE lang IS NOT NULL) FROM documents
  UNION ALL SELECT 'n_chars', count(n_chars), arg_min(substr(CAST(n_chars AS VARCHAR), 1, 80), doc_id) FILTER (WHERE n_chars IS NOT NULL) FROM documents
  UNION ALL SELECT 'source', count(source), arg_min(substr(source, 1, 80), doc_id) FILTER (WHERE source IS NOT NULL) FROM documents
  UNION ALL SELECT 'text', count(text), arg_min(substr(text, 1, 80), doc_id) FILTER (WHERE text IS NOT NULL) FROM documents
) USING (key)""")
def q_field_inventory(spark: SparkSession, sf: str) -> DataFrame:
    """A10: per column type, non-null count and a preview of the first value."""
    from paperlens.operators.annotations import field_inventory
    return field_inventory(read_table(spark, sf, "documents"), order_col="doc_id")


# ---------------------------------------------------------------- K1, K3, V6

def _tfidf_sql(docs_sql: str, n: int, max_features: int, part: str | None = None, result: str | None = None) -> str:
    """TF-IDF keywords in SQL (part = optional class column fitted separately)."""
    from paperlens.functions.text import TOKEN_PATTERN, english_stop_words
    sw = ", ".join(sql_str(w) for w in english_stop_words())
    p = part or "0"
    return f"""
WITH sw AS (SELECT unnest([{sw}]) AS w),
d AS (SELECT {p} AS part, doc_id, text FROM {docs_sql}),
t AS (SELECT part, doc_id, unnest(toks) AS tok, unnest(range(1, len(toks) + 1)) AS pos
      FROM (SELECT part, doc_id, regexp_extract_all(lower(coalesce(text, '')), {sql_str(TOKEN_PATTERN)})
            AS toks FROM d)),
f AS (SELECT part, doc_id, tok, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS p
      FROM t WHERE tok NOT IN (SELECT w FROM sw)),
terms AS (SELECT part, doc_id, tok AS term FROM f
          UNION ALL SELECT a.part, a.doc_id, a.tok || ' ' || b.tok FROM f a JOIN f b
          ON a.doc_id = b.doc_id AND b.p = a.p + 1),
tf AS (SELECT part, doc_id, term, count(*) AS tf FROM terms GROUP BY part, doc_id, term),
nd AS (SELECT part, count(*) AS n FROM d GROUP BY part),
st AS (SELECT part, term, sum(tf) AS cf, count(*) AS df FROM tf GROUP BY part, term),
voc AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY part ORDER BY cf DESC, term) AS r
        FROM st) WHERE r <= {max_features}),
w AS (SELECT tf.part, tf.doc_id, tf.term,
        (1 + ln(tf.tf)) * (ln((1.0 + nd.n) / (1.0 + voc.df)) + 1.0) AS w
      FROM tf JOIN voc ON tf.part = voc.part AND tf.term = voc.term JOIN nd ON nd.part = tf.part),
nw AS (SELECT part, doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY part, doc_id)) AS x FROM w),
sc AS (SELECT nw.part, term, sum(x) / min(nd.n) AS score FROM nw JOIN nd ON nd.part = nw.part
       GROUP BY nw.part, term),
rk AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY score DESC, term) AS rank FROM sc)
{result or f"SELECT part, rank, term, score FROM rk WHERE rank <= {n}"}"""


@register("tfidf_keywords", f"""
SELECT rank, term, round(score, 6) AS score FROM ({_tfidf_sql('documents', 50, 5000)})""")
def q_tfidf_keywords(spark: SparkSession, sf: str) -> DataFrame:
    """K1: top 50 TF-IDF keywords (1-2 grams, sublinear, 5000 features) of all documents."""
    from paperlens.operators.keywords import tfidf_keywords
    d = spread(read_table(spark, sf, "documents").select("doc_id", "text"))
    kw = tfidf_keywords(d, "text", "doc_id", 50, 5000)
    return kw.select(F.col("rank").cast("long").alias("rank"), "term", r6(F.col("score")).alias("score"))


KEYWORD_DOCS_SQL = f"(SELECT doc_id, label, text FROM {PREPROCESS_SQL} WHERE length(text) > 50)"


@register("keyword_compare", f"""
WITH k AS ({_tfidf_sql(KEYWORD_DOCS_SQL, 60, 5000, 'label')}),
pos AS (SELECT term, score AS pos_score FROM k WHERE part = 1 AND rank <= 30),
neg AS (SELECT term, score AS neg_score FROM k WHERE part = 0 AND rank <= 30)
SELECT CASE WHEN neg_score IS NULL THEN 'positive_distinctive'
            WHEN pos_score IS NULL THEN 'negative_distinctive' ELSE 'shared' END AS kind,
  coalesce(pos.term, neg.term) AS term, round(pos_score, 6) AS pos_score, round(neg_score, 6) AS neg_score
FROM pos FULL OUTER JOIN neg ON pos.term = neg.term""")
def q_keyword_compare(spark: SparkSession, sf: str) -> DataFrame:
    """K3 (+ U2, U3): per-class keywords on the combined text, distinctive and shared."""
    from paperlens.operators.keywords import compare_keywords
    p = preprocessed_articles(spark, sf).select("doc_id", "label", "text")
    out = compare_keywords(p, "label", "text", "doc_id", 30, 5000)
    return out.select("kind", "term", r6(F.col("pos_score")).alias("pos_score"),
                      r6(F.col("neg_score")).alias("neg_score"))


# ---------------------------------------------------------------- M6-M9, M11, M14, V4, V5

# rule-based scorers over the labelled documents: (model name, p1 expression)
SCORERS = [
    ("heuristic/length", "n_chars / (n_chars + 2000.0)"),
    ("heuristic/citations", "cited_by_count / 100.0"),
    ("heuristic/open_access", "CASE WHEN is_open_access THEN 0.9 ELSE 0.1 END"),
]

SCORED_SQL = "(" + " UNION ALL ".join(
    f"SELECT {sql_str(m)} AS model, {i} AS ord, label, CAST({e} AS DOUBLE) AS p1, "
    f"CASE WHEN CAST({e} AS DOUBLE) >= 0.5 THEN 1 ELSE 0 END AS prediction "
    f"FROM (SELECT a.*, d.n_chars FROM {LABELLED_ARTICLES_SQL} a JOIN documents d USING (doc_id))"
    for i, (m, e) in enumerate(SCORERS)) + ")"


def scored_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Every labelled document once for each scorer, from one pass over the tables."""
    a = documents_as_articles(spark, sf, labelled=True)
    each = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(i).alias("ord"),
                              F.expr(f"CAST({e} AS DOUBLE)").alias("p1")) for i, (m, e) in enumerate(SCORERS)])
    return a.select("label", F.explode(each).alias("s")).select(
        "s.model", "s.ord", "label", "s.p1", F.when(F.col("s.p1") >= 0.5, 1).otherwise(0).alias("prediction"))


def _eval_sql(scored: str = SCORED_SQL) -> str:
    return f"""
WITH s AS {scored},
c AS (SELECT model, min(ord) AS ord,
  count(*) FILTER (WHERE label = 0 AND prediction = 0) AS tn, count(*) FILTER (WHERE label = 0 AND prediction = 1) AS fp,
  count(*) FILTER (WHERE label = 1 AND prediction = 0) AS fn, count(*) FILTER (WHERE label = 1 AND prediction = 1) AS tp
  FROM s GROUP BY model),
per AS (SELECT model, p1, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg
        FROM s GROUP BY model, p1),
cum AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY model ORDER BY p1
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM per),
auc AS (SELECT model, sum(pos * (below + neg / 2.0)) / nullif(sum(pos) * sum(neg), 0) AS auc_roc
        FROM cum GROUP BY model)
SELECT c.*, CASE WHEN tp + tn + fp + fn = 0 THEN 0.0 ELSE (tp + tn) / (tp + tn + fp + fn) END AS accuracy,
  CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END AS precision,
  CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END AS recall,
  CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2 * tp / (2 * tp + fp + fn) END AS f1, auc.auc_roc
FROM c JOIN auc USING (model)"""


@register("evaluate_scorers", f"""
SELECT model, round(accuracy, 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall,
  round(f1, 6) AS f1, round(auc_roc, 6) AS auc_roc, tn, fp, fn, tp FROM ({_eval_sql()})""")
def q_evaluate_scorers(spark: SparkSession, sf: str) -> DataFrame:
    """M6, M7, M9: metrics, confusion counts and exact AUC per scorer."""
    from paperlens.operators.evaluation import evaluate
    e = evaluate(scored_rows(spark, sf), by=["model"])
    return e.select("model", *[r6(F.col(m)).alias(m) for m in
                               ("accuracy", "precision", "recall", "f1", "auc_roc")],
                    "tn", "fp", "fn", "tp")


@register("class_report", f"""
WITH c AS ({_eval_sql()}),
k AS (SELECT model, tn, fp, fn, tp, tn + fp + fn + tp AS n,
  CASE WHEN tn + fn = 0 THEN 0.0 ELSE tn / (tn + fn) END AS p0, CASE WHEN tn + fp = 0 THEN 0.0 ELSE tn / (tn + fp) END AS r0,
  CASE WHEN 2 * tn + fn + fp = 0 THEN 0.0 ELSE 2 * tn / (2 * tn + fn + fp) END AS f0,
  precision AS p1, recall AS r1, f1 AS f1_, accuracy, tn + fp AS s0, fn + tp AS s1 FROM c)
SELECT model, class, round(precision, 6) AS precision, round(recall, 6) AS recall,
  round(f1_score, 6) AS f1_score, support FROM (
  SELECT model, '0' AS class, p0 AS precision, r0 AS recall, f0 AS f1_score, s0 AS support FROM k
  UNION ALL SELECT model, '1', p1, r1, f1_, s1 FROM k
  UNION ALL SELECT model, 'accuracy', NULL, NULL, accuracy, n FROM k
  UNION ALL SELECT model, 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1_) / 2, n FROM k
  UNION ALL SELECT model, 'weighted avg', CASE WHEN n = 0 THEN 0.0 ELSE (p0 * s0 + p1 * s1) / n END,
    CASE WHEN n = 0 THEN 0.0 ELSE (r0 * s0 + r1 * s1) / n END,
    CASE WHEN n = 0 THEN 0.0 ELSE (f0 * s0 + f1_ * s1) / n END, n FROM k)""")
def q_class_report(spark: SparkSession, sf: str) -> DataFrame:
    """M8: classification report in long form per scorer."""
    from paperlens.operators.evaluation import classification_report
    r = classification_report(scored_rows(spark, sf), by=["model"])
    return r.select("model", "class", r6(F.col("precision")).alias("precision"),
                    r6(F.col("recall")).alias("recall"), r6(F.col("f1_score")).alias("f1_score"),
                    "support")


@register("model_compare", f"""
WITH c AS ({_eval_sql()}),
t AS (SELECT ord, 'TF-IDF + ' || split_part(model, '/', -1) AS model, 'baseline' AS type,
  accuracy, precision, recall, f1, auc_roc FROM c),
b AS (SELECT model FROM t ORDER BY f1 DESC, ord LIMIT 1)
SELECT t.model, type, round(accuracy, 6) AS accuracy, round(precision, 6) AS precision,
  round(recall, 6) AS recall, round(f1, 6) AS f1, round(coalesce(auc_roc, 0.0), 6) AS auc_roc,
  t.model = (SELECT model FROM b) AS is_best FROM t""")
def q_model_compare(spark: SparkSession, sf: str) -> DataFrame:
    """M11 + O5 + P12: comparison table (missing -> 0) and the best model by F1."""
    from paperlens.functions.coerce import baseline_model_label, short_model_name
    from paperlens.operators.evaluation import comparison_table, evaluate, is_best
    e = evaluate(scored_rows(spark, sf), by=["model", "ord"])
    res = e.select("ord", baseline_model_label(short_model_name("model")).alias("model"),
                   F.lit("baseline").alias("type"), "accuracy", "precision", "recall", "f1", "auc_roc")
    table = comparison_table(res)
    return table.select("model", "type", *[r6(F.col(m)).alias(m) for m in
                                           ("accuracy", "precision", "recall", "f1", "auc_roc")],
                        is_best().alias("is_best"))


@register("log_loss", f"""
SELECT model, round(avg(-ln(greatest(CASE WHEN label = 1 THEN p1 ELSE 1 - p1 END, 1e-15))), 6) AS loss
FROM {SCORED_SQL} GROUP BY model""")
def q_log_loss(spark: SparkSession, sf: str) -> DataFrame:
    """Mean per-row cross-entropy of the scored rows."""
    from paperlens.operators.evaluation import mean_log_loss
    return mean_log_loss(scored_rows(spark, sf), by=["model"]).withColumn("loss", r6(F.col("loss")))


@register("confusion_cells", f"""
WITH c AS ({_eval_sql()})
SELECT model, 0 AS true_label, 0 AS predicted_label, tn AS n FROM c
UNION ALL SELECT model, 0, 1, fp FROM c UNION ALL SELECT model, 1, 0, fn FROM c
UNION ALL SELECT model, 1, 1, tp FROM c""")
def q_confusion_cells(spark: SparkSession, sf: str) -> DataFrame:
    """V5: confusion-matrix cells per scorer."""
    from paperlens.operators.evaluation import confusion_cells, evaluate
    e = evaluate(scored_rows(spark, sf), by=["model"])
    return confusion_cells(e, ["model"])


@register("metrics_long", f"""
WITH c AS ({_eval_sql()})
SELECT model, metric_ord, metric, round(value, 6) AS value FROM (
  SELECT model, 0 AS metric_ord, 'accuracy' AS metric, accuracy AS value FROM c
  UNION ALL SELECT model, 1, 'precision', precision FROM c UNION ALL SELECT model, 2, 'recall', recall FROM c
  UNION ALL SELECT model, 3, 'f1', f1 FROM c UNION ALL SELECT model, 4, 'auc_roc', auc_roc FROM c)""")
def q_metrics_long(spark: SparkSession, sf: str) -> DataFrame:
    """V4: model x metric long table in fixed metric order."""
    from paperlens.operators.evaluation import evaluate, metrics_long
    e = evaluate(scored_rows(spark, sf), by=["model"])
    return metrics_long(e).withColumn("value", r6(F.col("value")))


@register("auc_many_scores", f"""
WITH per AS (SELECT score, count(*) FILTER (WHERE y = 1) AS pos, count(*) FILTER (WHERE y = 0) AS neg
  FROM (SELECT CAST(o_totalprice AS DOUBLE) AS score, CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END AS y
        FROM orders) GROUP BY score),
cum AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
        AS below FROM per)
SELECT round(sum(pos * (below + neg / 2.0)) / nullif(sum(pos) * sum(neg), 0), 6) AS auc_roc FROM cum""")
def q_auc_many_scores(spark: SparkSession, sf: str) -> DataFrame:
    """M9 / W5 over as many distinct scores as the orders have prices."""
    from paperlens.operators.evaluation import roc_auc
    o = read_table(spark, sf, "orders").select(
        F.col("o_totalprice").cast("double").alias("p1"), (F.col("o_orderstatus") == "O").cast("int").alias("label"))
    return roc_auc(o).select(r6(F.col("auc_roc")).alias("auc_roc"))


@register("best_epoch", f"""
WITH s AS (SELECT doc_id % 3 AS epoch, label, CASE WHEN n_chars / (n_chars + 2000.0) >= 0.5 THEN 1 ELSE 0 END AS p
  FROM {LABELLED_ARTICLES_SQL} JOIN (SELECT doc_id, n_chars FROM documents) USING (doc_id)),
e AS (SELECT epoch, count(*) FILTER (WHERE label = 1 AND p = 1) AS tp, count(*) FILTER (WHERE label = 0 AND p = 1) AS fp,
  count(*) FILTER (WHERE label = 1 AND p = 0) AS fn FROM s GROUP BY epoch),
h AS (SELECT epoch, CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2 * tp / (2 * tp + fp + fn) END AS val_f1 FROM e)
SELECT epoch, round(val_f1, 6) AS val_f1 FROM h WHERE val_f1 > 0 ORDER BY val_f1 DESC, epoch LIMIT 1""")
def q_best_epoch(spark: SparkSession, sf: str) -> DataFrame:
    """Three epochs (doc_id % 3) of one scorer, the one with the best F1."""
    from paperlens.operators.evaluation import best_epoch, evaluate
    a = documents_as_articles(spark, sf, labelled=True)
    p1 = F.col("n_chars") / (F.col("n_chars") + 2000.0)
    scored = a.select((F.col("doc_id") % 3).alias("epoch"), "label", p1.alias("p1"),
                      F.when(p1 >= 0.5, 1).otherwise(0).alias("prediction"))
    history = evaluate(scored, by=["epoch"]).select("epoch", F.col("f1").alias("val_f1"))
    return best_epoch(history).select("epoch", r6(F.col("val_f1")).alias("val_f1"))


# ---------------------------------------------------------------- S1-S7 on responses derived from the tables

def search_pages_from_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Search-response pages built from ``documents`` and passed through JSON
    text, as a landing job would store them: query = source, 100 results per
    page, optional fields left out (journal missing for every fifth document)."""
    from paperlens.schemas import SEARCH_RESPONSE_SCHEMA
    a = documents_as_articles(spark, sf)
    raw = F.struct(
        F.nullif(F.col("pmid"), F.lit("")).alias("pmid"), F.nullif(F.col("pmcid"), F.lit("")).alias("pmcid"),
        F.nullif(F.col("doi"), F.lit("")).alias("doi"), F.col("title").alias("title"),
        F.nullif(F.col("abstract"), F.lit("")).alias("abstractText"),
        F.when(F.col("doc_id") % 5 != 0, F.col("journal")).alias("journalTitle"),
        F.col("year").cast("string").alias("pubYear"),
        F.col("cited_by_count").cast("long").alias("citedByCount"),
        F.when(F.col("is_open_access"), F.lit("Y")).otherwise(F.lit("N")).alias("isOpenAccess"),
        F.lit("MED").alias("source"),
        F.struct(F.col("keywords").alias("keyword")).alias("keywordList"))
    # one page holds at most 100 results: a bounded group
    pages = (a.select(F.col("journal").alias("query"), (F.col("doc_id") / 100).cast("long").alias("page"),
                      F.struct(F.col("doc_id").alias("k"), raw.alias("r")).alias("e"))
             .groupBy("query", "page")
             .agg(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["r"]).alias("result")))
    js = pages.select(F.to_json(F.struct("query", "page", F.struct("result").alias("resultList")))
                      .alias("line"))
    return js.select(F.from_json("line", SEARCH_RESPONSE_SCHEMA).alias("p")).select("p.*")


@register("article_extract", f"""
SELECT query, pmid, doi, title, abstract, journal, year, cited_by_count, is_open_access,
  array_to_string(keywords, ',') AS keywords, first_pub_date
FROM (SELECT journal AS query, pmid, doi, title, abstract,
        CASE WHEN doc_id % 5 <> 0 THEN journal ELSE '' END AS journal,
        CAST(year AS VARCHAR) AS year, cited_by_count, is_open_access, keywords, '' AS first_pub_date,
        row_number() OVER (PARTITION BY journal ORDER BY doc_id) AS rn
      FROM {DOCUMENT_ARTICLES_SQL}) WHERE rn <= 40""")
def q_article_extract(spark: SparkSession, sf: str) -> DataFrame:
    """S1 + S2: landed pages -> results in page order, first 40 per query ->
    canonical fields with defaults for missing keys."""
    from paperlens.sources.landed import articles_from_pages
    arts = articles_from_pages(search_pages_from_documents(spark, sf), max_results=40)
    return arts.select("query", "pmid", "doi", "title", "abstract", "journal", "year",
                       "cited_by_count", "is_open_access",
                       F.array_join("keywords", ",").alias("keywords"), "first_pub_date")


@register("article_extract_all", f"""
SELECT journal AS query, pmid, doi, title, abstract,
  CASE WHEN doc_id % 5 <> 0 THEN journal ELSE '' END AS journal,
  CAST(year AS VARCHAR) AS year, cited_by_count, is_open_access,
  array_to_string(keywords, ',') AS keywords, '' AS first_pub_date
FROM {DOCUMENT_ARTICLES_SQL}""")
def q_article_extract_all(spark: SparkSession, sf: str) -> DataFrame:
    """S1 + S2 without a cap: every landed result."""
    from paperlens.sources.landed import articles_from_pages
    arts = articles_from_pages(search_pages_from_documents(spark, sf))
    return arts.select("query", "pmid", "doi", "title", "abstract", "journal", "year",
                       "cited_by_count", "is_open_access",
                       F.array_join("keywords", ",").alias("keywords"), "first_pub_date")


@register("lookup_by_doi", f"""
WITH ids AS (SELECT DISTINCT doi AS id FROM {LABELLED_ARTICLES_SQL} WHERE doi <> ''
             UNION SELECT 'doi-missing-' || CAST(doc_id AS VARCHAR) FROM labels WHERE toxic = 1),
a AS (SELECT doi, arg_min(doc_id, seq) AS doc_id FROM {DOCUMENT_ARTICLES_SQL} WHERE doi <> '' GROUP BY doi)
SELECT ids.id AS requested_id, a.doc_id FROM ids LEFT JOIN a ON a.doi = ids.id""")
def q_lookup_by_doi(spark: SparkSession, sf: str) -> DataFrame:
    """S3 in bulk (+ J6): first article per requested DOI, NULL when unknown."""
    from paperlens.sources.landed import lookup_by_id
    arts = documents_as_articles(spark, sf).select("doc_id", "seq", "doi")
    return lookup_by_id(arts, requested_dois(spark, sf), "doi", "id", ["seq"]).select("requested_id", "doc_id")


def requested_dois(spark: SparkSession, sf: str) -> DataFrame:
    """DOIs of the labelled articles, and some that no article has."""
    lab = documents_as_articles(spark, sf, labelled=True)
    return (lab.where(F.col("doi") != "").select(F.col("doi").alias("id"))
            .unionByName(read_table(spark, sf, "labels").where(F.col("toxic") == 1)
                         .select(F.concat(F.lit("doi-missing-"), F.col("doc_id").cast("string")).alias("id")))
            .distinct())


@register("lookup_indexed", ORACLES["lookup_by_doi"])
def q_lookup_indexed(spark: SparkSession, sf: str) -> DataFrame:
    """S3 + J6 by an index: the articles laid out by id once, then read by folder."""
    from paperlens.sources.id_index import lookup_indexed, write_id_index
    path = _scratch(spark, "id-index")
    write_id_index(documents_as_articles(spark, sf).select("doc_id", "seq", "doi"), path, "doi", ["seq"])
    ids = requested_dois(spark, sf)
    return lookup_indexed(spark, path, ids).select("requested_id", "doc_id")


def link_pages_from_documents(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    """Citation (``citations``) or reference (``references``) pages per document:
    document d is cited by d+1..d+3 and references d-1, d-2 (when >= 0)."""
    from paperlens.schemas import CITATIONS_RESPONSE_SCHEMA, REFERENCES_RESPONSE_SCHEMA
    d = read_table(spark, sf, "documents").select("doc_id", "source")
    offs = [1, 2, 3] if kind == "citations" else [-1, -2]
    ent = lambda k: F.when(F.col("doc_id") + k >= 0, F.struct(
        (F.col("doc_id") + k).cast("string").alias("id"), F.lit("MED").alias("source"),
        F.concat(F.lit("linked "), (F.col("doc_id") + k).cast("string")).alias("title")))
    arr = F.filter(F.array(*[ent(k) for k in offs]), lambda x: x.isNotNull())
    lst, item = ("citationList", "citation") if kind == "citations" else ("referenceList", "reference")
    schema = CITATIONS_RESPONSE_SCHEMA if kind == "citations" else REFERENCES_RESPONSE_SCHEMA
    js = d.select(F.to_json(F.struct(F.col("doc_id").cast("string").alias("article_id"),
                                     F.lit("MED").alias("article_source"), F.lit(1).alias("page"),
                                     F.struct(arr.alias(item)).alias(lst))).alias("line"))
    return js.select(F.from_json("line", schema).alias("p")).select("p.*")


@register("citation_edges", """
SELECT CAST(doc_id AS VARCHAR) AS article_id, 'cited_by' AS direction, CAST(doc_id + k AS VARCHAR) AS other_id
FROM documents, (SELECT unnest([1, 2]) AS k)
UNION ALL
SELECT CAST(doc_id AS VARCHAR), 'references', CAST(doc_id + k AS VARCHAR)
FROM documents, (SELECT unnest([-1, -2]) AS k) WHERE doc_id + k >= 0""")
def q_citation_edges(spark: SparkSession, sf: str) -> DataFrame:
    """S4 + S5: flattened citation (first 2 per article) and reference edges."""
    from paperlens.sources.landed import citation_edges, reference_edges
    c = citation_edges(link_pages_from_documents(spark, sf, "citations"), max_results=2)
    r = reference_edges(link_pages_from_documents(spark, sf, "references"), max_results=None)
    return c.unionByName(r).select("article_id", "direction", "other_id")


@register("citation_edges_all", """
SELECT CAST(doc_id AS VARCHAR) AS article_id, 'cited_by' AS direction, CAST(doc_id + k AS VARCHAR) AS other_id
FROM documents, (SELECT unnest([1, 2, 3]) AS k)
UNION ALL
SELECT CAST(doc_id AS VARCHAR), 'references', CAST(doc_id + k AS VARCHAR)
FROM documents, (SELECT unnest([-1, -2]) AS k) WHERE doc_id + k >= 0""")
def q_citation_edges_all(spark: SparkSession, sf: str) -> DataFrame:
    """S4 + S5 without a cap."""
    from paperlens.sources.landed import citation_edges, reference_edges
    c = citation_edges(link_pages_from_documents(spark, sf, "citations"))
    r = reference_edges(link_pages_from_documents(spark, sf, "references"))
    return c.unionByName(r).select("article_id", "direction", "other_id")


def annotation_records_from_events(spark: SparkSession, sf: str) -> DataFrame:
    """Annotation records built from ``events``: one record per user and block
    of 50 event ids (a bounded list), annotations in event order."""
    from paperlens.schemas import ANNOTATION_RECORD_SCHEMA
    e = read_table(spark, sf, "events")
    ann = F.struct(F.col("event_id").alias("k"), F.struct(
        F.col("event_type").alias("type"), F.col("props").alias("exact"),
        F.concat(F.lit("evt-"), F.col("event_id").cast("string")).alias("prefix")).alias("a"))
    rec = (e.groupBy("user_id", (F.col("event_id") / 50).cast("long").alias("blk"))
           .agg(F.transform(F.array_sort(F.collect_list(ann)), lambda x: x["a"]).alias("annotations")))
    js = rec.select(F.to_json(F.struct(F.lit("MED").alias("source"),
                                       F.col("user_id").cast("string").alias("extId"),
                                       "annotations")).alias("line"))
    return js.select(F.from_json("line", ANNOTATION_RECORD_SCHEMA).alias("p")).select("p.*")


@register("annotation_lookup", """
SELECT CAST(user_id AS VARCHAR) AS ext_id, event_type AS type, props AS exact,
  'evt-' || CAST(event_id AS VARCHAR) AS prefix
FROM events WHERE event_type = 'error'
  AND user_id IN (SELECT user_id FROM events WHERE event_type = 'purchase')""")
def q_annotation_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """S6 (+ J6 semi join): annotations of the requested ids, filtered by type."""
    from paperlens.sources.landed import annotations
    recs = annotation_records_from_events(spark, sf)
    ids = (read_table(spark, sf, "events").where(F.col("event_type") == "purchase")
           .select(F.col("user_id").cast("string").alias("id")))
    out = annotations(recs, ids, "id", annotation_type="error")
    return out.select(F.col("extId").alias("ext_id"), "type", "exact", "prefix")


@register("rule_hit_counts", f"""
SELECT rule_ord, query, count(*) AS hit_count FROM ({_rules_union_sql(DOCUMENT_ARTICLES_SQL, None)})
GROUP BY rule_ord, query""")
def q_rule_hit_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Hit count of every rule without materialising the hits (one pass)."""
    from paperlens.functions.rules import rule_column
    a = documents_as_articles(spark, sf)
    lt = F.lower(F.concat(F.col("title"), F.lit(" "), F.col("abstract")))
    one = a.agg(*[F.count_if(rule_column(r.rule, lt)).alias(f"c{i}") for i, r in enumerate(PROSE_RULES)])
    rows = F.array(*[F.struct(F.lit(i).alias("rule_ord"), F.lit(r.name).alias("query"),
                              F.col(f"c{i}").alias("hit_count")) for i, r in enumerate(PROSE_RULES)])
    return one.select(F.explode(rows).alias("r")).select("r.*").where(F.col("hit_count") > 0)


# ---------------------------------------------------------------- M1-M5, M10, M12, M13 (rows-only)

def _ml_splits(spark: SparkSession, sf: str) -> DataFrame:
    """Splits of the articles, written once: fits read them several times, and so do evaluations."""
    from paperlens.operators.curate import create_splits
    from paperlens.session import stored
    p = preprocessed_articles(spark, sf).select("doc_id", "label", "text")
    return stored(create_splits(p, 0.7, 0.15, 0.15, seed=42, stratify=True), "splits")


def _model_eval(spark: SparkSession, sf: str, name: str) -> DataFrame:
    from paperlens.operators.classifiers import BaselineClassifier
    sp = _ml_splits(spark, sf)
    clf = BaselineClassifier(name).fit(sp.where(F.col("split") == "train"))
    ev = [clf.evaluate(sp.where(F.col("split") == s), split=s) for s in ("val", "test")]
    return ev[0].unionByName(ev[1]).drop("confusion_matrix")


@register("logreg_eval")
def q_logreg_eval(spark: SparkSession, sf: str) -> DataFrame:
    """M1, M2, M5, M6: TF-IDF + logistic regression, val and test metrics."""
    return _model_eval(spark, sf, "logistic_regression")


@register("svm_eval")
def q_svm_eval(spark: SparkSession, sf: str) -> DataFrame:
    """M1, M3, M5, M6: TF-IDF + calibrated linear SVM (3 folds)."""
    return _model_eval(spark, sf, "svm")


@register("forest_eval")
def q_forest_eval(spark: SparkSession, sf: str) -> DataFrame:
    """M1, M4, M5, M6: TF-IDF + random forest (200 trees)."""
    return _model_eval(spark, sf, "random_forest")


@register("top_features")
def q_top_features(spark: SparkSession, sf: str) -> DataFrame:
    """15 strongest features per class of the logistic regression, rounded to 4."""
    from paperlens.operators.classifiers import BaselineClassifier
    sp = _ml_splits(spark, sf)
    clf = BaselineClassifier("logistic_regression").fit(sp.where(F.col("split") == "train"))
    return clf.top_features(15).withColumn("value", F.round("value", 4))


LOGIT_SCORED_SQL = f"""(
  SELECT 'm' AS model, 0 AS ord, label, p1, CASE WHEN p1 > 1 - p1 THEN 1 ELSE 0 END AS prediction
  FROM (SELECT label, 1 / (1 + exp(-(1.5 * ln(1 + length(text)) - 11.0))) AS p1
        FROM {PREPROCESS_SQL} WHERE length(text) > 50))"""


@register("batch_score", f"""
SELECT round(accuracy, 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall,
  round(f1, 6) AS f1, round(auc_roc, 6) AS auc_roc, tn, fp, fn, tp,
  (SELECT round(avg(-ln(greatest(CASE WHEN label = 1 THEN p1 ELSE 1 - p1 END, 1e-15))), 6) FROM {LOGIT_SCORED_SQL}) AS loss
FROM ({_eval_sql(LOGIT_SCORED_SQL)})""")
def q_batch_score(spark: SparkSession, sf: str) -> DataFrame:
    """M13 + M6 + M14: Arrow-batched scoring with a user model, then evaluation."""
    from paperlens.operators.evaluation import evaluate, mean_log_loss
    from paperlens.operators.scoring import batch_score, length_logit_model
    p = preprocessed_articles(spark, sf).select("doc_id", "label", "text")
    from paperlens.session import cut_lineage
    scored = cut_lineage(batch_score(p, length_logit_model(), "text").select("label", "prediction", "p1"))
    ev = evaluate(scored).crossJoin(mean_log_loss(scored))  # one row each
    return ev.select(*[r6(F.col(m)).alias(m) for m in ("accuracy", "precision", "recall", "f1", "auc_roc")],
                     "tn", "fp", "fn", "tp", r6(F.col("loss")).alias("loss"))


_BENCHMARK_DOCS_SQL = "(SELECT item_id AS doc_id, text FROM benchmark)"


@register("feature_vectors", _tfidf_sql(
    _BENCHMARK_DOCS_SQL, 0, 1 << 18, result="SELECT doc_id AS item_id, term, round(x, 6) AS weight FROM nw"))
def q_feature_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """M1: every stored value of the classifiers' TF-IDF vectors, fitted on the benchmark texts."""
    from paperlens.operators.classifiers import fit_features, vocabulary
    d = read_table(spark, sf, "benchmark").select("item_id", "text")
    features = fit_features(d, "text", 1 << 18)
    terms = spark.createDataFrame(list(enumerate(vocabulary(features))), "i int, term string")
    u = F.unwrap_udt("features")
    each = features.transform(d).select("item_id", F.explode_outer(
        F.arrays_zip(u.getField("indices").alias("i"), u.getField("values").alias("weight"))).alias("e"))
    return (each.select("item_id", "e.i", "e.weight").join(F.broadcast(terms), "i")
            .select("item_id", "term", r6(F.col("weight")).alias("weight")))


@register("logreg_certificate", f"""
SELECT count(*) FILTER (WHERE split = 'train') AS n_train, true AS is_optimal FROM (
  SELECT split FROM ({SPLIT_SQL.replace(LABELLED_ARTICLES_SQL, f"(SELECT * FROM {PREPROCESS_SQL} WHERE length(text) > 50)")}))""")
def q_logreg_certificate(spark: SparkSession, sf: str) -> DataFrame:
    """M2: the gradient of the regularised log loss at the fitted coefficients, by one
    aggregation, is within the optimiser's tolerance of zero."""
    from paperlens.operators.classifiers import LR_TOL, BaselineClassifier, fit_features, gradient_norm
    from paperlens.session import stored
    train = _ml_splits(spark, sf).where(F.col("split") == "train")
    features = fit_features(train)
    table = stored(features.transform(train).select("doc_id", "label", "features"), "features")
    clf = BaselineClassifier().fit_vectors(features, table)
    norm, n = gradient_norm(clf, table)
    return spark.range(1).select(F.lit(n).cast("long").alias("n_train"), F.lit(norm <= LR_TOL).alias("is_optimal"))


_ML_SPLIT_SQL = SPLIT_SQL.replace(LABELLED_ARTICLES_SQL, f"(SELECT * FROM {PREPROCESS_SQL} WHERE length(text) > 50)")


@register("svm_certificate", f"""
WITH c AS (SELECT label, count(*) AS n FROM {_ML_SPLIT_SQL} WHERE split = 'train' GROUP BY label),
f AS (SELECT k AS fold, n - (CAST(floor(n * (k + 1) / 3) AS BIGINT) - CAST(floor(n * k / 3) AS BIGINT)) AS n
  FROM c, (SELECT unnest([0, 1, 2]) AS k))
SELECT CAST(fold AS INTEGER) AS fold, CAST(sum(n) AS BIGINT) AS n_train, true AS is_optimal FROM f GROUP BY fold""")
def q_svm_certificate(spark: SparkSession, sf: str) -> DataFrame:
    """M3: for each fold's SVM, the bound of the distance to the optimum, half the squared
    gradient at the fitted weights, is within the tolerance; sums by SQL functions."""
    from paperlens.operators.classifiers import SVM_TOL, BaselineClassifier, fit_features, svm_certificates
    from paperlens.session import stored
    train = _ml_splits(spark, sf).where(F.col("split") == "train")
    features = fit_features(train)
    table = stored(features.transform(train).select("doc_id", "label", "features"), "features")
    clf = BaselineClassifier("svm").fit_vectors(features, table)
    # one row a fold; the last digits of sums depend on their order
    rows = [(k, n, gap <= SVM_TOL * value * (1 + 1e-6)) for k, (n, value, gap) in enumerate(svm_certificates(clf, table))]
    return spark.createDataFrame(rows, "fold int, n_train long, is_optimal boolean")


@register("forest_votes", f"""
SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS n_changed FROM {PREPROCESS_SQL} WHERE length(text) > 50""")
def q_forest_votes(spark: SparkSession, sf: str) -> DataFrame:
    """M4: the class shares that the saved trees give each row, walked node by node, are the forest's."""
    from paperlens.operators.classifiers import BaselineClassifier, fit_features, forest_shares
    from paperlens.session import stored
    sp = _ml_splits(spark, sf)
    features = fit_features(sp.where(F.col("split") == "train"))
    table = stored(features.transform(sp).select("doc_id", "label", "split", "features"), "features")
    clf = BaselineClassifier("random_forest", num_trees=20).fit_vectors(features, table.where(F.col("split") == "train"))
    walked = forest_shares(table, f"{clf.save(_scratch(spark, 'forest'))}/model", "doc_id")
    both = clf.predict_proba(table).select("doc_id", "p1").join(walked, "doc_id")
    return both.agg(F.count("*").alias("n_rows"), F.count_if(F.abs(F.col("p1") - F.col("share")) > 1e-9).alias("n_changed"))


@register("saved_model", f"""
SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS n_changed FROM {PREPROCESS_SQL} WHERE length(text) > 50""")
def q_saved_model(spark: SparkSession, sf: str) -> DataFrame:
    """S15 + X2: a fitted classifier, saved and loaded, predicts the same for every row."""
    from paperlens.operators.classifiers import BaselineClassifier
    sp = _ml_splits(spark, sf)
    clf = BaselineClassifier("logistic_regression", max_features=2000).fit(sp.where(F.col("split") == "train"))
    loaded = BaselineClassifier.load(clf.save(_scratch(spark, "model")))
    a, b = (c.predict_proba(sp).select("doc_id", F.struct("prediction", "p1").alias(x))
            for c, x in ((clf, "a"), (loaded, "b")))
    return a.join(b, "doc_id").agg(F.count("*").alias("n_rows"), F.count_if(F.col("a") != F.col("b")).alias("n_changed"))


# ---------------------------------------------------------------- S8-S14, written and read again

def _scratch(spark: SparkSession, what: str) -> str:
    """A new path in the folder that all executors share."""
    import uuid

    from paperlens.session import ensure_checkpoint_dir
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


_CSV_COLUMNS = "doc_id, title, abstract, journal, year"


@register("articles_csv", f"SELECT {_CSV_COLUMNS} FROM {DOCUMENT_ARTICLES_SQL}")
def q_articles_csv(spark: SparkSession, sf: str) -> DataFrame:
    """Articles to CSV and back; quotes, line breaks, empty texts and nulls stay."""
    from paperlens.sources.files import read_articles_csv, write_articles_csv
    path = _scratch(spark, "articles")
    a = documents_as_articles(spark, sf).select(*_CSV_COLUMNS.split(", "))
    write_articles_csv(a, path)
    return read_articles_csv(spark, path, a.schema)


@register("splits_saved", f"SELECT doc_id, label, split FROM {SPLIT_SQL}")
def q_splits_saved(spark: SparkSession, sf: str) -> DataFrame:
    """S9 + S10: splits to folders and back."""
    from paperlens.sources.files import load_splits, save_splits
    path = _scratch(spark, "splits")
    save_splits(labelled_splits(spark, sf).select("doc_id", "label", "split"), path)
    return load_splits(spark, path).select("doc_id", "label", "split")


@register("dictionary_saved", f"""
WITH d AS {DEDUP_TERMS_SQL} SELECT d.category, d.cat_ord, d.ord, d.term, count(a.doc_id) AS n_docs
FROM d LEFT JOIN (SELECT doc_id, lower(title || ' ' || abstract) AS lt FROM {DOCUMENT_ARTICLES_SQL}) a
  ON length(d.term) > 4 AND contains(a.lt, lower(d.term)) OR length(d.term) <= 4 AND regexp_matches(a.lt, d.pat)
GROUP BY ALL""")
def q_dictionary_saved(spark: SparkSession, sf: str) -> DataFrame:
    """S11 + S12: the built dictionary to a file and back, matched from there."""
    from paperlens.operators.dictionary import build_dictionary, load_dictionary, save_dictionary
    from paperlens.operators.matching import match_article_text
    from paperlens.operators.term_index import index_matches
    path = _scratch(spark, "dictionary")
    save_dictionary(build_dictionary(spark), path)
    d = load_dictionary(spark, path)
    a = documents_as_articles(spark, sf).select("doc_id", match_article_text().alias("text"))
    n = index_matches(a, d).groupBy("category", "ord").agg(F.count("*").alias("n"))
    return d.join(n, ["category", "ord"], "left").select(
        "category", "cat_ord", "ord", "term", F.coalesce("n", F.lit(0)).alias("n_docs"))


@register("dictionary_index", f"""
WITH c AS (SELECT regexp_extract_all(lower(text), '[a-zà-ÿ]+') AS w FROM conversations),
d AS (SELECT DISTINCT 'word' AS category, unnest(w) AS term FROM c
  UNION ALL SELECT * FROM (SELECT DISTINCT 'pair', unnest(list_transform(
    range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS term FROM c) WHERE length(term) > 4),
a AS (SELECT doc_id, lower(title || ' ' || abstract) AS lt FROM {DOCUMENT_ARTICLES_SQL}),
t AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lt, '[\\p{{L}}\\p{{N}}_]+')) AS w FROM a)
SELECT category, term, count(*) AS n_docs FROM d JOIN a ON contains(a.lt, d.term) WHERE length(term) > 4 GROUP BY ALL
UNION ALL SELECT category, term, count(*) FROM d JOIN t ON t.w = d.term WHERE length(term) <= 4 GROUP BY ALL""")
def q_dictionary_index(spark: SparkSession, sf: str) -> DataFrame:
    """T7, J1 with a dictionary that is a table of all words, and word pairs of more than four
    characters, of the conversations (tens of thousands): documents of each term that occurs."""
    from paperlens.operators.matching import match_article_text
    from paperlens.operators.term_index import index_matches
    c = read_table(spark, sf, "conversations").select(
        F.regexp_extract_all(F.lower("text"), F.lit("[a-zà-ÿ]+"), 0).alias("w"))
    pairs = F.transform(F.slice("w", 2, F.greatest(F.size("w"), F.lit(1))), lambda x, i: F.concat(F.get("w", i), F.lit(" "), x))
    d = (c.select(F.lit("word").alias("category"), F.lit(0).alias("cat_ord"), F.explode("w").alias("term"))
         .union(c.select(F.lit("pair"), F.lit(1), F.explode(pairs).alias("term")).where(F.char_length("term") > 4))
         .distinct().withColumn("ord", F.lit(0)))
    a = documents_as_articles(spark, sf).select("doc_id", match_article_text().alias("text"))
    return index_matches(a, d).groupBy("category", "term").agg(F.count("*").alias("n_docs"))


@register("model_results", f"""
SELECT 'TF-IDF + ' || model AS model, 'baseline' AS type, round(accuracy, 6) AS accuracy,
  round(f1, 6) AS f1, round(auc_roc, 6) AS auc_roc FROM ({_eval_sql()})""")
def q_model_results(spark: SparkSession, sf: str) -> DataFrame:
    """A report file of several models' test metrics, written and loaded."""
    from paperlens.operators.evaluation import evaluate
    from paperlens.sources.files import load_model_results
    path = _scratch(spark, "results")
    e = evaluate(scored_rows(spark, sf), by=["model", "ord"])
    test = F.struct(F.struct("accuracy", "precision", "recall", "f1", "auc_roc").alias("test"))
    one = e.agg(F.map_from_entries(F.transform(  # a row a model
        F.array_sort(F.collect_list(F.struct("ord", "model", test.alias("r")))),
        lambda x: F.struct(x["model"], x["r"]))).alias("m"))
    one.select(F.to_json("m")).coalesce(1).write.text(path)
    return load_model_results(spark, path, None).select(
        "model", "type", *[r6(F.col(m)).alias(m) for m in ("accuracy", "f1", "auc_roc")])


@register("analysis_report", f"""
WITH p AS (SELECT * FROM {PREPROCESS_SQL} WHERE length(text) > 50)
SELECT count(*) AS total, count(*) FILTER (WHERE label = 1) AS positive, count(*) FILTER (WHERE label = 0) AS negative,
  (SELECT CAST(sum(cited_by_count) AS BIGINT) FROM p WHERE label = 1) AS total_citations,
  (SELECT median(cited_by_count) FROM p WHERE label = 1) AS median_citations,
  (SELECT count(DISTINCT year) FROM p WHERE label = 1) AS n_years,
  least(30, {{positive}}) AS n_positive, least(30, {{negative}}) AS n_negative FROM p""".replace(
    "least(30, {positive})", "30").replace("least(30, {negative})", "30"))
def q_analysis_report(spark: SparkSession, sf: str) -> DataFrame:
    """The full report over the prepared splits, written as JSON and read again."""
    from paperlens.operators.curate import create_splits
    from paperlens.plans.pipelines import analysis_report
    from paperlens.session import stored
    from paperlens.sources.files import write_report
    splits = stored(create_splits(preprocessed_articles(spark, sf), 0.7, 0.15, 0.15, seed=42, stratify=True), "prepared")
    path = _scratch(spark, "report")
    write_report(analysis_report(splits), path)
    r = spark.read.json(path)
    of = F.col("impact_metrics.citations")
    return r.select("dataset.total", "dataset.positive", "dataset.negative", of["total_citations"].alias("total_citations"),
                    of["median_citations"].cast("double").alias("median_citations"),
                    F.size("impact_metrics.yearly_stats").cast("long").alias("n_years"),
                    F.size("top_keywords_positive").alias("n_positive"), F.size("top_keywords_negative").alias("n_negative"))


# ---------------------------------------------------------------- V3, V6

@register("word_frequencies", f"""
SELECT term, round(score, 6) AS score FROM ({_tfidf_sql('documents', 100, 5000)})""")
def q_word_frequencies(spark: SparkSession, sf: str) -> DataFrame:
    """V6: at most 100 (word, weight) pairs for a word cloud."""
    from paperlens.operators.keywords import word_frequencies
    d = spread(read_table(spark, sf, "documents").select("doc_id", "text"))
    return word_frequencies(d, "text", "doc_id", 100, 5000).withColumn("score", r6(F.col("score")))


@register("top_journals_chart", f"""
WITH per AS (SELECT journal, count(*) AS count, min(seq) AS first_seen FROM {ORDER_ARTICLES_SQL}
             WHERE journal IS NOT NULL AND journal <> '' GROUP BY journal),
top AS (SELECT *, row_number() OVER (ORDER BY count DESC, first_seen) AS rank FROM per)
SELECT CAST(16 - rank AS INTEGER) AS bar, substr(journal, 1, 40) AS label, count FROM top WHERE rank <= 15""")
def q_top_journals_chart(spark: SparkSession, sf: str) -> DataFrame:
    """V3 (+ A2, P13): top journals, labels cut to 40 characters, bars in reverse order."""
    from paperlens.functions.coerce import truncate_label
    from paperlens.operators.impact import journal_spread
    j = journal_spread(orders_as_articles(spark, sf), 15)
    return j.select((F.lit(16) - F.col("rank")).cast("int").alias("bar"),
                    truncate_label("journal", 40).alias("label"), "count").orderBy("bar")
