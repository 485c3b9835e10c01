"""Explicit schemas: canonical article record and landed response payloads."""

from __future__ import annotations

from pyspark.sql import types as T

S, L, B, I = T.StringType(), T.LongType(), T.BooleanType(), T.IntegerType()

# canonical article (16 fields) + collection columns
ARTICLE_FIELDS = [
    ("pmid", S), ("pmcid", S), ("doi", S), ("title", S), ("abstract", S),
    ("journal", S), ("year", S), ("authors", S), ("affiliation", S),
    ("cited_by_count", L), ("is_open_access", B), ("source", S),
    ("pub_type", T.ArrayType(S)), ("keywords", T.ArrayType(S)),
    ("first_pub_date", S), ("full_text_available", B),
]
ARTICLE_SCHEMA = T.StructType([T.StructField(n, t, True) for n, t in ARTICLE_FIELDS])
LABELLED_ARTICLE_SCHEMA = T.StructType(
    ARTICLE_SCHEMA.fields + [T.StructField("label", I, True), T.StructField("query", S, True)])

# one raw search result as the remote service returns it; every field optional
RAW_RESULT_SCHEMA = T.StructType([
    T.StructField("id", S), T.StructField("pmid", S), T.StructField("pmcid", S),
    T.StructField("doi", S), T.StructField("title", S), T.StructField("abstractText", S),
    T.StructField("journalTitle", S), T.StructField("pubYear", S),
    T.StructField("authorString", S), T.StructField("affiliation", S),
    T.StructField("citedByCount", L), T.StructField("isOpenAccess", S),
    T.StructField("source", S),
    T.StructField("pubTypeList", T.StructType([T.StructField("pubType", T.ArrayType(S))])),
    T.StructField("keywordList", T.StructType([T.StructField("keyword", T.ArrayType(S))])),
    T.StructField("firstPublicationDate", S), T.StructField("hasTextMinedTerms", S),
])

# one landed search-response page
SEARCH_RESPONSE_SCHEMA = T.StructType([
    T.StructField("query", S),          # written by the landing job next to the payload
    T.StructField("page", L),
    T.StructField("hitCount", L),
    T.StructField("nextCursorMark", S),
    T.StructField("resultList", T.StructType([
        T.StructField("result", T.ArrayType(RAW_RESULT_SCHEMA))])),
])

# citing / referenced article entries
LINKED_ARTICLE_SCHEMA = T.StructType([
    T.StructField("id", S), T.StructField("source", S), T.StructField("title", S),
    T.StructField("authorString", S), T.StructField("journalAbbreviation", S),
    T.StructField("pubYear", L), T.StructField("citedByCount", L),
])
CITATIONS_RESPONSE_SCHEMA = T.StructType([
    T.StructField("article_id", S), T.StructField("article_source", S),
    T.StructField("page", L), T.StructField("hitCount", L),
    T.StructField("citationList", T.StructType([
        T.StructField("citation", T.ArrayType(LINKED_ARTICLE_SCHEMA))])),
])
REFERENCES_RESPONSE_SCHEMA = T.StructType([
    T.StructField("article_id", S), T.StructField("article_source", S),
    T.StructField("page", L), T.StructField("hitCount", L),
    T.StructField("referenceList", T.StructType([
        T.StructField("reference", T.ArrayType(LINKED_ARTICLE_SCHEMA))])),
])

ANNOTATION_SCHEMA = T.StructType([
    T.StructField("type", S), T.StructField("exact", S), T.StructField("prefix", S),
    T.StructField("postfix", S), T.StructField("name", S),
])
ANNOTATION_RECORD_SCHEMA = T.StructType([
    T.StructField("source", S), T.StructField("extId", S), T.StructField("pmcid", S),
    T.StructField("annotations", T.ArrayType(ANNOTATION_SCHEMA)),
])

DICTIONARY_FILE_SCHEMA = T.StructType([
    T.StructField("metadata", T.StructType([
        T.StructField("build_date", S),
        T.StructField("sources", T.ArrayType(S)),
        T.StructField("total_terms", L),
        T.StructField("terms_per_category", T.MapType(S, L)),
    ])),
    T.StructField("dictionary", T.MapType(S, T.ArrayType(S))),
])
