"""Landed service responses.

The remote search service is not called from Spark: responses are landed as
JSON files (one response page per line, or one per file with ``multiLine``)
and read with explicit schemas. Everything after the read is DataFrame work:
``posexplode`` of the result arrays, field extraction with defaults, caps per
query / article as a top-n per group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperlens.schemas import (
    ANNOTATION_RECORD_SCHEMA, CITATIONS_RESPONSE_SCHEMA, REFERENCES_RESPONSE_SCHEMA,
    SEARCH_RESPONSE_SCHEMA)


def read_search_pages(spark: SparkSession, path: str | Sequence[str],
                      multiline: bool = False) -> DataFrame:
    """Landed search responses: ``(query, page, hitCount, nextCursorMark, resultList)``."""
    return spark.read.schema(SEARCH_RESPONSE_SCHEMA).option("multiLine", multiline).json(path)


def search_results(pages: DataFrame, max_results: int | None = None) -> DataFrame:
    """One row per result in (page, position) order, at most ``max_results``
    per query if given; pages with an empty result list contribute nothing.

    Output: ``query, page, pos, raw`` (raw = the nested result struct).
    """
    return _first_of_lists(pages, ["query"], "resultList.result", max_results, "raw")


def _first_of_lists(pages: DataFrame, by: Sequence[str], list_col: str, cap: int | None,
                    out: str) -> DataFrame:
    """Elements of each page's list as rows ``(by, page, pos, out)``; with a cap, the first
    of each ``by`` in page order. How much of a page is left under the cap follows from the
    sizes of the pages before it: one small row a page is ranked, and no record moves for it.
    (``by``, ``page``) identifies a page; pages repeated under one number share its cap."""
    items = F.col(list_col)
    if cap is None:
        return pages.select(*by, "page", F.posexplode(items).alias("pos", out))
    sizes = (pages.groupBy(*by, "page")
             .agg(F.max(F.greatest(F.size(items), F.lit(0))).alias("n")))
    w = Window.partitionBy(*by).orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    room = sizes.select(*[F.col(c).alias(f"__{c}") for c in (*by, "page")],
                        (F.lit(cap) - F.coalesce(F.sum("n").over(w), F.lit(0))).alias("__room"))
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in (*by, "page")]
    first = F.slice(items, F.lit(1), F.col("__room").cast("int"))
    return (pages.join(room.where("__room > 0"), same)
            .select(*by, "page", F.posexplode(first).alias("pos", out)))


def _s(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def extract_metadata(raw: Column | str = "raw", journal_paths: Sequence[str] = ("journalTitle",)
                     ) -> list[Column]:
    """The 16 canonical fields of a raw result; missing -> default."""
    r = F.col(raw) if isinstance(raw, str) else raw
    journal = F.coalesce(*[r.getField(p) for p in journal_paths], F.lit(""))
    return [
        _s(r["pmid"]).alias("pmid"), _s(r["pmcid"]).alias("pmcid"), _s(r["doi"]).alias("doi"),
        _s(r["title"]).alias("title"), _s(r["abstractText"]).alias("abstract"),
        journal.alias("journal"), _s(r["pubYear"]).alias("year"),
        _s(r["authorString"]).alias("authors"), _s(r["affiliation"]).alias("affiliation"),
        F.coalesce(r["citedByCount"], F.lit(0).cast("long")).alias("cited_by_count"),
        F.coalesce(r["isOpenAccess"] == "Y", F.lit(False)).alias("is_open_access"),
        _s(r["source"]).alias("source"),
        F.coalesce(r["pubTypeList"]["pubType"], F.array().cast("array<string>")).alias("pub_type"),
        F.coalesce(r["keywordList"]["keyword"], F.array().cast("array<string>")).alias("keywords"),
        _s(r["firstPublicationDate"]).alias("first_pub_date"),
        F.coalesce(r["hasTextMinedTerms"] == "Y", F.lit(False)).alias("full_text_available"),
    ]


def articles_from_pages(pages: DataFrame, max_results: int | None = None) -> DataFrame:
    """S1 + S2: canonical articles with ``query, page, pos`` kept for ordering."""
    res = search_results(pages, max_results)
    return res.select("query", "page", "pos", *extract_metadata("raw"))


def lookup_by_id(articles: DataFrame, ids: DataFrame, key: str = "doi",
                 id_col: str = "id", order_cols: Sequence[str] = ("query", "page", "pos")
                 ) -> DataFrame:
    """S3 in bulk: for each requested id the first matching article, or NULLs.

    ``ids`` is a one-column table of identifiers; a left join keeps ids
    without a match (the single lookup's ``None``).
    """
    m = articles.where(F.col(key) != "").withColumn("__id", F.col(key))
    first = (m.groupBy("__id")
             .agg(F.min_by(F.struct(*[F.col(c) for c in articles.columns]),
                           F.struct(*[F.col(c) for c in order_cols])).alias("a")))
    return (ids.select(F.col(id_col).alias("__id")).join(first, "__id", "left")
            .select(F.col("__id").alias("requested_id"), "a.*"))


def read_citation_pages(spark: SparkSession, path, multiline: bool = False) -> DataFrame:
    return spark.read.schema(CITATIONS_RESPONSE_SCHEMA).option("multiLine", multiline).json(path)


def read_reference_pages(spark: SparkSession, path, multiline: bool = False) -> DataFrame:
    return spark.read.schema(REFERENCES_RESPONSE_SCHEMA).option("multiLine", multiline).json(path)


def _edges(pages: DataFrame, list_col: str, direction: str, max_results: int | None) -> DataFrame:
    rows = _first_of_lists(pages, ["article_id", "article_source"], list_col, max_results, "e")
    return rows.select("article_id", "article_source", F.lit(direction).alias("direction"),
                       "page", "pos", F.col("e.id").alias("other_id"),
                       F.col("e.source").alias("other_source"), F.col("e.title").alias("title"),
                       F.col("e.pubYear").alias("pub_year"),
                       F.col("e.citedByCount").alias("cited_by_count"))


def citation_edges(pages: DataFrame, max_results: int | None = None) -> DataFrame:
    """Citing articles per article (capped), as edges ``article <- other``."""
    return _edges(pages, "citationList.citation", "cited_by", max_results)


def reference_edges(pages: DataFrame, max_results: int | None = None) -> DataFrame:
    """Referenced articles per article (capped), as edges ``article -> other``."""
    return _edges(pages, "referenceList.reference", "references", max_results)


def read_annotation_records(spark: SparkSession, path, multiline: bool = False) -> DataFrame:
    """Annotation payloads: a file may hold a list of records or one record;
    with ``multiLine`` Spark reads a top-level JSON array as one row per element."""
    return spark.read.schema(ANNOTATION_RECORD_SCHEMA).option("multiLine", multiline).json(path)


def annotations(records: DataFrame, ids: DataFrame | None = None, id_col: str = "id",
                annotation_type: str | None = None) -> DataFrame:
    """One row per annotation of the requested articles, optional type filter.

    Records without annotations keep one row with NULL fields (outer explode).
    """
    r = records
    if ids is not None:
        r = r.join(ids.select(F.col(id_col).alias("extId")), "extId", "left_semi")
    flat = r.select("source", "extId", F.posexplode_outer("annotations").alias("pos", "a"))
    flat = flat.select("source", "extId", "pos", "a.type", "a.exact", "a.prefix", "a.postfix",
                       "a.name")
    if annotation_type is not None:
        flat = flat.where(F.col("type") == annotation_type)
    return flat


def count_results(articles: DataFrame, predicate: Column) -> DataFrame:
    """Number of hits of a predicate, without materialising the rows."""
    return articles.agg(F.count_if(predicate).alias("hit_count"))
