"""Adapters from the driver's tables to article-shaped DataFrames.

The tables hold no article metadata, so the article fields are derived by
deterministic rules that the SQL oracle repeats column for column:

documents (+ labels):  id = doc_id; title = first line of text; abstract = the
rest ('' if one line); journal = source; keywords = [lang]; year = 2018 +
doc_id % 8; cited_by_count = doc_id * 37 % 101; open access = lang is 'en';
label = labels.quality; pmid / doi / pmcid: doc_id % 3 picks the one holding
md5(text), the others are ''.

orders:  id = o_orderkey; journal = o_orderpriority; year = year(o_orderdate);
first_pub_date = date(o_orderdate); cited_by_count = floor(o_totalprice / 10000);
open access = o_orderstatus is 'O'.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NL = "\n"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(scan: DataFrame) -> DataFrame:
    """A plain scan of wide texts, dealt out to all cores where its files make fewer
    partitions (one row group is one task, however much work its texts are)."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def documents_as_articles(spark: SparkSession, sf_dir: str,
                          labelled: bool = False) -> DataFrame:
    d = spread(read_table(spark, sf_dir, "documents"))
    nl_pos = F.instr(F.col("text"), NL)
    digest = F.md5(F.col("text"))
    kind = F.col("doc_id") % 3
    arts = d.select(
        F.col("doc_id"),
        F.col("doc_id").alias("seq"),
        F.when(kind == 0, digest).otherwise(F.lit("")).alias("pmid"),
        F.when(kind == 1, digest).otherwise(F.lit("")).alias("doi"),
        F.when(kind == 2, digest).otherwise(F.lit("")).alias("pmcid"),
        F.split_part(F.col("text"), F.lit(NL), F.lit(1)).alias("title"),
        F.when(nl_pos > 0, F.expr("substring(text, instr(text, '\n') + 1)"))
         .otherwise(F.lit("")).alias("abstract"),
        F.col("source").alias("journal"),
        F.array(F.col("lang")).alias("keywords"),
        (F.lit(2018) + F.col("doc_id") % 8).cast("int").alias("year"),
        (F.col("doc_id") * 37 % 101).alias("cited_by_count"),
        (F.col("lang") == "en").alias("is_open_access"),
        F.col("lang"),
        F.col("text").alias("raw_text"),
        F.col("n_chars"),
    )
    if labelled:
        lab = read_table(spark, sf_dir, "labels").select(
            "doc_id", F.col("quality").cast("int").alias("label"))
        arts = arts.join(lab, "doc_id", "inner")
    return arts


def orders_as_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderkey").alias("seq"),
        F.col("o_orderpriority").alias("journal"),
        F.year("o_orderdate").alias("year"),
        F.to_date("o_orderdate").alias("first_pub_date"),
        F.floor(F.col("o_totalprice") / 10000).cast("long").alias("cited_by_count"),
        (F.col("o_orderstatus") == "O").alias("is_open_access"),
    )


# SQL text of the same adapters, for the DuckDB oracle
DOCUMENT_ARTICLES_SQL = """(
  SELECT doc_id, doc_id AS seq,
    CASE WHEN doc_id % 3 = 0 THEN md5(text) ELSE '' END AS pmid,
    CASE WHEN doc_id % 3 = 1 THEN md5(text) ELSE '' END AS doi,
    CASE WHEN doc_id % 3 = 2 THEN md5(text) ELSE '' END AS pmcid,
    split_part(text, chr(10), 1) AS title,
    CASE WHEN strpos(text, chr(10)) > 0 THEN substr(text, strpos(text, chr(10)) + 1)
         ELSE '' END AS abstract,
    source AS journal, [lang] AS keywords,
    CAST(2018 + doc_id % 8 AS INTEGER) AS year,
    CAST(doc_id * 37 % 101 AS BIGINT) AS cited_by_count,
    lang = 'en' AS is_open_access, lang, text AS raw_text
  FROM documents)"""

LABELLED_ARTICLES_SQL = f"""(
  SELECT a.*, CAST(l.quality AS INTEGER) AS label
  FROM {DOCUMENT_ARTICLES_SQL} a JOIN labels l USING (doc_id))"""

ORDER_ARTICLES_SQL = """(
  SELECT o_orderkey AS id, o_orderkey AS seq, o_orderpriority AS journal,
    CAST(year(o_orderdate) AS INTEGER) AS year, CAST(o_orderdate AS DATE) AS first_pub_date,
    CAST(floor(o_totalprice / 10000) AS BIGINT) AS cited_by_count,
    o_orderstatus = 'O' AS is_open_access
  FROM orders)"""
