"""From documents to packed training sequences.

Each stage takes (spark, docs, sf_dir), is written as Parquet and read again by
the next; all but the last return the columns of ``documents``.

In every stage: columns other than those it decides by are kept with their values,
whatever their names (in any case, with dots, or named like an operator's results);
repeated rows are rows each, but where the stage says otherwise; texts of any length
are whole; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperlens.llm import langid, lines, mixing, packing, simhash
from paperlens.llm.common import documents, free_name, word_count, written

#: a document goes if its language has less than this score, unless it is a mixture that the
#: languages found explain better than chance
MIN_LANGUAGE_SHARE = 0.4
#: words that a Python worker of the last stage keeps, as memory also holds what earlier stages left
CACHED_WORDS = 200_000


def columns(docs: DataFrame) -> list[Column]:
    """All columns, by names that may hold dots."""
    return [F.col(f"`{c}`") for c in docs.columns]


def language_id(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter (null and empty ones too) and texts without a language:
    mixtures without a main one stay if their languages explain them. The labels of ``docs``
    teach the model; null labels teach nothing, and where there are none, all that has letters
    is kept. Equal texts, repeated rows too, stay or go together."""
    model = langid.train(docs)
    if not model.langs:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    own = free_name(docs, "found")
    found = docs.withColumn(own, langid.language(F.col("text"), model))
    of = F.col(own).getField
    mixture = (F.size(of("languages")) > 1) & (of("fit") > langid.CHANCE)
    good = (of("lang_pred") != "und") & ((of("score") >= MIN_LANGUAGE_SHARE) | mixture)
    return found.where(good).select(columns(docs))


def line_dedup(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that an earlier document, or an earlier place, has in a run. Null
    texts stay null; a null id is before all others; rows that agree in id and text don't
    repeat each other. ``n_chars``, where there is such a column, is that of what is left."""
    rest = F.struct(*columns(docs)).alias("rest")
    out = lines.dedup_lines(docs.select("doc_id", "text", rest))
    text = F.col("text")

    def kept(c: str) -> Column:
        if c.lower() == "text":
            return text.alias(c)
        if c.lower() == "n_chars":
            return F.length(text).cast(docs.schema[c].dataType).alias(c)
        return F.col("rest").getField(c).alias(c)

    return out.select([kept(c) for c in docs.columns])


def near_dedup(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each SimHash component: that of the smallest doc_id (null last), the first
    of several. Null, empty and wordless texts are one component, as their fingerprints agree."""
    place = free_name(docs, "row_of_stage")
    # the number is written, so that all that follows sees the same one however files are read
    rows = written(docs.withColumn(place, F.monotonically_increasing_id()), "numbered")
    groups = simhash.near_duplicates(rows.select(place, "text"), id_col=place)
    named = groups.select(F.col("id").alias(place), "root").join(rows.select(place, "doc_id"), place)
    kept = named.groupBy("root").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", place)).getField(place).alias(place))
    return rows.join(kept.select(place), place, "left_semi").select(columns(docs))


def mix_sources(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them: not at all, once or twice. A null source is a
    source; texts without words (null ones too) have size 0, and are taken as their hash says;
    rows that agree in id and number of words are taken alike."""
    sized = docs.select(F.struct(*columns(docs)).alias("doc"), "doc_id", "source",
                        word_count(F.col("text")).alias("size"))
    # written: words are counted once, and the histograms read three narrow columns
    taken = mixing.mix(written(sized, "sized")).where("copies > 0")
    copy = F.explode(F.array_repeat("doc", F.col("copies")))
    return taken.select(copy.alias("doc")).select(
        [F.col("doc").getField(c).alias(c) for c in docs.columns])


def pack_sequences(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their sequence and place in it. Null and empty texts are the end id alone;
    repeated rows give pieces each; other columns are left out."""
    pieces = packing.token_pieces(docs, packing.tokenizer_path(), cached=CACHED_WORDS)
    return packing.pack(written(pieces, "pieces"))


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_dedup),
    ("mixing sources", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: hashes and tokens of the stages are beyond SQL; tests hold each stage against brute force
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; the packed pieces."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "pipeline")
    return STAGES[-1][1](spark, docs, sf_dir)
