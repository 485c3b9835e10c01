"""TF-IDF keywords (K1, K3, V6) as DataFrame jobs.

Definition (sublinear TF-IDF, L2-normalised rows, averaged over documents):

1. tokens: lower-cased runs of >= 2 word characters; stop words removed
   before n-grams; n-grams joined by one space;
2. vocabulary: the ``max_features`` terms with the highest corpus count
   (ties: term ascending);
3. idf = ln((1 + N) / (1 + df)) + 1;  w = (1 + ln tf) * idf over vocabulary terms;
4. each document's weights divided by their L2 norm;
5. keyword score = sum of normalised weights / N (N counts every document).

Plan. Which terms make the vocabulary is told by a sketch: occurrences are summed by
hash bucket, and a bucket's sum is an upper bound for each of its terms. Only terms of
buckets that may reach the vocabulary are counted one by one; the count of the last one
in is a lower bound, and where a bucket left out still exceeds it, these are counted too.
So the bulk of the terms, which occur a few times each, is never shuffled, and the result
is exact. The vocabulary (at most ``max_features`` terms) then turns every document into
a short array of term numbers and counts on its own row (Spark ML's count vectors), kept
as a narrow table; document frequencies, norms and scores are sums over it. No text and
no (document, term) pair is shuffled. With ``partition_cols`` (e.g. the class label) every
class has its own vocabulary. Without ``max_features`` all terms are counted and joined.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import CountVectorizerModel, NGram, StopWordsRemover
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperlens.functions.text import english_stop_words, tfidf_tokens
from paperlens.operators.topk import top_k
from paperlens.session import cut_lineage, stored

#: hash buckets of the sketch of term counts, and most of them that are broadcast
BUCKETS = 1 << 20
MOST_BUCKETS = 200_000


def ngram_terms(df: DataFrame, text_col: str, ngram_range: tuple[int, int] = (1, 2),
                stop_words: Sequence[str] | None = None, out: str = "terms") -> DataFrame:
    """Add ``out`` = all n-grams (after stop-word removal) of the text, in order."""
    sw = list(english_stop_words() if stop_words is None else stop_words)
    staged = df.withColumn("__tok", tfidf_tokens(text_col))
    staged = StopWordsRemover(inputCol="__tok", outputCol="__flt", stopWords=sw,
                              caseSensitive=True).transform(staged)
    lo, hi = ngram_range
    pieces: list[Column] = []
    for n in range(lo, hi + 1):
        if n == 1:
            pieces.append(F.col("__flt"))
        else:
            staged = NGram(n=n, inputCol="__flt", outputCol=f"__ng{n}").transform(staged)
            pieces.append(F.col(f"__ng{n}"))
    terms = pieces[0] if len(pieces) == 1 else F.concat(*pieces)
    return (staged.withColumn(out, terms)
            .drop("__tok", "__flt", *[f"__ng{n}" for n in range(max(lo, 2), hi + 1)]))


def _terms(docs: DataFrame, text_col: str, id_col: str, pc: list[str], ngram_range, stop_words) -> DataFrame:
    base = docs.select(*pc, F.col(id_col).alias("doc_id"), F.col(text_col).alias("__t"))
    return ngram_terms(base, "__t", ngram_range, stop_words, "__terms")


def term_totals(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id",
                partition_cols: Sequence[str] = (), ngram_range: tuple[int, int] = (1, 2),
                stop_words: Sequence[str] | None = None) -> DataFrame:
    """``(partition_cols..., term, cf, df)``: occurrences and documents of every term."""
    pc = list(partition_cols)
    t = _terms(docs, text_col, id_col, pc, ngram_range, stop_words)
    each = F.concat(F.transform("__terms", lambda x: F.struct(x.alias("term"), F.lit(0).alias("d"))),
                    F.transform(F.array_distinct("__terms"), lambda x: F.struct(x.alias("term"), F.lit(1).alias("d"))))
    # explode_outer + null filter: a plain explode would let the optimizer
    # re-run the tokenisation for an inferred size(terms) > 0 filter
    flat = t.select(*pc, F.explode_outer(each).alias("e")).where(F.col("e").isNotNull())
    return flat.groupBy(*pc, F.col("e.term").alias("term")).agg(
        F.count_if(F.col("e.d") == 0).alias("cf"), F.count_if(F.col("e.d") == 1).alias("df"))


def doc_term_counts(docs: DataFrame, vocab: DataFrame, text_col: str = "text", id_col: str = "doc_id",
                    partition_cols: Sequence[str] = (), ngram_range: tuple[int, int] = (1, 2),
                    stop_words: Sequence[str] | None = None) -> DataFrame:
    """Long form ``(partition_cols..., doc_id, term, idf, tf)`` over vocabulary terms.

    Documents are hash-partitioned by id once; the counts here and the norm of
    ``weights`` reuse that partitioning.
    """
    pc = list(partition_cols)
    t = _terms(docs.repartition(F.col(id_col)), text_col, id_col, pc, ngram_range, stop_words)
    flat = (t.select(*pc, "doc_id", F.explode_outer("__terms").alias("term"))
            .where(F.col("term").isNotNull()))
    # vocabulary: at most max_features rows per partition value -> broadcast
    flat = flat.join(F.broadcast(vocab.select(*pc, "term", "idf")), [*pc, "term"])
    return flat.groupBy("doc_id", *pc, "term").agg(F.first("idf").alias("idf"), F.count("*").alias("tf"))


def document_counts(docs: DataFrame, partition_cols: Sequence[str] = ()) -> DataFrame:
    """N per partition value (documents without any term count too)."""
    pc = list(partition_cols)
    return docs.groupBy(*pc).agg(F.count("*").alias("n_docs"))


def fit_vocabulary(totals: DataFrame, n_docs: DataFrame, max_features: int | None = 5000,
                   partition_cols: Sequence[str] = ()) -> DataFrame:
    """Vocabulary with idf: ``(partition_cols..., term, idf, df, cf, n_docs)``.

    At most ``max_features`` rows per partition value: this is the bound that
    makes the vocabulary safe to broadcast.
    """
    pc = list(partition_cols)
    stats = totals
    if max_features:
        order = [F.col("cf").desc(), F.col("term")]
        stats = (top_k(stats, pc, order, max_features, ["term"]).drop("rank") if pc
                 else stats.orderBy(*order).limit(max_features))
    # n_docs: one row per partition value
    joined = stats.join(F.broadcast(n_docs), pc, "inner") if pc else stats.crossJoin(
        F.broadcast(n_docs))
    idf = F.log((F.lit(1.0) + F.col("n_docs")) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0)
    return joined.select(*pc, "term", idf.alias("idf"), "df", "cf", "n_docs")


def weights(dtc: DataFrame, partition_cols: Sequence[str] = ()) -> DataFrame:
    """Normalised TF-IDF weights ``(partition_cols..., doc_id, term, weight)``."""
    pc = list(partition_cols)
    w = dtc.withColumn("w", (F.lit(1.0) + F.log(F.col("tf").cast("double"))) * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("doc_id", *pc)))
    return w.select(*pc, "doc_id", "term", (F.col("w") / norm).alias("weight"))


def heavy_terms(terms: DataFrame, k: int, partition_cols: Sequence[str] = (), buckets: int = BUCKETS) -> DataFrame:
    """``(partition_cols..., term, cf)``: the ``k`` most frequent of ``terms`` (one row with an
    array column ``__terms`` a document), ties by term; exact, by a sketch of bounds."""
    pc = list(partition_cols)
    # explode_outer + null filter: a plain explode would let the optimizer
    # re-run the tokenisation for an inferred size(terms) > 0 filter
    flat = terms.select(*pc, F.explode_outer("__terms").alias("term")).where(F.col("term").isNotNull())
    flat = flat.withColumn("__b", F.xxhash64("term").bitwiseAND(F.lit(buckets - 1)))
    # at most ``buckets`` rows a task and class
    bounds = cut_lineage(flat.groupBy(*pc, "__b").agg(F.count("*").alias("bound")))

    def counted(above: DataFrame) -> DataFrame:
        """Exact counts of the terms in buckets whose bound reaches that of their class."""
        own = bounds.join(F.broadcast(above), pc) if pc else bounds.crossJoin(F.broadcast(above))  # a row a class
        own = own.where("bound >= least").select(*pc, "__b")
        few = own.limit(MOST_BUCKETS + 1).count() <= MOST_BUCKETS
        found = flat.join(F.broadcast(own) if few else own, [*pc, "__b"], "left_semi")
        return found.groupBy(*pc, "term").agg(F.count("*").alias("cf"))

    def kth(df: DataFrame, n: int, by: str, key: str) -> DataFrame:
        """(pc..., least): the n-th largest of ``by`` in each class (0 if there are fewer)."""
        if pc:
            top = top_k(df, pc, [F.col(by).desc(), F.col(key)], n, [key])
        else:
            top = df.orderBy(F.col(by).desc(), F.col(key)).limit(n)
        return top.groupBy(*pc).agg(F.when(F.count("*") >= n, F.min(by)).otherwise(F.lit(0)).alias("least"))

    first = cut_lineage(kth(bounds, 2 * k, "bound", "__b"))
    exact = cut_lineage(counted(first))
    order = [F.col("cf").desc(), F.col("term")]
    # the k-th exact count bounds the vocabulary from below; buckets left out may still exceed it
    least = cut_lineage(kth(exact, k, "cf", "term"))
    lower = least.withColumnRenamed("least", "now")
    both = first.join(lower, pc, "left") if pc else first.crossJoin(lower)
    if not both.where(F.coalesce("now", F.lit(0)) < F.col("least")).isEmpty():
        exact = cut_lineage(counted(both.select(*pc, F.coalesce("now", F.lit(0)).alias("least"))))
    if pc:
        return top_k(exact, pc, order, k, ["term"]).drop("rank")
    return exact.orderBy(*order).limit(k)


def count_vectors(terms: DataFrame, vocab: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """``(keep..., idx, tf)``: numbers of the vocabulary terms of each document and how often
    they occur in it."""
    model = CountVectorizerModel.from_vocabulary(list(vocab), inputCol="__terms", outputCol="__v")
    u = F.unwrap_udt(F.col("__v"))
    return (model.transform(terms).select(*keep, u.alias("__u"))
            .select(*keep, F.col("__u.indices").alias("idx"), F.col("__u.values").alias("tf")))


def tfidf_keywords(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id",
                   n: int = 50, max_features: int | None = 5000,
                   ngram_range: tuple[int, int] = (1, 2), partition_cols: Sequence[str] = (),
                   stop_words: Sequence[str] | None = None) -> DataFrame:
    """K1: top ``n`` terms by mean normalised weight over all documents.

    Returns ``(partition_cols..., rank, term, score)``. ``partition_cols`` are meant for a
    handful of classes: the driver holds their vocabularies.
    """
    pc = list(partition_cols)
    n_docs = document_counts(docs, pc)
    if max_features:
        sums, n_docs = _vector_sums(docs, n_docs, text_col, id_col, max_features, ngram_range, pc, stop_words)
    else:
        totals = term_totals(docs, text_col, id_col, pc, ngram_range, stop_words)
        vocab = fit_vocabulary(totals, n_docs, None, pc)
        dtc = doc_term_counts(docs, vocab, text_col, id_col, pc, ngram_range, stop_words)
        sums = weights(dtc, pc).groupBy(*pc, "term").agg(F.sum("weight").alias("s"))
    scored = sums.join(F.broadcast(n_docs), pc, "inner") if pc else sums.crossJoin(
        F.broadcast(n_docs))
    scored = scored.select(*pc, "term", (F.col("s") / F.col("n_docs")).alias("score"))
    order = [F.col("score").desc(), F.col("term")]
    # at most max_features rows a class, salted where there is no such bound
    return top_k(scored.withColumn("__all", F.lit(0)), pc or ["__all"], order, n, ["term"]).select(
        *pc, "rank", "term", "score")


def _vector_sums(docs: DataFrame, n_docs: DataFrame, text_col: str, id_col: str, max_features: int, ngram_range,
                 pc: list[str], stop_words) -> tuple[DataFrame, DataFrame]:
    """(pc..., term, s): sums of the normalised weights; and ``n_docs``, written."""
    spark = docs.sparkSession
    terms = _terms(docs, text_col, id_col, pc, ngram_range, stop_words)
    heavy = cut_lineage(heavy_terms(terms, max_features, pc))  # max_features rows a class
    vocab = [r["term"] for r in heavy.select("term").distinct().orderBy("term").collect()]
    if not vocab:
        return heavy.select(*pc, "term", F.lit(0.0).alias("s")), n_docs
    number = spark.createDataFrame(list(enumerate(vocab)), "i int, term string")
    own = heavy.join(F.broadcast(number), "term").select(*pc, "i")
    vectors = stored(count_vectors(terms, vocab, pc), "vectors")
    df = vectors.select(*pc, F.explode_outer("idx").alias("i")).groupBy(*pc, "i").agg(F.count("*").alias("df"))
    n_docs = cut_lineage(n_docs)
    stats = df.join(F.broadcast(own), [*pc, "i"])
    stats = stats.join(F.broadcast(n_docs), pc) if pc else stats.crossJoin(F.broadcast(n_docs))
    idf = F.log((F.lit(1.0) + F.col("n_docs")) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0)
    # one row a class: the idf of every number of the vocabulary, 0 where it is not of the class
    every = n_docs.select(*pc).crossJoin(F.broadcast(number.select("i")))  # classes x vocabulary
    table = (every.join(stats.select(*pc, "i", idf.alias("idf")), [*pc, "i"], "left").groupBy(*pc)
             .agg(F.array_sort(F.collect_list(F.struct("i", F.coalesce("idf", F.lit(0.0)).alias("idf")))).alias("all")))
    table = cut_lineage(table.select(*pc, F.col("all.idf").alias("idf")))
    rows = vectors.join(F.broadcast(table), pc) if pc else vectors.crossJoin(F.broadcast(table))
    w = F.zip_with("idx", "tf", lambda i, x: (F.lit(1.0) + F.log(x)) * F.get("idf", i))  # 0: not of the class
    rows = rows.select(*pc, "idx", w.alias("w"))
    norm = F.sqrt(F.aggregate("w", F.lit(0.0), lambda s, x: s + x * x))
    each = rows.select(*pc, F.arrays_zip("idx", "w").alias("e"), norm.alias("norm"))
    flat = each.select(*pc, "norm", F.explode_outer("e").alias("e")).where(F.col("e.w") > 0)
    sums = flat.groupBy(*pc, F.col("e.idx").alias("i")).agg(F.sum(F.col("e.w") / F.col("norm")).alias("s"))
    return sums.join(F.broadcast(number), "i").select(*pc, "term", "s"), n_docs


def compare_keywords(docs: DataFrame, label_col: str = "label", text_col: str = "text",
                     id_col: str = "doc_id", n: int = 30, max_features: int | None = 5000,
                     positive=1, negative=0) -> DataFrame:
    """K3: per-class keywords (each class fitted on its own), top ``n`` of each
    class, then ``positive_distinctive`` / ``negative_distinctive`` (score desc)
    and ``shared``. Returns ``(kind, term, pos_score, neg_score)``.
    """
    kw = tfidf_keywords(docs.where(F.col(label_col).isin(positive, negative)), text_col, id_col,
                        2 * n, max_features, partition_cols=[label_col])
    top = kw.where(F.col("rank") <= n)
    pos = top.where(F.col(label_col) == positive).select("term", F.col("score").alias("pos_score"))
    neg = top.where(F.col(label_col) == negative).select("term", F.col("score").alias("neg_score"))
    both = pos.join(neg, "term", "full_outer")  # two tables of at most n rows
    kind = (F.when(F.col("neg_score").isNull(), F.lit("positive_distinctive"))
            .when(F.col("pos_score").isNull(), F.lit("negative_distinctive"))
            .otherwise(F.lit("shared")))
    return both.select(kind.alias("kind"), "term", "pos_score", "neg_score")


def word_frequencies(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id",
                     max_words: int = 100, max_features: int | None = 5000) -> DataFrame:
    """V6: at most ``max_words`` (term, score) pairs for a word cloud."""
    return tfidf_keywords(docs, text_col, id_col, max_words, max_features).select("term", "score")
