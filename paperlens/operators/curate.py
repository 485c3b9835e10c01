"""De-duplication, balancing and splitting.

Sampling is exact and reproducible: rows are ordered by ``md5(id || ':' || seed)``
and cut at exact per-class quotas. No row is ranked or moved for that. The hash
of the row at each cut is found from counts, and rows compare with it:

* bucket = first ``digits`` hex characters of the digest (16**digits buckets,
  uniform because ids are unique); rows per (class, bucket) are counted;
* running sums over that small table tell in which bucket a quota ends;
* only the hashes of rows in these buckets are ranked, to find the last one in.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperlens.functions.coerce import dedup_key
from paperlens.session import stored

SPLIT_NAMES = ("train", "val", "test")


def with_dedup_key(df: DataFrame, out: str = "uid") -> DataFrame:
    """D1."""
    return df.withColumn(out, dedup_key())


def dedup_keep_first(df: DataFrame, key: str | Column = "uid", order_col: str = "seq",
                     within: Sequence[str] = (), count: str | None = None) -> DataFrame:
    """Keep the first row (lowest ``order_col``) of every key (optionally per class),
    with the number of its copies in a column ``count`` if named.

    ``min_by`` of the row aggregates partially on the map side (sort-based, as a row is
    no fixed-width buffer), so a key holding a large share of all rows is reduced to
    one row per input partition before the shuffle.
    """
    k = F.col(key) if isinstance(key, str) else key
    cols = [c for c in df.columns]
    grouped = df.withColumn("__k", k).groupBy(*within, "__k")
    kept = grouped.agg(F.min_by(F.struct(*[F.col(c) for c in cols]), F.col(order_col)).alias("__r"),
                       F.count("*").alias("__copies"))
    return kept.select("__r.*", *([F.col("__copies").alias(count)] if count else []))


def hash_key(id_cols: Sequence[str], seed: int | str) -> Column:
    return F.md5(F.concat_ws(":", *[F.col(c).cast("string") for c in id_cols], F.lit(str(seed))))


def cut_keys(df: DataFrame, by: str, id_cols: Sequence[str], quotas: DataFrame, cuts: Sequence[str],
             seed: int | str = 42, digits: int = 4) -> DataFrame:
    """``quotas`` (one row per class ``by``) with each column of ``cuts``, a number of rows, replaced
    by the key ``struct(hash, ids...)`` of the last row within that number (NULL: no row)."""
    h = hash_key(id_cols, seed)
    keyed = df.select(F.col(by).alias("__class"), F.struct(h.alias("h"), *id_cols).alias("__key"),
                      F.substring(h, 1, digits).alias("__b"))
    counts = keyed.groupBy("__class", "__b").agg(F.count("*").alias("__n"))
    w = Window.partitionBy("__class").orderBy("__b")
    counts = counts.withColumn("__upto", F.sum("__n").over(w))
    wanted = quotas.select(F.col(by).alias("__c"), F.explode(F.array(*[
        F.struct(F.lit(c).alias("cut"), F.col(c).cast("long").alias("k")) for c in cuts])).alias("__q"))
    wanted = wanted.select("__c", "__q.cut", F.greatest("__q.k", F.lit(0)).alias("k"))
    # one row per class and cut: the bucket in which the quota ends, and its place there; a quota
    # beyond the class ends with the last row
    sizes = counts.groupBy("__class").agg(F.sum("__n").alias("__all"))
    ends = (wanted.join(sizes, F.col("__c").eqNullSafe(F.col("__class"))).drop("__class")
            .withColumn("k", F.least("k", "__all")))
    ends = ends.join(counts, F.col("__c").eqNullSafe(F.col("__class"))
                     & (F.col("__upto") >= F.col("k")) & (F.col("__upto") - F.col("__n") < F.col("k")))
    ends = ends.select("__c", "cut", F.col("__b").alias("__e"),
                       (F.col("k") - F.col("__upto") + F.col("__n")).alias("place"))
    # at most one row per class and cut; classes are the values of a label
    near = keyed.join(F.broadcast(ends), F.col("__class").eqNullSafe(F.col("__c")) & (F.col("__b") == F.col("__e")))
    rank = F.row_number().over(Window.partitionBy("__c", "cut").orderBy("__key"))
    last = near.withColumn("__r", rank).where(F.col("__r") == F.col("place"))
    found = last.groupBy("__c").agg(*[F.max(F.when(F.col("cut") == c, F.col("__key"))).alias(f"__cut_{c}")
                                      for c in cuts])
    out = quotas.join(found, F.col(by).eqNullSafe(F.col("__c")), "left")
    return out.select(*[F.col(f"__cut_{c}").alias(c) if c in cuts else F.col(c) for c in quotas.columns])


def _within(id_cols: Sequence[str], seed: int | str, cut: str) -> Column:
    """Whether the row's key is at or before the cut's."""
    return F.coalesce(F.struct(hash_key(id_cols, seed).alias("h"), *id_cols) <= F.col(cut), F.lit(False))


def class_counts(df: DataFrame, label_col: str = "label") -> DataFrame:
    return df.groupBy(label_col).agg(F.count("*").alias("n"))


def balance(df: DataFrame, label_col: str = "label", id_cols: Sequence[str] = ("doc_id",),
            seed: int | str = 42, labels: Sequence[int] = (0, 1), digits: int = 4) -> DataFrame:
    """D3: down-sample every class to the smallest class size, exactly.

    A class listed in ``labels`` with no rows counts as size 0.
    """
    counts = class_counts(df, label_col)
    present = [F.coalesce(F.max(F.when(F.col(label_col) == F.lit(lab), F.col("n"))), F.lit(0))
               for lab in labels]
    k = counts.agg(F.least(*present).alias("__k") if len(present) > 1
                   else present[0].alias("__k"))
    # k is a single row; classes are the values of a label
    quotas = counts.crossJoin(F.broadcast(k)).select(F.col(label_col), F.col("__k"))
    cut = cut_keys(df, label_col, id_cols, quotas, ["__k"], seed, digits)
    cut = cut.select(F.col(label_col).alias("__class"), "__k")
    return (df.join(F.broadcast(cut), F.col(label_col).eqNullSafe(F.col("__class")))
            .where(_within(id_cols, seed, "__k")).select(*[df[c] for c in df.columns]))


def _largest_remainder(counts: DataFrame, total: Column, draws: Column, label_col: str,
                       count_col: str, out: str) -> DataFrame:
    """Allocate ``draws`` over classes proportionally: floor, then the largest
    fractional remainders (ties: smaller label first). ``counts`` is tiny."""
    w_all = Window.partitionBy()
    cont = F.when(total > 0, F.col(count_col).cast("double") / total.cast("double")
                  * draws.cast("double")).otherwise(F.lit(0.0))
    staged = counts.withColumn("__cont", cont).withColumn("__fl", F.floor("__cont"))
    staged = staged.withColumn("__need", draws - F.sum("__fl").over(w_all))
    rem = F.col("__cont") - F.col("__fl")
    w_rem = Window.partitionBy().orderBy(rem.desc(), F.col(label_col))
    staged = staged.withColumn("__rk", F.row_number().over(w_rem))
    return (staged.withColumn(out, (F.col("__fl") + F.when(F.col("__rk") <= F.col("__need"), 1)
                                    .otherwise(0)).cast("long"))
            .drop("__cont", "__fl", "__need", "__rk"))


def split_quotas(counts: DataFrame, train: float = 0.7, val: float = 0.15, test: float = 0.15,
                 label_col: str = "label", count_col: str = "n") -> DataFrame:
    """Per-class (train, val, test) sizes of the two successive cuts.

    First cut: ``ceil(n * (val + test))`` rows leave the training side;
    second cut: ``ceil(m * test / (val + test))`` of those go to test.
    """
    if abs(train + val + test - 1.0) >= 1e-6:
        raise ValueError(f"Ratios must sum to 1.0, got {train + val + test}")
    w_all = Window.partitionBy()
    temp_frac = val + test
    rel_test = test / temp_frac
    staged = counts.withColumn("__total", F.sum(count_col).over(w_all))
    staged = staged.withColumn(
        "__n_train", F.col("__total") - F.ceil(F.lit(temp_frac) * F.col("__total").cast("double")))
    staged = _largest_remainder(staged, F.col("__total"), F.col("__n_train"), label_col,
                                count_col, "n_train")
    staged = staged.withColumn("__temp", F.col(count_col) - F.col("n_train"))
    staged = staged.withColumn("__m", F.sum("__temp").over(w_all))
    staged = staged.withColumn(
        "__n_val", F.col("__m") - F.ceil(F.lit(rel_test) * F.col("__m").cast("double")))
    staged = _largest_remainder(staged, F.col("__m"), F.col("__n_val"), label_col, "__temp", "n_val")
    return staged.select(label_col, F.col(count_col).alias("n"), "n_train", "n_val",
                         (F.col("__temp") - F.col("n_val")).alias("n_test"))


def create_splits(df: DataFrame, train: float = 0.7, val: float = 0.15, test: float = 0.15,
                  seed: int | str = 42, stratify: bool = True, label_col: str = "label",
                  id_cols: Sequence[str] = ("doc_id",), digits: int = 4) -> DataFrame:
    """One DataFrame with a ``split`` column (train / val / test).

    Sizes follow the two-cut rule; with ``stratify`` every class is cut at its
    own proportional quota. Membership is the md5 order, so it is reproducible
    in any engine.
    """
    by_col = label_col if stratify else "__all"
    staged = df if stratify else df.withColumn("__all", F.lit(0))
    quotas = split_quotas(class_counts(staged, by_col).withColumnRenamed("n", "__cnt"),
                          train, val, test, by_col, "__cnt")
    quotas = quotas.select(by_col, "n_train", (F.col("n_train") + F.col("n_val")).alias("n_val"))
    cuts = cut_keys(staged, by_col, id_cols, quotas, ["n_train", "n_val"], seed, digits)
    # one row per class
    cuts = cuts.select(F.col(by_col).alias("__class"), F.col("n_train").alias("__t"), F.col("n_val").alias("__v"))
    out = staged.join(F.broadcast(cuts), F.col(by_col).eqNullSafe(F.col("__class")))
    split = (F.when(_within(id_cols, seed, "__t"), F.lit("train"))
             .when(_within(id_cols, seed, "__v"), F.lit("val")).otherwise(F.lit("test")))
    return out.select(*[staged[c] for c in df.columns], split.alias("split"))


def split_stats(splits: DataFrame, label_col: str = "label") -> DataFrame:
    """Size, positives, negatives per split."""
    return (splits.groupBy("split")
            .agg(F.count("*").alias("size"),
                 F.coalesce(F.sum(label_col), F.lit(0)).cast("long").alias("positive"),
                 F.count_if(F.col(label_col) == 0).alias("negative")))


def label_conflicts(deduped: DataFrame, label_col: str = "label") -> DataFrame:
    """Ids that carry more than one label after the per-class dedup: ``(uid, n_labels)``."""
    return (deduped.groupBy("uid").agg(F.countDistinct(label_col).alias("n_labels"))
            .where(F.col("n_labels") > 1))


def resolve_conflicts(deduped: DataFrame, policy: str = "keep", label_col: str = "label",
                      positive=1) -> DataFrame:
    """``keep``: an id may appear once per class (the default, as collected);
    ``drop``: ids with several labels are removed; ``positive``: such ids keep
    only their positive row."""
    if policy == "keep":
        return deduped
    if policy not in ("drop", "positive"):
        raise ValueError(f"unknown conflict policy {policy!r}")
    w = Window.partitionBy("uid")
    n = F.size(F.collect_set(label_col).over(w))
    staged = deduped.withColumn("__n", n)
    if policy == "drop":
        return staged.where(F.col("__n") == 1).drop("__n")
    return staged.where((F.col("__n") == 1) | (F.col(label_col) == positive)).drop("__n")


def collection_pipeline(articles: DataFrame, balance_classes: bool = True, seed: int = 42,
                        label_col: str = "label", order_col: str = "seq",
                        conflict: str = "keep") -> DataFrame:
    """Dedup within each class -> conflict policy -> balance -> one table."""
    keyed = with_dedup_key(articles)
    deduped = dedup_keep_first(keyed, "uid", order_col, within=[label_col])
    deduped = resolve_conflicts(deduped, conflict, label_col)
    if not balance_classes:
        return deduped
    # class sizes, bucket sizes, the last rows in and the result all read it: aggregated once
    deduped = stored(deduped, "deduped")
    return balance(deduped, label_col, ["uid"], seed)


def union_splits(*frames: DataFrame) -> DataFrame:
    """Bag union by column name."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
