"""Mixing sources to target weights by hash-threshold histograms.

Every row has a fixed hash. Sizes are summed by source and hash bucket; where
the running sum of a source crosses its budget lies its boundary bucket. Only
the rows of boundary buckets are summed again by the next hash bits, until a
boundary cell holds one hash. The threshold found keeps every row below it:
a filter, no sort, and thresholds of growing budgets are nested.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperlens.llm.common import documents, small, word_count, written

#: hash bits that a histogram resolves; four rounds use all 64
BITS = 16
_SHIFTS = [64 - BITS * i for i in range(1, 64 // BITS + 1)]


def targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """``sizes`` (source, source_size), a row a source, with ``target``.

    Sources in code point order, null last, weigh ``weights`` in turn and share
    ``share`` times the sum of all sizes. A target stops at ``most`` times its
    source's size; what is above is shared again by weight until none is above.
    That is a water level L with target = min(most * size, weight * L): sources
    reach their stop in the order of size over weight, so running sums in that
    order tell which do. One row a source, however many rows a source has.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]),
                     ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    s = sizes.withColumn("w", w).withColumn("stop", most * F.col("source_size"))
    by = Window.orderBy(F.col("stop") / F.col("w"), F.col("source").asc_nulls_last())
    full, everything = by.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    s = (s.withColumn("budget", share * F.sum("source_size").over(everything))
          .withColumn("stopped", F.coalesce(F.sum("stop").over(full), F.lit(0.0)))
          .withColumn("w_left", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(full), F.lit(0.0))))
    # the level if all earlier ones are full; this one stays below its stop when that is lower
    level = (F.col("budget") - F.col("stopped")) / F.col("w_left")
    s = s.withColumn("level", F.when(level * F.col("w") < F.col("stop"), level))
    s = s.withColumn("level", F.max(F.struct(F.col("level").isNotNull(), -F.col("stop") / F.col("w"),
                                             F.col("level"))).over(everything)["level"])
    target = F.when(F.col("level").isNull(), F.col("stop")).otherwise(
        F.least(F.col("stop"), F.col("w") * F.col("level")))
    return s.select("source", "source_size", target.alias("target"))


def _bits(shift: int, h: Column) -> Column:
    return F.shiftrightunsigned(h, shift)


def thresholds(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """(source, cut): rows of the source with an unsigned hash below ``cut`` (kept
    with its top bit flipped, so that signed order is the right one) sum up nearest
    to the source's ``rest``. ``rows``: (source, h, size); ``budgets``: (source, rest).

    Each round sums a histogram of at most 2**BITS rows a source, and looks only at
    rows of boundary cells. Rows of one hash are never parted.
    """
    state = budgets.select("source", "rest", F.lit(0).cast("long").alias("cell"))
    last = 64
    for shift in _SHIFTS:
        own = rows
        if last < 64:
            own = rows.join(small(state.select(F.col("source").alias("s"), "cell")),
                            F.col("source").eqNullSafe(F.col("s"))
                            & (_bits(last, F.col("h")) == F.col("cell"))).drop("s", "cell")
        hist = own.groupBy("source", _bits(shift, F.col("h")).alias("cell")).agg(F.sum("size").alias("sum"))
        # cells by unsigned order; a source has at most 2**BITS of them here
        unsigned = F.col("cell").bitwiseXOR(F.lit(-(1 << 63))) if shift == 0 else F.col("cell")
        w = Window.partitionBy("source").orderBy(unsigned)
        hist = (hist.withColumn("upto", F.sum("sum").over(w))
                .join(state.select(F.col("source").alias("s"), "rest"), F.col("source").eqNullSafe(F.col("s")))
                .drop("s"))
        if shift:
            # the first cell that reaches the budget; none reaches it only by rounding: the last
            found = F.min(F.when(F.col("upto") >= F.col("rest"), F.struct("cell", "upto", "sum")))
            lastc = F.max(F.struct("cell", "upto", "sum"))
            state = (hist.groupBy("source", "rest").agg(F.coalesce(found, lastc).alias("c"))
                     .select("source", (F.col("rest") - F.col("c.upto") + F.col("c.sum")).alias("rest"),
                             F.col("c.cell").alias("cell")))
            state = written(state, "mix-cells")  # a row a source
            last = shift
        else:
            # single hashes now: keep those whose running sum is nearest to the rest
            near = F.min_by(unsigned, F.struct(F.abs(F.col("upto") - F.col("rest")), unsigned))
            none = F.min(F.when(F.col("sum") > 0, unsigned))
            cut = (hist.groupBy("source", "rest")
                   .agg(near.alias("last"), F.min(F.abs(F.col("upto") - F.col("rest"))).alias("gap"),
                        F.min(unsigned).alias("first"), none.alias("none"))
                   .select("source", F.when(F.col("gap") <= F.col("rest"), F.col("last") + 1)
                           .otherwise(F.col("first")).alias("cut")))
    return cut


def mix(df: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2,
        key_cols: Sequence[str] = ("doc_id",), source_col: str = "source", size_col: str = "size",
        seed: int = 6) -> DataFrame:
    """All rows of ``df`` with ``source_size``, ``target`` and ``copies``.

    ``copies`` is how often the mix takes a row: for a target of k times the
    source's size and a rest, k times every row and once more those rows whose
    hash lies below the source's threshold. Of rows with equal keys and sizes
    all or none are taken, reruns agree, and the sum of copies times size misses
    the target by at most half of one row (of one group of equal rows).

    A null source is a source; a null size counts 0; a source of size 0 has target
    0 and no copies; an empty table gives an empty result. Columns named like the
    outputs are replaced, others are kept.
    """
    keep = [c for c in df.columns if c not in ("source_size", "target", "copies")]
    size = F.coalesce(F.col(size_col), F.lit(0)).cast("long")
    h = F.xxhash64(F.lit(seed), *[F.col(c) for c in key_cols], size)
    base = df.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"),
                     F.col(source_col).alias("source"), size.alias("size"), h.alias("h"))
    rows = base.select("source", "h", "size")
    sizes = rows.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    plan = written(targets(sizes, weights, share, most), "mix-targets")  # a row a source
    plan = plan.withColumn("k", F.when(F.col("source_size") > 0,
                                       F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    rest = plan.withColumn("rest", F.col("target") - F.col("k") * F.col("source_size"))
    cut = thresholds(rows, rest.where("rest > 0").select("source", "rest"))
    full = rest.join(cut.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    full = written(full.select(F.col("source").alias("s"), "source_size", "target", "k", "cut"), "mix-cuts")
    out = base.join(small(full), F.col("source").eqNullSafe(F.col("s")), "left")
    below = F.coalesce(F.col("h").bitwiseXOR(F.lit(-(1 << 63))) < F.col("cut"), F.lit(False))
    return out.select(*[F.col("row").getField(c).alias(c) for c in keep], "source_size", "target",
                      (F.col("k") + below.cast("int")).cast("int").alias("copies"))


def op6_hash_threshold_mix(spark, sf_dir: str) -> DataFrame:
    """All documents: sources weigh 3, 1, 2 in turn and share 150 % of all words."""
    d = documents(spark, sf_dir).select("doc_id", "source", word_count(F.col("text")).alias("size"))
    mixed = mix(written(d, "mix-sizes"))
    return mixed.select("doc_id", "size", "source_size", "target",
                        (F.col("copies") * F.col("size")).cast("long").alias("taken"))
