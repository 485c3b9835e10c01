"""Top-k per group without funnelling a group into one task.

``row_number() <= k`` over a window is only limited map-side for small k;
beyond that every row of a group meets in one task. Here the rows are first
ranked inside (group, salt) sub-groups, salt = hash of the row's key, and only
the k best of every sub-group reach the final per-group ranking. The order
must be total (add a tiebreak column) so the result is the exact top-k.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, group_cols: Sequence[str], order: Sequence[Column], k: int,
          salt_cols: Sequence[str], salts: int = 64, rank_col: str = "rank") -> DataFrame:
    """Rows ranked 1..k per group (``rank_col``), in ``order``."""
    g = list(group_cols)
    staged = df.withColumn("__salt", F.pmod(F.xxhash64(*[F.col(c) for c in salt_cols]), F.lit(salts)))
    w1 = Window.partitionBy(*g, "__salt").orderBy(*order)
    first = staged.withColumn("__r1", F.row_number().over(w1)).where(F.col("__r1") <= k)
    # at most salts * k rows per group reach this window
    w2 = Window.partitionBy(*g).orderBy(*order)
    return (first.drop("__r1", "__salt").withColumn(rank_col, F.row_number().over(w2))
            .where(F.col(rank_col) <= k))
