"""Uniform shuffle into shards by a hypergeometric communication matrix.

Input partition i holds n_i rows, shard j holds m_j rows, both known
before anything moves. How many rows go from i to j under a uniformly random
permutation follows a multivariate hypergeometric law, so the whole matrix is
drawn first. Each partition then deals its rows out by a random arrangement of
exactly those shard labels (the local permutation), the rows are exchanged, and
each shard permutes again. The result is a uniform permutation with
exact sizes and one shuffle.

Within its shard a row has a random place, a 64-bit number; the shard's rows are cut into
cells by the first bits of it, so that no task ever holds a shard, and the cells' counts
tell at which slot each begins.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperlens.llm.common import documents, mix64, small, with_fields, written

#: rows of a cell aimed at, and most entries of the communication matrix; cells whose counts
#: are summed up together
CELL_ROWS = 4096
MATRIX_ENTRIES = 1 << 18
SUMMED_CELLS_BITS = 12


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of ``n`` rows drawn without replacement are good; any population."""
    if good + bad < 10 ** 9:
        return int(rng.hypergeometric(good, bad, n))
    # above numpy's bound: ratio of uniforms around the mode (log-gamma densities)
    total, k, m = good + bad, min(good, bad), min(n, good + bad - n)
    mode = (m + 1) * (k + 1) // (total + 2)
    mean = m * k / total
    var = mean * (1 - k / total) * (total - m) / max(1, total - 1)
    width = 2 * math.sqrt(2 / math.e) * math.sqrt(var + 0.5) + 3 - 2 * math.sqrt(3 / math.e)

    def log_weight(x):
        return -(math.lgamma(x + 1) + math.lgamma(k - x + 1) + math.lgamma(m - x + 1)
                 + math.lgamma(total - k - m + x + 1))

    top = log_weight(mode)
    while True:
        u, v = rng.random(), rng.random()
        x = math.floor(mean + 0.5 + width * (v - 0.5) / max(u, 1e-300))
        if max(0, m + k - total) <= x <= min(m, k) and 2 * math.log(max(u, 1e-300)) <= log_weight(x) - top:
            break
    if good > bad:
        x = m - x
    return x if m == n else good - x


def communication_matrix(sizes: list[int], cells: list[int], seed: int) -> np.ndarray:
    """Rows that go from partition i to cell j, as a uniform permutation would send them."""
    rng = np.random.default_rng(seed)
    left = [int(c) for c in cells]
    out = np.zeros((len(sizes), len(cells)), np.int64)
    for i, size in enumerate(sizes):
        rest, pool = int(size), sum(left)
        for j, room in enumerate(left):
            if not rest:
                break
            pool -= room
            x = hypergeometric(rng, room, pool, rest) if pool and room else min(room, rest)
            out[i, j], left[j], rest = x, room - x, rest - x
    return out


def shard_sizes(rows: int, n_shards: int) -> list[int]:
    """Rows of each shard: at most one apart."""
    return [rows // n_shards + (s < rows % n_shards) for s in range(n_shards)]


def cell_bits(rows: int, n_shards: int, cell_rows: int) -> int:
    """Bits that name a cell of a shard: cells of ``cell_rows`` rows or fewer on average,
    however many rows or partitions there are."""
    return max(0, math.ceil(math.log2(max(1, rows / n_shards / cell_rows))))


class Matrix:
    """Rows that go from each partition to each shard, at most ``most`` entries on the driver:
    beyond, it is drawn for groups of consecutive partitions, and a group's entries are
    split among its partitions, again by the hypergeometric law, where they are needed."""

    def __init__(self, sizes: list[int], n_shards: int, seed: int, most: int = MATRIX_ENTRIES):
        self.sizes, self.seed = sizes, seed
        self.each = max(1, -(-len(sizes) * n_shards // max(most, n_shards)))
        groups = [sum(sizes[i:i + self.each]) for i in range(0, len(sizes), self.each)]
        self.groups = communication_matrix(groups, shard_sizes(sum(sizes), n_shards), seed)

    def row(self, i: int) -> np.ndarray:
        """Of partition ``i``; the same wherever it is asked for."""
        g = i // self.each
        if self.each == 1:
            return self.groups[i]
        own = self.sizes[g * self.each:(g + 1) * self.each]
        return communication_matrix(own, self.groups[g], [self.seed, 2, g])[i - g * self.each]


def shard_rows(df: DataFrame, n_shards: int, seed: int = 0, cell_rows: int = CELL_ROWS) -> DataFrame:
    """All rows of ``df`` with ``shard`` (0 to n_shards - 1) and ``slot``, a uniformly
    random place in the shard, gapless from 0; shard sizes differ by at most one.

    Rows are told apart by place alone, so nulls, empty and long texts, ties and
    repeated rows are ordinary rows; an empty table gives an empty result. Input
    columns named ``shard`` or ``slot`` are replaced, others are kept untouched.
    The rows are written once to the shared folder together with their partition and
    place in it, so that neither lost executors nor another split of the files among
    tasks changes which rows a partition holds.
    """
    if n_shards < 1:
        raise ValueError("at least one shard")
    keep = [c for c in df.columns if c.lower() not in ("shard", "slot")]
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"))
    rows = written(rows.withColumn("at", F.monotonically_increasing_id()), "shard-rows")
    part = F.shiftright("at", 33)  # such numbers begin with the partition
    counts = rows.groupBy(part.alias("p")).count().orderBy("p").collect()  # a row a partition
    sizes = [r["count"] for r in counts]
    # partition sizes and at most MATRIX_ENTRIES entries
    sent = df.sparkSession.sparkContext.broadcast(
        ({r["p"]: i for i, r in enumerate(counts)}, Matrix(sizes, n_shards, seed)))
    key = int(mix64(np.array([seed % (1 << 63)], np.uint64))[0])

    def dealt(batches):
        import pyarrow as pa
        number, matrix = sent.value
        here, order = None, None
        for b in batches:
            at = b.column("at").to_numpy()
            shard = np.zeros(len(at), np.int32)
            parts = at >> 33
            for p in np.unique(parts).tolist():
                if p != here:
                    here, deal = p, matrix.row(number[p])
                    order = np.repeat(np.arange(len(deal), dtype=np.int32), deal)
                    np.random.default_rng([seed, 1, p]).shuffle(order)
                own = parts == p
                shard[own] = order[at[own] & ((1 << 33) - 1)]
            draw = mix64(mix64(at.astype(np.uint64)) ^ np.uint64(key))
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(shard), pa.array(draw.view(np.int64))], [*b.schema.names, "shard", "draw"])

    bits = cell_bits(sum(sizes), n_shards, cell_rows)
    cell = F.shiftrightunsigned("draw", 64 - bits) if bits else F.lit(0).cast("long")

    def moved(narrow: DataFrame) -> DataFrame:
        return narrow.mapInArrow(dealt, with_fields(narrow, shard="int", draw="long")).withColumn("cell", cell)

    # slot at which a cell begins: sums over blocks of cells, then within a block
    n = written(moved(rows.select("at")).groupBy("shard", "cell").count(), "shard-cells")
    n = n.withColumn("block", F.shiftright("cell", SUMMED_CELLS_BITS))
    below = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = n.groupBy("shard", "block").agg(F.sum("count").alias("sum")).select(
        "shard", "block", F.coalesce(F.sum("sum").over(below.partitionBy("shard")), F.lit(0)).alias("before"))
    inside = Window.partitionBy("shard", "block").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    first = n.join(blocks, ["shard", "block"]).select(
        "shard", "cell", (F.col("before") + F.coalesce(F.sum("count").over(inside), F.lit(0))).alias("first"))
    place = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("draw", "at"))
    slots = moved(rows).withColumn("place", place).join(small(written(first, "shard-starts")), ["shard", "cell"])
    return slots.select(*[F.col("row").getField(c).alias(c) for c in keep], "shard",
                        (F.col("first") + F.col("place") - 1).cast("long").alias("slot"))


def op1_hypergeometric_shuffle(spark, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 7, law ``rows``: counts at most one apart."""
    d = documents(spark, sf_dir).select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).cast("long").alias("text_crc32"))
    return shard_rows(d, 8).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))
