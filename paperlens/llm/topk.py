"""Exact top-k inner products with block-at-a-time pruning.

Rows are dealt into ranges in order of the signs of their components, so that rows of
one direction, copies above all, lie together, and ranges into blocks. A block keeps a
forward index (the integer vectors of its rows) and, a dimension, the largest
and smallest component. A query's bound for a block is the sum over dimensions
of the larger of its component times either. For each query the blocks of a
range are taken in the order of their bounds and scored through the forward
index until the next bound falls below the query's k-th score so far. That begins, in
every task, with the k-th score among the rows of the query's own range.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperlens.llm.common import written

#: rows of a block, of a range, queries of a chunk
BLOCK_ROWS, RANGE_ROWS, CHUNK_ROWS = 128, 4096, 256
#: chunks that a task keeps the best rows of, partitions that rows are sorted in at most (the driver
#: gets a sample for each)
TASK_CHUNKS, MOST_PARTS = 64, 200


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component as long; null if the vector or a component is
    null or not finite, or does not fit a long."""
    x = F.transform(vector, lambda v: v.cast("double") * scale)
    good = F.forall(x, lambda v: F.coalesce(F.abs(v) < float(1 << 62), F.lit(False)))
    return F.when(good, F.transform(x, lambda v: F.floor(v)))


def signs(v: Column) -> Column:
    """The signs of the first 63 components as the bits of a long, the first one highest."""
    return F.aggregate(F.slice(v, 1, 63), F.lit(0).cast("long"), lambda bits, x: bits * 2 + (x > 0).cast("long"))


def _packed(rows: DataFrame, n_rows: int, name: str) -> DataFrame:
    """Rows (id, v, row, more) as one row for each ``n_rows`` of them that lie together by
    direction: ids, rows, lengths, all components, and the numbers ``more``."""
    parts = max(1, min(-(-rows.count() // n_rows), MOST_PARTS))

    def pack(batches):
        import pyarrow as pa
        ids, at, vectors, more = [], [], [], []
        kinds = pa.schema([(c, pa.binary()) for c in ("ids", "at", "dims", "v", "more")])

        def made():
            dims = np.array([len(v) for v in vectors], "<i4")
            flat = np.concatenate(vectors)
            least, most = flat.min(initial=0), flat.max(initial=0)
            kind = next(t for t in ("<i2", "<i4", "<i8") if np.iinfo(t).min <= least and most <= np.iinfo(t).max)
            return pa.RecordBatch.from_pydict(
                {"ids": [np.array(ids, "<i8").tobytes()], "at": [np.array(at, "<i8").tobytes()],
                 "dims": [dims.tobytes()], "v": [flat.astype(kind).tobytes()],
                 "more": [np.array(more, "<i8").tobytes()]}, kinds)

        for b in batches:
            for i, v, row, m in zip(*(b.column(c) for c in range(4))):
                ids.append(i.as_py())
                at.append(row.as_py())
                vectors.append(np.array(v.as_py(), np.int64))
                more.append(m.as_py())
                if len(ids) == n_rows:
                    yield made()
                    ids, at, vectors, more = [], [], [], []
        if ids:
            yield made()

    keyed = rows.select("id", "v", "row", "more", signs(F.col("v")).alias("code"))
    ranged = keyed.repartitionByRange(parts, "code", "id", "row").sortWithinPartitions("code", "id", "row")
    made = ranged.mapInArrow(pack, "ids binary, at binary, dims binary, v binary, more binary")
    return written(made.withColumn("unit", F.monotonically_increasing_id()), name)


def _matrix(ids: bytes, dims: bytes, v: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Ids and a matrix, a row a vector; shorter vectors end in zeros. Components take as many
    bytes as their number tells."""
    ids, dims = np.frombuffer(ids, "<i8"), np.frombuffer(dims, "<i4")
    v = np.frombuffer(v, f"<i{len(v) // max(1, int(dims.sum())) or 8}")
    out = np.zeros((len(ids), int(dims.max(initial=0))), np.int64)
    out[np.arange(out.shape[1])[None, :] < dims[:, None]] = v
    return ids, out


def _same_width(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    w = max(a.shape[1], b.shape[1])
    return (np.pad(a, ((0, 0), (0, w - a.shape[1]))), np.pad(b, ((0, 0), (0, w - b.shape[1]))))


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer a @ b.T; by floating point where that is exact."""
    size = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if size < 2 ** 53:
        return (a.astype(float) @ b.T.astype(float)).astype(np.int64)
    if size < 2 ** 62:
        return a @ b.T
    raise OverflowError("an inner product exceeds 64 bits")


class Best:
    """The k best (score, id) of each query of a chunk among all rows but its own (``rows``);
    ties to the smaller id."""

    def __init__(self, rows: np.ndarray, k: int, floor: np.ndarray | None = None):
        ids = self.own = rows
        self.floor = np.full(len(rows), np.iinfo(np.int64).min) if floor is None else floor
        self.k, self.scored = k, 0
        self.score = np.full((len(ids), k), np.iinfo(np.int64).min)
        self.id = np.full((len(ids), k), np.iinfo(np.int64).max)
        self.found = np.zeros((len(ids), k), bool)

    def kth(self) -> np.ndarray:
        """A score that k rows reach, as far as is known; a bound below it cannot matter."""
        return np.maximum(self.floor, np.where(self.found[:, -1], self.score[:, -1], np.iinfo(np.int64).min))

    def add(self, which: np.ndarray, ids: np.ndarray, at: np.ndarray, score: np.ndarray) -> None:
        self.scored += score.size
        other = (at[None, :] != self.own[which][:, None]) & (score >= self.kth()[which][:, None])
        some = other.any(axis=1)  # the others' best rows stay
        which, score, other = which[some], score[some], other[some]
        s = np.concatenate([self.score[which], score], axis=1)
        i = np.concatenate([self.id[which], np.broadcast_to(ids, score.shape)], axis=1)
        f = np.concatenate([self.found[which], other], axis=1)
        order = np.lexsort((i, -s, ~f), axis=1)[:, :self.k]
        for name, x in (("score", s), ("id", i), ("found", f)):
            getattr(self, name)[which] = np.take_along_axis(x, order, axis=1)


def scan(best: Best, queries: np.ndarray, ids: np.ndarray, at: np.ndarray, rows: np.ndarray,
         block_rows: int) -> None:
    """Adds the rows of a range (their ids, places and vectors), block by block as far as bounds demand."""
    queries, rows = _same_width(queries, rows)
    starts = np.arange(0, len(rows), block_rows)
    high = np.maximum.reduceat(rows, starts, axis=0)
    low = np.minimum.reduceat(rows, starts, axis=0)
    bound = _product(np.maximum(queries, 0), high) + _product(np.minimum(queries, 0), low)
    first = bound.argmax(axis=1)
    left = np.ones(bound.shape, bool)
    # each query's best block, then the others in turn, each for all queries that it is open to
    turns = [(j, first == j) for j in np.unique(first)]
    turns += [(j, left[:, j]) for j in np.argsort(-bound.max(axis=0, initial=0), kind="stable")]
    for j, asked in turns:
        # equal to the k-th score may still win by a smaller id
        which = np.flatnonzero(asked & (bound[:, j] >= best.kth()))
        left[which, j] = False
        if len(which):
            own = slice(starts[j], starts[j] + block_rows)
            best.add(which, ids[own], at[own], _product(queries[which], rows[own]))


def floors(rows: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
    """Of the rows numbered ``own``, the k-th score among the other rows."""
    score = _product(rows[own], rows)
    score[np.arange(len(own)), own] = np.iinfo(np.int64).min
    return np.partition(score, len(rows) - k, axis=1)[:, len(rows) - k]


def _floors_of(ranges: DataFrame, k: int, chunk_rows: int) -> DataFrame:
    """(row, floor): of each query the k-th score among its range, where that has k other rows."""
    def seed(batches):
        import pyarrow as pa
        for b in batches:
            for r in b.to_pylist():
                _, rows = _matrix(r["ids"], r["dims"], r["v"])
                at, asked = np.frombuffer(r["at"], "<i8"), np.flatnonzero(np.frombuffer(r["more"], "<i8"))
                for first in range(0, len(asked) if len(rows) > k else 0, chunk_rows):
                    own = asked[first:first + chunk_rows]
                    yield pa.RecordBatch.from_arrays([pa.array(at[own]), pa.array(floors(rows, own, k))], ["row", "floor"])

    return ranges.mapInArrow(seed, "row long, floor long")


def top_k(df: DataFrame, is_query: Column, k: int, id_col: str, vector_col: str, scale: int = 256,
          block_rows: int = BLOCK_ROWS, range_rows: int = RANGE_ROWS,
          chunk_rows: int = CHUNK_ROWS, every_row: bool = False) -> DataFrame:
    """(query_id, rank, id, score): each query's ``k`` highest integer inner products with
    all other rows, all of them if there are fewer; ties to the smaller id.

    Vectors that are null or hold a null, NaN or infinite component, and rows without an id,
    take no part. A shorter vector counts as ending in zeros. Of several vectors under one id
    the least (in the order of arrays) counts, so repeated rows are one; with ``every_row``
    each row is a candidate, and a query of its own where ``is_query`` holds for it: rows of
    one id are ranked apart, and meet each other. Other columns are left out. Empty tables
    give empty results. Scores over 64 bits fail the job.

    Queries are a stated set; each chunk of queries meets each range of rows once. A task keeps
    the best rows of up to ``TASK_CHUNKS`` chunks while its ranges go by, so that bounds found
    on one range prune the next. Ahead of that, each query is
    scored with the rows of its own range, which gives all chunks a k-th score to begin with.
    """
    d = df.select(F.col(id_col).cast("long").alias("id"), quantised(F.col(vector_col), scale).alias("v"),
                  F.coalesce(is_query, F.lit(False)).alias("q")).where("id IS NOT NULL AND v IS NOT NULL")
    if not every_row:
        d = d.groupBy("id").agg(F.min("v").alias("v"), F.max("q").alias("q"))
    # rows are numbered as they are written: every reader sees the same numbers
    d = written(d.withColumn("row", F.monotonically_increasing_id()), "topk-rows")
    ranges = _packed(d.select("id", "v", "row", F.col("q").cast("long").alias("more")), range_rows, "topk-ranges")
    known = d.where("q").join(_floors_of(ranges, k, chunk_rows), "row", "left")
    least = F.lit(int(np.iinfo(np.int64).min))
    chunks = _packed(known.select("id", "v", "row", F.coalesce("floor", least).alias("more")), chunk_rows, "topk-queries")
    # every pair of range and chunk, without a join key: ranges stream from their files past a group of
    # chunks, so that neither is copied for the other, nor goes through the driver or a shuffle
    groups = max(1, -(-chunks.count() // TASK_CHUNKS))
    asked = chunks.select(F.col("unit").alias("chunk"), F.col("ids").alias("q_ids"), F.col("at").alias("q_at"),
                          F.col("dims").alias("q_dims"), F.col("v").alias("q_v"), F.col("more").alias("q_floor"))
    met = ranges.drop("more").hint("shuffle_replicate_nl").crossJoin(asked.repartition(groups))

    def search(batches):
        import pyarrow as pa
        kinds = pa.schema([("query_id", pa.int64()), ("query", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])
        at_range, ids, rows, known = None, None, None, {}
        for b in batches:
            for r in b.to_pylist():
                if r["chunk"] not in known:
                    q_ids, q = _matrix(r["q_ids"], r["q_dims"], r["q_v"])
                    known[r["chunk"]] = q_ids, q, Best(np.frombuffer(r["q_at"], "<i8"), k, np.frombuffer(r["q_floor"], "<i8"))
                if r["unit"] != at_range:
                    at_range, (ids, rows) = r["unit"], _matrix(r["ids"], r["dims"], r["v"])
                _, q, best = known[r["chunk"]]
                scan(best, q, ids, np.frombuffer(r["at"], "<i8"), rows, block_rows)
        for q_ids, _, best in known.values():
            at = np.nonzero(best.found)
            yield pa.RecordBatch.from_arrays(
                [pa.array(q_ids[at[0]]), pa.array(best.own[at[0]]), pa.array(best.id[at]), pa.array(best.score[at])], schema=kinds)

    near = met.mapInArrow(search, "query_id long, query long, id long, score long")
    # at most k rows a task and query; Spark drops ranks above k before it shuffles them
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), "id"))
    return (near.withColumn("rank", rank).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "id", "score"))


def op7_block_pruned_search(spark, sf_dir: str) -> DataFrame:
    """The 5 highest inner products for every row whose id is divisible by 50, with every other row."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(e, F.col("vec_id") % 50 == 0, 5, "vec_id", "embedding", every_row=True).withColumnRenamed("id", "vec_id")


#: exact over the whole table; used where DuckDB holds every pair of query and row
OP7_SQL = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v,
  row_number() OVER () AS n
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, q.n, c.vec_id, CAST(list_inner_product(
    CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM e q JOIN e c ON q.vec_id % 50 = 0 AND c.n <> q.n),
r AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5"""
