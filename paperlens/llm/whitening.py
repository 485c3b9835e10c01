"""Whitening of embeddings by shifted CholeskyQR.

The centred rows A are never decomposed in one place. Each pass is one job: every
task takes its rows through the triangular solves of the factors found so far,
Q = A R1^-1 R2^-1 ..., and adds up the Gram matrix of what comes out; the driver
gets the sum, d x d numbers, and factors it. The first pass shifts the diagonal, so
that Cholesky succeeds however badly conditioned A is; Q is then so much better
conditioned that a few passes make its columns orthonormal. A = Q R with R the
product of the factors, so the singular values and right vectors of the small R
are those of A: they give the principal components and their variances without
squaring the condition number.

Directions in which the rows don't vary are no obstacle: Q has nothing there, the
root of its last Gram matrix is zero there, and they give no component.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperlens.llm.common import bound_batches, in_pieces, written

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 16
#: passes at most; Gram matrices this near to 0 and 1 end them sooner
PASSES, ORTHONORMAL = 12, 1e-12
#: entries beyond are no exact whole numbers as doubles
LARGEST = float(1 << 53)
_LONG = (1 << 63) - 1


def scaled(vec: str = "embedding", scale: int = SCALE, offset: int = OFFSET):
    """floor(scale * c) + offset of each entry, as longs."""
    return F.transform(F.col(vec), lambda c: F.floor(c.cast("double") * scale) + F.lit(offset).cast("long"))


def whole_vectors(df: DataFrame, id_col: str, vec_col: str, scale: int, offset: int) -> DataFrame:
    """(id, x) of the rows whose vector has entries, all of them finite numbers in range."""
    d = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vec_col}`").cast("array<double>").alias("v"))
    fine = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) * scale < LARGEST))
    # null where it must not be computed: an optimizer may move the filter behind the scaling
    x = F.when(fine, F.col("v"))
    return (d.select("id", x.alias("v")).where(F.col("v").isNotNull() & (F.size("v") > 0))
            .select("id", scaled("v", scale, offset).alias("x")))


def _matrix(column) -> np.ndarray:
    """An Arrow column of lists of one length as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _dims(rows: DataFrame) -> int:
    """The most frequent length of x (of several, the longest); 0 without rows."""
    top = (rows.groupBy(F.size("x").alias("d")).count()
           .orderBy(F.col("count").desc(), F.col("d").desc()).first())
    return top["d"] if top else 0


def _sums(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """(n, S): rows of the fit list and the exact sum of each dimension."""
    def run(batches):
        import pyarrow as pa
        n, high, low = 0, np.zeros(d, np.int64), np.zeros(d, np.int64)
        for b in in_pieces(batches, 4096):
            x = _matrix(b.column(0))
            n, high, low = n + len(x), high + (x >> 26).sum(axis=0), low + (x & ((1 << 26) - 1)).sum(axis=0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(d)), pa.array(np.full(d, n)), pa.array(high), pa.array(low)], ["i", "n", "h", "l"])

    got = (fit.select("x").mapInArrow(run, "i long, n long, h long, l long").groupBy("i")
           .agg(F.sum("n").alias("n"), F.sum("h").alias("h"), F.sum("l").alias("l")).orderBy("i").collect())  # d rows
    return (got[0]["n"] if got else 0), [(r["h"] << 26) + r["l"] for r in got]


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S / n: exact whole parts first, so that nothing cancels."""
    whole = np.array([s // n for s in sums], np.int64)
    rest = np.array([(s % n) / n for s in sums])
    return (x - whole) - rest


def _gram(fit: DataFrame, d: int, width: int, project) -> np.ndarray:
    """Sum over the rows of the outer products of what ``project`` makes of them: one pass,
    partial sums in the tasks, ``width`` squared numbers to the driver."""
    def run(batches):
        import pyarrow as pa
        g = np.zeros((width, width))
        for b in in_pieces(batches, 4096):
            q = project(_matrix(b.column(0)))
            g += q.T @ q
        at = np.triu_indices(width)
        yield pa.RecordBatch.from_arrays(
            [pa.array(at[0] * width + at[1]), pa.array(g[at])], ["at", "g"])

    got = (fit.select("x").mapInArrow(run, "at long, g double").groupBy("at")
           .agg(F.sum("g").alias("g")).toPandas())
    g = np.zeros((width, width))
    at = got["at"].to_numpy(np.int64)
    g[at // width, at % width] = got["g"].to_numpy()
    return np.triu(g) + np.triu(g, 1).T


def solve_upper(rows: np.ndarray, r: np.ndarray) -> np.ndarray:
    """rows R^-1 for an upper triangular R: columns from the first to the last."""
    out = np.empty_like(rows)
    for j in range(r.shape[0]):
        out[:, j] = (rows[:, j] - out[:, :j] @ r[:j, j]) / r[j, j]
    return out


def shifted_cholesky(gram: np.ndarray, n: int) -> np.ndarray:
    """Upper triangular R with R'R = gram, plus a shift of the diagonal where the matrix is
    not safely positive: 11 (n d + d (d + 1)) times the unit roundoff times its norm."""
    d = len(gram)
    values = np.linalg.eigvalsh(gram)
    shift = 11 * (n * d + d * (d + 1)) * np.finfo(float).eps / 2 * values[-1]
    if values[0] > 1e3 * shift:
        shift = 0.0
    return np.linalg.cholesky(gram + shift * np.eye(d)).T


@dataclass
class Whitening:
    """``n`` and ``sums`` of the fit list; ``basis``: a column a component, in order of
    falling ``values`` (variances); ``total``: variance over all dimensions; ``error``: the
    largest entry of the whitened fit list's covariance less the identity; ``passes``."""

    n: int
    sums: list[int]
    basis: np.ndarray
    values: np.ndarray
    total: float
    error: float | None
    passes: int

    @property
    def scaled_basis(self) -> np.ndarray:
        return self.basis / np.sqrt(self.values)


def fit_whitening(fit: DataFrame, d: int, components: int = COMPONENTS) -> Whitening:
    """Principal components of ``fit``, a written table of different ``x`` of length ``d``."""
    n, sums = _sums(fit, d) if d else (0, [])
    none = Whitening(n, sums, np.zeros((d, 0)), np.zeros(0), 0.0, None, 0)
    if not n:
        return none
    factors: list[np.ndarray] = []
    r, total = np.eye(d), 0.0
    for k in range(PASSES):
        def project(x, factors=tuple(factors)):
            q = centred(x, n, sums)
            for f in factors:
                q = solve_upper(q, f)
            return q

        gram = _gram(fit, d, d, project)
        if k == 0:
            total = float(np.trace(gram)) / n
            if total == 0:
                return none
        values, vectors = np.linalg.eigh(gram)
        if k and np.minimum(np.abs(values), np.abs(values - 1)).max() < max(ORTHONORMAL, 1e-15 * n):
            break
        factors.append(shifted_cholesky(gram, n))
        r = factors[-1] @ r
    # A = Q R and Q'Q = gram: its root times R has the singular values of A, and exact zeros
    # where Q has nothing
    root = np.where(values > 0.5, np.sqrt(np.maximum(values, 0)), 0.0)[:, None] * vectors.T
    _, sigma, right = np.linalg.svd(root @ r)
    keep = np.flatnonzero(sigma > sigma[0] * d * np.finfo(float).eps)[:components]
    basis = right[keep].T
    basis = basis * np.where(basis[np.abs(basis).argmax(axis=0), np.arange(len(keep))] < 0, -1, 1)
    model = Whitening(n, sums, basis, sigma[keep] ** 2 / n, total, None, len(factors))
    down = model.scaled_basis
    cov = _gram(fit, d, len(keep), lambda x: centred(x, n, sums) @ down) / n
    model.error = float(np.abs(cov - np.eye(len(keep))).max())
    return model


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over the dimensions of (n x - S)^2, exact; null beyond a long."""
    whole = np.array([s // n for s in sums], np.int64)
    rest = np.array([s % n for s in sums], np.int64)
    y = x - whole
    if n * (float(np.abs(y).max(initial=0)) + 1) < 3e9 / np.sqrt(x.shape[1]):
        return ((n * y - rest) ** 2).sum(axis=1).tolist()
    each = ((n * y.astype(object) - rest.astype(object)) ** 2).sum(axis=1).tolist()
    return [e if e <= _LONG else None for e in each]


def whiten(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding",
           components: int = COMPONENTS, scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error): a row for each
    vector and component.

    Vectors that are null, empty or hold a null, infinite or undefined entry, or one beyond
    2^53 / scale, are left out, as are those of another length than most have (of several
    such lengths the longest counts). Equal vectors are fitted once and all get their rows;
    repeated and null ids are ordinary. ``deviation`` is null beyond a long. There are fewer
    components where the vectors span fewer directions; equal variances leave the choice
    of directions open. No vectors, or only equal ones, give an empty result. Other columns
    are left out, whatever their names.
    """
    bound_batches(df.sparkSession)
    rows = whole_vectors(df, id_col, vec_col, scale, offset)
    # equal vectors meet in a partial aggregate before anything is shuffled
    different = written(rows.select("x").distinct(), "whitening")
    d = _dims(different)
    fit = different.where(F.size("x") == d)
    model = fit_whitening(fit, d, components)
    n, sums, down = model.n, model.sums, model.scaled_basis
    explained = (model.values / model.total if model.total else model.values).tolist()
    k, error = down.shape[1], model.error

    def run(batches):
        import pyarrow as pa
        for b in in_pieces(batches, 4096):
            if not k or not b.num_rows:
                continue
            x = _matrix(b.column(1))
            white = centred(x, n, sums) @ down
            at = np.repeat(np.arange(len(x)), k)
            m = len(at)
            dev = pa.array(deviations(x, n, sums), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(at)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                 pa.array(np.full(m, n)), dev.take(pa.array(at)), pa.array(white.ravel()),
                 pa.array(np.tile(explained, len(x))), pa.array(np.full(m, error))],
                ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.where(F.size("x") == d).mapInArrow(
        run, f"id {kind}, component int, n long, deviation long, whitened double, explained double, "
             "identity_error double")


def op12_shifted_cholesky_whitening(spark, sf_dir: str) -> DataFrame:
    """Whitened components of every embedding."""
    d = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return whiten(d).withColumnRenamed("id", "vec_id")
