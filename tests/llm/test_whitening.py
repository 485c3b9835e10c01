"""Whitening against a dense decomposition with exact integers."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperlens.llm import whitening

VECTORS = "vec_id long, embedding array<double>"


def dense(a, scale=64, offset=1_000_000):
    """Of all rows: x, different x, mean, falling variances and their directions."""
    x = np.array([[math.floor(c * scale) + offset for c in row] for row in a], dtype=object)
    u = np.array(sorted({tuple(r) for r in x}), dtype=object)
    n, sums = len(u), u.sum(axis=0)
    mean = np.array([float(s) / n for s in sums])
    c = u.astype(float) - mean
    values, right = np.linalg.svd(c, full_matrices=False)[1:]
    return x, n, sums, mean, values ** 2 / n, right


def check(got, a, ids, components=16):
    x, n, sums, mean, values, right = dense(a)
    k = min(components, int((values > values[0] * 1e-14).sum()))
    assert len(got) == len(a) * k and set(got["component"]) == set(range(1, k + 1))
    assert (got["n"] == n).all() and (got["identity_error"] <= 1e-8).all()
    for i in sorted(set(ids)):
        mine = got[got["vec_id"] == i] if "vec_id" in got else got[got["id"] == i]
        want = sorted(int(((n * x[j] - sums) ** 2).sum()) for j in np.flatnonzero(np.array(ids) == i) for _ in range(k))
        assert sorted(mine["deviation"]) == want
    explained = got.groupby("component")["explained"].first().to_numpy()
    assert np.allclose(explained, values[:k] / values.sum(), rtol=1e-6, atol=0)
    return mean, values, right, k


def test_against_dense(spark):
    rng = np.random.default_rng(1)
    a = rng.normal(size=(300, 20)) * np.linspace(1, 5, 20)
    a = np.vstack([a, a[:40], a[:1].repeat(30, axis=0)])  # copies are fitted once
    ids = list(range(len(a)))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in zip(ids, a)], VECTORS).repartition(4)
    got = whitening.whiten(df.withColumns({"n": F.lit(0), "x": F.lit("?"), "component": F.lit(1)})).toPandas()
    mean, values, right, k = check(got, a, ids)
    x = np.floor(64 * a) + 1_000_000
    want = (x - mean) @ right[:k].T / np.sqrt(values[:k])
    w = got.pivot_table(index="id", columns="component", values="whitened").loc[ids].to_numpy()
    sign = np.sign((w * want).sum(axis=0))
    assert np.abs(w * sign - want).max() < 1e-6


def test_bad_condition_and_few_directions(spark):
    """Variances far apart, one column a copy of another, one constant."""
    rng = np.random.default_rng(2)
    a = rng.normal(size=(200, 6)) * [1, 1e4, 0, 30, 1, 1]
    a[:, 4] = np.floor(a[:, 0] * 64) / 64 * 2 ** 10
    a[:, 0] = np.floor(a[:, 0] * 64) / 64
    ids = list(range(len(a)))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in zip(ids, a)], VECTORS)
    got = whitening.whiten(df).toPandas()
    assert check(got, a, ids)[3] == 4


def test_odd_vectors(spark):
    good = [(1, [1.0, 2.0]), (1, [3.0, 5.0]), (None, [4.0, 4.0]), (2, [1.0, 2.0])]
    odd = [(3, None), (4, []), (5, [1.0, None]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]),
           (8, [1e300, 1.0]), (9, [1.0, 2.0, 3.0]), (None, None)]
    got = whitening.whiten(spark.createDataFrame(good + odd, VECTORS)).toPandas()
    assert len(got) == 8 and got["id"].isna().sum() == 2 and set(got["id"].dropna()) == {1, 2}
    assert (got["n"] == 3).all() and got["identity_error"].max() < 1e-9
    one = spark.createDataFrame([(1, [1.0, 2.0])] * 3, VECTORS)
    assert whitening.whiten(one).count() == whitening.whiten(one.limit(0)).count() == 0


def test_large_numbers_are_exact(spark):
    a = [[2.0 ** 40, -2.0 ** 40 + i, float(i * i)] for i in range(5)] + [[-2.0 ** 41, 3.0, 4.0]]
    x, n, sums, *_ = dense(a)
    got = whitening.deviations(x.astype(np.int64), n, [int(s) for s in sums])
    want = [int(((n * r - sums) ** 2).sum()) for r in x]
    assert got == [w if w < 1 << 63 else None for w in want] and None in got
    near = [[float(i), 1.0] for i in range(4)]
    x, n, sums, *_ = dense(near)
    assert whitening.deviations(x.astype(np.int64), n, [int(s) for s in sums]) == [
        int(((n * r - sums) ** 2).sum()) for r in x]


def test_solve_and_shift():
    rng = np.random.default_rng(3)
    r = np.triu(rng.normal(size=(5, 5))) + 5 * np.eye(5)
    q = rng.normal(size=(7, 5))
    assert np.allclose(whitening.solve_upper(q @ r, r), q)
    singular = np.outer([1, 2, 3], [1, 2, 3.0])
    f = whitening.shifted_cholesky(singular, 10)
    assert np.allclose(f.T @ f, singular) and (np.tril(f, -1) == 0).all()


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01"])
def test_whole_table(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    got = whitening.op12_shifted_cholesky_whitening(spark, sf).toPandas()
    check(got, [r["embedding"] for r in rows], [r["vec_id"] for r in rows])
