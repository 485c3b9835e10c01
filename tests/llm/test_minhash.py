"""MinHash near-duplicates against all pairs of sets."""

from __future__ import annotations

import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperlens.llm import minhash
from tests.llm.helpers import SCHEMA, empty_docs, odd_docs, odd_rows, prose


def shingle_set(text, size):
    w = (text or "").encode().lower().split()
    return frozenset([b" ".join(w)] if 0 < len(w) < size else (b" ".join(w[i:i + size]) for i in range(len(w) - size + 1)))


def expected(rows, size, similarity=80):
    """(id, shingles, component) of every row, by all pairs of different sets."""
    sets = [shingle_set(t, size) for _, t in rows]
    different = [s for s in set(sets) if s]
    group = list(range(len(different)))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, a in enumerate(different):
        for j in range(i):
            b = different[j]
            both = len(a & b)
            if 100 * both >= similarity * (len(a) + len(b) - both):
                group[top(i)] = top(j)
    place = {s: top(i) for i, s in enumerate(different)}
    ids = defaultdict(list)
    for (key, _), s in zip(rows, sets):
        if s and key is not None:
            ids[place[s]].append(key)
    return sorted(((key, len(s), min(ids[place[s]], default=None) if s else key) for (key, _), s in zip(rows, sets)), key=repr)


def results(df, **more):
    return sorted((tuple(r) for r in minhash.near_duplicates(df, **more).collect()), key=repr)


def test_odd_rows(spark):
    rows = [r[:2] for r in odd_rows()]
    for size in (1, 4):
        assert results(odd_docs(spark), shingle=size) == expected(rows, size)
    assert results(empty_docs(spark)) == []
    assert results(spark.createDataFrame([(1, None, None, None), (None, " ", None, None)], SCHEMA)) == [
        (1, 0, 1), (None, 0, None)]


def chains(seed=5, steps=12):
    """Paths of texts each a little farther from the first, and stars of copies near one text
    only: ends are no links, the components are whole only by the texts between."""
    rng = random.Random(seed)
    texts = []
    for _ in range(4):
        words = prose(rng, 90).split()
        for _ in range(steps):
            texts.append(" ".join(words))
            words[rng.randrange(90)] = rng.choice(["Xa", "yb", "zc"]) + str(rng.random())[2:5]
    for _ in range(3):
        words = prose(rng, 120).split()
        texts.append(" ".join(words))
        for _ in range(25):
            copy = list(words)
            for at in (rng.randrange(40), 40 + rng.randrange(40), 80 + rng.randrange(40)):
                copy[at] = "q" + str(rng.random())[2:6]
            texts.append(" ".join(copy))
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("block", [3, 256])
def test_chains_and_stars(spark, block, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", block)
    rows = chains()
    want = expected(rows, 4)
    assert len({r[2] for r in want}) < len(rows) / 4
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert results(df.withColumns({c: F.lit(1) for c in ("key", "n", "sig", "bucket", "id")}), shingle=4) == want


@pytest.mark.parametrize("similarity", [50, 100])
def test_other_similarities(spark, similarity):
    rows = chains(6, 6)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert results(df, shingle=3, similarity=similarity) == expected(rows, 3, similarity)


def test_similarity_is_at_the_bound(spark):
    """Four of five shingles shared is a link, a hair less is none."""
    rows = [(1, "a b c d"), (2, "a b c d e"), (3, "p q r s"), (4, "p q r s t u")]
    assert [r[2] for r in results(spark.createDataFrame(rows, "doc_id long, text string"), shingle=1)] == [1, 1, 3, 4]


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = minhash.op13_bayesian_minhash(spark, sf).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=repr) == expected(rows, 4)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_signatures_agree_as_often_as_sets():
    functions = minhash.hash_functions(4000)
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 63, 300).astype(np.uint64)
    for shared in (30, 150, 270):
        y = np.append(x[:shared], rng.integers(0, 1 << 63, 300 - shared).astype(np.uint64))
        jaccard = shared / (600 - shared)
        rate = (minhash.signature(x, functions) == minhash.signature(y, functions)).mean()
        assert abs(rate - jaccard) < 4 * math.sqrt(jaccard * (1 - jaccard) / 4000)


def test_posterior_bounds():
    """The bound is where the posterior mass above the similarity, by integration, passes the
    miss probability; a pair at the similarity is hardly ever pruned, a distant one at once."""
    least = minhash.least_matches(80, 1e-4)
    s = np.linspace(0, 1, 200_001)[1:-1]
    for i, m in enumerate(least):
        n = minhash.BATCH * (i + 1)
        for matches, kept in ((m, True), (m - 1, False)):
            log = matches * np.log(s) + (n - matches) * np.log(1 - s)
            w = np.exp(log - log.max())
            assert (w[s >= .8].sum() / w.sum() >= 1e-4) == kept
    assert (1 - .8 ** minhash.BAND_ROWS) ** minhash.bands_for(80) <= minhash.MISS
    rng = np.random.default_rng(2)
    width = minhash.BATCH * minhash.BATCHES
    u = rng.integers(0, 1 << 32, (20_000, width)).astype(np.uint32)
    for jaccard, lo, hi in ((.8, .999, 1), (.3, 0, 0)):
        v = np.where(rng.random(u.shape) < jaccard, u, u + 1)
        n = np.full(len(u), 100)
        kept = len(minhash.survivors(u, v, n, n, 80, minhash.least_matches(80)))
        assert lo <= kept / len(u) <= hi
    assert len(minhash.survivors(u, u, n, n * 2, 80, least)) == 0  # sizes alone rule a link out
