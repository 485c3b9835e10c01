"""Sharding, packing, mixing and search against what plain Python gives."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperlens.llm import mixing, packing, sharding, topk
from tests.llm.helpers import SCHEMA, empty_docs, odd_docs, odd_rows


def test_shard_sizes_slots_and_rows(spark):
    rows = sharding.shard_rows(odd_docs(spark), 4, cell_rows=3).select(*SCHEMA_NAMES, "key", "shard", "slot").collect()
    assert Counter(tuple(r)[:4] for r in rows) == Counter(odd_rows())
    by = defaultdict(list)
    for r in rows:
        assert r["key"] == -7
        by[r["shard"]].append(r["slot"])
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1 and len(by) == 4
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


SCHEMA_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def test_shard_empty_and_few_rows(spark):
    assert sharding.shard_rows(empty_docs(spark), 3).count() == 0
    two = sharding.shard_rows(spark.range(2), 5).collect()
    assert sorted(r["slot"] for r in two) == [0, 0] and len({r["shard"] for r in two}) == 2


def test_shards_outlive_other_partitions(spark):
    """The number of partitions that a table is read in changes between the steps, as it does
    when executors come or go: every row still has its one place."""
    key = "spark.sql.leafNodeDefaultParallelism"
    df = spark.range(4000).repartition(7).withColumn("text", F.lit("x"))
    change, real = iter([1, 3, 2, 9, 4, 1, 5, 2, 8]), sharding.written

    def written(rows, what):
        out = real(rows, what)
        spark.conf.set(key, next(change))
        return out

    try:
        sharding.written = written
        out = sharding.shard_rows(df, 3, cell_rows=100)
        first = {(r["id"], r["shard"], r["slot"]) for r in out.collect()}
        spark.conf.set(key, 6)
        assert {(r["id"], r["shard"], r["slot"]) for r in out.collect()} == first
    finally:
        sharding.written = real
        spark.conf.unset(key)
    assert {i for i, *_ in first} == set(range(4000))
    by = defaultdict(list)
    for _, s, slot in first:
        by[s].append(slot)
    assert sorted(map(len, by.values())) == [1333, 1333, 1334]
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_cells_stay_small_and_matrices_bounded_at_many_partitions():
    """A million partitions of a million rows: cells as small as ever, few entries on the
    driver, and exact shard sizes however the entries are split."""
    rows = 10 ** 12
    cells = 2 ** sharding.cell_bits(rows, 8, sharding.CELL_ROWS)
    assert rows / 8 / cells <= sharding.CELL_ROWS
    sizes = [10 ** 6] * 10 ** 6
    m = sharding.Matrix(sizes, 8, seed=1, most=4096)
    assert m.groups.size <= 4096 and m.groups.sum(axis=0).tolist() == sharding.shard_sizes(rows, 8)
    few = sharding.Matrix([10 ** 6] * 20, 8, seed=1, most=32)
    own = np.array([few.row(i) for i in range(20)])
    assert few.each == 5 and (own.sum(axis=1) == 10 ** 6).all() and abs(own.mean() - 125_000) < 500
    assert (own.reshape(4, 5, 8).sum(axis=1) == few.groups).all()


def test_matrix_sums_and_law():
    """Row and column sums are exact; entries follow the hypergeometric mean and variance."""
    sizes, cells = [40, 0, 25, 35], [30, 20, 50]
    all_ = np.array([sharding.communication_matrix(sizes, cells, s) for s in range(800)])
    assert (all_.sum(axis=2) == sizes).all() and (all_.sum(axis=1) == cells).all()
    mean, var = 40 * 30 / 100, 40 * .3 * .7 * 60 / 99
    assert abs(all_[:, 0, 0].mean() - mean) < 4 * math.sqrt(var / 800)
    assert 0.8 < all_[:, 0, 0].var() / var < 1.25


def test_hypergeometric_above_numpys_bound():
    rng = np.random.default_rng(1)
    good, bad, n = 3 * 10 ** 9, 10 ** 9, 10 ** 6
    x = np.array([sharding.hypergeometric(rng, good, bad, n) for _ in range(2000)])
    sd = math.sqrt(n * .75 * .25)
    assert abs(x.mean() - .75 * n) < 5 * sd / math.sqrt(2000) and 0.9 < x.std() / sd < 1.1


def test_every_place_is_about_equally_likely(spark):
    seen = np.zeros((6, 6))
    df = spark.range(6).repartition(2).persist()
    for seed in range(60):
        for r in sharding.shard_rows(df, 2, seed=seed).collect():
            seen[r["id"], r["shard"] * 3 + r["slot"]] += 1
    df.unpersist()
    assert seen.min() >= 1 and abs(seen - 10).max() < 16


@pytest.fixture(scope="module")
def tokenizer():
    pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer
    return Tokenizer.from_file(packing.tokenizer_path())


def test_pieces_are_the_tokenizers_ids(spark, tokenizer):
    odd = [(100, "It's <|endoftext|> <|ENDOFTEXT|> I'll ÉCOLE don't! x²½ ﬁ Å K İI ΣΑΣ naïve áb 3.14   z", None, None)]
    rows = odd_rows() + odd
    df = spark.createDataFrame(rows, SCHEMA).withColumn("length", F.lit(-7))
    got = packing.token_pieces(df, packing.tokenizer_path(), max_len=64, with_ids=True).collect()
    want = Counter()
    for doc, text, *_ in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        for p, at in enumerate(range(0, len(ids), 64)):
            own = np.array(ids[at:at + 64], "<u4").tobytes()
            want[(doc, p, at, len(own) // 4, zlib.crc32(own), own)] += 1
    assert Counter((*tuple(r)[:5], bytes(r["ids"])) for r in got) == want


def test_word_cache_that_begins_anew_gives_the_same(tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "CACHED_WORDS", 50)
    t = packing.WordTokens(packing.tokenizer_path())
    for _, text, *_ in odd_rows():
        want = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids, "<u4").tobytes()
        assert t.ids([text or ""]) == [want]


def test_packing_is_whole_and_tight(spark):
    rng = random.Random(3)
    lengths = [rng.choice([rng.randint(1, 100), 100, 1]) for _ in range(3000)]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "doc_id long, length long")
    out = packing.pack(df.withColumn("offset", F.lit(-1)), max_len=100, lane_pieces=1000).collect()
    assert sorted((r["doc_id"], r["length"]) for r in out) == list(enumerate(lengths))
    bins = defaultdict(list)
    for r in out:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in bins.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 100
    assert len(bins) <= 1.01 * math.ceil(sum(lengths) / 100) + 3
    assert packing.pack(df.where("false")).count() == 0


def test_open_bins_are_best_fit_and_bounded():
    rng, bins, free = random.Random(4), packing.OpenBins(50, 8), {}
    for _ in range(3000):
        n = rng.randint(1, 50)
        before = dict(free)
        number, offset = bins.place(n)
        fits = [f for f in before.values() if f >= n]
        if fits:
            assert before[number] == min(fits)
        else:
            assert number not in before and offset == 0
            if len(before) == 8:
                still = {x for own in bins.bins.values() for x in own}
                closed = next(b for b in before if b not in still)
                assert before[closed] == min(before.values())  # the fullest
                del free[closed]
        free[number] = 50 - offset - n
        free = {b: f for b, f in free.items() if f}
        assert len(free) <= 8 and bins.count == len(free)


def _targets(sizes, weights, share, most):
    """Fill by weight until none is above its stop."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    t, open_ = dict.fromkeys(names, 0.0), list(names)
    left = share * sum(sizes.values())
    while open_ and left > 1e-9:
        total = sum(w[s] for s in open_)
        for s in open_:
            t[s] += left * w[s] / total
        left = 0.0
        for s in list(open_):
            if t[s] >= most * sizes[s]:
                left += t[s] - most * sizes[s]
                t[s] = most * sizes[s]
                open_.remove(s)
    return t


@pytest.mark.parametrize("share", [0.2, 1.5, 1.99])
def test_mix_targets_and_taken(spark, share):
    rng = random.Random(5)
    rows = [(i, rng.choice(["a", "a", "a", "b", "ç", "Z", "z", None, "tiny"]) if i > 3 else "tiny0",
             rng.choice([None, 0, 1, 5, 30, 200])) for i in range(900)]
    df = spark.createDataFrame(rows + rows[:40], "doc_id long, source string, size long").withColumn("h", F.lit(1))
    got = mixing.mix(df, share=share).collect()
    assert len(got) == 940 and sorted(r["doc_id"] for r in got) == sorted([r[0] for r in rows + rows[:40]])
    sizes, taken, largest = Counter(), Counter(), Counter()
    groups = defaultdict(int)
    for r in got:
        sizes[r["source"]] += r["size"] or 0
        taken[r["source"]] += r["copies"] * (r["size"] or 0)
        groups[(r["source"], r["doc_id"])] += r["size"] or 0
        largest[r["source"]] = max(largest[r["source"]], groups[(r["source"], r["doc_id"])])
        assert 0 <= r["copies"] <= 2 and r["h"] == 1
    want = _targets(sizes, (3, 1, 2), share, 2)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
    for s, t in want.items():
        assert abs(taken[s] - t) <= largest[s] / 2 + 1e-6, (s, t, taken[s])
    again = mixing.mix(df.repartition(7), share=share).collect()
    key = lambda rs: Counter((r["doc_id"], r["copies"]) for r in rs)
    assert key(got) == key(again)


def test_mix_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, source string, size long")
    assert mixing.mix(df).count() == 0
    zero = spark.createDataFrame([(1, None, None), (2, "a", 0)], "doc_id long, source string, size long")
    assert [(r["target"], r["copies"]) for r in mixing.mix(zero).collect()] == [(0.0, 0), (0.0, 0)]


def test_mix_thresholds_are_nested(spark):
    df = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), (F.col("id") % 9).alias("size"))
    low, high = ({r["doc_id"] for r in mixing.mix(df, share=s).where("copies > 0 and size > 0").collect()}
                 for s in (0.3, 0.6))
    assert low < high


def _brute_top(rows, k):
    ok = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        v = [math.floor(256 * x) for x in v]
        ok[i] = min(ok.get(i, v), v)
    out = set()
    for q, v in ok.items():
        if q % 50:
            continue
        s = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in ok.items() if i != q)[:k]
        out |= {(q, r + 1, i, -x) for r, (x, i) in enumerate(s)}
    return out


def test_top_k_is_exact(spark):
    rng = random.Random(6)
    rows = [(i, [rng.gauss(0, 1) for _ in range(5)]) for i in range(400)]
    rows += [(i, list(rows[i - 400][1])) for i in range(400, 460)]  # equal scores
    rows += [(460, None), (461, [1.0, None]), (462, [float("nan")] * 5), (463, [float("inf")] * 5), (None, [1.0] * 5),
             (464, []), (500, [2.0, 1.0]), (550, [100.0] * 5), rows[0], (50, [9.0] * 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(0))
    rows = [(r[0], None if r[1] is None else [None if x is None else float(np.float32(x)) for x in r[1]]) for r in rows]
    got = topk.top_k(df, F.col("vec_id") % 50 == 0, 5, "vec_id", "embedding", block_rows=16, range_rows=64, chunk_rows=4)
    assert {tuple(r) for r in got.collect()} == _brute_top(rows, 5)


def test_top_k_copies_no_chunk_for_the_ranges(spark):
    """Chunks of queries aren't copied to meet the ranges of rows, by a broadcast or a shuffle: both grow with
    queries times rows. The driver gets no table."""
    rng = random.Random(8)
    df = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(300)], "vec_id long, embedding array<float>")
    got = topk.top_k(df, F.col("vec_id") % 2 == 0, 5, "vec_id", "embedding", block_rows=4, range_rows=8, chunk_rows=4)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Broadcast" not in plan and "explode" not in plan.lower()
    got.write.format("noop").mode("overwrite").save()


def test_packed_components_are_as_wide_as_needed():
    for v, size in (([3, -4, 5], 2), ([3, 1 << 20, 5], 4), ([1 << 40, 0, -1], 8), ([], 8)):
        kind = f"<i{size}"
        dims = np.array([2, 1] if v else [0, 0], "<i4")
        _, rows = topk._matrix(np.array([7, 8], "<i8").tobytes(), dims.tobytes(), np.array(v, kind).tobytes())
        assert rows.dtype == np.int64 and rows.tolist() == ([v[:2], [v[2], 0]] if v else [[], []])


def test_top_k_few_rows_and_none(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [2.0])], "vec_id long, embedding array<double>")
    got = topk.top_k(df, F.col("vec_id") == 0, 5, "vec_id", "embedding").collect()
    assert sorted(tuple(r) for r in got) == [(0, 1, 1, 131072), (0, 2, 2, 131072)]
    assert topk.top_k(df.where("false"), F.lit(True), 5, "vec_id", "embedding").count() == 0


def test_every_row_of_an_id_is_searched(spark, tmp_path):
    """Different and equal vectors under one id, as candidates and as queries, as the SQL has them."""
    import duckdb
    rng = random.Random(13)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(120)]
    rows += [(i % 60, [rng.gauss(0, 3) for _ in range(4)]) for i in range(90)]
    rows += [rows[3], rows[50], rows[50], (7, [-9.0] * 4), (7, [9.0] * 4), (50, [5.0] * 4)]
    path = str(tmp_path / "embeddings.parquet")
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    df.write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{path}/*.parquet')")
    want = Counter(con.execute(topk.OP7_SQL).fetchall())
    assert Counter(tuple(r) for r in topk.op7_block_pruned_search(spark, str(tmp_path)).collect()) == want
    small = topk.top_k(df, F.col("vec_id") % 50 == 0, 5, "vec_id", "embedding", block_rows=4, range_rows=16,
                       chunk_rows=2, every_row=True)
    assert Counter(tuple(r[c] for c in ("query_id", "rank", "id", "score")) for r in small.collect()) == want
    assert sum(want.values()) == 5 * sum(i % 50 == 0 for i, _ in rows)  # also of rows that share an id
    one = topk.top_k(spark.createDataFrame([(0, [1.0]), (0, [3.0]), (1, [2.0]), (2, [-1.0])], "vec_id long, embedding array<float>"),
                     F.col("vec_id") % 50 == 0, 2, "vec_id", "embedding", every_row=True)
    assert Counter(tuple(r) for r in one.collect()) == Counter(
        [(0, 1, 0, 3 * 65536), (0, 2, 1, 2 * 65536), (0, 1, 1, 6 * 65536), (0, 2, 0, 3 * 65536)])


def test_blocks_are_pruned():
    """Blocks whose bound is below the k-th score are not scored."""
    rng = np.random.default_rng(7)
    rows = np.sort(rng.integers(-300, 300, (4096, 4)), axis=0)
    ids = np.arange(4096)
    best = topk.Best(np.array([-1]), 5)
    topk.scan(best, np.array([[5, 5, 5, 5]]), ids, ids, rows, 128)
    want = np.lexsort((ids, -(rows @ np.full(4, 5))))[:5]
    assert best.scored < 4096 / 4 and best.id[0].tolist() == want.tolist()


def _share_scored(v: np.ndarray, seeded: bool = True) -> float:
    """Share of the pairs of query and row that the search scores, in the order of ``signs``, and
    whether it finds the highest scores."""
    bits = (v[:, :63] > 0).astype(object) @ (1 << np.arange(62, 62 - min(63, v.shape[1]), -1).astype(object))
    v = v[np.argsort(bits.astype(float), kind="stable")]
    at = np.arange(len(v))
    ask = at[::50]
    floor = np.concatenate([topk.floors(v[s:s + 4096], own - s, 5) for s in range(0, len(v), 4096)
                            for own in [ask[(ask >= s) & (ask < s + 4096)]]]) if seeded else None
    best = topk.Best(ask, 5, floor)
    for s in range(0, len(v), 4096):
        topk.scan(best, v[ask], at[s:s + 4096], at[s:s + 4096], v[s:s + 4096], 128)
    score = v[ask] @ v.T
    score[np.arange(len(ask)), ask] = np.iinfo(np.int64).min
    assert (best.score == np.sort(score, axis=1)[:, :-6:-1]).all()
    return best.scored / score.size


def test_clustered_rows_are_pruned():
    """Rows around a few hundred directions of 64 dimensions, and a third of all rows copies of one."""
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(100, 64)) / 8
    v = centre[rng.integers(0, 100, 16_384)] + rng.normal(size=(16_384, 64)) / 8 * 0.02
    v = np.floor(256 * v).astype(np.int64)
    rng.shuffle(v)
    assert _share_scored(v) < 0.3
    v[::3] = v[0]
    assert _share_scored(v) < 0.3
