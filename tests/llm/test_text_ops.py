"""SimHash components, language mixtures, weighted fingerprints and the pipeline."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from paperlens.llm import components, langid, lines, packing, simhash, weighted
from paperlens.llm.words import Words
from tests.llm.helpers import SCHEMA, empty_docs, odd_docs, odd_rows, prose

SF = "/root/testdata/sf0.01"


def brute_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    grams = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute_components(fps):
    """Union-find over all pairs of distinct values."""
    distinct = sorted(set(fps))
    root = {f: f for f in distinct}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if bin((a ^ b) & (1 << 64) - 1).count("1") <= 2:
                root[find(a)] = find(b)
    return {f: find(f) for f in distinct}


def test_fingerprints(spark):
    rows = odd_rows() + [(900, "ABC Éa ÉA\x85x y", None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = simhash.fingerprints(df).collect()
    assert Counter((r["id"], r["fp"] & (1 << 64) - 1) for r in got) == \
        Counter((i, brute_fingerprint(t)) for i, t, *_ in rows)
    # the hash is the one that SQL has under this name
    one = spark.sql("SELECT xxhash64('a b c') AS h").first()["h"]
    assert one & (1 << 64) - 1 == xxhash.xxh64_intdigest(b"a b c", 42)


@pytest.mark.parametrize("compared", [1, 6, simhash.COMPARED, 10_000])  # 1: variants alone; 10,000: pairs alone
def test_components_of_near_fingerprints(spark, compared):
    rng = random.Random(8)
    fps = [0]
    for _ in range(12):
        f = rng.getrandbits(64)
        for _ in range(rng.randint(1, 40)):  # a chain, so that components are wider than a link
            fps.append(f)
            for b in rng.sample(range(64), rng.randint(1, 3)):
                f ^= 1 << b
    crowd = rng.getrandbits(64)  # many that share two blocks, some of them near each other
    fps += [crowd ^ rng.getrandbits(9) << 16 * rng.choice([0, 1]) for _ in range(90)]
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in set(signed)], "fp long")
    edges = simhash.links(df, compared).collect()
    assert all(bin((a ^ b) & (1 << 64) - 1).count("1") <= 2 for a, b in edges)
    found = {r["node"]: r["root"] for r in components.components(
        spark.createDataFrame(edges, "fp long, other long"), "fp", "other").collect()}
    want = brute_components(signed)
    groups = lambda d: {frozenset(k for k in d if d[k] == v) for v in d.values()}
    assert groups({f: found.get(f, f) for f in want}) == groups(want)


def test_components_long_path_and_empty(spark):
    path = [(i, i + 1) for i in range(200)] + [(500, 500), (None, 3), (700, 600)]
    df = spark.createDataFrame(path, "a long, b long")
    got = {r["node"]: r["root"] for r in components.components(df, "a", "b").collect()}
    assert got == {**{i: 0 for i in range(201)}, 600: 600, 700: 600}
    assert components.components(df.where("false"), "a", "b").count() == 0


def test_near_duplicates_rows(spark):
    got = simhash.near_duplicates(odd_docs(spark)).collect()
    rows = odd_rows()
    fp = [brute_fingerprint(t) for _, t, *_ in rows]
    root = brute_components(fp)
    least = defaultdict(list)
    for (i, *_), f in zip(rows, fp):
        least[root[f]] += [i] if i is not None else []
    want = Counter((i, f, min(least[root[f]], default=None)) for (i, *_), f in zip(rows, fp))
    assert Counter((r["id"], r["fp"] & (1 << 64) - 1, r["component_id"]) for r in got) == want
    assert simhash.near_duplicates(empty_docs(spark)).count() == 0


def _languages(rng, n):
    parts = {"aa": "ba be bi bo bu la le".split(), "bb": "kra kro kry stro stra".split(),
             "cc": "ñu ña ñe óng éng".split()}
    for i in range(n):
        lang = rng.choice(list(parts))
        yield i, " ".join("".join(rng.choices(parts[lang], k=rng.randint(1, 3)))
                          for _ in range(rng.randint(4, 60))), lang


def test_language_and_mixture(spark):
    rng = random.Random(9)
    rows = list(_languages(rng, 400))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(df.where("doc_id < 300"))
    assert model.langs == ["aa", "bb", "cc"]
    odd = [(1000, None, "aa"), (1001, "", "aa"), (1002, "123 !? \n", "bb"), (1003, "日本", None),
           (1004, rows[0][1], "zz"), (1005, rows[0][1], None)]
    tested = spark.createDataFrame(rows[300:] + odd, "doc_id long, text string, lang string")
    tested = tested.withColumns({"row": F.lit(1), "score": F.lit("x"), "lang_pred": F.lit(5)})
    got = {r["doc_id"]: r for r in langid.identify(tested, model).collect()}
    assert len(got) == 106 and all(r["row"] == 1 and 0 <= r["score"] <= 1 for r in got.values())
    assert sum(got[i]["lang_pred"] == lang for i, _, lang in rows[300:]) >= 99
    assert [got[i]["lang_pred"] for i in (1000, 1001, 1002)] == ["und"] * 3
    assert got[1003]["lang_pred"] in model.langs
    assert got[1004]["lang_pred"] == got[1005]["lang_pred"] == rows[0][2]
    by = {lang: " ".join(t for _, t, x in rows if x == lang) for lang in ("aa", "bb")}
    share = langid.infer(by["aa"][:3000] + " " + by["bb"][:1000], model.log_p)[2]
    assert share[0] == pytest.approx(.75, abs=.06) and share[1] == pytest.approx(.25, abs=.06) and share[2] == 0


def test_language_without_labels(spark):
    model = langid.train(empty_docs(spark))
    assert model.langs == []
    got = langid.identify(odd_docs(spark), model).select("lang_pred").distinct().collect()
    assert [r[0] for r in got] == ["und"]
    assert langid.identify(empty_docs(spark), model).count() == 0


def test_training_sample_is_bounded(spark):
    df = spark.createDataFrame(list(_languages(random.Random(3), 300)), "doc_id long, text string, lang string")
    few, all_ = langid.train(df, texts=20), langid.train(df)
    assert few.langs == all_.langs and (few.log_p != all_.log_p).any()


def test_training_sample_takes_a_text_once(spark):
    """One text in many copies beside a language of copies only: copies change nothing."""
    rows = [(i, t, "aa") for i, t, _ in _languages(random.Random(12), 200)]
    rows += [(1000 + i, t, "bb") for i, t in enumerate(["kra kro stry stro", "kre kru"])]
    schema = "doc_id long, text string, lang string"
    once = langid.train(spark.createDataFrame(rows, schema), texts=20)
    for hot in rows[:8]:
        copies = [(2000 + i, hot[1], "aa") for i in range(100)] + [(3000 + i, *rows[-1][1:]) for i in range(300)]
        model = langid.train(spark.createDataFrame(rows + copies, schema).repartition(3), texts=20)
        assert model.langs == once.langs == ["aa", "bb"] and (model.log_p == once.log_p).all()


def test_pipeline_keeps_mixtures_without_a_main_language(spark):
    import corpus_pipeline as P
    rows = list(_languages(random.Random(14), 300))
    parts = []
    for lang in ("aa", "bb", "cc"):
        words, n = [], 0
        for w in " ".join(t for _, t, x in rows if x == lang).split():
            if n < 1500:
                words.append(w)
                n += len(w)
        parts.append(" ".join(words))
    rows += [(1000, " ".join(parts), None), (1001, "123 !?", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs)
    _, score, share, fit = langid.infer(rows[300][1], model.log_p)
    assert score < P.MIN_LANGUAGE_SHARE and (share > 0.25).all() and fit > langid.CHANCE
    assert langid.infer("xqzj wvyq jzxw " * 50, model.log_p)[3] < langid.CHANCE
    assert {r["doc_id"] for r in P.language_id(spark, docs, SF).collect()} == set(range(300)) | {1000}


def test_language_held_out_accuracy(spark):
    from paperlens.llm.common import documents
    got = langid.op4_language_mixture(spark, SF).join(documents(spark, SF).select("doc_id", "lang"), "doc_id")
    row = got.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count("*")).first()
    assert row[1] > 100 and row[0] >= 0.98


def _jaccard(a, b):
    a, b = Counter(a.encode().split()), Counter(b.encode().split())
    top = sum(max(a[w], b[w]) for w in a | b)
    return sum(min(a[w], b[w]) for w in a | b) / top if top else 1.0


def test_collision_rate_is_generalised_jaccard():
    rng = random.Random(10)
    a = " ".join(rng.choices(["u", "v", "w", *map(str, range(60))], weights=[20, 9, 5] + [1] * 60, k=300))
    for b in (a.replace("u", "x"), a[:400], a + " " + prose(rng, 100)):
        sig = weighted.signatures(Words([a, b]), samples=4000)
        want = _jaccard(a, b)
        assert weighted.likeness(*sig, 4000) == pytest.approx(want, abs=4 * (want * (1 - want) / 4000) ** .5 + .002)


@pytest.mark.parametrize("range_rows", [3, 1000])
def test_fingerprints_with_edits(spark, range_rows):
    got = weighted.fingerprint_with_edits(odd_docs(spark), range_rows=range_rows).collect()
    rows = sorted(odd_rows(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    texts = [t or "" for _, t, *_ in rows]
    follow = texts[1:] + texts[:1]
    edits = [weighted.edited(a, b) for a, b in zip(texts, follow)]
    sig = weighted.signatures(Words(texts + edits))
    n = len(texts)
    want = Counter((r[0], len(t), hashlib.sha256(e.encode()).hexdigest(), weighted.as_text(sig[i]),
                    weighted.as_text(sig[n + i]), weighted.likeness(sig[i], sig[n + i]),
                    weighted.likeness(sig[i], sig[(i + 1) % n]))
                   for i, (r, t, e) in enumerate(zip(rows, texts, edits)))
    assert Counter(tuple(r) for r in got) == want
    one = spark.createDataFrame([(4, "a b c d", None, None)], SCHEMA)
    assert [(r["near_next"], r["n_chars"]) for r in weighted.fingerprint_with_edits(one).collect()] == [(1.0, 7)]
    assert weighted.fingerprint_with_edits(empty_docs(spark)).count() == 0


def test_pipeline_stages_against_plain_python(spark):
    """Each stage on its own input, over rows of every odd kind."""
    import corpus_pipeline as P
    docs = odd_docs(spark).withColumn("n_chars", F.length("text").cast("long"))
    names = docs.columns
    kept = P.STAGES[0][1](spark, docs, SF)
    assert kept.columns == names
    in_, out = [Counter((r["doc_id"], r["text"]) for r in d.collect()) for d in (docs, kept)]
    lettered = Counter({k: n for k, n in in_.items() if any(c.isalpha() for c in k[1] or "")})
    assert not out - lettered and sum(out.values()) >= 0.6 * sum(lettered.values())

    cut = P.STAGES[1][1](spark, docs, SF)
    assert cut.columns == names
    want = lines.dedup_lines(docs).select("doc_id", "text").collect()
    got = cut.collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter(tuple(r) for r in want)
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in got)

    from paperlens.llm.common import written
    base = written(docs, "test")
    one = P.STAGES[2][1](spark, base, SF)
    rows = odd_rows()
    fp = [brute_fingerprint(t) for _, t, *_ in rows]
    root = brute_components(fp)
    groups = defaultdict(list)
    for (i, *_), f in zip(rows, fp):
        groups[root[f]].append(i)
    want = [min((i for i in g if i is not None), default=None) for g in groups.values()]
    assert one.columns == names
    assert Counter(r["doc_id"] for r in one.collect()) == Counter(want)
    assert one.count() == len(set(root.values()))

    mixed = P.STAGES[3][1](spark, docs, SF)
    assert mixed.columns == names
    copies = Counter((r["doc_id"], r["text"], r["source"]) for r in mixed.collect())
    have = Counter((r["doc_id"], r["text"], r["source"]) for r in docs.collect())
    assert all(n <= 2 * have[k] for k, n in copies.items())

    packed = P.STAGES[4][1](spark, docs, SF).collect()
    pieces = packing.token_pieces(docs, packing.tokenizer_path()).collect()
    assert Counter(tuple(r)[:5] for r in packed) == Counter(tuple(r) for r in pieces)


def test_pipeline_stages_keep_clashing_columns(spark):
    """Columns named like results, in any case or with dots, keep their values in every stage."""
    import corpus_pipeline as P
    extra = {c: F.concat(F.lit(f"{c}-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none")))
             for c in ("Score", "n_removed", "a.b", "copies", "found", "rest", "size", "row_of_stage", "lang_pred", "doc")}
    docs = spark.createDataFrame(odd_rows(), SCHEMA).withColumn("n_chars", F.length("text").cast("long"))
    docs = docs.select("*", *[v.alias(k) for k, v in extra.items()])
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert rows, name
        for r in rows:
            own = "none" if r["doc_id"] is None else r["doc_id"]
            assert all(r[c] == f"{c}-{own}" for c in extra), name
    assert P.STAGES[-1][1](spark, docs, SF).count() >= docs.count()


def test_near_dedup_outlives_other_partitions(spark, monkeypatch):
    """Files are read in another number of partitions from step to step; the same rows stay."""
    import corpus_pipeline as P
    from paperlens.llm import simhash
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(5)
    rows = docs.select("doc_id", "text").collect()
    fp = [brute_fingerprint(r["text"]) for r in rows]
    root, groups = brute_components(fp), defaultdict(list)
    for r, f in zip(rows, fp):
        groups[root[f]].append(r["doc_id"])
    key, change = "spark.sql.leafNodeDefaultParallelism", iter([2, 7, 1, 3, 5, 2, 9, 4] * 20)
    for module in (P, simhash):
        real = module.written

        def written(df, what, real=real):
            out = real(df, what)
            spark.conf.set(key, next(change))
            return out

        monkeypatch.setattr(module, "written", written)
    try:
        kept = [r["doc_id"] for r in P.near_dedup(spark, docs, SF).collect()]
    finally:
        spark.conf.unset(key)
    assert Counter(kept) == Counter(min(g) for g in groups.values())


def test_em_against_a_plain_one():
    """Proportions and likelihood of the mixture, against EM word for word without arrays; the
    penalised choice against all sets of languages."""
    import itertools
    import math
    rng = np.random.default_rng(5)
    p = rng.dirichlet(np.full(40, .3), 3).T + 1e-6
    p /= p.sum(axis=0)
    share = [.6, .4, 0]
    n = rng.multinomial(400, p @ share).astype(float)

    def em(cols):
        pi = [1 / len(cols)] * len(cols)
        for _ in range(3000):
            new = [0.0] * len(cols)
            for c, count in enumerate(n):
                total = sum(w * p[c, k] for w, k in zip(pi, cols))
                for j, k in enumerate(cols):
                    new[j] += count * pi[j] * p[c, k] / total / n.sum()
            if max(abs(a - b) for a, b in zip(pi, new)) < 1e-7:
                break
            pi = new
        return pi, sum(count * math.log(sum(w * p[c, k] for w, k in zip(pi, cols))) for c, count in enumerate(n))

    want, fit = em([0, 1, 2])
    got, got_fit = langid._fit(p, n, 3000)
    assert np.abs(got - want).max() < 5e-3 and abs(got_fit - fit) < .1
    cost = langid.PENALTY * math.log(n.sum())
    sets = [list(c) for size in (1, 2, 3) for c in itertools.combinations(range(3), size)]
    assert max(sets, key=lambda c: em(c)[1] - cost * (len(c) - 1)) == [0, 1]


def test_pipeline_stages_on_nothing(spark):
    import corpus_pipeline as P
    docs = empty_docs(spark).withColumn("n_chars", F.lit(1).cast("long"))
    for _, stage in P.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_pipeline_runs(spark):
    import corpus_pipeline as P
    out = P.run(spark, "/root/testdata/sf0.001")
    used = out.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert used.where("n != end OR n > 2048").count() == 0 and out.count() > 100
    assert np.isfinite(out.agg(F.avg("length")).first()[0])
