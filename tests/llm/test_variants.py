"""Spelling variants against all edits of all words."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from paperlens.llm import variants
from tests.llm.helpers import empty_docs, odd_docs, odd_rows


def words_of(rows, letters=5, count=3, every=97):
    found = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{w}".encode())
            if h % every == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            found[w] += 1
    return {w: n for w, n in found.items() if len(w) >= letters and n >= count}


def expected(rows, times=2, **more):
    n = words_of(rows, **more)
    near = defaultdict(set)
    for w in n:
        for v in n:
            if w != v and abs(len(w) - len(v)) <= 1 and one_edit(w, v):
                near[w].add(v)
    form = {}
    for w in n:
        if near[w]:
            best = min(near[w], key=lambda v: (-n[v], v))
            if n[best] >= times * n[w]:
                form[w] = best

    def last(w):
        return last(form[w]) if w in form else w

    return {w: (form.get(w), last(w), n[w], len(near[w]), n[form[w]] if w in form else None) for w in n}


def one_edit(u, v):
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v)) == 1
    u, v = sorted((u, v), key=len)
    return any(v[:i] + v[i + 1:] == u for i in range(len(v)))


def results(df, **more):
    rows = variants.spelling_variants(df, **more).collect()
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}
    assert len(got) == len(rows)
    return got


def chains(seed=3):
    """Words with misspelt copies of copies, ties, accents, one letter repeated, long words."""
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdé") for _ in range(rng.randint(5, 9))) for _ in range(30)]
    base += ["a" * k for k in range(4, 12)] + ["ab" * 60, "ab" * 60 + "c", "ÿ×÷ÿ×", "ÿ×÷ÿ"]
    rows = []
    for i, w in enumerate(base):
        for power in (32, 8, 3, 3):
            rows.append((i, " ".join([w] * power)))
            at = rng.randrange(len(w))
            w = rng.choice([w[:at] + w[at + 1:], w[:at] + "b" + w[at:], w[:at] + "d" + w[at + 1:]])
    return rows


@pytest.mark.parametrize("most", [1, 3, 4096])
def test_chains_of_variants(spark, most):
    rows = chains()
    want = expected(rows, every=5)
    assert any(v[0] and v[1] != v[0] for v in want.values())  # a form of a form
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert results(df, every=5, most=most) == want


def test_odd_rows(spark):
    rows = [r[:2] for r in odd_rows()]
    assert results(odd_docs(spark), letters=3) == expected(rows, letters=3)
    assert results(empty_docs(spark)) == {}
    assert results(spark.createDataFrame([(1, None), (2, "a bc def ghij")], "doc_id long, text string")) == {}


def test_whole_tables_against_all_edits(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"])
           for r in variants.op11_spelling_variants(spark, sf).collect()}
    n = words_of(rows)
    # neighbours by variants with one letter open or left out, not by pairs
    same = defaultdict(set)
    for w in n:
        for i in range(len(w)):
            same[w[:i] + "*" + w[i + 1:]].add(w)
            same[w[:i] + w[i + 1:]].add(w)
        same[w].add(w)
    near = defaultdict(set)
    for k, g in same.items():
        for a in g:
            near[a] |= (g if "*" in k else g & {k}) - {a}
            if "*" not in k and k in n and k != a:
                near[k].add(a)
    assert {w: (v[2], v[3]) for w, v in got.items()} == {w: (n[w], len(near[w])) for w in n}
    for w, (form, root, count, _, form_n) in got.items():
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        good = best is not None and n[best] >= 2 * count
        assert (form, form_n) == ((best, n[best]) if good else (None, None))
        assert root == (got[form][1] if form else w)


def test_a_large_group_is_split_until_groups_are_small(spark):
    words = [f"prefix{a}{b}{c}suffix" for a in "abcdefg" for b in "abcdefg" for c in "abcdefg"]
    df = spark.createDataFrame([(w, 3) for w in words], "word string, n long")
    sizes = variants.groups(df, 10).groupBy("key").count().toPandas()["count"]
    assert sizes.max() <= 10
    pairs = variants.near_words(variants.groups(df, 10)).collect()
    assert len(pairs) == len({(r["word"], r["near"]) for r in pairs}) == len(words) * 18


def test_scan_of_sorted_words():
    """The scan alone, in pieces of few (query, range) pairs, against the definition."""
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(4, 5))).encode() for _ in range(200)})
    a = variants.letters_of(words, False)
    size = np.array(list(map(len, words)))
    u, v = variants.one_edit_pairs(a, size, np.zeros(len(words)), np.zeros(len(words), int), front=7)
    got = {(words[x].decode(), words[y].decode()) for x, y in zip(u, v)}
    assert len(got) == len(u)
    assert got == {(x.decode(), y.decode()) for x in words for y in words
                   if x != y and abs(len(x) - len(y)) <= 1 and one_edit(x.decode(), y.decode())}


def test_columns(spark):
    assert variants.spelling_variants(empty_docs(spark)).columns == [
        "word", "form", "root", "n", "n_near", "form_n"]
