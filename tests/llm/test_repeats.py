"""Substring, byte and line deduplication against brute force over all windows."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from paperlens.llm import lines, recompress, suffixes
from paperlens.llm.words import Words
from tests.llm.helpers import empty_docs, odd_docs, odd_rows, prose

LOW = -(1 << 63)


def _id(i):
    return LOW if i is None else i


def _cover(n, width, starts):
    gone = [False] * n
    for s in starts:
        gone[s:s + width] = [True] * width
    return gone


def brute_words(rows, width):
    docs = [(_id(i), (t or "").encode().split()) for i, t, *_ in rows]
    least = {}
    for i, w in docs:
        for s in range(len(w) - width + 1):
            k = tuple(w[s:s + width])
            least[k] = min(least.get(k, i), i)
    out = Counter()
    for (i, w), row in zip(docs, rows):
        gone = _cover(len(w), width, [s for s in range(len(w) - width + 1) if least[tuple(w[s:s + width])] < i])
        out[(row[0], len(w), sum(gone), " ".join(x.decode() for x, g in zip(w, gone) if not g))] += 1
    return out


@pytest.mark.parametrize("width", [50, 11])
def test_substrings(spark, width):
    got = recompress.dedup_substrings(odd_docs(spark), width).collect()
    assert Counter(tuple(r) for r in got) == brute_words(odd_rows(), width)


def brute_bytes(rows, width):
    docs = [(t or "").encode() for _, t, *_ in rows]
    seen = Counter(b[s:s + width] for b in docs for s in range(len(b) - width + 1))
    out = Counter()
    for b, row in zip(docs, rows):
        gone = np.array(_cover(len(b), width, [s for s in range(len(b) - width + 1) if seen[b[s:s + width]] > 1]), bool)
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out[(row[0], len(b), int(gone.sum()), spans, bytes(np.frombuffer(b, np.uint8)[~gone]))] += 1
    return out


@pytest.mark.parametrize("width,batches", [(200, 4), (60, 3)])
def test_bytes(spark, width, batches):
    got = suffixes.dedup_bytes(odd_docs(spark), width, batches).collect()
    assert Counter((*tuple(r)[:4], bytes(r["kept"])) for r in got) == brute_bytes(odd_rows(), width)


def brute_lines(rows, width):
    """Rows that agree in id and text are one document; equal ids compare by line number."""
    docs = [(i, (t or "").split("\n")) for i, t, *_ in rows]
    first = {}
    worded = []
    for i, ls in docs:
        own = [x for x in ls if x.encode().split()]
        worded.append(own)
        for s in range(len(own) - width + 1):
            k = tuple(own[s:s + width])
            first[k] = min(first.get(k, (_id(i), s)), (_id(i), s))
    out = Counter()
    for (i, ls), own, row in zip(docs, worded, rows):
        gone = _cover(len(own), width,
                      [s for s in range(len(own) - width + 1) if first[tuple(own[s:s + width])] < (_id(i), s)])
        kept, at, last = [], -1, False
        for x in ls:
            if x.encode().split():
                at += 1
                last = gone[at]
            if not last:
                kept.append(x)
        runs = sum(1 for j, g in enumerate(gone) if g and not (j and gone[j - 1]))
        out[(row[0], None if row[1] is None else "\n".join(kept), len(own), sum(gone), runs)] += 1
    return out


@pytest.mark.parametrize("width", [3, 2, 1])
def test_lines(spark, width):
    df = odd_docs(spark)
    out = lines.dedup_lines(df, width)
    assert set(out.columns) == set(df.columns) | {"n_lines", "n_removed", "n_runs"}
    got = out.select("doc_id", "text", "n_lines", "n_removed", "n_runs").collect()
    assert Counter(tuple(r) for r in got) == brute_lines(odd_rows(), width)
    assert {r["key"] for r in out.select("key").collect()} == {-7}


def brute_passages(rows):
    """Windows of three lines, of one or two lines of 50 words, and whole texts of one or two lines."""
    docs = [(_id(i), [x for x in (t or "").split("\n") if x.encode().split()]) for i, t, *_ in rows]

    def windows(own):
        for s in range(len(own)):
            for width in (1, 2, 3):
                win = tuple(own[s:s + width])
                if len(win) == width and (width == 3 or sum(len(x.encode().split()) for x in win) >= 50):
                    yield s, width, win
        if 0 < len(own) < 3:
            yield 0, len(own), ("whole", *own)

    first = {}
    for i, own in docs:
        for s, _, win in windows(own):
            first[win] = min(first.get(win, (i, s)), (i, s))
    out = Counter()
    for (i, own), row in zip(docs, rows):
        gone = [False] * len(own)
        for s, width, win in windows(own):
            if first[win] < (i, s):
                gone[s:s + width] = [True] * width
        kept = tuple(x for x, g in zip(own, gone) if not g)
        runs = sum(1 for j, g in enumerate(gone) if g and not (j and gone[j - 1]))
        out[(row[0], kept, len(own), sum(gone), runs)] += 1
    return out


def passage_rows():
    rng = random.Random(11)
    long_, half = prose(rng, 50), [prose(rng, 25), prose(rng, 25)]
    texts = [f"{prose(rng, 9)}\n{long_}\n{prose(rng, 9)}\n{half[0]}\n\n{half[1]}\nshort one",
             f"{prose(rng, 9)}\n{long_}\n{prose(rng, 9)}", f"{half[0]}\n{half[1]}\n{prose(rng, 3)}\n{prose(rng, 3)}",
             f"{half[0]}\n{prose(rng, 4)}\nshort one\n{prose(rng, 4)}", long_, " ".join(long_.split()[:49]),
             "one line", "one line", "two\nlines", "\ntwo\n\nlines", "short one", f"two\n{prose(rng, 4)}"]
    return [(1000 + i, t, "en", "s0") for i, t in enumerate(texts)]


def test_long_lines_and_short_texts(spark):
    rows = odd_rows() + passage_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    got = lines.dedup_lines(df).collect()
    own = lambda t: tuple(x for x in (t or "").split("\n") if x.encode().split())
    assert Counter((r["doc_id"], own(r["text"]), r["n_lines"], r["n_removed"], r["n_runs"]) for r in got) \
        == brute_passages(rows)
    removed = {r["doc_id"]: r["n_removed"] for r in got if (r["doc_id"] or 0) >= 1000}
    assert [removed[1000 + i] for i in range(12)] == [0, 1, 2, 0, 1, 0, 0, 1, 0, 2, 0, 0]


def test_passages_query_gives_what_its_sql_gives(spark):
    import duckdb
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    want = con.execute(lines.OP9_SQL).fetchall()
    got = [tuple(r) for r in lines.op9_winnowed_lines(spark, sf).collect()]
    assert Counter(got) == Counter(want) and len(got) == 1000


def test_nothing_gives_nothing(spark):
    for f in (recompress.dedup_substrings, suffixes.dedup_bytes, lines.dedup_lines):
        assert f(empty_docs(spark)).count() == 0


def test_family_has_few_levels_and_all_repeats(spark):
    """Any split into batches finds the same prefixes; levels are powers of two, falling."""
    rows = [(k % 7, k) for k in range(40)] + [(1000 + k, k) for k in range(30)]
    df = spark.createDataFrame(rows, "key long, id long")
    for n in (1, 3, 6):
        family = suffixes.SuffixFamily()
        for b in range(n):
            family.add(df.where(f"id % {n} = {b}"))
        sizes = [s for s, _ in family.levels]
        assert sum(sizes) == n and sizes == sorted(set(sizes), reverse=True)
        assert {r[0] for r in family.found_again().collect()} == set(range(7))


def test_symbols_are_the_same_in_equal_contexts():
    """A symbol's context alone gives its name: the text around it does not matter."""
    rng = np.random.default_rng(2)
    body = rng.integers(0, 4, 60)
    texts = [" ".join(map(str, np.concatenate((rng.integers(0, 4, int(k)), body, rng.integers(0, 4, 9)))))
             for k in rng.integers(0, 12, 40)]
    anchored = defaultdict(set)
    words = Words(texts)
    text, key, _, _, start, n = recompress.anchors_of(words, 20)
    for t, k, s, c in zip(text, key, start, n):
        own = words.hash[words.first[t]:words.first[t + 1]]
        for j in range(c):
            anchored[own[s + j:s + j + 20].tobytes()].add(int(k))
    assert len(anchored) > 100 and all(len(v) == 1 for v in anchored.values())
