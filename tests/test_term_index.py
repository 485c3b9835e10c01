"""Large dictionaries: the index gives what trying every term on every text gives."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperlens.functions.text import word_set
from paperlens.operators import term_index
from paperlens.operators.matching import CompiledDictionary, explode_matches, whole_word_pattern, with_matches


def test_index_against_every_term(spark, plain_text):
    rng = random.Random(4)
    words = plain_text.split()
    texts = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 40)))) for i in range(60)]
    texts += [(60, None), (61, ""), (62, "Hi-C and hi-cx, ÉTÉ été"), (63, "abcd"), (64, "abcde"), (65, "日本語テキスト"),
              (66, " ".join(words)), (66, " ".join(words))]
    terms = ["hi-c", "a+", "été", "abcd", "abcde", "本語テキス", "nowhere to be found", plain_text[5:30]]
    terms += [w[rng.randint(0, 2):][:rng.randint(1, 9)] for w in words[:200]] + [f"{a} {b}" for a, b in zip(words[:80], words[1:])]
    terms = sorted({t for t in terms if t})
    rows = [("first" if i % 3 else "second", i % 3 and 0 or 1, i, t) for i, t in enumerate(terms)]
    rows.append(("again", 2, 0, terms[3].upper()))
    d = spark.createDataFrame(rows, "category string, cat_ord int, ord int, term string")
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    got = term_index.index_matches(df.withColumn("gram", F.lit("clash")), d).collect()
    want = []
    for i, text in texts:
        for c, ci, o, t in rows:
            low = (text or "").lower()
            if re.search(rf"\b{re.escape(t.lower())}\b" if t.isalnum() else _boundaries(t), low) if len(t) <= 4 else t.lower() in low:
                want.append((i, c, ci, o, t))
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 300
    compiled = explode_matches(with_matches(df, CompiledDictionary.from_df(d), "text", "m").select("doc_id", "m"), "m", "h")
    assert sorted(tuple(r) for r in compiled.select("doc_id", "h.*").collect()) == sorted(want)


def _boundaries(t: str) -> str:
    body = re.escape(t.lower())
    return ("\\b" if t[0].isalnum() else r"(?<=\w)") + body + ("\\b" if t[-1].isalnum() else r"(?=\w)")


def test_a_full_bit_set_changes_nothing(spark, monkeypatch):
    """Hashes that share their bits only make more candidates."""
    d = spark.createDataFrame([("c", 0, i, f"term{i:03d}") for i in range(300)],
                              "category string, cat_ord int, ord int, term string")
    df = spark.createDataFrame([(i, f"xterm{i:03d}y and term{i + 7:03d}") for i in range(100)], "doc_id long, text string")
    want = sorted(tuple(r) for r in term_index.index_matches(df, d).collect())
    monkeypatch.setattr(term_index, "MOST_WORDS", 1)
    monkeypatch.setattr(term_index, "MOST_ROWS", 1)  # and nothing is broadcast
    assert sorted(tuple(r) for r in term_index.index_matches(df, d).collect()) == want and len(want) == 200


def test_gaps_of_rising_numbers():
    """Numbers below, at and far above what a byte holds, empty runs too, come back."""
    rng = random.Random(3)
    runs = [[0], [], [254], [255], [256, 511, 766], [], [0, 1, 2, 70_000]]
    runs += [sorted(rng.sample(range(3000), rng.randint(0, 40))) for _ in range(50)]
    rows, counts = np.array([x for r in runs for x in r]), np.array([len(r) for r in runs])
    back, n = term_index.rows_of(*term_index.gaps_of(rows, counts))
    assert back.tolist() == rows.tolist() and n.tolist() == counts.tolist()


@pytest.mark.parametrize("kind", ["long", "string", "int"])
def test_pieces_give_what_a_broadcast_gives(spark, monkeypatch, kind):
    """Ids of any type, null and repeated ones too, terms of several categories; in pieces of one bucket each."""
    rng = random.Random(9)
    words = [f"w{i:03d}" + "x" * (i % 4) for i in range(400)]
    df = spark.createDataFrame([(rng.choice([None, 7, i, -i * 10**6]), " ".join(rng.choices(words, k=30))) for i in range(200)]
                               + [(1, None), (2, "")], "doc_id long, text string").repartition(3).withColumn("doc_id", F.col("doc_id").cast(kind))
    d = spark.createDataFrame([(c, k, i, t) for i, t in enumerate(words[::2] + ["no term"]) for k, c in enumerate("ab"[:1 + i % 2])],
                              "category string, cat_ord int, ord int, term string")
    key = lambda r: tuple(map(str, r))
    want = sorted(term_index.index_matches(df, d).collect(), key=key)
    monkeypatch.setattr(term_index, "MOST_ROWS", 1)
    monkeypatch.setattr(term_index, "BUCKET_TERMS", 1)  # a bucket for each term
    monkeypatch.setattr(term_index, "PIECE_BYTES", 500)
    monkeypatch.setattr(term_index, "BLOCK", 4000)
    assert sorted(term_index.index_matches(df, d).collect(), key=key) == want and len(want) > 3000


def test_what_moves_is_small(spark, monkeypatch, tmp_path):
    """Of texts that share most terms, a pair of text and term takes few bytes of the shuffle: no eight for its id."""
    monkeypatch.setattr(term_index, "MOST_ROWS", 1)
    rng = random.Random(2)
    words = [f"word{i:03d}" for i in range(400)]
    df = spark.createDataFrame([(i * 1000, " ".join(rng.sample(words, 150))) for i in range(1000)], "doc_id long, text string").coalesce(1)
    d = spark.createDataFrame([("c", 0, i, t) for i, t in enumerate(words)], "category string, cat_ord int, ord int, term string")
    among = term_index.SubstringFilter(d.select(F.col("term").alias("lower"), F.lit(False).alias("short")))
    pieces = term_index._substrings(df.select(F.col("doc_id").alias("id"), F.col("text").alias("lt")), among, 4)
    moved = pieces.agg(F.sum(F.length("piece"))).first()[0]
    assert term_index.index_matches(df, d).count() == 150_000 and moved < 2 * 150_000


def test_nothing(spark):
    d = spark.createDataFrame([], "category string, cat_ord int, ord int, term string")
    df = spark.createDataFrame([(1, "text")], "doc_id long, text string")
    assert term_index.index_matches(df, d).count() == 0
    some = spark.createDataFrame([("c", 0, 0, "texts"), ("c", 0, 1, "text")], d.schema)
    assert [r["term"] for r in term_index.index_matches(df, some).collect()] == ["text"]
    assert term_index.index_matches(df.where("false"), some).count() == 0


def test_no_text_is_shuffled(spark, monkeypatch):
    """Of a dictionary too large to broadcast, too: what moves is substrings and ids."""
    monkeypatch.setattr(term_index, "MOST_ROWS", 1)
    d = spark.createDataFrame([("c", 0, i, f"term{i:03d}") for i in range(300)],
                              "category string, cat_ord int, ord int, term string")
    df = spark.createDataFrame([(i, f"xterm{i:03d}y") for i in range(100)], "doc_id long, text string")
    plan = term_index.index_matches(df, d)._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    moved = re.findall(r"\) Exchange\nInput \[\d+\]: \[([^\]]*)\]", plan)
    assert moved and not [m for m in moved if re.search(r"\b(lt|text)#", m)]


def test_blocks_and_windows(spark, plain_text, monkeypatch):
    """Terms across the windows of a text are found, those across two texts are not."""
    monkeypatch.setattr(term_index, "BLOCK", 90)
    monkeypatch.setattr(term_index, "WINDOW", 7)
    low = "éÉ日本 ".lower() + plain_text[:150].lower()
    rows = [(None, low), (1, low[:40]), (1, low[40:]), (2, "x" * 30), (3, low)]
    terms = sorted({low[i:i + n] for i in range(0, 120, 3) for n in (5, 6, 11, 30)} | {"x" * n for n in (5, 29, 31)})
    d = spark.createDataFrame([("c", 0, i, t) for i, t in enumerate(terms)], "category string, cat_ord int, ord int, term string")
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = [(r["doc_id"], r["term"]) for r in term_index.index_matches(df, d).collect()]
    want = [(i, t) for i, text in rows for t in terms if t in text]
    key = lambda x: (x[0] or 0, x[1])
    assert sorted(got, key=key) == sorted(want, key=key)


def test_texts_are_read_with_the_result(spark):
    """Making the result reads the terms alone: the texts are not gone through for the terms' keys first."""
    d = spark.createDataFrame([("c", 0, 0, "a term")], "category string, cat_ord int, ord int, term string")
    df = spark.range(1).select(F.col("id").alias("doc_id"), F.raise_error(F.lit("read")).cast("string").alias("text"))
    assert term_index.index_matches(df, d).columns == ["doc_id", "category", "cat_ord", "ord", "term"]


def test_each_text_is_read_once(spark, tmp_path):
    """Short terms, those with punctuation and long ones are looked for in the same reading of a text."""
    spark.createDataFrame([(1, "a b-c term text")], "doc_id long, text string").write.parquet(f"{tmp_path}/texts")
    d = spark.createDataFrame([("c", 0, i, x) for i, x in enumerate(("term", "b-c", "a b-c"))],
                              "category string, cat_ord int, ord int, term string")
    got = term_index.index_matches(spark.read.parquet(f"{tmp_path}/texts"), d)
    plan = got._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert len(re.findall(r"Location: [^\n]*/texts\]", plan)) == 1
    assert sorted(r["term"] for r in got.collect()) == ["a b-c", "b-c", "term"]


def test_edges_of_words_are_those_of_sparks_patterns(spark, monkeypatch):
    """Short terms between characters of one to four bytes, at the ends of texts, blocks and windows."""
    monkeypatch.setattr(term_index, "BLOCK", 60)
    monkeypatch.setattr(term_index, "WINDOW", 5)
    beside = ["", " ", "a", "_", "-", "7", "\u00b2", "\u00e9", "\u00d7", "\u0301", "\u2014", "\u65e5", "\u2167",
              "\U0001f600", "\U0001d51e", "\n", "\U0001fbf0"]
    terms = ["ab", "\u00e9", "\u65e5\u672c", "a-b", "+", "-\u00e9", "\u2014a", "\U0001d51e", "\U0001f600", "a\u0301"]
    texts = [(i, a + t + b) for i, (a, t, b) in enumerate((a, t, b) for a in beside for t in terms for b in beside)]
    d = spark.createDataFrame([("c", 0, i, t) for i, t in enumerate(terms)], "category string, cat_ord int, ord int, term string")
    df = spark.createDataFrame(texts, "doc_id long, text string").coalesce(2)
    low = F.lower("text")

    def rule(t):
        return F.array_contains(word_set(low), t) if t.isalnum() else low.rlike(whole_word_pattern(t))

    got = sorted(map(tuple, term_index.index_matches(df, d).select("doc_id", "term").collect()))
    want = [(r["doc_id"], t) for r in df.select("doc_id", *[rule(t).alias(f"t{i}") for i, t in enumerate(terms)]).collect()
            for i, t in enumerate(terms) if r[f"t{i}"]]
    assert got == sorted(want) and len(want) > 700
