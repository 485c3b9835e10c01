"""Rows that every operator must stand: nulls, empty and long texts, ties, repeats, clashing names."""

from __future__ import annotations

import random

WORDS = [f"{a}{b}{c}" for a in "bdklmnprst" for b in "aeiou" for c in ("", "n", "r", "st")]


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n))


def odd_rows(seed: int = 1) -> list[tuple]:
    """(doc_id, text, lang, source): copies, near copies, shared passages, runs, odd texts."""
    rng = random.Random(seed)
    passage = prose(rng, 70)
    base = [prose(rng, rng.randint(5, 300)) for _ in range(12)]
    texts = list(base)
    texts += [base[0], base[0], base[1], base[2] + " end", "x" + base[3]]
    texts += [f"{prose(rng, 20)} {passage} {prose(rng, 9)}", f"{passage}\n{prose(rng, 30)}", passage]
    texts += ["a " * 400, "a " * 380 + "b", "ab" * 500, "ab" * 400 + "c", "x\n" * 40]
    texts += ["", " \t\n", "!!! 123", None, "é ñ ü", "日本語 テキスト " * 30, "one", "one two", None]
    texts += ["\n".join(base[4:8]), "head\n" + "\n".join(base[4:7]) + "\n\ntail", "\n".join([base[9]] * 7)]
    rows = [(i, t, rng.choice(["en", "fr", None]), rng.choice(["s0", "s0", "s1", "s2", None]))
            for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, base[6], "en", "s0"), (None, None, None, None)]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string"


def odd_docs(spark, **more):
    """The rows, with columns whose names clash with those that operators use or return."""
    from pyspark.sql import functions as F
    clash = {c: F.lit(-7) for c in ("key", "span", "id", "doc", "row", "start", "n", "h", "cell", "size",
                                    "shard", "slot", "copies", "target", "score", "root", "fp", "piece",
                                    "length", "rank", "window", "at", "label")}
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3).withColumns(clash | more)


def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)
