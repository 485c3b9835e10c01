"""Language identification by multilingual mixture inference.

A text is a mixture of languages: each of its letter trigrams was drawn from one
of them. Expectation maximisation estimates the proportions from the trigrams'
likelihoods; the languages a text is said to hold are those whose mixture has
the best likelihood after a penalty for each language.
"""

from __future__ import annotations

import sys
import types

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperlens.llm.common import documents, free_name, small, written

#: trigram classes, labelled texts a language learns from (about), least count of a trigram
CLASSES = 1 << 16
TRAIN_TEXTS = 5000
SMOOTHING = 0.1
#: log-likelihood a trigram if all classes were equally likely
CHANCE = -float(np.log(CLASSES))
#: a run of letters counts in up to three trigrams, so a language costs three times the
#: usual half of log n
PENALTY = 1.5


def letters() -> np.ndarray:
    """Whether a code point is a letter; made once a Python worker."""
    kept = sys.modules.setdefault("_llm_letters", types.ModuleType("_llm_letters"))
    if not hasattr(kept, "table"):
        kept.table = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool)
    return kept.table


def trigrams(text: str | None) -> np.ndarray:
    """Classes of the trigrams around each letter of the lower-cased text; what is no
    letter counts as a space. Empty if there is no letter."""
    code = np.frombuffer((" " + (text or "").lower() + " ").encode("utf-32-le", "replace"), "<u4")
    letter = letters()[code]
    c = np.where(letter, code, 32).astype(np.uint64)
    h = (c[:-2] * np.uint64(0x9E3779B97F4A7C15) + c[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F)
         + c[2:] * np.uint64(0x165667B19E3779F9))
    h ^= h >> np.uint64(29)
    return ((h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(48))[letter[1:-1]].astype(np.uint16)


def _fit(p: np.ndarray, n: np.ndarray, rounds: int = 40) -> tuple[np.ndarray, float]:
    """Proportions and log-likelihood of the mixture of the columns of ``p``."""
    pi = np.full(p.shape[1], 1 / p.shape[1])
    total = n.sum()
    for _ in range(rounds):
        mixed = p @ pi
        new = pi * ((n / mixed) @ p) / total
        done = np.abs(new - pi).max() < 1e-4
        pi = new
        if done:
            break
    return pi, float(n @ np.log(p @ pi))


def infer(text: str | None, log_p: np.ndarray) -> tuple[int, float, np.ndarray | None, float | None]:
    """(language, score, proportions, log-likelihood a trigram): -1, 0, None, None for a text
    without a letter.

    ``log_p``: log-likelihood of each trigram class (row) in each language (column).
    """
    grams = trigrams(text)
    if not len(grams) or not log_p.shape[1]:
        return -1, 0.0, None, None
    classes, n = np.unique(grams, return_counts=True)
    lp, n = log_p[classes], n.astype(float)
    alone = n @ lp
    best = int(alone.argmax())
    share = np.zeros(len(alone))
    share[best] = 1.0
    posterior = 1 / np.exp(np.maximum((alone - alone[best]) / 3, -700)).sum()
    if len(alone) == 1:
        return best, 1.0, share, float(alone[best] / n.sum())
    p = np.exp(lp)
    order = np.argsort(-_fit(p, n)[0], kind="stable")
    cost = PENALTY * np.log(max(2.0, n.sum()))
    top, chosen = alone[best], None
    for size in range(2, len(order) + 1):
        pi, fit = _fit(p[:, order[:size]], n)
        if fit - cost * (size - 1) <= top:
            break
        top, chosen = fit - cost * (size - 1), (order[:size], pi, fit)
    if chosen is None:
        return best, float(min(1.0, posterior)), share, float(alone[best] / n.sum())
    share[:] = 0
    share[chosen[0]] = chosen[1]
    best = int(share.argmax())
    return best, float(min(1.0, share[best])), share, float(chosen[2] / n.sum())


class Model:
    """Languages and their trigram likelihoods; fitted from counts of Spark."""

    def __init__(self, langs: list[str], log_p: np.ndarray):
        self.langs, self.log_p = langs, log_p


def train(df: DataFrame, text_col: str = "text", lang_col: str = "lang",
          texts: int = TRAIN_TEXTS) -> Model:
    """Learns from about ``texts`` different texts of each language: those whose hash lies
    below the share of the language's different texts that this is (all, if there are
    fewer), each once however many copies it has, so the sample is bounded and the same in
    each run. Null languages and texts without a letter teach nothing; without any labelled
    text no language is known, and all is ``und``."""
    d = df.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where(
        "text IS NOT NULL AND lang IS NOT NULL").withColumn("hash", F.xxhash64(F.lit(4), "text"))
    # one row a text hash before anything is counted, by a partial aggregate of the hashes alone
    different = d.groupBy("lang", "hash").agg(F.lit(1).alias("one"))
    rows = small(written(different.groupBy("lang").agg(F.count("*").alias("different")), "languages"))
    place = F.pmod("hash", F.lit(1 << 40)) / float(1 << 40)
    taken = d.join(rows, "lang").where(place < texts / F.col("different"))
    sample = taken.groupBy("lang", "hash").agg(F.min("text").alias("text")).select("lang", "text")

    def counts(batches):
        import pyarrow as pa
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b.column(0), b.column(1)):
                own = sums.setdefault(lang.as_py(), np.zeros(CLASSES, np.int64))
                own += np.bincount(trigrams(text.as_py()), minlength=CLASSES)
        for lang, own in sums.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(own[at])],
                ["lang", "class", "n"])

    # at most CLASSES rows a language
    found = (sample.mapInArrow(counts, "lang string, class int, n long")
             .groupBy("lang", "class").agg(F.sum("n").alias("n")).toArrow())
    langs = sorted(set(found.column("lang").to_pylist()))
    n = np.full((CLASSES, len(langs)), SMOOTHING)
    column = {lang: i for i, lang in enumerate(langs)}
    at = np.array([column[x] for x in found.column("lang").to_pylist()], int)
    n[found.column("class").to_numpy(), at] += found.column("n").to_numpy()
    return Model(langs, np.log(n / n.sum(axis=0)))


def language(text: Column, model: Model) -> Column:
    """struct(lang_pred, score, languages, fit) of a text, as ``identify`` says. Only the text
    goes to Python, once, and only the struct comes back."""
    from pyspark import SparkContext
    sent = SparkContext._active_spark_context.broadcast((model.langs, model.log_p))  # CLASSES rows

    @F.arrow_udf("lang_pred string, score double, languages map<string,double>, fit double")
    def found(texts):
        import pyarrow as pa
        langs, log_p = sent.value
        pred, score, shares, fits = [], [], [], []
        for text in texts:
            k, s, share, fit = infer(text.as_py(), log_p)
            pred.append(langs[k] if k >= 0 else "und")
            score.append(s)
            shares.append([] if share is None else [(langs[i], float(share[i])) for i in np.flatnonzero(share)])
            fits.append(fit)
        return pa.StructArray.from_arrays(
            [pa.array(pred, pa.string()), pa.array(score, pa.float64()),
             pa.array(shares, pa.map_(pa.string(), pa.float64())), pa.array(fits, pa.float64())],
            ["lang_pred", "score", "languages", "fit"])

    # not to be worked out again by a filter on the result that moves below it
    return found.asNondeterministic()(text)


def identify(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """All rows of ``df`` with ``lang_pred`` (``und`` if the text is null or has no letter),
    ``score``, ``languages``, the map of the languages found to their proportions, and
    ``fit``, the log-likelihood a trigram under these (null if there is no letter).

    A single language's score is its probability against the other languages, that of a
    mixture's main language its proportion. Nothing but the text is looked at; equal texts
    get equal results; columns named like the outputs are replaced, others are kept.
    """
    outputs = ("lang_pred", "score", "languages", "fit")
    keep = [F.col(f"`{c}`") for c in df.columns if c.lower() not in outputs]
    own = free_name(df, "found")
    out = df.select(*keep, language(F.col(f"`{text_col}`"), model).alias(own))
    return out.select(*keep, *[F.col(own).getField(c).alias(c) for c in outputs])


def held_out(doc_id: Column) -> Column:
    """Rows kept from learning: crc32 of the id as text leaves no rest by 5 (null: none)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op4_language_mixture(spark, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the labelled ones that are not held out."""
    d = documents(spark, sf_dir)
    out = held_out(F.col("doc_id"))
    model = train(d.where(~out))
    found = identify(d.select("doc_id", "text"), model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
