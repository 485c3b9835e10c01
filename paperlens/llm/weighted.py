"""Document fingerprints by consistent weighted sampling.

A document is its words, weighted by how often they occur. For each sample,
every word draws gamma variates r and c and a uniform b from its hash; with
weight w it proposes t = floor(ln w / r + b) and the value
ln a = ln c - r (t - b + 1); the sample is the (word, t) of the least a. Two
documents have the same sample with a probability equal to their generalised
Jaccard similarity (sum of least over sum of largest weights).
"""

from __future__ import annotations

import hashlib
import sys
import types
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperlens.llm.common import documents, mix64
from paperlens.llm.words import Words

SAMPLES = 64
#: rows aimed at in a range of neighbouring ids
RANGE_ROWS = 4000


def _gamma_quantiles() -> np.ndarray:
    """Quantiles of Gamma(2, 1) at the middles of 65536 equal parts (Newton steps)."""
    p = (np.arange(65_536) + 0.5) / 65_536
    x = np.sqrt(2 * p)
    for _ in range(60):
        f = 1 - (1 + x) * np.exp(-x) - p
        x = np.maximum(x - f / np.maximum(x * np.exp(-x), 1e-12), x / 2)
    return x


def _tables() -> tuple[np.ndarray, np.ndarray]:
    kept = sys.modules.setdefault("_llm_gamma", types.ModuleType("_llm_gamma"))
    if not hasattr(kept, "tables"):
        x = _gamma_quantiles()
        kept.tables = x.astype(np.float32), np.log(x).astype(np.float32)
    return kept.tables


def signatures(words: Words, samples: int = SAMPLES, salt: int = 8) -> np.ndarray:
    """Samples (16 bits each) of each text, a row a text; a text without words has zeros.

    Equal texts have equal rows, and so have texts with the same words as often.
    """
    gamma, log_gamma = _tables()
    n = len(words.first) - 1
    out = np.zeros((n, samples), np.uint16)
    terms, weights, first = [], [], [0]
    for i in range(n):
        t, w = np.unique(words.hash[words.first[i]:words.first[i + 1]], return_counts=True)
        terms.append(t)
        weights.append(w)
        first.append(first[-1] + len(t))
    first = np.array(first)
    has = np.flatnonzero(np.diff(first))
    if not len(has):
        return out
    term = np.concatenate(terms)
    log_w = np.log(np.concatenate(weights)).astype(np.float32)
    factors = mix64(np.arange(samples, dtype=np.uint64) + np.uint64(salt << 32)) | np.uint64(1)
    low = np.uint64(0xFFFF)
    for k in range(samples):
        x = term * factors[k]
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        r = gamma[(x & low).astype(np.intp)]
        b = ((x >> np.uint64(16)) & low).astype(np.float32) * np.float32(1 / 65_536)
        t = np.floor(log_w / r + b)
        value = log_gamma[(x >> np.uint64(48)).astype(np.intp)] - r * (t - b + np.float32(1))
        bits = value.view(np.int32).astype(np.int64)  # in the order of the floats, unsigned
        bits = np.where(bits < 0, ~bits, bits | 0x80000000) & 0xFFFFFFFF
        name = (x >> np.uint64(20)) + t.astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        name ^= name >> np.uint64(32)
        best = np.minimum.reduceat((bits.astype(np.uint64) << np.uint64(32)) | (name & np.uint64(0xFFFFFFFF)),
                                   first[has])
        out[has, k] = (best & low).astype(np.uint16)
    return out


def likeness(a: np.ndarray, b: np.ndarray, samples: int = SAMPLES) -> float:
    return float((a == b).sum()) / samples


def as_text(signature: np.ndarray) -> str:
    return signature.astype(">u2").tobytes().hex()


def edited(text: str, following: str) -> str:
    """The last quarter of the code points replaced by the first as many of ``following``."""
    n = len(text) // 4
    return text[:len(text) - n] + following[:n]


def with_following(df: DataFrame, id_col: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Columns id, text of ``df`` in partitions of whole id ranges: rows of a range are
    sorted by id, then by text, and end with a copy of the first row of the next range (of
    the first range after the last), marked ``copy``. Null ids come first."""
    n = df.count()
    most = max(1, min(10_000, n // range_rows))
    cuts = df.select(F.percentile_approx(id_col, [i / most for i in range(1, most)] or [0.5], 100_000)
                     .alias("c")).first()["c"] or []
    cuts = np.array(sorted(set(cuts if most > 1 else [])), np.int64)  # at most 10000 numbers

    def own_range(ids: pd.Series) -> np.ndarray:
        known = ids.notna().to_numpy()
        out = np.zeros(len(ids), np.int64)
        out[known] = np.searchsorted(cuts, ids[known].astype("int64").to_numpy(), side="right")
        return out

    @F.pandas_udf("int")
    def range_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for ids in batches:
            yield pd.Series(own_range(ids).astype("int32"))

    heads = (df.select(F.col(id_col).alias("id")).groupBy(range_of("id").alias("range"))
             .agg(F.min_by("id", F.struct(F.col("id").isNotNull(), "id")).alias("head"))
             .orderBy("range").collect())  # a row a range
    # who needs a copy: the range before; the first row of all goes to the last range
    before = {h["head"]: heads[i - 1]["range"] for i, h in enumerate(heads)}
    null_to, before = before.get(None), {k: v for k, v in before.items() if k is not None}
    keys = np.array(sorted(before), np.int64)
    to = np.array([before[k] for k in keys.tolist()], np.int64)

    @F.pandas_udf("array<int>")
    def ranges(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for ids in batches:
            own, known = own_range(ids), ids.notna().to_numpy()
            out = [[r] for r in own.tolist()]
            if null_to is not None:
                for i in np.flatnonzero(~known).tolist():
                    out[i].append(null_to)
            value = ids.fillna(0).astype("int64").to_numpy()
            if len(keys):
                at = np.minimum(np.searchsorted(keys, value), len(keys) - 1)
                for i in np.flatnonzero(known & (keys[at] == value)).tolist():
                    out[i].append(int(to[at[i]]))
            yield pd.Series(out)

    spread = (df.select(F.col(id_col).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
              .select("id", "text", F.posexplode(ranges("id")).alias("copy", "range")))
    return (spread.repartition(max(1, len(heads)), "range")
            .sortWithinPartitions("range", "copy", F.col("id").asc_nulls_first(), "text"))


def fingerprint_with_edits(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                           samples: int = SAMPLES, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    Every row is compared with its edited text and with the next row by id (the first, after
    the last; itself, if it is alone). A null text is an empty one; an empty or wordless
    text has fingerprint zeros, alike to another such and, but for chance, to no other.
    Rows of one id follow each other by text, repeated rows included; null ids come before
    all others. Extra columns are left out, whatever their names. Empty tables give empty
    results.
    """
    d = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def compare(rows: list[tuple]) -> dict[str, list]:
        """For consecutive rows, all but the last."""
        texts = [r[1] for r in rows]
        changed = [edited(a, b) for a, b in zip(texts, texts[1:])]
        sig = signatures(Words(texts + changed), samples)
        own, new = sig[:len(texts)], sig[len(texts):]
        return {"id": [r[0] for r in rows[:-1]], "n_chars": [len(t) for t in texts[:-1]],
                "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in changed],
                "fingerprint": [as_text(s) for s in own[:-1]],
                "edited_fingerprint": [as_text(s) for s in new],
                "near_edited": [likeness(a, b, samples) for a, b in zip(own, new)],
                "near_next": [likeness(a, b, samples) for a, b in zip(own, own[1:])]}

    schema = ("id long, n_chars long, edited_sha256 string, fingerprint string, "
              "edited_fingerprint string, near_edited double, near_next double")

    def run(batches):
        import pyarrow as pa
        kinds = pa.schema([("id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()),
                           ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()),
                           ("near_edited", pa.float64()), ("near_next", pa.float64())])
        rows, size, here = [], 0, None
        for b in batches:
            for doc, text, copy, place in zip(*(b.column(c) for c in ("id", "text", "copy", "range"))):
                copy, place = copy.as_py(), place.as_py()
                if place != here:
                    rows, size, here = [], 0, place
                if here is None:
                    continue
                rows.append((doc.as_py(), text.as_py()))
                size += len(rows[-1][1])
                if copy or size > 1_000_000:
                    if len(rows) > 1:
                        yield pa.RecordBatch.from_pydict(compare(rows), kinds)
                    rows, size = rows[-1:], 0
                if copy:
                    here = None  # one copy ends the range
                    rows = []
        return

    return with_following(d, "id", range_rows).mapInArrow(run, schema)


def op8_weighted_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return fingerprint_with_edits(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")
