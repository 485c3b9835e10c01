"""Substring deduplication by recompression.

Each document starts as its sequence of word names. A round names runs of equal
symbols, then pairs of a left and a right symbol (a symbol's side is a bit of its
hash). A name is a hash of what it stands for, so the same run or pair has the
same name in every document, task and Spark job: naming is global without an
exchange. Equal substrings thereby get equal symbols in their interior, and only
symbols near their ends differ.

How near is known exactly: with each symbol goes its context, the words that
made it what it is. A window of words has those symbols whose context lies
within it, wherever it occurs. The one of least hash in the highest round is its anchor; a
shared anchor reveals a repeat, which is then verified window by window
(``paperlens.llm.repeats``).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperlens.llm.common import documents, in_pieces, mix64, written
from paperlens.llm.repeats import (
    Spans, anchors, covered, identified, keys_seen_again, packed_texts, repeated, runs, unpacked, with_ranges)
from paperlens.llm.words import Words

#: rounds of runs and pairs. Each makes symbols longer and contexts wider; after three a window of
#: 50 words has about fifteen symbols, and the one of least hash serves about fifteen windows
ROUNDS = 3
#: an anchor whose context has fewer words than this says too little: then each window is its own key
LEAST_CONTEXT = 8
_FAR = 1 << 40


class Symbols:
    """Symbols of several texts in a row: name, text, context [low, high) in words."""

    def __init__(self, name, text, low, high):
        self.name, self.text, self.low, self.high = name, text, low, high

    def _neighbours(self, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Contexts of the symbols before ``first`` and after ``last``; unbounded at a text's end."""
        n = len(self.name)
        before, after = np.maximum(first - 1, 0), np.minimum(last + 1, n - 1)
        low = np.where((first > 0) & (self.text[before] == self.text[first]), self.low[before], -_FAR)
        high = np.where((last < n - 1) & (self.text[after] == self.text[last]), self.high[after], _FAR)
        return low, high

    def runs_named(self, salt: int) -> "Symbols":
        same = (self.name[1:] == self.name[:-1]) & (self.text[1:] == self.text[:-1])
        first = np.concatenate(([0], np.flatnonzero(~same) + 1))
        last = np.concatenate((first[1:], [len(self.name)])) - 1
        length = (last - first + 1).astype(np.uint64)
        name = self.name[first]
        many = length > 1
        name[many] = mix64(name[many] + length[many] * np.uint64(0xA24BAED4963EE407) + np.uint64(2 * salt + 1))
        low, high = self._neighbours(first, last)  # a run ends where a neighbour differs
        return Symbols(name, self.text[first], np.minimum(low, self.low[first]),
                       np.maximum(high, self.high[last]))

    def pairs_named(self, salt: int) -> "Symbols":
        n = len(self.name)
        left = (mix64(self.name + np.uint64(salt << 8)) & np.uint64(1)).astype(bool)
        opens = np.zeros(n, bool)
        opens[:-1] = left[:-1] & ~left[1:] & (self.text[:-1] == self.text[1:])
        closes = np.zeros(n, bool)
        closes[1:] = opens[:-1]
        first = np.flatnonzero(~closes)
        paired = opens[first]
        last = first + paired
        name = self.name[first]
        p = first[paired]
        name[paired] = mix64(mix64(self.name[p] + np.uint64(2 * salt)) + self.name[p + 1])
        low, high = self._neighbours(first, last)
        # a pair is settled by itself; a left symbol alone by what follows, a right one by what precedes
        alone_left, alone_right = ~paired & left[first], ~paired & ~left[first]
        return Symbols(name, self.text[first],
                       np.where(alone_right, np.minimum(low, self.low[first]), self.low[first]),
                       np.where(alone_left, np.maximum(high, self.high[last]), self.high[last]))


def least_of(values: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Place of the least of ``count`` values from ``first`` on (the leftmost, if upper halves tie)."""
    code = (values & ~np.uint64(0xFFFFFFFF)) | np.arange(len(values), dtype=np.uint64)
    out = np.empty(len(first), np.uint64)
    step = 1
    while len(first):
        use = np.flatnonzero((count >= step) & (count < 2 * step))
        out[use] = np.minimum(code[first[use]], code[first[use] + count[use] - step])
        if step >= count.max(initial=0) or 2 * step > len(values):
            break
        code = np.minimum(code[:-step], code[step:])
        step *= 2
    return (out & np.uint64(0xFFFFFFFF)).astype(np.int64)


def anchors_of(words: Words, width: int, rounds: int = ROUNDS) -> tuple:
    """(text, key, span, at, start, n) for all windows of ``width`` words."""
    counts = np.diff(words.first)
    starts = np.concatenate([np.arange(a, a + max(0, c - width + 1)) for a, c in zip(words.first, counts)]
                            or [np.empty(0, np.int64)]).astype(np.int64)
    empty = np.empty(0, np.int64)
    if not len(starts):
        return empty, empty.astype(np.uint64), empty.astype(np.uint64), empty, empty, empty
    spans = Spans(words.hash)
    place = np.arange(len(words.hash), dtype=np.int64)
    s = Symbols(words.hash, np.repeat(np.arange(len(counts)), counts), place, place + 1)
    levels = []
    for r in range(rounds):
        s = s.runs_named(2 * r + 1).pairs_named(2 * r + 2)
        size = s.high - s.low
        good = (size <= width) & (size >= LEAST_CONTEXT)
        levels.append((s.low[good], s.high[good], s.name[good]))
    low = np.full(len(starts), -1, np.int64)  # context of each window's anchor, and its level
    high, level = low.copy(), low.copy()
    open_ = np.arange(len(starts))
    for r in range(rounds - 1, -1, -1):
        lo, hi, name = levels[r]
        if not len(lo) or not len(open_):
            continue
        first = np.searchsorted(lo, starts[open_])
        count = np.searchsorted(hi, starts[open_] + width, side="right") - first
        own = open_[count > 0]
        at = least_of(mix64(name), first[count > 0], count[count > 0])
        low[own], high[own], level[own] = lo[at], hi[at], r
        open_ = open_[count <= 0]
    # a run of windows with one anchor; a window without any is its own
    mark = np.where(level < 0, starts + _FAR, low * rounds + level)
    first, n = runs(mark)
    first_word = starts[first]
    end = first_word + n - 1 + width
    found = level[first] >= 0
    key_low = np.where(found, low[first], first_word)
    key_high = np.where(found, high[first], first_word + width)
    key = mix64(spans.hash(key_low, key_high) + level[first].astype(np.uint64))
    offset = (key_low - first_word).astype(np.uint64)
    span = mix64(spans.hash(first_word, end) + offset * np.uint64(0xC2B2AE3D27D4EB4F) + n.astype(np.uint64))
    text = np.searchsorted(words.first, first_word, side="right") - 1
    return text, key, span, key_low - words.first[text], first_word - words.first[text], n


def repeated_words(df: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """(doc, ranges) of windows that also start in a document with a smaller id."""
    docs = identified(df, id_col, text_col)

    def find(texts):
        return anchors_of(Words(texts), width)

    def spans_of(packed):
        return Spans(Words([unpacked(packed)], salt=3).hash)  # other hashes than the anchors'

    found = written(anchors(docs, find), "recompressed")
    return repeated(packed_texts(docs), found, keys_seen_again(found), "smaller", width, spans_of, "recompressed")


def dedup_substrings(df: DataFrame, width: int = 50, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """(id, n_words, n_removed, kept) of every row: ``kept`` are the words, joined by one
    space, that no window of ``width`` words covers which also starts in a document with a
    smaller id; windows are judged on the input.

    A null text has no words; a null id is before all others; rows of equal id never make
    each other repeats. Texts of any length are taken whole. Other columns are left out,
    whatever their names. An empty table gives an empty result.
    """
    ranges = repeated_words(df, width, id_col, text_col)

    def keep(batches):
        import pyarrow as pa
        for b in in_pieces(batches):
            out = [[], [], [], []]
            for row, packed, r in zip(b.column(0), b.column(1), b.column(2)):
                words = (unpacked(packed.as_py()) or "").encode().split()
                gone = covered(r.as_py(), width, len(words))
                kept = b" ".join([w for w, g in zip(words, gone.tolist()) if not g])
                for col, v in zip(out, (row.as_py()["id"], len(words), int(gone.sum()), kept)):
                    col.append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()),
                 pa.array(out[3], pa.binary()).cast(pa.string())], ["id", "n_words", "n_removed", "kept"])

    d = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    joined = with_ranges(d, ranges, "id", "text", ["id"])
    return joined.select("row", "packed", "ranges").mapInArrow(
        keep, "id long, n_words long, n_removed long, kept string")


def op5_recompression_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document without words of 50-word windows that an earlier document has."""
    d = dedup_substrings(documents(spark, sf_dir))
    return d.select(F.col("id").alias("doc_id"), "n_words", "n_removed",
                    F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP5_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50),
v AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS win FROM s),
r AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY win) AS first FROM v),
g AS (SELECT doc_id, list(DISTINCT i) AS starts FROM r WHERE first < doc_id GROUP BY doc_id),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM (
  SELECT doc_id, unnest(starts) AS i FROM g)),
u AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
k AS (SELECT u.doc_id, u.word, u.i, c.i IS NOT NULL AS gone FROM u LEFT JOIN c
  ON c.doc_id = u.doc_id AND c.i = u.i),
t AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed,
  string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM k GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(t.n_removed, 0) AS n_removed,
  sha256(coalesce(t.kept, '')) AS kept_sha256 FROM d LEFT JOIN t ON t.doc_id = d.doc_id"""
