"""Line deduplication by winnowing.

Of the hashes of every ``min_lines`` consecutive lines the least is selected, so
any run of that many lines that occurs again has a selected line at the same
place in each occurrence. Selected lines are joined by their hash; where one
occurs again, the match is extended both ways to all windows around it
(``paperlens.llm.repeats``), and every occurrence of a run but the first goes.
Fewer lines than that are windows of their own, whole, where they hold ``min_words``
words or are all lines of a text.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperlens.llm.common import documents, in_pieces, mix64, written
from paperlens.llm.repeats import (
    MOST_RANGES, Spans, anchors, covered, identified, keys_seen_again, repeated, runs)

MIN_LINES = 3
#: words from which fewer lines than MIN_LINES are a window too
MIN_WORDS = 50
_SEED = 9


def line_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lines that hold a word, and how many each text has."""
    import xxhash
    out, counts = [], []
    for text in texts:
        own = [xxhash.xxh64_intdigest(x, _SEED) for x in (text or "").encode().split(b"\n") if x.strip()]
        out.extend(own)
        counts.append(len(own))
    return np.array(out, np.uint64), np.array(counts, np.int64)


def line_words(texts: list[str | None]) -> np.ndarray:
    """Number of words of each line that holds one."""
    n = (len(x.split()) for text in texts for x in (text or "").encode().split(b"\n"))
    return np.array([x for x in n if x], np.int64)


def winnowed(hashes: np.ndarray, counts: np.ndarray, width: int) -> tuple:
    """(text, key, span, at, start, n): each window of ``width`` lines with its selected line."""
    first = np.concatenate(([0], np.cumsum(counts)[:-1])) if len(counts) else counts
    windows = np.maximum(0, counts - width + 1)
    empty = np.empty(0, np.int64)
    if not windows.sum():
        return empty, empty.astype(np.uint64), empty.astype(np.uint64), empty, empty, empty
    text = np.repeat(np.arange(len(counts)), windows)
    starts = np.arange(windows.sum()) + np.repeat(first - (np.cumsum(windows) - windows), windows)
    window = np.lib.stride_tricks.sliding_window_view(hashes, width)[starts]
    owner = starts + window.argmin(axis=1)  # the first of equal ones
    at, n = runs(owner + text * (len(hashes) + 1))
    begin, own = starts[at], owner[at]
    spans = Spans(mix64(hashes))
    span = mix64(spans.hash(begin, begin + n - 1 + width) + (own - begin).astype(np.uint64)
                 * np.uint64(0xC2B2AE3D27D4EB4F) + n.astype(np.uint64))
    of = first[text[at]]
    return text[at], hashes[own], span, own - of, begin - of, n


def short_windows(hashes: np.ndarray, counts: np.ndarray, words: np.ndarray, width: int,
                  min_words: int) -> tuple:
    """Like ``winnowed``, for fewer than ``width`` lines: every 1 to ``width`` - 1 consecutive
    ones that hold ``min_words`` words, and all lines of a text that has no more. Each is an
    anchor of its own, whose key and span agree. ``n`` is such that ``covered`` at ``width``
    covers just these lines: 0 for one line less than ``width``, -1 for two less."""
    first = np.concatenate(([0], np.cumsum(counts)[:-1])) if len(counts) else counts
    text, total = np.repeat(np.arange(len(counts)), counts), np.concatenate(([0], np.cumsum(words)))
    spans = Spans(mix64(hashes))
    found = []
    for size in range(1, width):
        start = np.arange(max(0, len(hashes) - size + 1))
        start = start[(text[start] == text[start + size - 1])
                      & (total[start + size] - total[start] >= min_words)]
        whole = first[counts == size]
        for begin, kind in ((start, 2 * size), (whole, 2 * size + 1)):
            key = mix64(spans.hash(begin, begin + size) + np.uint64(kind))
            at = begin - first[text[begin]]
            found.append((text[begin], key, key, at, at, np.full(len(begin), size - width + 1)))
    return tuple(np.concatenate(c) for c in zip(*found))


def merged(ranges: DataFrame, width: int) -> DataFrame:
    """(doc, ranges) with ranges that overlap or touch as one: as many as a text has removed runs."""
    def run(batches):
        import pyarrow as pa
        for b in in_pieces(batches):
            out = []
            for rows in b.column(1).to_pylist():
                start, n = (np.array([r[c] for r in rows], np.int64) for c in ("start", "n"))
                order = np.argsort(start, kind="stable")
                start, end = start[order], np.maximum.accumulate((start + n - 1 + width)[order])
                first = np.concatenate(([True], start[1:] > end[:-1]))
                begin, end = start[first], end[np.concatenate((first[1:], [True]))]
                out.append([{"start": x, "n": y} for x, y in zip(begin.tolist(), (end - begin + 1 - width).tolist())])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, b.schema.field(1).type)], ["doc", "ranges"])

    return ranges.select("doc", "ranges").mapInArrow(run, "doc long, ranges array<struct<start:int,n:int>>")


def without_lines(text: str, gone: np.ndarray) -> str:
    """The text without the given lines (numbered among those that hold a word); a blank line
    goes with the line of words before it."""
    kept, i, last = [], -1, False
    for line in text.split("\n"):
        if line.encode().strip():
            i += 1
            last = bool(gone[i])
        if not last:
            kept.append(line)
    return "\n".join(kept)


def dedup_lines(df: DataFrame, min_lines: int | None = None, id_col: str = "doc_id",
                text_col: str = "text", min_words: int | None = None) -> DataFrame:
    """All rows of ``df`` with the text reduced, and ``n_lines``, ``n_removed`` and ``n_runs``.

    Lines end at line feeds and count if they hold a word. Every line goes that lies in
    ``min_lines`` consecutive lines which also start at an earlier place: in a row with a
    smaller id, or before in the same row. ``n_runs`` counts maximal removed runs.

    With ``min_words``, fewer consecutive lines that hold so many words together go in the
    same way, and so do all lines of a row of fewer than ``min_lines`` that also are all
    lines of a row with a smaller id. By default ``min_lines`` is ``MIN_LINES`` and
    ``min_words`` is ``MIN_WORDS``; where only ``min_lines`` is given, it alone counts.

    A null text stays null and has no lines; a null id is before all others; rows of equal
    id are compared by line number alone, and rows that agree in id and text are one
    document, so they do not repeat each other. Columns named like the counts are replaced,
    other columns are kept. An empty table gives an empty result.
    """
    if min_lines is None:
        min_lines, min_words = MIN_LINES, MIN_WORDS if min_words is None else min_words
    docs = identified(df, id_col, text_col)

    def find(texts):
        hashes, counts = line_hashes(texts)
        found = winnowed(hashes, counts, min_lines)
        if min_words is None or min_lines < 2:
            return found
        short = short_windows(hashes, counts, line_words(texts), min_lines, min_words)
        # by text, as a document's rows are found together
        both = [np.concatenate(c) for c in zip(found, short)]
        order = np.argsort(both[0], kind="stable")
        return tuple(c[order] for c in both)

    def pack(batches):
        import pyarrow as pa
        for b in in_pieces(batches):
            packed = [line_hashes([t.as_py()])[0].tobytes() for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(packed, pa.binary())], ["doc", "packed"])

    def spans_of(packed):
        return Spans(mix64(np.frombuffer(packed, np.uint64)))

    found = written(anchors(docs, find), "winnowed")
    hashes = docs.select("doc", "text").mapInArrow(pack, "doc long, packed binary")  # 8 bytes a line
    ranges = repeated(hashes, found, keys_seen_again(found), "earlier", min_lines, spans_of, "winnowed")
    ranges = merged(ranges, min_lines)
    counts = ["n_lines", "n_removed", "n_runs"]
    keep = [c for c in df.columns if c.lower() not in counts]

    @F.arrow_udf("text string, n_lines long, n_removed long, n_runs long")
    def reduced(texts, ranges):
        """Counts of a text, and what is left of it if anything goes (else null)."""
        import pyarrow as pa
        out = [[], [], [], []]
        for text, r in zip(texts, ranges):
            text, r = text.as_py(), r.as_py()
            n = sum(1 for x in (text or "").encode().split(b"\n") if x.strip())
            gone = covered(r, min_lines, n)
            runs_ = int((gone & ~np.concatenate(([False], gone[:-1]))[:n]).sum())
            for col, v in zip(out, (None if r is None else without_lines(text, gone), n, int(gone.sum()), runs_)):
                col.append(v)
        return pa.StructArray.from_arrays(
            [pa.array(out[0], pa.string()), *(pa.array(c, pa.int64()) for c in out[1:])], ["text", *counts])

    text = F.col(f"`{text_col}`")
    row = F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row")
    doc = F.xxhash64(F.col(f"`{id_col}`").cast("long"), F.coalesce(text, F.lit(""))).alias("doc")
    # up to MOST_RANGES ranges are broadcast, a few MB; beyond, both sides are shuffled by document
    few = ranges.agg(F.coalesce(F.sum(F.size("ranges")), F.lit(0))).first()[0] <= MOST_RANGES
    joined = df.select(row, doc).join(F.broadcast(ranges) if few else ranges, "doc", "left")
    own = F.col("row").getField(text_col)
    # only the text goes to Python, and a text comes back only where it changes
    out = joined.select("row", reduced.asNondeterministic()(own, F.col("ranges")).alias("left"))
    return out.select(*[F.coalesce(F.col("left.text"), own).alias(c) if c == text_col
                        else F.col("row").getField(c).alias(c) for c in keep],
                      *[F.col("left").getField(c).alias(c) for c in counts])


def op9_winnowed_lines(spark, sf_dir: str) -> DataFrame:
    """Every document without lines of three-line runs, of one or two lines of 50 words, or of
    whole texts of one or two lines that stand earlier too."""
    return _hashed(dedup_lines(documents(spark, sf_dir).select("doc_id", "text")))


def _hashed(d: DataFrame) -> DataFrame:
    return d.select("doc_id", "n_lines", "n_removed", "n_runs",
                    F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH a AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
l AS (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS c, c > 0 AS words FROM a),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i,
    count(*) OVER (PARTITION BY doc_id) AS t FROM l WHERE words),
p AS (SELECT *, lead(line, 1) OVER d AS line1, lead(line, 2) OVER d AS line2, lead(c, 1) OVER d AS c1
  FROM n WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
w AS (SELECT doc_id, i, 3 AS kind, 3 AS size, line || chr(10) || line1 || chr(10) || line2 AS win FROM p
  UNION ALL SELECT doc_id, i, 2, 2, line || chr(10) || line1 FROM p WHERE c + c1 >= 50
  UNION ALL SELECT doc_id, i, 1, 1, line FROM p WHERE c >= 50
  UNION ALL SELECT doc_id, i, -t, t, concat_ws(chr(10), line, line1) FROM p WHERE t < 3 AND i = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY kind, win ORDER BY doc_id, i) AS k FROM w WHERE win IS NOT NULL),
g AS (SELECT DISTINCT doc_id, i + o AS i FROM r, (VALUES (0), (1), (2)) AS t(o) WHERE k > 1 AND o < size),
m AS (SELECT n.doc_id, n.pos, g.i IS NOT NULL AS gone FROM n LEFT JOIN g ON g.doc_id = n.doc_id AND g.i = n.i),
x AS (SELECT l.doc_id, l.pos, l.line, l.words, m.gone,
  coalesce(last_value(m.gone IGNORE NULLS) OVER (PARTITION BY l.doc_id ORDER BY l.pos), false) AS out
  FROM l LEFT JOIN m ON m.doc_id = l.doc_id AND m.pos = l.pos),
b AS (SELECT doc_id, pos, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY pos), false) AS begins
  FROM m)
SELECT x.doc_id, count(*) FILTER (words) AS n_lines, count(*) FILTER (x.gone) AS n_removed,
  count(*) FILTER (b.begins) AS n_runs,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY x.pos) FILTER (NOT out), '')) AS kept_sha256
FROM x LEFT JOIN b ON b.doc_id = x.doc_id AND b.pos = x.pos GROUP BY x.doc_id"""
