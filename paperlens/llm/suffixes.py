"""Repeated byte strings by a logarithmic family of hashed prefixes.

A family of suffix arrays in frame only: entries are hashes, not suffixes in byte
order, and there are no common-prefix lengths. The places indexed are minimisers:
of any run of windows' leading bytes, the least hash of PREFIX bytes, so that every
window of WIDTH bytes holds one at a place that its own bytes fix. A batch of
documents gets its table (an entry for each distinct prefix, its 64-bit hash),
which is joined with the table of each level for prefixes in common; when two
levels are of equal size they merge, so there are as many levels as the number of
batches has binary digits. Prefixes that occur again are then verified and extended
to exact windows (``paperlens.llm.repeats``), which finds the long matches.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperlens.llm.common import documents, in_pieces, mix64, written
from paperlens.llm.repeats import Spans, anchors, covered, identified, packed_texts, repeated, runs, unpacked, with_ranges

PREFIX = 32
#: batches that the query adds one after the other, windows in a block of anchors
BATCHES = 3
BLOCK = 16


class SuffixFamily:
    """Suffix arrays of levels of growing size over what ``add`` was given so far.

    An array is a table of the distinct prefixes' hashes, sorted within its partitions; the
    suffixes of a prefix are the anchors that carry it.
    """

    def __init__(self):
        self.levels: list[tuple[int, DataFrame]] = []
        self.hits: list[DataFrame] = []

    def add(self, batch: DataFrame) -> None:
        """Indexes the anchors of a batch and collects prefixes found again."""
        array = batch.groupBy("key").agg((F.count("*") > 1).alias("again"))
        array = written(array.sortWithinPartitions("key"), "suffix-array")
        self.hits.append(array.where("again").select("key"))
        for _, level in self.levels:
            self.hits.append(array.select("key").join(level, "key"))
        size, array = 1, array.select("key")
        while self.levels and self.levels[-1][0] == size:
            _, level = self.levels.pop()
            array = array.union(level).distinct()
            size *= 2
        if size > 1:
            array = written(array.sortWithinPartitions("key"), "suffix-level")
        self.levels.append((size, array))

    def found_again(self) -> DataFrame:
        """Distinct prefixes that occur twice or more in all that was added."""
        out = self.hits[0]
        for h in self.hits[1:]:
            out = out.union(h)
        return out.distinct()


def minimisers(raw_at: np.ndarray, lengths: np.ndarray, grams: np.ndarray, width: int, prefix: int) -> tuple:
    """For all windows of ``width`` bytes: (start, place of the least gram, leftmost if tied)."""
    reach = width - prefix + 1
    code = (grams & ~np.uint64(0xFFFFFFFF)) | np.arange(len(grams), dtype=np.uint64)
    least, step = code, 1
    while 2 * step <= reach:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    if reach > step:
        least = np.minimum(least[:len(least) - (reach - step)], least[reach - step:])
    counts = np.maximum(0, lengths - width + 1)
    offset = np.concatenate(([0], np.cumsum(counts)[:-1]))
    starts = np.repeat(raw_at - offset, counts) + np.arange(counts.sum())
    return starts, (least[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)


def byte_values(raw: np.ndarray, salt: int) -> np.ndarray:
    return mix64(np.arange(256, dtype=np.uint64) + np.uint64(salt << 20))[raw]


def anchors_of(texts: list[str], width: int, prefix: int = PREFIX) -> tuple:
    """(text, key, span, at, start, n) for all windows of ``width`` bytes."""
    blobs = [t.encode() for t in texts]
    lengths = np.array([len(b) for b in blobs], np.int64)
    empty = np.empty(0, np.int64)
    if not (lengths >= width).any():
        return empty, empty.astype(np.uint64), empty.astype(np.uint64), empty, empty, empty
    at = np.concatenate(([0], np.cumsum(lengths)))
    raw = np.frombuffer(b"".join(blobs), np.uint8)
    spans = Spans(byte_values(raw, 1))
    place = np.arange(len(raw) - prefix + 1)
    grams = spans.hash(place, place + prefix)
    starts, owner = minimisers(at[:-1], lengths, grams, width, prefix)
    text = np.repeat(np.arange(len(lengths)), np.maximum(0, lengths - width + 1))
    first, n = runs(owner + text * (len(raw) + 1))
    begin, anchor = starts[first], owner[first]
    offset = (anchor - begin).astype(np.uint64)
    span = mix64(spans.hash(begin, begin + n - 1 + width) + offset * np.uint64(0xC2B2AE3D27D4EB4F)
                 + n.astype(np.uint64))
    own = at[text[first]]
    return text[first], grams[anchor], span, anchor - own, begin - own, n


def repeated_bytes(df: DataFrame, width: int, batches: int, id_col: str, text_col: str) -> DataFrame:
    """(doc, ranges) of windows of bytes that start at two places or more."""
    docs = identified(df, id_col, text_col).withColumn("id", F.lit(0).cast("long"))  # no order needed

    def find(texts):
        return anchors_of(texts, width)

    def spans_of(packed):
        return Spans(byte_values(np.frombuffer(unpacked(packed).encode(), np.uint8), 2))

    found = written(anchors(docs, find, 1_000_000), "suffixes")
    family = SuffixFamily()
    for i in range(batches):
        family.add(found.where(F.pmod("doc", F.lit(batches)) == i))
    return repeated(packed_texts(docs), found, family.found_again(), "elsewhere", width, spans_of, "suffixes",
                    (BLOCK, 1) if width > 2 * BLOCK else (1,))


def dedup_bytes(df: DataFrame, width: int = 200, batches: int = BATCHES, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept) of every row: ``kept`` are the UTF-8 bytes that
    no string of ``width`` bytes covers which also starts anywhere else (the same document
    included); strings are judged on the input, ``n_spans`` counts maximal removed runs.

    A null text is an empty one; repeated rows are places of their own, so they repeat each
    other; ids may be null. Texts of any length are taken whole. Other columns are left out,
    whatever their names. An empty table gives an empty result.
    """
    ranges = repeated_bytes(df, width, batches, id_col, text_col)

    def keep(batches_):
        import pyarrow as pa
        kinds = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()),
                           ("n_spans", pa.int64()), ("kept", pa.binary())])
        for b in in_pieces(batches_):
            out = [[] for _ in kinds]
            for row, packed, r in zip(b.column(0), b.column(1), b.column(2)):
                raw = np.frombuffer((unpacked(packed.as_py()) or "").encode(), np.uint8)
                gone = covered(r.as_py(), width, len(raw))
                begins = gone & ~np.concatenate(([False], gone[:-1]))[:len(gone)]
                for col, v in zip(out, (row.as_py()["id"], len(raw), int(gone.sum()), int(begins.sum()),
                                        raw[~gone].tobytes())):
                    col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(out, kinds)], schema=kinds)

    d = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    joined = with_ranges(d, ranges, "id", "text", ["id"])
    return joined.select("row", "packed", "ranges").mapInArrow(
        keep, "id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op10_suffix_family_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document without bytes of 200-byte strings that start elsewhere too."""
    d = dedup_bytes(documents(spark, sf_dir))
    return d.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans",
                    F.sha2("kept", 256).alias("kept_sha256"))


OP10_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
s AS (SELECT doc_id, h, unnest(range(0, CAST(len(h) / 2 AS BIGINT) - 199)) AS i FROM d WHERE len(h) >= 400),
v AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 400)) AS win FROM s),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY win) AS c FROM v),
n AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 200 THEN 0 ELSE 1 END AS new
  FROM r WHERE c > 1),
g AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM n),
m AS (SELECT doc_id, min(i) AS a, max(i) + 200 AS b FROM g GROUP BY doc_id, run),
p AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS p FROM m),
t AS (SELECT p.doc_id, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans, max(b) AS last,
  string_agg(substr(h, 2 * p + 1, 2 * (a - p)), '' ORDER BY a) AS head FROM p JOIN d USING (doc_id) GROUP BY p.doc_id)
SELECT d.doc_id, CAST(len(h) / 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN t ON t.doc_id = d.doc_id"""
