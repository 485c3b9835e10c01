"""Exact repeated windows of tokens, found from anchors instead of from all windows.

An operator splits a document's windows (runs of W tokens) among anchors so that
a window's anchor is a matter of the window's own tokens. Equal windows then have
anchors of equal key, wherever they stand. An anchor is a row

    key, span: hashes of what all its windows share and of all they cover
    id, doc:   document (its order, its identity)
    at:        place that the windows' tokens fix, the same in equal windows
    start, n:  its windows begin at start, ..., start + n - 1

Only anchors whose key occurs again can have repeated windows. Among those, rows
of one span have the same windows, so which rows repeat as a whole is a matter of
an aggregate by span. Where a key has several spans, that is at the ends of
repeats, one row a span is cut into finer anchors, blocks of windows and in the
end single windows, whose keys and spans are again hashes of what their windows
share and cover. All steps are aggregates by key and joins against their written
results, which Spark can split: no pairs of a group are listed, and groups
aggregate before they are shuffled.

A rule says which occurrences are repeats: ``earlier`` (all but the first by
document and place), ``smaller`` (all in documents with more than the least id)
or ``elsewhere`` (all of two or more).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperlens.llm.common import in_pieces, mix64, written

#: ranges of all documents that are broadcast at most
MOST_RANGES = 200_000
#: ids order documents; a null id is before all others
NULL_ID = -(1 << 63)
_BASE = 0x9E3779B97F4A7C15 | 5


def base_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of an odd base and of its inverse, modulo 2**64."""
    both = []
    for b in (_BASE, pow(_BASE, -1, 1 << 64)):
        p = np.full(n + 1, b, np.uint64)
        p[0] = 1
        both.append(np.cumprod(p, dtype=np.uint64))
    return both[0], both[1]


class Spans:
    """Hashes of spans of a token sequence, a few operations each."""

    def __init__(self, tokens: np.ndarray):
        power, self.inverse = base_powers(len(tokens))
        self.sums = np.zeros(len(tokens) + 1, np.uint64)
        np.cumsum(tokens * power[:-1], out=self.sums[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.sums[end] - self.sums[start]) * self.inverse[start])


def runs(owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First position and length of each run of equal values."""
    if not len(owner):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    first = np.concatenate(([0], np.flatnonzero(owner[1:] != owner[:-1]) + 1))
    return first, np.diff(np.concatenate((first, [len(owner)])))


def identified(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, doc, text): the id for order and the document's identity, both long. Rows that
    agree in id and text are one document for all that follows."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    i = F.col(id_col).cast("long")
    return df.select(F.coalesce(i, F.lit(NULL_ID)).alias("id"), F.xxhash64(i, text).alias("doc"),
                     text.alias("text"))


ANCHOR_SCHEMA = "key long, span long, id long, doc long, at int, start int, n int"


def anchors(docs: DataFrame, find: Callable[[list[str]], tuple], most_chars: int = 2_000_000) -> DataFrame:
    """Anchors of all documents. ``find(texts)`` gives arrays: text number, key, span, at, start, n."""
    def run(batches):
        import pyarrow as pa
        kinds = pa.schema([("key", pa.int64()), ("span", pa.int64()), ("id", pa.int64()),
                           ("doc", pa.int64()), ("at", pa.int32()), ("start", pa.int32()), ("n", pa.int32())])
        for b in in_pieces(batches):
            ids, doc = b.column(0).to_numpy(), b.column(1).to_numpy()
            texts = b.column(2).to_pylist()
            at = 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end]) <= most_chars):
                    size += len(texts[end])
                    end += 1
                who, key, span, place, start, n = find(texts[at:end])
                if len(who):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key.view(np.int64)), pa.array(span.view(np.int64)),
                         pa.array(ids[at:end][who]), pa.array(doc[at:end][who]),
                         pa.array(place.astype(np.int32)), pa.array(start.astype(np.int32)),
                         pa.array(n.astype(np.int32))], schema=kinds)
                at = end

    return docs.select("id", "doc", "text").mapInArrow(run, ANCHOR_SCHEMA)


def keys_seen_again(found: DataFrame) -> DataFrame:
    """Keys of two or more anchors."""
    return found.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")


def repeated(packed: DataFrame, found: DataFrame, shared: DataFrame, rule: str, width: int,
             spans_of: Callable[[bytes], Spans], what: str, steps: tuple[int, ...] = (1,)) -> DataFrame:
    """(doc, ranges): for documents with repeated windows, ranges (start, n) of their starts.

    ``packed``: (doc, packed), what ``spans_of`` makes a document's spans from; ``found``:
    anchors; ``shared``: keys among which all repeated ones are (distinct); ``steps``:
    windows in a block of each finer round, the last 1.
    """
    place = {"earlier": F.struct("id", "start"), "smaller": F.struct("id"),
             "elsewhere": F.struct("doc", "start")}[rule]
    rows = written(found.join(written(shared, f"{what}-keys"), "key"), f"{what}-0")
    parts = []
    for i, step in enumerate((*steps, 0), 1):
        spans = rows.groupBy("key", "span").agg(F.count("*").alias("c"), F.min(place).alias("first"))
        spans = written(spans, f"{what}-spans")
        judged = rows.join(spans, ["key", "span"])
        whole = F.col("c") > 1 if rule == "elsewhere" else place > F.col("first")
        if not step:  # single windows: a key has one span
            parts.append(judged.where(whole).select("doc", "start", "n"))
            break
        judged = written(judged.select(*rows.columns, whole.alias("whole"), (place == F.col("first")).alias("is_first")),
                         f"{what}-judged")
        parts.append(judged.where("whole").select("doc", "start", "n"))
        several = spans.groupBy("key").agg(F.count("*").alias("spans")).where("spans > 1").select("key")
        # of a span only its first row; those of other documents repeat it
        finer = judged.where("is_first").join(written(several, f"{what}-several"), "key")
        rows = written(_cut(packed, finer, step, width, spans_of), f"{what}-{i}")
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return written(out.groupBy("doc").agg(F.collect_set(F.struct("start", "n")).alias("ranges")), f"{what}-ranges")


def packed_texts(docs: DataFrame) -> DataFrame:
    """(doc, packed): texts compressed for the shuffle, one row a document."""
    def run(batches):
        import pyarrow as pa
        import zstandard
        z = zstandard.ZstdCompressor(level=1)
        for b in in_pieces(batches):
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([z.compress(t.as_py().encode()) for t in b.column(1)], pa.binary())],
                ["doc", "packed"])

    return docs.select("doc", "text").mapInArrow(run, "doc long, packed binary")


def cut_anchors(spans: Spans, key: np.ndarray, at: np.ndarray, start: np.ndarray, n: np.ndarray,
                step: int, width: int) -> tuple:
    """(row, key, span, start, n) of the blocks of rows. A window lies ``at - its start`` tokens
    before ``at``; a block holds the windows of ``step`` consecutive distances."""
    far, near = at - start, at - start - n + 1
    blocks = far // step - near // step + 1
    row = np.repeat(np.arange(len(key)), blocks)
    block = far[row] // step - (np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks))
    first = at[row] - np.minimum(far[row], block * step + step - 1)
    last = at[row] - np.maximum(near[row], block * step)
    # what all windows of the block share, whichever of them the row has
    core = spans.hash(at[row] - block * step, at[row] - block * step - step + 1 + width)
    finer = mix64(mix64(key[row] + block.astype(np.uint64)) ^ core)
    return row, finer, mix64(spans.hash(first, last + width) + (at[row] - first).astype(np.uint64)), first, last - first + 1


def _cut(docs: DataFrame, rows: DataFrame, step: int, width: int, spans_of) -> DataFrame:
    """Rows as finer anchors, from their packed documents."""
    wanted = rows.groupBy("doc", "id").agg(F.collect_set(F.struct("key", "at", "start", "n")).alias("wanted"))

    def run(batches):
        import pyarrow as pa
        kinds = [pa.int64()] * 4 + [pa.int32()] * 3
        for b in in_pieces(batches):
            for doc, i, packed, rows in zip(*(c.to_pylist() for c in b.columns)):
                key, at, start, n = (np.array([r[c] for r in rows], np.int64) for c in ("key", "at", "start", "n"))
                row, key, span, first, n = cut_anchors(
                    spans_of(packed), key.view(np.uint64), at, start, n, step, width)
                cols = (key.view(np.int64), span.view(np.int64), np.full(len(row), i), np.full(len(row), doc),
                        at[row], first, n)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                                 ["key", "span", "id", "doc", "at", "start", "n"])

    # rows that agree in id and text are one document: cut it once
    once = docs.join(wanted, "doc").dropDuplicates(["doc"])
    return once.select("doc", "id", "packed", "wanted").mapInArrow(run, ANCHOR_SCHEMA)


def covered(ranges: list[dict] | None, width: int, n: int) -> np.ndarray:
    """Which of n tokens lie in a repeated window of ``width``."""
    step = np.zeros(n + 1, np.int32)
    if ranges:
        start = np.array([r["start"] for r in ranges])
        np.add.at(step, start, 1)
        np.add.at(step, start + np.array([r["n"] for r in ranges]) - 1 + width, -1)
    return np.cumsum(step[:-1]) > 0


def with_ranges(df: DataFrame, ranges: DataFrame, id_col: str, text_col: str, keep: list[str]) -> DataFrame:
    """Rows of ``df`` (their ``keep`` columns as struct ``row``) with packed text and ranges."""
    def run(batches):
        import pyarrow as pa
        import zstandard
        z = zstandard.ZstdCompressor(level=1)
        for b in in_pieces(batches):
            texts = [None if t is None else z.compress(t.encode()) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(texts, pa.binary())], ["row", "doc", "packed"])

    text = F.col(text_col)
    d = df.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"),
                  F.xxhash64(F.col(id_col).cast("long"), F.coalesce(text, F.lit(""))).alias("doc"),
                  text.alias("text"))
    from pyspark.sql.types import BinaryType, StructField, StructType
    schema = StructType([d.schema["row"], d.schema["doc"], StructField("packed", BinaryType())])
    # broadcast up to MOST_RANGES ranges, a few MB; beyond, both sides are shuffled by document
    n = ranges.agg(F.coalesce(F.sum(F.size("ranges")), F.lit(0))).first()[0]
    return d.mapInArrow(run, schema).join(F.broadcast(ranges) if n <= MOST_RANGES else ranges, "doc", "left")


def unpacked(packed: bytes | None) -> str | None:
    """A text that was packed."""
    import zstandard
    return None if packed is None else zstandard.ZstdDecompressor().decompress(packed).decode()
