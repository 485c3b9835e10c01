"""Bounded-space online best-fit packing of token sequences.

Texts become token ids, long documents are cut into whole sequences, and the
pieces are packed as they stream by: a fixed number of open bins, held in a
bitset keyed by free space, the fitting bin with the least free space first;
when a bin too many is open, the fullest closes. Pieces arrive longest first
within a lane, a stream of fixed size that one task packs in bounded memory.
"""

from __future__ import annotations

import re
import sys
import types
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperlens.llm.common import documents, in_pieces, with_fields, written

#: words kept with their ids in each Python worker
CACHED_WORDS = 600_000
#: pieces of a lane, bins open in it at a time
LANE_PIECES = 25_000
OPEN_BINS = 8192

_PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


class WordTokens:
    """Token ids of texts for a tokenizer that drops white space and lower-cases.

    Such a tokenizer treats the words between ASCII white space on their own, so
    a word's ids are kept: most words of a corpus repeat. A word of plain letters
    and a plain punctuation tail is one token group each, which keeps fewer.
    """

    def __init__(self, path: str, cached: int | None = None):
        from tokenizers import Tokenizer
        self.cached = cached or CACHED_WORDS
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        # how byte-level models write a byte: itself where it prints, else from 256 on
        prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [x for x in range(256) if x not in prints]
        self.written = {x: x for x in prints} | {x: 256 + i for i, x in enumerate(rest)}
        self.plain = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-;=-@\[-`{}~]*)")
        self.words: dict[bytes, bytes] = {b"": b""}
        self.parts: dict[str, bytes] = {"": b""}

    def encode(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes()

    def learn(self, words: set[bytes], docs: list[list[bytes]]) -> None:
        if len(self.words) + len(words) > self.cached:  # begin anew
            self.words, self.parts = {b"": b""}, {"": b""}
            words = set().union(*docs)
        parts, letters_ids = self.parts, self.letters_ids
        for w in words:
            s = w.decode("utf-8")
            m = self.plain.fullmatch(s)
            if m is None:
                self.words[w] = self.encode(s)
                continue
            letters, tail = m[1].lower(), m[2]
            if letters not in parts:
                parts[letters] = letters_ids(letters)
            if tail and tail not in parts:
                parts[tail] = self.encode(tail)
            self.words[w] = parts[letters] + parts[tail]

    def letters_ids(self, letters: str) -> bytes:
        """Ids of lower-case letters: the model alone, as its normaliser changes nothing."""
        raw = letters if letters.isascii() else letters.encode().decode("latin-1").translate(self.written)
        return b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(raw)])

    def ids(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        docs = []
        for text in texts:
            raw = text.encode("utf-8")
            # lower case first makes more words equal, but could spell a special token
            docs.append((raw if b"<|" in raw else raw.lower()).split())
        known = self.words
        self.learn(set().union(*docs).difference(known), docs)
        known = self.words.__getitem__
        return [b"".join(map(known, words)) for words in docs]


def text_groups(texts: list[str | None], most: int = 2_000_000) -> Iterator[list[str]]:
    """Consecutive texts of about ``most`` characters together (one longer text is a group)."""
    group, n = [], 0
    for text in texts:
        if group and n + len(text or "") > most:
            yield group
            group, n = [], 0
        group.append(text or "")
        n += len(text or "")
    if group:
        yield group


def word_tokens(path: str, cached: int | None = None) -> WordTokens:
    """The one of this Python worker; it outlives a task, as workers do."""
    kept = sys.modules.setdefault("_llm_word_tokens", types.ModuleType("_llm_word_tokens"))
    if getattr(kept, "path", None) != path:
        kept.path, kept.tokens = path, WordTokens(path, cached)
    kept.tokens.cached = cached or CACHED_WORDS
    return kept.tokens


def token_pieces(df: DataFrame, tokenizer: str, max_len: int = 2048, end_id: int = 0,
                 id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False,
                 cached: int | None = None) -> DataFrame:
    """Pieces (doc_id, piece, start, length, ids_crc32[, ids]) of every text.

    A document is its ids, then ``end_id``; a null or empty text is ``end_id``
    alone. Only documents over ``max_len`` are cut, into pieces of that length
    and a last one that may be shorter. ``tokenizer``: path of the file, the same
    on all machines. ``cached``: words that a Python worker keeps with their ids, a
    matter of memory and time alone. Other columns of ``df`` are left out, whatever their names.
    """
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches):
        import pyarrow as pa
        tokens = word_tokens(tokenizer, cached)
        for b in in_pieces(batches, 1024):
            out = [[] for _ in range(5 + with_ids)]
            ids_of = (x for group in text_groups(b.column(1).to_pylist()) for x in tokens.ids(group))
            for doc, ids in zip(b.column(0).to_pylist(), ids_of):
                ids += end
                for piece, at in enumerate(range(0, len(ids), 4 * max_len)):
                    own = ids[at:at + 4 * max_len]
                    row = (doc, piece, at // 4, len(own) // 4, zlib.crc32(own))
                    for col, v in zip(out, row + ((own,) if with_ids else ())):
                        col.append(v)
            types_ = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(out, types_)], names[:len(out)])

    schema = _PIECE_SCHEMA + (", ids binary" if with_ids else "")
    return df.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`")).mapInArrow(cut, schema)


class OpenBins:
    """At most ``most`` open bins; a bitset tells which free spaces occur."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most = capacity, most
        self.bits, self.count, self.bins, self.opened = 0, 0, {}, 0

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset) for a piece."""
        fitting = self.bits >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1  # least space that is enough
            number = self._take(free)
        else:
            if self.count >= self.most:  # the fullest closes
                self._take((self.bits & -self.bits).bit_length() - 1)
            free, number = self.capacity, self.opened
            self.opened += 1
        rest = free - length
        if rest:
            self.bins.setdefault(rest, []).append(number)
            self.bits |= 1 << rest
            self.count += 1
        return number, self.capacity - free

    def _take(self, free: int) -> int:
        own = self.bins[free]
        number = own.pop()
        self.count -= 1
        if not own:
            del self.bins[free]
            self.bits &= ~(1 << free)
        return number


def pack(pieces: DataFrame, max_len: int = 2048, open_bins: int = OPEN_BINS,
         lane_pieces: int = LANE_PIECES) -> DataFrame:
    """``pieces`` (any table with a ``length`` from 1 to ``max_len``) with
    ``sequence_id`` and ``offset``; columns of these names are replaced.

    Lanes are dealt out evenly row by row, so equal or repeated rows spread too;
    a lane's open bins close with it. A null or impossible length fails the job:
    such a piece has no place. An empty table gives an empty result.
    """
    pieces = pieces.drop("sequence_id", "offset")
    lanes = max(1, round(pieces.count() / lane_pieces))
    order = [F.col("length").desc(), *[F.col(f"`{c}`") for c, t in pieces.dtypes
                                       if t in ("int", "bigint", "string")]]

    def placed(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        lane, bins = TaskContext.get().partitionId(), OpenBins(max_len, open_bins)
        for b in batches:
            length = b.column("length").to_pylist()
            if any(n is None or not 1 <= n <= max_len for n in length):
                raise ValueError(f"a piece's length must be from 1 to {max_len}")
            got = [bins.place(n) for n in length]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array([(lane << 40) + n for n, _ in got], pa.int64()),
                 pa.array([o for _, o in got], pa.int64())],
                [*b.schema.names, "sequence_id", "offset"])

    lane = pieces.repartition(lanes).sortWithinPartitions(*order)
    return lane.mapInArrow(placed, with_fields(pieces, sequence_id="long", offset="long"))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def op2_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    pieces = written(token_pieces(documents(spark, sf_dir), tokenizer_path()), "pieces")
    return pack(pieces)
