"""Matching with dictionaries of any number of terms (T7, J1 at scale).

The dictionary is a table, not a constant of the expression. A term is looked for where it
may be: a bit set of the hashes of all terms, and of beginnings of some lengths of the long
ones (matched as substrings), goes to every task, and a text gives the substrings that it
lets pass, each once; of short terms (matched as whole words) only those between edges of
words. Batches of texts give ``(substring, ids)``, and an equi-join with the terms tells
which of them are some. Nothing compares a text with all terms, each text is read once, and
none is shuffled: what moves is a substring once a batch, and the ids of its texts. With a
dictionary too large to broadcast they move in compressed pieces, one for each bucket of
hashes: terms and substrings of a bucket meet in a task that holds its terms, while the pieces
of substrings go by.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperlens.functions.text import WORD_CHAR
from paperlens.operators.dictionary import SHORT_TERM_MAX_LEN
from paperlens.session import release, stored

#: longs of the bit set at most (more keys only make it let more pass), rows broadcast at most
MOST_WORDS = 1 << 24
MOST_ROWS = 500_000
#: terms of a bucket, buckets at least, bytes of pieces that are looked up at once
BUCKET_TERMS, LEAST_BUCKETS, PIECE_BYTES = 1 << 17, 128, 1 << 21
#: bytes of text whose substrings are gathered at once, positions whose hashes are made at once
BLOCK, WINDOW = 1 << 22, 1 << 18
#: a beginning is hashed at every so manieth length of a term
STEP = 3
_BASE, _PROBES = 0x9E3779B97F4A7C15, 3
#: what a hash is of
BEGINNING, LONG, SHORT = range(3)
#: bits that the first four bytes of long terms have of their own
FOUR_BITS = 1 << 20
CODE_POINTS = 0x110000
#: terms (kind 0) or substrings (kind 1) of a bucket
PIECE = "bucket int, kind int, piece binary"


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out)  # modulo 2^64


class _Hashes:
    """Hashes of the substrings of some bytes: of each, from the sums of its bytes times powers of a number."""

    def __init__(self, data: np.ndarray):
        self.inverse = _powers(pow(_BASE, -1, 1 << 64), len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data + np.uint64(1)) * _powers(_BASE, len(data)), out=self.sums[1:])

    def of(self, start: np.ndarray, length, kind: int) -> np.ndarray:
        """Of the substrings at ``start``, as terms or as beginnings of terms."""
        h = (self.sums[start + length] - self.sums[start]) * self.inverse[start]
        h = (h + (np.asarray(length) * 4 + kind).astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(32))


def _bit(h: np.ndarray, probe: int, bits: int) -> np.ndarray:
    """Number of a hash's bit: the low half plus ``probe`` times the high one."""
    return (((h & np.uint64(0xFFFFFFFF)) + np.uint64(probe) * ((h >> np.uint64(32)) | np.uint64(1)))
            & np.uint64(bits - 1)).astype(np.int64)


def _bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of an Arrow array of strings, and where each begins (and the last ends)."""
    import pyarrow as pa
    _, offsets, data = column.cast(pa.large_string()).buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data or b"", np.uint8)[at[0]:at[-1]], at - at[0]


def _four(data: np.ndarray) -> np.ndarray:
    """Of each place, the number of the bit of its four bytes (zeros after the last)."""
    padded = np.zeros(len(data) + 3, np.uint8)
    padded[:len(data)] = data
    x = np.ndarray((len(data),), "<u4", padded, 0, (1,))
    return (x * np.uint32(0x9E3779B1)) >> np.uint32(12)


def _bitset(rows: DataFrame, words: int) -> np.ndarray:
    """Longs that hold the bits numbered in the column ``bit``; the driver gets a row for each at most."""
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit").bitwiseAND(F.lit(63)).cast("int"))
    got = (rows.select(F.shiftright("bit", 6).cast("int").alias("w"), mask.alias("m"))
           .groupBy("w").agg(F.bit_or("m").alias("m"))).toArrow()
    out = np.zeros(words, np.int64)
    out[got.column("w").to_numpy()] = got.column("m").to_numpy()
    return out


def word_characters(spark: SparkSession) -> np.ndarray:
    """A bit for each code point: whether Spark's patterns take it for a word character."""
    c = F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32")
    points = spark.range(CODE_POINTS).where(~F.col("id").between(0xD800, 0xDFFF))  # halves of pairs are no characters
    return _bitset(points.where(c.rlike(WORD_CHAR)).select(F.col("id").alias("bit")), CODE_POINTS // 64)


class SubstringFilter:
    """A bit set of the hashes of terms and of some beginnings of the long ones: what it says no
    to is no term. ``terms``: (lower, short), distinct; lengths are of UTF-8."""

    def __init__(self, terms: DataFrame):
        sizes = terms.groupBy("short", F.octet_length("lower").alias("size")).agg(F.count("*").alias("n")).collect()
        self.lengths = sorted(r["size"] for r in sizes if not r["short"])
        self.short_lengths = sorted(r["size"] for r in sizes if r["short"])
        self.longest = max((r["size"] for r in sizes), default=0)
        self.starts = starts = self.lengths[::STEP]
        self.n = n = sum(r["n"] for r in sizes)
        words = min(MOST_WORDS, 1 << max(4, (n // 2).bit_length()))
        self.size = bits = words * 64

        def keys(batches):
            import pyarrow as pa
            for b in batches:
                data, at = _bytes(b.column("lower"))
                short = b.column("short").to_numpy(zero_copy_only=False).astype(bool)
                hashes, size, at = _Hashes(data), np.diff(at), at[:-1]
                of = [hashes.of(at[short], size[short], SHORT), hashes.of(at[~short], size[~short], LONG)]
                of += [hashes.of(at[~short & (size >= k)], k, BEGINNING) for k in starts]
                h = np.unique(np.concatenate(of))
                bit = [_bit(h, p, bits) for p in range(_PROBES)] + [_four(data)[at[~short]] + np.int64(bits)]
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(bit)))], ["bit"])

        spark = terms.sparkSession
        rows = terms.select("lower", "short").mapInArrow(keys, "bit long")
        # at most a row for each of the set's longs
        self.bits = spark.sparkContext.broadcast(_bitset(rows, words + FOUR_BITS // 64).tobytes())
        self.word = spark.sparkContext.broadcast(word_characters(spark).tobytes() if self.short_lengths else b"")


def _edges(data: np.ndarray, at: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether an edge of a word is before each byte of texts, as a start and as an end of what is
    matched: one of the characters beside it is a word character, the other is none or not there."""
    inside = np.concatenate([word[:128], np.zeros(128, bool)])[data]
    for size, least, most in ((2, 0xC0, 0xE0), (3, 0xE0, 0xF0), (4, 0xF0, 0x100)):
        place = np.flatnonzero((data >= least) & (data < most))
        if len(place):
            point = data[place].astype(np.int64) & (0x7F >> size)
            for k in range(1, size):
                point = point << 6 | data[place + k] & 0x3F
            place = place[word[point]]
            for k in range(size):
                inside[place + k] = True
    begins, ends = np.zeros(len(data) + 1, bool), np.zeros(len(data) + 1, bool)
    begins[1:-1] = ends[1:-1] = inside[1:] != inside[:-1]
    first, last = at[:-1][np.diff(at) > 0], at[1:][np.diff(at) > 0]
    begins[first], ends[last] = inside[first], inside[last - 1]
    return begins, ends


class _Finder:
    """Looks for the keys of a filter in the bytes of texts."""

    def __init__(self, among: dict, bits: bytes, word: bytes):
        self.__dict__ |= among
        self.bits = np.frombuffer(bits, np.uint8)
        self.four = np.unpackbits(self.bits[self.size // 8:], bitorder="little").astype(bool)
        self.word = np.unpackbits(np.frombuffer(word, np.uint8), bitorder="little").astype(bool)

    def known(self, hashes: _Hashes, place: np.ndarray, length: int, kind: int) -> np.ndarray:
        """Numbers of the places whose substrings the bit set lets pass."""
        h, kept = hashes.of(place, length, kind), np.arange(len(place))
        for probe in range(_PROBES):
            bit = _bit(h, probe, self.size)
            on = self.bits[bit >> 3] >> (bit & 7).astype(np.uint8) & 1 == 1
            kept, h = kept[on], h[on]
        return kept

    def passing(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places, lengths and kinds (short or not) of substrings inside a text that may be terms."""
        edges = _edges(data, at, self.word) if self.short_lengths else None
        found = [(np.zeros(0, np.int64), 0, False)]
        for first in range(0, len(data), WINDOW):
            found += self._window(data, at, edges, first, min(first + WINDOW, len(data)))
        place = np.concatenate([p for p, _, _ in found])
        count = [len(p) for p, _, _ in found]
        return place, np.repeat([k for _, k, _ in found], count), np.repeat([s for _, _, s in found], count)

    def _window(self, data: np.ndarray, at: np.ndarray, edges: tuple | None, first: int, last: int) -> list[tuple]:
        part = data[first:last + self.longest]
        hashes, found = _Hashes(part), []

        def end(live):  # of the text
            return at[np.searchsorted(at, live + first, side="right")] - first

        if self.lengths:
            live = np.flatnonzero(self.four[_four(part)[:last - first]])
            live = live[part[live] & 0xC0 != 0x80]  # a character's first byte
            room = end(live) - live
            for k in self.lengths:
                fits = room >= k
                live, room = live[fits], room[fits]
                if k in self.starts:
                    kept = self.known(hashes, live, k, BEGINNING)
                    live, room = live[kept], room[kept]
                if not len(live):
                    break
                place = live[self.known(hashes, live, k, LONG)]
                after = part[np.minimum(place + k, len(part) - 1)]
                place = place[(place + k == len(part)) | (after & 0xC0 != 0x80)]
                found.append((place + first, k, False))
        if self.short_lengths:
            begins = np.flatnonzero(edges[0][first:last])
            ends = edges[1][first:first + len(part) + 1]
            for k in self.short_lengths:
                live = begins[:np.searchsorted(begins, len(part) - k, side="right")]
                live = live[ends[live + k]]
                place = live[self.known(hashes, live, k, SHORT)]
                found.append((place[end(place) - place >= k] + first, k, True))
        return found


def _blocks(finder: _Finder, b):
    """``(strings, short, counts, rows, ids)`` of each block of a batch of texts: the substrings that may be
    terms, how many of the block's texts hold each and which, and the ids of its texts."""
    import pyarrow as pa
    data, at = _bytes(b.column("lt"))
    # rows of a block: whole texts
    row = 0
    while row < b.num_rows:
        to = max(row + 1, int(np.searchsorted(at, at[row] + BLOCK, side="right")) - 1)
        inside = at[row:to + 1] - at[row]
        text = data[at[row]:at[to]]
        place, size, short = finder.passing(text, inside)
        if len(place):
            offsets = np.concatenate([[0], np.cumsum(size)])
            held = text[np.repeat(place - offsets[:-1], size) + np.arange(offsets[-1])]
            strings = pa.Array.from_buffers(pa.large_string(), len(place), [
                None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(held)]).dictionary_encode()
            of = np.searchsorted(inside, place, side="right") - 1
            code = strings.indices.to_numpy().astype(np.int64) * 2 + short
            code, of = np.divmod(np.unique(code * (to - row) + of), to - row)
            code, counts = np.unique(code, return_counts=True)
            yield (strings.dictionary.take(pa.array(code >> 1)).cast(pa.string()), code & 1 == 1, counts, of,
                   b.column("id").slice(row, to - row))
        row = to


def _substrings(texts: DataFrame, among: SubstringFilter, buckets: int = 0) -> DataFrame:
    """``(lower, short, ids)``: substrings of texts that may be terms, with the ids of texts that hold
    them, each row's once. ``texts``: (id, lt); a substring has a row for each block of texts. With
    ``buckets``, the same in pieces ``(bucket, kind 1, piece)``."""
    bitset, word = among.bits, among.word
    own = {k: getattr(among, k) for k in ("lengths", "short_lengths", "longest", "starts", "size")}

    def found(batches):
        import pyarrow as pa
        finder = _Finder(own, bitset.value, word.value)
        for b in batches:
            for strings, short, counts, of, ids in _blocks(finder, b):
                if buckets:
                    yield from _packed(strings, short, counts, of, ids, buckets)
                else:
                    yield pa.RecordBatch.from_arrays([strings, pa.array(short), pa.ListArray.from_arrays(
                        np.concatenate([[0], np.cumsum(counts)]).astype(np.int32), ids.take(pa.array(of)))],
                        ["lower", "short", "ids"])

    return texts.mapInArrow(found, PIECE if buckets else
                            f"lower string, short boolean, ids array<{texts.schema['id'].dataType.simpleString()}>")


def _by_bucket(columns: dict, short: np.ndarray, buckets: int) -> list[tuple]:
    """``(bucket, table, start, end)``: where in a table of ``columns`` and ``short`` the rows of a bucket of
    ``lower`` are, in its order there."""
    import pyarrow as pa
    import pyarrow.compute as pc
    data, at = _bytes(columns["lower"])
    bucket = _Hashes(data).of(at[:-1], np.diff(at), np.where(short, SHORT, LONG)) % np.uint64(buckets)
    order = pc.sort_indices(pa.table({"bucket": bucket, "lower": columns["lower"]}),
                            [("bucket", "ascending"), ("lower", "ascending")])
    t = pa.table(columns | {"short": pa.array(short)}).take(order)
    which, first = np.unique(bucket[order.to_numpy()], return_index=True)
    return [(int(k), t, int(start), int(end)) for k, start, end in zip(which, first, [*first[1:], len(short)])]


def _piece(bucket: int, kind: int, *tables):
    """A row of pieces: compressed Arrow streams, one after the other."""
    import pyarrow as pa
    sink = pa.BufferOutputStream()
    for t in tables:
        with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(t)
    return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([kind], pa.int32()),
                                       pa.array([sink.getvalue().to_pybytes()])], ["bucket", "kind", "piece"])


def gaps_of(rows: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of runs of rising numbers, ``counts`` long, and where each run's begin: a number is the sum of the
    run's bytes so far, at each byte that is not 255."""
    gap = np.diff(rows, prepend=0)
    starts = (np.cumsum(counts) - counts)[counts > 0]
    gap[starts] = rows[starts]
    ends = np.cumsum(gap // 255 + 1)
    out = np.full(ends[-1] if len(ends) else 0, 255, np.uint8)
    out[ends - 1] = gap % 255
    return out, np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]


def rows_of(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of ``gaps_of`` what it was given: the numbers, and how many a run has."""
    sums = np.cumsum(data, dtype=np.int64)
    ends = data != 255
    before = np.concatenate([[0], sums])[at[:-1]]
    counts = np.diff(np.concatenate([[0], np.cumsum(ends)])[at])
    return sums[ends] - np.repeat(before, counts), counts


def _packed(strings, short: np.ndarray, counts: np.ndarray, rows: np.ndarray, ids, buckets: int):
    """Pieces of a block: substrings with the places of their texts in the block, as gaps, and the texts' ids."""
    import pyarrow as pa
    whole = pa.types.is_int64(ids.type) and not ids.null_count
    # as steps, which compress well where ids rise; sums wrap around as differences do
    named = pa.table({"steps": np.diff(ids.to_numpy(), prepend=0)} if whole else {"ids": ids})
    data, at = gaps_of(rows, counts)
    gaps = pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data)])
    for bucket, t, start, end in _by_bucket({"lower": strings, "gaps": gaps}, short, buckets):
        yield _piece(bucket, 1, t.slice(start, end - start), named)


def _meet(texts: DataFrame, among: SubstringFilter, terms: DataFrame, buckets: int) -> DataFrame:
    """``(ids, category, cat_ord, ord, term)``: the equi-join of the substrings of texts with terms, both in pieces."""
    names = ["category", "cat_ord", "ord", "term"]

    def packed(batches):
        import pyarrow as pa
        for b in batches:
            t = pa.Table.from_batches([b]).combine_chunks()
            short = t.column("short").to_numpy()
            columns = {c: t.column(c).combine_chunks() for c in ("lower", *names)}
            for bucket, rows, start, end in _by_bucket(columns, short, buckets):
                yield _piece(bucket, 0, rows.slice(start, end - start))

    def matched(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        here, kept, known = None, [], None

        def prepared():
            """A bucket's terms in the order of their numbers, and the different ``lower`` of them."""
            t = pa.concat_tables([pa.ipc.open_stream(x).read_all() for x in kept])
            values = pc.unique(t.column("lower"))
            code = pc.index_in(t.column("lower"), values).to_numpy().astype(np.int64) * 2 + t.column("short").to_numpy()
            order = np.argsort(code, kind="stable")
            return t.select(names).take(pa.array(order)).combine_chunks(), values, code[order]

        def looked_up(pieces):
            t, values, codes = known
            parts, ids, base = [], [], [0]
            for piece in pieces:
                stream = pa.BufferReader(piece)
                parts.append(pa.ipc.open_stream(stream).read_all())
                of = pa.ipc.open_stream(stream).read_all()
                ids.append(of.column(0).combine_chunks() if of.column_names == ["ids"]
                           else pa.array(np.cumsum(of.column(0).to_numpy())))
                base.append(base[-1] + len(ids[-1]))
            f, ids = pa.concat_tables(parts).combine_chunks(), pa.concat_arrays(ids)
            base = np.repeat(np.array(base[:-1]), [p.num_rows for p in parts])
            of = pc.fill_null(pc.index_in(f.column("lower"), values), -1).to_numpy().astype(np.int64)
            code = np.where(of < 0, -1, of * 2 + f.column("short").to_numpy())
            low = np.searchsorted(codes, code, side="left")
            n = np.searchsorted(codes, code, side="right") - low
            row = np.repeat(np.arange(len(code)), n)
            if not len(row):
                return
            term = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
            gaps = f.column("gaps").take(pa.array(row)).combine_chunks()
            _, offsets, data = gaps.buffers()
            place, counts = rows_of(np.frombuffer(data, np.uint8), np.frombuffer(offsets, np.int64)[:len(row) + 1])
            held = ids.take(pa.array(place + np.repeat(base[row], counts)))
            lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32), held)
            out = t.take(pa.array(term))
            yield from pa.table([lists, *out.columns], ["ids", *names]).combine_chunks().to_batches()

        for b in batches:
            some, size = [], 0
            for bucket, kind, piece in zip(*(b.column(c).to_pylist() for c in range(3))):
                if some and (bucket != here or size >= PIECE_BYTES):
                    yield from looked_up(some)
                    some, size = [], 0
                if bucket != here:
                    here, kept, known = bucket, [], None
                if kind == 0:
                    kept.append(piece)
                elif kept:
                    known = known or prepared()
                    some.append(piece)
                    size += len(piece)
            if some:
                yield from looked_up(some)

    both = terms.select("lower", "short", *names).mapInArrow(packed, PIECE).union(_substrings(texts, among, buckets))
    types = {f.name: f.dataType.simpleString() for f in (*texts.schema, *terms.schema)}
    # a bucket's terms are ahead of its substrings
    return both.repartition("bucket").sortWithinPartitions("bucket", "kind").mapInArrow(
        matched, f"ids array<{types['id']}>, " + ", ".join(f"`{c}` {types[c]}" for c in names))


def index_matches(df: DataFrame, terms: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, category, cat_ord, ord, term)``: one row for each term a row's text matches,
    by the rules of ``matching``. ``terms``: (category, cat_ord, ord, term), any number.

    Null texts match nothing; equal terms in several categories match in each.
    """
    lower, word = F.lower("term"), f"^{WORD_CHAR}+$"
    t = terms.select("category", "cat_ord", "ord", "term", lower.alias("lower"),
                     (F.char_length("term") <= SHORT_TERM_MAX_LEN).alias("short")).where(F.char_length("term") > 0)
    # a word that lower-casing makes more than a word is none of a text's words
    t = stored(t.where(~F.col("short") | ~F.col("term").rlike(word) | F.col("lower").rlike(word)), "terms")
    texts = df.select(F.col(f"`{id_col}`").alias("id"), F.lower(F.col(f"`{text_col}`")).alias("lt")).where(
        F.col("lt").isNotNull())
    among = SubstringFilter(t.select("lower", "short").distinct())
    release(df.sparkSession)  # the shuffle files of the terms' jobs
    if t.limit(MOST_ROWS + 1).count() <= MOST_ROWS:
        met = _substrings(texts, among).join(F.broadcast(t), ["lower", "short"])
    else:
        met = _meet(texts, among, t, max(LEAST_BUCKETS, -(-among.n // BUCKET_TERMS)))
    return met.select(F.explode("ids").alias(id_col), "category", "cat_ord", "ord", "term")
