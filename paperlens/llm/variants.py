"""Spelling variants: words one edit apart, by a dynamic programme over sorted word lists.

Two words one edit apart, the longer of M letters, share M - 1 letters at the two ends,
so a prefix or a suffix of half of that: words are grouped by either, and no pair is
missed or met in another group. A group too large for a task is split again by the same
argument, the free middle shared by halves, until at most one letter is free; groups
shrink to an alphabet then.

Inside a task the lists of its groups lie sorted, with the length of the prefix that each
word shares with the one before (LCP). The rows of the edit matrix, cut to the three
diagonals that one edit can reach, are worked out once for all words of a range that share
a prefix: going one letter deeper splits a range where the LCP is no longer than the
prefix, and the row above is used again for each part. A range goes as soon as its row
holds nothing below two edits. All queries and ranges of one depth advance together.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperlens.llm.common import bound_batches, documents, in_pieces, written

RUN = r"[A-Za-zÀ-ÿ]+"
LEAST_LETTERS, LEAST_COUNT, DELETE_EVERY, TIMES = 5, 3, 97, 2
#: words of a group above which it is split; words a task looks at together; (query, range)
#: pairs that advance together; different words a task counts before it passes them on
MOST, TOGETHER, FRONT, COUNTED = 4096, 1 << 15, 1 << 18, 1 << 17
_FAR = 2  # edits from which on a cell says nothing more


def word_counts(df: DataFrame, id_col: str, text_col: str, every: int, letters: int) -> DataFrame:
    """(word, n): occurrences of the runs of at least ``letters`` letters, after the deletions."""
    def run(batches):
        import pyarrow as pa
        find, lower = re.compile(RUN).findall, str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
        sums: Counter = Counter()

        def flush():
            out = pa.RecordBatch.from_arrays(
                [pa.array(list(sums), pa.string()), pa.array(list(sums.values()), pa.int64())], ["word", "n"])
            sums.clear()
            return out

        for b in in_pieces(batches):
            for key, text in zip(b.column(0), b.column(1)):
                if not (text := text.as_py()):
                    continue
                start = f"{'' if (key := key.as_py()) is None else key}:".encode()
                crc = zlib.crc32(start)
                for word, n in Counter(find(text.translate(lower))).items():
                    h = zlib.crc32(word.encode(), crc)
                    if h % every == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1:]
                    if len(word) >= letters:
                        sums[word] += n
                if len(sums) > COUNTED:
                    yield flush()
        yield flush()

    d = df.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))
    return d.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _keyed(rows: DataFrame) -> DataFrame:
    """``rows`` of (word, n, m, k, s, top) with ``key``: the group of words that share the
    first k and the last s of m letters. ``top``: pairs that share so many first letters are
    met in another group."""
    w = F.col("word")
    # substring counts from 1; a start before the word would shorten the end, k and s never do
    ends = F.struct("m", "k", "s", "top", F.substring(w, F.lit(1), F.col("k")).alias("head"),
                    F.substring(w, F.char_length(w) - F.col("s") + 1, F.col("s")).alias("tail"))
    return rows.withColumn("key", F.xxhash64(ends))


def _halves(rows: DataFrame) -> DataFrame:
    """Each group's words in its two halves: half of what is still to be shared is added to
    the shared prefix or to the shared suffix."""
    more = F.ceil((F.col("m") - F.col("k") - F.col("s") - 1) / 2).cast("int")
    left = F.struct((F.col("k") + more).alias("k"), F.col("s"), F.col("top"))
    right = F.struct(F.col("k"), (F.col("s") + more).alias("s"), F.least("top", F.col("k") + more).alias("top"))
    d = rows.select("word", "n", "m", F.explode(F.array(left, right)).alias("g"))
    return _keyed(d.select("word", "n", "m", "g.k", "g.s", "g.top"))


def groups(words: DataFrame, most: int = MOST) -> DataFrame:
    """(key, word, n, m, k, s, top): every word in the groups where it can meet another word
    one edit away; groups of more than ``most`` words have one free letter at most."""
    size = F.char_length("word").cast("int")
    lengths = F.explode(F.array(size, size + 1)).alias("m")  # as the longer word, and as the shorter
    rows = words.select("word", "n", lengths).select(
        "word", "n", "m", F.lit(0).alias("k"), F.lit(0).alias("s"), F.col("m").alias("top"))
    rows, done = written(_halves(rows), "variants"), None
    while True:
        each = rows.groupBy("key").agg(F.count("*").alias("size"), F.max(F.expr("m - k - s - 1")).alias("free"))
        kept = rows.join(each.where(f"size > 1 AND (size <= {most} OR free < 1)").select("key"), "key", "left_semi")
        done = kept if done is None else done.unionByName(kept)
        large = each.where(f"size > {most} AND free >= 1").select("key")
        if large.isEmpty():
            return done
        rows = written(_halves(rows.join(large, "key", "left_semi")), "variants")


def letters_of(words: list[bytes], reverse: bool) -> np.ndarray:
    """A row a word, a byte a letter, at least one 0 behind it; reversed words if asked for."""
    width = max(map(len, words)) + 3
    flat = b"".join((w[::-1] if reverse else w).ljust(width, b"\0") for w in words)
    return np.frombuffer(flat, np.uint8).reshape(len(words), width)


def one_edit_pairs(a: np.ndarray, size: np.ndarray, group: np.ndarray, shared: np.ndarray,
                   front: int = FRONT) -> tuple[np.ndarray, np.ndarray]:
    """(query, word): places of the words of each group that are one edit apart, both ways.

    ``a``: letters, sorted within each group, all words of one group side by side and
    different; ``shared``: letters that a group's words share at the start.
    """
    total = len(a)
    same = np.zeros(total, np.int64)  # letters shared with the word before; -1: another group
    if total > 1:
        differ = a[1:] != a[:-1]
        same[1:] = np.where(group[1:] == group[:-1], differ.argmax(axis=1), -1)
    same[0] = -1
    begin = np.flatnonzero(same < 0)
    end = np.append(begin[1:], total)
    queries, found = [], []
    # one row of three cells for the shared prefix: no edit on the diagonal, one beside it
    todo = []
    for k in np.unique(shared[begin]):
        at = begin[shared[begin] == k], end[shared[begin] == k]
        n = at[1] - at[0]
        todo.append((int(k), np.repeat(at[0], n), np.repeat(at[1], n),
                     np.concatenate([np.arange(x, y) for x, y in zip(*at)])))
    starts: dict[int, np.ndarray] = {}
    while todo:
        depth, lo, hi, q = todo.pop()
        cells = np.tile(np.array([1, 0, 1], np.int8), (len(q), 1))
        stack = [(depth, lo, hi, q, cells)]
        while stack:
            depth, lo, hi, q, cells = stack.pop()
            if len(q) > front:
                cut = [slice(i, i + front) for i in range(0, len(q), front)]
                stack += [(depth, lo[c], hi[c], q[c], cells[c]) for c in cut]
                continue
            # ends of words: the first of a range may be no longer than the prefix
            over = size[lo] == depth
            off = size[q[over]] - depth + 1
            hit = (off >= 0) & (off <= 2)
            hit[hit] = cells[over][hit, off[hit]] == 1
            queries.append(q[over][hit])
            found.append(lo[over][hit])
            lo = lo + over
            go = lo < hi
            lo, hi, q, cells = lo[go], hi[go], q[go], cells[go]
            if not len(q):
                continue
            # parts of each range by the next letter
            if depth not in starts:
                starts[depth] = np.flatnonzero(same <= depth)
            at = starts[depth]
            first, last = np.searchsorted(at, lo, "right"), np.searchsorted(at, hi, "left")
            parts = last - first + 1
            row = np.repeat(np.arange(len(q)), parts)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
            new_lo = np.where(nth == 0, lo[row], at[np.minimum(first[row] + nth - 1, len(at) - 1)])
            new_hi = np.where(nth == parts[row] - 1, hi[row], at[np.minimum(first[row] + nth, len(at) - 1)])
            q, old = q[row], cells[row]
            letter = a[new_lo, depth]
            # cell i of depth + 1 is the query's prefix of depth + i letters
            new = np.empty_like(old)
            left = np.full(len(q), _FAR, np.int8)
            for i in range(3):
                j = depth + i - 1  # the query's letter that is compared
                inside = (size[q] > j) if j >= 0 else np.zeros(len(q), bool)
                swap = old[:, i] + np.where(inside, a[q, min(max(j, 0), a.shape[1] - 1)] != letter, True)
                drop = old[:, i + 1] + 1 if i < 2 else np.full(len(q), _FAR, np.int8)
                cell = np.minimum(np.minimum(swap, drop), left + 1)
                cell = np.where((size[q] >= j + 1) & (j + 1 >= 0), np.minimum(cell, _FAR), _FAR)
                new[:, i] = left = cell.astype(np.int8)
            near = new.min(axis=1) < _FAR
            if near.any():
                stack.append((depth + 1, new_lo[near], new_hi[near], q[near], new[near]))
    none = np.zeros(0, np.int64)
    return np.concatenate(queries or [none]), np.concatenate(found or [none])


def _first_shared(a: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Letters that the words u and v share at the start."""
    return (a[u] != a[v]).argmax(axis=1)


def near_words(grouped: DataFrame) -> DataFrame:
    """(word, n, near, near_n): pairs of words one edit apart, both ways, each once."""
    def pairs(words, n, m, key, k, s, top):
        """Of whole groups whose words have m letters, or one less."""
        for reverse in (False, True):
            own = np.flatnonzero((s > k) == reverse)
            if not len(own):
                continue
            text = [words[i] for i in own]
            a = letters_of(text, reverse)
            order = np.lexsort([a.view(f"S{a.shape[1]}").ravel(), key[own]])
            a, own = a[order], own[order]
            size = np.fromiter((len(words[i]) for i in own), np.int64, len(own))
            u, v = one_edit_pairs(a, size, key[own], np.where(reverse, s, k)[own])
            # words that are both shorter are met as the longer ones of another group
            good = np.maximum(size[u], size[v]) == m
            u, v = u[good], v[good]
            front = a if not reverse else letters_of([words[i] for i in own], False)
            good = _first_shared(front, u, v) < top[own][u]
            yield own[u[good]], own[v[good]]

    def run(batches):
        import pyarrow as pa
        held, count = [], 0

        def results(table):
            m_all, key_all = table.column("m").to_numpy(), table.column("key").to_numpy()
            words = [w.encode("latin-1") for w in table.column("word").to_pylist()]
            n = table.column("n").to_numpy()
            k, s, top = (table.column(c).to_numpy() for c in ("k", "s", "top"))
            cut = np.flatnonzero(np.diff(m_all)) + 1
            for part in np.split(np.arange(len(words)), cut):
                text = [words[i] for i in part]
                for u, v in pairs(text, n[part], m_all[part[0]], key_all[part], k[part], s[part], top[part]):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([text[i].decode("latin-1") for i in u], pa.string()), pa.array(n[part][u]),
                         pa.array([text[i].decode("latin-1") for i in v], pa.string()), pa.array(n[part][v])],
                        ["word", "n", "near", "near_n"])

        for b in batches:
            held.append(b)
            count += b.num_rows
            letters = sum(x.column("word").nbytes for x in held)
            if count < TOGETHER and letters < 1 << 22:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            key = table.column("key").to_numpy()
            begin = np.flatnonzero(np.append(True, key[1:] != key[:-1]))[-1]  # the last group may go on
            if begin:
                yield from results(table.slice(0, begin))
            held, count = table.slice(begin).to_batches(), table.num_rows - begin
        if count:
            yield from results(pa.Table.from_batches(held).combine_chunks())

    # whole groups in a task, side by side, those of one length together
    d = grouped.repartition("key").sortWithinPartitions("m", "key")
    return d.mapInArrow(run, "word string, n long, near string, near_n long")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): forms followed to the last. Paths double each round,
    and a path's counts grow, so it has no loop; rounds grow with the logarithm of its length."""
    now = written(forms.select("word", F.col("form").alias("root")), "variant-roots")
    while True:
        up = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = now.join(up, "root", "left")
        new = written(step.select("word", F.coalesce("next", "root").alias("root"),
                                  F.col("next").isNotNull().alias("moved")), "variant-roots")
        if new.where("moved").isEmpty():
            return new.select("word", "root")
        now = new.select("word", "root")


def spelling_variants(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", letters: int = LEAST_LETTERS,
                      count: int = LEAST_COUNT, every: int = DELETE_EVERY, times: int = TIMES,
                      most: int = MOST) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the words of the texts.

    Words are maximal runs of Latin letters, A-Z lower-cased, one letter deleted where the
    checksum of ``<id>:<run>`` is a multiple of ``every``; those of at least ``letters``
    letters that occur ``count`` times at least. ``form``: the most frequent of the words
    one edit away (of several, the first in code-point order) if it occurs ``times`` as
    often; ``root``: forms followed to the last, the word itself if it has none.

    Null and empty texts have no words; a null id counts as an empty one in the checksum.
    Repeated rows count each. Texts and words of any length are whole, as words the letters
    up to U+00FF. Other columns are left out, whatever their names. No words give an empty
    result.
    """
    bound_batches(df.sparkSession)
    if letters < 2 or times <= 1:
        raise ValueError("words of two letters at least, and forms more frequent than their words")
    words = written(word_counts(df, id_col, text_col, every, letters).where(F.col("n") >= count), "words")
    near = near_words(groups(words, most))
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near")))  # partial in the tasks
    each = near.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    named = words.join(each, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "best",
        F.coalesce(-F.col("best.less") >= F.col("n") * times, F.lit(False)).alias("has"))
    named = written(named.select("word", "n", "n_near", F.when(F.col("has"), F.col("best.near")).alias("form"),
                                 F.when(F.col("has"), -F.col("best.less")).alias("form_n")), "variant-forms")
    last = roots(named.where("form IS NOT NULL"))
    return named.join(last, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark, sf_dir: str) -> DataFrame:
    """Variants among the words of all documents."""
    return spelling_variants(documents(spark, sf_dir))
