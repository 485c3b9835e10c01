"""MinHash near-duplicates with sequential Bayesian verification.

A document is the set of its word shingles; equal sets are one set from the start, however
many documents have them. A set's signature holds the least value of each of several
hundred hash functions: some in bands, whose equality makes candidates, the others for
comparing these. The number of bands follows from the chosen probability of missing a link.

Two signatures are compared a batch at a time. After each batch, with m of n values equal,
the posterior of the similarity (from a flat prior) tells how probable it still is that the
pair is a link; if that is less than the chosen miss probability, the pair goes. Survivors
are verified on their full sets.

No bucket lists its pairs. First every member is compared with one of its bucket, the set
that has most company in all its buckets, the centre of a group of copies. Links so found
make components, and only buckets that still hold several are looked at again: there the
members of different components are compared in blocks and verified in place, so that only
links leave a block, and of these no more than it takes to connect what they connect.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperlens.llm.common import documents, in_pieces, mix64, small, written
from paperlens.llm.components import components

SHINGLE, SIMILARITY, MISS = 5, 80, 1e-7
BAND_ROWS, BATCH, BATCHES = 4, 32, 6
#: members, and shingles of members, of one block of a bucket; shingles hashed at once
BLOCK, BLOCK_SHINGLES, CHUNK = 1024, 1 << 19, 1024


def bands_for(similarity: int, miss: float = MISS, rows: int = BAND_ROWS) -> int:
    """Bands of ``rows`` values such that a pair of the similarity shares one but for ``miss``."""
    s = similarity / 100
    return 1 if s >= 1 else math.ceil(math.log(miss) / math.log(1 - s ** rows))


def least_matches(similarity: int, miss: float = MISS, batch: int = BATCH, batches: int = BATCHES) -> list[int]:
    """For each number of batches compared: the least number m of equal values among n at
    which the similarity is ``similarity`` or more with a posterior probability of ``miss``.

    From a flat prior, the posterior after m of n is Beta(m + 1, n - m + 1); that it exceeds s
    is as probable as at most m successes in n + 1 trials of chance s."""
    s, out = similarity / 100, []
    for n in range(batch, batch * batches + 1, batch):
        below, m = 0.0, -1
        while below < miss:
            m += 1
            below += math.comb(n + 1, m) * s ** m * (1 - s) ** (n + 1 - m)
        out.append(m)
    return out


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles (A-Z lower-cased)."""
    import xxhash
    words = (text or "").encode().lower().split()  # bytes.lower() changes A-Z alone
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < size:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(size))))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, grams), np.uint64))


def hash_functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and addends of n permutations x -> a x + b of the 64-bit integers."""
    a = mix64(np.arange(1, n + 1, dtype=np.uint64)) | np.uint64(1)
    return a, mix64(np.arange(n + 1, 2 * n + 1, dtype=np.uint64))


def signature(hashes: np.ndarray, functions: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Least value of each function, of which the upper 32 bits: unequal ones are told apart
    but for a chance that only adds candidates."""
    a, b = functions
    least = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), CHUNK):
        least = np.minimum(least, (hashes[at:at + CHUNK, None] * a + b).min(axis=0))
    return (least >> np.uint64(32)).astype(np.uint32)


def _set_key(hashes: np.ndarray) -> bytes:
    import xxhash
    return xxhash.xxh3_128_digest(hashes.tobytes())


def signatures(df: DataFrame, id_col: str, text_col: str, size: int, bands: int) -> DataFrame:
    """(id, text_hash, key, n, bands, sig) of every row: 128 bits that name the set (null if
    it is empty), its size, a hash for each band, the values for comparing."""
    count = bands * BAND_ROWS + BATCH * BATCHES

    def run(batches):
        import pyarrow as pa
        functions = hash_functions(count)
        for b in in_pieces(batches):
            key, n, hashed, sig = [], [], [], []
            for text in b.column(2):
                h = shingles(text.as_py(), size)
                n.append(len(h))
                if not len(h):
                    key.append(None), hashed.append(None), sig.append(None)
                    continue
                key.append(_set_key(h))
                values = signature(h, functions)
                band = values[:bands * BAND_ROWS].astype(np.uint64).reshape(bands, BAND_ROWS)
                name = np.arange(bands, dtype=np.uint64)
                for i in range(BAND_ROWS):
                    name = mix64(name ^ band[:, i]) + np.uint64(i)
                hashed.append(mix64(name).view(np.int64))
                # a byte a value: unequal values may seem equal, which only adds candidates
                sig.append(values[bands * BAND_ROWS:].astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(key, pa.binary()), pa.array(n, pa.int64()),
                 pa.array(hashed, pa.list_(pa.int64())), pa.array(sig, pa.binary())],
                ["id", "text_hash", "key", "n", "bands", "sig"])

    d = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(f"`{text_col}`").alias("text_hash"),
                  F.col(f"`{text_col}`").alias("text"))
    return d.mapInArrow(run, "id long, text_hash long, key binary, n long, bands array<long>, sig binary")


def survivors(u: np.ndarray, v: np.ndarray, nu: np.ndarray, nv: np.ndarray, similarity: int,
              least: list[int]) -> np.ndarray:
    """Rows of the signatures ``u`` and ``v`` (a pair a row; ``nu`` and ``nv``: sizes of the
    sets) that may still be links after all batches, or whose sizes allow one."""
    alive = np.flatnonzero(100 * np.minimum(nu, nv) >= similarity * np.maximum(nu, nv))
    equal = np.zeros(len(alive), np.int64)
    for i, least_now in enumerate(least):
        at = slice(i * BATCH, (i + 1) * BATCH)
        equal += (u[alive, at] == v[alive, at]).sum(axis=1)
        alive, equal = alive[equal >= least_now], equal[equal >= least_now]
    return alive


def _unpacked(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def compared(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """The (a, b) of ``pairs`` that the comparison of signatures doesn't rule out."""
    least = least_matches(similarity)

    def run(batches):
        import pyarrow as pa
        for b in in_pieces(batches, 4096):
            if not b.num_rows:
                continue
            keep = survivors(_unpacked(b.column("sa")), _unpacked(b.column("sb")),
                             b.column("na").to_numpy(), b.column("nb").to_numpy(), similarity, least)
            yield pa.RecordBatch.from_arrays(
                [b.column("a").take(pa.array(keep)), b.column("b").take(pa.array(keep))], ["a", "b"])

    one = sets.select(F.col("key").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa"))
    two = sets.select(F.col("key").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "na", "nb", "sa", "sb").mapInArrow(
        run, "a binary, b binary")


def full_sets(keys: DataFrame, df: DataFrame, sets: DataFrame, text_col: str, size: int) -> DataFrame:
    """(key, hashes), written, of the sets in ``keys``: only their texts are read again, one a set."""
    def full(batches):
        import pyarrow as pa
        for b in in_pieces(batches):
            h = [shingles(t.as_py(), size) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([_set_key(x) for x in h], pa.binary()), pa.array([x.tobytes() for x in h], pa.binary())],
                ["key", "hashes"])

    needed = small(written(sets.join(keys.distinct(), "key", "left_semi").select("text_hash"), "minhash-texts"))
    texts = df.select(F.col(f"`{text_col}`").alias("text"), F.xxhash64(f"`{text_col}`").alias("text_hash"))
    # copies meet in a partial aggregate before anything is shuffled or read into sets
    once = texts.join(needed, "text_hash", "left_semi").select("text").distinct()
    rows = once.mapInArrow(full, "key binary, hashes binary")
    return written(rows.groupBy("key").agg(F.first("hashes").alias("hashes")), "minhash-sets")


def verified(pairs: DataFrame, df: DataFrame, sets: DataFrame, text_col: str, size: int,
             similarity: int) -> DataFrame:
    """The (a, b) of ``pairs``, a written table, that are links by their full sets."""
    def check(batches):
        import pyarrow as pa
        for b in in_pieces(batches):
            keep = []
            for i, (x, y) in enumerate(zip(b.column(2), b.column(3))):
                x, y = (np.frombuffer(z.as_py(), np.uint64) for z in (x, y))
                common = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * common >= similarity * (len(x) + len(y) - common):
                    keep.append(i)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at)], ["a", "b"])

    named = pairs.select(F.col("a").alias("key")).union(pairs.select("b"))
    hashes = full_sets(named, df, sets, text_col, size)
    wide = (pairs.join(hashes.withColumnsRenamed({"key": "a", "hashes": "ha"}), "a")
            .join(hashes.withColumnsRenamed({"key": "b", "hashes": "hb"}), "b"))
    return wide.select("a", "b", "ha", "hb").mapInArrow(check, "a binary, b binary")


def shared_buckets(sets: DataFrame) -> DataFrame:
    """(bucket, key, company): sets in buckets of two or more; ``company``: members of all
    the buckets of the set together."""
    rows = sets.select("key", F.explode("bands").alias("bucket"))
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    members = written(rows.join(sizes, "bucket"), "minhash-buckets")
    company = members.groupBy("key").agg(F.sum("size").alias("company"))
    return members.join(company, "key").select("bucket", "key", "company")


def star_pairs(buckets: DataFrame) -> DataFrame:
    """(a, b): each member of a bucket with the one that has most company."""
    centre = buckets.groupBy("bucket").agg(F.max(F.struct("company", "key")).getField("key").alias("b"))
    return (buckets.join(centre, "bucket").where("key != b")
            .select(F.least("key", "b").alias("a"), F.greatest("key", "b").alias("b")).distinct())


def block_links(sig: np.ndarray, sets: list[np.ndarray], root: np.ndarray, left: np.ndarray,
                right: np.ndarray, similarity: int, least: list[int]) -> list[tuple[int, int]]:
    """Links between members of ``left`` and ``right`` that are of different components
    (``root``, which the links found then join): compared by signatures, survivors verified."""
    n = np.fromiter(map(len, sets), np.int64, len(sets))
    # places of the members' shingles among all of the block's
    _, place = np.unique(np.concatenate(sets), return_inverse=True)
    end = np.cumsum(n)
    mark = np.zeros(place.max(initial=-1) + 1, np.int64)
    links = []
    for x in left:
        y = right[root[right] != root[x]]
        if not len(y):
            continue
        y = y[survivors(np.broadcast_to(sig[x], (len(y), sig.shape[1])), sig[y],
                        np.full(len(y), n[x]), n[y], similarity, least)]
        if not len(y):
            continue
        own = place[end[x] - n[x]:end[x]]
        mark[own] = 1
        at = np.concatenate([place[end[i] - n[i]:end[i]] for i in y])
        common = np.add.reduceat(mark[at], np.cumsum(n[y]) - n[y])
        mark[own] = 0
        for i in y[100 * common >= similarity * (n[x] + n[y] - common)]:
            if root[i] != root[x]:
                links.append((int(x), int(i)))
                root[root == root[i]] = root[x]
    return links


def open_links(buckets: DataFrame, found: DataFrame, df: DataFrame, sets: DataFrame, text_col: str, size: int,
               similarity: int, block: int, most_shingles: int) -> DataFrame:
    """(a, b): links in a bucket between members that are of different components so far, as
    many as it takes to connect these. ``found``: (key, root). Buckets of the same members
    are one; a bucket is cut into blocks, and each two of them meet in one group."""
    least = least_matches(similarity)
    d = buckets.select("bucket", "key").join(found, "key")
    each = d.join(sets.select("key", "n"), "key").groupBy("bucket").agg(
        F.count("*").alias("size"), F.sum("n").alias("shingles"), F.min("root").alias("lo"), F.max("root").alias("hi"),
        F.bit_xor(F.xxhash64("key")).alias("x"), F.sum(F.xxhash64("key").cast("decimal(20,0)")).alias("y"))
    parts = F.ceil(F.greatest(F.col("size") / block, F.col("shingles") / most_shingles)).cast("int").alias("parts")
    once = each.where("lo != hi").groupBy("size", "x", "y", parts).agg(F.min("bucket").alias("bucket"))
    rows = written(d.join(once.select("bucket", "parts"), "bucket"), "minhash-open")
    own = F.pmod(F.xxhash64(F.lit(7), "key"), F.col("parts")).cast("int")
    # a block meets itself and every other
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    met = rows.withColumn("own", own).withColumn("other", other).select(
        "bucket", "key", "root", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def run(table):
        import pyarrow as pa
        hashes = [np.frombuffer(h.as_py(), np.uint64) for h in table.column("hashes")]
        own_, i, j = (table.column(c)[0].as_py() if c != "own" else table.column(c).to_numpy()
                      for c in ("own", "i", "j"))
        root = table.column("root").to_pylist()
        number = {r: at for at, r in enumerate(sorted(set(root)))}
        links = block_links(_unpacked(table.column("sig")), hashes, np.array([number[r] for r in root]),
                            np.flatnonzero(own_ == i), np.flatnonzero(own_ == j), similarity, least)
        key = table.column("key")
        return pa.table({c: key.take(pa.array([x[at] for x in links], pa.int64())) for at, c in enumerate("ab")})

    hashes = full_sets(rows.select("key"), df, sets, text_col, size)
    wide = met.join(sets.select("key", "sig").join(hashes, "key"), "key")
    return wide.groupBy("bucket", "i", "j").applyInArrow(run, "a binary, b binary").distinct()


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                    similarity: int = SIMILARITY) -> DataFrame:
    """(id, n_shingles, component_id) for every row of ``df``.

    Rows are linked if the intersection of their shingle sets has at least ``similarity``
    per cent of the union; a component is what links reach, ``component_id`` its smallest
    id. A link is missed with a probability of ``MISS`` in the bands and less than that in
    each of ``BATCHES`` comparisons; none is made that the full sets don't confirm (shingles
    are told apart by 64 bits, sets by 128).

    A text of fewer words than a shingle is one shingle; a null or wordless text has none
    and is linked with nothing. A row with a null id is linked, but never gives a component
    its id (null if no row has one); repeated rows are rows of one component. Very long texts
    are whole. Other columns are left out, whatever their names. An empty table gives an
    empty result.
    """
    if not 0 < similarity <= 100:
        raise ValueError("similarity is a percentage above 0")
    rows = written(signatures(df, id_col, text_col, shingle, bands_for(similarity)), "minhash")
    # any row of a set will do: all have the same values
    first = F.min(F.struct("text_hash", "n", "bands", "sig")).alias("one")
    least = F.min("id").alias("least")
    sets = rows.where("key IS NOT NULL").groupBy("key").agg(least, first).select("key", "least", "one.*")
    sets = written(sets, "minhash-different")
    buckets = written(shared_buckets(sets), "minhash-shared")
    stars = written(compared(star_pairs(buckets), sets, similarity), "minhash-stars")
    links = written(verified(stars, df, sets, text_col, shingle, similarity), "minhash-links")
    reached = components(links, "a", "b").withColumnRenamed("node", "key")
    found = sets.select("key").join(reached, "key", "left").select("key", F.coalesce("root", "key").alias("root"))
    found = written(found, "minhash-found")
    more = written(open_links(buckets, found, df, sets, text_col, shingle, similarity, BLOCK, BLOCK_SHINGLES),
                   "minhash-open-links")
    if not more.isEmpty():
        reached = components(links.union(more), "a", "b").withColumnRenamed("node", "key")
    label = sets.select("key", "least").join(reached, "key", "left").select(
        "key", F.coalesce("root", "key").alias("root"), "least")
    label = written(label, "minhash-roots")
    ids = label.groupBy("root").agg(F.min("least").alias("component_id"))
    label = label.join(ids, "root").select("key", "component_id")
    return rows.select("id", "n", "key").join(label, "key", "left").select(
        "id", F.col("n").alias("n_shingles"),
        F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))


def op13_bayesian_minhash(spark, sf_dir: str) -> DataFrame:
    """Components of all documents by sets of four-word shingles."""
    d = near_duplicates(documents(spark, sf_dir), shingle=4)
    return d.select(F.col("id").alias("doc_id"), "n_shingles", "component_id",
                    F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
