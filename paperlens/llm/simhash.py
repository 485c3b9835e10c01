"""SimHash near-duplicates: pigeonhole blocks, then verified Hamming distance.

A 64-bit fingerprint is split into four blocks of 16 bits. Two fingerprints
with at most two differing bits agree in two blocks at least, so they share one
of the six pairs of blocks. Distinct fingerprints are joined on block pairs and
the members of a group compared by their Hamming distance. Groups of more than
``COMPARED`` members aren't compared, as the work would grow with their square:
there each fingerprint names its one-bit variants in the other blocks. Two
fingerprints that share the group differ in at most two bits exactly if they have
a variant in common, so the star around each variant, of 65 fingerprints at most,
gives every link as a path without listing pairs.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperlens.llm.common import documents, small, written
from paperlens.llm.components import components

MAX_BITS = 2
#: members of a group that are compared with one another; of more, the 33 variants of each are fewer
COMPARED = 32
_BLOCKS, _WIDTH = 4, 16
_PAIRS = list(combinations(range(_BLOCKS), _BLOCKS - MAX_BITS))


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Majority bits of the hashes of the text's word shingles, as a signed long."""
    import xxhash
    words = (text or "").encode().lower().split()  # bytes.lower() changes A-Z alone
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    h = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(42)), "<u8")
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 65_536):
        bits = np.unpackbits(h[i:i + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<i8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 shingle: int = 3) -> DataFrame:
    """(id, fp) of every row; a null or wordless text has fingerprint 0."""
    def run(batches):
        import pyarrow as pa
        for b in batches:
            fp = [fingerprint(t.as_py(), shingle) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64())], ["id", "fp"])

    d = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col))
    return d.mapInArrow(run, "id long, fp long")


def _masks(pair: tuple[int, ...]) -> list[int]:
    """No bit, and every single bit outside the pair's blocks, as signed longs."""
    free = [b for b in range(64) if b // _WIDTH not in pair]
    return [0, *(np.array([1 << b for b in free], np.uint64).view(np.int64).tolist())]


def links(fps: DataFrame, compared: int = COMPARED) -> DataFrame:
    """(fp, other): links among distinct fingerprints whose paths join all that differ in at
    most two bits; each link itself is of two bits at most. ``fps``: distinct (fp). No
    group above ``compared`` members is ever gathered."""
    block = [F.shiftrightunsigned("fp", _WIDTH * i).bitwiseAND(F.lit((1 << _WIDTH) - 1))
             for i in range(_BLOCKS)]
    keys = [F.lit(n << 32) + F.shiftleft(block[i], _WIDTH) + block[j] for n, (i, j) in enumerate(_PAIRS)]
    keyed = fps.select("fp", F.explode(F.array(*keys)).alias("key"))
    sizes = written(keyed.groupBy("key").agg(F.count("*").alias("c")).where("c > 1"), "simhash-groups")
    small_groups = sizes.where(F.col("c") <= compared).select("key")
    large_groups = sizes.where(F.col("c") > compared).select("key")

    groups = keyed.join(small_groups, "key").groupBy("key").agg(F.collect_list("fp").alias("all"))
    near = F.flatten(F.transform("all", lambda a: F.transform(
        F.filter("all", lambda b: (b < a) & (F.bit_count(a.bitwiseXOR(b)) <= MAX_BITS)),
        lambda b: F.struct(a.alias("fp"), b.alias("other")))))
    # not explode: a filter on the array's size would work it out twice
    pairs = groups.select(F.explode_outer(near).alias("link")).where("link is not null").select("link.*")

    masks = F.lit([_masks(p) for p in _PAIRS])[F.shiftright("key", 32).cast("int")]
    variants = (keyed.join(small(large_groups), "key").select("fp", masks.alias("masks"))
                .select("fp", F.explode("masks").alias("mask"))
                .select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("variant")))
    stars = variants.groupBy("variant").agg(F.collect_set("fp").alias("all")).where(F.size("all") > 1)
    spokes = (stars.select(F.array_min("all").alias("other"), F.explode("all").alias("fp"))
              .where("fp != other")
              .where(F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= MAX_BITS))
    return pairs.union(spokes.select("fp", "other")).distinct()


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    shingle: int = 3) -> DataFrame:
    """(id, fp, root, component_id) for every row of ``df``.

    Rows are linked if their fingerprints differ in at most two bits; a component is what
    links reach, ``root`` its smallest fingerprint and ``component_id`` its smallest id.
    Null, empty and wordless texts have fingerprint 0 and are linked like any other. A row
    with a null id is linked, but never gives the component its id (null if no row has one);
    repeated rows are rows of one component. Other columns are left out, whatever their
    names. An empty table gives an empty result.
    """
    docs = written(fingerprints(df, id_col, text_col, shingle), "simhash")
    each = written(docs.groupBy("fp").agg(F.min("id").alias("least")), "simhash-distinct")
    found = components(links(each.select("fp")), "fp", "other")
    rooted = (each.join(found.withColumnRenamed("node", "fp"), "fp", "left")
              .select("fp", F.coalesce("root", "fp").alias("root"), "least"))
    rooted = written(rooted, "simhash-roots")
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    label = rooted.join(ids, "root").select("fp", "root", "component_id")
    return docs.join(label, "fp").select("id", "fp", "root", "component_id")


def op3_simhash_components(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    d = near_duplicates(documents(spark, sf_dir))
    return d.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
                    "component_id")
