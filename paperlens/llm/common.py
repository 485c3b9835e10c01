"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperlens.session import ensure_checkpoint_dir

#: characters between words, as in ``[^\x20\x09-\x0D]+``; ``bytes.split()`` uses the same six
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


#: bytes of an Arrow batch that goes to a Python worker; a worker, and the JVM for it, holds
#: several times as much
BATCH_BYTES = 8 << 20


def documents(spark, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def bound_batches(spark) -> None:
    """Sets the session's Arrow batches to ``BATCH_BYTES``: whole texts in batches of 64 MB,
    Spark's default, take gigabytes of an executor. Results don't depend on it."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, None)
    if now is None or not now.isdigit() or not 0 < int(now) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` as a Parquet table in the shared checkpoint folder: cuts the lineage,
    survives lost executors, and every reader sees the same rows."""
    spark = df.sparkSession
    bound_batches(spark)
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    release(spark)
    return spark.read.schema(df.schema).parquet(path)


def release(spark) -> None:
    """Lets Spark delete the shuffle files of tables that nothing refers to any more: its
    cleaner acts when the driver collects garbage, which a job of many steps can't await."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """A hint to broadcast ``df``, a written table of a few columns, if it has at most ``rows``."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or longer, such that no column of ``df`` is so named in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def in_pieces(batches, rows: int = 256):
    """The rows of Arrow batches, ``rows`` at a time: what Python makes of a batch takes far
    more memory than the batch."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def word_count(text: Column) -> Column:
    """Number of words of a text (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective mixing of unsigned 64-bit integers (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def with_fields(df: DataFrame, **fields: str) -> T.StructType:
    """The schema of ``df`` and more fields, given as name=type."""
    more = [T.StructField(k, T._parse_datatype_string(v)) for k, v in fields.items()]
    return T.StructType([*df.schema.fields, *more])
