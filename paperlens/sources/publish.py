"""Tables that are replaced as a whole or not at all.

A table's folder holds its versions, each in a folder of its own, and numbered manifest
files that name one. A write goes to a new version; only when it is complete does a
manifest, written aside and renamed, make it the current one. Readers follow the manifest
of the highest number, so a write that dies half-way leaves the table as it was, and a
reader that has begun keeps its version.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

_MANIFEST = "_manifest-"


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _manifests(spark: SparkSession, path: str) -> list[str]:
    fs, folder = _fs(spark, path), _path(spark, path)
    if not fs.exists(folder):
        return []
    names = (s.getPath().getName() for s in fs.listStatus(folder))
    return sorted(n for n in names if n.startswith(_MANIFEST))


def current(spark: SparkSession, path: str) -> str:
    """The folder of the table's current version; ``path`` itself where nothing was published."""
    path = path.rstrip("/")
    names = _manifests(spark, path)
    if not names:
        return path
    stream = _fs(spark, path).open(_path(spark, f"{path}/{names[-1]}"))
    try:
        return f"{path}/{stream.readUTF()}"
    finally:
        stream.close()


def publish(spark: SparkSession, path: str, write: Callable[[str], None]) -> str:
    """``write(folder)`` into a new version, then makes it the current one; returns the folder.
    Two writers at once both write; the one whose manifest comes second is current."""
    path = path.rstrip("/")
    version = f"version-{uuid.uuid4().hex}"
    write(f"{path}/{version}")
    fs = _fs(spark, path)
    aside = _path(spark, f"{path}/_aside-{version}")
    stream = fs.create(aside, False)
    stream.writeUTF(version)
    stream.close()
    while True:
        names = _manifests(spark, path)
        number = int(names[-1][len(_MANIFEST):]) + 1 if names else 0
        # a rename fails where another writer took the number first
        if fs.rename(aside, _path(spark, f"{path}/{_MANIFEST}{number:012d}")):
            return f"{path}/{version}"
