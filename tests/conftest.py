"""Shared fixtures: one local Spark session for the whole run."""

from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from paperlens.session import ensure_checkpoint_dir
    s = (SparkSession.builder.master("local[*]").appName("paperlens-tests")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(s)  # unset in tests: a scratch folder is chosen
    yield s


@pytest.fixture(scope="session")
def term_rich_text():
    """A text made of built-in terms of every category, a few of each."""
    from paperlens.operators.dictionary import BUILTIN_CATEGORIES
    return ". ".join(" and ".join(terms[2:9:2]) for terms in BUILTIN_CATEGORIES.values())


@pytest.fixture(scope="session")
def plain_text(spark):
    """Invented prose of the driver's documents."""
    return spark.read.parquet(f"{SF_SMALL}/documents.parquet").orderBy("doc_id").first()["text"]
