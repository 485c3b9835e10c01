"""Results do not depend on the number of shuffle partitions (order independence)."""

from __future__ import annotations

import os

import pytest

from tests.conftest import SF_SMALL

QUERIES = ["split", "collect_balance", "dedup_keep_first", "tfidf_keywords", "dict_keywords",
           "journal_spread", "evaluate_scorers", "phrase_rules"]


@pytest.mark.skipif(not os.path.exists(SF_SMALL), reason="driver tables not present")
def test_same_result_for_1_4_13_partitions(spark):
    import __spark_entry__ as E
    before = spark.conf.get("spark.sql.shuffle.partitions")
    results = {}
    try:
        for n in (1, 4, 13):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            results[n] = {q: sorted(map(tuple, E.queries()[q](spark, SF_SMALL).collect()))
                          for q in QUERIES}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    for q in QUERIES:
        assert results[1][q] == results[4][q] == results[13][q], q
