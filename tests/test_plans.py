"""Plan checks: one match pass per text, no Python in the analytic queries."""

from __future__ import annotations

import os

import pytest

from tests.conftest import SF_SMALL


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("strategy,expected", [("expr", 0), ("automaton", 1)])
def test_t12_matches_once(spark, strategy, expected):
    from paperlens.operators.dictionary import distinct_builtin_terms
    from paperlens.operators.matching import CompiledDictionary, augment_with_dictionary
    df = spark.createDataFrame([(1, "genome assembly with PacBio HiFi")], "id int, text string")
    cd = CompiledDictionary.from_mapping(distinct_builtin_terms())
    plan = _plan(augment_with_dictionary(df, cd, "text", strategy=strategy))
    assert plan.count("ArrowEvalPython") == expected
    assert "BatchEvalPython" not in plan


@pytest.mark.skipif(not os.path.exists(SF_SMALL), reason="driver tables not present")
@pytest.mark.parametrize("name", ["preprocess", "split", "collect_balance", "tfidf_keywords",
                                  "citation_metrics", "trend_table", "evaluate_scorers",
                                  "article_extract", "match_features",
                                  "match_builtin", "relevance_by_label", "dict_keywords",
                                  "dict_term_hits", "dict_summary"])
def test_no_python_in_analytic_queries(spark, name):
    import __spark_entry__ as E
    plan = _plan(E.queries()[name](spark, SF_SMALL))
    assert "EvalPython" not in plan
