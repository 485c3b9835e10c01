"""Phrase-rule predicates (P9) and weak labelling rules.

A rule is a tree of phrases combined with AND / OR, evaluated case-insensitively
on ``lower(title || ' ' || abstract)``. The remote query-string syntax is not
parsed: rules are built with ``phrase``, ``all_of`` and ``any_of``.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Union

from pyspark.sql import Column
from pyspark.sql import functions as F

Rule = Union[str, "AllOf", "AnyOf"]


@dataclass(frozen=True)
class AllOf:
    parts: tuple


@dataclass(frozen=True)
class AnyOf:
    parts: tuple


def all_of(*parts: Rule) -> AllOf:
    return AllOf(tuple(parts))


def any_of(*parts: Rule) -> AnyOf:
    return AnyOf(tuple(parts))


@dataclass(frozen=True)
class LabelRule:
    """A named rule that labels its hits (P4): ``query`` text, ``label`` int."""
    name: str
    rule: Rule
    label: int


def rule_column(rule: Rule, lower_text: Column) -> Column:
    """Boolean Column: does the lower-cased text satisfy ``rule``."""
    if isinstance(rule, str):
        return F.contains(lower_text, F.lit(rule.lower()))
    parts = [rule_column(p, lower_text) for p in rule.parts]
    out = parts[0]
    for p in parts[1:]:
        out = (out & p) if isinstance(rule, AllOf) else (out | p)
    return out


def rule_sql(rule: Rule, lower_text_sql: str) -> str:
    """The same predicate as SQL text (used by the oracle queries)."""
    if isinstance(rule, str):
        lit = rule.lower().replace("'", "''")
        return f"contains({lower_text_sql}, '{lit}')"
    op = " AND " if isinstance(rule, AllOf) else " OR "
    return "(" + op.join(rule_sql(p, lower_text_sql) for p in rule.parts) + ")"


def rule_text(rule: Rule) -> str:
    """Human-readable query string of a rule: ``"a" AND ("b" OR "c")``."""
    if isinstance(rule, str):
        return f'"{rule}"'
    op = " AND " if isinstance(rule, AllOf) else " OR "
    inner = op.join(rule_text(p) if isinstance(p, str) else f"({rule_text(p)})"
                    for p in rule.parts)
    return inner


# --- fixed values: the collection rules of the default configuration ---
POSITIVE_RULES = [
    "Darwin Tree of Life",
    "Earth BioGenome Project",
    all_of("Genome Note", "Wellcome Open Research"),
    all_of("reference genome", "biodiversity"),
    all_of("genome assembly", any_of("insect", "plant", "fungi")),
    all_of("Tree of Life", "genome sequencing"),
    all_of("VGP", "vertebrate genome"),
    all_of("INSDC", "genome assembly"),
]
NEGATIVE_RULES = [
    all_of("clinical trial", "drug"),
    all_of("epidemiology", "cohort study"),
    all_of("psychology", "behavior"),
    all_of("cell culture", "in vitro"),
]
MIN_YEAR, MAX_YEAR = 2018, 2025
MAX_ARTICLES_PER_QUERY = 500


def default_label_rules() -> list[LabelRule]:
    return ([LabelRule(rule_text(r), r, 1) for r in POSITIVE_RULES]
            + [LabelRule(rule_text(r), r, 0) for r in NEGATIVE_RULES])
