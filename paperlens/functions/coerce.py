"""Type coercion and small scalar helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperlens.functions.text import WHITESPACE_RUN

# --- fixed values: strings read as "true" by the open-access coercion ---
TRUE_STRINGS = ["true", "y", "yes", "1"]


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


#: largest value of each integer type
_LIMIT = {"int": 2 ** 31 - 1, "long": 2 ** 63 - 1024}


def _truncated(c, kind: str) -> Column:
    """Numeric text, fraction cut, in range of ``kind``; anything else NULL (never an ANSI error)."""
    x = _col(c).cast("string").try_cast("double")
    fits = x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= F.lit(float(_LIMIT[kind])))
    # the cast stands behind the range check, in the same conditional
    return F.when(fits, F.when(fits, x).otherwise(F.lit(0.0)).cast(kind))


def to_int_or(c, default: int = 0, kind: str = "int") -> Column:
    """P10: numeric text -> integer (fraction truncated), anything invalid or out of the range
    of ``kind`` (``int`` or ``long``) -> ``default``."""
    return F.coalesce(_truncated(c, kind), F.lit(default).cast(kind))


def to_int_or_null(c, kind: str = "int") -> Column:
    """P10, drop variant: invalid -> NULL (callers filter it away)."""
    return _truncated(c, kind)


def to_whole(c, what: str = "label") -> Column:
    """A whole number, also if written ``1.0``; NULL stays NULL, anything else fails the job."""
    x = _col(c).cast("string")
    number = x.try_cast("double")
    whole = (number == F.floor(number)) & (F.abs(number) <= F.lit(float(_LIMIT["int"])))
    bad = F.raise_error(F.concat(F.lit(f"{what} is not a whole number: "), x)).cast("int")
    return F.when(x.isNull(), F.lit(None).cast("int")).when(
        F.coalesce(whole, F.lit(False)), F.when(whole, number).otherwise(F.lit(0.0)).cast("int")).otherwise(bad)


def to_bool_flag(c) -> Column:
    """Boolean as is; other types via lower-cased text in {true, y, yes, 1}."""
    x = _col(c)
    return F.coalesce(F.lower(x.cast("string")).isin(*TRUE_STRINGS), F.lit(False))


def short_model_name(c) -> Column:
    """Last '/'-separated segment."""
    return F.element_at(F.split(_col(c), "/"), -1)


def baseline_model_label(c) -> Column:
    """Display name of a baseline model."""
    return F.concat(F.lit("TF-IDF + "), _col(c))


def truncate_label(c, n: int = 40) -> Column:
    """First ``n`` characters."""
    return F.substring(_col(c), 1, n)


def strip_ws(c) -> Column:
    """Strip leading/trailing Unicode whitespace (Python ``str.strip``)."""
    return F.regexp_replace(_col(c), f"^{WHITESPACE_RUN}|{WHITESPACE_RUN}$", "")


def nonempty(c) -> Column:
    """NULL for NULL or empty string (so ``coalesce`` picks the first real value)."""
    return F.nullif(_col(c), F.lit(""))


def dedup_key(pmid="pmid", doi="doi", pmcid="pmcid", title="title") -> Column:
    """First non-empty of pmid, doi, pmcid; else the normalised title; namespaced."""
    return F.coalesce(
        F.concat(F.lit("pmid:"), nonempty(pmid)),
        F.concat(F.lit("doi:"), nonempty(doi)),
        F.concat(F.lit("pmcid:"), nonempty(pmcid)),
        F.concat(F.lit("title:"), strip_ws(F.lower(F.coalesce(_col(title), F.lit(""))))),
    )
