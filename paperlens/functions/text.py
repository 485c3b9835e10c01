"""Text functions as native Column expressions (P1, P2, tokens, stop words).

Every function here returns a ``Column``; nothing runs in Python per row, so the
expressions stay inside whole-stage codegen and scale with the executors.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: cleaning patterns of the article text (must stay as they are) ---
# markup tag, named entity, numeric entity; hexadecimal entities (&#x..;) are kept
TAG_PATTERN = r"<[^>]+>"
NAMED_ENTITY_PATTERN = r"&[a-zA-Z]+;"
NUMERIC_ENTITY_PATTERN = r"&#\p{Nd}+;"
MARKUP_PATTERN = f"{TAG_PATTERN}|{NAMED_ENTITY_PATTERN}|{NUMERIC_ENTITY_PATTERN}"
# Unicode whitespace as understood by Python's ``str.isspace``; written without
# \s so that Java regex and RE2 (the SQL oracle) read it the same way.
WHITESPACE_RUN = r"[\t\n\x{0B}\f\r\x{1C}-\x{1F}\x{85}\p{Z}]+"
# word characters: letters, digits (any script) and underscore
WORD_CHAR = r"[\p{L}\p{N}_]"
NON_WORD_CHAR = r"[^\p{L}\p{N}_]"
# tokens of the TF-IDF vectoriser: runs of two or more word characters
TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"
# labels of the combined text field
TITLE_LABEL, ABSTRACT_LABEL, JOURNAL_LABEL, KEYWORDS_LABEL = (
    "TITLE: ", "ABSTRACT: ", "JOURNAL: ", "KEYWORDS: ")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_text(c) -> Column:
    """Drop tags and entities (replaced by a space), squeeze whitespace, strip.

    NULL becomes ``""``. Entities are removed, not decoded.
    """
    x = F.coalesce(_col(c), F.lit(""))
    # one pass for the three removals: an entity cannot contain '<' and every
    # removal leaves a space, so no match can be created or split by another
    # kind - leftmost-first alternation equals the three passes in sequence
    x = F.regexp_replace(x, MARKUP_PATTERN, " ")
    x = F.regexp_replace(x, WHITESPACE_RUN, " ")
    # after squeezing, the only whitespace left is single spaces
    return F.trim(x)


def py_list_repr(arr) -> Column:
    """Render array<string> the way a Python list prints: ``['a', 'b']``."""
    def quote(s):
        has_single = F.instr(s, "'") > 0
        has_double = F.instr(s, '"') > 0
        body = F.replace(s, F.lit("\\"), F.lit("\\\\"))
        dq = F.concat(F.lit('"'), body, F.lit('"'))
        sq = F.concat(F.lit("'"), F.replace(body, F.lit("'"), F.lit("\\'")), F.lit("'"))
        return F.when(has_single & ~has_double, dq).otherwise(sq)

    return F.concat(F.lit("["), F.array_join(F.transform(_col(arr), quote), ", "), F.lit("]"))


def _truthy(c: Column) -> Column:
    return c.isNotNull() & (c != F.lit(""))


def combine_fields(title, abstract, journal=None, keywords=None) -> Column:
    """``TITLE: t ABSTRACT: a JOURNAL: j KEYWORDS: k`` with absent parts skipped.

    A part is present when the raw value is non-empty; keywords also must not
    render as ``[]``. ``keywords`` may be a string or an array<string> column.
    """
    t, a = _col(title), _col(abstract)
    parts = [
        F.when(_truthy(t), F.concat(F.lit(TITLE_LABEL), clean_text(t))),
        F.when(_truthy(a), F.concat(F.lit(ABSTRACT_LABEL), clean_text(a))),
    ]
    if journal is not None:
        j = _col(journal)
        parts.append(F.when(_truthy(j), F.concat(F.lit(JOURNAL_LABEL), clean_text(j))))
    if keywords is not None:
        k = _col(keywords)
        parts.append(F.when(_truthy(k) & (k != F.lit("[]")),
                            F.concat(F.lit(KEYWORDS_LABEL), clean_text(k))))
    return F.concat_ws(" ", *parts)


def combine_cleaned(parts) -> Column:
    """P2 from already-cleaned values: ``parts`` = [(label, raw, cleaned), ...].

    A part is present when its raw value is non-empty (keywords: also not
    ``[]``); its content is the cleaned column, so callers that keep the
    cleaned fields anyway do not clean them twice.
    """
    out = []
    for label, raw, cleaned in parts:
        r = _col(raw)
        present = _truthy(r)
        if label == KEYWORDS_LABEL:
            present = present & (r != F.lit("[]"))
        out.append(F.when(present, F.concat(F.lit(label), _col(cleaned))))
    return F.concat_ws(" ", *out)


def keywords_text(keywords, is_array: bool) -> Column:
    """Keywords as the string the combined field sees (arrays rendered as a list)."""
    k = _col(keywords)
    return py_list_repr(k) if is_array else k


def tfidf_tokens(c) -> Column:
    """Lower-cased tokens: maximal runs of >= 2 word characters."""
    return F.regexp_extract_all(F.lower(F.coalesce(_col(c), F.lit(""))),
                                F.lit(TOKEN_PATTERN), 0)


def word_set(lower_text) -> Column:
    """Distinct words (maximal runs of word characters) of an already lower-cased text."""
    return F.array_distinct(F.regexp_extract_all(_col(lower_text), F.lit(WORD_CHAR + "+"), 0))


# --- fixed values: Spark ML's default English stop words, in its order -------------
ENGLISH_STOP_WORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself
she her hers herself it its itself they them their theirs themselves what which who whom
this that these those am is are was were be been being have has had having do does did doing
a an the and but if or because as until while of at by for with about against between into
through during before after above below to from up down in out on off over under again
further then once here there when where why how all any both each few more most other some
such no nor not only own same so than too very s t can will just don should now i'll you'll
he'll she'll we'll they'll i'd you'd he'd she'd we'd they'd i'm you're he's she's it's we're
they're i've we've you've they've isn't aren't wasn't weren't haven't hasn't hadn't don't
doesn't didn't won't wouldn't shan't shouldn't mustn't can't couldn't cannot could here's
how's let's ought that's there's what's when's where's who's why's would
"""


def english_stop_words() -> tuple[str, ...]:
    """The list ``StopWordsRemover.loadDefaultStopWords("english")`` returns, as a
    constant: the SQL oracle needs it as literal rows, without a JVM or a file."""
    return tuple(ENGLISH_STOP_WORDS.split())
