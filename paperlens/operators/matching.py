"""Dictionary matching (T7-T12) and dictionary keywords (K2).

Semantics: a term matches a text case-insensitively; a term of at most four
characters must match as a whole word (word characters on neither side), a
longer term matches as a plain substring. Each distinct term counts once per
text, whatever the number of occurrences.

Plan shape (one narrow projection, no shuffle, no Python):

1. ``lower(text)`` once;
2. the set of distinct words once, intersected with the short word-only terms
   (one hash-set operation instead of one regex per short term);
3. long terms: ``contains`` on the lower-cased text; short terms with inner
   punctuation (``hi-c``): one literal regex with an explicit word boundary;
4. per category one array of ``when(condition, term)``, in generated code, without its
   nulls; ``matches`` = their concatenation, ``struct(category, cat_ord, ord, term)``
   in dictionary order; every count and score is derived from these arrays, so
   each text is matched once (the features and the relevance share it).

Such a dictionary is a user-sized constant (hundreds of terms), compiled into the
expression on the driver; it never grows with the article data. For dictionaries of
tens of thousands of terms, themselves a table, see ``paperlens.operators.term_index``.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperlens.functions.text import NON_WORD_CHAR, WORD_CHAR, word_set
from paperlens.operators.dictionary import SHORT_TERM_MAX_LEN

MATCH_TYPE = "array<struct<category:string,cat_ord:int,ord:int,term:string>>"
#: terms of one array in the generated code
TERMS_A_PIECE = 64
_WORD_RE = re.compile(r"^[^\W]+$")  # only word characters (Python \w = letters, digits, _)


@dataclass(frozen=True)
class Term:
    category: str
    cat_ord: int
    ord: int
    term: str

    @property
    def lower(self) -> str:
        return self.term.lower()

    @property
    def is_short(self) -> bool:
        return len(self.term) <= SHORT_TERM_MAX_LEN

    @property
    def word_only(self) -> bool:
        return bool(_WORD_RE.match(self.term))


_REGEX_META = set("\\.^$|?*+()[]{}")


def _regex_escape(s: str) -> str:
    """Escape regex metacharacters (valid for Java regex and RE2 alike)."""
    return "".join("\\" + ch if ch in _REGEX_META else ch for ch in s)


def whole_word_pattern(term: str) -> str:
    """Portable form of ``\\bterm\\b`` on lower-cased text (Java regex and RE2)."""
    body = _regex_escape(term.lower())
    is_word = lambda ch: ch.isalnum() or ch == "_"
    # \b before a word char needs a non-word (or start) before it, and vice versa
    left = f"(^|{NON_WORD_CHAR})" if is_word(term[0]) else WORD_CHAR
    right = f"($|{NON_WORD_CHAR})" if is_word(term[-1]) else WORD_CHAR
    return left + body + right


def term_hits_udf(terms: Sequence[str], whole_word: Sequence[bool]):
    """Pandas UDF: lower-cased text -> sorted distinct indexes of ``terms`` present.

    One Aho-Corasick pass per text (needs ``pyahocorasick`` on the executors),
    which reports every occurrence, overlapping ones included; a whole-word term
    only counts where a word boundary lies on both sides. Self-contained: it
    refers to nothing of this package, so the workers need not have it.
    """
    key = tuple(terms)
    whole = tuple(bool(w) for w in whole_word)

    @F.pandas_udf("array<int>")
    def hits(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick
        auto = ahocorasick.Automaton()
        for i, term in enumerate(key):
            auto.add_word(term, i)
        if key:
            auto.make_automaton()

        def word(ch):
            return ch is not None and (ch.isalnum() or ch == "_")

        def found(t):
            seen = set()
            for end, i in (auto.iter(t) if t and key else ()):
                if i in seen:
                    continue
                if whole[i]:
                    start = end - len(key[i]) + 1
                    before = t[start - 1] if start > 0 else None
                    after = t[end + 1] if end + 1 < len(t) else None
                    if word(before) == word(key[i][0]) or word(after) == word(key[i][-1]):
                        continue
                seen.add(i)
            return sorted(seen)

        for texts in batches:
            yield pd.Series([found(t) for t in texts])

    return hits


class CompiledDictionary:
    """Driver-side view of a (small) dictionary, ready to build expressions."""

    def __init__(self, terms: Sequence[Term]):
        self.terms = sorted(terms, key=lambda t: (t.cat_ord, t.ord))
        seen = []
        for t in self.terms:
            if t.category not in seen:
                seen.append(t.category)
        self.categories = seen
        self.n_terms = len(self.terms)

    @classmethod
    def from_mapping(cls, mapping: Mapping[str, Sequence[str]]) -> "CompiledDictionary":
        return cls([Term(c, ci, oi, t) for ci, (c, lst) in enumerate(mapping.items())
                    for oi, t in enumerate(lst)])

    @classmethod
    def from_df(cls, d: DataFrame) -> "CompiledDictionary":
        rows = d.select("category", "cat_ord", "ord", "term").orderBy("cat_ord", "ord").collect()
        return cls([Term(r[0], int(r[1]), int(r[2]), r[3]) for r in rows])

    @property
    def short_word_terms(self) -> list[str]:
        return sorted({t.lower for t in self.terms if t.is_short and t.word_only})

    @property
    def automaton_terms(self) -> list[tuple[str, bool]]:
        """Distinct (lower-cased term, whole-word) pairs, in a fixed order."""
        return sorted({(t.lower, t.is_short) for t in self.terms})


def _as_compiled(dictionary) -> CompiledDictionary:
    if isinstance(dictionary, CompiledDictionary):
        return dictionary
    if isinstance(dictionary, DataFrame):
        return CompiledDictionary.from_df(dictionary)
    return CompiledDictionary.from_mapping(dictionary)


def with_matches(df: DataFrame, dictionary, text_col: str = "text",
                 out: str = "matches", strategy: str = "expr",
                 category_prefix: str | None = None) -> DataFrame:
    """Add ``matches`` = matched terms as array<struct<category,cat_ord,ord,term>>.

    ``strategy``: ``expr`` = pure JVM (``contains`` per long term, one word set
    intersected with the short terms, a literal regex for short terms with
    punctuation), whatever the dictionary's size; ``automaton``, only when asked
    for by name = one Aho-Corasick pass per text in Arrow batches.
    With ``category_prefix`` the per-category match arrays are kept as columns
    ``<prefix><i>`` (category order), for counts without higher-order functions.
    """
    cd = _as_compiled(dictionary)
    ltext = "__ltext"
    hits = "__hits"
    staged = df.withColumn(ltext, F.lower(F.coalesce(F.col(text_col), F.lit(""))))
    if strategy not in ("expr", "automaton"):
        raise ValueError(f"unknown matching strategy {strategy!r}")
    if strategy == "automaton":
        terms, whole = zip(*cd.automaton_terms) if cd.terms else ((), ())
        staged = staged.withColumn(hits, term_hits_udf(terms, whole)(F.col(ltext)))
        number = {t: i for i, t in enumerate(cd.automaton_terms)}
    else:
        # short terms: plain words through the set of the text's words, the few with
        # punctuation by a literal regex each; both end up in one array
        odd = {t.lower: t for t in cd.terms if t.is_short and not t.word_only}
        found = [F.when(F.col(ltext).rlike(whole_word_pattern(t.term)), F.lit(lower))
                 for lower, t in sorted(odd.items())]
        words = (F.array_intersect(word_set(F.col(ltext)), F.array(*[F.lit(w) for w in cd.short_word_terms]))
                 if cd.short_word_terms else F.array().cast("array<string>"))
        staged = staged.withColumn(hits, F.concat(words, F.array_compact(F.array(*found))) if found else words)

    def present(t: Term) -> Column:
        if strategy == "automaton":
            return F.array_contains(hits, F.lit(number[t.lower, t.is_short]))
        return F.array_contains(hits, F.lit(t.lower)) if t.is_short else F.contains(F.col(ltext), F.lit(t.lower))

    def term(t: Term) -> Column:
        return F.struct(F.lit(t.category).alias("category"), F.lit(t.cat_ord).alias("cat_ord"),
                        F.lit(t.ord).alias("ord"), F.lit(t.term).alias("term"))

    # one generated expression a category, in pieces that keep its methods small
    def category(c: str) -> Column:
        own = [F.when(present(t), term(t)) for t in cd.terms if t.category == c]
        return F.concat(*[F.array_compact(F.array(*own[i:i + TERMS_A_PIECE]))
                          for i in range(0, len(own), TERMS_A_PIECE)])

    cat_cols = [f"{category_prefix or '__cat_'}{i}" for i in range(len(cd.categories))]
    staged = staged.withColumns({name: category(c) for name, c in zip(cat_cols, cd.categories)})
    arr = F.concat(*[F.col(n) for n in cat_cols]) if cat_cols else F.array().cast(MATCH_TYPE)
    out_df = staged.withColumn(out, arr).drop(ltext, hits)
    return out_df if category_prefix else out_df.drop(*cat_cols)


def explode_matches(df: DataFrame, matches: str = "matches", out: str = "h") -> DataFrame:
    """One row per matched term. ``explode_outer`` + a null filter: a plain
    ``explode`` lets the optimizer infer ``size(matches) > 0`` and push it below
    the match projection, which would evaluate the whole dictionary expression
    a second time per row."""
    cols = [c for c in df.columns if c != matches]
    return (df.select(*cols, F.explode_outer(matches).alias(out))
            .where(F.col(out).isNotNull()))


def match_article_text(title="title", abstract="abstract") -> Column:
    """The text an article is matched on: ``title + ' ' + abstract`` (uncleaned)."""
    c = lambda x: F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit(""))
    return F.concat(c(title), F.lit(" "), c(abstract))


def _in_category(c: str):
    # one-argument lambda (Spark reads the arity: two arguments would mean "with index")
    return lambda x: x["category"] == F.lit(c)


def matches_by_category(matches: str | Column, categories: Sequence[str]) -> Column:
    """T7 result as ``map<category, array<term>>``; categories without hits absent."""
    m = F.col(matches) if isinstance(matches, str) else matches
    entries = [F.struct(F.lit(c).alias("key"),
                        F.transform(F.filter(m, _in_category(c)),
                                    lambda x: x["term"]).alias("value"))
               for c in categories]
    if not entries:
        return F.create_map().cast("map<string,array<string>>")
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: F.size(e["value"]) > 0))


def feature_columns(dictionary, matches: str = "matches",
                    category_prefix: str | None = None) -> list[Column]:
    """T9-T11 as columns derived from the match array (no second match pass).

    With ``category_prefix`` the counts are sizes of the per-category arrays
    (plain generated code); otherwise they filter the match array.
    """
    cd = _as_compiled(dictionary)
    m = F.col(matches)
    if category_prefix:
        sizes = [F.size(F.col(f"{category_prefix}{i}")) for i in range(len(cd.categories))]
    else:
        sizes = [F.size(F.filter(m, _in_category(c))) for c in cd.categories]
    per_cat = [sz.alias(f"match_{c}") for sz, c in zip(sizes, cd.categories)]
    total = F.size(m)
    cats = sum(((sz > 0).cast("int") for sz in sizes), F.lit(0)) if sizes else F.lit(0)
    ncat = max(len(cd.categories), 1)
    coverage = cats.cast("double") / F.lit(float(ncat))
    density = F.least(F.lit(1.0), F.log1p(total.cast("double")) / F.lit(math.log1p(20)))
    relevance = F.when(total == 0, F.lit(0.0)).otherwise(
        F.round(F.lit(0.4) * coverage + F.lit(0.6) * density, 4))
    return per_cat + [
        total.alias("match_total"),
        (total.cast("double") / F.lit(float(max(cd.n_terms, 1)))).alias("match_score"),
        cats.alias("categories_matched"),
        relevance.alias("relevance_score"),
    ]


def augment_with_dictionary(df: DataFrame, dictionary, text_col: str = "text",
                            keep_matches: bool = False, strategy: str = "expr") -> DataFrame:
    """Add the feature vector and the relevance score, matching once per text."""
    cd = _as_compiled(dictionary)
    staged = with_matches(df, cd, text_col, "__matches", strategy, category_prefix="__mc")
    cat_cols = [f"__mc{i}" for i in range(len(cd.categories))]
    out = staged.select("*", *feature_columns(cd, "__matches", "__mc")).drop(*cat_cols)
    if keep_matches:
        return out.withColumnRenamed("__matches", "matches")
    return out.drop("__matches")


def relevance_score(df: DataFrame, dictionary, text_col: str = "text") -> DataFrame:
    """T11 alone."""
    cd = _as_compiled(dictionary)
    staged = with_matches(df, cd, text_col, "__matches", category_prefix="__mc")
    rel = feature_columns(cd, "__matches", "__mc")[-1]
    return staged.select("*", rel).drop("__matches", *[f"__mc{i}" for i in range(len(cd.categories))])


def dictionary_keywords(df: DataFrame, dictionary, text_col: str = "text",
                        order_col: str = "seq", n: int = 50) -> DataFrame:
    """K2: documents per matched term, top ``n``; ties in first-seen order.

    First seen = the earliest (row order, dictionary order) hit, the order in
    which a running counter would have met the term.
    """
    cd = _as_compiled(dictionary)
    staged = with_matches(df.select(order_col, text_col), cd, text_col, "m")
    hits = explode_matches(staged.select(F.col(order_col).alias("seq"), "m"), "m", "h")
    agg = (hits.groupBy(F.col("h.term").alias("term"))
           .agg(F.count("*").alias("n_docs"),
                F.min(F.struct(F.col("seq"), F.col("h.cat_ord"), F.col("h.ord"))).alias("first")))
    return (agg.orderBy(F.col("n_docs").desc(), F.col("first"))
            .limit(n).select("term", "n_docs"))
