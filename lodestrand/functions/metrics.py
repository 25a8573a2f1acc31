"""Evaluation metrics as Column expressions. An empty denominator gives null, never zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestrand.functions import text as X
from lodestrand.functions.unicode import column, match, number_text

# Floors and ratios of the failure labels, and the markers of a refusal.
GOOD_RANK, KEYWORD_FLOOR, SUBSTANTIVE, UNSUPPORTED_RATIO, LEAST_CLAUSES = 3, 0.5, 0.3, 0.4, 3
REFUSALS = ("当前知识库中未找到", "未找到相关依据", "未找到与该问题相关的依据", "资料中未涉及", "资料中没有")


def number_form(c: Column) -> Column:
    """NFKC without commas between digits."""
    return column(number_text, "string", c)


def match_form(c: Column) -> Column:
    """NFKC, no commas between digits, no white space, lower case: 16,000 is 16000, "16, 000" keeps its comma."""
    return column(match, "string", c)


def match_forms(c: Column) -> Column:
    """The match forms of an array's elements, blank ones left out; empty for null."""
    return column(lambda a: [] if a is None else [f for x in a if x is not None and (f := match(x))], "array<string>", c)


def snippet_form(c: Column) -> Column:
    """The match form without the bars of tables."""
    return F.replace(match_form(c), F.lit("|"), F.lit(""))


def source_form(c: Column) -> Column:
    return X.strip(F.translate(c, "\\", "/"))


def source_forms(c: Column) -> Column:
    """The distinct sources of an array in one form, blank ones left out; empty for null."""
    return F.array_distinct(F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda s: source_form(F.coalesce(s, F.lit("")))), lambda s: s != ""))


def hits(expected: Column, text: Column) -> Column:
    """How many of the expected strings the text holds; both in match form."""
    return F.size(F.filter(expected, lambda e: (e != "") & F.contains(text, e)))


def keyword_coverage(expected: Column, text: Column) -> Column:
    """The share of the expected strings held; 0 where none is expected."""
    return F.when(F.size(expected) > 0, F.round(hits(expected, text) / F.size(expected), 4)).otherwise(F.lit(0.0))


def source_matches(source: Column, expected: Column) -> Column:
    """Whether a source is one of the expected ones, or ends with one as a path."""
    return F.exists(expected, lambda e: (source == e) | F.endswith(source, F.concat(F.lit("/"), e)))


def relevant(source: Column, text: Column, sources: Column, snippets: Column) -> Column:
    """Relevance of a passage: its source is expected and, where snippets are expected, it holds one of them."""
    return source_matches(source, sources) & ((F.size(snippets) == 0) | (hits(snippets, text) > 0))


def is_refusal(answer: Column) -> Column:
    """Whether a text in match form holds one of the fixed refusals."""
    out = F.lit(False)
    for m in REFUSALS:
        out = out | F.contains(answer, F.lit(m))
    return F.coalesce(out, F.lit(False))


def effective_refusal(must_refuse: Column, refused: Column, declared: Column, substantive: Column) -> Column:
    """Items to refuse count as refused once the lack is declared; others only if refused outright or nothing else is said."""
    return (refused | declared) & (must_refuse | refused | ~substantive)


def refusal_path(refused: Column, declared: Column, substantive: Column) -> Column:
    return F.when(refused, "hard").when(declared & substantive, "partial").when(declared, "soft").otherwise("none")


def failure(error: Column, must_refuse: Column, refused: Column, out_of_range: Column, substantive: Column, has_sources: Column, recall: Column, first_rank: Column, clauses: Column, unsupported: Column, keywords: Column) -> Column:
    """The first failure that applies, in fixed order; ok if none does."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    return (
        F.when(yes(error), "error")
        .when(must_refuse & refused.isNull(), "not_evaluated")
        .when(yes(out_of_range), "citation_out_of_range")
        .when(must_refuse & refused, "ok")
        .when(must_refuse, "missed_refusal")
        .when(yes(refused) & substantive, "wrong_refusal")
        .when(yes(refused) & has_sources, "evidence_miss")
        .when(yes(refused), "wrong_refusal")
        .when(has_sources & yes(recall <= 0), "retrieval_miss")
        .when(has_sources & yes(first_rank > GOOD_RANK), "ranking_low")
        .when(yes((clauses >= LEAST_CLAUSES) & (unsupported / clauses >= UNSUPPORTED_RATIO)), "attribution_weak")
        .when(has_sources & yes(keywords < KEYWORD_FLOOR), "answer_mismatch")
        .otherwise("ok")
    )


def ratio(a: Column, b: Column) -> Column:
    return F.round(F.try_divide(a, b), 4)


def mean(c: Column) -> Column:
    return F.round(F.avg(c), 4)
