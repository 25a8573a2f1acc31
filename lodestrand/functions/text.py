"""Text primitives as Column expressions: no Python runs, so scans stay within whole-stage codegen.

All of them give null for null, and an empty string or array for an empty text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HAN = r"[一-鿿]"

# Index-side aliases as (trigger, must also occur, aliases).
ALIASES = (
    ("变速器油", (), ("变速箱油",)),
    ("制动液", (), ("刹车油",)),
    ("冷却液", (), ("防冻液",)),
    ("包修期", (), ("保修期",)),
    ("第 1 次", ("保养",), ("首保", "首次保养")),
)
# Phrases that carry no meaning of their own in a question.
STOP_PHRASES = ("是什么意思", "什么意思", "是什么", "怎么办", "怎么处理", "为什么", "如何", "请教", "请问", "谢谢", "麻烦")


def strip(c: Column) -> Column:
    """Without outer white space of any kind."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def flat(c: Column) -> Column:
    """Runs of white space as single spaces, none outside."""
    return strip(F.regexp_replace(c, r"\s+", " "))


def normalize(c: Column) -> Column:
    """Line ends as \\n, no zero-width signs, single spaces, no spaces at line ends, no more than one blank line."""
    c = F.regexp_replace(c, "\r\n?", "\n")
    c = F.regexp_replace(c, "[​﻿]", "")
    c = F.regexp_replace(c, "[ \t ]+", " ")
    c = F.regexp_replace(c, r" +(?=\n|$)", "")
    return strip(F.regexp_replace(c, r"\n{3,}", "\n\n"))


# Fixed value: where sentences end.
SENTENCE_END = r"(?<=[。！？!?；;])|(?<=\.)\s+"
# The marks of Markdown, in the order in which they go.
MARKS = (
    (r"(?s)```.*?```", ""), (r"`([^`]*)`", "$1"), (r"!\[[^\]]*\]\([^)]*\)", ""), (r"\[([^\]]*)\]\([^)]*\)", "$1"), (r"(?m)^\s{0,3}#{1,6}\s*", ""),
    (r"(?m)^\s{0,3}>\s?", ""), (r"\*\*([^*]*)\*\*", "$1"), (r"(?<!\*)\*([^*]*)\*(?!\*)", "$1"), (r"(?m)^\s*[-*+]\s+", ""),
)


def sentences(c: Column) -> Column:
    """Sentences with their marks, trimmed; the whole text if there is none."""
    parts = F.filter(F.transform(F.split(c, SENTENCE_END), strip), lambda s: s != "")
    return F.when((F.size(parts) == 0) & (c != ""), F.array(c)).otherwise(parts)


def _letters(run: Column, width: int) -> Column:
    last = F.length(run) - (width - 1)
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(run, i, F.lit(width)))).otherwise(F.array().cast("array<string>"))


def tokens(c: Column) -> Column:
    """Han characters, their bigrams by run, then words of a-z and 0-9 without single letters; repeats stay.

    Each kind is one regular expression, bigrams a look-ahead that matches at every place.
    """
    low = F.lower(c)
    found = lambda pattern, group: F.regexp_extract_all(low, F.lit(pattern), F.lit(group))
    return F.concat(found(HAN, 0), found(f"(?=({HAN}{{2}}))", 1), found("[a-z0-9]{2,}|[0-9]", 0))


def snippet(c: Column, most: int = 160) -> Column:
    """One line, cut to `most` characters with an ellipsis."""
    one = flat(c)
    return F.when(F.length(one) <= most, one).otherwise(F.concat(F.substring(one, 1, most - 1), F.lit("…")))


def ngrams(c: Column, width: int) -> Column:
    """Runs of `width` characters of the flattened text in lower case, but blank ones."""
    low = flat(F.lower(c))
    return F.filter(_letters(low, width), lambda g: F.trim(g) != "")


def strip_rules(c: Column) -> Column:
    """Without the lines that are nothing but a rule of three or more of - * _."""
    return F.array_join(F.filter(F.split(c, "\n"), lambda line: ~line.rlike(r"^\s*([-*_])(\s*\1){2,}\s*$")), "\n")


def strip_markdown(c: Column) -> Column:
    """The text without the marks of Markdown."""
    for pattern, by in MARKS:
        c = F.regexp_replace(c, pattern, by)
    return normalize(c)


def alias_line(c: Column) -> Column:
    """The aliases of the terms a text uses, as a line for its index text; empty if there are none."""
    found = [F.when(_all(c, (t, *also)), F.array(*map(F.lit, terms))).otherwise(F.array().cast("array<string>")) for t, also, terms in ALIASES]
    terms = F.array_distinct(F.flatten(F.array(*found)))
    return F.when(F.size(terms) > 0, F.concat(F.lit("（同义表述："), F.array_join(terms, "、"), F.lit("）"))).otherwise(F.lit(""))


def _all(c: Column, terms: tuple[str, ...]) -> Column:
    out = F.lit(True)
    for t in terms:
        out = out & F.contains(c, F.lit(t))
    return out


def context_text(c: Column, *context: Column, aliases: bool = True) -> Column:
    """The index text: context joined by ；, the aliases, then the text itself."""
    parts = [F.nullif(strip(x), F.lit("")) for x in context]
    if aliases:
        parts.append(F.nullif(alias_line(c), F.lit("")))
    head = F.concat_ws("；", *parts)
    return F.when(head != "", F.concat(head, F.lit("\n"), c)).otherwise(c)


def phrases(c: Column) -> Column:
    """The parts of a question between white space and punctuation, of two characters or more, but stop phrases."""
    return F.filter(F.split(c, r"[\s，。！？、；：,.!?;:（）()\[\]【】\"'“”]+"), lambda p: (F.length(p) >= 2) & ~p.isin(*STOP_PHRASES))


def citations(c: Column) -> Column:
    """The distinct numbers cited as [n], in order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(r"\[(\d{1,2})\]"), F.lit(1)), lambda x: x.cast("int")))


def body(c: Column) -> Column:
    """The answer before its list of sources."""
    return F.element_at(F.split(c, r"(?m)^[ \t]*依据[：:]", 2), 1)


def file_name(c: Column) -> Column:
    return F.regexp_extract(c, r"[^/\\]*$", 0)


def stable_id(c: Column, prefix: str = "doc_") -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(c, 256), 1, 10))


def content_hash(c: Column) -> Column:
    """A short hash of the text without white space."""
    return F.substring(F.sha2(F.regexp_replace(c, r"\s+", ""), 256), 1, 16)
