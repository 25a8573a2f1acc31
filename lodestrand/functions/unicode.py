"""Unicode normalisation; Spark has no NFKC function, so these run in Arrow batches."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = re.compile(r"\s+")
DIGIT_COMMA = re.compile(r"(?<=\d),(?=\d)")
NOT_WORD = re.compile(r"[\W_]+")


def nfkc(text: str) -> str:
    return text if text.isascii() else unicodedata.normalize("NFKC", text)


def squeeze(text: str | None) -> str | None:
    """NFKC, lower case, no white space; None stays None."""
    return None if text is None else SPACE.sub("", nfkc(text).lower())


def squeeze_value(text: str | None) -> str | None:
    """`squeeze` and no commas between digits, so that 5,000 km and ５０００KM agree."""
    return None if text is None else DIGIT_COMMA.sub("", squeeze(text))


def number_text(text: str | None) -> str | None:
    """NFKC without commas between digits."""
    return None if text is None else DIGIT_COMMA.sub("", nfkc(text))


def match(text: str | None) -> str | None:
    """NFKC, no commas between digits, then no white space, lower case; "16, 000" keeps its comma."""
    return None if text is None else SPACE.sub("", number_text(text)).lower()


def alnum(text: str | None) -> str:
    """NFKC, lower case, letters and numbers only (Unicode categories L and N)."""
    return "" if text is None else NOT_WORD.sub("", nfkc(text).lower())


def column(function, kind: str, source: Column) -> Column:
    """`function` over a string column, batchwise."""

    @F.pandas_udf(kind)
    def apply(values: pd.Series) -> pd.Series:
        return pd.Series([function(None if v is None or (isinstance(v, float) and v != v) else v) for v in values], dtype=object)

    return apply(source)
