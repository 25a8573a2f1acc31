"""Parts of the queries' SQL that stand in for functions DuckDB lacks."""

from __future__ import annotations

import unicodedata

#: The ranges whose compatibility forms the tables hold: Latin-1, punctuation and letterlike signs, CJK marks, wide forms.
RANGES = ((0xA0, 0x100), (0x2000, 0x2200), (0x2460, 0x2474), (0x3000, 0x3040), (0x3380, 0x33E0), (0xFF01, 0xFF5F))
_FORMS = {chr(c): unicodedata.normalize("NFKC", chr(c)) for low, high in RANGES for c in range(low, high) if chr(c) != unicodedata.normalize("NFKC", chr(c))}
ONE = {c: f for c, f in _FORMS.items() if len(f) == 1 and f != "'"}
#: Signs that become several characters.
SEVERAL = {c: f for c, f in _FORMS.items() if c in "…‥℃℉№㎜㎝㎞㎏㎡½¼¾"}


def nfkc(c: str) -> str:
    """NFKC of what the ranges hold."""
    for sign, form in SEVERAL.items():
        c = f"replace({c}, '{sign}', '{form}')"
    return f"nfc_normalize(translate({c}, '{''.join(ONE)}', '{''.join(ONE.values())}'))"


def squeeze(c: str) -> str:
    return rf"lower(regexp_replace({nfkc(c)}, '\s+', '', 'g'))"


def squeeze_value(c: str) -> str:
    once = rf"regexp_replace({squeeze(c)}, '(\d),(\d)', '\1\2', 'g')"
    return rf"regexp_replace({once}, '(\d),(\d)', '\1\2', 'g')"


def number_text(c: str) -> str:
    once = rf"regexp_replace({nfkc(c)}, '(\d),(\d)', '\1\2', 'g')"
    return rf"regexp_replace({once}, '(\d),(\d)', '\1\2', 'g')"


def match_form(c: str) -> str:
    return rf"lower(regexp_replace({number_text(c)}, '\s+', '', 'g'))"


def snippet_form(c: str) -> str:
    return f"replace({match_form(c)}, '|', '')"


def alnum(c: str) -> str:
    return rf"regexp_replace(lower({nfkc(c)}), '[^\p{{L}}\p{{N}}]', '', 'g')"
