"""Personal data in free text, found by a character tagger and replaced by typed placeholders.

A text is mapped character by character to half-width forms with all digits alike, short numbers
are shortened to one digit, and the whole text is read in overlapping windows of WINDOW characters,
across the ends of clauses, sentences and lines. The tagger (bidirectional LSTM with CRF,
`lodestrand.llm.tagger`) decodes each window; what a window's edge cuts is decoded again in a wider
one. The spans of all windows of a text are then reconciled together: of overlapping spans the union
stands if they are of one kind, else the longer one. An exact check of form follows: an e-mail address
must have its @, a phone number 7 to 21 digits with its extension, an identity number 8 letters or digits at least, an
address a house number, a name no digit.

There is no shuffle. Defined results: null and empty texts hold nothing and stay as they are.
Texts of any length are read whole.
"""

from __future__ import annotations

import os
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, pairwise

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.llm.tagger import KINDS, Tagger
from lodestrand.session import spread

MODEL = os.path.join(os.path.dirname(__file__), "pii_model.npz")
WINDOW, OVERLAP = 512, 48
#: Pieces of more characters than this are joined, not decoded again together.
WIDEST = 1024
PLACEHOLDERS = {k: f"[{k.upper()}]" for k in KINDS}

HALF = {c: c - 0xFEE0 for c in range(0xFF01, 0xFF5F) if chr(c) not in "，；：！？"} | {0x3000: 32, 0xA0: 32, 13: 10, 0x2007: 32, 0x202F: 32}
SHAPE = HALF | {ord(c): "0" for c in "0123456789"} | {c: "0" for c in range(0xFF10, 0xFF1A)}
# These begin with the sign itself, so that the search can leap from one to the next.
CODE = re.compile(r"[A-Z](?:(?<=0[A-Z])[A-Z]*|[A-Z]*+(?=-?0))")
NUMBER = re.compile(r"0(?:(?<![\w.+(/@-]0)(?<!0 0)0{0,2}(?:\.0{1,2})?(?![\w./@-]| ?[0(])|(?<=[一-鿿]0)0{0,2}(?:\.0{1,2})?(?=[^0A-Za-z ./@-]|[KNVm%LMΩk]))")
MAIL = re.compile(r"[A-Za-z0-9_.+-]+(?:\s?@\s?|\s?[(\[{] ?at ?[)\]}]\s?|\sat\s)[A-Za-z0-9-]+(?:(?:\.| ?[(\[{] ?dot ?[)\]}] ?| dot )[A-Za-z0-9-]+)+", re.I)
MAIL_SIGN = re.compile(r"[A-Za-z0-9_.+@-]")
EXTENSION = re.compile(r"ext|[x转]", re.I)
EDGE = re.compile(r"[^\w+(]+")
TITLE = re.compile(r"(?:[^\w]*(?:gez\.|Herrn?|Frau|Mrs?\.?|Ms\.?)? *)")

_state: dict = {"tagger": None}


def plain(text: str) -> str:
    """Half-width forms, simple spaces and line ends; as long as the text."""
    return text.translate(HALF)


def shape(text: str) -> str:
    """What the tagger reads: `plain` with all digits 0 and letters of codes alike; as long as the text."""
    return CODE.sub(lambda m: "A" * len(m[0]), text.translate(SHAPE))


def shapes(texts: list[str]) -> list[str]:
    """`shape` of many texts: joined, their characters are mapped by one table look-up."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    whole = _table()[codes].tobytes().decode("utf-32-le", "surrogatepass")
    ends = list(accumulate(map(len, texts), initial=0))
    return [CODE.sub(lambda m: "A" * len(m[0]), whole[a:b]) for a, b in pairwise(ends)]


@lru_cache(maxsize=1)
def _table() -> np.ndarray:
    table = np.arange(0x110000, dtype=np.uint32)
    for c, to in SHAPE.items():
        table[c] = ord(to) if isinstance(to, str) else to
    return table


def shorten(shaped: str) -> str:
    """The text with each short number as the digit 1; this is what is decoded."""
    return NUMBER.sub("1", shaped)


def places(shaped: str) -> list[int]:
    """For each place in the shortened text, and its end, the place in the text."""
    out, at = [], 0
    for m in NUMBER.finditer(shaped):
        out += range(at, m.start() + 1)
        at = m.end()
    return [*out, *range(at, len(shaped) + 1)]


def windows(length: int, width: int = WINDOW) -> list[tuple[int, int]]:
    """Overlapping windows over a text."""
    out, start = [], 0
    while length - start > width:
        out.append((start, start + width))
        start += width - OVERLAP
    return [*out, (start, length)]


def reconcile(spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Spans that don't overlap: unions within a kind, else the longer one."""
    joined: list[tuple[int, int, str]] = []
    for a, b, kind in sorted(spans, key=lambda s: (s[2], s[0], s[1])):
        if joined and joined[-1][2] == kind and a < joined[-1][1]:
            joined[-1] = (joined[-1][0], max(b, joined[-1][1]), kind)
        else:
            joined.append((a, b, kind))
    kept: list[tuple[int, int, str]] = []
    for s in sorted(joined, key=lambda s: (s[0] - s[1], s)):
        if all(s[1] <= k[0] or s[0] >= k[1] for k in kept):
            kept.append(s)
    return sorted(kept)


def decode(parts: list[str], tagger: Tagger) -> list[list[tuple[int, int, str]]]:
    """The reconciled spans of each text.

    What touches an inner edge of a window may be a piece of a longer span that no window sees
    whole. It is decoded again with OVERLAP characters around it, wider each time, until it touches no
    inner edge; pieces that make up more than WIDEST characters are joined as they are.
    """
    found: list[list] = [[] for _ in parts]
    todo = [(k, a, b, 0, len(part)) for k, part in enumerate(parts) for a, b in windows(len(part))]
    while todo:
        pieces: dict[int, list] = defaultdict(list)
        for (k, a, b, low, high), spans in zip(todo, tagger.decode([parts[k][a:b] for k, a, b, _, _ in todo])):
            for s, e, kind in ((a + s, a + e, kind) for s, e, kind in spans if a + s < high and a + e > low):
                if (a and s == a) or (b < len(parts[k]) and e == b):
                    # together with what it was sought for, so that the next window is wider
                    own = (min(s, low), max(e, high)) if (low, high) != (0, len(parts[k])) else (s, e)
                    pieces[k].append((*own, (s, e, kind)))
                else:
                    found[k].append((s, e, kind))
        todo = []
        for k, own in pieces.items():
            groups: list[tuple[int, int, list]] = []
            for s, e, piece in sorted(own):
                if groups and s < groups[-1][1]:
                    groups[-1] = (groups[-1][0], max(e, groups[-1][1]), [*groups[-1][2], piece])
                else:
                    groups.append((s, e, [piece]))
            for s, e, some in groups:
                if e - s > WIDEST:
                    found[k] += some
                else:
                    todo.append((k, max(0, s - OVERLAP), min(len(parts[k]), e + OVERLAP), s, e))
    return [reconcile(f) for f in found]


def confirm(text: str, a: int, b: int, kind: str) -> list[tuple[int, int]]:
    """The span's exact extent in a plain text, nothing if its form can't be of that kind."""
    if kind == "email":
        while a and MAIL_SIGN.match(text[a - 1]) and MAIL_SIGN.match(text[a]):
            a -= 1
        while b < len(text) and MAIL_SIGN.match(text[b]) and MAIL_SIGN.match(text[b - 1]):
            b += 1
        while b > a and not text[b - 1].isalnum():
            b -= 1
        while a < b and not text[a].isalnum():
            a += 1
        return [(a, b)] if MAIL.search(text[a:b]) else []
    if m := (TITLE if kind == "name" else EDGE).match(text[a:b]):
        a += m.end()
    while b > a and not (text[b - 1].isalnum() or text[b - 1] == ")"):
        b -= 1
    own = text[a:b]
    digits = sum(c.isdigit() for c in own)
    letters = sum(c.isalpha() for c in own)
    good = {
        "phone": 7 <= digits <= 21 and sum(c.isalpha() for c in EXTENSION.sub("", own)) == 0,
        "id_number": digits >= 6 and digits + letters >= 8,
        "address": digits >= 1 and letters >= 2,
        "name": digits == 0 and letters >= 2,
    }[kind]
    return [(a, b)] if good else []


def find(texts: list[str | None]) -> list[list[tuple[int, int, str]]]:
    """(start, end, kind) of the personal data of each text, in order."""
    if _state["tagger"] is None:
        _state["tagger"] = Tagger.load(MODEL)
    shaped = shapes([text or "" for text in texts])
    read = [shorten(own) for own in shaped]
    new = list(dict.fromkeys(read))
    known = dict(zip(new, decode(new, _state["tagger"])))
    out = []
    for text, own, part in zip(texts, shaped, read):
        spans = []
        if found := known[part]:
            back, flat = places(own), plain(text)
            spans = reconcile([(s, e, kind) for a, b, kind in found for s, e in confirm(flat, back[a], back[b], kind)])
        out.append(spans)
    return out


def redact(text: str | None, spans: list[tuple[int, int, str]]) -> str | None:
    """The text with each span replaced by the placeholder of its kind and all else unchanged."""
    if not spans:
        return text
    out, at = [], 0
    for a, b, kind in spans:
        out += [text[at:a], PLACEHOLDERS[kind]]
        at = b
    return "".join([*out, text[at:]])


def _found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for key, spans in zip(pdf["id"], find(pdf["text"].tolist())):
            count = dict.fromkeys(KINDS, 0)
            for a, b, kind in spans:
                count[kind] += 1
                rows.append((key, kind, count[kind], a, b))
        yield pd.DataFrame(rows, columns=["id", "kind", "nth", "start", "end"])


def _redacted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        texts = pdf["text"].tolist()
        spans = find(texts)
        yield pd.DataFrame({"id": pdf["id"], "text": [redact(t, s) for t, s in zip(texts, spans)], "n_replaced": [len(s) for s in spans]})


def _narrow(rows: DataFrame, id_column: str, text_column: str) -> tuple[DataFrame, str]:
    out = rows.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    return out, dict(out.dtypes)["id"]


def occurrences(rows: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """id, kind, nth, start, end of all personal data."""
    narrow, kind = _narrow(rows, id_column, text_column)
    return spread(narrow.where("text <> ''")).mapInPandas(_found, f"id {kind}, kind string, nth int, start int, end int")


def redacted(rows: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """id, text with placeholders, n_replaced of all rows."""
    narrow, kind = _narrow(rows, id_column, text_column)
    return spread(narrow).mapInPandas(_redacted, f"id {kind}, text string, n_replaced int")


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    found = occurrences(spark.read.parquet(f"{folder}/documents.parquet"), "doc_id", "text")
    return found.select(F.col("id").alias("doc_id"), "kind", "nth")


def p8_redacted(spark: SparkSession, folder: str) -> DataFrame:
    return redacted(spark.read.parquet(f"{folder}/documents.parquet"), "doc_id", "text").withColumnRenamed("id", "doc_id")
