"""Splitting oversized texts at natural boundaries with a fixed overlap.

A text is cut into sections at its headings. A section over the limit is taken apart by a
hierarchy of separators, paragraph, line, sentence, word, character, going down only where a part
is still too long, and the parts are packed greedily into pieces of at most `limit` code points.
Every piece after the first of a section starts `overlap` code points before the end of the one
before. Pieces are slices of the text as stored, so char_start and char_end are exact, and the
pieces of a section without their overlaps give the section again.

Defined results: null, empty and short texts (at most `limit`) give no piece, as they need none.
A text is split whole, whatever its length. Equal rows count once; rows without an id are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.session import spread

LIMIT, OVERLAP = 600, 80

HEADING = re.compile(
    r"^[ \t]{0,3}(?:(?P<marks>#{1,6})[ \t]+(?P<hashed>[^\r\n]+?)[ \t#]*"
    r"|(?P<numbered>(?:第[0-9一二三四五六七八九十百]+[章节条部篇]|[0-9]+(?:\.[0-9]+)+\.?|[一二三四五六七八九十]+、|§[ ]?[0-9]+|(?:Kapitel|Abschnitt|Chapter|Section)[ ][0-9.]+:?)[ \t][^\r\n]{1,60}?)[ \t]*"
    r"|(?P<under>[^\r\n|]{1,80}?)[ \t]*\r?\n[ \t]{0,3}(?:={3,}|-{3,})[ \t]*)(?=\r?\n|\Z)",
    re.M,
)
#: Ends of parts, from large to small: the match belongs to the part before it.
SEPARATORS = (
    re.compile(r"(?:\r?\n[ \t]*){2,}|\r{2,}"),
    re.compile(r"\r?\n|\r"),
    re.compile(r"[。！？；!?;…]+[”’\"')）」』]*\s*|(?<=[^\s\d])\.[”\"')]*\s+|(?<=\d)\.\s+(?=[A-ZÄÖÜ])"),
    re.compile(r"\s+|[，、,：:]\s*"),
)


def sections(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, path of headings) of each section; a heading belongs to the section it opens."""
    start, path, stack = 0, "", []
    for m in HEADING.finditer(text):
        if m["hashed"]:
            level, title = len(m["marks"]), m["hashed"]
        elif m["under"]:
            level, title = 1, m["under"].strip()
            if not title or title[0] in "-=|":
                continue
        else:
            level, title = 2 + m["numbered"].split()[0].count(".") if m["numbered"][0].isdigit() else 2, m["numbered"]
        if m.start() > start and text[start : m.start()].strip():
            yield start, m.start(), path
            start = m.start()
        while stack and stack[-1][0] >= level:
            stack.pop()
        stack.append((level, title.strip()))
        path = " > ".join(t for _, t in stack)
    if start < len(text):
        yield start, len(text), path


def _character_ends(text: str, start: int, end: int, room: int) -> Iterator[int]:
    """Cuts every `room` code points, moved left where a mark or a joiner would lose its base."""
    while end - start > room:
        cut = start + room
        while cut > start + 1 and (unicodedata.combining(text[cut]) or text[cut] in "️‍" or text[cut - 1] == "‍" or text[cut - 1 : cut + 1] == "\r\n"):
            cut -= 1
        yield cut
        start = cut
    yield end


def ends(text: str, start: int, end: int, room: int, level: int = 0) -> Iterator[int]:
    """Where the parts of text[start:end] end, none longer than `room`, cut as high in the hierarchy as can be."""
    if end - start <= room:
        yield end
    elif level == len(SEPARATORS):
        yield from _character_ends(text, start, end, room)
    else:
        for m in SEPARATORS[level].finditer(text, start, end):
            if start < m.end() < end:
                yield from ends(text, start, m.end(), room, level + 1)
                start = m.end()
        yield from ends(text, start, end, room, level + 1)


def pieces(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, str]]:
    """(start, end, section) of the pieces of a text, in order."""
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be less than the limit")
    out = []
    for start, stop, path in sections(text):
        at = done = start
        for end in ends(text, start, stop, limit - overlap) if stop - start > limit else (stop,):
            if end - at > limit:
                out.append((at, done, path))
                at = done - overlap
            done = end
        out.append((at, done, path))
    return out


def _split(limit: int, overlap: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for key, text, base in zip(pdf["item_id"], pdf["text"], pdf["base"]):
                for k, (a, b, path) in enumerate(pieces(text, limit, overlap)):
                    rows.append((key, k, " > ".join(x for x in (base, path) if x), a, b, text[a:b]))
            yield pd.DataFrame(rows, columns=["item_id", "piece", "section", "char_start", "char_end", "text"])

    return run


def split(rows: DataFrame, id_column: str, text_column: str, section_column: str | None = None, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """item_id, piece, section, char_start, char_end, text of all pieces of the texts over the limit; rows delivered twice give theirs twice."""
    base = F.coalesce(F.trim(F.col(section_column)), F.lit("")) if section_column else F.lit("")
    long = rows.select(F.col(id_column).alias("item_id"), F.col(text_column).alias("text"), base.alias("base")).where(F.col("item_id").isNotNull() & (F.length("text") > limit))
    kind = dict(long.dtypes)["item_id"]
    return spread(long).mapInPandas(_split(limit, overlap), f"item_id {kind}, piece int, section string, char_start int, char_end int, text string")


def _pieces(spark: SparkSession, folder: str) -> DataFrame:
    documents = split(spark.read.parquet(f"{folder}/source_document.parquet"), "doc_id", "text")
    chunks = split(spark.read.parquet(f"{folder}/chunk.parquet"), "chunk_id", "text", "section")
    return documents.select(F.lit("source_document").alias("item_kind"), "*").unionByName(chunks.select(F.lit("chunk").alias("item_kind"), "*"))


def p5_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return _pieces(spark, folder).distinct()


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """The items the operator took apart: those with a second piece."""
    return _pieces(spark, folder).where("piece = 1").select("item_kind", "item_id").distinct()


P5_FOUND_SQL = """
SELECT DISTINCT 'source_document' AS item_kind, doc_id AS item_id FROM source_document WHERE length(text) > 600
UNION ALL
SELECT DISTINCT 'chunk' AS item_kind, chunk_id AS item_id FROM chunk WHERE length(text) > 600
"""
