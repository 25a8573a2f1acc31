"""Markdown tables in documents, and the lookup rows read from them.

A table is a header row, a separator row, and the rows that follow: gaps and islands over the
lines, found in Arrow batches without a shuffle. Lookups are built-in expressions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrand.functions import text as X
from lodestrand.session import spread

# Fixed value: the form of a row.
ROW = re.compile(r"\s*\|(.+)\|\s*")
NONE, BODY, SEPARATOR = range(3)


def cells(line: str) -> list[str]:
    """The cells of a row; none if the line is no row."""
    m = ROW.fullmatch(line)
    return [c.strip() for c in m[1].split("|")] if m else []


def _kind(line: str) -> int:
    own = "".join(cells(line))
    return SEPARATOR if own and not own.strip("-: ") else BODY if ROW.fullmatch(line) else NONE


def tables(text: str | None) -> Iterator[tuple[int, list[str], list[list[str]]]]:
    """(line number, header, rows) of each table.

    Gaps and islands: lines of one kind in a row are an island. A separator line on its own makes the
    island before it end in a header and the one behind it a body, unless that before is a body already.
    """
    lines = (text or "").splitlines()
    islands = [(kind, [k for k, _ in own]) for kind, own in groupby(enumerate(map(_kind, lines)), key=lambda x: x[1])]
    body = -1
    for n, (kind, own) in enumerate(islands):
        if kind == SEPARATOR and len(own) == 1 and 0 <= n - 1 != body and islands[n - 1][0] == BODY:
            follows = islands[n + 1] if n + 1 < len(islands) else (NONE, [])
            body = n + 1 if follows[0] == BODY else -1
            yield own[0], cells(lines[own[0] - 1]), [cells(lines[k]) for k in follows[1]] if body > 0 else []


def _rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [(i, line, n, header, row) for i, t in zip(pdf["doc_id"], pdf["text"]) for line, header, body in tables(t) for n, row in enumerate(body)]
        yield pd.DataFrame(rows, columns=["doc_id", "line", "row", "header", "cells"])


def table_rows(documents: DataFrame) -> DataFrame:
    """doc_id, line, row, header, cells of every row of every table (documents delivered twice count once)."""
    once = documents.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("text").alias("text"))
    return spread(once).mapInPandas(_rows, "doc_id string, line int, row int, header array<string>, cells array<string>")


def _place(name: str) -> Column:
    """The place of a header, from 1, spaces in headers not counting; 0 if there is none."""
    return F.array_position(F.transform("header", lambda h: F.replace(h, F.lit(" "), F.lit(""))), name).cast("int")


def cell(name: str) -> Column:
    """The cell under a header; null if there is none."""
    return F.when(_place(name) > 0, F.try_element_at("cells", _place(name)))


# The header of descriptions, and the form of a code.
DESCRIPTIONS, CODE = ("中文描述",), r"^[PBCU][0-9]{4}$"


def fault_codes(rows: DataFrame, descriptions: tuple[str, ...] = DESCRIPTIONS, code_form: str = CODE) -> DataFrame:
    """doc_id, code, description, module, ftb of the fault tables of both header forms; ranges and other codes are passed over."""
    plain = _place("故障码") > 0
    code = F.coalesce(cell("故障码"), F.when(~plain, cell("DTC")))
    extra = lambda name: F.when(plain, F.lit("")).otherwise(F.coalesce(cell(name), F.lit("")))
    out = rows.select("doc_id", code.alias("code"), F.coalesce(*map(cell, descriptions)).alias("description"), extra("所属模块").alias("module"), extra("FTB").alias("ftb"))
    return out.where(F.col("code").rlike(code_form) & F.col("description").isNotNull())


def maintenance(rows: DataFrame) -> DataFrame:
    """doc_id, item, period, km, months of the tables whose first two headers are 保养项目 and 周期."""
    first = F.transform(F.slice("header", 1, 2), lambda h: F.replace(h, F.lit(" "), F.lit("")))
    own = rows.where(first == F.array(F.lit("保养项目"), F.lit("周期"))).select("doc_id", F.try_element_at("cells", F.lit(1)).alias("item"), F.try_element_at("cells", F.lit(2)).alias("period"))
    km, months = period(F.col("period"))
    return own.where("item <> '' AND period <> ''").select("doc_id", "item", "period", km.alias("km"), months.alias("months"))


# How distances, months and years are written in intervals.
KM, MONTH, YEAR = r"(\d+(?:\.\d+)?)[\s\p{Z}]*(万?)[\s\p{Z}]*(?:km|公里|千米)", r"(\d+(?:\.\d+)?)[\s\p{Z}]*个月", r"(\d+(?:\.\d+)?)[\s\p{Z}]*年"


def period(c: Column) -> tuple[Column, Column]:
    """(km, months) that a maintenance interval states in plain form, in narrow or wide digits; null where it states none."""
    plain = F.translate(c, "０１２３４５６７８９,，", "0123456789")
    number = lambda pattern: F.regexp_extract(plain, pattern, 1).try_cast("double")
    km = number(KM) * F.when(F.regexp_extract(plain, KM, 2) == "万", 10_000).otherwise(1)
    return km.cast("int"), F.coalesce(number(MONTH), number(YEAR) * 12).cast("int")


def keyword_search(rows: DataFrame, word: str, *columns: str) -> DataFrame:
    """The rows that hold a word in one of the columns, letter case of ASCII not counting."""
    found = F.lit(False)
    for c in columns:
        found = found | F.coalesce(F.col(c).ilike(f"%{word}%"), F.lit(False))
    return rows.where(found)


def lookup(rows: DataFrame, asked: DataFrame, code: str = "code", description: str = "description") -> DataFrame:
    """For each word asked: the rows of exactly that code, or else those whose code or description holds it.

    `asked` (word) is the small stated side of both joins.
    """
    wanted = asked.select("word").where("word <> ''").distinct()
    exact = rows.join(F.broadcast(wanted), F.upper(F.col(code)) == F.upper(F.col("word"))).withColumn("how", F.lit("code"))
    rest = wanted.join(exact.select("word").distinct(), "word", "left_anti")
    both = F.concat_ws("\n", code, description)
    like = rows.join(F.broadcast(rest), F.contains(F.lower(both), F.lower(F.col("word")))).withColumn("how", F.lit("keyword"))
    return exact.unionByName(like)


def car_model(c: Column, names: dict[str, str]) -> Column:
    """The standard name of a model: by its name, or its name without spaces, else as it is."""
    out = X.strip(c)
    table = F.create_map(*(F.lit(x) for k, v in {**{k.replace(" ", ""): v for k, v in names.items()}, **names}.items() for x in (k, v)))
    return F.coalesce(F.try_element_at(table, out), F.try_element_at(table, F.regexp_replace(out, " ", "")), out)
