"""Audits of documents before they are published: secrets, risky wordings, annotation lint."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrand.functions import text as X
from lodestrand.functions.metrics import snippet_form
from lodestrand.session import spread

# Forms of secrets; words that show a disclaimer; words of law, which excuse risks of the middle level.
SECRETS = {"api_key": r"sk-[A-Za-z0-9]{16,}", "cloud_key": r"AKIA[0-9A-Z]{16}", "token": r"ghp_[A-Za-z0-9]{20,}"}
DISCLAIMERS = ("虚构", "示例", "自编", "不对应任何", "不代表任何", "不包含任何", "仅用于", "仅用于演示", "可自由使用", "请勿用于", "演示数据", "构造")
LAW = ("三包规定", "修理更换退货责任规定", "gov.cn", "国务院", "市场监管总局")
LEVELS = ("高", "中", "低")
#: Wordings of risk with their level. Names of makers and platforms are the caller's to add.
RISKS = ((r"授权服务站内部|厂家内部|内部维修资料|禁止外传|仅限内部|机密|confidential|internal use only|nur für den internen", "高"), (r"转载自|摘自.{0,12}(码表|手册|资料)", "中"), (r"\.pdf\b|\.docx?\b|扫描件|水印", "低"))
AROUND = 120


def secrets(rows: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """id and a flag per kind of secret, for rows that hold one."""
    df = rows.select(F.col(id_column), *(F.coalesce(F.col(text_column).rlike(p), F.lit(False)).alias(n) for n, p in SECRETS.items()))
    return df.where(" OR ".join(SECRETS))


def excused(hits: np.ndarray, marks: np.ndarray, around: int = AROUND) -> np.ndarray:
    """Which of the hits (start, end) have a mark (start, end) wholly within `around` characters of them.

    Marks are in the order of their starts: of those that start late enough, the one that ends first decides.
    """
    if not len(marks):
        return np.zeros(len(hits), bool)
    ends = np.r_[np.minimum.accumulate(marks[::-1, 1])[::-1], np.iinfo(np.int64).max]
    return ends[np.searchsorted(marks[:, 0], hits[:, 0] - around)] <= hits[:, 1] + around


def _spans(pattern: re.Pattern, text: str) -> np.ndarray:
    return np.array([m.span(m.lastindex or 0) for m in pattern.finditer(text)], np.int64).reshape(-1, 2)


def _risks(patterns: tuple):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wanted = [re.compile(f"({p})", re.I) for p, _ in patterns]
        marks = re.compile(f"(?=({'|'.join(map(re.escape, sorted(DISCLAIMERS, key=len)))}))")  # overlapping ones, too
        law = re.compile("|".join(map(re.escape, LAW)))
        for pdf in batches:
            rows = []
            for key, text in zip(pdf["id"], pdf["text"]):
                near, lawful = _spans(marks, text), bool(law.search(text))
                for n, pattern in enumerate(wanted):
                    hits = np.array([m.span() for m in pattern.finditer(text)], np.int64).reshape(-1, 2)
                    if len(bare := hits[~excused(hits, near)]) and not (lawful and patterns[n][1] == LEVELS[1]):
                        rows.append((key, n, patterns[n][1], int(bare[0, 0])))
            yield pd.DataFrame(rows, columns=["id", "pattern", "level", "start"])

    return run


def risks(rows: DataFrame, id_column: str, text_column: str, patterns: tuple = RISKS) -> DataFrame:
    """id, pattern, level, start of the first hit of each risk pattern (regular expression, level) that no disclaimer stands near; whole texts are read."""
    narrow = rows.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    kind = dict(narrow.dtypes)["id"]
    return spread(narrow).mapInPandas(_risks(patterns), f"id {kind}, pattern int, level string, start int")


def snippet_lint(items: DataFrame, documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """id, nth, name, in_document, in_chunk of every annotated snippet: whether its source and a chunk of it hold it.

    items: id, expected_sources, expected_snippets. The join is on the file's name, containment, in
    the form of snippets (NFKC, no commas in numbers, white space or bars), is tested within it.
    """
    snippets = items.select("id", F.explode("expected_sources").alias("want"), "expected_snippets").select("id", X.file_name(F.col("want")).alias("name"), F.posexplode("expected_snippets").alias("nth", "snippet")).where("snippet <> ''").distinct()
    snippets = snippets.withColumn("snippet", snippet_form(F.col("snippet")))

    def held(df: DataFrame, name: str) -> DataFrame:
        texts = df.select(X.file_name(F.col("source")).alias("name"), "text").where("text IS NOT NULL").distinct().select("name", snippet_form(F.col("text")).alias("t"))
        return snippets.join(texts, "name").groupBy("id", "name", "nth").agg(F.max(F.contains("t", "snippet")).alias(name))

    out = snippets.join(held(documents, "in_document"), ["id", "name", "nth"], "left").join(held(chunks, "in_chunk"), ["id", "name", "nth"], "left")
    return out.select("id", "nth", "name", F.coalesce("in_document", F.lit(False)).alias("in_document"), F.coalesce("in_chunk", F.lit(False)).alias("in_chunk"))


def mislabelled(chunks: DataFrame) -> DataFrame:
    """Chunks that begin with a rule line, a sign that their section is the one before."""
    return chunks.where(X.strip(F.col("text")).rlike(r"^(?:---|\*\*\*)")).select("chunk_id", "section")


def anchor_impact(anchors: DataFrame, changed: DataFrame) -> DataFrame:
    """path, page, state of changed files: affected (a page is bound to it), broken (deleted but bound), uncovered.

    anchors: page, path. changed: path, deleted.
    """
    both = changed.join(anchors, "path", "left")
    state = F.when(F.col("page").isNull(), "uncovered").when(F.col("deleted"), "broken").otherwise("affected")
    return both.select("path", "page", state.alias("state"))
