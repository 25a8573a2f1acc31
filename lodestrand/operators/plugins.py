"""Where models plug in, with offline defaults that need none: embedder, second scorer, generator."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrand.functions import text as X
from lodestrand.operators import retrieval


class Embedder(Protocol):
    def __call__(self, rows: DataFrame, text_column: str) -> DataFrame: ...


class Scorer(Protocol):
    def __call__(self, pairs: DataFrame) -> DataFrame: ...


class Generator(Protocol):
    def __call__(self, prompts: DataFrame) -> DataFrame: ...


def hash_embedder(rows: DataFrame, text_column: str) -> DataFrame:
    return retrieval.embed(rows, text_column)


def overlap_scorer(pairs: DataFrame) -> DataFrame:
    """query_id, id, raw: twice the weighted coverage of the query less one, in place of a trained scorer."""
    share = retrieval.coverage(X.tokens(F.col("query")), F.array_distinct(X.tokens(F.col("text"))))
    return pairs.select("query_id", "id", (2 * share - 1).alias("raw"))


def extractive_generator(prompts: DataFrame) -> DataFrame:
    """answer_id, answer: the first sentence of the best passage with its citation, or the fixed refusal.

    prompts: answer_id, passages (array of texts, best first).
    """
    best = F.try_element_at("passages", F.lit(1))
    first = F.try_element_at(X.sentences(best), F.lit(1))
    return prompts.select("answer_id", F.when(F.coalesce(first, F.lit("")) != "", F.concat(first, F.lit(" [1]"))).otherwise(F.lit("当前知识库中未找到相关依据。")).alias("answer"))


def context_block(hits: DataFrame) -> DataFrame:
    """query_id, context: the numbered passages of each query, best first. hits: query_id, rank, source, section, text."""
    line = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.concat_ws(" > ", "source", F.nullif("section", F.lit(""))), F.lit("\n"), F.col("text"))
    listed = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("s"))
    return listed.select("query_id", F.array_join(F.transform("s", lambda s: s["line"]), "\n\n").alias("context"))


def accept_rewrite(question, rewritten):
    """A rewritten question: its first line without quotes if 4 to 200 characters long, else the question."""
    own = F.regexp_replace(X.strip(F.element_at(F.split(X.strip(rewritten), "\n"), 1)), r"^[\"'“”‘’「」]+|[\"'“”‘’「」]+$", "")
    return F.when(F.length(own).between(4, 200), own).otherwise(question)
