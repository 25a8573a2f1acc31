"""What stands between retrieval and an answer: gates, citations, history, cache keys, reflection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrand.functions import text as X

# The least similarity in vector mode, the longest answers in histories, how many turns a rewrite sees.
LEAST_SIMILARITY = 0.05
HISTORY_CHARS, REWRITE_CHARS, REWRITE_TURNS = 200, 120, 3
UNANSWERED = "（上轮未回答）"
REFLECT_TOTAL, REFLECT_SCORE = 4, 0.6


def gate(queries: DataFrame, hits: DataFrame, mode: str = "hybrid", floor: float = 0.01, least: float = LEAST_SIMILARITY) -> DataFrame:
    """query_id, best, reason: why a query is refused before anything is generated, null if it is answered.

    `empty` without hits, `low_evidence` if the best score is below the floor (0 switches that off),
    `low_similarity` in vector mode if the best cosine is below `least`; in other modes cosines are no measure.
    """
    best = hits.groupBy("query_id").agg(F.max(F.coalesce("score", F.lit(0.0))).alias("best"), F.max(F.coalesce("vector_score", F.lit(0.0))).alias("near"))
    weak = (F.col("best") < floor) if floor > 0 else F.lit(False)
    reason = F.when(F.col("best").isNull(), "empty").when(weak, "low_evidence")
    reason = reason.when(F.col("near") < least, "low_similarity") if mode == "vector" else reason
    return queries.select("query_id").distinct().join(best, "query_id", "left").select("query_id", "best", reason.alias("reason"))


def invented(total: Column, unsupported: Column, ratio: float) -> Column:
    """Whether an answer is refused as invented: at least two clauses, two of them unsupported, and that share of all; never for ratio 0."""
    total, unsupported = F.coalesce(total, F.lit(0)), F.coalesce(unsupported, F.lit(0))
    return F.lit(ratio > 0) & (total >= 2) & (unsupported >= 2) & (unsupported / total >= ratio)


def clause_sources(judged: DataFrame, citations: DataFrame) -> DataFrame:
    """answer_id, clause, index, source, section, position, invalid: what each clause cites, in order.

    judged: answer_id, clause, cited. citations: answer_id, index, source, section, position. An index
    that was never offered is `invalid`, with empty fields; clauses without citations have no row.
    """
    each = judged.select("answer_id", "clause", F.posexplode("cited").alias("nth", "index"))
    offered = citations.select("answer_id", "index", "source", "section", "position").dropDuplicates(["answer_id", "index"]).withColumn("_known", F.lit(True))
    out = each.join(offered, ["answer_id", "index"], "left")
    return out.select("answer_id", "clause", "nth", "index", *(F.coalesce(c, F.lit("")).alias(c) for c in ("source", "section")), F.coalesce("position", F.lit(0)).alias("position"), F.col("_known").isNull().alias("invalid"))


def cacheable(session: Column, debug: Column) -> Column:
    """Answers within a session depend on its history, and debugging measures: neither is cached."""
    return (F.coalesce(session, F.lit("")) == "") & ~F.coalesce(debug, F.lit(False))


def cache_key(version: Column, mode: Column, k: Column, question: Column) -> Column:
    """The key of an answer: another index version, mode or k is another entry."""
    part = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    return F.concat_ws("|", part("v", version), F.coalesce(F.nullif(mode, F.lit("")), F.lit("auto")), part("k", k), X.strip(F.coalesce(question, F.lit(""))))


def _lines(turns: DataFrame, chars: int) -> DataFrame:
    """session_id, back and the lines of each turn with a question: refused ones are marked, answers cut."""
    asked, said = X.strip(F.coalesce("question", F.lit(""))), X.strip(F.coalesce("answer", F.lit("")))
    line = F.concat(F.lit("问："), asked, F.when(F.coalesce("refused", F.lit(False)), UNANSWERED).otherwise(""))
    reply = F.when(said != "", F.concat(F.lit("\n答："), F.substring(said, 1, chars), F.when(F.length(said) > chars, "…").otherwise("")))
    return turns.where(asked != "").select("session_id", F.struct((-F.col("back")).alias("k"), F.concat(line, F.coalesce(reply, F.lit(""))).alias("line")).alias("s"))


def history_block(turns: DataFrame, chars: int = HISTORY_CHARS) -> DataFrame:
    """session_id, block of the turns handed over (session_id, back counting from 1, question, answer, refused), oldest first."""
    return _lines(turns, chars).groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["line"]), "\n").alias("block"))


def rewrite_block(turns: DataFrame) -> DataFrame:
    """The same of the last turns only, more shortly: what a rewrite of the next question sees."""
    return history_block(turns.where(F.col("back") <= REWRITE_TURNS), REWRITE_CHARS)


def reflection(report: DataFrame, attempts: Column, most: int = 1) -> Column:
    """pass or retry of a drafted answer: retried if a clause is unsupported, or its score is low over enough clauses, while attempts are left."""
    poor = (F.col("unsupported") > 0) | ((F.col("total") >= REFLECT_TOTAL) & (F.col("score") < REFLECT_SCORE))
    return F.when(poor & (attempts < most), "retry").otherwise("pass")
