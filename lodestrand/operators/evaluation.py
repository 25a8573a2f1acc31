"""Ranking metrics of retrieval runs, token overlap, grouped summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrand.functions import metrics as M
from lodestrand.functions import text as X
from lodestrand.functions.metrics import mean
from lodestrand.functions.unicode import column, match

# Fixed value: how a truth begins that is still to be written.
OPEN_MARK = "[待补充"


def rank_metrics(hits: DataFrame, k: int = 8) -> DataFrame:
    """query_id, n, relevant, first_rank, rr, precision, ndcg of hits with query_id, rank and flag.

    The ideal ranking counts the relevant hits of the whole list, at most k; ndcg is 0 without any.
    """
    flag = F.col("flag").cast("int")
    gain = F.sum(F.when(F.col("rank") <= k, flag / F.log2(F.col("rank") + 1.0)))
    df = hits.groupBy("query_id").agg(
        F.count("*").alias("n"), F.sum(flag).alias("relevant"), F.min(F.when(flag == 1, F.col("rank"))).alias("first_rank"),
        F.round(F.avg(F.when(F.col("rank") <= k, flag)), 4).alias("precision"), gain.alias("dcg"),
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(F.col("relevant"), F.lit(k)), F.lit(1)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1.0))
    rr = F.when(F.col("first_rank").isNull(), F.lit(0.0)).otherwise(F.round(1 / F.col("first_rank"), 4))
    return df.select("query_id", "n", "relevant", "first_rank", rr.alias("rr"), "precision", F.when(F.col("relevant") > 0, F.round(F.least(F.col("dcg") / ideal, F.lit(1.0)), 4)).otherwise(F.lit(0.0)).alias("ndcg"))


def recall_at(hits: DataFrame, expected: DataFrame, k: int) -> DataFrame:
    """query_id, expected, found, recall: the share of expected ids among the first k hits."""
    got = hits.where(F.col("rank") <= k).select("query_id", "id").distinct()
    both = expected.select("query_id", "id").distinct().join(got.withColumn("hit", F.lit(1)), ["query_id", "id"], "left")
    return both.groupBy("query_id").agg(F.count("*").alias("expected"), F.count("hit").alias("found"), F.round(F.count("hit") / F.count("*"), 4).alias("recall"))


def label_recall(hits: DataFrame, labels: DataFrame) -> DataFrame:
    """query_id, expected, found, recall where all others of a query's label are expected; they are counted, not paired.

    hits: query_id, id. labels: vec_id, label. Queries whose label has no other row are left out.
    """
    a, b = (labels.select(F.col("vec_id").alias(k), F.col("label").alias(f"{k}_label")) for k in ("query_id", "id"))
    sizes = labels.groupBy("label").agg((F.count("*") - 1).alias("expected")).where("expected > 0")
    same = F.coalesce(F.col("query_id_label") == F.col("id_label"), F.lit(False))
    found = hits.join(a, "query_id").join(b, "id").groupBy("query_id", "query_id_label").agg(F.count_if(same).alias("found"))
    return found.join(sizes, found["query_id_label"] == sizes["label"]).select("query_id", "expected", "found", F.round(F.col("found") / F.col("expected"), 4).alias("recall"))


def token_f1(rows: DataFrame, key: str, reference: str, hypothesis: str) -> DataFrame:
    """key, f1 of the multisets of tokens of two texts, commas in numbers not counting; null if one has none."""
    side = lambda c, n: rows.select(key, F.explode(X.tokens(M.number_form(F.col(c)))).alias("token")).groupBy(key, "token").agg(F.count("*").alias(n))
    both = side(reference, "r").join(side(hypothesis, "h"), [key, "token"], "full_outer").groupBy(key)
    df = both.agg(F.sum("r").alias("nr"), F.sum("h").alias("nh"), F.sum(F.least(F.coalesce("r", F.lit(0)), F.coalesce("h", F.lit(0)))).alias("common"))
    f1 = F.when(F.col("nr").isNotNull() & F.col("nh").isNotNull(), F.round(2.0 * F.col("common") / (F.col("nr") + F.col("nh")), 4))
    return rows.select(key).distinct().join(df.select(key, f1.alias("f1")), key, "left")


def distribution(rows: DataFrame, label: Column, name: str = "label") -> DataFrame:
    return rows.groupBy(label.alias(name)).agg(F.count("*").alias("n"))


def repeats(rows: DataFrame, run: str, metrics: list[str]) -> DataFrame:
    """metric, mean, least, most, constant over the runs' values."""
    stacked = rows.unpivot([run], metrics, "metric", "value")
    return stacked.groupBy("metric").agg(F.round(F.avg("value"), 4).alias("mean"), F.round(F.min("value"), 4).alias("least"), F.round(F.max("value"), 4).alias("most"), (F.min("value") == F.max("value")).alias("constant"))


def signal_discrimination(rows: DataFrame, flag: str, weights: dict[str, float]) -> DataFrame:
    """signal, mean over relevant rows, over the others, their difference, and the weighted mean of relevant rows."""
    stacked = rows.unpivot([flag], list(weights), "signal", "value")
    df = stacked.groupBy("signal").agg(mean(F.when(F.col(flag), F.col("value"))).alias("relevant"), mean(F.when(~F.col(flag), F.col("value"))).alias("others"))
    weight = F.create_map(*(F.lit(x) for kv in weights.items() for x in kv))
    return df.select("signal", "relevant", "others", F.round(F.col("relevant") - F.col("others"), 4).alias("difference"), F.round(F.element_at(weight, F.col("signal")) * F.col("relevant"), 4).alias("weighted"))


TEXTS = "array<string>"


def _list(c: str) -> Column:
    return F.coalesce(F.col(c), F.array().cast(TEXTS))


def judge(items: DataFrame, outcomes: DataFrame, k: int = 8) -> DataFrame:
    """One row per item with every metric of its outcome and its failure label.

    items: id, category, ground_truth, must_refuse, expected_sources, expected_snippets,
    expected_keywords. outcomes: id, answer, refused, reason, error, offered (numbers that may be
    cited), retrieved (array of structs source, text, score, best first), attribution (struct total,
    score, supported, weak, unsupported, no_citation, meta_skipped), total_ms. Relevance is by snippet
    where snippets are expected, else by source. An item without an outcome has no metric and is not evaluated.
    """
    both = items.join(outcomes, "id", "left").withColumn("_there", F.col("answer").isNotNull() | F.coalesce("refused", F.lit(False)))
    df = both.withColumn("_sources", M.source_forms(F.col("expected_sources"))).withColumn("_keywords", M.match_forms(_list("expected_keywords")))
    bars = lambda c: F.transform(c, lambda s: F.replace(s, F.lit("|"), F.lit("")))
    df = df.withColumn("_snippets", bars(M.match_forms(_list("expected_snippets")))).withColumn("_answer", F.coalesce(M.match_form(F.col("answer")), F.lit("")))
    # texts are brought to one form outside of the arrays' lambdas, then put back beside their sources
    held = F.coalesce("retrieved", F.array().cast(dict(both.dtypes)["retrieved"]))
    df = df.withColumn("_texts", bars(column(lambda a: [match(x or "") for x in a], TEXTS, F.transform(held, lambda r: r["text"]))))
    df = df.withColumn("_hits", F.zip_with(held, F.col("_texts"), lambda r, t: F.struct(M.source_form(r["source"]).alias("source"), t.alias("text"), r["score"].alias("score"))))
    fits = lambda t: (F.size("_snippets") == 0) | F.exists("_snippets", lambda s: F.contains(t, s))
    df = df.withColumn("_flags", F.transform("_hits", lambda h: (M.source_matches(h["source"], F.col("_sources")) & fits(h["text"])).cast("int")))
    reached = F.filter(F.slice("_hits", 1, k), lambda h: fits(h["text"]))
    found = F.filter("_sources", lambda w: F.exists(reached, lambda h: M.source_matches(h["source"], F.array(w))))
    gain = lambda n: F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1.0))
    relevant = F.aggregate("_flags", F.lit(0), lambda a, x: a + x)
    window = F.slice("_flags", 1, k)
    dcg = F.aggregate(F.transform(window, lambda x, i: x / F.log2(i + 2.0)), F.lit(0.0), lambda a, x: a + x)
    some = (F.size("_sources") > 0) & F.col("_there")
    df = df.withColumn("recall", F.when(some, F.round(F.size(found) / F.size("_sources"), 4))).withColumn("first_rank", F.nullif(F.array_position("_flags", F.lit(1)), F.lit(0)).cast("int"))
    df = df.withColumn("rr", F.when(some, F.coalesce(F.round(1.0 / F.col("first_rank"), 4), F.lit(0.0))))
    df = df.withColumn("ndcg", F.when(some & (F.size("_flags") > 0), F.when(relevant > 0, F.round(F.least(dcg / gain(F.least(relevant, F.lit(k))), F.lit(1.0)), 4)).otherwise(F.lit(0.0))))
    df = df.withColumn("precision", F.when(some & (F.size("_flags") > 0), F.round(F.aggregate(window, F.lit(0.0), lambda a, x: a + x) / F.size(window), 4)))
    df = df.withColumn("coverage", M.keyword_coverage(F.col("_keywords"), F.col("_answer"))).withColumn("substantive", (F.size("_keywords") > 0) & (F.col("coverage") >= M.SUBSTANTIVE))
    df = df.withColumn("must", F.coalesce("must_refuse", F.lit(False))).withColumn("_hard", F.coalesce("refused", F.lit(False))).withColumn("_said", M.is_refusal(F.col("_answer")))
    df = df.withColumn("effective", F.when(F.col("_there"), M.effective_refusal(F.col("must"), F.col("_hard"), F.col("_said"), F.col("substantive"))))
    df = df.withColumn("path", M.refusal_path(F.col("_hard"), F.col("_said"), F.col("substantive")))
    by = F.when(F.col("must") & F.col("effective"), F.when(~F.col("_hard"), "model_soft").when(F.coalesce("reason", F.lit("")) != "", "server_guard").otherwise("server_empty"))
    outside = F.array_except(X.citations(F.coalesce("answer", F.lit(""))), F.coalesce("offered", F.array().cast("array<int>")))
    label = M.failure(F.col("error").isNotNull(), F.col("must"), F.col("effective"), F.size(outside) > 0, F.col("substantive"), F.size("_sources") > 0, F.col("recall"), F.col("first_rank"), F.col("attribution.total"), F.col("attribution.unsupported"), F.col("coverage"))
    level = F.when(F.size("_snippets") > 0, "snippet").otherwise("file")
    shown = ("recall", "first_rank", "rr", "ndcg", "precision", "coverage", "substantive", "effective", "path")
    return df.select(
        "id", "category", "must", *shown, by.alias("refused_by"), outside.alias("outside"), level.alias("level"), label.alias("label"), F.size("_sources").alias("n_sources"), F.size("_keywords").alias("n_keywords"),
        F.array_max(F.transform("_hits", lambda h: h["score"])).alias("top_score"), "attribution", "total_ms", F.col("error").isNotNull().alias("failed"),
    )


def summary(judged: DataFrame, *keys: str) -> DataFrame:
    """Per group of `keys` (one row of all without): counts and means, each metric over its own denominator, null where that is empty."""
    done, judgeable = ~F.col("failed"), (F.col("n_sources") > 0) | (F.col("n_keywords") > 0)
    share = lambda a, b: F.round(F.try_divide(F.count_if(a & b), F.nullif(F.count_if(b), F.lit(0))), 4)
    over = lambda c, b: mean(F.when(b, F.col(c)))
    own, refused = done & (F.col("n_sources") > 0), F.coalesce("effective", F.lit(False))
    clauses = {n: F.sum(F.when(F.col("attribution.total") > 0, F.coalesce(f"attribution.{n}", F.lit(0)))) for n in ("total", "supported", "weak", "unsupported", "no_citation", "meta_skipped")}
    return judged.groupBy(*keys).agg(
        F.count("*").alias("total"), F.count_if(done).alias("completed"), F.count_if(done & judgeable).alias("scored"), F.count_if(own).alias("n_retrieval"), F.count_if(done & F.col("must")).alias("n_refusal"), F.count_if(done & ~F.col("must")).alias("n_answerable"),
        F.count_if(own & F.col("must")).alias("n_overlap"), F.count_if(F.col("level") == "snippet").alias("n_snippet"), F.count_if((F.col("level") == "file") & (F.col("n_sources") > 0)).alias("n_file"),
        share(F.coalesce(F.col("recall") > 0, F.lit(False)), done & judgeable).alias("source_hit_rate"), over("coverage", done & judgeable & ~refused).alias("coverage"), F.round(F.avg(F.when(done, F.col("total_ms"))), 2).alias("mean_ms"),
        *(over(c, own).alias(c) for c in ("recall", "rr", "ndcg", "precision")), F.count_if(done & (F.col("attribution.total") > 0)).alias("n_attributed"), mean(F.when(done & (F.col("attribution.total") > 0), F.col("attribution.score"))).alias("faithfulness"),
        share(refused, done & F.col("must")).alias("refusal_recall"), share(refused, done & ~F.col("must")).alias("over_refusal"), *(F.coalesce(c, F.lit(0)).alias(f"clauses_{n}") for n, c in clauses.items()),
        F.round(F.try_divide(clauses["unsupported"], clauses["total"]), 4).alias("unsupported_ratio"), F.round(F.try_divide(clauses["no_citation"], clauses["total"]), 4).alias("no_citation_ratio"),
    )


def placeholders(items: DataFrame) -> DataFrame:
    """id, field of what an evaluation item leaves open: a truth that begins with the mark, no sources, no keywords."""
    none = lambda c: F.size(_list(c)) == 0
    fields = {"ground_truth": F.startswith(X.strip(F.coalesce("ground_truth", F.lit(""))), F.lit(OPEN_MARK)), "expected_sources": none("expected_sources"), "expected_keywords": none("expected_keywords")}
    return items.select("id", F.explode(F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in fields.items())))).alias("field"))


def load_statistics(calls: DataFrame, key: str, ms: str = "ms", failed: str = "failed", note: str = "note") -> DataFrame:
    """key, n, errors, p50, p95, most over all calls of a load run, ok_p50, ok_p95 over those without error, and the notes' counts.

    A run's calls are its stated probe; percentiles are the values at index round(p (n - 1)), halves to even.
    """
    at = lambda a, p: F.element_at(F.array_sort(a), (F.bround(F.lit(p) * (F.size(a) - 1), 0) + 1).cast("int"))
    own = calls.groupBy(key).agg(F.collect_list(ms).alias("a"), F.collect_list(F.when(~F.col(failed), F.col(ms))).alias("b"), F.count_if(failed).alias("errors"))
    kinds = calls.groupBy(key, F.split_part(F.col(note), F.lit(":"), F.lit(1)).alias("kind")).agg(F.count("*").alias("n")).groupBy(key).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "kind", "n"))), ",").alias("notes"))
    stats = own.select(key, F.size("a").alias("n"), "errors", at(F.col("a"), 0.5).alias("p50"), at(F.col("a"), 0.95).alias("p95"), F.array_max("a").alias("most"), *(F.when(F.size("b") > 0, at(F.col("b"), p)).otherwise(F.lit(0.0)).alias(n) for n, p in (("ok_p50", 0.5), ("ok_p95", 0.95))))
    return stats.join(kinds, key)
