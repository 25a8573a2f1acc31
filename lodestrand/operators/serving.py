"""Sessions, caches and request metrics over recorded events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrand.operators.bounded import small
from lodestrand.operators.ordering import running

# The ring buffers' sizes.
TURNS, CONTEXT_TURNS, RECORDS = 6, 3, 1000


def percentile(sorted_values: Column, n: Column, p: float) -> Column:
    """The value at index round(p (n - 1)), halves to even, of a sorted array."""
    return F.element_at(sorted_values, (F.bround(F.lit(p) * (n - 1), 0) + 1).cast("int"))


def request_metrics(requests: DataFrame, endpoint: str = "event_type", value: str = "value") -> DataFrame:
    """endpoint, n, p50, p95, p99, most of each endpoint, and of all as 'overall'.

    Values are counted first; running sums of the counts over a range-partitioned order then tell
    at which value a rank is reached, so no endpoint's values are sorted or gathered in one task.
    """
    both = F.explode(F.array(F.coalesce(endpoint, F.lit("(none)")), F.lit("overall")))
    counted = requests.where(F.col(value).isNotNull()).select(F.col(value).alias("v"), both.alias("endpoint")).groupBy("endpoint", "v").agg(F.count("*").alias("c"))
    run = running(counted, ["endpoint", "v"], "c", "upto")
    whole = small(run.groupBy("endpoint").agg(F.sum("c").alias("n"), F.min(F.col("upto") - F.col("c")).alias("before")))
    at = lambda p: F.bround(F.lit(p) * (F.col("n") - 1), 0)
    point = lambda p: F.min(F.when(F.col("upto") - F.col("before") > at(p), F.col("v")))
    return run.join(whole, "endpoint").groupBy("endpoint").agg(F.max("n").alias("n"), point(0.5).alias("p50"), point(0.95).alias("p95"), point(0.99).alias("p99"), F.max("v").alias("most"))


def request_rates(requests: DataFrame, prompt_price: float | None = None, completion_price: float | None = None) -> DataFrame:
    """One row: count, window, rates of hits, refusals and errors, tokens and, with both prices per million, the cost; rates of no request are null.

    requests: ts, cache_hit, refused, error (boolean), prompt_tokens, completion_tokens (null or 0 without usage).
    """
    n = F.count("*")
    rate = lambda c: F.round(F.try_divide(F.count_if(F.coalesce(c, F.lit(False))), n), 4)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    prompt, completion = total("prompt_tokens"), total("completion_tokens")
    priced = bool(prompt_price) and bool(completion_price)
    cost = F.round(prompt / 1e6 * prompt_price + completion / 1e6 * completion_price, 4) if priced else F.lit(None).cast("double")
    used = (F.coalesce("prompt_tokens", F.lit(0)) > 0) | (F.coalesce("completion_tokens", F.lit(0)) > 0)
    return requests.agg(
        n.alias("n"), F.min("ts").alias("since"), F.max("ts").alias("until"), rate("cache_hit").alias("cache_hit_rate"), rate("refused").alias("refusal_rate"), rate("error").alias("error_rate"),
        prompt.alias("prompt_tokens"), completion.alias("completion_tokens"), (prompt + completion).alias("total_tokens"), F.count_if(used).alias("n_with_usage"), cost.alias("cost"),
    )


def last_turns(turns: DataFrame, most: int = TURNS, session: str = "session_id", turn: str = "turn") -> DataFrame:
    """The latest turns of each session, `back` counting from 1; `in_context` those handed to the next question."""
    back = F.row_number().over(Window.partitionBy(session).orderBy(F.col(turn).desc_nulls_last(), F.desc("id")))
    return turns.where(F.col(session).isNotNull()).withColumn("back", back).where(F.col("back") <= most).withColumn("in_context", F.col("back") <= CONTEXT_TURNS)


def history(turns: DataFrame, session: str = "session_id") -> DataFrame:
    """One text per session of its turns in context, answers cut to 200 characters."""
    line = F.concat(F.lit("Q: "), F.coalesce("question", F.lit("")), F.lit("\nA: "), F.substring(F.coalesce("ground_truth", F.lit("")), 1, 200))
    own = last_turns(turns).where("in_context").select(session, F.struct((-F.col("back")).alias("k"), line.alias("line")).alias("s"))
    return own.groupBy(session).agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["line"]), "\n").alias("history"))


def ring(records: DataFrame, order: list, most: int = RECORDS) -> tuple[DataFrame, int]:
    """The latest `most` records, and how many were dropped. A top-k, not a global sort."""
    n = records.count()
    return records.orderBy(*order).limit(most), max(0, n - most)


def _walk(ttl: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, since = None, 0
        for pdf in batches:
            hits = []
            for run_of in zip(pdf["key"], pdf["run"], pdf["t"]):
                hit = run_of[:2] == at and run_of[2] - since < ttl
                if not hit:
                    at, since = run_of[:2], run_of[2]
                hits.append(hit)
            yield pd.DataFrame({"key": pdf["key"], "order": pdf["order"], "hit": hits})

    return run


def cache_replay(requests: DataFrame, key: str, time: str, order: str, ttl_seconds: int = 3600) -> DataFrame:
    """Each request with `hit`: whether an entry of its key, stored less than the time to live before, was there.

    An entry is stored by a miss; a hit doesn't renew it. So whether a request hits depends on the
    last miss before it, a chain that can't be told from any window of fixed size. It breaks at
    gaps of a time to live, which split a hot key into runs; each partition then walks its sorted
    rows once, holding no more than the last miss.
    """
    w = Window.partitionBy("key").orderBy("t", "order")
    rows = requests.select(F.col(key).cast("string").alias("key"), F.col(time).cast("long").alias("t"), F.col(order).alias("order")).where("key IS NOT NULL AND t IS NOT NULL")
    gap = F.coalesce(F.col("t") - F.lag("t").over(w) >= ttl_seconds, F.lit(True))
    runs = rows.withColumn("run", F.sum(gap.cast("int")).over(w))
    placed = runs.repartition("key", "run").sortWithinPartitions("key", "run", "t", "order")
    kind = dict(requests.dtypes)[order]
    return placed.mapInPandas(_walk(ttl_seconds), f"key string, order {kind}, hit boolean").select(F.col("key").alias(key), F.col("order").alias(order), "hit")


def dedupe(rows: DataFrame, keys: list, order: list) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def evicted(turns: DataFrame, cap: int = 512, session: str = "session_id", order: str = "id") -> DataFrame:
    """The sessions that a store of at most `cap` sessions has dropped, the earliest begun first: all but a top-k."""
    begun = turns.where(F.col(session).isNotNull()).groupBy(session).agg(F.min(order).alias("begun"))
    kept = begun.orderBy(F.desc("begun"), F.desc(session)).limit(cap)
    return begun.join(kept.select(session), session, "left_anti")
