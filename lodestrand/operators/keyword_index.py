"""BM25 recall of many queries at once.

Only the queries' own terms matter, so a first pass counts in how many documents each of them
occurs, in built-in expressions. The second pass scores: joining postings with queries would emit
a row for every shared term of every pair, so each Arrow batch of documents becomes a matrix over
the query terms instead, its product with the queries' weights gives all scores of the batch, and
only the best k per query and batch leave the worker. Queries are taken in blocks of QUERY_BLOCK
with at most about TERM_LIMIT terms each, so that what is broadcast is bounded.

score = sum over query terms, repeats counting, of w * idf * tf * (k1 + 1) / (tf + K), with w 0.3
for a single Han character; multiplied by 1.3 for each of up to three query phrases that the raw
text holds. Of the best k those below 0.15 of the best score are dropped. Ties go to the lesser id.
Documents without a token are no part of the index; queries without one find nothing.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrand.functions import text as X
from lodestrand.operators.bounded import MOST_ROWS, small
from lodestrand.session import cut, spread
from lodestrand.sources.store import Table

# Fixed values of the ranking function.
K1, B, FLOOR, PHRASE, SINGLE = 1.5, 0.75, 0.15, 1.3, 0.3
QUERY_BLOCK, TERM_LIMIT = 512, 20_000
HAN = re.compile(r"[一-鿿]+")
WORD = re.compile(r"[a-z0-9]+")


def terms(text: str) -> list[str]:
    """The same tokens as `functions.text.tokens`, for workers."""
    low, out = text.lower(), []
    for run in HAN.findall(low):
        out += run
        out += [run[i : i + 2] for i in range(len(run) - 1)]
    return out + [w for w in WORD.findall(low) if len(w) > 1 or w.isdigit()]


def postings(documents: DataFrame, id_column: str, index_text) -> DataFrame:
    """id, token, tf, length of every document and token."""
    rows = documents.select(F.col(id_column).alias("id"), X.tokens(index_text).alias("tokens")).where(F.size("tokens") > 0)
    return rows.select("id", F.size("tokens").alias("length"), F.explode("tokens").alias("token")).groupBy("id", "length", "token").agg(F.count("*").alias("tf"))


def frequencies(documents: DataFrame, id_column: str, index_text) -> DataFrame:
    """token, df, idf over all documents that have tokens."""
    rows = documents.select(X.tokens(index_text).alias("tokens")).where(F.size("tokens") > 0)
    n = rows.agg(F.count("*").alias("n"))
    df = rows.select(F.explode(F.array_distinct("tokens")).alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    return df.join(F.broadcast(n)).select("token", "df", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))


def _score(shared, k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary, weights, phrases, average, ids = shared.value
        for pdf in batches:
            rows, cols, values, kept = [], [], [], []
            for at, text in enumerate(pdf["index_text"]):
                own = terms(text)
                if not own:
                    continue
                floor = K1 * (1 - B + B * len(own) / average)
                for term, tf in Counter(own).items():
                    if (col := vocabulary.get(term)) is not None:
                        rows.append(len(kept))
                        cols.append(col)
                        values.append(tf * (K1 + 1) / (tf + floor))
                kept.append(at)
            if not kept:
                continue
            raw, key = pdf["text"].to_numpy()[kept], pdf["id"].to_numpy()[kept]
            out = []
            step = max(1, 8_000_000 // max(1, len(vocabulary)))
            rows, cols, values = np.array(rows, np.int64), np.array(cols, np.int64), np.array(values)
            for low in range(0, len(kept), step):
                high = min(low + step, len(kept))
                m = np.zeros((high - low, len(vocabulary)))
                at = (rows >= low) & (rows < high)
                m[rows[at] - low, cols[at]] = values[at]
                score = m @ weights
                for q, own in enumerate(phrases):
                    s = score[:, q]
                    # phrases multiply a score by at most PHRASE ** 3: what is too far below the k-th best can't reach it
                    least = np.partition(s, -k)[-k] / PHRASE**3 if len(s) > k else 0.0
                    found = np.flatnonzero((s > 0) & (s >= least))
                    for d in found if own else ():
                        text = raw[low + d]
                        if hits := sum(p in text for p in own):
                            s[d] *= PHRASE ** min(hits, 3)
                    if len(found) > k:
                        found = found[np.lexsort((key[low:high][found], -np.round(s[found], 6)))[:k]]
                    out += [(ids[q], key[low + d], s[d]) for d in found]
            yield pd.DataFrame(out, columns=["query_id", "id", "score"])

    return run


def _counted(shared):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, place = shared.value
        df, size = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        for pdf in batches:
            for own in map(terms, pdf["index_text"]):
                if own:
                    at = [k for t in {"", *own} if (k := place.get(t)) is not None]
                    df[at] += 1
                    size[at] += len(own)
        if len(at := np.flatnonzero(df)):
            yield pd.DataFrame({"token": np.array([words[k] for k in at], object), "df": df[at], "size": size[at]})

    return run


def _term_counts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """token, df, size (tokens of the documents that have it) of the wanted tokens and, as the token '', of all.

    Up to MOST_ROWS tokens are sent to the workers, which count them in one pass and give one row per
    token and partition; more meet the documents' tokens in a shuffled join. The counts are the same.
    """
    few = wanted.limit(MOST_ROWS + 1).collect()
    if len(few) <= MOST_ROWS:
        words = ["", *sorted(r["token"] for r in few)]
        shared = docs.sparkSession.sparkContext.broadcast((words, {w: k for k, w in enumerate(words)}))
        each = docs.select("index_text").mapInPandas(_counted(shared), "token string, df long, size long")
        return each.groupBy("token").agg(F.sum("df").alias("df"), F.sum("size").alias("size"))
    tokens = docs.select(X.tokens(F.col("index_text")).alias("tokens")).where(F.size("tokens") > 0)
    each = tokens.select(F.size("tokens").alias("size"), F.explode(F.array_append(F.array_distinct("tokens"), F.lit(""))).alias("token"))
    both = wanted.unionByName(docs.sparkSession.createDataFrame([("",)], "token string"))
    return each.join(both, "token").groupBy("token").agg(F.count("*").alias("df"), F.sum("size").alias("size"))


def search(documents: DataFrame, queries: DataFrame, k: int, id_column: str = "doc_id", text_column: str = "text", context: tuple = (), query_id: str = "item_id", query_text: str = "text") -> DataFrame:
    """query_id, id, score, rank of the best documents of each query."""
    spark = documents.sparkSession
    rows = spread(documents.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"), F.array(*context).cast("array<string>").alias("context")).where("id IS NOT NULL AND text IS NOT NULL"))
    index_text = X.context_text(F.col("text"), *(F.col("context")[k] for k in range(len(context))))
    docs = rows.select("id", "text", index_text.alias("index_text"))
    asked = queries.select(F.col(query_id).alias("q"), F.col(query_text).alias("t"), X.phrases(F.col(query_text)).alias("p")).where("q IS NOT NULL AND t IS NOT NULL")
    kinds = dict(docs.dtypes)["id"], dict(asked.dtypes)["q"]
    schema = f"query_id {kinds[1]}, id {kinds[0]}, score double"
    wanted = cut(asked.select(F.explode(X.tokens(F.col("t"))).alias("token")).distinct())
    counts = cut(_term_counts(docs, wanted))
    n, total = counts.where("token = ''").select("df", "size").first() or (0, 0)
    average = total / n if n else 1.0
    many, size = asked.agg(F.count("*"), F.sum(F.size(X.tokens(F.col("t"))))).first()
    blocks = max(1, math.ceil(many / QUERY_BLOCK), math.ceil((size or 0) / TERM_LIMIT))
    out = None
    for block in range(blocks):
        part = sorted(asked.where(F.pmod(F.hash("q"), F.lit(blocks)) == block).collect(), key=lambda r: r["q"])
        asked_terms = {t for r in part for t in terms(r["t"])}
        if not part or not n or not asked_terms:
            continue
        own = spark.createDataFrame([(t,) for t in asked_terms], "token string")
        df = {r["token"]: r["df"] for r in counts.join(F.broadcast(own), "token").collect()}
        vocabulary = {t: c for c, t in enumerate(sorted(df))}
        weights = np.zeros((len(vocabulary), len(part)))
        for c, r in enumerate(part):
            for t, times in Counter(terms(r["t"])).items():
                if t in vocabulary:
                    idf = math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5))
                    weights[vocabulary[t], c] = times * idf * (SINGLE if len(t) == 1 and HAN.match(t) else 1.0)
        shared = spark.sparkContext.broadcast((vocabulary, weights, [list(r["p"]) for r in part], average, [r["q"] for r in part]))
        found = docs.mapInPandas(_score(shared, k), schema)
        out = found if out is None else out.unionAll(found)
    if out is None:
        return spark.createDataFrame([], f"{schema}, rank int")
    ranked = out.withColumn("score", F.round("score", 6)).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)
    best = F.max("score").over(Window.partitionBy("query_id"))
    return ranked.withColumn("best", best).where(F.col("score") >= FLOOR * F.col("best")).drop("best")


def search_postings(stored: DataFrame, frequency: DataFrame, queries: DataFrame, k: int, query_id: str = "item_id", query_text: str = "text", average: float | None = None) -> DataFrame:
    """query_id, id, score, rank from postings and frequencies of at least the queries' tokens, without phrases.

    The postings meet the queries in a join, so this is for few or short queries against a large
    stored index, `search` for many at once. `average` is the mean length of the documents, else
    taken from the postings, which then must be all there are.
    """
    asked = queries.select(F.col(query_id).alias("query_id"), F.explode(X.tokens(F.col(query_text))).alias("token")).groupBy("query_id", "token").agg(F.count("*").alias("times"))
    weight = F.when((F.length("token") == 1) & F.col("token").rlike(X.HAN), F.lit(SINGLE)).otherwise(F.lit(1.0))
    asked = small(asked.join(frequency.select("token", "idf"), "token").select("query_id", "token", (F.col("times") * F.col("idf") * weight).alias("w")))
    if average is None:
        average = stored.select("id", "length").distinct().agg(F.avg("length")).first()[0] or 1.0
    part = F.col("w") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / average))
    scored = stored.join(asked, "token").groupBy("query_id", "id").agg(F.round(F.sum(part), 6).alias("score"))
    w = Window.partitionBy("query_id")
    ranked = scored.withColumn("rank", F.row_number().over(w.orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)
    return ranked.withColumn("best", F.max("score").over(w)).where(F.col("score") >= FLOOR * F.col("best")).drop("best")


class StoredIndex:
    """An index on disk: postings in buckets by token, and each document's length and tokens in buckets by id.

    An update replaces the postings of its documents and touches only the buckets of their old and new
    tokens; a search reads only the buckets of the queries' tokens and the documents' lengths.
    """

    def __init__(self, spark: SparkSession, folder: str, id_type: str = "string", buckets: int = 256):
        self.postings = Table(spark, f"{folder}/postings", f"token string, id {id_type}, tf long, length int", ["token"], buckets)
        self.documents = Table(spark, f"{folder}/documents", f"id {id_type}, length int, tokens array<string>", ["id"], buckets)

    def update(self, rows: DataFrame, id_column: str, index_text) -> None:
        """Puts documents in, in place of those of the same ids; documents without a token go."""
        given = rows.select(F.col(id_column).alias("id"), X.tokens(index_text).alias("all")).where("id IS NOT NULL")
        given = cut(given.groupBy("id").agg(F.max("all").alias("all")))
        self._drop(given.select("id"))
        new = given.where(F.size("all") > 0)
        counts = new.select("id", F.size("all").alias("length"), F.explode("all").alias("token")).groupBy("token", "id", "length").agg(F.count("*").alias("tf"))
        self.postings.append(counts)
        self.documents.upsert(new.select("id", F.size("all").alias("length"), F.array_distinct("all").alias("tokens")), ["id"])

    def remove(self, ids: DataFrame) -> int:
        """Takes documents (id) out; gives how many they were."""
        gone = cut(ids.select("id").distinct())
        self._drop(gone)
        return self.documents.delete(gone, ["id"])

    def _drop(self, ids: DataFrame) -> None:
        known = self.documents.read(self.documents.buckets_of(ids, ["id"])).join(ids, "id", "left_semi")
        self.postings.delete(known.select("id", F.explode("tokens").alias("token")), ["token", "id"])

    def search(self, queries: DataFrame, k: int, query_id: str = "item_id", query_text: str = "text") -> DataFrame:
        """query_id, id, score, rank of the best documents of each query, without phrases."""
        wanted = small(cut(queries.select(F.explode(X.tokens(F.col(query_text))).alias("token")).distinct()))
        own = self.postings.read(self.postings.buckets_of(wanted, ["token"])).join(wanted, "token")
        n, average = self.documents.read().agg(F.count("*"), F.avg("length")).first()
        idf = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        frequency = own.groupBy("token").agg(F.count("*").alias("df")).select("token", "df", idf.alias("idf"))
        return search_postings(own, frequency, queries, k, query_id, query_text, average or 1.0)
