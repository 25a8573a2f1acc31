"""Vector recall, fusion of recall lists, and reranking by transparent signals."""

from __future__ import annotations

import hashlib
import random
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrand.functions import text as X
from lodestrand.session import spread

# Rank fusion and the weights of the rerank signals.
RRF_K, VECTOR_WEIGHT, KEYWORD_WEIGHT = 60, 1.0, 0.8
SIGNALS = {"fusion": 0.54, "coverage": 0.12, "precision": 0.12, "cjk": 0.08, "section": 0.08, "phrase": 0.06}
SINGLE = 0.25
VECTOR_BLOCK = 2_048


def _unit(m: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norm > 0, norm, 1)


def _nearest(blocks: list, k: int):
    """Every batch of vectors meets all blocks of queries, one matrix product each; only its best k per query leave the worker."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            length = np.array([-1 if v is None else len(v) for v in pdf["v"]])
            for block in blocks:
                ids, asked = block.value
                own = pdf[length == asked.shape[1]]
                if not len(own):
                    continue
                # rows in the order of ids, so that ties at the border go to the lesser id
                own = own.sort_values("id", kind="stable")
                key, score = own["id"].to_numpy(), np.round(_unit(np.stack(own["v"].to_numpy()).astype(np.float64)) @ asked.T, 6)
                if len(key) > k:
                    least = np.partition(score, len(key) - k, axis=0)[len(key) - k]
                    above, tied = score > least, score == least
                    keep = above | (tied & (np.cumsum(tied, axis=0) <= k - above.sum(axis=0)))
                else:
                    keep = np.ones(score.shape, bool)
                d, q = np.nonzero(keep)
                yield pd.DataFrame({"query_id": np.array(ids, dtype=object)[q], "id": key[d], "score": score[d, q]})

    return run


def recall(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, id, score, rank: exact cosine recall. vectors: id, v. queries: query_id, v.

    The queries are the stated set; they are sent out in blocks of VECTOR_BLOCK, each of bounded
    size, and the vectors are read once for all of them. Vectors of another length than a query's and
    null ones are no hits for it, zero vectors score 0; ties go to the lesser id.
    """
    spark = vectors.sparkSession
    rows = vectors.select("id", "v").where("id IS NOT NULL AND v IS NOT NULL")
    asked = queries.select("query_id", "v").where("query_id IS NOT NULL AND size(v) > 0")
    schema = f"query_id {dict(asked.dtypes)['query_id']}, id {dict(rows.dtypes)['id']}, score double"
    blocks, by = [], {}

    def send(length: int) -> None:
        if own := by.pop(length, None):
            blocks.append(spark.sparkContext.broadcast(([q for q, _ in own], _unit(np.array([v for _, v in own], np.float64)))))

    for r in asked.toLocalIterator():
        by.setdefault(len(r["v"]), []).append((r["query_id"], r["v"]))
        if len(by[len(r["v"])]) == VECTOR_BLOCK:
            send(len(r["v"]))
    for length in list(by):
        send(length)
    if not blocks:
        return spark.createDataFrame([], f"{schema}, rank int")
    found = spread(rows).mapInPandas(_nearest(blocks, k), schema)
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)


def nearest(vectors: DataFrame, queries: DataFrame, k: int, id_column: str = "vec_id", vector_column: str = "embedding", itself: bool = False) -> DataFrame:
    """`recall` of queries that are rows of the same kind as the vectors; a query is no hit of its own unless `itself`."""
    rows = vectors.select(F.col(id_column).alias("id"), F.col(vector_column).alias("v"))
    asked = queries.select(F.col(id_column).alias("query_id"), F.col(vector_column).alias("v"))
    found = recall(rows, asked, k if itself else k + 1)
    if itself:
        return found
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    return found.where("query_id <> id").withColumn("rank", rank).where(F.col("rank") <= k)


@lru_cache(maxsize=8)
def _signs(dim: int) -> np.ndarray:
    seed = int.from_bytes(hashlib.sha256(f"hash-embedder-seed-{dim}".encode()).digest()[:8], "big")
    draw = random.Random(seed)
    return np.array([1.0 if draw.random() < 0.5 else -1.0 for _ in range(dim)])


@lru_cache(maxsize=1 << 20)
def _placed(gram: str, dim: int) -> tuple[int, float]:
    """The dimension of a gram and its sign; grams recur, so the digests are kept."""
    digest = hashlib.blake2b(gram.encode("utf-8"), digest_size=8).digest()
    at = int.from_bytes(digest, "big") % dim
    return at, (1.0 if digest[0] & 1 == 0 else -1.0) * _signs(dim)[at]


def hash_vector(text: str | None, dim: int) -> np.ndarray:
    """The signed, hashed, log-counted character 2- and 3-grams of a text, of length 1; zero if it has none."""
    low = " ".join((text or "").lower().split())
    count = Counter(g for width in (2, 3) for g in map("".join, zip(*(low[k:] for k in range(width)))) if g != " " * width)
    if not count:
        return np.zeros(dim)
    at, sign = zip(*(_placed(g, dim) for g in count))
    out = np.bincount(at, np.array(sign) * (1 + np.log(np.fromiter(count.values(), float, len(count)))), dim)
    norm = np.linalg.norm(out)
    return out / norm if norm > 0 else out


def embed(rows: DataFrame, text_column: str, dim: int = 1024) -> DataFrame:
    """`rows` with a column `embedding` by the offline hash embedder."""

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([hash_vector(t, dim).astype(np.float32) for t in texts])

    return rows.withColumn("embedding", run(F.col(text_column)))


def fuse(vector_hits: DataFrame, keyword_hits: DataFrame, mode: str = "hybrid") -> DataFrame:
    """query_id, id, vector_score, keyword_score, fusion: score-normalised reciprocal rank fusion of two recall lists.

    Inputs have query_id, id, score and rank. A list whose best score isn't positive adds nothing.
    """
    best = F.max("score").over(Window.partitionBy("query_id"))

    def listed(df: DataFrame, name: str) -> DataFrame:
        share = F.when(best > 0, F.col("score") / best).otherwise(F.lit(0.0))
        return df.select("query_id", "id", F.col("score").alias(f"{name}_score"), F.col("rank").alias(f"{name}_rank"), share.alias(f"{name}_share"))

    both = listed(vector_hits, "vector").join(listed(keyword_hits, "keyword"), ["query_id", "id"], "full_outer")
    part = lambda n, w: F.coalesce(w * F.col(f"{n}_share") / (RRF_K + F.col(f"{n}_rank")), F.lit(0.0))
    fusion = {"hybrid": part("vector", VECTOR_WEIGHT) + part("keyword", KEYWORD_WEIGHT), "vector": F.col("vector_score"), "keyword": F.col("keyword_share")}[mode]
    return both.select("query_id", "id", "vector_score", "keyword_score", "vector_rank", "keyword_rank", fusion.alias("fusion"))


MODES = ("vector", "keyword", "hybrid")
TOP_K, CANDIDATES, SCORED = 5, 20, 20


def mode_of(mode: str | None, default: str = "hybrid") -> str:
    """The mode asked for, in any letter case; the default for an unknown one."""
    return mode.lower() if mode and mode.lower() in MODES else default


def retrieve(chunks: DataFrame, queries: DataFrame, vectors: DataFrame | None = None, query_vectors: DataFrame | None = None, mode: str | None = None, top_k: int = TOP_K, candidates: int = CANDIDATES, scorer=None, scored: int = SCORED) -> DataFrame:
    """query_id, rank, id, score and all parts of the score of the best chunks of each query, end to end.

    chunks: id, text, section. queries: query_id, text. vectors: id, v; query_vectors: query_id, v
    (modes vector and hybrid). Both recall lists have max(top_k, candidates) entries; they are fused,
    reranked by the six signals and, with a `scorer` (see plugins), its first `scored` ordered anew by
    it. Then the list is cut to top_k, and only then entries without a positive score are dropped.
    Ties stand as in the vector list, then as in the keyword list. Blank queries find nothing.
    """
    from lodestrand.operators import keyword_index

    mode, top_k = mode_of(mode), max(1, top_k)
    many = max(top_k, candidates)
    rows = chunks.where("id IS NOT NULL AND text IS NOT NULL").select("id", "text", F.coalesce("section", F.lit("")).alias("section"))
    asked = queries.select("query_id", X.strip(F.col("text")).alias("query")).where("query <> ''")
    kinds = dict(rows.dtypes)["id"], dict(asked.dtypes)["query_id"]
    none = rows.sparkSession.createDataFrame([], f"query_id {kinds[1]}, id {kinds[0]}, score double, rank int")
    by_vector = none if mode == "keyword" else recall(vectors.join(rows, "id", "left_semi"), query_vectors.join(asked, "query_id", "left_semi"), many)
    by_words = none if mode == "vector" else keyword_index.search(rows, asked, many, "id", "text", ("section",), "query_id", "query")
    fused = fuse(by_vector, by_words, mode).join(asked, "query_id").join(rows, "id")
    # candidates are few and small but cost much time each, so they must not be put together by their bytes
    spark = fused.sparkSession
    wide = fused.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "query_id", "id")
    ranked = rerank(wide, "query", "text", "section")
    place = Window.partitionBy("query_id")
    order = [F.asc_nulls_last("vector_rank"), F.asc_nulls_last("keyword_rank"), F.asc("id")]
    ranked = ranked.withColumn("rank", F.row_number().over(place.orderBy(F.desc("score"), *order)))
    if scorer is not None:
        head = ranked.where(F.col("rank") <= max(scored, top_k)).select("query_id", "id", "query", "text")
        ranked = cross_rerank(ranked, scorer(head), max(scored, top_k)).drop("rank").withColumnRenamed("new_rank", "rank")
    return ranked.where((F.col("rank") <= top_k) & (F.col("score") > 0))


def debug(hits: DataFrame, text: bool = False, most: int = 160) -> DataFrame:
    """What is shown of hits: ranks and scores, rounded, a snippet, and the whole text only if asked for."""
    signals = F.create_map(*(x for n in SIGNALS for x in (F.lit(n), F.col(f"signal_{n}"))))
    return hits.select(
        "query_id", "rank", "id", "section", F.round("score", 6).alias("score"), F.round("vector_score", 6).alias("vector_score"), F.round("keyword_score", 4).alias("keyword_score"),
        F.col("vector_rank").isNotNull().alias("from_vector"), F.col("keyword_rank").isNotNull().alias("from_keyword"), F.round("fusion", 6).alias("fusion"), signals.alias("signals"),
        X.snippet(F.col("text"), most).alias("snippet"), (F.col("text") if text else F.lit("")).alias("text"),
    )


def _weight(t: Column) -> Column:
    return F.when((F.length(t) == 1) & t.rlike(X.HAN), F.lit(SINGLE)).otherwise(F.lit(1.0))


def coverage(terms: Column, there: Column) -> Column:
    """The weight of the terms that are in `there`, of the weight of all; 0 if there are no terms.

    What both hold is intersected first, by hashing, and bound as one element, so that a term is sought among few.
    """

    def share(held: Column) -> Column:
        add = lambda keep: F.aggregate(terms, F.lit(0.0), lambda a, t: a + F.when(keep(t), _weight(t)).otherwise(F.lit(0.0)))
        total = add(lambda t: F.lit(True))
        return F.when(total > 0, add(lambda t: F.array_contains(held, t)) / total).otherwise(F.lit(0.0))

    return F.element_at(F.transform(F.array(F.array_intersect(terms, there)), share), 1)


def rerank(pairs: DataFrame, query: str = "query", text: str = "text", section: str = "section", fusion: str = "fusion") -> DataFrame:
    """`pairs` with the six signals and `score`, their weighted sum, all by built-in expressions."""
    q, s = F.col(query), F.coalesce(F.col(section), F.lit(""))
    df = pairs.withColumn("_index", X.context_text(F.col(text), s)).withColumn("_q", X.tokens(q)).withColumn("_t", F.array_distinct(X.tokens(F.col("_index"))))
    df = df.withColumn("_s", F.array_distinct(X.tokens(s)))
    exact = F.array_distinct(F.filter("_q", lambda t: t.rlike("[0-9a-z]") & (F.length(F.regexp_replace(t, "_", "")) <= 12)))
    han = F.array_distinct(F.filter("_q", lambda t: (F.length(t) >= 2) & t.rlike(X.HAN)))
    only = F.regexp_replace(F.col("_index"), r"[^一-鿿]", "")
    flat_q, flat_t = X.flat(q), X.flat(F.col("_index"))
    held = lambda a, b: F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a)).otherwise(F.lit(0.0))
    phrase = ((flat_q != "") & F.contains(flat_t, flat_q)) | ((F.length(X.strip(q)) >= 4) & F.contains(F.col("_index"), X.strip(q)))
    signals = {
        "fusion": F.coalesce(F.col(fusion), F.lit(0.0)),
        "coverage": coverage(F.col("_q"), F.col("_t")),
        "precision": held(exact, F.col("_t")),
        "cjk": F.when(F.size(han) > 0, F.size(F.filter(han, lambda t: F.contains(only, t))) / F.size(han)).otherwise(F.lit(0.0)),
        "section": F.when(F.size("_s") > 0, coverage(F.col("_q"), F.col("_s"))).otherwise(F.lit(0.0)),
        "phrase": phrase.cast("double"),
    }
    df = df.select(*pairs.columns, *(F.round(c, 6).alias(f"signal_{n}") for n, c in signals.items()), sum(SIGNALS[n] * c for n, c in signals.items()).alias("_score"))
    return df.withColumn("score", F.round("_score", 6)).drop("_score")


def cross_rerank(ranked: DataFrame, scores: DataFrame, top: int = 20) -> DataFrame:
    """The order after another scorer saw the first `top` of each query: these by its score, the rest unchanged.

    `ranked` has query_id, id, rank; `scores` has query_id, id, raw. A missing score leaves a row where it was.
    """
    both = ranked.join(scores, ["query_id", "id"], "left")
    head = (F.col("rank") <= top) & F.col("raw").isNotNull()
    order = [F.when(head, 0).otherwise(1), F.when(head, -F.col("raw")), "rank"]
    return both.withColumn("new_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).withColumn("probability", 1 / (1 + F.exp(-F.col("raw"))))
