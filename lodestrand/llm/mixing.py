"""Mixing sources to target shares of all tokens, with a cap on repeats.

Documents are counted in tokens of a public tokenizer. The documents of each source fall, by a
hash of their id, into up to BLOCKS blocks in a random order; block sizes are all that goes to the
driver, and sources with many passes, or many sources, have fewer blocks, so that the plan that comes
back is at most about MOST_DRAWS rows, one per source and pass at least. The mix is as large as the scarcest source allows: the
total T for which no source need be repeated more than its cap. A source's quota, its share of T,
is made of whole passes over its blocks and of one last pass in a fresh random order of the blocks
that still fit; what then is left is filled from the smallest other block, document by document.

Block quotas are dealt to the output shards by a splitting tree: at each node the left half of
the shards gets a multivariate hypergeometric draw of the node's blocks by source, so each shard
has its counts exactly as if all blocks had been shuffled and cut. Each shard then draws that many
of the source's permuted blocks, disjointly, and its documents are shuffled within the shard. Shards
hold about SHARD_TOKENS whatever the size of the mix: the tree's upper levels, down to MOST_GROUPS groups
of shards, are grown on the driver, the lower ones group by group on the workers, where each block
falls into smaller ones by further bits of its documents' keys.

Defined results: sources are compared in lower case without outer white space. Documents of null
or unlisted sources, and of sources whose share isn't positive, stay out; listed sources without a
token are reported with no share, the others being scaled up. Null and empty texts have no tokens
and are not drawn. Documents delivered twice count once.
"""

from __future__ import annotations

import base64
import heapq
import math
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrand.operators.bounded import small
from lodestrand.session import cut, spread

BLOCKS = 1024
SHARD_TOKENS, MOST_GROUPS = 5_000_000, 4096
MOST_DRAWS = 1_000_000
#: Smaller blocks per shard and source that the lower levels deal in, on average.
PARTS_PER_SHARD = 16
#: The share of a quota that may stay open before documents of the last pass are drawn once more.
SLACK = 0.005
SEED = 20
VOCABULARY = "byte_bpe_multi_50k.tiktoken"

_state: dict = {}


def encoder(folder: str | None, name: str):
    """The tokenizer of a vocabulary file, loaded once per worker; by default from the installed public_tokenizers."""
    if (folder, name) not in _state:
        import public_tokenizers
        import tiktoken

        path = os.path.join(folder, name) if folder else public_tokenizers.path(name)
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _state[folder, name] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _state[folder, name]


def _counted(folder: str | None, name: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(folder, name).encode_ordinary
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "source": pdf["source"], "n_tokens": [len(encode(t)) for t in pdf["text"]]})

    return run


def sizes(documents: DataFrame, folder: str | None = None, name: str = VOCABULARY) -> DataFrame:
    """doc_id, source, n_tokens, key of each document; the key's bits tell its block and part, and order it."""
    rows = documents.select("doc_id", F.lower(F.regexp_replace("source", r"^\s+|\s+$", "")).alias("source"), "text").where("doc_id IS NOT NULL AND source IS NOT NULL AND text <> ''")
    kind = dict(rows.dtypes)["doc_id"]
    counted = spread(rows).mapInPandas(_counted(folder, name), f"doc_id {kind}, source string, n_tokens long")
    once = counted.groupBy("doc_id").agg(F.min(F.struct("source", "n_tokens")).alias("r")).select("doc_id", "r.source", "r.n_tokens")
    key = F.xxhash64(F.lit(SEED), "doc_id")
    return cut(once.where("n_tokens > 0").withColumn("key", key))


def split(counts: np.ndarray, shards: int, r: np.random.Generator) -> np.ndarray:
    """Counts (shards, sources) of a random deal of the blocks, by halving the shards again and again."""
    if shards == 1:
        return counts[None, :]
    left = shards // 2
    drawn = r.multivariate_hypergeometric(counts, int(counts.sum()) * left // shards, method="marginals")
    return np.vstack([split(drawn, left, r), split(counts - drawn, shards - left, r)])


def quotas(tokens: dict[str, int], targets: dict[str, tuple[float, int]]) -> dict[str, int]:
    """The tokens that each source gives to the largest mix that the caps allow."""
    live = sorted(s for s, (share, most) in targets.items() if share > 0 and most > 0 and tokens.get(s))
    whole = sum(targets[s][0] for s in live)
    total = min((targets[s][1] * tokens[s] * whole / targets[s][0] for s in live), default=0)
    return {s: math.floor(total * targets[s][0] / whole + 1e-6) for s in live}


def folds(tokens: dict[str, int], targets: dict[str, tuple[float, int]]) -> dict[str, int]:
    """How many blocks each source is dealt in, so that all passes together make at most MOST_DRAWS draws if that can be; the sources with most draws are folded first."""
    passes = {s: min(targets[s][1], q // tokens[s] + 1) for s, q in quotas(tokens, targets).items()}
    count = dict.fromkeys(passes, BLOCKS)
    heap = [(-BLOCKS * n, s) for s, n in passes.items()]
    heapq.heapify(heap)
    total = -sum(n for n, _ in heap)
    while total > MOST_DRAWS and heap:
        draws, s = heapq.heappop(heap)
        if count[s] > 1:
            count[s] //= 2
            now = count[s] * passes[s]
            total += draws + now
            heapq.heappush(heap, (-now, s))
    return count


def shards_of(due: dict[str, int]) -> int:
    return max(1, math.ceil(sum(due.values()) / SHARD_TOKENS))


def _dealt(per: int, parts: int):
    """The lower levels of the tree: a group's draws, each in `parts` smaller blocks, dealt to its `per` shards."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        group = int(pdf["shard"].iloc[0])
        r = np.random.default_rng([SEED, group])
        out = []
        pdf = pdf.sort_values(["source", "block", "copy"])
        own = [p for _, p in pdf.groupby("source", sort=True)]
        counts = split(np.array([len(p) * parts for p in own], np.int64), per, r)
        for p, count in zip(own, counts.T):
            wide = p.loc[p.index.repeat(parts)].assign(part=np.tile(np.arange(parts, dtype=np.int32), len(p)))
            wide = wide.iloc[r.permutation(len(wide))]
            out.append(wide.assign(shard=group * per + np.repeat(np.arange(per), count)))
        return pd.concat(out)

    return run


def plan(blocks: dict[str, dict[int, int]], targets: dict[str, tuple[float, int]], shards: int | None = None, seed: int = SEED) -> list[tuple[str, int, int, int, int | None]]:
    """(source, block, copy, group, budget) of every draw of a block; budget bounds the tokens of a last, partial one."""
    r = np.random.default_rng(seed)
    tokens = {s: sum(b.values()) for s, b in blocks.items()}
    due = quotas(tokens, targets)
    live = list(due)
    if not live:
        return []
    draws: dict[str, list] = {}
    for s in live:
        quota = due[s]
        passes = min(targets[s][1], quota // tokens[s])
        own = [(b, c, None) for c in range(passes) for b in blocks[s]]
        rest = quota - passes * tokens[s]
        at, over = passes, []
        while at < targets[s][1] and rest > (quota * SLACK if over else 0):  # a further pass only if large blocks left much open
            over = []
            for b in r.permutation(sorted(blocks[s])).tolist():
                if blocks[s][b] > rest:
                    over.append(b)
                else:
                    own.append((b, at, None))
                    rest -= blocks[s][b]
            at += 1
        if over:
            own.append((min(over, key=lambda b: blocks[s][b]), at - 1, rest))
        draws[s] = [own[k] for k in r.permutation(len(own))]
    count = min(MOST_GROUPS, shards or shards_of(due))
    dealt = split(np.array([len(draws[s]) for s in live], np.int64), count, r)
    out, at = [], dict.fromkeys(live, 0)
    for shard, row in enumerate(dealt.tolist()):
        for s, n in zip(live, row):
            out += [(s, b, c, shard, budget) for b, c, budget in draws[s][at[s] : at[s] + n]]
            at[s] += n
    return out


def _filled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The documents of partial blocks, in order, each that fits into what the ones before it left of the budget."""
    at, rest = None, 0
    for pdf in batches:
        keep = []
        for *place, n, budget in zip(pdf["source"], pdf["block"], pdf["copy"], pdf["n_tokens"], pdf["budget"]):
            if place != at:
                at, rest = place, budget
            keep.append(n <= rest)
            rest -= n * keep[-1]
        yield pdf[np.array(keep, bool)]


def mix(documents: DataFrame, targets: DataFrame, shards: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The mix (shard, pos, doc_id, copy, source, n_tokens) and the shares really reached."""
    spark = documents.sparkSession
    wanted = {row["source"].strip().lower(): (row["target_share"] or 0.0, row["max_repeats"] or 0) for row in targets.where("source IS NOT NULL").toLocalIterator()}
    listed = spark.createDataFrame([(s, *v) for s, v in wanted.items()], "source string, target_share double, max_repeats int")
    known = sizes(documents).join(small(listed.select("source")), "source")
    tokens = {row["source"]: row["n"] for row in known.groupBy("source").agg(F.sum("n_tokens").alias("n")).toLocalIterator()}
    counts = folds(tokens, wanted)
    count_of = small(spark.createDataFrame(list(counts.items()), "source string, _count int"))
    bits = F.shiftrightunsigned("key", 32)
    known = known.join(count_of, "source", "left").withColumn("block", F.pmod(bits, F.coalesce("_count", F.lit(BLOCKS)).cast("long")).cast("int")).drop("_count")
    by: dict[str, dict[int, int]] = {}
    for row in known.groupBy("source", "block").agg(F.sum("n_tokens").alias("n")).toLocalIterator():
        by.setdefault(row["source"], {})[row["block"]] = row["n"]
    schema = "source string, block int, copy int, shard int, budget long"
    planned = plan(by, wanted, shards)
    draws = spark.createDataFrame(planned, schema)
    many = shards or shards_of(quotas({s: sum(b.values()) for s, b in by.items()}, wanted))
    per = -(-many // MOST_GROUPS)
    if per > 1 and planned:
        parts = max(1, -(-PARTS_PER_SHARD * per * MOST_GROUPS // len(planned)))
        dealt = draws.groupBy("shard").applyInPandas(_dealt(per, parts), f"{schema}, part int")
        drawn = known.withColumn("part", F.pmod(F.col("key").bitwiseAND(F.lit((1 << 32) - 1)), F.lit(parts)).cast("int")).join(dealt, ["source", "block", "part"]).drop("part")
    else:
        drawn = known.join(small(draws), ["source", "block"])
    place = ["source", "block", "copy"]
    last = drawn.where("budget IS NOT NULL").repartition(*place).sortWithinPartitions(*place, "key", "doc_id").mapInPandas(_filled, drawn.schema)
    both = drawn.where("budget IS NULL").unionByName(last)
    pos = F.row_number().over(Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(SEED + 1), "doc_id", "copy"), "doc_id", "copy"))
    mixed = both.select("shard", pos.alias("pos"), "doc_id", "copy", "source", "n_tokens")
    there = known.groupBy("source").agg(F.sum("n_tokens").alias("tokens_there"), F.count("*").alias("docs_there"))
    used = both.groupBy("source").agg(F.sum("n_tokens").alias("tokens_used"), F.count("*").alias("rows_used"), (F.max("copy") + 1).alias("most_copies"))
    total = used.agg(F.sum("tokens_used").alias("all"))
    shares = listed.join(there, "source", "left").join(used, "source", "left").join(F.broadcast(total), how="left")
    shares = shares.select("source", "target_share", F.round(F.coalesce(F.col("tokens_used") / F.col("all"), F.lit(0.0)), 9).alias("share"), "max_repeats", F.coalesce("most_copies", F.lit(0)).alias("most_copies"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("tokens_used", "rows_used", "tokens_there", "docs_there")))
    return mixed, shares


def _tables(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return mix(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/mix_target.parquet"))


def p7_mix(spark: SparkSession, folder: str) -> DataFrame:
    return _tables(spark, folder)[0]


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    return _tables(spark, folder)[1]
