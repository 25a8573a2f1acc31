"""Test items that stand, fully or in parts, in corpus documents, found by greedy string tiling.

Texts are compared as their letters and digits (NFKC, lower case, categories L and N). Of every
item, windows of SEED characters at every STEP-th place are hashed; any run of at least LEAST =
SEED + STEP - 1 characters holds one of them whole, so no run is missed. Documents roll the same
Karp-Rabin hash over all their windows. Where a seed is met, document and item are tiled: the
longest unmarked common runs of at least LEAST characters are marked again and again, running
Karp-Rabin giving the matches, so reordered passages count like connected ones.

The items are the stated query set. They are taken in blocks of at most about BLOCK_CHARS
characters, each block's seeds being broadcast, so what is broadcast has a bound whatever the
number of items. The documents are read once for PASS blocks, with no shuffle.

Defined results: null and empty texts hold nothing and leak nothing. Items of fewer than LEAST
letters and digits can't leak. Documents or items delivered twice give one row.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.functions import sql
from lodestrand.functions.unicode import alnum
from lodestrand.session import spread

LEAST = 40
SEED, STEP = 20, 21
BLOCK_CHARS, PASS = 4_000_000, 4
#: An item counts as leaked by a document if so much of it is covered or a tile is so long.
COVERAGE = 0.2
APART = ""
FILTER_BITS = 22
STRETCH = 2_000_000
_B = np.uint64(0x9E3779B97F4A7C15 | 1)
_B_INVERSE = np.uint64(pow(int(_B), -1, 1 << 64))
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(which: str, n: int) -> np.ndarray:
    """Powers 0..n-1 of the base or of its inverse, modulo 2 ** 64."""
    if len(_powers[which]) < n:
        size = max(n, 2 * len(_powers[which]))
        steps = np.full(size, _B if which == "up" else _B_INVERSE, np.uint64)
        steps[0] = 1
        _powers[which] = np.multiply.accumulate(steps)
    return _powers[which][:n]


def codes(text: str) -> np.ndarray:
    a = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    a = (a + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)
    return a ^ (a >> np.uint64(31))


def rolling(a: np.ndarray, width: int) -> np.ndarray:
    """Karp-Rabin hashes of all windows of `width` codes."""
    if len(a) < width:
        return np.empty(0, np.uint64)
    total = np.zeros(len(a) + 1, np.uint64)
    np.cumsum(a * _power("up", len(a)), out=total[1:])
    return (total[width:] - total[:-width]) * _power("down", len(a) - width + 1)


def tiles(item: str, text: str, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(place in item, place in text, length) of the tiles, longest first within each pass."""
    a, b = codes(item), codes(text)
    free_a, free_b = np.ones(len(a), bool), np.ones(len(b), bool)
    out: list[tuple[int, int, int]] = []
    width = max(least, min(len(a), len(b)) // 2)
    while True:
        matches, longest = _matches(a, b, free_a, free_b, width)
        if longest > 2 * width:
            width = longest
            continue
        for n, i, j in sorted(matches, key=lambda m: (-m[0], m[1], m[2])):
            if free_a[i : i + n].all() and free_b[j : j + n].all():
                out.append((i, j, n))
                free_a[i : i + n] = free_b[j : j + n] = False
        if not matches or width == least:
            if width == least and not matches:
                return out
            if width > least:
                width = max(least, width // 2)


def _ends(h: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first, last) of the progressions in which each hash recurs at one distance of at most `width`.

    Text of a short period gives such a progression. Of two of them only matches that begin or end
    together can be the longest or reach beyond them, so the places between need not be paired.
    """
    by = np.lexsort((at, h))
    h, at = h[by], at[by]
    gap = np.diff(at)
    close = (h[1:] == h[:-1]) & (gap <= width)
    on = close.copy()
    on[1:] &= ~close[:-1] | (gap[1:] == gap[:-1])
    first = np.flatnonzero(np.r_[True, ~on]) if len(h) else np.empty(0, np.int64)
    last = np.r_[first[1:], len(h)] - 1 if len(h) else first
    return h[first], at[first], at[last]


def _run(a: np.ndarray, b: np.ndarray) -> int:
    """How many places a and b agree from the start; in growing steps, so a long rest isn't compared for a short run."""
    room, done, step = min(len(a), len(b)), 0, 64
    while done < room:
        stop = min(room, done + step)
        equal = a[done:stop] == b[done:stop]
        if not equal.all():
            return done + int(equal.argmin())
        done, step = stop, step * 4
    return done


def _matches(a: np.ndarray, b: np.ndarray, free_a: np.ndarray, free_b: np.ndarray, width: int) -> tuple[list[tuple[int, int, int]], int]:
    """Maximal common runs of at least `width` unmarked codes, and the length of the longest."""

    def open_windows(x: np.ndarray, free: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        taken = np.r_[0, np.cumsum(~free)]
        h = rolling(x, width)
        at = np.flatnonzero(taken[width:] == taken[: len(h)]) if len(h) else np.empty(0, np.int64)
        return h[at], at

    (ha, *ends_a), (hb, *ends_b) = (_ends(*open_windows(x, free), width) for x, free in ((a, free_a), (b, free_b)))
    low, high = np.searchsorted(hb, ha, "left"), np.searchsorted(hb, ha, "right")
    many = high - low
    k = np.repeat(np.arange(len(ha)), many)
    m = np.repeat(low - np.cumsum(many) + many, many) + np.arange(len(k))
    pairs = np.unique(np.concatenate([np.stack([x[k], y[m]], 1) for x, y in zip(ends_a, ends_b)]), axis=0)
    pairs = pairs[np.lexsort((pairs[:, 0], pairs[:, 0] - pairs[:, 1]))]
    # marked places differ from everything, so a run ends at them
    x, y = np.where(free_a, a, np.uint64(1)), np.where(free_b, b, np.uint64(2))
    back_x, back_y = x[::-1], y[::-1]
    out, longest, diagonal, reach = [], 0, None, -1
    for i, j in pairs.tolist():
        if i - j == diagonal and i < reach:  # within the run before
            continue
        before = _run(back_x[len(x) - i :], back_y[len(y) - j :])
        n = before + _run(x[i:], y[j:])
        diagonal, reach = i - j, i - before + n
        if n >= width:
            out.append((n, i - before, j - before))
            longest = max(longest, n)
    return out, longest


def stretches(texts: list[str], size: int) -> Iterator[tuple[list[tuple[int, int]], str, np.ndarray]]:
    """Texts joined into stretches of about `size` characters, long texts cut with SEED - 1 characters in common.

    Of each: (text, offset) of its parts, the joined string, and where the parts start in it.
    """
    parts, joined, length = [], [], 0
    for n, text in enumerate(texts):
        for low in range(0, max(1, len(text) - SEED + 1), size):
            part = text[low : low + size + SEED - 1]
            parts.append((n, low))
            joined.append(part)
            length += len(part) + 1
            if length > size:
                yield parts, APART.join(joined), np.cumsum([0] + [len(p) + 1 for p in joined[:-1]])
                parts, joined, length = [], [], 0
    if parts:
        yield parts, APART.join(joined), np.cumsum([0] + [len(p) + 1 for p in joined[:-1]])


def around(text: str, places: list[int], reach: int) -> str:
    """The parts of a text that a match with a seed at one of the places can touch; any tile lies in one of them."""
    spans: list[list[int]] = []
    for p in sorted(places):
        if spans and p - reach <= spans[-1][1]:
            spans[-1][1] = p + SEED + reach
        else:
            spans.append([max(0, p - reach), p + SEED + reach])
    return APART.join(text[a:b] for a, b in spans)


def _search(blocks: list, size: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shift = np.uint64(64 - FILTER_BITS)
        for pdf in batches:
            norms = [alnum(t) for t in pdf["text"]]
            met: dict[tuple[int, int, int], list[int]] = defaultdict(list)
            for first, text, starts in stretches(norms, size):
                windows = rolling(codes(text), SEED)
                for n, block in enumerate(blocks):
                    known, owner, _, likely = block.value
                    at = np.flatnonzero(likely[windows >> shift])
                    k = np.minimum(np.searchsorted(known, windows[at]), len(known) - 1)
                    at, k = at[known[k] == windows[at]], k[known[k] == windows[at]]
                    doc = np.searchsorted(starts, at, "right") - 1
                    for d, place, seed in zip(doc.tolist(), (at - starts[doc]).tolist(), k.tolist()):
                        for item in owner[seed]:
                            met[first[d][0], n, item].append(place + first[d][1])
            rows = []
            for (doc, n, item), places in met.items():
                key, text = blocks[n].value[2][item]
                if found := tiles(text, around(norms[doc], places, len(text))):
                    rows.append((pdf["doc_id"].iloc[doc], key, len(found), max(n for _, _, n in found), sum(n for _, _, n in found) / len(text)))
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "n_tiles", "longest", "coverage"])

    return run


def leaks(documents: DataFrame, items: DataFrame, doc_column: str = "doc_id", item_column: str = "item_id", text_column: str = "text") -> DataFrame:
    """doc_id, item_id, n_tiles, longest, coverage of every pair that shares a run of at least LEAST."""
    spark = documents.sparkSession
    docs = spread(documents.select(F.col(doc_column).alias("doc_id"), F.col(text_column).alias("text")).where("text IS NOT NULL"))
    tests = items.select(F.col(item_column).alias("item_id"), F.col(text_column).alias("text")).where("item_id IS NOT NULL AND text IS NOT NULL").groupBy("item_id").agg(F.min("text").alias("text"))
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, item_id {dict(tests.dtypes)['item_id']}, n_tiles int, longest int, coverage double"
    chars = tests.agg(F.sum(F.length("text"))).first()[0] or 0
    count, blocks = max(1, math.ceil(chars / BLOCK_CHARS)), []
    for n in range(count):
        part = tests.where(F.pmod(F.hash("item_id"), F.lit(count)) == n).collect()
        texts = [(r["item_id"], norm) for r in part if len(norm := alnum(r["text"])) >= LEAST]
        of = defaultdict(list)
        for k, (_, text) in enumerate(texts):
            for h in np.unique(rolling(codes(text), SEED)[::STEP]).tolist():
                of[h].append(k)
        if not of:
            continue
        known = np.array(sorted(of), np.uint64)
        likely = np.zeros(1 << FILTER_BITS, bool)
        likely[known >> np.uint64(64 - FILTER_BITS)] = True
        blocks.append(spark.sparkContext.broadcast((known, [of[h] for h in known.tolist()], texts, likely)))
    found = [docs.mapInPandas(_search(blocks[k : k + PASS], STRETCH), schema) for k in range(0, len(blocks), PASS)]
    return reduce(DataFrame.unionAll, found).distinct() if found else spark.createDataFrame([], schema)


def _tables(spark: SparkSession, folder: str) -> DataFrame:
    return leaks(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/eval_item.parquet"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return _tables(spark, folder).select("doc_id", "item_id")


def p6_report(spark: SparkSession, folder: str) -> DataFrame:
    """Of each leaked item: documents, the longest tile, the most of it that one document covers."""
    found = _tables(spark, folder)
    return found.groupBy("item_id").agg(
        F.countDistinct("doc_id").alias("n_documents"),
        F.max("longest").alias("longest"),
        F.round(F.max("coverage"), 6).alias("most_covered"),
        F.countDistinct(F.when(F.col("coverage") >= COVERAGE, F.col("doc_id"))).alias("n_covering"),
    )


P6_FOUND_SQL = f"""
WITH runs AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, length(t) - 38), lambda i: substr(t, i, 40))) AS run FROM (SELECT item_id, {sql.alnum('text')} AS t FROM eval_item WHERE item_id IS NOT NULL) WHERE length(t) >= 40),
texts AS (SELECT doc_id, unnest(list_transform(range(1, length(t) - 38), lambda i: substr(t, i, 40))) AS run FROM (SELECT doc_id, {sql.alnum('text')} AS t FROM documents) WHERE length(t) >= 40)
SELECT DISTINCT doc_id, item_id FROM texts JOIN runs USING (run)
"""
