"""What changed between consecutive full snapshots of keyed records.

Every delivery of a source brings all its records anew. Deliveries get one dense number g each, in
the order (source, time, id), so that a delivery and the one before it are g and g - 1. Of every
record only (g, key hash, row hash, row id) is moved: 48 bytes, hashes being of 128 bits, so that equal
ones mean equal texts. These rows are bucketed by key hash and by runs of BLOCK delivery numbers, the
last delivery of a run being repeated in the next; a run has as many buckets as its rows, which are
counted, need to hold about BUCKET_ROWS each. So neither a hot source nor a hot key nor a hot delivery
lies in one bucket. A bucket is compared
in numpy: codes of (key, g) are sorted, and searchsorted finds for every code its neighbour one
delivery earlier or later. Full values are fetched only for the records that differ.

Defined results: deliveries without records are passed over. Rows with a null delivery or key are
ignored. A null value equals only null. Of several rows of one key in a delivery the one with the
highest row id stands; rows with the same row id count once. Null times order first. Deliveries of
a null source, and records of unknown deliveries, are ignored. Other columns don't matter.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.functions import sql
from lodestrand.functions.unicode import column, squeeze_value
from lodestrand.operators.bounded import small
from lodestrand.operators.ordering import numbered
from lodestrand.session import cut, spread, table

BLOCK = 4096
BUCKET_ROWS = 500_000
KINDS = ("added", "removed", "changed")


def _dense(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Numbers 0, 1, ... that are equal where both halves of a hash are."""
    by = np.lexsort((low, high))
    new = np.r_[False, (high[by][1:] != high[by][:-1]) | (low[by][1:] != low[by][:-1])]
    out = np.empty(len(by), np.int64)
    out[by] = np.cumsum(new)
    return out


def differences(key: np.ndarray, key_low: np.ndarray, g: np.ndarray, value: np.ndarray, value_low: np.ndarray, row: np.ndarray, first: np.ndarray, last: np.ndarray, low: int, high: int) -> pd.DataFrame:
    """The changes that deliveries low..high-1 bring, each (key, g) being there once.

    Keys and values are hashes in two halves; `first` and `last` say whether a row's delivery is its source's first or last one.
    """
    codes = _dense(key, key_low) * (high - low + 2) + (g - low + 1)
    by = np.argsort(codes)
    codes, g, value, value_low, row, first, last = (x[by] for x in (codes, g, value, value_low, row, first, last))

    def at(wanted: np.ndarray) -> np.ndarray:
        """Where each wanted code is, -1 if nowhere."""
        k = np.minimum(np.searchsorted(codes, wanted), max(0, len(codes) - 1))
        return np.where(codes[k] == wanted, k, -1)

    none = np.full(len(codes), -1, np.int64)
    now = np.flatnonzero((g >= low) & (g < high) & ~first)
    before = at(codes[now] - 1)
    added, kept = now[before < 0], before >= 0
    changed, old = now[kept], before[kept]
    differ = (value[changed] != value[old]) | (value_low[changed] != value_low[old])
    changed, old = changed[differ], old[differ]
    gone = np.flatnonzero((g + 1 >= low) & (g + 1 < high) & ~last)
    gone = gone[at(codes[gone] + 1) < 0]
    return pd.DataFrame(
        {
            "g": np.r_[g[added], g[gone] + 1, g[changed]],
            "kind": np.repeat(np.array([0, 1, 2], np.int32), [len(added), len(gone), len(changed)]),
            "old_row": np.r_[none[: len(added)], row[gone], row[old]],
            "new_row": np.r_[row[added], none[: len(gone)], row[changed]],
        }
    )


def _bucket(block: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        low = int(pdf["run"].iloc[0]) * block
        return differences(*(pdf[c].to_numpy() for c in ("key", "key_low", "g", "value", "value_low", "row", "first", "last")), low, low + block)

    return run


def changes(deliveries: DataFrame, records: DataFrame) -> DataFrame:
    """version_id, kind, key, old_value, new_value of every change.

    deliveries: id, source, time. records: row, version_id, key, value (strings).
    """
    records = records.where("version_id IS NOT NULL AND key IS NOT NULL AND row IS NOT NULL")
    plain = spread(records).select("version_id", "key", "row", column(squeeze_value, "string", F.col("value")).alias("value"))
    # the second half of a hash is that of the text behind another one, and so has another seed
    both = lambda c, n: (F.xxhash64(c).alias(n), F.xxhash64(F.lit("low"), c).alias(f"{n}_low"))
    compact = plain.select("version_id", *both("key", "key"), "row", *both("value", "value")).select("version_id", "key", "key_low", F.struct("row", "value", "value_low").alias("last"))
    compact = cut(compact.groupBy("version_id", "key", "key_low").agg(F.max("last").alias("r")).select("version_id", "key", "key_low", "r.row", "r.value", "r.value_low"))
    full = compact.select("version_id").distinct()
    once = deliveries.where("id IS NOT NULL AND source IS NOT NULL").groupBy("id").agg(F.min("source").alias("source"), F.min("time").alias("time"))
    ordered = numbered(once.join(full, once["id"] == full["version_id"], "left_semi"), ["source", F.col("time").asc_nulls_first(), "id"], "g")
    ordered = cut(ordered.select("id", "source", "g"))
    before = ordered.select((F.col("g") + 1).alias("g"), F.col("source").alias("source_before"))
    after = ordered.select((F.col("g") - 1).alias("g"), F.col("source").alias("source_after"))
    same = lambda c: F.coalesce(F.col("source") == F.col(c), F.lit(False))
    ordered = ordered.join(before, "g", "left").join(after, "g", "left").select("id", "g", (~same("source_before")).alias("first"), (~same("source_after")).alias("last"))
    ordered = cut(ordered)
    placed = compact.join(ordered, compact["version_id"] == ordered["id"]).select("g", "key", "key_low", "value", "value_low", "row", "first", "last")
    run = F.floor(F.col("g") / BLOCK)
    carried = (F.col("g") % BLOCK == BLOCK - 1) & ~F.col("last")
    placed = placed.withColumn("run", F.explode(F.when(carried, F.array(run, run + 1)).otherwise(F.array(run))))
    sizes = small(placed.groupBy("run").agg(F.ceil(F.count("*") / BUCKET_ROWS).alias("buckets")))
    placed = placed.join(sizes, "run").withColumn("bucket", F.pmod("key", F.col("buckets")))
    found = placed.groupBy("run", "bucket").applyInPandas(_bucket(BLOCK), "g long, kind int, old_row long, new_row long")
    found = cut(found.join(ordered.select("g", F.col("id").alias("version_id")), "g").drop("g"))
    wanted = found.select(F.col("old_row").alias("row")).unionAll(found.select(F.col("new_row").alias("row"))).where("row >= 0").distinct()
    full = records.join(wanted, "row", "left_semi").groupBy("row").agg(F.min("key").alias("key"), F.min("value").alias("value"))
    old, new = (full.select(F.col("row").alias(f"{k}_row"), F.col("key").alias(f"{k}_key"), F.col("value").alias(f"{k}_value")) for k in ("old", "new"))
    joined = found.join(old, "old_row", "left").join(new, "new_row", "left")
    names = F.array(*map(F.lit, KINDS))
    return joined.select("version_id", F.element_at(names, F.col("kind") + 1).alias("kind"), F.coalesce("new_key", "old_key").alias("key"), "old_value", "new_value")


def claim_changes(spark: SparkSession, folder: str) -> DataFrame:
    versions = table(spark, folder, "doc_version").select("id", F.col("doc_source").alias("source"), F.col("extracted_at").alias("time"))
    claims = table(spark, folder, "claim").select(F.col("id").alias("row"), "version_id", F.col("claim_key").alias("key"), "value")
    return changes(versions, claims)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return claim_changes(spark, folder).select("version_id", F.col("key").alias("claim_key"), F.col("kind").alias("change_kind"))


def p2_changes(spark: SparkSession, folder: str) -> DataFrame:
    """The changes with the values before and after."""
    return claim_changes(spark, folder).select("version_id", F.col("key").alias("claim_key"), F.col("kind").alias("change_kind"), "old_value", "new_value")


_SQL = f"""
WITH c AS (SELECT version_id, claim_key, value FROM (SELECT *, row_number() OVER (PARTITION BY version_id, claim_key ORDER BY id DESC) AS n FROM claim WHERE version_id IS NOT NULL AND claim_key IS NOT NULL) WHERE n = 1),
v AS (SELECT DISTINCT id, doc_source, extracted_at FROM doc_version WHERE doc_source IS NOT NULL AND id IN (SELECT version_id FROM c)),
o AS (SELECT id, lag(id) OVER (PARTITION BY doc_source ORDER BY extracted_at NULLS FIRST, id) AS before FROM v),
n AS (SELECT id AS version_id, claim_key, value FROM o JOIN c ON c.version_id = o.id WHERE before IS NOT NULL),
b AS (SELECT id AS version_id, claim_key, value FROM o JOIN c ON c.version_id = o.before)
SELECT coalesce(n.version_id, b.version_id) AS version_id, coalesce(n.claim_key, b.claim_key) AS claim_key, CASE WHEN b.version_id IS NULL THEN 'added' WHEN n.version_id IS NULL THEN 'removed' ELSE 'changed' END AS change_kind, b.value AS old_value, n.value AS new_value
FROM n FULL JOIN b ON n.version_id = b.version_id AND n.claim_key = b.claim_key
WHERE n.version_id IS NULL OR b.version_id IS NULL OR {sql.squeeze_value('n.value')} IS DISTINCT FROM {sql.squeeze_value('b.value')}
"""
P2_FOUND_SQL = f"SELECT version_id, claim_key, change_kind FROM ({_SQL})"
P2_CHANGES_SQL = _SQL
