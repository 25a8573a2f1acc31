"""Which documents to index: the difference between what is delivered and what is registered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrand.session import cut


def plan(delivered: DataFrame, registry: DataFrame, rebuild: bool = False, only: list[str] | None = None) -> DataFrame:
    """source, status of every source: indexed (new or changed), skipped, failed (empty), deleted.

    delivered: source, checksum, n_chars. registry: source, checksum. With `only`, other sources
    are left alone and nothing counts as deleted. Failed sources keep their entry.
    """
    now = delivered if only is None else delivered.where(F.col("source").isin(only))
    both = now.alias("n").join(registry.alias("r"), "source", "full_outer" if only is None else "left")
    there = F.col("n.checksum").isNotNull() | F.col("n.n_chars").isNotNull()
    same = F.col("n.checksum").eqNullSafe(F.col("r.checksum")) & F.lit(not rebuild)
    status = F.when(~there, "deleted").when(F.coalesce(F.col("n.n_chars"), F.lit(0)) == 0, "failed").when(same, "skipped").otherwise("indexed")
    known = F.when(F.col("r.checksum").isNull(), "new").otherwise("known")
    return both.select("source", status.alias("status"), known.alias("known"))


def counters(planned: DataFrame) -> DataFrame:
    return planned.groupBy("status", "known").agg(F.count("*").alias("n"))


def apply(registry: DataFrame, delivered: DataFrame, planned: DataFrame) -> DataFrame:
    """The registry after a run: indexed sources with their new entries, deleted ones gone, the rest unchanged."""
    new = delivered.join(planned.where("status = 'indexed'").select("source"), "source", "left_semi")
    gone = planned.where("status IN ('indexed', 'deleted')").select("source")
    return registry.join(gone, "source", "left_anti").unionByName(new.select(*registry.columns))


LAST_RUN = "finished timestamp, indexed long, skipped long, failed long, deleted long, rebuild boolean, version long"


def run(registry, runs, delivered: DataFrame, rebuild: bool = False, only: list[str] | None = None) -> dict[str, int]:
    """One ingest against a registry table: plans, takes in new and changed sources, takes deleted ones out; gives the counters.

    registry: a store.Table by source (source, checksum, n_chars, ...). runs: a store.Table of LAST_RUN, to
    which the run is added. A run that changes nothing writes nothing to the registry, so its version,
    which tells caches whether the index is another one, rises only with a change.
    """
    planned = cut(plan(delivered, registry.read(), rebuild, only))
    n = {r["status"]: r["n"] for r in planned.groupBy("status").agg(F.count("*").alias("n")).collect()}
    if n.get("indexed"):
        registry.upsert(delivered.join(planned.where("status = 'indexed'").select("source"), "source", "left_semi"), ["source"])
    if n.get("deleted"):
        registry.delete(planned.where("status = 'deleted'").select("source"), ["source"])
    out = {k: int(n.get(k, 0)) for k in ("indexed", "skipped", "failed", "deleted")} | {"version": registry.version()}
    spark = delivered.sparkSession
    runs.append(spark.range(1).select(F.current_timestamp().alias("finished"), *(F.lit(out[k]).cast("long").alias(k) for k in ("indexed", "skipped", "failed", "deleted")), F.lit(rebuild).alias("rebuild"), F.lit(out["version"]).cast("long").alias("version")))
    return out
