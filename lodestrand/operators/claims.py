"""Versioned claims: snapshots, what changed and how gravely, and who is affected."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrand.functions import text as X
from lodestrand.functions.unicode import column
from lodestrand.operators.ordering import numbered

# Types whose changes weigh heavily, and the order of severities.
GRAVE = ("interval", "threshold", "policy")
SEVERITIES = ("high", "medium", "recheck", "low", "none")
# The units that a normal form of a value knows, as spelled and as kept.
UNITS = {"km": "km", "公里": "km", "千米": "km", "个月": "month", "月": "month", "年": "year", "mm": "mm", "毫米": "毫米", "%": "%"}
AMOUNT = re.compile(rf"(\d+(?:\.\d+)?)\s*(?:(万)?\s*(km|公里|千米)|(个月|月|年|mm|毫米|%))")


def claim_key(source: Column, kind: Column, subject: Column, predicate: Column) -> Column:
    return F.concat(F.lit("ck_"), F.substring(F.sha1(F.concat_ws("|", source, kind, subject, predicate)), 1, 16))


def latest_versions(versions: DataFrame, most: int = 1) -> DataFrame:
    """The latest `most` versions of each document, by id, with `age` 1 for the latest."""
    once = versions.where("id IS NOT NULL").dropDuplicates(["id"])
    age = F.row_number().over(Window.partitionBy("doc_source").orderBy(F.desc("id")))
    return once.withColumn("age", age).where(F.col("age") <= most)


def qualifiers(c: Column) -> Column:
    """The sorted qualifiers of a JSON list; none if it is broken."""
    return F.array_sort(F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>")))


def normal_value(text: str | None) -> str | None:
    """The amounts of a value in a mechanical normal form such as 8000km|8month; None if it states none."""
    found = AMOUNT.findall((text or "").lower().replace(",", "").replace("，", ""))
    parts = {f"{float(number) * (10_000 if many else 1):g}{UNITS[road or other]}" for number, many, road, other in found}
    return "|".join(sorted(parts)) or None


def normalize_value(c: Column) -> Column:
    """`normal_value` of a column, in Arrow batches, as numbers are printed in their shortest form."""
    return column(normal_value, "string", c)


def change_class(old_value: Column, new_value: Column, old_norm: Column, new_norm: Column, old_q: Column, new_q: Column) -> Column:
    """unchanged, qualifier_changed or modified of a claim that is in both versions."""
    same = (X.strip(old_value) == X.strip(new_value)) | F.coalesce(old_norm == new_norm, F.lit(False))
    return F.when(same & (old_q == new_q), "unchanged").when(same, "qualifier_changed").otherwise("modified")


def severity(change: Column, kind: Column) -> Column:
    return F.when(change.isin("modified", "removed"), F.when(kind.isin(*GRAVE), "high").otherwise("medium")).when(change == "qualifier_changed", "medium").when(change == "added", "low").otherwise("none")


def diff_latest(versions: DataFrame, claims: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """doc_source, claim_key, change, severity, subject, recheck between the two latest versions of each document.

    Of several claims of one key in a version the last row counts. Values without a stored normal
    form get theirs. Changes that may be jitter of the extraction are of severity `recheck`: an
    addition without a normal form and, where `texts` (doc_source, text) are given, a removal whose
    evidence still stands in the document.
    """
    two = latest_versions(versions, 2).select(F.col("id").alias("version_id"), "doc_source", "age")
    full = two.join(two.where("age = 2").select("doc_source"), "doc_source", "left_semi")
    value = F.struct("id", "claim_type", "subject", F.coalesce("value", F.lit("")).alias("value"), F.coalesce(F.nullif("value_normalized", F.lit("")), "_norm").alias("norm"), qualifiers(F.col("qualifiers")).alias("q"), "evidence")
    last = claims.join(two, "version_id", "left_semi").withColumn("_norm", normalize_value(F.col("value"))).select("version_id", "claim_key", value.alias("c")).where("claim_key IS NOT NULL").groupBy("version_id", "claim_key").agg(F.max_by("c", "c.id").alias("c"))
    own = last.join(full, "version_id").select("doc_source", "claim_key", "age", "c")
    old, new = (own.where(f"age = {k}").select("doc_source", "claim_key", F.col("c").alias(n)) for k, n in ((2, "old"), (1, "new")))
    both = old.join(new, ["doc_source", "claim_key"], "full_outer")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise(change_class(*(F.col(f"{s}.{f}") for f in ("value", "norm", "q") for s in ("old", "new"))))
    kind = F.coalesce("new.claim_type", "old.claim_type")
    out = both.select("doc_source", "claim_key", change.alias("change"), kind.alias("kind"), F.coalesce("new.subject", "old.subject").alias("subject"), ((change == "added") & F.col("new.norm").isNull()).alias("jitter"), F.col("old.evidence").alias("evidence"))
    gone, rest = out.where("change = 'removed'"), out.where("change <> 'removed'")
    if texts is not None:
        now = texts.groupBy("doc_source").agg(F.min("text").alias("_text"))
        gone = gone.join(now, "doc_source", "left").withColumn("jitter", F.coalesce(evidence_holds(F.col("evidence"), F.col("_text")), F.lit(False))).drop("_text")
    grave = F.when(F.col("jitter"), "recheck").otherwise(severity(F.col("change"), F.col("kind")))
    return rest.unionByName(gone).select("doc_source", "claim_key", "change", grave.alias("severity"), "subject", F.col("jitter").alias("recheck"))


def in_order(changes: DataFrame) -> list[Column]:
    """The order in which changes are listed: by severity, then subject; a total one by document and key."""
    return [F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity")), F.col("subject"), F.col("doc_source"), F.col("claim_key")]


def counters(changes: DataFrame) -> DataFrame:
    """doc_source and how many changes of each class, in one row per document."""
    kinds = ("added", "removed", "modified", "qualifier_changed", "unchanged")
    return changes.groupBy("doc_source").agg(*(F.count_if(F.col("change") == k).alias(k) for k in kinds))


def reuse_plan(chunks: DataFrame, known: DataFrame) -> DataFrame:
    """chunk_id, content_hash, reusable: whether the chunk's text was seen unchanged before.

    chunks: chunk_id, text. known: chunk_id, content_hash.
    """
    now = chunks.select("chunk_id", X.content_hash(F.col("text")).alias("content_hash"))
    before = known.select("chunk_id", F.col("content_hash").alias("old_hash"))
    return now.join(before, "chunk_id", "left").select("chunk_id", "content_hash", F.coalesce(F.col("content_hash") == F.col("old_hash"), F.lit(False)).alias("reusable"))


def impact(versions: DataFrame, claims: DataFrame, word: str) -> DataFrame:
    """doc_source, n: how many claims of each document's latest version hold a word in subject, predicate or value."""
    return listing(versions, claims, word).groupBy("doc_source").agg(F.count("*").alias("n"))


def listing(versions: DataFrame, claims: DataFrame, word: str) -> DataFrame:
    """The claims of each document's latest version that hold a word in subject, predicate or value."""
    newest = latest_versions(versions).select(F.col("id").alias("version_id"))
    held = F.lit(False)
    for c in ("subject", "predicate", "value"):
        held = held | F.coalesce(F.col(c).ilike(f"%{word}%"), F.lit(False))
    return claims.dropDuplicates(["id"]).where(held).join(newest, "version_id", "left_semi")


def evidence_holds(evidence: Column, text: Column) -> Column:
    """Whether the text still has the first 40 characters of the evidence, white space aside."""
    bare = lambda c: F.regexp_replace(c, r"\s+", "")
    own = F.substring(bare(evidence), 1, 40)
    return F.when(own != "", F.contains(bare(text), own)).otherwise(F.lit(False))


def tolerant_json(c: Column, schema: str) -> Column:
    """The first JSON value in a text, fenced or with words around it and commas before closing brackets; null if there is none."""
    inner = F.regexp_extract(c, r"(?s)[\[{].*[\]}]", 0)
    return F.from_json(F.regexp_replace(inner, r",\s*([\]}])", "$1"), schema)


def accepted(found: DataFrame, chunks: DataFrame) -> DataFrame:
    """Extracted claims whose evidence stands in their chunk, white space aside. found: chunk_id, evidence, ...; chunks: chunk_id, text."""
    bare = lambda c: F.regexp_replace(c, r"\s+", "")
    both = found.join(chunks.select("chunk_id", F.col("text").alias("_text")), "chunk_id")
    return both.where((bare(F.col("evidence")) != "") & F.contains(bare(F.col("_text")), bare(F.col("evidence")))).drop("_text")


def severities(changes: DataFrame) -> DataFrame:
    """doc_source, changes by severity, in one row per document."""
    n = lambda s: F.count_if(F.col("severity") == s).alias(s)
    return changes.groupBy("doc_source").agg(*map(n, SEVERITIES))


CLAIM = "claim_key string, doc_source string, section string, claim_type string, subject string, predicate string, value string, value_normalized string, qualifiers string, evidence string, chunk_id string"


def extract(chunks: DataFrame, known: DataFrame, before: DataFrame, extractor) -> tuple[DataFrame, DataFrame]:
    """The claims of a new version of documents, and its chunk hashes.

    chunks: chunk_id, doc_source, section, text. known: chunk_id, content_hash of the version before;
    before: its claims (CLAIM). Claims of chunks whose text is unchanged are taken over; only other
    chunks go to the `extractor`, which gives chunk_id, claim_type, subject, predicate, value,
    qualifiers, evidence of what it finds. What has no evidence in its chunk is dropped, and values get
    their normal forms. Of several claims of one key the first by chunk stays.
    """
    plan = reuse_plan(chunks.select("chunk_id", "text"), known)
    fresh = chunks.join(plan.where("NOT reusable").select("chunk_id"), "chunk_id", "left_semi")
    found = accepted(extractor(fresh), fresh.select("chunk_id", "text")).join(fresh.select("chunk_id", "doc_source", "section"), "chunk_id")
    named = found.withColumn("claim_key", claim_key(*map(F.col, ("doc_source", "claim_type", "subject", "predicate")))).withColumn("value_normalized", normalize_value(F.col("value")))
    columns = [c.split()[0] for c in CLAIM.split(", ")]
    kept = before.join(plan.where("reusable").select("chunk_id"), "chunk_id", "left_semi")
    both = kept.select(*columns).unionByName(named.select(*columns))
    first = both.groupBy("doc_source", "claim_key").agg(F.min_by(F.struct(*columns), F.struct("chunk_id", "value")).alias("c")).select("c.*")
    return first, plan.select("chunk_id", "content_hash")


def next_version(versions: DataFrame, doc_source: DataFrame) -> DataFrame:
    """doc_source, id of the versions to come: ids go on behind the highest there is, in the order of sources."""
    last = versions.agg(F.max("id")).first()[0] or 0
    return numbered(doc_source.select("doc_source").distinct(), ["doc_source"], "_n").select("doc_source", (F.col("_n") + last + 1).alias("id"))
