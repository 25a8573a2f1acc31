"""Sources: document folders, evaluation sets, registries, reports, anchored pages."""

from __future__ import annotations

import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.functions import text as X

SUFFIXES = ("md", "txt", "pdf", "docx")
ITEM = "id: string, category: string, question: string, ground_truth: string, expected_sources: array<string>, expected_keywords: array<string>, expected_snippets: array<string>, must_refuse: boolean, notes: string, session_id: string, turn: int"


def decode(content: bytes) -> str:
    """UTF-8, else GB18030, else UTF-8 without what can't be read."""
    for name in ("utf-8", "gb18030"):
        try:
            return content.decode(name)
        except UnicodeDecodeError:
            pass
    return content.decode("utf-8", "ignore")


def extract(content: bytes, suffix: str) -> tuple[str | None, str | None]:
    """(text, error) of a file's content; PDF and DOCX need pypdf and python-docx."""
    try:
        if suffix == "pdf":
            import pypdf

            pages = []
            for page in pypdf.PdfReader(io.BytesIO(content)).pages:
                try:
                    pages.append(page.extract_text() or "")
                except Exception:  # a page that can't be read is passed over
                    continue
            return "\n\n".join(pages), None
        if suffix == "docx":
            import docx

            document = docx.Document(io.BytesIO(content))
            rows = [f"| {' | '.join(c.text.strip() for c in r.cells)} |" for t in document.tables for r in t.rows]
            return "\n".join([*(p.text for p in document.paragraphs), *rows]), None
        return decode(content), None
    except Exception as error:  # a file that can't be read is a row with an error, not a failed job
        return None, f"{type(error).__name__}: {error}"


def _extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        found = [extract(c, s) for c, s in zip(pdf["content"], pdf["suffix"])]
        yield pdf.drop(columns="content").assign(raw=[f[0] for f in found], error=[f[1] for f in found])


def files(spark: SparkSession, folder: str) -> DataFrame:
    """source, suffix, length, content and `rejected` of all files, hidden and lock files left out."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    base = F.regexp_replace(F.lit(folder.rstrip("/") + "/"), r"^file:/*", "/")
    path = F.regexp_replace("path", r"^file:/*", "/")
    df = df.withColumn("source", F.replace(path, base, F.lit(""))).withColumn("name", X.file_name(F.col("source")))
    df = df.where(~F.col("name").rlike(r"^(\.|~\$)")).withColumn("suffix", F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1)))
    return df.select("source", "name", "suffix", "length", "content", (~F.col("suffix").isin(*SUFFIXES)).alias("rejected"))


def title(text: Column, name: Column) -> Column:
    """The first level-one heading, else the first line that isn't blank, else the file's stem; at most 80 characters."""
    heading = F.nullif(F.regexp_extract(text, r"(?m)^\s{0,3}#\s+(.+?)\s*$", 1), F.lit(""))
    line = F.nullif(F.trim(F.regexp_extract(text, r"(?m)^\s*(\S.*)$", 1)), F.lit(""))
    return F.substring(F.coalesce(heading, line, F.regexp_replace(name, r"\.[^.]+$", "")), 1, 80)


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, source, title, text, checksum, metadata, error of the accepted files of a folder."""
    read = files(spark, folder).where("NOT rejected").mapInPandas(_extract, "source string, name string, suffix string, length long, rejected boolean, raw string, error string")
    text = X.normalize(F.col("raw"))
    df = read.withColumn("text", text)
    error = F.coalesce("error", F.when(F.coalesce("text", F.lit("")) == "", F.lit("empty")))
    meta = F.create_map(F.lit("filename"), F.col("name"), F.lit("suffix"), F.col("suffix"), F.lit("size_bytes"), F.col("length").cast("string"))
    return df.select(X.stable_id(F.col("source")).alias("doc_id"), "source", title(F.col("text"), F.col("name")).alias("title"), "text", F.sha2("text", 256).alias("checksum"), meta.alias("metadata"), error.alias("error"))


def evaluation_set(spark: SparkSession, path: str) -> DataFrame:
    """One row per item of an evaluation set file {name, version, items: [...]}."""
    whole = spark.read.option("multiLine", True).schema(f"name string, version string, items array<struct<{ITEM}>>").json(path)
    return whole.select(F.col("name").alias("dataset"), "version", F.explode("items").alias("i")).select("dataset", "version", "i.*")


REGISTRY = "source string, doc_id string, checksum string, chunks int, title string"


def registry(spark: SparkSession, path: str) -> DataFrame:
    """source, doc_id, checksum, chunks, title of a registry table; empty only if there is none yet: what can't be read is an error."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)
    return spark.read.schema(REGISTRY).parquet(path) if there else spark.createDataFrame([], REGISTRY)


def reports(spark: SparkSession, folder: str) -> DataFrame:
    """file and dataset of saved reports, newest first; broken files are passed over."""
    df = spark.read.option("multiLine", True).option("mode", "PERMISSIVE").schema("dataset string, run string, _corrupt_record string").json(f"{folder}/report_*.json")
    return df.withColumn("file", X.file_name(F.input_file_name())).where("_corrupt_record IS NULL").orderBy(F.desc("file")).select("file", "dataset", "run")


def anchors(spark: SparkSession, folder: str) -> DataFrame:
    """page, state, path: the files that pages name as their sources in front matter; state bound, frozen or unbound."""
    df = spark.read.text(f"{folder}/*.md", wholetext=True).withColumn("page", X.file_name(F.input_file_name()))
    head = F.when(F.col("value").startswith("---"), F.try_element_at(F.split("value", "(?m)^---[ \t]*$", 3), F.lit(2))).otherwise(F.lit(""))
    paths = F.regexp_extract_all(head, F.lit(r"(?m)^\s*-\s+(\S+)\s*$"), F.lit(1))
    state = F.when(head.rlike(r"(?m)^frozen:\s*true"), "frozen").when(F.size(paths) > 0, "bound").otherwise("unbound")
    return df.select("page", state.alias("state"), F.explode_outer(paths).alias("path"))
