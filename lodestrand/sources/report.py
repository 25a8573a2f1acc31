"""Reports of runs: a JSON file and a Markdown page of summary tables. Summaries are small by nature; their size is checked."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession

MOST_ROWS = 10_000


def collected(df: DataFrame) -> list[dict]:
    """The rows of a summary, refused if it is none."""
    rows = df.limit(MOST_ROWS + 1).collect()
    if len(rows) > MOST_ROWS:
        raise ValueError(f"a summary of more than {MOST_ROWS} rows")
    return [r.asDict(recursive=True) for r in rows]


def markdown(title: str, summaries: dict[str, list[dict]]) -> str:
    out = [f"# {title}"]
    for name, rows in summaries.items():
        out.append(f"\n## {name}\n")
        if rows:
            columns = list(rows[0])
            out += [f"| {' | '.join(columns)} |", f"|{' --- |' * len(columns)}"]
            out += [f"| {' | '.join('' if r[c] is None else str(r[c]) for c in columns)} |" for r in rows]
    return "\n".join(out) + "\n"


def save(spark: SparkSession, folder: str, dataset: str, summaries: dict[str, DataFrame], run: str | None = None) -> str:
    """Writes report_RUN.json and report_RUN.md into a folder of any file system that Spark writes to; gives the run's name."""
    run = run or time.strftime("%Y%m%d-%H%M%S", time.gmtime())
    rows = {k: collected(df) for k, df in summaries.items()}
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    for ending, text in (("json", json.dumps({"dataset": dataset, "run": run, "summaries": rows}, default=str)), ("md", markdown(f"{dataset} {run}", rows))):
        path = hadoop.Path(f"{folder}/report_{run}.{ending}")
        out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path, True)
        out.write(bytearray(text.encode("utf-8")))
        out.close()
    return run
