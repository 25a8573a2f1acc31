"""Dense numbering and running sums in a global order without gathering any group in one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrand.session import cut


def numbered(df: DataFrame, keys: list, name: str, partitions: int | None = None) -> DataFrame:
    """`df` with a column `name`: 0, 1, 2, ... in the order of `keys`, which must order it totally.

    The rows are range-partitioned and sorted within partitions, so a key that holds most rows is
    split like any other run of rows. Only one count per partition goes to the driver.
    """
    spark = df.sparkSession
    count = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = cut(df.repartitionByRange(count, *keys).sortWithinPartitions(*keys))
    placed = ordered.withColumn("_at", F.monotonically_increasing_id())
    part = F.shiftright("_at", 33)
    sizes = {r["p"]: r["n"] for r in placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
    starts, total = [], 0
    for p in sorted(sizes):
        starts.append((p, total))
        total += sizes[p]
    offsets = F.broadcast(spark.createDataFrame(starts or [(0, 0)], "_p long, _start long"))
    row = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(offsets, part == F.col("_p")).withColumn(name, F.col("_start") + row).drop("_at", "_p", "_start")


def running(df: DataFrame, keys: list[str], weight: str, name: str, partitions: int | None = None) -> DataFrame:
    """`df` with a column `name`: the sum of `weight` over all rows up to and with this one, in the order of `keys`.

    Rows are range-partitioned like in `numbered`; a partition adds up its own, and only one sum per
    partition goes to the driver. The keys must order the rows totally.
    """
    spark = df.sparkSession
    count = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = cut(df.repartitionByRange(count, *keys).sortWithinPartitions(*keys)).withColumn("_p", F.spark_partition_id())
    sums = {r["_p"]: r["n"] for r in ordered.groupBy("_p").agg(F.sum(weight).alias("n")).collect()}
    before = dict(zip(sorted(sums), np.cumsum([0, *(sums[p] for p in sorted(sums))]).tolist()))

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for pdf in batches:
            if len(pdf):
                total = before[int(pdf["_p"].iloc[0])] if total is None else total
                run = total + np.cumsum(pdf[weight].to_numpy())
                total = int(run[-1])
                yield pdf.drop(columns="_p").assign(**{name: run})

    fields = ", ".join(f"`{c}` {t}" for c, t in df.dtypes)
    return ordered.mapInPandas(add, f"{fields}, `{name}` long")
