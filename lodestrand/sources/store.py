"""Sinks: keyed tables that are upserted, replaced by key, appended to or deleted from, bucket by bucket.

A table is a folder of written parts and of numbered manifests. Rows lie in buckets by a hash of the
table's keys, and a write touches the buckets of its rows only: their parts are written anew, or added
to, and all others are taken over by name. Readers see the manifest with the highest number, which names
every bucket's parts, so a failed or lost job leaves the table as it was. A writer first makes the lock
of the next number, which only one can: a second writer fails and doesn't overwrite the first one's work.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrand.session import cut

BUCKETS = 64


class Table:
    """`keys` place the rows; operations by these keys, or by more, touch the buckets of their rows only, others all."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, keys: list[str] | None = None, buckets: int = BUCKETS):
        self.spark, self.folder, self.schema, self.buckets = spark, folder.rstrip("/"), schema, buckets
        self.columns = spark.createDataFrame([], schema).columns
        self.keys = keys or self.columns[:1]
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self.path = hadoop.Path
        self.fs = hadoop.Path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The number of the last manifest, 0 if there is none."""
        if not self.fs.exists(self.path(self.folder)):
            return 0
        names = (s.getPath().getName() for s in self.fs.listStatus(self.path(self.folder)))
        return max((int(m[1]) for m in map(re.compile(r"manifest-(\d+)").fullmatch, names) if m), default=0)

    def parts(self, version: int | None = None) -> dict[int, list[str]]:
        """The parts of each bucket that has any."""
        now = self.version() if version is None else version
        if not now:
            return {}
        text = "\n".join(r["value"] for r in self.spark.read.text(f"{self.folder}/manifest-{now}").collect())
        return {int(b): parts for b, parts in json.loads(text).items()}

    def read(self, buckets: set[int] | None = None) -> DataFrame:
        """The table, or what lies in some of its buckets."""
        wanted = [f"{self.folder}/{p}" for b, parts in self.parts().items() if buckets is None or b in buckets for p in parts]
        return self.spark.read.schema(self.schema).parquet(*wanted) if wanted else self.spark.createDataFrame([], self.schema)

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def buckets_of(self, rows: DataFrame, keys: list[str]) -> set[int] | None:
        """The buckets in which rows of these keys lie; None if the keys don't tell."""
        if not set(self.keys) <= set(keys):
            return None
        return {r["b"] for r in rows.select(self.bucket().alias("b")).distinct().collect()}

    def _commit(self, rows: DataFrame | None, replaced: set[int] | None, base: int) -> int:
        """A manifest after `base` with the parts of `rows`: in place of those of the replaced buckets (None: of all), beside the others."""
        new = base + 1
        lock = self.path(f"{self.folder}/lock-{new}")
        try:
            self.fs.create(lock, False).close()
        except Exception as error:
            raise RuntimeError(f"another writer is at version {new} of {self.folder}") from error
        try:
            if self.version() != base:
                raise RuntimeError(f"{self.folder} was written since version {base} was read")
            now = {b: p for b, p in self.parts(base).items() if replaced is not None and b not in replaced}
            if rows is not None:
                rows.select(*self.columns, self.bucket().alias("_bucket")).repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.folder}/v{new}")
                for s in self.fs.listStatus(self.path(f"{self.folder}/v{new}")):
                    if m := re.fullmatch(r"_bucket=(\d+)", s.getPath().getName()):
                        now.setdefault(int(m[1]), []).append(f"v{new}/{m[0]}")
            draft = self.path(f"{self.folder}/draft-{new}")
            out = self.fs.create(draft, True)
            out.write(bytearray(json.dumps(now).encode()))
            out.close()
            if not self.fs.rename(draft, self.path(f"{self.folder}/manifest-{new}")):
                raise RuntimeError(f"version {new} of {self.folder} couldn't be named")
        finally:
            self.fs.delete(lock, False)
        return new

    def _start(self) -> int:
        base = self.version()
        if self.fs.exists(self.path(f"{self.folder}/lock-{base + 1}")):
            raise RuntimeError(f"another writer is at version {base + 1} of {self.folder}; delete its lock if it is lost")
        return base

    def write(self, rows: DataFrame) -> int:
        """The table is these rows from now on."""
        return self._commit(rows, None, self._start())

    def append(self, rows: DataFrame) -> int:
        """Rows are added; what is there isn't read or written."""
        return self._commit(rows, set(), self._start())

    def upsert(self, rows: DataFrame, keys: list[str]) -> int:
        """Rows replace those of the same keys. Of several new rows of one key one stays."""
        base, new = self._start(), cut(rows.select(*self.columns).dropDuplicates(keys))
        touched = self.buckets_of(new, keys)
        return self._commit(self.read(touched).join(new.select(*keys), keys, "left_anti").select(*self.columns).unionByName(new), touched, base)

    def insert_new(self, rows: DataFrame, keys: list[str]) -> int:
        """Rows whose keys aren't there yet are added; gives how many."""
        base, own = self._start(), cut(rows.select(*self.columns).dropDuplicates(keys))
        new = cut(own.join(self.read(self.buckets_of(own, keys)).select(*keys), keys, "left_anti").select(*self.columns))
        if n := new.count():
            self._commit(new, set(), base)
        return n

    def replace_latest(self, rows: DataFrame, keys: list[str], order: str) -> int:
        """The newest row of each key, among the old and the new, stays."""
        base, new = self._start(), cut(rows.select(*self.columns))
        touched = self.buckets_of(new, keys)
        w = Window.partitionBy(*keys).orderBy(F.desc(order))
        both = self.read(touched).unionByName(new).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
        return self._commit(both, touched, base)

    def delete(self, which: DataFrame, keys: list[str]) -> int:
        """The rows of these keys go; gives how many they were."""
        base, gone = self._start(), cut(which.select(*keys).distinct())
        touched = self.buckets_of(gone, keys)
        old = self.read(touched)
        kept = cut(old.join(gone, keys, "left_anti").select(*self.columns))
        n = old.count() - kept.count()
        if n:
            self._commit(kept, touched, base)
        return n

    def reset(self) -> int:
        return self._commit(None, None, self._start())

    def vacuum(self, keep: int = 2) -> int:
        """Deletes manifests and parts that the last `keep` versions don't name; gives how many folders went."""
        now, used, gone = self.version(), set(), 0
        for v in range(max(1, now - keep + 1), now + 1):
            used |= {p.split("/")[0] for parts in self.parts(v).values() for p in parts}
        for s in self.fs.listStatus(self.path(self.folder)) if now else ():
            name = s.getPath().getName()
            m = re.fullmatch(r"(?:v|manifest-)(\d+)", name)
            if m and int(m[1]) <= now - (keep if name.startswith("m") else 0) and name not in used:
                self.fs.delete(s.getPath(), True)
                gone += name.startswith("v")
        return gone
