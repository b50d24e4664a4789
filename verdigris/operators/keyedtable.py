"""A stored table with one row for each key, in versions.

Rows lie in buckets by a hash of their key; a bucket is a folder of Parquet files that is never changed. Merging rewrites the buckets that
have keys of the new rows and no others, beside the old ones, and then makes a pointer (sources.versions) that names each bucket's folder.
So reading costs one version, a merge costs the buckets that it touches, and one that fails, or that another writer was faster than,
leaves the table as it was. A bucket is one task's work in a merge: resize() deals the rows to more buckets when they have grown.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from verdigris.sources.versions import Conflict, Versions

#: Buckets of a new table, bytes of a bucket beyond which grown() says so, and attempts of a merge against other writers.
BUCKETS, BUCKET_BYTES, ATTEMPTS = 64, 256 << 20, 5


class KeyedTable:
    """The table under a root folder, keyed by one column. Rows without a key count as one key."""

    def __init__(self, spark: SparkSession, root: str, key: str, buckets: int = BUCKETS) -> None:
        self.spark, self.key, self.buckets = spark, key, buckets
        self.versions = Versions(spark, root)
        self.root = self.versions.root

    def _bucket(self, n: int) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(n)).cast("int")

    def _rows(self, pointer: dict, only: list[str] | None = None) -> DataFrame | None:
        """A version's rows, of some buckets or all; None before the first version."""
        if "schema" not in pointer:
            return None
        schema = StructType.fromJson(pointer["schema"])
        paths = [f"{self.root}/data/{name}/_b={b}" for b, name in pointer["folders"].items() if only is None or b in only]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of the last version, or of one that still is there."""
        rows = self._rows(self.versions.read(version))
        if rows is None:
            raise ValueError(f"nothing was merged into {self.root} yet")
        return rows

    def _write(self, rows: DataFrame, buckets: int) -> dict[str, str]:
        """Write rows (with _b) and give the folder of each bucket that has some."""
        name = uuid.uuid4().hex
        rows.write.partitionBy("_b").parquet(f"{self.root}/data/{name}")
        return {n[3:]: name for n in self.versions._names(f"data/{name}") if n.startswith("_b=")}

    def merge(self, new: DataFrame, order: list[Column], keep_old: bool = False, batch: tuple[str, int] | None = None) -> dict:
        """Take new rows in and give the version's pointer. The first of a key's rows by order stays; on ties a new row before an old one, or with
        keep_old always the old one. batch: a source's name and its running number; what a source has merged before isn't merged again."""
        staged = f"{self.root}/staged/{uuid.uuid4().hex}"
        written = 0
        for _ in range(ATTEMPTS):
            base = self.versions.read()
            if batch and base.get("batches", {}).get(batch[0], -1) >= batch[1]:
                return base
            n = base.get("buckets", self.buckets)
            if written != n:  # the new rows are worked out once, whatever happens to the table meanwhile
                new.withColumn("_b", self._bucket(n)).repartition("_b").write.mode("overwrite").partitionBy("_b").parquet(staged)
                written = n
            touched = [x[3:] for x in self.versions._names(staged.removeprefix(f"{self.root}/")) if x.startswith("_b=")]
            fresh = self.spark.read.schema(new.schema).parquet(*[f"{staged}/_b={b}" for b in touched]) if touched else new.limit(0)
            old = self._rows(base, touched)
            both = fresh.withColumn("_age", F.lit(1))
            if old is not None:
                both = both.unionByName(old.withColumn("_age", F.lit(0)), allowMissingColumns=True)
            by = [F.asc("_age"), *order] if keep_old else [*order, F.desc("_age")]
            dealt = both.withColumn("_b", self._bucket(n)).repartition(max(1, len(touched)), "_b")
            first = dealt.withColumn("_n", F.row_number().over(Window.partitionBy("_b", self.key).orderBy(*by))).filter("_n = 1").drop("_n", "_age")
            folders = {**base.get("folders", {}), **(self._write(first, n) if touched else {})}
            schema = first.drop("_b").schema
            for f in schema.fields:
                f.nullable = True
            content = {"buckets": n, "schema": schema.jsonValue(), "folders": folders, "batches": {**base.get("batches", {}), **({batch[0]: batch[1]} if batch else {})}}
            try:
                done = self.versions.commit(base, content)
            except Conflict:
                continue
            self.versions._fs.delete(self.versions._path(staged), True)
            return done
        raise Conflict(f"other writers were faster {ATTEMPTS} times")

    def upsert(self, new: DataFrame, seq: str, batch: tuple[str, int] | None = None) -> dict:
        """The row of each key that was written last (greatest seq; new before old on ties) stays."""
        return self.merge(new, [F.desc(seq)], batch=batch)

    def insert(self, new: DataFrame, order: list[Column], batch: tuple[str, int] | None = None) -> dict:
        """Rows whose key is there are left out; the first of each other key comes in."""
        return self.merge(new, order, keep_old=True, batch=batch)

    def _touch(self, change: Callable[[dict], dict]) -> dict:
        base = self.versions.read()
        return self.versions.commit(base, change(base))

    def grown(self) -> bool:
        """Whether buckets have become larger, on the mean, than one task should rewrite."""
        pointer = self.versions.read()
        sizes = [self.versions._fs.getContentSummary(self.versions._path(f"{self.root}/data/{name}/_b={b}")).getLength() for b, name in pointer.get("folders", {}).items()]
        return bool(sizes) and sum(sizes) / len(sizes) > BUCKET_BYTES

    def resize(self, buckets: int) -> dict:
        """A version with the same rows in another number of buckets."""

        def change(base: dict) -> dict:
            rows = self._rows(base)
            if rows is None:
                raise ValueError(f"nothing was merged into {self.root} yet")
            return {**base, "buckets": buckets, "folders": self._write(rows.withColumn("_b", self._bucket(buckets)).repartition(buckets, "_b"), buckets)}

        return self._touch(change)

    def expire(self, keep: int = 1) -> list[str]:
        """Delete what only older versions name, and what failed merges have left. Not while a merge runs."""
        return self.versions.expire(keep, "data", lambda v: v.get("folders", {}).values()) + self.versions.expire(keep, "staged", lambda v: ())
