"""Sharding by size-tiered compaction with a versioned manifest.

A root folder holds immutable runs (folders of Parquet shards) and manifests. Arrivals are appended as
small runs; runs of one size tier are merged, when there are FANOUT of them, into one run of shards of
about the target size. A merge is a read and a write, with a shuffle only where a shard is too large and must be split.
Readers see what a manifest lists and nothing else; a version is committed by renaming its manifest into place without
overwriting, so of two writers one fails and tries again from the new version. Only metadata reaches the driver.

Defined cases: an empty table makes a version without runs that has its schema. Rows are never changed: repeated rows and nulls
stay as they are, extra columns too, whatever their names. A null arrival value is an arrival of its own. Very long texts are
copied like any others; a shard is never smaller than one row.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from verdigris.llm import common

#: Shards' target size, the size under which all runs are in tier 0, and the runs of a tier that are merged.
TARGET_BYTES, TIER_BYTES, FANOUT = 64 << 20, 1 << 20, 4


class ShardStore:
    """Runs and manifests under a root folder of any file system that Spark can write."""

    def __init__(self, spark: SparkSession, root: str, target_bytes: int = TARGET_BYTES, tier_bytes: int = TIER_BYTES, fanout: int = FANOUT) -> None:
        self.spark = spark
        self.target_bytes, self.tier_bytes, self.fanout = target_bytes, tier_bytes, fanout
        self._fs = self._path(root).getFileSystem(spark._jsc.hadoopConfiguration())
        self.root = self._fs.makeQualified(self._path(root)).toString()  # as listings spell it
        self._fs.mkdirs(self._path(f"{self.root}/manifests"))

    def _path(self, at: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(at)

    def _bytes(self, at: str) -> int:
        return self._fs.getContentSummary(self._path(at)).getLength()

    def versions(self) -> list[int]:
        return sorted(int(name[1:-5]) for s in self._fs.listStatus(self._path(f"{self.root}/manifests")) if (name := s.getPath().getName()).startswith("v") and name.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """A version's manifest, by default the last one's."""
        if version is None:
            version = max(self.versions(), default=0)
        if not version:
            return {"version": 0, "runs": [], "schema": None}
        at = f"{self.root}/manifests/v{version:08d}.json"
        return json.loads(self.spark.read.text(at, wholetext=True).first()[0])

    def tier(self, size: int) -> int:
        return max(0, math.floor(math.log(max(size, 1) / self.tier_bytes, self.fanout)) + 1)

    def _run(self, at: str) -> dict:
        shards = [f.getLen() for f in self._fs.listStatus(self._path(at)) if f.getPath().getName().startswith("part-")]
        size = sum(shards)
        return {"id": at.rpartition("/")[2], "path": at, "bytes": size, "tier": self.tier(size), "shards": len(shards), "largest": max(shards, default=0)}

    def _commit(self, base: dict, runs: list[dict], schema: dict | None = None) -> dict:
        """Make base's successor visible, all at once; fails if another writer has made one."""
        new = {"version": base["version"] + 1, "runs": runs, "schema": schema or base.get("schema")}
        draft, final = f"{self.root}/manifests/.draft-{uuid.uuid4().hex}", f"{self.root}/manifests/v{new['version']:08d}.json"
        out = self._fs.create(self._path(draft), False)
        out.write(bytearray(json.dumps(new).encode()))
        out.close()
        jvm = self.spark._jvm
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.root).toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(self._path(draft), self._path(final), none)
        except Py4JJavaError:
            self._fs.delete(self._path(draft), False)
            raise
        return new

    def _update(self, change: Callable[[dict], list[dict] | None], schema: dict | None = None) -> dict:
        """Commit the runs that change makes of the last version, again from a newer one if another writer was first; None leaves things as they are."""
        while True:
            base = self.manifest()
            runs = change(base)
            if runs is None:
                return base
            try:
                return self._commit(base, runs, schema)
            except Py4JJavaError:
                if base["version"] + 1 not in self.versions():
                    raise

    def append(self, df: DataFrame, arrival: Column) -> dict:
        """Write each value of arrival as a run of small shards, and commit them together. Rows of later appends have the first one's columns."""
        batch, by = f"{self.root}/runs/a{uuid.uuid4().hex[:12]}", common.free_name("_arrival", df.columns)
        df.withColumn(by, arrival).write.partitionBy(by).option("compression", "zstd").parquet(batch)
        found = [self._run(p) for p in sorted(s.getPath().toString() for s in self._fs.listStatus(self._path(batch)) if s.isDirectory())]
        return self._update(lambda base: base["runs"] + found, json.loads(df.schema.json()))

    def _rows(self, runs: list[dict], schema: dict) -> DataFrame:
        kind = StructType.fromJson(schema)
        if not runs:
            return self.spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in kind])
        return self.spark.read.schema(kind).parquet(*[r["path"] for r in runs])

    def _too_large(self, run: dict) -> bool:
        return run["largest"] > 2 * self.target_bytes

    def _merge(self, runs: list[dict], schema: dict) -> dict:
        at, n = f"{self.root}/runs/m{uuid.uuid4().hex[:12]}", max(1, math.ceil(sum(r["bytes"] for r in runs) / self.target_bytes))
        rows = self._rows(runs, schema)
        rows = rows.repartition(n) if any(map(self._too_large, runs)) else rows.coalesce(n)
        rows.write.option("compression", "zstd").parquet(at)
        return self._run(at)

    def _due(self, runs: list[dict]) -> list[dict]:
        """The runs to merge next: those of the smallest full tier, else one with a shard that must be split."""
        tiers: dict[int, list[dict]] = {}
        for r in runs:
            tiers.setdefault(r["tier"], []).append(r)
        full = next((t for t in sorted(tiers) if len(tiers[t]) >= self.fanout), None)
        if full is not None:
            return tiers[full]
        # A merged run has been split already: what is still large there has few, long rows.
        return next(([r] for r in runs if self._too_large(r) and not r["id"].startswith("m")), [])

    def compact(self) -> dict:
        """Merge tiers that hold FANOUT runs or more, smallest first, until none does, and split shards of over twice the target; one commit for each merge."""
        while True:
            now = self.manifest()
            due = self._due(now["runs"])
            if not due:
                return now
            merged, old = self._merge(due, now["schema"]), {r["path"] for r in due}

            def swapped(base: dict, merged=merged, old=old) -> list[dict] | None:
                # Another writer may have merged some of them meanwhile; then this merge is left for vacuum().
                rest = [r for r in base["runs"] if r["path"] not in old]
                return [*rest, merged] if len(rest) == len(base["runs"]) - len(old) else None

            self._update(swapped)

    def vacuum(self, versions_kept: int = 1, older_than_s: float = 0.0) -> None:
        """Delete runs that none of the last versions lists, and those that failed writers left: they must be older than older_than_s, which must
        be more than the longest write takes while others write. Readers of older versions must have ended."""
        kept = {r["path"] for v in self.versions()[-versions_kept:] for r in self.manifest(v)["runs"]}
        jvm, top = self.spark._jvm, f"{self.root}/runs"
        if not self._fs.exists(self._path(top)):
            return
        before = jvm.System.currentTimeMillis() - int(older_than_s * 1000)
        for folder in self._fs.listStatus(self._path(top)):
            inner = [s for s in self._fs.listStatus(folder.getPath()) if s.isDirectory()]
            for s in inner or [folder]:
                if s.getPath().toString() not in kept and s.getModificationTime() <= before:
                    self._fs.delete(s.getPath(), True)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, as they were appended."""
        now = self.manifest(version)
        if now["schema"] is None:
            raise ValueError("nothing has been appended to this store")
        return self._rows(now["runs"], now["schema"])

    def located(self, version: int | None = None) -> DataFrame:
        """The rows of a version in a struct `row`, with run, tier and shard (the file's name)."""
        now = self.manifest(version)
        rows = self.read(version)
        listed = [F.struct(F.lit(r["id"]).alias("run"), F.lit(r["tier"]).alias("tier")) for r in now["runs"]]
        tiers = self.spark.range(1).select(F.inline(F.array(*listed) if listed else F.array().cast("array<struct<run:string,tier:int>>")))
        at = F.split(F.input_file_name() if now["runs"] else F.lit(""), "/")
        run = F.url_decode(F.regexp_replace(F.element_at(at, -2), r"\+", "%2B")) if now["runs"] else F.lit("")
        placed = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), run.alias("run"), F.element_at(at, -1).alias("shard"))
        return placed.join(tiers, "run").select("row", "run", "tier", "shard")


def op9_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source arrives as a run; after compaction, where each document is."""
    path = common.scratch_path(spark, "shards")
    store = ShardStore(spark, path)
    store.append(common.table(spark, sf_dir, "documents"), F.col("source"))
    common.delete_at_exit(spark, path)
    last = store.compact()
    return store.located().select("row.doc_id", F.lit(last["version"]).cast("long").alias("version"), "run", "tier", "shard")
