"""Versions of a stored table: one JSON pointer for each, put in place by a rename that never overwrites."""

from __future__ import annotations

import json
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Conflict(RuntimeError):
    """Another writer has made the version that was to be written."""


def shared_path(spark: SparkSession, name: str) -> str:
    """A path in the folder that the cluster names in spark.checkpoint.dir; where that is unset, one of the local mode's own, and an error on a cluster."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", at)
    return f"{at.rstrip('/')}/{name}"


class Versions:
    """Pointers under root/versions on any file system that Spark can write. Readers see the last one, or one they name; data that no pointer names doesn't exist for them."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark = spark
        self._fs = self._path(root).getFileSystem(spark._jsc.hadoopConfiguration())
        self.root = self._fs.makeQualified(self._path(root)).toString()
        self._fs.mkdirs(self._path(f"{self.root}/versions"))

    def _path(self, at: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(at)

    def _names(self, folder: str) -> list[str]:
        p = self._path(f"{self.root}/{folder}")
        return [s.getPath().getName() for s in self._fs.listStatus(p)] if self._fs.exists(p) else []

    def numbers(self) -> list[int]:
        return sorted(int(n[1:-5]) for n in self._names("versions") if n.startswith("v") and n.endswith(".json"))

    def read(self, version: int | None = None) -> dict:
        """A version's pointer, by default the last one's; {"version": 0} before the first."""
        at = max(self.numbers(), default=0) if version is None else version
        return json.loads(self.spark.read.text(f"{self.root}/versions/v{at:08d}.json", wholetext=True).first()[0]) if at else {"version": 0}

    def commit(self, base: dict, content: dict) -> dict:
        """Make content the successor of base, all at once; a Conflict leaves what is there."""
        new = {**content, "version": base["version"] + 1}
        draft, final = (self._path(f"{self.root}/versions/{n}") for n in (f".draft-{uuid.uuid4().hex}", f"v{new['version']:08d}.json"))
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(new).encode()))
        out.close()
        jvm = self.spark._jvm
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.root).toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            files.rename(draft, final, self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Py4JJavaError as e:
            self._fs.delete(draft, False)
            if self._fs.exists(final):
                raise Conflict(f"version {new['version']} is there") from e
            raise
        return new

    def expire(self, keep: int, folder: str, used) -> list[str]:
        """Delete all but the last `keep` pointers, and the entries of a folder that none of those names (used(pointer) gives the names); gives what went.
        Nothing may be written meanwhile, as an entry that isn't named yet goes, too."""
        numbers = self.numbers()
        named = {n for v in numbers[-keep:] for n in used(self.read(v))}
        gone = [f"versions/v{v:08d}.json" for v in numbers[:-keep]] + [f"{folder}/{n}" for n in self._names(folder) if n not in named]
        for at in gone:
            self._fs.delete(self._path(f"{self.root}/{at}"), True)
        return gone
