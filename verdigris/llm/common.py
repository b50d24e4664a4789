"""Helpers shared by the corpus operators: scratch tables, batch bounds, row access."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.functions.batches import BATCH_BYTES, BATCH_ROWS, bound_batches, kept, lean  # noqa: F401

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(name: str, taken: list[str]) -> str:
    """name, with as many underscores before it as it takes to clash with no column."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name = f"_{name}"
    return name


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir). Where it is unset, a local one in local mode, as in tests, and an error
    on a cluster, whose executors wouldn't see each other's files."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def scratch_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def _file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def delete_at_exit(spark: SparkSession, path: str) -> None:
    """Let the driver delete a scratch folder when it ends, if nothing has before."""
    fs, p = _file_system(spark, path)
    fs.deleteOnExit(p)


#: Scratch tables that were written and not deleted, in order, for those who know when they are done with.
written: list[str] = []


def delete(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        fs, p = _file_system(spark, path)
        fs.delete(p, True)
        if path in written:
            written.remove(path)


def materialize(df: DataFrame, tag: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, and lost executors cost no recomputation."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, tag)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    delete_at_exit(spark, path)
    written.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path  # type: ignore[attr-defined]
    return out


def discard(df: DataFrame) -> None:
    """Delete a scratch table that materialize() wrote and that nothing needs any more."""
    delete(df.sparkSession, [df.scratch])  # type: ignore[attr-defined]


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of plans that are no longer referenced."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def text_or_empty(col: str = "text"):
    return F.coalesce(F.col(col), F.lit(""))


def bitmap(rows: DataFrame, bit: Column, bits: int) -> np.ndarray:
    """The bits, from 0, that rows name: bits / 8 bytes, least bit first, put together on Spark before they come to the driver."""
    at = bit + 1  # Spark's functions count from 1
    found = rows.groupBy(F.call_function("bitmap_bucket_number", at).alias("bucket")).agg(F.call_function("bitmap_construct_agg", F.call_function("bitmap_bit_position", at)).alias("bits")).collect()
    out = np.zeros(-(-bits // 32768) * 4096, np.uint8)
    for r in found:
        begin = (r["bucket"] - 1) * 4096
        out[begin : begin + len(r["bits"])] = np.frombuffer(r["bits"], np.uint8)
    return out


def in_bitmap(held: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """Which of these bits are set."""
    return (held[bit >> 3] >> (bit & 7).astype(np.uint8) & 1).astype(bool)
