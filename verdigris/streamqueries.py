"""Registered queries that run as streams over a table until all that is there has been read, with the SQL of their batch twins."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.operators.keyedtable import KeyedTable
from verdigris.session import table
from verdigris.sources.versions import shared_path
from verdigris.streaming import streams

_PROVIDER, _ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream, ts with a time zone as watermarks need it."""
    schema = table(spark, sf_dir, "events").schema
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/events.parquet")
    reader = spark.readStream.schema(schema)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        stream = reader.parquet(at.toString())
    else:  # a stream reads folders
        stream = reader.option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def collected(spark: SparkSession, stream: DataFrame, mode: str) -> DataFrame:
    """What a stream gives, as a table: of complete results the last one, else all batches."""
    path, schema = shared_path(spark, f"stream-{uuid.uuid4().hex}"), stream.schema

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch={0 if mode == 'complete' else batch_id}")

    stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).parquet(f"{path}/rows").select(*schema.names)


def streamed_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The users that were seen, each once."""
    return collected(spark, streams.stream_dedup(events(spark, sf_dir).select("user_id"), "user_id"), "append")


def streamed_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by day and type."""
    found = collected(spark, streams.stream_facets(events(spark, sf_dir), "ts", "event_type", "1 day"), "complete")
    return found.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n")


def streamed_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each user, merged into a stored table."""
    at = shared_path(spark, f"stream-{uuid.uuid4().hex}")
    users = KeyedTable(spark, f"{at}/users", "user_id", 8)
    rows = events(spark, sf_dir).select("user_id", "event_id", "event_type")
    streams.keyed_sink(rows, users, f"{at}/checkpoint", [F.desc("event_id")]).awaitTermination()
    return users.read().select("user_id", "event_id", "event_type")


def admission_stream(velocity: dict, tiers: tuple, default: tuple) -> Callable[[SparkSession, str], DataFrame]:
    def streamed_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Verdicts by state of each user; the state store is changed for the run of the stream."""
        before = spark.conf.get(_PROVIDER)
        spark.conf.set(_PROVIDER, _ROCKS)
        try:
            kind = F.col("event_type")
            verdicts = streams.stream_admission(events(spark, sf_dir), F.col("user_id"), F.col("ts"), F.col("event_id"), velocity, default[1], default[2] * 1_000_000, kind, tiers, kind == "error", kind == "signup")
            found = collected(spark, verdicts, "update")
        finally:
            spark.conf.set(_PROVIDER, before)
        return found.select(F.col("id").alias("event_id"), "verdict")

    return streamed_admission


KEYS_SQL = "select distinct user_id from events"
FACETS_SQL = "select strftime(ts, '%Y-%m-%d') as day, event_type, count(*) as n from events group by all"
UPSERTS_SQL = "select user_id, max(event_id) as event_id, arg_max(event_type, event_id) as event_type from events group by 1"
