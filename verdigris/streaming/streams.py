"""Structured Streaming forms: dedup, sinks, incremental runs, admission, facets.

Event time is the watermark's; dedup with a time, admission with a delay, and facets drop rows later than it, and LateRows counts them.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery, StreamingQueryListener

from verdigris.operators import tables, weblog
from verdigris.operators.keyedtable import KeyedTable


def stream_dedup(stream: DataFrame, key: str, ts: str | None = None, delay: str = "1 day") -> DataFrame:
    """The first row of each key; state survives restarts by the checkpoint. With ts, keys older than the watermark are forgotten."""
    return stream.dropDuplicates([key]) if ts is None else stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def insert_sink(stream: DataFrame, path: str, checkpoint: str, key: str, order: list) -> StreamingQuery:
    """Append batches to a Parquet table, rows whose key it has left out. A batch that is written again writes its own folder again."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        others = _batches_before(spark, path, batch_id)
        new = tables.first_per_key(batch, key, order) if others is None else tables.new_rows(batch, others, key, order)
        new.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def keyed_sink(stream: DataFrame, table: KeyedTable, checkpoint: str, order: list, keep_old: bool = False) -> StreamingQuery:
    """Merge each batch into a stored table: keys' rows are replaced by later ones, or with keep_old stay as they are. Only the buckets of a batch's keys are
    rewritten; a batch that comes again after a failure isn't merged twice, since the version names the batches it holds."""

    def write(batch: DataFrame, batch_id: int) -> None:
        table.merge(batch, order, keep_old, (checkpoint, batch_id))

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upsert_sink(stream: DataFrame, path: str, checkpoint: str, key: str, seq: str) -> StreamingQuery:
    """Keep in a stored table the row of each key that was written last (greatest seq; the later batch on ties), for latest_rows() to read."""
    return keyed_sink(stream, KeyedTable(stream.sparkSession, path, key), checkpoint, [F.desc(seq)])


def latest_rows(spark: SparkSession, path: str, key: str, seq: str) -> DataFrame:
    """The table of upsert_sink(): one row for each key, of the last version."""
    return KeyedTable(spark, path, key).read()


def _batches_before(spark: SparkSession, path: str, batch_id: int) -> DataFrame | None:
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return None
    before = [s.getPath().toString() for s in fs.listStatus(root) if s.getPath().getName().startswith("batch=") and int(s.getPath().getName()[6:]) < batch_id]
    return spark.read.parquet(*before) if before else None


def incremental_run(
    spark: SparkSession, source: str, schema, sink: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] = lambda d: d,
    mode: str = "daily", content: tuple[str, ...] = (),
) -> None:
    """Process the files that came since the last run, once.

    mode: "daily" keeps metadata only, so the columns of content aren't read at all; "full" keeps them, too. Each mode has its own
    progress below checkpoint and its own table below sink, as a full run must also see files that daily ones have seen; without columns of content
    the modes are the same, and checkpoint and sink are used as they are.
    """
    if mode not in ("daily", "full"):
        raise ValueError(f"unknown mode: {mode}")
    stream = spark.readStream.schema(schema).parquet(source)
    if content:
        sink, checkpoint = f"{sink}/{mode}", f"{checkpoint}/{mode}"
        stream = stream if mode == "full" else stream.drop(*content)
    transform(stream).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def stream_facets(stream: DataFrame, ts: str, key: str, size: str = "1 hour", slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Counts by window and key, tumbling or sliding."""
    return stream.withWatermark(ts, delay).groupBy(F.window(ts, size, slide) if slide else F.window(ts, size), key).agg(F.count("*").alias("n"))


class _Admission(StatefulProcessor):
    """Velocity block and rate limits of one client, hits in order of time within each batch. Rows that come with a verdict keep it and leave the state alone.

    With timers a client's state goes when no later hit can see it: its hits are out of their windows and its block has ended.
    """

    def __init__(self, velocity: dict, timers: bool) -> None:
        self.velocity, self.timers = velocity, timers

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("hits", "recent array<bigint>, until bigint, ends bigint")
        self.rated = handle.getMapState("rated", "tier string", "hits array<bigint>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        recent, until, ends = self.state.get() if self.state.exists() else ((), -1, -1)
        recent, held = deque(recent), {}
        data = pd.concat(list(rows)).sort_values(["t", "id"])
        out, last = [], ends
        for t, given, tier, limit, window_us in zip(*(data[c].tolist() for c in ("t", "given", "tier", "limit", "window_us")), strict=True):
            if given:
                out.append(given)
                continue
            if until > t:
                out.append("velocity")
                continue
            while recent and recent[0] < t - self.velocity["window_us"]:
                recent.popleft()
            recent.append(t)
            last = max(last, t + self.velocity["window_us"])
            if len(recent) > self.velocity["threshold"]:
                until = t + self.velocity["block_us"]
                last = max(last, until)
                out.append("velocity")
                continue
            if tier not in held:
                held[tier] = deque(self.rated.getValue((tier,))[0] if self.rated.containsKey((tier,)) else ())
            hits = held[tier]
            while hits and hits[0] <= t - window_us:
                hits.popleft()
            hits.append(t)
            last = max(last, t + window_us)
            out.append("allow" if len(hits) <= limit else "rate")
        if last > ends or recent:
            for tier, hits in held.items():
                self.rated.updateValue((tier,), (list(hits),))
            self.state.update((list(recent), until, last))
            if self.timers:
                for old in list(self.handle.listTimers()):
                    self.handle.deleteTimer(old)
                self.handle.registerTimer(last // 1000 + 1)  # milliseconds
        yield pd.DataFrame({"client": data["client"], "id": data["id"], "verdict": out})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N803
        self.state.clear()
        self.rated.clear()
        return iter(())

    def close(self) -> None:
        pass


def stream_admission(
    stream: DataFrame, client: Column, ts: Column, id_: Column, velocity: dict, limit: int, window_us: int,
    route: Column | None = None, tiers: tuple = (), is_bot: Column | None = None, excluded: Column | None = None, delay: str | None = None,
) -> DataFrame:
    """client, id, verdict (excluded, bot, velocity, rate, allow) with state by client, as weblog.admission gives; needs the RocksDB state store.

    limit and window_us hold for routes that no tier (route prefix, limit, window in seconds) fits. With delay, a watermark
    follows event time: rows later than it get no verdict and leave the state alone (LateRows counts them), and the state of a client ends
    when its windows and its block are past. Without, a client's state stays, and hits count whenever they come.
    """
    given = F.when(F.lit(False) if excluded is None else excluded, "excluded").when(F.lit(False) if is_bot is None else is_bot, "bot").otherwise("")
    tier = weblog.route_tier(F.lit("") if route is None else route, tiers, ("default", limit, 0))
    rows = stream.select(client.cast("string").alias("client"), ts.cast("timestamp").alias("ts"), id_.cast("long").alias("id"), given.alias("given"), tier.alias("r"))
    if delay is not None:
        rows = rows.withWatermark("ts", delay)
    window = F.when(F.col("r.window_us") == 0, F.lit(window_us).cast("long")).otherwise(F.col("r.window_us")).alias("window_us")
    rows = rows.select("client", *(["ts"] if delay is not None else []), F.unix_micros("ts").alias("t"), "id", "given", "r.tier", "r.limit", window)
    return rows.groupBy("client").transformWithStateInPandas(_Admission(velocity, delay is not None), "client string, id long, verdict string", "Update", "None" if delay is None else "EventTime")


class LateRows(StreamingQueryListener):
    """How many rows of each query came later than the watermark and were dropped, by the query's name or else its id.

    Add it to spark.streams before the query starts. Dedup and admission drop single rows; facets drop what a task has
    counted already, so there a window and key of one task and batch counts once, however many rows it has.
    """

    def __init__(self) -> None:
        self.counts: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:
        self.counts.setdefault(event.name or str(event.id), 0)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        name = p.name or str(p.id)
        self.counts[name] = self.counts.get(name, 0) + sum(s.numRowsDroppedByWatermark for s in p.stateOperators)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
