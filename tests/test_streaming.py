"""Streams give what their batch twins give."""

from __future__ import annotations

from pyspark.sql import functions as F

from verdigris.operators import tables, weblog
from verdigris.operators.keyedtable import KeyedTable
from verdigris.streaming import streams

S = 1_000_000


def run(df, tmp_path, mode="append"):
    name = "out_" + str(abs(hash(str(tmp_path))))
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def source(spark, tmp_path, df):
    df.write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))


def test_dedup(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "k string, v int")
    assert sorted(map(tuple, run(streams.stream_dedup(source(spark, tmp_path, df), "k"), tmp_path).collect())) == [("a", 1), ("b", 2)]


def test_insert_sink_and_incremental_run(spark, tmp_path):
    first = spark.createDataFrame([("a", 1), ("a", 2)], "k string, v int")
    first.write.parquet(str(tmp_path / "in"))
    for extra in (None, spark.createDataFrame([("a", 9), ("c", 3)], "k string, v int")):
        if extra is not None:
            extra.write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(first.schema).parquet(str(tmp_path / "in"))
        streams.insert_sink(stream, str(tmp_path / "out"), str(tmp_path / "cp"), "k", ["v"]).awaitTermination()
        streams.incremental_run(spark, str(tmp_path / "in"), first.schema, str(tmp_path / "all"), str(tmp_path / "cp2"))
    got = spark.read.parquet(str(tmp_path / "out")).select("k", "v").collect()
    batch = tables.insert_if_absent(spark.createDataFrame([("a", 9), ("c", 3)], "k string, v int"), tables.first_per_key(first, "k", ["v"]), "k", ["v"])
    assert sorted(map(tuple, got)) == sorted(map(tuple, batch.collect()))
    assert spark.read.parquet(str(tmp_path / "all")).count() == 4


def test_facets(spark, tmp_path):
    df = spark.createDataFrame([("a", 10), ("a", 20), ("b", 4000)], "k string, t int").select("k", F.timestamp_seconds("t").alias("ts"))
    got = run(streams.stream_facets(source(spark, tmp_path, df), "ts", "k"), tmp_path, "complete").collect()
    batch = df.groupBy(F.window("ts", "1 hour"), "k").agg(F.count("*").alias("n")).collect()
    assert sorted((r.window.start, r.k, r.n) for r in got) == sorted((r.window.start, r.k, r.n) for r in batch)


def test_admission(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    df = spark.createDataFrame([("a" if i % 3 else "b", float(i), i) for i in range(40)], "client string, t double, id int").select("client", F.timestamp_micros((F.col("t") * S).cast("long")).alias("ts"), "id")
    velocity, tier = {"window_us": 8 * S, "threshold": 5, "block_us": 4 * S}, ("d", 6, 20)
    got = run(streams.stream_admission(source(spark, tmp_path, df), F.col("client"), F.col("ts"), F.col("id"), velocity, 6, 20 * S), tmp_path, "update")
    batch = weblog.admission(df, "client", F.lit("x"), "ts", "id", F.lit(False), F.lit(False), velocity, (), tier)
    assert sorted((r.client, r.id, r.verdict) for r in got.collect()) == sorted((r.client, r.id, r.verdict) for r in batch.collect())


def test_admission_of_tiers_bots_and_excluded_paths(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    routes = ("search/a", "search/b", "download/x", "health", "list")
    hits = [("abc"[i * i % 3], routes[i * 7 % 5], i % 11 == 0, float(i // 2), i) for i in range(120)]
    df = spark.createDataFrame(hits, "client string, route string, bot boolean, t double, id int").withColumn("ts", F.timestamp_micros((F.col("t") * S).cast("long"))).drop("t")
    velocity, tiers = {"window_us": 8 * S, "threshold": 9, "block_us": 4 * S}, (("search", 3, 20), ("download", 1, 30))
    first, second = df.filter("id < 50"), df.filter("id >= 50")
    first.write.parquet(str(tmp_path / "in"))
    got = []
    for i, more in enumerate((None, second)):
        if more is not None:
            more.write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
        verdicts = streams.stream_admission(stream, F.col("client"), F.col("ts"), F.col("id"), velocity, 4, 10 * S, F.col("route"), tiers, F.col("bot"), F.col("route") == "health")
        q = verdicts.writeStream.foreachBatch(lambda b, _: got.extend(b.collect())).outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
    batch = weblog.admission(df, "client", F.col("route"), "ts", "id", F.col("bot"), F.col("route") == "health", velocity, tiers, ("default", 4, 10)).collect()
    assert sorted((r.client, r.id, r.verdict) for r in got) == sorted((r.client, r.id, r.verdict) for r in batch)
    assert {r.verdict for r in batch} == {"excluded", "bot", "velocity", "rate", "allow"}


def test_upsert_sink(spark, tmp_path):
    parts = [[("a", 1, "x"), ("a", 3, "y"), ("b", 2, "z")], [("a", 2, "late"), ("b", 2, "tie"), ("c", 1, "new")], [("c", 5, "last")]]
    want = None
    for rows in parts:
        df = spark.createDataFrame(rows, "k string, seq int, v string")
        df.write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
        streams.upsert_sink(stream, str(tmp_path / "out"), str(tmp_path / "cp"), "k", "seq").awaitTermination()
        want = sorted(map(tuple, tables.upsert_latest(df, spark.createDataFrame(want or [], df.schema), "k", "seq").collect()))
        assert sorted(map(tuple, streams.latest_rows(spark, str(tmp_path / "out"), "k", "seq").select("k", "seq", "v").collect())) == want
    assert want == [("a", 3, "y"), ("b", 2, "tie"), ("c", 5, "last")]


def stepwise(spark, tmp_path, parts, make, name, mode="append"):
    """Run a query over parts, one batch each; what it gives, and its progress."""
    got, progress = [], []
    for part in parts:
        part.write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(part.schema).parquet(str(tmp_path / "in"))
        q = make(stream).writeStream.foreachBatch(lambda b, _: got.extend(b.collect())).queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
        progress += [p for p in q.recentProgress if p.stateOperators]
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return got, progress


def timed(spark, rows):
    return spark.createDataFrame(rows, "client string, t double, id int").select("client", F.timestamp_micros(((F.col("t") + 1000) * S).cast("long")).alias("ts"), "id")  # the first watermark is the epoch


def test_state_of_idle_clients_ends_and_late_rows_are_counted(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    late = streams.LateRows()
    spark.streams.addListener(late)
    velocity = {"window_us": 8 * S, "threshold": 5, "block_us": 4 * S}
    first = timed(spark, [("ab"[i % 3 == 0], float(i), i) for i in range(40)])
    second = timed(spark, [("c", 500.0, 100), ("c", 501.0, 101)])
    third = timed(spark, [("a", 30.0, 200), ("b", 39.0, 201), ("d", 1000.0, 202), ("a", 1000.5, 203)])  # two come too late
    fourth = timed(spark, [("d", 2000.0, 300)])
    make = lambda s: streams.stream_admission(s, F.col("client"), F.col("ts"), F.col("id"), velocity, 6, 20 * S, delay="10 seconds")
    try:
        got, progress = stepwise(spark, tmp_path, [first, second, third, fourth], make, "admission", "update")
    finally:
        spark.streams.removeListener(late)
    batch = weblog.admission(first.union(second), "client", F.lit("x"), "ts", "id", F.lit(False), F.lit(False), velocity, (), ("d", 6, 20)).collect()
    want = sorted((r.client, r.id, r.verdict) for r in batch) + [("a", 203, "allow"), ("d", 202, "allow"), ("d", 300, "allow")]
    assert sorted((r.client, r.id, r.verdict) for r in got) == sorted(want)
    assert late.counts["admission"] == 2
    held = [p.stateOperators[0].numRowsTotal for p in progress]
    assert held[0] > 0 and held[-1] < held[0] and held[-1] <= 4, held  # what the last client has, and nothing of the others


def test_late_rows_of_dedup_and_facets_are_counted(spark, tmp_path):
    late = streams.LateRows()
    spark.streams.addListener(late)
    parts = [timed(spark, x) for x in ([("a", 10_000.0, 1)], [("b", 10_000.0, 2), ("a", 1.0, 3), ("c", 2.0, 4)], [("b", 90_000.0, 5)], [("x", 5.0, 6)])]
    try:
        got, _ = stepwise(spark, tmp_path / "1", parts, lambda s: streams.stream_dedup(s, "client", "ts", "1 hour"), "dedup")
        facets, _ = stepwise(spark, tmp_path / "2", parts, lambda s: streams.stream_facets(s, "ts", "client", "10 minutes", delay="1 hour"), "facets")
    finally:
        spark.streams.removeListener(late)
    assert sorted(r.id for r in got) == [1, 2] and late.counts["dedup"] == 3
    assert sorted((r.client, r.n) for r in facets) == [("a", 1), ("b", 1)] and late.counts["facets"] == 3


def test_daily_and_full_runs(spark, tmp_path):
    df = spark.createDataFrame([("u1", "title", "body")], "url string, title string, content string")
    df.write.parquet(str(tmp_path / "in"))
    at = (str(tmp_path / "in"), df.schema, str(tmp_path / "out"), str(tmp_path / "cp"))
    streams.incremental_run(spark, *at, content=("content",))
    streams.incremental_run(spark, *at, content=("content",))
    df.withColumn("url", F.lit("u2")).write.mode("append").parquet(str(tmp_path / "in"))
    streams.incremental_run(spark, *at, mode="full", content=("content",))
    streams.incremental_run(spark, *at, content=("content",))
    daily, full = (spark.read.parquet(str(tmp_path / "out" / m)) for m in ("daily", "full"))
    assert daily.columns == ["url", "title"] and sorted(r.url for r in daily.collect()) == ["u1", "u2"]
    assert full.columns == df.columns and sorted(r.url for r in full.collect()) == ["u1", "u2"]


def test_keyed_sink_merges_a_batch_once(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 1)], "k string, seq int")
    table = KeyedTable(spark, str(tmp_path / "t"), "k", 4)
    for rows in (df, df.withColumn("seq", F.lit(2)).filter("k = 'a'")):
        rows.write.mode("append").parquet(str(tmp_path / "in"))
        streams.keyed_sink(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), table, str(tmp_path / "cp"), [F.desc("seq")], keep_old=True).awaitTermination()
    assert sorted(map(tuple, table.read().collect())) == [("a", 1), ("b", 1)]
    assert table.merge(df.withColumn("seq", F.lit(9)), [F.desc("seq")], batch=(str(tmp_path / "cp"), 1)) == table.versions.read()
