"""Access-log analytics: sliding velocity, blocks, rate tiers, admission, resets, circuit breaker.

Times are microseconds of event time. Windows count arrivals one by one: rows with equal times are in
the order of their id, which a range frame alone would not see, so later peers are taken off.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Tiers as (route prefix, limit, window in seconds) in order, and the default.
TIERS = (("search", 50, 60), ("download", 20, 3600))
DEFAULT_TIER = ("default", 100, 60)
#: Windows of time that one task's stretch of a key covers.
STRETCH = 64
#: Rows of a key from which on its log is cut where it was idle.
HOT = 1 << 20


def micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def _arrivals(df: DataFrame, keys: list[str], at: str, id_: str, span: int) -> Column:
    """Rows of the key in [t - span, t] that have arrived up to this one."""
    peers = Window.partitionBy(*keys, at)
    within = F.count("*").over(Window.partitionBy(*keys).orderBy(at).rangeBetween(-span, 0))
    return within - (F.count("*").over(peers) - F.row_number().over(peers.orderBy(id_)))


def _in_stretches(df: DataFrame, at: str, span: Column) -> DataFrame:
    """df with _stretch and _own: time is cut into stretches of STRETCH spans, so that a key's windows are dealt out to many tasks.
    A row stands in its own stretch, and once more (not _own) in the next one if windows there reach back to it."""
    place = lambda t: F.floor(t / (span * STRETCH))
    own, seen = place(F.col(at)), place(F.col(at) + span)
    rows = df.withColumn("_stretch", F.explode(F.when(seen > own, F.array(own, own + 1)).otherwise(F.array(own))))
    return rows.withColumn("_own", F.col("_stretch").eqNullSafe(own))


def velocity_count(df: DataFrame, key: str, ts: str, id_: str, window_us: int = 10_000_000) -> DataFrame:
    """df with hits: arrivals of the key in the closed window [t - w, t]."""
    dealt = _in_stretches(df.withColumn("_t", micros(ts)), "_t", F.lit(window_us))
    return dealt.withColumn("hits", _arrivals(df, [key, "_stretch"], "_t", id_, window_us)).filter("_own").drop("_t", "_stretch", "_own")


def _sessions(df: DataFrame, key: str, id_: str, span: int) -> DataFrame:
    """df (with _t) and _from, the time since which its key was never idle for longer than span.

    Whether a hit has one before it within span is seen in its stretch of time, so a key's log is dealt out; then each stretch's last
    start, one row for a key and stretch, is carried on to the stretches after it that have none.
    """
    dealt = _in_stretches(df, "_t", F.lit(span))
    before = Window.partitionBy(key, "_stretch").orderBy("_t", id_)
    starts = F.coalesce(F.col("_t") - F.lag("_t").over(before) > span, F.lit(True))
    own = dealt.withColumn("_start", F.when(starts, F.col("_t"))).filter("_own").drop("_own")
    own = own.withColumn("_here", F.max("_start").over(before.rowsBetween(Window.unboundedPreceding, 0)))
    last = own.groupBy(key, "_stretch").agg(F.max("_start").alias("_last"))
    carried = F.max("_last").over(Window.partitionBy(key).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1))
    known = last.select(F.col(key).alias("_key"), F.col("_stretch").alias("_at"), carried.alias("_carried"))
    met = own.join(known, own[key].eqNullSafe(F.col("_key")) & own["_stretch"].eqNullSafe(F.col("_at")))
    return met.withColumn("_from", F.coalesce("_here", "_carried")).drop("_start", "_here", "_stretch", "_key", "_at", "_carried")


def velocity_block(df: DataFrame, key: str, ts: str, id_: str, window_us: int = 10_000_000, threshold: int = 10, block_us: int = 60_000_000, hot: int = HOT) -> DataFrame:
    """df with blocked. More than `threshold` recorded hits in the closed window block the key for block_us; hits while blocked
    are rejected, not recorded, and don't prolong the block.

    The state is recursive, so rows stream through a task in time order; memory is one window of hits. A key with more than `hot` rows is cut wherever it
    was idle for longer than window and block: nothing is left of the state there, so each part is work of its own. What isn't idle for so long, such as
    one client that never pauses, stays one task's sequential work.
    """
    cols = df.columns
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, hits, until = object(), deque(), -1
        for pdf in batches:
            out = []
            for k, t in zip(pdf["_k"].tolist(), pdf["_t"].tolist(), strict=True):
                if k != last:
                    last, hits, until = k, deque(), -1
                if until > t:
                    out.append(True)
                    continue
                while hits and hits[0] < t - window_us:
                    hits.popleft()
                hits.append(t)
                blocked = len(hits) > threshold
                if blocked:
                    until = t + block_us
                out.append(blocked)
            yield pdf[cols].assign(blocked=out)

    timed = df.withColumn("_t", micros(ts))
    plain = F.coalesce(F.concat(F.lit("k"), F.col(key).cast("string")), F.lit(""))
    many = df.groupBy(F.col(key).alias("_hot")).count().filter(F.col("count") > hot).select("_hot")  # a row for so many rows
    if many.limit(1).count():
        is_hot = timed[key].eqNullSafe(many["_hot"])
        parts = _sessions(timed.join(many, is_hot, "left_semi"), key, id_, max(window_us, block_us))
        named = timed.join(many, is_hot, "left_anti").withColumn("_k", plain).unionByName(parts.withColumn("_k", F.concat_ws("@", "_from", plain)).drop("_from"))
    else:
        named = timed.withColumn("_k", plain)
    return named.repartition("_k").sortWithinPartitions("_k", "_t", id_).mapInPandas(run, f"{ddl}, blocked boolean")


def with_tiers(df: DataFrame, route: str, rules: DataFrame, default=None) -> DataFrame:
    """df with _r, struct<tier,limit,window_us>, of the first rule whose prefix a route has. rules: prefix, limit, seconds, place (less comes first), of any number.

    Each distinct route is cut to the lengths that prefixes have, and joins the rules by equality.
    """
    default = default or DEFAULT_TIER
    lengths = sorted(r[0] for r in rules.select(F.length("prefix")).distinct().collect())  # of prefixes of URLs
    routes = df.select(F.col(route).alias("_route")).filter("_route is not null").distinct()
    cut = routes.select("_route", F.explode(F.array_distinct(F.transform(F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length("_route")), lambda n: F.left("_route", n)))).alias("prefix")) if lengths else routes.select("_route", F.lit("").alias("prefix")).filter("false")
    kind = F.struct(F.col("prefix").alias("tier"), F.col("limit").cast("int").alias("limit"), (F.col("seconds").cast("long") * 1_000_000).alias("window_us"))
    best = cut.join(rules, "prefix").groupBy("_route").agg(F.min_by(kind, F.struct("place", "prefix")).alias("_found"))
    other = F.struct(F.lit(default[0]).alias("tier"), F.lit(default[1]).cast("int").alias("limit"), F.lit(default[2] * 1_000_000).cast("long").alias("window_us"))
    return df.join(best, F.col(route) == F.col("_route"), "left").withColumn("_r", F.coalesce("_found", other)).drop("_found", "_route")


def route_tier(route: Column, tiers=TIERS, default=DEFAULT_TIER) -> Column:
    """struct<tier, limit, window_us> of the first prefix that fits the route."""
    chosen = None
    for prefix, limit, seconds in tiers:
        s = F.struct(F.lit(prefix).alias("tier"), F.lit(limit).alias("limit"), F.lit(seconds * 1_000_000).cast("long").alias("window_us"))
        ok = route.startswith(prefix)
        chosen = F.when(ok, s) if chosen is None else chosen.when(ok, s)
    s = F.struct(F.lit(default[0]).alias("tier"), F.lit(default[1]).alias("limit"), F.lit(default[2] * 1_000_000).cast("long").alias("window_us"))
    return s if chosen is None else chosen.otherwise(s)


def rate_limit(df: DataFrame, key: str, route: Column, ts: str, id_: str, tiers=TIERS, default=DEFAULT_TIER) -> DataFrame:
    """df with tier, used, allowed, retry_after: arrivals of (tier, key) in the half-open window (t - w, t], denied ones too. tiers: a tuple, or a
    table of rules for with_tiers()."""
    if isinstance(tiers, DataFrame):
        marked = with_tiers(df.withColumn("_path", route), "_path", tiers, default).drop("_path")
        seconds_of = {r[0] for r in tiers.select(F.col("seconds").cast("long")).distinct().collect()} | {default[2]}  # lengths of windows
    else:
        marked, seconds_of = df.withColumn("_r", route_tier(route, tiers, default)), {t[2] for t in (*tiers, default)}
    marked = marked.withColumn("tier", F.col("_r.tier")).withColumn("_t", micros(ts))
    marked = _in_stretches(marked, "_t", F.col("_r.window_us"))
    used, limit, seconds = F.lit(None).cast("long"), F.col("_r.limit"), (F.col("_r.window_us") / 1_000_000).cast("long")
    for s in sorted(seconds_of):
        w = s * 1_000_000
        used = F.when(F.col("_r.window_us") == w, _arrivals(df, ["tier", key, "_stretch"], "_t", id_, w - 1)).otherwise(used)
    counted = marked.withColumn("used", used).filter("_own").drop("_stretch", "_own")
    wait = F.greatest(F.lit(1), F.greatest(F.lit(5), seconds - F.floor(F.col("used") * 0.5)))
    return counted.withColumn("allowed", F.col("used") <= limit).withColumn("retry_after", F.when(F.col("used") > limit, wait)).drop("_r", "_t")


def rate_usage(df: DataFrame, key: str, route: Column, ts: str, as_of: int, tiers=TIERS, default=DEFAULT_TIER) -> DataFrame:
    """key, tier, used, limit, remaining at the instant as_of (microseconds), each tier over its own window."""
    r = df.select(key, route_tier(route, tiers, default).alias("_r"), micros(ts).alias("_t"))
    inside = (F.col("_t") > F.lit(as_of) - F.col("_r.window_us")) & (F.col("_t") <= as_of)
    used = r.groupBy(key, F.col("_r.tier").alias("tier"), F.col("_r.limit").alias("limit")).agg(F.count_if(inside).alias("used"))
    return used.select(key, "tier", "used", "limit", F.greatest(F.lit(0), F.col("limit") - F.col("used")).alias("remaining"))


def with_resets(df: DataFrame, key: str, is_reset: Column, ts: str, id_: str, stretch_us: int = 3_600_000_000) -> DataFrame:
    """df with session, the number of resets of the key so far: a further key that makes windows start anew.

    Resets are counted within stretches of time, so a key's log is dealt out; the stretches' totals, a row for a key and stretch, are summed up behind.
    """
    rows = df.withColumn("_t", micros(ts)).withColumn("_reset", is_reset).withColumn("_stretch", F.floor(F.col("_t") / stretch_us))
    here = Window.partitionBy(key, "_stretch").orderBy("_t", id_).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("_key").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(F.col(key).alias("_key"), F.col("_stretch").alias("_at")).agg(F.count_if("_reset").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    counted = rows.withColumn("_here", F.count_if("_reset").over(here))
    met = counted.join(totals, counted[key].eqNullSafe(F.col("_key")) & counted["_stretch"].eqNullSafe(F.col("_at")))
    return met.select(*df.columns, (F.col("_before") + F.col("_here")).alias("session"))


def admission(df: DataFrame, key: str, route: Column, ts: str, id_: str, is_bot: Column, excluded: Column, velocity: dict, tiers=TIERS, default=DEFAULT_TIER) -> DataFrame:
    """df with verdict: excluded paths pass, then bots, velocity and rate limit reject in this order; what one stage rejects, later ones don't see."""
    cols = df.columns
    first = df.withColumn("verdict", F.when(excluded, "excluded").when(is_bot, "bot"))
    checked = velocity_block(first.filter("verdict is null").drop("verdict"), key, ts, id_, **velocity)
    rated = rate_limit(checked.filter(~F.col("blocked")).select(*cols), key, route, ts, id_, tiers, default)
    return (
        first.filter("verdict is not null")
        .unionByName(checked.filter("blocked").select(*cols, F.lit("velocity").alias("verdict")))
        .unionByName(rated.select(*cols, F.when(F.col("allowed"), "allow").otherwise("rate").alias("verdict")))
    )


def circuit_breaker(df: DataFrame, domain: str, run: str, order: str, ok: Column, threshold: int = 3) -> DataFrame:
    """domain, run, trailing (failures after the run's last success), carried (with those of earlier runs since a clean one), skipped."""
    # A run's last success and its failures after that are sums of each task's, so a long run is no single task.
    rows = df.withColumn("_ok", ok)
    last = rows.groupBy(F.col(domain).alias("_d"), F.col(run).alias("_r")).agg(F.max(F.when(F.col("_ok"), F.col(order))).alias("_last"))
    marked = rows.join(last, rows[domain].eqNullSafe(F.col("_d")) & rows[run].eqNullSafe(F.col("_r")))
    runs = marked.groupBy(domain, run).agg(F.count_if(~F.col("_ok") & (F.col("_last").isNull() | (F.col(order) > F.col("_last")))).alias("trailing"))
    so_far = Window.partitionBy(domain).orderBy(run).rowsBetween(Window.unboundedPreceding, 0)
    island = runs.withColumn("_clean", F.count_if(F.col("trailing") == 0).over(so_far))
    summed = island.withColumn("carried", F.sum("trailing").over(Window.partitionBy(domain, "_clean").orderBy(run).rowsBetween(Window.unboundedPreceding, 0)))
    before = Window.partitionBy(domain).orderBy(run).rowsBetween(Window.unboundedPreceding, -1)
    return summed.withColumn("skipped", F.coalesce(F.max(F.col("carried") >= threshold).over(before), F.lit(False))).drop("_clean")
