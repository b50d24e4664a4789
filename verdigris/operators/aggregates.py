"""Counts and summaries over reports, crawls and files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def facet_counts(df: DataFrame, caps: dict[str, int]) -> DataFrame:
    """facet, value, n: the most frequent values of each column (ties by value), from one pass; missing values have no bucket."""
    keyed = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in caps])).alias("f")).select("f.*").filter("value is not null")
    counts = keyed.groupBy("facet", "value").agg(F.count("*").alias("n"))
    cap = F.create_map(*[F.lit(x) for kv in caps.items() for x in kv])
    w = Window.partitionBy("facet").orderBy(F.desc("n"), "value")
    return counts.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= cap[F.col("facet")]).drop("_r")


def report_summary(df: DataFrame, keys: list[str], date: str | None = None) -> DataFrame:
    """key, value, n, earliest, latest: a total row (key 'total') and one row for each value of each key."""
    dates = [F.min(date).alias("earliest"), F.max(date).alias("latest")] if date else []
    entries = F.array(F.struct(F.lit("total").alias("key"), F.lit("").alias("value")), *[F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("value")) for k in keys])
    return df.select(F.explode(entries).alias("e"), *([date] if date else [])).groupBy("e.key", "e.value").agg(F.count("*").alias("n"), *dates)


def run_stats(df: DataFrame, key: str, conditions: dict) -> DataFrame:
    """Per key, how many rows meet each named condition."""
    return df.groupBy(key).agg(*[F.count_if(c).alias(n) for n, c in conditions.items()])


def crawl_counters(items: DataFrame, stored: DataFrame, key: str, indexed: Column | None = None, failed: Column | None = None) -> DataFrame:
    """fetched, duplicate (in the batch or stored), inserted, indexed, errors: one row. indexed and failed say of each item whether it was indexed or failed."""
    there = stored.select(key).distinct().withColumn("_there", F.lit(True))
    flag = lambda c: F.lit(0) if c is None else F.count_if(c)
    by_key = items.groupBy(key).agg(F.count("*").alias("_n"), flag(indexed).alias("_i"), flag(failed).alias("_e")).join(there, key, "left")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    sums = by_key.agg(total("_n").alias("fetched"), F.count_if(F.col("_there").isNull()).alias("inserted"), total("_i").alias("indexed"), total("_e").alias("errors"))
    return sums.select("fetched", (F.col("fetched") - F.col("inserted")).alias("duplicate"), "inserted", "indexed", "errors")


def batch_outcome(results: DataFrame, errors: str = "errors", ms: str | None = None) -> DataFrame:
    total = [F.sum(ms).alias("total_ms")] if ms else []
    return results.agg(F.count_if(F.size(errors) == 0).alias("ok"), F.count_if(F.size(errors) > 0).alias("failed"), *total)


def attachment_stats(df: DataFrame, key: str, free) -> DataFrame:
    """Per key: total, free, paid and the share of free ones (0 for none)."""
    g = df.groupBy(key).agg(F.count("*").alias("total"), F.count_if(free).alias("free"))
    return g.select(key, "total", "free", (F.col("total") - F.col("free")).alias("paid"), F.coalesce(F.try_divide("free", "total"), F.lit(0.0)).alias("free_rate"))


def merge_stats(parts: list[DataFrame], key: str) -> DataFrame:
    """Cumulative attachment_stats of several runs."""
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    g = both.groupBy(key).agg(F.sum("total").alias("total"), F.sum("free").alias("free"), F.sum("paid").alias("paid"))
    return g.withColumn("free_rate", F.coalesce(F.try_divide("free", "total"), F.lit(0.0)))


def distinct_per_group(df: DataFrame, group: str, value: str) -> DataFrame:
    """group, names (sorted), n of the distinct values of each group."""
    return df.groupBy(group).agg(F.array_sort(F.collect_set(value)).alias("names")).withColumn("n", F.size("names"))


def match_summary(matches: DataFrame, name: str) -> DataFrame:
    """hits and enterprises of a match table: one row."""
    per_name = matches.groupBy(name).agg(F.count("*").alias("n"))
    return per_name.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("hits"), F.count("*").alias("enterprises"))
