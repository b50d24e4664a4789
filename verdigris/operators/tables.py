"""Keyed table maintenance: insert if absent, upsert, dedup against what was seen, left merge, lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdigris.operators.dictionary import words_in_texts


def first_per_key(df: DataFrame, key: str, order: list) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def new_rows(new: DataFrame, target: DataFrame, key: str, order: list) -> DataFrame:
    """Rows of new whose key isn't in target, the first of each key."""
    return first_per_key(new.join(target.select(key).distinct(), key, "left_anti"), key, order)


def insert_if_absent(new: DataFrame, target: DataFrame, key: str, order: list) -> DataFrame:
    """target with the rows of new whose key it lacks; rows that are there stay as they are."""
    return target.unionByName(new_rows(new, target, key, order))


def upsert_latest(new: DataFrame, target: DataFrame, key: str, seq: str) -> DataFrame:
    """Both tables with one row for each key, the one written last (greatest seq; new before old on ties)."""
    both = target.withColumn("_age", F.lit(0)).unionByName(new.withColumn("_age", F.lit(1)))
    return first_per_key(both, key, [F.desc(seq), F.desc("_age")]).drop("_age")


def drop_seen(items: DataFrame, seen: DataFrame, key: str, order: list) -> DataFrame:
    """Items whose key wasn't seen before, the first of each; items without a key pass through."""
    has = F.col(key).isNotNull() & (F.col(key) != "")
    return new_rows(items.filter(has), seen, key, order).unionByName(items.filter(~F.coalesce(has, F.lit(False))))


def present(x: Column, y: Column) -> Column:
    """x unless it is null or empty, else y."""
    return F.coalesce(F.nullif(x, F.lit("")), y)


def merge_detail(rows: DataFrame, detail: DataFrame, key: str) -> DataFrame:
    """Left merge: detail's columns win where a detail row exists, for columns of both; rows without detail keep their own."""
    both = [c for c in detail.columns if c in rows.columns and c != key]
    d = detail.withColumnsRenamed({c: f"_d_{c}" for c in both}).withColumn("_found", F.lit(True))
    joined = rows.join(d, key, "left")
    return joined.withColumns({c: F.when(F.col("_found"), F.col(f"_d_{c}")).otherwise(F.col(c)) for c in both}).drop("_found", *[f"_d_{c}" for c in both])


def get_by_id(df: DataFrame, key: str, value) -> DataFrame:
    return df.filter(F.col(key) == F.lit(value))


def upload_status(asked: DataFrame, uploaded: DataFrame, key: str) -> DataFrame:
    """For each asked key 'uploaded' or 'not_found'."""
    there = uploaded.select(key).distinct().withColumn("_there", F.lit(True))
    return asked.join(there, key, "left").select(*asked.columns, F.when(F.col("_there"), "uploaded").otherwise("not_found").alias("status"))


def content_manifest(files: DataFrame, url: str, content: Column, ext: Column, seq: str, least: int = 128, prefix: int = 64) -> DataFrame:
    """sha256, file (hash and extension), url, length of each distinct payload of `least` bytes or more; the last write of a payload names it."""
    named = files.select(F.col(url).alias("url"), F.sha2(content, 256).alias("sha256"), F.octet_length(content).alias("length"), ext.alias("ext"), F.col(seq).alias("seq")).filter(F.col("length") >= least)
    last = first_per_key(named, "sha256", [F.desc("seq")])
    return last.select("sha256", F.concat(F.left("sha256", F.lit(prefix)), F.lit("."), "ext").alias("file"), "url", "length")


def match_enterprises(names: DataFrame, links: DataFrame, name: str, title: str, words=("环评", "报告", "公示")) -> DataFrame:
    """Links whose title holds the enterprise's name or one of the words, for each enterprise: columns of both.

    Titles are read once for all names (operators.dictionary); a title that holds one of the words goes with every name, which is
    the only place where names and links meet without a name in common.
    """
    general = F.lit(False)
    for w in words:
        general |= F.coalesce(F.col(title).contains(w), F.lit(False))
    whole = links.select(F.struct(*links.columns).alias("_l"), F.col(title).alias("_title"), F.sha2(title, 256).alias("_of"), general.alias("_general"))
    asked = names.select(F.struct(*names.columns).alias("_n"), F.col(name).alias("word"))
    own = whole.filter(~F.col("_general"))
    hits = words_in_texts(own.select("_of", "_title"), "_of", "_title", names.select(name)).distinct()
    # A name stands for all rows of names that have it, a title for all links.
    found = asked.join(hits, "word").join(own.select("_of", "_l"), "_of").select("_n.*", "_l.*")
    if not words:
        return found
    return found.unionByName(asked.join(whole.filter("_general"), F.lit(True)).select("_n.*", "_l.*"))


def search_tasks(parks: DataFrame, park: str, enterprise: str, templates: tuple[str, ...], per_park: int = 3) -> DataFrame:
    """Query texts for the first enterprises of each park, by name: park, enterprise, query."""
    w = Window.partitionBy(park).orderBy(enterprise)
    few = parks.select(park, enterprise).distinct().withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= per_park)
    return few.select(park, enterprise, F.explode(F.array(*[F.format_string(t, F.col(enterprise)) for t in templates])).alias("query"))
