"""Stored tables that answer one request from a few rows: suggestions by prefix, and keys that were seen."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verdigris.functions.segments import each
from verdigris.functions.texts import strip
from verdigris.operators.tables import first_per_key
from verdigris.sources.versions import Versions

#: Prefixes up to this length have their best terms stored, as many as a request may ask for.
SHORT, MOST = 4, 20
#: Bits of the filter of seen keys (2^27 are 16 MB), and buckets of a table of them.
BITS, BUCKETS = 1 << 27, 64


class SuggestIndex:
    """Terms with their counts, sorted by their lower-case form, and for each short prefix its best terms, sorted by prefix.

    A request for a short prefix reads the row group that holds the prefix, one for a longer prefix the row groups that terms with it stand in, as
    Parquet's own statistics say.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.versions = spark, Versions(spark, root)

    def build(self, df: DataFrame, term: Column) -> dict:
        """A new version from all terms of df; gives its pointer."""
        base, name = self.versions.read(), uuid.uuid4().hex
        at = f"{self.versions.root}/data/{name}"
        counts = df.select(strip(term).alias("term")).filter("term is not null").groupBy("term").agg(F.count("*").alias("n")).withColumn("low", F.lower("term"))
        counts.repartitionByRange("low", "term").sortWithinPartitions("low", "term").write.parquet(f"{at}/terms")
        terms = self.spark.read.parquet(f"{at}/terms")
        prefixes = F.transform(F.sequence(F.lit(0), F.least(F.length("low"), F.lit(SHORT))), lambda i: F.left("low", i))
        best = Window.partitionBy("prefix").orderBy(F.desc("n"), "term")  # Spark keeps MOST rows a prefix in each task before it shuffles
        short = each(terms, ["term", "n"], prefixes, "prefix").withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= MOST)
        short.repartitionByRange("prefix", "rank").sortWithinPartitions("prefix", "rank").write.parquet(f"{at}/prefixes")
        return self.versions.commit(base, {"name": name})

    def suggest(self, prefix: str, limit: int = 10) -> DataFrame:
        """term, n: terms with the prefix (any case), the most frequent first, then by name."""
        name, low, limit = self.versions.read().get("name"), prefix.lower(), min(limit, MOST)
        if name is None:
            return self.spark.createDataFrame([], "term string, n long")
        at = f"{self.versions.root}/data/{name}"
        if len(low) <= SHORT:
            rows = self.spark.read.parquet(f"{at}/prefixes").filter((F.col("prefix") == low) & (F.col("rank") <= limit))
        else:
            rows = self.spark.read.parquet(f"{at}/terms").filter(F.col("low").startswith(low))
        return rows.select("term", "n").orderBy(F.desc("n"), "term").limit(limit)

    def expire(self) -> list[str]:
        """Delete all but the last version."""
        return self.versions.expire(1, "data", lambda v: [v["name"]] if "name" in v else [])


class SeenKeys:
    """Keys that were seen, in a table of the session's catalog that is bucketed by key, so that it is never shuffled, with a filter of fixed size beside it.

    An item whose bit in the filter isn't set wasn't seen and needs no join; the others meet the table. The filter errs on one side only, so
    no key is lost or taken twice. keys are strings.
    """

    def __init__(self, spark: SparkSession, table: str, bits: int = BITS, buckets: int = BUCKETS, folder: str | None = None) -> None:
        """folder: where the tables' files lie, if not in the warehouse."""
        if not re.fullmatch(r"\w+(\.\w+)?", table):
            raise ValueError(f"not a table's name: {table}")
        self.spark, self.table, self.filter, self.bits, self.buckets = spark, table, f"{table}_filter", bits, buckets
        self._paths = {t: {"path": f"{folder}/{t}"} if folder else {} for t in (self.table, self.filter)}

    def _bit(self, key: Column | str) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.bits))

    def _maps(self) -> DataFrame:
        """place and map (32768 bits) of all versions of the filter's parts together: bits / 8 bytes at most."""
        return self.spark.table(self.filter).groupBy("place").agg(F.call_function("bitmap_or_agg", F.col("map")).alias("map"))

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.table)

    def add(self, keys: DataFrame) -> None:
        """Take in the keys (first column) that aren't there yet; null and empty ones are left out."""
        own = keys.select(F.col(keys.columns[0]).cast("string").alias("key")).filter("key is not null and key != ''").distinct()
        new = own.join(self.spark.table(self.table), "key", "left_anti") if self.exists() else own
        bit = self._bit("key") + 1  # Spark's bitmaps count from 1
        # The filter goes first: a key that is in the filter only is one more for the join, one that is in the table only would be lost.
        maps = own.groupBy(F.call_function("bitmap_bucket_number", bit).alias("place")).agg(F.call_function("bitmap_construct_agg", F.call_function("bitmap_bit_position", bit)).alias("map"))
        maps.coalesce(1).write.mode("append").options(**self._paths[self.filter]).saveAsTable(self.filter)
        new.repartition(self.buckets, "key").write.bucketBy(self.buckets, "key").sortBy("key").mode("append").options(**self._paths[self.table]).saveAsTable(self.table)

    def unseen(self, items: DataFrame, key: str) -> DataFrame:
        """Items whose key wasn't seen; null and empty keys are nobody's and pass."""
        if not self.exists():
            return items
        k = F.col(key).cast("string")
        bit = self._bit(k)
        at = F.call_function("bitmap_bit_position", bit + 1)
        placed = items.withColumn("_place", F.call_function("bitmap_bucket_number", bit + 1)).withColumn("_at", at).withColumn("_key", k)
        byte = F.conv(F.hex(F.substring("map", F.floor(F.col("_at") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        known = F.coalesce(F.getbit(byte, (F.col("_at") % 8).cast("int")) == 1, F.lit(False)) & F.col("_key").isNotNull() & (F.col("_key") != "")
        marked = placed.join(F.broadcast(self._maps()), placed["_place"] == F.col("place"), "left").withColumn("_known", known)
        perhaps = marked.filter("_known").join(self.spark.table(self.table).withColumnRenamed("key", "_seen"), F.col("_key") == F.col("_seen"), "left_anti")
        return marked.filter(~F.col("_known")).select(*items.columns).unionByName(perhaps.select(*items.columns))

    def take(self, items: DataFrame, key: str, order: list) -> DataFrame:
        """tables.drop_seen against what was seen so far: new items, the first of each key, and those without a key."""
        has = F.coalesce((F.col(key).isNotNull()) & (F.col(key).cast("string") != ""), F.lit(False))
        rows = self.unseen(items, key)
        return first_per_key(rows.filter(has), key, order).unionByName(rows.filter(~has))

    def drop(self) -> None:
        for t in (self.table, self.filter):
            self.spark.sql(f"drop table if exists {t}")
