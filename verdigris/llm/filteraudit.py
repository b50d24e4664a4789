"""Interaction audit of document filters from relations of failing ids.

One pass over the texts measures every document; each filter then has a table of the ids that fail it,
with their part. The relations meet in left-semi and left-anti joins on the id: filter by filter the ids
found so far are split into those that fail it, too, and those that don't, and ids that only it finds
come in. What results are disjoint relations, one for each combination of filters. An order's prefix
removes the combinations that hold one of its filters, so survivors, removals, redundancies and, by
semi joins with the labels, label losses of all prefixes of all orders are sums over them. Ids that fail nothing are never
shuffled: survivors are a part's count less what was removed. Rows that meet in joins are an id and a few numbers.

Defined cases: a null text is empty, and so are its words; an empty text holds no words, and fails A only, or E, too. A null doc_id is
neither smaller nor larger than another, so it never fails E and makes no other fail it. Repeated rows are
documents of their own; equal doc_ids with equal texts don't fail E for each other. A document has a label if any row
of its doc_id in the label table has it. Null lang is the part of the empty string, together with a lang that is empty. An empty table gives
no rows, as it has no parts. Extra columns are ignored, whatever their names. Very long texts are measured whole.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.llm import common

FILTERS = "ABCDE"
#: Thresholds and patterns of the filters.
MIN_WORDS, MIN_DISTINCT_PCT, MAX_CAPITAL_PCT = 100, 80, 10
WORD, CAPITAL, ODD_SIGN = r"[^\x20\x09-\x0D]+", "[^A-Z]+", r"[#$%&*|]"


def measure(docs: DataFrame) -> DataFrame:
    """_id, doc_id, part, same (a hash of the text) and fails, the failed ones of the filters that look at a text alone."""
    own = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), common.text_or_empty().alias("text"))
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    size = own.select("*", words.alias("_w")).select(
        "doc_id", "part", F.sha2("text", 256).alias("same"), F.size("_w").cast("long").alias("n"), F.size(F.array_distinct("_w")).cast("long").alias("d"),
        F.length("text").cast("long").alias("c"), F.length(F.regexp_replace("text", CAPITAL, "")).cast("long").alias("u"), F.col("text").rlike(ODD_SIGN).alias("odd"),
    )
    failing = {"A": F.col("n") < MIN_WORDS, "B": 100 * F.col("d") < MIN_DISTINCT_PCT * F.col("n"), "C": 100 * F.col("u") > MAX_CAPITAL_PCT * F.col("c"), "D": F.col("odd")}
    return size.select(F.monotonically_increasing_id().alias("_id"), "doc_id", "part", F.unhex("same").alias("same"), F.filter(F.array(*[F.when(c, k) for k, c in failing.items()]), lambda x: x.isNotNull()).alias("fails"))


def failing_ids(measured: DataFrame) -> DataFrame:
    """filter, _id, doc_id, part: one table for each filter, as partitions of one. A text's smallest doc_id comes from partial minima, so a large group of copies is one row a task."""
    alone = measured.select("_id", "doc_id", "part", F.explode("fails").alias("filter"))
    first = measured.groupBy("same").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last").select("same", "first")
    first = common.materialize(first, "first-copies")  # a table, so that Spark knows its size and can split the copies of one text
    copies = measured.select("_id", "doc_id", "part", "same").join(first, "same").filter("doc_id > first").select("_id", "doc_id", "part", F.lit("E").alias("filter"))
    return common.materialize(alone.unionByName(copies), "failing", partition_by=["filter"])


def combinations(failing: DataFrame) -> DataFrame:
    """_id, doc_id, part, mask: each failing id once, with a bit for each filter that it fails, by semi and anti joins of the id tables."""
    found = failing.filter(F.col("filter") == FILTERS[0]).select("_id", "doc_id", "part", F.lit(1).alias("mask"))
    for k, name in enumerate(FILTERS[1:], 1):
        ids = failing.filter(F.col("filter") == name).select("_id", "doc_id", "part")
        key = ids.select("_id")
        step = common.union_all([
            found.join(key, "_id", "left_semi").withColumn("mask", F.col("mask") + (1 << k)),
            found.join(key, "_id", "left_anti"),
            ids.join(found.select("_id"), "_id", "left_anti").withColumn("mask", F.lit(1 << k)),
        ])
        before, found = found, common.materialize(step, "combinations")
        if k > 1:
            common.discard(before)
    return found


def _by_mask(rows: DataFrame, name: str) -> DataFrame:
    return rows.groupBy("part", "mask").agg(F.count("*").alias(name))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step and counts: every order of the filters, step by step, for each part."""
    measured = common.materialize(measure(docs), "measured")
    failing = failing_ids(measured)
    sets = combinations(failing)
    counts = _by_mask(sets, "n")
    for name, flag in (("good", F.col("quality") == 1), ("toxic", F.col("toxic") == 1)):
        such = labels.filter(flag).select("doc_id")
        counts = counts.join(_by_mask(sets.join(such, "doc_id", "left_semi"), name), ["part", "mask"], "left")
    # A part has 2^5 combinations at most, so its sums fit in one row.
    cell = F.struct("mask", "n", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    cells = counts.groupBy("part").agg(F.collect_list(cell).alias("cells"))
    total = measured.groupBy("part").agg(F.count("*").alias("total"))
    parts = total.join(cells, "part", "left").withColumn("cells", F.coalesce("cells", F.array().cast(cells.schema["cells"].dataType)))
    return _orders(parts)


def _orders(parts: DataFrame) -> DataFrame:
    """The rows of all orders and steps of each part, from its total and its cells."""
    every = [(1 << len(FILTERS)) - 1]
    bit = {f: 1 << k for k, f in enumerate(FILTERS)}

    def count(what: str, fits) -> Column:
        return F.aggregate("cells", F.lit(0).cast("long"), lambda a, c: a + F.when(fits(c["mask"]), c[what]).otherwise(0))

    # What depends on the set of earlier filters and the next one only: 80 pairs a part.
    pairs = [(before, f) for f in FILTERS for before in range(every[0] + 1) if not before & bit[f]]
    pair = F.explode(F.array(*[F.struct(F.lit(b).alias("before"), F.lit(f).alias("f"), F.lit(bit[f]).alias("bit")) for b, f in pairs])).alias("p")
    before, own = F.col("p.before"), F.col("p.bit")

    def removed_here(m: Column) -> Column:
        return (m.bitwiseAND(before) == 0) & (m.bitwiseAND(own) != 0)

    sums = parts.select("*", pair).select(
        "part", F.struct(before, F.col("p.f")).alias("key"), (F.col("total") - count("n", lambda m: m.bitwiseAND(before.bitwiseOR(own)) != 0)).alias("kept"), count("n", removed_here).alias("removed"),
        count("n", lambda m: (m.bitwiseAND(before) != 0) & (m.bitwiseAND(own) != 0)).alias("redundant"), count("n", lambda m: m == own).alias("unique_fails"),
        count("good", removed_here).alias("good_lost"), count("toxic", removed_here).alias("toxic_lost"),
    )
    orders = ["".join(p) for p in permutations(FILTERS)]
    steps: dict[tuple, list] = {}
    for o in orders:
        for i, f in enumerate(o):
            steps.setdefault((sum(bit[x] for x in o[:i]), f), []).append((o, i + 1))
    # How many orders come by a pair weighs its removals in the filter's sum over all orders.
    weight = F.map_from_arrays(F.array(*[F.struct(F.lit(b).alias("before"), F.lit(f).alias("f")) for b, f in pairs]), F.array(*[F.lit(len(steps[k])) for k in pairs]))
    shapley = sums.groupBy("part", F.col("key.f").alias("f")).agg(F.sum(F.col("removed") * F.element_at(weight, F.col("key"))).alias("shapley"))
    spark = parts.sparkSession
    names = spark.createDataFrame([(b, f, o, s) for (b, f), at in steps.items() for o, s in at], "before int, f string, filter_order string, step int")  # 600 rows
    full = sums.join(shapley, (sums["part"] == shapley["part"]) & (sums["key.f"] == shapley["f"])).select(sums["*"], "shapley")
    full = full.select("*", F.col("key.before").alias("before"), F.col("key.f").alias("f")).join(F.broadcast(names), ["before", "f"])
    return full.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
