"""Importance resampling towards a target distribution, with a distributed quickselect.

Words and runs of words are hashed into buckets. What a bucket gains is the log ratio of its share in the target texts to
that in the source texts, both smoothed; there are as many gains as buckets, and a document's weight, the mean gain of
its features, is read from an array of them. Gumbel noise from a seeded hash of the doc_id makes a draw without replacement
of a choice of the highest scores.

The k-th score is found without a sort of all rows: some random rows are pivots, one pass counts how many keys are less than, equal to and
greater than each, and only keys between the two pivots around the k-th stay candidates. A key is the score, the doc_id and
the row's number, so no two are equal and ties need no care. The rows up to that key, and no others, are sorted by ranges and numbered.

Defined cases: a null or empty text has no words, no features and weight 0, and isn't drawn. A null doc_id is hashed as the empty text
and comes after the others among ties. Repeated rows are documents of their own, with equal scores, if they are drawn with
ranks of their own. An empty table, or one of short texts, gives its rows without ranks; an empty target leaves gains by
the smoothing alone. Extra columns are ignored, whatever their names. Very long texts are counted whole.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verdigris.functions.segments import each
from verdigris.llm import common

WORD = r"[0-9a-z\x{80}-\x{10FFFF}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Hash buckets, longest run of words, seed of the noise, words a drawn document has at least, share drawn in per cent.
BUCKETS, RUN, SEED, MIN_WORDS, SHARE_PCT = 10_000, 1, 2024, 20, 10
#: Pivots of a round of the selection.
PIVOTS = 24


def words(text: str = "text") -> Column:
    return F.regexp_extract_all(F.translate(common.text_or_empty(text), UPPER, LOWER), F.lit(WORD), F.lit(0))


def features(found: Column, run: int) -> Column:
    """All runs of 1 to run consecutive words, joined by a space, from an array of words."""

    def runs(n: int) -> Column:
        starts = F.when(F.size(found) >= n, F.sequence(F.lit(1), F.size(found) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(found, i, F.lit(n)), " "))

    return F.concat(found, *[runs(n) for n in range(2, run + 1)]) if run > 1 else found


def bucket(feature: Column, buckets: int) -> Column:
    return (F.crc32(feature) % buckets).cast("int")


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS, run: int = RUN) -> list[int]:
    """How many features fall in each bucket: sums of a row a bucket at most from each task."""
    one = each(docs.select(words().alias("_w")), [], features(F.col("_w"), run), "feature")
    found = dict(map(tuple, one.groupBy(bucket(F.col("feature"), buckets).alias("b")).count().collect()))  # as many rows as buckets at most
    return [found.get(b, 0) for b in range(buckets)]


def gains(source: list[int], target: list[int]) -> list[int]:
    """1000 times the log ratio of smoothed shares, rounded down, by bucket."""
    s_all, t_all, n = float(sum(source)), float(sum(target)), len(source)
    return [math.floor(1000 * math.log((t + 1) * (t_from) / ((s + 1) * (s_from)))) for s, t, t_from, s_from in ((s, t, s_all + n, t_all + n) for s, t in zip(source, target, strict=True))]


def scored(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, run: int = RUN, seed: int = SEED) -> DataFrame:
    """_row, doc_id, n_words, n_features, weight and score of each row, as a table."""
    gain = gains(bucket_counts(docs, buckets, run), bucket_counts(target, buckets, run))
    array = F.split(F.lit(",".join(map(str, gain))), ",").cast("array<bigint>")  # folded to one literal when the plan is made
    own = docs.select("doc_id", words().alias("_w")).select("doc_id", F.size("_w").cast("long").alias("n_words"), features(F.col("_w"), run).alias("_f"))
    total = F.aggregate("_f", F.lit(0).cast("long"), lambda a, f: a + F.get(array, bucket(f, buckets)))
    summed = own.select("doc_id", "n_words", F.size("_f").cast("long").alias("n_features"), total.alias("_sum"))
    n = F.col("n_features")
    weight = F.when(n > 0, F.expr("(_sum - pmod(_sum, n_features)) div n_features")).otherwise(F.lit(0).cast("long"))
    seeded = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(seeded, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0)))
    rows = summed.select("doc_id", "n_words", "n_features", weight.alias("weight"), (weight + noise).cast("long").alias("score"))
    return common.materialize(rows.withColumn("_row", F.monotonically_increasing_id()), "scored")


def _key() -> Column:
    """Ascending in the order of drawing: no two rows are equal."""
    return F.struct((-F.col("score")).alias("a"), F.col("doc_id").isNull().alias("b"), F.col("doc_id").alias("c"), F.col("_row").alias("d"))


def _literal(key: tuple, kind) -> Column:
    return F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(key, kind, strict=True)])


def kth_key(rows: DataFrame, k: int, pivots: int = PIVOTS) -> tuple | None:
    """The k-th smallest key of rows (_row, doc_id, score), from 1; None if there are fewer."""
    left = rows.select("score", "doc_id", "_row", _key().alias("_key"))
    kind, round_ = left.schema["_key"].dataType, 0
    while True:
        chosen = left.orderBy(F.xxhash64("_row", F.lit(round_)), "_row").limit(pivots).select("_key").collect()
        if not chosen:
            return None
        keys = [tuple(r["_key"]) for r in chosen]
        lit = [_literal(x, kind) for x in keys]
        counts = left.agg(*[F.count_if(F.col("_key") < p).alias(f"less{i}") for i, p in enumerate(lit)], *[F.count_if(F.col("_key") == p).alias(f"same{i}") for i, p in enumerate(lit)], F.count("*").alias("n")).first()
        if k > counts["n"]:
            return None
        below, above = [], []
        for i, x in enumerate(keys):
            less, same = counts[f"less{i}"], counts[f"same{i}"]
            if less < k <= less + same:
                return x
            (below if less + same < k else above).append((less, same, i))
        if below:
            less, same, i = max(below)
            left, k = left.filter((F.col("score") <= -keys[i][0]) & (F.col("_key") > lit[i])), k - less - same
        if above:
            i = min(above)[2]
            left = left.filter((F.col("score") >= -keys[i][0]) & (F.col("_key") < lit[i]))
        round_ += 1


def ranked(rows: DataFrame) -> DataFrame:
    """rows with their rank (long, from 1) by key: sorted by ranges, numbered in each range, and moved on by the sizes of the ranges before it."""
    mono = F.monotonically_increasing_id()
    placed = rows.orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last(), "_row").select("*", F.shiftright(mono, 33).cast("int").alias("_range"), mono.bitwiseAND((1 << 33) - 1).alias("_at"))
    placed = common.materialize(placed, "drawn")
    sizes = placed.groupBy("_range").agg(F.count("*").alias("n"))  # a row for each range
    before = F.sum("n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("_range", F.coalesce(before, F.lit(0)).alias("_before"))
    return placed.join(F.broadcast(offsets), "_range").withColumn("rank", F.col("_before") + F.col("_at") + 1).drop("_range", "_at", "_before")


def resample(docs: DataFrame, target: DataFrame, share_pct: int = SHARE_PCT, min_words: int = MIN_WORDS, buckets: int = BUCKETS, run: int = RUN, seed: int = SEED) -> DataFrame:
    """Every row's doc_id, n_features, weight, score and rank; ranks are null but for the share drawn of those with min_words words."""
    rows = scored(docs, target, buckets, run, seed)
    fits = rows.filter(F.col("n_words") >= min_words)
    k = share_pct * fits.count() // 100
    last = kth_key(fits, k) if k else None
    out = ["doc_id", "n_features", "weight", "score", "rank"]
    if last is None:
        return rows.withColumn("rank", F.lit(None).cast("long")).select(out)
    key, limit = _key(), _literal(last, fits.select(_key().alias("_key")).schema["_key"].dataType)
    won = ranked(fits.filter(key <= limit))
    rest = rows.filter((F.col("n_words") < min_words) | (key > limit)).withColumn("rank", F.lit(None).cast("long"))
    return won.select(out).unionByName(rest.select(out))


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
