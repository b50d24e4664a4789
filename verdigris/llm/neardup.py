"""Near-duplicate documents: SuperMinHash signatures, banding, full verification and union-find by labels.

One pass over the texts gives each document its number of shingles, a key of its shingle set and a
SuperMinHash signature: every shingle walks a random permutation of the slots, step j offering the rank
j plus a random fraction, and a document stops once no slot can get a smaller value. Documents with
equal sets form a class and one of them stands for it, so exact copies cost nothing further.

Class representatives meet in buckets by band. A small bucket offers all its pairs; a large one pairs
each member with two pivots, the member that shares most buckets and a random one. Pairs whose signatures agree in
too few slots are set aside, the rest is verified on full shingle sets: first the best pair of each document, then what
still joins different components. What pivots can't decide is settled exactly: in a large bucket whose members ended in
different components, members outside its main component are compared with all members in blocks, on full sets too. So no link is lost to a pivot, and no step holds a whole bucket or makes all its pairs.

With BANDS bands of ROWS slots a pair at the threshold shares no bucket with probability (1 - 0.75^4)^32, about 5e-6,
and fails the slot count (MIN_SLOTS of SLOTS) with probability under 1e-6.

Defined cases: words are what white space separates, A-Z lowered. A document with fewer words than a shingle has
one shingle, its whole sequence; without words, or with a null text, it has none and is linked with nothing. Rows with
equal doc_id are one node; a null doc_id is linked with nothing, has a null component and is kept. An empty table gives no rows. Extra columns are
ignored, and kept by deduplicate(). A very long text is never split: some 100 bytes of arrays a byte, and 8 bytes a shingle in a link's check.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.llm import common
from verdigris.llm.components import connected_components
from verdigris.llm.hashing import ODD, Substrings, mix

WORDS, PERCENT = 5, 75
SLOTS, BANDS, ROWS, MIN_SLOTS = 128, 32, 4, 71
#: Largest bucket that offers all its pairs, rows of a block in the exact comparison of large buckets, bits of the candidate bitmap.
SMALL, BLOCK, BITMAP_BITS = 6, 512, 1 << 24
_SLICE = 1 << 19
_LOWER = bytes(c + 32 if 65 <= c <= 90 else 32 if 9 <= c <= 13 else c for c in range(256))


def shingle_sets(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, sorted by text and hash, and the text of each."""
    data = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.array([len(d) + 1 for d in data], np.int64)
    raw = np.frombuffer(b" ".join([*data, b""]).translate(_LOWER), np.uint8)
    space = raw == 32
    before = np.r_[True, space[:-1]]
    starts = np.flatnonzero(~space & before)
    none = np.empty(0, np.uint64), np.empty(0, np.int64)
    if not len(starts):
        return none
    ends = np.flatnonzero(space & ~before)  # every text ends with a space
    doc = np.searchsorted(np.cumsum(sizes), starts, "right")
    # Words with one space between: hashes of runs of words are differences of one running sum.
    lengths = ends - starts + 1
    at = np.cumsum(lengths) - lengths
    keep = ~space
    keep[ends] = True
    n_words = np.bincount(doc, minlength=len(texts))
    first = np.cumsum(n_words) - n_words
    begin = np.flatnonzero((np.arange(len(doc)) - first[doc] <= n_words[doc] - WORDS) | (np.arange(len(doc)) == first[doc]))
    last = np.minimum(begin + WORDS, (first + n_words)[doc[begin]]) - 1
    a, b = at[begin], at[last] + lengths[last] - 1
    h = Substrings(raw[keep])(a, b)
    owner = doc[begin]
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])]
    return h[new], owner[new]


def signatures(h: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """SuperMinHash slots (n x SLOTS, uint64) of n sets: rank in the high bits, fraction in the low 40."""
    slots = np.full(n * SLOTS, np.uint64(0xFFFFFFFFFFFFFFFF))
    live, perm = np.arange(len(h)), None
    for j in range(SLOTS):
        x = mix(h[live] + np.uint64((j + 1) * int(ODD) % (1 << 64)))
        k = j + (((x >> np.uint64(40)) * np.uint64(SLOTS - j)) >> np.uint64(24)).astype(np.int64)
        if perm is None:
            slot = k
        else:
            rows = np.arange(len(live))
            slot = perm[rows, k].astype(np.int64)
            perm[rows, k] = perm[rows, j]
            perm[rows, j] = slot
        np.minimum.at(slots, owner[live] * SLOTS + slot, (x & np.uint64((1 << 40) - 1)) | np.uint64(j << 40))
        # A set goes on while some slot could still get a value of the next step.
        open_ = (slots.reshape(n, SLOTS).max(1) >> np.uint64(40)) > j
        on = open_[owner[live]]
        if not on.any():
            break
        if perm is None:
            live = live[on]
            perm = np.tile(np.arange(SLOTS, dtype=np.uint8), (len(live), 1))
            perm[:, 0], first = k[on].astype(np.uint8), perm[:, 0].copy()
            perm[np.arange(len(live)), k[on]] = first
        else:
            live, perm = live[on], perm[on]
    return slots.reshape(n, SLOTS)


def _slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    at = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > at and size + n > _SLICE:
            yield at, i
            at, size = i, 0
        size += n
    if at < len(texts):
        yield at, len(texts)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column(1).to_pylist()
        for i, j in _slices(texts):
            h, owner = shingle_sets(texts[i:j])
            n = np.bincount(owner, minlength=j - i)
            slots = signatures(h, owner, j - i)
            sums = np.zeros((2, j - i), np.uint64)
            some = np.flatnonzero(n)
            if len(some):
                at = np.searchsorted(owner, some)
                sums[0, some], sums[1, some] = np.add.reduceat(mix(h ^ ODD), at), np.add.reduceat(mix(h + ODD), at)
            parts = mix(slots.reshape(j - i, BANDS, ROWS))
            bands = np.zeros((j - i, BANDS), np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64) * ODD
            for r in range(ROWS):
                bands = mix(bands * ODD + parts[:, :, r])
            small = (mix(slots) & np.uint64(255)).astype(np.uint8)
            flat = pa.array(bands.view(np.int64).ravel(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).slice(i, j - i), pa.array(n, pa.int64()), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)), pa.ListArray.from_arrays(pa.array(np.arange(0, BANDS * (j - i) + 1, BANDS, dtype=np.int32)), flat), pa.array([x.tobytes() for x in small], pa.binary())],
                names=["doc_id", "n_shingles", "k1", "k2", "bands", "slots"],
            )


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, k1 and k2 (the set's key), bands, slots (a byte of each signature slot)."""
    common.bound_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(common.lean(_sketch), "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>, slots binary")


def _agreement(pairs: DataFrame, slots: DataFrame) -> DataFrame:
    """a, b and slots that agree, of the pairs that may reach the threshold."""
    sa, sb = slots.select(F.col("rep").alias("a"), F.col("slots").alias("sa")), slots.select(F.col("rep").alias("b"), F.col("slots").alias("sb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            x, y = (np.frombuffer(b"".join(t.column(c).to_pylist()), np.uint8).reshape(-1, SLOTS) for c in ("sa", "sb"))
            same = (x == y).sum(1)
            ok = pa.array(same >= MIN_SLOTS)
            yield pa.RecordBatch.from_arrays([t.column("a").filter(ok), t.column("b").filter(ok), pa.array(same, pa.int32()).filter(ok)], names=["a", "b", "agree"])

    return pairs.join(sa, "a").join(sb, "b").mapInArrow(common.lean(run), "a long, b long, agree int")


def _candidate_sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """rep and its shingle set for the documents in ids, from a second pass over the texts.

    A bitmap of hashed ids, of fixed size, goes to the tasks, so that only candidates' sets leave them; ids it lets
    through by chance are dropped by the join.
    """
    bit = F.pmod(F.xxhash64("rep"), F.lit(BITMAP_BITS))
    shared = docs.sparkSession.sparkContext.broadcast(common.bitmap(ids, bit, BITMAP_BITS))  # BITMAP_BITS / 8 bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            place = b.column("bit").to_numpy(zero_copy_only=False)
            hit = np.flatnonzero(common.in_bitmap(shared.value, place))
            ids_, texts = b.column("rep").take(pa.array(hit)), b.column("text").take(pa.array(hit)).to_pylist()
            for i, j in _slices(texts):
                h, owner = shingle_sets(texts[i:j])
                ends = np.searchsorted(owner, np.arange(j - i + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([ids_.slice(i, j - i), pa.ListArray.from_arrays(pa.array(ends), pa.array(h.view(np.int64)))], names=["rep", "shingles"])

    own = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").filter("rep is not null")
    own = own.withColumn("bit", bit)
    return own.mapInArrow(common.lean(run), "rep long, shingles array<long>").join(ids, "rep", "left_semi").dropDuplicates(["rep"])


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    with_b = pairs.select("a", "b").join(sets.select(F.col("rep").alias("b"), F.col("shingles").alias("sb")), "b")
    both = with_b.join(sets.select(F.col("rep").alias("a"), F.col("shingles").alias("sa")), "a")
    counted = both.select("a", "b", F.size(F.array_intersect("sa", "sb")).alias("common"), (F.size("sa") + F.size("sb")).alias("total"))
    return counted.filter(F.col("common") * 100 >= (F.col("total") - F.col("common")) * PERCENT).select("a", "b")


def _ordered(x: Column, y: Column) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _blocked(rest: DataFrame, classes: DataFrame, sets: DataFrame) -> DataFrame:
    """Links across components within large buckets: rest has bucket, rep, component, n (rows of the bucket), main (its main component).

    A pair is looked at in the bucket of the first band that it shares, and only what passes the signatures on full sets.
    """
    held = rest.join(classes.select("rep", "slots", "bands"), "rep").join(sets, "rep").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    mine = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    cols = ["bucket", "i", "j", "rep", "component", "slots", "bands", "shingles"]
    members = held.withColumn("i", mine).withColumn("j", F.explode(every)).select(*cols, F.lit(True).alias("member"))
    others = held.filter(F.col("component") != F.col("main")).withColumn("j", mine).withColumn("i", F.explode(every)).select(*cols, F.lit(False).alias("member"))

    def run(block: pd.DataFrame) -> pd.DataFrame:
        x, y = block[block["member"]], block[~block["member"]]
        out = []
        if len(x) and len(y):
            bucket, sets_ = block["bucket"].iloc[0], list(x["shingles"])
            left, bands, lc, lr = np.stack([np.frombuffer(s, np.uint8) for s in x["slots"]]), np.stack(list(x["bands"])), x["component"].to_numpy(), x["rep"].to_numpy()
            for s, k, own, c, r in zip(y["slots"], y["bands"], y["shingles"], y["component"], y["rep"], strict=True):
                same = bands == k
                first_here = k[same.argmax(1)] == bucket
                linked = set()
                for i in np.flatnonzero(first_here & (lc != c) & ((left == np.frombuffer(s, np.uint8)).sum(1) >= MIN_SLOTS)).tolist():
                    if lc[i] in linked:
                        continue
                    common_ = len(np.intersect1d(sets_[i], own, assume_unique=True))
                    if common_ * 100 >= (len(sets_[i]) + len(own) - common_) * PERCENT:
                        linked.add(lc[i])
                        out.append((min(lr[i], r), max(lr[i], r)))
        return pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)

    return members.unionByName(others).groupBy("bucket", "i", "j").applyInPandas(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id (the smallest doc_id linked to it, directly or not)."""
    spark = docs.sparkSession
    base = common.materialize(sketches(docs), "sketches")
    nodes = base.filter("n_shingles > 0 and doc_id is not null")
    classes = common.materialize(nodes.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.min_by(F.struct("bands", "slots"), "doc_id").alias("s")).select("k1", "k2", "rep", "s.bands", "s.slots"), "classes")
    # Buckets of two or more, by band.
    places = classes.select("rep", F.explode("bands").alias("bucket"))
    sizes = places.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    shared = common.materialize(places.join(sizes, "bucket"), "buckets")
    central = shared.groupBy("rep").agg(F.sum("n").alias("weight"))
    large = shared.filter(F.col("n") > SMALL)
    pivots = large.join(central, "rep").groupBy("bucket").agg(
        F.max(F.struct("weight", F.xxhash64("rep"), "rep"))["rep"].alias("p1"),
        F.max(F.struct(F.xxhash64("rep", "bucket").alias("h"), "rep"))["rep"].alias("p2"),
    )
    to_pivot = large.join(pivots, "bucket").select("rep", F.explode(F.array("p1", "p2")).alias("p")).filter("rep != p")
    small = shared.filter(F.col("n") <= SMALL).select("bucket", "rep")
    in_small = small.join(small.withColumnRenamed("rep", "p"), "bucket").filter("rep < p").select("rep", "p")
    pairs = to_pivot.select(*_ordered(F.col("rep"), F.col("p"))).union(in_small.select(*_ordered(F.col("rep"), F.col("p")))).distinct()
    likely = common.materialize(_agreement(pairs, classes), "pairs")
    # Any document of a bucket may be compared later, so sets are made for those in likely pairs and large buckets.
    ids = likely.select(F.col("a").alias("rep")).union(likely.select("b")).union(large.select("rep")).distinct()
    sets = common.materialize(_candidate_sets(docs, ids), "sets")
    best = F.max(F.struct("agree", "other"))["other"]
    sides = likely.select("a", F.col("b").alias("other"), "agree").union(likely.select("b", "a", "agree"))
    first = sides.groupBy("a").agg(best.alias("b")).select(*_ordered(F.col("a"), F.col("b"))).distinct()
    links = common.materialize(_confirmed(first, sets), "links")
    labels = connected_components(links)

    def across(p: DataFrame) -> DataFrame:
        ca, cb = labels.select(F.col("node").alias("a"), F.col("component").alias("ca")), labels.select(F.col("node").alias("b"), F.col("component").alias("cb"))
        return p.join(ca, "a", "left").join(cb, "b", "left").filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")

    more = common.materialize(_confirmed(across(likely.select("a", "b").exceptAll(first)), sets), "links")
    labels = connected_components(more, labels)
    # Large buckets whose members are in different components: compare exactly, in blocks.
    named = large.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("bucket", "rep", "n", F.coalesce("component", "rep").alias("component"))
    groups = named.groupBy("bucket", "component").agg(F.count("*").alias("m"), F.first("n").alias("n"))
    mains = groups.groupBy("bucket").agg(F.max(F.struct("m", "component"))["component"].alias("main"), F.count("*").alias("k")).filter("k > 1").select("bucket", "main")
    last = common.materialize(_blocked(named.join(mains, "bucket"), classes, sets), "links")
    labels = connected_components(last, labels)
    of_class = classes.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("k1", "k2", F.coalesce("component", "rep").alias("component"))
    # Rows of one doc_id are one node, whatever their texts.
    found = nodes.select("doc_id", "k1", "k2").join(of_class, ["k1", "k2"]).select("doc_id", "component")
    twice = nodes.groupBy("doc_id").count().filter("count > 1").limit(1).count()
    if twice:
        merged = connected_components(found.select(F.col("doc_id").alias("a"), F.col("component").alias("b")).filter("a != b").union(found.select(F.col("doc_id").alias("a"), F.col("doc_id").alias("b"))))
        found = merged.select(F.col("node").alias("doc_id"), "component")
    return base.select("doc_id", "n_shingles").join(found, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def kept(component: str = "component_id") -> Column:
    return F.coalesce(F.col("doc_id") == F.col(component), F.lit(True))


def deduplicate(docs: DataFrame) -> DataFrame:
    """docs without the rows whose document isn't the smallest doc_id of its group; rows with equal doc_id are one document and stay or go together."""
    groups = near_duplicates(docs)
    # As a table its size is known, so Spark broadcasts it below its own threshold, and then no text is shuffled.
    gone = common.materialize(groups.filter(~kept()).select(F.col("doc_id").alias("_gone")).distinct(), "gone")
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", kept().alias("kept"))
