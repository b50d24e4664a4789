"""A stored inverted index for full-text search: BM25 from postings alone, skipping blocks that can't reach the page.

Documents of about one length are dealt to blocks of about BLOCK documents by a hash of their key. A row of the index is a term in a block:
the keys, counts and lengths of the documents there that hold it, how many they are, and the greatest count and the least length among them, which bound
what the term can add to a score there. Rows lie in folders by a hash of the term, sorted by term and block, so a query
reads the folders of its terms and, by Parquet's own statistics, the row groups that hold them. A term that stands in all documents
has a row in each block, so it is as many rows as there are blocks, in many files.

The k best come in two steps: the blocks with the greatest bounds are scored, and the k-th score found there is the threshold; then
all other blocks whose bound reaches it. Blocks below it are not read beyond their bounds, and no hit is lost.

Appending writes a segment of its own and leaves the others as they are; merge() makes one segment of all, from the postings. A
pointer (sources.versions) names the segments that count, with their numbers of documents and terms, so readers never see a half-written one.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.functions.segments import each
from verdigris.functions.texts import highlight
from verdigris.operators.textsearch import B, K1, query_terms, term_counts, token_count
from verdigris.sources.versions import Versions

#: Documents of a block (expected number), folders of terms, documents whose postings make one file of a folder.
BLOCK, FOLDERS, FILE_DOCS = 1024, 64, 1 << 22
#: Blocks that are scored for the threshold, at least, and one more for so many hits of the page.
FIRST_BLOCKS, HITS_A_BLOCK = 8, 64
#: Tokens of the blocks whose postings one task puts together (expected number).
PART_TOKENS = 1 << 21


def _length_class(dl: Column) -> Column:
    """Lengths within a power of two are one class."""
    return F.floor(F.log2(F.greatest(dl, F.lit(1)).cast("double"))).cast("int")


def _split(docs: DataFrame) -> DataFrame:
    """block, key, dl, term, tf of documents with their text: terms are counted within the row."""
    rows = each(docs, ["block", "key", "dl"], term_counts(F.col("text")), "_e")
    return rows.select("block", "key", "dl", F.col("_e.term").alias("term"), F.col("_e.tf").alias("tf"))


class SearchIndex:
    """The index under a root folder; key_type is the Spark type of the documents' keys, which must be unique."""

    def __init__(self, spark: SparkSession, root: str, key_type: str = "long", k1: float = K1, b: float = B) -> None:
        self.spark, self.k1, self.b = spark, k1, b
        self.schema = f"term string, block long, n int, max_tf int, min_dl int, keys array<{key_type}>, tfs array<int>, dls array<int>, segment string, folder int"
        self.versions = Versions(spark, root)
        self.root = self.versions.root

    def append(self, docs: DataFrame, key: str = "doc_id", text: str = "text") -> dict:
        """Index documents that aren't in the index yet; gives the new version's pointer."""
        own = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
        own = own.withColumn("dl", token_count(F.col("text")))
        return self._add(own.select("dl"), own, _split, keep=True)

    def merge(self) -> dict:
        """Make one segment of all, so that blocks are full again and files few."""
        base = self.versions.read()
        rows = self._postings(base)
        one = rows.select("term", F.explode(F.arrays_zip("keys", "tfs", "dls")).alias("p")).select(F.col("p.keys").alias("key"), F.col("p.dls").alias("dl"), "term", F.col("p.tfs").alias("tf"))
        lengths = one.select("key", "dl").distinct().select("dl")  # documents without terms have no postings
        return self._add(lengths, one, lambda rows: rows, keep=False, base=base)

    def _add(self, lengths: DataFrame, rows: DataFrame, split: Callable[[DataFrame], DataFrame], keep: bool, base: dict | None = None) -> dict:
        """Write a segment. rows (key, dl and what split() makes term and tf of) are dealt out by block once, before they are split, so that the
        postings of a block are put together in its task and only whole lists are dealt out again, by folder."""
        base = base or self.versions.read()
        # A row for each class of lengths, which are powers of two.
        classes = {r["c"]: r for r in lengths.groupBy(_length_class(F.col("dl")).alias("c")).agg(F.count("*").alias("n"), F.sum("dl").alias("total")).collect()}
        n = sum(r["n"] for r in classes.values())
        blocks = F.element_at(F.create_map(*[F.lit(x) for c, r in classes.items() for x in (c, max(1, -(-r["n"] // BLOCK)))]), F.col("_c")) if classes else F.lit(1)
        number = base["version"] + 1
        place = F.lit(number << 40) + F.shiftleft(F.col("_c").cast("long"), 32) + F.pmod(F.xxhash64("key"), blocks)
        parts = max(1, -(-sum(r["total"] or 0 for r in classes.values()) // PART_TOKENS))
        dealt = rows.withColumn("_c", _length_class(F.col("dl"))).withColumn("block", place).drop("_c").repartition(parts, "block")
        lists = split(dealt).groupBy("block", "term").agg(F.sort_array(F.collect_list(F.struct("key", "tf", "dl"))).alias("_e"))
        made = lists.select("term", "block", F.col("_e.key").alias("keys"), F.col("_e.tf").alias("tfs"), F.col("_e.dl").alias("dls"))
        files = max(1, -(-n // FILE_DOCS))
        folder = F.pmod(F.xxhash64("term"), F.lit(FOLDERS)).cast("int")
        spread = made.repartition(FOLDERS * files, folder, F.pmod("block", F.lit(files)))
        # What follows from the lists is worked out where they are written.
        full = spread.select("term", "block", F.size("keys").alias("n"), F.array_max("tfs").alias("max_tf"), F.array_min("dls").alias("min_dl"), "keys", "tfs", "dls", folder.alias("folder"))
        name = f"segment={number}-{uuid.uuid4().hex[:8]}"
        full.sortWithinPartitions("folder", "term", "block").write.partitionBy("folder").parquet(f"{self.root}/segments/{name}")
        old = base.get("segments", [])
        docs, total = sum(s["docs"] for s in old), sum(s["length"] for s in old)
        new = {"name": name, "docs": n if keep else docs, "length": sum(r["total"] or 0 for r in classes.values()) if keep else total}
        return self.versions.commit(base, {"segments": [*(old if keep else []), new]})

    def _postings(self, pointer: dict | None = None) -> DataFrame:
        pointer = pointer or self.versions.read()
        paths = [f"{self.root}/segments/{s['name']}" for s in pointer.get("segments", [])]
        return self.spark.read.schema(self.schema).option("basePath", f"{self.root}/segments").parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def _asked(self, query: str) -> tuple[DataFrame, list[tuple[str, float]], float]:
        """The rows of the query's terms, terms with their idf, and the mean length, all of one version."""
        pointer = self.versions.read()
        terms = query_terms(self.spark, query)
        folders = F.lit(False) if not terms else F.col("folder").isin([r[0] for r in self.spark.range(1).select(F.explode(F.array(*[F.pmod(F.xxhash64(F.lit(t)), F.lit(FOLDERS)).cast("int") for t in terms]))).collect()])
        rows = self._postings(pointer).filter(folders & F.col("term").isin(terms))
        n = sum(s["docs"] for s in pointer.get("segments", []))
        held = dict(map(tuple, rows.groupBy("term").agg(F.sum("n")).collect())) if terms else {}  # a row for each term
        idf = self.spark.range(1).select(*[F.log(1 + (F.lit(n) - held.get(t, 0) + 0.5) / (F.lit(held.get(t, 0)) + 0.5)) for t in terms]).first() if terms else ()
        return rows, list(zip(terms, idf, strict=True)), sum(s["length"] for s in pointer.get("segments", [])) / max(n, 1)

    def _part(self, tf: Column, dl: Column, mean: float) -> Column:
        return tf / (tf + self.k1 * (1 - self.b + self.b * dl / F.lit(mean)))

    def _scored(self, rows: DataFrame, terms: list[tuple[str, float]], mean: float, allowed: DataFrame | None) -> DataFrame:
        """key and score of every document in rows; the sums are taken in the order of the terms."""
        p = rows.select("term", F.explode(F.arrays_zip("keys", "tfs", "dls")).alias("p")).select("term", F.col("p.keys").alias("key"), F.col("p.tfs").alias("tf"), F.col("p.dls").alias("dl"))
        if allowed is not None:
            p = p.join(allowed.select(F.col(allowed.columns[0]).alias("key")), "key", "left_semi")
        if not terms:
            return p.select("key", F.lit(0.0).alias("score")).filter("false")
        by_key = p.groupBy("key").agg(*[F.max(F.when(F.col("term") == t, F.lit(w) * self._part(F.col("tf"), F.col("dl"), mean))).alias(f"_{i}") for i, (t, w) in enumerate(terms)])
        score = F.lit(0.0)
        for i in range(len(terms)):
            score = score + F.coalesce(F.col(f"_{i}"), F.lit(0.0))
        return by_key.select("key", score.alias("score"))

    def scores(self, query: str, allowed: DataFrame | None = None) -> DataFrame:
        """key and score of all documents that hold a term, of those in allowed (its first column) if that is given."""
        return self._scored(*self._asked(query), allowed)

    def total(self, query: str, allowed: DataFrame | None = None) -> DataFrame:
        """One row with total, the number of documents that hold a term: from the keys of a block at a time."""
        rows, _, _ = self._asked(query)
        if allowed is not None:
            hits = rows.select(F.explode("keys").alias("key")).join(allowed.select(F.col(allowed.columns[0]).alias("key")), "key", "left_semi")
            return hits.agg(F.count_distinct("key").alias("total"))
        each_block = rows.groupBy("block").agg(F.size(F.array_distinct(F.flatten(F.collect_list("keys")))).cast("long").alias("n"))
        return each_block.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))

    def blocks(self, query: str, k: int, allowed: DataFrame | None = None) -> tuple[DataFrame, list[int], float | None]:
        """block and bound of every block that holds a term, those that are scored first, and the threshold: the k-th score there, None if they have fewer hits."""
        rows, terms, mean = self._asked(query)
        return self._blocks(rows, terms, mean, k, allowed)

    def _blocks(self, rows, terms, mean, k, allowed):
        weight = F.lit(0.0)
        for t, w in terms:
            weight = F.when(F.col("term") == t, w).otherwise(weight)
        bounds = rows.groupBy("block").agg(F.sum(weight * self._part(F.col("max_tf"), F.col("min_dl"), mean)).alias("bound"))
        few = FIRST_BLOCKS + k // HITS_A_BLOCK
        first = [r["block"] for r in bounds.orderBy(F.desc("bound"), "block").limit(few).collect()]
        best = self._scored(rows.filter(F.col("block").isin(first)), terms, mean, allowed).orderBy(F.desc("score")).offset(k - 1).limit(1).collect() if first else []
        return bounds, first, best[0]["score"] if best else None

    def top(self, query: str, k: int, allowed: DataFrame | None = None) -> DataFrame:
        """key and score of the k best, ties by key."""
        rows, terms, mean = self._asked(query)
        bounds, first, least = self._blocks(rows, terms, mean, k, allowed)
        if least is not None:  # sums of bounds and of scores may differ in their last bits
            open_ = bounds.filter((F.col("bound") >= least * (1 - 1e-12)) | F.col("block").isin(first)).select("block")
            rows = rows.join(open_, "block", "left_semi")
        return self._scored(rows, terms, mean, allowed).orderBy(F.desc("score"), "key").limit(k)

    def search(self, query: str, docs: DataFrame, key: str = "doc_id", text: str = "text", page: int = 1, size: int = 20, allowed: DataFrame | None = None) -> DataFrame:
        """A page of hits: key, score, total, highlights. Of docs only the page's rows are asked for, by their keys."""
        size = min(size, 100)
        terms = query_terms(self.spark, query)
        hits = self.top(query, page * size, allowed).offset((page - 1) * size).collect() if terms else []  # 100 rows at most
        kind = docs.schema[key].dataType.simpleString()
        found = self.spark.createDataFrame([(r["key"], r["score"]) for r in hits], f"{key} {kind}, score double")
        total = self.total(query, allowed).first()[0]
        texts = docs.filter(F.col(key).isin([r["key"] for r in hits])).select(key, F.col(text).alias("_text"))
        marked = highlight(F.col("_text"), terms) if terms else F.array().cast("array<string>")
        return texts.join(F.broadcast(found), key).select(key, "score", F.lit(total).cast("long").alias("total"), marked.alias("highlights")).orderBy(F.desc("score"), key)

    def expire(self, keep: int = 1) -> list[str]:
        """Delete segments and pointers of all but the last versions."""
        return self.versions.expire(keep, "segments", lambda v: [s["name"] for s in v.get("segments", [])])
