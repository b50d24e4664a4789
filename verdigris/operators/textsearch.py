"""TF-IDF models, similarity, BM25 full-text search and suggestions, as long tables of terms."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verdigris.functions import batches
from verdigris.functions.segments import bound, each
from verdigris.functions.texts import highlight, strip

K1, B = 1.2, 0.75
#: Grams that a task sums up before it gives sums out, and grams that are spelled at a time.
MOST_GRAMS, SPELLED = 1 << 18, 1 << 14


def char_grams(text: Column) -> Column:
    """All character n-grams of a text, n from 1 to 3, runs of white space counting as one space."""

    def grams(c: Column) -> Column:
        n = F.size(c)
        upto = lambda k: F.greatest(n - k, F.lit(0))
        two = F.zip_with(F.slice(c, F.lit(1), upto(1)), F.slice(c, F.lit(2), upto(1)), lambda x, y: F.concat(x, y))
        three = bound(two, lambda p: F.zip_with(F.slice(p, F.lit(1), upto(2)), F.slice(c, F.lit(3), upto(2)), lambda x, y: F.concat(x, y)))
        return F.concat(c, two, three)

    return bound(F.split(F.regexp_replace(text, r"\s\s+", " "), ""), grams)


def gram_counts(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, gram, tf."""
    some = docs.filter(F.col(text).isNotNull() & (F.col(text) != ""))
    return each(some, [key], char_grams(F.col(text)), "gram").groupBy(key, "gram").agg(F.count("*").alias("tf"))


def tfidf_fit(counts: DataFrame, n_docs: int, max_features: int = 5000) -> DataFrame:
    """The model: gram, df, idf, n_docs of the max_features grams that occur most (ties by gram)."""
    totals = counts.groupBy("gram").agg(F.sum("tf").alias("total"), F.count("*").alias("df"))
    return totals.orderBy(F.desc("total"), "gram").limit(max_features).select("gram", "df", (F.log(F.lit(1 + n_docs) / (1 + F.col("df"))) + 1).alias("idf"), F.lit(n_docs).cast("long").alias("n_docs"))


def _counted(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct grams of char_grams() of one text, as numbers in order, and how often each occurs. A gram's number holds its code points, plus one, in 21 bits each."""
    t = re.sub(r"(?a)\s\s+", " ", text or "")
    p = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) + 1
    one, two = p << 42, (p[:-1] << 42) | (p[1:] << 21)
    return np.unique(np.concatenate([one, two, two[:-1] | p[2:]]), return_counts=True)


def _spelled(codes: np.ndarray) -> list[str]:
    parts = np.stack([codes >> 42, (codes >> 21) & 0x1FFFFF, codes & 0x1FFFFF], 1)
    return ["".join(chr(c - 1) for c in row if c) for row in parts.tolist()]


def _code(gram: str) -> int:
    points = [ord(c) + 1 for c in gram] + [0, 0]
    return points[0] << 42 | points[1] << 21 | points[2]


def _summed(codes: np.ndarray, totals: np.ndarray, dfs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct codes in order, with the sums of both counts."""
    grams, at = np.unique(codes, return_inverse=True)
    return grams, np.bincount(at, totals, len(grams)).astype(np.int64), np.bincount(at, dfs, len(grams)).astype(np.int64)


def _sums(n: int, grams: np.ndarray, totals: np.ndarray, dfs: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of gram, total and df, SPELLED grams at a time, and one without a gram for n documents."""
    yield pa.RecordBatch.from_arrays([pa.array([None], pa.string()), pa.array([n], pa.int64()), pa.array([n], pa.int64())], names=["gram", "total", "df"])
    for at in range(0, len(grams), SPELLED):
        one = slice(at, at + SPELLED)
        yield pa.RecordBatch.from_arrays([pa.array(_spelled(grams[one]), pa.string()), pa.array(totals[one]), pa.array(dfs[one])], names=["gram", "total", "df"])


def tfidf_fit_texts(docs: DataFrame, text: str = "text", max_features: int = 5000) -> DataFrame:
    """The model of tfidf_fit(gram_counts(docs)) over all documents with a text, without a row for each document and gram.

    One pass sums totals and document frequencies within a task, which holds MOST_GRAMS sums at most and then gives them out, so only distinct grams
    are shuffled, however many documents there are.
    """

    def count(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held, n = [], 0, 0
        for b in batches.slices(found, text):
            codes, counts = (np.concatenate(x) for x in zip(*map(_counted, b.column(0).to_pylist()), strict=True))
            parts.append(_summed(codes, counts, np.ones(len(codes), np.int64)))
            held, n = held + len(parts[-1][0]), n + b.num_rows
            if held > MOST_GRAMS:
                parts = [_summed(*map(np.concatenate, zip(*parts, strict=True)))]
                held = len(parts[0][0])
                if held > MOST_GRAMS // 2:
                    yield from _sums(n, *parts[0])
                    parts, held, n = [], 0, 0
        if n:
            yield from _sums(n, *_summed(*map(np.concatenate, zip(*parts, strict=True))))

    batches.bound_batches(docs.sparkSession)
    some = docs.filter(F.col(text).isNotNull()).select(text)
    sums = some.mapInArrow(count, "gram string, total long, df long").groupBy("gram").agg(F.sum("total").alias("total"), F.sum("df").alias("df"))
    # The row without a gram counts documents; it has the place before all grams.
    best = sums.orderBy(F.col("gram").isNotNull(), F.desc("total"), "gram").limit(max_features + 1)
    n_docs = F.coalesce(F.max(F.when(F.col("gram").isNull(), F.col("total"))).over(Window.partitionBy(F.lit(1))), F.lit(0))  # max_features rows
    return best.withColumn("n_docs", n_docs).filter("gram is not null").select("gram", "df", (F.log((1 + F.col("n_docs")) / (1 + F.col("df"))) + 1).alias("idf"), "n_docs")


class _Model:
    """A fitted model, max_features rows, as arrays that tasks search."""

    def __init__(self, rows: list) -> None:
        codes = np.array([_code(r["gram"]) for r in rows], np.int64)
        order = np.argsort(codes)
        self.codes, self.grams = codes[order], [rows[i]["gram"] for i in order]
        self.idf = np.array([rows[i]["idf"] for i in order])

    def weights(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Places of a text's grams in the model, and their weights as in tfidf_transform."""
        codes, counts = _counted(text)
        at = np.searchsorted(self.codes, codes)
        hit = at < len(self.codes)
        hit[hit] = self.codes[at[hit]] == codes[hit]
        at = at[hit]
        raw = (1 + np.log(counts[hit])) * self.idf[at]
        return at, raw / np.sqrt((raw * raw).sum()) if len(raw) else raw


def _mapped(df: DataFrame, text: str, out: str, kind: str, make: Callable[[list], pa.Array]) -> DataFrame:
    """df with a column that make() gives for the texts of a slice, in place of one with its name."""
    return batches.mapped(df, text, [c for c in df.columns if c != out], {out: kind}, lambda texts: [make(texts)])


def with_embedding(df: DataFrame, model: DataFrame, text: str = "text", out: str = "embedding") -> DataFrame:
    """df with a column of each text's weights, map<string,double>, at most as many as the model has grams; empty for a null or empty text."""
    shared = df.sparkSession.sparkContext.broadcast(_Model(model.select("gram", "idf").collect()))  # max_features rows

    def make(texts: list) -> pa.Array:
        m = shared.value
        at, w = zip(*map(m.weights, texts), strict=True) if texts else ((), ())
        ends = np.cumsum([0, *map(len, at)]).astype(np.int32)
        keys = pa.array(m.grams, pa.string()).take(pa.array(np.concatenate([np.empty(0, np.int64), *at])))
        return pa.MapArray.from_arrays(pa.array(ends), keys, pa.array(np.concatenate([np.empty(0), *w])))

    return _mapped(df, text, out, "map<string,double>", make)


def tfidf_transform(counts: DataFrame, model: DataFrame, key: str) -> DataFrame:
    """key, gram, tf, weight: (1 + ln tf) idf, each document of unit length."""
    raw = counts.join(model.select("gram", "idf"), "gram").withColumn("_w", (1 + F.log("tf")) * F.col("idf"))
    norms = raw.groupBy(key).agg(F.sqrt(F.sum(F.col("_w") * F.col("_w"))).alias("_n"))
    return raw.join(norms, key).select(key, "gram", "tf", (F.col("_w") / F.col("_n")).alias("weight"))


def top_terms(weights: DataFrame, key: str, k: int = 20) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc("weight"), "gram")
    return weights.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def save_model(model: DataFrame, path: str) -> None:
    model.write.mode("errorifexists").parquet(path)


def load_model(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def similarity_topk(query: str, docs: DataFrame, key: str, text: str = "text", k: int = 10, max_features: int = 5000, keep: tuple[str, ...] = (), snippet: int = 200) -> DataFrame:
    """key, further columns to keep (title, source), score, snippet: the k documents (at most 100) with the largest TF-IDF cosine to the query, the
    model of max_features grams fitted on both; ties by key, documents that share no gram with the query left out."""
    rows = docs.select(key, *keep, F.col(text).alias("_t"))
    asked = docs.sparkSession.createDataFrame([(query,)], "_t string")
    fitted = _Model(tfidf_fit_texts(rows.select("_t").unionByName(asked), "_t", max_features).select("gram", "idf").collect())
    shared = docs.sparkSession.sparkContext.broadcast(fitted)  # max_features rows

    def make(texts: list) -> pa.Array:
        m = shared.value
        wanted = np.zeros(len(m.idf))
        at, w = m.weights(query)
        wanted[at] = w
        return pa.array([float((wanted[at] * w).sum()) for at, w in map(m.weights, texts)], pa.float64())

    scored = _mapped(rows, "_t", "score", "double", make)
    best = scored.filter("score > 0").orderBy(F.desc("score"), key).limit(min(k, 100))
    return best.select(key, *keep, "score", F.left("_t", F.lit(snippet)).alias("snippet"))


_TOKEN = r"\p{IsHan}|(?:[^\P{L}\p{IsHan}]|\p{N})++"


def tokens(text: Column) -> Column:
    """Lower-case terms: single Han characters, and runs of other letters or digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(_TOKEN), F.lit(0))


def token_count(text: Column) -> Column:
    """How many tokens() a text has."""
    return F.regexp_count(F.lower(text), F.lit(_TOKEN))


def term_counts(text: Column) -> Column:
    """The distinct tokens() of a text with how often each stands there, array<struct<term,tf>>."""

    def runs(t: Column) -> Column:
        begins = F.filter(F.transform(t, lambda x, i: F.when((i == 0) | (x != F.get(t, i - 1)), i)), lambda i: i.isNotNull())
        return bound(begins, lambda at: F.transform(at, lambda i, j: F.struct(F.get(t, i).alias("term"), (F.coalesce(F.get(at, j + 1), F.size(t)) - i).alias("tf"))))

    return bound(F.sort_array(tokens(text)), runs)


def query_terms(spark: SparkSession, query: str) -> list[str]:
    """The distinct terms of a query, split as texts are."""
    return spark.range(1).select(F.array_distinct(tokens(F.lit(query)))).first()[0]


def _scored(docs: DataFrame, key: str, terms: list[str], text: str, keep: tuple[str, ...], k1: float, b: float) -> DataFrame:
    """key, keep, score and total (documents with a term) of the documents that hold a term.

    A first pass counts tokens and the documents of each term; only texts in which a term can stand are split, there and in the second pass.
    """
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    has = [low.contains(w) & F.array_contains(tokens(F.col(text)), w) for w in terms]
    first = docs.select(F.regexp_count(low, F.lit(_TOKEN)).alias("dl"), *[h.alias(f"_{i}") for i, h in enumerate(has)])
    any_of = F.greatest(*[F.col(f"_{i}").cast("int") for i in range(len(terms))]) if len(terms) > 1 else F.col("_0").cast("int")
    stats = first.agg(F.count("*").alias("_n"), F.avg("dl").alias("_avg"), F.coalesce(F.sum(any_of), F.lit(0)).alias("total"), *[F.count_if(f"_{i}").alias(f"_df{i}") for i in range(len(terms))])
    likely = low.contains(terms[0])
    for w in terms[1:]:
        likely |= low.contains(w)
    split = docs.filter(likely).select(key, *keep, tokens(F.col(text)).alias("_t")).select(key, *keep, F.size("_t").alias("_dl"), F.filter("_t", lambda x: x.isin(*terms)).alias("_m")).filter(F.size("_m") > 0)
    score = F.lit(0.0)
    for i, w in enumerate(terms):
        df, tf = F.col(f"_df{i}"), F.size(F.filter("_m", _equals(w)))
        score = score + F.log(1 + (F.col("_n") - df + 0.5) / (df + 0.5)) * tf / (tf + k1 * (1 - b + b * F.col("_dl") / F.col("_avg")))
    return split.join(F.broadcast(stats)).select(key, *keep, score.alias("score"), "total")  # stats is one row


def bm25(docs: DataFrame, key: str, query: str, text: str = "text", k1: float = K1, b: float = B) -> DataFrame:
    """key, score of the documents that hold a term of the query."""
    terms = query_terms(docs.sparkSession, query)
    if not terms:
        return docs.select(key, F.lit(0.0).alias("score")).filter("false")
    return _scored(docs, key, terms, text, (), k1, b).select(key, "score")


def _equals(w: str):
    return lambda x: x == w


def fulltext_search(docs: DataFrame, key: str, query: str, text: str = "text", page: int = 1, size: int = 20) -> DataFrame:
    """A page of hits: key, score, total (all hits), highlights; highlights are made for the page only. Filters go on docs before."""
    terms, size = query_terms(docs.sparkSession, query), min(size, 100)
    if not terms:
        return docs.select(key, F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("total"), F.array().cast("array<string>").alias("highlights")).filter("false")
    hits = _scored(docs.withColumn("_text", F.col(text)), key, terms, text, ("_text",), K1, B)
    few = hits.orderBy(F.desc("score"), key).offset((page - 1) * size).limit(size)
    return few.select(key, "score", "total", highlight(F.col("_text"), terms).alias("highlights"))


def suggest(df: DataFrame, term: Column, prefix: str, limit: int = 10) -> DataFrame:
    """term, n: values with the prefix (any case), the most frequent first, then by name."""
    return df.select(strip(term).alias("term")).filter(F.lower("term").startswith(prefix.lower())).groupBy("term").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "term").limit(min(limit, 20))
