"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams on Spark (map-side sums, one row per language and bucket); the smoothed
log-probability matrix, languages x buckets, has a fixed width and is broadcast. Scoring gathers
matrix rows for a batch of texts at a time and sums them by document.

Defined cases: a text that is null, empty or without a letter is `und` with score 0. With no labelled rows, as in
an empty table, everything is `und`. Equal scores go to the language first in alphabetical order. Repeated rows
are scored alike; extra columns are ignored, whatever their names. Very long texts are scored whole, with some 150 bytes of arrays
for each character, one text at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.llm import common

#: Hash buckets of n-grams (a power of two) and n-gram lengths.
BITS, ORDERS = 15, (1, 2, 3)
#: Bound of the training sample: whole labelled documents per language (expected number).
TRAIN_DOCS = 3000
#: Languages that a model may have: its matrix is 2^BITS x languages numbers of 4 bytes.
MAX_LANGS = 1000
UNKNOWN = "und"
_MULT = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def _grams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n-gram length the buckets of all positions and the text each position is in; n-grams never cross texts."""
    points = [np.frombuffer(t.lower().encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    sizes = np.array([len(p) for p in points])
    flat = np.concatenate(points).astype(np.uint64) if points else np.empty(0, np.uint64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    for n in ORDERS:
        m = len(flat) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n, np.uint64)
        for k in range(n):
            h = (h + flat[k : k + m]) * _MULT[k]
            h ^= h >> np.uint64(29)
        inside = owner[:m] == owner[n - 1 :]
        yield (h >> np.uint64(64 - BITS)).astype(np.int32)[inside], owner[:m][inside]


def _slices(texts: list[str], limit: int = 1 << 18) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of bounded total length, with the index of their first."""
    at = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield at, texts[at:i]
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield at, texts[at:]


def fit(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> dict:
    """The model: sorted languages and a float32 matrix (buckets x languages) of log-probabilities.

    docs: doc_id, text, lang. At most about train_docs whole documents of each language are used,
    picked by a hash of doc_id; rows without one aren't learned from. More than MAX_LANGS labels are an error.
    """
    spark = docs.sparkSession
    common.bound_batches(spark)
    known = docs.select("doc_id", "text", "lang").filter("doc_id is not null and lang is not null and text is not null")
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGS + 1).collect()}
    if len(sizes) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} values of lang: these aren't labels")
    langs = sorted(sizes)
    if not langs:
        return {"langs": [], "logp": np.zeros((1 << BITS, 0), np.float32)}
    share = F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, train_docs / sizes[k]))])
    picked = known.filter(F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(langs), 1 << BITS), np.int64)
        at = {k: i for i, k in enumerate(langs)}
        for b in batches:
            texts, of = b.column(0).to_pylist(), np.array([at[k] for k in b.column(1).to_pylist()])
            for first, part in _slices(texts):
                for h, owner in _grams(part):
                    sums += np.bincount(of[first + owner] * (1 << BITS) + h, minlength=sums.size).reshape(sums.shape)
        i, h = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(h, pa.int32()), pa.array(sums[i, h], pa.int64())], names=["l", "h", "n"])

    counted = picked.select("text", "lang").mapInArrow(common.lean(count), "l int, h int, n long").groupBy("l", "h").agg(F.sum("n").alias("n")).toPandas()
    sums = np.zeros((len(langs), 1 << BITS))
    sums[counted["l"], counted["h"]] = counted["n"]
    logp = np.log(sums + 0.5) - np.log((sums + 0.5).sum(axis=1, keepdims=True))
    return {"langs": langs, "logp": np.ascontiguousarray(logp.T, np.float32)}


def score_texts(texts: list[str | None], model: dict) -> tuple[list[str], np.ndarray]:
    """Language and score of each text."""
    langs, logp = model["langs"], model["logp"]
    out, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
    some = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))]
    if not langs:
        return out, score
    for first, part in _slices([texts[i] for i in some]):
        total, n = np.zeros((len(part), len(langs))), np.zeros(len(part))
        for h, owner in _grams(part):
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else np.empty(0, int)
            if len(starts):
                total[owner[starts]] += np.add.reduceat(logp[h], starts, axis=0)
                n[owner[starts]] += np.diff(np.r_[starts, len(owner)])
        best = total.argmax(axis=1)
        z = np.exp((total - total.max(axis=1, keepdims=True)) / np.sqrt(np.maximum(n, 1))[:, None])
        for j, i in enumerate(some[first : first + len(part)]):
            out[i], score[i] = langs[best[j]], 1 / z[j].sum()
    return out, score


def label(docs: DataFrame, model: dict, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs with columns for the predicted language and its score, under names that docs doesn't have; only the text is looked at."""
    common.bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # langs x 2^BITS floats
    cols = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, score = score_texts(b.column("text").to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in cols], pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*cols, *names])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(common.lean(run), f"{ddl}, `{names[0]}` string, `{names[1]}` double")


def keep_known(docs: DataFrame, model: dict, lang: str = "lang") -> DataFrame:
    """The rows of docs whose text is in a learned language, with that language in the column lang; no other column is added or changed."""
    common.bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # langs x 2^BITS floats
    cols = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, _ = score_texts(b.column("text").to_pylist(), shared.value)
            named = pa.array(found, pa.string())
            known = pa.array([x != UNKNOWN for x in found])
            yield pa.RecordBatch.from_arrays([(named if c == lang else b.column(c)).filter(known) for c in cols], names=cols)

    return docs.mapInArrow(common.lean(run), docs.schema)


def identify(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, lang_pred, score of every row of docs."""
    return label(docs.select("doc_id", "text"), model).drop("text")


def held_out():
    """True for the fifth of documents that is never learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    model = fit(docs.filter(~held_out()))
    return identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
