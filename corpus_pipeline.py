"""Corpus preparation in five stages, each of which filters or rewrites what the one before it kept.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame with the
columns of documents, the last one the encoded corpus. run() writes each stage's result as Parquet to the
shared folder and reads it again as the next one's docs.

Null and empty texts: language ID rejects them, as it does every text without a letter; every other text is given the likeliest
learned language. Repeated rows stay until near-dedup, which keeps one document of each group (rows with equal doc_id are one
document). Ties between languages go to the first in alphabetical order. Extra columns stay, whatever their names,
until the last stage, which returns its own. Very long texts are worked on whole. An empty table passes through all stages.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.llm import common, decontaminate, langid, neardup, pieces, secrets


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters or text, for which no language is predicted; lang becomes the predicted one. Learns from labelled documents outside the held-out fifth."""
    model = langid.fit(docs.filter(~langid.held_out()))
    return langid.keep_known(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates."""
    return neardup.deduplicate(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of the benchmark."""
    return decontaminate.clean(docs, common.table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts; no document is dropped."""
    return secrets.redact(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes the texts: doc_id, lang, source, ids, and the text decoded from them."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    coded = pieces.encode(docs.select("doc_id", "text", "lang", "source"), path, decoded="decoded")
    return coded.select("doc_id", "lang", "source", F.col("decoded").alias("text"), "ids")


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scan", secret_scan),
    ("sentencepiece", sentencepiece),
]

#: Trained and sampled stages have no SQL form; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage's result is a table in the shared folder; what a stage worked with, and the result before its own, go when it has ended."""
    docs, last = common.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path, before = common.scratch_path(spark, f"pipeline-{name}"), len(common.written)
        stage(spark, docs, sf_dir).write.parquet(path)
        common.delete_at_exit(spark, path)
        common.delete(spark, [*common.written[before:], *([last] if last else [])])
        docs, last = spark.read.parquet(path), path
    return docs
