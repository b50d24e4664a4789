"""The document pipeline as one composed plan: parse, sanitize, entities, TF-IDF."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.functions import texts
from verdigris.operators import entities, masking, pages, textsearch
from verdigris.sources import office

STAGES = ("parse", "sanitize", "ner", "embed")
_ERRORS = "array<struct<stage:string,error:string>>"


#: Extensions that Spark's own functions read.
TEXTS, MARKUPS = ("txt",), ("html", "htm")


def parse_files(files: DataFrame) -> DataFrame:
    """path, text, tables, metadata, error of scanned files (path, extension, content, error): texts are UTF-8 or else GBK, of pages their text nodes, a
    line each; DOCX and XLSX are read in tasks. What the scan refused keeps its code, and an extension without a parser gets NO_PARSER."""
    fine, ext = files.filter("error is null"), F.col("extension")
    office_files = office.parse_office(fine.filter(ext.isin(*office.EXTENSIONS)))
    content, is_text, is_markup = F.col("content"), ext.isin(*TEXTS), ext.isin(*MARKUPS)
    one_break = lambda t: F.regexp_replace(t, r"\r\n?", "\n")
    text = F.when(is_text, one_break(texts.decode_text(F.when(is_text, content)))).when(is_markup, pages.html_to_text(one_break(F.make_valid_utf8(F.when(is_markup, content).cast("string")))))
    encoding = F.when(is_text, F.when(F.is_valid_utf8(content.cast("string")), "utf-8").otherwise("gbk"))
    known = F.struct(F.element_at(F.split("path", "/"), -1).alias("title"), F.lit(None).cast("int").alias("paragraphs"), F.lit(None).cast("array<string>").alias("sheets"), F.lit(0).alias("tables_count"), encoding.alias("encoding"), F.octet_length(content).cast("long").alias("file_size"))
    plain = fine.filter(~ext.isin(*office.EXTENSIONS)).select("path", text.alias("text"), F.array().cast(office.TABLES).alias("tables"), F.when(is_text | is_markup, known).alias("metadata"), F.when(~is_text & ~is_markup, "NO_PARSER").alias("error"))
    refused = files.filter("error is not null").select("path", F.lit(None).cast("string").alias("text"), F.array().cast(office.TABLES).alias("tables"), F.lit(None).cast(office.METADATA).alias("metadata"), "error")
    return office_files.unionByName(plain).unionByName(refused)


def run_pipeline(
    docs: DataFrame, key: str, text: str = "text", stages=STAGES, keywords: dict = entities.KEYWORDS, max_chars: int = 1_000_000, max_features: int = 5000,
    error: str | None = None, continue_on_error: bool = False, model: DataFrame | None = None,
) -> DataFrame:
    """key, text, truncated, n_masks, entities, entity_count, embedding (gram to weight), n_features, stages_completed, errors.

    Stages run in the order parse, sanitize, ner, embed whatever order they are named in, each within the row. error names a column of
    parse errors, as parse_files gives; a null text is an error of the parse stage, too. Such a row ends there, or with
    continue_on_error goes on with an empty text. model: a fitted TF-IDF model; without one it is fitted on the texts that reach the embed stage.
    """
    unknown = set(stages) - set(STAGES)
    if unknown:
        raise ValueError(f"unknown stages: {sorted(unknown)}")
    named = [s for s in STAGES if s in stages]
    why = F.coalesce(F.col(error) if error else F.lit(None).cast("string"), F.when(F.col(text).isNull(), "no text"))
    step = docs.select(key, why.alias("_why"), *texts.truncated(F.col(text), max_chars))
    goes_on = F.lit(True) if continue_on_error else F.col("_why").isNull()
    step = step.withColumn("_on", goes_on).withColumn("text", F.when(F.col("_on"), F.coalesce("text", F.lit("")))).withColumn("truncated", F.coalesce("truncated", F.lit(False)))

    def list_of(names: list[str]) -> Column:
        return F.array(*[F.lit(s) for s in names]).cast("array<string>")

    later = [s for s in named if s != "parse"]
    done = F.when(F.col("_why").isNull(), list_of(named)).when(F.col("_on"), list_of(later)).otherwise(list_of([]))
    step = step.withColumns({
        "stages_completed": done,
        "errors": F.when(F.col("_why").isNotNull(), F.array(F.struct(F.lit("parse").alias("stage"), F.col("_why").alias("error")))).otherwise(F.array().cast(_ERRORS)),
    })
    if "sanitize" in named:
        step = masking.sanitize(step, "text").withColumn("text", F.when(F.col("_on"), F.col("sanitized"))).withColumn("n_masks", F.size("masks")).drop("sanitized", "masks")
    else:
        step = step.withColumn("n_masks", F.lit(0))
    if "ner" in named:
        step = entities.with_entities(step, "text", keywords)
    else:
        step = step.withColumn("entities", F.array().cast(f"array<{entities.ENTITY}>"))
    if "embed" in named:
        step = textsearch.with_embedding(step, textsearch.tfidf_fit_texts(step, "text", max_features) if model is None else model)
    else:
        step = step.withColumn("embedding", F.create_map().cast("map<string,double>"))
    counts = (F.size("entities").cast("long").alias("entity_count"), "embedding", F.size("embedding").cast("long").alias("n_features"))
    return step.select(key, "text", "truncated", "n_masks", "entities", *counts, "stages_completed", "errors")
