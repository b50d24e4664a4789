"""Column functions over texts: labelled fields, decoding, truncation, chunks, highlighting."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from verdigris.functions.segments import each

# Labels of fields in detail texts.
FIELD_LABELS = {
    "company": "建设单位", "project_name": "建设项目名称", "construction_location": "建设地点", "construction_content": "建设内容",
    "contact_person": "联系人", "phone": "联系电话", "email": "邮箱", "eia_unit": "环评单位",
}


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def labelled_fields(text: Column, labels: dict[str, str] = FIELD_LABELS) -> list[Column]:
    """For each label the rest of the line after 'label:' (either colon), trimmed; null where it is missing."""
    return [F.nullif(strip(F.regexp_extract(text, rf"(?d){re.escape(label)}[：:]\s*([^\n]+)", 1)), F.lit("")).alias(name) for name, label in labels.items()]


@F.pandas_udf(StringType())
def _gbk(content: pd.Series) -> pd.Series:
    return content.map(lambda b: None if b is None else bytes(b).decode("gbk", "replace"))


def decode_text(content: Column) -> Column:
    """Bytes as UTF-8 where they are valid, else as GBK with replacement. Spark decodes no GBK by default, so those rows alone go to Python."""
    valid = F.is_valid_utf8(content.cast("string"))
    return F.when(valid, F.decode(content, "UTF-8")).otherwise(_gbk(F.when(~valid, content)))


def truncated(text: Column, n: int = 1_000_000) -> list[Column]:
    return [F.left(text, F.lit(n)).alias("text"), (F.length(text) > n).alias("truncated")]


def chunk_text(df: DataFrame, text: str, n: int = 512) -> DataFrame:
    """df's rows with each chunk of n characters and its offset; blank chunks are left out."""
    starts = F.sequence(F.lit(0), F.greatest(F.ceil(F.length(text) / n).cast("int") - 1, F.lit(0)))
    cut = each(df, df.columns, F.transform(starts, lambda i: F.struct((i * n).alias("offset"), F.substr(F.col(text), i * n + 1, F.lit(n)).alias("chunk"))), "_c")
    return cut.select(*df.columns, "_c.offset", "_c.chunk").filter(strip(F.col("chunk")) != "")


def highlight(text: Column, terms: list[str], width: int = 150, most: int = 3) -> Column:
    """Up to `most` windows of `width` characters, in order, that contain a term, with terms in <em> tags."""
    pattern = "(?i)(" + "|".join(re.escape(t) for t in terms) + ")"
    starts = F.sequence(F.lit(0), F.greatest(F.ceil(F.length(text) / width).cast("int") - 1, F.lit(0)))
    windows = F.transform(starts, lambda i: F.substr(text, i * width + 1, F.lit(width)))
    hit = F.slice(F.filter(windows, lambda w: w.rlike(pattern)), 1, most)
    return F.transform(hit, lambda w: F.regexp_replace(w, pattern, "<em>$1</em>"))
