"""Masking of personal data in texts, and the audit of what was masked.

Matches of all categories are found by one ordered alternation: the leftmost match counts, and at one
place the first of id card, bank card, phone, e-mail. Only built-in functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.functions.segments import bound, each, running_sums

# The patterns of the categories, in order of priority.
PATTERNS = {
    "id_card": r"[1-9][0-9]{5}(?:19|20)[0-9]{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12][0-9]|3[01])[0-9]{3}[0-9Xx]",
    "bank_card": r"\b[0-9]{4}[ \t]?[0-9]{4}[ \t]?[0-9]{4}[ \t]?[0-9]{4}[ \t]?[0-9]{0,3}\b",
    "phone": r"(?:(?:\+?86)?[ \t]*1[3-9][0-9][ \t]?[0-9]{4}[ \t]?[0-9]{4})|(?:\(?0[0-9]{2,3}\)?[ \t\-]?[0-9]{7,8})",
    "email": r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}",
}


def _chosen(categories: list[str] | None) -> list[str]:
    unknown = set(categories or []) - set(PATTERNS)
    if unknown:
        raise ValueError(f"unknown categories: {sorted(unknown)}")
    return [c for c in PATTERNS if categories is None or c in categories]


def alternation(categories: list[str] | None = None) -> str:
    return "|".join(f"(?:{PATTERNS[c]})" for c in _chosen(categories))


def _search(categories: list[str] | None) -> tuple[str, str]:
    """The alternation as it is searched, and what a text must hold for a match. An address can begin only where its run
    of characters begins or the match before ended, so each run is read once."""
    names = _chosen(categories)
    starts = {"email": r"(?:(?<![A-Za-z0-9._%+\-])|\G)"}
    return "|".join(f"(?:{starts.get(c, '')}(?:{PATTERNS[c]}))" for c in names), "|".join(["@"] * ("email" in names) + ["[0-9]"] * (set(names) != {"email"}))


def _category(match: Column, names: list[str]) -> Column:
    # Word boundaries held in the text; a match alone may end in a blank.
    alone = {n: f"^(?:{PATTERNS[n]})$".replace(r"\b", "") for n in names}
    chosen = F.when(match.rlike(alone[names[0]]), names[0])
    for n in names[1:]:
        chosen = chosen.when(match.rlike(alone[n]), n)
    return chosen.otherwise(names[-1])


def _masked(match: Column, category: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    phone = F.when(F.length(digits) >= 11, F.concat(F.left(digits, F.lit(3)), F.lit("****"), F.right(digits, F.lit(4)))).when(
        F.length(digits) >= 10, F.concat(F.left(digits, F.lit(3)), F.lit("****"), F.right(digits, F.lit(3)))
    ).otherwise("****")
    return (
        F.when(category == "id_card", F.concat(F.left(match, F.lit(6)), F.lit("********"), F.right(match, F.lit(4))))
        .when(category == "bank_card", F.concat(F.lit("****"), F.right(digits, F.lit(4))))
        .when(category == "phone", phone)
        .otherwise(F.concat(F.left(match, F.lit(1)), F.lit("***@"), F.regexp_extract(match, "@(.*)$", 1)))
    )


def pii_present(text: Column, categories: list[str] | None = None) -> Column:
    return F.coalesce(text.rlike(alternation(categories)), F.lit(False))


def sanitize(df: DataFrame, text: str = "text", categories: list[str] | None = None) -> DataFrame:
    """df with sanitized and masks, array<struct<category, original, masked, start, end>>; the end is that of the mask. Null and empty texts become ''."""
    names, cols = _chosen(categories), df.columns
    none = F.array().cast("array<string>")
    t = F.coalesce(F.col(text), F.lit(""))
    if not names:
        return df.select(*cols, t.alias("sanitized"), F.expr("cast(array() as array<struct<category:string,original:string,masked:string,start:int,end:int>>)").alias("masks"))
    pattern, needs = _search(names)
    step = df.withColumn("_hit", F.when(t.rlike(needs), F.regexp_extract_all(t, F.lit(pattern), F.lit(0))).otherwise(none))
    step = step.withColumn("_gap", F.when(F.size("_hit") > 0, F.split(t, pattern, -1)).otherwise(F.array(t)))
    step = step.withColumn("_m", F.transform("_hit", lambda h: bound(_category(h, names), lambda c: F.struct(c.alias("category"), h.alias("original"), _masked(h, c).alias("masked")))))
    step = step.withColumn("_end", F.when(F.size("_hit") > 0, running_sums(F.zip_with(F.slice("_gap", F.lit(1), F.size("_hit")), "_hit", lambda g, h: F.length(g) + F.length(h)))).otherwise(F.array().cast("array<int>")))
    pieces = F.zip_with("_gap", F.concat(F.transform("_m", lambda m: m["masked"]), F.array(F.lit(""))), lambda g, x: F.concat(g, F.coalesce(x, F.lit(""))))

    def mask(m: Column, i: Column) -> Column:
        start = F.get("_end", i) - F.length(m["original"])
        return F.struct(m["category"].alias("category"), m["original"].alias("original"), m["masked"].alias("masked"), start.alias("start"), (start + F.length(m["masked"])).alias("end"))

    return step.select(*cols, F.when(F.size("_hit") > 0, F.array_join(pieces, "")).otherwise(t).alias("sanitized"), F.transform("_m", mask).alias("masks"))


def mask_audit(df: DataFrame, key: str, text: str = "text", categories: list[str] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each mask, in order: key, further columns to keep, pos, category, original, masked, start, end, original_length."""
    found = sanitize(df.select(key, *keep, text), text, categories)
    length = F.length(F.coalesce(F.col(text), F.lit(""))).alias("original_length")
    return each(found, [key, *keep, length], F.col("masks"), "m", "pos").select(key, *keep, "pos", "m.*", "original_length")
