"""Personal data: regular expressions propose spans, checksums confirm them, context words adjust scores.

Context is the text up to CONTEXT_CHARS characters on both sides of a span; before it, back to the last
confirmed span of the same kind at most, so a word in front of several spans counts for the first.

Everything is built from Spark's own functions, one projection over whole texts. Patterns are written
so that matching is linear: possessive runs, and starts only where a run begins or the last match ended.

Defined cases: a null or empty text has no spans. Kinds are sought independently, so spans of
different kinds may overlap. Offsets are code points, ends exclusive. Repeated rows give repeated results, an empty table none. Extra
columns are ignored, whatever their names. Very long texts take time and memory in proportion to their length.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.functions.segments import between, chunks, with_matches
from verdigris.llm import common

# The kinds in their order, the base kinds first, and their patterns.
BASE = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "local_phone": r"(?<![0-9+(.-])(?:\([0-9]{2,4}\)|[0-9]{2,4})[\x20.-][0-9]{3,4}[\x20.-][0-9]{4}(?![0-9-])",
}
# Score without context, what a context word adds, and the words; added kinds below MIN_SCORE are dropped.
SCORES = {"email": (0.9, 0.1), "ip": (0.6, 0.3), "card": (0.8, 0.2), "phone": (0.7, 0.3), "iban": (0.8, 0.2), "ssn": (0.3, 0.5), "local_phone": (0.3, 0.4)}
CONTEXT_WORDS = {
    "email": r"(?i)mail|contact|write",
    "ip": r"(?i)\bip\b|host|server|address",
    "card": r"(?i)card|visa|master|credit|pay",
    "phone": r"(?i)phone|tel|call|mobile|fax",
    "iban": r"(?i)iban|account|bank|konto",
    "ssn": r"(?i)ssn|social|security",
    "local_phone": r"(?i)phone|tel|call|mobile|fax",
}
CONTEXT_CHARS, MIN_SCORE = 40, 0.5
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _mod97(x: Column) -> Column:
    plain = F.regexp_replace(x, " ", "")
    turned = F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4))
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda a, c: F.when(c.rlike("^[0-9]$"), (a * 10 + F.ascii(c) - 48) % 97).when(c.rlike("^[A-Z]$"), (a * 100 + F.ascii(c) - 55) % 97).otherwise(a))


_VALID = {
    "ip": lambda m: m.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"),
    "card": lambda m: F.length(_digits(m)).between(12, 19) & F.call_function("luhn_check", _digits(m)),
    "phone": lambda m: F.length(_digits(m)).between(9, 15),
    "iban": lambda m: _mod97(m) == 1,
    "ssn": lambda m: ~m.rlike("^(?:000|666|9)|-00-|0000$"),
}


def find_pii(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id and spans, array<struct<start,rank,end,kind,score,match>>, sorted; rank is the kind's place."""
    digit, t = F.col("_digit"), F.col("text")
    own = docs.select("doc_id", common.text_or_empty().alias("text")).withColumn("_digit", t.rlike("[0-9]"))
    guards = {"email": t.contains("@"), "phone": t.contains("+"), **{k: digit for k in ("ip", "card", "iban", "ssn", "local_phone")}}
    found = with_matches(own, "text", PATTERNS, guards)
    any_match = reduce(lambda a, b: a | b, (F.size(k) > 0 for k in PATTERNS))
    found = found.withColumn("_cut", F.when(any_match, chunks(F.col("text"))).otherwise(F.array().cast("array<string>")))

    def confirmed(kind: str) -> Column:
        return F.filter(kind, lambda s: _VALID[kind](s["match"]))

    found = found.withColumns({k: confirmed(k) for k in _VALID})

    def context(kind: str, s: Column, i: Column) -> Column:
        low = F.greatest(s["start"] - CONTEXT_CHARS, F.coalesce(F.get(kind, i - 1)["end"], F.lit(0)))
        around = (between(F.col("_cut"), low, s["start"]), between(F.col("_cut"), s["end"], s["end"] + CONTEXT_CHARS))
        return F.concat(around[0], F.lit("\n"), around[1])

    def kept(rank: int, kind: str) -> Column:
        plain, more = SCORES[kind]
        scored = F.transform(
            kind,
            lambda s, i: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind"), F.when(context(kind, s, i).rlike(CONTEXT_WORDS[kind]), plain + more).otherwise(F.lit(plain)).alias("score"), s["match"].alias("match")),
        )
        return scored if kind in BASE else F.filter(scored, lambda s: s["score"] >= MIN_SCORE)

    return found.select("doc_id", F.array_sort(F.concat(*[kept(i, k) for i, k in enumerate(PATTERNS)])).alias("spans"))


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def digest(found: DataFrame, base: tuple[str, ...]) -> DataFrame:
    """Counts of the base kinds, the hash of the base spans and all spans as text."""
    first = F.filter("spans", lambda s: s["rank"] < len(base))
    kinds = F.transform("spans", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in base]
    return found.select("doc_id", *counts, F.sha2(joined(first), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(find_pii(common.table(spark, sf_dir, "documents")), BASE)
