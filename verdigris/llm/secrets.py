"""Secret scans with multipart credential linking, from Spark's own functions only.

Strong kinds (assign, access, hex) are always reported. Weak candidates (bare 40-character keys,
account identifiers, endpoints) say little alone: they are reported only if the complementary parts
of a credential lie within SCOPE characters, counted from the end of one part to the start of the
other. That interval join makes no pairs: running over the exploded parts of a row by start, it carries
the greatest end of earlier complements, and running back, the least start of later ones.

Defined cases: a null or empty text has no spans. Offsets are code points, ends exclusive. Repeated
rows give repeated results, also if doc_id is null or repeated; an empty table gives none. Extra columns are ignored, and kept by
redact(), whatever their names. Very long texts take time and memory in proportion to their length; the parts of one text are sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verdigris.functions.segments import bound, each, with_matches
from verdigris.llm import common
from verdigris.llm.pii import digest

# The kinds in their order, the base kinds first, their patterns and the part of a credential each is.
BASE = ("assign", "access", "hex")
PATTERNS = {
    "assign": r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
    "access": r"AKIA[A-Z0-9]{16,}",
    "hex": r"(?<![0-9a-f])[0-9a-f]{24,}",
    "bare_key": r"(?<![A-Za-z0-9+/=_.-])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=_.-])",
    "identifier": r"(?<![A-Za-z0-9])(?i:user|username|login|account|client_id|access_key_id)[\"']?\x20{0,8}[:=]\x20{0,8}[\"']?[A-Za-z0-9._@-]{3,}",
    "endpoint": r"(?i:https?|postgres|postgresql|mysql|mongodb|redis|amqp|s3)://[^\s\"'<>]+",
}
PART = {"assign": "secret", "access": "id", "hex": "secret", "bare_key": "secret", "identifier": "id", "endpoint": "endpoint"}
#: Parts that must lie in scope for a weak kind to count, and the scope in characters.
NEEDS = {"bare_key": ("id",), "identifier": ("secret",), "endpoint": ("id", "secret")}
SCOPE = 200
#: Characters of the chunks that a text is cut into to take spans out.
CHUNK = 256


def _parts(docs: DataFrame) -> DataFrame:
    """docs with a column parts: all candidates, array<struct<start,rank,end,kind,match>>."""
    t, low = F.col("text"), F.col("_low")

    def any_of(*words: str) -> Column:
        found = low.contains(words[0])
        for w in words[1:]:
            found |= low.contains(w)
        return found

    own = docs.withColumn("_text", t).withColumn("text", common.text_or_empty()).withColumn("_low", F.lower("text"))
    guards = {
        "assign": any_of("passw", "secret", "token", "apikey", "api_key"), "access": t.contains("AKIA"), "endpoint": t.contains("://"),
        "identifier": any_of("user", "login", "account", "client_id", "access_key_id"), "bare_key": t.rlike("[A-Za-z0-9+/]{40}"),
    }
    found = with_matches(own, "text", PATTERNS, guards)
    valid = {
        "assign": lambda m: F.length(F.regexp_extract(m, PATTERNS["assign"], 1)) >= 6,
        "bare_key": lambda m: m.rlike("[0-9]") & m.rlike("[A-Z]") & m.rlike("[a-z]"),
    }

    def kept(rank: int, kind: str) -> Column:
        ok = valid.get(kind, lambda m: F.lit(True))
        return F.transform(F.filter(kind, lambda s: ok(s["match"])), lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind"), s["match"].alias("match")))

    return found.select(*[c for c in docs.columns if c != "text"], F.col("_text").alias("text"), F.concat(*[kept(i, k) for i, k in enumerate(PATTERNS)]).alias("parts"))


def _linked(rows: DataFrame) -> DataFrame:
    """rows (_row, parts, more columns) with a row for each part, _p, or one with a null for a row without parts; _k is the part's place and
    _fits holds for strong parts, and for weak ones whose complement is in scope. More columns stand at the part in place 0 only."""
    # Running frames that include rows of the same start; both run forwards, since Spark recomputes shrinking frames.
    upto = Window.partitionBy("_row").orderBy("_at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    back = Window.partitionBy("_row").orderBy(F.desc("_at")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    more = [c for c in rows.columns if c not in ("_row", "parts")]
    one = rows.select("*", F.posexplode_outer("parts").alias("_k", "_p")).withColumn("_at", F.col("_p.start"))
    one = one.select("_row", "_p", "_k", "_at", *[F.when(F.coalesce(F.col("_k"), F.lit(0)) == 0, F.col(c)).alias(c) for c in more])
    kind, start, end = F.col("_p.kind"), F.col("_p.start"), F.col("_p.end")

    def in_scope(part: str) -> Column:
        such = kind.isin([k for k, v in PART.items() if v == part])
        return (F.coalesce(F.max(F.when(such, end)).over(upto) >= start - SCOPE, F.lit(False))) | F.coalesce(F.min(F.when(such, start)).over(back) <= end + SCOPE, F.lit(False))

    seen = one.withColumns({f"_has_{p}": in_scope(p) for p in ("id", "secret")})
    fits = kind.isin(*BASE)
    for k, parts in NEEDS.items():
        ok = kind == k
        for p in parts:
            ok &= F.col(f"_has_{p}")
        fits |= ok
    return seen.withColumn("_fits", F.coalesce(fits, F.lit(False))).drop("_has_id", "_has_secret")


def find_secrets(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id and spans, array<struct<start,rank,end,kind,match>>, sorted; rank is the kind's place."""
    rows = _parts(docs.select("doc_id", "text")).select(F.monotonically_increasing_id().alias("_row"), "doc_id", "parts")
    spans = F.array_sort(F.collect_list(F.when(F.col("_fits"), F.col("_p"))))
    return _linked(rows).groupBy("_row").agg(F.first("doc_id", ignorenulls=True).alias("doc_id"), spans.alias("spans")).drop("_row")


def _without(text: Column, cuts: Column, mark: str) -> Column:
    """text with every cut (from, to, marked), in order and apart from each other, taken out and mark put in for those marked.

    The text is cut into chunks once, and what stays is put together from parts of chunks, so no step walks the text from its start.
    """
    whole = F.length(text)

    def joined(v: Column) -> Column:
        chunk, cut = v["chunks"], v["cuts"]

        def stays(low: Column, high: Column) -> Column:
            n = F.lit(CHUNK)
            ids = F.when(high > low, F.sequence(F.floor(low / n).cast("int"), F.floor((high - 1) / n).cast("int"))).otherwise(F.array().cast("array<int>"))
            return F.transform(ids, lambda k: F.substr(F.get(chunk, k), F.greatest(low - k * n, F.lit(0)) + 1, F.least(high, (k + 1) * n) - F.greatest(low, k * n)))

        def step(c: Column, i: Column) -> Column:
            before = F.when(i > 0, F.get(cut, i - 1)["to"]).otherwise(F.lit(0))
            return F.concat(stays(before, c["from"]), F.when(c["marked"], F.array(F.lit(mark))).otherwise(F.array().cast("array<string>")))

        return F.array_join(F.flatten(F.transform(cut, step)), "")

    end = F.struct(whole.alias("from"), whole.alias("to"), F.lit(False).alias("marked"))
    chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))
    return bound(F.struct(chunks.alias("chunks"), F.concat(cuts, F.array(end)).alias("cuts")), joined)


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with every found secret replaced by mark and n_chars brought up to date, all rows and columns kept.

    Only rows with candidates are shuffled; the others pass straight through. Spans may overlap: what a running maximum of ends
    says is gone already isn't cut again, and spans that overlap are one mark.
    """
    cols = docs.columns
    rows = _parts(docs.select(F.struct(*cols).alias("_doc"), "text")).withColumn("_row", F.monotonically_increasing_id())
    # Not a filter on parts, which Spark would push below them and work out anew for each element of its own lambdas.
    rest = each(rows, [], F.when(F.size("parts") == 0, F.array("_doc")), "_doc").select("_doc.*")
    earlier = Window.partitionBy("_row").orderBy("_at", "_k").rowsBetween(Window.unboundedPreceding, -1)
    one = _linked(rows.filter(F.size("parts") > 0).select("_row", "parts", "_doc"))
    one = one.withColumn("_gone", F.coalesce(F.max(F.when(F.col("_fits"), F.col("_p.end"))).over(earlier), F.lit(0)))
    start, end, gone = F.col("_p.start"), F.col("_p.end"), F.col("_gone")
    cut = F.struct(F.greatest(start, gone).alias("from"), F.greatest(end, gone).alias("to"), (start >= gone).alias("marked"))
    # A list, of one element, as first() would copy the row's text at each of its parts.
    found = one.groupBy("_row").agg(F.get(F.collect_list("_doc"), F.lit(0)).alias("_doc"), F.array_sort(F.collect_list(F.when(F.col("_fits"), cut))).alias("_cuts"))
    text = F.col("_doc.text")
    done = found.select("_doc", F.when(F.size("_cuts") > 0, _without(text, F.col("_cuts"), mark)).otherwise(text).alias("_new"))
    out = {"text": F.col("_new"), "n_chars": F.length("_new").cast(docs.schema["n_chars"].dataType) if "n_chars" in cols else None}
    return rest.unionByName(done.select(*[out[c].alias(c) if c in out else F.col("_doc")[c].alias(c) for c in cols]))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(find_secrets(common.table(spark, sf_dir, "documents")), BASE)
