"""Regex matches with code-point offsets, from built-in functions only.

split() gives the segments between matches and regexp_extract_all() the matches; they alternate, so
offsets are running sums of lengths. The sums are taken in blocks, which keeps the work near linear
for texts with very many matches. Patterns must not match the empty string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BLOCK, _CHUNK = 64, 64
SPAN_TYPE = "array<struct<start:int,end:int,match:string,before:string>>"


def running_sums(lengths: Column) -> Column:
    """Inclusive running sums of an array of ints."""

    def total(x: Column) -> Column:
        return F.aggregate(x, F.lit(0), lambda a, v: a + v)

    blocks = F.transform(
        F.sequence(F.lit(0), F.greatest(F.ceil(F.size(lengths) / _BLOCK).cast("int") - 1, F.lit(0))),
        lambda b: F.slice(lengths, b * _BLOCK + 1, F.lit(_BLOCK)),
    )
    with_base = F.transform(
        F.array(blocks),
        lambda bs: F.transform(bs, lambda x, i: F.struct(x.alias("x"), total(F.transform(F.slice(bs, F.lit(1), i), total)).alias("base"))),
    )[0]
    return F.flatten(F.transform(with_base, lambda b: F.transform(b["x"], lambda _, i: b["base"] + total(F.slice(b["x"], F.lit(1), i + 1)))))


def bound(value: Column, f) -> Column:
    """f(value), with value worked out once however often f uses it."""
    return F.transform(F.array(value), f)[0]


def each(df: DataFrame, keep: list[str | Column], array: Column, name: str, pos: str | None = None) -> DataFrame:
    """keep with a row for each element of an array that holds no nulls, and its place if pos names it.

    The outer form with a filter behind it, since Spark would filter for arrays with elements before the plain form, and so
    work out a costly array twice.
    """
    rows = df.select(*keep, F.explode_outer(array).alias(name) if pos is None else F.posexplode_outer(array).alias(pos, name))
    return rows.filter(F.col(name).isNotNull())


def literal_starts(text: Column, word: Column) -> Column:
    """Where a word stands in a text, left to right without overlaps: array<int>."""
    gaps = F.split(text, F.concat(F.lit("\\Q"), word, F.lit("\\E")), -1)
    ends = F.transform(F.slice(gaps, F.lit(1), F.size(gaps) - 1), lambda g: F.length(g) + F.length(word))
    return F.transform(bound(ends, running_sums), lambda e: e - F.length(word))


def chunks(text: Column) -> Column:
    """A text cut after every _CHUNK characters, in time linear in its length."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_CHUNK}}}"), F.lit(0))


def between(cut: Column, start: Column, end: Column) -> Column:
    """The characters from start to end of a text that chunks() has cut, without a walk from the text's first one."""
    low = F.greatest(start, F.lit(0))
    first = F.floor(low / _CHUNK).cast("int")
    part = F.slice(cut, first + 1, F.greatest(F.ceil(end / _CHUNK).cast("int") - first, F.lit(0)))
    return F.substr(F.array_join(part, ""), low - first * _CHUNK + 1, F.greatest(end - low, F.lit(0)))


def with_matches(df: DataFrame, text: str, patterns: dict[str, str], guards: dict[str, Column] | None = None, context: int = 0) -> DataFrame:
    """df with one column for each name in patterns: its matches as array<struct<start,end,match,before>>.

    guards: conditions without which a pattern isn't tried. context: how many characters before a
    match `before` holds, at most back to the previous match. A null text has no matches.
    """
    guards, cols = guards or {}, df.columns
    none = F.array().cast("array<string>")
    t = F.coalesce(F.col(text), F.lit(""))
    step = df.withColumns({f"_hit_{k}": F.when(guards.get(k, F.lit(True)), F.regexp_extract_all(t, F.lit(p), F.lit(0))).otherwise(none) for k, p in patterns.items()})
    step = step.withColumns({f"_gap_{k}": F.when(F.size(f"_hit_{k}") > 0, F.split(t, p, -1)).otherwise(none) for k, p in patterns.items()})
    step = step.withColumns({f"_len_{k}": F.zip_with(F.slice(f"_gap_{k}", F.lit(1), F.size(f"_hit_{k}")), f"_hit_{k}", lambda g, h: F.length(g) + F.length(h)) for k in patterns})
    step = step.withColumns({f"_end_{k}": F.when(F.size(f"_len_{k}") > 0, running_sums(F.col(f"_len_{k}"))).otherwise(F.array().cast("array<int>")) for k in patterns})

    def spans(k: str) -> Column:
        end, gap = F.col(f"_end_{k}"), F.col(f"_gap_{k}")
        return F.transform(f"_hit_{k}", lambda h, i: F.struct((F.get(end, i) - F.length(h)).alias("start"), F.get(end, i).alias("end"), h.alias("match"), (F.right(F.get(gap, i), F.lit(context)) if context else F.lit("")).alias("before")))

    return step.select(*cols, *[spans(k).alias(k) for k in patterns])
