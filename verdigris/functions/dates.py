"""Column functions that find and parse dates; all instants are UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_DATE = r"([0-9]{4})[-/年]([0-9]{1,2})[-/月]([0-9]{1,2})日?"
_COMPACT = r"([0-9]{4})([0-9]{2})([0-9]{2})"


def raw_date(text: Column) -> Column:
    """The first date as it stands in the text, else null."""
    return F.nullif(F.regexp_extract(text, _DATE, 0), F.lit(""))


def extract_date(text: Column) -> Column:
    """The first date as YYYY-MM-DD, not validated; null if there is none."""
    y, m, d = (F.regexp_extract(text, _DATE, k) for k in (1, 2, 3))
    return F.when(y != "", F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")))


def _day(text: Column, pattern: str) -> Column:
    y, m, d = (F.regexp_extract(text, pattern, k) for k in (1, 2, 3))
    return F.when(y != "", F.try_to_timestamp(F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), F.lit("yyyy-MM-dd")))


def extract_date_valid(text: Column) -> Column:
    """The first date that is in the calendar, in separated form or else eight digits, as a timestamp."""
    return F.coalesce(_day(text, _DATE), _day(text, _COMPACT))


def parse_mixed_ts(text: Column) -> Column:
    """'Y-m-d H:M', 'Y-m-d', ISO seconds, a date at the start, or epoch milliseconds; null for anything else."""
    t = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")

    def if_like(pattern: str, fmt: str) -> Column:
        return F.when(t.rlike(pattern), F.try_to_timestamp(t, F.lit(fmt)))

    start = F.regexp_extract(t, "^" + _DATE, 0)
    millis = F.when(t.rlike(r"^[+-]?[0-9]{1,17}$"), F.timestamp_millis(F.expr("0") + t.try_cast("bigint")))
    return F.coalesce(
        if_like(r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}$", "yyyy-M-d H:m"), if_like(r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
        if_like(r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}$", "yyyy-M-d'T'H:m:s"), F.when(start != "", _day(start, _DATE)), millis,
    )
