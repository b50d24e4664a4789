"""Filters over reports, links and dated rows."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdigris.functions import dates, titles, urls
from verdigris.functions.texts import strip

# Domains left out of search hits, static files, words of notices.
EXCLUDED_DOMAINS = ("facebook.com", "twitter.com", "linkedin.com", "weibo.com", "zhihu.com")
STATIC = (".css", ".js", ".png", ".jpg", ".gif", ".ico")
NOTICE_WORDS = ("通知", "公告", "公示")


def paged(df: DataFrame, order: list, page: int = 1, size: int = 20) -> DataFrame:
    """One page of df in a fixed order; size is at most 100."""
    size = min(size, 100)
    return df.orderBy(*order).offset((page - 1) * size).limit(size)


def list_reports(df: DataFrame, key: str, equals: dict[str, object] | None = None, page: int = 1, size: int = 20) -> DataFrame:
    """A page of the rows that meet all given equalities; None values don't filter."""
    for c, v in (equals or {}).items():
        if v is not None:
            df = df.filter(F.col(c) == v)
    return paged(df, [key], page, size)


def list_with_total(df: DataFrame, key: str, equals: dict[str, object] | None = None, page: int = 1, size: int = 20) -> DataFrame:
    """list_reports with total, the number of rows on all pages: one more count of the rows that meet the equalities, a row that joins the page."""
    met = search_filters(df, equals)
    return paged(met, [key], page, size).join(F.broadcast(met.agg(F.count("*").alias("total"))))


def search_filters(df: DataFrame, equals: dict[str, object] | None = None, date: str | None = None, date_from=None, date_to=None) -> DataFrame:
    """Equalities and an inclusive date range, put before any scoring."""
    for c, v in (equals or {}).items():
        if v is not None:
            df = df.filter(F.col(c) == v)
    if date_from is not None:
        df = df.filter(F.col(date) >= F.lit(date_from))
    return df if date_to is None else df.filter(F.col(date) <= F.lit(date_to))


def incremental_cutoff(df: DataFrame, ts: str, cutoff: datetime | str | None, full: bool = False) -> DataFrame:
    """Rows not before the cutoff; rows without a date stay. No cutoff, one that isn't a date, or full: all rows."""
    if isinstance(cutoff, str):
        try:
            cutoff = datetime.fromisoformat(cutoff)
        except ValueError:
            cutoff = None
    if full or cutoff is None:
        return df
    return df.filter(F.col(ts).isNull() | (F.col(ts) >= F.lit(cutoff)))


def early_stop(df: DataFrame, group: str, order: list, is_old: Column, max_old: int = 5) -> DataFrame:
    """Rows of each list, read in order, that aren't old, up to where more than max_old old ones have been met."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_old", is_old).withColumn("_met", F.count_if("_old").over(w)).filter(~F.col("_old") & (F.col("_met") <= max_old)).drop("_old", "_met")


def select_links(links: DataFrame, matches=titles.matches_report) -> DataFrame:
    """Links (href, url, text, title, parent_text) that are documents or whose text or parent's text is about reports, with
    file_type by href and published_at, the first date in these texts as it stands."""
    title = F.coalesce(F.nullif("text", F.lit("")), F.nullif("title", F.lit("")), F.lit(""))
    around = F.concat(title, F.lit(" "), F.left(F.coalesce("parent_text", F.lit("")), F.lit(200)))
    kept = links.filter(urls.is_document_href(F.col("href")) | matches(around))
    return kept.withColumn("file_type", urls.file_type_href(F.col("href"))).withColumn("published_at", dates.raw_date(around))


def frontier_links(links: DataFrame, k: int = 5, matches=titles.matches_report) -> DataFrame:
    """Up to k new pages to follow from each page, in page order: links has page_id, page_url, pos, href, url, text."""
    domain = urls.url_domain(F.col("url"))
    path = urls.url_path(F.col("url"))
    text = strip(F.coalesce("text", F.lit("")))
    own = (domain == "") | (domain == urls.url_domain(F.col("page_url")))
    skip = F.col("href").startswith("#") | F.col("href").startswith("javascript:") | urls.is_document_href(F.col("href")) | titles.contains_any(path, STATIC)
    wanted = matches(text) | matches(F.col("url")) | ((F.length(text) >= 4) & titles.contains_any(text, NOTICE_WORDS))
    once = Window.partitionBy("page_id", "url").orderBy("pos")
    first = links.filter(own & ~skip & wanted).withColumn("_n", F.row_number().over(once)).filter("_n = 1").drop("_n")
    return top_k_per_group(first, "page_id", ["pos"], k)


def top_k_per_group(df: DataFrame, group, order: list, k: int) -> DataFrame:
    w = Window.partitionBy(*([group] if isinstance(group, str) else group)).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= k).drop("_rank")


def exclude_domains(df: DataFrame, url: str, domains=EXCLUDED_DOMAINS) -> DataFrame:
    """Rows whose URL contains none of the domains, anywhere in it."""
    return df.filter(~titles.contains_any(F.col(url), domains))
