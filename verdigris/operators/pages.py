"""Tables from crawled pages: links, text, listing and detail fields, attachments, announcements."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdigris.functions import batches, dates, texts, titles, urls
from verdigris.functions.segments import each
from verdigris.functions.texts import strip
from verdigris.operators import elements as el
from verdigris.operators.filters import incremental_cutoff

# Labels of the detail list, hints of document links, and character references that pages use.
DETAIL_LABELS = {"project_name": "项目名称", "report_type": "报告类型", "industry": "行业分类", "location_detail": "项目位置", "project_nature": "项目性质", "status_detail": "公示状态", "valid_period": "公示有效期"}
DOCUMENT_HINTS = ("pdf", "下载", "附件", "全文", "download", "doc")
REFERENCES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&amp;": "&"}
_A = r"(?is)<a\b([^>]*)>(.*?)</a>"


def plain(html: Column) -> Column:
    """Tags off, references decoded, trimmed."""
    t = F.regexp_replace(html, r"(?s)<[^>]*>", "")
    for k, v in REFERENCES.items():
        t = F.replace(t, F.lit(k), F.lit(v))
    return strip(t)


def attribute(tag: Column, name: str) -> Column:
    """An attribute's value, null if the tag hasn't it."""
    return F.nullif(F.regexp_extract(tag, rf"(?is)(?:^|\s){re.escape(name)}\s*=\s*[\"']?([^\"'>]*)", 1), F.lit(""))


def extract_links(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """key, page_url, pos, href, url (resolved), text, title, of every anchor with an href, in page order."""
    body = F.regexp_replace(F.col(html), r"(?s)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>", "")
    found = each(pages, [F.col(key), F.col(url).alias("page_url")], F.regexp_extract_all(body, F.lit(_A), F.lit(0)), "_a", "pos")
    tag = F.regexp_extract("_a", _A, 1)
    rows = found.select(key, "page_url", "pos", strip(attribute(tag, "href")).alias("href"), plain(F.regexp_extract("_a", _A, 2)).alias("text"), attribute(tag, "title").alias("title"))
    return rows.filter("href is not null").select(key, "page_url", "pos", "href", urls.resolve_url(F.col("page_url"), F.col("href")).alias("url"), F.coalesce(F.nullif("text", F.lit("")), "title", F.lit("")).alias("text"), "title")


class _Anchors(HTMLParser):
    """The anchors of a page with their own and their parents' text, stripped text nodes put together, and the links of the largest list around each."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.texts: list[str] = []
        self.anchors: list[dict] = []
        self.open: list[dict] = [{"tag": "", "at": 0, "inside": [], "links": 0, "anchor": None}]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in el.VOID:
            return
        while self.open[-1]["tag"] in el.ENDS.get(tag, ()):
            self._close()
        anchor, has = None, dict(attrs)
        if tag == "a" and has.get("href"):
            lists = [f for f in self.open if f["tag"] in ("ul", "ol")]
            for f in lists:
                f["links"] += 1
            anchor = {"href": has["href"].strip(), "title": has.get("title"), "lists": lists}
            self.anchors.append(anchor)
            self.open[-1]["inside"].append(anchor)
        self.open.append({"tag": tag, "at": len(self.texts), "inside": [], "links": 0, "anchor": anchor})

    def handle_endtag(self, tag: str) -> None:
        if any(f["tag"] == tag for f in self.open[1:]):
            while self.open[-1]["tag"] != tag:
                self._close()
            self._close()

    def handle_data(self, data: str) -> None:
        if self.open[-1]["tag"] not in ("script", "style") and data.strip():
            self.texts.append(data.strip())

    def _close(self) -> None:
        f = self.open.pop()
        own = "".join(self.texts[f["at"] :])
        if f["anchor"] is not None:
            f["anchor"]["text"] = own
        for a in f["inside"]:
            a["parent_text"] = own[:200]

    def close(self) -> None:
        super().close()
        while self.open:
            self._close()


def links_with_parents(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """extract_links with parent_text (the first 200 characters of the element around the anchor) and list_links (links of the
    largest list around it, 0 outside lists). Nested elements aren't regular, so a parser reads each page in its task."""
    link = "struct<pos:int,href:string,text:string,title:string,parent_text:string,list_links:int>"
    kind = batches.arrow_type(f"array<{link}>")

    def make(htmls: list) -> list[pa.Array]:
        out = []
        for h in htmls:
            p = _Anchors()
            p.feed(h or "")
            p.close()
            out.append([{"pos": i, "href": a["href"], "text": a["text"], "title": a["title"], "parent_text": a["parent_text"], "list_links": max((f["links"] for f in a["lists"]), default=0)} for i, a in enumerate(p.anchors)])
        return [pa.array(out, kind)]

    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("page_url"), F.col(html).alias("html"))
    found = batches.mapped(rows, "html", ["key", "page_url"], {"_links": f"array<{link}>"}, make)
    found = found.select("key", "page_url", F.inline("_links"))
    text = F.coalesce(F.nullif("text", F.lit("")), "title", F.lit("")).alias("text")
    return found.select(F.col("key").alias(key), "page_url", "pos", "href", urls.resolve_url(F.col("page_url"), F.col("href")).alias("url"), text, "title", "parent_text", "list_links")


def html_to_text(html: Column, keep_cdata: bool = True) -> Column:
    """Non-empty text nodes, trimmed, a line each. Bodies of script and style are kept unless keep_cdata is off."""
    raw = r"(?is)<(script|style)\b[^>]*>(.*?)</\1>"
    t = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    if keep_cdata:
        # Protect markup inside raw text while tags are split off.
        parts = F.split(t, r"(?is)(?=<(?:script|style)\b)|(?<=</script>)|(?<=</style>)")
        nodes = F.flatten(F.transform(parts, lambda p: F.when(p.rlike(raw), F.array(F.regexp_extract(p, raw, 2))).otherwise(F.transform(F.split(p, r"(?s)<[^>]*>"), plain))))
    else:
        nodes = F.transform(F.split(F.regexp_replace(t, raw, ""), r"(?s)<[^>]*>"), plain)
    return F.array_join(F.filter(F.transform(nodes, strip), lambda x: x != ""), "\n")


def is_list_page(links: DataFrame, key: str = "page_id", least: int = 3, matches=titles.matches_report) -> DataFrame:
    """Pages with `least` or more links about reports or, if links has list_links, a list with so many links: key, n (links about reports)."""
    listed = F.max("list_links") if "list_links" in links.columns else F.lit(0)
    counts = links.groupBy(key).agg(F.count_if(matches(F.col("text"))).alias("n"), listed.alias("_l"))
    return counts.filter((F.col("n") >= least) | (F.col("_l") >= least)).drop("_l")


def listing_rows(pages: DataFrame, url: str = "url", html: str = "html", keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows of listing tables with five cells or more and a link with an id: columns to keep and twelve others. A row's cells are its own: those
    of a table within a cell are that table's rows'."""
    tree = el.with_tree(pages, html, tuple(dict.fromkeys((*keep, url)))).select(*keep, F.col(url).alias("_u"), "nodes", "texts")
    rows = each(tree, [*keep, "_u", "nodes", "texts"], el.all_such("nodes", el.such("tr")), "_r")
    inner_rows = el.all_such(el.within(F.col("_r")), el.such("tr"))
    own = rows.withColumn("_inner", inner_rows).withColumn("_c", F.filter(el.within(F.col("_r")), lambda n: n["tag"].isin("td", "th") & ~F.exists("_inner", lambda r: (r["id"] < n["id"]) & (n["id"] < r["end"]))))
    cells = own.withColumn("_c", F.filter("_c", lambda n: n["tag"] == "td")).filter((F.size("_c") >= 5) & ~F.array_contains(F.get("_c", F.lit(0))["classes"], "table_title"))
    c = [el.within(F.get("_c", F.lit(i))) for i in range(5)]

    def found(cell: int, tag: str, klass: str | None = None) -> Column:
        return F.coalesce(el.text(el.first_such(c[cell], el.such(tag, klass))), F.lit(""))

    href = F.coalesce(el.value(F.get(F.filter(c[0], lambda n: (n["tag"] == "a") & F.map_contains_key(n["attrs"], "href")), F.lit(0)), "href"), F.lit(""))
    spans = el.all_such(c[3], el.such("span"))
    two = F.size(spans) >= 2
    bottom = el.first_such(c[1], el.such("div", "f_common_bottom"))
    # Some listings have no block around location and status.
    where = F.when(bottom.isNotNull(), el.within(bottom)).otherwise(c[1])
    out = cells.select(
        *keep, F.regexp_extract(href, r"id=([\w]+)", 1).alias("publish_id"), urls.resolve_url(F.col("_u"), href).alias("detail_url"), found(1, "a", "f_title").alias("title"),
        F.regexp_replace(found(1, "em"), r"^[\[\]]+|[\[\]]+$", "").alias("category_tag"), F.coalesce(F.regexp_extract(found(1, "div", "fct_att"), r"(\d+)", 1).try_cast("int"), F.lit(0)).alias("attachment_count"),
        F.coalesce(el.text(el.first_such(where, el.such("div", "fcb-location"))), F.lit("")).alias("location"), F.coalesce(el.text(el.first_such(where, el.such("span", "gsz"))), F.lit("")).alias("status"),
        found(2, "span", "f_time").alias("reply_time"), F.when(two, el.text(F.get(spans, F.lit(0)))).otherwise("0").alias("download_count"), F.when(two, el.text(F.get(spans, F.lit(1)))).otherwise("0").alias("view_count"),
        found(4, "a", "f_peo").alias("author"), found(4, "span", "f_time").alias("publish_time"),
    )
    return out.filter("publish_id != ''")


def detail_fields(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, the labelled list values, the fields of the content block, detail_title, post_author and post_time (null where they are missing), and
    attachments, array<struct<attachment_id,name,size>>."""
    step = el.with_tree(pages, html, (key,))
    items = F.transform(el.all_such("nodes", el.such("li")), lambda n: F.struct(
        el.text(el.first_such(el.within(n), el.such("div", "project_li_l"))).alias("label"), el.text(el.first_such(el.within(n), el.such("div", "project_li_r"))).alias("value")))
    content = F.coalesce(el.first_such("nodes", el.such("div", id="contentContainer")), el.first_such("nodes", el.such("div", "detail_main")), el.first_such("nodes", el.such("div", "detail_text")))
    step = step.withColumns({"_items": items, "_content": content, "_fj": el.first_such("nodes", el.such("div", "detail_fj")), "_top": el.first_such("nodes", el.such("div", "top_details"))})

    def item(label: str) -> Column:
        of = F.filter("_items", lambda i: (i["label"] == label) & i["value"].isNotNull())
        return F.nullif(F.get(of, F.size(of) - 1)["value"], F.lit(""))  # of several the last, as a later one is put over it

    def attachment(a: Column) -> Column:
        beside = F.get(F.filter("nodes", lambda n: (n["tag"] == "span") & (n["parent"] == a["parent"]) & (n["id"] >= a["end"])), F.lit(0))
        return F.struct(F.coalesce(el.value(a, "data"), F.lit("")).alias("attachment_id"), el.text(a).alias("name"), F.coalesce(el.text(beside), F.lit("")).alias("size"))

    links = F.when(F.col("_fj").isNotNull(), el.all_such(el.within(F.col("_fj")), el.such("a", "down-publish-att")))
    kind = "array<struct<attachment_id:string,name:string,size:string>>"
    posted = el.text(F.col("_top"))
    out = step.select(
        key, *[item(label).alias(n) for n, label in DETAIL_LABELS.items()], el.text(F.col("_content"), "\n").alias("description"), F.nullif(el.text(el.first_such("nodes", el.such("span", "box_tit"))), F.lit("")).alias("detail_title"),
        F.coalesce(F.transform(links, attachment), F.array().cast(kind)).alias("attachments"),
        F.nullif(strip(F.regexp_extract(posted, r"^(.+?)发表于", 1)), F.lit("")).alias("post_author"), F.nullif(strip(F.regexp_extract(posted, r"发表于\s*([0-9\-:\s]+)", 1)), F.lit("")).alias("post_time"),
    )
    own = [c.alias(f"{n}_from_content" if n == "project_name" else n) for n, c in zip(texts.FIELD_LABELS, texts.labelled_fields(F.col("description")), strict=True)]
    return out.select("*", *own)


def attachment_ids(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, pos, attachment_id: from download elements, else elements with a data attribute, else ids in scripts."""
    h = F.col(html)
    tags = F.regexp_extract_all(h, F.lit(r"(?is)<[a-z]+\b[^>]*class\s*=\s*\"[^\"]*down-publish-att[^>]*>"), F.lit(0))
    by_class = F.filter(F.transform(tags, lambda t: F.coalesce(attribute(t, "data-attachment-id"), attribute(t, "data-id"))), lambda x: x.isNotNull())
    by_data = F.regexp_extract_all(h, F.lit(r"(?is)<[a-z]+\b[^>]*data-attachment-id\s*=\s*[\"']([^\"']+)"), F.lit(1))
    by_script = F.regexp_extract_all(h, F.lit(r"[\"']?attachment(?:Id|id)?[\"']?\s*[:=]\s*[\"']([a-f0-9]{32})[\"']"), F.lit(1))
    ids = F.when(F.size(by_class) > 0, by_class).when(F.size(by_data) > 0, by_data).otherwise(by_script)
    return each(pages, [key], ids, "attachment_id", "pos")


def document_links(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """key, url, file_type of the documents a page links to, each once; a page without any gives itself as 'html'."""
    links = extract_links(pages, key, url, html)
    hinted = titles.contains_any(F.lower(F.concat_ws(" ", "text", "title")), DOCUMENT_HINTS)
    docs = links.filter(urls.is_document_href(F.col("href")) | (hinted & urls.file_type_from_url(F.col("url")).isNotNull()))
    once = docs.groupBy(key, "url").agg(F.min("pos").alias("_p")).select(key, "url", F.coalesce(urls.file_type_from_url(F.col("url")), urls.file_type_href(F.col("url"))).alias("file_type"))
    rest = pages.select(key, F.col(url).alias("url")).join(once.select(key).distinct(), key, "left_anti").select(key, "url", F.lit("html").alias("file_type"))
    return once.unionByName(rest)


def list_page_items(pages: DataFrame, cutoff=None, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """key, url, title, file_type, published_at, kind: direct documents as 'item', other links as 'detail', older than the
    cutoff left out; dates are sought in the link's and then its parent's text."""
    links = links_with_parents(pages, key, url, html)
    title = F.coalesce(F.nullif("text", F.lit("")), F.lit("Untitled Document"))
    kind = F.when(urls.is_document_href(F.col("href")), "item").otherwise("detail")
    rows = links.select(key, "url", title.alias("title"), urls.file_type_from_url(F.col("url")).alias("file_type"), dates.extract_date_valid(F.concat("text", "parent_text")).alias("published_at"), kind.alias("kind"))
    return incremental_cutoff(rows, "published_at", cutoff)


def announcement_rows(pages: DataFrame, url: str = "url", html: str = "html", keep: tuple[str, ...] = ()) -> DataFrame:
    """Announcements of table rows: columns to keep, url, title, published_at (text), file_type, report_cycle; navigation links and blank titles are skipped."""
    rows = each(pages, [*keep, F.col(url).alias("_u")], F.regexp_extract_all(F.col(html), F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), F.lit(1)), "_r")
    a = rows.withColumn("href", attribute(F.regexp_extract("_r", _A, 1), "href")).withColumn("title", plain(F.regexp_extract("_r", _A, 2)))
    fine = F.col("href").isNotNull() & ~titles.contains_any(F.col("href"), ("javascript", "#", "logout", "login")) & (F.col("title") != "")
    last = plain(F.element_at(F.regexp_extract_all("_r", F.lit(r"(?is)<td\b[^>]*>(.*?)</td>"), F.lit(1)), -1))
    kind = urls.infer_file_type(F.col("title"), F.col("href"))
    return a.filter(fine).select(*keep, urls.resolve_url(F.col("_u"), F.col("href")).alias("url"), "title", F.nullif(last, F.lit("")).alias("published_at"), F.nullif(kind, F.lit("html")).alias("file_type"), titles.classify_report_cycle(F.col("title")).alias("report_cycle"))


def first_links(links: DataFrame, key: str, k: int) -> DataFrame:
    w = Window.partitionBy(key).orderBy("pos")
    return links.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= k).drop("_n")
