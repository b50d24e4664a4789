"""Registered queries over varied literals: each row of a table is given one of the cases, and SQL holds the results worked out by hand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.functions import dates, texts, titles, urls, web
from verdigris.operators import aggregates, entities, filters, pages
from verdigris.plans.documents import run_pipeline
from verdigris.session import table
from verdigris.sources import registry

Register = dict[str, tuple]
_found: Register = {}


def _sql(v) -> str:
    if v is None:
        return "null"
    return str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int | float) else "'" + v.replace("'", "''") + "'"


def cases(spark: SparkSession, sf_dir: str, name: str, key: str, columns: str, rows: list[tuple]) -> DataFrame:
    """key of each row of a table with the columns of the case that the key's remainder picks."""
    kinds = [c.split() for c in columns.split(", ")]
    each = F.array(*[F.struct(*[F.lit(v).cast(t).alias(n) for v, (n, t) in zip(r, kinds, strict=True)]) for r in rows])
    return table(spark, sf_dir, name).select(key, F.get(each, (F.col(key) % len(rows)).cast("int")).alias("_c")).select(key, "_c.*")


def expected(name: str, key: str, columns: str, rows: list[tuple | None]) -> str:
    """SQL for the results of the cases; None is a case without a result, a list one with several rows."""
    values = [(i, *r) for i, case in enumerate(rows) for r in (case if isinstance(case, list) else [case] if case is not None else [])]
    body = ", ".join("(" + ", ".join(map(_sql, v)) + ")" for v in values)
    return f"select {key}, c.* exclude (_i) from {name} join (values {body}) c(_i, {columns}) on {key} % {len(rows)} = _i"


def case_query(name: str, key: str, inputs: str, outputs: str, pairs: list[tuple]):
    """Register f(df) over the cases: pairs of inputs and the outputs by hand."""

    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(cases(spark, sf_dir, name, key, inputs, [a for a, _ in pairs])).select(key, *outputs.split(", "))

        run.__name__ = f.__name__
        _found[f.__name__] = (run, expected(name, key, outputs, [b for _, b in pairs]))
        return f

    return register


def registered() -> Register:
    return _found


def _text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


@case_query("pages", "page_id", "url string, title string, content_type string", "strict, loose, inferred, by_type", [
    (("http://h.org/a.PDF?x=1#f", "t", "application/pdf; q=1"), ("pdf", "html", "pdf", "pdf")),
    (("http://h.org/p/b.docx", "t", "application/msword"), ("docx", "docx", "docx", "docx")),
    (("http://h.org/c.xlsx", None, None), ("xlsx", "xlsx", "xlsx", "xlsx")),
    (("http://h.org/d.html", "年报 PDF", "text/html"), (None, "html", "pdf", "bin")),
    (("http://h.org/e", "a DOCX", "x/wordperfect"), (None, "html", "doc", "docx")),
    (("http://h.org/", "plain", None), (None, "html", "html", "bin")),
    (("http://h.org/f.ppt", "t", ""), ("ppt", "ppt", "html", "ppt")),
])
def file_types(df):
    u = F.col("url")
    return df.select("page_id", urls.file_type_from_url(u).alias("strict"), urls.file_type_href(u).alias("loose"), urls.infer_file_type(F.col("title"), u).alias("inferred"), urls.file_type_from_content_type(F.col("content_type"), u).alias("by_type"))


@case_query("documents", "doc_id", "t string", "as_written, valid, mixed", [
    (("于2024年5月6日发布",), ("2024-05-06", "2024-05-06 00:00:00", None)),
    (("2024/2/3",), ("2024-02-03", "2024-02-03 00:00:00", "2024-02-03 00:00:00")),
    (("2024-13-40 and 20240506",), ("2024-13-40", "2024-05-06 00:00:00", None)),
    (("x20240230",), (None, None, None)),
    ((" 2024-05-06 12:30 ",), ("2024-05-06", "2024-05-06 00:00:00", "2024-05-06 12:30:00")),
    (("2024-05-06T01:02:03",), ("2024-05-06", "2024-05-06 00:00:00", "2024-05-06 01:02:03")),
    (("1714953600000",), (None, None, "2024-05-06 00:00:00")),
    (("2024年05月06日起",), ("2024-05-06", "2024-05-06 00:00:00", "2024-05-06 00:00:00")),
    (("none",), (None, None, None)),
    ((None,), (None, None, None)),
])
def found_dates(df):
    t = F.col("t")
    return df.select("doc_id", dates.extract_date(t).alias("as_written"), _text(dates.extract_date_valid(t)).alias("valid"), _text(dates.parse_mixed_ts(t)).alias("mixed"))


@case_query("pages", "page_id", "base string, href string", "url, domain, section", [
    (("https://www.mee.gov.cn/hjzl/a/", "../b.html"), ("https://www.mee.gov.cn/hjzl/b.html", "www.mee.gov.cn", "hjzl")),
    (("https://www.mee.gov.cn/ywdt/xwfb/x", "y?q=1#f"), ("https://www.mee.gov.cn/ywdt/xwfb/y?q=1#f", "www.mee.gov.cn", "xwfb")),
    (("http://h.org:80/p/q", "//o.net/z"), ("http://o.net/z", "o.net", "unknown")),
    (("http://h.org/p/q?o=1", "?n=2"), ("http://h.org/p/q?n=2", "h.org", "unknown")),
    (("http://h.org/p", "https://www.mee.gov.cn/ywgz/zcwj/1"), ("https://www.mee.gov.cn/ywgz/zcwj/1", "www.mee.gov.cn", "zcwj")),
])
def resolved_urls(df):
    u = urls.resolve_url(F.col("base"), F.col("href"))
    return df.select("page_id", u.alias("url"), urls.url_domain(u).alias("domain"), urls.section_of(u).alias("section"))


@case_query("documents", "doc_id", "t string", "env, cycle, half_first, named, enterprise", [
    (("广东测试有限公司环境影响报告书",), (True, "other", "other", True, "广东测试有限公司")),
    (("2023年年度报告",), (False, "annual_report", "annual_report", False, "")),
    (("某集团半年度报告",), (False, "annual_report", "half_year_report", True, "")),
    (("中报",), (False, "half_year_report", "half_year_report", False, "")),
    (("第一季度 EIA",), (True, "quarterly_report", "quarterly_report", False, "")),
    (("esg of 甲乙（深圳）股份有限公司",), (False, "esg_report", "esg_report", True, "甲乙（深圳）股份有限公司")),
    (("招股书",), (False, "prospectus", "prospectus", False, "")),
    (("公司",), (False, "other", "other", False, "")),
    (("plain title",), (False, "other", "other", False, "")),
])
def report_titles(df):
    t = F.col("t")
    return df.select("doc_id", titles.is_env_report(t).alias("env"), titles.classify_report_cycle(t).alias("cycle"), titles.classify_report_cycle(t, True).alias("half_first"), titles.is_enterprise_name(t).alias("named"), titles.extract_enterprise(t).alias("enterprise"))


@case_query("events", "event_id", "forwarded string, host string, agent string", "ip, bot, reason", [
    ((" 1.2.3.4 , 5.6.7.8", "h", "python-requests/2.1"), ("1.2.3.4", "python-requests", "UA matches bot pattern: python-requests")),
    (("", "9.9.9.9", "Mozilla HeadlessChrome/1"), ("9.9.9.9", "headless", "UA matches bot pattern: headless")),
    ((None, "h", "Googlebot/2.1"), ("h", "bot", "UA matches bot pattern: bot")),
    ((None, None, "Mozilla/5.0 Firefox"), ("unknown", None, None)),
    (("7.7.7.7", None, "robotics"), ("7.7.7.7", None, None)),
    (("8.8.8.8", "h", None), ("8.8.8.8", None, None)),
    (("8.8.4.4", "h", ""), ("8.8.4.4", None, None)),
])
def request_clients(df):
    a = F.col("agent")
    return df.select("event_id", web.client_ip(F.col("forwarded"), F.col("host")).alias("ip"), web.bot_pattern(a).alias("bot"), web.bot_reason(a).alias("reason"))


@case_query("pages", "page_id", "name string, body string, declared string", "mime, status, strict, accepted", [
    (("a.txt", "hello", "text/plain"), ("text/plain", "ok", "ok", True)),
    (("a.txt", "", "text/plain"), ("text/plain", "empty_file", "empty_file", True)),
    (("a.bin", "%PDF-1.4", None), ("application/pdf", "ok", "ok", False)),
    (("a.exe", "MZ..", None), ("application/x-msdownload", "mime_not_allowed", "mime_not_allowed", False)),
    (("x.html", "<script>1</script>", None), ("text/html", "malicious_content", "malicious_content", False)),
    (("x.txt", "1 union  select 2", "Text/Plain; charset=x"), ("text/plain", "malicious_content", "malicious_content", True)),
    (("a.PDF", "abc", "text/plain"), ("text/plain", "ok", "extension_mismatch", True)),
    (("z.zip", "x" * 500, None), ("application/zip", "size_exceeded", "size_exceeded", True)),
    (("noext", "data", None), ("application/octet-stream", "mime_not_allowed", "mime_not_allowed", False)),
])
def uploads(df):
    c = F.encode("body", "UTF-8")
    v, s = (web.validate_upload(F.col("name"), c, F.col("declared"), max_bytes=400, strict_extension=x) for x in (False, True))
    return df.select("page_id", v["mime"].alias("mime"), v["status"].alias("status"), s["status"].alias("strict"), web.upload_allowed(F.col("name")).alias("accepted"))


@case_query("documents", "doc_id", "raw string, name string", "text, file", [
    (("E4B8ADE69687", "报告 (1).pdf"), ("中文", "id_报告 1.pdf")),
    (("D6D0CEC4", "a/b"), ("中文", "id_ab.pdf")),
    (("616263", "x.docx"), ("abc", "id_x.docx")),
    (("", "?.zip"), ("", "id_.zip")),
    ((None, "n"), (None, "id_n.pdf")),
])
def decoded_files(df):
    return df.select("doc_id", texts.decode_text(F.unhex("raw")).alias("text"), urls.clean_filename(F.lit("id"), F.col("name")).alias("file"))


@case_query("pages", "page_id", "t string", "company, contact_person, phone, email", [
    (("建设单位：某公司\n联系人: 张三 \n联系电话：\n邮箱：a@b.cn",), ("某公司", "张三", "邮箱：a@b.cn", "a@b.cn")),
    (("联系电话: 0755-1\n建设单位:乙",), ("乙", None, "0755-1", None)),
    (("no labels",), (None, None, None, None)),
])
def labelled_cases(df):
    return df.select("page_id", *texts.labelled_fields(F.col("t")))


_ROW = '<tr><td><a href="/gs/detail/1?id={i}">i</a></td><td><a class="f_title">{t}</a><em>[{e}]</em><div class="fct_att">附件 {n}</div><div class="fcb-location">{l}</div></td><td><span class="f_time">2024-01-02</span></td><td><span>{a}</span><span>{b}</span></td><td><a class="f_peo">{p}</a></td></tr>'


@case_query("pages", "page_id", "url string, html string", "publish_id, detail_url, title, category_tag, attachment_count, location, download_count, author", [
    (("http://h/a/", "<table><tr><td class=\"table_title\">x</td><td/><td/><td/><td/></tr>" + _ROW.format(i="21010yz", t="某项目", e="一次", n=3, l="广州", a=5, b=6, p="张") + "</table>"), ("21010yz", "http://h/gs/detail/1?id=21010yz", "某项目", "一次", 3, "广州", "5", "张")),
    (("http://k/", _ROW.format(i="a1", t="x &amp; y", e="t", n="", l="", a=1, b=2, p="")), ("a1", "http://k/gs/detail/1?id=a1", "x & y", "t", 0, "", "1", "")),
    (("http://k/", "<tr><td>only</td><td>two</td></tr>"), None),
])
def listings(df):
    return pages.listing_rows(df.select("page_id", F.col("url"), F.col("html")), keep=("page_id",))


@case_query("pages", "page_id", "html string", "project_name, company, contact_person, detail_title", [
    (('<ul><li><div class="project_li_l">项目名称</div><div class="project_li_r">甲</div></li></ul><div id="contentContainer">建设单位：乙公司<br>联系人：丙</div><span class="box_tit">题</span>',), ("甲", "乙公司", "丙", "题")),
    (('<div class="x detail_main y">联系人：丁</div>',), (None, None, "丁", None)),
    (("",), (None, None, None, None)),
])
def details(df):
    return pages.detail_fields(df)


@case_query("pages", "page_id", "html string", "pos, attachment_id", [
    (('<a class="down-publish-att" data-id="7">f</a><a class="x down-publish-att" data-attachment-id="8">g</a>',), [(0, "7"), (1, "8")]),
    (('<b data-attachment-id="q">f</b>',), (0, "q")),
    (("<script>var attachmentId = '" + "a" * 32 + "'</script>",), (0, "a" * 32)),
    (("nothing",), None),
])
def attachments(df):
    return pages.attachment_ids(df)


@case_query("pages", "page_id", "url string, html string", "url, title, published_at, file_type, report_cycle", [
    (("http://h/l", '<tr><td>1</td><td><a href="/a.pdf">2023年年度报告</a></td><td>2024-03-01</td></tr><tr><td><a href="javascript:x">n</a></td></tr><tr><td><a href="/b"> </a></td></tr>'), ("http://h/a.pdf", "2023年年度报告", "2024-03-01", "pdf", "annual_report")),
    (("http://h/l/", '<tr><td><a href="c">社会责任</a></td></tr><tr><td><a href="d.docx">x</a></td><td>y</td></tr>'), [("http://h/l/c", "社会责任", "社会责任", None, "esg_report"), ("http://h/l/d.docx", "x", "y", "docx", "other")]),
    (("http://h/l", "<p>none</p>"), None),
])
def announcements(df):
    return pages.announcement_rows(df, keep=("page_id",))


_LIST = '<ul><li>2024-05-06<a href="/x.pdf">下载</a></li><li><a href="y.html">环评公示</a> 2023年1月2日</li><li><a href="z.html">other</a></li></ul>'


@case_query("pages", "page_id", "url string, html string", "url, title, parent_text, file_type, published_at", [
    (("http://h/d/", _LIST), [("http://h/x.pdf", "下载", "2024-05-06下载", "pdf", "2024-05-06"), ("http://h/d/y.html", "环评公示", "环评公示2023年1月2日", "html", "2023年1月2日")]),
    (("http://h/", '<p>验收监测 <b>x</b><a href="q" title="T"> </a></p><div><a href="w">plain</a></div>'), ("http://h/q", "T", "验收监测x", "html", None)),
    (("http://h/", "<p>no links</p>"), None),
])
def selected_links(df):
    return filters.select_links(pages.links_with_parents(df)).withColumn("title", F.col("text"))


@case_query("pages", "page_id", "url string, html string", "n", [
    (("http://h/", _LIST), (1,)),
    (("http://h/", "<p>" + '<a href="a">环评</a>' * 3 + "</p>"), (3,)),
    (("http://h/", '<ul><li><a href="a">环评</a></ul><ol><li><a href="b">b</a></ol>'), None),
])
def list_page_cases(df):
    return pages.is_list_page(pages.links_with_parents(df)).withColumn("n", F.col("n").cast("int"))


@case_query("pages", "page_id", "url string, html string", "url, kind, published_at", [
    (("http://h/d/", _LIST), [("http://h/x.pdf", "item", "2024-05-06 00:00:00"), ("http://h/d/z.html", "detail", None)]),
    (("http://h/", '<p><a href="n.docx"></a> 20240102</p>'), ("http://h/n.docx", "item", "2024-01-02 00:00:00")),
])
def list_items(df):
    return pages.list_page_items(df, "2023-06-01").withColumn("published_at", _text(F.col("published_at")))


@case_query("pages", "page_id", "url string, html string", "url, file_type", [
    (("http://h/d/", _LIST), ("http://h/x.pdf", "pdf")),
    (("http://h/d/", '<a href="/f.doc?v=1">附件</a><a href="/f.doc?v=1">全文</a><a href="g">附件</a>'), ("http://h/f.doc?v=1", "doc")),
    (("http://h/d/", "<p>none</p>"), ("http://h/d/", "html")),
])
def detail_documents(df):
    return pages.document_links(df)


@case_query("documents", "doc_id", "a int, b int, c int, t string", "kept", [
    ((0, 5, 9, "T"), ("0,9",)),
    ((0, 6, 12, "T"), ("0,6,12",)),
    ((0, 3, 20, "T"), ("0,20",)),
    ((0, 5, 5, "U"), ("5",)),
])
def kept_entities(df):
    # Three mentions of one text of five characters; in case U the second has the best score.
    one = F.explode(F.array(*[F.struct(F.col(c).alias("start"), F.lit(s).alias("score")) for c, s in (("a", 0.5), ("b", 0.5), ("c", 0.5))])).alias("m")
    rows = df.select("doc_id", F.col("t").alias("type"), F.lit("abcde").alias("text"), one)
    better = F.when((F.col("type") == "U") & (F.col("m.start") == 5), 0.9).otherwise(F.col("m.score"))
    spans = rows.select("doc_id", "type", "text", F.col("m.start").alias("start"), (F.col("m.start") + 5).alias("end"), better.alias("score"))
    kept = entities.dedup_entities(spans, "doc_id")
    return kept.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list("start")), ",").alias("kept"))


@case_query("pages", "page_id", "payload string", "url, title, file_type, moment, cycle", [
    (('{"announcements": [], "data": [{"title": "中报", "url": "/a.pdf", "publishDate": "2024-05-06"}]}',), ("http://www.cninfo.com.cn/a.pdf", "中报", "pdf", "2024-05-06 00:00:00", "half_year_report")),
    (('{"classifiedAnnouncements": [{"announcementTitle": "年报", "adjunctUrl": "x.docx", "announcementTime": "1714953600000"}]}',), ("http://www.cninfo.com.cn/x.docx", "年报", "docx", "2024-05-06 00:00:00", "annual_report")),
    (("{}",), None),
])
def flattened(df):
    rows = registry.flatten_announcements(df, keep=("page_id",))
    return rows.select("page_id", "url", "title", "file_type", _text(F.col("published_at")).alias("moment"), F.col("raw_meta")["report_cycle"].alias("cycle"))


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third document has no text, every fourth a parse error; those end in the first stage."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 3 != 0, F.col("text")).alias("text"), F.when(F.col("doc_id") % 4 == 0, "broken").alias("why"))
    done = run_pipeline(d, "doc_id", stages=("parse", "sanitize"), error="why")
    return aggregates.batch_outcome(done)


_found["outcomes"] = (outcomes, "select count(*) filter (where doc_id % 3 <> 0 and doc_id % 4 <> 0) as ok, count(*) filter (where doc_id % 3 = 0 or doc_id % 4 = 0) as failed from documents")


def run_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as crawled items; those with an even id are indexed, those of every fifth id failed."""
    p = table(spark, sf_dir, "pages").select("page_id", urls.url_domain(F.col("url")).alias("domain"))
    return aggregates.crawl_counters(p.filter("page_id % 3 != 0"), p.filter("page_id % 3 = 0"), "domain", F.col("page_id") % 2 == 0, F.col("page_id") % 5 == 0)


_found["run_counters"] = (run_counters, "with n as (select page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) d from pages), i as (select page_id, d, row_number() over (partition by d) k, d in (select d from n where page_id % 3 = 0) there from n where page_id % 3 <> 0) select count(*) as fetched, count(*) filter (where k > 1 or there) as duplicate, count(*) filter (where k = 1 and not there) as inserted, count(*) filter (where page_id % 2 = 0) as indexed, count(*) filter (where page_id % 5 = 0) as errors from i")


def seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queued URLs for the sites of all suppliers."""
    sites = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("https://s"), "s_suppkey", F.lit(".org/x/")).alias("url"))
    return registry.seed_urls(sites, ("/a/", "b"), "site").select("s_suppkey", "url", "type", "status")


_found["seeds"] = (seeds, "select s_suppkey, 'https://s' || s_suppkey || '.org' || p as url, 'site' as type, 'queued' as status from supplier, (values ('/a/'), ('/x/b')) v(p)")


def page_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the user's MIME rules say of each page under a name that depends on it."""
    name = F.concat(F.lit("p."), F.get(F.array(*map(F.lit, ("html", "json", "none", "PNG"))), (F.col("page_id") % 4).cast("int")))
    return table(spark, sf_dir, "pages").select("page_id", web.resolve_mime(name, F.encode("html", "UTF-8"), F.when(F.col("page_id") % 8 == 0, " Text/XML ;q")).alias("mime"))


_found["page_types"] = (page_types, "select page_id, case when page_id % 8 = 0 then 'text/xml' when page_id % 4 = 0 then 'text/html' when page_id % 4 = 1 then 'application/json' when page_id % 4 = 3 then 'image/png' else 'application/octet-stream' end as mime from pages")
