"""Column functions on literal rows."""

from __future__ import annotations

from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from verdigris.functions import dates, segments, texts, titles, urls, web


def values(spark, column, *args):
    """column(col) for each literal."""
    return [r[0] for r in spark.createDataFrame([(i, a) for i, a in enumerate(args)], "i int, x string").orderBy("i").select(column(F.col("x"))).collect()]


def test_file_types(spark):
    assert values(spark, urls.file_type_from_url, "http://h/a.PDF?x=1", "http://h/a.html", "http://h/b.docx#f", "http://h/", None) == ["pdf", None, "docx", None, None]
    assert values(spark, urls.file_type_href, "a.pdf", "a.pdf?x", "b.XLSX") == ["pdf", "html", "xlsx"]
    rows = spark.createDataFrame([("年报 PDF", "http://h/x"), ("a DOCX", "http://h/x"), ("a", "http://h/x.docx"), ("a", "http://h/y.xlsx"), (None, "http://h/")], "t string, u string")
    assert [r[0] for r in rows.select(urls.infer_file_type(F.col("t"), F.col("u"))).collect()] == ["pdf", "doc", "docx", "xlsx", "html"]
    typed = spark.createDataFrame([("application/pdf", "u"), ("application/msword", "u"), (None, "http://h/a.xls"), ("x", "http://h/a")], "c string, u string")
    assert [r[0] for r in typed.select(urls.file_type_from_content_type(F.col("c"), F.col("u"))).collect()] == ["pdf", "docx", "xls", "bin"]


@pytest.mark.parametrize("href", ["/a/b.html", "c.html", "../d", "./e/../f", "?q=1", "#top", "//other.org/x", "http://z.org/", "", "../../../g", "mailto:a@b", "h/.", "h/.."])
def test_resolve_like_the_standard(spark, href):
    base = "https://h.org/p/q/r.html?old=1"
    assert values(spark, lambda c: urls.resolve_url(F.lit(base), c), href) == [urljoin(base, href)]


def test_sections_and_names(spark):
    assert values(spark, urls.section_of, "https://www.mee.gov.cn/hjzl/x", "https://x.org") == ["hjzl", "unknown"]
    assert values(spark, lambda c: urls.clean_filename(F.lit("id1"), c), "报告 (1).pdf", "a/b") == ["id1_报告 1.pdf", "id1_ab.pdf"]


def test_dates(spark):
    assert values(spark, dates.extract_date, "于2024年5月6日发布", "2024-13-40", "none") == ["2024-05-06", "2024-13-40", None]
    assert [str(v) for v in values(spark, dates.extract_date_valid, "2024/2/3", "2024-13-40 20240506", "x20240230", "none")] == ["2024-02-03 00:00:00", "2024-05-06 00:00:00", "None", "None"]
    got = values(spark, dates.parse_mixed_ts, " 2024-05-06 12:30 ", "2024-05-06", "2024-05-06T01:02:03", "2024年05月06日起", "1714953600000", "起2024年05月06日", "2024-02-31", "")
    assert [None if v is None else str(v) for v in got] == ["2024-05-06 12:30:00", "2024-05-06 00:00:00", "2024-05-06 01:02:03", "2024-05-06 00:00:00", "2024-05-06 00:00:00", None, None, None]


def test_titles(spark):
    assert values(spark, titles.is_env_report, "某项目环境影响报告书", "eia", "EIA") == [True, False, True]
    assert values(spark, titles.classify_report_cycle, "2023年年度报告", "半年度报告", "中报", "第一季度", "esg", "招股书", "x") == ["annual_report", "annual_report", "half_year_report", "quarterly_report", "esg_report", "prospectus", "other"]
    assert values(spark, lambda c: titles.classify_report_cycle(c, True), "半年度报告") == ["half_year_report"]
    assert values(spark, titles.is_enterprise_name, "广东某某公司", "公司", "ABCD公司x", "abcd") == [True, False, True, False]
    assert values(spark, titles.extract_enterprise, "关于广东测试（集团）有限公司环评公示", "无") == ["关于广东测试（集团）有限公司", ""]


def test_web(spark):
    agents = ("python-requests/2.1", "Mozilla HeadlessChrome/1", "Googlebot/2.1", "Mozilla/5.0 Firefox", "robotics", "", None)
    assert values(spark, web.bot_pattern, *agents) == ["python-requests", "headless", "bot", None, None, None, None]
    assert values(spark, lambda c: web.client_ip(c, F.lit("h")), " 1.2.3.4 , 5.6.7.8", "", None) == ["1.2.3.4", "h", "h"]
    rows = spark.createDataFrame(
        [("a.txt", b"hello", "text/plain"), ("a.txt", b"", "text/plain"), ("a.bin", b"\x89PNG1234", None), ("a.exe", b"MZ..", None), ("x.html", b"<script>1</script>", None), ("x.txt", b"1 union  select 2", "text/plain; charset=x"), ("x.txt", b"A" * 300, None), ("x", b"%PDF-1", None), ("a.pdf", b"12345678901", None)],
        "f string, c binary, t string",
    )
    got = [r[0]["status"] for r in rows.select(web.validate_upload(F.col("f"), F.col("c"), F.col("t"), max_bytes=400)).collect()]
    assert got == ["ok", "empty_file", "ok", "mime_not_allowed", "malicious_content", "malicious_content", "malicious_content", "ok", "ok"]
    assert rows.select(web.validate_upload(F.lit("a.pdf"), F.col("c"), F.lit("text/plain"), strict_extension=True)["status"]).first()[0] == "extension_mismatch"
    assert values(spark, web.upload_allowed, "a.PDF", "a.exe", "a") == [True, False, False]


def test_texts(spark):
    text = "建设单位：某公司\n联系人: 张三 \n联系电话：\n"
    got = spark.createDataFrame([(text,)], "t string").select(*texts.labelled_fields(F.col("t"))).first().asDict()
    assert got["company"] == "某公司" and got["contact_person"] == "张三" and got["email"] is None
    raw = spark.createDataFrame([("中文".encode(),), ("中文".encode("gbk"),)], "c binary")
    assert [r[0] for r in raw.select(texts.decode_text(F.col("c"))).collect()] == ["中文", "中文"]
    assert values(spark, lambda c: texts.highlight(c, ["x."], 5, 1), "aaaaabX.bbcx.cc") == [["b<em>X.</em>bb"]]
    chunks = texts.chunk_text(spark.createDataFrame([(1, "abcde  "), (2, "")], "i int, t string"), "t", 5)
    assert [tuple(r) for r in chunks.select("i", "offset", "chunk").collect()] == [(1, 0, "abcde")]


def test_matches_have_offsets(spark):
    import re

    text = "é1 " * 300 + "22 ß333"
    df = spark.createDataFrame([(text,), (None,), ("",)], "t string")
    got = segments.with_matches(df, "t", {"n": "[0-9]+"}, context=2).collect()
    assert [(m["start"], m["end"], m["match"]) for m in got[0]["n"]] == [(*m.span(), m.group()) for m in re.finditer("[0-9]+", text)]
    assert got[1]["n"] == [] and got[2]["n"] == []
