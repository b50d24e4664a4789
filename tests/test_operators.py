"""Operators on small fixtures whose results are worked out by hand."""

from __future__ import annotations

import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from verdigris.operators import elements as el
from verdigris.operators import aggregates, entities, filters, masking, pages, tables, textsearch, weblog
from verdigris.plans.documents import parse_files, run_pipeline
from verdigris.sources import office, registry

S = 1_000_000


def events(spark, rows):
    return spark.createDataFrame(rows, "client string, t double, id int").withColumn("ts", F.timestamp_micros((F.col("t") * S).cast("long")))


def test_velocity_window_is_closed(spark):
    e = events(spark, [("a", 89.999, 1), ("a", 90.0, 2), ("a", 100.0, 3), ("a", 100.0, 4)])
    assert [r.hits for r in weblog.velocity_count(e, "client", "ts", "id", 10 * S).orderBy("id").collect()] == [1, 2, 2, 3]


def test_null_and_empty_clients_are_two(spark):
    e = events(spark, [(None, 1.0, 1), ("", 2.0, 2), (None, 3.0, 3), ("", 4.0, 4)])
    assert weblog.velocity_block(e, "client", "ts", "id", 10 * S, 2, 60 * S).filter("blocked").count() == 0
    assert [r.hits for r in weblog.velocity_count(e, "client", "ts", "id", 10 * S).orderBy("id").collect()] == [1, 1, 2, 2]


def test_block_neither_records_nor_extends(spark):
    e = events(spark, [("a", float(i), i) for i in range(6)] + [("a", 30.0, 7), ("a", 64.9, 8), ("a", 65.0, 9), ("b", 1.0, 10)])
    got = {r.id: r.blocked for r in weblog.velocity_block(e, "client", "ts", "id", 10 * S, 5, 60 * S).collect()}
    assert [k for k, v in got.items() if v] == [5, 7, 8]


@pytest.mark.parametrize("route,limit", [("search", 50), ("download", 20), ("other", 100)])
def test_tiers_deny_the_next_hit(spark, route, limit):
    e = events(spark, [("a", 1 + i / 1000, i) for i in range(limit + 1)]).withColumn("route", F.lit(route + "/x"))
    got = weblog.rate_limit(e, "client", F.col("route"), "ts", "id").orderBy("id").collect()
    assert [r.allowed for r in got] == [True] * limit + [False]
    assert got[-1].retry_after >= 5 and got[0].retry_after is None


def test_rate_window_is_half_open(spark):
    e = events(spark, [("a", 0.0, 1), ("a", 60.0, 2), ("a", 60.5, 3)])
    assert [r.used for r in weblog.rate_limit(e, "client", F.lit("x"), "ts", "id").orderBy("id").collect()] == [1, 1, 2]
    none = weblog.rate_limit(e, "client", F.lit("x"), "ts", "id", (), ("none", 0, 60))
    assert none.filter("allowed").count() == 0


def test_admission_order(spark):
    e = events(spark, [("a", float(i), i) for i in range(8)]).withColumn("route", F.when(F.col("id") == 0, "health").otherwise("x"))
    got = weblog.admission(e, "client", F.col("route"), "ts", "id", F.col("id") == 1, F.col("route") == "health", {"window_us": 10 * S, "threshold": 4, "block_us": S}, (), ("d", 3, 60))
    assert [r.verdict for r in got.orderBy("id").collect()] == ["excluded", "bot", "allow", "allow", "allow", "rate", "velocity", "velocity"]


def test_circuit_breaker(spark):
    rows = [("d", 1, 1, True), ("d", 1, 2, False), ("d", 2, 3, False), ("d", 2, 4, False), ("d", 3, 5, True), ("e", 1, 1, False), ("e", 2, 2, True), ("e", 3, 3, False)]
    got = weblog.circuit_breaker(spark.createDataFrame(rows, "domain string, run int, seq int, ok boolean"), "domain", "run", "seq", F.col("ok")).orderBy("domain", "run").collect()
    assert [(r.trailing, r.carried, r.skipped) for r in got] == [(1, 1, False), (2, 3, False), (0, 0, True), (1, 1, False), (0, 0, False), (1, 1, False)]


def test_masks(spark):
    text = "电话 13812345678 或 0755-1234567，证件110101199003074519，卡 6222 0000 1111 2222，信 ab@c.com"
    df = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "+8613812345678")], "id int, text string")
    got = {r.id: r for r in masking.sanitize(df).collect()}
    assert got[1].sanitized == "电话138****5678 或 075****4567，证件110101********4519，卡 ****2222，信 a***@c.com"
    assert [m["category"] for m in got[1].masks] == ["phone", "phone", "id_card", "bank_card", "email"]
    assert got[2].sanitized == "" and got[3].masks == [] and got[4].sanitized == "861****5678"
    with pytest.raises(ValueError):
        masking.sanitize(df, "text", ["nope"])
    one = masking.mask_audit(df, "id", "text", ["email"]).collect()
    assert [(r.original, r.start, r.end - r.start, r.original_length) for r in one] == [("ab@c.com", text.index("ab@"), len("a***@c.com"), len(text))]


def test_dedup_entities_is_greedy(spark):
    rows = [(1, "T", "x", 0, 5, 0.9), (1, "T", "x", 5, 9, 0.9), (1, "T", "x", 9, 12, 0.9), (1, "T", "x", 20, 22, 0.1), (1, "U", "x", 0, 5, 0.5)]
    got = entities.dedup_entities(spark.createDataFrame(rows, "doc int, type string, text string, start int, end int, score double"), "doc")
    assert sorted((r.type, r.start) for r in got.collect()) == [("T", 0), ("T", 9), ("T", 20), ("U", 0)]


def test_bio_entities(spark):
    rows = [("张", "B-PER", 0.9, 0), ("三", "I-PER", 0.7, 1), ("在", "O", 0.9, 2), ("北", "B-LOC", 0.8, 3), ("##京", "O", 0.6, 4), ("x", "I-ORG", 0.5, 5), ("y", "B-MISC", 0.5, 6), ("z", "I-LOC", 0.5, 7)]
    df = spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], "doc int, pos int, word string, label string, score double, start int")
    got = entities.bio_entities(df, "doc").orderBy("start").collect()
    assert [(r.type, r.text, r.start, r.end, r.score) for r in got] == [("PERSON", "张三", 0, 2, 0.8), ("LOC", "北京x", 3, 6, 0.6333)]
    assert entities.bio_entities(df.filter("label = 'O'"), "doc").count() == 0


def test_rule_and_keyword_entities(spark):
    text = "2024年5月6日，广东省广州市天河区某公司，COD排放浓度达标，邮箱 a@b.cn，电话13812345678"
    df = spark.createDataFrame([(1, text), (2, " ")], "doc int, text string")
    got = entities.extract_entities(df, "doc").collect()
    kinds = {r.type for r in got}
    assert {"DATE", "ADDRESS", "CONTACT", "EMISSION"} <= kinds and {r.doc for r in got} == {1}
    assert all(text[r.start : r.end] == r.text for r in got)
    wide = entities.keyword_entities(df, "doc", keywords={"EMISSION": (0.85, ("排放浓度",))}, context=2).first()
    assert wide.text == "排放浓度达标"


def test_search(spark):
    docs = spark.createDataFrame([(1, "red fox jumps"), (2, "blue fox fox"), (3, "环评报告 fox"), (4, None)], "id int, text string")
    got = textsearch.fulltext_search(docs, "id", "环 red").orderBy(F.desc("score"), "id").collect()
    assert {r.id for r in got} == {1, 3} and got[0].total == 2 and "<em>" in got[0].highlights[0]
    assert textsearch.bm25(docs, "id", "!!").count() == 0
    assert [r.id for r in textsearch.similarity_topk("blue fox", docs, "id", k=2).collect()][0] == 2
    counts = textsearch.gram_counts(docs, "id")
    model = textsearch.tfidf_fit(counts, 3, 50)
    w = textsearch.tfidf_transform(counts, model, "id")
    norms = w.groupBy("id").agg(F.sum(F.col("weight") ** 2).alias("n")).collect()
    assert all(abs(r.n - 1) < 1e-9 for r in norms)
    assert textsearch.top_terms(w, "id", 2).groupBy("id").count().filter("count > 2").count() == 0


def test_model_round_trip(spark, tmp_path):
    model = textsearch.tfidf_fit(textsearch.gram_counts(spark.createDataFrame([(1, "abab")], "id int, text string"), "id"), 1)
    textsearch.save_model(model, str(tmp_path / "m"))
    assert sorted(map(tuple, textsearch.load_model(spark, str(tmp_path / "m")).collect())) == sorted(map(tuple, model.collect()))


LISTING = """<table><tr><td class="table_title">x</td><td/><td/><td/><td/></tr><tr><td><a href="/gs/detail/1?id=21010yz">i</a></td>
<td><a class="f_title">某项目</a><em>[一次]</em><div class="fct_att">附件 3</div><div class="f_common_bottom"><div class="fcb-location">广州</div><span class="gsz">公示中</span></div></td>
<td><span class="f_time">2024-01-02</span></td><td><span>5</span><span>6</span></td><td><a class="f_peo">张</a><span class="f_time">2024-01-01</span></td></tr><tr><td><a href="/x?id=1">y</a></td><td></td></tr></table>"""


def test_page_tables(spark):
    p = spark.createDataFrame([(1, "http://h/a/", LISTING)], "page_id int, url string, html string")
    got = pages.listing_rows(p).collect()
    assert [tuple(r) for r in got] == [("21010yz", "http://h/gs/detail/1?id=21010yz", "某项目", "一次", 3, "广州", "公示中", "2024-01-02", "5", "6", "张", "2024-01-01")]
    html = '<ul><li><div class="project_li_l">项目名称</div><div class="project_li_r">甲</div></li></ul><div id="contentContainer">建设单位：乙公司<br>联系人：丙</div><span class="box_tit">题</span><a class="down-publish-att" data-id="7">f</a>'
    p = spark.createDataFrame([(1, "http://h/", html), (2, "http://h/", "<script>var attachmentId = '" + "a" * 32 + "'</script>"), (3, "http://h/", "")], "page_id int, url string, html string")
    r = pages.detail_fields(p).filter("page_id = 1").first()
    assert (r.project_name, r.company, r.contact_person, r.detail_title) == ("甲", "乙公司", "丙", "题")
    assert [(r.page_id, r.attachment_id) for r in pages.attachment_ids(p).orderBy("page_id").collect()] == [(1, "7"), (2, "a" * 32)]
    rows = '<tr><td>1</td><td><a href="/a.pdf">2023年年度报告</a></td><td>2024-03-01</td></tr><tr><td><a href="javascript:x">n</a></td></tr><tr><td><a href="/b"> </a></td></tr>'
    got = pages.announcement_rows(spark.createDataFrame([(1, "http://h/l", rows)], "page_id int, url string, html string")).collect()
    assert [tuple(r) for r in got] == [("http://h/a.pdf", "2023年年度报告", "2024-03-01", "pdf", "annual_report")]


def test_links(spark):
    html = '<a href="/x.pdf">下载</a><a href="y.html" title="环评">  </a><a>none</a><a href="/x.pdf">again</a><p>a&amp;b</p><script>var t="</p>"</script>'
    p = spark.createDataFrame([(1, "http://h/d/", html)], "page_id int, url string, html string")
    assert [(r.url, r.text) for r in pages.extract_links(p).orderBy("pos").collect()] == [("http://h/x.pdf", "下载"), ("http://h/d/y.html", "环评"), ("http://h/x.pdf", "again")]
    assert [(r.url, r.file_type) for r in pages.document_links(p).collect()] == [("http://h/x.pdf", "pdf")]
    text = p.select(pages.html_to_text(F.col("html")).alias("a"), pages.html_to_text(F.col("html"), False).alias("b")).first()
    assert text.a.split("\n")[-2:] == ["a&b", 'var t="</p>"'] and text.b.split("\n")[-1] == "a&b"
    kept = filters.select_links(pages.extract_links(p).withColumn("parent_text", F.lit("")))
    assert kept.count() == 3
    items = pages.list_page_items(p).collect()
    assert {(r.kind, r.title) for r in items} == {("item", "下载"), ("detail", "环评"), ("item", "again")}


def test_tables(spark):
    old = spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int")
    new = spark.createDataFrame([("b", 9), ("c", 2), ("c", 3), (None, 4), ("", 5)], "k string, v int")
    assert sorted(map(tuple, tables.insert_if_absent(new.filter("k is not null and k != ''"), old, "k", ["v"]).collect())) == [("a", 1), ("b", 1), ("c", 2)]
    assert sorted(r.v for r in tables.drop_seen(new, old, "k", ["v"]).collect()) == [2, 4, 5]
    assert sorted(map(tuple, tables.upsert_latest(new.filter("k is not null"), old, "k", "v").collect())) == [("", 5), ("a", 1), ("b", 9), ("c", 3)]
    merged = tables.merge_detail(old, spark.createDataFrame([("a", None, "x")], "k string, v int, w string"), "k").orderBy("k").collect()
    assert [tuple(r) for r in merged] == [("a", None, "x"), ("b", 1, None)]


def test_aggregates(spark):
    df = spark.createDataFrame([("a", "x"), ("a", None), ("b", "x")], "p string, q string")
    got = aggregates.facet_counts(df, {"p": 1, "q": 5}).collect()
    assert sorted(map(tuple, got)) == [("p", "a", 2), ("q", "x", 2)]
    stats = aggregates.attachment_stats(df, "p", F.col("q").isNotNull())
    assert {r.p: (r.total, r.free, r.paid, r.free_rate) for r in aggregates.merge_stats([stats, stats], "p").collect()} == {"a": (4, 2, 2, 0.5), "b": (2, 2, 0, 1.0)}
    out = aggregates.batch_outcome(spark.createDataFrame([([],), (["e"],)], "errors array<string>")).first()
    assert (out.ok, out.failed) == (1, 1)


def test_pipeline(spark):
    docs = spark.createDataFrame([(1, "COD标准 13812345678"), (2, None), (3, "")], "id int, text string")
    got = {r.id: r for r in run_pipeline(docs, "id", stages=("embed", "ner", "parse", "sanitize")).collect()}
    assert got[1].n_masks == 1 and got[1].entity_count >= 2 and got[1].n_features > 0 and got[1].stages_completed == ["parse", "sanitize", "ner", "embed"]
    assert got[2].errors[0]["stage"] == "parse" and got[2].stages_completed == [] and got[3].entity_count == 0
    with pytest.raises(ValueError):
        run_pipeline(docs, "id", stages=("x",))


def test_pipeline_errors(spark):
    docs = spark.createDataFrame([(1, "a@b.cn", None), (2, "text", "broken"), (3, None, None)], "id int, text string, why string")
    stop = {r.id: r for r in run_pipeline(docs, "id", error="why").collect()}
    assert [len(stop[i].stages_completed) for i in (1, 2, 3)] == [4, 0, 0] and stop[2].errors[0]["error"] == "broken" and stop[3].text is None
    on = {r.id: r for r in run_pipeline(docs, "id", error="why", continue_on_error=True).collect()}
    assert on[3].stages_completed == ["sanitize", "ner", "embed"] and on[3].text == "" and len(on[3].errors) == 1 and on[3].embedding == {}
    assert abs(sum(w * w for w in on[1].embedding.values()) - 1) < 1e-9 and on[1].n_masks == 1 and on[1].entity_count == len(on[1].entities)


def test_embedding_is_the_transform(spark):
    docs = spark.createDataFrame([(1, "a  b\n\nab é"), (2, "xyz ab"), (3, ""), (4, None), (5, "😀x\x00y")], "id int, text string")
    model = textsearch.tfidf_fit_texts(docs, max_features=12)
    counts = textsearch.gram_counts(docs, "id")
    assert sorted((r.gram, r.df, round(r.idf, 9)) for r in model.collect()) == sorted((r.gram, r.df, round(r.idf, 9)) for r in textsearch.tfidf_fit(counts, 4, 12).collect())
    want = {(r.id, r.gram): round(r.weight, 9) for r in textsearch.tfidf_transform(counts, model, "id").collect()}
    got = {(r.id, g): round(w, 9) for r in textsearch.with_embedding(docs, model).collect() for g, w in r.embedding.items()}
    assert got == want and len(got) > 10


def test_dedup_agrees_in_rows_and_tables(spark):
    """Random touching mentions of two texts: the array form, the table form and a plain greedy loop."""
    import random

    r = random.Random(4)
    docs = {d: [("T", t, s, s + len(t), r.choice((0.5, 0.9))) for t in ("ab", "xyz") for s in sorted(r.sample(range(30), r.randint(0, 12)))] for d in range(25)}
    flat = spark.createDataFrame([(d, *m) for d, ms in docs.items() for m in ms], "doc int, type string, text string, start int, end int, score double")
    want = set()
    for d, ms in docs.items():
        kept = []
        for m in sorted(ms, key=lambda m: (-m[4], m[2])):
            if not any(m[1] == k[1] and m[2] <= k[3] and m[3] >= k[2] for k in kept):
                kept.append(m)
        want |= {(d, *m) for m in kept}
    assert set(map(tuple, entities.dedup_entities(flat, "doc").collect())) == want
    one = flat.groupBy("doc").agg(F.collect_list(F.struct("type", "text", "start", "end", "score")).alias("a")).select("doc", F.explode(entities.dedup_array(F.col("a"))).alias("e")).select("doc", "e.*")
    assert set(map(tuple, one.collect())) == want


def test_registries(spark, tmp_path):
    (tmp_path / "b.json").write_text('{"national": {"MEE": {"name": "部", "url": "https://m.cn", "dept": "d"}}, "provinces": {"乙": {"name": "b", "url": "https://b.cn"}, "甲": {"name": "a", "url": ""}, "丙": {"name": "c", "url": "https://c.cn"}}}')
    full = registry.load_bureaus(spark, str(tmp_path / "b.json"))
    assert [r.url for r in full.collect()][0] == "https://m.cn" and full.count() == 3
    assert [r.province for r in registry.load_bureaus(spark, str(tmp_path / "b.json"), "test", "乙").collect()] == ["乙"]
    assert registry.load_bureaus(spark, str(tmp_path / "b.json"), "test", "无").count() == 1
    (tmp_path / "p.json").write_text('[{"name": "园", "province": "甲", "url": "https://p.cn/x", "area_km2": 1.5}]')
    parks = registry.load_parks(spark, str(tmp_path / "p.json"))
    seeds = registry.seed_urls(parks, registry.PARK_PATHS, "enterprise_list").collect()
    assert len(seeds) == 5 and seeds[0].url == "https://p.cn/qyml/" and seeds[0].status == "queued"
    (tmp_path / "n.txt").write_text(" a \n\nb\n")
    assert [r.name for r in registry.read_name_list(spark, str(tmp_path / "n.txt")).collect()] == ["a", "b"]
    registry.write_manifest(parks, parks.agg(F.count("*").alias("n")), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out" / "stats")).first().n == 1


def test_announcements(spark):
    payloads = ['{"announcements": [], "data": [{"title": "中报", "url": "/a.pdf", "publishDate": "2024-05-06"}]}', '{"classifiedAnnouncements": [{"announcementTitle": "年报", "adjunctUrl": "x.docx", "announcementTime": "1714953600000", "secCode": "1"}]}', "{}"]
    got = registry.flatten_announcements(spark.createDataFrame([(p,) for p in payloads], "payload string")).collect()
    assert [(r.url, r.title, r.file_type, str(r.published_at), r.raw_meta["report_cycle"]) for r in got] == [
        ("http://www.cninfo.com.cn/a.pdf", "中报", "pdf", "2024-05-06 00:00:00", "half_year_report"),
        ("http://www.cninfo.com.cn/x.docx", "年报", "docx", "2024-05-06 00:00:00", "annual_report"),
    ]


def test_files(spark, tmp_path):
    w, s = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"', 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'

    def zipped(parts: dict[str, str]) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for k, v in parts.items():
                z.writestr(k, v)
        return out.getvalue()

    (tmp_path / "a.docx").write_bytes(zipped({"word/document.xml": f"<w:document {w}><w:body><w:p><w:r><w:t>一</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>二</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>c</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>"}))
    (tmp_path / "b.xlsx").write_bytes(zipped({"xl/workbook.xml": f'<workbook {s}><sheets><sheet name="S1"/></sheets></workbook>', "xl/sharedStrings.xml": f"<sst {s}><si><t>h</t></si></sst>", "xl/worksheets/sheet1.xml": f'<worksheet {s}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>5</v></c></row><row/></sheetData></worksheet>'}))
    (tmp_path / "bad.docx").write_bytes(b"nope")
    (tmp_path / "c.exe").write_bytes(b"x")
    (tmp_path / "d.txt").write_bytes(b"x" * 200)
    files = registry.scan_files(spark, str(tmp_path), max_bytes=10_000)
    assert {r.extension: r.error for r in files.collect()}["exe"] == "UNSUPPORTED_TYPE"
    assert registry.scan_files(spark, str(tmp_path), max_bytes=100).filter("error = 'FILE_TOO_LARGE'").count() >= 1
    got = {r.path.rpartition("/")[2]: r for r in office.parse_office(files.filter("extension in ('docx', 'xlsx')")).collect()}
    assert got["a.docx"].text == "一\n\n二" and got["a.docx"].tables[0]["rows"] == [["c"]]
    assert got["b.xlsx"].text == "[S1]\nh |  | 5" and got["b.xlsx"].tables[0]["sheet"] == "S1"
    assert got["bad.docx"].error.startswith("BadZipFile")
    assert (got["a.docx"].metadata.title, got["a.docx"].metadata.paragraphs, got["a.docx"].metadata.tables_count) == ("a.docx", 2, 1)
    assert (got["b.xlsx"].metadata.sheets, got["b.xlsx"].metadata.tables_count) == (["S1"], 1) and got["bad.docx"].metadata is None


def test_files_of_all_kinds_go_through_the_pipeline(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "a.txt").write_bytes("项目 联系人\r\n13800138000".encode())
    (tmp_path / "deep" / "b.TXT").write_bytes("环境影响报告".encode("gbk"))
    (tmp_path / "c.html").write_bytes("<html><style>p{}</style><p>数据 &amp; <b>x</b></p>\xff</html>".encode("utf-8").replace("ÿ".encode(), b"\xff"))
    (tmp_path / "d.Htm").write_bytes(b" ")
    (tmp_path / "e.pdf").write_bytes(b"%PDF-")
    (tmp_path / "f.exe").write_bytes(b"MZ")
    (tmp_path / "big.txt").write_bytes(b"x" * 5000)
    (tmp_path / "noext").write_bytes(b"x")
    files = registry.scan_files(spark, str(tmp_path), max_bytes=4000)
    assert files.count() == 8 and sorted(r.error or "" for r in files.collect()) == [""] * 5 + ["FILE_TOO_LARGE", "UNSUPPORTED_TYPE", "UNSUPPORTED_TYPE"]
    parsed = parse_files(files)
    got = {r.path.rpartition("/")[2]: r for r in parsed.collect()}
    assert got["a.txt"].text == "项目 联系人\n13800138000" and got["a.txt"].metadata.encoding == "utf-8" and got["a.txt"].metadata.file_size == 29
    assert got["b.TXT"].text == "环境影响报告" and got["b.TXT"].metadata.encoding == "gbk"
    assert got["c.html"].text == "p{}\n数据 &\nx\n\ufffd" and got["d.Htm"].text == ""
    assert {k: r.error for k, r in got.items() if r.error} == {"e.pdf": "NO_PARSER", "f.exe": "UNSUPPORTED_TYPE", "noext": "UNSUPPORTED_TYPE", "big.txt": "FILE_TOO_LARGE"}
    done = {r.path.rpartition("/")[2]: r for r in run_pipeline(parsed, "path", error="error").collect()}
    assert done["a.txt"].n_masks == 1 and "13800138000" not in done["a.txt"].text and done["b.TXT"].stages_completed == ["parse", "sanitize", "ner", "embed"]
    assert done["big.txt"].errors[0].error == "FILE_TOO_LARGE" and not done["big.txt"].stages_completed


def test_files_beyond_the_session_limit_are_not_read(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"x" * 200)
    (tmp_path / "b.txt").write_bytes(b"y")
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", 100)
    try:
        got = {r.path[-5:]: (r.error, r.content) for r in registry.scan_files(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    assert got == {"a.txt": ("FILE_TOO_LARGE", None), "b.txt": (None, b"y")}


def test_elements_nest(spark):
    html = "<div id=a class='x y'>one<div>two</div>three<p>four<p>five</div><table><tr><td>1<table><tr><td>in</td></tr></table><td>2</table><br/><script>var a='<div>'</script><img src=q><span>end"
    rows = spark.createDataFrame([(1, html), (2, None), (3, "</div>x</p>")], "page_id int, html string")
    got = {r.page_id: r for r in el.with_tree(rows, keep=("page_id",)).select("page_id", "texts", "nodes", *[
        el.text(el.first_such("nodes", el.such("div", "y", id="a")), "|").alias("a"), el.text(el.first_such("nodes", el.such("table"))).alias("t"), F.size(el.within(el.first_such("nodes", el.such("tr")))).alias("n"),
        el.value(el.first_such("nodes", el.such("img")), "src").alias("src"), el.text(el.first_such("nodes", el.such("span"))).alias("s"), el.text(el.first_such("nodes", el.such("h1"))).alias("none"),
    ]).collect()}
    r = got[1]
    assert (r.a, r.t, r.n, r.src, r.s, r.none) == ("one|two|three|four|five", "1in2", 5, "q", "end", None)
    assert all(n.end > n.id >= 0 and n.parent < n.id for n in r.nodes) and [n.tag for n in r.nodes if n.parent == -1] == ["div", "table", "br", "script", "img", "span"]
    assert got[2].nodes == [] and got[2].texts == [] and got[3].texts == ["x"]


def test_details_of_nested_blocks(spark):
    html = ('<ul class="project_ul"><li><div class="project_li_l">报告类型</div><div class="project_li_r"><div>书</div>表</div></li></ul><div class="detail_main"><div>建设单位：甲</div><div>联系人：乙<div>邮箱：a@b.cn</div></div></div>'
            '<div class="detail_fj"><a class="down-publish-att" data="1">f.pdf</a><b>-</b><span>1 MB</span><a class="down-publish-att">g</a></div><div class="top_details"><a>张三</a>发表于 2026-05-06 23:12 </div>')  # fmt: skip
    r = pages.detail_fields(spark.createDataFrame([(1, html)], "page_id int, html string")).first()
    assert (r.report_type, r.company, r.contact_person, r.email, r.post_author, r.post_time) == ("书表", "甲", "乙", "a@b.cn", "张三", "2026-05-06 23:12")
    assert [tuple(a) for a in r.attachments] == [("1", "f.pdf", "1 MB"), ("", "g", "")]
    none = pages.detail_fields(spark.createDataFrame([(1, None), (2, "<p>x")], "page_id int, html string")).collect()
    assert all(r.attachments == [] and r.description is None and r.post_time is None for r in none)


def test_page_with_total(spark):
    df = spark.createDataFrame([(i, "ab"[i % 3 == 0]) for i in range(50)], "id int, k string")
    got = filters.list_with_total(df, "id", {"k": "a"}, 2, 10).collect()
    assert [r.total for r in got] == [33] * 10 and filters.list_with_total(df, "id", {"k": "z"}).count() == 0


def test_early_stop_and_cutoff(spark):
    df = spark.createDataFrame([("g", i, i in (2, 3)) for i in range(6)], "g string, i int, old boolean")
    assert [r.i for r in filters.early_stop(df, "g", ["i"], F.col("old"), 1).collect()] == [0, 1]
    dated = spark.createDataFrame([("2024-01-01",), ("2023-01-01",), (None,)], "d string").select(F.to_timestamp("d").alias("d"))
    assert filters.incremental_cutoff(dated, "d", "2023-06-01").count() == 2
    assert filters.incremental_cutoff(dated, "d", "junk").count() == 3


def test_windows_across_stretches_of_time(spark):
    r = random.Random(3)
    rows = [(r.choice(["a", "a", "a", None, ""]), r.choice([None, 0, 1, 2, 3, 9, 10, 11, 639, 640, 641, 650, 651, 1279, 1280, 1281, 1290, -1, -10, -640]), i) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, s int, id int").withColumn("ts", F.timestamp_seconds("s"))
    came = [(k, s, i) for k, s, i in rows]

    def arrivals(k, s, i, since):
        if s is None:
            return sum(1 for a, b, c in came if a == k and b is None and c <= i)
        return sum(1 for a, b, c in came if a == k and b is not None and since <= b <= s and (b < s or c <= i))

    got = {x.id: x.hits for x in weblog.velocity_count(df, "k", "ts", "id").collect()}
    assert got == {i: arrivals(k, s, i, (s or 0) - 10) for k, s, i in rows}
    used = {x.id: (x.tier, x.used) for x in weblog.rate_limit(df, "k", F.lit("x"), "ts", "id", (), ("d", 5, 10)).collect()}
    assert used == {i: ("d", arrivals(k, s, i, (s or 0) - 9)) for k, s, i in rows}


def test_hot_clients_are_cut_where_they_were_idle(spark):
    r = random.Random(8)
    rows = []
    for k in ("a", "b", None):
        t = 0
        for _ in range(300):
            t += r.choice([0, 0, 1, 1, 2, 3, 4, 5, 6, 7, 20, 400, 5000])
            rows.append((k, float(t), len(rows)))
    df = events(spark, rows)
    for window, threshold, block in ((5, 3, 4), (4, 2, 6), (5, 4, 5)):
        at = {"window_us": window * S, "threshold": threshold, "block_us": block * S}
        plain, cut = weblog.velocity_block(df, "client", "ts", "id", **at), weblog.velocity_block(df, "client", "ts", "id", **at, hot=100)
        assert sorted((x.id, x.blocked) for x in cut.collect()) == sorted((x.id, x.blocked) for x in plain.collect())
        assert {x.blocked for x in plain.collect()} == {True, False}
    parts = weblog._sessions(df.withColumn("_t", weblog.micros("ts")), "client", "id", 6 * S).select("client", "_from").distinct().groupBy("client").count().collect()
    want = {}
    for k in ("a", "b", None):
        times = [t for c, t, _ in rows if c == k]
        want[k] = 1 + sum(b - a > 6 for a, b in zip(times, times[1:], strict=False))
    assert {x.client: x["count"] for x in parts} == want and min(want.values()) > 30


def test_rules_from_a_table_are_what_the_chain_gives(spark):
    r = random.Random(4)
    tiers = tuple(dict.fromkeys(("".join(r.choice("ab/") for _ in range(r.randint(1, 4))), r.randint(1, 3), r.choice([5, 10])) for _ in range(40)))
    rules = spark.createDataFrame([(p, n, s, i) for i, (p, n, s) in enumerate(tiers)], "prefix string, limit int, seconds int, place int")
    hits = [(r.choice("xy"), "".join(r.choice("ab/c") for _ in range(r.randint(0, 6))) or None, float(i // 3), i) for i in range(200)]
    df = spark.createDataFrame(hits, "client string, route string, t double, id int").withColumn("ts", F.timestamp_micros((F.col("t") * S).cast("long"))).drop("t")
    default = ("default", 2, 7)
    chain = weblog.rate_limit(df, "client", F.col("route"), "ts", "id", tiers, default)
    table = weblog.rate_limit(df, "client", F.col("route"), "ts", "id", rules, default)
    assert sorted(map(str, table.select(*chain.columns).collect())) == sorted(map(str, chain.collect()))
    many = spark.createDataFrame([(f"/p{i:05d}", i % 7, 60, i) for i in range(10_000)], "prefix string, limit int, seconds int, place int")
    asked = spark.createDataFrame([("/p00042/x",), ("/p09999",), ("/q",), (None,)], "route string")
    got = {x.route: x._r for x in weblog.with_tiers(asked, "route", many).collect()}
    assert (got["/p00042/x"].tier, got["/p00042/x"].limit, got["/p09999"].limit) == ("/p00042", 0, 3) and got["/q"].tier == got[None].tier == "default"


def test_resets_across_stretches_of_time(spark):
    r = random.Random(6)
    rows = [(r.choice(["a", "b", None]), r.choice([None, float(r.randint(-50, 50))]), i, r.choice([True, False, False, None])) for i in range(200)]
    df = spark.createDataFrame(rows, "client string, t double, id int, reset boolean").withColumn("ts", F.timestamp_micros((F.col("t") * S).cast("long")))
    got = {x.id: x.session for x in weblog.with_resets(df, "client", F.col("reset"), "ts", "id", 7 * S).collect()}
    order = lambda t, i: (t is not None, t or 0, i)
    assert got == {i: sum(bool(x) for c, u, j, x in rows if c == k and order(u, j) <= order(t, i)) for k, t, i, _ in rows}
