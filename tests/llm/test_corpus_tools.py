"""Main text of pages, importance resampling and the filter audit, against brute force and by hand."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from verdigris.llm import filteraudit, htmltree, importance

LINES = [
    ("<p>a<p>b", "a\n\nb"), ("a<br>b <b>c</b>d", "a b cd"), ("<ul><li>1<li>2</ul>3", "1\n\n2\n\n3"), ("x &amp; &lt;y&gt; &#233;&nbsp;z", "x & <y> é z"), ("a < b <3 c</>d", "a < b <3 cd"),
    ("<article>in<aside>no</aside></article>out", "in"), ("<nav>n</nav><header>h</header>t<footer>f</footer>", "t"), ("<article><header><h1>H</h1></header><p>t</p></article>", "H\n\nt"),
    ("<div class='ad-slot'>x</div><div id=comments><article>c</article></div><div class=has-sidebar><main>m</main></div>", "m"), ("<script>var a='<p>x'</script>t<style>p{}</style><!-- c -->u", "tu"),
    ("<title>T</title><p title='a>b'>t</p><img alt='x'>", "t"), ("<p>t</p><form>x<input>y</form><button>b</button>v", "t\n\nv"), ("<table><tr><td>1<td>2<tr><td>3</table>", "1\n\n2\n\n3"),
    ("t<p", "t"), ("t<!-- open", "t"), ("<script>never closed <p>x</p>", ""), ("", ""), (None, ""), ("<div role=navigation>x</div><p>é\t\n é</p>", "é é"), ("<h1>a<h2>b</h1>c", "a\n\nb\n\nc"), ("<svg/>a<svg><text>x</text></svg>b", "ab"),
]


def test_page_texts(spark):
    df = spark.createDataFrame([(i, None, h, "x") for i, (h, _) in enumerate(LINES)], "page_id long, url string, html string, host string")
    got = {r.page_id: r for r in htmltree.extract(df).collect()}
    assert {i: r.text for i, r in got.items()} == {i: t for i, (_, t) in enumerate(LINES)}
    assert all(r.n_chars == len(r.text) and r.url is None for r in got.values())
    assert htmltree.extract(df.limit(0)).count() == 0
    assert htmltree.extract(df.union(df)).count() == 2 * len(LINES)


def _site(n: int, article: str = "div") -> list[tuple]:
    r = random.Random(n)
    word = lambda: "".join(r.choices("abcdefghij", k=6))
    text = [" ".join(word() for _ in range(12)) for _ in range(n)]
    return [(i, f"http://site.org/{i}", f"<div class=top><div>Welcome to the site</div><div>All news</div></div><{article}><h1>{word()}</h1><div class=body><p>{t}</p></div><div class=more>Read on every day</div></{article}>") for i, t in enumerate(text)], text


@pytest.mark.parametrize("element", ["div", "article"])
def test_site_tree_leaves_out_what_all_pages_share(spark, element):
    rows, text = _site(12, element)
    other = [(100 + i, f"https://few.org/{i}", "<div class=top>Welcome</div><p>t</p>") for i in range(3)]  # too few pages to judge
    same = [(200 + i, f"https://same.org/{i}", "<div class=top>Welcome</div><p>t</p>") for i in range(9)]  # nothing stands out
    df = spark.createDataFrame(rows + other + same, "page_id long, url string, html string")
    got = {r.page_id: r for r in htmltree.extract(df.repartition(5)).collect()}
    for i, t in enumerate(text):
        assert got[i].text.split("\n\n")[1:] == [t] and got[i].n_low == (3 if element == "div" else 1)
    assert all(got[i].text == "Welcome\n\nt" and not got[i].n_low for i in [*range(100, 103), *range(200, 209)])


def test_importance_of_nodes_by_brute_force(spark):
    """Entropies of every node from all instances on all pages, without Spark's sums."""
    r = random.Random(5)
    pages = [(i, f"http://{r.choice('ab')}.org", "".join(r.choice(["<p>x</p>", "<div class=c>y<b>z</b></div>", "<div class=c>y<i>w</i></div>", "<p>u<b>v</b></p>", f"<p>{r.randint(0, 5)}</p>"]) for _ in range(6))) for i in range(20)]
    got = {(x.host, x.node): x for x in htmltree.site_trees(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(7)).collect()}
    seen: dict[tuple, list] = {}
    for i, url, html in pages:
        page = htmltree.Page(html)
        for node, _, _, text in page.blocks:
            seen.setdefault((url[7:], node), [[], []])[0].append((i, text))
        for (node, style), n in page.styles.items():
            seen[url[7:], node][1].extend([style] * n)
    assert set(got) == set(seen)
    for k, (blocks, styles) in seen.items():
        m = len({i for i, _ in blocks})
        entropy = lambda xs, base: -sum(xs.count(x) / len(xs) * math.log(xs.count(x) / len(xs), base) for x in set(xs))
        shape = entropy(styles, len(styles)) if len(styles) > 1 else 1
        content = 1 - sum(entropy([i for i, t in blocks if t == text], m) for text in {t for _, t in blocks}) / len({t for _, t in blocks}) if m > 1 else 1
        share = 0.9 ** len(set(styles))
        assert got[k].importance == pytest.approx((1 - share) * shape + share * content, abs=1e-6)


def test_given_pages_by_their_articles(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r.text for r in htmltree.op11_main_text(spark, "/root/testdata/sf0.001").collect()}
    for r in rows.collect():
        inner = r.html[r.html.index("<article>") : r.html.index("</article>")]
        parts = [" ".join(htmltree.entities.unescape(re.sub("<[^>]*>", "", p)).split()) for p in re.split("<p>|</p>|</?h1>|<article>", inner)]
        assert got[r.page_id] == "\n\n".join(filter(None, parts))


WORD = re.compile(r"[0-9a-z\x80-\U0010FFFF]+")


def _low(t: str | None) -> list[str]:
    return WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))


def _resampled(rows: list[tuple], target: list[str | None], run: int = 1, buckets: int = 10_000, min_words: int = 20, pct: int = 10) -> dict:
    def buckets_of(t):
        w = _low(t)
        return [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, run + 1) for i in range(len(w) - n + 1)]

    s, t = [0] * buckets, [0] * buckets
    for _, x in rows:
        for b in buckets_of(x):
            s[b] += 1
    for x in target:
        for b in buckets_of(x):
            t[b] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(t) * 0 + sum(s) + buckets) / ((a + 1) * (sum(t) + buckets)))) for a, b in zip(s, t, strict=True)]
    out = []
    for d, x in rows:
        f = buckets_of(x)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append((d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    fits = sorted((-o[3], o[0] is None, o[0] or 0) for o, (_, x) in zip(out, rows, strict=True) if len(_low(x)) >= min_words)
    drawn = fits[: pct * len(fits) // 100]
    return out, drawn


@pytest.mark.parametrize("run", [1, 3])
def test_resampling(spark, run):
    r = random.Random(run)
    words = ["the", "of", "Ünï", "a1", "X", "déjà", "spark", "row", "z9"]
    rows = [(i, " ".join(r.choice(words) for _ in range(r.choice((0, 5, 19, 20, 21, 60))))) for i in range(300)] + [(7, "row " * 30), (7, "row " * 30), (None, "spark " * 25), (400, None), (401, "!!"), (402, "x" * 5000 + " y" * 40)]
    target = ["spark row spark", None, "", "Déjà Ünï spark"]
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, score int")
    bench = spark.createDataFrame(list(enumerate(target)), "item_id long, text string")
    want, drawn = _resampled(rows, target, run)
    got = importance.resample(df.repartition(6), bench, run=run).collect()
    assert sorted(map(str, (tuple(x)[:4] for x in got))) == sorted(map(str, want))
    ranks = sorted((x.rank, -x.score, x.doc_id is None, x.doc_id or 0) for x in got if x.rank)
    assert [x[0] for x in ranks] == list(range(1, len(drawn) + 1)) and [x[1:] for x in ranks] == drawn
    none = importance.resample(df.limit(0), bench)
    assert none.count() == 0 and none.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert all(x.rank is None for x in importance.resample(df, bench, min_words=10_000).collect())
    assert importance.resample(df, bench.limit(0), share_pct=100, min_words=0).filter("rank is null").count() == 0


def test_kth_key_with_ties(spark):
    r = random.Random(3)
    rows = [(r.randint(0, 3), r.choice([None, 1, 2, 3]), i) for i in range(500)]
    df = spark.createDataFrame(rows, "score long, doc_id long, _row long")
    want = sorted((-s, d is None, d or 0, i) for s, d, i in rows)
    for k in (1, 2, 77, 250, 499, 500):
        a, b, c, d = importance.kth_key(df, k, 4)
        assert (a, b, c or 0, d) == want[k - 1]
    assert importance.kth_key(df, 501) is None and importance.kth_key(df.limit(0), 1) is None


def _audited(rows: list[tuple], labels: list[tuple]) -> dict:
    texts = [(d, t or "", lang or "") for d, t, lang in rows]
    fails = []
    for d, t, _ in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = "A" * (len(w) < 100) + "B" * (100 * len(set(w)) < 80 * len(w)) + "C" * (100 * len(re.findall("[A-Z]", t)) > 10 * len(t)) + "D" * bool(re.search("[#$%&*|]", t))
        fails.append(f + "E" * (d is not None and any(x is not None and x < d and y == t for x, y, _ in texts)))
    good, toxic = {d for d, q, _ in labels if q == 1 and d is not None}, {d for d, _, x in labels if x == 1 and d is not None}
    out = {}
    for part in {p for _, _, p in texts}:
        own = [(d, f) for (d, _, p), f in zip(texts, fails, strict=True) if p == part]
        sums = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            gone: set[int] = set()
            for step, x in enumerate(order, 1):
                such = {i for i, (_, f) in enumerate(own) if x in f}
                here = such - gone
                redundant = len(such & gone)
                gone |= here
                sums[x] += len(here)
                ids = [own[i][0] for i in here]
                out[part, "".join(order), step] = [len(own) - len(gone), len(here), redundant, sum(f == x for _, f in own), sum(i in good for i in ids), sum(i in toxic for i in ids), x]
        for k, v in out.items():
            if k[0] == part:
                v[-1] = sums[v[-1]]
    return out


def test_filter_audit(spark):
    r = random.Random(9)
    sign = lambda: r.choice(["", "", "#", "a|b"])
    texts = [" ".join(r.choice(["a", "B", "cc", "Dd", *map(str, range(r.choice((3, 300))))]) for _ in range(r.choice((3, 99, 100, 150)))) + sign() for _ in range(60)]
    rows = [(i, r.choice(texts), r.choice(["en", "de", None, ""])) for i in range(-20, 150)]
    rows += [(5, texts[0], "en"), (5, texts[0], "en"), (None, texts[0], "en"), (None, None, "xx"), (900, "", "xx"), (901, None, "xx"), (902, "\x0b \x1f x", "xx"), (903, "É" * 9 + "E", "xx"), (904, "w " * 50_000, "xx")]
    labels = [(i, r.choice((0, 1, None)), r.choice((0, 1))) for i in range(-30, 100)] + [(3, 1, 0), (3, 0, 1), (None, 1, 1)]
    df = spark.createDataFrame([(*x, "k") for x in rows], "doc_id long, text string, lang string, fails string").repartition(5)
    found = filteraudit.audit(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {(x.part, x.filter_order, x.step): [x.kept, x.removed, x.redundant, x.unique_fails, x.good_lost, x.toxic_lost, x.shapley] for x in found.collect()}
    assert got == _audited(rows, labels)
    assert filteraudit.audit(df.limit(0), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).count() == 0
    clean = spark.createDataFrame([(1, " ".join(map(str, range(120))), "en")], "doc_id long, text string, lang string")
    rows = filteraudit.audit(clean, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()
    assert len(rows) == 600 and all(x.kept == 1 and not x.removed and not x.shapley for x in rows)


def test_brute_documents_pass_through(spark):
    """The awkward documents of the other tests: nothing crashes, no row is lost."""
    rows = brute.documents()
    docs = brute.frame(spark, rows)
    assert importance.resample(docs, docs.select(F.col("doc_id").alias("item_id"), "text")).count() == len(rows)
    assert filteraudit.audit(docs, spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")).filter("step = 5").groupBy("filter_order").agg(F.sum("kept")).distinct().count() == 120
