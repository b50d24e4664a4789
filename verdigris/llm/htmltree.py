"""Main text of web pages by site style trees.

Each page is read once into blocks of text, each with the element it stands in; elements with the same chain of tags and classes below
the page are one node of their host's tree. Spark sums over all pages of a host how a node's styles (the tags of its children) and contents
(its blocks) are spread. Presentation matters by the entropy of the styles; a content counts the less, the more evenly
it is spread over the pages. Both make a node's composite importance, (1 - g^l) * presentation + g^l * content for l styles. What a markup says
comes in as a prior: plain text elements of an article count half by themselves, and elements that are menus, forms, adverts and
the like by tag, role or class count nothing. A branch goes if it and all below it matter little; text stands in nodes, so that is
the same as leaving out each node of low importance. If a page has an article, what stands outside it goes, too.

Only sums by host, node and feature are shuffled, pre-aggregated in each task, so a host that holds a third of all pages is no
large group. The nodes that go are one list for each host, which meets the pages in a join by host; Spark broadcasts it where
it is small and splits a hot host where it isn't.

Defined cases: null or empty html gives an empty text. A page without a host has no site, so markup alone decides there, and so it does for nodes
seen on fewer than MIN_PAGES pages of a host. On a host whose pages are all alike nothing stands out, and nothing is left out
for being alike. Unclosed elements end as browsers end them; a tag that the text breaks off in is dropped. Repeated rows give repeated results,
an empty table none. Extra columns are ignored, whatever their names. Very long pages take time and memory in proportion to their length.
"""

from __future__ import annotations

import hashlib
import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.llm import common

# Elements that make blocks, those that end an open paragraph, where a search for an open element stops, and
# elements whose text is none of the article's, as blocks, within a line, or as raw text.
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = HEADINGS | frozenset("address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form header hgroup hr li main menu nav ol p pre search section summary table ul".split())
BLOCKS = CLOSES_P | frozenset("caption legend optgroup option tbody td tfoot th thead tr".split())
SCOPES = frozenset("caption table td th".split())
LABELS = frozenset("a b em i ins label small span strong".split())
LISTS, ROWS, CELLS = frozenset("dir menu ol ul".split()), frozenset("tbody tfoot thead tr".split()), frozenset("caption td th".split())
#: The open elements that a start tag ends, and where the search for them stops.
ENDS = {"li": (frozenset({"li"}), LISTS | SCOPES), **dict.fromkeys(("dd", "dt"), (frozenset({"dd", "dt"}), SCOPES | {"dl"})), **dict.fromkeys(CELLS, (CELLS, frozenset({"table"}))), **dict.fromkeys(ROWS, (ROWS, frozenset({"table"}))),
        "tr": (frozenset({"tr"}), frozenset({"table"})), **dict.fromkeys(("option", "optgroup"), (frozenset({"option"}), frozenset({"select"})))}
_P, _NO_WORDS = frozenset({"p"}), frozenset()
NOISE_TAGS = frozenset("aside dialog footer form header menu nav search".split())
NOISE_INLINE = frozenset("audio button canvas datalist math noscript object select svg template video".split())
RAW = frozenset("iframe noembed noframes script style textarea title xmp".split())
NOISE_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
NOISE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer form gdpr header masthead menu menus modal nav navbar "
    "navigation newsletter notice notices pager pagination popup promo related reply replies share sidebar social sponsor sponsored subscribe toolbar widget".split()
)
#: Class words of them that layouts around an article carry, too ("has-sidebar"): an article within is one all the same. An article's own head holds its headline.
LAYOUT = frozenset("ad ads banner cookie cookies footer header menu modal nav navbar sidebar".split())
PAGE_TOP = frozenset({"header", "masthead"})
PLAIN = HEADINGS | frozenset("article blockquote dd dl dt figcaption figure li main ol p pre table tbody td tfoot th thead tr ul".split())
#: Weight of presentation, importance below which a node goes, that share of the host's most important node, and the pages that a judgement takes.
GAMMA, LOW, LOW_SHARE, MIN_PAGES = 0.9, 0.2, 0.5, 5
NEUTRAL, MAIN = 0, 1
#: Why an element's text counts nothing: for class words that layouts carry, too, or for good.
SOFT, HARD = 1, 2

_TOKEN = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*+(?:>|\Z)|</(?:>|[^A-Za-z>][^>]*+(?:>|\Z))|<(/?)([A-Za-z][^\s/>]*+)((?:=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))|[^>])*+)(>|\Z)", re.S)
_ATTR = re.compile(r"(?:^|[\s/\"'])(class|id|role)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>\"']++))", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_ENDS = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)", re.I) for t in RAW}
_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"


def _number(*parts: object) -> int:
    return int.from_bytes(hashlib.blake2b("\0".join(map(str, parts)).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


@lru_cache(1 << 16)
def _node(above: int, tag: str, words: frozenset) -> int:
    return _number(above, tag, *sorted(words))


@lru_cache(1 << 12)
def _named(attrs: str) -> tuple[str, frozenset]:
    """Role and words of class and id."""
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(attrs)}
    names = entities.unescape(f"{found.get('class', '')} {found.get('id', '')}")
    return found.get("role", "").lower(), frozenset(w.lower() for w in _PART.findall(names))


class _Element:
    __slots__ = ("child", "held", "inside", "key", "plain", "quiet", "style", "tag")

    def __init__(self, tag: str, key: int, quiet: int, inside: bool, plain: bool):
        self.tag, self.key, self.quiet, self.inside, self.plain = tag, key, quiet, inside, plain
        self.child, self.style, self.held = "", 0, False


class Page:
    """Blocks of a page in order: (node, kind, in an article, text), and for each node with text the styles it has."""

    def __init__(self, html: str):
        self.blocks: list[tuple[int, int, bool, str]] = []
        self.styles: Counter = Counter()
        self._open = [_Element("", 0, 0, False, False)]
        self._count: Counter = Counter()
        self._run: list[str] = []
        at, size = 0, len(html)
        while at < size:
            low = html.find("<", at)
            if low < 0:
                self._text(html[at:])
                break
            if low > at:
                self._text(html[at:low])
            m = _TOKEN.match(html, low)
            if not m:
                self._text("<")
                at = low + 1
                continue
            at = m.end()
            if not m[2] or not m[4]:
                continue  # comments and the like, and a tag that isn't complete
            tag = m[2].lower()
            if m[1]:
                self._end(tag)
            elif tag in RAW:
                closing = _ENDS[tag].search(html, at)
                at = closing.start() if closing else size
            else:
                self._start(tag, m[3])
        self._flush()
        while len(self._open) > 1:
            self._pop()

    def _text(self, s: str) -> None:
        if not self._open[-1].quiet:
            self._run.append(s)

    def _flush(self) -> None:
        if self._run:
            text = " ".join(entities.unescape("".join(self._run)).split())
            self._run = []
            if text:
                e = next(x for x in reversed(self._open) if x.tag in BLOCKS or not x.tag)
                e.held = True
                self.blocks.append((e.key, MAIN if e.plain else NEUTRAL, e.inside, text))

    def _pop(self) -> None:
        e = self._open.pop()
        self._count[e.tag] -= 1
        if e.held:
            self.styles[e.key, e.style] += 1

    def _pop_to(self, tags: frozenset, stop: frozenset = frozenset()) -> None:
        """End the nearest open element of these tags, and all within it, if no element of stop is in between."""
        for i in range(len(self._open) - 1, 0, -1):
            if self._open[i].tag in tags:
                while len(self._open) > i:
                    self._pop()
                return
            if self._open[i].tag in stop:
                return

    def _push(self, tag: str, key: int, quiet: int, inside: bool, plain: bool) -> None:
        self._open.append(_Element(tag, key, quiet, inside, plain))
        self._count[tag] += 1

    def _start(self, tag: str, attrs: str) -> None:
        top, count = self._open[-1], self._count
        if not top.quiet and top.child != tag:
            top.child, top.style = tag, _node(top.style, tag, _NO_WORDS)
        if "=" not in attrs or top.quiet == HARD:
            role, words = "", _NO_WORDS
        else:  # long attributes aren't worth keeping
            role, words = (_named if len(attrs) < 200 else _named.__wrapped__)(attrs)
        if tag not in BLOCKS:
            if tag == "br":
                self._text(" ")
            elif tag in NOISE_INLINE:
                if not attrs.rstrip().endswith("/"):
                    self._push(tag, top.key, HARD, top.inside, False)
            elif tag in LABELS and (words & NOISE_WORDS or role in NOISE_ROLES):
                self._push(tag, top.key, HARD, top.inside, False)
            return
        self._flush()
        if count["p"] and tag in CLOSES_P:
            self._pop_to(_P, SCOPES)
        if tag in HEADINGS and self._open[-1].tag in HEADINGS:
            self._pop()
        elif tag == "hr":
            return
        elif tag in ENDS and any(count[t] for t in ENDS[tag][0]):
            self._pop_to(*ENDS[tag])
        top = self._open[-1]
        if top.quiet == HARD:  # nothing in here counts
            self._push(tag, top.key, HARD, False, False)
            return
        anchor = tag in ("article", "main") or role == "main"
        inside = top.inside or anchor
        by_words = words & NOISE_WORDS - (PAGE_TOP if inside else _NO_WORDS) if words and tag != "main" else _NO_WORDS
        quiet = top.quiet if not anchor else 0
        if (tag in NOISE_TAGS and not (tag in PAGE_TOP and inside)) or role in NOISE_ROLES or by_words - LAYOUT:
            quiet = HARD
        elif by_words:
            quiet = SOFT
        self._push(tag, _node(top.key, tag, words), quiet, inside and not quiet, tag in PLAIN and not words and (anchor or top.plain))

    def _end(self, tag: str) -> None:
        if tag in BLOCKS:
            if tag == "p" or tag in HEADINGS or self._count[tag] > 0:
                self._flush()
                self._pop_to(HEADINGS if tag in HEADINGS else frozenset({tag}), SCOPES - {tag} if tag not in ROWS else frozenset({"table"}))
        elif self._count[tag] > 0:
            self._end_inline(tag)

    def _end_inline(self, tag: str) -> None:
        """An end tag within a line ends a muted element if no block is open within it."""
        for i in range(len(self._open) - 1, 0, -1):
            if self._open[i].tag == tag:
                while len(self._open) > i:
                    self._pop()
                return
            if self._open[i].tag in BLOCKS and tag not in NOISE_INLINE:
                return


_SUMS = "host string, node long, kind tinyint, feature long, n long, spread double, pages long"
#: What a row of sums is about: a style, a content, or the node itself.
_STYLE, _CONTENT, _NODE = 0, 1, 2


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the pages of a batch by host, node and feature: how often, sum of n ln n over pages, and pages."""
    for batch in batches:
        sums: dict[tuple, list] = {}
        for host, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            page = Page(html)
            own = Counter({(node, _STYLE, f): n for (node, f), n in page.styles.items()})
            own.update((node, _CONTENT, _number(text)) for node, _, _, text in page.blocks)
            own.update((node, _NODE, kind) for node, kind, _, _ in page.blocks)
            for k, n in own.items():
                s = sums.setdefault((host, *k), [0, 0.0, 0])
                s[0] += n
                s[1] += n * math.log(n)
                s[2] += 1
        keys = list(zip(*sums, strict=True)) or [(), (), (), ()]
        values = list(zip(*sums.values(), strict=True)) or [(), (), ()]
        kinds = (pa.string(), pa.int64(), pa.int8(), pa.int64(), pa.int64(), pa.float64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([*keys, *values], kinds, strict=True)], names=[x.split()[0] for x in _SUMS.split(", ")])


def _with_host(pages: DataFrame) -> DataFrame:
    host = F.regexp_extract(F.coalesce("url", F.lit("")), _HOST, 1)
    return pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), F.lower(F.nullif(host, F.lit(""))).alias("host"))


def site_trees(pages: DataFrame) -> DataFrame:
    """host, node, pages, styles, presentation, content and importance of every node with text of every host's tree."""
    common.bound_batches(pages.sparkSession)
    sums = _with_host(pages).filter("host is not null").select("host", "html").mapInArrow(_count_batches, _SUMS)
    by_feature = sums.groupBy("host", "node", "kind", "feature").agg(F.sum("n").alias("n"), F.sum("spread").alias("spread"), F.sum("pages").alias("pages"))
    kind, n = F.col("kind"), F.col("n").cast("double")
    nodes = by_feature.groupBy("host", "node").agg(
        F.max(F.when(kind == _NODE, F.col("pages"))).alias("pages"), F.max(F.when(kind == _NODE, F.col("feature"))).alias("prior"),
        F.count_if(kind == _STYLE).alias("styles"), F.sum(F.when(kind == _STYLE, n)).alias("_all"), F.sum(F.when(kind == _STYLE, n * F.ln(n))).alias("_own"),
        F.avg(F.when(kind == _CONTENT, F.ln(n) - F.col("spread") / n)).alias("_even"),
    )
    presentation = F.when(F.col("_all") > 1, (F.ln("_all") - F.col("_own") / F.col("_all")) / F.ln("_all")).otherwise(1.0)
    content = F.when(F.col("pages") > 1, 1 - F.col("_even") / F.ln("pages")).otherwise(1.0)
    rows = nodes.select("host", "node", "prior", "pages", "styles", presentation.alias("presentation"), content.alias("content"))
    share = F.pow(F.lit(GAMMA), F.col("styles"))
    both = (1 - share) * F.col("presentation") + share * F.col("content")
    weighed = F.when(F.col("prior") == MAIN, (1 + both) / 2).otherwise(both)
    return rows.withColumn("importance", F.round(weighed, 9))


def low_nodes(trees: DataFrame) -> DataFrame:
    """host and nodes, the list of its nodes that go. A host that has none has no row."""
    best = trees.groupBy("host").agg(F.max("importance").alias("best"))
    low = trees.filter((F.col("pages") >= MIN_PAGES) & (F.col("importance") < LOW)).join(best, "host").filter(F.col("importance") < LOW_SHARE * F.col("best"))
    return low.groupBy("host").agg(F.collect_list("node").alias("nodes"))


def _text_of(html: str, low: set[int]) -> tuple[str, int, int]:
    """The main text, the blocks it is of, and those that the tree left out."""
    blocks = Page(html).blocks
    if any(b[2] for b in blocks):
        blocks = [b for b in blocks if b[2]]
    kept = [b[3] for b in blocks if b[0] not in low]
    return "\n\n".join(kept), len(kept), len(blocks) - len(kept)


def _extract_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [_text_of(h, set(low or ())) for h, low in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        more = [pa.array([f[0] for f in found], pa.string()), *[pa.array(x, pa.int64()) for x in ([len(f[0]) for f in found], [f[1] for f in found], [f[2] for f in found])]]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *more], names=["page_id", "url", "text", "n_chars", "n_blocks", "n_low"])


def extract(pages: DataFrame) -> DataFrame:
    """One row for each page: page_id, url, text, n_chars, the blocks in text and how many the site's tree left out."""
    low = common.materialize(low_nodes(site_trees(pages)), "low-nodes")
    joined = _with_host(pages).join(low, "host", "left").select("page_id", "url", "html", "nodes")
    kinds = {f.name: f.dataType.simpleString() for f in pages.select("page_id", "url").schema}
    return joined.mapInArrow(_extract_batches, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long, n_blocks long, n_low long")


def op11_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(common.table(spark, sf_dir, "pages"))
