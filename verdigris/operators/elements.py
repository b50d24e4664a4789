"""Pages as trees of elements: made once in a page's task, asked by conditions on intervals.

Elements are numbered in page order, so what stands within element n are the elements from n.id + 1 up to n.end, and its text nodes
are those from n.first up to n.last. Nested blocks, tables within cells and the like need no more than that. Optional end tags are supplied
where a start tag implies them; text nodes are trimmed, blank ones and the bodies of scripts and styles left out.
"""

from __future__ import annotations

from collections.abc import Callable
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.functions import batches

# Elements without content, what a start tag ends of the elements that are still open, and what it doesn't look beyond.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
ENDS = {"li": {"li"}, "p": {"p"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
NODE = "struct<id:int,end:int,parent:int,tag:string,classes:array<string>,attrs:map<string,string>,first:int,last:int>"


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.nodes: list[dict] = []
        self.texts: list[str] = []
        self._open: list[dict] = []
        self._tags: dict[str, int] = {}

    def _close(self) -> None:
        n = self._open.pop()
        self._tags[n["tag"]] -= 1
        n["end"], n["last"] = len(self.nodes), len(self.texts)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        while self._open and self._open[-1]["tag"] in ENDS.get(tag, ()):
            self._close()
        own = {k: v or "" for k, v in reversed(attrs)}
        at, here = len(self.nodes), len(self.texts)
        node = {"id": at, "end": at + 1, "parent": self._open[-1]["id"] if self._open else -1, "tag": tag, "classes": own.get("class", "").split(), "attrs": own, "first": here, "last": here}
        self.nodes.append(node)
        if tag not in VOID:
            self._open.append(node)
            self._tags[tag] = self._tags.get(tag, 0) + 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self._close()

    def handle_endtag(self, tag: str) -> None:
        if self._tags.get(tag):
            while self._open[-1]["tag"] != tag:
                self._close()
            self._close()

    def handle_data(self, data: str) -> None:
        if data.strip() and not (self._open and self._open[-1]["tag"] in ("script", "style")):
            self.texts.append(data.strip())

    def close(self) -> None:
        super().close()
        while self._open:
            self._close()


def with_tree(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ()) -> DataFrame:
    """Columns to keep with nodes, the elements in page order, and texts, the text nodes; both empty for a null page."""
    kind = batches.arrow_type(f"array<{NODE}>")

    def make(htmls: list) -> list[pa.Array]:
        trees = []
        for h in htmls:
            t = _Tree()
            t.feed(h or "")
            t.close()
            trees.append(t)
        return [pa.array([[n | {"attrs": list(n["attrs"].items())} for n in t.nodes] for t in trees], kind), pa.array([t.texts for t in trees], pa.list_(pa.string()))]

    rows = pages.select(*keep, F.col(html).alias("_html"))
    return batches.mapped(rows, "_html", list(keep), {"nodes": f"array<{NODE}>", "texts": "array<string>"}, make)


def within(node: Column, nodes: Column | str = "nodes") -> Column:
    """The elements within one."""
    return F.slice(nodes, node["id"] + 2, node["end"] - node["id"] - 1)


def such(tag: str | None = None, klass: str | None = None, **attrs: str) -> Callable[[Column], Column]:
    """Whether an element has a tag, a class and attributes."""

    def test(n: Column) -> Column:
        ok = F.lit(True) if tag is None else n["tag"] == tag
        if klass is not None:
            ok &= F.array_contains(n["classes"], klass)
        for k, v in attrs.items():
            ok &= F.coalesce(F.get(F.map_values(F.map_filter(n["attrs"], lambda a, _: a == k)), F.lit(0)) == v, F.lit(False))  # noqa: B023
        return ok

    return test


def all_such(nodes: Column | str, test: Callable[[Column], Column]) -> Column:
    return F.filter(nodes, test)


def first_such(nodes: Column | str, test: Callable[[Column], Column]) -> Column:
    """The first element that passes, or null."""
    return F.get(F.filter(nodes, test), F.lit(0))


def value(node: Column, name: str) -> Column:
    """An attribute's value, or null."""
    return F.try_element_at(node["attrs"], F.lit(name))


def text(node: Column, between: str = "", texts: Column | str = "texts") -> Column:
    """An element's text nodes put together; null for no element."""
    return F.when(node.isNotNull(), F.array_join(F.slice(texts, node["first"] + 1, node["last"] - node["first"]), between))
