"""Column functions over URLs and file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions of documents, and sections with their base URLs in the order they are tried.
DOCUMENT_TYPES = ("pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx")
SECTIONS = {
    "xwfb": "https://www.mee.gov.cn/ywdt/xwfb/",
    "zcwj": "https://www.mee.gov.cn/ywgz/zcwj/",
    "hjzl": "https://www.mee.gov.cn/hjzl/",
    "ywgz": "https://www.mee.gov.cn/ywgz/",
    "xxgk": "https://www.mee.gov.cn/xxgk2018/",
}
# Hints of a file's type in a path or title, in the order they are tried.
TYPE_HINTS = (("pdf", (".pdf", "PDF")), ("doc", (".doc", "DOC")), ("docx", (".docx", "DOCX")), ("xlsx", (".xls", ".xlsx")))
_DOC_END = r"\.(pdf|docx?|xlsx?|pptx?)$"


def url_hash(url: Column, n: int = 64) -> Column:
    """SHA-256 of a URL in hex, whole or its first n characters."""
    return F.left(F.sha2(url, 256), F.lit(n))


def _split(url: Column, group: int) -> Column:
    # scheme, authority, path, query, fragment
    return F.regexp_extract(url, r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(\?[^#]*)?(#.*)?$", group)


def url_path(url: Column) -> Column:
    return _split(url, 3)


def url_domain(url: Column) -> Column:
    """The authority of a URL, '' if it has none."""
    return _split(url, 2)


def file_type_from_url(url: Column) -> Column:
    """Extension of the URL's path if it is a document's, else null; query and fragment don't count."""
    ext = F.regexp_extract(F.lower(url_path(url)), r"[^/]\.([a-z0-9]+)$", 1)
    return F.when(ext.isin(*DOCUMENT_TYPES), ext)


def file_type_href(href: Column, other: str = "html") -> Column:
    """Extension at the very end of an href, else `other`."""
    ext = F.regexp_extract(F.lower(href), _DOC_END, 1)
    return F.when(ext == "", F.lit(other)).otherwise(ext)


def is_document_href(href: Column) -> Column:
    return F.lower(href).rlike(_DOC_END)


def infer_file_type(title: Column, url: Column) -> Column:
    """Type by the path's end, then by hints in path or title in the order pdf, doc, docx, xlsx, else 'html'."""
    path = F.lower(url_path(url))
    chosen = F.when(path.rlike(r"\.pdf$"), "pdf").when(path.rlike(r"\.docx$"), "docx").when(path.rlike(r"\.doc$"), "doc")
    for kind, hints in TYPE_HINTS:
        for h in hints:
            chosen = chosen.when(path.contains(h) | F.coalesce(title.contains(h), F.lit(False)), kind)
    return chosen.otherwise("html")


def file_type_from_content_type(content_type: Column, url: Column) -> Column:
    """pdf or docx by content type, else by the URL's suffix, else 'bin'."""
    c = F.lower(F.coalesce(content_type, F.lit("")))
    return F.when(c.contains("pdf"), "pdf").when(c.contains("word") | c.contains("docx"), "docx").otherwise(F.coalesce(file_type_from_url(url), F.lit("bin")))


def resolve_url(base: Column, href: Column) -> Column:
    """href seen from base: absolute, //host, /path, relative (with dot segments), ?query, #fragment or empty."""
    scheme, host, path = _split(base, 1), _split(base, 2), _split(base, 3)
    root = F.concat(scheme, F.lit("://"), host)
    folder = F.regexp_replace(path, "[^/]*$", "")
    folder = F.when(folder == "", "/").otherwise(folder)
    h_path, h_rest = _split(href, 3), F.concat(_split(href, 4), _split(href, 5))
    joined = F.when(h_path.startswith("/"), h_path).otherwise(F.concat(folder, h_path))
    last = F.element_at(F.split(joined, "/"), -1)
    parts = F.aggregate(
        F.slice(F.split(joined, "/"), F.lit(2), F.greatest(F.size(F.split(joined, "/")) - 1, F.lit(0))), F.array().cast("array<string>"),
        lambda a, s: F.when(s == ".", a).when(s == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(s))),
    )
    clean = F.concat(F.lit("/"), F.array_join(parts, "/"), F.when(last.isin(".", "..") & (F.size(parts) > 0), "/").otherwise(""))
    return (
        F.when(href == "", base)
        .when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
        .when(href.startswith("#"), F.concat(F.regexp_replace(base, "#.*$", ""), href))
        .when(href.startswith("?"), F.concat(root, path, href))
        .otherwise(F.concat(root, clean, h_rest))
    )


def section_of(url: Column, sections: dict[str, str] = SECTIONS) -> Column:
    """The first section whose base URL is in the URL, else 'unknown'."""
    chosen = None
    for name, base in sections.items():
        chosen = F.when(url.contains(base), name) if chosen is None else chosen.when(url.contains(base), name)
    return F.lit("unknown") if chosen is None else chosen.otherwise("unknown")


def clean_filename(publish_id: Column, name: Column) -> Column:
    """Id and name with only letters, digits, blanks and ._- kept, ending in a document suffix ('.pdf' if none)."""
    full = F.trim(F.regexp_replace(F.concat_ws("_", publish_id, name), r"[^\p{L}\p{N}._ -]", ""))
    return F.when(full.rlike(r"\.(pdf|docx?|zip)$"), full).otherwise(F.concat(full, F.lit(".pdf")))
