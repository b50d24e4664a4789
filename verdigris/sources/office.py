"""DOCX and XLSX files to text and tables: the ZIP and XML are read per file inside Spark tasks."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame

EXTENSIONS = ("docx", "xlsx")
TABLES = "array<struct<rows:array<array<string>>,sheet:string>>"
#: What is known of a file; fields that its kind hasn't are null.
METADATA = "struct<title:string,paragraphs:int,sheets:array<string>,tables_count:int,encoding:string,file_size:long>"
SCHEMA = f"path string, text string, tables {TABLES}, metadata {METADATA}, error string"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_W, _S = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}", "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def _words(node: ET.Element) -> str:
    return "".join(t.text or "" for t in node.iter(f"{_W}t"))


def _docx(z: zipfile.ZipFile) -> tuple[str, list[dict], dict]:
    body = ET.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    found = [] if body is None else list(body)
    lines = [t for p in found if p.tag == f"{_W}p" and (t := _words(p).strip())]
    tables = [{"rows": [[_words(c).strip() for c in r.findall(f"{_W}tc")] for r in t.findall(f"{_W}tr")], "sheet": None} for t in found if t.tag == f"{_W}tbl"]
    return "\n\n".join(lines), tables, {"paragraphs": len(lines)}


def _column(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]*", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n


def _sheets(z: zipfile.ZipFile) -> list[tuple[str, str]]:
    """Name and part of each sheet, in the workbook's order: by its relationships, else by position."""
    sheets = list(ET.fromstring(z.read("xl/workbook.xml")).iter(f"{_S}sheet"))
    targets = {}
    if "xl/_rels/workbook.xml.rels" in z.namelist():
        targets = {r.get("Id"): r.get("Target", "") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    parts = []
    for k, s in enumerate(sheets, 1):
        to = targets.get(s.get(f"{_R}id"))
        part = f"xl/worksheets/sheet{k}.xml" if not to else to.lstrip("/") if to.startswith("/") else posixpath.normpath(f"xl/{to}")
        parts.append((s.get("name"), part))
    return parts


def _xlsx(z: zipfile.ZipFile) -> tuple[str, list[dict], dict]:
    strings = []
    if "xl/sharedStrings.xml" in z.namelist():
        strings = ["".join(t.text or "" for t in s.iter(f"{_S}t")) for s in ET.fromstring(z.read("xl/sharedStrings.xml"))]
    parts, tables = [], []
    for name, part in _sheets(z):
        rows = []
        for r in ET.fromstring(z.read(part)).iter(f"{_S}row"):
            cells: dict[int, str] = {}
            for c in r.findall(f"{_S}c"):
                v = c.find(f"{_S}v")
                value = "".join(t.text or "" for t in c.iter(f"{_S}t")) if c.get("t") == "inlineStr" else "" if v is None else v.text or ""
                cells[_column(c.get("r", "")) or len(cells) + 1] = strings[int(value)] if c.get("t") == "s" and value else value
            row = [cells.get(i, "") for i in range(1, max(cells, default=0) + 1)]
            if any(x.strip() for x in row):
                rows.append(row)
        parts.append("\n".join([f"[{name}]", *[" | ".join(r) for r in rows]]))
        tables.append({"rows": rows, "sheet": name})
    return "\n\n".join(parts), tables, {"sheets": [t["sheet"] for t in tables]}


def parse_office(files: DataFrame) -> DataFrame:
    """path, text, tables, metadata, error for files with path, extension and content; a file that can't be read gives its error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path, ext, content in zip(pdf["path"], pdf["extension"], pdf["content"], strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        text, tables, more = {"docx": _docx, "xlsx": _xlsx}[ext](z)
                    known = dict.fromkeys(("title", "paragraphs", "sheets", "tables_count", "encoding", "file_size"))
                    out.append((path, text, tables, known | more | {"title": posixpath.basename(path), "tables_count": len(tables), "file_size": len(content)}, None))
                except (zipfile.BadZipFile, KeyError, ET.ParseError, ValueError, IndexError, TypeError) as e:
                    out.append((path, None, [], None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["path", "text", "tables", "metadata", "error"])

    return files.filter("content is not null").select("path", "extension", "content").mapInPandas(run, SCHEMA)
