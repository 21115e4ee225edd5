"""Office documents: text of .docx, sheets of .xlsx, read with the standard library under size caps."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame

# The most bytes of an archive, of its contents, and of contents to an archive's byte.
MOST_ARCHIVE, MOST_CONTENT, MOST_RATIO = 50 << 20, 512 << 20, 200


def within_caps(content: bytes) -> bool:
    """Whether an archive is small enough to open, by what its directory says."""
    if len(content) > MOST_ARCHIVE or not zipfile.is_zipfile(io.BytesIO(content)):
        return False
    size = sum(i.file_size for i in zipfile.ZipFile(io.BytesIO(content)).infolist())
    return size <= MOST_CONTENT and size <= MOST_RATIO * max(1, len(content))


def _local(element: ElementTree.Element) -> str:
    return element.tag.rsplit("}", 1)[-1]


def docx_text(content: bytes) -> str:
    """Paragraphs by line; headings get marks by their level."""
    root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml"))
    out = []
    for p in (e for e in root.iter() if _local(e) == "p"):
        style = next((v for e in p.iter() if _local(e) == "pStyle" for k, v in e.attrib.items() if k.endswith("val")), "")
        text = "".join(e.text or "" for e in p.iter() if _local(e) == "t").strip()
        level = re.fullmatch(r"[Hh]eading(\d)", style)
        if text:
            out.append("#" * int(level[1]) + " " + text if level else text)
    return "\n\n".join(out)


def xlsx_sheets(content: bytes) -> dict[str, list[list[str]]]:
    """Rows of shown text by sheet."""
    z = zipfile.ZipFile(io.BytesIO(content))
    names, shared = z.namelist(), []
    if "xl/sharedStrings.xml" in names:
        shared = ["".join(t.text or "" for t in s.iter() if _local(t) == "t") for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")) if _local(s) == "si"]
    titles = [e.attrib["name"] for e in ElementTree.fromstring(z.read("xl/workbook.xml")).iter() if _local(e) == "sheet"]
    files = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
    out = {}
    for title, name in zip(titles, files, strict=False):
        rows = []
        for row in (e for e in ElementTree.fromstring(z.read(name)).iter() if _local(e) == "row"):
            cells = []
            for c in (e for e in row if _local(e) == "c"):
                value = next((e.text or "" for e in c.iter() if _local(e) in ("v", "t")), "")
                cells.append(shared[int(value)] if c.attrib.get("t") == "s" and value else value)
            rows.append(cells)
        out[title] = rows
    return out


def office_text(path: str, content: bytes) -> str:
    """Markdown of one file; empty if it can't be read within the caps."""
    if not within_caps(content):
        return ""
    try:
        if path.endswith(".docx"):
            return docx_text(content)
        return "\n\n".join(f"## {t}\n\n" + "\n".join("| " + " | ".join(r) + " |" for r in rows) for t, rows in xlsx_sheets(content).items())
    except (KeyError, ValueError, ElementTree.ParseError, zipfile.BadZipFile):
        return ""


def read_office(files: DataFrame) -> DataFrame:
    """``(path, text)`` of binary files ``(path, content)``."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"path": part["path"], "text": [office_text(p, c) for p, c in zip(part["path"], part["content"], strict=True)]})

    return files.select("path", "content").mapInPandas(run, "path string, text string")


def sheet_structure(files: DataFrame) -> DataFrame:
    """``(path, sheet, column)`` of the first row of each sheet of ``(path, content)``."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(p, s, c) for p, b in zip(part["path"], part["content"], strict=True) if within_caps(b) for s, r in xlsx_sheets(b).items() for c in (r[0] if r else ())]
            yield pd.DataFrame(rows, columns=["path", "sheet", "column"])

    return files.select("path", "content").mapInPandas(run, "path string, sheet string, column string")
