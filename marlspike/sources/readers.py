"""Files of a directory as pages: text, Markdown, CSV and DOCX built in, PDF by a parser that is passed in."""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Callable, Iterator
from itertools import islice
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

#: bytes -> the text of each page; None leaves PDF files out
PageParser = Callable[[bytes], list[str]]
PAGES = "source string, seq int, page int, type string, section_heading string, page_content string"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def scan(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, source, ext, content of every file directly in ``path``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    source = F.element_at(F.split("path", "/"), -1)
    return files.select("path", source.alias("source"), T.extension(source).alias("ext"), "length", "content")


def docx_blocks(data: bytes) -> Iterator[tuple[str, int, str]]:
    """(kind, heading level, text) of the body in document order; tables come as Markdown."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    for el in body if body is not None else ():
        if el.tag == f"{_W}p":
            style = el.find(f"{_W}pPr/{_W}pStyle")
            name = style.get(f"{_W}val", "") if style is not None else ""
            text = "".join(t.text or "" for t in el.iter(f"{_W}t"))
            level = re.match(r"(?i)(?:heading|title)\s*(\d*)", name)
            yield ("heading", int(level.group(1) or 1), text) if level else ("text", 0, text)
        elif el.tag == f"{_W}tbl":
            rows = [["".join(t.text or "" for t in c.iter(f"{_W}t")) for c in r.iter(f"{_W}tc")] for r in el.iter(f"{_W}tr")]
            width = max(map(len, rows), default=0)
            lines = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in rows]
            yield "table", 0, "\n".join(lines[:1] + ["| " + " | ".join(["---"] * width) + " |"] * bool(lines) + lines[1:])


def docx_sections(data: bytes) -> list[tuple[str, str]]:
    """(heading, text) of each section with text; a heading begins a section and is its first line."""
    out: list[tuple[str, list[str]]] = [("", [])]
    for kind, level, text in docx_blocks(data):
        if not text.strip():
            continue
        if kind == "heading":
            out.append((text.strip()[:200], [f"{'#' * level} {text.strip()}"]))
        else:
            out[-1][1].append(text.strip())
    return [(h, "\n".join(lines)) for h, lines in out if "\n".join(lines).strip()]


def _parse(pdf: PageParser | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for source, ext, data in zip(*(batch.column(i).to_pylist() for i in range(3))):
                try:
                    if ext == "docx":
                        rows += [(source, i, None, "docx_section", h, t) for i, (h, t) in enumerate(docx_sections(data))]
                    elif ext == "pdf" and pdf is not None:
                        rows += [(source, i, i + 1, "pdf", None, t) for i, t in enumerate(pdf(data)) if t.strip()]
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
                    rows.append((source, 0, None, "unreadable", None, ""))
            cols = list(zip(*rows)) or [[]] * 6
            types = (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=[c.split()[0] for c in PAGES.split(", ")])

    return run


def _csv(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """source, seq, page_content of the rows of each file, by the file's own header."""
    for batch in batches:
        for source, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            rows = csv.DictReader(io.StringIO(data.decode("utf-8-sig", "replace"), newline=""), restval="", restkey="")
            n = 0
            while part := list(islice(rows, 1000)):
                texts = ["\n".join(f"{k}: {v if isinstance(v, str) else ' '.join(v)}" for k, v in r.items() if k or v) for r in part]
                yield pa.RecordBatch.from_arrays([pa.array([source] * len(texts)), pa.array(range(n, n + len(texts)), pa.int32()), pa.array(texts)], names=["source", "seq", "page_content"])
                n += len(texts)


def csv_rows(files: DataFrame) -> DataFrame:
    """source, seq, page_content: one record per row of each CSV file (source, content), its fields as "name: value" lines.

    Files have headers of their own; rows are numbered within a file, short rows filled with blanks.
    """
    return files.select("source", "content").mapInArrow(_csv, "source string, seq int, page_content string")


def corpus(spark: SparkSession, path: str, pdf: PageParser | None = None) -> DataFrame:
    """All readable files of a directory as pages; files of other kinds are skipped."""
    files = scan(spark, path)
    none = lambda t: F.lit(None).cast(t)
    plain = files.filter(F.col("ext").isin("txt", "md")).select("source", F.lit(0).alias("seq"), none("int").alias("page"), none("string").alias("type"), none("string").alias("section_heading"), F.col("content").cast("string").alias("page_content"))
    parsed = files.filter(F.col("ext").isin("docx", "pdf")).select("source", "ext", "content").mapInArrow(_parse(pdf), PAGES)
    out = plain.unionByName(parsed)
    rows = csv_rows(files.filter(F.col("ext") == "csv")).select("source", "seq", none("int").alias("page"), none("string").alias("type"), none("string").alias("section_heading"), "page_content")
    return out.unionByName(rows)


def docx_images(data: bytes) -> list[tuple[int, str, bytes]]:
    """(block, name, bytes) of the pictures in a document's paragraphs, found by their relationship ids."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        try:
            relations = ElementTree.fromstring(z.read("word/_rels/document.xml.rels"))
        except KeyError:
            return []
        targets = {r.get("Id"): r.get("Target", "") for r in relations}
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
        out = []
        for i, el in enumerate(body if body is not None else ()):
            for blip in el.iter(f"{_A}blip"):
                name = targets.get(blip.get(f"{_R}embed"), "")
                path = name.lstrip("/") if name.startswith("/") else f"word/{name}"
                if name and path in z.namelist():
                    out.append((i, name.rsplit("/", 1)[-1], z.read(path)))
        return out
