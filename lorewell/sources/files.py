"""File and directory sources behind a suffix registry."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Reader = Callable[[bytes], list[str]]

W_NS = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def read_text(content: bytes) -> list[str]:
    """S6."""
    return [content.decode("utf-8")]


def read_docx(content: bytes) -> list[str]:
    """Paragraphs of word/document.xml, one per line."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    return ["\n".join("".join(t.text or "" for t in p.iter(f"{W_NS}t")) for p in root.iter(f"{W_NS}p"))]


def read_pdf(content: bytes) -> list[str]:
    """One document per page; needs pypdf, and without it the file is an error row."""
    import pypdf

    return [p.extract_text() or "" for p in pypdf.PdfReader(io.BytesIO(content)).pages]


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.out: list[str] = []
        self.skip = 0

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style")

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style") and self.skip > 0

    def handle_data(self, data):
        if not self.skip and data.strip():
            self.out.append(data.strip())


def read_html(content: bytes) -> list[str]:
    """S7 for local files: visible text, one line per text node."""
    parser = _Text()
    parser.feed(content.decode("utf-8", "replace"))
    return ["\n".join(parser.out)]


READERS: dict[str, Reader] = {".pdf": read_pdf, ".docx": read_docx, ".doc": read_docx, ".txt": read_text, ".md": read_text, ".html": read_html}


def register(suffix: str, reader: Reader) -> None:
    """E5."""
    READERS[suffix.lower()] = reader


def suffix_of(path: str) -> str:
    return m[0].lower() if (m := re.search(r"\.[^./]+$", path)) else ""


def load_file(spark: SparkSession, path: str) -> DataFrame:
    """An unsupported suffix raises at once; a file that cannot be read raises when the rows are computed."""
    if suffix_of(path) not in READERS:
        raise ValueError(f"unsupported file type: {suffix_of(path) or path}")
    return load_directory(spark, path, strict=True).drop("error")


def load_directory(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """(content, page, source_file, error) below path; other suffixes are left out.

    A file that cannot be read gives one row with its error, so that nothing vanishes silently. Files of no
    bytes give no row, as Spark does not open them.
    """
    readers = dict(READERS)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    known = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).isin(*readers)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for p, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    rows += [(text, i, p, None) for i, text in enumerate(readers[suffix_of(p)](content))]
                except Exception as e:  # noqa: BLE001  a bad file is quarantined
                    if strict:
                        raise
                    rows.append((None, None, p, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["content", "page", "source_file", "error"]).astype({"page": "Int32"})

    return files.where(known).select("path", "content").mapInPandas(run, "content string, page int, source_file string, error string")


def load_urls(pages: DataFrame, urls: list[str] | None = None) -> DataFrame:
    """S10 over fetched pages (url, html): visible text with source_url; urls that were not fetched give no row."""
    rows = pages.where(F.col("url").isin(urls)) if urls is not None else pages

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"content": [read_html((h or "").encode())[0] for h in batch["html"]], "source_url": batch["url"]})

    return rows.select("url", "html").mapInPandas(run, "content string, source_url string")
