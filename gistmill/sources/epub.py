"""E-book source: archives read as binary files, sections in spine order."""

from __future__ import annotations

import io
import lzma
import struct
import zipfile
import zlib
from collections.abc import Iterator
from urllib.parse import unquote
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gistmill.functions.text import html_to_text
from gistmill.operators.segment import identity_page

LEAST_SECTION = 40


def resolve_path(base: str, href: str) -> str:
    """href against the folder of base; .. goes up, . stays."""
    out: list[str] = base.split("/")[:-1]
    for part in href.split("/"):
        if part == "..":
            del out[-1:]
        elif part not in ("", "."):
            out.append(part)
    return "/".join(out)


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def spine_paths(book: zipfile.ZipFile) -> list[str]:
    """Chapter paths: the manifest's href of each spine entry, in order."""
    try:
        container = ElementTree.fromstring(book.read("META-INF/container.xml"))
        opf = next(e.get("full-path") for e in container.iter() if _local(e.tag) == "rootfile")
        package = ElementTree.fromstring(book.read(opf))
    except (KeyError, StopIteration, ElementTree.ParseError):
        return []
    manifest = {e.get("id"): e.get("href") for e in package.iter() if _local(e.tag) == "item"}
    spine = [e.get("idref") for e in package.iter() if _local(e.tag) == "itemref"]
    return [resolve_path(opf, unquote(manifest[i])) for i in spine if manifest.get(i)]


# what zipfile raises on archives and entries that are cut, encrypted, damaged or packed in an unknown way
_UNREADABLE = (zipfile.BadZipFile, zlib.error, lzma.LZMAError, struct.error, RuntimeError, EOFError, OSError, ValueError, IndexError)


def _book(content: bytes) -> Iterator[tuple[int, str | None, str | None, str | None]]:
    """(place, entry, html, error) of a book's chapters; an entry that cannot be read has
    an error, and so has a book, without an entry."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as book:
            names = set(book.namelist())
            found = spine_paths(book) or sorted(n for n in names if n.lower().endswith((".html", ".xhtml", ".htm")))
            for i, name in enumerate(found):
                if name in names:
                    try:
                        yield i, name, book.read(name).decode("utf-8", "replace"), None
                    except _UNREADABLE as e:
                        yield i, name, None, f"{type(e).__name__}: {e}"
    except _UNREADABLE as e:
        yield -1, None, None, f"{type(e).__name__}: {e}"


def _chapters(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in parts:
        for path, content in zip(pdf["path"], pdf["content"], strict=True):
            yield pd.DataFrame([(path, *row) for row in _book(content)], columns=["path", "spine", "name", "html", "error"])


def _read(spark: SparkSession, path: str) -> DataFrame:
    books = spark.read.format("binaryFile").option("pathGlobFilter", "*.epub").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return books.mapInPandas(_chapters, "path string, spine int, name string, html string, error string")


def read_sections(spark: SparkSession, path: str) -> DataFrame:
    """path, section_index (dense), title, text of the sections of every book under
    `path`; short sections are passed over, and what cannot be read has none."""
    raw = _read(spark, path).where("error is null")
    body = F.regexp_replace("html", r"(?is)<head\b.*?</head>", " ")
    title = html_to_text(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1))
    named = F.when(title == "", F.regexp_extract("name", "([^/]+)$", 1)).otherwise(title)
    rows = raw.select("path", "spine", named.alias("title"), html_to_text(body).alias("text")).where(F.length("text") >= LEAST_SECTION)
    order = Window.partitionBy("path").orderBy("spine")
    return rows.withColumn("section_index", F.row_number().over(order) - 1).select("path", "section_index", "title", "text")


def unreadable(spark: SparkSession, path: str) -> DataFrame:
    """path, name (null: the whole book), error of what read_sections leaves out because
    it cannot be read.  A file without any bytes is passed over by Spark itself."""
    return _read(spark, path).where("error is not null").select("path", "name", "error")


def section_pages(sections: DataFrame) -> DataFrame:
    """Sections as pages with an identity map and no glyphs."""
    return sections.select("path", "title", *identity_page(F.col("section_index"), F.col("text")))


