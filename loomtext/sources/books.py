"""Books: EPUB archives, plain texts with chapter headings, and a library of both."""

from __future__ import annotations

import html
import io
import os.path
import posixpath
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator, Sequence
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_WANTED = {"p", "h1", "h2", "h3", "h4", "blockquote"}
_ENDS_P = _WANTED | {"div", "ul", "ol", "li", "table", "section", "article", "hr", "pre", "h5", "h6", "header", "footer", "body"}


class _Blocks(HTMLParser):
    """Texts of paragraphs, headings and block quotations in the order in which they open; an open paragraph ends at the next block."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[list[str]] = []
        self.open: list[tuple[str, int]] = []
        self.skipped = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("script", "style", "title"):
            self.skipped += 1
        if tag in _ENDS_P and self.open and self.open[-1][0] == "p":
            self.open.pop()
        if tag == "br":
            self.handle_data(" ")
        if tag in _WANTED:
            self.blocks.append([])
            self.open.append((tag, len(self.blocks) - 1))

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style", "title"):
            self.skipped = max(0, self.skipped - 1)
        if tag in _WANTED and any(t == tag for t, _ in self.open):
            while self.open.pop()[0] != tag:
                pass

    def handle_data(self, data: str) -> None:
        if not self.skipped:
            for _, i in self.open:
                self.blocks[i].append(data)


def html_blocks(text: str) -> list[str]:
    """The texts of an HTML page's paragraphs, headings and block quotations; empty ones are dropped."""
    reader = _Blocks()
    reader.feed(text)
    reader.close()
    found = (re.sub(r"\s+", " ", "".join(b)).strip() for b in reader.blocks)
    return [f for f in found if f]


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def epub_paragraphs(content: bytes) -> list[tuple[str, str, int, int]]:
    """Locator, text, chapter and place of each paragraph of an EPUB, in the order of its spine.

    The chapter is the place in the spine; a part that is missing from the archive keeps its number but has no rows.
    Raises ``ValueError`` if the archive names no package.
    """
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        names = set(archive.namelist())
        if "META-INF/container.xml" not in names:
            raise ValueError("not an EPUB: no META-INF/container.xml")
        root = next((e.get("full-path") for e in ET.fromstring(archive.read("META-INF/container.xml")).iter() if _local(e.tag) == "rootfile"), None)
        if not root or root not in names:
            raise ValueError("not an EPUB: no package")
        package = ET.fromstring(archive.read(root))
        hrefs = {e.get("id"): e.get("href") for e in package.iter() if _local(e.tag) == "item"}
        spine = [hrefs[e.get("idref")] for e in package.iter() if _local(e.tag) == "itemref" and e.get("idref") in hrefs]
        out: list[tuple[str, str, int, int]] = []
        for chapter, href in enumerate(spine):
            path = posixpath.join(posixpath.dirname(root), href)
            if path in names:
                for text in html_blocks(archive.read(path).decode("utf-8", "replace")):
                    out.append((f"{href}#p{len(out)}", text, chapter, len(out)))
        return out


def read_epubs(spark: SparkSession, path: str) -> DataFrame:
    """``path``, ``locator``, ``text``, ``chapter``, ``idx`` of the paragraphs of all EPUB files of a folder; one file is one task's row."""
    return epub_rows(spark.read.format("binaryFile").option("pathGlobFilter", "*.epub").load(path))


def epub_rows(files: DataFrame) -> DataFrame:
    """The same of archives in the columns ``path`` and ``content``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                yield pd.DataFrame([(name, *row) for row in epub_paragraphs(content)], columns=["path", "locator", "text", "chapter", "idx"])

    return files.select("path", "content").mapInPandas(run, "path string, locator string, text string, chapter int, idx bigint")


def epub_bytes(title: str, chapters: Sequence[Sequence[str]]) -> bytes:
    """An EPUB of chapters of paragraphs; a paragraph that begins with CHAPTER is a heading. The mimetype comes first and is stored."""
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(zipfile.ZipInfo("mimetype"), "application/epub+zip", zipfile.ZIP_STORED)
        z.writestr(
            "META-INF/container.xml",
            '<container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles>'
            '<rootfile full-path="OEBPS/content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>',
        )
        parts = range(len(chapters))
        items = "".join(f'<item id="c{i}" href="c{i}.xhtml" media-type="application/xhtml+xml"/>' for i in parts)
        order = "".join(f'<itemref idref="c{i}"/>' for i in parts)
        z.writestr("OEBPS/content.opf", f'<package xmlns="http://www.idpf.org/2007/opf" version="2.0"><manifest>{items}</manifest><spine>{order}</spine></package>')
        for i, texts in enumerate(chapters):
            body = "\n".join(f"<{t}>{html.escape(p)}</{t}>" for p in texts for t in ["h1" if p.startswith("CHAPTER") else "p"])
            z.writestr(f"OEBPS/c{i}.xhtml", f'<html xmlns="http://www.w3.org/1999/xhtml"><head><title>{html.escape(title)}</title></head><body>\n{body}\n</body></html>')
    return buffer.getvalue()


def text_chapters(paragraphs: DataFrame) -> DataFrame:
    """``path``, ``idx``, ``text``, ``chapter`` (0-based) of plain-text paragraphs: front matter before the first heading, headings, and lines of
    volumes and parts are dropped; a text without a heading is one chapter."""
    heading = F.col("text").rlike(r"(?i)^(CHAPTER|LETTER)\s+[\dIVXLC]+\b")
    book = Window.partitionBy("path").orderBy("idx")
    seen = F.sum(heading.cast("int")).over(book)
    total = F.sum(heading.cast("int")).over(Window.partitionBy("path"))
    marked = paragraphs.select("path", "idx", "text", heading.alias("h"), seen.alias("seen"), total.alias("total"))
    kept = marked.where("total = 0 OR (seen > 0 AND NOT h)").where(~((F.col("total") > 0) & F.col("text").rlike(r"(?i)^(VOLUME|PART)\b")))
    return kept.select("path", "idx", "text", F.greatest(F.lit(0), F.col("seen") - 1).cast("int").alias("chapter"))


def read_paragraphs(spark: SparkSession, path: str) -> DataFrame:
    """``path``, ``idx``, ``text``, ``start``, ``end`` of the paragraphs of plain texts, parted by blank lines.

    Line breaks and tabs inside become spaces one for one, so places in the file hold.
    """
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("v"))
    pieces = F.regexp_extract_all("v", F.lit(r"(\n[ \t]*\n|(?:(?!\n[ \t]*\n)[\s\S])++)"), F.lit(1))
    cut = files.select("path", F.posexplode(pieces).alias("i", "piece"))
    order = Window.partitionBy("path").orderBy("i")
    placed = cut.select("*", (F.sum(F.length("piece")).over(order) - F.length("piece")).cast("int").alias("start"))
    placed = placed.where(F.col("piece").rlike(r"\S")).withColumn("end", F.col("start") + F.length("piece"))
    return placed.select("path", (F.row_number().over(Window.partitionBy("path").orderBy("start")) - 1).alias("idx"), F.translate("piece", "\n\r\t", "   ").alias("text"), "start", "end")


def library(spark: SparkSession, root: str) -> DataFrame:
    """``book``, ``ready`` (it has an index) and ``interrupted`` (it has a text but no index) of each folder of a library."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    parts = files.select(F.element_at(F.split("path", "/"), -2).alias("book"), F.element_at(F.split("path", "/"), -1).alias("name"))
    books = parts.groupBy("book").agg(F.max(F.col("name") == "index.db").alias("ready"), F.max(F.endswith("name", F.lit(".epub"))).alias("has_text"))
    return books.select("book", "ready", (F.col("has_text") & ~F.col("ready")).alias("interrupted"))


def file_name(identifier: str, suffix: str = ".characters.json") -> str:
    """A file name for an id: everything but letters, digits, ``-`` and ``_`` as percent signs and hexadecimal digits."""
    return "".join(c if c.isalnum() or c in "-_" else f"%{ord(c):02X}" for c in identifier) + suffix


def identifier_of(name: str, suffix: str = ".characters.json") -> str:
    return re.sub(r"%([0-9A-F]{2})", lambda m: chr(int(m[1], 16)), os.path.basename(name).removesuffix(suffix))
