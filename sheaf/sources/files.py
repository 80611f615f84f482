"""Files as pages of text.  A file that can't be read is a row with an error; it never fails the batch."""

from __future__ import annotations

import importlib.util
import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable
from html.entities import html5
from html.parser import HTMLParser
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STRICT_SUFFIXES = ["pdf", "txt", "docx"]
TEXT_SUFFIXES = ["txt", "md", "markdown", "rst", "csv", "json", "xml", "yaml", "yml"]
SUFFIXES = [*TEXT_SUFFIXES, "html", "htm", "xhtml", "docx", "pdf"]
PAGE_SCHEMA = "path string, document string, extractor string, page int, total_pages int, source_unit int, text string, title string, error_type string, message string"


class SourceError(ValueError):
    """A file holds nothing to read, or is of a kind that can't be read."""


class Parser(Protocol):
    """Reads files of some kinds; a caller may pass its own to ``load``."""

    suffixes: tuple[str, ...]

    def read(self, data: bytes) -> list[tuple[int | None, str]]:
        """The file's pages: the number, if pages are numbered, and the text."""
        ...


def clean(text: str) -> str:
    return "\n".join(line.rstrip() for line in re.split(r"\r\n?|\n", text)).strip()


def decode(data: bytes) -> str:
    """UTF-8 with or without a mark, else the Thai code page."""
    for name in ("utf-8-sig", "cp874"):
        try:
            return data.decode(name)
        except UnicodeDecodeError:
            continue
    raise SourceError("neither UTF-8 nor Thai text")


def read_text(data: bytes) -> list[tuple[int | None, str]]:
    return [(None, decode(data))]


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def read_docx(data: bytes, cells: str = "filled") -> list[tuple[int | None, str]]:
    """Paragraphs that aren't blank, then the rows of tables, cells joined by bars (blank ones left out unless ``cells`` is "all")."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ET.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    said = lambda e: "".join(("\t" if t.tag == f"{_W}tab" else "\n" if t.tag in (f"{_W}br", f"{_W}cr") else t.text or "") for t in e.iter() if t.tag in (f"{_W}t", f"{_W}tab", f"{_W}br", f"{_W}cr"))
    parts = [p for e in (body if body is not None else []) if e.tag == f"{_W}p" and (p := said(e).strip())]
    for table in body.iter(f"{_W}tbl") if body is not None else ():
        for row in table.findall(f"{_W}tr"):
            values = ["\n".join(said(p) for p in c.iter(f"{_W}p")).strip() for c in row.findall(f"{_W}tc")]
            values = values if cells == "all" else [v for v in values if v]
            if any(values):
                parts.append(" | ".join(values))
    return [(None, "\n".join(parts) if cells == "filled" else "\n\n".join(parts))]


def read_pdf(data: bytes) -> list[tuple[int | None, str]]:
    """All pages under their real numbers, blank ones too, by whichever PDF library the workers have."""
    if importlib.util.find_spec("pypdf"):
        import pypdf

        return [(k, p.extract_text() or "") for k, p in enumerate(pypdf.PdfReader(io.BytesIO(data)).pages, 1)]
    if importlib.util.find_spec("pdfplumber"):
        import pdfplumber

        with pdfplumber.open(io.BytesIO(data)) as pdf:
            return [(k, p.extract_text() or "") for k, p in enumerate(pdf.pages, 1)]
    raise SourceError("no PDF library is installed")


class _Html(HTMLParser):
    """Text nodes outside the dropped elements; with ``inside``, those within the first element it accepts."""

    VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())

    def __init__(self, drop: frozenset[str], inside: Callable[[str, dict], bool] | None = None):
        super().__init__()
        self.drop, self.inside, self.open, self.texts, self.title = drop, inside, [], [], None
        self.dropped, self.root, self.done = 0, None, False

    def handle_starttag(self, tag, attrs):
        if tag in self.VOID:
            return
        self.open.append(tag)
        self.dropped += tag in self.drop
        if self.inside and self.root is None and not self.dropped and self.inside(tag, dict(attrs)):
            self.root = len(self.open)

    def handle_endtag(self, tag):
        if tag in self.open:
            while True:
                last = self.open.pop()
                self.dropped -= last in self.drop
                if self.root is not None and len(self.open) < self.root:
                    self.done = True
                if last == tag:
                    break

    def handle_data(self, data):
        if "title" in self.open and self.title is None and data.strip():
            self.title = data.strip()
        if not self.dropped and data.strip() and (not self.inside or self.root is not None and not self.done):
            self.texts.append(data.strip())


PLAIN_DROP = frozenset(["script", "style", "nav", "footer", "header"])
WEB_DROP = PLAIN_DROP | {"aside", "noscript"}


_REFERENCE = re.compile("&(#[0-9]+;|#[xX][0-9a-fA-F]+;|[A-Za-z][A-Za-z0-9]*;)?")


def closed_references(page: str) -> str:
    """A page whose only character references are known ones with a semicolon; other ampersands are text."""
    return _REFERENCE.sub(lambda m: m[0] if m[1] and (m[1][0] == "#" or m[1] in html5) else f"&amp;{m[0][1:]}", page)


def html_text(page: str, web: bool = False, unclosed: bool = True) -> tuple[str, str | None]:
    """Text and title.  ``web`` also drops asides and looks for main, then article, then a content div, then the whole page.

    A reference without a semicolon, as in a title that was cut off after "&amp", is decoded as browsers do; without ``unclosed`` it stays.
    """
    page = page if unclosed else closed_references(page)
    steps: list[Callable[[str, dict], bool] | None] = [None]
    if web:
        steps = [lambda t, a: t == "main", lambda t, a: t == "article", lambda t, a: t == "div" and re.search("content|main|article", a.get("class") or "") is not None, None]
    parser = None
    for inside in steps:
        parser = _Html(WEB_DROP if web else PLAIN_DROP, inside)
        parser.feed(page)
        parser.close()
        if parser.texts:
            break
    text = re.sub(r"[ \t]{2,}", " ", re.sub(r"\n{3,}", "\n\n", "\n".join(parser.texts)))
    return text.strip(), parser.title


def parse(path: str, data: bytes, strict: bool, parsers: tuple[Parser, ...] = (), unclosed: bool = True) -> tuple[list[tuple[int | None, str]], int, str, str | None]:
    """Pages with text, how many there are with those without, the extractor's name and the title of a source.

    A URL is a fetched page; other sources go by their suffix, and in the open profile unknown ones are text.
    """
    suffix = path.rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""
    own = next((p for p in parsers if suffix in p.suffixes), None)
    title = None
    if own is not None:
        pages, name = own.read(data), type(own).__name__
    elif strict and suffix not in STRICT_SUFFIXES:
        raise SourceError(f"unsupported suffix: {suffix or 'none'}")
    elif not strict and path.startswith(("http://", "https://")):
        text, title = html_text(data.decode("utf-8", "replace"), True, unclosed)
        pages, name = [(None, text)], "web"
    elif suffix in ("html", "htm", "xhtml"):
        text, title = html_text(data.decode("utf-8", "replace"), unclosed=unclosed)
        pages, name = [(None, text)], "html"
    elif suffix in ("docx", "doc"):
        pages, name = read_docx(data, "filled" if strict else "all"), "docx"
    elif suffix == "pdf":
        pages, name = read_pdf(data), "pdf"
    else:
        pages, name = read_text(data), "text"
    filled = [(n, t) for n, text in pages if (t := clean(text))]
    if not filled:
        raise SourceError("no text")
    return filled, len(pages), name, title


def discover(spark: SparkSession, folder: str, suffixes: list[str] | None = None, recursive: bool = False) -> DataFrame:
    """Files with one of the suffixes, in any case, in order of their names: path, name, length, content.

    Names are chosen when the folder is listed, so other files aren't read.  A folder that isn't there is an error.
    """
    either = lambda s: "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in s)
    kinds = ",".join(map(either, suffixes or STRICT_SUFFIXES))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", f"*.{{{kinds}}}").load(folder)
    name = F.regexp_extract("path", "([^/]*)$", 1)
    return files.select("path", name.alias("name"), "length", "content").orderBy(F.lower("name"), "path")


def load(files: DataFrame, strict: bool = True, parsers: tuple[Parser, ...] = (), unclosed: bool = True) -> DataFrame:
    """A row for each page, and one with error_type and message for each file that can't be read.

    ``files`` has path, name and content; a fetched page's path is its URL.  ``parsers`` come before the built-in ones;
    ``unclosed`` is that of ``html_text``.
    """

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for f in pdf.itertuples():
                try:
                    pages, total, extractor, title = parse(f.path, f.content, strict, parsers, unclosed)
                    rows += [(f.path, f.name, extractor, n, total, k, t, title, None, None) for k, (n, t) in enumerate(pages, 1)]
                except Exception as error:  # whatever a broken file raises is its result
                    rows.append((f.path, f.name, None, None, None, None, None, None, type(error).__name__, str(error)[:500]))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in PAGE_SCHEMA.split(", ")]).astype({"page": "Int64", "source_unit": "Int64", "total_pages": "Int64"})

    return files.select("path", "name", "content").mapInPandas(run, PAGE_SCHEMA)


def pages_of(loaded: DataFrame) -> DataFrame:
    return loaded.filter(F.col("error_type").isNull()).drop("error_type", "message")


def failures_of(loaded: DataFrame) -> DataFrame:
    return loaded.filter(F.col("error_type").isNotNull()).select("document", "error_type", "message")


def from_texts(spark: SparkSession, texts: list[str], metadata: list[dict[str, str]] | None = None) -> DataFrame:
    """(doc_id, text, metadata) from lists in memory; missing metadata are empty."""
    known = [*(metadata or []), *[{}] * len(texts)]
    return spark.createDataFrame([(k, t, known[k]) for k, t in enumerate(texts)], "doc_id long, text string, metadata map<string,string>")


def web_pages(pages: DataFrame, html: str = "html", unclosed: bool = True) -> DataFrame:
    """Adds text and title of fetched pages, by the rules for the web."""

    @F.pandas_udf("struct<text:string,title:string>")
    def read(column):
        import pandas as pd

        found = [html_text(h, True, unclosed) if isinstance(h, str) else (None, None) for h in column]
        return pd.DataFrame(found, columns=["text", "title"])

    return pages.withColumn("_r", read(F.col(html))).select(*pages.columns, "_r.*")


def is_url(text):
    return text.rlike("^https?://[^/ ]+")


def regex_text(html):
    """Text of a page by regular expressions alone (entities stay): for engines without a parser."""
    for tag in ("script", "style", "nav", "footer", "header"):
        html = F.regexp_replace(html, f"(?is)<{tag}[^>]*>.*?</{tag}>", "\n")
    html = F.regexp_replace(html, "(?s)<!--.*?-->", "")
    lines = F.regexp_replace(F.regexp_replace(html, "<[^>]*>", "\n"), r"[ \t]+", " ")
    return F.regexp_replace(F.regexp_replace(lines, r" ?\n[ \n]*", "\n"), r"^[ \n]+|[ \n]+$", "")


def regex_title(html):
    return F.regexp_extract(html, "(?is)<title>([^<]*)</title>", 1)
