"""Chunks of whole texts: by characters with exact offsets, and by tokens along headings and sentences.

Where a chunk starts depends on where the one before ended, so a text is chunked in one Python call; rows are independent.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.functions import rules
from sheaf.functions import text as T
from sheaf.storage import bound_batches

_ENDS = re.compile(r"[.!?…。！？\n]")
_SPACES = re.compile(r"\s+")
CHAR_SCHEMA = "chunk_index int, start_char int, end_char int, chunk string"


@dataclass(frozen=True)
class CharChunks:
    """``size`` characters at most, ``overlap`` at most shared with the chunk before."""

    size: int = 1000
    overlap: int = 150

    def __post_init__(self) -> None:
        if self.size <= 0:
            raise ValueError("the chunk size must be greater than 0")
        if self.overlap < 0:
            raise ValueError("the overlap must not be negative")
        if self.overlap >= self.size:
            raise ValueError("the overlap must be less than the chunk size")

    def spans(self, text: str) -> Iterator[tuple[int, int]]:
        """Start and end of each chunk, white space at either side left out.

        A chunk ends after the last sentence end in its second half, else after the last white space there, else at the
        full size.  The next starts at the first sentence end within the overlap, else at the first white space, else at the
        overlap itself, and at least one character later than the last.
        """
        breaks = [m.end() for m in _ENDS.finditer(text)], [m.end() for m in _SPACES.finditer(text)]
        total = len(text)
        solid = lambda a, b: a + len(text[a:b]) - len(text[a:b].lstrip())

        def last(low: int, high: int) -> int | None:
            for places in breaks:
                k = bisect_right(places, high)
                if k and places[k - 1] >= low:
                    return places[k - 1]
            return None

        def first(low: int, high: int) -> int | None:
            for places in breaks:
                k = bisect_left(places, low)
                if k < len(places) and places[k] <= high:
                    return places[k]
            return None

        at = solid(0, total)
        while at < total:
            stop = total
            if at + self.size < total:
                full = at + self.size
                stop = last(at + max(1, self.size // 2), full) or full
            inner = text[at:stop]
            start, end = at + len(inner) - len(inner.lstrip()), at + len(inner.rstrip())
            if start < end:
                yield start, end
            if stop == total:
                return
            if self.overlap:
                floor = max(at + 1, stop - self.overlap)
                found = first(floor, stop - 1)
                follow = floor if found is None else solid(found, stop)
            else:
                follow = solid(stop, total)
            at = max(follow, at + 1)


def char_chunks(pages: DataFrame, size: int = 1000, overlap: int = 150, text: str = "text") -> DataFrame:
    """The rows of ``pages`` with chunk_index (from 1), start_char, end_char (exclusive) and chunk; blank texts have none."""
    rule = CharChunks(size, overlap)

    @F.pandas_udf(f"array<struct<{', '.join(':'.join(c.split()) for c in CHAR_SCHEMA.split(', '))}>>")
    def cut(texts):
        import pandas as pd

        return pd.Series([[(k, a, b, t[a:b]) for k, (a, b) in enumerate(rule.spans(t), 1)] if isinstance(t, str) else [] for t in texts])

    bound_batches(pages.sparkSession)
    return pages.withColumn("_c", F.explode(cut(F.col(text)))).select(*[c for c in pages.columns if c != text], "_c.*")


def page_chunks(pages: DataFrame, size: int = 1000, overlap: int = 150) -> DataFrame:
    """Chunks of (document, page, source_unit, text) with ids like ``name_p3_c01``; page null where there are none."""
    from pyspark.sql import Window

    @F.pandas_udf("string")
    def key(names):
        return names.map(T.document_key, na_action="ignore")

    keyed = pages.withColumn("units", F.count("*").over(Window.partitionBy("document"))).withColumn("document_key", key(F.col("document")))
    found = char_chunks(keyed, size, overlap)
    name = F.concat_ws("_", "document_key", T.page_key(F.col("page"), F.col("source_unit"), F.col("units")), F.concat(F.lit("c"), F.when(F.col("chunk_index") < 10, F.concat(F.lit("0"), F.col("chunk_index").cast("string"))).otherwise(F.col("chunk_index").cast("string"))))
    return found.select(name.alias("chunk_id"), F.col("chunk").alias("text"), "document", "page", "chunk_index", "start_char", "end_char")


_HEADING = re.compile("|".join(rules.HEADINGS), re.M)
_TOKEN = re.compile(T.OPEN_WORD)
_END = re.compile(r"[.!?。？！ฯ]+")


def join_tokens(words: list[str]) -> str:
    """Tokens with a space only where Latin letters or digits would meet."""
    return re.sub(r"(?<=[a-zA-Z0-9])\0(?=[a-zA-Z0-9])", " ", "\0".join(words)).replace("\0", "")


def split_sentences(text: str) -> list[str]:
    """Sentences with their marks.  One of fewer than 10 characters joins the one before, if that has no full stop."""
    cuts = [0, *[m.end() for m in _END.finditer(text)], len(text)]
    out: list[str] = []
    for a, b in zip(cuts, cuts[1:], strict=False):
        part = text[a:b].strip()
        if not part:
            continue
        if out and len(part) < 10 and out[-1][-1] not in ".!?":
            out[-1] += " " + part
        else:
            out.append(part)
    return out or [text]


def heading_level(heading: str) -> int:
    """1 to 6 by the number of #; an underline of = is 1, of - is 2; bullets are 3, all numbered kinds 2."""
    marks = re.match(r"#+", heading)
    if marks:
        return len(marks[0])
    if "\n" in heading and re.search(r"\n[-=]{3,}$", heading):
        return 1 if "=" in heading else 2
    if heading[:1] in "➤▶◆●■►▪":
        return 3
    numbered = re.match(r"\d+[.)]\s|[ก-ฮ]\.\s|\([ก-ฮ]\)\s", heading) or any(w in heading for w in ("หัวข้อ", "บทที่", "ส่วนที่", "มาตรา", "ข้อ"))
    return 2 if numbered else 3


@dataclass(frozen=True)
class TokenChunks:
    """Chunks of ``size`` tokens along sentences (``mode`` "sentences"), headings ("adaptive") or neither ("tokens").

    Text before the first heading is a section of its own; ``legacy`` drops it, as does a chunk overlap of 0 that
    repeats the whole chunk before.
    """

    size: int = 500
    overlap: int = 50
    least: int = 50
    mode: str = "adaptive"
    legacy: bool = False

    def __post_init__(self) -> None:
        if self.size <= 0 or not 0 <= self.overlap < self.size:
            raise ValueError("the overlap must be at least 0 and less than the chunk size")
        if self.mode not in ("adaptive", "sentences", "tokens"):
            raise ValueError("mode must be adaptive, sentences or tokens")

    def windows(self, words: list[str]) -> list[str]:
        return [join_tokens(words[k : k + self.size]) for k in range(0, len(words), self.size - self.overlap)]

    def tail(self, text: str) -> str:
        words = _TOKEN.findall(text)
        keep = len(words) if not self.overlap and self.legacy else self.overlap
        return join_tokens(words[max(0, len(words) - keep) :])

    def pack(self, sentences: list[str]) -> Iterator[str]:
        """Sentences together up to the size; a longer one becomes windows; each new chunk starts with the end of the last."""
        held, count = "", 0
        for s in sentences:
            n = len(_TOKEN.findall(s))
            if n > self.size:
                if held:
                    yield held
                yield from self.windows(_TOKEN.findall(s))
                held, count = "", 0
            elif held and count + n > self.size:
                yield held
                held = f"{self.tail(held)} {s}"
                count = len(_TOKEN.findall(held))
            else:
                held = f"{held} {s}".strip() if held else s
                count += n
        if held:
            yield held

    def sections(self, text: str) -> Iterator[tuple[str | None, int | None, str]]:
        """Heading, its level, and the section with its heading."""
        found = list(_HEADING.finditer(text))
        if not found:
            yield None, None, text
            return
        if not self.legacy and text[: found[0].start()].strip():
            yield None, None, text[: found[0].start()].strip()
        for m, stop in zip(found, [m.start() for m in found[1:]] + [len(text)], strict=True):
            part = text[m.start() : stop].strip()
            if part:
                yield m[0].strip(), heading_level(m[0]), part

    def chunks(self, text: str | None) -> list[tuple[int, int, str | None, int | None, str]]:
        """(chunk_index, chunk_tokens, heading, heading_level, chunk); the heading with a section's first chunk only."""
        if not text or not text.strip():
            return []
        words = _TOKEN.findall(text)
        if len(words) <= self.size:
            return [(0, len(words), None, None, text.strip())]
        if self.mode == "tokens":
            parts = [(None, None, w) for w in self.windows(words)]
        elif self.mode == "sentences":
            parts = [(None, None, p) for p in self.pack(split_sentences(text))]
        else:
            parts = []
            for heading, level, section in self.sections(text):
                for k, p in enumerate(self.pack(split_sentences(section))):
                    parts.append((heading, level, p) if k == 0 else (None, None, p))
        out = [(k, len(_TOKEN.findall(p)), h, v, p.strip()) for k, (h, v, p) in enumerate(parts)]
        return [c for c in out if c[1] >= self.least]


def section_chunks(documents: DataFrame, rule: TokenChunks = TokenChunks(), text: str = "text") -> DataFrame:  # noqa: B008
    """The rows of ``documents`` with their chunks instead of the text."""

    @F.pandas_udf("array<struct<chunk_index:int,chunk_tokens:int,heading:string,heading_level:int,chunk:string>>")
    def cut(texts):
        import pandas as pd

        return pd.Series([rule.chunks(t if isinstance(t, str) else None) for t in texts])

    bound_batches(documents.sparkSession)
    return documents.withColumn("_c", F.explode(cut(F.col(text)))).select(*[c for c in documents.columns if c != text], "_c.*")


def register(spark: SparkSession) -> None:
    """SQL table functions char_chunks(text, size, overlap) and section_chunks(text, size, overlap) for LATERAL joins."""

    @F.udtf(returnType=CHAR_SCHEMA)
    class Chars:
        def eval(self, text: str, size: int, overlap: int):
            for k, (a, b) in enumerate(CharChunks(size, overlap).spans(text or ""), 1):
                yield k, a, b, text[a:b]

    @F.udtf(returnType="chunk_index int, chunk_tokens int, heading string, heading_level int, chunk string")
    class Sections:
        def eval(self, text: str, size: int, overlap: int):
            yield from TokenChunks(size, overlap, 1).chunks(text)

    spark.udtf.register("char_chunks", Chars)
    spark.udtf.register("section_chunks", Sections)
