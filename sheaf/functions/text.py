"""Column functions over text.  All but ``normalize`` and ``casefold`` are Spark's own expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from sheaf.functions import rules
from sheaf.storage import bound_batches

OPEN_WORD = r"[฀-๿]+|[a-zA-Z0-9]+"
LONG_WORD = r"[\u0e00-\u0e7f]{2,}|[a-z0-9]{2,}"
STRICT_WORD = r"[a-z0-9]+|[฀-๿]+"


def normalize_text(text: str) -> str:
    """NFC (not NFKC, which would split Thai vowels), case folded, white space runs made one space."""
    return " ".join(unicodedata.normalize("NFC", text).casefold().split())


def normalize(text: Column) -> Column:
    """``normalize_text`` of a column; Spark has no NFC or case folding of its own.  Null stays null."""

    @F.pandas_udf("string")
    def run(texts):
        import pandas as pd  # noqa: F401

        return texts.map(normalize_text, na_action="ignore")

    bound_batches(SparkSession.active())
    return run(text)


def contains_any(text: Column, terms: list[str]) -> Column:
    """Whether at least one of the terms is a substring."""
    found = F.lit(False)
    for t in terms:
        found = found | F.contains(text, F.lit(t))
    return found


def tokens(text: Column) -> Column:
    """Words of the open profile: lower case, runs of Thai or of Latin letters and digits, of two characters at least."""
    return F.regexp_extract_all(F.coalesce(F.lower(text), F.lit("")), F.lit(LONG_WORD), F.lit(0))


def cased_tokens(text: Column) -> Column:
    """Tokens by which chunks are measured: the same runs in their own case, single characters too."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(OPEN_WORD), F.lit(0))


def ngrams(text: Column, n: int) -> Column:
    """Character n-grams in order; none for a shorter text."""
    places = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.substring(text, i, F.lit(n)))


def strict_tokens(normalized: Column) -> Column:
    """Terms of the strict profile from normalised text: Latin runs and Thai runs without stop words, and the 2- and 3-grams of Thai runs."""
    none = F.array().cast("array<string>")

    def terms(run: Column) -> Column:
        latin = F.when(run.isin(rules.ENGLISH_STOP_WORDS), none).otherwise(F.array(run))
        thai = F.concat(F.when(run.isin(rules.THAI_STOP_WORDS), none).otherwise(F.array(run)), ngrams(run, 2), ngrams(run, 3))
        return F.when(run.rlike("^[a-z0-9]"), latin).otherwise(thai)

    return F.flatten(F.transform(F.regexp_extract_all(F.coalesce(normalized, F.lit("")), F.lit(STRICT_WORD), F.lit(0)), terms))


def clean(text: Column) -> Column:
    """Line ends made line feeds, each line stripped at its right, the whole stripped."""
    lines = F.regexp_replace(text, r"\r\n?", "\n")
    return F.regexp_replace(F.regexp_replace(lines, r"(?U)[\s&&[^\n]]+(?=\n|\z)", ""), r"(?U)^\s+|\s+\z", "")


def folded(text: Column) -> Column:
    """For matching only: lower case without private-use characters, Thai vowels and marks, and white space."""
    return F.regexp_replace(F.lower(text), r"(?U)[\x{E000}-\x{F8FF}\x{0E30}-\x{0E3A}\x{0E40}-\x{0E4E}\s]", "")


def compact(text: Column) -> Column:
    """Lower case without white space."""
    return F.lower(F.regexp_replace(text, r"(?U)\s+", ""))


def detect_language(text: Column) -> Column:
    """By script, in this order: Japanese kana, Hangul, Han, Thai, Latin; Thai if none."""
    return (
        F.when(text.rlike(r"[぀-ヿ]"), "ja")
        .when(text.rlike(r"[가-힯]"), "ko")
        .when(text.rlike(r"[㐀-鿿]"), "zh")
        .when(text.rlike(r"[฀-๿]"), "th")
        .when(text.rlike("[A-Za-z]"), "en")
        .otherwise("th")
    )


def question_type(text: Column) -> Column:
    low, kind = F.lower(text), None
    for name, terms in rules.QUESTION_TYPES:
        kind = F.when(contains_any(low, terms), name) if kind is None else kind.when(contains_any(low, terms), name)
    return kind.otherwise("general")


def signals(text: Column) -> dict[str, Column]:
    """What the open profile reads from a question: tokens, keywords, phrases, numbers, dates, names, English terms."""
    every = lambda pattern: F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    quoted = every("\"[^\"]+\"|“[^”]+”|'[^']+'")
    words = tokens(text)
    return {
        "tokens": words,
        "keywords": F.filter(words, lambda t: ~t.isin(rules.OPEN_STOP_WORDS)),
        "phrases": F.transform(quoted, lambda p: F.substring(p, F.lit(2), F.length(p) - 2)),
        "numbers": every(rules.NUMBER),
        "dates": every(rules.DATE),
        "names": every(rules.NAME),
        "english_terms": every(rules.ENGLISH),
        "thai_numbers": every(rules.THAI_NUMBER),
        "question_type": question_type(text),
    }


def sentences(text: Column) -> Column:
    """Sentences with their end marks; the rest of the text is the last one."""
    parts = F.regexp_extract_all(text, F.lit(r"[^.!?。？！ฯ]*[.!?。？！ฯ]+|[^.!?。？！ฯ]+\z"), F.lit(0))
    return F.filter(F.transform(parts, lambda p: F.regexp_replace(p, r"(?U)^\s+|\s+\z", "")), lambda p: p != "")


def smart_join(words: Column) -> Column:
    """Words joined with a space only between two that meet in Latin letters or digits."""
    marked = F.regexp_replace(F.array_join(words, "\0"), r"(?<=[a-zA-Z0-9])\x00(?=[a-zA-Z0-9])", " ")
    return F.replace(marked, F.lit("\0"), F.lit(""))


def token_windows(words: Column, size: int, overlap: int) -> Column:
    """Windows of ``size`` tokens, each starting ``size - overlap`` after the one before."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and less than size")
    starts = F.when(F.size(words) > 0, F.sequence(F.lit(0), F.size(words) - 1, F.lit(size - overlap))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.slice(words, i + 1, size))


def document_key(name: str) -> str:
    """A file name's stem as an identifier: NFKC, letters and digits kept, all else one underscore."""
    import os
    import re

    stem = unicodedata.normalize("NFKC", os.path.splitext(os.path.basename(name))[0])
    return re.sub(r"[\W_]+", "_", stem).strip("_") or "document"


def page_key(page: Column, unit: Column, units: Column) -> Column:
    """p<page>, or pna for documents without pages, numbered if they have several units."""
    return F.when(page.isNotNull(), F.concat(F.lit("p"), page.cast("string"))).when(units > 1, F.concat(F.lit("pna_u"), F.lpad(unit.cast("string"), 2, "0"))).otherwise("pna")


def redact(text: Column, secret: str | None) -> Column:
    return F.replace(text, F.lit(secret), F.lit("[REDACTED]")) if secret else text


def hide_source_markers(text: Column) -> Column:
    """Drops [SOURCE n] marks and the spaces they leave."""
    bare = F.regexp_replace(text, r"(?i)[ \t]*\[\s*SOURCE\s+\d+\s*\]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"[ \t]+(?=\n)", ""), " {2,}", " "))


def confidence_band(confidence: Column) -> Column:
    return F.when(confidence >= 0.7, "high").when(confidence >= 0.4, "medium").otherwise("low")
