"""Query enhancement: a provider's reply, or rules where it has none, parsed into variants of a question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.functions import rules
from sheaf.functions import text as T


def keywords(question: Column) -> Column:
    """The first ten words that aren't question words, joined by spaces: runs of Thai or of Latin letters, of two characters at least."""
    words = F.regexp_extract_all(F.lower(question), F.lit(r"[฀-๿]+|[a-zA-Z]+"), F.lit(0))
    return F.array_join(F.slice(F.filter(words, lambda w: ~w.isin(rules.ENHANCER_STOP_WORDS) & (F.length(w) > 1)), 1, 10), " ")


def parts(question: Column) -> Column:
    """Up to five sub-questions: what stands between question marks and conjunctions, each with a mark; else the question itself."""
    cut = F.split(question, r"(?U)\?|\s+(?:" + "|".join(rules.CONJUNCTIONS) + r")\s+")
    found = F.filter(F.transform(cut, lambda p: F.trim(F.regexp_replace(p, r"(?U)^\s+|\s+\z", ""))), lambda p: p != "")
    return F.when(F.size(found) == 0, F.array(question)).otherwise(F.slice(F.transform(found, lambda p: F.concat(p, F.lit("?"))), 1, 5))


def fallback(question: Column) -> Column:
    """The reply that rules give in a provider's place."""
    return F.concat(F.lit("1. "), question, F.lit(f" {rules.EXPAND_MORE}\n2. "), F.array_join(parts(question), " | "), F.lit("\n3. "), keywords(question))


def parse(reply: Column, question: Column) -> Column:
    """(original, expanded, decomposed, keyword_focused, all_variants) from a reply's lines, the last of each kind; rules fill in."""
    bare = lambda v: F.regexp_replace(v, r"(?U)^\s+|\s+\z", "")
    lines = F.filter(F.transform(F.split(F.coalesce(reply, F.lit("")), "\n"), bare), lambda v: v != "")
    lines = F.transform(lines, lambda v: F.regexp_replace(v, r"^[0-9]+[.)]\s*", ""))
    told = lambda kind: lambda v: T.contains_any(F.lower(v), rules.REPLY_LINES[kind])
    last = lambda test: F.try_element_at(F.filter(lines, test), F.lit(-1))
    expanded = last(told("expanded"))
    split = last(lambda v: told("decomposed")(v) & ~told("expanded")(v))
    words = last(lambda v: told("keywords")(v) & ~told("decomposed")(v) & ~told("expanded")(v))
    pieces = F.filter(F.transform(F.split(split, rules.REPLY_SEPARATORS), bare), lambda v: v != "")
    expanded, decomposed, words = F.coalesce(expanded, question), F.coalesce(pieces, F.array(question)), F.coalesce(words, keywords(question))
    every = F.concat(F.array(question, expanded, words), decomposed)
    return F.struct(question.alias("original"), expanded.alias("expanded"), decomposed.alias("decomposed"), words.alias("keyword_focused"), distinct(every).alias("all_variants"))


def distinct(variants: Column) -> Column:
    """The first of those that differ in case or outer white space only; blank ones are left out."""
    key = lambda v: F.lower(F.regexp_replace(v, r"(?U)^\s+|\s+\z", ""))
    return F.aggregate(variants, F.array().cast("array<string>"), lambda got, v: F.when((key(v) == "") | F.exists(got, lambda g: key(g) == key(v)), got).otherwise(F.concat(got, F.array(v))))


def enhance(asked: DataFrame, provider=None, template: str = "{user_query}", enabled: bool = True) -> DataFrame:
    """(query_id, original, expanded, decomposed, keyword_focused, all_variants, provider_error) of (query_id, question).

    Without a provider, or where it fails, its reply is that of the rules.  Not enabled, a question is its only variant.
    """
    from sheaf.plans.provider import ask

    question = F.col("question")
    if not enabled:
        read = F.struct(question.alias("original"), question.alias("expanded"), F.array(question).alias("decomposed"), keywords(question).alias("keyword_focused"), F.array(question).alias("all_variants"))
        return asked.select("query_id", read.alias("r"), F.lit(None).cast("string").alias("provider_error")).select("query_id", "r.*", "provider_error")
    said = asked.select("query_id", "question")
    if provider is None:
        said = said.withColumns({"raw": F.lit(None).cast("string"), "provider_error": F.lit(None).cast("string")})
    else:
        before, _, after = template.partition("{user_query}")
        prompts = said.select("query_id", F.lit(rules.ENHANCER_SYSTEM).alias("system"), F.concat(F.lit(before), question, F.lit(after)).alias("user"))
        said = said.join(ask(prompts, provider), "query_id", "left")
    reply = F.coalesce(F.regexp_replace("raw", r"(?U)^\s+|\s+\z", ""), fallback(question))
    return said.select("query_id", parse(reply, question).alias("r"), "provider_error").select("query_id", "r.*", "provider_error")
