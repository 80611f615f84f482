"""Question understanding: aliases, routing, intent, facets, history, query variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheaf.functions import rules
from sheaf.functions import text as T


def _alias(low: Column, name: str) -> Column:
    """ASCII names as whole words, others anywhere."""
    if name.isascii():
        import re

        return low.rlike(f"(?<![a-z0-9]){re.escape(name)}(?![a-z0-9])")
    return F.contains(low, F.lit(name))


def any_alias(low: Column, names: list[str]) -> Column:
    found = F.lit(False)
    for n in names:
        found = found | _alias(low, n)
    return found


def add_aliases(question: Column) -> Column:
    """The question with the Thai names of what it mentions in other languages."""
    low = F.lower(question)
    return F.concat_ws(" ", F.trim(question), *[F.when(any_alias(low, names), F.lit(extra)) for names, extra in rules.ALIASES])


def cross_document(low: Column) -> Column:
    return T.contains_any(low, rules.CROSS_DOCUMENT)


def preferred_document(low: Column) -> Column:
    """The document that a normalised text is about, the most specific rule first; null if none or if it spans several."""
    out = F.when(cross_document(low), F.lit(None).cast("string"))
    for document, terms, words in rules.ROUTES:
        test = T.contains_any(low, terms)
        for w in words:
            test = test | low.rlike(rf"(?U)\b{w}\b")
        out = out.when(test, document)
    return out


def plan(question: Column) -> Column:
    """Entities, ranking, comparison, teaching and recommendation as one struct."""
    low = F.lower(question)
    has = {k: T.contains_any(low, v) for k, v in rules.INTENTS.items()}
    import re

    named = F.array_compact(F.array(*[F.when(low.rlike(f"(?<![a-z0-9_]){re.escape(p[0].lower())}(?![a-z0-9_])"), F.lit(d)) for d, p in rules.PROGRAMS.items()]))
    comparison = (F.size(named) > 1) & has["comparison"]
    every = F.array(*[F.lit(d) for d in rules.PROGRAMS])
    documents = F.when(has["all_programs"], every).when(comparison, named).otherwise(F.array().cast("array<string>"))
    return F.struct(
        documents.alias("documents"),
        has["ranking"].alias("ranking"),
        comparison.alias("comparison"),
        has["teaching"].alias("teaching"),
        (comparison & has["recommendation"]).alias("recommendation"),
    )


def facets(question: Column) -> Column:
    """The facets a question asks for, in order and once each; ``unknown`` where a rule forbids or a clause asks for more."""
    low = F.lower(question)
    named = [F.when(T.contains_any(low, terms), F.lit(name)) for name, terms in rules.FACET_TERMS.items()]
    credit = F.when(F.contains(low, F.lit("หน่วยกิต")), F.when(F.contains(low, F.lit("สหกิจ")), "co_op").when(F.contains(low, F.lit("หมวดวิชาเฉพาะ")), "specialized").otherwise("credits"))
    clauses = F.split(low, r"(?U)และ|พร้อมทั้ง|\band\b|[?？;；]")
    other = F.when(F.exists(clauses, lambda c: T.contains_any(c, rules.ASKING) & ~T.contains_any(c, rules.KNOWN)), F.lit("unknown"))
    found = F.array_distinct(F.array_compact(F.array(*named, credit, other)))
    barred = low.rlike(r"(?<![0-9])[0-9]{8}(?![0-9])") | T.contains_any(low, rules.BANNED)
    return F.when(barred | (F.size(found) == 0), F.array(F.lit("unknown"))).otherwise(found)


def with_history(turns: DataFrame, messages: int = 6, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """User turns with the last ``messages`` user and assistant turns before them and the query that retrieval uses.

    The query is the last three non-blank user turns of that history, then the question, joined by line feeds.  Turns with
    other roles are left out.
    """
    before = Window.partitionBy(key).orderBy(order).rowsBetween(-messages, -1)
    said = turns.filter(F.col("role").isin("user", "assistant"))
    if messages:
        said = said.withColumn("history", F.collect_list(F.struct("role", "text")).over(before))
    else:
        said = said.withColumn("history", F.array().cast("array<struct<role:string,text:string>>"))
    own = F.transform(F.filter("history", lambda h: (h["role"] == "user") & (F.trim(h["text"]) != "")), lambda h: h["text"])
    last = F.slice(own, F.greatest(F.lit(1), F.size(own) - 2), 3)
    asked = said.filter(F.col("role") == "user")
    return asked.withColumn("retrieval_query", F.array_join(F.concat(last, F.array("text")), "\n"))


def variants(question: Column) -> Column:
    """A question, its keywords, and its clauses: distinct regardless of case, the question first."""
    words = F.slice(T.signals(question)["keywords"], 1, 10)
    keywords = F.array_join(words, " ")
    clauses = F.slice(F.filter(F.transform(F.split(question, r"(?U)และ|หรือ|\band\b|\bor\b|[?？;；]"), lambda c: F.trim(c)), lambda c: F.length(c) > 1), 1, 5)
    every = F.filter(F.concat(F.array(F.trim(question)), clauses, F.array(keywords)), lambda v: v != "")
    # keeps the first of those that differ in case only
    return F.aggregate(every, F.array().cast("array<string>"), lambda got, v: F.when(F.exists(got, lambda g: F.lower(g) == F.lower(v)), got).otherwise(F.concat(got, F.array(v))))


def guard(question: Column, most: int = 4000) -> Column:
    """Why a question can't be asked; null if it can."""
    return F.when(question.isNull() | (F.trim(question) == ""), "empty_question").when(F.length(question) > most, "question_too_long")
