"""Prompts built from ranked chunks, history and preferences, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.functions import rules
from sheaf.functions import text as T

CONTEXT, QUESTION = "{context}", "{question}"


def source_block(number: Column, document: Column, page: Column, chunk_id: Column, text: Column) -> Column:
    """A chunk between marks of its number, labelled by stored fields only."""
    head = F.concat(F.lit("[SOURCE "), number.cast("string"), F.lit("]\ndocument: "), document, F.lit("\npage: "), F.coalesce(page.cast("string"), F.lit("N/A")), F.lit("\nchunk_id: "), chunk_id.cast("string"))
    return F.concat(head, F.lit("\ncontent:\n"), text, F.lit("\n[/SOURCE "), number.cast("string"), F.lit("]"))


def contexts(hits: DataFrame) -> DataFrame:
    """(query_id, context) of hits (query_id, rank, document, page, chunk_id, text): their blocks in rank order."""
    rows = F.array_sort(F.collect_list(F.struct("rank", "document", "page", "chunk_id", "text")))
    blocks = F.transform(rows, lambda r, i: source_block(i + 1, r["document"], r["page"], r["chunk_id"], r["text"]))
    return hits.groupBy("query_id").agg(F.array_join(blocks, "\n\n").alias("context"))


def history(turns: Column) -> Column:
    """An array of (role, text) as lines; blank turns are left out."""
    bare = lambda h: F.regexp_replace(h["text"], r"(?U)^\s+|\s+\z", "")
    lines = F.transform(F.filter(turns, lambda h: bare(h) != ""), lambda h: F.concat(F.upper(h["role"]), F.lit(": "), bare(h)))
    return F.when(F.coalesce(F.size(turns), F.lit(0)) <= 0, F.lit(rules.NO_HISTORY)).otherwise(F.array_join(lines, "\n"))


def user_prompt(question: Column, context: Column, turns: Column) -> Column:
    bare = F.regexp_replace(question, r"(?U)^\s+|\s+\z", "")
    return F.concat(F.lit(rules.HISTORY_TITLE + "\n"), history(turns), F.lit("\n\nCONTEXT:\n"), F.coalesce(context, F.lit("")), F.lit("\n\nQUESTION:\n"), bare, F.lit("\n\n" + rules.USER_PROMPT_END))


def filled(template: str, context: Column, question: Column) -> Column:
    """A template with both placeholders filled in; one without them gives way to the fixed one."""
    if CONTEXT not in template or QUESTION not in template:
        template = rules.RAG_TEMPLATE
    out, rest = [], template
    while rest:
        at = min((k for k in (rest.find(CONTEXT), rest.find(QUESTION)) if k >= 0), default=len(rest))
        out.append(F.lit(rest[:at]))
        if rest.startswith(CONTEXT, at):
            out.append(context)
            rest = rest[at + len(CONTEXT) :]
        elif rest.startswith(QUESTION, at):
            out.append(question)
            rest = rest[at + len(QUESTION) :]
        else:
            rest = ""
    return F.concat(*out)


def guidance(style: str = "concise") -> str:
    """What is asked of an answer's form; it never overrides the rules about evidence."""
    return f"{rules.STYLES[style]} {rules.AUTO_LANGUAGE}{rules.PREFERENCES_END}"


def language_instruction(question: Column) -> Column:
    """Thai questions are answered once, others in Thai and in their own language."""
    language = T.detect_language(question)
    name = F.coalesce(*[F.when(language == k, F.lit(v)) for k, v in rules.LANGUAGE_NAMES.items()])
    both = F.concat(F.lit("\nREQUIRED BILINGUAL OUTPUT: a complete Thai answer under 'ภาษาไทย', then the equivalent answer in "), name, F.lit(". Both keep the same facts, numbers and qualifications; use only CONTEXT evidence."))
    return F.when(language == "th", rules.THAI_ONCE).otherwise(both)


def refusal(question: Column) -> Column:
    """The refusal in Thai and, for a question in another known language, in that."""
    language = T.detect_language(question)
    out = None
    for code, (heading, message) in rules.REFUSALS.items():
        said = f"ภาษาไทย:\n{rules.REFUSAL}\n\n{heading}:\n{message}"
        out = F.when(language == code, said) if out is None else out.when(language == code, said)
    return out.otherwise(rules.REFUSAL)


def closed_context(cases: DataFrame, chunks: DataFrame, rule: str) -> DataFrame:
    """One row, prompt: a rule, chosen chunks (document, page, text, place) and questions (id, question, history), for comparing models offline."""
    blocks = F.array_sort(F.collect_list(F.struct("place", F.concat(F.lit("[DOCUMENT: "), "document", F.lit(", PAGE: "), F.coalesce(F.col("page").cast("string"), F.lit("None")), F.lit("]\n"), "text").alias("b"))))
    said = F.array_join(F.transform("history", lambda h: F.concat(h["role"], F.lit(": "), h["text"])), " | ")
    line = F.when(F.coalesce(F.size("history"), F.lit(0)) > 0, F.concat(F.col("id"), F.lit(". HISTORY: "), said, F.lit("\nQUESTION: "), F.col("question"))).otherwise(F.concat_ws(". ", "id", "question"))
    asks = F.array_sort(F.collect_list(F.struct("id", line.alias("b"))))
    joined = lambda rows: F.array_join(F.transform(rows, lambda r: r["b"]), "\n\n")
    one = chunks.agg(joined(blocks).alias("context")).crossJoin(cases.agg(joined(asks).alias("questions")))
    return one.select(F.concat(F.lit(rule + "\n\nCONTEXT:\n"), "context", F.lit("\n\nQUESTIONS:\n"), "questions").alias("prompt"))
