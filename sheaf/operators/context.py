"""What happens between ranking and answering: gates, packing, deduplication, citations, conflicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gate(hits: DataFrame, threshold: float = 1.0, least: float = 1.0, factor: float = 3.0) -> DataFrame:
    """(query_id, top_score, passed, confidence) of the open profile; the BM25 family's threshold is 1.0, cosine's 0.7 (least 0.1, factor 2).

    Confidence isn't continuous: just below the threshold it is near 1, at it a third (half, for cosine).
    """
    best = hits.groupBy("query_id").agg(F.max_by("score", -F.col("rank")).alias("top_score"))
    passed = F.col("top_score") >= threshold
    high = F.least(F.col("top_score") / max(threshold * factor, least), F.lit(1.0))
    low = F.col("top_score") / max(threshold, least)
    confidence = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(passed, high).otherwise(low)))
    return best.select("query_id", "top_score", passed.alias("passed"), F.round(confidence, 6).alias("confidence"))


def strict_gate(hits: DataFrame, threshold: float = 0.35, strict: bool = False) -> DataFrame:
    """Hits of sufficient confidence; the strict mode asks for 0.55 at least, the other for none."""
    return hits.filter(F.col("confidence") >= max(threshold, 0.55)) if strict else hits


def first_source(*names: str) -> Column:
    """The first of the columns that isn't null or empty."""
    return F.coalesce(*[F.nullif(F.col(n), F.lit("")) for n in names], F.lit("Unknown"))


def block(source: Column, page: Column, chunk: Column, heading: Column, content: Column) -> Column:
    """A chunk as the model sees it."""
    line = lambda label, v: F.when(v.isNotNull(), F.concat(F.lit(f"[{label}] "), v.cast("string"), F.lit("\n"))).otherwise("")
    return F.concat(F.lit("[เอกสารที่พบ]\n[DOCUMENT] "), source, F.lit("\n"), line("PAGE", page), line("CHUNK", chunk), line("HEADING", F.nullif(heading, F.lit(""))), F.lit("[CONTENT]\n"), content, F.lit("\n[/เอกสารที่พบ]"))


def pack(hits: DataFrame, most: int = 4000, text: str = "block") -> DataFrame:
    """The hits of each query, in rank order, up to the first whose block would pass ``most`` characters."""
    run = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return hits.withColumn("used", F.sum(F.length(text)).over(run)).filter(F.col("used") <= most)


def context(packed: DataFrame, text: str = "block") -> DataFrame:
    """(query_id, context): packed blocks joined by blank lines in rank order."""
    parts = F.array_sort(F.collect_list(F.struct("rank", F.col(text).alias("b"))))
    return packed.groupBy("query_id").agg(F.array_join(F.transform(parts, lambda p: p["b"]), "\n\n").alias("context"))


def first_of(hits: DataFrame, *keys: Column | str, order: tuple[str, ...] = ("rank",)) -> DataFrame:
    """The first hit of each query for each key (a source and page, the first 200 characters, ...)."""
    w = Window.partitionBy("query_id", *keys).orderBy(*order)
    return hits.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def citations(hits: DataFrame) -> DataFrame:
    """(query_id, document, page, chunk_ids): a citation for each document and page, its chunks in rank order."""
    ids = F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))), lambda s: s["chunk_id"])
    return hits.groupBy("query_id", "document", "page").agg(F.min("rank").alias("first_rank"), ids.alias("chunk_ids"))


def conflicts(facts: DataFrame, *keys: str) -> DataFrame:
    """For each key the distinct values that aren't null, in order, and whether there is more than one."""
    return facts.groupBy(*keys).agg(F.array_sort(F.collect_set("value")).alias("values")).withColumn("conflict", F.size("values") > 1)


def rank_facts(facts: DataFrame, by: tuple[str, ...], subject: str) -> DataFrame:
    """Subjects in descending order of their value; those with no value or with several come last."""
    found = conflicts(facts, *by, subject)
    value = F.when(F.size("values") == 1, F.element_at("values", 1).cast("long"))
    w = Window.partitionBy(*by).orderBy((F.size("values") != 1).asc(), value.desc_nulls_last(), subject)
    return found.withColumn("number", value).withColumn("place", F.row_number().over(w))


def bounds(quotes: DataFrame, most_chars: int = 24_000, most_rows: int = 80) -> DataFrame:
    """Whether all quotes of a query fit; if not, none is used."""
    found = quotes.groupBy("query_id").agg(F.sum(F.length("quote")).cast("long").alias("chars"), F.count("*").alias("rows"))
    return found.withColumn("fits", (F.col("chars") <= most_chars) & (F.col("rows") <= most_rows))


def diverse(hits: DataFrame, top_k: int, document: str = "document") -> DataFrame:
    """One hit of each document first, then the others, up to top_k of each query."""
    per = Window.partitionBy("query_id", document).orderBy("rank")
    every = Window.partitionBy("query_id").orderBy(F.col("_turn") > 1, "rank")
    return hits.withColumn("_turn", F.row_number().over(per)).withColumn("place", F.row_number().over(every)).filter(F.col("place") <= top_k).drop("_turn")


def merge_variants(hits: DataFrame, top_k: int = 5, text: str = "text") -> DataFrame:
    """Hits of several variants of a query: of those that start with the same 200 characters the first variant's stays."""
    kept = first_of(hits, F.substring(F.col(text), 1, 200), order=("variant", "rank"))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "variant", "rank")
    return kept.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top_k)
