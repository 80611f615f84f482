"""Reports as DataFrames: rows for what was read, cut, indexed, found and scored, and JSON for each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.operators.index import Index
from sheaf.sources import files

#: Failures that a report of one row shows; it always counts all.
SHOWN = 100


def without_text(rows: DataFrame, include_text: bool, *names: str) -> DataFrame:
    """The rows as they are, or without their long columns."""
    return rows if include_text else rows.drop(*(names or ("text",)))


def as_json(rows: DataFrame) -> DataFrame:
    """(json) of each row; null fields are kept."""
    return rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("json"))


def documents(loaded: DataFrame, include_text: bool = False) -> DataFrame:
    """A row for each page that ``files.load`` read: document, page, extractor, characters."""
    rows = files.pages_of(loaded).withColumn("n_chars", F.length("text").cast("long"))
    return without_text(rows, include_text)


def document_summary(loaded: DataFrame) -> DataFrame:
    """A row for each file: pages, characters and the error, if it couldn't be read."""
    return loaded.groupBy("document").agg(F.count("text").alias("pages"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n_chars"), F.max("error_type").alias("error_type"), F.max("message").alias("message"))


def chunks(cut: DataFrame, include_text: bool = False) -> DataFrame:
    return without_text(cut.withColumn("n_chars", F.length("text").cast("long")), include_text)


def index(own: Index, failures: DataFrame | None = None) -> DataFrame:
    """One row: what an index holds, its fingerprint, and what couldn't be read (all counted, the first shown)."""
    held = own.totals().select("n", "n_tokens", F.round("avgdl", 6).alias("avgdl")).crossJoin(own.fingerprint())
    documents_ = own.chunks.agg((F.count_distinct("document") if "document" in own.chunks.columns else F.count_distinct("id")).alias("n_documents"))
    out = held.crossJoin(documents_)
    if failures is None:
        return out.withColumns({"n_errors": F.lit(0).cast("long"), "errors": F.array().cast("array<struct<document:string,error_type:string,message:string>>")})
    shown = failures.orderBy("document").limit(SHOWN).agg(F.array_sort(F.collect_list(F.struct("document", "error_type", "message"))).alias("errors"))
    return out.crossJoin(failures.agg(F.count("*").alias("n_errors"))).crossJoin(shown)


def search(hits: DataFrame, include_text: bool = False) -> DataFrame:
    """(query_id, result_count, results) of hits with a rank; results are in its order."""
    kept = without_text(hits, include_text)
    names = ["rank", *[c for c in kept.columns if c not in ("query_id", "rank")]]
    return kept.groupBy("query_id").agg(F.count("*").alias("result_count"), F.array_sort(F.collect_list(F.struct(*names))).alias("results"))


def benchmark(scored: DataFrame, path: str, system: str, rule: str) -> None:
    """Writes a benchmark's results as JSON lines, and one line with the totals."""
    from sheaf.operators.evaluate import summary

    scored.write.mode("overwrite").json(f"{path}/results")
    head = summary(scored).select(F.current_timestamp().cast("string").alias("generated_at"), F.lit(system).alias("system"), F.lit(rule).alias("rule"), F.struct("*").alias("summary"))
    head.coalesce(1).write.mode("overwrite").json(f"{path}/summary")
