"""Bounded samples of labelled documents, for fitting classifiers on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Texts of more characters aren't used for fitting (they are scored, whole, like any other).
MAX_CHARS = 100_000


def remainder(doc_id: str, modulus: int) -> Column:
    """crc32 of the decimal doc_id modulo ``modulus``; null for a null doc_id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus


def sample(documents: DataFrame, labels: DataFrame, label: str, usable: Column, per_class: int, max_chars: int = MAX_CHARS) -> tuple[list[str], list[int]]:
    """Texts and 0/1 labels of at most ``per_class`` documents of each class.

    ``usable`` is a condition on doc_id.  Those with the least hash of doc_id are taken, so the sample is the same in
    every run and doesn't follow the order of rows.  At most 2 * per_class ids are broadcast.  Rows with a null id or
    label are left out; of a doc_id that is labelled both ways the label is 1, of one with several texts the least is used.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("y")).filter(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & usable)
    known = known.groupBy("doc_id").agg(F.max("y").alias("y")).withColumn("_at", F.xxhash64("doc_id"))
    classes = [known.filter(F.col("y") == y).orderBy("_at", "doc_id").limit(per_class) for y in (0, 1)]
    chosen = classes[0].unionByName(classes[1])
    rows = (
        documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
        .filter(F.length("text") <= max_chars)
        .join(F.broadcast(chosen), "doc_id")
        .groupBy("_at", "doc_id", "y")
        .agg(F.min("text").alias("text"))
        .collect()
    )
    rows.sort(key=lambda r: (r["_at"], r["doc_id"]))
    return [r["text"] for r in rows], [r["y"] for r in rows]
