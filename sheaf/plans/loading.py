"""Files and fetched pages as chunks of the open profile, and an index that grows by them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.operators.chunking import TokenChunks, section_chunks
from sheaf.operators.index import Index
from sheaf.sources import files


def metadata(loaded: DataFrame) -> DataFrame:
    """(path, source_unit, text, metadata): what is known of each page as a map; unknown fields are left out."""
    fields = {
        "source_path": F.col("path"),
        "source_name": F.when(files.is_url(F.col("path")), F.col("path")).otherwise(F.col("document")),
        "extractor": F.col("extractor"),
        "title": F.col("title"),
        "page_number": F.col("page").cast("string"),
        "total_pages": F.when(F.col("page").isNotNull(), F.col("total_pages").cast("string")),
    }
    entries = F.filter(F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in fields.items()]), lambda e: e["value"].isNotNull())
    return files.pages_of(loaded).select("path", "source_unit", "text", F.map_from_entries(entries).alias("metadata"))


def cut(loaded: DataFrame, rule: TokenChunks = TokenChunks()) -> DataFrame:  # noqa: B008
    """Chunks of pages: id, path, content, metadata (with chunk_index and heading), chunk_tokens.  Files that failed have none."""
    found = section_chunks(metadata(loaded), rule)
    more = F.map_from_entries(F.filter(F.array(F.struct(F.lit("chunk_index").alias("key"), F.col("chunk_index").cast("string").alias("value")), F.struct(F.lit("heading").alias("key"), F.col("heading").alias("value"))), lambda e: e["value"].isNotNull()))
    name = F.concat_ws("#", "path", F.col("source_unit").cast("string"), F.col("chunk_index").cast("string"))
    return found.select(name.alias("id"), "path", F.col("chunk").alias("content"), F.map_concat("metadata", more).alias("metadata"), "chunk_tokens")


def extract(sources: DataFrame, rule: TokenChunks = TokenChunks(), unclosed: bool = True) -> DataFrame:  # noqa: B008
    """Chunks of sources (path, name, content): files by their suffix, fetched pages by their URL."""
    return cut(files.load(sources, strict=False, unclosed=unclosed), rule)


def load_documents(sources: DataFrame, chunk_size: int = 500, overlap: int = 50) -> DataFrame:
    """(content, metadata) of all chunks of sources (path, name, content); a source that can't be read adds none."""
    return extract(sources, TokenChunks(chunk_size, overlap)).select("content", "metadata")


def add_documents(index: Index | None, sources: DataFrame, chunk_size: int = 500, overlap: int = 50) -> tuple[Index, int]:
    """The index with the chunks of more sources, and how many those are."""
    from sheaf.storage import stored

    more = stored(extract(sources, TokenChunks(chunk_size, overlap)).withColumnRenamed("content", "text"), "chunks")
    grown = Index.build(more, key="id") if index is None else index.add(more, key="id")
    return grown, more.count()


def from_folder(spark: SparkSession, folder: str, chunk_size: int = 500, overlap: int = 50, recursive: bool = True) -> DataFrame:
    """(content, metadata) of all files of known kinds under a folder."""
    return load_documents(files.discover(spark, folder, files.SUFFIXES, recursive), chunk_size, overlap)
