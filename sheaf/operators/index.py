"""A term index as plain tables: postings, document frequencies, lengths and corpus totals."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.functions import text as T
from sheaf.operators.store import BUCKETS, Asked, IndexFormatError, Store
from sheaf.storage import spread, stored

__all__ = ["EVERY", "Index", "IndexFormatError", "Lookup", "ordered_fingerprint", "sums"]
#: The term under which a lookup lists every chunk once; no tokenizer gives an empty one.
EVERY = ""
#: The column of tokens beside those of the chunks.
TOKENS = "_sheaf_tokens"


@dataclass
class Lookup:
    """What rankers need of an index for some terms."""

    postings: DataFrame  # term, id, tf, dl
    frequencies: DataFrame  # term, df
    totals: DataFrame  # one row: n, avgdl, n_tokens
    ids: DataFrame  # id of each chunk
    asked: Asked | None = None  # how a stored index finds the terms


def sums(n: Column, n_tokens: Column) -> list[Column]:
    n, n_tokens = F.coalesce(n, F.lit(0)).cast("long"), F.coalesce(n_tokens, F.lit(0)).cast("long")
    return [n.alias("n"), F.coalesce(n_tokens / F.nullif(n, F.lit(0)), F.lit(0.0)).alias("avgdl"), n_tokens.alias("n_tokens")]


@dataclass
class Index:
    """``chunks`` has the key column ``id`` and the text; ``tokens`` one row a chunk with its tokens.

    Nothing is computed until it is asked for: postings for a handful of query terms come from one pass over the chunks
    that keeps those terms alone.  A stored index reads the partitions of those terms, and BM25 opens only the blocks of
    postings that can hold one of the best chunks; ``store`` has more on that, and the ways to change a stored index.
    """

    chunks: DataFrame
    tokens: DataFrame  # id, tokens
    stored: Store | None = None
    wide: DataFrame | None = None  # the chunks with their tokens in a column TOKENS

    @classmethod
    def build(cls, chunks: DataFrame, tokenizer=T.tokens, key: str = "doc_id", text: str = "text") -> Index:
        named = chunks.withColumnRenamed(key, "id") if key != "id" else chunks
        return cls.cut(named, tokenizer(F.col(text)))

    @classmethod
    def cut(cls, named: DataFrame, tokens: Column) -> Index:
        """The index of chunks that have an id, with the expression that gives their tokens."""
        return cls(named, spread(named).select("id", tokens.alias("tokens")), wide=named.withColumn(TOKENS, tokens))

    def postings(self, terms: DataFrame | None = None) -> DataFrame:
        """(term, id, tf, dl), of the given terms only if there are some."""
        if self.stored:
            return self.stored.postings(terms)
        wide = self.tokens.select("id", F.size("tokens").alias("dl"), F.explode("tokens").alias("term"))
        if terms is not None:
            wide = wide.join(stored(terms.select("term").distinct(), "terms"), "term", "left_semi")  # before anything is shuffled
        return wide.groupBy("term", "id").agg(F.count("*").alias("tf"), F.max("dl").alias("dl"))

    def every(self, terms: DataFrame | None = None) -> DataFrame:
        """(term, id, tf, dl, tokens): the postings, of some terms or all, and one of EVERY for each chunk, from one reading."""
        words = F.concat(F.array(F.lit(EVERY)), F.coalesce("tokens", F.array().cast("array<string>")))
        wide = self.tokens.select("id", F.coalesce(F.size("tokens"), F.lit(0)).alias("dl"), F.explode(words).alias("term"))
        if terms is not None:
            # stored, so that its size is known: Spark broadcasts few terms and shuffles for very many
            every = self.tokens.sparkSession.range(1).select(F.lit(EVERY).alias("term"))
            wide = wide.join(stored(terms.select("term").unionByName(every).distinct(), "terms"), "term", "left_semi")
        return wide.groupBy("term", "id").agg(F.count("*").alias("tf"), F.max("dl").alias("dl"), F.sum("dl").alias("tokens"))

    def lookup(self, terms: DataFrame) -> Lookup:
        """The postings of some terms, stored, and the totals, from one pass over the chunks.

        Chunks meet the terms before anything is shuffled; Spark broadcasts the terms if they are few enough.
        """
        if self.stored:
            asked, postings, frequencies = self.stored.lookup(terms)
            return Lookup(postings, frequencies, self.totals(), self.tokens.select("id"), asked)
        else:
            every = stored(self.every(terms), "postings")
            found = every.filter(F.col("term") != EVERY).drop("tokens")
            ids = every.filter(F.col("term") == EVERY).select("id")
            totals = every.filter(F.col("term") == EVERY).agg(*sums(F.sum("tf"), F.sum("tokens")))
        return Lookup(found, found.groupBy("term").agg(F.count("*").alias("df")), totals, ids)

    def totals(self) -> DataFrame:
        """One row: n chunks, average length, number of tokens."""
        if self.stored:
            return self.stored.totals()
        return self.tokens.agg(*sums(F.count("*"), F.sum(F.size("tokens"))))

    def frequencies(self) -> DataFrame:
        """(term, df); unless the index is stored, one shuffle of partial counts."""
        if self.stored:
            return self.stored.frequencies()
        return self.tokens.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))

    def lengths(self) -> DataFrame:
        return self.tokens.select("id", F.size("tokens").alias("dl"))

    def add(self, chunks: DataFrame, tokenizer=T.tokens, key: str = "doc_id", text: str = "text") -> Index:
        """The index of both; statistics follow."""
        more = Index.build(chunks, tokenizer, key, text)
        wide = self.wide.unionByName(more.wide, allowMissingColumns=True) if self.wide is not None else None
        return Index(self.chunks.unionByName(more.chunks, allowMissingColumns=True), self.tokens.unionByName(more.tokens), wide=wide)

    def clear(self) -> Index:
        """The index of nothing, with the same columns."""
        return Index(self.chunks.limit(0), self.tokens.limit(0), wide=self.wide.limit(0) if self.wide is not None else None)

    def fingerprint(self, text: str = "text") -> DataFrame:
        """One row: an order-free digest of (id, text) pairs that doesn't need the corpus in one place."""
        row = F.sha2(F.concat(F.col("id").cast("string"), F.lit("\0"), F.coalesce(F.col(text), F.lit("")), F.lit("\0")), 256)
        part = lambda at: F.sum(F.conv(F.substring(row, at, 15), 16, 10).cast("decimal(38,0)"))
        return self.chunks.agg(F.count("*").alias("n_chunks"), *[F.coalesce(part(1 + 15 * k), F.lit(0)).cast("string").alias(f"digest_{k}") for k in range(4)])

    def rows(self) -> DataFrame:
        """(id, tokens, chunk): what a store is given."""
        if self.wide is None:
            raise ValueError("the tokens of this index don't come from its chunks")
        own = [F.col(c) for c in self.wide.columns if c not in ("id", TOKENS)] or [F.lit(None).cast("string").alias("text")]
        return spread(self.wide).select("id", F.col(TOKENS).alias("tokens"), F.struct(*own).alias("chunk"))

    def save(self, path: str, buckets: int = BUCKETS) -> Store:
        """Stores the index as the next version under ``path``; readers of earlier ones aren't disturbed, and a save that stops half-way isn't seen."""
        return Store.create(self.tokens.sparkSession, path, buckets).replace(self.rows())

    @classmethod
    def load(cls, spark: SparkSession, path: str, version: int | None = None) -> Index:
        return cls.of(Store.open(spark, path, version))

    @classmethod
    def of(cls, store: Store) -> Index:
        """The index of a version of a store."""
        wide = store.docs("id", "tokens", "chunk")
        own = [F.col(f"chunk.{c}").alias(c) for c in wide.schema["chunk"].dataType.names if c != "id"]
        return cls(store.chunks(), store.docs("id", "tokens"), store, wide.select("id", *own, F.col("tokens").alias(TOKENS)))


def ordered_fingerprint(chunks: DataFrame, key: str, text: str = "text", width: int = 1024, levels: int = 4) -> DataFrame:
    """One row: an order-dependent digest of (key, text), keys being whole numbers.

    It is a tree: the digest of a run of ``width`` keys is that of its rows' digests in order, and so on for runs of runs, so
    no task gets more than a run while keys lie below width ** levels, in size.
    """
    piece = F.concat(F.col(key).cast("string"), F.lit("\0"), F.coalesce(F.col(text), F.lit("")), F.lit("\0"))
    digest = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "d"))), lambda s: s["d"]), ""), 256).alias("d")
    level = chunks.select(F.col(key).cast("long").alias("k"), F.sha2(piece, 256).alias("d"))
    for _ in range(levels):
        level = level.groupBy(F.expr(f"k div {width}").alias("run")).agg(digest).withColumnRenamed("run", "k")
    return level.agg(digest.alias("digest"))
