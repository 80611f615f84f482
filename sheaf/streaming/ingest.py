"""Incremental ingestion and running statistics with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sheaf.functions import text as T
from sheaf.operators.index import EVERY, Index, sums
from sheaf.operators.store import Store
from sheaf.storage import stored


def is_folder(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory()


def table_stream(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table's files as a stream."""
    path = f"{sf_dir}/{table}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    return reader.parquet(path) if is_folder(spark, path) else reader.option("pathGlobFilter", f"{table}.parquet").parquet(sf_dir)


def ingest(stream: DataFrame, path: str, key: str = "doc_id", text: str = "text", tokenizer=T.tokens) -> None:
    """Appends the postings of new chunks to an index under ``path`` until the stream has no more at hand.

    A batch's postings lie in a folder of its number, which a repeated batch overwrites, so each chunk counts once.
    Frequencies and totals are sums over the folders.
    """

    def add(batch: DataFrame, number: int) -> None:
        found = Index.build(batch, tokenizer, key, text).every()
        where = f"{path}/every/batch={number}"
        found.write.mode("overwrite").parquet(where)
        found = batch.sparkSession.read.parquet(where)
        found.filter(F.col("term") != EVERY).drop("tokens").write.mode("overwrite").parquet(f"{path}/postings/batch={number}")
        found.filter(F.col("term") == EVERY).agg(*sums(F.sum("tf"), F.sum("tokens"))).select("n", "n_tokens").write.mode("overwrite").parquet(f"{path}/totals/batch={number}")

    stream.writeStream.foreachBatch(add).option("checkpointLocation", f"{path}/_checkpoint").trigger(availableNow=True).start().awaitTermination()


def ingest_changes(stream: DataFrame, path: str, key: str = "doc_id", text: str = "text", order: str = "at", tokenizer: Callable[[Column], Column] = T.tokens) -> Store:
    """Applies a stream of changes to the store under ``path`` until it has no more at hand, and returns the last version.

    A row sets the chunk of its key, or takes it out where its text is null; of several for one key in a batch the last by
    ``order`` counts.  A batch becomes one version, and a batch that is repeated after a failure none.  Only keys are shuffled, and the
    rows of those that come more than once.
    """

    def apply(batch: DataFrame, number: int) -> None:
        last = Window.partitionBy(key).orderBy(F.col(order).desc(), F.col(text).desc())
        often = stored(batch.groupBy(key).count().filter("count > 1").select(F.col(key).alias("_key")), "repeated")
        now = batch.drop(order)
        if not often.isEmpty():
            same = F.col(key).eqNullSafe(F.col("_key"))
            some = batch.join(often, same, "left_semi").withColumn("_last", F.row_number().over(last)).filter("_last = 1").drop("_last", order)
            now = batch.join(often, same, "left_anti").drop(order).unionByName(stored(some, "changes"))
        named = now.withColumnRenamed(key, "id") if key != "id" else now
        kept = named.filter(F.col(text).isNotNull())
        Store.create(batch.sparkSession, path).apply(Index.cut(kept, tokenizer(F.col(text))).rows(), named.filter(F.col(text).isNull()).select("id"), f"{path}/_changes", number)

    stream.writeStream.foreachBatch(apply).option("checkpointLocation", f"{path}/_changes").trigger(availableNow=True).start().awaitTermination()
    return Store.create(stream.sparkSession, path)


def totals(spark: SparkSession, path: str) -> DataFrame:
    """One row: chunks, tokens, average length, terms."""
    sums = spark.read.parquet(f"{path}/totals").agg(F.sum("n").alias("n"), F.sum("n_tokens").alias("n_tokens"))
    terms = spark.read.parquet(f"{path}/postings").agg(F.count_distinct("term").alias("n_terms"))
    return sums.crossJoin(terms).select("n", "n_tokens", "n_terms", F.round(F.col("n_tokens") / F.col("n"), 6).alias("avgdl"))


def complete(result: DataFrame, folder: str) -> DataFrame:
    """An aggregate of all rows at hand, as a table in the folder that each batch writes anew; nothing passes through the driver."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/result")

    result.sparkSession.createDataFrame([], result.schema).write.mode("ignore").parquet(f"{folder}/result")  # there may be no batch
    query = result.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{folder}/_checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return result.sparkSession.read.schema(result.schema).parquet(f"{folder}/result")


def running_stats(stream: DataFrame, key: str = "event_type", value: str = "value") -> DataFrame:
    """Counts and averages by key."""
    return stream.groupBy(key).agg(F.count("*").alias("n"), F.count(value).alias("n_values"), F.round(F.avg(value), 6).alias("avg_value"))


def windowed_counts(stream: DataFrame, time: str = "ts", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by window and event type; rows later than ``late`` are left out where windows are closed (in append mode)."""
    timed = stream.withColumn(time, F.col(time).cast("timestamp"))
    return timed.withWatermark(time, late).groupBy(F.window(time, width), "event_type").agg(F.count("*").alias("n"))
