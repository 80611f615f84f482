"""Benchmark decontamination, in DataFrame operations alone.

The benchmark's windows (10 consecutive normalised words; a shorter item is one window) are hashed into a set that is
broadcast.  Every document is cut into words once, the words are hashed, and the hash of each of its windows probes the
set; hits are verified word by word inside the join, so a hash collision is no hit.  Unverified windows never leave the
scan: documents are shuffled neither for the search nor for the result, only hits and one row a document are.  The set holds
each window once; which items it is of is looked up later, for the windows that were found.

The set has a size bound, ``MAX_WINDOWS`` and ``MAX_BYTES``; a larger benchmark is searched in blocks of about that size.

A null or empty text has no words and is clean.  Each input row gives one row, repeated rows too.  An item without words
has no window; an item with a null item_id marks words but is neither counted nor listed; repeated items count once.
Other columns are passed on by ``decontaminate`` and not read otherwise.  An empty benchmark leaves all documents clean.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.llm import shared

WINDOW = 10
#: Windows of a broadcast set and bytes of their texts, on average over blocks.
MAX_WINDOWS, MAX_BYTES = 500_000, 96 << 20
#: Keys of contaminated documents that are broadcast to remove them; more are joined by a shuffle.
MAX_KEYS = 1_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words before A-Z is lower-cased: letters, digits and everything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """The words of a text, in their own case."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def _hashes(words: Column) -> Column:
    """Hashes of words; full lower case joins more than A-Z alone, which the verification undoes."""
    return F.transform(words, lambda w: F.xxhash64(F.lower(w)))


def _plain(words: Column, start: Column, n: Column) -> Column:
    return F.translate(F.array_join(F.slice(words, start, n), " "), UPPER, LOWER)


def _window_hashes(hashes: Column, count: Column, n: int) -> Column:
    """The hash of each window of n words, in order; none if there are fewer words."""
    places = F.when(count >= n, F.sequence(F.lit(1), count - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.xxhash64(F.slice(hashes, i, n)))


def windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Each window of the benchmark and item that holds it: the window's hash, text and number of words, and item_id."""
    words = benchmark.select("item_id", words_of(F.col("text")).alias("words")).filter(F.size("words") > 0)
    words = words.withColumn("n", F.least(F.lit(window), F.size("words")))
    at = words.withColumn("start", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("n") + 1)))
    part = F.slice("words", F.col("start"), F.col("n"))
    return at.select("item_id", "n", _plain(F.col("words"), F.col("start"), F.col("n")).alias("gram"), F.xxhash64(_hashes(part)).alias("hash")).distinct()


def _scan(documents: DataFrame, grams: DataFrame, lengths: list[int], first: bool) -> DataFrame:
    """One row for each verified hit and, if ``first``, one with a null gram for each document."""
    cut = documents.withColumn("_words", words_of(F.col("text"))).withColumn("_n", F.size("_words")).withColumn("_hashes", _hashes(F.col("_words")))
    runs = [_window_hashes(F.col("_hashes"), F.col("_n"), n) for n in lengths]
    # place 0 stands for the document itself; the windows of each length follow one another
    places = F.concat(F.array(F.lit(None).cast("long")), *runs)
    # the array is a column of its own: with an attribute to explode, generator and join are compiled into one loop, in which
    # the words are a reference and are never copied for each window; the outer form keeps Spark from inferring a filter on the
    # array's size, which would be pushed into the scan and compute every array twice
    wide = cut.select("_key", "_words", "_n", places.alias("_places")).select("_key", "_words", "_n", F.posexplode_outer("_places").alias("_place", "_hash"))
    before, offsets = F.lit(0), []
    for n in lengths:
        offsets.append(before)
        before = before + F.greatest(F.lit(0), F.col("_n") - (n - 1))
    offset = reduce(lambda c, x: F.when(F.col("g_n") == x[0], x[1]).otherwise(c), zip(lengths, offsets, strict=True), F.lit(0))
    start = F.col("_place") - offset
    g = F.broadcast(grams.select(F.col("hash").alias("g_hash"), F.col("gram").alias("g_gram"), F.col("n").alias("g_n"), F.col("id").alias("g_id")))
    same = (F.col("_hash") == F.col("g_hash")) & (_plain(F.col("_words"), start, F.col("g_n")) == F.col("g_gram"))
    hits = wide.join(g, same, "left" if first else "inner")
    if first:
        hits = hits.filter((F.col("_place") == 0) | F.col("g_n").isNotNull())
    return hits.select("_key", F.col("_n").alias("n_words"), start.alias("start"), F.col("g_n").alias("n"), F.col("g_id").alias("gram"))


def find(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """For each document: key (doc_id and a hash of the text), copies (rows like it), n_words, its hit spans and the windows in it;
    and the items of windows: (gram, item_id)."""
    spark, folder = documents.sparkSession, shared.folder(documents.sparkSession, "benchmark")
    held = shared.table(windows(benchmark, window), folder, "windows")
    grams = shared.table(held.select("hash", "gram", "n").distinct().withColumn("id", F.monotonically_increasing_id()), folder, "grams")
    held_now = grams.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("gram")), F.lit(0)).alias("bytes")).first()
    lengths = sorted({r["n"] for r in grams.select("n").distinct().collect()} | {window}, reverse=True)  # at most as many as a window has words
    keyed = documents.select(F.struct("doc_id", F.xxhash64("text").alias("text"), F.length("text").alias("chars")).alias("_key"), "text")
    blocks = max(1, -(-held_now["n"] // MAX_WINDOWS), -(-held_now["bytes"] // MAX_BYTES))
    scans = [_scan(keyed, grams.filter(F.pmod(F.col("hash"), F.lit(blocks)) == b) if blocks > 1 else grams, lengths, b == 0) for b in range(blocks)]
    found = (
        reduce(DataFrame.unionByName, scans)
        .groupBy(F.col("_key").alias("key"))
        .agg(
            F.count_if(F.col("n").isNull()).alias("copies"),
            F.max("n_words").cast("long").alias("n_words"),
            F.sort_array(F.collect_set(F.when(F.col("n").isNotNull(), F.struct("start", "n")))).alias("spans"),
            F.collect_set("gram").alias("grams"),
        )
    )
    items = held.filter(F.col("item_id").isNotNull()).join(grams, ["hash", "gram", "n"]).select(F.col("id").alias("gram"), "item_id")
    return found, items


def covered(spans: Column) -> Column:
    """Words inside at least one of the spans, which are in order."""
    zero = F.struct(F.lit(0).cast("long").alias("hit"), F.lit(0).cast("long").alias("end"))

    def add(a: Column, s: Column) -> Column:
        end = (s["start"] + s["n"]).cast("long")
        return F.struct((a["hit"] + F.greatest(F.lit(0), end - F.greatest(a["end"], s["start"].cast("long")))).alias("hit"), F.greatest(a["end"], end).alias("end"))

    return F.aggregate(spans, zero, add, lambda a: a["hit"])


def report(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row for each document row: words, words hit, items found."""
    folder = shared.folder(documents.sparkSession, "report")
    found, items = find(documents, benchmark, window)
    found = shared.table(found, folder, "found")
    # a pair of document and item once, however many windows they share
    pairs = found.select("key", F.explode("grams").alias("gram")).join(items, "gram").select("key", "item_id").distinct()
    names = pairs.groupBy("key").agg(F.array_sort(F.collect_list(F.col("item_id").cast("string"))).alias("names")).select(F.col("key").alias("of"), "names")
    names = found.join(names, F.col("key").eqNullSafe(F.col("of")), "left").withColumn("names", F.coalesce("names", F.array().cast("array<string>")))
    out = names.select(
        F.col("key.doc_id").alias("doc_id"), "copies", "n_words", covered(F.col("spans")).alias("n_hit"), F.size("names").cast("long").alias("n_items"), F.sha2(F.array_join("names", ","), 256).alias("items_sha256")
    )
    out = out.withColumn("contaminated", F.col("n_hit") > 0)
    return out.select("*", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).drop("copy", "copies")


def decontaminate(documents: DataFrame, benchmark: DataFrame, remove: str = "documents", window: int = WINDOW) -> DataFrame:
    """The documents, all columns, without those that hold a benchmark window, or without the words inside such windows.

    A removed word goes with the characters before it; a text of which all words go keeps what follows the last one.
    """
    if remove not in ("documents", "spans"):
        raise ValueError("remove must be 'documents' or 'spans'")
    spark = documents.sparkSession
    hits = find(documents, benchmark, window)[0].filter(F.size("spans") > 0).select("key", "spans")
    hits = shared.table(hits, shared.folder(spark, "contaminated"), "keys")
    key = F.struct(documents["doc_id"], F.xxhash64(documents["text"]).alias("text"), F.length(documents["text"]).alias("chars"))
    of, spans, gaps, words = shared.fresh("of", "spans", "gaps", "words")
    side = hits.select(F.col("key").alias(of), F.col("spans").alias(spans))
    if remove == "documents":
        side = side.drop(spans)
        # a key has a fixed size, so so many of them are a bounded set
        return documents.join(F.broadcast(side) if hits.count() <= MAX_KEYS else side, key.eqNullSafe(F.col(of)), "left_anti")
    joined = documents.join(side, key.eqNullSafe(F.col(of)), "left")
    hit = lambda i: F.exists(spans, lambda s: (s["start"] <= i + 1) & (i + 1 < s["start"] + s["n"]))
    kept = joined.withColumn(gaps, F.split(F.col("text"), WORD, -1)).withColumn(words, words_of(F.col("text")))
    body = F.transform(words, lambda w, i: F.when(hit(i), "").otherwise(F.concat(F.get(gaps, i), w)))
    text = F.when(F.col(spans).isNull(), F.col("text")).otherwise(F.concat(F.array_join(body, ""), F.element_at(gaps, -1)))
    return kept.withColumn("text", text).select(*documents.columns)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
