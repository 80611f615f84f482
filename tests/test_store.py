"""A stored index: pruning, versions, changes, and saves that stop half-way."""

import random
import re

import pytest
from pyspark.sql import functions as F

from sheaf.operators import ranking, store
from sheaf.operators.index import Index
from sheaf.operators.store import IndexFormatError, Store, StoreConflict
from sheaf.storage import shared_folder
from sheaf.streaming import ingest


def rows_of(frame, *columns):
    return sorted(map(tuple, frame.select(*columns).collect()), key=repr)


POSTINGS = ("term", "id", "tf", "dl")


@pytest.fixture(scope="module")
def corpus(spark):
    """A few words in nearly every chunk, the others rare; chunks of very different lengths, an empty one and a null."""
    rng = random.Random(9)
    rare = [f"{a}{b}{c}" for a in "klmnprst" for b in "aeiou" for c in "bdfgxz"]
    text = lambda n: " ".join(rng.choice(["the", "and", "of"]) if rng.random() < 0.5 else rng.choice(rare) for _ in range(n))
    rows = [(k, text(rng.choice([3, 10, 30, 120])), f"b{k}") for k in range(1500)] + [(2000, "", "x"), (2001, None, "x"), (None, "the null", "x")]
    return spark.createDataFrame(rows, "id long, text string, block string").repartition(3).cache()


@pytest.fixture(scope="module")
def asked(spark):
    said = ["the kab", "and of the lef", "the and of", "kab lef mix the", "nothing known", "", "the the the of", " ".join(["the", "and", "of", "kab", "lef", "mix", "nox", "paz", "rub", "sed", "tiz", "kob", "lub", "meg"])]
    return spark.createDataFrame(list(enumerate(said)), "query_id long, query string")


@pytest.fixture(scope="module")
def index(corpus):
    return Index.build(corpus, key="id")


@pytest.fixture(scope="module")
def saved(index, tmp_path_factory):
    return index.save(f"file://{tmp_path_factory.mktemp('store')}/i", buckets=8)


@pytest.mark.parametrize("top_k", [1, 3, 40])
def test_pruned_ranking(index, saved, asked, top_k):
    own = Index.of(saved)
    for rank, plain in ((ranking.bm25, index), (ranking.bm25_strict, ranking.strict_index(index.chunks, "id"))):
        stored = own if rank is ranking.bm25 else Index.of(plain.save(f"{saved.path}-strict-{top_k}"))
        want = rank(plain, asked, top_k)
        assert rows_of(rank(stored, asked, top_k), *want.columns) == rows_of(want, *want.columns)


def test_skipped_blocks(spark, saved, monkeypatch):
    """Of frequent words in a question with a rare one, less than a third of the postings are opened."""
    monkeypatch.setattr(store, "SEEDS", 4)
    own = Index.of(saved)
    terms = spark.createDataFrame([(0, "the", 1), (0, "kab", 1), (1, "of", 1), (1, "and", 1), (1, "lef", 1)], "query_id long, term string, qtf int")
    found = own.lookup(terms)
    weighed = terms.join(found.frequencies, "term").crossJoin(found.totals)
    weight = lambda tf, dl: ranking.idf(F.col("n"), F.col("df")) * ranking.saturation(tf, dl, F.col("avgdl"), 1.5, 0.75) * F.col("qtf")
    pruned = saved.prune(found.asked, weighed, weight, 3)
    often = F.col("term").isin("the", "of", "and")
    n = lambda df: df.filter(often).agg(F.sum("size"), F.count("*")).first()
    (before, blocks), (after, opened) = n(pruned.heads), n(pruned.opened)
    assert after < before / 3 and blocks - opened > blocks / 2, (before, after, blocks, opened)
    # no bound is below what its chunks score
    bounds = pruned.heads.groupBy("query_id", "segment", "block").agg(F.sum("most").alias("bound"))
    every = pruned.heads.select("query_id", "segment", "block").distinct()
    scored = saved.rows_of(found.asked, weighed, every, ["query_id", "segment", "block"]).groupBy("query_id", "segment", "block", "id").agg(F.sum(weight(F.col("tf"), F.col("dl"))).alias("score"))
    assert scored.join(bounds, ["query_id", "segment", "block"]).filter(F.col("score") > F.col("bound") + 1e-9).isEmpty()


def test_pruned_partitions(spark, saved):
    """Asked terms are partition filters and pushed to the files; a long list prunes by bucket alone."""
    few = saved.postings(spark.createDataFrame([("kab",)], "term string"))
    plan = few._jdf.queryExecution().toString()
    scan = next(line for line in plan.splitlines() if "PushedFilters" in line and "ids" in line)
    assert re.search(r"PartitionFilters: \[[^\]]*\(bucket#\d+ = \d+\)\]", scan) and "EqualTo(term,kab)" in scan
    many = spark.createDataFrame([(f"no{k}",) for k in range(store.LISTED)] + [("kab",)], "term string")
    assert rows_of(saved.postings(many), *POSTINGS) == rows_of(few, *POSTINGS)


def state(table):
    return {r.id: r for r in table.collect()}


def test_life_of_an_index(spark, corpus, asked, tmp_path):
    """Updates, removals and additions in versions, equal to an index built of what is left, also in one segment and after old files went."""
    path = f"file://{tmp_path}/i"
    first = Index.build(corpus, key="id").save(path, buckets=4)
    change = spark.createDataFrame([(0, "kab kab the"), (1, ""), (5000, "lef the of")], "id long, text string")
    wide = lambda df: Index.build(df, key="id").rows()
    second = first.apply(wide(change), spark.createDataFrame([(2,), (3,), (9999,)], "id long"))
    third = second.apply(wide(spark.createDataFrame([(0, "kab again"), (2, "back of the kab")], "id long, text string")))
    gone = [0, 1, 2, 3]
    rest = corpus.filter(~F.coalesce(F.col("id").isin(gone), F.lit(False))).select("id", "text")
    left = rest.unionByName(spark.createDataFrame([(0, "kab again"), (1, ""), (2, "back of the kab"), (5000, "lef the of")], "id long, text string"))
    want = Index.build(left, key="id")
    for now in (third, third.compact()):
        own = Index.of(now)
        assert rows_of(own.postings(), *POSTINGS) == rows_of(want.postings(), *POSTINGS)
        assert rows_of(own.frequencies(), "term", "df") == rows_of(want.frequencies(), "term", "df")
        assert tuple(own.totals().first()) == pytest.approx(tuple(want.totals().first()))
        assert rows_of(own.chunks, "id", "text") == rows_of(left, "id", "text")
        assert own.fingerprint().first() == want.fingerprint().first()
        for rank in (ranking.bm25, ranking.tfidf):
            assert rows_of(rank(own, asked, 5), "query_id", "id", "score", "rank") == rows_of(rank(want, asked, 5), "query_id", "id", "score", "rank")
    # a reader of the first version still has it, until its files are deleted
    assert Index.load(spark, path, 1).totals().first().n == 1503 == Index.of(first).totals().first().n
    latest = Store.open(spark, path)
    assert latest.manifest.version == 4 and len(latest.manifest.segments) == 1 and latest.vacuum() > 0
    assert Store.versions(spark, path) == [4] and rows_of(Index.of(latest).postings(), *POSTINGS) == rows_of(want.postings(), *POSTINGS)
    assert "block" not in Index.of(latest).chunks.columns or Index.of(latest).chunks.filter("block is not null").count() > 0
    with pytest.raises(IndexFormatError):
        Index.load(spark, path, 1)


def test_half_a_save(spark, index, tmp_path, monkeypatch):
    """A save that stops before its manifest isn't seen; a later one isn't disturbed by what it left."""
    path = f"file://{tmp_path}/i"
    small = Index.build(spark.createDataFrame([(1, "cat"), (2, "dog")], "id long, text string"), key="id")
    small.save(path)
    for broken in ("_publish", "_postings_schema"):
        with monkeypatch.context() as m:
            m.setattr(store, broken, lambda *a: 1 / 0)
            with pytest.raises(ZeroDivisionError):
                index.save(path)
        assert rows_of(Index.load(spark, path).postings(), *POSTINGS) == [("cat", 1, 1, 1), ("dog", 2, 1, 1)]
    index.save(path)
    assert Index.load(spark, path).totals().first().n == 1503


def test_two_writers(spark, tmp_path):
    path = f"file://{tmp_path}/i"
    make = lambda word: Index.build(spark.createDataFrame([(1, word)], "id long, text string"), key="id").rows()
    a, b = Store.create(spark, path), Store.create(spark, path)
    a.apply(make("first"))
    with pytest.raises(StoreConflict):
        b.apply(make("second"))
    assert rows_of(Store.open(spark, path).postings(), *POSTINGS) == [("first", 1, 1, 1)]


def test_store_edges(spark, tmp_path):
    """Nothing at all, ids that are strings, chunks without words, columns named like the store's own."""
    empty = Index.build(spark.createDataFrame([], "id long, text string"), key="id").save(f"file://{tmp_path}/none")
    question = spark.createDataFrame([(0, "cat")], "query_id long, query string")
    assert ranking.bm25(Index.of(empty), question, 2).collect() == [] and empty.compact().totals().first().n == 0
    rows = [("b", "cat", 1, "s"), ("a", "cat", 2, None), ("d", "dog cat", 3, "t"), ("c", "", 4, "u")]
    index = Index.build(spark.createDataFrame(rows, "id string, text string, dl int, segment string"), key="id")
    own = Index.of(index.save(f"file://{tmp_path}/named", buckets=2))
    assert rows_of(own.chunks, "id", "text", "dl", "segment") == sorted(rows, key=repr)
    assert rows_of(own.postings(), *POSTINGS) == rows_of(index.postings(), *POSTINGS)
    more = spark.createDataFrame([("a", "bird", 7.5), ("e", "fish", None)], "id string, text string, tokens double")
    grown = Index.of(own.stored.apply(Index.build(more, key="id").rows()))
    assert rows_of(grown.chunks, "id", "text", "dl", "segment", "tokens") == sorted([*[(*r, None) for r in rows if r[0] != "a"], ("a", "bird", None, None, 7.5), ("e", "fish", None, None, None)], key=repr)
    assert rows_of(Index.of(grown.stored.compact()).chunks, "id", "text", "dl", "tokens") == rows_of(grown.chunks, "id", "text", "dl", "tokens")
    no_words = Index.build(spark.createDataFrame([(1, ""), (2, None)], "id long, text string"), key="id").save(f"file://{tmp_path}/blank")
    assert [tuple(r)[1:] for r in ranking.bm25(Index.of(no_words), question, 2).select("query_id", "id", "score", "rank").collect()] == [(1, 0.0, 1), (2, 0.0, 2)]


def test_stream_of_changes(spark, tmp_path):
    """Batches become versions; a batch that comes again changes nothing; of several changes in a batch the last counts."""
    log, path = f"file://{tmp_path}/log", f"file://{tmp_path}/i"
    stream = lambda: spark.readStream.schema("doc_id long, text string, at int").parquet(log)
    put = lambda rows: spark.createDataFrame(rows, "doc_id long, text string, at int").write.mode("append").parquet(log)
    put([(1, "old cat", 1), (1, "new cat", 2), (2, "dog", 1), (3, "bird", 1), (3, None, 5)])
    assert rows_of(ingest.ingest_changes(stream(), path).postings(), "term", "id") == [("cat", 1), ("dog", 2), ("new", 1)]
    put([(2, "dog again", 1), (3, "bird back", 1), (1, None, 1)])
    now = ingest.ingest_changes(stream(), path)
    assert rows_of(now.postings(), "term", "id") == [("again", 2), ("back", 3), ("bird", 3), ("dog", 2)] and now.manifest.version == 2
    assert now.apply(Index.build(spark.createDataFrame([(9, "late")], "id long, text string"), key="id").rows(), None, f"{path}/_changes", 1) is now
    assert ingest.ingest_changes(stream(), path).manifest.version == 2


def test_blocks_written_as_several_rows_are_pruned_as_one(spark, monkeypatch):
    """A block whose chunks came in two Arrow batches has two rows a term: one may be essential and the other not."""
    monkeypatch.setattr(store, "SEEDS", 2)
    rng = random.Random(5)
    words = ["rare", "often", "common"]
    rows = [(k, " ".join(rng.choices([*words, "filler", "other"], [1, 4, 30, 20, 20], k=rng.randint(5, 40)))) for k in range(3000)]
    chunks = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    queries = spark.createDataFrame([(0, "rare often common"), (1, "often common"), (2, "rare common")], "query_id long, query string")
    own = Index.build(chunks)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(key, 40)
    try:
        kept = Index.of(own.save(shared_folder(spark, "index")))
        docs = kept.stored.docs("id", "segment", "block")
        got = [tuple(r) for r in ranking.bm25(kept, queries, 5).select("query_id", "id", "score", "rank").orderBy("query_id", "rank").collect()]
    finally:
        spark.conf.unset(key)
    assert docs.count() == 3000
    blocks = kept.stored.blocks(lambda t: t).groupBy("segment", "block", "term").count().filter("count > 1")
    assert blocks.count() > 0
    assert got == [tuple(r) for r in ranking.bm25(own, queries, 5).select("query_id", "id", "score", "rank").orderBy("query_id", "rank").collect()]
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == str(8 << 20)


def test_changes_move_ids_alone(spark, tmp_path):
    """Removals are tables of ids, so that chunks needn't be shuffled to leave them out; of a key that comes twice in a batch the last counts."""
    log, folder = f"{tmp_path}/log", f"file://{tmp_path}/store"
    rows = [(k, f"word{k} the the", 0) for k in range(20)] + [(3, "late of", 2), (3, "early of", 1), (None, "nothing one", 0), (None, "nothing two", 0), (4, None, 1)]
    spark.createDataFrame(rows, "doc_id long, text string, at int").coalesce(1).write.parquet(log)
    stream = lambda: spark.readStream.schema("doc_id long, text string, at int").parquet(log)
    ingest.ingest_changes(stream(), folder)
    spark.createDataFrame([(5, None, 3), (6, "again the", 3)], "doc_id long, text string, at int").write.mode("append").parquet(log)
    last = ingest.ingest_changes(stream(), folder)
    want = {k: ["word" + str(k), "the", "the"] for k in range(20) if k not in (3, 4, 5)} | {3: ["late", "of"], 6: ["again", "the"], None: ["nothing", "two"]}
    assert {r.id: r.tokens for r in last.docs("id", "tokens").collect()} == want
    df = {r.term: r.df for r in last.frequencies().collect()}
    assert df["the"] == 17 and "word5" not in df and "early" not in df and last.totals().first().n == len(want)
    (change,) = last.manifest.removed
    assert set(spark.read.parquet(f"{last.path}/removed/change={change}").columns) == {"id", "segment", "dl"}
    plan = last.docs("id", "tokens")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
