"""Inverted lists of vectors: recall against brute force, the exact search, hot cells, edges."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheaf import storage
from sheaf.operators import ranking, vector_index
from sheaf.operators.vector_index import VectorIndex, recall

KINDS = ("clusters", "noise")


def table(kind):
    """3,000 vectors, a third of them copies of one, two without length."""
    rng = np.random.default_rng(4)
    if kind == "clusters":
        centres = rng.normal(size=(30, 16))
        rows = centres[rng.integers(0, 30, 2000)] + 0.2 * rng.normal(size=(2000, 16))
    else:
        rows = rng.normal(size=(2000, 16))
    rows = np.concatenate([rows, np.repeat(rows[:1], 1000, 0), np.zeros((2, 16))])
    return [(k, [float(x) for x in r]) for k, r in enumerate(rows)]


@pytest.fixture(scope="module", params=KINDS)
def vectors(spark, request):
    own = spark.createDataFrame(table(request.param), "id long, embedding array<float>").repartition(3).cache()
    asked = own.filter("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"))
    return own, asked, ranking.vector(own, asked, 5).cache(), VectorIndex.build(own), request.param


def test_recall(vectors):
    own, asked, right, index, kind = vectors
    some = asked.filter("query_id > 0 and query_id < 2000")  # of copies, any five would do
    right = right.join(some, "query_id", "left_semi")
    measured = recall(index.search(some, 5), right).first()
    assert measured.recall >= 0.9 and measured.n == 5 * 39
    assert kind == "noise" or index.probes < index.cells().count() / 3
    assert recall(index.search(some, 5, probes=1), right).first().recall < 1


def test_exact(vectors):
    own, asked, right, index, kind = vectors
    columns = ("query_id", "id", "score", "rank")
    rows = lambda df: sorted(map(tuple, df.select(*columns).collect()))
    for probes in (1, 3, 10_000):
        assert rows(index.search(asked, 5, probes, exact=True)) == rows(right)
    again = VectorIndex.open(own.sparkSession, index.path)
    assert again.probes == index.probes and rows(again.search(asked, 5)) == rows(index.search(asked, 5))


def test_pruned_cells(spark, vectors):
    index = vectors[3]
    plan = index.lists([1, 3])._jdf.queryExecution().toString()
    assert "PartitionFilters: [cell#" in plan and "IN (1,3)" in plan
    assert index.cells().agg(F.sum("n")).first()[0] == 3002


def test_hot_cell(spark, monkeypatch):
    """A cell with most of the rows lies in several files."""
    monkeypatch.setattr(vector_index, "FILE_ROWS", 100)
    own = spark.createDataFrame([(k, [1.0, 0.0] if k % 4 else [0.0, float(k + 1)]) for k in range(800)], "id long, embedding array<double>")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # which would join files as small as these
    index = VectorIndex.build(own, cells=2)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = spark.read.parquet(f"{index.path}/lists").withColumn("file", F.input_file_name()).groupBy("cell").agg(F.count_distinct("file").alias("files"), F.count("*").alias("n"))
    found = {r.n: r.files for r in files.collect()}
    assert set(found) == {200, 600} and found[600] > 1
    asked = spark.createDataFrame([(0, [1.0, 0.1])], "query_id long, vector array<double>")
    assert [r.id for r in index.search(asked, 3, 1).orderBy("rank").collect()] == [1, 2, 3]


def test_edges(spark):
    empty = VectorIndex.build(spark.createDataFrame([], "id long, embedding array<float>"))
    asked = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 0.0])], "query_id long, vector array<float>")
    assert empty.search(asked).collect() == [] and empty.search(asked, exact=True).collect() == []
    one = VectorIndex.build(spark.createDataFrame([(5, [0.0, 2.0]), (6, None), (7, [])], "id long, embedding array<float>"))
    assert sorted(map(tuple, one.search(asked, exact=True).collect())) == [(0, 5, 0.0, 1), (1, 5, 0.0, 1)]
    with pytest.raises(ValueError):
        one.search(asked, 5, 0)


def test_a_query_is_kept_once(spark, vectors):
    """What meets the cells holds each query's vector once, however many cells it visits."""
    own, asked, right, index, kind = vectors
    for exact in (False, True):
        before = set(storage._MADE)
        index.search(asked, 5, 8, exact=exact).collect()
        made = [p for p in storage._MADE if p not in before]
        for what in ("visits", "asked"):
            for p in (p for p in made if p.rsplit("/", 1)[1].startswith(f"{what}-")):
                rows = spark.read.parquet(p)
                assert (rows.count() if what == "visits" else rows.select(F.explode("q_keys")).count()) <= asked.count()


def test_sample_of_least_hashes(spark, monkeypatch):
    """The sample is the rows of least hashes, whether the bound on hashes lets enough of them through or not."""
    own = spark.range(3000).select("id", F.array(F.col("id").cast("double")).alias("embedding"))
    right = [[float(r.id)] for r in own.orderBy(F.xxhash64("id")).limit(50).collect()]
    assert vector_index._matrix(vector_index._least(own, 50, 3000)).tolist() == right
    assert vector_index._matrix(vector_index._least(own, 50, 10**9)).tolist() == right
