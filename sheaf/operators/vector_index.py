"""Nearest vectors through inverted lists: cells of like vectors as partitions of a table, of which a query reads a few.

Cells come from spherical k-means on a bounded sample (SAMPLE rows, those with the least hashes of their ids); every row
is assigned to its nearest cell and stored there, a large cell in many files.  A query visits the cells whose centres are nearest to it
and compares itself with all vectors in them, so scores are exact and only the choice of cells isn't.

How many cells that takes depends on the data: ``build`` measures on its sample, by brute force, in which of its nearest cells a vector's
neighbours lie, and keeps the number that holds the share RECALL of them.  The sample is sparser than the table, so neighbours in
the table are nearer and no rarer to be found.

``search(exact=True)`` then visits all other cells that can hold one of the first top_k: a cell keeps the widest angle between
its centre and a vector in it, so no vector's angle to a query is below that of the centre less this one.  The result
is that of ``ranking.vector``.  Queries of near cells are packed into blocks, with a bit for each cell that one visits; a block
of a cell's vectors meets the blocks of queries that have a visit there, one matrix product each, so a query's vector is kept once,
not once a visit.
Similarities are cosines; a vector without length has 0 with all, lies in the first cell and is met in exact searches only if
a query's floor is that low.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sheaf.operators.ranking import DIGITS, check, cosines, top
from sheaf.storage import shared_folder, spread, stored

#: Rows that cells are trained on, and cells at most.
SAMPLE, MAX_CELLS = 16_384, 4096
#: Share of neighbours that the kept number of visits finds in the sample, and the vectors and neighbours that it is measured on.
RECALL, TRIED, NEIGHBOURS = 0.97, 512, 5
#: Rows of a cell in one file, rows of a block, queries of a block.
FILE_ROWS, ROWS, QUERIES = 1 << 18, 4096, 512


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def _matrix(column, kind=np.float64) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind)
    return flat.reshape(len(column), -1) if len(flat) else np.zeros((len(column), 0))


def train(sample: np.ndarray, cells: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Centres of unit length; one that loses all rows takes the row that fits its own centre worst."""
    rng = np.random.default_rng(seed)
    rows = _unit(sample)
    centres = rows[rng.choice(len(rows), min(cells, len(rows)), replace=False)]
    for _ in range(rounds):
        near = rows @ centres.T
        own = near.argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, rows)
        empty = np.flatnonzero(np.bincount(own, minlength=len(centres)) == 0)
        if len(empty):
            sums[empty] = rows[np.argsort(near[np.arange(len(rows)), own])[: len(empty)]]
        centres = _unit(sums)
    return centres


def visits_needed(sample: np.ndarray, centres: np.ndarray) -> int:
    """The cells that a query has to visit to find the share RECALL of its NEIGHBOURS nearest other rows of the sample."""
    rows = _unit(sample)
    near = rows @ centres.T
    own = near.argmax(1)
    some = np.arange(min(TRIED, len(rows)))
    like = rows[some] @ rows.T
    like[some, some] = -np.inf
    found = np.argsort(-like, axis=1, kind="stable")[:, :NEIGHBOURS]
    places = np.argsort(np.argsort(-near[some], axis=1, kind="stable"), axis=1)
    return int(np.quantile(np.take_along_axis(places, own[found], 1), RECALL, method="higher")) + 1


def _assign(centres: np.ndarray):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = _unit(_matrix(batch.column("embedding")))
            for k in range(0, len(rows), ROWS):
                near = rows[k : k + ROWS] @ centres.T
                cell = near.argmax(1)
                part = batch.slice(k, ROWS)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("embedding"), pa.array(cell.astype(np.int32)), pa.array(near[np.arange(len(cell)), cell])], ["id", "embedding", "cell", "near"])

    return run


def _blocks(batches):
    """Vectors of one cell packed together: (cell, keys, floats)."""
    import pyarrow as pa

    for batch in batches:
        cell, keys, rows = batch.column("cell").to_numpy(), batch.column("id").to_numpy(), _matrix(batch.column("embedding"))
        order = np.argsort(cell, kind="stable")
        cuts = np.flatnonzero(np.diff(cell[order])) + 1
        out = [part[k : k + ROWS] for part in np.split(order, cuts) for k in range(0, len(part), ROWS)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([int(cell[p[0]]) for p in out], pa.int32()), pa.array([keys[p] for p in out], pa.list_(pa.int64())), pa.array([rows[p].tobytes() for p in out], pa.binary())],
            ["cell", "keys", "floats"],
        )


def _asked_blocks(names: np.ndarray):
    """Queries packed together: (q_keys, q_floats, q_cells, q_visits), the cells that one of them visits and each one's bits."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for k in range(0, batch.num_rows, QUERIES):
                part = batch.slice(k, QUERIES)
                visits = part.column("visits").to_pylist()
                some = np.unpackbits(np.bitwise_or.reduce(np.frombuffer(b"".join(visits), np.uint8).reshape(len(visits), -1)), count=len(names)) > 0
                if some.any():
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([part.column("query_id").to_numpy()], pa.list_(pa.int64())), pa.array([_matrix(part.column("vector")).tobytes()], pa.binary()), pa.array([names[some]], pa.list_(pa.int32())), pa.array([b"".join(visits)], pa.binary())],
                        ["q_keys", "q_floats", "q_cells", "q_visits"],
                    )

    return run


def _compare(top_k: int, names: np.ndarray):
    """The best rows of each query of a block that visits the cell of a block of vectors."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for q_keys, q_floats, q_visits, cell, keys, floats in zip(*(batch.column(c) for c in ("q_keys", "q_floats", "q_visits", "cell", "keys", "floats")), strict=True):
                q, own = q_keys.values.to_numpy(), keys.values.to_numpy()
                a, b = (np.frombuffer(f.as_buffer(), np.float64).reshape(len(k), -1) for f, k in ((q_floats, q), (floats, own)))
                at = int(np.searchsorted(names, cell.as_py()))
                here = np.frombuffer(q_visits.as_buffer(), np.uint8).reshape(len(q), -1)[:, at // 8] >> (7 - at % 8) & 1 > 0
                q, a = q[here], a[here]
                score = np.round(cosines(a, b), DIGITS) + 0.0
                order = np.argsort(own, kind="stable")
                best = order[np.argsort(-score[:, order], axis=1, kind="stable")[:, :top_k]]
                yield pa.RecordBatch.from_arrays([pa.array(q.repeat(best.shape[1])), pa.array(own[best].ravel()), pa.array(np.take_along_axis(score, best, 1).ravel())], ["query_id", "id", "score"])

    return run


def _least(rows: DataFrame, sample: int, n: int):
    """The vectors of the ``sample`` rows, of n, whose ids have the least hashes."""
    value = F.xxhash64("id")
    # rows that can't be among them stay where they are, or each task would send as many as are wanted to one
    share = 1.5 * sample / n
    few = rows.filter(value <= int((share - 0.5) * 2.0**64)) if share < 1 else rows
    taken = few.orderBy(value, "id").limit(sample).select("embedding").toArrow().column(0).combine_chunks()
    return taken if few is rows or len(taken) == sample else _least(rows, sample, sample)


@dataclass
class VectorIndex:
    spark: SparkSession
    path: str
    probes: int

    @classmethod
    def build(cls, vectors: DataFrame, path: str | None = None, cells: int | None = None, sample: int = SAMPLE) -> VectorIndex:
        """Stores vectors of (id, embedding), ids being whole numbers, by cell: the square root of their number, unless it is given."""
        spark = vectors.sparkSession
        path = (path or shared_folder(spark, "vectors")).rstrip("/")
        rows = vectors.filter(F.size("embedding") > 0).select(F.col("id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))
        n = rows.count()
        if not n:
            spark.createDataFrame([], "cell int, n long, least double, centre array<double>, probes int").write.parquet(f"{path}/cells")
            return cls(spark, path, 1)
        known = _matrix(_least(rows, min(sample, SAMPLE), n))
        centres = train(known, cells or int(min(MAX_CELLS, max(1, round(n**0.5)))))
        assigned = stored(spread(rows).mapInArrow(_assign(centres), "id long, embedding array<double>, cell int, near double"), "assigned")
        counts = stored(assigned.groupBy("cell").agg(F.count("*").alias("n"), F.min("near").alias("least")), "counts")
        # a cell that many rows fall into, copies perhaps, is dealt to as many tasks as it needs
        dealt = assigned.join(counts.select("cell", F.ceil(F.col("n") / FILE_ROWS).alias("files")), "cell").withColumn("file", F.pmod(F.xxhash64("id"), "files"))
        dealt.repartition("cell", "file").sortWithinPartitions("cell").select("id", "embedding", "cell").write.partitionBy("cell").parquet(f"{path}/lists")
        probes = visits_needed(known, centres)
        named = spark.createDataFrame([(k, c.tolist(), probes) for k, c in enumerate(centres)], "cell int, centre array<double>, probes int")
        counts.join(named, "cell").select("cell", "n", "least", "centre", "probes").write.parquet(f"{path}/cells")
        return cls(spark, path, probes)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> VectorIndex:
        first = spark.read.parquet(f"{path.rstrip('/')}/cells").first()
        return cls(spark, path.rstrip("/"), first.probes if first else 1)

    def cells(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/cells")

    def lists(self, cells: list[int]) -> DataFrame:
        """The rows of some cells: a filter on partitions."""
        own = self.spark.read.schema("id long, embedding array<double>, cell int").parquet(f"{self.path}/lists")
        return own.filter(F.col("cell").isin(cells))

    def search(self, queries: DataFrame, top_k: int = 5, probes: int | None = None, exact: bool = False) -> DataFrame:
        """(query_id, id, score, rank) of the nearest vectors of each query of (query_id, vector) in the cells that it visits."""
        probes = self.probes if probes is None else probes
        check(1, 0, top_k)
        if probes <= 0:
            raise ValueError("probes must be greater than 0")
        asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("vector").cast("array<double>").alias("vector"))
        known = self.cells().orderBy("cell").collect()  # no more than MAX_CELLS
        if not known:
            return asked.limit(0).select("query_id", F.lit(0).cast("long").alias("id"), F.lit(0.0).alias("score"), F.lit(1).alias("rank"))
        asked = stored(asked, "queries")
        first = stored(top(self._visit(asked, known, top_k, probes), top_k), "nearest")
        if not exact or len(known) <= probes:
            return first
        worst = first.filter(F.col("rank") == top_k).select("query_id", F.col("score").alias("floor"))
        rest = self._visit(asked.join(worst, "query_id", "left"), known, top_k, probes, beyond=True)
        return top(first.drop("rank").unionByName(rest), top_k)

    def _visit(self, asked: DataFrame, known: list, top_k: int, probes: int, beyond: bool = False) -> DataFrame:
        """(query_id, id, score) from the first ``probes`` cells of each query, or from those beyond them that can reach its floor."""
        names = np.array([r.cell for r in known], np.int32)
        centres, wide = np.array([r.centre for r in known]), np.arccos(np.clip([r.least for r in known], -1, 1))

        def choose(batches):
            import pyarrow as pa

            for batch in batches:
                rows = _matrix(batch.column("vector"))
                near = _unit(rows) @ centres.T
                order = np.argsort(-near, axis=1, kind="stable")
                if beyond:
                    floor = np.array([-2.0 if x is None else x for x in batch.column("floor").to_pylist()])
                    bound = np.cos(np.maximum(0, np.arccos(np.clip(near, -1, 1)) - wide))
                    # of a vector without length all is at 0, which a bound below 0 hides
                    chosen = np.maximum(bound, 0.0) >= floor[:, None] - 2 * 10.0**-DIGITS
                    np.put_along_axis(chosen, order[:, :probes], False, 1)
                else:
                    chosen = np.zeros(near.shape, bool)
                    np.put_along_axis(chosen, order[:, :probes], True, 1)
                bits = [b.tobytes() for b in np.packbits(chosen, axis=1)]
                yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("vector"), pa.array(order[:, 0].astype(np.int32)), pa.array(bits, pa.binary())], ["query_id", "vector", "nearest", "visits"])

        placed = stored(asked.mapInArrow(choose, "query_id long, vector array<double>, nearest int, visits binary"), "visits")
        # queries that are near to the same cells share a block, which then has few others
        dealt = placed.repartitionByRange(-(-placed.count() // QUERIES) or 1, "nearest", "query_id").sortWithinPartitions("nearest", "query_id")
        said = stored(dealt.mapInArrow(_asked_blocks(names), "q_keys array<long>, q_floats binary, q_cells array<int>, q_visits binary"), "asked")
        cells = sorted(r.cell for r in said.select(F.explode("q_cells").alias("cell")).distinct().collect())  # no more than MAX_CELLS
        own = self.lists(cells).mapInArrow(_blocks, "cell int, keys array<long>, floats binary")
        both = own.join(said, F.array_contains("q_cells", F.col("cell"))).drop("q_cells")
        return both.mapInArrow(_compare(top_k, names), "query_id long, id long, score double")


def recall(found: DataFrame, right: DataFrame) -> DataFrame:
    """One row: how many of the right pairs (query_id, id) were found."""
    both = right.select("query_id", "id").join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    return both.agg(F.count("*").alias("n"), F.count("hit").alias("n_found"), F.round(F.count("hit") / F.count("*"), 6).alias("recall"))
