"""A stored index: immutable segments, removals, and snapshots that are published whole.

Under the folder of a store lie

* ``docs/segment=S``: one row a chunk (id, block, dl, tokens, chunk), in blocks of BLOCK chunks of like length;
* ``postings/segment=S/bucket=B``: one row for each term and block, with the ids, counts and lengths of its chunks and with the
  largest count and least length among them.  Buckets are ranges of a hash of the term, so asked terms become a filter on
  partitions, and files are sorted by term, so they become a filter on row groups;
* ``removed/change=C``: ids taken out of a segment, and ``forgotten/change=C/bucket=B``: how many of them held a term, so that
  frequencies and totals are those of the chunks that are left;
* ``snapshots/N.json``: the manifest of version N.  It names all else, and it is moved into place last, in one step that fails
  if the version exists.  So a change is seen whole or not at all, readers keep the version that they opened, and of
  two writers at once one gets a ``StoreConflict``.

An upsert replaces earlier chunks of the same id, wherever they are; a null id replaces nothing.  Ids are meant
to be unique; rows of one upsert that share an id are as many chunks.  ``compact`` writes what is left as one
segment, ``vacuum`` deletes what no kept version names.

Rankings by sums of weights, which grow with a term's count and fall with the chunk's length, read blocks by their bounds
(``Store.prune``) and open few of the postings of frequent terms.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sheaf.storage import spread, stored

VERSION = 2
BLOCK_KEY = ["query_id", "segment", "block"]
#: Chunks of a block.
BLOCK = 64
#: Buckets of a new store; for many terms choose more, so that a bucket stays a few files.
BUCKETS = 64
#: How files of chunks and postings are compressed.
PACKING = "zstd"
#: Tokens of a segment for which one more task sorts and writes postings, up to one for each bucket.
TASK = 1 << 18
#: Asked terms up to which they are pushed to the scan as a list; beyond, they are joined.
LISTED = 256
#: Blocks of a query that are scored to find a floor.
SEEDS = 32
#: Terms of a query up to which its terms are split; longer ones gain no more than it costs.
SPLIT = 12
#: Scores closer than this count as equal.
SLACK = 1e-6


class IndexFormatError(RuntimeError):
    """A stored index is missing, broken or of another version."""


class StoreConflict(RuntimeError):
    """Another writer has published the version that this one was about to."""


# files


def _filesystem(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _names(spark: SparkSession, folder: str) -> list[str]:
    fs, where = _filesystem(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []


def _publish(spark: SparkSession, text: str, target: str) -> None:
    """Writes a small file under a name of its own and moves it into place, which fails if there is one."""
    fs, place = _filesystem(spark, target)
    _, own = _filesystem(spark, f"{target}.{uuid.uuid4().hex}")
    out = fs.create(own, False)
    out.write(bytearray(text.encode()))
    out.close()
    jvm = spark._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(own, place, spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
    except Exception as error:
        fs.delete(own, False)
        if fs.exists(place):
            raise StoreConflict(f"{target} exists") from error
        raise


def _read(spark: SparkSession, path: str) -> str:
    # tables may have been read as text of many lines; a manifest is one
    return spark.read.text(path, wholetext=True).first()[0]


# manifests


@dataclass
class Manifest:
    """What a version of a store consists of."""

    version: int = 0
    buckets: int = BUCKETS
    segments: dict[str, dict] = field(default_factory=dict)  # name -> {"n", "n_tokens", "rows", "schema", "postings"}
    removed: dict[str, dict] = field(default_factory=dict)  # name -> {"n", "n_tokens"}
    batches: dict[str, int] = field(default_factory=dict)  # stream -> its last batch

    @property
    def n(self) -> int:
        return sum(s["n"] for s in self.segments.values()) - sum(r["n"] for r in self.removed.values())

    @property
    def n_tokens(self) -> int:
        return sum(s["n_tokens"] for s in self.segments.values()) - sum(r["n_tokens"] for r in self.removed.values())

    def text(self) -> str:
        return json.dumps({"format": VERSION} | self.__dict__)


def bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _packed(salts: int):
    """Postings of a bucket, as rows (part, rows): compressed columns, which take a third of what their rows do in a shuffle.

    They are made from rows (id, block, dl, tokens, buckets), the last being the buckets of the tokens, and have a row for each
    term and block with the chunks of the block that hold the term.  A block whose rows come in two batches has two rows, each with bounds of its own.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            tokens = batch.column("tokens")
            sizes = np.diff(tokens.offsets.to_numpy())
            flat = tokens.flatten()
            if not len(flat):
                continue
            coded = flat.dictionary_encode()
            n, code = len(coded.dictionary), coded.indices.to_numpy().astype(np.int64)
            bucket = np.zeros(n, np.int32)
            bucket[code] = batch.column("buckets").flatten().to_numpy()
            keys, tf = np.unique(np.repeat(np.arange(batch.num_rows), sizes) * n + code, return_counts=True)
            row, code = keys // n, keys % n
            block = batch.column("block").to_numpy()
            order = np.lexsort((row, block[row], code, bucket[code]))
            row, code, tf = row[order], code[order], tf[order].astype(np.int32)
            own = block[row]
            first = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (own[1:] != own[:-1])]))
            dl = batch.column("dl").to_numpy()[row].astype(np.int32)
            ends = pa.array(np.append(first, len(row)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, x) for x in (batch.column("id").take(pa.array(row)), pa.array(tf), pa.array(dl))]
            columns = [coded.dictionary.take(pa.array(code[first])), pa.array(own[first]), pa.array(np.diff(np.append(first, len(row))).astype(np.int32)), pa.array(np.maximum.reduceat(tf, first)), pa.array(np.minimum.reduceat(dl, first)), *lists]
            buckets = bucket[code[first]]
            whole = pa.RecordBatch.from_arrays([*columns, pa.array(buckets)], ["term", "block", "n", "max_tf", "min_dl", "ids", "tfs", "dls", "bucket"])
            starts = np.flatnonzero(np.append(True, buckets[1:] != buckets[:-1]))
            salt = int(block[0]) % salts
            held = [_written(whole.slice(x, y - x)) for x, y in zip(starts, np.append(starts[1:], len(buckets)), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array((buckets[starts] * salts + salt).astype(np.int32)), pa.array(held, pa.binary())], ["part", "rows"])

    return run


def _written(rows) -> bytes:
    import pyarrow as pa

    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(rows)
    return out.getvalue().to_pybytes()


def _opened(batches):
    """The rows that ``_packed`` has packed."""
    import pyarrow as pa

    for batch in batches:
        for rows in batch.column("rows"):
            yield from pa.ipc.open_stream(rows.as_buffer())


def _postings_schema(key: str) -> str:
    return f"term string, block long, n int, max_tf int, min_dl int, ids array<{key}>, tfs array<int>, dls array<int>"


class Store:
    """One version of a stored index; methods that change it return the next one."""

    def __init__(self, spark: SparkSession, path: str, manifest: Manifest):
        self.spark, self.path, self.manifest = spark, path.rstrip("/"), manifest

    # versions

    @classmethod
    def versions(cls, spark: SparkSession, path: str) -> list[int]:
        return [int(name[:-5]) for name in _names(spark, f"{path.rstrip('/')}/snapshots") if name.endswith(".json")]

    @classmethod
    def open(cls, spark: SparkSession, path: str, version: int | None = None) -> Store:
        """The latest version, or a given one."""
        try:
            known = cls.versions(spark, path)
            raw = json.loads(_read(spark, f"{path.rstrip('/')}/snapshots/{(version or max(known)):09d}.json"))
        except Exception as error:
            raise IndexFormatError(f"no readable index at {path}") from error
        if not isinstance(raw, dict) or raw.pop("format", None) != VERSION:
            raise IndexFormatError(f"an index of another version at {path}")
        return cls(spark, path, Manifest(**raw))

    @classmethod
    def create(cls, spark: SparkSession, path: str, buckets: int = BUCKETS) -> Store:
        """The latest version, or an empty one that isn't published yet."""
        known = cls.versions(spark, path)
        return cls.open(spark, path) if known else cls(spark, path, Manifest(buckets=buckets))

    def _next(self, manifest: Manifest) -> Store:
        manifest.version = self.manifest.version + 1
        _publish(self.spark, manifest.text(), f"{self.path}/snapshots/{manifest.version:09d}.json")
        return Store(self.spark, self.path, manifest)

    # changes

    def _add_segment(self, tokens: DataFrame) -> tuple[str, dict] | None:
        """Writes rows (id, tokens, chunk); the blocks of a task are of chunks of like length."""
        name = f"s{self.manifest.version + 1:09d}-{uuid.uuid4().hex[:8]}"
        where = f"{self.path}/docs/segment={name}"
        number = (F.monotonically_increasing_id() / BLOCK).cast("long")
        rows = tokens.withColumn("tokens", F.coalesce("tokens", F.array().cast("array<string>"))).withColumn("dl", F.size("tokens"))
        rows.sortWithinPartitions("dl", "id").select("id", number.alias("block"), "dl", "tokens", "chunk").write.option("compression", PACKING).parquet(where)
        docs = self.spark.read.schema(f"id {rows.schema['id'].dataType.simpleString()}, block long, dl int, tokens array<string>").parquet(where)
        found = docs.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("n_tokens")).first()
        if not found.n:
            return None
        key = docs.schema["id"].dataType.simpleString()
        # a bucket is dealt to as many tasks as there are for each, so that a frequent term isn't one task's
        buckets = self.manifest.buckets
        salts = max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")) // buckets)
        own = docs.withColumn("buckets", F.transform("tokens", lambda t: bucket(t, buckets)))
        tasks = min(buckets * salts, max(1, found.n_tokens // TASK))
        packed = own.mapInArrow(_packed(salts), "part int, rows binary").repartitionById(tasks, F.col("part") % tasks)
        opened = packed.mapInArrow(_opened, f"{_postings_schema(key)}, bucket int")
        opened.sortWithinPartitions("bucket", "term", "block").write.option("compression", PACKING).partitionBy("bucket").parquet(f"{self.path}/postings/segment={name}")
        return name, {"n": found.n, "n_tokens": found.n_tokens, "key": key, "chunk": rows.schema["chunk"].dataType.json(), "postings": found.n_tokens > 0}

    def _add_removal(self, ids: DataFrame) -> tuple[str, dict] | None:
        """Takes the live chunks of some ids out of their segments."""
        if not self.manifest.segments:
            return None
        name = f"c{self.manifest.version + 1:09d}-{uuid.uuid4().hex[:8]}"
        # tables of ids alone, whose size is known: Spark broadcasts few, so that chunks stay where they are
        asked = stored(ids.select("id").distinct(), "ids")
        where = f"{self.path}/removed/change={name}"
        self.docs("id", "segment", "dl").join(asked, "id", "left_semi").write.parquet(where)
        gone = self.spark.read.schema(f"id {self.key}, segment string, dl int").parquet(where)
        found = gone.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("n_tokens")).first()
        if not found.n:
            return None
        held = self.docs("id", "segment", "tokens").join(gone.select("id", "segment"), ["id", "segment"], "left_semi")
        terms = held.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
        terms.withColumn("bucket", bucket(F.col("term"), self.manifest.buckets)).repartition("bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{self.path}/forgotten/change={name}")
        return name, {"n": found.n, "n_tokens": found.n_tokens, "postings": found.n_tokens > 0}

    def apply(self, upserts: DataFrame | None = None, removals: DataFrame | None = None, stream: str | None = None, number: int = 0) -> Store:
        """The next version: upserts (id, tokens, chunk) replace chunks of the same ids, removals (id) take them out.

        A batch of a stream whose number isn't above the last one's is passed over, so a repeated batch changes nothing.
        """
        if stream is not None and self.manifest.batches.get(stream, -1) >= number:
            return self
        m = self.manifest
        ids = [df.select("id") for df in (upserts, removals) if df is not None]
        gone = self._add_removal(ids[0] if len(ids) == 1 else ids[0].unionByName(ids[1])) if ids else None
        new = self._add_segment(upserts) if upserts is not None else None
        batches = m.batches | ({stream: number} if stream is not None else {})
        return self._next(Manifest(m.version, m.buckets, m.segments | (dict([new]) if new else {}), m.removed | (dict([gone]) if gone else {}), batches))

    def replace(self, rows: DataFrame) -> Store:
        """The next version has these rows alone."""
        new = self._add_segment(rows)
        return self._next(Manifest(self.manifest.version, self.manifest.buckets, dict([new]) if new else {}, {}, dict(self.manifest.batches)))

    def compact(self) -> Store:
        """The next version has the same chunks in one segment."""
        return self.replace(spread(self.docs("id", "tokens", "chunk")))

    def vacuum(self, keep: int = 1) -> int:
        """Deletes the files that only versions before the last ``keep`` name; returns how many folders."""
        known = self.versions(self.spark, self.path)
        kept = [Store.open(self.spark, self.path, v).manifest for v in known[-keep:]]
        alive = {f"segment={s}" for m in kept for s in m.segments} | {f"change={c}" for m in kept for c in m.removed}
        gone = [f"{kind}/{name}" for kind in ("docs", "postings", "removed", "forgotten") for name in _names(self.spark, f"{self.path}/{kind}") if name not in alive]
        for name in [f"snapshots/{v:09d}.json" for v in known[:-keep]] + gone:  # manifests first: none names a folder that isn't there
            fs, where = _filesystem(self.spark, f"{self.path}/{name}")
            fs.delete(where, True)
        return len(gone)

    # reading

    def _tables(self, kind: str, part: str, names: Iterable[str], schema: str) -> DataFrame:
        """The tables of some segments or changes as one, which partition values tell apart."""
        paths = [f"{self.path}/{kind}/{part}={n}" for n in names]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.option("basePath", f"{self.path}/{kind}").schema(schema).parquet(*paths)

    @property
    def key(self) -> str:
        return next((s["key"] for s in self.manifest.segments.values()), "bigint")

    def _alive(self, rows: DataFrame) -> DataFrame:
        """Of rows with (id, segment) those that aren't removed."""
        if not self.manifest.removed:
            return rows
        gone = self._tables("removed", "change", self.manifest.removed, f"id {self.key}, segment string, change string")
        return rows.join(gone.select("id", "segment"), ["id", "segment"], "left_anti")

    def docs(self, *columns: str) -> DataFrame:
        """Live rows of id, segment, block, dl, tokens, chunk."""
        from pyspark.sql.types import StructType

        parts = []
        by_shape: dict[str, list[str]] = {}
        for name, s in self.manifest.segments.items():
            by_shape.setdefault(s["chunk"], []).append(name)
        for shape, names in by_shape.items():
            chunk = StructType.fromJson(json.loads(shape)).simpleString()
            parts.append(self._tables("docs", "segment", names, f"id {self.key}, block long, dl int, tokens array<string>, chunk {chunk}, segment string"))
        if not parts:
            return self.spark.createDataFrame([], f"id {self.key}, block long, dl int, tokens array<string>, chunk struct<text:string>, segment string").select(*columns)
        if len(parts) > 1 and "chunk" in columns:
            # chunks that came with other columns: a chunk has null in those that it lacks
            flat = [p.select("id", "segment", "block", "dl", "tokens", *[F.col(f"chunk.`{c}`").alias(f"chunk {c}") for c in p.schema["chunk"].dataType.names]) for p in parts]
            wide = flat[0]
            for p in flat[1:]:
                wide = wide.unionByName(p, allowMissingColumns=True)
            chunk = F.struct(*[F.col(f"`{c}`").alias(c[6:]) for c in wide.columns if c.startswith("chunk ")]).alias("chunk")
            return self._alive(wide).select("id", "segment", "block", "dl", "tokens", chunk).select(*columns)
        whole = parts[0]
        for p in parts[1:]:
            whole = whole.drop("chunk").unionByName(p.drop("chunk"))
        return self._alive(whole).select(*columns)

    def chunks(self) -> DataFrame:
        """The live chunks with the columns they came with."""
        own = self.docs("id", "chunk")
        names = own.schema["chunk"].dataType.names
        return own.select("id", *[F.col(f"chunk.`{c}`").alias(c) for c in names if c != "id"])

    def ask(self, terms: DataFrame | None) -> Asked:
        """How to find the rows of some terms: their buckets, and the terms if they are few, are literals, which Spark prunes files by."""
        if terms is None:
            return lambda table: table
        own = stored(terms.select("term").distinct().withColumn("bucket", bucket(F.col("term"), self.manifest.buckets)), "asked")
        few = own.limit(LISTED + 1).collect()
        if len(few) <= LISTED:
            buckets, listed = sorted({r.bucket for r in few}), sorted(r.term for r in few)
            return lambda table: table.filter(F.col("bucket").isin(buckets) & F.col("term").isin(listed))
        buckets = sorted(r.bucket for r in own.select("bucket").distinct().collect())  # no more than there are buckets
        return lambda table: (table.filter(F.col("bucket").isin(buckets)) if len(buckets) < self.manifest.buckets else table).join(own.select("term"), "term", "left_semi")

    def blocks(self, asked: Asked) -> DataFrame:
        """(term, segment, block, n, max_tf, min_dl, ids, tfs, dls) of asked terms; what isn't selected isn't read."""
        names = [n for n, s in self.manifest.segments.items() if s["postings"]]
        return asked(self._tables("postings", "segment", names, f"{_postings_schema(self.key)}, segment string, bucket int"))

    def opened(self, blocks: DataFrame, *also: str) -> DataFrame:
        """(term, segment, id, tf, dl) of the live chunks of blocks."""
        each = blocks.select("term", "segment", *also, F.inline(F.arrays_zip(F.col("ids").alias("id"), F.col("tfs").alias("tf"), F.col("dls").alias("dl"))))
        return self._alive(each)

    def postings(self, terms: DataFrame | None = None) -> DataFrame:
        """(term, id, tf, dl), of the given terms only if there are some."""
        return self.opened(self.blocks(self.ask(terms))).select("term", "id", F.col("tf").cast("long").alias("tf"), "dl")

    def frequencies(self, terms: DataFrame | None = None) -> DataFrame:
        """(term, df), from the counts of blocks: no posting is opened."""
        asked = self.ask(terms)
        return self._frequencies(asked)

    def _frequencies(self, asked: Asked) -> DataFrame:
        found = self.blocks(asked).select("term", "n")
        names = [n for n, r in self.manifest.removed.items() if r["postings"]]
        if names:
            gone = asked(self._tables("forgotten", "change", names, "term string, n long, change string, bucket int"))
            found = found.unionByName(gone.select("term", (-F.col("n")).alias("n")))
        return found.groupBy("term").agg(F.sum("n").cast("long").alias("df")).filter("df > 0")

    def totals(self) -> DataFrame:
        """One row: n, avgdl, n_tokens."""
        n, n_tokens = self.manifest.n, self.manifest.n_tokens
        return self.spark.range(1).select(F.lit(n).cast("long").alias("n"), F.lit(n_tokens / n if n else 0.0).alias("avgdl"), F.lit(n_tokens).cast("long").alias("n_tokens"))

    # pruning

    def lookup(self, terms: DataFrame) -> tuple[Asked, DataFrame, DataFrame]:
        """How to find some terms, their postings and their frequencies."""
        asked = self.ask(terms)
        return asked, self.opened(self.blocks(asked)).select("term", "id", F.col("tf").cast("long").alias("tf"), "dl"), self._frequencies(asked)

    def heads(self, asked: Asked, weighed: DataFrame, weight: Weight) -> DataFrame:
        """(query_id, term, segment, block, size, most): what a term can add to a chunk's score in a block of ``size`` postings.

        ``weighed`` has a row for each query and term, with what ``weight`` needs besides tf and dl.  A term and block that were
        written as several rows (see ``_packed``) are one here, whose bound is their highest: they are opened or set aside together.
        """
        own = self.blocks(asked).select("term", "segment", "block", F.col("n").alias("size"), "max_tf", "min_dl")
        each = own.join(weighed, "term").withColumn("most", weight(F.col("max_tf"), F.col("min_dl")))
        return each.groupBy(*BLOCK_KEY, "term").agg(F.sum("size").cast("int").alias("size"), F.max("most").alias("most")).select("query_id", "term", "segment", "block", "size", "most")

    def rows_of(self, asked: Asked, weighed: DataFrame, wanted: DataFrame, on: list[str]) -> DataFrame:
        """The postings of blocks that match ``wanted``, each with its query and term's columns; no others are opened."""
        wide = self.blocks(asked).select("term", "segment", "block", "ids", "tfs", "dls").join(weighed, "term").join(wanted, on, "left_semi")
        return self.opened(wide, "block", *[c for c in weighed.columns if c != "term"])

    def prune(self, asked: Asked, weighed: DataFrame, weight: Weight, top_k: int, slack: float = 0.0) -> Pruned:
        """What a ranking of the first top_k by sums of ``weight(tf, dl)`` has to read.

        ``weight`` must not fall as tf grows or dl falls.  A score may later rise by up to ``slack``.

        1. The SEEDS blocks with the highest bounds are scored; the score of the top_k-th chunk in them is the floor.
        2. Blocks whose bound doesn't reach the floor are skipped.
        3. In each of the others the terms that add least are set aside as long as all of them together don't reach the
           floor: a chunk with none of the remaining, essential ones can't either.  Essential postings are opened, and
           their chunks are kept if what they have and what the terms set aside can add reach the floor.
        4. Postings set aside are opened in blocks with such chunks alone.

        Queries of more than SPLIT terms end with step 2, as nearly every chunk has one of their essential terms.
        """
        block = BLOCK_KEY
        heads = stored(self.heads(asked, weighed, weight), "heads")
        bounds = heads.groupBy(*block).agg(F.sum("most").alias("bound"))
        best = Window.partitionBy("query_id").orderBy(F.col("bound").desc(), "segment", "block")
        seeds = bounds.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= SEEDS)
        scored = self.rows_of(asked, weighed, seeds.select(*block), block).groupBy("query_id", "segment", "id").agg(F.sum(weight(F.col("tf"), F.col("dl"))).alias("score"))
        best = Window.partitionBy("query_id").orderBy(F.col("score").desc())
        floor = scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") == top_k).select("query_id", (F.col("score") - (slack + SLACK)).alias("floor"))
        alive = bounds.join(floor, "query_id", "left").filter(F.col("floor").isNull() | (F.col("bound") >= F.col("floor")))
        alive = stored(heads.join(alive.drop("bound"), block), "alive")
        lengths = weighed.groupBy("query_id").agg((F.count("*") <= SPLIT).alias("short"))
        kinds = {r.short for r in lengths.select("short").distinct().collect()}
        whole = alive if kinds == {False} else alive.join(lengths.filter("NOT short"), "query_id", "left_semi")
        short = alive if kinds == {True} else alive.join(lengths.filter("short"), "query_id", "left_semi")
        ways = ([self._whole(asked, weighed, whole)] if False in kinds else []) + ([self._split(asked, weighed, weight, short)] if True in kinds else [])
        rows, opened = ways[0] if ways else self._whole(asked, weighed, alive)
        for more, also in ways[1:]:
            rows, opened = rows.unionByName(more), opened.unionByName(also)
        return Pruned(rows, heads, opened)

    def _whole(self, asked: Asked, weighed: DataFrame, alive: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The postings of all live blocks, and which blocks they are."""
        opened = alive.select(*BLOCK_KEY, "term", "size")
        return self.rows_of(asked, weighed, opened, [*BLOCK_KEY, "term"]), opened

    def _split(self, asked: Asked, weighed: DataFrame, weight: Weight, alive: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The same of chunks that reach the floor by what their essential terms have and the others can add."""
        block = BLOCK_KEY
        below = Window.partitionBy(*block).orderBy("most", "term")
        split = alive.withColumn("essential", F.col("floor").isNull() | (F.sum("most").over(below) >= F.col("floor")))
        split = stored(split.select(*block, "term", "size", "essential", "floor", F.when(~F.col("essential"), F.col("most")).alias("most")), "split")
        first = stored(self.rows_of(asked, weighed, split.filter("essential").select(*block, "term"), [*block, "term"]), "essential")
        rest = split.groupBy(*block).agg(F.coalesce(F.sum("most"), F.lit(0.0)).alias("rest"), F.max("floor").alias("floor"))
        partial = first.groupBy(*block, "id").agg(F.sum(weight(F.col("tf"), F.col("dl"))).alias("score"))
        chunks = partial.join(rest, block).filter(F.col("floor").isNull() | (F.col("score") + F.col("rest") >= F.col("floor")))
        chunks = stored(chunks.select(*block, "id"), "candidates")
        later = split.filter("NOT essential").join(chunks.select(*block).distinct(), block, "left_semi").select(*block, "term", "size")
        second = self.rows_of(asked, weighed, later, [*block, "term"])
        rows = first.unionByName(second).join(chunks.select("query_id", "segment", "id"), ["query_id", "segment", "id"], "left_semi")
        return rows, split.filter("essential").select(*block, "term", "size").unionByName(later)


#: Keeps the rows of asked terms of a table with columns term and bucket.
Asked = Callable[[DataFrame], DataFrame]
#: What a posting adds to a score, from its tf and dl.
Weight = Callable[[Column, Column], Column]


@dataclass
class Pruned:
    """``rows``: the postings of the chunks that may be among the first, with their query and term's columns.

    ``heads`` are all blocks of postings of the queries, ``opened`` those of them that were read.
    """

    rows: DataFrame
    heads: DataFrame
    opened: DataFrame
