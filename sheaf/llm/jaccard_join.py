"""N-gram Jaccard join: a grouped prefix join of documents over their sets of five-word shingles.

1. Counts.  Every task sorts the shingle hashes of its documents and ships runs of them, dealt by hash range; a task
   for each range counts in how many documents each occurs and stores those in two or more as a sorted array.
2. Prefixes.  Documents are read again.  Shingles are ordered by count, then hash; two sets with a Jaccard index of at
   least 0.8 share one of the first n - ceil(0.8 n) + 1.  A shingle of one document can be shared by none, so a document
   whose prefix has no other has no partner.
3. Classes.  Documents with equal sets are one class.  Its set and its prefix go into a file of sorted arrays.
4. Groups.  Classes with the same size and the same prefix (the shingles of it that others have) are one group; a group
   of very many classes is several, each of about MEMBERS.  Only groups are listed, under the shingles of their prefixes
   and by bands of size: sets that link lie in the same band or in neighbours, so a list holds a band's groups and,
   as guests, those of the next.
5. Leads.  Each group of a list meets the list's first group: its members are verified against one member of that.  What
   links joins components, so a large group of near copies never becomes all its pairs.
6. Pairs.  Lists with more than one component are cut into blocks of about BLOCK classes, the largest component apart
   from the rest.  Blocks of the rest meet all blocks of the list, a task for each pair of blocks at a time.  There pairs
   of groups are filtered: by component, by size, by whether this list is the first of those they share, and by the
   number of shingles that both prefixes have, which bounds what the sets can share.  Groups of pairs that are left are
   expanded into their members and verified.  A task returns the links that join something, not all of them.

Shingles are 64-bit hashes.  Counts may take two of them for one (see counted.py), which can only change the order, never a
result.  A document is a row: a repeated row or copy is in the class of its text.  A null or empty text, or one without
words, has an empty set and links with nothing; its component is itself.  The component of a row with a null doc_id is the
least doc_id it is linked with, else null.  Only doc_id and text are read.  An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.llm import shared
from sheaf.llm.components import components
from sheaf.llm.counted import Counts, count_hashes
from sheaf.llm.words import Rolling, slices, words_of

SHINGLE, PERCENT = 5, 80
#: Classes of a group that are handled as one, and of a block of a list, on average.
MEMBERS, BLOCK = 64, 256
#: Hashes of a file of sets, and files of a task at most.
FILE, FILES = 1 << 20, 1 << 16
#: Hashes of sets, and columns of a table of them, that a task compares at once.
HASHES, COLUMNS = 1 << 20, 1 << 13

def shingle_sets(texts: pa.Array, n: int = SHINGLE):
    """For each text its distinct shingles, sorted 64-bit hashes."""
    words = words_of(texts, lower=True)
    h = words.hashes()
    rolling = Rolling(h)
    full = rolling.windows(n)
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= n:
            yield np.unique(full[a : b - n + 1])
        elif b > a:
            yield Rolling(h[a:b]).windows(b - a)
        else:
            yield h[:0]


DOCS = "doc_id long, text_hash long, n int, high long, low long, sign long, prefix array<long>, tokens binary"


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - -(-n * percent // 100) + 1


def _prefixes(counts: Counts):
    """For each document its size and, if it may have a partner, set hash, prefix hash, shared shingles of its prefix and its set."""

    def run(batches):
        for batch in batches:
            for piece in slices(batch, size=2 << 20):
                sets = list(shingle_sets(piece.column("text")))
                ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
                flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
                order = np.argsort(flat, kind="stable")
                df = np.empty(len(flat), np.int64)
                df[order] = counts.find(flat[order])
                alone = np.concatenate([[0], np.cumsum(df == 1)])
                rows: dict[str, list] = {k: [] for k in ("n", "high", "low", "sign", "prefix", "tokens")}
                for d, s in enumerate(sets):
                    a, b, n = ends[d], ends[d + 1], len(s)
                    p = prefix_length(n) if n else 0
                    rows["n"].append(n)
                    if not n or alone[b] - alone[a] >= p:
                        for k in ("high", "low", "sign", "prefix", "tokens"):
                            rows[k].append(None)
                        continue
                    rank = df[a:b]
                    first = np.argsort(rank, kind="stable")[:p]
                    whole = xxhash.xxh3_128_intdigest(s.tobytes())
                    rows["high"].append((whole >> 64) - 2**63)
                    rows["low"].append((whole & (2**64 - 1)) - 2**63)
                    prefix = np.sort(s[first][rank[first] > 1])
                    rows["sign"].append(xxhash.xxh3_64_intdigest(prefix.tobytes(), n) - 2**63)
                    rows["prefix"].append(prefix.view(np.int64))
                    rows["tokens"].append(s.tobytes())
                kinds = {"n": pa.int32(), "high": pa.int64(), "low": pa.int64(), "sign": pa.int64(), "prefix": pa.list_(pa.int64()), "tokens": pa.binary()}
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("text_hash")] + [pa.array(rows[k], t) for k, t in kinds.items()], ["doc_id", "text_hash", *kinds])

    return run


def _store(folder: str):
    """Writes the sets of a partition's classes to files of about FILE hashes; the id of a class is its file and its place there."""

    def run(batches):
        task, files = TaskContext.get().partitionId(), 0
        held: list[pa.RecordBatch] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal files, size
            table = pa.Table.from_batches(held)
            sets = [np.frombuffer(x, np.uint64) for x in table["tokens"].to_pylist()]
            firsts = [np.array(x, np.int64).view(np.uint64) for x in table["prefix"].to_pylist()]
            ends = lambda parts: np.concatenate([[0], np.cumsum([len(s) for s in parts])]).astype(np.int64)
            number = task * FILES + files
            shared.save(folder, f"sets-{number}", {"ends": ends(sets), "tokens": np.concatenate(sets), "prefix_ends": ends(firsts), "prefix": np.concatenate(firsts)})
            ids = pa.array((np.int64(number) << 24) + np.arange(len(sets)))
            held.clear()
            files, size = files + 1, 0
            return table.select(["high", "low", "least", "n", "sign", "prefix"]).append_column("class", ids).combine_chunks().to_batches()[0]

        for batch in batches:
            for piece in slices(batch, "tokens", 8 * FILE):
                held.append(piece)
                size += piece.column("tokens").nbytes // 8
                if size >= FILE or sum(x.num_rows for x in held) >= 1 << 23:
                    yield flush()
        if held:
            yield flush()

    return run


def _loader(folder: str, ends: str = "ends", values: str = "tokens"):
    """The set of a class, or its prefix: ascending hashes."""

    def load(c: int) -> np.ndarray:
        arrays = shared.load(f"{folder}/sets-{c >> 24}", 1024)
        at = c & (2**24 - 1)
        return arrays[values][arrays[ends][at] : arrays[ends][at + 1]]

    return load


def _verify(folder: str, percent: int):
    """Of pairs of classes (u, v), those that link."""

    load = _loader(folder)

    def run(batches):
        for batch in batches:
            u, v = (batch.column(k).to_numpy() for k in ("u", "v"))
            order, ok = np.argsort(u, kind="stable"), np.zeros(len(u), bool)
            starts = np.flatnonzero(np.concatenate([[True], np.diff(u[order]) != 0])) if len(u) else []
            for a, b in zip(starts, [*starts[1:], len(u)], strict=True):
                one = load(int(u[order[a]]))
                for k in range(a, b, 256):
                    at = order[k : min(b, k + 256)]
                    sets = [load(int(x)) for x in v[at]]
                    ends = np.cumsum([len(s) for s in sets])
                    flat = np.concatenate(sets)
                    slot = np.minimum(np.searchsorted(one, flat), len(one) - 1)
                    both = np.concatenate([[0], np.cumsum(one[slot] == flat)])[np.concatenate([[0], ends])]
                    both = np.diff(both)
                    ok[at] = 100 * both >= percent * (len(one) + np.diff(ends, prepend=0) - both)
            yield pa.RecordBatch.from_arrays([pa.array(u[ok]), pa.array(v[ok])], ["u", "v"])

    return run


def _runs(sets: list[np.ndarray]):
    """Neighbouring sets of about HASHES hashes together, at least one: (from, to, hashes in order, the set of each)."""
    ends, at = np.cumsum([len(s) for s in sets]), 0
    while at < len(sets):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + HASHES, "right")))
        flat = np.concatenate(sets[at:stop])
        order = np.argsort(flat, kind="stable")
        yield at, stop, flat[order], np.repeat(np.arange(stop - at), [len(s) for s in sets[at:stop]])[order]
        at = stop


def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many hashes each set of a has in common with each of b, as products of 0/1 tables of the hashes both sides have."""
    out = np.zeros((len(a), len(b)), np.int64)
    right = list(_runs(b))
    for a0, a1, x, of_x in _runs(a):
        for b0, b1, y, of_y in right:
            both = np.intersect1d(x, y)
            for k in range(0, len(both), COLUMNS):
                names, tables = both[k : k + COLUMNS], []
                for values, owner, size in ((x, of_x, a1 - a0), (y, of_y, b1 - b0)):
                    lo, hi = np.searchsorted(values, names[0]), np.searchsorted(values, names[-1], "right")
                    slot = np.searchsorted(names, values[lo:hi])
                    held = names[slot] == values[lo:hi]
                    one = np.zeros((size, len(names)), np.float32)
                    one[owner[lo:hi][held], slot[held]] = 1
                    tables.append(one)
                out[a0:a1, b0:b1] += (tables[0] @ tables[1].T).astype(np.int64)
    return out


def _spanning(links: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Of the links between classes those that join something; the others follow from them."""
    root: dict[int, int] = {}

    def find(c: int) -> int:
        while root.setdefault(c, c) != c:
            root[c] = c = root[root[c]]
        return c

    kept = []
    for i, j in zip(*(x.tolist() for x in np.nonzero(links)), strict=True):
        u, v = int(left[i]), int(right[j])
        p, q = find(u), find(v)
        if p != q:
            root[p] = q
            kept.append((u, v))
    return kept


class _Side:
    """The groups of a block, from a batch's column of arrays of structs."""

    def __init__(self, units: pa.StructArray, a: int, b: int):
        take = lambda name: units.field(name).slice(a, b - a).to_numpy(zero_copy_only=False)
        self.unit, self.n, self.root, self.guest = take("unit"), take("n").astype(np.int64), take("root"), take("guest")
        members = units.field("members")
        ends = members.offsets.to_numpy()[a : b + 1]
        self.members = [members.values.slice(x, y - x).to_numpy() for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def group_pairs(a: _Side, b: _Side, same: bool, token: np.uint64, prefix, percent: int) -> np.ndarray:
    """Which pairs of groups of two blocks of a list may hold a link that no other list's turn it is to find.

    Common prefix hashes up to where the prefix that ends first ends are all common hashes so far; that set has no more than
    n - prefix_length(n) behind it.  So c common ones in the prefixes allow c + n - prefix_length(n) in all, for one of the two n.
    """
    n, m = a.n[:, None], b.n[None, :]
    maybe = (100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & ~((a.root[:, None] == b.root[None, :]) & (a.root >= 0)[:, None]) & ~(a.guest[:, None] & b.guest[None, :])
    if same:
        maybe &= np.triu(np.ones(maybe.shape, bool))
        np.fill_diagonal(maybe, maybe.diagonal() & (a.root < 0))  # a group whose members aren't all joined meets itself
    rows, cols = np.flatnonzero(maybe.any(1)), np.flatnonzero(maybe.any(0))
    if not len(rows):
        return maybe
    x, y = [prefix(int(a.unit[i])) for i in rows], [prefix(int(b.unit[j])) for j in cols]
    earlier = overlaps([p[: np.searchsorted(p, token)] for p in x], [p[: np.searchsorted(p, token)] for p in y]) > 0
    rest = np.array([k - prefix_length(k) for k in a.n[rows].tolist()])[:, None], np.array([k - prefix_length(k) for k in b.n[cols].tolist()])[None, :]
    most = overlaps(x, y) + np.maximum(*rest)
    sizes = a.n[rows][:, None] + b.n[cols][None, :]
    maybe[np.ix_(rows, cols)] &= ~earlier & ((100 + percent) * most >= percent * sizes)
    return maybe


def _match(folder: str, percent: int):
    """Links between the classes of pairs of blocks (token, a, b)."""
    load, prefix = _loader(folder), _loader(folder, "prefix_ends", "prefix")

    def run(batches):
        for batch in batches:
            sides = [(batch.column(c).values, batch.column(c).offsets.to_numpy()) for c in ("a", "b")]
            found: list[tuple[int, int]] = []
            for k, token in enumerate(batch.column("token").to_numpy()):
                a, b = (_Side(units, int(ends[k]), int(ends[k + 1])) for units, ends in sides)
                same = np.array_equal(a.unit, b.unit)
                pairs = group_pairs(a, b, same, np.int64(token).view(np.uint64), prefix, percent)
                rows, cols = np.flatnonzero(pairs.any(1)), np.flatnonzero(pairs.any(0))
                if not len(rows):
                    continue
                left, right = (np.concatenate([s.members[i] for i in which]) for s, which in ((a, rows), (b, cols)))
                of_left, of_right = (np.repeat(which, [len(s.members[i]) for i in which]) for s, which in ((a, rows), (b, cols)))
                both = overlaps([load(int(c)) for c in left], [load(int(c)) for c in right])
                links = pairs[of_left][:, of_right] & (left[:, None] != right[None, :])
                links &= 100 * both >= percent * (a.n[of_left][:, None] + b.n[of_right][None, :] - both)
                found += _spanning(links, left, right)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (list(zip(*found, strict=True)) or [(), ()])], ["u", "v"])

    return run


def _band(n: Column, percent: int) -> Column:
    """Sizes that differ by no more than linked sets may lie in the same band or in neighbours; the factor is for rounding."""
    return F.floor(F.log(n) / (F.log(F.lit(100 / percent)) * (1 + 1e-9))).cast("int")


def _links(stored: DataFrame, folder: str, percent: int) -> DataFrame:
    """(node, root) of linked classes, from the stored classes (class, n, sign, prefix)."""
    spark = stored.sparkSession
    sizes = stored.groupBy("n", "sign").agg(F.count("*").alias("size"))
    part = F.pmod(F.xxhash64("class"), F.ceil(F.col("size") / MEMBERS)).alias("part")
    units = stored.select("n", "sign", "class", "prefix").join(sizes, ["n", "sign"]).groupBy("n", "sign", part).agg(F.min("class").alias("unit"), F.min("prefix").alias("prefix"), F.array_sort(F.collect_list("class")).alias("members"))
    units = shared.table(units.select("unit", "n", "prefix", "members"), folder, "units")
    members = units.select("unit", "n", F.explode("members").alias("class"))

    def lists(table: DataFrame, *columns: str) -> DataFrame:
        """A row for each group and hash of its prefix, in the list of its band and, as a guest, in that of the band below."""
        own = F.struct(_band(F.col("n"), percent).alias("band"), F.lit(False).alias("guest"))
        below = F.struct((_band(F.col("n"), percent) - 1).alias("band"), F.lit(True).alias("guest"))
        return table.select(*columns, F.explode(F.array(own, below)).alias("list"), "prefix").select(*columns, "list.*", F.explode("prefix").alias("token"))

    near = lambda a, b: (100 * a >= percent * b) & (100 * b >= percent * a)
    every = lists(units, "unit", "n")
    lead = every.filter("NOT guest").groupBy("token", "band").agg(F.min(F.struct("unit", "n")).alias("lead"))
    pairs = every.join(lead, ["token", "band"]).filter(near(F.col("n"), F.col("lead.n"))).select(F.col("lead.unit").alias("u"), "unit").distinct()
    pairs = pairs.join(members.select("unit", F.col("class").alias("v")), "unit").filter("u <> v").select("u", "v")
    links = shared.table(pairs.repartition("u", "v").mapInArrow(_verify(folder, percent), "u long, v long"), folder, "links-0")
    found = components(links, folder, "first")

    # a group's component; below 0, and its own, where its members lie in several
    rooted = members.join(found.select(F.col("node").alias("class"), "root"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    state = rooted.groupBy("unit").agg(F.when(F.min("root") == F.max("root"), F.min("root")).otherwise(-1 - F.col("unit")).alias("root"))
    placed = shared.table(units.join(state, "unit").withColumn("size", F.size("members")), folder, "placed")
    parts = lists(placed, "root", "size").groupBy("token", "band", "root").agg(F.sum("size").alias("size"), F.bool_or(~F.col("guest")).alias("home"))
    whole = parts.groupBy("token", "band").agg(
        F.count("*").alias("roots"), F.bool_or("home").alias("home"), F.min("root").alias("least"), F.sum("size").alias("size"), F.max_by(F.struct("root", "size"), F.struct("size", "root")).alias("top")
    )
    several = whole.filter("home AND (roots > 1 OR least < 0)").select("token", "band", F.col("size").alias("all"), "top")
    main = (F.col("root") == F.col("top.root")) & (F.col("root") >= 0)
    count = F.when(F.col("main"), F.col("top.size")).when(F.col("top.root") >= 0, F.col("all") - F.col("top.size")).otherwise(F.col("all"))
    cut = lists(placed, "unit", "root").join(several, ["token", "band"]).withColumn("main", main).withColumn("block", F.pmod(F.xxhash64("unit"), F.ceil(count / BLOCK)))
    cut = cut.select("token", "band", "main", "block", "unit", "guest").join(placed.select("unit", "n", "root", "members"), "unit")
    blocks = cut.groupBy("token", "band", "main", "block").agg(F.array_sort(F.collect_list(F.struct("unit", "n", "root", "guest", "members"))).alias("units"))
    blocks = shared.table(blocks, folder, "blocks")
    side = lambda s: blocks.select("token", "band", *[F.col(c).alias(f"{c}_{s}") for c in ("main", "block", "units")])
    met = side("a").filter("NOT main_a").join(side("b"), ["token", "band"]).filter("main_b OR block_a <= block_b")
    # lists with the same groups are one, under their first shingle in the order of unsigned numbers
    order = F.col("token").bitwiseXOR(F.lit(-(2**63)))
    met = met.groupBy(F.col("units_a").alias("a"), F.col("units_b").alias("b")).agg(F.min_by("token", order).alias("token"))
    met = met.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("token", "a", "b"))
    more = shared.table(met.mapInArrow(_match(folder, percent), "u long, v long"), folder, "links-1")
    return components(found.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(more), folder, "last")


ROWS = ("doc_id", "text_hash", "n_shingles", "component_id")


def _labelled(documents: DataFrame, percent: int) -> DataFrame:
    """ROWS and root, the class that names the component, for each row; root is null where no other row can be linked."""
    spark, folder = documents.sparkSession, shared.folder(documents.sparkSession, "jaccard")
    texts = documents.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    shards = max(64, 4 * texts.rdd.getNumPartitions())
    counts = count_hashes(texts, lambda piece: shingle_sets(piece.column("text")), folder, shards)
    docs = shared.table(texts.mapInArrow(_prefixes(counts), DOCS), folder, "documents")

    maybe = docs.filter(F.col("sign").isNotNull())
    # equal sets meet before the shuffle, so the copies of a text are one row a task
    classes = maybe.groupBy("high", "low").agg(F.min("doc_id").alias("least"), F.min("n").alias("n"), F.min("sign").alias("sign"), F.min("prefix").alias("prefix"), F.min("tokens").alias("tokens"))
    # in one order, so that a task that runs again gives the same ids
    stored = classes.select("high", "low", "least", "n", "sign", "prefix", "tokens").sortWithinPartitions("high", "low")
    stored = shared.table(stored.mapInArrow(_store(folder), "high long, low long, least long, n int, sign long, prefix array<long>, class long"), folder, "classes")

    final = _links(stored, folder, percent).withColumnRenamed("node", "class")
    named = stored.select("high", "low", "least", "class").join(final, "class", "left").withColumn("root", F.coalesce("root", "class"))
    named = shared.table(named, folder, "named")
    roots = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_set = named.join(roots, "root").select("high", "low", "root", "component_id")
    linked = maybe.select("doc_id", "text_hash", "n", "high", "low").join(by_set, ["high", "low"], "left").select("doc_id", "text_hash", F.col("n").cast("long").alias("n_shingles"), "component_id", "root")
    alone = docs.filter(F.col("sign").isNull()).select("doc_id", "text_hash", F.col("n").cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("root"))
    return linked.unionByName(alone)


def jaccard_components(documents: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, text_hash, n_shingles, component_id) for each row of (doc_id, text); the hash is Spark's xxhash64."""
    return _labelled(documents, percent).select(*ROWS)


GOES, REPEATED = 1, 2


def _store_fates(folder: str):
    """Stores what becomes of rows, sorted by the hash of the text and the doc_id."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        part, table = key[0].as_py(), table.append_column("none", pc.is_null(table["doc_id"]))
        table = table.set_column(table.schema.get_field_index("doc_id"), "doc_id", pc.fill_null(table["doc_id"], 0)).sort_by([(c, "ascending") for c in ("text_hash", "none", "doc_id")])
        shared.save(folder, f"fates-{part:06d}", {c: table[c].to_numpy() for c in ("text_hash", "none", "doc_id", "fate")})
        return pa.table({"part": pa.array([part], pa.int32())})

    return run


def _fate_is(folder: str, stored: np.ndarray, wanted: int, names: list[str], hidden: tuple[str, str]):
    """The rows whose fate is the wanted one (0: they aren't listed), without the hidden columns: hash of the text, part."""

    def run(batches):
        for batch in batches:
            for piece in slices(batch):
                ids, (hashes, parts) = piece.column("doc_id"), (piece.column(c).to_numpy() for c in hidden)
                none, ids = ids.is_null().to_numpy(zero_copy_only=False), pc.fill_null(ids, 0).to_numpy(zero_copy_only=False)
                fates = np.zeros(len(hashes), np.int64)
                for k in np.flatnonzero(stored[parts]).tolist():
                    arrays = shared.load(f"{folder}/fates-{parts[k]:06d}", 1024)
                    a, b = np.searchsorted(arrays["text_hash"], [hashes[k]])[0], np.searchsorted(arrays["text_hash"], [hashes[k]], "right")[0]
                    if a < b:
                        middle = a + int(np.searchsorted(arrays["none"][a:b], True))
                        a, b = (middle, b) if none[k] else (a, middle)
                        at = a + int(np.searchsorted(arrays["doc_id"][a:b], ids[k]))
                        if at < b and arrays["doc_id"][at] == ids[k]:
                            fates[k] = arrays["fate"][at]
                yield piece.select(names).filter(pa.array(fates == wanted))

    return run


def keep_one(documents: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The documents, all columns, with one row of each component: the one with the least doc_id, then the least hash of its text.

    A null doc_id comes last.  Of rows that share both doc_id and text one stays, it isn't said which.  Documents with an
    empty set, or with a set that no other can be near to, stay.  Rows that go are looked up in sorted arrays, so the
    documents themselves aren't shuffled.
    """
    folder = shared.folder(documents.sparkSession, "keep-one")
    found = shared.table(_labelled(documents, percent).filter("root IS NOT NULL"), folder, "components")
    # the best row of a component by its root, then rows by keys of their own: a large component is no key of a join
    best = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("best")).select(F.struct("best.doc_id", "best.text_hash").alias("kept"))
    rows = found.groupBy(F.struct("doc_id", "text_hash").alias("row")).agg(F.count("*").alias("times"))
    rows = rows.join(best, F.col("row").eqNullSafe(F.col("kept")), "left")
    fates = rows.select("row.*", F.when(F.col("kept").isNull(), GOES).when(F.col("times") > 1, REPEATED).alias("fate")).filter("fate IS NOT NULL")
    # by doc_id too: a text may have very many copies
    ranges = max(64, 4 * documents.rdd.getNumPartitions())
    part = lambda text_hash: F.pmod(F.xxhash64("doc_id", text_hash), F.lit(ranges)).cast("int")
    fates = shared.table(fates.withColumn("part", part(F.col("text_hash"))), folder, "fates")
    stored = np.zeros(ranges, bool)
    stored[[r["part"] for r in fates.groupBy("part").applyInArrow(_store_fates(folder), "part int").collect()]] = True
    hidden = tuple(shared.fresh("hash", "part"))
    named = documents.withColumn(hidden[0], F.xxhash64("text")).withColumn(hidden[1], part(F.col(hidden[0])))
    with_fate = lambda wanted: named.mapInArrow(_fate_is(folder, stored, wanted, documents.columns, hidden), documents.schema)
    if fates.filter(F.col("fate") == REPEATED).isEmpty():
        return with_fate(0)
    return with_fate(0).unionByName(with_fate(REPEATED).dropDuplicates(["doc_id", "text"]))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id")
