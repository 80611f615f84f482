"""Many strings looked for in many texts at once: one automaton for all of them, run over Arrow batches.

``find`` gives the pairs of rows and patterns that they contain, so that rules, signals or passages are joined to what they were found
in, whatever their number: no text is tried against each pattern.  The automaton (Aho-Corasick) reads a text once.  Patterns
are dealt to blocks of about BLOCK bytes by their hash; a block is what is sent to the tasks, and each block reads the
texts once more.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.storage import spread, stored

#: Bytes of patterns of an automaton, on average.
BLOCK = 1 << 20

_BUILT: dict[str, object] = {}


def _automaton(name: str, patterns: list[str]):
    """A worker's automaton; it keeps the last one."""
    if name not in _BUILT:
        import ahocorasick

        made = ahocorasick.Automaton()
        for k, pattern in enumerate(patterns):
            made.add_word(pattern, k)
        made.make_automaton()
        _BUILT.clear()
        _BUILT[name] = made
    return _BUILT[name]


def _search(name: str, sent):
    def run(batches):
        import pyarrow as pa

        patterns = sent.value
        automaton = _automaton(name, patterns)
        for batch in batches:
            row, found = [], []
            for k, text in enumerate(batch.column("text").to_pylist()):
                hits = {v for _, v in automaton.iter(text)} if text else ()
                row += [k] * len(hits)
                found += [patterns[v] for v in sorted(hits)]
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(row, pa.int64())), pa.array(found, pa.string())], ["key", "pattern"])

    return run


def find(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """(key, pattern) for each row of texts (key, text) and each distinct pattern of patterns (pattern) that its text contains.

    Null and empty patterns are in nothing, as nothing is in a null text.  A row with a repeated key counts by itself.
    """
    spark = texts.sparkSession
    known = stored(patterns.filter("pattern <> ''").select("pattern").distinct(), "patterns")
    size = known.agg(F.coalesce(F.sum(F.octet_length("pattern")), F.lit(0)).alias("bytes")).first().bytes
    kind = texts.schema["key"].dataType.simpleString()
    texts, blocks = spread(texts.select("key", F.col("text").cast("string").alias("text"))), -(-size // BLOCK)
    out = spark.createDataFrame([], f"key {kind}, pattern string")
    for b in range(blocks):
        own = [r.pattern for r in known.filter(F.pmod(F.xxhash64("pattern"), F.lit(blocks)) == b).collect()]
        if own:
            out = out.unionByName(texts.mapInArrow(_search(uuid.uuid4().hex, spark.sparkContext.broadcast(own)), out.schema))
    return out


def triggered(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """(key, rule) of the rules of (rule, trigger, whole) with a trigger in the text of rows (key, text), each once.

    With ``whole`` a trigger counts only where no Latin letter or digit stands next to it.  Texts are taken as they are: fold case before.
    """
    found = find(rows, rules.select(F.col("trigger").alias("pattern"))).join(rules.withColumnRenamed("trigger", "pattern"), "pattern")
    loose = found.filter(~F.col("whole")).select("key", "rule")
    # of the few pairs that are left, those whose trigger stands alone
    alone = found.filter("whole").join(rows, "key").filter(F.rlike("text", _alone(F.col("pattern")))).select("key", "rule")
    return loose.unionByName(alone).distinct()


def _alone(pattern: Column) -> Column:
    return F.concat(F.lit(r"(?<![a-z0-9])\Q"), F.replace(pattern, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit(r"\E(?![a-z0-9])"))


def expand_by(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """Texts with what the rules of (rule, trigger, whole, extra) add, in the order of the rules: (key, text, expanded).

    A rule may have many rows, one for each of its triggers; keys are unique.
    """
    said = rules.groupBy("rule").agg(F.first("extra", ignorenulls=True).alias("extra"))
    added = triggered(rows.select("key", F.lower("text").alias("text")), rules).join(said, "rule").groupBy("key")
    added = added.agg(F.transform(F.array_sort(F.collect_list(F.struct("rule", "extra"))), lambda s: s["extra"]).alias("added"))
    return rows.join(added, "key", "left").select("key", "text", F.concat_ws(" ", "text", "added").alias("expanded"))


def route_by(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """The target of the first rule of (rule, trigger, whole, target) that a text triggers: (key, text, target), null if none does."""
    said = rules.groupBy("rule").agg(F.first("target", ignorenulls=True).alias("target"))
    first = triggered(rows.select("key", F.lower("text").alias("text")), rules).groupBy("key").agg(F.min("rule").alias("rule")).join(said, "rule").select("key", "target")
    return rows.join(first, "key", "left").select("key", "text", "target")
