"""Many patterns in many texts against plain search: blocks, overlaps, odd texts, and rules by the ten thousand."""

import random

from pyspark.sql import functions as F

from sheaf.functions import rules
from sheaf.operators import patterns
from sheaf.operators import query as Q

TEXTS = [(1, "ab abc bcd"), (2, ""), (3, None), (4, "xABCx"), (1, "abc again"), (5, "日本語 text"), (6, "a" * 5000), (7, "née \\E end")]
PATTERNS = ["a", "ab", "abc", "bcd", "ABC", "本語", "", "zzz", "née", "\\E", "aaa", "x" * 300]


def pairs(found):
    return sorted((r.key, r.pattern) for r in found.collect())


def test_find(spark, monkeypatch):
    texts = spark.createDataFrame(TEXTS, "key long, text string").repartition(3)
    listed = spark.createDataFrame([(p,) for p in PATTERNS + PATTERNS[:3]] + [(None,)], "pattern string")
    want = sorted((k, p) for k, t in TEXTS for p in PATTERNS if p and t and p in t)
    assert pairs(patterns.find(texts, listed)) == want
    monkeypatch.setattr(patterns, "BLOCK", 40)  # several automata, one of them of a single long pattern
    assert pairs(patterns.find(texts, listed)) == want
    assert pairs(patterns.find(texts, listed.limit(0))) == [] and pairs(patterns.find(texts.limit(0), listed)) == []


def test_twenty_thousand_rules(spark):
    """Each rule has two triggers, one of which must stand alone; the plan doesn't grow with them."""
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    table = [(k, word(), bool(j), f"extra{k}") for k in range(20_000) for j in (0, 1)]
    texts = [(k, " ".join(rng.choice(table)[1] + rng.choice(["", "", "x"]) for _ in range(8))) for k in range(60)]
    rows = spark.createDataFrame(texts, "key long, text string")
    listed = spark.createDataFrame(table, "rule int, trigger string, whole boolean, extra string")

    def alone(t, p):
        return any((i == 0 or t[i - 1] not in "abcdefghijklmnopqrstuvwxyz0123456789") and t[i + len(p) : i + len(p) + 1] not in list("abcdefghijklmnopqrstuvwxyz0123456789") for i in range(len(t)) if t.startswith(p, i))

    found = {k: {r for r, p, whole, _ in table if p in t and (not whole or alone(t, p))} for k, t in texts}
    want = [(k, t, " ".join([t, *[f"extra{r}" for r in sorted(found[k])]])) for k, t in texts]
    expanded = patterns.expand_by(rows, listed)
    assert sorted(map(tuple, expanded.collect())) == want and all(found.values())
    assert len(expanded._jdf.queryExecution().optimizedPlan().toString()) < 20_000
    routed = patterns.route_by(rows, listed.withColumnRenamed("extra", "target"))
    assert {r.key: r.target for r in routed.collect()} == {k: f"extra{min(f)}" for k, f in found.items()}


def test_aliases_as_a_table(spark):
    said = ["How many credits and careers does AIT have?", "数据科学 学分 多少", "waiting for information technology", "", "ait2 co-op"]
    rows = spark.createDataFrame(list(enumerate(said)), "key long, text string")
    table = [(k, n, n.isascii(), extra) for k, (names, extra) in enumerate(rules.ALIASES) for n in names]
    found = patterns.expand_by(rows, spark.createDataFrame(table, "rule int, trigger string, whole boolean, extra string"))
    want = {r.key: r.a for r in rows.select("key", Q.add_aliases(F.col("text")).alias("a")).collect()}
    assert {r.key: r.expanded for r in found.collect()} == want
