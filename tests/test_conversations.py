"""State of conversations over several batches against a plain simulation: eviction by count of messages and of chats, silence."""

import random

import pytest

from sheaf.streaming.conversations import Limits, run

SCHEMA = "owner long, chat long, at long, role string, text string"


def simulate(batches, limits):
    owners, last, out = {}, {}, []
    for batch in batches:
        for owner, chat, at, role, text in sorted(batch, key=lambda r: (r[2], r[1])):
            chats = owners.setdefault(owner, {})
            for c in [c for c in chats if limits.idle is not None and at - last[owner, c] > limits.idle]:
                del chats[c]
            last[owner, chat] = at
            messages = chats.pop(chat, [])
            sent = messages[-limits.sent :] if limits.sent else []
            chats[chat] = (messages + [(role, text)])[-limits.stored :]
            if len(chats) > limits.chats:
                del chats[next(iter(chats))]
            out.append((owner, chat, at, role, text, sent, len(chats[chat]), len(chats)))
    return out


def rows_of(found):
    return sorted(((*r[:5], [tuple(h) for h in r.history], r.n_stored, r.n_chats) for r in found.collect()), key=repr)


def feed(spark, tmp_path, batches, limits):
    log, folder = f"file://{tmp_path}/log", f"file://{tmp_path}/out"
    for batch in batches:
        spark.createDataFrame(batch, SCHEMA).repartition(2).write.mode("append").parquet(log)
        found = run(spark.readStream.schema(SCHEMA).parquet(log), folder, limits)
    return found


@pytest.mark.parametrize("limits", [Limits(stored=5, chats=3, sent=4), Limits(stored=2, chats=1, sent=0), Limits(chats=4, idle=9)])
def test_chats_across_batches(spark, tmp_path, limits):
    rng = random.Random(6)
    at, batches = 0, []
    for _ in range(3):
        batch = []
        for _ in range(40):
            at += 1
            batch.append((rng.randrange(2), rng.randrange(5), at, rng.choice(["user", "assistant"]), rng.choice(["", None, f"said {at}"])))
        batches.append(batch)
    assert rows_of(feed(spark, tmp_path, batches, limits)) == sorted(simulate(batches, limits), key=repr)
    again = run(spark.readStream.schema(SCHEMA).parquet(f"file://{tmp_path}/log"), f"file://{tmp_path}/out", limits)
    assert again.count() == 120  # nothing new, nothing twice


def test_limits():
    for bad in ({"chats": 0}, {"stored": 0}, {"sent": -1}, {"idle": 0}):
        with pytest.raises(ValueError):
            Limits(**bad)
