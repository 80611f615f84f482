"""Live conversations as state of a stream: what each owner's chats remember, and what is sent with each question.

The state of an owner is a map of chats, each with its last ``Limits.stored`` messages, and the order in which they were last
spoken in.  A message that makes an owner's chats more than ``Limits.chats`` drops the one that has been silent longest;
if it speaks again it starts anew.  With ``Limits.idle`` a chat whose last message is more than that long before a message of its owner,
in units of ``at``, is dropped too.

Messages are taken in the order of ``at`` within a batch and in that of batches across them.  A batch's messages of one owner are
sorted in memory; bound batches by the source's maxBytesPerTrigger.  A batch that is repeated after a failure starts from the
state before it, so each message counts once.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

MESSAGE = "array<struct<role:string,text:string>>"
OUT = f"owner long, chat long, at long, role string, text string, history {MESSAGE}, n_stored long, n_chats long"


@dataclass(frozen=True)
class Limits:
    """Messages kept of a chat, chats of an owner, messages sent with a question, and how long a chat may be silent."""

    stored: int = 40
    chats: int = 30
    sent: int = 20
    idle: int | None = None

    def __post_init__(self) -> None:
        if min(self.stored, self.chats) < 1 or self.sent < 0 or self.idle is not None and self.idle < 1:
            raise ValueError("limits must be positive; none may be sent")


class Chats(StatefulProcessor):
    """A row for each message: what was sent with it, and how much is kept after it."""

    def __init__(self, limits: Limits):
        self.limits = limits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.chats = handle.getMapState("chats", "chat long", f"messages {MESSAGE}")
        self.order = handle.getValueState("order", "chats array<long>, ats array<long>")  # the last spoken in comes last

    def handleInputRows(self, key, rows, timerValues) -> Iterator:  # noqa: N802, N803
        import pandas as pd

        batch = pd.concat(list(rows)).sort_values(["at", "chat"], kind="stable")
        order: dict[int, int] = dict(zip(*self.order.get(), strict=True)) if self.order.exists() else {}
        held: dict[int, list[tuple[str | None, str | None]]] = {}
        out = []
        for chat, at, role, text in zip(batch["chat"].tolist(), batch["at"].tolist(), batch["role"].tolist(), batch["text"].tolist(), strict=True):
            silent = [c for c, last in order.items() if self.limits.idle is not None and at - last > self.limits.idle]
            for c in silent:
                del order[c]
                held[c] = []
            if chat not in held:
                known = chat in order
                held[chat] = [tuple(m) for m in self.chats.getValue((chat,))[0]] if known else []
            messages = held[chat]
            sent = messages[len(messages) - self.limits.sent :] if self.limits.sent < len(messages) else list(messages)
            messages.append((role, text))
            del messages[: -self.limits.stored]
            order.pop(chat, None)
            order[chat] = at
            if len(order) > self.limits.chats:
                first = next(iter(order))
                del order[first]
                held[first] = []
            out.append((key[0], chat, at, role, text, [{"role": r, "text": t} for r, t in sent[: self.limits.sent]], len(messages), len(order)))
        for chat, messages in held.items():
            if chat in order:
                self.chats.updateValue((chat,), (messages,))
            elif self.chats.containsKey((chat,)):
                self.chats.removeKey((chat,))
        self.order.update((list(order), list(order.values())))
        yield pd.DataFrame(out, columns=["owner", "chat", "at", "role", "text", "history", "n_stored", "n_chats"])

    def close(self) -> None:
        pass


_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def state_on_disk(spark: SparkSession):
    """Stateful processors keep their state in RocksDB, so it may exceed an executor's memory."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


def remember(messages: DataFrame, limits: Limits = Limits()) -> DataFrame:  # noqa: B008
    """A stream with a row (owner, chat, at, role, text, history, n_stored, n_chats) for each of (owner, chat, at, role, text)."""
    wide = messages.select(*[F.col(c).cast("long").alias(c) for c in ("owner", "chat", "at")], "role", "text")
    return wide.groupBy("owner").transformWithStateInPandas(Chats(limits), OUT, "Append", "None")


def run(messages: DataFrame, folder: str, limits: Limits = Limits()) -> DataFrame:  # noqa: B008
    """Runs the stream until it has no more at hand; all rows that it has given so far."""
    spark = messages.sparkSession
    with state_on_disk(spark):
        said = remember(messages, limits)
        said.writeStream.format("parquet").option("path", f"{folder}/said").option("checkpointLocation", f"{folder}/_checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(OUT).parquet(f"{folder}/said")
