"""Bounded conversation memory as list state of transformWithState (M1, M2): expiry by timer, initial state from a table.

A session's state is its last messages, oldest first, and grows by what comes: a message is put in its place and the oldest goes, so
that a micro-batch touches the kept messages of the sessions it holds and no others. What a micro-batch changed is emitted, a session
as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

MESSAGE = StructType([StructField("turn", LongType()), StructField("role", StringType()), StructField("text", StringType())])
OUT = "conv_id long, turn long, role string, text string"
#: Needed by the session before a stream with this state starts.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _order(m: tuple) -> tuple:
    """By turn, null first; messages of one turn by role and text, so that their order does not hang on arrival."""
    return (m[0] is not None, m[0] or 0, m[1] or "", m[2] or "")


class Memory(StatefulProcessor):
    """The n last messages of a session since its last message of role 'clear'; forgotten `idle_seconds` after it was last touched."""

    def __init__(self, n: int = 10, idle_seconds: int | None = None) -> None:
        self.n, self.idle = n, idle_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getListState("kept", MESSAGE)

    def _put(self, messages: list[tuple]) -> list[tuple]:
        messages = sorted(messages, key=_order)
        cleared = max((i for i, m in enumerate(messages) if m[1] == "clear"), default=-1)
        said = messages[cleared + 1 :][-self.n :]
        # the mark stays, so that what comes late and lies before it is not remembered
        kept = ([messages[cleared]] if cleared >= 0 else []) + said
        self.kept.put(kept) if kept else self.kept.clear()
        return said

    def _touched(self, now: int) -> None:
        if self.idle:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(now + self.idle * 1000)

    def handleInitialState(self, key, initialState, timerValues) -> None:  # noqa: N803  Spark's name
        rows = initialState if isinstance(initialState, list) else [initialState]
        old = [tuple(m) for m in self.kept.get()] if self.kept.exists() else []
        self._put(old + [(r["turn"], r["role"], r["text"]) for r in rows])

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N803
        messages = [tuple(m) for m in self.kept.get()] if self.kept.exists() else []
        for r in rows:
            messages.append((r["turn"], r["role"], r["text"]))
            if len(messages) > 8 * (self.n + 1):
                self._put(messages)
                messages = [tuple(m) for m in self.kept.get()]
        said = self._put(messages)
        self._touched(timerValues.getCurrentProcessingTimeInMs())
        for turn, role, text in said:
            yield Row(conv_id=key[0], turn=turn, role="user" if role == "user" else "assistant", text=text)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N803
        self.kept.clear()
        return iter(())

    def close(self) -> None:
        pass


def memory_state(turns: DataFrame, n: int = 10, idle_seconds: int | None = None, initial: DataFrame | None = None) -> DataFrame:
    """The memory of every session that a micro-batch of (conv_id, turn, role, text) touches, after it.

    initial: messages that sessions start from, such as the table of an earlier run; read by the first micro-batch alone.
    """
    start = initial.select("conv_id", "turn", "role", "text").groupBy("conv_id") if initial is not None else None
    mode = "ProcessingTime" if idle_seconds else "None"
    return turns.select("conv_id", "turn", "role", "text").groupBy("conv_id").transformWithState(Memory(n, idle_seconds), OUT, "Update", mode, start)


def run(turns: DataFrame, path: str, checkpoint: str, n: int = 10, **kw) -> None:
    """Takes what a stream of messages has now; every micro-batch is a folder batch=i of path with the memories that it changed.

    A repeated micro-batch writes its folder anew. With idle_seconds all that is there is one micro-batch, as timers of the clock
    would keep a run going for ever.
    """
    turns.sparkSession.conf.set(*PROVIDER)
    all_now = {"once": True} if kw.get("idle_seconds") else {"availableNow": True}

    def write(changed: DataFrame, i: int) -> None:
        changed.write.mode("overwrite").parquet(f"{path}/batch={i}")

    memory_state(turns, n, **kw).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("update").trigger(**all_now).start().awaitTermination()
