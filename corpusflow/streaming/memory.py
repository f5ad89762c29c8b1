"""Conversation memory: the last turns of each conversation, in batch and as a stream."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

from ..operators.qa import plausible

#: Turns that memory holds, and how many of their questions go before the current one.
HELD, USED = 3, 2
#: What is remembered as the answer to a question whose best passage cannot answer it.
NOT_FOUND = "not found"


def with_history(turns: DataFrame, used: int = USED) -> DataFrame:
    """Turns (conv_id, turn, question, any others) with history, the questions of the ``used`` turns before, and query, the question followed by them."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-used, -1)
    return turns.withColumn("history", F.collect_list("question").over(w)).withColumn("query", F.concat_ws(" ", "question", F.array_join("history", " ")))


def with_outcomes(turns: DataFrame) -> DataFrame:
    """Turns (conv_id, turn, ts, question, passage, span) with answer and remembered, as a pipeline that answers them decides.

    Without a passage or a span the turn returns early: it answers NOT_FOUND and is not remembered. A passage that cannot
    answer the question makes it NOT_FOUND too, but is remembered as such; else the answer is the span.
    """
    missing: Column = (F.coalesce("passage", F.lit("")) == "") | (F.coalesce("span", F.lit("")) == "")
    answer = F.when(missing | ~plausible(F.col("question"), F.col("passage")), NOT_FOUND).otherwise(F.col("span"))
    return turns.select("conv_id", "turn", "ts", "question", answer.alias("answer"), (~missing).alias("remembered"))


_TURN = "turn long, ts long, question string, answer string, remembered boolean"
REMEMBERED = "conv_id long, turn long, question string, answer string, query string, memory array<struct<question:string,answer:string>>"


class _Memory(StatefulProcessor):
    """Typed state of one conversation: turns that wait for their time, and the last ``HELD`` remembered ones.

    A turn waits in a buffer until the watermark has passed it, then leaves in order of (time, turn), so batches may bring
    turns in any order within the stream's delay. A timer stands at the earliest waiting turn; once none
    waits, one stands where the conversation has been idle for too long, and clears it.
    """

    def __init__(self, idle_ms: int | None):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _TURN)
        self.held = handle.getListState("held", "ts long, question string, answer string")
        self.last = handle.getValueState("last", "ts long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        new = [(int(r.turn), int(r.ms), r.question, r.answer, bool(r.remembered)) for frame in rows for r in frame.itertuples(index=False)]
        self.waiting.appendList(new)
        for ms in {r[1] for r in new}:
            self.handle.registerTimer(ms)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        rows = sorted(tuple(r) for r in self.waiting.get()) if self.waiting.exists() else []
        due, later = [r for r in rows if r[1] <= now], [r for r in rows if r[1] > now]
        due.sort(key=lambda r: (r[1], r[0]))
        last = self.last.get()[0] if self.last.exists() else None
        held = [tuple(r) for r in self.held.get()] if self.held.exists() else []
        out = []
        for turn, ts, question, answer, remembered in due:
            if self.idle_ms is not None and last is not None and ts - last > self.idle_ms:
                held = []
            out.append((key[0], turn, question, answer, " ".join([question, *[q for _, q, _ in held[-USED:]]]), [{"question": q, "answer": a} for _, q, a in held]))
            last = ts
            if remembered:
                held = [*held, (ts, question, answer)][-HELD:]
        if due:
            self.waiting.put(later) if later else self.waiting.clear()
            self.held.put(held) if held else self.held.clear()
            self.last.update((last,))
            if self.idle_ms is not None:
                self.handle.registerTimer(last + self.idle_ms + 1)
        elif self.idle_ms is not None and last is not None and now - last > self.idle_ms and not later:
            self.held.clear()
            self.last.clear()
        if out:
            yield pd.DataFrame(out, columns=["conv_id", "turn", "question", "answer", "query", "memory"])

    def close(self) -> None:
        pass


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Typed state needs the RocksDB store: set for streams that start within."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def stream_with_memory(turns: DataFrame, delay: str = "10 minutes", idle_ms: int | None = None) -> DataFrame:
    """A stream of turns (conv_id, turn, ts, question, answer, remembered) with query and memory, each turn once.

    memory holds the (question, answer) of the last three remembered turns before this one, oldest first; query is the
    question followed by the last two of their questions. Turns may come in any order as long as none is more than ``delay`` behind
    the latest seen: they leave once the watermark has passed them, and later ones are dropped by it. After
    more than ``idle_ms`` between two turns, remembered or not, a conversation starts afresh, and its state goes when that time has
    passed. Needs the RocksDB state store, and a turn of a later time to let the last ones out.
    """
    rows = turns.select("conv_id", "turn", "ts", F.unix_millis("ts").alias("ms"), "question", "answer", "remembered").withWatermark("ts", delay).groupBy("conv_id")
    return rows.transformWithStateInPandas(_Memory(idle_ms), REMEMBERED, outputMode="Append", timeMode="EventTime")


def needed_documents(stream: DataFrame, needed: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents of a stream that a table names: a stateless stream-static semi join."""
    return stream.join(needed.select(key).distinct(), key, "left_semi")
