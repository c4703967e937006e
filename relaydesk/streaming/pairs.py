"""First question and answer of conversations whose turns arrive as a stream, kept in state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions.text import clean_message

PAIR = ("conversation_id {kind}, version bigint, asked_at bigint, asked string, answered_at bigint, answer string, "
        "num_turns bigint, closed boolean")
STATE_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MOST_REPLIES = 10_000  # turns that a batch reads before it drops the replies that can answer no more


class FirstPair(StatefulProcessor):
    """State of one conversation: its first customer turn, the support turns that may answer it, the count.

    Turns come in any order, one row at a time. A support turn behind the one that answers now can never answer, as the question
    only moves forward in the conversation; so the state holds the answer and the support turns before the
    question; a batch reads these and its own turns. Of turns with one position the greatest text counts.
    """

    def __init__(self, idle_ms: int | None):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", "version bigint, asked_at bigint, asked string, num_turns bigint")
        self.replies = handle.getMapState("replies", "pos bigint", "text string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        begin = 0 if self.idle_ms is None else timerValues.getCurrentProcessingTimeInMs()  # above all versions before a time-out
        version, asked_at, asked, turns, held = begin, None, None, 0, {}
        if self.head.exists():  # without it there are no replies either
            version, asked_at, asked, turns = self.head.get()
            held = {k[0]: v[0] for k, v in self.replies.iterator()}
        replies = dict(held)
        for n, row in enumerate(rows, 1):
            turns += 1
            if row.pos is not None and row.pos == row.pos:  # nor NaN
                pos, text = int(row.pos), row.text
                if row.role == "customer" and (asked_at is None or pos < asked_at or (pos == asked_at and _greater(text, asked))):
                    asked_at, asked = pos, text
                elif row.role == "support" and (pos not in replies or _greater(text, replies[pos])):
                    replies[pos] = text
            if n % MOST_REPLIES == 0:
                replies = _useful(asked_at, replies)
        replies = _useful(asked_at, replies)
        version += 1
        self.head.update((version, asked_at, asked, turns))
        for pos in held.keys() - replies.keys():
            self.replies.removeKey((pos,))
        for pos, text in replies.items():
            if pos not in held or held[pos] != text:
                self.replies.updateValue((pos,), (text,))
        if self.idle_ms is not None:  # only the latest arrival counts
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield self._row(key, version, asked_at, asked, replies, turns, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.head.exists():
            version, asked_at, asked, turns = self.head.get()
            replies = {k[0]: v[0] for k, v in self.replies.iterator()}
            self.head.clear()
            self.replies.clear()
            yield self._row(key, version + 1, asked_at, asked, replies, turns, True)

    def close(self) -> None:
        pass

    def _row(self, key, version, asked_at, asked, replies, turns, closed) -> Row:
        at = _answer(asked_at, replies)
        return Row(conversation_id=key[0], version=version, asked_at=asked_at, asked=asked, answered_at=at,
                   answer=replies.get(at), num_turns=turns, closed=closed)


def _greater(text: str | None, before: str | None) -> bool:
    return before is None or (text is not None and text > before)


def _useful(asked_at: int | None, replies: dict) -> dict:
    """The replies without those behind the one that answers."""
    at = _answer(asked_at, replies)
    return replies if at is None else {p: t for p, t in replies.items() if p <= at}


def _answer(asked_at: int | None, replies: dict) -> int | None:
    return None if asked_at is None else min((p for p in replies if p > asked_at), default=None)


def pair_stream(
    turns: DataFrame,
    out: str,
    checkpoint: str,
    idle_ms: int | None = None,
    score: Callable[[DataFrame], DataFrame] | None = None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Write the pairs that each micro-batch of ``turns`` (conversation_id, pos, role, text) changes to ``out``.

    Roles other than customer and support are left out. A row has a ``version`` that grows per conversation;
    :func:`latest_pairs` reads the newest. ``idle_ms`` after its last turn a conversation is written once more
    as ``closed`` and its state is dropped: turns that come later count no more. Without it all states stay.
    Time-outs need a trigger that goes on (every 10 seconds if none is given; ``stop()`` ends it): one that ends
    with the available turns is refused, as it would wait for time-outs for ever. ``score``, for example a triage with
    prepared resources, sees only the changed rows of a batch. A batch overwrites its own folder, which makes a
    repeated batch harmless. The state is that of ``transformWithState``: Spark refuses a checkpoint that a stream of
    ``transformWithStateInPandas`` wrote. Turns are shuffled once, by conversation: the state of one lies in one task, to which its turns of a batch stream.
    """
    trigger = trigger or ({"availableNow": True} if idle_ms is None else {"processingTime": "10 seconds"})
    if idle_ms is not None and "availableNow" in trigger:
        raise ValueError("time-outs need a trigger that goes on after the available turns")
    spark = turns.sparkSession
    kind = turns.schema["conversation_id"].dataType.simpleString()
    useful = turns.where(F.col("role").isin("customer", "support") & F.col("conversation_id").isNotNull())
    pairs = useful.select("conversation_id", "pos", "role", "text").groupBy("conversation_id").transformWithState(
        FirstPair(idle_ms), PAIR.format(kind=kind), "Update", "None" if idle_ms is None else "ProcessingTime"
    )

    def write(batch: DataFrame, batch_id: int) -> None:
        (batch if score is None else score(batch)).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, STATE_PROVIDER)  # a stream keeps the settings it starts with
    try:
        return (
            pairs.writeStream.foreachBatch(write).outputMode("update")
            .option("checkpointLocation", checkpoint)
            .trigger(**trigger)
            .start()
        )
    finally:
        spark.conf.set(name, before)


def latest_pairs(spark: SparkSession, out: str, min_customer_len: int = 20, min_support_len: int = 15) -> DataFrame:
    """The pair of every conversation, cleaned and filtered as the batch operators do: the one it was first
    closed with, or the newest."""
    order = F.struct("closed", F.when(F.col("closed"), -F.col("version")).otherwise(F.col("version")))
    newest = spark.read.parquet(out).groupBy("conversation_id").agg(
        F.max_by(F.struct("asked", "answer", "num_turns"), order).alias("p")
    )
    return newest.select(
        "conversation_id", clean_message(F.col("p.asked")).alias("first_customer_msg"),
        F.col("p.answer").alias("first_support_reply"), F.col("p.num_turns").cast("int").alias("num_turns"),
    ).where(
        (F.col("num_turns") >= 2) & (F.length("first_customer_msg") >= min_customer_len)
        & (F.length("first_support_reply") >= min_support_len)
    )
