"""Messages put together from streamed deltas, in Spark's state store: only deltas move, and a message's state goes when it has ended.

The session must keep states in RocksDB (``spark.sql.streaming.stateStore.providerClass``); ``with_state_store`` sets it.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

MESSAGE = "message_id string, text string, status string, events long"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKSDB)


class Assembler(StatefulProcessor):
    """A message's deltas in a list, and beside them how many there are, the number and kind of the last one, and the newest time.

    The event that ends a message (done or error) has the highest number, and numbers run from 1, so the message has ended as soon as
    all have come, in whatever order; repeated events count once. A message that stays silent for ``silence_ms`` of event time, by the watermark, ends as interrupted with the
    text it has. What an ended message leaves, for repeated events to be known, goes at that time too.
    """

    def __init__(self, silence_ms: int):
        self.silence_ms = silence_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.deltas = handle.getListState("deltas", "seq long, delta string")
        self.known = handle.getValueState("known", "events long, last long, failed boolean, newest long, ended boolean, timer long")

    def _ended(self, key: Any, deltas: dict[int, str], status: str) -> Row:
        return Row(message_id=key[0], text="".join(deltas[k] or "" for k in sorted(deltas)), status=status, events=len(deltas))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803
        events, last, failed, newest, ended, timer = self.known.get() or (0, 0, False, 0, False, 0)
        deltas: dict[int, str] = {}
        for r in rows:
            seq, newest = r["event_seq"], max(newest, r["at_ms"])
            if not ended and seq not in deltas:
                deltas[seq] = r["delta"]
                if (r["done"] or r["error"]) and seq > last:
                    last, failed = seq, r["error"]
        if not ended:
            held = events > 0
            events += len(deltas)
            if last and events >= last:
                deltas = ({r[0]: r[1] for r in self.deltas.get()} if held else {}) | deltas
                if len(deltas) >= last:
                    ended, events = True, len(deltas)
                    if held:
                        self.deltas.clear()
                    yield self._ended(key, deltas, "interrupted" if failed else "complete")
                else:  # some had come twice
                    events = len(deltas)
                    self.deltas.put(list(deltas.items()))
            else:
                self.deltas.appendList(list(deltas.items()))
        if not timer:
            timer = newest + self.silence_ms
            self.handle.registerTimer(timer)
        self.known.update((events, last, failed, newest, ended, timer))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:  # noqa: N802, N803
        events, last, failed, newest, ended, timer = self.known.get()
        if newest + self.silence_ms > timerValues.getCurrentWatermarkInMs():  # it has spoken since
            timer = newest + self.silence_ms
            self.handle.registerTimer(timer)
            self.known.update((events, last, failed, newest, ended, timer))
            return
        if not ended:
            yield self._ended(key, {r[0]: r[1] for r in self.deltas.get()}, "interrupted")
            self.deltas.clear()
        self.known.clear()

    def close(self) -> None:
        pass


def assembled(deltas: DataFrame, silence: str = "10 minutes", late: str = "1 minute") -> DataFrame:
    """Messages of a stream of deltas (message_id, event_seq, delta, done, error, at), each once, when it has ended.

    ``silence`` is how long a message may say nothing, ``late`` how far behind the newest event others may come; what comes later is left out. Rows without
    message_id or event_seq are left out; a null delta is empty.
    """
    from pyspark.sql import functions as F

    spark = deltas.sparkSession
    ms = int(spark.sql(f"SELECT (unix_micros(timestamp'1970-01-01 00:00:00Z' + interval {silence})) div 1000").first()[0])
    x = deltas.withWatermark("at", late).where("message_id is not null and event_seq is not null")
    x = x.select(F.col("message_id").cast("string").alias("message_id"), F.col("event_seq").cast("long").alias("event_seq"), F.coalesce("delta", F.lit("")).alias("delta"), F.coalesce("done", F.lit(False)).alias("done"), F.coalesce("error", F.lit(False)).alias("error"), F.unix_millis("at").alias("at_ms"), "at")
    return x.groupBy("message_id").transformWithState(statefulProcessor=Assembler(ms), outputStructType=MESSAGE, outputMode="Append", timeMode="EventTime")
