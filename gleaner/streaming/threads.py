"""State of threads that outlives a run: counts, marks and participants of each thread, and what is newer than its mark.

State is kept by Structured Streaming in RocksDB below the query's checkpoint,
so a restarted stream goes on where it stopped. A thread's state is kept by its
authors and messages are combined before the shuffle: a thread that holds a third
of all messages is not one task's, and no row of a thread passes through Python.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle, StreamingQuery

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Since(StatefulProcessor):
    """Rows newer than their key's mark as it was before the batch; the mark then rises to the newest."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.mark = handle.getValueState("mark", "at long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        before = self.mark.get()[0] if self.mark.exists() else None
        top = before
        for part in rows:
            fresh = part.dropna(subset=["at"])
            if before is not None:
                fresh = fresh[fresh["at"] > before]
            if len(fresh):
                newest = int(fresh["at"].max())
                top = newest if top is None else max(top, newest)
                yield fresh.astype({"at": "int64"})
        if top is not None and top != before:
            self.mark.update((top,))

    def close(self) -> None:
        pass


def _start(spark: SparkSession, writer: DataStreamWriter, checkpoint: str, every: str | None) -> StreamingQuery:
    """Start a stream with its state in RocksDB."""
    own = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        writer = writer.option("checkpointLocation", checkpoint)
        return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
    finally:
        spark.conf.set(_PROVIDER, own) if own else spark.conf.unset(_PROVIDER)


def rollup_stream(rows: DataFrame, thread: str, author: str, at: str, target: str, checkpoint: str, every: str | None = None, salts: int | None = None) -> StreamingQuery:
    """Keep the state of each thread of a stream of messages; `target` gets a log of what each batch changed.

    The log has (thread, author, message_count, first_at, last_at) of each thread and author
    that a batch touched, as they are after it, in a folder of the batch's number: a batch that is
    retried replaces its own folder. `at` is a long. Messages may come in any order and in any batches: `thread_states`
    of the log is what a roll-up of all of them gives. Defined cases: a null
    thread is a thread; a null author or time counts as a message alone; a
    message given twice counts twice, as in a batch (see `incremental.deduplicated`).
    `salts` is of no effect: state is kept by thread and author, and messages are combined before the shuffle.
    """
    keyed = rows.select(F.col(thread).cast("string").alias("thread"), F.col(author).cast("string").alias("author"), F.col(at).cast("long").alias("at"))
    state = keyed.groupBy("thread", "author").agg(F.count(F.lit(1)).alias("message_count"), F.min("at").alias("first_at"), F.max("at").alias("last_at"))
    each = lambda batch, n: batch.write.mode("overwrite").parquet(f"{target}/batch={n}")
    return _start(rows.sparkSession, state.writeStream.outputMode("update").foreachBatch(each), checkpoint, every)


def thread_states(log: DataFrame) -> DataFrame:
    """(thread, message_count, first_at, last_at, participant_count): the state of each thread from the log of `rollup_stream`."""
    own = log.groupBy("thread", "author").agg(F.max("message_count").alias("n"), F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"))
    took_part = F.col("author").isNotNull() & F.col("first_at").isNotNull()
    return own.groupBy("thread").agg(F.sum("n").alias("message_count"), F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"), F.count_if(took_part).alias("participant_count"))


def participants(log: DataFrame) -> DataFrame:
    """(thread, author, first_at): when each participant of a thread first wrote, one row each."""
    return log.where("author IS NOT NULL AND first_at IS NOT NULL").groupBy("thread", "author").agg(F.min("first_at").alias("first_at"))


def since_stream(rows: DataFrame, key: str, at: str, target: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Append to `target` the rows that are newer than their key's high-water mark; marks are kept between batches and runs.

    A mark rises at the end of a batch, so rows of one batch may have any order;
    rows as old as the mark or older, and those without a time, are left out.
    `at` is a long; all rows of a key go through one task of a batch, in parts.
    """
    marked = rows.withColumnsRenamed({key: "key", at: "at"})
    out = marked.groupBy("key").transformWithStateInPandas(_Since(), marked.schema, "Append", "None").withColumnsRenamed({"key": key, "at": at})
    return _start(rows.sparkSession, out.writeStream.format("parquet").outputMode("append").option("path", target), checkpoint, every)
