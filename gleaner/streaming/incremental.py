"""Incremental ingest on Structured Streaming: append with dedup, change logs, and index updates by micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gleaner.operators.rollups import apply_changes, latest
from gleaner.plans.index import update
from gleaner.plans.segments import FAMILY, KEYS, Index
from gleaner.runtime import discard, materialise


def stream_json(spark: SparkSession, path: str, schema: str, per_trigger: int = 1000) -> DataFrame:
    """A folder of JSON-lines dumps as a stream; each file is read once."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).json(path)


def deduplicated(rows: DataFrame, keys: list[str], event_time: str | None = None, late: str = "1 day") -> DataFrame:
    """A stream without repeats of `keys`; with an event time, state is kept only as long as rows may be late."""
    if event_time is None:
        return rows.dropDuplicates(keys)
    return rows.withWatermark(event_time, late).dropDuplicatesWithinWatermark(keys)


def windowed_counts(rows: DataFrame, event_time: str, window: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Rows of each key in each window of event time; windows close when the watermark has passed them."""
    counts = rows.withWatermark(event_time, late).groupBy(F.window(event_time, window).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return counts.select("w.start", "w.end", *keys, "n")


def _start(rows: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, every: str | None) -> StreamingQuery:
    writer = rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def append_stream(rows: DataFrame, target: str, keys: list[str], checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Append a stream to a Parquet table, each batch without keys that the table has: a retried batch repeats nothing."""

    def each(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates(keys)
        try:
            fresh = fresh.join(spark.read.parquet(target).select(*keys), keys, "left_anti")
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
                raise
        fresh.write.mode("append").parquet(target)

    return _start(rows, each, checkpoint, every)


def apply_changes_stream(log: DataFrame, index: Index, table: str, keys: list[str], order: list[str], checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Keep a table of an index up to a change log (its columns, `op`, and the order); applying a batch twice changes nothing.

    The last operation of each key counts. A batch is one segment and its
    tombstones; by other keys than the table's own, the table is written anew.
    """
    family = FAMILY[table]

    def each(batch: DataFrame, n: int) -> None:
        if keys != KEYS[family]:
            snap = index.snapshot()
            index.replace(base=snap, **{table: apply_changes(snap.table(table), batch, keys, order)})
            return
        last = materialise(latest(batch, keys, order), "changes")
        puts = last.where("op <> 'delete'").select(*index.empty(table).columns)
        index.commit(index.snapshot(), append={table: puts}, gone={family: last})
        discard(last)
        index.compact()

    return _start(log, each, checkpoint, every)


def index_stream(documents: DataFrame, index: Index, adapter, now_iso: Callable[[], str], checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Upsert a stream of documents (path, size, mtime_ms, content) into an index; what is not in a batch stays."""

    def each(batch: DataFrame, n: int) -> None:
        newest = materialise(latest(batch, ["path"], ["mtime_ms"]).select("path", "size", "mtime_ms", "content"), "batch")
        update(index, newest, adapter, now_iso(), prune=False)
        discard(newest)

    return _start(documents, each, checkpoint, every)
