"""Registered queries of incremental work: digest trees, state of threads and marks across runs, published folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.operators.digests import STEP, digest_tree, leaf_bits, tree_diff
from gleaner.plans import records
from gleaner.runtime import materialise, read, scratch_path
from gleaner.sources import publish
from gleaner.sources.files import read_documents
from gleaner.streaming import threads


def index_diff_tree(spark: SparkSession, d: str) -> DataFrame:
    """What changed between two states of an index, by the tree of digests that the stored one keeps."""
    stored = materialise(records._stored(spark, d), "stored")
    current = materialise(records._current(spark, d), "current")
    bits = leaf_bits(stored.count(), 16)
    tree = materialise(digest_tree(stored, "doc_id", ["hash", "mtime"], bits), "tree")
    return tree_diff(stored, current, "doc_id", "hash", "mtime", tree, bits)


def digest_levels(spark: SparkSession, d: str) -> DataFrame:
    """The rows of a digest tree by level: each level counts all of them."""
    tree = digest_tree(records._stored(spark, d), "doc_id", ["hash"], 2 * STEP)
    return tree.groupBy("level").agg(F.sum("n").alias("n"))


def _twice(spark: SparkSession, rows: DataFrame, first: str, then: str, start) -> DataFrame:
    """The target of a stream that is stopped after the rows of `first` and started again for those of `then`."""
    source, target, point = (scratch_path(spark, n) for n in ("source", "target", "point"))
    for part in (first, then):
        rows.where(part).write.mode("append").parquet(source)
        start(spark.readStream.schema(rows.schema).parquet(source), target, point).awaitTermination()
    return spark.read.parquet(target)


def thread_states(spark: SparkSession, d: str) -> DataFrame:
    """The state of each conversation, kept by a stream that is restarted once."""
    rows = read(spark, d, "conversations").select("conv_id", "turn", "role")
    log = _twice(spark, rows, "turn % 3 = 1", "turn % 3 <> 1 OR turn IS NULL", lambda s, target, point: threads.rollup_stream(s, "conv_id", "role", "turn", target, point))
    return threads.thread_states(log)


def thread_participants(spark: SparkSession, d: str) -> DataFrame:
    """When each kind of event first came to each user, from the log of a restarted stream."""
    rows = read(spark, d, "events").select("user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event_id")
    log = _twice(spark, rows, "event_id % 2 = 1", "event_id % 2 = 0", lambda s, target, point: threads.rollup_stream(s, "user_id", "event_type", "us", target, point))
    return threads.participants(log)


def mark_increment(spark: SparkSession, d: str) -> DataFrame:
    """Events that a stream with stored marks lets pass: of its first run all, of its second those newer than their user's mark."""
    rows = read(spark, d, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return _twice(spark, rows, "event_id % 2 = 0 AND user_id % 3 <> 0", "true", lambda s, target, point: threads.since_stream(s, "user_id", "us", target, point)).select("event_id")


def published_files(spark: SparkSession, d: str) -> DataFrame:
    """Documents published in two phases over an older state of the folder, and read again."""
    root = scratch_path(spark, "published")
    rows = read(spark, d, "supplier").select(F.concat(F.lit("n"), F.col("s_nationkey").cast("string"), F.lit("/s"), F.col("s_suppkey").cast("string"), F.lit(".md")).alias("path"), F.col("s_name").alias("content"), "s_suppkey")
    publish.write_documents(rows.where("s_suppkey % 2 = 0").withColumn("content", F.lit("old")), root)
    publish.write_documents(rows.where("s_suppkey % 4 <> 2"), root)
    return read_documents(spark, root).select(F.regexp_extract("path", r"([^/]+/[^/]+)$", 1).alias("path"), "content")


QUERIES = {f.__name__: f for f in (index_diff_tree, digest_levels, thread_states, thread_participants, mark_increment, published_files)}

_STORED = "SELECT doc_id, sha256(text) AS hash, doc_id * 10 AS mtime FROM documents WHERE doc_id % 10 <> 0"
_CURRENT = """SELECT doc_id, sha256(CASE WHEN doc_id % 13 = 0 THEN text || '!' ELSE text END) AS hash, doc_id * 10 + (doc_id % 3 = 0)::INT AS mtime
FROM documents WHERE doc_id % 7 <> 0"""

SQL = {
    "index_diff_tree": f"""SELECT coalesce(s.doc_id, c.doc_id) AS doc_id,
  CASE WHEN s.doc_id IS NULL THEN 'new' WHEN c.doc_id IS NULL THEN 'pruned' WHEN s.hash = c.hash THEN 'touched' ELSE 'changed' END AS status
FROM ({_STORED}) s FULL JOIN ({_CURRENT}) c ON s.doc_id = c.doc_id
WHERE s.doc_id IS NULL OR c.doc_id IS NULL OR s.mtime <> c.mtime""",
    "digest_levels": "SELECT level, (SELECT count(*) FROM documents WHERE doc_id % 10 <> 0) AS n FROM (VALUES (0), (4), (8)) t(level)",
    "thread_states": """SELECT conv_id::VARCHAR AS thread, count(*) AS message_count, min(turn)::BIGINT AS first_at, max(turn)::BIGINT AS last_at,
  count(DISTINCT role) FILTER (turn IS NOT NULL) AS participant_count FROM conversations GROUP BY conv_id""",
    "thread_participants": "SELECT user_id::VARCHAR AS thread, event_type AS author, min(epoch_us(ts)) AS first_at FROM events WHERE event_type IS NOT NULL AND ts IS NOT NULL GROUP BY ALL",
    "mark_increment": """WITH first AS (SELECT * FROM events WHERE event_id % 2 = 0 AND user_id % 3 <> 0 AND ts IS NOT NULL),
marks AS (SELECT user_id, max(ts) AS mark FROM first GROUP BY user_id)
SELECT event_id FROM first UNION ALL
SELECT event_id FROM events LEFT JOIN marks USING (user_id) WHERE ts IS NOT NULL AND (mark IS NULL OR ts > mark)""",
    "published_files": """SELECT 'n' || s_nationkey || '/s' || s_suppkey || '.md' AS path, CASE WHEN s_suppkey % 4 = 2 THEN 'old' ELSE s_name END AS content FROM supplier""",
}
