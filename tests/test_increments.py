"""Digest trees, state of threads across runs, and the two phases of the document sink."""

import json

import pytest
from pyspark.sql import functions as F

from gleaner.operators import digests, rollups
from gleaner.sources import publish
from gleaner.streaming import threads


def test_tree_diff_equals_the_full_join(spark):
    stored = spark.range(6000).select("id", (F.col("id") * 7).alias("v"), F.col("id").alias("m"))
    current = spark.range(3, 6004).select("id", F.when(F.col("id") % 911 == 0, None).otherwise(F.col("id") * 7).alias("v"), F.when(F.col("id") % 700 == 0, -1).otherwise(F.col("id")).alias("m"))
    for mtime in (None, "m"):
        got = digests.tree_diff(stored, current, "id", "v", mtime, bits=12)
        want = rollups.diff_status(stored, current, "id", "v", mtime).where("status <> 'unchanged'")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() > 12
    assert digests.tree_diff(stored, stored, "id", "v").isEmpty()
    none = stored.where("id < 0")
    assert digests.tree_diff(none, none, "id", "v").isEmpty() and digests.tree_diff(none, stored, "id", "v").where("status = 'new'").count() == 6000


def test_few_leaves_are_compared_for_few_changes(spark):
    stored = spark.range(20000).select("id", F.col("id").alias("v"))
    current = stored.withColumn("v", F.when(F.col("id").isin(5, 77), -1).otherwise(F.col("v")))
    trees = [digests.digest_tree(t, "id", ["v"], 8) for t in (stored, current)]
    assert digests.differing_leaves(*trees, 8).count() in (1, 2)
    with pytest.raises(ValueError):
        digests.tree_diff(stored, current, "id", "v", tree=trees[0])
    kept = digests.tree_diff(stored, current, "id", "v", tree=trees[0], bits=8)
    assert sorted(map(tuple, kept.collect())) == [(5, "changed"), (77, "changed")]


def test_threads_keep_their_state_over_restarts(spark, tmp_path):
    source, target, point = (str(tmp_path / n) for n in ("in", "log", "point"))
    schema = "thread string, author string, at long, extra int"
    batches = [
        [("a", "x", 5, 1), ("a", "y", 3, 1), ("b", None, None, 1), (None, "x", 1, 1)],
        [("a", "x", 2, 1), ("a", "z", 9, 1), ("b", "y", 4, 1), ("a", "x", 2, 1)],
    ]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        threads.rollup_stream(stream, "thread", "author", "at", target, point, salts=2).awaitTermination()
    log = spark.read.parquet(target)
    got = {r.thread: tuple(r)[1:] for r in threads.thread_states(log).collect()}
    assert got == {"a": (5, 2, 9, 3), "b": (2, 4, 4, 1), None: (1, 1, 1, 1)}
    assert {(r.thread, r.author): r.first_at for r in threads.participants(log).collect()} == {("a", "x"): 2, ("a", "y"): 3, ("a", "z"): 9, ("b", "y"): 4, (None, "x"): 1}


def test_marks_outlive_a_run(spark, tmp_path):
    source, target, point = (str(tmp_path / n) for n in ("in", "out", "point"))
    schema = "channel string, ts long, said string"
    for rows in ([("c", 5, "one"), ("c", 3, "two"), ("d", 1, "three"), ("d", None, "never")], [("c", 5, "old"), ("c", 4, "old"), ("c", 6, "four"), ("e", 0, "five")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        threads.since_stream(spark.readStream.schema(schema).parquet(source), "channel", "ts", target, point).awaitTermination()
    assert sorted(r.said for r in spark.read.parquet(target).collect()) == ["five", "four", "one", "three", "two"]


def _files(folder):
    """What readers see; a task that is killed late may leave staged files, which recovery removes by age."""
    return {str(p.relative_to(folder)): p.read_text() for p in folder.rglob("*") if p.is_file() and ".staging" not in p.parts}


def test_a_failed_write_leaves_the_folder_as_it_was(spark, tmp_path):
    rows = spark.createDataFrame([("a/b.md", "A"), ("c.md", "é"), ("d.md", None)], "path string, content string")
    publish.write_documents(rows, f"file://{tmp_path}")
    assert _files(tmp_path) == {"a/b.md": "A", "c.md": "é", "d.md": ""}
    newer = rows.withColumn("content", F.lit("new")).repartition(3)
    broken = newer.withColumn("content", F.when(F.col("path") == "c.md", F.raise_error(F.lit("lost"))).otherwise(F.col("content")))
    for bad in (broken, newer.unionByName(rows.select(F.lit("../x.md").alias("path"), "content"))):
        with pytest.raises(Exception, match="lost|no path below"):
            publish.write_documents(bad, f"file://{tmp_path}")
        assert _files(tmp_path) == {"a/b.md": "A", "c.md": "é", "d.md": ""}
    publish.write_documents(newer.limit(0), str(tmp_path))
    publish.write_documents(newer.where("path <> 'd.md'"), str(tmp_path))
    assert _files(tmp_path) == {"a/b.md": "new", "c.md": "new", "d.md": ""}


def test_a_committed_write_is_finished_by_recovery(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame([("a.md", b"1"), ("b.md", b"2"), ("b.md", b"2")], "path string, content binary")
    with monkeypatch.context() as patched:
        patched.setattr(publish, "_finish", lambda *args: None)
        publish.write_documents(rows, str(tmp_path))
    (folder,) = (tmp_path / ".staging").iterdir()
    assert not (tmp_path / "a.md").exists()
    # One file was moved before the crash.
    manifest = next(p for p in folder.glob("*.jsonl") if "a.md" in p.read_text())
    staged = next(line for line in map(json.loads, manifest.read_text().splitlines()) if line["path"] == "a.md")
    (folder / staged["staged"]).rename(tmp_path / "a.md")
    (tmp_path / ".staging" / "1-dead").mkdir()
    assert publish.recover(spark, str(tmp_path)) == (1, 1)
    assert _files(tmp_path) == {"a.md": "1", "b.md": "2"}
    assert publish.recover(spark, str(tmp_path)) == (0, 0)


def test_a_log_has_a_row_for_each_author_and_a_folder_for_each_batch(spark, tmp_path):
    """State is kept without Python; a batch's folder holds whole states, so writing it again changes nothing."""
    source, target, point = (str(tmp_path / n) for n in ("in", "log", "point"))
    schema = "thread string, author string, at long"
    for rows in ([("a", "x", 5), ("a", "x", 7), ("a", None, 1), ("b", "y", None)], [("a", "x", 3)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        query = threads.rollup_stream(spark.readStream.schema(schema).parquet(source), "thread", "author", "at", target, point)
        query.awaitTermination()
    assert {tuple(r) for r in spark.read.parquet(f"{target}/batch=0").collect()} == {("a", "x", 2, 5, 7), ("a", None, 1, 1, 1), ("b", "y", 1, None, None)}
    assert [tuple(r) for r in spark.read.parquet(f"{target}/batch=1").collect()] == [("a", "x", 3, 3, 7)]
    log = spark.read.parquet(target)
    assert {tuple(r) for r in threads.thread_states(log).collect()} == {("a", 4, 1, 7, 1), ("b", 1, None, None, 0)}
    assert [tuple(r) for r in threads.participants(log).collect()] == [("a", "x", 3)]
