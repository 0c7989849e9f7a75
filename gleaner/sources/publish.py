"""Documents written to a folder in two phases: staged by tasks, and moved into place once all of them have been.

The first phase is a data source whose tasks write their files and a manifest
below a hidden folder of the root; its commit is one small marker that names the
manifests of the tasks that counted. The second is a job that moves the files.
A failure in the first leaves the folder as it was; one after the marker is
finished by `recover`, since a move that was done already is left as it is.
What a task that is killed late stages after an abort stays hidden until then.
"""

from __future__ import annotations

import json
import posixpath
import time
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from gleaner.sources.dumps import _store

STAGING = ".staging"
_MARKER = "committed.json"
#: Age from which a staging folder without a marker is taken for one of a writer that died.
ABANDONED_SECONDS = 86_400


def _write(store, path: str, content: bytes) -> None:
    store.create_dir(posixpath.dirname(path), recursive=True)
    with store.open_output_stream(path) as f:
        f.write(content)


def _inside(path: str) -> str:
    """A relative path below the root; one that leads out of it, or into the staging folder, is an error."""
    clean = posixpath.normpath(path)
    if clean.startswith(("/", "../")) or clean in (".", "..") or clean.split("/")[0] == STAGING:
        raise ValueError(f"no path below the folder: {path!r}")
    return clean


@dataclass
class _Staged(WriterCommitMessage):
    manifest: str = field(default="")


class _Stager(DataSourceWriter):
    """Stages (path, content) rows; what a task attempt that did not count has staged is named by no manifest of the marker."""

    def __init__(self, folder: str):
        self.folder = folder

    def write(self, iterator: Iterator) -> _Staged:
        store, folder = _store(self.folder)
        attempt, lines = uuid.uuid4().hex, []
        for n, row in enumerate(iterator):
            content = row["content"]
            _write(store, f"{folder}/{attempt}/{n}", bytes(content) if content is not None else b"")
            lines.append(json.dumps({"staged": f"{attempt}/{n}", "path": _inside(row["path"])}))
        _write(store, f"{folder}/{attempt}.jsonl", "\n".join(lines).encode())
        return _Staged(f"{attempt}.jsonl")

    def commit(self, messages: list) -> None:
        store, folder = _store(self.folder)
        named = [m.manifest for m in messages if m is not None]
        _write(store, f"{folder}/{_MARKER}.tmp", json.dumps(named).encode())
        store.move(f"{folder}/{_MARKER}.tmp", f"{folder}/{_MARKER}")

    def abort(self, messages: list) -> None:
        _remove(self.folder)


class StagedDocuments(DataSource):
    """df.write.format("staged_documents").mode("append").save(folder): rows (path, content binary), staged below the folder."""

    @classmethod
    def name(cls):
        return "staged_documents"

    def writer(self, schema, overwrite):
        return _Stager(self.options["path"])


def _remove(folder: str) -> None:
    store, inner = _store(folder)
    try:
        store.delete_dir(inner)
    except FileNotFoundError:
        pass


def _move(root: str, folder: str):
    """Moves staged files of (staged, path) rows into place; one that is gone was moved by an earlier attempt."""

    def run(part: Iterable) -> None:
        from pyarrow import fs

        store, inner = _store(folder)
        _, target = _store(root)
        gone = fs.FileType.NotFound
        for row in part:
            here, there = f"{inner}/{row['staged']}", f"{target.rstrip('/')}/{row['path']}"
            if store.get_file_info(here).type == gone:
                continue
            store.create_dir(posixpath.dirname(there), recursive=True)
            try:
                store.move(here, there)
            except OSError:
                # Another attempt has moved it, or the store does not move onto a file.
                if store.get_file_info(here).type == gone:
                    continue
                store.delete_file(there)
                store.move(here, there)

    return run


def _finish(spark: SparkSession, root: str, folder: str) -> None:
    """The second phase of a staging folder that has a marker."""
    store, inner = _store(folder)
    with store.open_input_stream(f"{inner}/{_MARKER}") as f:
        manifests = [f"{folder}/{m}" for m in json.loads(f.read())]
    if manifests:
        spark.read.schema("staged string, path string").json(manifests).foreachPartition(_move(root, folder))
    _remove(folder)


def write_documents(rows: DataFrame, root: str) -> None:
    """Write (path, content) rows, texts or bytes, as files below a shared folder; a failed write leaves it as it was.

    Defined cases: a null content is an empty file; of rows that repeat a path
    one is kept, whole; a path that leads out of the folder fails the write.
    A reader may meet some new files before others while they are moved. Each
    task reports one name, so the driver's part grows with tasks, not with files.
    """
    spark = rows.sparkSession
    spark.dataSource.register(StagedDocuments)
    folder = f"{root.rstrip('/')}/{STAGING}/{int(time.time())}-{uuid.uuid4().hex}"
    content = rows["content"].cast("binary")
    rows.select("path", content.alias("content")).write.format("staged_documents").mode("append").save(folder)
    _finish(spark, root, folder)


def recover(spark: SparkSession, root: str, abandoned_seconds: int = ABANDONED_SECONDS) -> tuple[int, int]:
    """Finish writes that were committed but not moved, and remove ones abandoned before; how many of each."""
    from pyarrow import fs

    store, inner = _store(root)
    base = f"{inner.rstrip('/')}/{STAGING}"
    finished = removed = 0
    for found in store.get_file_info(fs.FileSelector(base, allow_not_found=True)):
        folder = f"{root.rstrip('/')}/{STAGING}/{found.base_name}"
        if store.get_file_info(f"{base}/{found.base_name}/{_MARKER}").type == fs.FileType.File:
            _finish(spark, root, folder)
            finished += 1
        elif time.time() - int(found.base_name.split("-")[0]) >= abandoned_seconds:
            _remove(folder)
            removed += 1
    return finished, removed
