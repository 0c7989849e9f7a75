"""Connector dumps: JSON exports of chats, mail, issues and pages, as typed DataFrames and as a Python data source.

The network side of a connector is left to whoever writes the dump; this is
what reads it, page by page or incrementally, and types it.
"""

from __future__ import annotations

import io
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

CHAT_USER = "id string, name string, real_name string, deleted boolean, is_bot boolean, profile struct<display_name: string, real_name: string, email: string, image_72: string>"
CHAT_CHANNEL = "id string, name string, is_im boolean, is_mpim boolean, is_private boolean, is_group boolean, is_archived boolean, num_members int, created bigint, `user` string, topic struct<value: string>, purpose struct<value: string>"
CHAT_MESSAGE = (
    "ts string, channel string, `user` string, text string, blocks string, thread_ts string, reply_count int, subtype string, bot_id string, username string, bot_profile struct<name: string>, edited struct<user: string, ts: string>, "
    "reactions array<struct<name: string, count: int, users: array<string>>>, files array<struct<id: string, name: string, mimetype: string, size: bigint, url_private_download: string, permalink: string, created: bigint>>"
)
PAGE_BLOCK = "page_id string, id string, parent_id string, ordinal int, type string, has_children boolean, content string"


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of a JSON-lines dump; lines that are no JSON are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def _filled(*columns: Column) -> Column:
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns), F.lit(""))


def chat_users(raw: DataFrame) -> DataFrame:
    """Users with their names; the names fall back on each other."""
    return raw.select(
        "id", _filled(F.col("name")).alias("name"), _filled(F.col("real_name"), F.col("profile.real_name"), F.col("name")).alias("realName"), _filled(F.col("profile.display_name"), F.col("real_name"), F.col("name")).alias("displayName"),
        F.col("profile.email").alias("email"), F.coalesce("is_bot", F.lit(False)).alias("isBot"), F.coalesce("deleted", F.lit(False)).alias("isDeleted"), F.coalesce("profile.image_72", F.lit("")).alias("avatar72"),
    )


def chat_channels(raw: DataFrame) -> DataFrame:
    """Channels with their kind: direct before group direct before private before public."""
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    kind = F.when(yes("is_im"), "im").when(yes("is_mpim"), "mpim").when(yes("is_private") | yes("is_group"), "private").otherwise("public")
    return raw.select(
        "id", F.coalesce("name", "user", "id").alias("name"), kind.alias("type"), F.coalesce("topic.value", F.lit("")).alias("topic"), F.coalesce("purpose.value", F.lit("")).alias("purpose"),
        F.coalesce("num_members", F.lit(0)).alias("memberCount"), yes("is_archived").alias("isArchived"), F.coalesce("created", F.lit(0)).alias("created"),
    )


def chat_messages(raw: DataFrame) -> DataFrame:
    """Messages in one flat shape; reactions and files as arrays of what is shown."""
    return raw.select(
        "ts", F.col("channel").alias("channelId"), F.coalesce("user", F.lit("")).alias("userId"), F.coalesce("text", F.lit("")).alias("text"), "blocks", F.col("thread_ts").alias("threadTs"), F.col("reply_count").alias("replyCount"),
        F.transform("reactions", lambda r: F.struct(r["name"].alias("name"), r["count"].alias("count"), r["users"].alias("users"))).alias("reactions"),
        F.transform("files", lambda f: F.struct(f["id"].alias("id"), F.coalesce(f["name"], F.lit("untitled")).alias("name"), F.coalesce(f["mimetype"], F.lit("")).alias("mimetype"), F.coalesce(f["size"], F.lit(0)).alias("size"))).alias("files"),
        "edited", "subtype", F.col("bot_id").alias("botId"), F.col("bot_profile").alias("botProfile"), "username",
    )


#: Bytes of a dump that one task reads.
RANGE_BYTES = 64 << 20


def _store(path: str):
    """The file system and inner path of a URI, on any store that pyarrow knows."""
    from pyarrow import fs

    if path.startswith("file:") or "://" not in path:
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else path
    return fs.FileSystem.from_uri(path)


def _sizes(paths: str) -> dict[str, int]:
    """The size of each file of comma-separated files and folders; files named with `_` or `.` are left out."""
    from pyarrow import fs

    out = {}
    for path in paths.split(","):
        store, inner = _store(path)
        info = store.get_file_info(inner)
        if info.type == fs.FileType.Directory:
            for f in store.get_file_info(fs.FileSelector(inner, recursive=True)):
                if f.type == fs.FileType.File and not f.base_name.startswith(("_", ".")):
                    out[f"{path.rstrip('/')}{f.path[len(inner.rstrip('/')):]}"] = f.size
        elif info.type == fs.FileType.File:
            out[path] = info.size
        else:
            raise FileNotFoundError(path)
    return out


class _Range(InputPartition):
    """The lines that begin at bytes `begin` up to `end` of a file."""

    def __init__(self, path: str, begin: int, end: int):
        self.path, self.begin, self.end = path, begin, end


def _ranges(path: str, begin: int, end: int) -> list[_Range]:
    return [_Range(path, at, min(at + RANGE_BYTES, end)) for at in range(begin, end, RANGE_BYTES)]


def _rows(part: _Range, fields: list[str]):
    """The wanted fields of each JSON line of a range; a line belongs to the range that it begins in."""
    store, inner = _store(part.path)
    with io.BufferedReader(store.open_input_file(inner), 1 << 20) as f:
        at = part.begin
        if at:
            f.seek(at - 1)
            at += len(f.readline()) - 1
        else:
            f.seek(0)
        while at < part.end:
            line = f.readline()
            if not line:
                return
            at += len(line)
            try:
                record = json.loads(line)
            except ValueError:
                continue
            if isinstance(record, dict):
                yield tuple(None if (v := record.get(k)) is None else v if isinstance(v, str) else json.dumps(v, ensure_ascii=False) for k in fields)


class _Reader(DataSourceReader):
    def __init__(self, options: dict, fields: list[str]):
        self.options, self.fields = options, fields

    def partitions(self):
        return [r for path, size in sorted(_sizes(self.options["path"]).items()) for r in _ranges(path, 0, size)]

    def read(self, partition):
        return _rows(partition, self.fields)


class _Stream(DataSourceStreamReader):
    """Reads growing dumps from their byte offsets on, in ranges; a line is read once it is complete."""

    def __init__(self, options: dict, fields: list[str]):
        self.path, self.fields = options["path"], fields

    def initialOffset(self):
        return {}

    def latestOffset(self):
        return {path: _last_line_end(path, size) for path, size in _sizes(self.path).items()}

    def partitions(self, start, end):
        return [r for path, size in sorted(end.items()) for r in _ranges(path, start.get(path, 0), size)]

    def read(self, partition):
        return _rows(partition, self.fields)


def _last_line_end(path: str, size: int, step: int = 1 << 16) -> int:
    """The byte behind the last line break among a file's first `size` bytes."""
    store, inner = _store(path)
    with store.open_input_file(inner) as f:
        end = size
        while end > 0:
            begin = max(0, end - step)
            f.seek(begin)
            found = f.read(end - begin).rfind(b"\n")
            if found >= 0:
                return begin + found + 1
            end = begin
    return 0


class DumpSource(DataSource):
    """spark.read.format("dump").option("fields", "id,text").load(path): fields of JSON lines as strings, batch or stream."""

    @classmethod
    def name(cls):
        return "dump"

    def schema(self):
        return ", ".join(f"`{f}` string" for f in self._fields())

    def _fields(self) -> list[str]:
        return [f.strip() for f in self.options["fields"].split(",")]

    def reader(self, schema):
        return _Reader(self.options, self._fields())

    def streamReader(self, schema):
        return _Stream(self.options, self._fields())


def register(spark: SparkSession) -> None:
    spark.dataSource.register(DumpSource)
