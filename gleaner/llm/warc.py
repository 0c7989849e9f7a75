"""Operator 10: WARC archives with a two-level capture index.

Records are written by Spark's text writer with the record separator as line
separator, so archives land on any file system that Spark writes. Of pages with
equal payloads, from a least size on, one is a response and the others revisit
it. The first index level holds a line for each capture, sorted by reversed-host
URL key, cut into compressed blocks that stand one behind the other in files;
the second, sparse one, the directory, names the first and last key of each
block with its file and byte range.

Look-ups are a sorted merge. Keys are dealt to the index files by the files'
first and last keys, of which there are as many as the index has partitions. A
task has its file's part of the directory and its keys in order; for each it
binary-searches the directory, reads the block's byte range, and binary-searches
its lines. The captures found are dealt by file and stretch, and their byte
ranges of the archives are read. Reading all pages back is such a look-up.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.runtime import checked_join, discard, materialise, scratch_path

#: Equal payloads below this size are stored again.
LEAST_REVISIT = 100
#: Records of an archive file; captures of an index block.
FILE_RECORDS = 20_000
BLOCK_LINES = 1_000
_CRLF = "\r\n"
_CONTROL = re.compile(r"[\x00-\x20\x7F]")
_DATE = "2025-01-01T00:00:00Z"


def surt(url: str | None) -> str:
    """A URL's sort key: the host's labels reversed and joined by commas, then `)` and the rest; lower-case host, no scheme."""
    rest = (url or "").split("://", 1)[-1] if "://" in (url or "") else (url or "")
    cut = min((i for i in (rest.find(c) for c in "/?#") if i >= 0), default=len(rest))
    host = rest[:cut].lower()
    return ",".join(reversed(host.split("."))) + ")" + (rest[cut:] or "/")


def cleaned(url: str | None) -> str:
    """A URL as a header holds it: without control characters and blanks; empty for null."""
    return _CONTROL.sub("%20", url or "")


def _records(pages: DataFrame, id_col: str, url_col: str, html_col: str, least: int) -> DataFrame:
    """One text for each page: its WARC record without the trailing separator."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    page = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), html.alias("html"), F.sha2(html.cast("binary"), 256).alias("digest"), F.octet_length(html).alias("size"))
    large = page.select("page_id", "digest", "size").where(F.col("size") >= least)
    shared = large.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first")
    page = checked_join(page, materialise(shared, "shared"), "digest", "left")
    revisit = (F.col("size") >= least) & F.col("first").isNotNull() & (F.coalesce(F.col("page_id"), F.col("first") - 1) != F.col("first"))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{_CRLF}Content-Type: text/html; charset=utf-8{_CRLF}Content-Length: "), "size", F.lit(_CRLF * 2))
    block = F.length(http) + F.when(F.col("revisit"), 0).otherwise(F.col("size"))
    uri = F.regexp_replace("url", _CONTROL.pattern, "%20")  # a header is one line
    head = F.concat(
        F.lit(f"WARC/1.1{_CRLF}WARC-Type: "), F.when(F.col("revisit"), "revisit").otherwise("response"),
        F.lit(f"{_CRLF}WARC-Record-ID: "), name(F.col("page_id")), F.lit(f"{_CRLF}WARC-Date: {_DATE}{_CRLF}WARC-Target-URI: "), uri,
        F.lit(f"{_CRLF}WARC-Payload-Digest: sha256:"), "digest",
        F.when(F.col("revisit"), F.concat(F.lit(f"{_CRLF}WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{_CRLF}WARC-Refers-To: "), name(F.col("first")))).otherwise(""),
        F.lit(f"{_CRLF}Content-Type: application/http; msgtype=response{_CRLF}Content-Length: "), block.cast("string"), F.lit(_CRLF * 2),
    )
    return page.withColumn("revisit", revisit).select(F.concat(head, http, F.when(F.col("revisit"), "").otherwise(F.col("html"))).alias("value"))


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST_REVISIT, file_records: int = FILE_RECORDS) -> None:
    """Write a WARC record for each row of `pages` into files below `path`.

    Defined cases: a null url or html is empty; a null id is written as null and
    never answers for others; rows that repeat the response's id and payload are
    responses too; equal payloads below `least` bytes are all responses; an
    empty table gives no records; other columns are not looked at.
    """
    _records(pages, id_col, url_col, html_col, least).write.option("lineSep", _CRLF * 2).option("maxRecordsPerFile", file_records).text(path)


def _open(path: str):
    """A seekable binary file of any store that pyarrow knows; executors read byte ranges of it."""
    from pyarrow import fs

    if path.startswith("file:"):
        return open("/" + path.removeprefix("file:").lstrip("/"), "rb")
    store, inner = fs.FileSystem.from_uri(path)
    return store.open_input_file(inner)


def _files(spark: SparkSession, path: str) -> list[str]:
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    store = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(s.getPath().toString() for s in store.listStatus(root) if s.getLen() and not s.getPath().getName().startswith(("_", ".")))


def _head(raw: bytes) -> dict[str, str]:
    """The named fields of a record's header."""
    return {k.lower(): v for k, _, v in (line.partition(": ") for line in raw.decode("utf-8", "replace").split(_CRLF)[1:])}


def _captures(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each record of each archive, from its header alone; contents are skipped by seeking."""
    for batch in batches:
        for path in batch.column(0).to_pylist():
            with _open(path) as f:
                rows: list[tuple] = []
                at, tail = 0, b""
                while True:
                    f.seek(at)
                    raw = f.read(2048)
                    if not raw:
                        break
                    while (end := raw.find(b"\r\n\r\n")) < 0:
                        more = f.read(1 << 16)
                        if not more:
                            raise ValueError(f"{path}: a record at {at} has no end of its header")
                        raw += more
                    fields = _head(raw[:end])
                    size = end + 4 + int(fields["content-length"])
                    rows.append((surt(fields.get("warc-target-uri", "")), path, at, size))
                    at += size + 4
                    if len(rows) == 10_000:
                        yield _rows(rows)
                        rows = []
                if rows:
                    yield _rows(rows)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    keys, paths, at, size = zip(*rows)
    return pa.record_batch([pa.array(keys), pa.array(paths), pa.array(at, pa.int64()), pa.array(size, pa.int64())], ["key", "path", "at", "size"])


def _make(path: str):
    """A new binary file of any store that pyarrow knows."""
    import os

    from pyarrow import fs

    if path.startswith("file:"):
        local = "/" + path.removeprefix("file:").lstrip("/")
        os.makedirs(os.path.dirname(local), exist_ok=True)
        return open(local, "wb")
    store, inner = fs.FileSystem.from_uri(path)
    store.create_dir(os.path.dirname(inner), recursive=True)
    return store.open_output_stream(inner)


_DIRECTORY = "first_key string, last_key string, n long, file string, at long, size long"


def _blocks(lines: int, folder: str):
    """Writes the sorted captures of a partition as one file of blocks; gives its rows of the directory.

    The file's name is of this attempt alone, so that what a lost or repeated
    task has left is never named by the directory.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        path = f"{folder}/{uuid.uuid4().hex}.idx"
        held: list[tuple[str, str, int, int]] = []
        directory: list[tuple] = []
        out, end = None, 0

        def write(rows: list[tuple]) -> None:
            nonlocal out, end
            raw = zlib.compress("\n".join(f"{_quoted(k)} {p} {a} {s}" for k, p, a, s in rows).encode())
            out = out or _make(path)
            out.write(raw)
            directory.append((rows[0][0], rows[-1][0], len(rows), path, end, len(raw)))
            end += len(raw)

        for batch in batches:
            held += zip(*(c.to_pylist() for c in batch.columns))
            while len(held) >= lines:
                write(held[:lines])
                held = held[lines:]
        if held:
            write(held)
        if out is not None:
            out.close()
            names = ["first_key", "last_key", "n", "file", "at", "size"]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*directory)], names)

    return run


def _quoted(key: str) -> str:
    """A key without blanks or line ends; the order of keys is kept by comparing them unquoted."""
    from urllib.parse import quote

    return quote(key, safe="")


def _parsed(block: bytes) -> list[tuple[str, str, int, int]]:
    from urllib.parse import unquote

    out = []
    for line in zlib.decompress(block).decode().split("\n"):
        key, rest = line.split(" ", 1)
        path, at, size = rest.rsplit(" ", 2)
        out.append((unquote(key), path, int(at), int(size)))
    return out


def build_index(spark: SparkSession, archives: str, path: str, block_lines: int = BLOCK_LINES) -> None:
    """Index all archives below `archives`: blocks sorted by key in files below path/blocks, their directory at path/directory.

    Archives are read by header only. Keys are range-partitioned with the
    place of the record as tie-breaker, so a host or URL of any number of
    captures spreads over blocks and partitions.
    """
    files = spark.createDataFrame([(f,) for f in _files(spark, archives)], "path string")
    n = max(1, min(files.count(), 4 * spark.sparkContext.defaultParallelism))
    captures = materialise(files.repartition(n, "path").mapInArrow(_captures, "key string, path string, at long, size long"), "captures")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = captures.repartitionByRange(parts, "key", "path", "at").sortWithinPartitions("key", "path", "at")
    ordered.mapInArrow(_blocks(block_lines, f"{path}/blocks"), _DIRECTORY).write.parquet(f"{path}/directory")
    discard(captures)


_PAGE = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def _number(name: str) -> int | None:
    inner = name.removeprefix("<urn:page:").removesuffix(">")
    return None if inner == "null" else int(inner)


def parse_record(raw: bytes) -> dict:
    """A record's fields; the digest of a response is computed from its payload, a revisit's is the one it names."""
    end = raw.index(b"\r\n\r\n")
    fields, content = _head(raw[:end]), raw[end + 4 :]
    middle = content.index(b"\r\n\r\n")
    http, payload = _head(content[:middle]), content[middle + 4 :]
    revisit = fields["warc-type"] == "revisit"
    return {
        "page_id": _number(fields["warc-record-id"]), "url": fields.get("warc-target-uri", ""), "record_type": fields["warc-type"],
        "refers_to": _number(fields["warc-refers-to"]) if revisit else None, "payload_bytes": int(http["content-length"]) if revisit else len(payload),
        "payload_digest": fields["warc-payload-digest"].removeprefix("sha256:") if revisit else hashlib.sha256(payload).hexdigest(), "payload": None if revisit else payload,
    }


def _fetched(with_payload: bool):
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, name, rows, size = None, None, [], 0
        for batch in batches:
            for path, at, length in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("path", "at", "size"))):
                if path != name:
                    if file is not None:
                        file.close()
                    file, name = _open(path), path
                file.seek(at)
                row = parse_record(file.read(length))
                size += length if with_payload else 0
                rows.append(row if with_payload else row | {"payload": None})
                if len(rows) >= 5_000 or size > 8_000_000:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)
        if file is not None:
            file.close()

    return run


class Index:
    """Look-ups by URL in the index at `path`."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.directory = spark.read.schema(_DIRECTORY).parquet(f"{path}/directory")
        # One row for each index file; there are no more than the partitions that wrote them.
        ends = self.directory.groupBy("file").agg(F.min("first_key").alias("first"), F.max("last_key").alias("last"))
        rows = sorted((r["first"], r["last"], r["file"]) for r in ends.collect())
        self.first, self.last, self.files = ([r[i] for r in rows] for i in range(3))

    def captures(self, urls: DataFrame, url_col: str = "url") -> DataFrame:
        """(key, path, at, size) of all captures of the URLs in a column; a URL that is given often is looked up once."""
        first, last, files = self.first, self.last, self.files

        def dealt(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                file, keys = [], []
                for url in batch.column(0).to_pylist():
                    key = surt(cleaned(url))
                    own = files[bisect_left(last, key) : bisect_right(first, key)]
                    file += own
                    keys += [key] * len(own)
                yield pa.record_batch([pa.array(file, pa.string()), pa.array(keys, pa.string())], ["file", "key"])

        asked = urls.select(F.col(url_col).alias("url")).distinct().mapInArrow(dealt, "file string, key string").distinct()
        asked = asked.select("file", "key", F.lit(None).cast("string").alias("last_key"), F.lit(None).cast("long").alias("at"), F.lit(None).cast("long").alias("size"))
        entries = self.directory.select("file", F.col("first_key").alias("key"), "last_key", "at", "size")
        both = asked.unionByName(entries).withColumn("is_key", F.col("at").isNull())
        merged = both.repartition("file").sortWithinPartitions("file", "is_key", "key", "at")
        return merged.mapInArrow(_looked_up, "key string, path string, at long, size long")

    def records(self, urls: DataFrame, url_col: str = "url", with_payload: bool = True) -> DataFrame:
        """The records of all captures of the URLs in a column."""
        ranges = self.captures(urls, url_col).drop("key")
        dealt = ranges.repartition("path", F.floor(F.col("at") / (1 << 23))).sortWithinPartitions("path", "at")
        return dealt.mapInArrow(_fetched(with_payload), _PAGE)


def _looked_up(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a file's directory, then keys in order: the captures of each key, from the blocks that may hold it."""
    name, file = None, None
    last: list[str] = []
    first: list[str] = []
    ranges: list[tuple[int, int]] = []
    # Blocks that the last key needed; keys come in order, so others are done with.
    opened: dict[int, list[tuple[str, str, int, int]]] = {}
    found: list[tuple] = []
    for batch in batches:
        columns = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("file", "key", "last_key", "at", "size", "is_key"))
        for path, key, end, at, size, is_key in zip(*columns):
            if path != name:
                if file is not None:
                    file.close()
                name, file, first, last, ranges, opened = path, None, [], [], [], {}
            if not is_key:
                first.append(key)
                last.append(end)
                ranges.append((at, size))
                continue
            file = file or _open(path)
            blocks = range(bisect_left(last, key), bisect_right(first, key))
            opened = {i: block for i, block in opened.items() if i in blocks}
            for i in blocks:
                if i not in opened:
                    file.seek(ranges[i][0])
                    opened[i] = _parsed(file.read(ranges[i][1]))
                keys = opened[i]
                a = bisect_left(keys, key, key=lambda r: r[0])
                b = bisect_right(keys, key, key=lambda r: r[0])
                found += keys[a:b]
                if len(found) >= 10_000:
                    yield _rows(found)
                    found = []
    if found:
        yield _rows(found)
    if file is not None:
        file.close()


def archive_and_read(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", with_payload: bool = False) -> DataFrame:
    """Write `pages` as archives in shared scratch, index them, and look every page's URL up to read its records back."""
    spark = pages.sparkSession
    root = scratch_path(spark, "warc")
    write_archives(pages, f"{root}/archives", id_col, url_col, html_col)
    build_index(spark, f"{root}/archives", f"{root}/index")
    return Index(spark, f"{root}/index").records(pages, url_col, with_payload)
