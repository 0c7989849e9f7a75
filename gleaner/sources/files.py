"""Documents and page images from folders, on any file system that Spark reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EXTENSIONS = ("md", "markdown", "txt")


def _documents(spark: SparkSession, root: str) -> DataFrame:
    """Binary files below `root` that are text documents; names count in any letter case."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True)
    any_case = ["".join(f"[{c}{c.upper()}]" for c in e) for e in EXTENSIONS]
    files = found.option("pathGlobFilter", "*.{" + ",".join(any_case) + "}").load(root)
    below = F.substring_index(F.regexp_replace("path", r"/[^/]*$", ""), root.rstrip("/").split(":")[-1], -1)
    return files.where(~below.rlike(r"/[._]"))


def walk_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, size, mtime_ms) of all text documents below `root`; folders that begin with `_` or `.` are left out.

    Lists by Spark's own readers, so the listing of a large tree is distributed;
    they skip files whose own names begin so, too.
    """
    return _documents(spark, root).select("path", F.col("length").alias("size"), F.unix_millis("modificationTime").alias("mtime_ms"))


def read_documents(spark: SparkSession, root: str) -> DataFrame:
    """(path, size, mtime_ms, content) with whole UTF-8 contents; files that can't be read, and empty ones, are skipped."""
    return _documents(spark, root).select("path", F.col("length").alias("size"), F.unix_millis("modificationTime").alias("mtime_ms"), F.decode("content", "UTF-8").alias("content"))


def guarded(spark: SparkSession, root: str) -> DataFrame:
    """read_documents, but a missing root is an error before anything is pruned."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        raise FileNotFoundError(f"no such folder: {root}")
    return read_documents(spark, root)


class PageExtractor:
    """What turns a document into page images and page texts; a rasteriser is plugged in by subclassing."""

    def pages(self, content: bytes) -> list[bytes]:
        raise NotImplementedError

    def texts(self, content: bytes) -> list[tuple[str, str]]:
        """(text, method) of each page."""
        raise NotImplementedError


def extract_pages(documents: DataFrame, extractor: PageExtractor) -> DataFrame:
    """(path, document_id, page_number, image, image_hash) of each page of binary documents (path, content)."""
    import base64
    import hashlib

    import pandas as pd

    def run(batches):
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"]):
                for n, image in enumerate(extractor.pages(bytes(content)), 1):
                    rows.append((path, hashlib.sha256(path.encode()).hexdigest(), n, image, hashlib.sha256(base64.b64encode(image)).hexdigest()))
            yield pd.DataFrame(rows, columns=["path", "document_id", "page_number", "image", "image_hash"])

    return documents.select("path", "content").mapInPandas(run, "path string, document_id string, page_number int, image binary, image_hash string")


def extract_text(documents: DataFrame, extractor: PageExtractor) -> DataFrame:
    """(path, page_number, text, method) of each page."""
    import pandas as pd

    def run(batches):
        for pdf in batches:
            rows = [(path, n, text.strip(), method) for path, content in zip(pdf["path"], pdf["content"]) for n, (text, method) in enumerate(extractor.texts(bytes(content)), 1)]
            yield pd.DataFrame(rows, columns=["path", "page_number", "text", "method"])

    return documents.select("path", "content").mapInPandas(run, "path string, page_number int, text string, method string")
