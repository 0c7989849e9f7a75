"""Incremental upkeep of indexes: files, chunks with vectors, an inverted index, and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import markup, scoring, text
from gleaner.functions.embedding import TextAdapter, embed
from gleaner.functions.frontmatter import yaml_to_json
from gleaner.operators import ranking as R
from gleaner.operators.rollups import diff_status
from gleaner.plans.segments import FILES, Index, Snapshot
from gleaner.runtime import checked_join, discard, materialise, spread

SCHEMA_VERSION = 6
__all__ = ["FILES", "Index", "add_page_texts", "chunked", "freshness", "index_age", "list_indexes", "parsed", "reindex", "update", "update_pages"]


def list_indexes(spark: SparkSession, root: str) -> list[dict[str, object]]:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(root)
    store = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(at):
        return []
    return [Index(spark, root, n).status() for n in sorted(s.getPath().getName() for s in store.listStatus(at) if s.isDirectory())]


def parsed(documents: DataFrame) -> DataFrame:
    """(path, ..., metadata, body, content_timestamp_ms) of whole texts (path, content, mtime_ms)."""
    parts = documents.withColumn("_p", text.frontmatter_parts(F.col("content"))).withColumn("metadata", yaml_to_json("_p.yaml"))
    # Frontmatter that is no mapping leaves the whole text as the body.
    whole = F.when(F.col("metadata").isNull() & F.col("_p.yaml").isNotNull(), F.col("content")).otherwise(F.col("_p.body"))
    return parts.withColumn("body", whole).withColumn("content_timestamp_ms", scoring.content_timestamp(F.col("metadata"), F.col("mtime_ms"))).drop("_p")


def chunked(documents: DataFrame) -> DataFrame:
    """(path, chunk_index, content, section_context, content_timestamp_ms): `parsed` documents by the chunker of their format."""
    docs = documents.withColumn("_format", markup.mail_format(F.col("metadata")))
    field = lambda k: F.coalesce(F.get_json_object("metadata", f"$.{k}"), F.lit(""))
    subject = F.coalesce(F.nullif(field("subject"), F.lit("")), text.title(F.col("metadata"), F.col("body")), F.lit(""))
    blocks = F.transform(markup.thread_messages(F.col("body")), markup.message_block)
    thread = F.flatten(F.transform(blocks, lambda m: markup.message_chunks(m["body"], F.coalesce(F.nullif(m["subject"], F.lit("")), subject), m["from"], m["date"])))
    message = markup.message_chunks(F.col("body"), field("subject"), field("from"), field("date"))
    plain = text.document_chunks(text.title(F.col("metadata"), F.col("body")), F.col("body"))
    made = F.when(F.col("_format") == "thread", thread).when(F.col("_format") == "message", message).otherwise(plain)
    rows = docs.select("path", "content_timestamp_ms", F.posexplode(made).alias("chunk_index", "c"))
    return rows.select("path", F.col("chunk_index").cast("long").alias("chunk_index"), "c.content", "c.section_context", "content_timestamp_ms")


def _inverted(chunks: DataFrame) -> dict[str, DataFrame]:
    """The postings in blocks and the lengths of `chunks` (path, chunk_index, content)."""
    rows = chunks.select("path", "chunk_index", F.concat_ws(" ", "content", "path").alias("text"))
    return {
        "postings": R.block_postings(rows, ["path", "chunk_index"], F.col("text")),
        "lengths": materialise(rows.select("path", "chunk_index", F.size(R.tokens(F.col("text"))).alias("dl")), "lengths"),
    }


def _own(path: str = "path") -> Column:
    """Whether a file's rows come from page texts."""
    return F.col(path).startswith("pdf://")


def _vectors(stored: DataFrame, chunks: DataFrame, adapter: TextAdapter) -> DataFrame:
    """(content_hash, embedding) of all texts of `chunks`: stored vectors, and new ones for hashes that have none.

    Only stored vectors of wanted hashes are moved; those wanted are broadcast where few.
    """
    wanted = materialise(chunks.select("content_hash", "content").dropDuplicates(["content_hash"]), "wanted")
    known = checked_join(stored.where("embedding IS NOT NULL").select("content_hash", "embedding"), wanted.select("content_hash"), "content_hash", "left_semi")
    known = materialise(known.dropDuplicates(["content_hash"]), "known")
    fresh = embed(wanted.join(known, "content_hash", "left_anti"), "content", adapter).select("content_hash", "embedding")
    return known.unionByName(fresh)


def _counted(snap: Snapshot, counts: dict[str, int], gone: DataFrame, lengths: DataFrame) -> dict[str, int]:
    """The totals after an update, from those before and what it changes; lengths have one row for each chunk."""
    sums = lambda df: tuple(x or 0 for x in df.agg(F.count(F.lit(1)), F.sum("dl")).first())
    lost, lost_dl = sums(checked_join(snap.table("lengths"), gone, "path", "left_semi")) if "changed" in counts or "pruned" in counts else (0, 0)
    made, made_dl = sums(lengths)
    before = lambda k: int(snap.meta.get(k, 0))
    return {
        "total_files": before("total_files") + counts.get("new", 0) - counts.get("pruned", 0),
        "total_chunks": before("total_chunks") - lost + made, "total_dl": before("total_dl") - lost_dl + made_dl,
    }


def update(index: Index, documents: DataFrame, adapter: TextAdapter, now_iso: str, source: str = "", prune: bool = True) -> dict[str, int]:
    """Bring an index up to `documents` (path, size, mtime_ms, content): prune, skip, touch, re-chunk, embed what is new.

    Each text is embedded once, and only if its hash has no vector yet. A file
    that became empty loses its chunks. Without a change nothing is written;
    else one segment of what changed, and tombstones of what it replaces. With `prune`
    off, `documents` are a batch, and files that it does not hold stay. Returns how
    many files had each status. Raises `segments.Conflict` if another writer has changed the same tables.
    """
    snap = index.snapshot()
    stored_files = snap.table("files").where(~_own())
    if not prune:
        stored_files = checked_join(stored_files, materialise(documents.select("path").distinct(), "batch"), "path", "left_semi")
    if snap.version:
        # Times alone, without a content read, tell whether there is anything to do.
        then = stored_files.select("path", F.col("mtime_ms").alias("then"))
        both = documents.select("path", "mtime_ms").join(then, "path", "full")
        n, differ = both.agg(F.count(F.lit(1)), F.count_if(~F.col("then").eqNullSafe(F.col("mtime_ms")))).first()
        if not differ:
            index.set_meta(last_indexed_at=now_iso)
            return {"unchanged": n} if n else {}
    current = documents.withColumn("content_hash", text.sha256(F.col("content")))
    status = materialise(diff_status(stored_files, current, "path", "content_hash", "mtime_ms"), "status")
    counts = {r.status: r["count"] for r in status.groupBy("status").count().collect()}
    of = lambda *kinds: status.where(F.col("status").isin(*kinds)).select("path")
    docs = materialise(parsed(current.join(of("new", "changed"), "path", "left_semi")), "parsed")
    # Small files come in few partitions, and chunking costs far more than moving them.
    chunks = chunked(spread(docs)).withColumn("content_hash", text.chunk_hash(F.col("content"), adapter.name))
    chunks = materialise(chunks, "chunks")
    vectors = materialise(_vectors(snap.table("chunks"), chunks, adapter), "vectors")
    made = chunks.join(vectors, "content_hash", "left").select("path", "chunk_index", "content", "embedding", "content_hash", "section_context", "content_timestamp_ms")
    files = docs.select("path", "content_hash", "size", "mtime_ms", F.lit(now_iso).alias("indexed_at"), "metadata")
    touched = current.join(of("touched"), "path", "left_semi").select("path", "mtime_ms", "size")
    touched = checked_join(stored_files.drop("mtime_ms", "size"), materialise(touched, "touched"), "path").select(*files.columns)
    gone = of("changed", "pruned")
    meta = {"schema_version": SCHEMA_VERSION, "index_name": index.name, "source_directory": source or snap.meta.get("source_directory", ""), "model_id": adapter.name, "last_indexed_at": now_iso}
    keywords = _inverted(chunks)
    index.commit(
        snap, append={"files": files.unionByName(touched), "chunks": made, **keywords}, gone={"files": of("changed", "pruned", "touched"), "content": gone},
        meta=meta | _counted(snap, counts, gone, keywords["lengths"]), reads=("files", "chunks", "lengths"),
    )
    discard(status, docs, chunks, vectors)
    index.compact()
    return counts


def update_pages(index: Index, pages: DataFrame, vectors: DataFrame, adapter_name: str, now_iso: str) -> None:
    """Upsert page images (document_id, page_number, image_hash, source_path) and their vectors; pages with the same image stay."""
    snap = index.snapshot()
    stored, keys = snap.table("page_images"), ["document_id", "page_number"]
    fresh = materialise(pages.join(stored.select(*keys, "image_hash"), [*keys, "image_hash"], "left_anti"), "fresh")
    own = checked_join(vectors, fresh.select(*keys), keys, "left_semi").select(*index.empty("page_vectors").columns)
    own = materialise(own, "vectors")
    counted = own.groupBy(*keys).agg(F.count(F.lit(1)).cast("int").alias("num_vectors"))
    rows = fresh.join(counted, keys, "left").select(*keys, "image_hash", F.lit(adapter_name).alias("adapter_name"), F.coalesce("num_vectors", F.lit(0)).alias("num_vectors"), "source_path", F.lit(now_iso).alias("indexed_at"))
    lost = checked_join(stored.select(*keys, "num_vectors"), fresh.select(*keys), keys, "left_semi")
    pages_lost, vectors_lost = lost.agg(F.count(F.lit(1)), F.sum("num_vectors")).first()
    before = lambda k: int(snap.meta.get(k, 0))
    index.commit(
        snap, append={"page_images": rows, "page_vectors": own}, gone={"pages": fresh}, reads=("page_images", "page_vectors"),
        meta={
            "vision_adapter": adapter_name, "last_vision_indexed_at": now_iso, "total_pages": before("total_pages") - pages_lost + fresh.count(),
            "total_page_vectors": before("total_page_vectors") - (vectors_lost or 0) + own.count(),
        },
    )
    discard(fresh, own)
    index.compact()


def add_page_texts(index: Index, texts: DataFrame, model: str, now_iso: str) -> None:
    """Keyword-only chunks of page texts (path, page_number, text): no vector, no metadata, no time."""
    rows = texts.where(~text.is_blank(F.col("text"))).select(F.concat(F.lit("pdf://"), "path").alias("path"), F.col("page_number"), F.format_string("[Page %d] %s", "page_number", "text").alias("content"))
    chunks = rows.select("path", (F.col("page_number") - 1).cast("long").alias("chunk_index"), "content", F.lit(None).cast("array<float>").alias("embedding"), text.chunk_hash(F.col("content"), model).alias("content_hash"), F.lit(None).cast("string").alias("section_context"), F.lit(None).cast("long").alias("content_timestamp_ms"))
    files = rows.groupBy("path").agg(text.sha256(F.array_join(F.array_sort(F.collect_list("content")), "\n")).alias("content_hash"), F.sum(F.octet_length("content")).cast("long").alias("size")).select("path", "content_hash", "size", F.lit(0).cast("long").alias("mtime_ms"), F.lit(now_iso).alias("indexed_at"), F.lit(None).cast("string").alias("metadata"))
    own = materialise(texts.select(F.concat(F.lit("pdf://"), "path").alias("path")).distinct(), "own")
    snap = index.snapshot()
    counts = {"new": files.count(), "pruned": checked_join(snap.table("files").select("path"), own, "path", "left_semi").count()}
    keywords = _inverted(chunks)
    index.commit(snap, append={"files": files, "chunks": chunks, **keywords}, gone={"files": own, "content": own}, meta=_counted(snap, counts, own, keywords["lengths"]), reads=("files", "lengths"))
    discard(own)
    index.compact()


def reindex(spark: SparkSession, root: str, documents_of, adapter: TextAdapter, now_iso: str, name: str | None = None) -> dict[str, object]:
    """Update one index, or all of them, from their own sources; an index that fails leaves the others alone."""
    out: dict[str, object] = {}
    for status in list_indexes(spark, root):
        if name is None or status["name"] == name:
            try:
                index = Index(spark, root, str(status["name"]))
                out[index.name] = update(index, documents_of(index.meta()["source_directory"]), adapter, now_iso)
            except Exception as error:
                out[str(status["name"])] = error
    return out


def freshness(spark: SparkSession, root: str, now_ms: int, most_days: float = 7.0) -> DataFrame:
    """(name, indexed_at, age_days, status) of each index below a root: `fresh`, `stale` beyond `most_days`, or `never` indexed."""
    rows = [(str(s["name"]), s.get("last_indexed_at")) for s in list_indexes(spark, root)]
    table = spark.createDataFrame(rows, "name string, indexed_at string")
    return table.select("name", "indexed_at", *index_age(F.col("indexed_at"), now_ms, most_days))


def index_age(indexed_at: Column, now_ms: int, most_days: float = 7.0) -> tuple[Column, Column]:
    """The age in days of a time of indexing, and what it amounts to."""
    age = (F.lit(now_ms) - F.unix_millis(F.try_to_timestamp(indexed_at))) / F.lit(86_400_000.0)
    return age.alias("age_days"), F.when(age.isNull(), "never").when(age > most_days, "stale").otherwise("fresh").alias("status")
