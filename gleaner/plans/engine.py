"""Registered queries that run the engine itself: indexes are made, updated and searched as a user of the library does it."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.plans import index as I
from gleaner.plans.search import search
from gleaner.runtime import read, scratch_path

NOW_MS = 1_709_251_200_000
NOW = "2024-03-01T00:00:00.000Z"
DAY_MS = 86_400_000
QUERY = "golden rusty-plum"
WORDS = ("copper", "silver", "golden plum", "rusty plum")
FILLER = "It keeps its stock in good order and answers every letter within a week."


class VowelAdapter:
    """A text adapter that SQL can follow: the counts of five vowels, and one, on the unit sphere."""

    kind, name, dimensions = "text", "vowels", 6

    def embed_documents(self, texts: list[str]) -> list[list[float]]:
        counts = [[float(t.count(v)) for v in "aeiou"] + [1.0] for t in texts]
        return [[x / math.sqrt(sum(y * y for y in c)) for x in c] for c in counts]

    def embed_query(self, text: str) -> list[float]:
        return self.embed_documents([text])[0]


def _files(spark: SparkSession, d: str) -> DataFrame:
    """A document for each supplier, with a head that names its status."""
    k = F.col("s_suppkey")
    word = F.element_at(F.array(*map(F.lit, WORDS)), (k % 4 + 1).cast("int"))
    status = F.when(k % 3 == 0, "done").otherwise("open")
    body = F.concat(F.lit("Supplier "), "s_name", F.lit(" delivers from "), F.coalesce("n_name", F.lit("nowhere")), F.lit(" the "), word, F.lit(" ware. "), F.repeat(F.lit(FILLER + " "), (k % 5 + 1).cast("int")))
    rows = read(spark, d, "supplier").join(read(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"), "left")
    content = F.concat(F.lit("---\nstatus: "), status, F.lit("\n---\n\n"), body)
    rows = rows.select(k, F.concat(F.lit("/data/s/"), k.cast("string"), F.lit(".md")).alias("path"), (F.lit(NOW_MS) - k * DAY_MS).alias("mtime_ms"), content.alias("content"))
    return rows.withColumn("size", F.octet_length("content").cast("long"))


def _index(spark: SparkSession, d: str, pages: bool = False) -> tuple[str, VowelAdapter]:
    """The root of a fresh index `suppliers` over all documents, and, if wanted, over all page vectors."""
    root, adapter = scratch_path(spark, "indexes"), VowelAdapter()
    index = I.Index(spark, root, "suppliers")
    I.update(index, _files(spark, d).drop("s_suppkey"), adapter, NOW, "/data")
    if pages:
        vectors = read(spark, d, "embeddings").select(F.lit("doc").alias("document_id"), F.col("label").cast("int").alias("page_number"), F.row_number().over(_by_page()).alias("vector_index"), "embedding")
        images = vectors.select("document_id", "page_number").distinct().withColumn("image_hash", F.lit("h")).withColumn("source_path", F.lit("/data/doc.pdf"))
        I.update_pages(index, images, vectors, "late", NOW)
    return root, adapter


def _by_page():
    from pyspark.sql import Window

    return Window.partitionBy("label").orderBy("vec_id")


def _page_query(spark: SparkSession, d: str) -> list[list[float]]:
    rows = read(spark, d, "embeddings").orderBy("vec_id").limit(4).select("embedding").collect()
    return [[float(x) for x in r[0]] for r in rows]


def search_text(spark: SparkSession, d: str) -> DataFrame:
    root, adapter = _index(spark, d)
    found = search(spark, root, QUERY, ["suppliers"], vector=adapter.embed_query(QUERY), now_ms=NOW_MS, filters={"status": "OPEN"})
    return found.select("relative_path", *(F.round(c, 6).alias(c) for c in ("score", "semantic_score", "vec_score", "fts_score")), "metadata", "content_timestamp_ms")


def search_vision(spark: SparkSession, d: str) -> DataFrame:
    root, _ = _index(spark, d, pages=True)
    found = search(spark, root, QUERY, ["suppliers"], page_query=_page_query(spark, d), now_ms=NOW_MS, mode="vision")
    return found.select("page_number", "source_path", F.round("score", 6).alias("score"))


def search_hybrid(spark: SparkSession, d: str) -> DataFrame:
    root, adapter = _index(spark, d, pages=True)
    found = search(spark, root, QUERY, ["suppliers"], vector=adapter.embed_query(QUERY), page_query=_page_query(spark, d), now_ms=NOW_MS, mode="hybrid")
    return found.select("result_type", "relative_path", "page_number", F.round("rrf_score", 9).alias("rrf_score"))


def index_update(spark: SparkSession, d: str) -> DataFrame:
    """What a second update finds, and the totals after it."""
    root, adapter = _index(spark, d)
    index = I.Index(spark, root, "suppliers")
    k = F.col("s_suppkey")
    files = _files(spark, d).where(k % 7 != 0).withColumn("content", F.when(k % 5 == 0, F.concat("content", F.lit("More."))).otherwise(F.col("content")))
    files = files.withColumn("mtime_ms", F.col("mtime_ms") + F.when(k % 10 < 6, 1).otherwise(0)).withColumn("size", F.octet_length("content").cast("long"))
    counts = I.update(index, files.drop("s_suppkey"), adapter, NOW)
    again = I.update(index, files.drop("s_suppkey"), adapter, NOW)
    rows = [(s, counts.get(s, 0)) for s in ("changed", "new", "pruned", "touched", "unchanged")] + [("again", again.get("unchanged", 0)), ("total", int(index.meta()["total_files"]))]
    return spark.createDataFrame(rows, "status string, n long")


def index_chunks(spark: SparkSession, d: str) -> DataFrame:
    """The chunks of an index with the hashes that its embedding cache goes by."""
    root, _ = _index(spark, d)
    return I.Index(spark, root, "suppliers").table("chunks").select("path", "chunk_index", "content_hash", F.round(F.element_at("embedding", 1).cast("double"), 6).alias("first"), "content_timestamp_ms")


def index_postings(spark: SparkSession, d: str) -> DataFrame:
    """The stored inverted index: documents and occurrences of each term."""
    root, _ = _index(spark, d)
    return I.Index(spark, root, "suppliers").table("postings").groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


def _updated(spark: SparkSession, d: str) -> I.Index:
    """An index after an update that changes one file in fifty, and prunes and touches as many."""
    root, adapter = _index(spark, d)
    index, k = I.Index(spark, root, "suppliers"), F.col("s_suppkey") % 50
    files = _files(spark, d).where(k != 1).withColumn("content", F.when(k == 0, F.concat("content", F.lit("More."))).otherwise(F.col("content")))
    files = files.withColumn("mtime_ms", F.col("mtime_ms") + F.when(k.isin(0, 2), 1).otherwise(0)).withColumn("size", F.octet_length("content").cast("long"))
    I.update(index, files.drop("s_suppkey"), adapter, NOW)
    return index


def index_segments(spark: SparkSession, d: str) -> DataFrame:
    """What each commit to an index has written: rows of each table, and tombstones."""
    state = _updated(spark, d).snapshot().state
    rows = [(p["seq"], name, p["rows"]) for name, parts in state["tables"].items() if name not in ("impacts", "cells") for p in parts]
    rows += [(g["seq"], f"gone_{family}", g["rows"]) for family, graves in state["gone"].items() for g in graves]
    return spark.createDataFrame(rows, "segment int, name string, n long")


def index_merged(spark: SparkSession, d: str) -> DataFrame:
    """The inverted index after an update, when its segments have been merged."""
    index = _updated(spark, d)
    index.compact(full=True)
    return index.table("postings").groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


def index_page_texts(spark: SparkSession, d: str) -> DataFrame:
    """Keyword-only chunks of page texts beside documents; an update of the documents leaves them."""
    root, adapter = _index(spark, d)
    index = I.Index(spark, root, "suppliers")
    texts = read(spark, d, "region").select(F.lit("/data/doc.pdf").alias("path"), (F.col("r_regionkey") + 1).cast("int").alias("page_number"), F.when(F.col("r_regionkey") != 3, F.col("r_name")).otherwise("  ").alias("text"))
    I.add_page_texts(index, texts, "none", NOW)
    I.update(index, _files(spark, d).drop("s_suppkey").withColumn("mtime_ms", F.col("mtime_ms") + 1), adapter, NOW)
    return index.table("chunks").where("path LIKE 'pdf://%'").select("path", "chunk_index", "content", F.col("embedding").isNull().alias("bare"))


def index_list(spark: SparkSession, d: str) -> DataFrame:
    """The indexes below a root after one of three was deleted."""
    root, _ = _index(spark, d)
    for name in ("a", "b"):
        I.Index(spark, root, name).set_meta(index_name=name, total_files=0)
    I.Index(spark, root, "a").delete()
    rows = [(str(s["name"]), str(s.get("total_files"))) for s in I.list_indexes(spark, root)]
    return spark.createDataFrame(rows, "name string, total_files string")


def index_freshness(spark: SparkSession, d: str) -> DataFrame:
    """The age of an index for each supplier's time of indexing, and whether it is stale."""
    at = F.when(F.col("s_suppkey") % 6 != 0, F.date_format(F.timestamp_millis(F.lit(NOW_MS) - F.col("s_suppkey") * DAY_MS), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
    return read(spark, d, "supplier").select("s_suppkey", *I.index_age(at, NOW_MS))


QUERIES = {f.__name__: f for f in (search_text, search_vision, search_hybrid, index_update, index_chunks, index_postings, index_segments, index_merged, index_page_texts, index_list, index_freshness)}

_FILES = f"""
    files AS (
        SELECT s_suppkey AS k, 's/' || s_suppkey || '.md' AS rel, '/data/s/' || s_suppkey || '.md' AS path, {NOW_MS} - s_suppkey * {DAY_MS} AS ms, CASE WHEN s_suppkey % 3 = 0 THEN 'done' ELSE 'open' END AS status,
            rtrim('Supplier ' || s_name || ' delivers from ' || coalesce(n_name, 'nowhere') || ' the ' || {list(WORDS)}[(s_suppkey % 4 + 1)::INT] || ' ware. ' || repeat('{FILLER} ', (s_suppkey % 5 + 1)::INT)) AS content
        FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey
    ),
    raw AS (SELECT k, path, list_transform(['a', 'e', 'i', 'o', 'u'], lambda v: (length(content) - length(replace(content, v, '')))::DOUBLE) || [1.0::DOUBLE] AS c FROM files),
    units AS (SELECT k, list_transform(c, lambda x: (x / sqrt(list_sum(list_transform(c, lambda y: y * y))))::FLOAT::DOUBLE) AS v FROM raw),
    words AS (SELECT k, list_filter(regexp_split_to_array(lower(content || ' ' || path), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '') AS t FROM files)"""
_UPDATED = f"""{_FILES},
    later AS (SELECT k, path, CASE WHEN k % 50 = 0 THEN content || 'More.' ELSE content END AS content FROM files WHERE k % 50 <> 1),
    terms AS (SELECT k, 1 AS segment, unnest(t) AS term FROM words UNION ALL SELECT k, 2, unnest(list_filter(regexp_split_to_array(lower(content || ' ' || path), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')) FROM later)"""
_QC = [QUERY.count(v) for v in "aeiou"] + [1]
_QV = "[" + ", ".join(f"{x / math.sqrt(sum(y * y for y in _QC))!r}::DOUBLE" for x in _QC) + "]"
_LANES = f"""{_FILES},
    tf AS (SELECT k, len(t) AS dl, len(list_filter(t, lambda x: x = 'golden')) AS a, len(list_filter(range(1, len(t)), lambda i: t[i] = 'rusty' AND t[i + 1] = 'plum')) AS b FROM words),
    st AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS avgdl, count(*) FILTER (a > 0) AS da, count(*) FILTER (b > 0) AS db FROM tf),
    bm AS (
        SELECT k, greatest(1e-6, ln((n - da + 0.5) / (da + 0.5))) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * dl / avgdl)) + greatest(1e-6, ln((n - db + 0.5) / (db + 0.5))) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * dl / avgdl)) AS s FROM tf, st WHERE a > 0 OR b > 0
    ),
    kw AS (SELECT k, s FROM bm ORDER BY s DESC, k LIMIT 200),
    fts AS (SELECT k, s / (SELECT max(s) FROM kw) AS f FROM kw),
    near AS (SELECT k, greatest(0, 1 - d * d / 2) AS v FROM (SELECT k, list_distance(v, {_QV}) AS d FROM units ORDER BY d, k LIMIT 200)),
    cand AS (
        SELECT files.*, coalesce(v, 0)::DOUBLE AS vec, coalesce(f, 0)::DOUBLE AS fts, coalesce(v, 0) * 0.6::DOUBLE + coalesce(f, 0) * 0.4::DOUBLE AS sem
        FROM fts FULL JOIN near ON fts.k = near.k JOIN files ON files.k = coalesce(fts.k, near.k)
    ),
    scored AS (SELECT *, sem * (1 - 0.15::DOUBLE + 0.15::DOUBLE / (1 + k / 90.0::DOUBLE)) AS score FROM cand)"""
_PAGES = """
    sims AS (SELECT p.label, t.vec_id AS q, max(list_cosine_similarity(p.embedding::DOUBLE[], t.embedding::DOUBLE[])) AS best FROM embeddings p, embeddings t WHERE t.vec_id IN (SELECT vec_id FROM embeddings ORDER BY vec_id LIMIT 4) GROUP BY ALL),
    paged AS (SELECT label, sum(best) AS score FROM sims GROUP BY label ORDER BY score DESC, label::VARCHAR LIMIT 20)"""

SQL = {
    "search_text": f"""
        WITH {_LANES}
        SELECT rel AS relative_path, round(score, 6) AS score, round(sem, 6) AS semantic_score, round(vec, 6) AS vec_score, round(fts, 6) AS fts_score, '{{"status": "' || status || '"}}' AS metadata, ms AS content_timestamp_ms
        FROM scored WHERE status = 'open' ORDER BY scored.score DESC, path LIMIT 10""",
    "search_vision": f"WITH {_PAGES} SELECT label::INTEGER AS page_number, '/data/doc.pdf' AS source_path, round(score, 6) AS score FROM paged ORDER BY paged.score DESC, label LIMIT 10",
    "search_hybrid": f"""
        WITH {_LANES}, {_PAGES},
        cut AS (SELECT *, 'text:' || path || ':0' AS id FROM scored ORDER BY score DESC, path LIMIT 20),
        lanes AS (
            SELECT id, row_number() OVER (ORDER BY vec DESC, id) AS r FROM cut UNION ALL SELECT id, row_number() OVER (ORDER BY fts DESC, id) FROM cut
            UNION ALL SELECT 'vision:suppliers:' || label, row_number() OVER (ORDER BY score DESC, 'vision:suppliers:' || label) FROM paged
        ),
        fused AS (SELECT id, sum(1.0::DOUBLE / (60 + r)) AS s FROM lanes GROUP BY id ORDER BY s DESC, id LIMIT 10)
        SELECT CASE WHEN path IS NULL THEN 'vision' ELSE 'text' END AS result_type, rel AS relative_path, CASE WHEN path IS NULL THEN split_part(fused.id, ':', 3)::INTEGER END AS page_number, round(s, 9) AS rrf_score FROM fused LEFT JOIN cut ON cut.id = fused.id""",
    "index_update": """
        WITH s AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 7 = 0 THEN 'pruned' WHEN s_suppkey % 10 >= 6 THEN 'unchanged' WHEN s_suppkey % 5 = 0 THEN 'changed' ELSE 'touched' END AS status FROM supplier)
        SELECT 'new' AS status, 0::BIGINT AS n UNION ALL SELECT x, (SELECT count(*) FROM s WHERE status = x) FROM (VALUES ('changed'), ('pruned'), ('touched'), ('unchanged')) t(x)
        UNION ALL SELECT x, (SELECT count(*) FROM s WHERE status <> 'pruned') FROM (VALUES ('again'), ('total')) t(x)""",
    "index_chunks": f"WITH {_FILES} SELECT path, 0::BIGINT AS chunk_index, sha256(content || chr(0) || 'vowels') AS content_hash, round(v[1], 6) AS first, ms AS content_timestamp_ms FROM files JOIN units USING (k)",
    "index_postings": f"WITH {_FILES}, x AS (SELECT k, unnest(t) AS term FROM words) SELECT term, count(DISTINCT k) AS df, count(*) AS cf FROM x GROUP BY term",
    "index_segments": f"""
        WITH {_UPDATED}, rows AS (
            SELECT 1 AS segment, unnest(['files', 'chunks', 'lengths']) AS name FROM supplier
            UNION ALL SELECT 1, 'postings' FROM (SELECT DISTINCT k, term FROM terms WHERE segment = 1) UNION ALL SELECT 2, 'postings' FROM (SELECT DISTINCT k, term FROM terms WHERE segment = 2 AND k % 50 = 0)
            UNION ALL SELECT 2, unnest(CASE s_suppkey % 50 WHEN 0 THEN ['files', 'chunks', 'lengths', 'gone_files', 'gone_content'] WHEN 1 THEN ['gone_files', 'gone_content'] ELSE ['files', 'gone_files'] END) FROM supplier WHERE s_suppkey % 50 < 3
        )
        SELECT segment, name, count(*) AS n FROM rows GROUP BY ALL""",
    "index_merged": f"WITH {_UPDATED} SELECT term, count(DISTINCT k) AS df, count(*) AS cf FROM terms WHERE segment = 2 GROUP BY term",
    "index_page_texts": "SELECT 'pdf:///data/doc.pdf' AS path, r_regionkey::BIGINT AS chunk_index, '[Page ' || (r_regionkey + 1) || '] ' || r_name AS content, true AS bare FROM region WHERE r_regionkey <> 3",
    "index_list": "SELECT 'b' AS name, '0' AS total_files UNION ALL SELECT 'suppliers', count(*)::VARCHAR FROM supplier",
    "index_freshness": "SELECT s_suppkey, CASE WHEN s_suppkey % 6 <> 0 THEN s_suppkey::DOUBLE END AS age_days, CASE WHEN s_suppkey % 6 = 0 THEN 'never' WHEN s_suppkey > 7 THEN 'stale' ELSE 'fresh' END AS status FROM supplier",
}
