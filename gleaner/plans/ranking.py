"""Registered ranking queries: vectors, keywords, fusion, recency, filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import scoring
from gleaner.operators import ranking as R
from gleaner.runtime import checked_join, materialise, read, spread

NOW_MS = 1_709_251_200_000
EPOCH_MS = 1_704_067_200_000
QUERY = "than thnt thea"
BLOCK_QUERY = "license than thnt-thea"
TOP_K = 10


def _vector(spark: SparkSession, sf_dir: str, vec_id: int) -> list[float]:
    """The query's embedding: that of one stored vector."""
    row = read(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").first()
    return [float(x) for x in row[0]]


def _doc_ms():
    """Documents have no time of their own; each is a day older than the one before."""
    return F.lit(EPOCH_MS) - F.col("doc_id") * scoring.DAY_MS


def knn_l2_topk(spark: SparkSession, d: str) -> DataFrame:
    found = R.knn(read(spark, d, "embeddings"), _vector(spark, d, 0), 200, "vec_id")
    return found.select("vec_id", F.round("distance", 6).alias("distance"))


def knn_cells(spark: SparkSession, d: str) -> DataFrame:
    """The nearest vectors once more, from cells that may hold them."""
    rows = read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    placed, cells = R.celled(rows)
    table = materialise(placed.repartitionByRange("cell", "reach").sortWithinPartitions("cell", "reach").withColumn("part", F.lit(0)), "cells")
    found = R.CellSearch(table, materialise(cells.withColumn("part", F.lit(0)), "centres")).nearest(_vector(spark, d, 0), 200)
    return found.select(F.col("id").alias("vec_id"), F.round("distance", 6).alias("distance"))


def knn_score(spark: SparkSession, d: str) -> DataFrame:
    distance = R.l2_distance(F.col("embedding"), _vector(spark, d, 0))
    return read(spark, d, "embeddings").select("vec_id", F.round(scoring.distance_score(distance), 6).alias("score"))


def cosine_similarity(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "embeddings").select("vec_id", F.round(R.cosine(F.col("embedding"), _vector(spark, d, 1)), 6).alias("similarity"))


def maxsim_by_label(spark: SparkSession, d: str) -> DataFrame:
    query = [_vector(spark, d, i) for i in range(4)]
    found = R.maxsim(read(spark, d, "embeddings"), query, "label")
    return found.select("label", F.round("score", 6).alias("score"))


def maxsim_bounds(spark: SparkSession, d: str) -> DataFrame:
    """The best pages by late interaction, opened in the order of their bounds."""
    rows = read(spark, d, "embeddings").select("label", "embedding")
    found = R.PageSearch(rows, R.page_bounds(rows, "label"), "label").top([_vector(spark, d, i) for i in range(4)], 3)
    return found.select("label", F.round("score", 6).alias("score"))


def page_vector_counts(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n_vectors"))


def _bm25(spark: SparkSession, d: str) -> DataFrame:
    return R.bm25(spread(read(spark, d, "documents").select("doc_id", "text")), QUERY, "doc_id", F.col("text"))


def bm25_top200(spark: SparkSession, d: str) -> DataFrame:
    best = _bm25(spark, d).withColumn("score", F.round("score", 6)).orderBy(F.desc("score"), "id").limit(R.FTS_CANDIDATES)
    return best.select(F.col("id").alias("doc_id"), "score")


def _searched(spark: SparkSession, d: str, query: str, k: int) -> tuple[DataFrame, R.BlockSearch]:
    rows, words = read(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), F.coalesce("text", F.lit(""))
    posts = materialise(R.block_postings(rows, ["id"], F.col("text")).withColumn("part", F.lit(0)), "posts")
    # Every word is in one posting, but for those of rows without an id, which count as rows of the corpus too.
    n, held = rows.count(), posts.agg(F.sum("tf")).first()[0] or 0
    bare = rows.where("id IS NULL").agg(F.sum(F.size(R.tokens(words)))).first()[0] or 0
    found = R.BlockSearch(posts, R.impacts(posts).withColumn("part", F.lit(0)), n, (held + bare) / n if n else 0.0)
    return found.top(query, k), found


def bm25_blocks(spark: SparkSession, d: str) -> DataFrame:
    """The best rows of a keyword query with a phrase, from blocks of postings."""
    best, _ = _searched(spark, d, BLOCK_QUERY, TOP_K)
    return best.select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


def bm25_phrase(spark: SparkSession, d: str) -> DataFrame:
    found = R.bm25(spread(read(spark, d, "documents").select("doc_id", "text")), "rights-reserved license", "doc_id", F.col("text"))
    return found.select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


def inverted_index_stats(spark: SparkSession, d: str) -> DataFrame:
    posts = R.postings(spread(read(spark, d, "documents").select("doc_id", "text")), "doc_id", F.col("text"))
    return posts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").cast("long").alias("cf"))


def _hybrid(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of both lanes with their scores; keyword scores are rounded before the cut, so that both engines cut alike."""
    keyword = R.fts_candidates(_bm25(spark, d).withColumn("score", F.round("score", 6)))
    found = R.knn(read(spark, d, "embeddings"), _vector(spark, d, 0), 20 * TOP_K, "vec_id")
    return R.hybrid_candidates(keyword, found.select(F.col("vec_id").alias("id"), scoring.distance_score(F.col("distance")).alias("vec_score")))


def hybrid_text_topk(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("id"), "source", "lang", _doc_ms().alias("content_timestamp_ms"))
    scored = _hybrid(spark, d).join(docs, "id").withColumn("score", F.round(scoring.recency_weighted(F.col("semantic_score"), scoring.recency_boost(F.col("content_timestamp_ms"), NOW_MS), 0.15), 6))
    best = scored.orderBy(F.desc("score"), "id").limit(TOP_K)
    return best.select(F.col("id").alias("doc_id"), "score", F.round("semantic_score", 6).alias("semantic_score"), F.round("vec_score", 6).alias("vec_score"), F.round("fts_score", 6).alias("fts_score"), "source", "content_timestamp_ms")


def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    both = _hybrid(spark, d).join(read(spark, d, "documents").select(F.col("doc_id").alias("id")), "id")
    lane = lambda name, score: both.select(F.lit(name).alias("lane"), F.concat(F.lit("text:"), F.col("id").cast("string")).alias("id"), F.round(score, 6).alias("score"))
    query = [_vector(spark, d, i) for i in range(4)]
    pages = R.maxsim(read(spark, d, "embeddings"), query, "label").select(F.lit("vision").alias("lane"), F.concat(F.lit("vision:"), F.col("label").cast("string")).alias("id"), F.round("score", 6).alias("score"))
    lanes = lane("vec", "vec_score").unionByName(lane("fts", "fts_score")).unionByName(pages)
    return R.rrf(lanes, large=True).select("id", F.round("rrf_score", 9).alias("rrf_score"))


def recency_boost(spark: SparkSession, d: str) -> DataFrame:
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return read(spark, d, "events").select("event_id", F.round(scoring.recency_boost(ms, NOW_MS), 6).alias("boost"))


def recency_score(spark: SparkSession, d: str) -> DataFrame:
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return read(spark, d, "events").select("event_id", F.round(scoring.recency_weighted(F.col("value"), scoring.recency_boost(ms, NOW_MS, 30.0), 0.15), 3).alias("score"))


def relative_age(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", scoring.relative_age(_doc_ms(), EPOCH_MS).alias("age"))


def metadata_filter(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").where(scoring.matches_filters(F.col("props"), {"k": 3})).select("event_id", "props")


def threshold_cut(spark: SparkSession, d: str) -> DataFrame:
    score = scoring.distance_score(R.l2_distance(F.col("embedding"), _vector(spark, d, 0)))
    return read(spark, d, "embeddings").select("vec_id", F.round(score, 6).alias("score")).where("score >= 0.3")


def dedup_best(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"), "n_chars")
    return R.keep_best(docs, ["content_hash"], "n_chars", "doc_id")


def per_index_cut(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select("doc_id", F.col("source").alias("index_name"), "n_chars")
    return R.cut_per_index(docs, 2 * TOP_K, "n_chars", "doc_id")


def per_index_max(spark: SparkSession, d: str) -> DataFrame:
    """Lengths as shares of the longest of their source; the maxima are combined first, so no source gathers its rows."""
    docs = read(spark, d, "documents").select("doc_id", F.col("source").alias("index_name"), "n_chars")
    top = docs.groupBy("index_name").agg(F.max("n_chars").alias("most"))
    shares = checked_join(docs, top, "index_name", "left").withColumn("share", F.round(F.col("n_chars") / F.col("most"), 6))
    return shares.select("doc_id", "index_name", "n_chars", "share")


QUERIES = {f.__name__: f for f in (knn_l2_topk, knn_cells, knn_score, cosine_similarity, maxsim_by_label, maxsim_bounds, page_vector_counts, bm25_top200, bm25_blocks, bm25_phrase, inverted_index_stats, hybrid_text_topk, rrf_fusion, recency_boost, recency_score, relative_age, metadata_filter, threshold_cut, dedup_best, per_index_cut, per_index_max)}

_TOKENS = r"list_filter(regexp_split_to_array(strip_accents(lower(text)), '[^\p{L}\p{N}]+'), lambda t: t <> '')"
_BM25 = f"""
    words AS (SELECT doc_id, unnest(t) AS term, len(t) AS dl FROM (SELECT doc_id, {_TOKENS} AS t FROM documents)),
    sizes AS (SELECT doc_id, len({_TOKENS}) AS dl FROM documents),
    stats AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS avgdl FROM sizes),
    tfs AS (SELECT doc_id, term, count(*) AS tf, any_value(dl) AS dl FROM words WHERE term IN ('than', 'thnt', 'thea') GROUP BY doc_id, term),
    dfs AS (SELECT term, count(*)::DOUBLE AS df FROM tfs GROUP BY term),
    bm AS (
        SELECT doc_id, round(sum(greatest(1e-6, ln((n - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
        FROM tfs JOIN dfs USING (term), stats GROUP BY doc_id
    )"""
_Q = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = {})"
_HYBRID = f"""{_BM25},
    kw AS (SELECT doc_id AS id, score FROM bm ORDER BY score DESC, doc_id LIMIT 200),
    fts AS (SELECT id, score / (SELECT max(score) FROM kw) AS fts_score FROM kw),
    near AS (SELECT vec_id AS id, list_distance(embedding::DOUBLE[], {_Q.format(0)}) AS dist FROM embeddings ORDER BY dist, vec_id LIMIT 200),
    vec AS (SELECT id, greatest(0, 1 - dist * dist / 2) AS vec_score FROM near),
    hybrid AS (SELECT coalesce(fts.id, vec.id) AS id, coalesce(vec_score, 0) AS vec_score, coalesce(fts_score, 0) AS fts_score, coalesce(vec_score, 0) * 0.6::DOUBLE + coalesce(fts_score, 0) * 0.4::DOUBLE AS semantic_score FROM fts FULL JOIN vec ON fts.id = vec.id)"""
_MAXSIM = f"""
    sims AS (SELECT p.label, t.vec_id AS q, max(list_cosine_similarity(p.embedding::DOUBLE[], t.embedding::DOUBLE[])) AS best FROM embeddings p, embeddings t WHERE t.vec_id < 4 GROUP BY ALL),
    pages_ AS (SELECT label, round(sum(best), 6) AS score FROM sims GROUP BY label)"""
_MS = "epoch_ms(ts)"
_BOOST = "CASE WHEN {ms} >= 1709251200000 THEN 1.0::DOUBLE ELSE 1.0::DOUBLE / (1.0 + (1709251200000 - {ms}) / 86400000.0::DOUBLE / {half}::DOUBLE) END"
_DOC_MS = "(1704067200000 - doc_id * 86400000)"

_NEAREST = f"SELECT vec_id, round(list_distance(embedding::DOUBLE[], {_Q.format(0)}), 6) AS distance FROM embeddings ORDER BY list_distance(embedding::DOUBLE[], {_Q.format(0)}), vec_id LIMIT 200"

SQL = {
    "knn_l2_topk": _NEAREST,
    "knn_cells": _NEAREST,
    "knn_score": f"SELECT vec_id, round(greatest(0, 1 - list_distance(embedding::DOUBLE[], {_Q.format(0)}) ** 2 / 2), 6) AS score FROM embeddings",
    "cosine_similarity": f"SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], {_Q.format(1)}), 6) AS similarity FROM embeddings",
    "maxsim_by_label": f"WITH {_MAXSIM} SELECT label, score FROM pages_",
    "maxsim_bounds": f"WITH {_MAXSIM} SELECT label, score FROM pages_ ORDER BY score DESC, label LIMIT 3",
    "page_vector_counts": "SELECT label, count(*) AS n_vectors FROM embeddings GROUP BY label",
    "bm25_top200": f"WITH {_BM25} SELECT doc_id, score FROM bm ORDER BY score DESC, doc_id LIMIT 200",
    "bm25_phrase": f"""
        WITH t AS (SELECT doc_id, {_TOKENS} AS w FROM documents),
        places AS (SELECT doc_id, unnest(w) AS term, unnest(list_concat(w[2:], [''])) AS next FROM t),
        tfs AS (
            SELECT doc_id, 'p' AS phrase, count(*) AS tf FROM places WHERE term = 'rights' AND next = 'reserved' GROUP BY doc_id
            UNION ALL SELECT doc_id, 'l', count(*) FROM places WHERE term = 'license' GROUP BY doc_id
        ),
        dfs AS (SELECT phrase, count(*)::DOUBLE AS df FROM tfs GROUP BY phrase),
        stats AS (SELECT count(*)::DOUBLE AS n, avg(len(w)) AS avgdl FROM t)
        SELECT tfs.doc_id, round(sum(greatest(1e-6, ln((n - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / avgdl))), 6) AS score
        FROM tfs JOIN dfs USING (phrase) JOIN t USING (doc_id), stats GROUP BY tfs.doc_id""",
    "bm25_blocks": f"""
        WITH t AS (SELECT doc_id, {_TOKENS} AS w FROM documents),
        places AS (SELECT doc_id, unnest(w) AS term, unnest(list_concat(w[2:], [''])) AS next FROM t),
        tfs AS (
            SELECT doc_id, 'p' AS phrase, count(*) AS tf FROM places WHERE term = 'thnt' AND next = 'thea' GROUP BY doc_id
            UNION ALL SELECT doc_id, term, count(*) FROM places WHERE term IN ('license', 'than') GROUP BY doc_id, term
        ),
        dfs AS (SELECT phrase, count(*)::DOUBLE AS df FROM tfs GROUP BY phrase),
        stats AS (SELECT count(*)::DOUBLE AS n, avg(len(w)) AS avgdl FROM t),
        bm AS (
            SELECT tfs.doc_id, sum(greatest(1e-6, ln((n - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / avgdl))) AS s
            FROM tfs JOIN dfs USING (phrase) JOIN t USING (doc_id), stats GROUP BY tfs.doc_id
        )
        SELECT doc_id, round(s, 6) AS score FROM bm ORDER BY s DESC, doc_id LIMIT 10""",
    "inverted_index_stats": f"SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM (SELECT doc_id, unnest({_TOKENS}) AS term FROM documents) GROUP BY term",
    "hybrid_text_topk": f"""
        WITH {_HYBRID}, timed AS (SELECT h.*, source, {_DOC_MS} AS ms FROM hybrid h JOIN documents ON doc_id = id),
        scored AS (SELECT *, round(semantic_score * (1 - 0.15::DOUBLE + 0.15::DOUBLE * {_BOOST.format(ms="ms", half=90)}), 6) AS score FROM timed)
        SELECT id AS doc_id, score, round(semantic_score, 6) AS semantic_score, round(vec_score, 6) AS vec_score, round(fts_score, 6) AS fts_score, source, ms AS content_timestamp_ms
        FROM scored ORDER BY score DESC, id LIMIT 10""",
    "rrf_fusion": f"""
        WITH {_HYBRID}, {_MAXSIM}, both_ AS (SELECT h.* FROM hybrid h JOIN documents ON doc_id = h.id),
        lanes AS (
            SELECT 'vec' AS lane, 'text:' || id AS id, round(vec_score, 6) AS score FROM both_
            UNION ALL SELECT 'fts', 'text:' || id, round(fts_score, 6) FROM both_
            UNION ALL SELECT 'vision', 'vision:' || label, score FROM pages_
        ),
        places AS (SELECT *, row_number() OVER (PARTITION BY lane ORDER BY score DESC, id) AS r FROM lanes)
        SELECT id, round(sum(1.0::DOUBLE / (60 + r)), 9) AS rrf_score FROM places GROUP BY id""",
    "recency_boost": f"SELECT event_id, round({_BOOST.format(ms=_MS, half=90)}, 6) AS boost FROM events",
    "recency_score": f"SELECT event_id, round(value * (1 - 0.15::DOUBLE + 0.15::DOUBLE * {_BOOST.format(ms=_MS, half=30)}), 3) AS score FROM events",
    "relative_age": """
        SELECT doc_id, CASE WHEN doc_id = 0 THEN 'today' WHEN doc_id < 30 THEN doc_id || 'd ago' WHEN doc_id // 30 < 12 THEN (doc_id // 30) || 'mo ago' ELSE (doc_id // 365) || 'y ago' END AS age FROM documents""",
    "metadata_filter": "SELECT event_id, props FROM events WHERE lower(json_extract_string(props, '$.k')) = '3'",
    "threshold_cut": f"SELECT * FROM (SELECT vec_id, round(greatest(0, 1 - list_distance(embedding::DOUBLE[], {_Q.format(0)}) ** 2 / 2), 6) AS score FROM embeddings) WHERE score >= 0.3",
    "dedup_best": "SELECT doc_id, content_hash, n_chars FROM (SELECT doc_id, sha256(text) AS content_hash, n_chars, row_number() OVER (PARTITION BY sha256(text) ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE r = 1",
    "per_index_cut": "SELECT doc_id, index_name, n_chars FROM (SELECT doc_id, source AS index_name, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE r <= 20",
    "per_index_max": "SELECT doc_id, source AS index_name, n_chars, round(n_chars::DOUBLE / max(n_chars) OVER (PARTITION BY source), 6) AS share FROM documents",
}
