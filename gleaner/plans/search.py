"""Search over indexes: text, vision and hybrid modes of one ranked query."""

from __future__ import annotations

import warnings
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.functions import scoring, text
from gleaner.operators import ranking as R
from gleaner.plans.segments import Index, Snapshot

#: From so many postings on, keyword candidates come from blocks of high bounds, in a few jobs; both ways give the same.
MANY_POSTINGS = 5_000_000
#: Likewise for vectors, whose far cells are left out.
MANY_VECTORS = 200_000
#: All fields of a result, with their types, in order.
RESULT = (
    ("score", "double"), ("semantic_score", "double"), ("rrf_score", "double"), ("vec_score", "double"), ("fts_score", "double"), ("index_name", "string"), ("file_path", "string"), ("relative_path", "string"), ("section_context", "string"),
    ("content", "string"), ("metadata", "string"), ("content_timestamp_ms", "bigint"), ("chunk_index", "bigint"), ("result_type", "string"), ("page_number", "int"), ("source_path", "string"),
)


def _result(rows: DataFrame) -> DataFrame:
    have = set(rows.columns)
    return rows.select(*(F.col(n) if n in have else F.lit(None).cast(t).alias(n) for n, t in RESULT))


def _lane(index: Snapshot, query: str, vector: list[float], top_k: int, now_ms: int, weight: float, half_life: float, filters: dict | None, prefilter: bool) -> DataFrame:
    """The best 2 top_k chunks of one index: both candidate sets, then filters, then scores.

    Keyword candidates come from the stored postings and vector candidates from
    a few columns of the chunks; contents and metadata are joined to candidates only.
    Candidates that tie at the cut are taken by their time, the newer first, since
    that is the better result; then by path.
    """
    meta = index.meta
    key = F.struct("path", "chunk_index").alias("id")
    files, chunks = index.table("files").select("path", "metadata"), index.table("chunks")
    newest = F.struct(F.coalesce(-F.col("content_timestamp_ms"), F.lit((1 << 63) - 1)).alias("age"), "path", "chunk_index").alias("id")
    times = chunks.select(key, F.col("content_timestamp_ms").alias("ms"))
    postings, lengths, vectors = index.table("postings"), index.table("lengths"), chunks.select("path", "chunk_index", "content_timestamp_ms", "embedding")
    if prefilter and filters:
        allowed = files.where(scoring.matches_filters(F.col("metadata"), filters)).select("path")
        postings, lengths, vectors = (t.join(allowed, "path", "left_semi") for t in (postings, lengths, vectors))
    if index.rows("postings") >= MANY_POSTINGS and not (prefilter and filters):
        scores = index.keyword_search().top(query, R.FTS_CANDIDATES, tied=True)
    else:
        scores = R.bm25_stored(postings.select("term", key, "tf", "positions"), lengths.select(key, "dl"), query)
    if index.rows("chunks") >= MANY_VECTORS and not (prefilter and filters):
        near = index.vector_search(newest).nearest(vector, 20 * top_k)
    else:
        near = R.knn(vectors.select(newest, "embedding"), vector, 20 * top_k, "id")
    near = near.select(F.struct("id.path", "id.chunk_index").alias("id"), scoring.distance_score(F.col("distance")).alias("vec_score"))
    both = R.hybrid_candidates(R.newest_candidates(scores, times), near).select("id.*", "vec_score", "fts_score", "semantic_score")
    # At most FTS_CANDIDATES + 20 top_k rows.
    both = F.broadcast(both).join(chunks.drop("embedding"), ["path", "chunk_index"]).join(files, "path").where(scoring.matches_filters(F.col("metadata"), filters))
    boost = scoring.recency_boost(F.col("content_timestamp_ms"), now_ms, half_life)
    scored = both.withColumn("score", scoring.recency_weighted(F.col("semantic_score"), boost, weight)).withColumn("index_name", F.lit(index.index.name))
    relative = text.relative_path(F.lit(meta.get("source_directory") or "\0"), F.col("path"))
    scored = scored.withColumn("relative_path", relative).withColumnRenamed("path", "file_path").withColumn("result_type", F.lit("text"))
    return _result(R.cut_per_index(scored, 2 * top_k, "score", "file_path", "chunk_index"))


def _vision(index: Snapshot, query: list[list[float]], top_k: int) -> DataFrame | None:
    if not index.meta.get("vision_adapter"):
        return None
    page = F.concat_ws("\0", "document_id", F.col("page_number").cast("string"))
    vectors = index.table("page_vectors").withColumn("page", page)
    if index.rows("page_vectors") >= MANY_VECTORS:
        bounds = index.table("page_bounds").select(page.alias("page"), "width", "centre", "radius")
        best = R.PageSearch(vectors, bounds, "page").top(query, 2 * top_k)
    else:
        best = R.maxsim(vectors, query, "page")
    rows = best.join(index.table("page_images").withColumn("page", page), "page").withColumn("index_name", F.lit(index.index.name)).withColumn("result_type", F.lit("vision")).withColumn("file_path", F.col("source_path"))
    return _result(R.cut_per_index(rows, 2 * top_k, "score", "page"))


def merge_text(rows: DataFrame, top_k: int, threshold: float) -> DataFrame:
    """Results of all indexes: the best of each chunk, those that reach the threshold, then the best `top_k`."""
    best = R.keep_best(rows, ["file_path", "chunk_index"], "score", "index_name").where(F.col("score") >= threshold)
    return best.orderBy(F.desc("score"), "index_name", "file_path", "chunk_index").limit(top_k)


def fuse(rows: DataFrame, pages: DataFrame | None, top_k: int, threshold: float) -> DataFrame:
    """Reciprocal rank fusion of the vector, keyword and page lanes; the threshold holds for the fused score, after the cut."""
    ided = rows.withColumn("id", F.concat(F.lit("text:"), "file_path", F.lit(":"), F.col("chunk_index").cast("string")))
    if pages is not None:
        ided = ided.unionByName(pages.withColumn("id", F.concat(F.lit("vision:"), "index_name", F.lit(":"), F.col("page_number").cast("string"))))
    lane = lambda name, score, kind: ided.where(F.col("result_type") == kind).select(F.lit(name).alias("lane"), "id", F.col(score).alias("score"))
    lanes = reduce(DataFrame.unionByName, (lane("vec", "vec_score", "text"), lane("fts", "fts_score", "text"), lane("vision", "score", "vision")))
    fused = R.rrf(lanes)
    last = ided.withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy("index_name", "file_path"))).where("_n = 1").drop("_n", "rrf_score", "score")
    out = last.join(fused, "id").withColumn("score", F.col("rrf_score"))
    return _result(out.orderBy(F.desc("rrf_score"), "id").limit(top_k).where(F.col("rrf_score") >= threshold))


def search(
    spark: SparkSession, root: str, query: str, index_names: list[str], *, vector: list[float] | None = None, page_query: list[list[float]] | None = None, now_ms: int, top_k: int = 10, threshold: float = 0.0, mode: str = "text",
    recency_weight: float = 0.15, half_life_days: float = 90.0, filters: dict | None = None, prefilter: bool = False,
) -> DataFrame:
    """The best `top_k` results of a query over indexes, as one lazy plan.

    `vector` and `page_query` are the query's embeddings; indexes that do not
    exist are warned of and left out. `prefilter` applies the metadata filter
    before candidates are chosen, so that it can't leave fewer than there are.
    """
    top_k, threshold = top_k or 10, threshold or 0.0
    found = []
    for name in index_names:
        index = Index(spark, root, name).snapshot()
        if index.version:
            found.append(index)
        else:
            warnings.warn(f"no index {name!r}", stacklevel=2)
    empty = spark.createDataFrame([], ", ".join(f"{n} {t}" for n, t in RESULT))
    union = lambda parts: reduce(DataFrame.unionByName, parts, empty)
    lanes = union([_lane(i, query, vector or [], top_k, now_ms, recency_weight, half_life_days, filters, prefilter) for i in found]) if mode in ("text", "hybrid") else empty
    if mode == "text":
        return merge_text(lanes, top_k, threshold)
    pages = union([p for i in found if page_query and (p := _vision(i, page_query, top_k)) is not None])
    if mode == "vision":
        return pages.orderBy(F.desc("score"), "index_name", "source_path", "page_number").limit(top_k).where(F.col("score") >= threshold)
    return fuse(lanes, pages, top_k, threshold)


def aged(results: DataFrame, now_ms: int) -> DataFrame:
    """Results with the age that the text format shows."""
    age: Column = scoring.relative_age(F.col("content_timestamp_ms"), now_ms)
    return results.withColumn("age", age)
