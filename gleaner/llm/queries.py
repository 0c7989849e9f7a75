"""The queries of the training-data operators, and the SQL that checks them where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import importance, language, licences, line_dedup, mixing, near_dedup, oracles, packing, phrases, secrets, topk, url_filter, vector_dedup, warc
from gleaner.runtime import read


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = url_filter.fit(url_filter.labelled_urls(spark))
    return url_filter.judge(read(spark, sf_dir, "pages"), model)


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op1 that SQL can follow: host, path and rule of every url, and the verdict where a rule gives it."""
    judged = op1_url_filter(spark, sf_dir)
    return judged.select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("ruled"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = near_dedup.near_duplicates(read(spark, sf_dir, "documents"))
    return classes.select(F.col("id").alias("doc_id"), "class_id", "kept")


def op3_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_vectors(read(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(read(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "context_size", "step_group")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = language.identify(docs, language.learn(docs))
    return found.select("doc_id", (language.fold("doc_id") == 2).alias("held_out"), "lang_pred", "score")


def op6_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.licences(read(spark, sf_dir, "documents"))
    starts = F.transform("base", lambda x: x["start"].cast("long"))
    names = lambda c: F.transform(c, lambda x: x["label"])
    listed = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    cover = F.coalesce(F.array_max(F.transform("found", lambda x: x["cover"])), F.lit(0.0))
    return found.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        listed(names("base")).alias("base_labels"), listed(F.concat(names("base"), names("found"))).alias("labels"), F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.least(cover, F.lit(1.0))).alias("score"),
    )


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(read(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"].isin(*secrets.BASE_KINDS))
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(secrets.joined(base), 256).alias("base_sha256"), secrets.joined(F.col("spans")).alias("spans"),
    )


def secret_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op7 that SQL can follow: the spans of the fixed patterns."""
    return op7_secrets(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = warc.archive_and_read(read(spark, sf_dir, "pages"))
    return pages.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = importance.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), percent=5, least_words=20)
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.drop_repeated_lines(read(spark, sf_dir, "documents").select("doc_id", "text"), least_docs=10)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_url_filter": op1_url_filter,
        "op2_near_dedup": op2_near_dedup,
        "op3_vector_dedup": op3_vector_dedup,
        "op4_packing": op4_packing,
        "op5_language": op5_language,
        "op6_licences": op6_licences,
        "op7_secrets": op7_secrets,
        "op8_mixing": op8_mixing,
        "op9_topk": op9_topk,
        "op10_warc": op10_warc,
        "op11_importance": op11_importance,
        "op12_line_dedup": op12_line_dedup,
        "op13_collocations": op13_collocations,
        "url_rules": url_rules,
        "secret_base": secret_base,
    }


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()
