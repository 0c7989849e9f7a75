"""Registered queries on records: threads, look-ups, diffs, change logs, trees, chat rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import chat
from gleaner.functions.text import sha256
from gleaner.operators import rollups as R
from gleaner.runtime import read


def thread_rollup(spark: SparkSession, d: str) -> DataFrame:
    found = R.thread_rollup(read(spark, d, "conversations"), "conv_id", "turn", "role", "text")
    return found.select("conv_id", "message_count", "participants", sha256(F.col("body")).alias("body_hash"))


def participants(spark: SparkSession, d: str) -> DataFrame:
    rows = R.ordered(read(spark, d, "events"), ["user_id"], ["event_id"], ["event_type"])
    return rows.select("user_id", F.array_join(R.first_seen(F.transform("items", lambda x: x["event_type"])), ",").alias("participants"))


def first_last(spark: SparkSession, d: str) -> DataFrame:
    return R.first_last(read(spark, d, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us")), "user_id", "us")


def day_groups(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("at"))
    return R.group_breaks(rows, ["user_id"], ["at", "event_id"], F.to_date("at")).select("event_id", F.date_format("at", "yyyy-MM-dd").alias("day"), "is_break")


def numbered_runs(spark: SparkSession, d: str) -> DataFrame:
    """The number of each event within its run of equal types, as items of numbered lists count."""
    from pyspark.sql import Window

    rows = R.group_breaks(read(spark, d, "events").select("event_id", "user_id", "event_type"), ["user_id"], ["event_id"], F.col("event_type"))
    run = F.sum(F.col("is_break").cast("int")).over(Window.partitionBy("user_id").orderBy("event_id"))
    numbered = rows.withColumn("run", run).withColumn("number", F.row_number().over(Window.partitionBy("user_id", "run").orderBy("event_id")))
    return numbered.select("event_id", F.col("run").cast("long").alias("run"), F.col("number").cast("long").alias("number"))


def lookup_enrich(spark: SparkSession, d: str) -> DataFrame:
    customers = read(spark, d, "customer").where("c_custkey % 5 <> 0")
    named = R.lookup(read(spark, d, "orders").select("o_orderkey", "o_custkey"), customers, "o_custkey", "c_custkey", "c_name", "customer_name")
    return named.select("o_orderkey", "customer_name")


def lookup_chain(spark: SparkSession, d: str) -> DataFrame:
    customers = read(spark, d, "customer").select("c_custkey", "c_nationkey")
    nations = R.lookup(customers, read(spark, d, "nation").where("n_nationkey < 20"), "c_nationkey", "n_nationkey", "n_name", "nation")
    return nations.select("c_custkey", "nation")


def label_array_resolve(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", (F.col("o_orderkey") % 25).cast("int").alias("n")))).alias("x")).select("o_custkey", F.transform("x", lambda v: v["n"]).alias("labels"))
    named = R.lookup_array(rows, read(spark, d, "nation").where("n_nationkey % 3 <> 0"), "o_custkey", "labels", "n_nationkey", "n_name", "names")
    return named.select("o_custkey", F.array_join("names", ",").alias("names"))


def _stored(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").where("doc_id % 10 <> 0").select("doc_id", F.sha2("text", 256).alias("hash"), (F.col("doc_id") * 10).alias("mtime"))


def _current(spark: SparkSession, d: str) -> DataFrame:
    changed = F.when(F.col("doc_id") % 13 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    return read(spark, d, "documents").where("doc_id % 7 <> 0").select("doc_id", F.sha2(changed, 256).alias("hash"), (F.col("doc_id") * 10 + F.when(F.col("doc_id") % 3 == 0, 1).otherwise(0)).alias("mtime"))


def index_diff(spark: SparkSession, d: str) -> DataFrame:
    return R.diff_status(_stored(spark, d), _current(spark, d), "doc_id", "hash")


def index_diff_mtime(spark: SparkSession, d: str) -> DataFrame:
    return R.diff_status(_stored(spark, d), _current(spark, d), "doc_id", "hash", "mtime").groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def index_prune(spark: SparkSession, d: str) -> DataFrame:
    return R.set_difference(_stored(spark, d), _current(spark, d), "doc_id").select("doc_id", "hash")


def embedding_cache(spark: SparkSession, d: str) -> DataFrame:
    """What is embedded: each wanted hash that the store lacks, once."""
    wanted = read(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("hash"))
    return R.set_difference(wanted, _stored(spark, d), "hash").groupBy("hash").agg(F.min("doc_id").alias("doc_id"))


def _log(spark: SparkSession, d: str) -> DataFrame:
    op = F.when(F.col("event_type") == "error", "delete").otherwise("upsert")
    return read(spark, d, "events").select("user_id", "event_id", op.alias("op"), "value")


def cdc_apply(spark: SparkSession, d: str) -> DataFrame:
    state = read(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.lit(-1).cast("long").alias("event_id"), F.lit("stored").alias("op"), F.col("c_acctbal").alias("value"))
    return R.apply_changes(state, _log(spark, d), ["user_id"], ["event_id"])


def label_changes(spark: SparkSession, d: str) -> DataFrame:
    rows = R.ordered(read(spark, d, "events"), ["user_id"], ["event_id"], ["event_type"])
    return rows.select("user_id", F.array_join(F.transform("items", lambda x: x["event_type"]), ",").alias("labels"))


def hwm_increment(spark: SparkSession, d: str) -> DataFrame:
    events = read(spark, d, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    marks = R.high_water(events.where("event_id % 2 = 0 AND user_id % 3 <> 0"), "user_id", "us")
    return R.since(events, marks, "user_id", "us").select("event_id")


def set_diff_resume(spark: SparkSession, d: str) -> DataFrame:
    return R.set_difference(read(spark, d, "customer").select("c_custkey"), read(spark, d, "orders").where("o_custkey % 3 <> 0").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


def tree_paths(spark: SparkSession, d: str) -> DataFrame:
    regions = read(spark, d, "region").select(F.concat(F.lit("r"), F.col("r_regionkey")).alias("id"), F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("name"))
    nations = read(spark, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey")).alias("id"), F.concat(F.lit("r"), F.col("n_regionkey")).alias("parent"), F.col("n_name").alias("name"))
    suppliers = read(spark, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey")).alias("id"), F.concat(F.lit("n"), F.col("s_nationkey")).alias("parent"), F.col("s_name").alias("name"))
    return R.tree_paths(regions.unionByName(nations).unionByName(suppliers), "id", "parent", "name")


def tree_chain(spark: SparkSession, d: str) -> DataFrame:
    """Paths in chains of a hundred nodes, each below the one before."""
    k = F.col("c_custkey")
    rows = read(spark, d, "customer").select(k.alias("id"), F.when(k % 100 != 0, k - 1).alias("parent"), F.col("c_mktsegment").alias("name"))
    return R.tree_paths(rows, "id", "parent", "name").select("id", "depth", sha256(F.col("path")).alias("path_hash"))


def slug_collisions(spark: SparkSession, d: str) -> DataFrame:
    return R.collision_suffix(read(spark, d, "customer").select("c_custkey", F.lower("c_mktsegment").alias("slug")), "slug", "c_custkey", "unique_slug").select("c_custkey", "unique_slug")


def author_fallback(spark: SparkSession, d: str) -> DataFrame:
    users = read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).otherwise("").alias("display_name"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment")).alias("real_name"))
    rows = read(spark, d, "events").select("event_id", "user_id", F.when(F.col("event_id") % 5 == 0, F.col("event_type")).alias("username"), F.when(F.col("event_id") % 7 == 0, F.col("event_id").cast("string")).alias("bot_id"))
    joined = rows.join(users, rows["user_id"] == users["id"], "left")
    return joined.select("event_id", chat.author_name(F.col("display_name"), F.col("real_name"), F.lit(None).cast("string"), F.col("username"), F.col("bot_id")).alias("author"))


def system_filter(spark: SparkSession, d: str) -> DataFrame:
    subtype = F.element_at(F.array(*(F.lit(x) for x in ("channel_join", "channel_topic", "bot_message", "thread_broadcast", "channel_leave"))), (F.col("event_id") % 5 + 1).cast("int"))
    return read(spark, d, "events").select("event_id", subtype.alias("subtype")).where(~chat.is_system(F.col("subtype")))


def noise_filter(spark: SparkSession, d: str) -> DataFrame:
    said = F.concat(F.when(F.col("conv_id") % 4 == 0, "  deploying ").when(F.col("conv_id") % 4 == 1, "Success: ").otherwise(""), F.col("text"))
    subtype = F.when(F.col("turn") == 2, "message_deleted").when(F.col("turn") == 4, "bot_message")
    rows = read(spark, d, "conversations").select("conv_id", "turn", said.alias("text"), subtype.alias("subtype"), (F.col("role") == "assistant").alias("is_bot"))
    return rows.where(~chat.should_skip(F.col("subtype"), F.col("text"), F.lit(False), F.col("is_bot"))).select("conv_id", "turn")


def mention_resolve(spark: SparkSession, d: str) -> DataFrame:
    """Users, channels, links and groups of chat text resolved by look-up."""
    users = read(spark, d, "customer").select(F.concat(F.lit("U"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_name").alias("name"))
    said = F.concat(F.lit("hi <@U"), F.col("user_id").cast("string"), F.lit("> and <@U"), F.col("event_id").cast("string"), F.lit("|bob>, see <#C1|general> <https://a.example/x|site> <https://b.example> <mailto:a@b.c|a@b.c> <!here> <!subteam^S1|ops>"))
    rows = read(spark, d, "events").select((F.col("event_id") % 100).alias("event_id"), said.alias("text"))
    return chat.resolve_mentions(rows, "text", users, "id", ["name"]).select("event_id", F.col("text").alias("resolved"))


def markdown_from_chat(spark: SparkSession, d: str) -> DataFrame:
    said = F.concat(F.lit("*"), F.col("event_type"), F.lit("* and ~gone~ "), F.col("event_id").cast("string"), F.lit("*2*3"))
    return read(spark, d, "events").select("event_id", chat.to_markdown(said).alias("markdown"))


def index_stats(spark: SparkSession, d: str) -> DataFrame:
    files = read(spark, d, "documents").agg(F.count(F.lit(1)).alias("total_files"), F.count_distinct("source").alias("sources"))
    return files.crossJoin(F.broadcast(read(spark, d, "embeddings").agg(F.count(F.lit(1)).alias("total_chunks"))))


def sum_in_window(spark: SparkSession, d: str) -> DataFrame:
    """Units used in the minute up to each event, as the quota limiter counts them."""
    from pyspark.sql import Window

    us = F.unix_micros(F.col("ts").cast("timestamp"))
    window = Window.partitionBy("user_id").orderBy("us").rangeBetween(-3_600_000_000, 0)
    return read(spark, d, "events").select("event_id", "user_id", us.alias("us")).select("event_id", F.count(F.lit(1)).over(window).alias("used"))


QUERIES = {f.__name__: f for f in (thread_rollup, participants, first_last, day_groups, numbered_runs, lookup_enrich, lookup_chain, label_array_resolve, index_diff, index_diff_mtime, index_prune, embedding_cache, cdc_apply, label_changes, hwm_increment, set_diff_resume, tree_paths, tree_chain, slug_collisions, author_fallback, system_filter, noise_filter, mention_resolve, markdown_from_chat, index_stats, sum_in_window)}

_STORED = "(SELECT doc_id, sha256(text) AS hash, doc_id * 10 AS mtime FROM documents WHERE doc_id % 10 <> 0)"
_CURRENT = "(SELECT doc_id, sha256(CASE WHEN doc_id % 13 = 0 THEN text || '!' ELSE text END) AS hash, doc_id * 10 + CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS mtime FROM documents WHERE doc_id % 7 <> 0)"

SQL = {
    "thread_rollup": """
        WITH firsts AS (SELECT conv_id, role, min(turn) AS t FROM conversations GROUP BY ALL), names AS (SELECT conv_id, string_agg(role, ',' ORDER BY t) AS participants FROM firsts GROUP BY conv_id)
        SELECT c.conv_id, count(*) AS message_count, any_value(participants) AS participants, sha256(string_agg('**From:** ' || role || chr(10) || chr(10) || text, chr(10) || '---' || chr(10) ORDER BY turn)) AS body_hash
        FROM conversations c JOIN names USING (conv_id) GROUP BY c.conv_id""",
    "participants": "WITH f AS (SELECT user_id, event_type, min(event_id) AS e FROM events GROUP BY ALL) SELECT user_id, string_agg(event_type, ',' ORDER BY e) AS participants FROM f GROUP BY user_id",
    "first_last": "SELECT user_id, count(*) AS message_count, min(epoch_us(ts)) AS first_ts, max(epoch_us(ts)) AS last_ts FROM events GROUP BY user_id",
    "day_groups": "SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, coalesce(lag(ts::DATE) OVER (PARTITION BY user_id ORDER BY ts, event_id) <> ts::DATE, true) AS is_break FROM events",
    "numbered_runs": """
        WITH b AS (SELECT event_id, user_id, event_type, coalesce(lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) <> event_type, true) AS brk FROM events),
        r AS (SELECT *, sum(brk::INT) OVER (PARTITION BY user_id ORDER BY event_id)::BIGINT AS run FROM b)
        SELECT event_id, run, row_number() OVER (PARTITION BY user_id, run ORDER BY event_id) AS number FROM r""",
    "lookup_enrich": "SELECT o_orderkey, coalesce(c_name, o_custkey::VARCHAR) AS customer_name FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 5 <> 0) ON c_custkey = o_custkey",
    "lookup_chain": "SELECT c_custkey, coalesce(n_name, c_nationkey::VARCHAR) AS nation FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 20) ON n_nationkey = c_nationkey",
    "label_array_resolve": "SELECT o_custkey, coalesce(string_agg(n_name, ',' ORDER BY o_orderkey), '') AS names FROM orders LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 3 <> 0) ON n_nationkey = o_orderkey % 25 GROUP BY o_custkey",
    "index_diff": f"SELECT coalesce(s.doc_id, c.doc_id) AS doc_id, CASE WHEN s.doc_id IS NULL THEN 'new' WHEN c.doc_id IS NULL THEN 'pruned' WHEN s.hash = c.hash THEN 'unchanged' ELSE 'changed' END AS status FROM {_STORED} s FULL JOIN {_CURRENT} c ON s.doc_id = c.doc_id",
    "index_diff_mtime": f"""
        SELECT CASE WHEN s.doc_id IS NULL THEN 'new' WHEN c.doc_id IS NULL THEN 'pruned' WHEN s.mtime = c.mtime THEN 'unchanged' WHEN s.hash = c.hash THEN 'touched' ELSE 'changed' END AS status, count(*) AS n
        FROM {_STORED} s FULL JOIN {_CURRENT} c ON s.doc_id = c.doc_id GROUP BY 1""",
    "index_prune": f"SELECT doc_id, hash FROM {_STORED} s WHERE NOT EXISTS (SELECT 1 FROM {_CURRENT} c WHERE c.doc_id = s.doc_id)",
    "embedding_cache": f"SELECT hash, min(doc_id) AS doc_id FROM (SELECT doc_id, sha256(text) AS hash FROM documents) WHERE hash NOT IN (SELECT hash FROM {_STORED}) GROUP BY hash",
    "cdc_apply": """
        WITH log AS (SELECT user_id, event_id, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'upsert' END AS op, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events)
        SELECT user_id, event_id, op, value FROM log WHERE r = 1 AND op <> 'delete'
        UNION ALL SELECT c_custkey, -1, 'stored', c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)""",
    "label_changes": "SELECT user_id, string_agg(event_type, ',' ORDER BY event_id) AS labels FROM events GROUP BY user_id",
    "hwm_increment": "WITH m AS (SELECT user_id, max(ts) AS hw FROM events WHERE event_id % 2 = 0 AND user_id % 3 <> 0 GROUP BY user_id) SELECT event_id FROM events LEFT JOIN m USING (user_id) WHERE hw IS NULL OR ts > hw",
    "set_diff_resume": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey % 3 <> 0)",
    "tree_paths": """
        SELECT 'r' || r_regionkey AS id, 0::BIGINT AS depth, r_name AS path FROM region
        UNION ALL SELECT 'n' || n_nationkey, 1, r_name || '/' || n_name FROM nation JOIN region ON r_regionkey = n_regionkey
        UNION ALL SELECT 's' || s_suppkey, 2, r_name || '/' || n_name || '/' || s_name FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey""",
    "tree_chain": """
        WITH RECURSIVE t AS (
            SELECT c_custkey AS k, 0::BIGINT AS depth, c_mktsegment AS path FROM customer WHERE c_custkey % 100 = 0 OR c_custkey - 1 NOT IN (SELECT c_custkey FROM customer)
            UNION ALL SELECT c_custkey, depth + 1, path || '/' || c_mktsegment FROM t JOIN customer ON c_custkey = k + 1 AND c_custkey % 100 <> 0
        )
        SELECT k::VARCHAR AS id, depth, sha256(path) AS path_hash FROM t""",
    "slug_collisions": "SELECT c_custkey, lower(c_mktsegment) || CASE WHEN row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) = 1 THEN '' ELSE '--' || c_custkey END AS unique_slug FROM customer",
    "author_fallback": """
        SELECT event_id, CASE WHEN c_custkey % 2 = 0 THEN c_name WHEN c_custkey % 3 = 0 THEN c_mktsegment WHEN event_id % 5 = 0 THEN event_type WHEN event_id % 7 = 0 THEN 'bot:' || event_id ELSE 'unknown' END AS author
        FROM events LEFT JOIN customer ON c_custkey = user_id""",
    "system_filter": "SELECT event_id, CASE event_id % 5 WHEN 2 THEN 'bot_message' ELSE 'thread_broadcast' END AS subtype FROM events WHERE event_id % 5 IN (2, 3)",
    "noise_filter": """
        SELECT conv_id, turn FROM (SELECT *, CASE conv_id % 4 WHEN 0 THEN '  deploying ' WHEN 1 THEN 'Success: ' ELSE '' END || text AS t FROM conversations)
        WHERE turn <> 2 AND NOT (role = 'assistant' AND regexp_matches(t, '(?i)^\\s*(DEPLOYING|BUILDING|DEPLOYED|SUCCESS|FAILED|ROLLING BACK)\\b'))""",
    "mention_resolve": """
        SELECT event_id % 100 AS event_id, 'hi @' || coalesce(u.c_name, 'U' || user_id) || ' and @bob, see #general [site](https://a.example/x) https://b.example a@b.c @here @ops' AS resolved
        FROM events LEFT JOIN customer u ON u.c_custkey = user_id""",
    "markdown_from_chat": "SELECT event_id, '**' || event_type || '** and ~~gone~~ ' || event_id || '**2**3' AS markdown FROM events",
    "index_stats": "SELECT count(*) AS total_files, count(DISTINCT source) AS sources, (SELECT count(*) FROM embeddings) AS total_chunks FROM documents",
    "sum_in_window": "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW) AS used FROM events",
}
