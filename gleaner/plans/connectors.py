"""Registered queries on connector records: chat exports, issues, projects; raw records are made from the test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import chat, issues
from gleaner.functions.text import sha256
from gleaner.operators import channels as C
from gleaner.runtime import read
from gleaner.sources import dumps

NOW = "2024-03-01T00:00:00.000Z"


def _s(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def _users(spark: SparkSession, d: str) -> DataFrame:
    """Chat users: every third without a display name, every fifth unknown."""
    raw = read(spark, d, "customer").where("c_custkey % 5 <> 0").select(
        F.concat(F.lit("U"), _s("c_custkey")).alias("id"), F.concat(F.lit("n"), _s("c_custkey")).alias("name"), F.lit(None).cast("string").alias("real_name"), F.lit(False).alias("deleted"), (F.col("c_custkey") % 7 == 0).alias("is_bot"),
        F.struct(F.when(F.col("c_custkey") % 3 != 0, F.concat(F.lit("Ann "), _s("c_custkey"))).alias("display_name"), F.lit(None).cast("string").alias("real_name"), F.lit("a@b.c").alias("email"), F.lit("i").alias("image_72")).alias("profile"),
    )
    return dumps.chat_users(raw)


def _channels(spark: SparkSession, d: str) -> DataFrame:
    raw = read(spark, d, "nation").select(
        F.concat(F.lit("C"), _s("n_nationkey")).alias("id"),
        F.when(F.col("n_nationkey") % 5 == 1, F.concat(F.lit("U"), _s(F.col("n_nationkey") % 3 + 1))).when(F.col("n_nationkey") % 5 == 2, F.lit("mpdm-zed--Ann_b--carl-1")).when(F.col("n_nationkey") % 5 == 3, F.lit("Same Név")).otherwise(F.col("n_name")).alias("name"),
        (F.col("n_nationkey") % 5 == 1).alias("is_im"), (F.col("n_nationkey") % 5 == 2).alias("is_mpim"), (F.col("n_nationkey") % 5 == 3).alias("is_private"), F.lit(None).cast("boolean").alias("is_group"), F.lit(False).alias("is_archived"),
        F.col("n_nationkey").alias("num_members"), F.lit(0).cast("long").alias("created"), F.lit(None).cast("string").alias("user"), F.struct(F.lit("t").alias("value")).alias("topic"), F.lit(None).cast("struct<value: string>").alias("purpose"),
    )
    return dumps.chat_channels(raw)


def _messages(spark: SparkSession, d: str) -> DataFrame:
    """Messages from turns: a channel for each conversation modulo 20, noise, uploads, deleted ones, reactions, mentions."""
    k, t = F.col("conv_id"), F.col("turn")
    said = F.when(k % 6 == 0, F.concat(F.lit("  deploying "), _s(k))).when(k % 6 == 1, F.lit(" ")).otherwise(F.concat(F.lit("*hi* <@U"), _s(k % 9), F.lit("> "), _s(k), F.lit("\nsecond <#C4> ~line~")))
    raw = read(spark, d, "conversations").select(
        F.concat(_s(F.lit(1_700_000_000) + k * 40_000 + t), F.lit(".000000")).alias("ts"), F.concat(F.lit("C"), _s(k % 20)).alias("channel"), F.concat(F.lit("U"), _s((k + t) % 11)).alias("user"), said.alias("text"), F.lit(None).cast("string").alias("blocks"),
        F.when((k % 4 == 2), F.concat(_s(F.lit(1_700_000_000) + k * 40_000), F.lit(".000000"))).alias("thread_ts"), F.lit(0).alias("reply_count"), F.when(t == 3, "message_deleted").when(t == 5, "channel_join").alias("subtype"),
        F.when(k % 6 == 0, "B1").alias("bot_id"), F.lit(None).cast("string").alias("username"), F.lit(None).cast("struct<name: string>").alias("bot_profile"), F.lit(None).cast("struct<user: string, ts: string>").alias("edited"),
        F.when(t == 1, F.array(F.struct(F.lit("wave").alias("name"), F.lit(2).alias("count"), F.array(F.lit("U1")).alias("users")))).alias("reactions"),
        F.when(k % 6 == 1, F.array(F.struct(F.lit("F").alias("id"), F.lit("a.png").alias("name"), F.lit("image/png").alias("mimetype"), F.lit(2048).cast("long").alias("size"), F.lit("u").alias("url_private_download"), F.lit("p").alias("permalink"), F.lit(0).cast("long").alias("created")))).alias("files"),
    )
    return dumps.chat_messages(raw)


def _prepared(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Messages of channels and of threads, as they are shown."""
    shown = C.prepared(_messages(spark, d), _users(spark, d), _channels(spark, d))
    return shown.where("threadTs IS NULL OR threadTs = ts"), shown.where("threadTs IS NOT NULL")


def channel_pages(spark: SparkSession, d: str) -> DataFrame:
    messages, replies = _prepared(spark, d)
    return C.pages(_channels(spark, d), messages, replies).select("id", sha256(F.col("content")).alias("content_hash"))


def channel_records(spark: SparkSession, d: str) -> DataFrame:
    messages, _ = _prepared(spark, d)
    return C.records(messages).select(F.col("channelId").alias("id"), "ts", sha256(F.col("value")).alias("value_hash"))


def channel_meta(spark: SparkSession, d: str) -> DataFrame:
    found = C.summaries(_channels(spark, d), _messages(spark, d), NOW)
    return found.select("channelId", "channelName", "type", F.col("memberCount").cast("long").alias("memberCount"), "messageCount", "oldestMessage", "newestMessage")


def thread_documents(spark: SparkSession, d: str) -> DataFrame:
    _, replies = _prepared(spark, d)
    found = C.thread_documents(_channels(spark, d), replies, _users(spark, d), NOW)
    return found.select("thread_ts", "channel_id", "started_by", F.array_join("participants", ",").alias("participants"), "reply_count", "started_at", sha256(F.col("body")).alias("body_hash"))


def channel_slugs(spark: SparkSession, d: str) -> DataFrame:
    return C.slugs(_channels(spark, d), _users(spark, d))


def channel_index(spark: SparkSession, d: str) -> DataFrame:
    own = _channels(spark, d)
    return C.channels_index(own, C.slugs(own, _users(spark, d)).where("id <> 'C0'")).select("id", "name", "type", "slug", "topic", "purpose", F.col("memberCount").cast("long").alias("memberCount"), "isArchived")


def user_index(spark: SparkSession, d: str) -> DataFrame:
    return C.users_index(_users(spark, d))


def thread_parents(spark: SparkSession, d: str) -> DataFrame:
    counted = _messages(spark, d).select("ts", "threadTs", F.when(F.substring("ts", 10, 1) > "3", 1).alias("n"))
    return counted.where(chat.is_thread_parent(F.col("ts"), F.col("threadTs"), F.col("n"))).select("ts")


def _issue_users(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "customer").where("c_custkey % 4 <> 0").select(F.concat(F.lit("u"), _s("c_custkey")).alias("id"), F.col("c_name").alias("displayName"))


def _teams(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "nation").select(F.concat(F.lit("t"), _s("n_nationkey")).alias("id"), F.concat(F.lit("K"), _s("n_nationkey")).alias("key"), F.col("n_name").alias("name"))


def _projects(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("r_regionkey")
    return read(spark, d, "region").select(
        F.concat(F.lit("p"), _s(k)).alias("id"), F.concat(F.lit("The  "), "r_name").alias("name"), F.when(k % 2 == 0, F.concat(F.lit("slug-"), _s(k))).otherwise("").alias("slug"), F.lit("started").alias("state"), F.when(k > 1, "About it").alias("description"),
        F.concat(F.lit("u"), _s(k)).alias("leadId"), F.array(F.concat(F.lit("t"), _s(k)), F.lit("none"), F.lit("t7")).alias("teamIds"), F.when(k == 1, "2024-01-01").otherwise("").alias("startDate"), F.lit(None).cast("string").alias("targetDate"),
    )


def _issues(spark: SparkSession, d: str, since: str | None = None) -> DataFrame:
    """Issues from orders, by way of the JSON that the tracker's API gives."""
    k = F.col("o_orderkey")
    ref = lambda p, c: F.struct(F.concat(F.lit(p), _s(c)).alias("id"))
    issue = lambda c: F.struct(F.lit("i").alias("id"), F.concat(F.lit("I-"), _s(c)).alias("identifier"))
    node = F.struct(
        F.concat(F.lit("o"), _s(k)).alias("id"), F.concat(F.lit("I-"), _s(k)).alias("identifier"), F.concat(F.lit("Order of "), _s("o_custkey")).alias("title"), F.when(k % 2 == 0, F.lit("It says.")).alias("description"), (k % 6).cast("int").alias("priority"), F.when(k % 9 == 0, 2.5).alias("estimate"),
        F.lit("").alias("dueDate"), F.lit("2024-01-01").alias("createdAt"), F.concat(F.lit("2024-02-"), F.lpad(_s(k % 28 + 1), 2, "0")).alias("updatedAt"), F.when(k % 10 == 0, "2024-02-29").alias("archivedAt"), F.lit(None).cast("string").alias("completedAt"), F.lit(None).cast("string").alias("canceledAt"),
        F.struct(F.lit("s").alias("id"), F.lit("Todo").alias("name"), F.lit("unstarted").alias("type")).alias("state"), ref("t", k % 30).alias("team"), ref("u", "o_custkey").alias("assignee"), F.when(k % 3 == 0, ref("u", k % 50)).alias("creator"), ref("p", k % 7).alias("project"), ref("c", k % 6).alias("cycle"),
        F.when(k % 4 == 0, F.struct(F.lit("x").alias("id"), F.lit("I-1").alias("identifier"))).alias("parent"), F.struct(F.array(ref("t", k % 25), ref("zz", k), ref("t", k % 7)).alias("nodes")).alias("labels"),
        F.struct(F.when(k % 3 == 0, F.array(F.struct(F.lit("c").alias("id"), F.lit("Yes.").alias("body"), F.lit("d1").alias("createdAt"), F.lit("d").alias("updatedAt"), ref("u", "o_custkey").alias("user")), F.struct(F.lit("e").alias("id"), F.lit("No.").alias("body"), F.lit("d2").alias("createdAt"), F.lit("d").alias("updatedAt"), F.lit(None).cast("struct<id: string>").alias("user")))).otherwise(F.array()).alias("nodes")).alias("comments"),
        F.struct(F.when(k % 5 == 0, F.array(F.struct(F.lit("a").alias("id"), F.lit("T").alias("title"), F.concat(F.lit("https://x.y/f%20"), _s(k), F.lit(".png?z=1")).alias("url"), F.lit(None).cast("string").alias("sourceType"), F.lit("d").alias("createdAt")))).otherwise(F.array()).alias("nodes")).alias("attachments"),
        F.struct(F.when(k % 2 == 0, F.array(F.struct(F.lit("blocks").alias("type"), issue(k + 1).alias("relatedIssue")))).otherwise(F.array()).alias("nodes")).alias("relations"),
        F.struct(F.when(k % 3 == 0, F.array(F.struct(F.when(k % 2 == 0, "duplicate").otherwise("odd").alias("type"), issue(k + 2).alias("issue")))).otherwise(F.array()).alias("nodes")).alias("inverseRelations"),
    )
    raw = read(spark, d, "orders").select(F.to_json(node).alias("line")).select(F.from_json("line", issues.ISSUE_NODE.replace(": ", ":")).alias("x")).select("x.*")
    return issues.typed_issues(raw, since)


def issue_documents(spark: SparkSession, d: str) -> DataFrame:
    cycles = read(spark, d, "region").select(F.concat(F.lit("c"), _s("r_regionkey")).alias("id"), F.when(F.col("r_regionkey") % 2 == 0, F.col("r_name")).otherwise("").alias("name"), F.col("r_regionkey").alias("number"))
    found = issues.documents(_issues(spark, d), _issue_users(spark, d), _teams(spark, d), _projects(spark, d), cycles, _teams(spark, d))
    field = lambda k: F.get_json_object("frontmatter", f"$.{k}").alias(k)
    return found.select("path", *(field(k) for k in ("assignee", "creator", "team", "project", "cycle", "labels", "priority", "priorityLabel", "parent", "estimate", "dueDate", "archived", "archivedAt", "relations", "attachments")), sha256(F.col("body")).alias("body_hash"))


def issue_relations(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("issue_id"), F.col("l_partkey").alias("related_id"), F.when(F.col("l_returnflag") == "A", "blocks").when(F.col("l_returnflag") == "N", "duplicate-of").otherwise("custom").alias("type"))
    return issues.relations(rows).groupBy("kind", "direction").agg(F.count(F.lit(1)).alias("n"), F.sum("source").alias("sources"))


def issue_increment(spark: SparkSession, d: str) -> DataFrame:
    return _issues(spark, d, "2024-02-20").select("identifier", "updatedAt", F.size("relations").cast("long").alias("n_relations"))


def issue_attachments(spark: SparkSession, d: str) -> DataFrame:
    rows = _issues(spark, d).select("identifier", F.explode("attachments").alias("a")).where(issues.is_downloadable(F.col("a.sourceType")))
    return rows.select("identifier", issues.attachment_path(F.col("identifier"), F.col("a.url"), F.col("a.title")).alias("path"))


def project_documents(spark: SparkSession, d: str) -> DataFrame:
    found = issues.project_documents(_projects(spark, d), _issue_users(spark, d), _teams(spark, d))
    return found.select("path", F.get_json_object("frontmatter", "$.lead").alias("lead"), F.get_json_object("frontmatter", "$.teams").alias("teams"), F.get_json_object("frontmatter", "$.startDate").alias("startDate"), "body")


QUERIES = {f.__name__: f for f in (channel_pages, channel_records, channel_meta, thread_documents, channel_slugs, channel_index, user_index, thread_parents, issue_documents, issue_relations, issue_increment, issue_attachments, project_documents)}

_TS = "({} || '.000000')"
_MSG = """
    names AS (SELECT c_custkey AS u, CASE WHEN c_custkey % 3 <> 0 THEN 'Ann ' || c_custkey ELSE 'n' || c_custkey END AS name FROM customer WHERE c_custkey % 5 <> 0),
    country AS (SELECT 'C' || n_nationkey AS id, n_nationkey AS k, CASE n_nationkey % 5 WHEN 1 THEN 'U' || (n_nationkey % 3 + 1) WHEN 2 THEN 'mpdm-zed--Ann_b--carl-1' WHEN 3 THEN 'Same Név' ELSE n_name END AS name FROM nation),
    turns AS (
        SELECT conv_id AS k, turn AS t, (1700000000 + conv_id * 40000 + turn)::BIGINT AS sec, 'C' || (conv_id % 20) AS channel, (conv_id + turn) % 11 AS u,
            CASE WHEN conv_id % 4 = 2 THEN (1700000000 + conv_id * 40000)::BIGINT END AS top, CASE turn WHEN 3 THEN 'message_deleted' WHEN 5 THEN 'channel_join' END AS subtype
        FROM conversations
    ),
    shown AS (
        SELECT turns.*, coalesce(a.name, CASE WHEN turns.k % 6 = 0 THEN 'bot:B1' ELSE 'unknown' END) AS author, strftime(make_timestamp(sec * 1000000), '%I:%M %p') AS clock, strftime(make_timestamp(sec * 1000000), '%Y-%m-%d') AS day,
            strftime(make_timestamp(sec * 1000000), '%Y-%m-%dT%H:%M:%S.000Z') AS iso,
            CASE WHEN turns.k % 6 = 0 THEN '  deploying ' || turns.k WHEN turns.k % 6 = 1 THEN ' '
            ELSE '**hi** @' || coalesce(m.name, 'U' || (turns.k % 9)) || ' ' || turns.k || chr(10) || 'second #' || (SELECT name FROM country WHERE id = 'C4') || ' ~~line~~' END AS said
        FROM turns LEFT JOIN names a ON a.u = turns.u LEFT JOIN names m ON m.u = turns.k % 9
    )"""
_SLUG = """
    plain AS (
        SELECT id, k, name, CASE k % 5 WHEN 1 THEN 'dm--n' || (k % 3 + 1) WHEN 2 THEN 'mpim--ann-b--carl--zed' WHEN 3 THEN 'same-nev' ELSE regexp_replace(lower(name), '[ _]+', '-', 'g') END AS own FROM country
    ),
    slugged AS (SELECT id, k, name, own || CASE WHEN row_number() OVER (PARTITION BY own ORDER BY id) = 1 THEN '' ELSE '--' || id END AS slug FROM plain)"""
_KIND = "CASE k % 5 WHEN 1 THEN 'im' WHEN 2 THEN 'mpim' WHEN 3 THEN 'private' ELSE 'public' END"
_REACT = "CASE WHEN t = 1 THEN chr(10) || '[:wave: (2)]' ELSE '' END"
_SKIP = "subtype IS NOT NULL OR k % 6 IN (0, 1)"

SQL = {
    "channel_pages": f"""
        WITH {_MSG},
        quoted AS (
            SELECT channel, top, chr(10) || coalesce(string_agg(CASE WHEN sec <> top THEN chr(10) || '> **' || author || '** (' || clock || ') [thread]:' || chr(10) || '> ' || replace(said, chr(10), chr(10) || '> ') ELSE '' END, '' ORDER BY sec), '') AS q
            FROM shown WHERE top IS NOT NULL GROUP BY channel, top
        ),
        kept AS (SELECT s.*, coalesce(q, '') AS q, lag(day) OVER (PARTITION BY s.channel ORDER BY sec) AS before FROM shown s LEFT JOIN quoted ON quoted.channel = s.channel AND quoted.top = s.sec WHERE (s.top IS NULL OR s.top = s.sec) AND NOT ({_SKIP})),
        lines AS (
            SELECT channel, sec, CASE WHEN before IS NULL THEN '## ' || day || chr(10) || chr(10) WHEN before <> day THEN chr(10) || '## ' || day || chr(10) || chr(10) ELSE '' END
                || '**' || author || '** (' || clock || '):' || chr(10) || said || {_REACT} || q || chr(10) AS line FROM kept
        ),
        pages_ AS (SELECT channel, string_agg(line, chr(10) ORDER BY sec) AS page FROM lines GROUP BY channel)
        SELECT id, sha256(coalesce(page, CASE WHEN id IN (SELECT channel FROM turns WHERE top IS NULL OR top = sec) THEN '' ELSE '_No messages._' || chr(10) END)) AS content_hash FROM country LEFT JOIN pages_ ON channel = id""",
    "channel_records": f"""
        WITH {_MSG}
        SELECT channel AS id, sec || '.000000' AS ts, sha256('{{"ts":"' || sec || '.000000","user":"U' || u || '","userName":"' || author || '","text":"' || replace(said, chr(10), '\\n') || '","threadTs":' || coalesce('"' || top || '.000000"', 'null')
            || ',"reactions":' || CASE WHEN t = 1 THEN '[{{"name":"wave","count":2,"users":["U1"]}}]' ELSE '[]' END || ',"files":' || CASE WHEN k % 6 = 1 THEN '[{{"id":"F","name":"a.png","mimetype":"image/png","size":2048}}]' ELSE '[]' END || ',"edited":null,"date":"' || iso || '"}}') AS value_hash
        FROM shown WHERE (top IS NULL OR top = sec) AND coalesce(subtype, '') <> 'message_deleted'""",
    "channel_meta": f"""
        WITH {_MSG},
        counted AS (SELECT channel, count(*) AS n, min(iso) AS a, max(iso) AS z FROM shown WHERE coalesce(subtype, '') <> 'message_deleted' GROUP BY channel)
        SELECT id AS "channelId", name AS "channelName", {_KIND} AS type, k::BIGINT AS "memberCount", coalesce(n, 0) AS "messageCount", a AS "oldestMessage", z AS "newestMessage" FROM country LEFT JOIN counted ON channel = id""",
    "thread_documents": f"""
        WITH {_MSG},
        firsts AS (SELECT channel, top, u, min(sec) AS f FROM shown WHERE top IS NOT NULL GROUP BY ALL),
        who AS (SELECT channel, top, string_agg(coalesce(name, 'U' || firsts.u), ',' ORDER BY f) AS participants FROM firsts LEFT JOIN names ON names.u = firsts.u GROUP BY channel, top),
        bodies AS (
            SELECT channel, top, count(*) AS n, arg_min(author, sec) AS author, arg_min(said, sec) AS said,
                string_agg(CASE WHEN sec <> top THEN chr(10) || '**' || author || '** (' || day || ' ' || clock || '):' || chr(10) || said || {_REACT} || chr(10) ELSE '' END, '' ORDER BY sec) AS rest
            FROM shown WHERE top IS NOT NULL GROUP BY channel, top
        )
        SELECT b.top || '.000000' AS thread_ts, b.channel AS channel_id, author AS started_by, participants, n - 1 AS reply_count, strftime(make_timestamp(b.top * 1000000), '%Y-%m-%dT%H:%M:%S.000Z') AS started_at,
            sha256('# Thread in #' || name || chr(10) || chr(10) || '**' || author || '** started this thread:' || chr(10) || chr(10) || said || chr(10) || chr(10) || '---' || chr(10) || rest) AS body_hash
        FROM bodies b JOIN who USING (channel, top) JOIN country ON id = b.channel""",
    "channel_slugs": f"WITH {_MSG}, {_SLUG} SELECT id, slug FROM slugged",
    "channel_index": f"""WITH {_MSG}, {_SLUG} SELECT id, name, {_KIND} AS type, CASE WHEN id = 'C0' THEN name ELSE slug END AS slug, 't' AS topic, '' AS purpose, k::BIGINT AS "memberCount", false AS "isArchived" FROM slugged""",
    "user_index": """
        SELECT 'U' || c_custkey AS id, 'n' || c_custkey AS name, 'n' || c_custkey AS "realName", CASE WHEN c_custkey % 3 <> 0 THEN 'Ann ' || c_custkey ELSE 'n' || c_custkey END AS "displayName", 'a@b.c' AS email, c_custkey % 7 = 0 AS "isBot", false AS "isDeleted"
        FROM customer WHERE c_custkey % 5 <> 0""",
    "thread_parents": f"WITH {_MSG} SELECT sec || '.000000' AS ts FROM turns WHERE sec % 10 > 3 AND (top IS NULL OR top = sec)",
    "issue_documents": """
        WITH u AS (SELECT c_custkey AS k, c_name AS name FROM customer WHERE c_custkey % 4 <> 0),
        o AS (SELECT o_orderkey AS k, o_custkey AS c FROM orders),
        rel AS (SELECT k, list_filter([CASE WHEN k % 2 = 0 THEN '{"type":"blocks","issue":"I-' || (k + 1) || '"}' END, CASE WHEN k % 3 = 0 THEN '{"type":"' || CASE WHEN k % 2 = 0 THEN 'duplicate-of' ELSE 'odd' END || '","issue":"I-' || (k + 2) || '"}' END], lambda x: x IS NOT NULL) AS r FROM o)
        SELECT 'issues/' || CASE WHEN o.k % 30 < 25 THEN 'K' || (o.k % 30) ELSE '' END || '/I-' || o.k || '.md' AS path, a.name AS assignee, CASE WHEN o.k % 3 = 0 THEN b.name END AS creator, t.n_name AS team,
            'The  ' || p.r_name AS project, CASE WHEN y.r_regionkey % 2 = 0 THEN y.r_name ELSE 'Cycle ' || y.r_regionkey END AS cycle, '["' || l.n_name || '","' || m.n_name || '"]' AS labels, (o.k % 6)::VARCHAR AS priority,
            ['None', 'Urgent', 'High', 'Medium', 'Low', 'None'][o.k % 6 + 1] AS "priorityLabel", CASE WHEN o.k % 4 = 0 THEN 'I-1' END AS parent, CASE WHEN o.k % 9 = 0 THEN '2.5' END AS estimate, NULL::VARCHAR AS "dueDate",
            CASE WHEN o.k % 10 = 0 THEN 'true' ELSE 'false' END AS archived, CASE WHEN o.k % 10 = 0 THEN '2024-02-29' END AS "archivedAt", CASE WHEN len(r) > 0 THEN '[' || array_to_string(r, ',') || ']' END AS relations,
            CASE WHEN o.k % 5 = 0 THEN '[{"title":"T","url":"https://x.y/f%20' || o.k || '.png?z=1"}]' END AS attachments,
            sha256('# I-' || o.k || ': Order of ' || o.c || chr(10) || CASE WHEN o.k % 2 = 0 THEN chr(10) || 'It says.' ELSE '' END || CASE WHEN o.k % 3 = 0 THEN chr(10) || chr(10) || '---' || chr(10) || chr(10) || '## Comments' || chr(10) || chr(10)
                || '### ' || coalesce(a.name, 'Unknown') || ' --- d1' || chr(10) || chr(10) || 'Yes.' || chr(10) || chr(10) || '### Unknown --- d2' || chr(10) || chr(10) || 'No.' ELSE '' END) AS body_hash
        FROM o JOIN rel ON rel.k = o.k LEFT JOIN u a ON a.k = o.c LEFT JOIN u b ON b.k = o.k % 50 LEFT JOIN nation t ON t.n_nationkey = o.k % 30 LEFT JOIN region p ON p.r_regionkey = o.k % 7 LEFT JOIN region y ON y.r_regionkey = o.k % 6
        JOIN nation l ON l.n_nationkey = o.k % 25 JOIN nation m ON m.n_nationkey = o.k % 7""",
    "issue_relations": """
        WITH r AS (SELECT l_orderkey AS a, l_partkey AS b, CASE l_returnflag WHEN 'A' THEN 'blocks' WHEN 'N' THEN 'duplicate-of' ELSE 'custom' END AS kind FROM lineitem)
        SELECT kind, direction, count(*) AS n, sum(source)::BIGINT AS sources FROM (
            SELECT a AS source, kind, 0 AS direction FROM r UNION ALL SELECT b, CASE kind WHEN 'blocks' THEN 'blocked-by' WHEN 'duplicate-of' THEN 'duplicate' ELSE kind END, 1 FROM r) GROUP BY kind, direction""",
    "issue_increment": """
        SELECT 'I-' || o_orderkey AS identifier, '2024-02-' || lpad((o_orderkey % 28 + 1)::VARCHAR, 2, '0') AS "updatedAt", (CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END)::BIGINT AS n_relations
        FROM orders WHERE o_orderkey % 28 + 1 > 20""",
    "issue_attachments": "SELECT 'I-' || o_orderkey AS identifier, 'attachments/I-' || o_orderkey || '/f_' || o_orderkey || '.png' AS path FROM orders WHERE o_orderkey % 5 = 0",
    "project_documents": """
        SELECT 'projects/' || CASE WHEN r_regionkey % 2 = 0 THEN 'slug-' || r_regionkey ELSE 'the-' || regexp_replace(lower(r_name), ' +', '-', 'g') END || '.md' AS path, CASE WHEN r_regionkey > 0 AND r_regionkey % 4 <> 0 THEN c_name END AS lead,
            '["' || a.n_name || '","' || b.n_name || '"]' AS teams, CASE WHEN r_regionkey = 1 THEN '2024-01-01' END AS "startDate", '# The  ' || r_name || chr(10) || chr(10) || CASE WHEN r_regionkey > 1 THEN 'About it' ELSE '' END AS body
        FROM region LEFT JOIN customer ON c_custkey = r_regionkey JOIN nation a ON a.n_nationkey = r_regionkey JOIN nation b ON b.n_nationkey = 7""",
}
