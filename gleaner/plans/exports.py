"""Registered queries on mail, pages and files: raw records are made from the test tables, in the form that dumps have."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import blocks, chat, errors, issues, markup, mime, pages, scoring
from gleaner.functions import text as T
from gleaner.functions.embedding import embed_images
from gleaner.functions.frontmatter import yaml_to_json
from gleaner.operators import mail
from gleaner.operators import rollups as R
from gleaner.runtime import read, scratch_path, spread
from gleaner.sources import files, publish, sinks


def _s(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def _raw_mail(spark: SparkSession, d: str) -> DataFrame:
    """Raw messages from turns: plain and HTML parts in base64url, an attachment for some, drafts among them."""
    k, t = F.col("conv_id"), F.col("turn")
    coded = lambda c: F.translate(F.base64(F.encode(c, "UTF-8")), "+/\r\n", "-_")
    part = lambda kind, said: F.struct(F.lit(kind).alias("mimeType"), F.lit("").alias("filename"), F.array(F.struct(F.lit("Content-Type").alias("name"), F.lit(f"{kind}; charset=UTF-8").alias("value"))).alias("headers"), F.struct(F.lit(1).alias("size"), said.alias("data"), F.lit(None).cast("string").alias("attachmentId")).alias("body"))
    none = F.lit(None).cast("string")
    file = F.struct(F.lit("image/png").alias("mimeType"), F.concat(F.lit("a b"), _s(k), F.lit(".png")).alias("filename"), F.array(F.struct(F.lit("Content-ID").alias("name"), F.lit("<c>").alias("value"))).alias("headers"), F.struct(F.lit(2048).alias("size"), none.alias("data"), F.lit("A").alias("attachmentId")).alias("body"))
    plain, html = part("text/plain", coded(F.col("text"))), part("text/html", coded(F.concat(F.lit("<p>So <b>"), _s(k), F.lit("</b></p>"))))
    parts = F.when(k % 3 == 0, F.array(plain, html, file)).when(k % 3 == 1, F.array(html)).otherwise(F.array(plain))
    head = lambda n, v: F.struct(F.lit(n).alias("name"), v.alias("value"))
    headers = F.array(head("FROM", F.concat("role", F.lit("@x.y"))), head("To", F.lit("b@x.y")), head("subject", F.concat(F.lit("S"), _s(k))), head("Date", F.lit("D")), head("Cc", F.when(t == 1, "c@x.y").otherwise("")))
    labels = F.when(t == 2, F.array(F.lit("DRAFT"))).otherwise(F.array(F.lit("INBOX"), F.concat(F.lit("L"), _s(k % 30))))
    raw = F.struct(F.concat(F.lit("m"), _s(k), F.lit("-"), _s(t)).alias("id"), F.concat(F.lit("t"), _s(k)).alias("threadId"), labels.alias("labelIds"), F.lit("sn").alias("snippet"), _s(F.lit(99) + k).alias("historyId"), _s(F.lit(1000) - t).alias("internalDate"), F.lit(5).alias("sizeEstimate"), F.struct(F.lit("multipart/mixed").alias("mimeType"), headers.alias("headers"), parts.alias("parts")).alias("payload"))
    return read(spark, d, "conversations").select(F.to_json(raw).alias("value"))


def _mail(spark: SparkSession, d: str) -> DataFrame:
    parsed = mail.without_drafts(mime.parse_messages(_raw_mail(spark, d)))
    labels = read(spark, d, "nation").select(F.concat(F.lit("L"), _s("n_nationkey")).alias("id"), F.col("n_name").alias("name"))
    return mail.named_labels(parsed, labels)


def mail_parsed(spark: SparkSession, d: str) -> DataFrame:
    found = mime.parse_messages(_raw_mail(spark, d))
    return found.select("id", "threadId", F.col("from").alias("sender"), "subject", T.sha256(F.col("body")).alias("body_hash"), F.size("attachments").cast("long").alias("n_files"), F.array_join(F.transform("attachments", lambda a: a["contentId"]), ",").alias("cids"))


def mail_documents(spark: SparkSession, d: str) -> DataFrame:
    found = mail.message_documents(_mail(spark, d))
    field = lambda c, k: F.get_json_object(c, f"$.{k}")
    return found.select("path", field("frontmatter", "thread_id").alias("thread_id"), field("frontmatter", "labels").alias("labels"), field("frontmatter", "cc").alias("cc"), T.sha256(F.col("body")).alias("body_hash"), field("sidecar", "attachments").alias("files"), field("sidecar", "labelIds").alias("label_ids"))


def mail_cli_documents(spark: SparkSession, d: str) -> DataFrame:
    rows = _mail(spark, d).withColumn("body", F.when(F.col("id").endswith("-1"), F.lit("")).otherwise(F.col("body")))
    found = mail.cli_message_documents(rows)
    return found.select("path", F.get_json_object("frontmatter", "$.cc").alias("cc"), F.get_json_object("frontmatter", "$.historyId").alias("history_id"), T.sha256(F.col("body")).alias("body_hash"))


def mail_threads(spark: SparkSession, d: str) -> DataFrame:
    found = mime.threads(_mail(spark, d))
    return found.select("threadId", "messageCount", "subject", F.array_join("participants", ",").alias("participants"), T.sha256(F.col("body")).alias("body_hash"))


def attachments_split(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "part").select("p_partkey", (F.col("p_partkey") * 1000).alias("size"))
    kept, skipped = sinks.split_attachments(rows, 50_000)
    return kept.withColumn("reason", F.lit(None).cast("string")).unionByName(skipped).select("p_partkey", "reason")


def _history(spark: SparkSession, d: str) -> DataFrame:
    """A history feed from events: a record for each, of the kind that its type names."""
    message = F.struct(F.concat(F.lit("m"), _s("user_id")).alias("id"))
    moved = lambda kind: F.when(F.col("event_type") == kind, F.array(F.struct(message.alias("message"))))
    labelled = lambda kind: F.when(F.col("event_type") == kind, F.array(F.struct(message.alias("message"), F.array(_s(F.col("event_id") % 4), F.lit("x")).alias("labelIds"))))
    return read(spark, d, "events").select(_s("event_id").alias("id"), moved("click").alias("messagesAdded"), moved("error").alias("messagesDeleted"), labelled("view").alias("labelsAdded"), labelled("signup").alias("labelsRemoved"))


def history_changes(spark: SparkSession, d: str) -> DataFrame:
    own = mail.history_changes(_history(spark, d)).withColumn("both", F.lit("deleted"))
    return own.unionByName(mail.history_changes(_history(spark, d), "skipped").withColumn("both", F.lit("skipped")))


def history_labels(spark: SparkSession, d: str) -> DataFrame:
    return mail.label_log(_history(spark, d)).select("id", F.array_join("added", ",").alias("added"), F.array_join("removed", ",").alias("removed"))


def history_mark(spark: SparkSession, d: str) -> DataFrame:
    return mail.history_mark(_history(spark, d))


def _results(spark: SparkSession, d: str) -> DataFrame:
    """Search results of a workspace: customers as pages and rows, nations as databases."""
    k = F.col("c_custkey")
    page = F.format_string(
        '{"object":"page","id":"p%d","url":"u","created_time":"c","last_edited_time":"e","archived":%s,"created_by":{"id":"x"},"parent":%s,"icon":%s,"cover":%s,"properties":{"Name":{"type":"title","title":[{"plain_text":"%s"},{"plain_text":"!"}]},"Count":{"type":"number","number":%d},"Done":{"type":"checkbox","checkbox":true},"Note":{"type":"rich_text","rich_text":[{"plain_text":"n"}]},"None":{"type":"select","select":null}}}',
        k, F.when(k % 2 == 0, "true").otherwise("false"), F.when(k % 3 == 0, F.format_string('{"type":"database_id","database_id":"d%d"}', F.col("c_nationkey"))).when(k % 3 == 1, '{"type":"workspace","workspace":true}').otherwise(F.format_string('{"type":"page_id","page_id":"p%d"}', k - 1)),
        F.when(k % 4 == 0, '{"type":"emoji","emoji":"!"}').when(k % 4 == 1, '{"type":"file","file":{"url":"f"}}').otherwise("null"), F.when(k % 5 == 0, '{"type":"external","external":{"url":"w"}}').otherwise("null"), F.col("c_name"), k,
    )
    base = F.format_string('{"object":"database","id":"d%d","title":[%s],"parent":{"type":"workspace"},"properties":{"Name":{"id":"title","name":"Name","type":"title","title":{}},"Kind":{"id":"k","name":"Kind","type":"select","select":{"options":[%d]}}}}', "n_nationkey", F.when(F.col("n_nationkey") % 2 == 0, F.format_string('{"plain_text":"%s"}', "n_name")).otherwise(""), "n_regionkey")
    raw = read(spark, d, "customer").select(page.alias("value")).unionByName(read(spark, d, "nation").select(base.alias("value")))
    return pages.read_search(raw)


def page_heads(spark: SparkSession, d: str) -> DataFrame:
    found = pages.page_heads(pages.discovered(_results(spark, d))[0])
    return found.select("id", "title", "url", "parentId", "parentType", "createdTime", "archived", "createdBy", F.col("icon.type").alias("icon"), F.col("icon.url").alias("icon_url"), F.col("cover.url").alias("cover"))


def database_heads(spark: SparkSession, d: str) -> DataFrame:
    found = pages.database_heads(pages.discovered(_results(spark, d))[1])
    return found.select("id", "title", "parentType", F.to_json("schema").alias("schema"))


def database_rows(spark: SparkSession, d: str) -> DataFrame:
    rows, _ = pages.rows_and_pages(pages.page_heads(pages.discovered(_results(spark, d))[0]))
    field = lambda k: F.get_json_object("frontmatter", f"$.{k}").alias(k)
    return pages.row_heads(rows).select("id", field("url"), field("Count"), field("Done"), field("Note"), field("None"), field("Name"), "sidecar")


def page_slugs(spark: SparkSession, d: str) -> DataFrame:
    found = pages.page_heads(pages.discovered(_results(spark, d))[0])
    return found.select("id", T.unique_slug(F.col("title"), F.col("id")).alias("slug"))


def page_changes(spark: SparkSession, d: str) -> DataFrame:
    """What a workspace's sync has to do: new, changed and deleted pages by their time of editing."""
    k = F.col("c_custkey")
    stored = read(spark, d, "customer").where(k % 4 != 0).select(k.alias("id"), F.lit("2024-01-01").alias("version"))
    current = read(spark, d, "customer").where(k % 5 != 0).select(k.alias("id"), F.when(k % 3 == 0, "2024-01-02").otherwise("2024-01-01").alias("version"))
    return R.diff_status(stored, current, "id", "version").where("status <> 'unchanged'")


def asset_names(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    url = F.when(k % 4 == 0, "https://x.y/a/b.jpeg?s=1.gif").when(k % 4 == 1, "https://x.y/a.b/c").when(k % 4 == 2, "no url.png").otherwise("https://x.y/long.extension")
    hint = F.when(k % 3 == 0, "image").when(k % 3 == 1, "pdf").otherwise("file")
    return read(spark, d, "part").select("p_partkey", pages.asset_filename(F.concat(F.lit("ab-cd-"), F.lpad(_s(k), 12, "0")), url, hint).alias("name"))


def block_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages from turns: a heading, numbered items, a quote and a nested list."""
    k, t = F.col("conv_id"), F.col("turn")
    rich = lambda said: F.concat(F.lit('{"rich_text":[{"type":"text","plain_text":"'), said, F.lit('","annotations":{"bold":true}}]}'))
    kind = F.when(t == 0, "heading_1").when(t == 3, "quote").otherwise("numbered_list_item")
    rows = read(spark, d, "conversations").select(
        k.alias("page_id"), F.concat(F.lit("b"), _s(t)).alias("id"), F.when(t == 5, "b4").alias("parent_id"), t.cast("int").alias("ordinal"), F.when(t == 5, "bulleted_list_item").otherwise(kind).alias("type"), rich(F.concat(F.lit("x"), _s(t))).alias("content"),
    )
    found = blocks.render_pages(rows.where("ordinal < 6"))
    return found.select("page_id", T.sha256(F.col("markdown")).alias("page_hash"))


def chat_blocks(spark: SparkSession, d: str) -> DataFrame:
    said = F.format_string('[{"type":"header","text":{"type":"plain_text","text":"H%d"}},{"type":"rich_text","elements":[{"type":"rich_text_list","style":"ordered","elements":[{"type":"rich_text_section","elements":[{"type":"text","text":"a","style":{"bold":true,"italic":true}},{"type":"emoji","name":"e"}]},{"type":"rich_text_section","elements":[{"type":"link","url":"u","text":"t"}]}]}]},{"type":"divider"}]', F.col("event_id"))
    value = F.when(F.col("event_id") % 2 == 0, said)
    return read(spark, d, "events").select("event_id", chat.blocks_to_text(value, F.col("event_type")).alias("said"))


def chat_times(spark: SparkSession, d: str) -> DataFrame:
    ts = F.when(F.col("event_id") % 9 == 0, "soon").otherwise(F.format_string("%d.%06d", F.lit(1_700_000_000) + F.col("event_id") * 7919, F.lit(250_000)))
    return read(spark, d, "events").select("event_id", chat.iso_time(ts).alias("iso"), chat.clock_time(ts).alias("clock"), chat.date_group(ts).alias("day"))


def error_classes(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    status = F.element_at(F.array(*map(F.lit, (200, 404, 429, 500, 503, 600))), (k % 6 + 1).cast("int"))
    said = F.element_at(F.array(*map(F.lit, ("ok", "read ECONNRESET", "Rate limit hit", "gateway Timeout", "error 502", "Quota exceeded", "socket hang up"))), (k % 7 + 1).cast("int"))
    return read(spark, d, "events").select("event_id", *(errors.is_retryable(s, status, said).alias(s) for s in errors.MESSAGES), errors.is_rate_limit(said).alias("wait"), errors.is_history_expired(status, said).alias("expired"))


def mail_formats(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    meta = F.when(k % 4 == 0, F.format_string('{"threadId":"t","messageCount":%d}', k)).when(k % 4 == 1, '{"id":"i","threadId":"t"}').when(k % 4 == 2, '{"threadId":"t","messageCount":"3"}').otherwise('{"thread_id":"t","message_count":3}')
    return read(spark, d, "events").select("event_id", markup.mail_format(meta).alias("format"))


def yaml_metadata(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    said = F.format_string("n: %d\nday: 2024-01-02\nyes: no\ntags: [a, b]\ntext: 'x: y'\n", k)
    rows = spread(read(spark, d, "events").select("event_id")).select("event_id", F.when(k % 5 == 0, "just words").otherwise(said).alias("yaml")).withColumn("metadata", yaml_to_json("yaml"))
    field = lambda c: F.get_json_object("metadata", f"$.{c}").alias(c)
    return rows.select("event_id", field("n"), field("day"), field("yes"), field("tags"), field("text"))


def files_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Documents written as files of several kinds and places, and those that a walk of the folder reads again."""
    root = scratch_path(spark, "folder")
    k = F.col("s_suppkey")
    name = F.concat(F.when(k % 5 == 0, "_skip/").when(k % 5 == 1, "sub/.hidden/").when(k % 5 == 2, "sub/deep/").otherwise(""), F.lit("f"), _s(k), F.when(k % 3 == 0, ".mD").when(k % 3 == 1, ".txt").otherwise(".pdf"))
    rows = read(spark, d, "supplier").select(name.alias("path"), F.concat("s_name", F.lit(" é")).alias("content"))
    publish.write_documents(rows, root)
    found = files.read_documents(spark, root)
    walked = files.walk_files(spark, root).select("path", F.lit(True).alias("walked"))
    return found.join(walked, "path", "left").select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "size", "content", F.coalesce("walked", F.lit(False)).alias("walked"))


class _Bytes:
    """A vision adapter that SQL can follow: a vector of size and first byte for each of two halves; empty images have none that is finite."""

    kind, name = "vision", "bytes"

    def embed_images(self, images: list[bytes]) -> list[list[list[float]]]:
        return [[[float(len(x)), float(n)] if x else [float("nan"), float(n)] for n in range(2)] for x in images]


def page_vectors(spark: SparkSession, d: str) -> DataFrame:
    images = read(spark, d, "region").select(F.col("r_regionkey").alias("page_number"), F.encode(F.when(F.col("r_regionkey") != 2, F.col("r_name")).otherwise(""), "UTF-8").alias("image"))
    found = embed_images(images, "image", _Bytes())
    return found.select("page_number", "vector_index", F.element_at("embedding", 1).cast("double").alias("a"), F.element_at("embedding", 2).cast("double").alias("b"))


def filter_options(spark: SparkSession, d: str) -> DataFrame:
    """Rows of events that pass a filter as it is given on a command line."""
    key, value = scoring.parse_filter("k=7") or ("", "")
    return read(spark, d, "events").where(scoring.matches_filters(F.col("props"), {key: value})).select("event_id")


def page_documents(spark: SparkSession, d: str) -> DataFrame:
    """Pages with their bodies, the paths of the tree, and comments."""
    heads = pages.page_heads(pages.discovered(_results(spark, d))[0])
    k = F.col("c_custkey")
    customers = read(spark, d, "customer")
    bodies = customers.where(k % 2 == 0).select(F.concat(F.lit("p"), _s(k)).alias("id"), F.concat(F.lit("body "), _s(k)).alias("markdown"))
    paths = customers.select(F.concat(F.lit("p"), _s(k)).alias("id"), F.concat(F.lit("notes/"), _s(k)).alias("path"))
    said = customers.where(k % 10 == 0).select(F.explode(F.array(F.lit(2), F.lit(1))).alias("n"), k.alias("k")).select(
        F.concat(F.lit("c"), _s("n")).alias("id"), F.concat(F.lit("t"), _s("n")).alias("created_time"), F.struct(F.lit("w").alias("id")).alias("created_by"), F.struct(F.concat(F.lit("p"), _s("k")).alias("page_id")).alias("parent"),
        F.array(F.struct(F.lit("a").alias("plain_text")), F.struct(F.lit("b").alias("plain_text"))).alias("rich_text"),
    )
    found = pages.page_documents(heads, bodies, paths, pages.page_comments(said))
    return found.select("path", F.get_json_object("frontmatter", "$.archived").alias("archived"), F.get_json_object("frontmatter", "$.icon").alias("icon"), "body", F.get_json_object("sidecar", "$.comments").alias("comments"), F.get_json_object("sidecar", "$.parentType").alias("parent_type"))


def dimension_files(spark: SparkSession, d: str) -> DataFrame:
    """Teams of wanted keys as one JSON array."""
    teams = read(spark, d, "nation").select(_s("n_nationkey").alias("id"), F.concat(F.lit("K"), _s(F.col("n_nationkey") % 5)).alias("key"), F.col("n_name").alias("name"))
    return sinks.json_array(issues.team_filter(teams, ["K1", "K3"]), "id")


def result_lines(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    rows = read(spark, d, "part").select(
        k, (k % 100 / 97).alias("score"), F.lit("ix").alias("index_name"), F.concat(F.lit("/r/"), _s(k)).alias("file_path"), F.when(k % 2 == 0, F.concat(F.lit("rel/"), _s(k))).alias("relative_path"), F.when(k % 3 == 0, "A § B").alias("section_context"),
        F.repeat(F.lit("word\n"), (k % 60).cast("int")).alias("content"), F.when(k % 5 == 0, F.lit(1_700_000_000_000) - k * 86_400_000).alias("content_timestamp_ms"), F.when(k % 7 == 0, "vision").otherwise("text").alias("result_type"),
    )
    return sinks.result_lines(rows, 1_700_000_000_000).select("p_partkey", T.sha256(F.col("line")).alias("line_hash"))


def chat_increment(spark: SparkSession, d: str) -> DataFrame:
    """Messages newer than their channel's mark, and replies newer than their thread's, by text as chat times compare."""
    k, t = F.col("conv_id"), F.col("turn")
    rows = read(spark, d, "conversations").select(F.concat(F.lit("C"), _s(k % 7)).alias("channel"), F.when(k % 3 == 0, _s(k)).alias("thread"), F.concat(_s(F.lit(1_700_000_000) + k * 10 + t), F.lit(".000100")).alias("ts"))
    old = rows.where("substring(ts, 10, 1) < '5'")
    messages = R.since(rows.where("thread IS NULL"), R.high_water(old.where("thread IS NULL"), "channel", "ts"), "channel", "ts")
    replies = R.since(rows.where("thread IS NOT NULL"), R.high_water(old.where("thread IS NOT NULL"), "thread", "ts"), "thread", "ts")
    return messages.select("channel", "ts").unionByName(replies.select("channel", "ts"))


QUERIES = {f.__name__: f for f in (
    mail_parsed, mail_documents, mail_cli_documents, mail_threads, attachments_split, history_changes, history_labels, history_mark, page_heads, database_heads, database_rows, page_slugs, page_changes, asset_names, block_pages,
    chat_blocks, chat_times, error_classes, mail_formats, yaml_metadata, files_round_trip, page_vectors, filter_options, page_documents, dimension_files, result_lines, chat_increment,
)}

_BODY = "CASE WHEN conv_id % 3 = 1 THEN 'So **' || conv_id || '**' ELSE text END"
_KEPT = f"(SELECT *, {_BODY} AS body, 'm' || conv_id || '-' || turn AS id FROM conversations WHERE turn <> 2)"
SQL = {
    "mail_parsed": f"""
        SELECT 'm' || conv_id || '-' || turn AS id, 't' || conv_id AS "threadId", role || '@x.y' AS sender, 'S' || conv_id AS subject, sha256({_BODY}) AS body_hash, CASE WHEN conv_id % 3 = 0 THEN 1 ELSE 0 END::BIGINT AS n_files, CASE WHEN conv_id % 3 = 0 THEN 'c' ELSE '' END AS cids
        FROM conversations""",
    "mail_documents": f"""
        SELECT 'messages/' || id || '.md' AS path, 't' || conv_id AS thread_id, '["INBOX","' || coalesce(n_name, 'L' || (conv_id % 30)) || '"]' AS labels, CASE WHEN turn = 1 THEN 'c@x.y' END AS cc,
            sha256(body || CASE WHEN conv_id % 3 = 0 THEN chr(10) || chr(10) || 'Attachments:' || chr(10) || '- [a b' || conv_id || '.png](../attachments/' || id || '/a_b' || conv_id || '.png) (2.0 KB)' ELSE '' END) AS body_hash,
            CASE WHEN conv_id % 3 = 0 THEN '[{{"filename":"a b' || conv_id || '.png","mimeType":"image/png","size":2048}}]' ELSE '[]' END AS files, '["INBOX","L' || (conv_id % 30) || '"]' AS label_ids
        FROM {_KEPT} LEFT JOIN nation ON n_nationkey = conv_id % 30""",
    "mail_cli_documents": f"""
        SELECT 'messages/' || id || '.md' AS path, CASE WHEN turn = 1 THEN 'c@x.y' END AS cc, (99 + conv_id)::VARCHAR AS history_id, sha256(CASE WHEN turn = 1 OR body = '' THEN '(no body)' ELSE body END) AS body_hash FROM {_KEPT}""",
    "mail_threads": f"""
        WITH firsts AS (SELECT conv_id, role, max(turn) AS t FROM {_KEPT} GROUP BY ALL), names AS (SELECT conv_id, string_agg(role || '@x.y', ',' ORDER BY t DESC) AS participants FROM firsts GROUP BY conv_id)
        SELECT 't' || conv_id AS "threadId", count(*) AS "messageCount", 'S' || conv_id AS subject, any_value(participants) AS participants,
            sha256(string_agg('**From:** ' || role || '@x.y  ' || chr(10) || '**Date:** D' || chr(10) || chr(10) || body, chr(10) || chr(10) || '---' || chr(10) ORDER BY turn DESC)) AS body_hash
        FROM {_KEPT} JOIN names USING (conv_id) GROUP BY conv_id""",
    "attachments_split": "SELECT p_partkey, CASE WHEN p_partkey * 1000 > 50000 THEN 'exceeds 50000 bytes' END AS reason FROM part",
    "history_changes": """
        WITH x AS (SELECT 'm' || user_id AS id, bool_or(event_type = 'click') AS a, bool_or(event_type = 'error') AS d FROM events WHERE event_type IN ('click', 'error') GROUP BY user_id)
        SELECT id, CASE WHEN d THEN 'deleted' ELSE 'added' END AS op, 'deleted' AS both FROM x UNION ALL SELECT id, CASE WHEN d THEN 'deleted' ELSE 'added' END, 'skipped' FROM x WHERE NOT (a AND d)""",
    "history_labels": """
        SELECT 'm' || user_id AS id, coalesce(string_agg(event_id % 4 || ',x', ',' ORDER BY event_id) FILTER (event_type = 'view'), '') AS added, coalesce(string_agg(event_id % 4 || ',x', ',' ORDER BY event_id) FILTER (event_type = 'signup'), '') AS removed
        FROM events WHERE event_type IN ('view', 'signup') GROUP BY user_id""",
    "history_mark": "SELECT max(event_id)::VARCHAR AS history_id FROM events",
    "page_heads": """
        SELECT 'p' || c_custkey AS id, c_name || '!' AS title, 'u' AS url, CASE c_custkey % 3 WHEN 0 THEN 'd' || c_nationkey WHEN 2 THEN 'p' || (c_custkey - 1) END AS "parentId", CASE c_custkey % 3 WHEN 0 THEN 'database_id' WHEN 1 THEN 'workspace' ELSE 'page_id' END AS "parentType",
            'c' AS "createdTime", c_custkey % 2 = 0 AS archived, 'x' AS "createdBy", CASE c_custkey % 4 WHEN 0 THEN 'emoji' WHEN 1 THEN 'file' END AS icon, CASE c_custkey % 4 WHEN 1 THEN 'f' END AS icon_url, CASE WHEN c_custkey % 5 = 0 THEN 'w' END AS cover FROM customer""",
    "database_heads": """
        SELECT 'd' || n_nationkey AS id, CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE 'Untitled Database' END AS title, 'workspace' AS "parentType",
            '{"Name":{"id":"title","type":"title","config":"{}"},"Kind":{"id":"k","type":"select","config":"{\\"options\\":[' || n_regionkey || ']}"}}' AS schema FROM nation""",
    "database_rows": """
        SELECT 'p' || c_custkey AS id, 'u' AS url, c_custkey::VARCHAR AS "Count", 'true' AS "Done", 'n' AS "Note", NULL::VARCHAR AS "None", NULL::VARCHAR AS "Name",
            '{"id":"p' || c_custkey || '","title":"' || c_name || '!","url":"u","createdTime":"c","lastEditedTime":"e","archived":' || CASE WHEN c_custkey % 2 = 0 THEN 'true' ELSE 'false' END || '}' AS sidecar FROM customer WHERE c_custkey % 3 = 0""",
    "page_slugs": "SELECT 'p' || c_custkey AS id, regexp_replace(lower(c_name), '[^a-z0-9]', '', 'g') || '-' || substr('p' || c_custkey, 1, 8) AS slug FROM customer",
    "page_changes": """
        SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN 'new' WHEN c_custkey % 5 = 0 THEN 'pruned' ELSE 'changed' END AS status FROM customer
        WHERE NOT (c_custkey % 4 = 0 AND c_custkey % 5 = 0) AND (c_custkey % 4 = 0 OR c_custkey % 5 = 0 OR c_custkey % 3 = 0)""",
    "asset_names": """
        SELECT p_partkey, substr('abcd' || lpad(p_partkey::VARCHAR, 12, '0'), 1, 12) || CASE WHEN p_partkey % 4 = 0 THEN '.jpeg' ELSE CASE p_partkey % 3 WHEN 0 THEN '.png' WHEN 1 THEN '.pdf' ELSE '.bin' END END AS name FROM part""",
    "block_pages": """
        WITH n AS (SELECT conv_id, max(turn) AS m FROM conversations GROUP BY conv_id)
        SELECT conv_id AS page_id, sha256('# **x0**' || CASE WHEN m >= 1 THEN chr(10) || chr(10) || '1. **x1**' ELSE '' END || CASE WHEN m >= 2 THEN chr(10) || '2. **x2**' ELSE '' END || CASE WHEN m >= 3 THEN chr(10) || chr(10) || '> **x3**' ELSE '' END
            || CASE WHEN m >= 4 THEN chr(10) || chr(10) || '1. **x4**' ELSE '' END || CASE WHEN m >= 5 THEN chr(10) || '- **x5**' ELSE '' END) AS page_hash FROM n""",
    "chat_blocks": "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '### H' || event_id || chr(10) || chr(10) || '1. _**a**_:e:' || chr(10) || '2. [t](u)' || chr(10) || chr(10) || '---' ELSE event_type END AS said FROM events",
    "chat_times": """
        WITH t AS (SELECT event_id, event_id % 9 = 0 AS odd, make_timestamp((1700000000 + event_id * 7919) * 1000000 + 250000) AS w FROM events)
        SELECT event_id, CASE WHEN odd THEN 'soon' ELSE strftime(w, '%Y-%m-%dT%H:%M:%S.250Z') END AS iso, CASE WHEN odd THEN 'soon' ELSE strftime(w, '%I:%M %p') END AS clock, CASE WHEN odd THEN 'soon' ELSE strftime(w, '%Y-%m-%d') END AS day FROM t""",
    "error_classes": """
        WITH x AS (SELECT event_id, event_id % 7 AS m, [200, 404, 429, 500, 503, 600][(event_id % 6 + 1)::INT] AS s FROM events)
        SELECT event_id, m IN (1, 6) OR s IN (500, 503) AS core, m IN (1, 2, 6) OR s IN (429, 500, 503) AS chat, m IN (1, 6) OR s IN (429, 500, 503) AS mail, m IN (1, 4, 6) AS issues, m IN (1, 2, 3, 4) AS pages, m = 5 AS wait, s = 404 AS expired FROM x""",
    "mail_formats": "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'thread' WHEN 1 THEN 'message' END AS format FROM events",
    "yaml_metadata": """
        SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN event_id::VARCHAR END AS n, CASE WHEN event_id % 5 <> 0 THEN '2024-01-02' END AS day, CASE WHEN event_id % 5 <> 0 THEN 'no' END AS yes, CASE WHEN event_id % 5 <> 0 THEN '["a","b"]' END AS tags, CASE WHEN event_id % 5 <> 0 THEN 'x: y' END AS text FROM events""",
    "files_round_trip": """
        SELECT 'f' || s_suppkey || CASE s_suppkey % 3 WHEN 0 THEN '.mD' ELSE '.txt' END AS name, strlen(s_name || ' é')::BIGINT AS size, s_name || ' é' AS content, true AS walked FROM supplier WHERE s_suppkey % 5 > 1 AND s_suppkey % 3 < 2""",
    "page_vectors": "SELECT r_regionkey AS page_number, n::INTEGER AS vector_index, CASE WHEN r_regionkey = 2 THEN 0 ELSE length(r_name) END::DOUBLE AS a, n::DOUBLE AS b FROM region, (VALUES (0), (1)) t(n)",
    "filter_options": "SELECT event_id FROM events WHERE json_extract_string(props, '$.k') = '7'",
    "page_documents": """
        SELECT 'notes/' || c_custkey || '/index.md' AS path, CASE WHEN c_custkey % 2 = 0 THEN 'true' END AS archived, CASE WHEN c_custkey % 4 = 0 THEN '!' END AS icon, CASE WHEN c_custkey % 2 = 0 THEN 'body ' || c_custkey ELSE '' END AS body,
            CASE WHEN c_custkey % 10 = 0 THEN '[{"createdTime":"t1","id":"c1","createdBy":"w","text":"ab"},{"createdTime":"t2","id":"c2","createdBy":"w","text":"ab"}]' END AS comments, CASE c_custkey % 3 WHEN 0 THEN 'database_id' WHEN 1 THEN 'workspace' ELSE 'page_id' END AS parent_type
        FROM customer""",
    "dimension_files": """SELECT '[' || string_agg('{"id":"' || n_nationkey || '","key":"K' || (n_nationkey % 5) || '","name":"' || n_name || '"}', ',' ORDER BY n_nationkey::VARCHAR) || ']' AS value FROM nation WHERE n_nationkey % 5 IN (1, 3)""",
    "result_lines": """
        WITH x AS (
            SELECT p_partkey AS k, p_partkey % 100 / 97.0::DOUBLE AS s, repeat('word' || chr(10), (p_partkey % 60)::INT) AS c,
                CASE WHEN k % 5 = 0 THEN CASE WHEN k < 1 THEN 'today' WHEN k = 1 THEN '1d ago' WHEN k < 30 THEN k || 'd ago' WHEN k // 30 < 12 THEN (k // 30) || 'mo ago' ELSE (k // 365) || 'y ago' END END AS age FROM part
        )
        SELECT k AS p_partkey, sha256('[' || CASE WHEN age IS NULL THEN printf('%.3f', s) ELSE printf('%.2f', s) || ' | ' || age END || '] ix/' || CASE WHEN k % 2 = 0 THEN 'rel/' ELSE '/r/' END || k || CASE WHEN k % 3 = 0 THEN ' § A § B' ELSE '' END
            || CASE WHEN k % 7 = 0 THEN ' [vision]' ELSE '' END || chr(10) || '  "' || substr(replace(c, chr(10), ' '), 1, 200) || CASE WHEN length(c) > 200 THEN '...' ELSE '' END || '"' || chr(10)) AS line_hash FROM x""",
    "chat_increment": """
        WITH x AS (SELECT 'C' || (conv_id % 7) AS channel, CASE WHEN conv_id % 3 = 0 THEN conv_id END AS thread, (1700000000 + conv_id * 10 + turn) || '.000100' AS ts FROM conversations),
        m AS (SELECT channel, max(ts) AS h FROM x WHERE thread IS NULL AND substr(ts, 10, 1) < '5' GROUP BY channel), r AS (SELECT thread, max(ts) AS h FROM x WHERE thread IS NOT NULL AND substr(ts, 10, 1) < '5' GROUP BY thread)
        SELECT x.channel, ts FROM x LEFT JOIN m ON m.channel = x.channel WHERE thread IS NULL AND (h IS NULL OR ts > h) UNION ALL SELECT x.channel, ts FROM x LEFT JOIN r ON r.thread = x.thread WHERE x.thread IS NOT NULL AND (h IS NULL OR ts > h)""",
}
