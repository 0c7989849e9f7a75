import json

import pytest
from pyspark.sql import functions as F

from gleaner.functions import chat, issues, mime
from gleaner.functions.blocks import Renderer, page_title, property_value, render_pages, rich_text, tree
from gleaner.operators import channels, rollups
from gleaner.sources import dumps, publish, sinks

C = F.col("c")


def seg(said, href=None, **style):
    return {"type": "text", "plain_text": said, "href": href, "annotations": style}


def block(kind, said="", children=(), id="b", **content):
    return {"id": id, "type": kind, "content": {"rich_text": [seg(said)] if said else [], **content}, "children": list(children)}


@pytest.mark.parametrize("segments, want", [
    ([seg("a", bold=True, italic=True)], "***a***"), ([seg("a", code=True, bold=True)], "`a`"), ([seg("a", href="u", strikethrough=True)], "[~~a~~](u)"), ([seg("a", underline=True)], "<u>a</u>"),
    ([{"type": "equation", "plain_text": "x", "href": "u", "annotations": {}, "equation": {"expression": "x^2"}}], "$x^2$"), (None, ""), ([seg("")], ""),
])
def test_rich_text(segments, want):
    assert rich_text(segments) == want


@pytest.mark.parametrize("one, want", [
    (block("paragraph", "p"), "p"), (block("heading_2", "h"), "## h"), (block("to_do", "t", checked=True), "- [x] t"), (block("divider"), "---"), (block("code", "x = 1", language="python", caption=[seg("note")]), "```python\nx = 1\n```\n*note*"),
    (block("quote", "a\nb"), "> a\n> b"), (block("callout", "c", icon={"type": "emoji", "emoji": "!"}), "> ! **c**"), (block("image", type="external", external={"url": "u"}), "![image](u)"), (block("pdf", type="file", file={"url": "u"}), "[pdf](u)"),
    (block("bookmark", url="u"), "[Bookmark: u](u)"), (block("equation", expression="e"), "$$\ne\n$$"), (block("synced_block"), "<!-- synced block (content not available) -->"), (block("breadcrumb"), ""), (block("mystery", "m"), "<!-- unsupported block: mystery --> m"),
    (block("link_to_page", page_id="p9"), "[Page link](notion://p9)"), (block("child_page", title="T", id="c1"), "[T](./t-slug/)"), (block("video", url="u"), "[Video](u)"), (block("embed", url="u"), "[Embed](u)"), (block("link_preview", url="u"), "[u](u)"),
    (block("toggle", "t", [block("paragraph", "in")]), "<details>\n<summary>t</summary>\n\nin\n\n</details>"),
])
def test_blocks(one, want):
    assert Renderer({"c1": "t-slug"}).blocks([one]) == want


def test_lists_number_and_nest():
    got = Renderer().blocks([block("numbered_list_item", "a", [block("bulleted_list_item", "in")]), block("numbered_list_item", "b"), block("paragraph", "p"), block("numbered_list_item", "c")])
    assert got == "1. a\n- in\n2. b\n\np\n\n1. c"


def test_tables_fill_short_rows_and_keep_long_ones():
    row = lambda *cells: {"id": "r", "type": "table_row", "content": {"cells": [[seg(c)] for c in cells]}, "children": []}
    got = Renderer().blocks([{"id": "t", "type": "table", "content": {}, "children": [row("a", "b"), row("1"), row("1", "2", "3")]}])
    assert got == "| a | b |\n| --- | --- |\n| 1 |  |\n| 1 | 2 | 3 |"


@pytest.mark.parametrize("prop, want", [
    ({"type": "title", "title": [seg("T")]}, "T"), ({"type": "number", "number": 3}, 3), ({"type": "select", "select": None}, None), ({"type": "multi_select", "multi_select": [{"name": "a"}, {"name": "b"}]}, ["a", "b"]),
    ({"type": "date", "date": {"start": "a", "end": "b"}}, "a - b"), ({"type": "checkbox", "checkbox": None}, False), ({"type": "formula", "formula": {"type": "number", "number": 2}}, 2), ({"type": "relation", "relation": [{"id": "x"}]}, ["x"]),
    ({"type": "rollup", "rollup": {"type": "array", "array": [{"type": "number", "number": 1}]}}, [1]), ({"type": "people", "people": [{"id": "i"}, {"id": "j", "name": "J"}]}, ["i", "J"]), ({"type": "unique_id", "unique_id": {"prefix": "P", "number": 4}}, "P-4"),
    ({"type": "files", "files": [{"name": "f", "type": "external", "external": {"url": "u"}}]}, [{"name": "f", "url": "u"}]), ({"type": "status", "status": {"name": "s"}}, "s"), ({"type": "button"}, None), ({"type": "verification", "verification": {"state": "v"}}, "v"),
])
def test_properties(prop, want):
    assert property_value(prop) == want
    assert page_title({"x": {"type": "title", "title": []}}) == "Untitled" and page_title({"x": {"type": "title", "title": [seg("A")]}}) == "A"


def test_pages_from_adjacency_rows(spark):
    content = lambda said, **more: json.dumps({"rich_text": [seg(said)], **more})
    rows = [("p1", "b1", None, 0, "bulleted_list_item", content("top")), ("p1", "b2", "b1", 0, "paragraph", content("in")), ("p1", "b0", None, 1, "synced_block", json.dumps({"synced_from": {"block_id": "b1"}})), ("p2", "x", None, 0, "heading_1", content("H"))]
    df = spark.createDataFrame(rows, "page_id string, id string, parent_id string, ordinal int, type string, content string")
    assert {r.page_id: r.markdown for r in render_pages(df).collect()} == {"p1": "- top\nin\n\nin", "p2": "# H"}
    cycle = [{"id": "a", "parent_id": "a", "ordinal": 0, "type": "paragraph", "content": "{}"}]
    assert tree(cycle) == []
    deep = [{"id": f"b{i}", "parent_id": f"b{i - 1}" if i else None, "ordinal": 0, "type": "bulleted_list_item", "content": json.dumps({"rich_text": [{"plain_text": f"item {i}"}]})} for i in range(400)]
    frame = spark.createDataFrame([("p", *r.values()) for r in deep], "page_id string, id string, parent_id string, ordinal int, type string, content string")
    whole = render_pages(frame).first().markdown
    assert all(f"item {i}" in whole for i in range(400)) and "item 21" not in render_pages(frame, most_depth=20).first().markdown


def test_chat_blocks(column):
    blocks = [
        {"type": "rich_text", "elements": [{"type": "rich_text_section", "elements": [{"type": "text", "text": "hi", "style": {"bold": True, "code": True}}, {"type": "user", "user_id": "U1"}, {"type": "emoji", "name": "x"}]}]},
        {"type": "rich_text", "elements": [{"type": "rich_text_list", "style": "ordered", "elements": [{"type": "rich_text_section", "elements": [{"type": "text", "text": "a"}]}, {"type": "rich_text_section", "elements": [{"type": "link", "url": "u", "text": "t"}]}]}]},
        {"type": "rich_text", "elements": [{"type": "rich_text_quote", "elements": [{"type": "text", "text": "l1\nl2"}]}, {"type": "rich_text_preformatted", "elements": [{"type": "text", "text": "code"}]}]},
        {"type": "section", "text": {"type": "mrkdwn", "text": "s"}, "fields": [{"text": "f"}]}, {"type": "header", "text": {"text": "H"}}, {"type": "context", "elements": [{"type": "image", "alt_text": "pic"}, {"type": "mrkdwn", "text": "c"}]}, {"type": "divider"}, {"type": "image", "alt_text": "z"}, {"type": "actions"},
    ]
    got = column(chat.blocks_to_text(C, F.lit("fall")), c=json.dumps(blocks))
    assert got == "**`hi`**<@U1>:x:\n\n1. a\n2. [t](u)\n\n> l1\n> l2```\ncode\n```\n\ns\nf\n\n### H\n\n[pic] | c\n\n---\n\n[Image: z]"
    assert [column(chat.blocks_to_text(C, F.lit("fall")), c=x) for x in (None, "[]", '[{"type":"input"}]')] == ["fall"] * 3


def test_chat_rules(column):
    assert column(chat.to_markdown(C), c="*b* **c** ~s~ a*b") == "**b** **c** ~~s~~ a*b"
    skip = lambda sub, said, files, bot: column(chat.should_skip(F.lit(sub).cast("string"), C, F.lit(files), F.lit(bot)), c=said)
    assert [skip("channel_join", "x", False, False), skip(None, " ", True, False), skip(None, "deployed v1", False, True), skip(None, "deployed v1", False, False), skip("bot_message", "x", False, True)] == [True, True, True, False, False]
    assert column(chat.author_name(F.lit(""), F.lit("Real"), F.lit("P"), F.lit("u"), F.lit("B"))) == "Real" and column(chat.author_name(*[F.lit(None).cast("string")] * 4, F.lit("B"))) == "bot:B"
    assert [column(f(C), c="1672531200.000000") for f in (chat.iso_time, chat.clock_time, chat.date_group)] == ["2023-01-01T00:00:00.000Z", "12:00 AM", "2023-01-01"] and column(chat.clock_time(C), c="bad") == "bad"
    assert column(chat.render_system(F.lit("channel_join"), F.lit("A"), C), c="") == "_A joined the channel_"


def test_mentions(spark):
    users = spark.createDataFrame([("U1", "Ann")], "id string, name string")
    rows = spark.createDataFrame([(1, "<@U1><@U2> <@U3|Cy> <#C1> <!subteam^S1> <https://x.y|l>"), (1, "b <@U1>"), (2, ""), (3, "plain"), (4, None)], "id int, text string").withColumn("_row", F.lit("clash"))
    channels_ = spark.createDataFrame([("C1", "general")], "id string, name string")
    got = sorted((r.id, r.text) for r in chat.resolve_mentions(rows, "text", users, "id", ["name"], channels_).collect() if r.id != 4)
    assert got == [(1, "@Ann@U2 @Cy #general @group [l](https://x.y)"), (1, "b @Ann"), (2, ""), (3, "plain")]


def _b64(text, charset="utf-8"):
    import base64

    return base64.urlsafe_b64encode(text.encode(charset)).decode().rstrip("=")


def test_mime():
    part = lambda kind, said, charset="utf-8": {"mimeType": kind, "filename": "", "headers": [{"name": "content-type", "value": f"{kind}; charset={charset}"}], "body": {"size": 1, "data": _b64(said, charset)}}
    pdf = {"mimeType": "application/pdf", "filename": "a.pdf", "headers": [{"name": "Content-ID", "value": "<cid>"}], "body": {"size": 9, "attachmentId": "A"}}
    raw = {"id": "m", "threadId": "t", "internalDate": "5", "payload": {"mimeType": "multipart/mixed", "headers": [{"name": "SUBJECT", "value": "S"}, {"name": "From", "value": "f"}], "parts": [{"mimeType": "multipart/alternative", "parts": [part("text/plain", "é", "iso-8859-1"), part("text/html", "<p>h</p>")]}, pdf]}}
    got = mime.parse_message(raw)
    assert (got["subject"], got["bodyPlain"], got["bodyHtml"], got["cc"]) == ("S", "é", "<p>h</p>", None)
    assert got["attachments"] == [{"attachmentId": "A", "filename": "a.pdf", "mimeType": "application/pdf", "size": 9, "contentId": "cid"}]
    assert mime.decode_body(_b64("x"), "text/plain; charset=nonsense") == "x" and mime.decode_body(None) == ""
    assert mime.html_to_markdown("<h2>T</h2><p>a <b>b</b> <a href='u'>l</a></p><ul><li>1</li><li>2</li></ul>") == "## T\n\na **b** [l](u)\n\n- 1\n- 2"
    assert mime.body_markdown(" ", "<p>h</p>", "snip") == " " and mime.body_markdown("", None, "snip") == "snip"


def test_mail_threads(spark):
    raws = [{"id": f"m{i}", "threadId": "t", "internalDate": str(9 - i), "snippet": f"s{i}", "payload": {"headers": [{"name": "From", "value": f"f{i % 2}"}, {"name": "Subject", "value": f"S{i}"}]}} for i in range(3)]
    df = spark.createDataFrame([(json.dumps(r),) for r in raws] + [("broken",)], "value string")
    messages = mime.parse_messages(df)
    assert messages.count() == 3
    (row,) = mime.threads(messages).collect()
    assert (row.messageCount, row.subject, row.participants) == (3, "S2", ["f0", "f1"]) and row.body.startswith("**From:** f0") and row.body.count("\n---\n") == 2


def test_issues(spark, column):
    node = {
        "id": "i", "identifier": "TM-1", "title": "Fix", "description": "Desc", "priority": 1, "createdAt": "c", "updatedAt": "2024-01-02", "archivedAt": None, "state": {"id": "s", "name": "Todo", "type": "unstarted"}, "team": {"id": "t1"},
        "assignee": {"id": "u1"}, "creator": {"id": "u9"}, "project": {"id": "p"}, "cycle": {"id": "c1"}, "labels": {"nodes": [{"id": "l2"}, {"id": "x"}, {"id": "l1"}]}, "estimate": None, "dueDate": "",
        "comments": {"nodes": [{"id": "k", "body": "hey", "createdAt": "t", "user": {"id": "u1"}}, {"id": "k2", "body": "yo", "createdAt": "t2", "user": None}]},
        "attachments": {"nodes": [{"id": "a", "title": "T", "url": "https://x.y/z"}]}, "relations": {"nodes": [{"type": "blocks", "relatedIssue": {"id": "r", "identifier": "TM-2"}}]},
        "inverseRelations": {"nodes": [{"type": "blocks", "issue": {"id": "r", "identifier": "TM-3"}}, {"type": "duplicate", "issue": {"id": "r", "identifier": "TM-4"}}, {"type": "odd", "issue": {"id": "r", "identifier": "TM-5"}}]},
    }
    plain = {"id": "j", "identifier": "TM-9", "title": "Bare", "priority": 9, "createdAt": "c", "updatedAt": "2024-01-01", "archivedAt": "z", "team": {"id": "none"}}
    raw = spark.read.schema(issues.ISSUE_NODE).json(spark.sparkContext.parallelize([json.dumps(node), json.dumps(plain)]))
    users = spark.createDataFrame([("u1", "Ann")], "id string, displayName string")
    teams = spark.createDataFrame([("t1", "TM", "Team")], "id string, key string, name string")
    named = lambda *rows: spark.createDataFrame(rows, "id string, name string, number int")
    docs = {r.path: r for r in issues.documents(issues.typed_issues(raw), users, teams, named(("p", "P", None)), named(("c1", "", 7)), named(("l1", "bug", None), ("l2", "ui", None))).collect()}
    full, bare = docs["issues/TM/TM-1.md"], docs["issues//TM-9.md"]
    assert json.loads(full.frontmatter) == {
        "id": "i", "identifier": "TM-1", "title": "Fix", "state": "Todo", "stateType": "unstarted", "priority": 1, "priorityLabel": "Urgent", "assignee": "Ann", "team": "Team", "project": "P", "cycle": "Cycle 7", "labels": ["ui", "bug"],
        "createdAt": "c", "updatedAt": "2024-01-02", "archived": False, "attachments": [{"title": "T", "url": "https://x.y/z"}],
        "relations": [{"type": "blocks", "issue": "TM-2"}, {"type": "blocked-by", "issue": "TM-3"}, {"type": "duplicate-of", "issue": "TM-4"}, {"type": "odd", "issue": "TM-5"}],
    }
    assert full.body == "# TM-1: Fix\n\nDesc\n\n---\n\n## Comments\n\n### Ann --- t\n\nhey\n\n### Unknown --- t2\n\nyo" and bare.body == "# TM-9: Bare\n"
    assert json.loads(bare.frontmatter) == {"id": "j", "identifier": "TM-9", "title": "Bare", "priority": 9, "priorityLabel": "None", "createdAt": "c", "updatedAt": "2024-01-01", "archived": True, "archivedAt": "z"}
    assert [r.id for r in issues.typed_issues(raw, "2024-01-01").collect()] == ["i"]
    names = {"https://a.b/c/d%20e.png?x=1": "d e.png", "https://a.b": None, "https://a.b/c/d": None, "no url.png": None, "https://a.b/c/x.y/": "x.y", "https://a.b/a+b.c": "a+b.c", "https://a.b/%zz.c": None}
    assert {u: column(issues.filename_from_url(C), c=u) for u in names} == names
    assert [column(issues.is_downloadable(C), c=x) for x in (None, "", "upload", "github")] == [True, True, True, False]
    assert column(issues.project_slug(F.lit(""), C), c="My  Big/Plan") == "my-big_plan" and column(issues.attachment_title(C), c="") == "attachment"
    rel = spark.createDataFrame([("a", "b", "blocks"), ("c", "d", "odd"), ("e", "f", "duplicate-of")], "issue_id string, related_id string, type string")
    assert {(r.source, r.kind) for r in issues.relations(rel).collect()} == {("a", "blocks"), ("b", "blocked-by"), ("c", "odd"), ("d", "odd"), ("e", "duplicate-of"), ("f", "duplicate")}


def test_change_logs(spark):
    state = spark.createDataFrame([(1, 0, "s", "old"), (2, 0, "s", "old")], "k int, at int, op string, v string")
    log = spark.createDataFrame([(1, 1, "put", "a"), (1, 2, "delete", None), (3, 1, "delete", None), (3, 2, "put", "c"), (2, 1, "put", "b")], "k int, at int, op string, v string")
    assert sorted((r.k, r.v) for r in rollups.apply_changes(state, log, ["k"], ["at"]).collect()) == [(2, "b"), (3, "c")]
    again = rollups.apply_changes(rollups.apply_changes(state, log, ["k"], ["at"]), log, ["k"], ["at"])
    assert again.count() == 2


def test_orphans_are_roots_and_paths_are_whole(spark):
    nodes = spark.createDataFrame([("c", "b", "C"), ("b", "a", "B"), ("a", None, "A"), ("o", "gone", "O")], "id string, parent string, name string")
    assert {r.id: (r.depth, r.path) for r in rollups.tree_paths(nodes, "id", "parent", "name").collect()} == {"a": (0, "A"), "b": (1, "A/B"), "c": (2, "A/B/C"), "o": (0, "O")}


def test_deep_trees_are_whole_and_cycles_end(spark):
    chain = [(str(i), str(i - 1) if i else None, f"n{i}") for i in range(25)]
    nodes = spark.createDataFrame([*chain, ("x", "0", "X"), ("y", "x", "Y"), ("x", "y", "X"), ("p", "q", "P"), ("q", "p", "Q")], "id string, parent string, name string")
    got = rollups.tree_paths(nodes, "id", "parent", "name").collect()
    assert {(r.id, r.depth) for r in got} == {(str(i), i) for i in range(25)} | {("x", 1), ("y", 2)} and len(got) == 27
    assert max(got, key=lambda r: r.depth).path == "/".join(f"n{i}" for i in range(25))


def test_dumps(spark, tmp_path):
    raw = [{"id": "U1", "name": "n", "profile": {"display_name": ""}}, {"id": "U2", "real_name": "R", "is_bot": True}]
    (tmp_path / "users.jsonl").write_text("\n".join(map(json.dumps, raw)) + "\n")
    users = dumps.chat_users(dumps.read_json_lines(spark, str(tmp_path / "users.jsonl"), dumps.CHAT_USER)).orderBy("id").collect()
    assert [(u.displayName, u.isBot) for u in users] == [("n", False), ("R", True)]
    channels = spark.read.schema(dumps.CHAT_CHANNEL).json(spark.sparkContext.parallelize(['{"id":"C1","name":"g","is_private":true}', '{"id":"D1","user":"U1","is_im":true,"is_private":true}']))
    assert {c.id: (c.name, c.type) for c in dumps.chat_channels(channels).collect()} == {"C1": ("g", "private"), "D1": ("U1", "im")}
    dumps.register(spark)
    rows = spark.read.format("dump").option("fields", "id,profile").load(str(tmp_path / "users.jsonl")).orderBy("id").collect()
    assert rows[0].profile == '{"display_name": ""}' and rows[1].profile is None


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a/b.md", "A"), ("c.md", "é")], "path string, content string")
    publish.write_documents(rows, f"file://{tmp_path}")
    publish.write_documents(rows, f"file://{tmp_path}")
    assert (tmp_path / "a/b.md").read_text() == "A" and (tmp_path / "c.md").read_text() == "é"
    sinks.remove_documents(spark.createDataFrame([("c.md",), ("c.md",)], "path string"), str(tmp_path))
    assert not (tmp_path / "c.md").exists()
    state = sinks.SyncState(str(tmp_path / "state.json"))
    state.adapter("x")["cursors"]["k"] = "v"
    assert state.adapter("y")["cursors"] == {}
    state.save("x", "now")
    assert sinks.SyncState(str(tmp_path / "state.json")).adapter("x") == {"lastSyncAt": "now", "cursors": {"k": "v"}, "metadata": {}}
    small, large = sinks.split_attachments(spark.createDataFrame([("a", 5), ("b", 50)], "name string, size long"), 10)
    assert small.count() == 1 and large.first().reason == "exceeds 10 bytes"
    text = sinks.format_results([{"score": 0.5, "age": "today", "index_name": "i", "file_path": "/r/f", "relative_path": "f", "content": "x\n" * 150, "section_context": "S", "result_type": "text"}], "q", 0)
    assert "[0.50 | today] i/f § S" in text and text.rstrip().endswith('..."') and sinks.format_results([], "q", 0) == 'No results found for "q".'


def test_trees_of_a_long_chain_and_of_a_wide_root(spark):
    chain = spark.range(1000).select(F.col("id").cast("string").alias("id"), F.when(F.col("id") > 0, (F.col("id") - 1).cast("string")).alias("parent"), F.lit("n").alias("name"))
    assert rollups.tree_paths(chain, "id", "parent", "name").agg(F.max("depth"), F.count("*")).first()[:] == (999, 1000)
    wide = spark.range(1_200_000).select(F.col("id").cast("string").alias("id"), F.when(F.col("id") > 0, F.lit("0")).alias("parent"), F.lit("n").alias("name"))
    assert rollups.tree_paths(wide, "id", "parent", "name").where("path = 'n/n' AND depth = 1").count() == 1_199_999


def test_channel_documents(spark):
    users = dumps.chat_users(spark.read.schema(dumps.CHAT_USER).json(spark.sparkContext.parallelize(['{"id": "U1", "name": "ann", "profile": {"display_name": "Ann"}}', '{"id": "U2", "name": "bob"}'])))
    lines = [{"id": "C1", "name": "general"}, {"id": "C2", "name": "Général"}, {"id": "C3", "name": "U1", "is_im": True}, {"id": "C4", "name": "mpdm-zed--ann-1", "is_mpim": True}, {"id": "C5", "name": "empty"}]
    rooms = dumps.chat_channels(spark.read.schema(dumps.CHAT_CHANNEL).json(spark.sparkContext.parallelize([json.dumps(x) for x in lines])))
    said = [
        {"ts": "1700000000.000100", "channel": "C1", "user": "U1", "text": "*hey* <@U2> <@U9>", "thread_ts": "1700000000.000100", "reactions": [{"name": "ok", "count": 2}, {"name": "no", "count": 1}]},
        {"ts": "1700000001.000100", "channel": "C1", "user": "U2", "text": "", "files": [{"id": "F", "name": "a.txt", "size": 10}]},
        {"ts": "1700000002.000100", "channel": "C1", "user": "U2", "text": "see", "files": [{"id": "F", "size": 10}]},
        {"ts": "1700000003.000100", "channel": "C1", "user": "U2", "text": "gone", "subtype": "message_deleted"},
        {"ts": "1700000004.000100", "channel": "C1", "bot_id": "B", "text": "  Deploying x"},
        {"ts": "1700100000.000100", "channel": "C1", "user": "U9", "text": "next day"},
    ]
    replies = [said[0], {"ts": "1700000009.000100", "channel": "C1", "user": "U2", "text": "a\nb", "thread_ts": "1700000000.000100"}]
    typed = lambda rows: channels.prepared(dumps.chat_messages(spark.read.schema(dumps.CHAT_MESSAGE).json(spark.sparkContext.parallelize([json.dumps(x) for x in rows]))), users, rooms)
    messages, answers = typed(said), typed(replies)
    page = {r.id: r.content for r in channels.pages(rooms, messages, answers).collect()}
    assert page["C5"] == "_No messages._\n" and page["C1"] == (
        "## 2023-11-14\n\n**Ann** (10:13 PM):\n**hey** @bob @U9\n[:ok: (2) :no: (1)]\n\n> **bob** (10:13 PM) [thread]:\n> a\n> b\n\n"
        "**bob** (10:13 PM):\nsee\n[File: untitled (10 B)]\n\n\n## 2023-11-16\n\n**unknown** (02:00 AM):\nnext day\n"
    )
    records = [json.loads(r.value) for r in channels.records(messages).orderBy("ts").collect()]
    assert len(records) == 5 and set(records[0]) == {"ts", "user", "userName", "text", "threadTs", "reactions", "files", "edited", "date"} and records[5 - 1]["edited"] is None
    thread = channels.thread_documents(rooms, answers, users, "now").first()
    assert (thread.started_by, thread.participants, thread.reply_count) == ("Ann", ["Ann", "bob"], 1)
    assert thread.body == "# Thread in #general\n\n**Ann** started this thread:\n\n**hey** @bob @U9\n\n---\n\n**bob** (2023-11-14 10:13 PM):\na\nb\n"
    assert {r.id: r.slug for r in channels.slugs(rooms, users).collect()} == {"C1": "general", "C2": "general--C2", "C3": "dm--ann", "C4": "mpim--ann--zed", "C5": "empty"}
    meta = {r.channelId: r for r in channels.summaries(rooms, messages, "now").collect()}
    assert (meta["C1"].messageCount, meta["C5"].messageCount, meta["C5"].oldestMessage) == (5, 0, None)


def test_rows_that_repeat_an_id_get_each_name_once(spark):
    from gleaner.operators import mail, rollups

    labels = spark.createDataFrame([("L1", "One"), ("L2", "Two"), ("L2", "Two")], "id string, name string")
    rows = spark.createDataFrame([("m", ["L1", "L9", None]), ("m", ["L1", "L9", None]), ("m", ["L2", "L1", "L2"]), (None, ["L1"]), ("n", []), ("o", None)], "id string, labelIds array<string>")
    got = sorted((repr(r.id), r.labels) for r in mail.named_labels(rows, labels).collect())
    assert got == [("'m'", ["One", "L9"]), ("'m'", ["One", "L9"]), ("'m'", ["Two", "One", "Two"]), ("'n'", []), ("'o'", []), ("None", ["One"])]
    nations = spark.createDataFrame([(1, "A"), (2, "B")], "k long, name string")
    twice = spark.createDataFrame([(7, [2, 1, 5]), (7, [2, 1, 5])], "row long, ids array<bigint>")
    assert [r.out for r in rollups.lookup_array(twice, nations, "row", "ids", "k", "name", "out").collect()] == [["B", "A"]] * 2
    assert [r.out for r in rollups.lookup_array(twice, nations, "row", "ids", "k", "name", "out", keep_missing=True).collect()] == [["B", "A", "5"]] * 2
    users = spark.createDataFrame([("u", "Ann")], "id string, displayName string")
    said = spark.createDataFrame([("i", [("u", "x")]), ("i", [("u", "x"), ("u", "y")])], "id string, comments array<struct<userId: string, body: string>>")
    assert [(r.id, r.names) for r in issues.comment_names(said, users).collect()] == [("i", {"u": "Ann"})]
