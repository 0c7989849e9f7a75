"""Chat messages: block layouts, mentions, markup, authors, and the rules of what is shown."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.text import is_blank, slugify, strip
from gleaner.runtime import materialise, private

# The subtypes of messages that a channel writes itself.
SYSTEM_SUBTYPES = (
    "channel_join", "channel_leave", "channel_topic", "channel_purpose", "channel_name", "channel_archive", "channel_unarchive", "pinned_item", "unpinned_item",
    "group_join", "group_leave", "group_topic", "group_purpose", "group_name", "group_archive", "group_unarchive",
)
# How bots' deploy notices begin.
_BOT_NOISE = r"(?i)^(DEPLOYING|BUILDING|DEPLOYED|SUCCESS|FAILED|ROLLING BACK)\b"

def _schema() -> str:
    plain = "type: string, text: string, url: string, name: string, user_id: string, usergroup_id: string, channel_id: string, `range`: string, style: struct<bold: boolean, italic: boolean, strike: boolean, code: boolean>"
    item = f"struct<{plain}, elements: array<struct<{plain}>>>"
    return f"array<struct<type: string, text: string, fields: array<string>, alt_text: string, elements: array<struct<type: string, text: string, alt_text: string, style: string, elements: array<{item}>>>>>"


def _filled(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def _or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _inline(e: Column) -> Column:
    said, style = _or_empty(e["text"]), e["style"]
    for flag, mark in (("code", "`"), ("bold", "**"), ("italic", "_"), ("strike", "~~")):
        said = F.when(style[flag], F.concat(F.lit(mark), said, F.lit(mark))).otherwise(said)
    link = F.when(_filled(e["text"]).isNotNull(), F.concat(F.lit("["), e["text"], F.lit("]("), _or_empty(e["url"]), F.lit(")"))).otherwise(_or_empty(e["url"]))
    framed = lambda a, c, b: F.concat(F.lit(a), _or_empty(c), F.lit(b))
    kind = e["type"]
    return (
        F.when(kind == "text", said).when(kind == "link", link).when(kind == "emoji", framed(":", e["name"], ":")).when(kind == "user", framed("<@", e["user_id"], ">"))
        .when(kind == "usergroup", framed("<!subteam^", e["usergroup_id"], ">")).when(kind == "channel", framed("<#", e["channel_id"], ">"))
        .when(kind == "broadcast", framed("<!", e["range"], ">")).otherwise(_or_empty(e["text"]))
    )


def _run(elements: Column) -> Column:
    """Inline elements one behind the other."""
    return F.array_join(F.transform(elements, _inline), "")


def _rich(e: Column) -> Column:
    kind, run = e["type"], _or_empty(_run(e["elements"]))
    item = lambda x, i: F.concat(F.when(e["style"] == "ordered", F.concat((i + 1).cast("string"), F.lit(". "))).otherwise("- "), _or_empty(_run(x["elements"])))
    return (
        F.when(kind == "rich_text_section", run).when(kind == "rich_text_list", _or_empty(F.array_join(F.transform(e["elements"], item), "\n")))
        .when(kind == "rich_text_quote", F.concat(F.lit("> "), F.replace(run, F.lit("\n"), F.lit("\n> ")))).when(kind == "rich_text_preformatted", F.concat(F.lit("```\n"), run, F.lit("\n```"))).otherwise("")
    )


def _text_object(c: Column) -> Column:
    """A text object's text, or the text itself."""
    return F.when(c.startswith("{"), _or_empty(F.get_json_object(c, "$.text"))).otherwise(_or_empty(c))


def _block(b: Column) -> Column:
    kind = b["type"]
    rich = _or_empty(F.array_join(F.transform(b["elements"], _rich), ""))
    lines = F.concat(F.when(b["text"].isNotNull(), F.array(_text_object(b["text"]))).otherwise(F.array().cast("array<string>")), F.coalesce(F.transform(b["fields"], _text_object), F.array().cast("array<string>")))
    context = F.array_join(F.transform(b["elements"], lambda e: F.when(e["type"] == "image", F.concat(F.lit("["), F.coalesce(e["alt_text"], F.lit("image")), F.lit("]"))).otherwise(_text_object(e["text"]))), " | ")
    return (
        F.when(kind == "rich_text", rich).when(kind == "section", F.array_join(lines, "\n")).when(kind == "header", F.concat(F.lit("### "), _text_object(b["text"])))
        .when(kind == "context", _or_empty(context)).when(kind == "divider", "---").when(kind == "image", F.concat(F.lit("[Image: "), F.coalesce(b["alt_text"], F.lit("image")), F.lit("]"))).otherwise("")
    )


def blocks_to_text(blocks_json: Column, fallback: Column) -> Column:
    """The text of a message's layout blocks, blank line between; the fallback where they say nothing."""
    parts = F.filter(F.transform(F.from_json(blocks_json, _schema()), _block), lambda t: t != "")
    return F.coalesce(_filled(F.array_join(parts, "\n\n")), fallback)


def _plain_mentions(c: Column) -> Column:
    """All angle-bracket forms that need no look-up."""
    # The forms of the message format.
    steps = (
        (r"<@[A-Z0-9]+\|([^>]+)>", "@$1"), (r"<#[A-Z0-9]+\|([^>]+)>", "#$1"), (r"<(https?://[^|>]+)\|([^>]+)>", "[$2]($1)"), (r"<(https?://[^|>]+)>", "$1"), (r"<mailto:[^|>]+\|([^>]+)>", "$1"), (r"<mailto:([^|>]+)>", "$1"),
        (r"<!(here|channel|everyone)>", "@$1"), (r"<!subteam\^[A-Z0-9]+\|([^>]+)>", "@$1"), (r"<!subteam\^[A-Z0-9]+>", "@group"),
    )
    return reduce(lambda x, s: F.regexp_replace(x, s[0], s[1]), steps, c)


def mention_ids(text: Column) -> Column:
    """The distinct `@id` and `#id` of a text's mentions that need a look-up."""
    return F.array_distinct(F.regexp_extract_all(_plain_mentions(text), F.lit("<([@#][A-Z0-9]+)>"), F.lit(1)))


def resolve_mentions(
    rows: DataFrame, text_col: str, users: DataFrame, user_id: str, user_names: list[str], channels: DataFrame | None = None, channel_id: str = "id", channel_name: str = "name"
) -> DataFrame:
    """`rows` with mentions in `text_col` as names; unknown ids stay as they are.

    A user is shown by the first filled of `user_names`. Only rows with a
    mention meet the dimensions: their ids are joined, and the names of a row
    come back as one small map, under a row number that no other row has.
    """
    names = users.select(F.concat(F.lit("@"), F.col(user_id)).alias("tag"), F.concat(F.lit("@"), F.coalesce(*(_filled(F.col(c)) for c in user_names), F.col(user_id))).alias("name"))
    if channels is not None:
        names = names.unionByName(channels.select(F.concat(F.lit("#"), F.col(channel_id)).alias("tag"), F.concat(F.lit("#"), F.coalesce(_filled(F.col(channel_name)), F.col(channel_id))).alias("name")))
    row, tags, tag, found, plain = private(rows, "row", "tags", "tag", "found", "plain")
    numbered = materialise(rows.withColumn(plain, _plain_mentions(F.col(text_col))).withColumn(tags, mention_ids(F.col(text_col))).withColumn(row, F.monotonically_increasing_id()), "mentions")
    pairs = numbered.where(F.size(tags) > 0).select(row, F.explode(tags).alias(tag))
    known = pairs.join(names.dropDuplicates(["tag"]), F.col(tag) == F.col("tag"))
    known = known.groupBy(row).agg(F.map_from_entries(F.collect_list(F.struct(tag, "name"))).alias(found))
    joined = numbered.join(known, row, "left")
    # Texts are cut before and behind each tag; the cuts keep every character.
    pieces = F.split(F.col(plain), r"(?=<[@#][A-Z0-9]+>)|(?<=<[@#][A-Z0-9]{1,40}>)")
    bare = lambda p: F.regexp_extract(p, r"\A<([@#][A-Z0-9]+)>\z", 1)
    said = F.transform(pieces, lambda p: F.when(bare(p) == "", p).otherwise(F.coalesce(F.try_element_at(F.col(found), bare(p)), bare(p))))
    whole = F.when(F.size(tags) > 0, F.array_join(said, "")).otherwise(F.col(plain))
    return joined.select(*(whole.alias(c) if c == text_col else F.col(f"`{c}`") for c in rows.columns))


def render_messages(messages: DataFrame, users: DataFrame, channels: DataFrame, out: str = "said") -> DataFrame:
    """`messages` with `out`: what each says as Markdown, from its blocks or else its text, with mentions as names."""
    said = messages.withColumn(out, blocks_to_text(F.col("blocks"), F.coalesce("text", F.lit(""))))
    named = resolve_mentions(said, out, users, "id", ["displayName", "name"], channels)
    return named.withColumn(out, to_markdown(F.col(out)))


def to_markdown(c: Column) -> Column:
    """Single-mark bold and strike-through as Markdown's double marks, within a line."""
    bold = F.regexp_replace(c, r"(?<!\*)\*([^*\n]+)\*(?!\*)", "**$1**")
    return F.regexp_replace(bold, r"(?<!~)~([^~\n]+)~(?!~)", "~~$1~~")


def author_name(display_name: Column, real_name: Column, bot_profile: Column, username: Column, bot_id: Column, name: Column | None = None) -> Column:
    """The first filled of a user's names, a bot's profile, a user name, a bot's id; else `unknown`."""
    names = [display_name, real_name, *([name] if name is not None else []), bot_profile, username]
    return F.coalesce(*(_filled(n) for n in names), F.concat(F.lit("bot:"), _filled(bot_id)), F.lit("unknown"))


def is_system(subtype: Column) -> Column:
    return F.coalesce(subtype.isin(*SYSTEM_SUBTYPES), F.lit(False))


def render_system(subtype: Column, author: Column, text: Column) -> Column:
    """A channel's own message as one line in italics."""
    line = lambda *parts: F.concat(F.lit("_"), *(F.lit(p) if isinstance(p, str) else p for p in parts), F.lit("_"))
    return (
        F.when(subtype.isin("channel_join", "group_join"), line(author, " joined the channel")).when(subtype.isin("channel_leave", "group_leave"), line(author, " left the channel"))
        .when(subtype.isin("channel_topic", "group_topic"), line(author, " set the channel topic: ", text)).when(subtype.isin("channel_purpose", "group_purpose"), line(author, " set the channel purpose: ", text))
        .when(subtype == "pinned_item", line(author, " pinned a message")).otherwise(line(subtype, ": ", text))
    )


def should_skip(subtype: Column, text: Column, has_files: Column, is_bot: Column) -> Column:
    """Whether a message is left out of a channel's page: system and deleted ones, bare uploads, and bots' deploy notices."""
    said = F.coalesce(text, F.lit(""))
    noise = is_system(subtype) | is_deleted(subtype) | (has_files & is_blank(said)) | (is_bot & strip(said).rlike(_BOT_NOISE))
    return F.coalesce(noise, F.lit(False))


def is_deleted(subtype: Column) -> Column:
    return F.coalesce(subtype == "message_deleted", F.lit(False))


def is_thread_parent(ts: Column, thread_ts: Column, reply_count: Column) -> Column:
    return (F.coalesce(reply_count, F.lit(0)) > 0) & (ts == F.coalesce(thread_ts, ts))


def seconds(ts: Column) -> Column:
    return ts.try_cast("double")


def iso_time(ts: Column) -> Column:
    at = F.timestamp_millis(F.floor(seconds(ts) * 1000).cast("long"))
    return F.coalesce(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), ts)


def clock_time(ts: Column) -> Column:
    return F.coalesce(F.date_format(F.timestamp_seconds(seconds(ts)), "hh:mm a"), ts)


def date_group(ts: Column) -> Column:
    return F.coalesce(F.date_format(F.timestamp_seconds(seconds(ts)), "yyyy-MM-dd"), ts)


def channel_slug(kind: Column, id_: Column, name: Column, partner: Column) -> Column:
    """A channel's slug before collisions: `dm--` and the partner's name, `mpim--` and the members' sorted names, or its own name."""
    own = F.coalesce(_filled(name), id_)
    members = F.array_sort(F.filter(F.transform(F.split(F.regexp_extract(own, r"\Ampdm-(.*)-\d+\z", 1), "--"), lambda m: slugify(m)), lambda m: m != ""))
    group = F.when(own.rlike(r"\Ampdm-.+-\d+\z"), F.array_join(members, "--")).otherwise(slugify(own))
    alone = slugify(F.coalesce(_filled(partner), own))
    return F.when(kind == "im", F.concat(F.lit("dm--"), alone)).when(kind == "mpim", F.concat(F.lit("mpim--"), group)).otherwise(slugify(own))
