"""Channel exports: pages, records, summaries and thread documents of chat channels, and their indexes.

Inputs are typed as `sources.dumps` types them. What is asked of a single message
is made in its row; a page or thread document is gathered in order only where
it becomes one text, and `page_lines` gives a channel of any size as sorted rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions import chat
from gleaner.functions.text import format_bytes
from gleaner.operators.ranking import previous
from gleaner.operators.rollups import collision_suffix, ordered

NO_MESSAGES = "_No messages._\n"


def prepared(messages: DataFrame, users: DataFrame, channels: DataFrame) -> DataFrame:
    """`messages` with what is shown of them: author, said, time, day."""
    said = chat.render_messages(messages, users, channels)
    names = users.select(F.col("id").alias("_user"), "displayName", "realName", F.col("name").alias("_name")).dropDuplicates(["_user"])
    joined = said.join(names, F.col("userId") == F.col("_user"), "left")
    author = chat.author_name(F.col("displayName"), F.col("realName"), F.col("botProfile.name"), F.col("username"), F.col("botId"), F.col("_name"))
    shown = joined.withColumn("author", author).withColumn("time", chat.clock_time(F.col("ts"))).withColumn("day", chat.date_group(F.col("ts")))
    return shown.drop("_user", "displayName", "realName", "_name")


def _reactions(c: Column) -> Column:
    shown = F.array_join(F.transform(c, lambda r: F.concat(F.lit(":"), r["name"], F.lit(": ("), r["count"].cast("string"), F.lit(")"))), " ")
    return F.when(F.size(c) > 0, F.array(F.concat(F.lit("["), shown, F.lit("]")))).otherwise(F.array().cast("array<string>"))


def _files(c: Column) -> Column:
    shown = F.transform(c, lambda f: F.concat(F.lit("[File: "), f["name"], F.lit(" ("), format_bytes(f["size"]), F.lit(")]")))
    return F.coalesce(shown, F.array().cast("array<string>"))


def _said(author: Column, time: Column) -> Column:
    return F.concat(F.lit("**"), author, F.lit("** ("), time, F.lit(")"))


def _participants(items: Column) -> Column:
    """The names of a thread's users, each user once, in the order in which they first wrote."""
    users = F.array_distinct(F.transform(F.filter(items, lambda x: x["who"].isNotNull()), lambda x: F.struct(x["userId"].alias("id"), x["who"].alias("who"))))
    return F.transform(users, lambda u: u["who"])


def _reply_lines(replies: DataFrame) -> DataFrame:
    """(channelId, ts of the parent, quoted): the lines of each thread as a message's page quotes them."""
    line = F.concat(F.lit("> "), _said(F.col("author"), F.col("time")), F.lit(" [thread]:\n> "), F.replace(F.col("said"), F.lit("\n"), F.lit("\n> ")))
    rows = replies.select("channelId", "threadTs", "ts", F.when(F.col("ts") != F.col("threadTs"), line).alias("line"))
    groups = ordered(rows, ["channelId", "threadTs"], ["ts"], ["line"])
    lines = F.filter(F.transform("items", lambda x: x["line"]), lambda x: x.isNotNull())
    return groups.select("channelId", F.col("threadTs").alias("ts"), F.concat(F.array(F.lit("")), lines).alias("quoted"))


def page_lines(messages: DataFrame, replies: DataFrame) -> DataFrame:
    """(channelId, ts, lines): what a channel's page says for each shown message, headed where a new day begins.

    `messages` and `replies` are as `prepared` makes them; joined by a line
    break in order of ts, the lines of a channel are its page.
    """
    skip = chat.should_skip(F.col("subtype"), F.col("text"), F.size("files") > 0, F.col("botId").isNotNull() | F.col("botProfile").isNotNull())
    rows = messages.where(~skip).join(_reply_lines(replies), ["channelId", "ts"], "left")
    rows, before = previous(rows, ["channelId"], ["ts"], F.col("day"), "_day_before"), F.col("_day_before")
    head = F.when(before.isNull(), F.array(F.concat(F.lit("## "), "day"), F.lit(""))).when(before != F.col("day"), F.array(F.lit(""), F.concat(F.lit("## "), "day"), F.lit("")))
    none = F.array().cast("array<string>")
    own = F.array(F.concat(_said(F.col("author"), F.col("time")), F.lit(":")), F.col("said"))
    parts = F.concat(F.coalesce(head, none), own, _reactions(F.col("reactions")), _files(F.col("files")), F.coalesce("quoted", none), F.array(F.lit("")))
    return rows.select("channelId", "ts", F.array_join(parts, "\n").alias("lines"))


def pages(channels: DataFrame, messages: DataFrame, replies: DataFrame) -> DataFrame:
    """(id, content) of each channel's page; one without messages says so."""
    lines = ordered(page_lines(messages, replies), ["channelId"], ["ts"], ["lines"])
    body = lines.select(F.col("channelId").alias("id"), F.array_join(F.transform("items", lambda x: x["lines"]), "\n").alias("content"))
    some = messages.select(F.col("channelId").alias("id"), F.lit("").alias("bare")).distinct()
    return channels.select("id").join(body, "id", "left").join(some, "id", "left").select("id", F.coalesce("content", "bare", F.lit(NO_MESSAGES)).alias("content"))


def records(messages: DataFrame) -> DataFrame:
    """(channelId, ts, value): a JSON text for each message that was not deleted."""
    files = F.coalesce(F.transform("files", lambda f: F.struct(f["id"].alias("id"), f["name"].alias("name"), f["mimetype"].alias("mimetype"), f["size"].alias("size"))), F.array())
    fields = F.struct(
        "ts", F.col("userId").alias("user"), F.col("author").alias("userName"), F.col("said").alias("text"), "threadTs", F.coalesce("reactions", F.array()).alias("reactions"),
        files.alias("files"), "edited", chat.iso_time(F.col("ts")).alias("date"),
    )
    kept = messages.where(~chat.is_deleted(F.col("subtype")))
    return kept.select("channelId", "ts", F.to_json(fields, {"ignoreNullFields": "false"}).alias("value"))


def summaries(channels: DataFrame, messages: DataFrame, now_iso: str) -> DataFrame:
    """One row for each channel: what it is, how many messages it has, and when the first and last were sent."""
    kept = messages.where(~chat.is_deleted(F.col("subtype")))
    counted = kept.groupBy(F.col("channelId").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    return channels.join(counted, "id", "left").select(
        F.col("id").alias("channelId"), F.col("name").alias("channelName"), "type", "topic", "purpose", "memberCount", F.coalesce("n", F.lit(0)).cast("long").alias("messageCount"),
        chat.iso_time(F.col("first")).alias("oldestMessage"), chat.iso_time(F.col("last")).alias("newestMessage"), F.lit(now_iso).alias("lastSyncAt"),
    )


def thread_documents(channels: DataFrame, replies: DataFrame, users: DataFrame, now_iso: str) -> DataFrame:
    """A row for each thread: its head (thread_ts, channel, started_by, participants, reply_count, ...) and body.

    `replies` are as `prepared` makes them and hold the parent, if it is known,
    as the first; nothing is filtered.
    """
    shown = users.select(F.col("id").alias("userId"), F.coalesce(F.nullif("displayName", F.lit("")), F.col("name")).alias("shown")).dropDuplicates(["userId"])
    rows = replies.join(shown, "userId", "left").withColumn("who", F.nullif(F.coalesce("shown", "userId"), F.lit("")))
    when = F.concat("day", F.lit(" "), "time")
    block = F.concat_ws("\n", F.concat(_said(F.col("author"), when), F.lit(":")), "said", F.array_join(_reactions(F.col("reactions")), "\n"), F.lit(""))
    plain = F.concat_ws("\n", F.concat(_said(F.col("author"), when), F.lit(":")), "said", F.lit(""))
    rows = rows.withColumn("line", F.when(F.col("ts") != F.col("threadTs"), F.when(F.size("reactions") > 0, block).otherwise(plain)))
    groups = ordered(rows, ["channelId", "threadTs"], ["ts"], ["author", "said", "userId", "who", "line"])
    first = F.get("items", F.lit(0))
    name = F.coalesce(F.nullif("name", F.lit("")), F.col("id"))
    lines = F.filter(F.transform("items", lambda x: x["line"]), lambda x: x.isNotNull())
    top = F.array(F.concat(F.lit("# Thread in #"), name), F.lit(""), F.concat(F.lit("**"), first["author"], F.lit("** started this thread:")), F.lit(""))
    opening = F.when(first["said"] != "", F.array(first["said"], F.lit(""))).otherwise(F.array().cast("array<string>"))
    body = F.array_join(F.concat(top, opening, F.array(F.lit("---"), F.lit("")), lines), "\n")
    return groups.join(channels.select("id", "name"), F.col("channelId") == F.col("id")).select(
        F.col("threadTs").alias("thread_ts"), name.alias("channel"), F.col("id").alias("channel_id"), first["author"].alias("started_by"),
        _participants(F.col("items")).alias("participants"), (F.size("items") - 1).cast("long").alias("reply_count"),
        chat.iso_time(F.col("threadTs")).alias("started_at"), F.lit(now_iso).alias("exported_at"), body.alias("body"),
    )


def slugs(channels: DataFrame, users: DataFrame) -> DataFrame:
    """(id, slug) of each channel; of channels with one slug all but the first by id carry their id too."""
    partner = users.select(F.col("id").alias("_user"), F.coalesce(F.nullif("name", F.lit("")), F.col("displayName")).alias("_partner")).dropDuplicates(["_user"])
    joined = channels.join(partner, F.coalesce(F.nullif("name", F.lit("")), F.col("id")) == F.col("_user"), "left")
    own = joined.select("id", chat.channel_slug(F.col("type"), F.col("id"), F.col("name"), F.col("_partner")).alias("own"))
    return collision_suffix(own, "own", "id", "slug").select("id", "slug")


def users_index(users: DataFrame) -> DataFrame:
    """What is listed of users."""
    return users.select("id", "name", "realName", "displayName", "email", "isBot", "isDeleted")


def channels_index(channels: DataFrame, slug: DataFrame) -> DataFrame:
    """What is listed of channels, with their slugs."""
    return channels.join(slug, "id", "left").select("id", "name", "type", F.coalesce("slug", "name").alias("slug"), "topic", "purpose", "memberCount", "isArchived")
