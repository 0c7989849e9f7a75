"""Mail records: message documents with their sidecars, labels, drafts, and the change log of a history feed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.text import sanitize_filename
from gleaner.operators.rollups import names_of

#: A record of a mailbox's history feed.
_MOVED = "array<struct<message: struct<id: string>>>"
_LABELLED = "array<struct<message: struct<id: string>, labelIds: array<string>>>"
HISTORY = f"id string, messagesAdded {_MOVED}, messagesDeleted {_MOVED}, labelsAdded {_LABELLED}, labelsRemoved {_LABELLED}"
DRAFT = "DRAFT"


def without_drafts(messages: DataFrame, include: bool = False) -> DataFrame:
    """Messages that are no drafts, unless drafts are wanted."""
    return messages if include else messages.where(~F.coalesce(F.array_contains("labelIds", DRAFT), F.lit(False)))


def named_labels(messages: DataFrame, labels: DataFrame, out: str = "labels") -> DataFrame:
    """`messages` (id, labelIds, ...) with the names of their labels in order; a label without a name stays as its id."""
    names = labels.select("id", "name").dropDuplicates(["id"])
    return names_of(messages, "labelIds", names, out, keep_missing=True).withColumn(out, F.coalesce(out, F.array().cast("array<string>")))


def _filled(c: str) -> Column:
    return F.nullif(F.col(c), F.lit(""))


def message_documents(messages: DataFrame) -> DataFrame:
    """(path, frontmatter, body, sidecar) of messages with named labels; attachments are linked below the body."""
    link = lambda a: F.concat(F.lit("- ["), a["filename"], F.lit("](../attachments/"), F.col("id"), F.lit("/"), sanitize_filename(a["filename"]), F.lit(") ("), F.format_string("%.1f", a["size"] / 1024), F.lit(" KB)"))
    links = F.concat(F.lit("\n\nAttachments:\n"), F.array_join(F.transform("attachments", link), "\n"))
    head = F.struct("id", F.col("threadId").alias("thread_id"), "date", "from", "to", "subject", "labels", _filled("cc").alias("cc"), _filled("bcc").alias("bcc"))
    files = F.transform("attachments", lambda a: F.struct(a["filename"].alias("filename"), a["mimeType"].alias("mimeType"), a["size"].alias("size")))
    side = F.struct(
        "id", "threadId", "historyId", "internalDate", "from", "to", "subject", "messageId", "labelIds", "labels", "sizeEstimate", F.coalesce(files, F.array()).alias("attachments"),
        _filled("cc").alias("cc"), _filled("bcc").alias("bcc"), _filled("inReplyTo").alias("inReplyTo"), _filled("references").alias("references"),
    )
    return messages.select(
        F.concat(F.lit("messages/"), "id", F.lit(".md")).alias("path"), F.to_json(head).alias("frontmatter"),
        F.concat("body", F.when(F.size("attachments") > 0, links).otherwise("")).alias("body"), F.to_json(side).alias("sidecar"),
    )


def cli_message_documents(messages: DataFrame) -> DataFrame:
    """(path, frontmatter, body) of messages as the command-line mail reader gives them; empty values are left out."""
    head = F.struct("id", _filled("threadId").alias("threadId"), *(_filled(c).alias(c) for c in ("from", "to", "cc", "bcc", "date", "subject")), "labels", "sizeEstimate", _filled("historyId").alias("historyId"))
    return messages.select(F.concat(F.lit("messages/"), "id", F.lit(".md")).alias("path"), F.to_json(head).alias("frontmatter"), F.coalesce(_filled("body"), F.lit("(no body)")).alias("body"))


def history_changes(records: DataFrame, both: str = "deleted") -> DataFrame:
    """(id, op) of messages that a history feed added or deleted, each once.

    A message that it added and deleted is `deleted`, or with both='skipped'
    left out on either side, as the command-line reader does.
    """
    ids = lambda c, op: records.select(F.explode(c).alias("x")).select(F.col("x.message.id").alias("id"), F.lit(op).alias("op")).where("id IS NOT NULL")
    moved = ids("messagesAdded", "added").unionByName(ids("messagesDeleted", "deleted"))
    found = moved.groupBy("id").agg(F.max((F.col("op") == "added").cast("int")).alias("a"), F.max((F.col("op") == "deleted").cast("int")).alias("d"))
    if both == "skipped":
        found = found.where("a + d < 2")
    return found.select("id", F.when(F.col("d") == 1, "deleted").otherwise("added").alias("op"))


def label_log(records: DataFrame, order: str = "id") -> DataFrame:
    """(id, added, removed): all label ids that a history feed added to and removed from each message, in order of its numbers."""
    at = F.col(order).cast("decimal(38,0)").alias("at")
    parts = lambda c, new: records.select(at, F.posexplode(c).alias("n", "x")).select("at", "n", F.col("x.message.id").alias("id"), F.col("x.labelIds").alias(new))
    both = parts("labelsAdded", "plus").withColumn("minus", F.lit(None).cast("array<string>")).unionByName(parts("labelsRemoved", "minus").withColumn("plus", F.lit(None).cast("array<string>")))
    groups = both.where("id IS NOT NULL AND coalesce(plus, minus) IS NOT NULL").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("at", "n", "plus", "minus"))).alias("items"))
    gathered = lambda c: F.flatten(F.filter(F.transform("items", lambda x: x[c]), lambda v: v.isNotNull()))
    return groups.select("id", gathered("plus").alias("added"), gathered("minus").alias("removed"))


def history_mark(records: DataFrame) -> DataFrame:
    """(history_id): the newest number of a feed, by value and not by text."""
    return records.agg(F.max(F.col("id").cast("decimal(38,0)")).cast("string").alias("history_id"))
