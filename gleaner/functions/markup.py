"""HTML and mail bodies: stripping tags, quoted replies, message blocks of rendered threads."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner.functions.text import BLANK, LEAST, TARGET, let, paragraph_chunks, strip, trim

_BLOCKS = "p|div|h[1-6]|li|tr|blockquote"
# The entities that are decoded, in the order in which they are.
_ENTITIES = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "))


def _chain(c: Column, *steps: tuple[str, str]) -> Column:
    return reduce(lambda x, s: F.regexp_replace(x, s[0], s[1]), steps, c)


def _numeric_entities(c: Column) -> Column:
    """&#n; as the UTF-16 unit n; the references are found once and replaced one by one."""
    codes = F.array_distinct(F.regexp_extract_all(c, F.lit(r"&#(\d+);"), F.lit(1)))
    unit = lambda n: F.decode(F.unhex(F.lpad(F.hex((n.cast("decimal(38,0)") % 65536).cast("int")), 4, "0")), "UTF-16BE")
    return F.when(c.contains("&#"), F.aggregate(codes, c, lambda acc, n: F.replace(acc, F.concat(F.lit("&#"), n, F.lit(";")), unit(n)))).otherwise(c)


def strip_html(c: Column) -> Column:
    """The text of an HTML fragment: no comments, styles and scripts; line ends for breaks and blocks; entities decoded once."""
    plain = _chain(
        c, (r"(?s)<!--.*?-->", ""), (r"(?is)<(style|script)[^>]*>.*?</\1>", ""), (r"(?i)<br\s*/?>", "\n"), (rf"(?i)</({_BLOCKS})>", "\n"), (r"<[^>]+>", ""), *_ENTITIES,
    )
    decoded = _chain(_numeric_entities(plain), (r"&\w+;", ""), (r"[ \t]+", " "), (r"\n[ \t]+", "\n"), (r"\n{3,}", "\n\n"))
    return strip(decoded)


def is_html(c: Column) -> Column:
    return c.rlike(r"(?i)<(!DOCTYPE|html|head|body|div|span|table|a\s|br|img)\b")


def remove_quoted_replies(c: Column) -> Column:
    """Lines before the first `On ... wrote:`, without those that are quoted by `>`."""
    def before_stop(lines: Column) -> Column:
        flags = F.transform(lines, lambda x: x.rlike(rf"(?i)\A[{BLANK}]*On .+wrote:[{BLANK}]*\z"))
        return let(F.array_position(flags, True), lambda stop: strip(F.array_join(F.when(stop > 0, F.slice(lines, F.lit(1), (stop - 1).cast("int"))).otherwise(lines), "\n")))

    return let(F.filter(F.split(c, "\n"), lambda x: ~x.rlike(rf"\A[{BLANK}]*>")), before_stop)


def thread_messages(body: Column) -> Column:
    """The blocks of a rendered thread that begin with a sender."""
    parts = F.transform(F.split(body, r"\n---\n(?=\*\*From:\*\*)"), strip)
    return F.filter(parts, lambda p: p.startswith("**From:**"))


def message_block(block: Column) -> Column:
    """struct(from, date, subject, body) of one block of a thread."""
    field = lambda k: strip(F.regexp_extract(block, rf"\*\*{k}:\*\*\s*([^\n\r]+)", 1))
    body = strip(F.regexp_replace(block, r"\A(?:[ \t]*\*\*\w[^\n]*(?:\n|\z))+", ""))
    return F.struct(field("From").alias("from"), field("Date").alias("date"), field("Subject").alias("subject"), body.alias("body"))


def message_context(subject: Column, sender: Column, date: Column) -> Column:
    context = F.concat_ws(" § ", F.nullif(subject, F.lit("")), F.nullif(sender, F.lit("")))
    return F.when(F.coalesce(date, F.lit("")) != "", F.concat(context, F.lit(" @ "), date)).otherwise(context)


def message_chunks(body: Column, subject: Column, sender: Column, date: Column) -> Column:
    """array<struct<content, section_context>> of one mail; parts of a long one are numbered before short ones are dropped."""
    made = lambda ctx, text: F.struct(F.concat(F.lit("["), ctx, F.lit("]\n"), text).alias("content"), ctx.alias("section_context"))

    def numbered(context: Column, parts: Column) -> Column:
        many = F.size(parts) > 1
        named = F.transform(parts, lambda p, i: F.struct(p.alias("text"), F.when(many, F.concat(context, F.lit(" (part "), (i + 1).cast("string"), F.lit(")"))).otherwise(context).alias("context")))
        return F.transform(F.filter(named, lambda x: F.length(trim(x["text"])) >= LEAST), lambda x: made(x["context"], x["text"]))

    def cut(m: Column) -> Column:
        none = F.filter(F.array(made(m["context"], m["clean"])), lambda x: F.lit(False))
        size = F.length(m["clean"])
        return F.when(size < LEAST, none).when(size <= TARGET, F.array(made(m["context"], m["clean"]))).otherwise(let(paragraph_chunks(m["clean"]), lambda parts: numbered(m["context"], parts)))

    clean = let(body, lambda b: remove_quoted_replies(F.when(is_html(b), strip_html(b)).otherwise(b)))
    return let(F.struct(clean.alias("clean"), message_context(subject, sender, date).alias("context")), cut)


def mail_format(metadata: Column) -> Column:
    """'thread', 'message' or null by the fields of a document's JSON metadata."""
    field = lambda k: F.nullif(F.get_json_object(metadata, f"$.{k}"), F.lit(""))
    number = F.get_json_object(metadata, "$.messageCount").rlike(r"\A-?\d+(\.\d+)?\z") & ~metadata.rlike(r'"messageCount"\s*:\s*"')
    return F.when(field("threadId").isNotNull() & number, "thread").when(field("id").isNotNull() & field("threadId").isNotNull(), "message")
