"""Text-processing column functions of the document ETL (sections, paragraphs, sentences, slugs, hashes).

All are built-in expressions. Where the semantics name white space, the class
includes the no-break space and the byte-order mark.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

TARGET, MOST, OVERLAP, LEAST = 1500, 2000, 200, 80

BLANK = r"\s\x0B\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
_INLINE = r"[^\n\r\u2028\u2029]"
_HEADING = rf"#{{1,4}}(?:(?!\n)[{BLANK}])+{_INLINE}+(?=\n|\z)"
_strings = "array<string>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once for a row, however often it is named."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    """Both ends without white space of any kind."""
    return F.regexp_replace(c, rf"\A[{BLANK}]+|[{BLANK}]+\z", "")


def is_blank(c: Column) -> Column:
    """Whether there is white space only; looks no further than the first other character."""
    return ~c.rlike(rf"[^{BLANK}]")


def frontmatter_parts(raw: Column) -> Column:
    """struct(yaml, body): the text between fences at the very start and what follows; yaml is null without fences."""
    pattern = r"(?s)\A---\r?\n(.*?)\r?\n---\r?\n?(.*)\z"
    fenced = raw.rlike(pattern)
    return F.struct(F.when(fenced, F.regexp_extract(raw, pattern, 1)).alias("yaml"), F.when(fenced, F.regexp_extract(raw, pattern, 2)).otherwise(raw).alias("body"))


def title(metadata: Column, body: Column) -> Column:
    """The title of a document: the first filled of title, name, subject, identifier in its JSON metadata, else its first level-1 heading."""
    field = lambda k: F.nullif(F.get_json_object(metadata, f"$.{k}"), F.lit(""))
    identifier = field("identifier")
    empty_title = F.get_json_object(metadata, "$.title") == ""
    named = F.when(identifier.isNotNull() & empty_title, F.concat(identifier, F.lit(": "))).otherwise(identifier)
    heading = F.regexp_extract(body, rf"(?m)^#[{BLANK}]+({_INLINE}+)$", 1)
    return F.coalesce(field("title"), field("name"), field("subject"), named, F.when(body.rlike(rf"(?m)^#[{BLANK}]+{_INLINE}"), strip(heading)))


def sections(body: Column) -> Column:
    """array<struct<heading, content>>: the body cut before each heading of level 1 to 4; sections without content are dropped."""
    parts = F.split(body, rf"\n(?={_HEADING})")

    def section(part: Column) -> Column:
        headed = part.rlike(rf"\A{_HEADING}")
        rest = F.when(F.instr(part, "\n") > 0, F.regexp_replace(part, r"\A[^\n]*\n", "")).otherwise("")
        return F.struct(
            F.when(headed, strip(F.regexp_extract(part, rf"\A#{{1,4}}[{BLANK}]+({_INLINE}+)", 1))).alias("heading"),
            let(F.when(headed, rest).otherwise(part), trim).alias("content"),
        )

    return F.filter(F.transform(parts, section), lambda s: s["content"] != "")


def sentences(text: Column) -> Column:
    """Pieces after closing punctuation and white space; blank ones are dropped."""
    return F.filter(F.split(text, rf"(?<=[.!?])[{BLANK}]+"), lambda s: ~is_blank(s))


def _state(out: Column, buffer: Column) -> Column:
    return F.struct(out.alias("out"), buffer.alias("buffer"))


def _emit(out: Column, buffer: Column) -> Column:
    return F.when(is_blank(buffer), out).otherwise(F.concat(out, F.array(trim(buffer))))


def trim(c: Column) -> Column:
    """`strip` of a value that has a name: the whole is searched only where an end is white space."""
    return F.when(F.concat(F.left(c, F.lit(1)), F.right(c, F.lit(1))).rlike(f"[{BLANK}]"), strip(c)).otherwise(c)


def sentence_chunks(text: Column) -> Column:
    """Sentences merged up to TARGET; a full chunk's last OVERLAP characters begin the next one."""

    def step(acc: Column, s: Column) -> Column:
        out, buffer = acc["out"], acc["buffer"]
        full = (F.length(buffer) + F.length(s) > TARGET) & ~is_blank(buffer)
        return F.when(full, _state(F.concat(out, F.array(trim(buffer))), F.concat(F.right(buffer, F.lit(OVERLAP)), s))).otherwise(
            _state(out, F.concat(buffer, F.when(buffer == "", "").otherwise(" "), s))
        )

    start = _state(F.array().cast(_strings), F.lit(""))
    return F.aggregate(sentences(text), start, step, lambda acc: _emit(acc["out"], acc["buffer"]))


def paragraph_chunks(text: Column) -> Column:
    """Paragraphs merged up to TARGET; those over MOST are cut at sentences, with overlap."""
    paragraphs = F.filter(F.split(text, r"\n\n+"), lambda p: ~is_blank(p))

    def step(acc: Column, p: Column) -> Column:
        out, buffer = acc["out"], acc["buffer"]
        huge = _state(F.concat(_emit(out, buffer), sentence_chunks(p)), F.lit(""))
        # A blank buffer before a huge paragraph is kept as it is; it is empty in every reachable state.
        full = _state(_emit(out, buffer), p)
        more = _state(out, F.concat(buffer, F.when(buffer == "", "").otherwise("\n\n"), p))
        return F.when(F.length(p) > MOST, huge).when(F.length(buffer) + F.length(p) + 2 > TARGET, full).otherwise(more)

    start = _state(F.array().cast(_strings), F.lit(""))
    return F.aggregate(paragraphs, start, step, lambda acc: _emit(acc["out"], acc["buffer"]))


def document_chunks(title_: Column, body: Column) -> Column:
    """array<struct<content, section_context>> of a document; short chunks are dropped, the rest carry their context in brackets."""

    def of_section(name: Column, s: Column) -> Column:
        context = F.nullif(F.concat_ws(" § ", F.nullif(name, F.lit("")), F.nullif(s["heading"], F.lit(""))), F.lit(""))
        kept = F.filter(paragraph_chunks(s["content"]), lambda c: F.length(trim(c)) >= LEAST)
        made = lambda ctx: F.transform(kept, lambda c: F.struct(F.concat(F.coalesce(F.concat(F.lit("["), ctx, F.lit("] ")), F.lit("")), c).alias("content"), ctx.alias("section_context")))
        return let(context, made)

    return let(F.struct(title_.alias("title"), body.alias("body")), lambda d: F.flatten(F.transform(sections(d["body"]), lambda s: of_section(d["title"], s))))


def sha256(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def chunk_hash(content: Column, model: str) -> Column:
    """The key of the embedding cache: content and model, with a zero between."""
    return F.sha2(F.concat(content, F.lit("\0"), F.lit(model)).cast("binary"), 256)


def _plain_letters() -> tuple[str, str]:
    """All characters that decompose into one letter or digit and combining marks, and what they decompose into."""
    marked, plain = [], []
    for code in range(0x80, 0x30000):
        parts = unicodedata.normalize("NFD", chr(code))
        rest = [c for c in parts if not 0x300 <= ord(c) <= 0x36F]
        if len(parts) > 1 and len(rest) == 1 and rest[0].isalnum():
            marked.append(chr(code))
            plain.append(rest[0])
    return "".join(marked), "".join(plain)


_MARKED, _PLAIN = _plain_letters()


def unmarked(c: Column) -> Column:
    """Letters without their marks; combining marks are dropped."""
    return F.regexp_replace(F.translate(c, _MARKED, _PLAIN), r"[\u0300-\u036F]", "")


def slugify(text: Column, most: int | Column = 80) -> Column:
    plain = F.regexp_replace(F.regexp_replace(unmarked(F.lower(text)), rf"[{BLANK}_]+", "-"), r"[^a-z0-9-]", "")
    slug = F.regexp_replace(F.regexp_replace(plain, "-+", "-"), r"\A-|-\z", "")
    return F.regexp_replace(F.substring(slug, F.lit(1), F.lit(most) if isinstance(most, int) else most), r"-+\z", "")


def unique_slug(text: Column, id_: Column, most: int = 80) -> Column:
    """A slug with the first eight characters of the id, which stay whole."""
    short = F.substring(F.regexp_replace(id_, "-", ""), 1, 8)
    slug = slugify(text, F.lit(most - 1) - F.length(short))
    return F.when(slug == "", short).otherwise(F.concat_ws("-", slug, short))


def sanitize_filename(name: Column, most: int = 200) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(name, r'[/\\:*?"<>|]', "_"), rf"[{BLANK}]+", "_"), 1, most)


def relative_path(root: Column, path: Column) -> Column:
    """`path` below `root`; unchanged if it lies elsewhere."""
    prefix = F.concat(F.regexp_replace(root, r"/+\z", ""), F.lit("/"))
    return F.when(F.startswith(path, prefix), F.substr(path, F.length(prefix) + 1)).otherwise(path)


def format_bytes(n: Column) -> Column:
    return F.when(n < 1024, F.format_string("%d B", n)).when(n < 1048576, F.format_string("%.1f KB", n / 1024)).otherwise(F.format_string("%.1f MB", n / 1048576))
