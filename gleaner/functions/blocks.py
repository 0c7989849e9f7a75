"""Block-structured pages: rich text, block trees and typed properties as Markdown.

Trees are recursive, so a page is rendered in one Python call on its blocks,
which Arrow hands over; a page is the unit of work and its blocks are few.
Tables below say how each block type is written; code says only what differs.
"""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Frames that rendering may nest: some four for each level of blocks.
DEEPEST = 20_000
_LISTS = {"bulleted_list_item", "numbered_list_item", "to_do"}
# Prefixes of plain text blocks, and labels of linked ones without a caption.
_HEADINGS = {"heading_1": "# ", "heading_2": "## ", "heading_3": "### "}
_LINKED = {"video": "Video", "audio": "Audio", "embed": "Embed"}
_SILENT = {"table_row", "breadcrumb", "table_of_contents"}
_MARKS = (("bold", "**", "**"), ("italic", "*", "*"), ("strikethrough", "~~", "~~"), ("underline", "<u>", "</u>"))


def rich_text(segments: list[dict] | None) -> str:
    """Rich-text segments as Markdown; code keeps no other mark, an equation no link."""
    out = []
    for s in segments or []:
        said = s.get("plain_text") or ""
        if not said:
            continue
        expression = (s.get("equation") or {}).get("expression") if s.get("type") == "equation" else None
        if expression:
            out.append(f"${expression}$")
            continue
        style = s.get("annotations") or {}
        if style.get("code"):
            said = f"`{said}`"
        else:
            for name, a, b in _MARKS:
                said = f"{a}{said}{b}" if style.get(name) else said
        out.append(f"[{said}]({s['href']})" if s.get("href") else said)
    return "".join(out)


def plain_text(segments: list[dict] | None) -> str:
    return "".join(s.get("plain_text") or "" for s in segments or [])


def _url(content: dict) -> str:
    if isinstance(content.get("url"), str):
        return content["url"]
    return (content.get(content.get("type") or "") or {}).get("url", "") if content.get("type") in ("file", "external") else ""


class Renderer:
    """Renders block trees; slugs resolve links to child pages and databases, `assets` the URLs of hosted files."""

    def __init__(self, page_slugs: dict[str, str] | None = None, database_slugs: dict[str, str] | None = None, assets: Callable[[str, str, str], str] | None = None):
        self.pages, self.databases, self.assets = page_slugs or {}, database_slugs or {}, assets

    def blocks(self, blocks: list[dict], depth: int = 0) -> str:
        """Sibling blocks: a blank line between them, but none within a list; numbers restart after other types."""
        lines, number = [], 0
        for i, block in enumerate(blocks):
            number = number + 1 if block["type"] == "numbered_list_item" else 0
            text = self.block(block, depth, number)
            lines.append(text)
            follows = blocks[i + 1]["type"] if i + 1 < len(blocks) else None
            if text and not (block["type"] in _LISTS and follows == block["type"]):
                lines.append("")
        return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()

    def _below(self, block: dict, depth: int) -> str:
        children = block.get("children") or []
        return "\n" + self.blocks(children, depth) if children else ""

    def _quoted(self, text: str, pad: str) -> str:
        return "\n".join(f"{pad}> {line}" for line in text.split("\n"))

    def _hosted(self, block: dict, hint: str) -> str:
        content = block.get("content") or {}
        url = _url(content)
        if self.assets and content.get("type") == "file":
            try:
                return self.assets(url, block["id"], hint)
            except Exception:  # a file that can't be fetched keeps its address
                return url
        return url

    def block(self, block: dict, depth: int = 0, number: int = 1) -> str:
        kind, content, children = block["type"], block.get("content") or {}, block.get("children") or []
        pad, text, caption = "  " * depth, rich_text(content.get("rich_text")), rich_text(content.get("caption"))
        own = getattr(self, f"_{kind}", None)
        if kind in _SILENT:
            return ""
        if kind in _HEADINGS:
            return f"{pad}{_HEADINGS[kind]}{text}"
        if kind in _LISTS:
            mark = {"bulleted_list_item": "-", "numbered_list_item": f"{number}.", "to_do": f"- [{'x' if content.get('checked') is True else ' '}]"}[kind]
            return f"{pad}{mark} {text}{self._below(block, depth + 1)}"
        if kind in _LINKED:
            return f"{pad}[{caption or _LINKED[kind]}]({_url(content) if kind != 'embed' else content.get('url') or ''})"
        if kind in ("file", "pdf"):
            name = content["name"] if content.get("name") is not None else caption or kind
            return f"{pad}[{name}]({self._hosted(block, kind)})"
        return own(block, content, children, pad, depth, text, caption) if own else f"{pad}<!-- unsupported block: {kind} -->{' ' + text if text else ''}"

    def _paragraph(self, block, content, children, pad, depth, text, caption):
        return f"{pad}{text}{self._below(block, depth)}"

    def _toggle(self, block, content, children, pad, depth, text, caption):
        inner = self.blocks(children) if children else ""
        return "\n".join((f"{pad}<details>", f"{pad}<summary>{text}</summary>", pad, inner, pad, f"{pad}</details>"))

    def _code(self, block, content, children, pad, depth, text, caption):
        note = f"\n{pad}*{caption}*" if caption else ""
        return f"{pad}```{content.get('language') or ''}\n{text}\n{pad}```{note}"

    def _quote(self, block, content, children, pad, depth, text, caption):
        return self._quoted(text, pad) + ("\n" + self._quoted(self.blocks(children), pad) if children else "")

    def _callout(self, block, content, children, pad, depth, text, caption):
        emoji = (content.get("icon") or {}).get("emoji") or ""
        return f"{pad}> {emoji + ' ' if emoji else ''}**{text}**" + ("\n" + self._quoted(self.blocks(children), pad) if children else "")

    def _divider(self, block, content, children, pad, *_):
        return f"{pad}---"

    def _image(self, block, content, children, pad, depth, text, caption):
        return f"{pad}![{caption or 'image'}]({self._hosted(block, 'image')})"

    def _bookmark(self, block, content, children, pad, depth, text, caption):
        url = content.get("url") or ""
        return f"{pad}[Bookmark: {caption or url}]({url})"

    def _link_preview(self, block, content, children, pad, *_):
        url = content.get("url") or ""
        return f"{pad}[{url}]({url})"

    def _equation(self, block, content, children, pad, *_):
        return f"{pad}$$\n{pad}{content.get('expression') or ''}\n{pad}$$"

    def _column_list(self, block, content, children, pad, depth, *_):
        return "\n\n".join(self.blocks(c["children"], depth) for c in children if c["type"] == "column" and c.get("children"))

    def _column(self, block, content, children, pad, depth, *_):
        return self.blocks(children, depth) if children else ""

    def _synced_block(self, block, content, children, pad, depth, *_):
        return self.blocks(children, depth) if children else f"{pad}<!-- synced block (content not available) -->"

    def _child(self, block, content, pad, slugs, untitled):
        slug = slugs.get(block["id"])
        title = content["title"] if content.get("title") is not None else untitled
        return f"{pad}[{title}]({f'./{slug}/' if slug else ''})"

    def _child_page(self, block, content, children, pad, *_):
        return self._child(block, content, pad, self.pages, "Untitled")

    def _child_database(self, block, content, children, pad, *_):
        return self._child(block, content, pad, self.databases, "Untitled Database")

    def _link_to_page(self, block, content, children, pad, *_):
        target = next((content[k] for k in ("page_id", "database_id") if content.get(k) is not None), "")
        slug = self.pages.get(target) or self.databases.get(target)
        return f"{pad}[Page link](../{slug}/)" if slug else f"{pad}[Page link](notion://{target})"

    def _table(self, block, content, children, pad, *_):
        """The first row is the header; short rows are filled, long ones kept."""
        rows = [[rich_text(c) for c in (r.get("content") or {}).get("cells") or []] for r in children if r["type"] == "table_row"]
        if not rows:
            return ""
        wide = len(rows[0])
        line = lambda cells: f"{pad}| {' | '.join(cells)} |"
        return "\n".join([line(rows[0]), line(["---"] * wide), *(line(r + [""] * (wide - len(r))) for r in rows[1:])])


def _named(v: dict | None) -> object:
    return None if not v else v["name"] if v.get("name") is not None else v.get("id")


def _inner(v: dict | None) -> object:
    return None if not v else v.get(v.get("type"))


def _rollup(v: dict | None) -> object:
    return [property_value(x) for x in v.get("array") or []] if v and v.get("type") == "array" else _inner(v)


def _unique(v: dict | None) -> object:
    return None if not v else f"{v['prefix']}-{v['number']}" if v.get("prefix") else v.get("number")


def _dates(v: dict | None) -> object:
    return None if not v else f"{v['start']} - {v['end']}" if v.get("end") else v.get("start")


_PROPERTIES: dict[str, Callable[[object], object]] = {
    "title": plain_text, "rich_text": plain_text, "select": lambda v: (v or {}).get("name"), "status": lambda v: (v or {}).get("name"), "multi_select": lambda v: [x["name"] for x in v or []],
    "date": _dates, "checkbox": lambda v: False if v is None else v, "formula": _inner, "relation": lambda v: [x["id"] for x in v or []], "rollup": _rollup, "people": lambda v: [_named(x) for x in v or []],
    "files": lambda v: [{"name": x.get("name"), "url": ((x.get("file") if x.get("type") == "file" else x.get("external")) or {}).get("url")} for x in v or []],
    "created_by": _named, "last_edited_by": _named, "unique_id": _unique, "verification": lambda v: (v or {}).get("state"),
    **{k: (lambda v: v) for k in ("number", "url", "email", "phone_number", "created_time", "last_edited_time")},
}


def property_value(prop: dict) -> object:
    """The plain value of a typed property; None for types that have none."""
    kind = prop.get("type")
    return _PROPERTIES[kind](prop.get(kind)) if kind in _PROPERTIES else None


def page_title(properties: dict) -> str:
    return next((t for p in properties.values() if p.get("type") == "title" and (t := plain_text(p.get("title")))), "Untitled")


def tree(rows: list[dict], root: str | None = None, most_depth: int | None = None) -> list[dict]:
    """Blocks (id, parent_id, ordinal, type, content JSON) as nested children, in order; cycles are cut, and what is deeper than `most_depth` if that is given.

    A synced block that names its origin has the origin's children; child pages and databases are not entered.
    """
    by_id = {r["id"]: r for r in rows}
    below: dict[str | None, list[dict]] = {}
    for r in sorted(rows, key=lambda r: (r["ordinal"], r["id"])):
        below.setdefault(r["parent_id"] if r["parent_id"] in by_id or r["parent_id"] == root else root, []).append(r)

    def grow(at: str | None, depth: int, seen: frozenset) -> list[dict]:
        out = []
        for r in below.get(at, []):
            if r["id"] in seen or most_depth is not None and depth > most_depth:
                continue
            content = json.loads(r["content"]) if isinstance(r["content"], str) else r["content"] or {}
            origin = ((content.get("synced_from") or {}).get("block_id") if r["type"] == "synced_block" else None) or r["id"]
            children = [] if r["type"] in ("child_page", "child_database") else grow(origin, depth + 1, seen | {r["id"], origin})
            out.append({"id": r["id"], "type": r["type"], "content": content, "children": children})
        return out

    return grow(root, 0, frozenset())


def render_pages(blocks: DataFrame, page_col: str = "page_id", most_depth: int | None = None) -> DataFrame:
    """(page_col, markdown) from blocks (page_col, id, parent_id, ordinal, type, content), one row for each page; whole, unless `most_depth` is given."""
    packed = blocks.groupBy(page_col).agg(F.collect_list(F.struct("id", "parent_id", "ordinal", "type", "content")).alias("blocks"))

    @F.pandas_udf("string")
    def markdown(pages: pd.Series) -> pd.Series:
        draw = Renderer()
        sys.setrecursionlimit(max(sys.getrecursionlimit(), DEEPEST))
        return pages.map(lambda rows: draw.blocks(tree([dict(r) for r in rows], most_depth=most_depth)))

    return packed.select(page_col, markdown("blocks").alias("markdown"))
