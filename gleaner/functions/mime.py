"""Mail messages in their transport form: bodies, headers, parts, and HTML as Markdown."""

from __future__ import annotations

import base64
import json
import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Labels of character sets that have another name.
_CHARSETS = {"utf8": "utf-8", "latin1": "iso-8859-1", "latin-1": "iso-8859-1", "us-ascii": "ascii", "iso-8859-1": "windows-1252", "ascii": "windows-1252"}


def charset(content_type: str) -> str:
    found = re.search(r"charset\s*=\s*\"?([^\";\s]+)", content_type or "", re.IGNORECASE)
    return found[1].strip().lower() if found else "utf-8"


def decode_body(data: str | None, content_type: str = "") -> str:
    """Base64url text in its character set; unknown sets are read as UTF-8."""
    if not data:
        return ""
    raw = base64.urlsafe_b64decode(re.sub(r"[^A-Za-z0-9_+/-]", "", data).replace("+", "-").replace("/", "_") + "=" * (-len(re.sub(r"[^A-Za-z0-9_+/-]", "", data)) % 4))
    label = charset(content_type)
    try:
        return raw.decode(_CHARSETS.get(label, label), "replace")
    except LookupError:
        return raw.decode("utf-8", "replace")


def header(headers: list[dict] | None, name: str) -> str:
    """The first header of that name in any case; empty if there is none."""
    return next((h.get("value") or "" for h in headers or [] if (h.get("name") or "").lower() == name.lower()), "")


def walk_parts(payload: dict | None) -> dict:
    """All text and HTML leaves without a file name, concatenated in order, and the attachments."""
    out: dict = {"plain": [], "html": [], "attachments": []}

    def visit(part: dict) -> None:
        for inner in part.get("parts") or []:
            visit(inner)
        if part.get("parts"):
            return
        body, kind, headers = part.get("body") or {}, (part.get("mimeType") or "").lower(), part.get("headers")
        if part.get("filename") and body.get("attachmentId"):
            out["attachments"].append({"attachmentId": body["attachmentId"], "filename": part["filename"], "mimeType": part.get("mimeType") or "", "size": int(body.get("size") or 0), "contentId": header(headers, "Content-ID").strip("<>")})
        elif not part.get("filename") and body.get("data") and kind in ("text/plain", "text/html"):
            out["plain" if kind == "text/plain" else "html"].append(decode_body(body["data"], header(headers, "Content-Type")))

    visit(payload or {})
    return out


def attachments_below(payload: dict | None) -> list[dict]:
    """The attachments among a payload's parts, at any depth, but not of the payload itself, as the command-line reader lists them."""
    return [a for part in (payload or {}).get("parts") or [] for a in walk_parts(part)["attachments"]]


class _Markdown(HTMLParser):
    _WRAP = {"strong": "**", "b": "**", "em": "_", "i": "_", "code": "`"}
    _BREAK = {"p", "div", "table", "ul", "ol", "blockquote", "pre", "section", "article"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.lists: list[list] = []
        self.links: list[tuple[int, str]] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag in ("script", "style", "head"):
            self.hidden += 1
        elif re.fullmatch(r"h[1-6]", tag):
            self.out.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag in self._WRAP:
            self.out.append(self._WRAP[tag])
        elif tag == "br":
            self.out.append("\n")
        elif tag == "hr":
            self.out.append("\n\n---\n\n")
        elif tag == "a":
            self.links.append((len(self.out), a.get("href") or ""))
        elif tag == "img" and a.get("src"):
            self.out.append(f"![{a.get('alt') or ''}]({a['src']})")
        elif tag == "li":
            kind = self.lists[-1] if self.lists else ["ul", 0]
            kind[1] += 1
            self.out.append("\n" + "  " * max(0, len(self.lists) - 1) + (f"{kind[1]}. " if kind[0] == "ol" else "- "))
        if tag in ("ul", "ol"):
            self.lists.append([tag, 0])
        if tag in self._BREAK:
            self.out.append("\n\n")

    def handle_endtag(self, tag):
        if tag in ("script", "style", "head"):
            self.hidden = max(0, self.hidden - 1)
        elif tag in self._WRAP:
            self.out.append(self._WRAP[tag])
        elif tag == "a" and self.links:
            at, href = self.links.pop()
            said = "".join(self.out[at:])
            self.out[at:] = [f"[{said}]({href})" if href else said]
        elif tag in ("ul", "ol") and self.lists:
            self.lists.pop()
        if tag in self._BREAK or re.fullmatch(r"h[1-6]", tag):
            self.out.append("\n\n")

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(re.sub(r"\s+", " ", data))


def html_to_markdown(html: str) -> str:
    parser = _Markdown()
    parser.feed(html)
    parser.close()
    text = re.sub(r"[ \t]*\n[ \t]*(?![ \t]*(?:-|\d+\.) )", "\n", "".join(parser.out))
    return re.sub(r"\n{3,}", "\n\n", text).strip()


def body_markdown(plain: str | None, html: str | None, snippet: str | None) -> str:
    """The plain body, else the HTML one as Markdown, else the snippet."""
    if plain:
        return plain
    return html_to_markdown(html) if html else snippet or ""


_MESSAGE = (
    "id string, threadId string, labelIds array<string>, historyId string, internalDate bigint, `from` string, `to` string, cc string, bcc string, subject string, date string, messageId string, inReplyTo string, `references` string, "
    "bodyPlain string, bodyHtml string, snippet string, attachments array<struct<attachmentId: string, filename: string, mimeType: string, size: bigint, contentId: string>>, sizeEstimate bigint"
)


def parse_message(raw: dict) -> dict:
    """A raw message flattened: headers as fields, bodies decoded, attachments listed; absent optional headers are null."""
    payload = raw.get("payload") or {}
    headers, parts = payload.get("headers"), walk_parts(payload)
    optional = lambda name: header(headers, name) or None
    return {
        "id": raw.get("id"), "threadId": raw.get("threadId"), "labelIds": raw.get("labelIds") or [], "historyId": raw.get("historyId"), "internalDate": int(raw.get("internalDate") or 0),
        "from": header(headers, "From"), "to": header(headers, "To"), "cc": optional("Cc"), "bcc": optional("Bcc"), "subject": header(headers, "Subject"), "date": header(headers, "Date"), "messageId": header(headers, "Message-ID"),
        "inReplyTo": optional("In-Reply-To"), "references": optional("References"), "bodyPlain": "".join(parts["plain"]) or None, "bodyHtml": "".join(parts["html"]) or None, "snippet": raw.get("snippet") or "",
        "attachments": parts["attachments"], "sizeEstimate": int(raw.get("sizeEstimate") or 0),
    }


def parse_messages(raw: DataFrame, json_col: str = "value") -> DataFrame:
    """One flat row for each raw message in JSON, with its Markdown body; unreadable JSON is dropped."""

    def run(batches):
        for pdf in batches:
            rows = []
            for text in pdf[json_col]:
                try:
                    message = parse_message(json.loads(text))
                except (TypeError, ValueError):
                    continue
                rows.append(message | {"body": body_markdown(message["bodyPlain"], message["bodyHtml"], message["snippet"])})
            yield pd.DataFrame(rows, columns=[c.split(" ")[0].strip("`") for c in re.split(r", (?![^<]*>)", f"{_MESSAGE}, body string")])

    return raw.select(json_col).mapInPandas(run, f"{_MESSAGE}, body string")


def threads(messages: DataFrame) -> DataFrame:
    """(threadId, messageCount, subject, participants, body): messages in order of time; senders as first seen."""
    from gleaner.operators.rollups import first_seen, ordered

    rows = ordered(messages, ["threadId"], ["internalDate", "id"], ["from", "date", "subject", "body"])
    block = lambda m: F.concat(F.lit("**From:** "), F.coalesce(m["from"], F.lit("")), F.lit("  \n**Date:** "), F.coalesce(m["date"], F.lit("")), F.lit("\n\n"), F.coalesce(F.nullif(m["body"], F.lit("")), F.lit("(no body)")))
    return rows.select(
        "threadId", F.size("items").cast("long").alias("messageCount"), F.get("items", F.lit(0))["subject"].alias("subject"), first_seen(F.transform("items", lambda m: m["from"])).alias("participants"),
        F.array_join(F.transform("items", block), "\n\n---\n").alias("body"),
    )
