"""Writers: documents as Markdown with frontmatter, JSON lines, sidecars, and the state of a sync (folders of documents: `publish`)."""

from __future__ import annotations

import json
import os
import tempfile
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def yaml_lines(frontmatter: dict) -> str:
    """A frontmatter block of plain keys; texts that would read as something else are quoted."""
    import yaml

    return yaml.safe_dump(frontmatter, allow_unicode=True, sort_keys=False, width=10**9)


def document(frontmatter_yaml: Column, body: Column) -> Column:
    return F.concat(F.lit("---\n"), frontmatter_yaml, F.lit("---\n\n"), body)


def simple_yaml(**fields: Column) -> Column:
    """`key: value` lines of the fields that have a value, each value as a JSON text, which YAML reads alike."""
    lines = [F.when(v.isNotNull(), F.concat(F.lit(f"{k}: "), F.to_json(F.struct(v.alias("v"))).substr(F.lit(6), F.length(F.to_json(F.struct(v.alias("v")))) - 6), F.lit("\n"))).otherwise("") for k, v in fields.items()]
    return F.concat(*lines)


def atomic_write(path: str, content: str | bytes) -> None:
    """Write a file by renaming a finished temporary one over it."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    handle, temporary = tempfile.mkstemp(dir=os.path.dirname(path) or ".", prefix=".tmp-")
    with os.fdopen(handle, "wb") as f:
        f.write(content if isinstance(content, bytes) else content.encode())
    os.replace(temporary, path)


def remove_documents(rows: DataFrame, root: str) -> None:
    """Remove the files of (path) rows from the executors; those that are gone already are no error."""

    def remove(part: Iterable) -> None:
        from pyarrow import fs

        for row in part:
            whole = f"{root.rstrip('/')}/{row['path']}"
            local = root.startswith("file:") or "://" not in root
            store, inner = (fs.LocalFileSystem(), whole.removeprefix("file://").removeprefix("file:")) if local else fs.FileSystem.from_uri(whole)
            try:
                store.delete_file(inner)
            except FileNotFoundError:
                pass

    rows.select("path").foreachPartition(remove)


def write_json_lines(rows: DataFrame, path: str, append: bool = False) -> None:
    rows.write.mode("append" if append else "overwrite").json(path)


def write_meta(path: str, record: dict) -> None:
    atomic_write(path, json.dumps(record, indent=2, ensure_ascii=False))


class SyncState:
    """The state of syncs in one JSON file: last time, cursors and metadata of each adapter, written atomically."""

    def __init__(self, path: str):
        self.path = path
        try:
            with open(path, encoding="utf-8") as f:
                self.data = json.load(f)
        except (OSError, ValueError):
            self.data = {}

    def adapter(self, name: str) -> dict:
        """The state of one adapter; adapters share nothing."""
        own = self.data.setdefault(name, {})
        own.setdefault("lastSyncAt", None)
        own.setdefault("cursors", {})
        own.setdefault("metadata", {})
        return own

    def checkpoint(self) -> None:
        write_meta(self.path, self.data)

    def save(self, name: str, now_iso: str) -> None:
        self.adapter(name)["lastSyncAt"] = now_iso
        self.checkpoint()


def split_attachments(attachments: DataFrame, most_bytes: int) -> tuple[DataFrame, DataFrame]:
    """Attachments to store, and those too large with the reason."""
    large = F.coalesce(F.col("size"), F.lit(0)) > most_bytes
    return attachments.where(~large), attachments.where(large).withColumn("reason", F.format_string("exceeds %d bytes", F.lit(most_bytes)))


def format_results(rows: list, query: str, now_ms: int) -> str:
    """Search results as text: score and age, place, and a line of content."""
    if not rows:
        return f'No results found for "{query}".'
    out = [f'Results for "{query}":\n']
    for r in rows:
        r = r.asDict() if hasattr(r, "asDict") else r
        content, age = r.get("content") or "", r.get("age")
        score = f"{r['score']:.2f} | {age}" if age else f"{r['score']:.3f}"
        context = f" § {r['section_context']}" if r.get("section_context") else ""
        tag = " [vision]" if r.get("result_type") == "vision" else ""
        snippet = content.replace("\n", " ")[:200] + ("..." if len(content) > 200 else "")
        out.append(f"[{score}] {r['index_name']}/{r.get('relative_path') or r['file_path']}{context}{tag}\n  \"{snippet}\"\n")
    return "\n".join(out)


def results_json(rows: DataFrame) -> DataFrame:
    """One JSON text for each result; fields without a value are left out."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))


def json_array(rows: DataFrame, *order: str) -> DataFrame:
    """(value): a small dimension, such as teams or labels, as one JSON array in order."""
    fields = [c for c in rows.columns if c not in order]
    items = F.array_sort(F.collect_list(F.struct(*order, *fields)))
    return rows.agg(F.to_json(F.transform(items, lambda x: F.struct(*(x[c].alias(c) for c in rows.columns)))).alias("value"))


def result_lines(rows: DataFrame, now_ms: int) -> DataFrame:
    """`rows` of search results with `line`: score and age, place, and a line of content, as the text format shows them."""
    from gleaner.functions.scoring import relative_age

    age = relative_age(F.col("content_timestamp_ms"), now_ms)
    score = F.when(age.isNotNull(), F.concat(F.format_string("%.2f", "score"), F.lit(" | "), age)).otherwise(F.format_string("%.3f", "score"))
    content = F.coalesce("content", F.lit(""))
    context = F.when(F.coalesce("section_context", F.lit("")) != "", F.concat(F.lit(" § "), "section_context")).otherwise("")
    tag = F.when(F.col("result_type") == "vision", " [vision]").otherwise("")
    place = F.concat(F.lit("["), score, F.lit("] "), "index_name", F.lit("/"), F.coalesce(F.nullif("relative_path", F.lit("")), "file_path"), context, tag)
    snippet = F.concat(F.lit('  "'), F.substring(F.replace(content, F.lit("\n"), F.lit(" ")), 1, 200), F.when(F.length(content) > 200, "...").otherwise(""), F.lit('"\n'))
    return rows.withColumn("line", F.concat(place, F.lit("\n"), snippet))
