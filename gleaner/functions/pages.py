"""Pages and databases of a block-structured workspace: their typed heads, discovery, assets, and database schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_FILE = "struct<url: string>"
_ICON = f"struct<type: string, emoji: string, external: {_FILE}, file: {_FILE}>"
#: What search results hold of a page or database; properties as JSON texts by name.
PAGE = (
    "object string, id string, url string, created_time string, last_edited_time string, archived boolean, created_by struct<id: string>, last_edited_by struct<id: string>, "
    f"parent struct<type: string, page_id: string, database_id: string, block_id: string>, icon {_ICON}, cover {_ICON}, title array<struct<plain_text: string>>, properties map<string, string>"
)
# Extensions of assets whose URL names none.
EXTENSIONS = {"image": ".png", "pdf": ".pdf", "audio": ".mp3", "video": ".mp4"}


def read_search(raw: DataFrame, json_col: str = "value") -> DataFrame:
    """Typed search results from JSON texts."""
    return raw.select(F.from_json(json_col, PAGE).alias("x")).select("x.*")


def discovered(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The pages and the databases among search results."""
    return results.where("object = 'page'"), results.where("object = 'database'")


def _parent() -> tuple[Column, Column]:
    kind = F.col("parent.type")
    known = kind.isin("page_id", "database_id", "block_id")
    id_ = F.when(kind == "page_id", F.col("parent.page_id")).when(kind == "database_id", F.col("parent.database_id")).when(kind == "block_id", F.col("parent.block_id"))
    return id_.alias("parentId"), F.when(known, kind).otherwise("workspace").alias("parentType")


def _icon(c: str) -> Column:
    """An emoji, or a link to an image; null for other kinds."""
    kind, none = F.col(f"{c}.type"), F.lit(None).cast("string")
    made = lambda emoji, url: F.struct(kind.alias("type"), emoji.alias("emoji"), url.alias("url"))
    return F.when(kind == "emoji", made(F.col(f"{c}.emoji"), none)).when(kind == "external", made(none, F.col(f"{c}.external.url"))).when(kind == "file", made(none, F.col(f"{c}.file.url"))).alias(c)


def _cover(c: str) -> Column:
    """A link to an image; null for other kinds and for none."""
    kind = F.col(f"{c}.type")
    url = F.when(kind == "external", F.col(f"{c}.external.url")).when(kind == "file", F.col(f"{c}.file.url"))
    return F.when(url.isNotNull(), F.struct(kind.alias("type"), url.alias("url"))).alias(c)


def _texts(c: Column) -> Column:
    return F.array_join(F.transform(F.from_json(c, "array<struct<plain_text: string>>"), lambda t: F.coalesce(t["plain_text"], F.lit(""))), "")


def title_of(properties: Column) -> Column:
    """The text of the first title-typed property; `Untitled` without one."""
    titles = F.filter(F.map_values(properties), lambda p: F.get_json_object(p, "$.type") == "title")
    said = F.filter(F.transform(titles, lambda p: _texts(F.get_json_object(p, "$.title"))), lambda t: t != "")
    return F.coalesce(F.get(said, F.lit(0)), F.lit("Untitled"))


def _heads(rows: DataFrame, title: Column, *more: Column) -> DataFrame:
    or_empty = lambda c, name: F.coalesce(F.col(c), F.lit("")).alias(name)
    return rows.select(
        "id", title.alias("title"), or_empty("url", "url"), *_parent(), or_empty("created_time", "createdTime"), or_empty("last_edited_time", "lastEditedTime"),
        F.coalesce("archived", F.lit(False)).alias("archived"), _icon("icon"), _cover("cover"), *more,
    )


def page_heads(pages: DataFrame) -> DataFrame:
    """What is kept of each page."""
    by = lambda c, name: F.coalesce(F.col(f"{c}.id"), F.lit("")).alias(name)
    return _heads(pages, title_of(F.col("properties")), by("created_by", "createdBy"), by("last_edited_by", "lastEditedBy"), F.col("properties"))


def database_heads(databases: DataFrame) -> DataFrame:
    """What is kept of each database, with its schema: the id, type and configuration of each property by name."""
    said = F.array_join(F.transform("title", lambda t: F.coalesce(t["plain_text"], F.lit(""))), "")

    def column(p: Column) -> Column:
        kind = F.get_json_object(p, "$.type")
        config = F.try_element_at(F.from_json(p, "map<string, string>"), kind)
        return F.struct(F.get_json_object(p, "$.id").alias("id"), kind.alias("type"), config.alias("config"))

    schema = F.transform_values("properties", lambda _, p: column(p))
    return _heads(databases, F.coalesce(F.nullif(said, F.lit("")), F.lit("Untitled Database")), schema.alias("schema"))


def asset_filename(block_id: Column, url: Column, hint: Column) -> Column:
    """The file name of a block's asset: twelve characters of its id, and the URL's extension or one for the hint."""
    path = F.regexp_extract(url, r"\A[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    extension = F.regexp_extract(path, r"[^/](\.[^./]*)/*\z", 1)
    fallback = F.lit(".bin")
    for kind, name in EXTENSIONS.items():
        fallback = F.when(hint == kind, name).otherwise(fallback)
    return F.concat(F.substring(F.regexp_replace(block_id, "-", ""), 1, 12), F.when((extension != "") & (F.length(extension) <= 6), extension).otherwise(fallback))


def rows_and_pages(heads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pages that are rows of a database, and pages of their own; a row is not written as a page too."""
    return heads.where("parentType = 'database_id'"), heads.where("parentType <> 'database_id'")


def row_heads(rows: DataFrame) -> DataFrame:
    """(id, frontmatter, sidecar) of database rows: properties as plain values but the title, those without a value left out."""
    import json

    import pandas as pd

    from gleaner.functions.blocks import property_value

    def run(batches):
        for pdf in batches:
            out = []
            for id_, url, text in zip(pdf["id"], pdf["url"], pdf["properties"]):
                head = {"id": id_, "url": url}
                for name, prop in json.loads(text or "{}").items():
                    prop = json.loads(prop) if isinstance(prop, str) else prop
                    if prop.get("type") != "title" and (value := property_value(prop)) is not None:
                        head[name] = value
                out.append(json.dumps(head, ensure_ascii=False))
            yield pd.DataFrame({"id": pdf["id"], "frontmatter": out})

    side = F.to_json(F.struct("id", "title", "url", "createdTime", "lastEditedTime", "archived"))
    made = rows.select("id", "url", F.to_json("properties").alias("properties")).mapInPandas(run, "id string, frontmatter string")
    return made.join(rows.select("id", side.alias("sidecar")), "id")


COMMENT = "id string, created_time string, created_by struct<id: string>, parent struct<page_id: string>, rich_text array<struct<plain_text: string>>"


def page_comments(comments: DataFrame) -> DataFrame:
    """(page_id, comments): the comments (typed as COMMENT) of each page in order of time."""
    said = F.array_join(F.transform("rich_text", lambda t: F.coalesce(t["plain_text"], F.lit(""))), "")
    rows = comments.select(F.col("parent.page_id").alias("page_id"), F.struct(F.col("created_time").alias("createdTime"), "id", F.col("created_by.id").alias("createdBy"), said.alias("text")).alias("c"))
    return rows.groupBy("page_id").agg(F.array_sort(F.collect_list("c")).alias("comments"))


def page_documents(heads: DataFrame, bodies: DataFrame, paths: DataFrame, comments: DataFrame | None = None) -> DataFrame:
    """(path, frontmatter, body, sidecar) of pages (heads as page_heads makes them, bodies (id, markdown), paths (id, path)).

    A page without blocks has an empty body; comments, where they are known, go to the sidecar.
    """
    rows = heads.join(bodies, "id", "left").join(paths, "id")
    rows = rows.join(comments.withColumnRenamed("page_id", "id"), "id", "left") if comments is not None else rows.withColumn("comments", F.lit(None).cast("array<struct<id: string>>"))
    head = F.struct("id", "title", "url", F.col("createdTime").alias("created_time"), F.col("lastEditedTime").alias("last_edited_time"), F.when(F.col("archived"), True).alias("archived"), F.nullif(F.col("icon.emoji"), F.lit("")).alias("icon"))
    side = F.struct("id", "title", "url", "createdTime", "lastEditedTime", "parentId", "parentType", "archived", "createdBy", "lastEditedBy", "icon", "cover", "comments")
    return rows.select(F.concat("path", F.lit("/index.md")).alias("path"), F.to_json(head).alias("frontmatter"), F.coalesce("markdown", F.lit("")).alias("body"), F.to_json(side).alias("sidecar"))
