"""Issue-tracker records: typed issues, frontmatter and bodies of issues and projects, cycles, relations, attachments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.text import sanitize_filename
from gleaner.operators.rollups import inverse_relations, names_of
from gleaner.runtime import materialise

# Labels of priorities, and the inverse of each relation type.
PRIORITIES = {0: "None", 1: "Urgent", 2: "High", 3: "Medium", 4: "Low"}
INVERSE = {"blocks": "blocked-by", "blocked-by": "blocks", "duplicate": "duplicate-of", "duplicate-of": "duplicate", "related": "related"}

_REF = "struct<id: string>"
#: An issue as the tracker's API gives it.
ISSUE_NODE = (
    "id string, identifier string, title string, description string, priority int, estimate double, dueDate string, createdAt string, updatedAt string, archivedAt string, completedAt string, canceledAt string, "
    f"state struct<id: string, name: string, type: string>, team {_REF}, assignee {_REF}, creator {_REF}, project {_REF}, cycle {_REF}, parent struct<id: string, identifier: string>, labels struct<nodes: array<{_REF}>>, "
    f"comments struct<nodes: array<struct<id: string, body: string, createdAt: string, updatedAt: string, user: {_REF}>>>, attachments struct<nodes: array<struct<id: string, title: string, url: string, sourceType: string, createdAt: string>>>, "
    "relations struct<nodes: array<struct<type: string, relatedIssue: struct<id: string, identifier: string>>>>, inverseRelations struct<nodes: array<struct<type: string, issue: struct<id: string, identifier: string>>>>"
)


def _inverse(kind: Column) -> Column:
    named = F.create_map(*(F.lit(x) for pair in INVERSE.items() for x in pair))
    return F.coalesce(F.try_element_at(named, kind), kind)


def typed_issues(raw: DataFrame, since: str | None = None) -> DataFrame:
    """Issues in one flat shape; with `since` only those updated after it, a filter that reaches the scan.

    Relations come from both directions: outgoing ones, then the others with
    their type's inverse (unknown types as they are).
    """
    if since is not None:
        raw = raw.where(F.col("updatedAt") > since)
    link = lambda kind, issue: F.struct(kind.alias("type"), issue["id"].alias("relatedIssueId"), issue["identifier"].alias("relatedIssueIdentifier"))
    nodes = lambda name, made, kind: F.coalesce(F.transform(F.col(f"{name}.nodes"), made), F.array().cast(f"array<{kind}>"))
    link_type = "struct<type: string, relatedIssueId: string, relatedIssueIdentifier: string>"
    outgoing = nodes("relations", lambda r: link(r["type"], r["relatedIssue"]), link_type)
    incoming = nodes("inverseRelations", lambda r: link(_inverse(r["type"]), r["issue"]), link_type)
    comment = lambda c: F.struct(c["id"].alias("id"), c["body"].alias("body"), F.coalesce(c["user"]["id"], F.lit("")).alias("userId"), c["createdAt"].alias("createdAt"))
    attachment = lambda a: F.struct(a["id"].alias("id"), a["title"].alias("title"), a["url"].alias("url"), a["sourceType"].alias("sourceType"))
    return raw.select(
        "id", "identifier", "title", "description", F.col("state.id").alias("stateId"), F.col("state.name").alias("stateName"), F.col("state.type").alias("stateType"), "priority",
        F.col("assignee.id").alias("assigneeId"), F.col("creator.id").alias("creatorId"), F.col("team.id").alias("teamId"), F.col("project.id").alias("projectId"), F.col("cycle.id").alias("cycleId"),
        nodes("labels", lambda x: x["id"], "string").alias("labelIds"), F.col("parent.identifier").alias("parentIdentifier"), "estimate", "dueDate", "createdAt", "updatedAt", "archivedAt", "completedAt", "canceledAt",
        F.concat(outgoing, incoming).alias("relations"), nodes("comments", comment, "struct<id: string, body: string, userId: string, createdAt: string>").alias("comments"),
        nodes("attachments", attachment, "struct<id: string, title: string, url: string, sourceType: string>").alias("attachments"),
    )


def priority_label(priority: Column) -> Column:
    out = F.lit(PRIORITIES[0])
    for n, label in PRIORITIES.items():
        out = F.when(priority == n, label).otherwise(out)
    return out


def cycle_name(name: Column, number: Column) -> Column:
    return F.coalesce(F.nullif(name, F.lit("")), F.concat(F.lit("Cycle "), number.cast("string")))


def relations(rows: DataFrame) -> DataFrame:
    """(source, target, kind, direction) of relations (issue_id, related_id, type) and their mirrors."""
    return inverse_relations(rows, "issue_id", "related_id", "type", INVERSE)


def _named(rows: DataFrame, id_col: str, dimension: DataFrame, name: Column, out: str) -> DataFrame:
    names = dimension.select(F.col("id").alias("_id"), F.nullif(name, F.lit("")).alias(out)).dropDuplicates(["_id"])
    return rows.join(names, F.col(id_col) == F.col("_id"), "left").drop("_id")


def enriched(issues: DataFrame, users: DataFrame, teams: DataFrame, projects: DataFrame, cycles: DataFrame, labels: DataFrame) -> DataFrame:
    """`issues` (typed) with the names their ids stand for, each by a left join; what has no match is null, labels without one are dropped."""
    out = issues
    for id_col, dim, name, new in (
        ("assigneeId", users, F.col("displayName"), "assignee"), ("creatorId", users, F.col("displayName"), "creator"), ("teamId", teams, F.col("name"), "team"),
        ("projectId", projects, F.col("name"), "project"), ("cycleId", cycles, cycle_name(F.col("name"), F.col("number")), "cycle"),
    ):
        out = _named(out, id_col, dim, name, new)
    names = labels.select("id", F.nullif(F.col("name"), F.lit("")).alias("name")).dropDuplicates(["id"])
    return names_of(out, "labelIds", names, "labels")


def frontmatter() -> Column:
    """The head of an enriched issue: a JSON object without the keys that have no value."""
    filled = lambda c: F.nullif(F.col(c), F.lit(""))
    some = lambda c: F.when(F.size(c) > 0, c)
    related = F.transform("relations", lambda r: F.struct(r["type"].alias("type"), r["relatedIssueIdentifier"].alias("issue")))
    attached = F.transform("attachments", lambda a: F.struct(a["title"].alias("title"), a["url"].alias("url")))
    return F.to_json(F.struct(
        "id", "identifier", "title", F.col("stateName").alias("state"), "stateType", "priority", priority_label(F.col("priority")).alias("priorityLabel"), "assignee", "creator", "team", "project", "cycle",
        some(F.col("labels")).alias("labels"), filled("parentIdentifier").alias("parent"), "estimate", filled("dueDate").alias("dueDate"), "createdAt", "updatedAt", F.col("archivedAt").isNotNull().alias("archived"),
        filled("completedAt").alias("completedAt"), filled("canceledAt").alias("canceledAt"), filled("archivedAt").alias("archivedAt"), some(related).alias("relations"), some(attached).alias("attachments"),
    ))


def body(users: Column) -> Column:
    """The page of an issue: its title, description, and comments in stored order; `users` maps ids to names."""
    def comment(c: Column) -> Column:
        who = F.coalesce(F.try_element_at(users, F.nullif(c["userId"], F.lit(""))), F.lit("Unknown"))
        return F.concat(F.lit("\n\n### "), who, F.lit(" --- "), F.coalesce(c["createdAt"], F.lit("")), F.lit("\n\n"), F.coalesce(c["body"], F.lit("")))

    said = F.when(F.size("comments") > 0, F.concat(F.lit("\n\n---\n\n## Comments"), F.array_join(F.transform("comments", comment), ""))).otherwise("")
    described = F.when(F.coalesce("description", F.lit("")) == "", "").otherwise(F.concat(F.lit("\n"), "description"))
    return F.concat(F.lit("# "), "identifier", F.lit(": "), "title", F.lit("\n"), described, said)


def comment_names(issues: DataFrame, users: DataFrame) -> DataFrame:
    """(id, names): for each issue with comments a map of its writers' ids to their names."""
    names = users.select(F.col("id").alias("_id"), F.col("displayName").alias("_name")).dropDuplicates(["_id"])
    writers = issues.select("id", F.explode(F.array_distinct(F.transform("comments", lambda c: c["userId"]))).alias("_id")).join(names, "_id").where("_name IS NOT NULL")
    return writers.groupBy("id").agg(F.map_from_entries(F.collect_set(F.struct("_id", "_name"))).alias("names"))


def documents(issues: DataFrame, users: DataFrame, teams: DataFrame, projects: DataFrame, cycles: DataFrame, labels: DataFrame) -> DataFrame:
    """(path, frontmatter, body) of typed issues, which are written out once: names of people and labels are looked up from them again."""
    issues = materialise(issues, "issues")
    rows = enriched(issues, users, teams, projects, cycles, labels).join(comment_names(issues, users), "id", "left")
    keys = teams.select(F.col("id").alias("_team"), F.col("key").alias("_key")).dropDuplicates(["_team"])
    rows = rows.join(keys, F.col("teamId") == F.col("_team"), "left")
    names = F.coalesce("names", F.create_map().cast("map<string,string>"))
    return rows.select(issue_path(F.coalesce("_key", F.lit("")), F.col("identifier")).alias("path"), frontmatter().alias("frontmatter"), body(names).alias("body"))


def project_documents(projects: DataFrame, users: DataFrame, teams: DataFrame) -> DataFrame:
    """(path, frontmatter, body) of projects (id, name, slug, state, description, leadId, teamIds, startDate, targetDate)."""
    names = teams.select("id", F.nullif(F.col("name"), F.lit("")).alias("name")).dropDuplicates(["id"])
    rows = names_of(_named(projects, "leadId", users, F.col("displayName"), "lead"), "teamIds", names, "teams")
    filled = lambda c: F.nullif(F.col(c), F.lit(""))
    head = F.struct("id", "name", "slug", "state", "lead", "teams", filled("startDate").alias("startDate"), filled("targetDate").alias("targetDate"))
    page = F.concat(F.lit("# "), "name", F.lit("\n\n"), F.coalesce("description", F.lit("")))
    return rows.select(F.concat(F.lit("projects/"), project_slug(F.col("slug"), F.col("name")), F.lit(".md")).alias("path"), F.to_json(head).alias("frontmatter"), page.alias("body"))


def issue_path(team_key: Column, identifier: Column) -> Column:
    return F.concat(F.lit("issues/"), team_key, F.lit("/"), identifier, F.lit(".md"))


def project_slug(slug: Column, name: Column) -> Column:
    """The slug, or the lower-case name with hyphens for blanks as a file name."""
    return F.coalesce(F.nullif(slug, F.lit("")), sanitize_filename(F.regexp_replace(F.lower(name), r"\s+", "-")))


def is_downloadable(source_type: Column) -> Column:
    """Uploads, and attachments that don't say where they come from."""
    return F.coalesce(source_type, F.lit("")).isin("", "upload")


def filename_from_url(url: Column) -> Column:
    """The last segment of a URL's path, percent-decoded, if it has a dot; else null."""
    path = F.regexp_extract(url, r"\A[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    last = F.regexp_extract(path, r"([^/]+)/*\z", 1)
    # A plus stands for itself in a path.
    return F.when(F.contains(last, F.lit(".")), F.try_url_decode(F.replace(last, F.lit("+"), F.lit("%2B"))))


def attachment_title(title: Column) -> Column:
    """A title as a file name of any length; `attachment` if nothing is left."""
    return F.coalesce(F.nullif(sanitize_filename(title, 1 << 30), F.lit("")), F.lit("attachment"))


def attachment_path(identifier: Column, url: Column, title: Column) -> Column:
    """Where an issue's attachment is stored."""
    name = F.coalesce(F.nullif(sanitize_filename(filename_from_url(url)), F.lit("")), attachment_title(title))
    return F.concat(F.lit("attachments/"), identifier, F.lit("/"), name)


def team_filter(teams: DataFrame, keys: list[str]) -> DataFrame:
    """The teams of these keys; all of them if there are no keys."""
    return teams.where(F.col("key").isin(keys)) if keys else teams
