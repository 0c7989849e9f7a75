"""Indexes as segments: what an update writes is what it changed, and a pointer says which segments count.

A commit adds at most one segment to each table, and tombstones: keys whose
rows in earlier segments are dead. Reading a table is the union of its segments
less dead rows. When there are many segments, the newest of them whose bytes
together outweigh the next older one are merged, so that a row is written again a
logarithmic number of times. Nothing that a pointer names is ever altered.

Commits are optimistic. A writer reads a snapshot, and its commit names the
tables it read and wrote. If a later version exists by then, the commit is carried over to
it, unless one of those tables has changed in between: then `Conflict` is raised
and nothing is lost. What no pointer names any more is deleted once its
successor is older than the retention, so that a reader has that long to finish.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.operators import ranking as R
from gleaner.runtime import discard, materialise

FILES = "path string, content_hash string, size bigint, mtime_ms bigint, indexed_at string, metadata string"
CHUNKS = "path string, chunk_index bigint, content string, embedding array<float>, content_hash string, section_context string, content_timestamp_ms bigint, cell int, reach double"
PAGES = "document_id string, page_number int, image_hash string, adapter_name string, num_vectors int, source_path string, indexed_at string"
PAGE_VECTORS = "document_id string, page_number int, vector_index int, embedding array<float>"
POSTINGS = "term string, path string, chunk_index bigint, tf bigint, positions array<int>, block bigint, dl int"
LENGTHS = "path string, chunk_index bigint, dl int"
_SCHEMAS = {"files": FILES, "chunks": CHUNKS, "postings": POSTINGS, "lengths": LENGTHS, "impacts": R.IMPACTS, "cells": R.CELLS, "page_images": PAGES, "page_vectors": PAGE_VECTORS, "page_bounds": f"document_id string, page_number int, {R.PAGE_BOUNDS}"}
#: Tables whose rows die together, by the same keys.
FAMILY = {"files": "files", "chunks": "content", "postings": "content", "lengths": "content", "page_images": "pages", "page_vectors": "pages", "page_bounds": "pages"}
KEYS = {"files": ["path"], "content": ["path"], "pages": ["document_id", "page_number"]}
#: Columns by which a table's segments are sorted, so that a filter on the first reads few row groups.
SORTED = {"postings": ["term", "block", "path", "chunk_index"], "impacts": ["term", "block"], "chunks": ["cell", "reach"]}
MOST_SEGMENTS = 8
RETENTION_MS = 3_600_000
#: Tombstones of at most so many rows and stored bytes are broadcast; the pointer knows both.
SMALL_ROWS, SMALL_BYTES = 500_000, 16 << 20

State = dict


class Conflict(RuntimeError):
    """Another writer has changed what this one read or wrote; start again from a fresh snapshot."""


class Snapshot:
    """One version of an index; all its tables are of the same commit."""

    def __init__(self, index: Index, version: int, state: State):
        self.index, self.version, self.state = index, version, state

    @property
    def meta(self) -> dict[str, str]:
        return self.state["meta"]

    def parts(self, name: str) -> list[dict]:
        """The segments of a table: commit number, folder, rows and bytes of each."""
        return self.state["tables"].get(name, [])

    def rows(self, name: str) -> int:
        """Rows in all segments, dead ones too."""
        return sum(p["rows"] for p in self.parts(name))

    def _scan(self, name: str, parts: list[dict]) -> DataFrame:
        return self.index.spark.read.schema(_SCHEMAS[name]).parquet(*(f"{self.index.path}/{name}/{p['at']}" for p in parts))

    def _dead(self, family: str, after: int, upto: int | None = None) -> DataFrame | None:
        """(keys, _upto): tombstones of commits above `after`; what is older than `_upto` is dead."""
        graves = [g for g in self.state["gone"].get(family, []) if g["seq"] > after and (upto is None or g["seq"] <= upto)]
        if not graves:
            return None
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in self.index.empty(_of(family)).select(*KEYS[family]).schema)
        read = lambda g: self.index.spark.read.schema(schema).parquet(f"{self.index.path}/gone_{family}/{g['at']}").withColumn("_upto", F.lit(g["seq"]))
        dead = reduce(DataFrame.unionByName, map(read, graves)).groupBy(*KEYS[family]).agg(F.max("_upto").alias("_upto"))
        few = sum(g["rows"] for g in graves) <= SMALL_ROWS and sum(g["bytes"] for g in graves) <= SMALL_BYTES
        return F.broadcast(dead) if few else dead

    def _tagged(self, name: str, parts: list[dict]) -> DataFrame:
        """The rows of some segments with their commit as `part`."""
        return reduce(DataFrame.unionByName, (self._scan(name, [p]).withColumn("part", F.lit(p["seq"])) for p in parts))

    def live(self, name: str, parts: list[dict], upto: int | None = None, how: str = "left_anti", tagged: bool = False) -> DataFrame:
        """The rows of some segments that are not dead by tombstones up to a commit; the dead ones with `how` left_semi.

        With `tagged` they have the commit of their segment as `part`.
        """
        scan = lambda ps: self._tagged(name, ps) if tagged else self._scan(name, ps)
        none = self.index.empty(name).withColumn("part", F.lit(0)) if tagged else self.index.empty(name)
        dead = self._dead(FAMILY[name], min(p["seq"] for p in parts), upto) if parts else None
        if dead is None:
            return scan(parts) if parts and how == "left_anti" else none
        last = max(g["seq"] for g in self.state["gone"][FAMILY[name]] if upto is None or g["seq"] <= upto)
        fresh, old = [p for p in parts if p["seq"] >= last], [p for p in parts if p["seq"] < last]
        dated = self._tagged(name, old)
        on = reduce(lambda a, b: a & b, (dated[k].eqNullSafe(dead[k]) for k in KEYS[FAMILY[name]]), dated["part"] < dead["_upto"])
        found = dated.join(dead, on, how)
        found = found if tagged else found.drop("part")
        return found.unionByName(scan(fresh)) if fresh and how == "left_anti" else found

    def keyword_search(self) -> R.BlockSearch:
        """A keyword search of the live rows by blocks; the pointer has the corpus statistics."""
        parts = self.parts("postings")
        n, total = int(self.meta.get("total_chunks", 0)), int(self.meta.get("total_dl", 0))
        posts = self.live("postings", parts, tagged=True).select("term", F.struct("path", "chunk_index").alias("id"), "positions", "part", "block", "dl")
        impacts = self._tagged("impacts", self.parts("impacts")) if self.parts("impacts") else self.index.empty("impacts").withColumn("part", F.lit(0))
        dead = self.live("postings", parts, how="left_semi").select("term") if parts and self._dead("content", parts[0]["seq"]) is not None else None
        return R.BlockSearch(posts, impacts, n, total / n if n else 0.0, dead)

    def vector_search(self, key: Column | None = None) -> R.CellSearch:
        """A search of the live vectors by cells; ties go to the smaller `key`, the path and chunk unless given."""
        rows = self.live("chunks", self.parts("chunks"), tagged=True).select((F.struct("path", "chunk_index") if key is None else key).alias("id"), "embedding", "part", "cell", "reach")
        cells = self._tagged("cells", self.parts("cells")) if self.parts("cells") else self.index.empty("cells").withColumn("part", F.lit(0))
        return R.CellSearch(rows, cells)

    def table(self, name: str) -> DataFrame:
        """The live rows of a table; columns added since a segment was written read as null."""
        return self.live(name, self.parts(name))


def _arranged(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Tables of a segment: postings get blocks and lengths unless they have them, and impacts beside them; chunks get cells of their vectors; pages get bounds."""
    if "chunks" in tables:
        chunks, cells = R.celled(tables["chunks"].drop("cell", "reach"))
        tables = tables | {"chunks": chunks, "cells": cells}
    if "page_vectors" in tables and "page_bounds" not in tables:
        page = F.to_json(F.struct("document_id", "page_number")).alias("page")
        bounds = R.page_bounds(tables["page_vectors"].select(page, "embedding"), "page")
        bounds = bounds.withColumn("page", F.from_json("page", "document_id string, page_number int"))
        tables = tables | {"page_bounds": bounds.select("page.*", "width", "centre", "radius")}
    if "postings" not in tables:
        return tables
    posts = tables["postings"]
    if "block" not in posts.columns:
        posts = R.blocked(posts, tables["lengths"], ["path", "chunk_index"])
    # Read by the sort of the postings, which samples them first, and by the impacts.
    posts = materialise(posts.select("term", "path", "chunk_index", "tf", "positions", "block", "dl"), "postings")
    return tables | {"postings": posts, "impacts": R.impacts(posts)}


def _of(family: str) -> str:
    return next(name for name, f in FAMILY.items() if f == family)


class Index:
    """One index below a root that all executors share."""

    def __init__(self, spark: SparkSession, root: str, name: str, retention_ms: int = RETENTION_MS, most_segments: int = MOST_SEGMENTS):
        self.spark, self.name, self.path, self.retention_ms, self.most_segments = spark, name, f"{root.rstrip('/')}/{name}", retention_ms, most_segments
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def empty(self, name: str) -> DataFrame:
        return self.spark.createDataFrame([], _SCHEMAS[name])

    # ---- versions

    def _pointers(self) -> list[int]:
        at = self._path(f"{self.path}/pointers")
        if not self._fs.exists(at):
            return []
        names = (s.getPath().getName() for s in self._fs.listStatus(at))
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))

    def _state(self, version: int) -> State:
        stream = self._fs.open(self._path(f"{self.path}/pointers/{version:09d}.json"))
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def snapshot(self) -> Snapshot:
        """The newest version, to read or to commit against."""
        version = max(self._pointers(), default=0)
        return Snapshot(self, version, self._state(version) if version else {"tables": {}, "gone": {}, "meta": {}})

    @property
    def exists(self) -> bool:
        return bool(self._pointers())

    def meta(self) -> dict[str, str]:
        return self.snapshot().meta

    def table(self, name: str) -> DataFrame:
        """The live rows of a table in the newest version."""
        return self.snapshot().table(name)

    def status(self) -> dict[str, object]:
        snap = self.snapshot()
        return {"name": self.name, **snap.meta} if snap.version else {"name": self.name, "error": "no such index"}

    def delete(self) -> None:
        self._fs.delete(self._path(self.path), True)

    # ---- commits

    def _publish(self, version: int, state: State) -> bool:
        """Make the pointer of a version, whole or not at all; false if the version is there already."""
        at, temporary = f"{self.path}/pointers/{version:09d}.json", f"{self.path}/pointers/.{uuid.uuid4().hex}.tmp"
        stream = self._fs.create(self._path(temporary), True)
        stream.write(bytearray(json.dumps(state, indent=1).encode()))
        stream.close()
        if self._fs.getUri().getScheme() == "file":
            # A local rename replaces its target; a link does not.
            local = lambda p: self._path(p).toUri().getPath()
            try:
                os.link(local(temporary), local(at))
                made = True
            except FileExistsError:
                made = False
            self._fs.delete(self._path(temporary), False)
            return made
        made = not self._fs.exists(self._path(at)) and self._fs.rename(self._path(temporary), self._path(at))
        if not made:
            self._fs.delete(self._path(temporary), False)
        return made

    def _apply(self, base: Snapshot, change: Callable[[State, int], State], reads: set[str], writes: set[str]) -> Snapshot:
        """Publish `change` on the newest version, unless tables that it read or wrote have changed since `base`."""
        while True:
            now = self.snapshot()
            if now.version < base.version:
                raise Conflict(f"{self.path} was deleted")
            for version in range(base.version + 1, now.version + 1):
                try:
                    theirs = set(self._state(version)["changed"])
                except Exception as error:
                    raise Conflict(f"version {version} of {self.path} is gone") from error
                if met := theirs & (reads | writes):
                    raise Conflict(f"version {version} of {self.path} has changed {', '.join(sorted(met))}")
            state = change(json.loads(json.dumps(now.state)), now.version + 1) | {"changed": sorted(writes)}
            if self._publish(now.version + 1, state):
                self.vacuum()
                return Snapshot(self, now.version + 1, state)

    def _write(self, folder: str, df: DataFrame, order: list[str] | None = None) -> dict | None:
        """Write a segment; none where there are no rows."""
        at = uuid.uuid4().hex
        path = f"{self.path}/{folder}/{at}"
        if order:
            df = df.repartitionByRange(*order[:2]).sortWithinPartitions(*order)
        df.write.parquet(path)
        rows = self.spark.read.schema(df.schema).parquet(path).count()
        if not rows:
            self._fs.delete(self._path(path), True)
            return None
        return {"at": at, "rows": rows, "bytes": self._fs.getContentSummary(self._path(path)).getLength()}

    def commit(
        self, base: Snapshot, append: dict[str, DataFrame] | None = None, gone: dict[str, DataFrame] | None = None, meta: dict[str, object] | None = None, reads: tuple[str, ...] = (),
        replace: dict[str, DataFrame] | None = None,
    ) -> Snapshot:
        """Add segments and tombstones (a family's keys) to what `base` was, or whole new tables, with meta values, all at once.

        Keys that go and come in one commit are replaced. `reads` names tables
        that the new rows depend on besides those written.
        """
        arranged = _arranged(append or {})
        parts = {n: self._write(n, df, SORTED.get(n)) for n, df in {**arranged, **(replace or {})}.items()}
        discard(arranged.get("postings"))
        graves = {f: self._write(f"gone_{f}", df.select(*KEYS[f]).distinct()) for f, df in (gone or {}).items()}
        writes = {n for n, p in parts.items() if p or n in (replace or {})} | {n for n, f in FAMILY.items() if graves.get(f)}

        def change(state: State, seq: int) -> State:
            for name, part in parts.items():
                old = [] if name in (replace or {}) else state["tables"].get(name, [])
                state["tables"][name] = old + ([part | {"seq": seq}] if part else [])
            for family, grave in graves.items():
                state["gone"][family] = state["gone"].get(family, []) + ([grave | {"seq": seq}] if grave else [])
            state["meta"] |= {k: str(v) for k, v in (meta or {}).items()}
            return state

        try:
            return self._apply(base, change, set(reads), writes)
        except Conflict:
            for folder, made in [*parts.items(), *((f"gone_{f}", g) for f, g in graves.items())]:
                if made:
                    self._fs.delete(self._path(f"{self.path}/{folder}/{made['at']}"), True)
            raise

    def set_meta(self, **values: object) -> None:
        self.commit(self.snapshot(), meta=values)

    def replace(self, meta: dict[str, object] | None = None, base: Snapshot | None = None, **tables: DataFrame) -> Snapshot:
        """Write tables anew, and meta values, in one commit against `base` (the version that is newest when the call begins)."""
        return self.commit(base or self.snapshot(), meta=meta, replace=tables)

    # ---- upkeep

    def segments(self) -> list[tuple[int, int]]:
        """(commit number, bytes) of the segments of all tables, oldest first."""
        sizes: dict[int, int] = {}
        for parts in self.snapshot().state["tables"].values():
            for p in parts:
                sizes[p["seq"]] = sizes.get(p["seq"], 0) + p["bytes"]
        return sorted(sizes.items())

    def compact(self, most: int | None = None, full: bool = False) -> bool:
        """Merge the newest segments into one if there are more than `most` (the index's own limit), or all of them if `full`; whether it did.

        The oldest segment to be merged is the first that those after it outweigh
        together, so sizes fall geometrically and merges cost a logarithmic share. Contents
        do not change: updates that run meanwhile are carried over, and are not undone.
        """
        base, sizes = self.snapshot(), self.segments()
        graves = [g["seq"] for own in base.state["gone"].values() for g in own]
        if not sizes or not (full and len(sizes) + len(graves) > 1 or len(sizes) > max(1, most or self.most_segments)):
            return False
        after = [sum(b for _, b in sizes[i + 1 :]) for i in range(len(sizes))]
        start = 0 if full else next((i for i, (_, b) in enumerate(sizes) if b <= after[i]), len(sizes) - 2)
        first, last = sizes[start][0], max(sizes[-1][0], *graves, 0)
        # With the oldest segment, tombstones of the merged commits have nothing left to act on.
        within = {n: [p for p in base.parts(n) if first <= p["seq"] <= last] for n in _SCHEMAS}
        due = {n for n, f in FAMILY.items() if len(within[n]) > 1 or within[n] and base._dead(f, within[n][0]["seq"], last) is not None}
        if within["postings"] and due & {"postings", "lengths"}:
            due |= {"postings", "lengths"}
        live = {n: base.live(n, within[n], last) for n in due}
        merged = arranged = _arranged(live | ({"postings": live["postings"].drop("block", "dl")} if "postings" in live else {}))
        used = {n: {p["at"] for p in within[n]} for n in merged}
        merged = {n: self._write(n, df, SORTED.get(n)) for n, df in merged.items()}
        discard(arranged.get("postings"))
        oldest = {f: min((p["seq"] for n, fam in FAMILY.items() if fam == f for p in base.parts(n)), default=0) for f in KEYS}
        graves, buried = {}, {}
        for family, old in base.state["gone"].items():
            own = [g for g in old if first <= g["seq"] <= last]
            if own and (first <= oldest[family] or len(own) > 1):
                buried[family] = {g["at"] for g in own}
                made = None if first <= oldest[family] else self._write(f"gone_{family}", base._dead(family, first - 1, last).select(*KEYS[family]))
                # Segments left as they are have no tombstone of the merged commits after them.
                graves[family] = made and made | {"seq": max(g["seq"] for g in own)}
        merged = {n: part and part | {"seq": last} for n, part in merged.items()}

        def change(state: State, seq: int) -> State:
            for group, made, taken in ((state["tables"], merged, used), (state["gone"], graves, buried)):
                for name, ats in taken.items():
                    have = group.get(name, [])
                    if not ats <= {p["at"] for p in have}:
                        raise Conflict(f"segments of {name} in {self.path} were merged or replaced by another writer")
                    rest = [p for p in have if p["at"] not in ats]
                    group[name] = sorted(rest + ([made[name]] if made[name] else []), key=lambda p: p["seq"])
            return state

        self._apply(base, change, set(), set())
        return True

    def vacuum(self, retention_ms: int | None = None) -> None:
        """Delete versions whose successor is older than the retention, and the folders that only they name; the last two stay."""
        keep = self.retention_ms if retention_ms is None else retention_ms
        if len(numbers := self._pointers()) < 3:
            return
        made = {s.getPath().getName(): s.getModificationTime() for s in self._fs.listStatus(self._path(f"{self.path}/pointers"))}
        now = self.spark.sparkContext._jvm.java.lang.System.currentTimeMillis()
        old = [n for n, after in zip(numbers[:-2], numbers[1:-1]) if now - made[f"{after:09d}.json"] >= keep]
        if not old:
            return
        named = lambda s: {f"{n}/{p['at']}" for n, parts in s["tables"].items() for p in parts} | {f"gone_{f}/{g['at']}" for f, graves in s["gone"].items() for g in graves}
        kept = set().union(*(named(self._state(n)) for n in numbers if n not in old))
        for n in old:
            for folder in named(self._state(n)) - kept:
                self._fs.delete(self._path(f"{self.path}/{folder}"), True)
            self._fs.delete(self._path(f"{self.path}/pointers/{n:09d}.json"), False)
