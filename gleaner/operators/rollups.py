"""Groupings of mail, chat and issue records: threads, participants, channels, look-ups, trees, change logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.operators.ranking import previous
from gleaner.runtime import checked_join, discard, materialise, private


def ordered(rows: DataFrame, keys: list[str], order: list[str], fields: list[str]) -> DataFrame:
    """(keys, items): the rows of each key as one array of structs in order."""
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, *[f for f in fields if f not in order]))).alias("items"))


def first_seen(values: Column) -> Column:
    """The distinct values of an array in the order in which they first come."""
    return F.array_distinct(F.filter(values, lambda v: v.isNotNull()))


def thread_rollup(messages: DataFrame, thread: str, order: str, author: str, text: str, divider: str = "\n---\n") -> DataFrame:
    """(thread, message_count, participants, body): the messages of each thread in order."""
    groups = ordered(messages, [thread], [order], [author, text])
    shown = F.transform("items", lambda m: F.concat(F.lit("**From:** "), F.coalesce(m[author], F.lit("")), F.lit("\n\n"), F.coalesce(m[text], F.lit(""))))
    return groups.select(thread, F.size("items").cast("long").alias("message_count"), F.array_join(first_seen(F.transform("items", lambda m: m[author])), ",").alias("participants"), F.array_join(shown, divider).alias("body"))


def first_last(rows: DataFrame, key: str, ts: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("message_count"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))


def group_breaks(rows: DataFrame, keys: list[str], order: list[str], value: Column) -> DataFrame:
    """`rows` with `is_break`: whether the value differs from the row before within the keys; the first row breaks. Groups may have any size."""
    (before,) = private(rows, "before")
    return previous(rows, keys, order, value, before).withColumn("is_break", F.col(before).isNull() | (F.col(before) != value)).drop(before)


def lookup(rows: DataFrame, dimension: DataFrame, id_col: str, dim_id: str, name_col: str, out: str) -> DataFrame:
    """`rows` with `out`: the dimension's name for the id, or the id itself where there is none; rows are never lost."""
    names = dimension.select(F.col(dim_id).alias("_id"), F.col(name_col).alias("_name")).dropDuplicates(["_id"])
    joined = rows.join(names, F.col(id_col) == F.col("_id"), "left")
    return joined.withColumn(out, F.coalesce("_name", F.col(id_col).cast("string"))).drop("_id", "_name")


def names_of(rows: DataFrame, ids_col: str, names: DataFrame, out: str, keep_missing: bool = False) -> DataFrame:
    """`rows` with `out`: the names (id, name, the columns of `names` in order; each id once) of an array of ids in its order.

    Ids without a name are dropped or kept as they are; null where the array is null or nothing is left. Each
    different array is looked up once, so it does not matter whether rows repeat or what identifies them.
    """
    key, own, at, one, name = private(rows, "key", "own", "at", "one", "name")
    known = names.toDF(one, name)
    arrays = rows.select(F.col(ids_col).alias(key)).where(F.size(ids_col) > 0).distinct()
    # A null id has no name, and takes no part in the join.
    places = arrays.select(key, F.posexplode(key).alias(at, own)).join(known, F.col(own) == F.col(one), "left")
    said = F.coalesce(name, F.col(own).cast("string")) if keep_missing else F.col(name)
    found = places.where(said.isNotNull()).groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(at), said.alias(name)))), lambda x: x[name]).alias(out))
    return rows.drop(out).join(found, F.col(ids_col) == F.col(key), "left").drop(key)


def lookup_array(rows: DataFrame, dimension: DataFrame, row_id: str, ids_col: str, dim_id: str, name_col: str, out: str, keep_missing: bool = False) -> DataFrame:
    """`rows` with `out`: the names of an array of ids in its order; ids without a name are dropped or kept as they are."""
    names = dimension.select(F.col(dim_id), F.col(name_col)).dropDuplicates([dim_id])
    return names_of(rows, ids_col, names, out, keep_missing).withColumn(out, F.coalesce(out, F.array().cast("array<string>")))


def collision_suffix(rows: DataFrame, slug: str, id_col: str, out: str) -> DataFrame:
    """`rows` with `out`: the slug, and for all but the first of its owners the id behind two hyphens."""
    place = F.row_number().over(Window.partitionBy(slug).orderBy(id_col))
    return rows.withColumn(out, F.when(place == 1, F.col(slug)).otherwise(F.concat_ws("--", slug, F.col(id_col).cast("string"))))


def tree_paths(nodes: DataFrame, id_col: str, parent_col: str, name_col: str, most_depth: int | None = None) -> DataFrame:
    """(id_col, depth, path) of all nodes below a root (a node whose parent is null or absent).

    By pointer doubling: each round hangs what lies above a node's known stretch
    of path before it, so the rounds grow with the logarithm of the depth, and
    a parent of any number of children is one skewed join that AQE splits.
    Nodes on a cycle, and below one, hang from no root and give no row; of rows
    that repeat an id the one with the smallest parent counts, a root first; a
    null name is empty.
    """
    own = nodes.select(F.col(id_col).cast("string").alias("id"), F.col(parent_col).cast("string").alias("parent"), F.coalesce(F.col(name_col), F.lit("")).alias("name"))
    own = own.groupBy("id").agg(F.min(F.struct("parent", "name")).alias("row")).select("id", "row.*")
    known = own.select(F.col("id").alias("parent")).distinct().withColumn("has", F.lit(True))
    marked = own.join(known, "parent", "left").select("id", F.when(F.col("has"), F.col("parent")).alias("up"), F.array("name").alias("names"))
    state = materialise(marked, "paths")
    steps, most = 1, state.count()
    while steps <= most and not state.where("up IS NOT NULL").isEmpty():
        above = state.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("names").alias("before"))
        moved = state.where("up IS NOT NULL").join(above, "up").select("id", F.col("next").alias("up"), F.concat("before", "names").alias("names"))
        state, old = materialise(state.where("up IS NULL").unionByName(moved), "paths"), state
        discard(old)
        steps *= 2
    depth = (F.size("names") - 1).cast("long")
    found = state.where("up IS NULL").select(F.col("id").alias(id_col), depth.alias("depth"), F.array_join("names", "/").alias("path"))
    return found if most_depth is None else found.where(F.col("depth") <= most_depth)


def inverse_relations(relations: DataFrame, source: str, target: str, kind: str, inverse: dict[str, str]) -> DataFrame:
    """Relations and, with the type's inverse (unknown ones as they are), their mirrors; outgoing ones first."""
    named = F.create_map(*(F.lit(x) for pair in inverse.items() for x in pair)) if inverse else F.create_map().cast("map<string,string>")
    out = relations.select(F.col(source).alias("source"), F.col(target).alias("target"), F.col(kind).alias("kind"), F.lit(0).alias("direction"))
    back = relations.select(F.col(target).alias("source"), F.col(source).alias("target"), F.coalesce(F.try_element_at(named, F.col(kind)), F.col(kind)).alias("kind"), F.lit(1).alias("direction"))
    return out.unionByName(back)


def latest(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key, combined before the shuffle."""
    rest = [c for c in log.columns if c not in keys]
    top = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return top.select(*keys, "_row.*")


def apply_changes(state: DataFrame, log: DataFrame, keys: list[str], order: list[str], op: str = "op", deleted: str = "delete") -> DataFrame:
    """`state` after a change log: the last operation of each key wins, deletes remove, everything else upserts."""
    last = latest(log, keys, order)
    kept = state.join(last.select(*keys), keys, "left_anti")
    return kept.unionByName(last.where(F.col(op) != deleted).select(*state.columns))


def since(rows: DataFrame, marks: DataFrame, key: str, ts: str, mark: str = "high_water") -> DataFrame:
    """Rows newer than their key's high-water mark; keys without one are all new."""
    joined = checked_join(rows, marks.select(key, mark), key, "left")
    return joined.where(F.col(mark).isNull() | (F.col(ts) > F.col(mark))).drop(mark)


def high_water(rows: DataFrame, key: str, ts: str) -> DataFrame:
    return rows.groupBy(key).agg(F.max(ts).alias("high_water"))


def set_difference(wanted: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return wanted.join(done.select(key).distinct(), key, "left_anti")


def diff_status(stored: DataFrame, current: DataFrame, key: str, version: str, mtime: str | None = None) -> DataFrame:
    """(key, status): new, changed, touched (time only), unchanged or pruned, by one full join on the key."""
    s = stored.select(F.col(key), F.col(version).alias("_old"), *([F.col(mtime).alias("_then")] if mtime else []), F.lit(True).alias("_stored"))
    c = current.select(F.col(key), F.col(version).alias("_new"), *([F.col(mtime).alias("_now")] if mtime else []), F.lit(True).alias("_current"))
    status = F.when(F.col("_stored").isNull(), "new").when(F.col("_current").isNull(), "pruned")
    if mtime:
        status = status.when(F.col("_then") == F.col("_now"), "unchanged").when(F.col("_old") == F.col("_new"), "touched")
    status = status.when(F.col("_old").eqNullSafe(F.col("_new")), "unchanged").otherwise("changed")
    return s.join(c, key, "full").select(key, status.alias("status"))
