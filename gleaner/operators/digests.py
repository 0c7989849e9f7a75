"""Differences of large keyed tables by trees of digests, so that only what lies below a differing node is compared.

Rows fall into leaves by the leading bits of their key's hash, and a node's
digest is the number of rows below it, the exclusive or of one hash of them and
the exact sum of another. A tree is small beside its table, is kept with it, and
is descended level by level, from the root to the leaves that differ.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.operators.rollups import diff_status
from gleaner.runtime import checked_join, discard, materialise, private

#: Rows of a leaf, about; bits of the hash from one level to the next.
LEAF_ROWS = 256
STEP = 4
MOST_BITS = 60
_DIGEST = ("n", "mixed", "total")


def leaf_bits(rows: int, leaf_rows: int = LEAF_ROWS) -> int:
    """The bits that name a leaf, in whole levels, for a table of so many rows."""
    levels = math.ceil(math.log2(max(1, rows / leaf_rows)) / STEP)
    return min(MOST_BITS, max(1, levels) * STEP)


def _leaf(key: str, bits: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(key), 64 - bits)


def digest_tree(rows: DataFrame, key: str, versions: list[str], bits: int) -> DataFrame:
    """(level, node, n, mixed, total) for each node that has rows; `level` is the bits that name it.

    One aggregation of the rows, combined before its shuffle, and one of the
    leaves. A null version is a version; rows that repeat a key all count.
    """
    hashed = rows.select(_leaf(key, bits).alias("leaf"), F.xxhash64(key, *versions).alias("a"), F.xxhash64(F.lit(1), *versions, key, *(F.col(v).isNull() for v in versions)).alias("b"))
    total = F.sum(F.col("b").cast("decimal(20,0)")).cast("decimal(38,0)")
    leaves = materialise(hashed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), F.bit_xor("a").alias("mixed"), total.alias("total")), "leaves")
    levels = F.explode(F.sequence(F.lit(0), F.lit(bits), F.lit(STEP)))
    nodes = leaves.withColumn("level", levels).withColumn("node", F.expr(f"shiftright(leaf, {bits} - level)"))
    return nodes.groupBy("level", "node").agg(F.sum("n").alias("n"), F.bit_xor("mixed").alias("mixed"), F.sum("total").cast("decimal(38,0)").alias("total"))


def differing_leaves(stored: DataFrame, current: DataFrame, bits: int) -> DataFrame:
    """(node): the leaves whose digests differ between two trees, found by descending only where a parent differs."""
    wanted = None
    for level in range(0, bits + 1, STEP):
        sides = []
        for tree, side in ((stored, "s"), (current, "c")):
            nodes = tree.where(F.col("level") == level).select("node", *_DIGEST)
            if wanted is not None:
                nodes = checked_join(nodes.withColumn("above", F.shiftright("node", STEP)), wanted.withColumnRenamed("node", "above"), "above", "left_semi")
            sides.append(nodes.select("node", F.struct(*_DIGEST).alias(side)))
        found = sides[0].join(sides[1], "node", "full").where(~F.col("s").eqNullSafe(F.col("c"))).select("node")
        wanted, above = materialise(found, "differing"), wanted
        discard(above)
        if wanted.isEmpty():
            break
    return wanted


def tree_diff(stored: DataFrame, current: DataFrame, key: str, version: str, mtime: str | None = None, tree: DataFrame | None = None, bits: int | None = None) -> DataFrame:
    """(key, status): what `diff_status` gives but for unchanged rows, by comparing only rows of differing leaves.

    `tree` is the stored table's tree of `bits`, kept from the time it was
    written; without one it is made. What is shuffled by key grows with the
    changes, not with the tables. Keys occur once a table; a null key is equal
    to none, so its rows are new or pruned wherever their leaf differs.
    """
    versions = [version] + ([mtime] if mtime else [])
    if tree is None:
        bits = bits or leaf_bits(stored.count())
        tree = materialise(digest_tree(stored, key, versions, bits), "tree")
    elif bits is None:
        raise ValueError("give the bits of the stored tree")
    leaves = differing_leaves(tree, materialise(digest_tree(current, key, versions, bits), "tree"), bits)

    def suspected(rows: DataFrame) -> DataFrame:
        (node,) = private(rows, "node")
        return checked_join(rows.withColumn(node, _leaf(key, bits)), leaves.withColumnRenamed("node", node), node, "left_semi").drop(node)

    return diff_status(suspected(stored), suspected(current), key, version, mtime).where("status <> 'unchanged'")
