"""Operator 9: exact top-k inner products by Fagin's threshold algorithm.

Candidates are dealt to shards of bounded size; a shard is stored with, for
each dimension, the order of its members by that component. Queries go in
blocks. A query walks its dimensions' lists from the end that its sign prefers,
a deeper slice at a time, scores what it has not seen by random access, and
stops when the sum over dimensions of what the lists still offer cannot reach
its k-th score so far. That bound crosses shards: all queries first search one
pilot shard, and then go through chains of the others, starting at the k-th
score of the pilot and raising it from shard to shard. A chain hands back only
what may still win; the lists of the chains are merged at the end.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm._arrow import groups
from gleaner.llm._vectors import valid
from gleaner.runtime import materialise, private, with_row_ids

K = 10
SCALE = 1024
#: Vectors and components of a shard at most; bytes of the queries of a block; shards of a chain.
SHARD, SHARD_CELLS = 4096, 1 << 20
QUERY_BYTES = 8 << 20
CHAIN = 4
#: Bounds of a long: components beyond take no part, scores beyond are given as the bound.
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1
_FIRST_DEPTH = 16


def threshold_search(
    x: np.ndarray, order: np.ndarray, ids: np.ndarray, q: np.ndarray, k: int, own: int = -1, floor: float | int | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Rows and scores of the k largest inner products of `q` with rows of `x`, ties to smaller ids; row `own` takes no part.

    order[d] lists the rows by falling component d. Scores below `floor` are
    not wanted: the walk may stop, and leaves them out.
    """
    n = len(x)
    dims = np.flatnonzero(q)
    seen = np.zeros(n, bool)
    if own >= 0:
        seen[own] = True
    rows, scores = np.zeros(0, np.int64), np.zeros(0, x.dtype)
    done, depth = 0, min(n, _FIRST_DEPTH)
    if not len(dims):
        dims = np.zeros(1, np.int64)
    down = q[dims] >= 0
    while True:
        ahead, back = order[dims[down], done:depth], order[dims[~down], n - depth : n - done]
        fresh = np.zeros(n, bool)
        fresh[ahead.reshape(-1)] = True
        fresh[back.reshape(-1)] = True
        new = np.flatnonzero(fresh & ~seen)
        seen[new] = True
        rows, scores = np.concatenate((rows, new)), np.concatenate((scores, x[new] @ q))
        if len(rows) > k:
            least = np.partition(scores, len(scores) - k)[len(scores) - k]
            keep = scores >= least
            rows, scores = rows[keep], scores[keep]
        if depth == n:
            break
        offered = np.where(down, x[order[dims, depth - 1], dims], x[order[dims, n - depth], dims])
        bound = scores.min() if len(rows) >= k else floor
        if floor is not None and bound < floor:
            bound = floor
        if bound is not None and (offered * q[dims]).sum() < bound:
            break
        done, depth = depth, min(n, 2 * depth)
    if floor is not None:
        keep = scores >= floor
        rows, scores = rows[keep], scores[keep]
    best = np.lexsort((ids[rows], -scores))[:k]
    return rows[best], scores[best]


def _narrow(x: np.ndarray) -> np.ndarray:
    """`x` in the narrowest whole numbers that hold it, so that a shard is sent to each query block in few bytes."""
    low, high = x.min(initial=0), x.max(initial=0)
    return x.astype(next(t for t in ("<i2", "<i4", "<i8") if np.iinfo(t).min <= low and high <= np.iinfo(t).max))


def _wide(raw: bytes, rows: int, width: int) -> np.ndarray:
    """The matrix of `_narrow`'s bytes, as longs."""
    cell = len(raw) // max(1, rows * width)
    return np.frombuffer(raw, f"<i{max(2, cell)}").reshape(rows, width).astype(np.int64)


def _packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each shard or query block: its uids, ids and matrix, the sorted lists of a shard, and the floors of queries."""
    for g in groups(batches, ["block"]):
        x = np.array(g.column("vector").to_pylist(), np.int64)
        is_shard = not g.column("is_query")[0].as_py()
        place = "<u2" if len(x) <= 1 << 16 else "<u4"
        order = np.argsort(-x, axis=0, kind="stable").T.astype(place) if is_shard else np.zeros(0, place)
        first = [g.column(c).combine_chunks().slice(0, 1) for c in ("block", "is_query", "width")]
        raw = [g.column("uid").to_numpy().tobytes(), g.column("id").to_numpy().tobytes(), _narrow(x).tobytes(), order.tobytes()]
        floors = pa.array([g.column("floor").to_pylist()], pa.list_(pa.int64()))
        yield pa.record_batch([*first, *(pa.array([v], pa.binary()) for v in raw), floors], ["block", "is_query", "width", "uids", "ids", "matrix", "lists", "floors"])


_PACKED = "block string, is_query boolean, width int, uids binary, ids binary, matrix binary, lists binary, floors array<long>"


class _Block:
    """A block of queries on its way along a chain of shards: the best of each so far."""

    def __init__(self, row: dict, k: int):
        self.k = k
        self.uids, self.ids = (np.frombuffer(row[c], np.int64) for c in ("uids", "ids"))
        self.q = _wide(row["matrix"], len(self.uids), row["width"])
        self.floors = row["floors"]
        self.best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, object))] * len(self.uids)

    def pass_by(self, row: dict) -> None:
        uids, ids = (np.frombuffer(row[c], np.int64) for c in ("uids", "ids"))
        x = _wide(row["matrix"], len(uids), row["width"])
        order = np.frombuffer(row["lists"], "<u2" if len(uids) <= 1 << 16 else "<u4").reshape(row["width"], -1)
        q = self.q
        largest = lambda m: float(np.abs(m.astype(np.float64)).max(initial=0))
        if row["width"] * largest(q) * largest(x) < 2**53:
            q, x = q.astype(np.float64), x.astype(np.float64)  # exact, and a fast product
        else:
            q, x = q.astype(object), x.astype(object)
        place = {u: i for i, u in enumerate(uids.tolist())}
        for i, u in enumerate(self.uids.tolist()):
            known, scores = self.best[i]
            floor = scores[-1] if len(scores) == self.k else self.floors[i]
            at, found = threshold_search(x, order, ids, q[i], self.k, place.get(u, -1), floor)
            if len(at):
                known, scores = np.concatenate((known, ids[at])), np.concatenate((scores, [int(s) for s in found]))
                best = np.lexsort((known, -scores))[: self.k]
                self.best[i] = known[best], scores[best]

    def rows(self) -> pa.RecordBatch:
        n = [len(known) for known, _ in self.best]
        out = [np.repeat(self.uids, n).tolist(), np.repeat(self.ids, n).tolist(), [], []]
        for known, scores in self.best:
            out[2] += known.tolist()
            out[3] += [min(max(s, _LEAST), _MOST) for s in scores.tolist()]
        return pa.record_batch([pa.array(c, pa.int64()) for c in out], ["query_uid", "query_id", "vec_id", "score"])


def _searched(k: int):
    """Units of a query block and the shards of a chain, the queries first; one shard is held at a time."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, block = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if row["unit"] != unit:
                    if block is not None:
                        yield block.rows()
                    unit, block = row["unit"], None
                if row["is_query"]:
                    block = _Block(row, k)
                elif block is not None:
                    block.pass_by(row)
        if block is not None:
            yield block.rows()

    return run


def _whole(v: np.ndarray | None, scale: int) -> np.ndarray | None:
    """floor(scale * v) as longs; None where a component is beyond them."""
    if v is None:
        return None
    with np.errstate(over="ignore"):
        w = np.floor(scale * v)
    return w.astype(np.int64) if np.abs(w).max(initial=0) < 2.0**63 else None


def _quantised(scale: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = [_whole(v, scale) for v in valid(batch.column(2))]
            keep = pa.array([v is not None for v in vectors], pa.bool_())
            width = pa.array([0 if v is None else len(v) for v in vectors], pa.int32())
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(vectors, pa.list_(pa.int64())), width], ["uid", "id", "vector", "width"]).filter(keep)

    return run


def top_k(
    vectors: DataFrame, is_query: Column, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE,
    shard: int = SHARD, query_block: int | None = None, chain: int = CHAIN,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where `is_query` holds, the k highest integer inner products.

    Components become floor(scale * x). Every other row of the same width is a
    candidate. Defined cases: vectors that are null, empty, hold null or
    non-finite components or one whose integer is beyond a long, and rows
    without an id, take no part; equal scores go by smaller id; of repeated rows
    each is a query and a candidate for the others; fewer candidates than k are
    all given; an empty table gives no rows; a score beyond a long is given as
    the nearest long, and ranks among such by id between chains.

    A shard is sent once to each block of `query_block` queries, by default as
    many as fill QUERY_BYTES, so what is shuffled grows with shards times blocks.
    """
    (uid,) = private(vectors, "uid")
    tagged = with_row_ids(vectors.where(F.col(id_col).isNotNull()), id_col, uid)
    source = tagged.select(F.col(uid).alias("uid"), F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    known = materialise(source.mapInArrow(_quantised(scale), "uid long, id long, vector array<long>, width int"), "vectors")
    asked = tagged.where(is_query).select(F.col(uid).alias("uid"))
    asked = materialise(known.join(asked, "uid", "left_semi"), "queries")
    counted = lambda rows: {r.width: r.n for r in rows.groupBy("width").agg(F.count(F.lit(1)).alias("n")).collect()}
    shards_of = {w: -(-n // max(1, min(shard, SHARD_CELLS // w))) for w, n in counted(known).items()}
    blocks_of = {w: -(-n // (query_block or max(1, QUERY_BYTES // (8 * w)))) for w, n in counted(asked).items()}
    by_width = lambda table: F.coalesce(*(F.when(F.col("width") == w, F.lit(n)) for w, n in table.items()), F.lit(1)).cast("long")

    def dealt(rows: DataFrame, parts: dict[int, int], query: bool) -> DataFrame:
        block = F.concat_ws("/", "width", F.pmod(F.xxhash64("uid"), by_width(parts)))
        rows = rows.withColumn("block", block).withColumn("is_query", F.lit(query))
        if not query:
            rows = rows.withColumn("floor", F.lit(None).cast("long"))
        return rows.repartition("block").sortWithinPartitions("block").mapInArrow(_packed, _PACKED)

    shards = materialise(dealt(known, shards_of, False), "shards")
    number = F.substring_index("block", "/", -1).cast("long")

    def searched(queries: DataFrame, candidates: DataFrame, chains: Column) -> DataFrame:
        """The best of each query in each chain of `candidates`."""
        unit = lambda block, c: F.concat_ws("/", "width", block, c)
        others = F.transform(F.sequence(F.lit(0).cast("long"), by_width(blocks_of) - 1), lambda j: unit(j, F.pmod(number, chains)))
        owns = F.transform(F.sequence(F.lit(0).cast("long"), chains - 1), lambda c: unit(number, c))
        units = candidates.withColumn("unit", F.explode(others)).unionByName(queries.withColumn("unit", F.explode(owns)))
        keyed = units.repartition("unit").sortWithinPartitions("unit", F.desc("is_query"), "block")
        return keyed.mapInArrow(_searched(k), "query_uid long, query_id long, vec_id long, score long")

    queries = dealt(asked.withColumn("floor", F.lit(None).cast("long")), blocks_of, True)
    pilot = materialise(searched(queries, shards.where(number == 0), F.lit(1).cast("long")), "pilot")
    floors = pilot.groupBy(F.col("query_uid").alias("uid")).agg(F.min("score").alias("floor"), F.count(F.lit(1)).alias("n")).where(F.col("n") == k).drop("n")
    queries = materialise(dealt(asked.join(floors, "uid", "left"), blocks_of, True), "blocks")
    chains = F.greatest(F.ceil((by_width(shards_of) - 1) / chain), F.lit(1)).cast("long")
    found = pilot.unionByName(searched(queries, shards.where(number > 0), chains))
    order = Window.partitionBy("query_uid").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
