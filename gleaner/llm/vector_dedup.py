"""Operator 3: embedding near-duplicates by a robust-pruned flat graph.

Vectors are assigned to several of their nearest centres, fitted on a bounded
sample, which makes overlapping shards. A shard beyond the block size is split
by centres of its own, level by level, unless its vectors are mostly linked to
each other: then its block pairs do no more work than it has links. In each
shard (in blocks of bounded size) a graph is grown by insertion: a vector
searches the graph so far, takes the neighbours that robust pruning leaves of
what the search met (one goes if a kept one is much nearer to it), and is
offered to them in return; a second round searches the whole graph again. A
vector's lists from all its shards are united. Then every vector searches its
shards' graphs from the medoids, greedily with a beam, and from what lies
within range expands over all neighbours within range. Hits are verified by
cosine in double precision, and recall is audited against brute force for a
sample of queries; should it be low, the overlap is doubled.

Equal directions are one vertex from the start. Links are counted and joined to
components within a block pair, so no pair leaves its task.
"""

from __future__ import annotations

import hashlib
import logging
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.llm._arrow import groups
from gleaner.llm._graph import components
from gleaner.llm._vectors import matrix, valid
from gleaner.runtime import checked_join, discard, materialise, with_row_ids

THRESHOLD = 0.95
#: Vectors that centres are fitted on at most, those with the smallest hashes; and centres of the first level at most.
SAMPLE = 16_384
MOST_CENTRES = 1_024
#: Vectors that the centres of a split shard are fitted on; share of linked pairs among them from which it is not split;
#: levels of splitting, beyond which a large shard is left to block pairs; vectors that one task deals to centres.
SPLIT_SAMPLE, DENSE, LEVELS, SPLIT_ROWS = 2_048, 0.1, 6, 65_536
#: Vectors meant for a centre; nearest centres that a vector is assigned to; vectors of a block.
PER_CENTRE = 512
OVERLAP = 4
BLOCK = 4_096
#: Neighbours kept, the pool they are pruned from, the pruning factor, the beam, and how far below the threshold expansion goes.
DEGREE, POOL, PRUNE, BEAM, SLACK = 24, 24, 1.2, 12, 0.03
#: Groups of a block whose medoids searches enter at; vectors that a graph starts with.
MEDOIDS, SEED_ROWS = 32, 256
#: Queries of the audit, and the recall it asks for.
AUDIT, LEAST_RECALL = 256, 0.98

_log = logging.getLogger(__name__)


def _pruned(x: np.ndarray, rows: np.ndarray, near: np.ndarray, degree: int, factor: float) -> np.ndarray:
    """Robust pruning: of the candidates `near` (rows x m, -1 for none) of each row, up to `degree`, the nearest first."""
    out = np.full((len(rows), degree), -1, np.int64)
    x = x.astype(np.float32)  # single precision tells which neighbours to keep; hits are verified in double
    for a in range(0, len(rows), 256):
        own, some = near[a : a + 256], x[rows[a : a + 256]]
        known = (own >= 0) & (own != rows[a : a + 256, None])
        sims = np.where(known, np.einsum("id,ipd->ip", some, x[own]), -np.inf)
        order = np.argsort(-sims, axis=1, kind="stable")
        own, sims = np.take_along_axis(own, order, 1), np.take_along_axis(sims, order, 1)
        alive = np.isfinite(sims)
        between = np.matmul(x[own], x[own].transpose(0, 2, 1))
        distance = np.sqrt(np.maximum(0, 2 - 2 * np.where(alive, sims, -1)))
        among = np.sqrt(np.maximum(0, 2 - 2 * between))
        at = np.arange(len(own))
        for slot in range(degree):
            first = alive.argmax(axis=1)
            left = alive[at, first]
            if not left.any():
                break
            out[a + at[left], slot] = own[at, first][left]
            alive[at, first] = False
            alive &= ~((factor * among[at, first] <= distance) & left[:, None])
    return out


def _returned(x: np.ndarray, graph: np.ndarray, rows: np.ndarray, degree: int, pool: int, factor: float) -> None:
    """Offers each of `rows` to the neighbours it has chosen, which prune their lists again, in place."""
    u, col = np.nonzero(graph[rows] >= 0)
    u = rows[u]
    v = graph[rows][graph[rows] >= 0]
    order = np.lexsort((-np.einsum("id,id->i", x[u], x[v]), v))
    u, v = u[order], v[order]
    targets, first, n = np.unique(v, return_index=True, return_counts=True)
    place = np.arange(len(v)) - np.repeat(first, n)
    offered = np.full((len(targets), min(pool, int(n.max(initial=1)))), -1, np.int64)
    keep = place < offered.shape[1]
    offered[np.repeat(np.arange(len(targets)), n)[keep], place[keep]] = u[keep]
    graph[targets] = _pruned(x, targets, np.concatenate((graph[targets], offered), axis=1), degree, factor)


def pruned_graph(x: np.ndarray, degree: int = DEGREE, pool: int = POOL, factor: float = PRUNE) -> np.ndarray:
    """Neighbour rows (n x degree, -1 where there are fewer) of unit vectors: a graph grown by insertion, robustly pruned.

    The first few rows choose among themselves; then as many rows as the graph
    has are inserted at a time, each choosing from the nearest `pool` that its
    search of the graph so far has met; a second round of searches lets rows
    that came together find each other.
    """
    n = len(x)
    out = np.full((n, degree), -1, np.int64)
    if n < 2:
        return out
    turn = np.random.default_rng(n).permutation(n)
    y = x[turn]
    graph = np.full((n, degree), -1, np.int64)
    built = min(n, SEED_ROWS)
    first = np.arange(built)
    graph[first] = _pruned(y, first, np.broadcast_to(first, (built, built)), degree, factor)

    def chosen(rows: np.ndarray, size: int) -> None:
        """New neighbours of `rows` from searches of the first `size` rows' graph."""
        entries = medoids(y[:size])
        for a in range(0, len(rows), 256):
            own = rows[a : a + 256]
            sims = _beam(y[own], y[:size], graph[:size], np.broadcast_to(entries, (len(own), len(entries))), BEAM)[:, :size]
            most = min(pool, size)
            near = np.argpartition(-sims, most - 1, axis=1)[:, :most]
            near = np.where(np.isfinite(np.take_along_axis(sims, near, 1)), near, -1)
            graph[own] = _pruned(y, own, np.concatenate((graph[own], near), axis=1), degree, factor)

    while built < n:
        rows = np.arange(built, min(n, 2 * built))
        chosen(rows, built)
        _returned(y, graph, rows, degree, pool, factor)
        built += len(rows)
    if n > SEED_ROWS:
        chosen(np.arange(n), n)
        _returned(y, graph, np.arange(n), degree, pool, factor)
    out[turn] = np.where(graph >= 0, turn[graph], -1)
    return out


def medoids(x: np.ndarray, most: int = MEDOIDS) -> np.ndarray:
    """Rows nearest to the means of `most` groups of unit vectors, around evenly spaced pivots: where searches enter."""
    pivots = np.linspace(0, len(x) - 1, min(most, len(x))).astype(int)
    group = (x @ x[pivots].T).argmax(axis=1)
    total = np.zeros((len(pivots), x.shape[1]))
    np.add.at(total, group, x)
    sims = np.where(group[:, None] == np.arange(len(pivots)), x @ total.T, -np.inf)
    best = sims.argmax(axis=0)
    return np.where(np.isfinite(sims[best, np.arange(len(pivots))]), best, pivots)


def _undirected(adjacency: np.ndarray) -> np.ndarray:
    """Neighbour rows in either direction (n x widest, n where there are fewer): a row that none points at is reached from those it points at."""
    n = len(adjacency)
    u, col = np.nonzero(adjacency >= 0)
    v = adjacency[u, col]
    u, v = np.divmod(np.unique(np.concatenate((u * n + v, v * n + u))), max(n, 1))
    first = np.searchsorted(u, np.arange(n))
    out = np.full((n, max(1, int(np.bincount(u, minlength=1).max()) if len(u) else 1)), n)
    out[u, np.arange(len(u)) - first[u]] = v
    return out


def _beam(own: np.ndarray, x: np.ndarray, adjacency: np.ndarray, starts: np.ndarray, beam: int) -> np.ndarray:
    """Beam searches of the graph for all of `own` side by side: the cosines (queries x rows + 1) of what they met, else -inf."""
    n, m = len(x), len(own)
    rows = np.arange(m)
    seen = np.zeros((m, n + 1), bool)
    seen[:, n] = True  # the place of "none"
    sims = np.full((m, n + 1), -np.inf)
    pool = np.full((m, beam), n)
    score = np.full((m, beam), -np.inf)
    opened = np.ones((m, beam), bool)
    fresh = np.where(starts < 0, n, starts)
    while True:
        new = np.where(np.take_along_axis(seen, fresh, 1), n, fresh)
        new.sort(axis=1)
        new[:, 1:][new[:, 1:] == new[:, :-1]] = n
        np.put_along_axis(seen, new, True, 1)
        at, col = np.nonzero(new < n)
        got = np.full(new.shape, -np.inf)
        got[at, col] = np.einsum("id,id->i", own[at], x[new[at, col]])
        sims[at, new[at, col]] = got[at, col]
        pool, score = np.concatenate((pool, new), 1), np.concatenate((score, got), 1)
        opened = np.concatenate((opened, new == n), 1)
        best = np.argpartition(-score, beam - 1, axis=1)[:, :beam]
        pool, score, opened = (np.take_along_axis(v, best, 1) for v in (pool, score, opened))
        wait = np.where(opened, -np.inf, score)
        first = wait.argmax(axis=1)
        some = np.isfinite(wait[rows, first])
        if not some.any():
            return sims
        opened[rows, first] = True
        fresh = np.where(some[:, None], adjacency[np.minimum(pool[rows, first], n - 1)], -1)
        fresh = np.where(fresh < 0, n, fresh)


def range_search(
    q: np.ndarray, x: np.ndarray, adjacency: np.ndarray, starts: np.ndarray, threshold: float, beam: int = BEAM, slack: float = SLACK
) -> list[np.ndarray]:
    """For each query the rows of `x` found with cosine >= threshold.

    adjacency is (n x m) with -1 for none; starts is (queries x s) rows, -1 for
    none. A beam search runs for all queries side by side; each then expands
    over neighbours, in either direction, within `threshold - slack`.
    """
    n, out = len(x), []
    both = _undirected(adjacency)
    for a in range(0, len(q), 256):
        own = q[a : a + 256]
        sims = _beam(own, x, adjacency, starts[a : a + 256], beam)
        for i in range(len(own)):
            known = sims[i, :n]
            front = np.flatnonzero(known >= threshold - slack)
            while len(front):
                reached = np.zeros(n + 1, bool)
                reached[both[front].reshape(-1)] = True
                near = np.flatnonzero(reached[:n] & np.isinf(known))
                known[near] = x[near] @ own[i]
                front = near[known[near] >= threshold - slack]
            out.append(np.flatnonzero(known >= threshold))
    return out


def _prepared(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unit vectors in double precision with a key of their direction; null for vectors that link with nothing."""
    for batch in batches:
        unit, keys = [], []
        for v in valid(batch.column(2)):
            size = 0.0 if v is None else float(np.abs(v).max())
            if not size:
                unit.append(None)
                keys.append(None)
                continue
            u = v / size
            u = u / np.sqrt((u * u).sum())
            raw = u.astype("<f8").tobytes()
            unit.append(raw)
            keys.append(hashlib.blake2b(raw, digest_size=16).digest())
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(unit, pa.binary()), pa.array(keys, pa.binary())], ["uid", "id", "unit", "key"])


def _fitted(x: np.ndarray, k: int) -> np.ndarray:
    """`k` centres of unit vectors by a few rounds of spherical k-means."""
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(6):
        label = (x @ c.T).argmax(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, label, x)
        size = np.sqrt((total * total).sum(axis=1, keepdims=True))
        c = np.where(size > 0, total / np.maximum(size, 1e-300), c)
    return c


def _nearest(c: np.ndarray, u: np.ndarray, overlap: int) -> np.ndarray:
    """The places of the `overlap` centres nearest to a vector."""
    k = min(overlap, len(c))
    return np.sort(np.argpartition(-(c @ u), k - 1)[:k])


def _centres(spark: SparkSession, heads: DataFrame, n: int) -> dict[int, np.ndarray]:
    """Centres of the first level for each width of vectors, fitted on the sample."""
    rows = heads.orderBy(F.xxhash64("uid"), "uid").limit(SAMPLE).select("unit").collect()
    by_width: dict[int, list[np.ndarray]] = {}
    for r in rows:
        v = np.frombuffer(r.unit, "<f8")
        by_width.setdefault(len(v), []).append(v)
    return {w: _fitted(np.stack(x), max(1, min(MOST_CENTRES, len(x) // 4, -(-n // PER_CENTRE)))) for w, x in by_width.items()}


def _split_centres(threshold: float, overlap: int):
    """For each large shard, centres fitted on its sampled rows; none for one whose rows are mostly linked to each other."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, ["shard"]):
            x = matrix(g.column("unit"))
            linked = ((x @ x.T >= threshold).sum() - len(x)) / max(1, len(x) * (len(x) - 1))
            if linked < DENSE:
                c = _fitted(x, max(4 * overlap, min(len(x) // 4, -(-g.column("n")[0].as_py() // PER_CENTRE))))
                raw = pa.array([c.astype("<f8").tobytes()], pa.binary())
                yield pa.record_batch([g.column("shard").combine_chunks().slice(0, 1), raw, pa.array([c.shape[1]], pa.int32())], ["shard", "centres", "width"])

    return run


def _split_rows(overlap: int):
    """Units of a shard's centres and some of its rows, the centres first: each row's shards on the next level."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, at = None, None
        for batch in batches:
            uid, subs = [], []
            for r in batch.to_pylist():
                if r["centres"] is not None:
                    c, at = np.frombuffer(r["centres"], "<f8").reshape(-1, r["width"]), r["shard"]
                elif r["shard"] == at:
                    uid.append(r["uid"])
                    subs.append([_below(at, int(i)) for i in _nearest(c, np.frombuffer(r["unit"], "<f8"), overlap)])
            yield pa.record_batch([pa.array(uid, pa.int64()), pa.array(subs, pa.list_(pa.int64())), pa.array([at] * len(uid), pa.int64())], ["uid", "subs", "shard"])

    return run


def _below(shard: int, i: int) -> int:
    """The name of a shard's i-th part, a long above all of those of the first level."""
    return int.from_bytes(hashlib.blake2b(f"{shard}/{i}".encode(), digest_size=8).digest()) >> 2 | 1 << 61


def _split(own: DataFrame, overlap: int, threshold: float) -> DataFrame:
    """`own` with large shards replaced by parts of them, until each fits a block, is dense, or was split often enough."""
    for _ in range(LEVELS):
        placed = own.select("uid", "unit", F.explode("shards").alias("shard"))
        sizes = placed.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK)
        sizes = materialise(sizes, "sizes")
        if sizes.isEmpty():
            break
        large = materialise(checked_join(placed, sizes, "shard"), "large")
        # The rows with the smallest hashes, ranked among four times as many as are wanted.
        place = F.row_number().over(Window.partitionBy("shard").orderBy(F.xxhash64("uid", "shard"), "uid"))
        share = F.pmod(F.xxhash64("shard", "uid"), F.lit(1 << 20)) <= F.lit(4.0 * SPLIT_SAMPLE * (1 << 20)) / F.col("n")
        sampled = large.where(share).withColumn("place", place).where(F.col("place") <= SPLIT_SAMPLE).drop("place")
        centres = sampled.repartition("shard").sortWithinPartitions("shard", "uid").mapInArrow(_split_centres(threshold, overlap), "shard long, centres binary, width int")
        centres = materialise(centres, "centres")
        if centres.isEmpty():
            break
        salts = F.ceil(F.col("n") / SPLIT_ROWS).cast("long")
        sent = centres.join(sizes, "shard").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)))
        sent = sent.select("shard", "salt", "centres", "width", F.lit(None).cast("long").alias("uid"), F.lit(None).cast("binary").alias("unit"))
        rows = checked_join(large, centres.select("shard"), "shard", "left_semi")
        rows = rows.select("shard", F.pmod(F.xxhash64("uid"), salts).alias("salt"), F.lit(None).cast("binary").alias("centres"), F.lit(None).cast("int").alias("width"), "uid", "unit")
        units = sent.unionByName(rows).repartition("shard", "salt").sortWithinPartitions("shard", "salt", F.col("centres").isNull())
        parts = units.mapInArrow(_split_rows(overlap), "uid long, subs array<long>, shard long")
        moved = parts.groupBy("uid").agg(F.flatten(F.collect_list("subs")).alias("subs"), F.collect_list("shard").alias("gone"))
        shards = F.array_sort(F.concat(F.array_except("shards", F.coalesce("gone", F.array().cast("array<long>"))), F.coalesce("subs", F.array().cast("array<long>"))))
        fresh = materialise(own.join(moved, "uid", "left").select("uid", "unit", "copies", shards.alias("shards")), "assigned")
        discard(own, large, centres, sizes)
        own = fresh
    return own


def _assigned(centres: dict[int, np.ndarray], overlap: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = [np.frombuffer(x, "<f8") for x in batch.column(1).to_pylist()]
            shards: list[list[int]] = []
            for u in units:
                c = centres.get(len(u))
                if c is None:  # a width that the sample missed is a shard of its own
                    shards.append([len(u) << 20])
                    continue
                shards.append([(len(u) << 20) + 1 + int(i) for i in _nearest(c, u, overlap)])
            yield pa.record_batch([batch.column(0), batch.column(1), batch.column(2), pa.array(shards, pa.list_(pa.int64()))], ["uid", "unit", "copies", "shards"])

    return run


def _built(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for g in groups(batches, ["shard", "block"]):
        uid = g.column("uid").to_numpy()
        links = pruned_graph(matrix(g.column("unit")))
        yield pa.record_batch([pa.array(uid), pa.array([uid[row[row >= 0]] for row in links], pa.list_(pa.int64()))], ["uid", "near"])


def _local_components(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """The smallest row reachable from each row over the pairs."""
    label = np.arange(n)
    while True:
        low = label.copy()
        np.minimum.at(low, u, label[v])
        np.minimum.at(low, v, label[u])
        low = low[low]
        if (low == label).all():
            return label
        label = low


def _owned(u: np.ndarray, v: np.ndarray, shards: list[list[int]], shard: int) -> np.ndarray:
    """Whether no shard below `shard` has both ends of the links (u, v)."""
    below = [[s for s in own if s < shard] for own in shards]
    wide = max(map(len, below), default=0)
    table = np.full((len(below), wide), -1, np.int64)
    for i, own in enumerate(below):
        table[i, : len(own)] = own
    out = np.ones(len(u), bool)
    for a in range(0, len(u), 1_000_000):
        left, right = table[u[a : a + 1_000_000]], table[v[a : a + 1_000_000]]
        for i in range(wide):
            for j in range(wide):
                out[a : a + 1_000_000] &= (left[:, i] != right[:, j]) | (left[:, i] < 0)
    return out


def _linked(threshold: float):
    """For each vertex of a block pair: links that this unit owns, and the smallest vertex it reaches in the unit.

    A link is owned by the least shard that both ends are in.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, ["shard", "low", "high"]):
            g = g.sort_by("uid")
            uid, block, copies = (g.column(c).to_numpy() for c in ("uid", "block", "copies"))
            shard, shards = g.column("shard")[0].as_py(), g.column("shards").to_pylist()
            x = matrix(g.column("unit"))
            same = g.column("low")[0].as_py() == g.column("high")[0].as_py()
            asks = np.arange(len(uid)) if same else np.flatnonzero(block == g.column("low")[0].as_py())
            nodes = asks if same else np.flatnonzero(block == g.column("high")[0].as_py())
            if not len(asks) or not len(nodes):
                continue
            place = np.full(len(uid) + 1, -1)
            place[nodes] = np.arange(len(nodes))
            near = g.column("near").to_pylist()
            local = []
            for own in near:
                at = np.searchsorted(uid, own)
                at[at == len(uid)] = 0
                found = place[at[uid[at] == own]]
                local.append(found[found >= 0])
            wide = max(map(len, local), default=0) or 1
            adjacency = np.full((len(uid), wide), -1)
            for i, own in enumerate(local):
                adjacency[i, : len(own)] = own
            y = x[nodes]
            entries = np.broadcast_to(medoids(y), (len(asks), min(len(y), MEDOIDS)))
            starts = np.concatenate((entries, place[asks][:, None] if same else adjacency[asks]), axis=1)
            hits = range_search(x[asks], y, adjacency[nodes], starts, threshold)
            u = np.repeat(asks, [len(h) for h in hits])
            v = nodes[np.concatenate(hits)] if hits else np.zeros(0, np.int64)
            keep = u != v
            u, v = u[keep], v[keep]
            u, v = np.divmod(np.unique(np.concatenate((u * len(uid) + v, v * len(uid) + u))), len(uid))
            owned = _owned(u, v, shards, shard)
            links = np.zeros(len(uid), np.int64)
            np.add.at(links, u[owned], copies[v[owned]])
            low = uid[_local_components(u, v, len(uid))]
            some = np.unique(u)
            yield pa.record_batch([pa.array(uid[some]), pa.array(links[some]), pa.array(low[some])], ["uid", "links", "low"])

    return run


def _counted(queries: dict[int, tuple[np.ndarray, np.ndarray]], threshold: float):
    """Links of the audit's queries with the vertices of each batch, by brute force."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_width: dict[int, list[int]] = {}
            units = [np.frombuffer(x, "<f8") for x in batch.column(1).to_pylist()]
            for i, u in enumerate(units):
                by_width.setdefault(len(u), []).append(i)
            uid, copies = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            for width, rows in by_width.items():
                if width in queries:
                    ids, q = queries[width]
                    hit = (q @ np.stack([units[i] for i in rows]).T >= threshold) & (ids[:, None] != uid[rows][None, :])
                    yield pa.record_batch([pa.array(ids), pa.array((hit * copies[rows]).sum(axis=1))], ["uid", "links"])

    return run


def audited_recall(heads: DataFrame, links: DataFrame, threshold: float, queries: int = AUDIT) -> float:
    """Links found over links there are, averaged over `queries` vertices: the linked ones with the smallest hashes, then others."""
    known = heads.select("uid", "unit").join(links.select("uid", "links"), "uid", "left")
    pick = known.orderBy(F.col("links").isNull(), F.xxhash64("uid"), "uid").limit(queries // 2)
    others = known.orderBy(F.xxhash64(F.col("uid"), F.lit(1)), "uid").limit(queries - queries // 2)
    rows = {r.uid: r for r in pick.unionByName(others).collect()}
    by_width: dict[int, list] = {}
    for r in rows.values():
        by_width.setdefault(len(r.unit) // 8, []).append(r)
    asked = {w: (np.array([r.uid for r in g]), np.stack([np.frombuffer(r.unit, "<f8") for r in g])) for w, g in by_width.items()}
    counted = heads.select("uid", "unit", "copies").mapInArrow(_counted(asked, threshold), "uid long, links long")
    true = {r.uid: r.links for r in counted.groupBy("uid").agg(F.sum("links").alias("links")).collect()}
    shares = [min(1.0, (rows[uid].links or 0) / n) for uid, n in true.items() if n]
    return sum(shares) / len(shares) if shares else 1.0


def _links(heads: DataFrame, centres: dict[int, np.ndarray], overlap: int, threshold: float) -> DataFrame:
    """(uid, links, low) of all block pairs of all shards."""
    own = materialise(heads.select("uid", "unit", "copies").mapInArrow(_assigned(centres, overlap), "uid long, unit binary, copies long, shards array<long>"), "assigned")
    own = _split(own, max(2, overlap // 2), threshold)
    spread = own.withColumn("shard", F.explode("shards"))
    sizes = spread.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    spread = checked_join(spread, materialise(sizes, "sizes"), "shard").withColumn("block", F.pmod(F.xxhash64("uid"), F.col("blocks")))
    built = spread.select("shard", "block", "uid", "unit").repartition("shard", "block").sortWithinPartitions("shard", "block").mapInArrow(_built, "uid long, near array<long>")
    united = built.groupBy("uid").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
    united = materialise(united, "graph")
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda j: F.struct(F.least("block", j).alias("low"), F.greatest("block", j).alias("high")))
    units = spread.join(united, "uid").withColumn("pair", F.explode(pairs)).select("shard", "pair.low", "pair.high", "block", "uid", "unit", "copies", "shards", "near")
    keyed = units.repartition("shard", "low", "high").sortWithinPartitions("shard", "low", "high")
    return materialise(keyed.mapInArrow(_linked(threshold), "uid long, links long, low long"), "links")


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, overlap: int = OVERLAP, least_recall: float = LEAST_RECALL) -> DataFrame:
    """(id, n_links, component_id, kept), a row for each row of `vectors`.

    n_links counts the other rows linked directly, component_id is the smallest
    id reachable by links. Defined cases: vectors that are null, empty, zero or
    hold null or non-finite components link with nothing; those of different
    widths do not link; repeated rows are linked like any equal vectors; a null
    id is passed through and never the smallest unless all are; an empty table
    gives no rows; other columns are not looked at.
    """
    spark = vectors.sparkSession
    tagged = with_row_ids(vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector")), "id", "uid")
    rows = materialise(tagged.select("uid", "id", "vector").mapInArrow(_prepared, "uid long, id long, unit binary, key binary"), "units")
    known = rows.where("key IS NOT NULL")
    tops = known.groupBy("key").agg(F.min("uid").alias("head"), F.min("id").alias("low_id"), F.count(F.lit(1)).alias("copies"))
    heads = materialise(known.join(tops.select(F.col("head").alias("uid"), "low_id", "copies"), "uid").select("uid", "unit", "copies", "low_id"), "heads")
    centres = _centres(spark, heads, heads.count())
    while True:
        parts = _links(heads, centres, overlap, threshold)
        found = parts.groupBy("uid").agg(F.sum("links").alias("links"))
        widest = max((len(c) for c in centres.values()), default=0)
        recall = audited_recall(heads, found, threshold)
        _log.info("recall %.4f at overlap %d", recall, overlap)
        if recall >= least_recall:
            break
        if overlap >= widest:
            raise RuntimeError(f"recall {recall:.4f} stays below {least_recall:.2f} though every vector is in every shard; no incomplete result is returned")
        overlap *= 2
    reached = components(parts.where("uid <> low").select(F.col("uid").alias("u"), F.col("low").alias("v")))
    ids = heads.select("uid", "low_id").join(reached, F.col("uid") == F.col("node"), "left").withColumn("component", F.coalesce("component", "uid"))
    lows = ids.groupBy("component").agg(F.min("low_id").alias("component_id"))
    solved = materialise(ids.join(lows, "component").select("uid", "component_id").join(found, "uid", "left").select(F.col("uid").alias("head"), "component_id", F.coalesce("links", F.lit(0)).alias("links")), "solved")
    heads_of = tops.select("key", "head", "copies").join(solved, "head").select("key", "copies", "component_id", "links")
    out = rows.select("id", "key").join(heads_of, "key", "left")
    return out.select("id", F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"), F.coalesce(F.col("id") == F.coalesce("component_id", "id"), F.lit(False)).alias("kept"))
