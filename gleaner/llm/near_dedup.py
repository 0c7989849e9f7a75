"""Operator 2: near-duplicate documents by BagMinHash (weighted MinHash over shingle multisets).

Each document is the multiset of its five-word shingles. Every shingle runs
Poisson processes over its weight axis, cut into the dyadic levels (0,1], (1,2],
(2,4], ...; a level's process is seeded by (shingle, level) alone, has a rate
in proportion to its width, and gives each point a time, one of m components
and a height. A document of weight w sees the points at heights up to w. The
earliest time it sees in each component is its signature, so two signatures
agree in a component with probability Σmin / Σmax: the weighted Jaccard similarity.
Levels above a weight are never opened, and points after the time by which all
components are expected to be filled are never drawn.

Signatures are cut into bands. Candidates come from shared bands without
listing the pairs of a group:

1. equal word sequences are one class from the start (partial aggregation);
2. each class representative is compared with one hub: of those that its bands
   lead to, the one in the fullest bands whose signature agrees. A group's
   original is nearer to its copies than they are to each other, so this
   collapses large groups of near copies. The trees of hubs are families;
3. bands that hold several families compare their representatives by signature,
   in blocks of bounded size, and give only what joins families: then every pair
   that shares a band and agrees lies within a family;
4. a family that is still in several components compares them in such blocks,
   first by signature. Only texts with an agreeing partner in a block are sent
   there, are compared exactly, and give only what joins components.

All pairs found are verified by the exact multiset overlap of whole texts.
Components of the verified links are the classes. A hub's members are dealt
over salts, so a hub's text or signature travels once for each salt and no key
gathers a group. Blocks are as large as a task holds: a family of n rows in b
blocks is sent b times, which a family of some ten thousand texts makes about ten.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm import _shingles as S
from gleaner.llm._arrow import groups, steps
from gleaner.llm._graph import components
from gleaner.runtime import checked_join, discard, materialise, private, with_row_ids

SHINGLE = 5
THRESHOLD = 0.8
#: 24 bands of 4 components miss a pair of similarity 0.8 with probability 3e-6.
COMPONENTS = 96
BAND_ROWS = 4
#: Signatures that agree in fewer components belong to pairs of similarity 0.8 with probability 3e-6.
LEAST_AGREEING = 58
#: Rows of a block of signatures; rows and shingles of a block of whole texts; rows compared at a time.
BLOCK, TEXT_ROWS, TEXT_WEIGHT, TILE = 4_096, 2_048, 1_000_000, 512

_GOLD = np.uint64(0x9E3779B97F4A7C15)
#: Once so few processes go on, this many of their next points are drawn at a time.
_FEW, _DRAWS = 4_000, 16


def signatures(hashes: np.ndarray, at: np.ndarray, m: int = COMPONENTS) -> np.ndarray:
    """The BagMinHash signatures (texts x m, uint32) of multisets of sorted hashes; zeros for an empty one."""
    n = len(at) - 1
    size = np.diff(at)
    times = np.full((n, m), np.inf)
    if not len(hashes):
        return np.zeros((n, m), np.uint32)
    begins = np.zeros(len(hashes), bool)
    begins[at[:-1][size > 0]] = True
    begins[1:] |= hashes[1:] != hashes[:-1]
    first = np.flatnonzero(begins)
    weight = np.diff(np.append(first, len(hashes)))
    element, text = hashes[first], np.repeat(np.arange(n), size)[first]
    level, seeds, rates, texts, weights = 0, [], [], [], []
    while len(element):
        seeds.append(S.mix(element + np.uint64((level + 1) * int(_GOLD) % (1 << 64))))
        rates.append(np.full(len(element), float(m * max(1, 1 << max(0, level - 1)))))
        texts.append(text)
        weights.append(np.stack((weight, np.full(len(weight), level))))
        keep = weight > (1 << level)
        element, text, weight, level = element[keep], text[keep], weight[keep], level + 1
    seed, rate, text, weight = np.concatenate(seeds), np.concatenate(rates), np.concatenate(texts), np.concatenate(weights, axis=1)
    spread = np.log(m) + 3.0
    todo = size > 0
    flat = times.reshape(-1)
    while todo.any():
        until = np.where(todo, spread / np.maximum(size, 1), -1.0)
        s, r, d, w, now = seed, rate, text, weight, np.zeros(len(seed))
        if not todo.all():
            keep = todo[d]
            s, r, d, w, now = s[keep], r[keep], d[keep], w[:, keep], now[keep]
        while len(s):
            draws = 1 if len(s) > _FEW else _DRAWS
            z = S.mix(s[:, None] + _GOLD * np.arange(1, draws + 1, dtype=np.uint64))
            wait = -np.log(((z >> np.uint64(11)) + np.uint64(1)).astype(np.float64) * 2.0**-53) / r[:, None]
            wait[:, 0] += now
            when = np.cumsum(wait, axis=1)
            row, col = np.nonzero(when < until[d][:, None])
            hit, moment = S.mix(z[row, col] ^ _GOLD), when[row, col]
            component = (((hit >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)).astype(np.int64)
            count, step = w[0][row], w[1][row]
            width = 1 << np.maximum(step - 1, 0)
            height = np.where(step > 0, width, 0) + (((hit & np.uint64(0xFFFFFFFF)).astype(np.int64) * width) >> 32) + 1
            seen = height <= count
            np.minimum.at(flat, d[row][seen] * m + component[seen], moment[seen])
            keep = when[:, -1] < until[d]
            s, r, d, w, now = s[keep] + np.uint64(draws * int(_GOLD) % (1 << 64)), r[keep], d[keep], w[:, keep], when[keep, -1]
        todo = todo & np.isinf(times).any(axis=1)
        spread *= 2
    times[size == 0] = 0
    return times.astype(np.float32).view(np.uint32)


def band_keys(signature: np.ndarray, rows: int = BAND_ROWS) -> np.ndarray:
    """A long for each band of each signature; equal for equal rows of the same band."""
    n, m = signature.shape
    parts = signature.reshape(n, m // rows, rows).astype(np.uint64)
    key = np.tile(np.arange(m // rows, dtype=np.uint64), (n, 1)) + np.uint64(1)
    for i in range(rows):
        key = S.mix(key * _GOLD + parts[:, :, i])
    return key.view(np.int64)


_FEATURES = "uid long, id long, content_key binary, weight long, signature binary, bands array<long>"


def _features(k: int, m: int, rows: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a, b in steps(whole.column(2)):
                batch = whole.slice(a, b - a)
                texts = batch.column(2).to_pylist()
                words, at = S.word_hashes(texts)
                keys = S.content_keys(texts, words, at)
                hashes, at = S.shingle_hashes(words, at, k)
                sig = signatures(hashes, at, m)
                size = np.diff(at)
                bands = [row if n else None for row, n in zip(band_keys(sig, rows), size)]
                yield pa.record_batch(
                    [batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array(size, pa.int64()), pa.array([row.tobytes() for row in sig], pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                    ["uid", "id", "content_key", "weight", "signature", "bands"],
                )

    return run


def _verified(k: int, threshold: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a, b in steps(whole.column(2), whole.column(3)):
                batch = whole.slice(a, b - a)
                left, right = batch.column(2).to_pylist(), batch.column(3).to_pylist()
                own = list(dict.fromkeys([*left, *right]))
                place = {t: j for j, t in enumerate(own)}
                hashes, at = S.shingle_hashes(*S.word_hashes(own), k)
                sets = [S.occurrences(hashes[x:y]) for x, y in zip(at[:-1], at[1:])]
                score = np.array([S.overlap(sets[place[x]], sets[place[y]]) for x, y in zip(left, right)])
                yield pa.record_batch([batch.column(0), batch.column(1), pa.array(score)], ["u", "v", "similarity"]).filter(pa.array(score >= threshold))

    return run


def with_both(pairs: DataFrame, payload: DataFrame, column: str, name: str) -> DataFrame:
    """`pairs` (u, v, ...), a table, with `column` of the rows u and v of `payload` as `name`_u and `name`_v.

    A hub is a u of many pairs. These are dealt over as many salts as the root
    of all pairs, and the hub's value is sent once to each salt that has some.
    """
    salts = max(1, int(pairs.count() ** 0.5))
    salt = F.pmod(F.xxhash64("v"), F.lit(salts)).alias("salt")
    hubs = payload.select(F.col("uid").alias("u"), F.col(column).alias(name + "_u"))
    members = payload.select(F.col("uid").alias("v"), F.col(column).alias(name + "_v"))
    sent = pairs.select("u", salt).distinct().join(hubs, "u")
    return pairs.join(members, "v").select("*", salt).join(sent, ["u", "salt"]).drop("salt")


def verify(pairs: DataFrame, rows: DataFrame, k: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """The pairs (u, v), a table, of row ids whose whole texts overlap by at least `threshold`, with their similarity.

    Only the texts of documents in some pair are moved.
    """
    ids = materialise(pairs.select(F.explode(F.array("u", "v")).alias("uid")).distinct(), "ids")
    texts = checked_join(rows.select("uid", F.coalesce("text", F.lit("")).alias("text")), ids, "uid", "left_semi")
    joined = with_both(pairs.select("u", "v"), texts, "text", "text").select("u", "v", "text_u", "text_v")
    return joined.mapInArrow(_verified(k, threshold), "u long, v long, similarity double")


def _sides(part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows of either side of a block unit; one block is set against itself."""
    if part.min() == part.max():
        return np.arange(len(part)), np.arange(len(part))
    return np.flatnonzero(part == part.max()), np.flatnonzero(part == part.min())


def _spanning(a: np.ndarray, b: np.ndarray, pairs: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """The pairs (i, j) that join groups a[i] and b[j] not yet joined by those before."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.get(x, x) != x:
            root[x] = root.get(root[x], root[x])
            x = root[x]
        return x

    out = []
    for i, j in pairs:
        x, y = find(int(a[i])), find(int(b[j]))
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((i, j))
    return out


def _longs(u: list[int], v: list[int]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])


def _joining_families(least: int, ratio: float):
    """Within each unit of signatures, pairs of different families that agree enough: a spanning set of them."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in groups(batches, ["unit"]):
            uid, family, part, weight = (unit.column(c).to_numpy() for c in ("uid", "component", "part", "weight"))
            sig = np.stack([np.frombuffer(x, np.uint32) for x in unit.column("signature").to_pylist()])
            a, b = _sides(part)

            def agreeing() -> Iterator[tuple[int, int]]:
                for i in a.tolist():
                    low, high = np.minimum(weight[b], weight[i]), np.maximum(weight[b], weight[i])
                    for j in b[(family[b] != family[i]) & (low >= ratio * high) & ((sig[b] == sig[i]).sum(axis=1) >= least)].tolist():
                        yield i, j

            joined = _spanning(family, family, agreeing())
            yield _longs([int(uid[i]) for i, _ in joined], [int(uid[j]) for _, j in joined])

    return run


def _agreeing_rows(least: int, ratio: float):
    """The rows of each unit of signatures that agree enough with some row of another component on the other side."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in groups(batches, ["unit"]):
            component, part, weight = (unit.column(c).to_numpy() for c in ("component", "part", "weight"))
            sig = np.stack([np.frombuffer(x, np.uint32) for x in unit.column("signature").to_pylist()])
            a, b = _sides(part)
            some = np.zeros(len(part), bool)
            for i in a.tolist():
                low, high = np.minimum(weight[b], weight[i]), np.maximum(weight[b], weight[i])
                near = b[(component[b] != component[i]) & (low >= ratio * high)]
                near = near[(sig[near] == sig[i]).sum(axis=1) >= least]
                some[near] = True
                some[i] |= len(near) > 0
            yield from unit.select(["unit", "part", "uid", "component"]).filter(pa.array(some)).to_batches()

    return run


def _common(a: list[np.ndarray], b: list[np.ndarray], columns: int = 2_048) -> np.ndarray:
    """The sizes of all intersections of sets of `a` with sets of `b`, as products of slices of their incidence matrices."""
    out = np.zeros((len(a), len(b)), np.float32)
    left, right = np.concatenate(a), np.concatenate(b)
    known = np.intersect1d(left, right)
    if not len(known):
        return out
    placed = []
    for sets, flat in ((a, left), (b, right)):
        row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        at = np.minimum(np.searchsorted(known, flat), len(known) - 1)
        keep = known[at] == flat
        order = np.argsort(at[keep], kind="stable")
        placed.append((row[keep][order], at[keep][order]))
    for begin in range(0, len(known), columns):
        end = min(begin + columns, len(known))
        sides = []
        for (row, at), n in zip(placed, (len(a), len(b))):
            x, y = np.searchsorted(at, (begin, end))
            dense = np.zeros((n, end - begin), np.float32)
            dense[row[x:y], at[x:y] - begin] = 1
            sides.append(dense)
        out += sides[0] @ sides[1].T
    return out


def _joining_links(k: int, threshold: float):
    """Within each unit of whole texts, verified links that join different components: a spanning set of them."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in groups(batches, ["unit"]):
            uid, component, part = (unit.column(c).to_numpy() for c in ("uid", "component", "part"))
            hashes, at = S.shingle_hashes(*S.word_hashes(unit.column("text").to_pylist()), k)
            sets = [S.occurrences(hashes[x:y]) for x, y in zip(at[:-1], at[1:])]
            size = np.diff(at)
            left, right = _sides(part)

            def linked() -> Iterator[tuple[int, int]]:
                for x in range(0, len(left), TILE):
                    for y in range(0, len(right), TILE):
                        a, b = left[x : x + TILE], right[y : y + TILE]
                        both = _common([sets[i] for i in a], [sets[i] for i in b])
                        total = size[a][:, None] + size[b][None, :] - both
                        other = component[a][:, None] != component[b][None, :]
                        row, col = np.nonzero((both >= threshold * total) & other & (total > 0))
                        yield from zip(a[row].tolist(), b[col].tolist())

            joined = _spanning(component, component, linked())
            yield _longs([int(uid[i]) for i, _ in joined], [int(uid[j]) for _, j in joined])

    return run


def _units(members: DataFrame, rows: int, weight: int | None = None) -> DataFrame | None:
    """Block units of the groups whose members are in several components; None if there are none.

    members is (group, component, uid, load). In such a group the largest
    component is set against the rest, and the rest against itself, in blocks
    of at most about `rows` rows, or of `weight` as their load, a side: (unit,
    part, component, uid). Smaller groups are cut too, into an eighth of the
    root of their rows, so that their units spread over tasks.
    """
    sizes = members.groupBy("group", "component").agg(F.count(F.lit(1)).alias("n"), F.sum("load").alias("w"))
    top = F.max(F.struct("n", "component", "w")).alias("top")
    mixed = sizes.groupBy("group").agg(F.count(F.lit(1)).alias("parts"), F.sum("n").alias("n"), F.sum("w").alias("w"), top).where("parts > 1")
    most = lambda n, w: F.greatest(n / rows, F.sqrt(n) / 8, *([w / weight] if weight else []))
    blocks = lambda n, w: F.ceil(most(n, w)).cast("long")
    mixed = mixed.select(
        "group", F.col("top.component").alias("top"), blocks(F.col("top.n"), F.col("top.w")).alias("n_top"),
        blocks(F.col("n") - F.col("top.n"), F.col("w") - F.col("top.w")).alias("n_rest"),
    )
    mixed = materialise(mixed, "mixed")
    if mixed.isEmpty():
        return None
    inner = checked_join(members, mixed, "group").withColumn("is_top", F.col("component") == F.col("top"))
    own = F.pmod(F.xxhash64("uid"), F.when(F.col("is_top"), F.col("n_top")).otherwise(F.col("n_rest")))
    other = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    unit = lambda kind, i, j: F.xxhash64("group", F.lit(kind), i, j)
    top = F.transform(other("n_rest"), lambda j: F.struct(unit("top", F.col("block"), j).alias("unit"), F.lit(0).alias("part")))
    side = lambda j: F.when(j == F.col("block"), 0).when(j > F.col("block"), 1).otherwise(2)
    rest = F.concat(
        F.transform(other("n_top"), lambda i: F.struct(unit("top", i, F.col("block")).alias("unit"), F.lit(1).alias("part"))),
        F.transform(other("n_rest"), lambda j: F.struct(unit("rest", F.least("block", j), F.greatest("block", j)).alias("unit"), side(j).alias("part"))),
    )
    dealt = inner.withColumn("block", own).withColumn("x", F.explode(F.when(F.col("is_top"), top).otherwise(rest)))
    return dealt.select("x.unit", "x.part", "component", "uid")


def _dealt(units: DataFrame, payload: DataFrame) -> DataFrame:
    """Units with the columns of `payload` by uid, each unit in one partition and together in it."""
    return units.join(payload, "uid").repartition("unit").sortWithinPartitions("unit")


def integral_id(docs: DataFrame, id_col: str) -> Column:
    """An id as a long; null where it is none."""
    return F.col(id_col).try_cast("long") if dict(docs.dtypes)[id_col] == "string" else F.col(id_col).cast("long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, threshold: float = THRESHOLD, rows: DataFrame | None = None) -> DataFrame:
    """Classes of near-duplicate documents: (uid, id, class_id, class_uid, kept), a row for each row of `docs`.

    class_id is the smallest id in the class and `kept` marks the one row that
    stays for it. Defined cases: a null text is a class of its own; texts
    without words, the empty one included, link only with equal texts; a text
    of fewer than k words links only with texts of the same words; of rows that
    repeat an id, or have none, one stays for each class (null ids come after
    others); an id that is no integer counts as a null one; a text of any length
    is compared whole, and the task that has it holds its shingles; an empty
    table gives no rows; other columns are not looked at.

    `rows` may give the documents with unique ids as (uid, id, text).
    """
    if rows is None:
        own = with_row_ids(docs.select(integral_id(docs, id_col).alias("id"), F.col(text_col).alias("text")), "id", "uid")
        rows = own.select("uid", "id", "text")
    found = materialise(rows.select("uid", "id", "text").mapInArrow(_features(k, COMPONENTS, BAND_ROWS), _FEATURES), "features")
    order = F.struct(F.coalesce("id", F.lit((1 << 63) - 1)).alias("order_id"), F.col("uid").alias("head"), "id")
    copies = found.where("content_key IS NOT NULL").groupBy("content_key").agg(F.min(order).alias("top"), F.count(F.lit(1)).alias("n")).where("n > 1")
    # A table of its own, so that the join deals both sides anew and AQE can split a group of many copies.
    heads = materialise(copies.select("content_key", F.col("top.head").alias("head"), F.col("top.id").alias("head_id")), "heads")
    members = materialise(
        found.select("uid", "id", "content_key").join(heads, "content_key", "left").select("uid", "id", F.coalesce("head", "uid").alias("head"), F.when(F.col("head").isNull(), F.col("id")).otherwise(F.col("head_id")).alias("head_id")),
        "members",
    )
    reps = found.where("bands IS NOT NULL").join(members.where("uid = head").select("uid"), "uid", "left_semi").select("uid", "weight", "signature", "bands")
    bands = reps.select("uid", F.explode("bands").alias("band"))
    shared = bands.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    places = materialise(bands.join(shared, "band"), "places")
    hubs = places.groupBy("uid").agg(F.sum("n").alias("hub"))
    buckets = materialise(places.join(hubs, "uid").select("band", "uid", "hub"), "buckets")
    centres = buckets.groupBy("band").agg(F.max(F.struct("hub", (-F.col("uid")).alias("centre"))).alias("top"))
    led = buckets.join(centres, "band").select((-F.col("top.centre")).alias("u"), F.col("uid").alias("v"), F.col("top.hub").alias("hub"))
    led = materialise(led.where("u <> v").distinct(), "led")
    sig = reps.select("uid", "signature", "weight")
    part = lambda c, i: F.substring(f"sig_{c}.signature", i * 4 + 1, 4)
    agreeing = F.size(F.filter(F.sequence(F.lit(0), F.lit(COMPONENTS - 1)), lambda i: part("u", i) == part("v", i)))
    alike = F.least("sig_u.weight", "sig_v.weight") >= F.lit(threshold) * F.greatest("sig_u.weight", "sig_v.weight")
    likely = with_both(led, sig.select("uid", F.struct("signature", "weight").alias("sig")), "sig", "sig").where(alike).where(agreeing >= LEAST_AGREEING)
    best = F.max(F.struct("hub", (-F.col("u")).alias("u"))).alias("top")
    stars = materialise(likely.groupBy("v").agg(best).select((-F.col("top.u")).alias("u"), "v"), "stars")
    owner = lambda edges, name: components(edges).select(F.col("node").alias("uid"), F.col("component").alias(name))
    links = materialise(verify(stars, rows, k, threshold).select("u", "v"), "links")
    labelled = buckets.select(F.col("band").alias("group"), "uid").join(owner(stars, "family"), "uid", "left")
    labelled = materialise(labelled.select("group", F.coalesce("family", "uid").alias("component"), "uid", F.lit(0).alias("load")), "labelled")
    units = _units(labelled, BLOCK)
    if units is not None:
        joins = _dealt(units, sig).mapInArrow(_joining_families(LEAST_AGREEING, threshold), "u long, v long")
        stars = materialise(stars.unionByName(joins), "stars")
    own = owner(stars, "family").join(owner(links, "component"), "uid", "left").join(sig.select("uid", F.col("weight").alias("load")), "uid")
    own = materialise(own.select(F.col("family").alias("group"), F.coalesce("component", "uid").alias("component"), "uid", "load"), "own")
    units = _units(own, TEXT_ROWS, TEXT_WEIGHT)
    if units is not None:
        sent = _dealt(units, sig).mapInArrow(_agreeing_rows(LEAST_AGREEING, threshold), "unit long, part int, uid long, component long")
        sent = materialise(sent, "sent")
        ids = materialise(sent.select("uid").distinct(), "ids")
        texts = checked_join(rows.select("uid", F.coalesce("text", F.lit("")).alias("text")), ids, "uid", "left_semi")
        joins = _dealt(sent, texts).mapInArrow(_joining_links(k, threshold), "u long, v long")
        links = links.unionByName(materialise(joins, "links"))
        discard(sent, ids)
    comps = components(links)
    linked = members.where("uid = head").select("head", "head_id").join(comps, F.col("head") == F.col("node"))
    tops = linked.groupBy("component").agg(F.min(F.struct(F.coalesce("head_id", F.lit((1 << 63) - 1)).alias("order_id"), F.col("head").alias("class_uid"), F.col("head_id").alias("class_id"))).alias("top"))
    moved = materialise(comps.join(tops, "component").select(F.col("node").alias("head"), "top.class_uid", "top.class_id"), "classes")
    discard(found, heads, places, buckets, led, labelled, own)
    joined = members.join(moved, "head", "left")
    class_uid = F.coalesce("class_uid", "head")
    return joined.select("uid", "id", F.when(F.col("class_uid").isNull(), F.col("head_id")).otherwise(F.col("class_id")).alias("class_id"), class_uid.alias("class_uid"), (F.col("uid") == class_uid).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with one row of each near-duplicate class (see near_duplicates), all columns as they were."""
    names = docs.columns
    (uid,) = private(docs, "uid")
    tagged = with_row_ids(docs, id_col, uid)
    rows = tagged.select(F.col(uid).alias("uid"), integral_id(docs, id_col).alias("id"), F.col(text_col).alias("text"))
    classes = near_duplicates(docs, id_col, text_col, rows=rows)
    gone = materialise(classes.where("NOT kept").select(F.col("uid").alias(uid)), "gone")
    return checked_join(tagged, gone, uid, "left_anti").select(*(F.col(f"`{c}`") for c in names))
