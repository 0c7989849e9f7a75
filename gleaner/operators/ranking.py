"""Candidate generation and ranking: exact vectors, keywords, late interaction, fusion.

Vector arithmetic is unrolled to one generated expression for queries of up to
UNROLL components in all, which stays in whole-stage code generation; larger
ones go to matrix products over Arrow batches, which hand back only what may
still win: the best rows, or the maxima of each page. Every top-k has a total order.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.text import unmarked
from gleaner.runtime import checked_join, discard, materialise, private

K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6
FTS_CANDIDATES = 200
RRF_K = 60
UNROLL = 256
TOKEN = r"[^\p{L}\p{N}]+"


def _sum(terms: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms, F.lit(0.0))


def dot(vector: Column, query: list[float]) -> Column:
    """The inner product of an array column with a fixed vector, in double precision."""
    if len(query) <= UNROLL:
        return _sum([F.get(vector, F.lit(i)).cast("double") * F.lit(float(q)) for i, q in enumerate(query)])
    fixed = F.from_json(F.lit(str([float(q) for q in query])), "array<double>")
    return F.aggregate(F.zip_with(vector, fixed, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)


def l2_distance(vector: Column, query: list[float]) -> Column:
    """The Euclidean distance of an array column from a fixed vector, in double precision."""
    if len(query) <= UNROLL:
        parts = [F.get(vector, F.lit(i)).cast("double") - F.lit(float(q)) for i, q in enumerate(query)]
        return F.sqrt(_sum([p * p for p in parts]))
    fixed = F.from_json(F.lit(str([float(q) for q in query])), "array<double>")
    return F.sqrt(F.aggregate(F.zip_with(vector, fixed, lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda s, x: s + x))


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(vector: Column, query: list[float]) -> Column:
    """0 where either has no length."""
    size = sum(float(q) * float(q) for q in query) ** 0.5
    own = norm(vector)
    return F.when((own == 0) | F.lit(size == 0), 0.0).otherwise(dot(vector, query) / (own * F.lit(size or 1.0)))


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one batch, in double precision; the rows have no null."""
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _nearest(query: list[float], k: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = np.array(query)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1)) - q
            distance = np.sqrt(np.einsum("ij,ij->i", x, x))
            distance[np.isnan(distance)] = np.inf
            # All ties of the k-th are kept, so that ids decide among them later.
            keep = distance <= np.partition(distance, k - 1)[k - 1] if len(distance) > k else np.ones(len(distance), bool)
            yield pa.record_batch([batch.column(0), pa.array(distance)], [batch.schema.names[0], "distance"]).filter(pa.array(keep))

    return run


def knn(rows: DataFrame, query: list[float], k: int, id_col: str, vector_col: str = "embedding") -> DataFrame:
    """(id_col, distance) of the k rows nearest to `query`; rows without a vector, or with one of another width or with a component that is null or no number, take no part.

    One scan of two columns; a task keeps a bounded heap, or the best of each batch.
    """
    known = rows.where(F.size(vector_col) == len(query)).select(F.col(id_col), F.col(vector_col))
    if len(query) <= UNROLL:
        # Exploded, so that the filter below does not compute it again.
        found = known.select(F.col(id_col), F.explode(F.array(l2_distance(F.col(vector_col), query))).alias("distance"))
    else:
        kind = known.schema[0].dataType.simpleString()
        found = known.mapInArrow(_nearest(query, k), f"`{id_col}` {kind}, distance double")
    # Neither null nor NaN, which is above all numbers, is below infinity.
    return found.where(F.col("distance") < math.inf).orderBy("distance", id_col).limit(k)


#: Vectors of a cell, about, and the most cells of one table or segment; their centres are vectors of a sample.
CELL_ROWS, MOST_CELLS = 256, 1024
CELLS = "cell int, centre array<double>, radius double, n bigint"


def _cell_of(centres: np.ndarray):
    """(cell, reach) of vectors: the nearest centre and the distance from it; cell -1 for those that can't be compared."""
    sizes = (centres * centres).sum(axis=1)

    def place(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for vectors in parts:
            cell, reach = np.full(len(vectors), -1, np.int32), np.full(len(vectors), np.nan)
            rows = [i for i, v in enumerate(vectors) if v is not None and len(v) == centres.shape[1]]
            for a in range(0, len(rows), 2048):
                own = np.array(rows[a : a + 2048])
                x = np.stack([np.asarray(vectors.iloc[i], np.float64) for i in own])
                good = np.isfinite(x).all(axis=1)
                own, x = own[good], x[good]
                best = np.argmin(sizes - 2.0 * (x @ centres.T), axis=1)
                cell[own], reach[own] = best, np.sqrt(((x - centres[best]) ** 2).sum(axis=1))
            yield pd.DataFrame({"cell": cell, "reach": reach})

    place.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(place, "cell int, reach double")


def celled(rows: DataFrame, vector_col: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """(`rows` with `cell` and `reach`, cells): vectors dealt to the nearest of a bounded sample of them.

    `rows` are read several times. Vectors that are null, not finite or of another width than
    most of the sample belong to cell -1, which every search reads.
    """
    known = rows.where(F.size(vector_col) > 0).select(F.col(vector_col).alias("v"))
    wanted = min(MOST_CELLS, -(-known.count() // CELL_ROWS))
    sample = [tuple(float(x) if x is not None else math.nan for x in r.v) for r in known.orderBy(F.xxhash64("v")).limit(wanted).collect()]
    sample = sorted({v for v in sample if all(map(math.isfinite, v))})
    if not sample:
        return rows.withColumn("cell", F.lit(-1)).withColumn("reach", F.lit(None).cast("double")), rows.sparkSession.createDataFrame([], CELLS)
    widths = [len(v) for v in sample]
    centres = np.array([v for v in sample if len(v) == max(sorted(set(widths)), key=widths.count)])
    located = rows.withColumn("_at", _cell_of(centres)(F.col(vector_col))).select(*(F.col(f"`{c}`") for c in rows.columns if c not in ("cell", "reach")), F.col("_at.cell").alias("cell"), F.col("_at.reach").alias("reach"))
    named = rows.sparkSession.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>")
    sizes = located.where("cell >= 0").groupBy("cell").agg(F.max("reach").alias("radius"), F.count(F.lit(1)).alias("n"))
    return located, sizes.join(F.broadcast(named), "cell").select("cell", "centre", "radius", "n")


class CellSearch:
    """The k vectors nearest to a query, exactly, without reading cells that are too far.

    `rows` (id, embedding, part, cell, reach) are sorted by (cell, reach) in each part,
    and `cells` (part, cell, centre, radius, n) describe them. By the triangle
    inequality a vector of reach r, in a cell whose centre is at distance d, is at least |d - r| away. The
    nearest cells give a k-th distance; then only cells and rings that may
    hold something as near are read. `cells`, `cells_read` and `rows_read` tell of the last search.
    """

    def __init__(self, rows: DataFrame, cells: DataFrame):
        self.rows, self._cells = rows, cells
        self.cells = self.cells_read = self.rows_read = 0

    def _within(self, spans: list[tuple[int, int, float, float]]) -> DataFrame:
        """Rows in rings of cells, and those of no cell."""
        wanted = self.rows.sparkSession.createDataFrame(spans, "_part int, _cell int, _low double, _high double")
        rows = self.rows.withColumn("cell", F.coalesce("cell", F.lit(-1)))
        met = (F.col("part") == F.col("_part")) & (F.col("cell") == F.col("_cell")) & F.col("reach").between(F.col("_low"), F.col("_high"))
        near = _intervals([(p, c) for p, c, _, _ in spans], "cell")
        # At most MOST_CELLS rows for each part.
        ringed = rows.where(near & (F.col("cell") >= 0)).join(F.broadcast(wanted), met, "left_semi")
        return ringed.unionByName(rows.where("cell = -1"))

    def nearest(self, query: list[float], k: int) -> DataFrame:
        """(id, distance), ties to the smaller id."""
        known = self._cells.where(F.size("centre") == len(query)).select("part", "cell", l2_distance(F.col("centre"), query).alias("d"), "radius", "n")
        cells = sorted(known.collect(), key=lambda r: (r.d, r.part, r.cell))
        held, first = 0, []
        for r in cells:
            if held >= k and len(first) >= 4:
                break
            first.append((r.part, r.cell, -math.inf, math.inf))
            held += r.n
        best = [r.distance for r in knn(self._within(first), query, k, "id").collect()]
        limit = best[-1] * (1 + 1e-9) + 1e-12 if len(best) == k else math.inf
        spans = [(r.part, r.cell, r.d - limit, r.d + limit) for r in cells if r.d - r.radius <= limit]
        self.cells, self.cells_read = len(cells), len(spans)
        self.rows_read = sum(r.n for r in cells if r.d - r.radius <= limit)
        return knn(self._within(spans), query, k, "id")


def query_phrases(query: str) -> list[list[str]]:
    """The phrases of a keyword query: each blank-separated term is one, of the tokens inside it."""
    out = [[t for t in re.split(r"[\W_]+", fold(term)) if t] for term in query.split()]
    return [p for p in out if p]


def fts_query(query: str) -> str:
    """A keyword query as quoted terms joined by OR."""
    return " OR ".join('"' + t.replace('"', '""') + '"' for t in query.split())


def fold(text: str) -> str:
    """A query as `tokens` reads it."""
    return re.sub("[\u0300-\u036f]", "", unicodedata.normalize("NFD", text.lower()))


def tokens(text: Column) -> Column:
    """The tokens of a text: runs of letters and digits, in lower case and without marks."""
    low = F.lower(text)
    plain = F.when(low.rlike(r"[^\x00-\x7F]"), unmarked(low)).otherwise(low)
    return F.filter(F.split(plain, TOKEN), lambda t: t != "")


def _frequency(words: Column, phrase: list[str]) -> Column:
    """How often the tokens of a phrase stand in a row."""
    if len(phrase) == 1:
        return F.size(F.filter(words, lambda t: t == phrase[0]))
    places = F.sequence(F.lit(0), F.greatest(F.size(words) - len(phrase), F.lit(0)))
    here = lambda i: reduce(lambda a, b: a & b, [F.coalesce(F.get(words, i + j) == p, F.lit(False)) for j, p in enumerate(phrase)])
    return F.size(F.filter(places, here))


def term_counts(rows: DataFrame, id_col: str, text: Column, phrases: list[list[str]]) -> DataFrame:
    """(id, dl, tf): document length and the frequency of each phrase, one narrow row for each document."""
    words = rows.select(F.col(id_col).alias("id"), F.explode(F.array(tokens(F.coalesce(text, F.lit(""))))).alias("words"))
    return words.select("id", F.size("words").alias("dl"), F.array(*(_frequency(F.col("words"), p) for p in phrases)).alias("tf"))


def bm25(rows: DataFrame, query: str, id_col: str, text: Column) -> DataFrame:
    """(id, score) of the rows that hold some phrase of `query`, by BM25 over all rows.

    Corpus statistics are one partial-aggregated row, broadcast to the scan.
    """
    phrases = query_phrases(query)
    if not phrases:
        return rows.select(F.col(id_col).alias("id"), F.lit(0.0).alias("score")).limit(0)
    counts = term_counts(rows, id_col, text, phrases)
    stats = counts.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"), *_frequencies(len(phrases)))
    return _scored(counts.where(F.exists("tf", lambda x: x > 0)), stats, len(phrases))


def _frequencies(phrases: int) -> list[Column]:
    return [F.array(*(F.count(F.when(F.get("tf", F.lit(j)) > 0, 1)) for j in range(phrases))).alias("df")]


def _scored(held: DataFrame, stats: DataFrame, phrases: int) -> DataFrame:
    """(id, score) of rows (id, dl, tf) by one row of corpus statistics (n, avgdl, df)."""
    n, dl = F.col("n").cast("double"), F.col("dl")

    def part(j: int) -> Column:
        tf, df = F.get("tf", F.lit(j)), F.get("df", F.lit(j)).cast("double")
        idf = F.greatest(F.lit(IDF_FLOOR), F.log((n - df + 0.5) / (df + 0.5)))
        return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / F.col("avgdl")))

    return held.crossJoin(F.broadcast(stats)).select("id", _sum([part(j) for j in range(phrases)]).alias("score"))


def bm25_stored(stored: DataFrame, sizes: DataFrame, query: str) -> DataFrame:
    """bm25 from a stored inverted index: postings (term, id, tf, positions) and document lengths (id, dl).

    Only the query's terms are read of the postings, a filter that reaches a
    scan sorted by term; lengths are read for the corpus statistics and joined
    to the documents that hold some term.
    """
    phrases = query_phrases(query)
    if not phrases:
        return sizes.select("id", F.lit(0.0).alias("score")).limit(0)
    terms = sorted({t for p in phrases for t in p})
    found = stored.where(F.col("term").isin(terms)).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("at"))
    counts = found.select("id", F.array(*map(_phrase_count, phrases)).alias("tf")).where(F.exists("tf", lambda x: x > 0))
    corpus = sizes.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    stats = corpus.crossJoin(F.broadcast(counts.agg(*_frequencies(len(phrases)))))
    return _scored(counts.join(sizes, "id"), stats, len(phrases))


def postings(rows: DataFrame, id_col: str, text: Column) -> DataFrame:
    """(term, id, tf, positions): the inverted index; a row's tokens meet in its own groups only."""
    words = rows.select(F.col(id_col).alias("id"), F.posexplode(tokens(F.coalesce(text, F.lit("")))).alias("position", "term"))
    return words.groupBy("term", "id").agg(F.count(F.lit(1)).alias("tf"), F.array_sort(F.collect_list("position")).alias("positions"))


#: Documents of a block of postings; blocks listed by number in a filter, and the intervals that they are joined to there.
BLOCK, LISTED, INTERVALS = 64, 10_000, 32
#: Postings of a batch that goes back from Python.
POSTINGS = 1 << 18
IMPACTS = "term string, block bigint, n bigint, max_tf bigint, min_dl int"


def _inverted(ids: list[str]):
    """Postings of rows (ids, block, words), a batch at a time: words are numbered in their order, and places sorted by word and row.

    So the pages of a file hold few words each, and a scan for some words passes over the others.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column("words")
            ends = words.offsets.to_numpy().astype(np.int64)
            sizes = np.diff(ends)
            numbered = words.flatten().dictionary_encode()
            known = pc.array_sort_indices(numbered.dictionary)
            rank = np.empty(len(known), np.int64)
            rank[known.to_numpy()] = np.arange(len(known))
            row = np.repeat(np.arange(len(sizes)), sizes)
            place = np.arange(len(row)) - np.repeat(ends[:-1] - ends[0], sizes)
            key = rank[numbered.indices.to_numpy()] * len(sizes) + row
            order = np.argsort(key, kind="stable")
            starts = np.flatnonzero(np.diff(key[order], prepend=-1))
            stops = np.append(starts[1:], len(order))
            for a in range(0, len(starts), POSTINGS):
                low, high = starts[a : a + POSTINGS], stops[a : a + POSTINGS]
                first, own = order[low], pa.array(row[order[low]])
                at = pa.ListArray.from_arrays(pa.array(np.append(low, high[-1]) - low[0], pa.int32()), pa.array(place[order[low[0] : high[-1]]], pa.int32()))
                columns = {"term": numbered.dictionary.take(numbered.indices.take(pa.array(first)))} | {c: batch.column(c).take(own) for c in ids}
                columns |= {"tf": pa.array(high - low, pa.int64()), "positions": at, "block": batch.column("block").take(own), "dl": pa.array(sizes[row[first]], pa.int32())}
                yield pa.RecordBatch.from_pydict(columns)

    return run


def block_postings(rows: DataFrame, ids: list[str], text: Column, size: int = BLOCK) -> DataFrame:
    """(term, ids, tf, positions, block, dl): `blocked` postings of rows whose ids are unique; rows with a null id have none.

    Only the rows are moved, into the order of their ids: a row's words are split
    once and meet where the row is.
    """
    placed = rows.select(*ids, F.coalesce(text, F.lit("")).alias("words")).dropna(subset=ids).repartitionByRange(*ids).sortWithinPartitions(*ids)
    words = placed.select(*ids, F.floor(F.monotonically_increasing_id() / size).alias("block"), tokens(F.col("words")).alias("words"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in words.select(*ids).schema)
    return words.mapInArrow(_inverted(ids), f"term string, {kinds}, tf bigint, positions array<int>, block bigint, dl int")


def blocked(posts: DataFrame, sizes: DataFrame, ids: list[str], size: int = BLOCK) -> DataFrame:
    """Postings with `block` and `dl` from postings (term, ids, ...) and lengths (ids, dl).

    A block is a run of `size` documents in the order of their ids, so that documents
    of one folder share blocks.
    """
    placed = sizes.repartitionByRange(*ids).sortWithinPartitions(*ids).withColumn("block", F.floor(F.monotonically_increasing_id() / size))
    return posts.join(materialise(placed, "placed"), ids)


def impacts(posts: DataFrame) -> DataFrame:
    """Of each term and block of stored postings how many documents hold it, its highest frequency, and their smallest length.

    Together they bound the score of any document of the block, whatever the corpus statistics become.
    """
    return posts.groupBy("term", "block").agg(F.count(F.lit(1)).alias("n"), F.max("tf").alias("max_tf"), F.min("dl").cast("int").alias("min_dl"))


def _impact(tf: Column, dl: Column, avgdl: float) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / F.lit(avgdl)))


def _idf(n: int, df: int) -> float:
    return max(IDF_FLOOR, math.log((n - df + 0.5) / (df + 0.5)))


class BlockSearch:
    """The best rows of a keyword query by BM25 from blocks of postings, exactly, without reading all of them.

    `postings` (term, id, positions, part, block, dl) and `impacts` are sorted by
    (term, block) in each part, a segment; `n` and `avgdl` are of the whole corpus.
    `dead` has the postings (term) of rows that are gone but counted in impacts. A few blocks of
    the highest bounds give a score that the k-th best cannot fall below; blocks
    whose bound is lower are never read. `blocks` and `blocks_read` tell how many
    blocks hold a term of the query and how many were read for scores.
    """

    def __init__(self, postings: DataFrame, impacts: DataFrame, n: int, avgdl: float, dead: DataFrame | None = None):
        self.postings, self.impacts, self.n, self.avgdl, self.dead = postings, impacts, n, avgdl, dead
        self.blocks = self.blocks_read = 0

    def _counts(self, phrases: list[list[str]], blocks: DataFrame | None) -> DataFrame:
        """(id, dl, tf) of the rows that hold some phrase, in some blocks only."""
        found = self.postings.where(F.col("term").isin(sorted({t for p in phrases for t in p})))
        if blocks is not None:
            found = checked_join(found.where(_near(blocks)), blocks.select("part", "block"), ["part", "block"], "left_semi")
        at = found.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("at"), F.first("dl").alias("dl"))
        return at.select("id", "dl", F.array(*(_phrase_count(p) for p in phrases)).alias("tf")).where(F.exists("tf", lambda x: x > 0))

    def _score(self, counts: DataFrame, idf: list[float]) -> DataFrame:
        return counts.select("id", _sum([F.lit(w) * _impact(F.get("tf", F.lit(j)), F.col("dl"), self.avgdl) for j, w in enumerate(idf)]).alias("score"))

    def top(self, query: str, k: int, pilot: int = 8, tied: bool = False) -> DataFrame:
        """(id, score) of the best k rows, ties to the smaller id; with `tied`, all that tie with the k-th too."""
        phrases = query_phrases(query)
        none = self.postings.select("id", F.lit(0.0).alias("score")).limit(0)
        if not phrases or not self.n:
            return none
        terms = sorted({t for p in phrases for t in p})
        held = materialise(self.impacts.where(F.col("term").isin(terms)), "impacts")
        df = {r.term: r.n for r in held.groupBy("term").agg(F.sum("n").alias("n")).collect()}
        if self.dead is not None:
            for r in self.dead.where(F.col("term").isin(terms)).groupBy("term").count().collect():
                df[r.term] -= r["count"]
        # A block's frequency of each phrase is at most that of its rarest term there, and only where all are.
        by_term = F.map_from_entries(F.collect_list(F.struct("term", F.struct("max_tf", "min_dl"))))
        bounds = held.groupBy("part", "block").agg(by_term.alias("at"))
        for j, p in enumerate(phrases):
            own = [F.try_element_at("at", F.lit(t)) for t in p]
            some = reduce(lambda a, b: a & b, [x.isNotNull() for x in own])
            # Repeated, so that both functions have two arguments at least.
            tf, dl = F.least(*(x["max_tf"] for x in own * 2)), F.greatest(*(x["min_dl"] for x in own * 2))
            bounds = bounds.withColumn(f"b{j}", F.when(some, _impact(tf, dl, self.avgdl)))
        bounds = materialise(bounds.drop("at"), "bounds")
        idf = []
        for j, p in enumerate(phrases):
            frequency = df.get(p[0], 0) if len(p) == 1 else self._counts([p], bounds.where(F.col(f"b{j}").isNotNull()).select("part", "block")).count()
            idf.append(_idf(self.n, frequency))
        # A rounding error of bounds must not lose a row.
        bound = _sum([F.coalesce(F.col(f"b{j}"), F.lit(0.0)) * w for j, w in enumerate(idf)]) * (1 + 1e-12)
        ranges = materialise(bounds.select("part", "block", bound.alias("bound")).where("bound > 0"), "ranges")
        self.blocks = ranges.count()
        first = materialise(ranges.orderBy(F.desc("bound"), "part", "block").limit(pilot + -(-k // BLOCK)), "pilot")
        best = [r.score for r in self._score(self._counts(phrases, first), idf).orderBy(F.desc("score")).limit(k).collect()]
        wanted = materialise(ranges.where(F.col("bound") >= (best[-1] if len(best) == k else 0.0)), "wanted")
        self.blocks_read = wanted.count()
        scored = self._score(self._counts(phrases, wanted), idf)
        if tied:
            scored = materialise(scored, "scored")
            last = scored.orderBy(F.desc("score")).limit(k).agg(F.min("score")).first()[0]
            found = materialise(scored.where(F.col("score") >= last), "best")
            discard(scored)
        else:
            found = materialise(scored.orderBy(F.desc("score"), "id").limit(k), "best")
        discard(held, bounds, ranges, first, wanted)
        return found


def _intervals(keys: list[tuple[int, int]], column: str) -> Column:
    """A filter that a sorted scan can use: intervals of each part that hold its wanted keys, split at the widest gaps."""
    rows = sorted(keys)
    gaps = sorted(((b[1] - a[1], i) for i, (a, b) in enumerate(zip(rows, rows[1:])) if a[0] == b[0]), reverse=True)
    cuts = sorted({i for _, i in gaps[:INTERVALS]} | {i for i, (a, b) in enumerate(zip(rows, rows[1:])) if a[0] != b[0]} | ({len(rows) - 1} if rows else set()))
    spans = [(rows[a + 1], rows[b]) for a, b in zip([-1, *cuts], cuts)]
    return reduce(lambda x, y: x | y, [(F.col("part") == low[0]) & F.col(column).between(low[1], high[1]) for low, high in spans], F.lit(False))


def _near(blocks: DataFrame) -> Column:
    """A filter of wanted blocks, as far as they are few."""
    rows = blocks.select("part", "block").limit(LISTED + 1).collect()
    return F.lit(True) if len(rows) > LISTED else _intervals([(r.part, r.block) for r in rows], "block")


def _phrase_count(phrase: list[str]) -> Column:
    """How often a phrase stands in a row, from the positions of its terms in the map `at`."""
    places = lambda t: F.coalesce(F.try_element_at("at", F.lit(t)), F.array().cast("array<int>"))
    here = lambda i: reduce(lambda a, b: a & b, [F.array_contains(places(t), i + j) for j, t in enumerate(phrase[1:], 1)])
    return F.size(places(phrase[0])) if len(phrase) == 1 else F.size(F.filter(places(phrase[0]), here))


def fts_candidates(scores: DataFrame, most: int = FTS_CANDIDATES) -> DataFrame:
    """The best keyword candidates with their scores normalised by the best one's."""
    best = scores.orderBy(F.desc("score"), "id").limit(most)
    top = F.max("score").over(Window.partitionBy())
    return best.withColumn("fts_score", F.when(top > 0, F.col("score") / top).otherwise(0.0)).select("id", "fts_score")


def newest_candidates(scores: DataFrame, times: DataFrame, most: int = FTS_CANDIDATES) -> DataFrame:
    """`fts_candidates` whose ties go to the newer row by `times` (id, ms), those without a time last, then to the smaller id."""
    age = F.coalesce(-F.col("ms"), F.lit((1 << 63) - 1))
    aged = scores.join(times.select("id", "ms"), "id", "left").select(F.struct(age.alias("age"), "id").alias("id"), "score")
    return fts_candidates(aged, most).select("id.id", "fts_score")


def hybrid_candidates(keyword: DataFrame, vector: DataFrame) -> DataFrame:
    """(id, vec_score, fts_score, semantic_score): the union of both candidate sets; a missing side counts 0."""
    both = keyword.join(vector, "id", "full").select("id", F.coalesce("vec_score", F.lit(0.0)).alias("vec_score"), F.coalesce("fts_score", F.lit(0.0)).alias("fts_score"))
    return both.withColumn("semantic_score", F.col("vec_score") * 0.6 + F.col("fts_score") * 0.4)


def ranked(rows: DataFrame, score: str, *ties: str, by: tuple[str, ...] = ()) -> DataFrame:
    """`rows` with their long rank from 1 by falling score, within `by`."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), *ties)).cast("long"))


def global_rank(rows: DataFrame, order: list[Column], by: tuple[str, ...] = (), out: str = "rank") -> DataFrame:
    """`rows` with `out`, their long rank from 1 in `order` within `by`, for groups of any size.

    `ranked` sorts a group in one task; here the rows are dealt by ranges of
    (by, order, place in the input), so that neither a large group nor a large
    tie has to fit a task, and are written once in sorted order. A row's place in its
    partition is then known; what earlier partitions hold of its group is added
    from a table of one row for each partition and group in it. Equal rows get
    different ranks. Nulls of `by` are a group; nulls of `order` are placed as it says.
    """
    tie, at, part, before, *keys = private(rows, "tie", "at", "part", "before", *(f"by{i}" for i in range(len(by))))
    placed = rows.withColumn(tie, F.monotonically_increasing_id())
    sort = [*(F.col(f"`{c}`") for c in by), *order, F.col(tie)]
    placed = placed.repartitionByRange(*sort).sortWithinPartitions(*sort).drop(tie)
    table = materialise(placed.withColumn(at, F.monotonically_increasing_id()), "ranked")
    # The upper bits of `at` are the partition, the lower 33 the place in it.
    table = table.withColumn(part, F.shiftright(at, 33))
    groups = table.groupBy(F.col(part), *(F.col(f"`{c}`").alias(k) for c, k in zip(by, keys))).agg(F.count(F.lit(1)).alias("_n"), F.min(at).alias("_first"))
    earlier = F.coalesce(F.sum("_n").over(Window.partitionBy(*(keys or [F.lit(0)])).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # At most one group of a partition began in an earlier one, so a group meets as many rows here as it fills partitions.
    offsets = materialise(groups.select(F.col(part).alias(f"{part}_"), *keys, (earlier - F.col("_first") + 1).alias(before)), "offsets")
    on = F.col(part) == F.col(f"{part}_")
    for c, k in zip(by, keys):
        on = on & F.col(f"`{c}`").eqNullSafe(F.col(k))
    found = checked_join(table, offsets, on)
    return found.select(*(F.col(f"`{c}`") for c in rows.columns), (F.col(at) + F.col(before)).alias(out))


def previous(rows: DataFrame, keys: list[str], order: list[str], value: Column, out: str) -> DataFrame:
    """`rows` with `out`: `value` of the row before, in `order` within `keys`; null for the first. Groups may have any size.

    What a window does in one task for a group is done by global ranks: each row
    meets the one of the rank before, so a group of any size spreads. Rows are
    told apart by their place in the input where the order leaves ties.
    """
    rank, own, before, *names = private(rows.withColumn(out, F.lit(None)), "rank", "own", "before", *(f"k{i}" for i in range(len(keys))))
    ranks = materialise(global_rank(rows.withColumn(own, value), [F.asc(c) for c in order], by=tuple(keys), out=rank), "ordered")
    earlier = ranks.select(*(F.col(c).alias(n) for c, n in zip(keys, names)), (F.col(rank) + 1).alias(before), F.col(own).alias(out))
    on = F.col(rank) == F.col(before)
    for c, n in zip(keys, names):
        on = on & F.col(c).eqNullSafe(F.col(n))
    return ranks.drop(own).join(earlier, on, "left").drop(rank, before, *names)


def rrf(lanes: DataFrame, id_col: str = "id", k: int = RRF_K, large: bool = False) -> DataFrame:
    """(id, rrf_score) from (lane, id, score): reciprocal ranks added over lanes; ids that repeat within a lane add up.

    A lane is ranked in one task, as fits the candidates of a search; with `large`, by ranges, for lanes of any size.
    """
    ranks = global_rank(lanes, [F.desc("score"), F.asc(id_col)], by=("lane",)) if large else ranked(lanes, "score", id_col, by=("lane",))
    return ranks.groupBy(id_col).agg(F.sum(F.lit(1.0) / (F.lit(k) + F.col("rank"))).alias("rrf_score"))


def _page_maxima(query: list[list[float]]):
    """For each page of a batch, the best cosine of each query vector."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = np.array(query, np.float64)
        size = np.sqrt((q * q).sum(axis=1, keepdims=True))
        q = np.divide(q, size, out=np.zeros_like(q), where=size > 0).T
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1))
            own = np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
            sims = np.divide(x @ q, own, out=np.zeros((len(x), q.shape[1])), where=own > 0)
            pages = batch.column(0).dictionary_encode()
            code = pages.indices.fill_null(len(pages.dictionary)).to_numpy(zero_copy_only=False)
            order = np.argsort(code, kind="stable")
            first = np.flatnonzero(np.concatenate(([True], np.diff(code[order]) != 0)))
            best = np.maximum.reduceat(sims[order], first, axis=0)
            yield pa.record_batch([batch.column(0).take(pa.array(order[first])), pa.array(list(best), pa.list_(pa.float64()))], [batch.schema.names[0], "best"])

    return run


def maxsim(pages: DataFrame, query: list[list[float]], page_col: str, vector_col: str = "embedding") -> DataFrame:
    """(page_col, score): for each query vector the best cosine on a page, added over query vectors.

    Maxima are combined before the shuffle, so a page's vectors never meet in one place.
    Vectors that are null or of another width take no part.
    """
    known = pages.where(F.size(vector_col) == len(query[0])).select(F.col(page_col), F.col(vector_col))
    names = [f"s{j}" for j in range(len(query))]
    if sum(map(len, query)) <= UNROLL:
        sims = known.select(F.col(page_col), *(cosine(F.col(vector_col), q).alias(n) for q, n in zip(query, names)))
    else:
        kind = known.schema[0].dataType.simpleString()
        parts = known.mapInArrow(_page_maxima(query), f"`{page_col}` {kind}, best array<double>")
        sims = parts.select(F.col(page_col), *(F.get("best", F.lit(j)).alias(n) for j, n in enumerate(names)))
    best = sims.groupBy(page_col).agg(*(F.max(n).alias(n) for n in names))
    return best.select(page_col, _sum([F.col(n) for n in names]).alias("score"))


PAGE_BOUNDS = "width int, centre array<double>, radius double"


def _units(column: pa.Array, width: int) -> np.ndarray:
    """Vectors of one width on the unit sphere; zero ones stay zero."""
    x = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, width)
    size = np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
    with np.errstate(invalid="ignore"):
        return np.divide(x, size, out=np.zeros_like(x), where=size != 0)


def _by_width(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    widths = pc.list_value_length(batch.column(column)).to_numpy(zero_copy_only=False)
    for width in sorted(set(widths.tolist())):
        yield int(width), batch.filter(pa.array(widths == width))


def _runs_of(pages: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The order of a batch's rows by page, and where each page begins in it."""
    code = pages.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
    order = np.argsort(code, kind="stable")
    return order, np.flatnonzero(np.concatenate(([True], np.diff(code[order]) != 0)))


def _middles(page: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for width, part in _by_width(batch, 1) if batch.num_rows else ():
                order, first = _runs_of(part.column(0))
                n = np.diff(np.append(first, len(order)))
                middle = np.add.reduceat(_units(part.column(1), width)[order], first, axis=0) / n[:, None]
                yield pa.record_batch([part.column(0).take(pa.array(order[first])), pa.array([width] * len(n), pa.int32()), pa.array(n), pa.array(list(middle), pa.list_(pa.float64()))], [page, "width", "n", "centre"])

    return run


def _radii(page: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for width, part in _by_width(batch, 1) if batch.num_rows else ():
                away = _units(part.column(1), width) - part.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
                order, first = _runs_of(part.column(0))
                far = np.maximum.reduceat(np.sqrt(np.einsum("ij,ij->i", away, away))[order], first)
                # A vector that is not finite bounds nothing: its page is always opened.
                far = np.where(np.isfinite(far), far, np.inf)
                yield pa.record_batch([part.column(0).take(pa.array(order[first])), pa.array([width] * len(far), pa.int32()), pa.array(far)], [page, "width", "radius"])

    return run


def page_bounds(pages: DataFrame, page_col: str, vector_col: str = "embedding") -> DataFrame:
    """(page_col, width, centre, radius): a ball around the unit vectors of each page and width.

    The centre is the mean of the page's largest run of rows in a batch, so that
    means are never gathered; the radius is the greatest distance from it.
    """
    kind = pages.schema[page_col].dataType.simpleString()
    known = pages.where(F.size(vector_col) > 0).select(F.col(page_col), F.col(vector_col))
    means = known.mapInArrow(_middles(page_col), f"`{page_col}` {kind}, width int, n long, centre array<double>")
    centres = materialise(means.groupBy(page_col, "width").agg(F.max_by("centre", F.struct("n", "centre")).alias("centre")), "middles")
    page, width = private(known, "page", "width")
    met = F.col(page_col).eqNullSafe(F.col(page)) & (F.size(vector_col) == F.col(width))
    beside = checked_join(known, centres.select(F.col(page_col).alias(page), F.col("width").alias(width), "centre"), met).select(page_col, vector_col, "centre")
    radii = beside.mapInArrow(_radii(page_col), f"`{page_col}` {kind}, width int, radius double").groupBy(F.col(page_col).alias(page), F.col("width").alias(width)).agg(F.max("radius").alias("radius"))
    return centres.join(radii, F.col(page_col).eqNullSafe(F.col(page)) & (F.col("width") == F.col(width))).select(page_col, "width", "centre", "radius")


def _bounds(query: list[list[float]], page: str):
    """The most that a page's late interaction with `query` can be, by its ball."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = np.array(query, np.float64)
        size = np.sqrt((q * q).sum(axis=1, keepdims=True))
        q = np.divide(q, size, out=np.zeros_like(q), where=size > 0).T
        for batch in batches:
            if batch.num_rows:
                near = _matrix(batch.column(1)) @ q + batch.column(2).to_numpy(zero_copy_only=False)[:, None]
                yield pa.record_batch([batch.column(0), pa.array(np.minimum(np.nan_to_num(near, nan=1.0), 1.0).sum(axis=1) + 1e-9)], [page, "bound"])

    return run


class PageSearch:
    """The k best pages by late interaction, exactly, opening those only whose bound may reach the k-th score.

    `pages` and `bounds` are as `page_bounds` has them. `pages_known` and `pages_read` tell of the last search.
    """

    def __init__(self, pages: DataFrame, bounds: DataFrame, page_col: str, vector_col: str = "embedding"):
        self.pages, self.bounds, self.page, self.vector = pages, bounds, page_col, vector_col
        self.pages_known = self.pages_read = 0

    def _scores(self, query: list[list[float]], wanted: DataFrame) -> DataFrame:
        (page,) = private(self.pages, "page")
        own = checked_join(self.pages, wanted.select(F.col(self.page).alias(page)), F.col(self.page).eqNullSafe(F.col(page)), "left_semi")
        return maxsim(own, query, self.page, self.vector).orderBy(F.desc("score"), self.page)

    def top(self, query: list[list[float]], k: int) -> DataFrame:
        """(page_col, score), ties to the smaller page."""
        kind = self.bounds.schema[self.page].dataType.simpleString()
        known = self.bounds.where(F.col("width") == len(query[0])).select(self.page, "centre", "radius")
        bounds = materialise(known.mapInArrow(_bounds(query, self.page), f"`{self.page}` {kind}, bound double"), "bounds")
        first = materialise(bounds.orderBy(F.desc("bound"), self.page).limit(2 * k + 8), "pilot")
        best = [r.score for r in self._scores(query, first).limit(k).collect()]
        least = best[-1] if len(best) == k and best[-1] == best[-1] else -math.inf
        wanted = materialise(bounds.where(F.col("bound") >= least), "opened")
        self.pages_known, self.pages_read = bounds.count(), wanted.count()
        return self._scores(query, wanted).limit(k)


def keep_best(rows: DataFrame, keys: list[str], score: str, *ties: str) -> DataFrame:
    """The best row of each key by falling score."""
    order = Window.partitionBy(*keys).orderBy(F.desc(score), *ties)
    return rows.withColumn("_place", F.row_number().over(order)).where("_place = 1").drop("_place")


def cut_per_index(rows: DataFrame, most: int, score: str, *ties: str, index_col: str = "index_name") -> DataFrame:
    """The best `most` rows of each index."""
    order = Window.partitionBy(index_col).orderBy(F.desc(score), *ties)
    return rows.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= most).drop("_place")
