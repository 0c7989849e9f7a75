"""Operator 5: language identification by rank-order n-gram profiles.

A profile is the list of a text's most frequent character n-grams, most
frequent first (ties by code points). A document is compared with every
language's profile by the out-of-place distance: the sum, over the document's
n-grams, of how far each stands from its rank in the language's profile, or of
the profile's length where it is absent. The language at the least distance wins.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.operators.ranking import global_rank
from gleaner.runtime import checked_join, materialise

UNDETERMINED = "und"
#: Length of profiles, of documents and of languages.
PROFILE = 300
ORDERS = (1, 2, 3)
#: At most so many labelled documents of a language are learned from, those with the smallest MD5 of their ids.
TRAIN_ROWS = 1_000
#: A text that scores less than this under every profile is in no learned language. Labelled documents score 0.32 and more
#: on check_s (median 0.69); unlearned languages (200 letters and more), random letters and base64 0.14 to 0.29.
LEAST_SCORE = 0.32
#: Where labelled documents score low themselves, the threshold is this share of the median of the lowest language.
LEAST_SHARE = 0.5

_SPACE = 32
_tables: tuple[np.ndarray, np.ndarray] | None = None


def _letters() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: whether it is a letter; its lower-case form if that is one code point."""
    global _tables
    if _tables is None:
        letter, lower = np.zeros(0x110000, bool), np.arange(0x110000, dtype=np.uint32)
        for c in range(0x110000):
            x = chr(c)
            if x.isalpha():
                letter[c] = True
                low = x.lower()
                if len(low) == 1:
                    lower[c] = ord(low)
        _tables = letter, lower
    return _tables


def _units(text: str) -> np.ndarray:
    """Lower-case letters with one space for each run of anything else, and one at either end."""
    letter, lower = _letters()
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letter[codes]
    out = np.where(is_letter, lower[codes], _SPACE)
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]
    out = out[keep]
    return np.concatenate(([_SPACE], out, [_SPACE] if len(out) and out[-1] != _SPACE else [])).astype(np.uint64)


def ngram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of a whole text, packed as 21 bits a letter, in order of code points, and their counts.

    Blanks alone are no n-gram. Packing puts the first letter highest, so
    that for one length packed order is the order of strings.
    """
    u = _units(text)
    made = []
    for n in ORDERS:
        if len(u) >= n:
            g = u[: len(u) - n + 1]
            for i in range(1, n):
                g = (g << np.uint64(21)) | u[i : len(u) - n + 1 + i]
            g = g << np.uint64(21 * (max(ORDERS) - n))
            made.append(g if n > 1 else g[u != _SPACE])
    grams = np.concatenate(made)
    grams.sort()
    first = np.flatnonzero(np.concatenate(([True], grams[1:] != grams[:-1]))) if len(grams) else np.zeros(0, int)
    return grams[first], np.diff(np.append(first, len(grams)))


def top(grams: np.ndarray, counts: np.ndarray, k: int = PROFILE) -> np.ndarray:
    """The k n-grams of the highest counts, ties in order of code points."""
    if len(counts) > 4 * k:
        least = np.partition(counts, len(counts) - k)[len(counts) - k]
        keep = counts >= least
        grams, counts = grams[keep], counts[keep]
    return grams[np.argsort(-counts, kind="stable")][:k]


class Profiles:
    """The learned profiles, indexed for look-up."""

    def __init__(self, profiles: dict[str, np.ndarray], k: int = PROFILE):
        self.names, self.k = sorted(profiles), k
        self.grams = np.unique(np.concatenate([*profiles.values(), np.zeros(0, np.uint64)]))
        self.ranks = np.full((len(self.names), len(self.grams) + 1), -1, np.int64)
        for i, name in enumerate(self.names):
            self.ranks[i, np.searchsorted(self.grams, profiles[name])] = np.arange(len(profiles[name]))

    def judge(self, text: str | None) -> tuple[str, float]:
        """The nearest language and 1 - distance / largest distance; `und` and 0 without a letter or a profile."""
        if not text or not self.names:
            return UNDETERMINED, 0.0
        grams, counts = ngram_counts(text)
        if not len(grams):
            return UNDETERMINED, 0.0
        own = top(grams, counts, self.k)
        at = np.searchsorted(self.grams, own)
        at[at == len(self.grams)] = 0
        known = self.grams[at] == own
        ranks = self.ranks[:, np.where(known, at, len(self.grams))]
        distance = np.where(ranks >= 0, np.abs(ranks - np.arange(len(own))), self.k).sum(axis=1)
        best = int(distance.argmin())
        return self.names[best], float(1.0 - distance[best] / (self.k * len(own)))


def fold(doc_id):
    """crc32 of the id as text (a null one as the empty text), modulo 4; documents at 2 are held out."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1)):
            g, n = ngram_counts(text.as_py())
            yield pa.record_batch([pa.array([lang.as_py()] * len(g), pa.string()), pa.array(g.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])


def sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """(lang, text) of the documents learned from: of each language the `train_rows` labelled ones, not held out, with the smallest MD5 of their id.

    A null id counts as the empty text. Rows that repeat an id and text are
    learned from once; of different texts with one id the smaller hashes come first.
    """
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (fold(id_col) != 2))
    order_key = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    labelled = labelled.select(F.col(lang_col).alias("lang"), order_key.alias("h"), F.xxhash64(text_col).alias("t"), F.col(text_col).alias("text"))
    keys = labelled.select("lang", "h", "t")
    # Only rows among the smallest hashes are ranked: four times as many as wanted, by each language's number of ids.
    counts = keys.groupBy("lang").agg(F.approx_count_distinct("h").alias("ids"))
    near = F.conv(F.substring("h", 1, 13), 16, 10).cast("long") / F.lit(2.0**52) <= F.lit(4.0 * train_rows) / F.col("ids")
    keys = checked_join(keys, materialise(counts, "counts"), "lang", limit=10_000).where(near).select("lang", "h", "t").distinct()
    # Many texts may share one id, or have none: no task ranks a whole language.
    places = global_rank(keys, [F.asc("h"), F.asc("t")], by=("lang",), out="n")
    keys = materialise(places.where(F.col("n") <= train_rows).drop("n"), "sample")
    return checked_join(labelled, keys, ["lang", "h", "t"], "left_semi").dropDuplicates(["lang", "h", "t"]).select("lang", "text")


def profiles_of(texts: DataFrame, k: int = PROFILE) -> dict[str, np.ndarray]:
    """The profiles of (lang, text) rows; what comes to the driver is `k` n-grams for each language."""
    counts = texts.mapInArrow(_counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    rows = counts.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).collect()
    out: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: (r.lang, r.rank)):
        out.setdefault(r.lang, []).append(r.gram)
    return {lang: np.array(g, np.int64).view(np.uint64) for lang, g in out.items()}


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", k: int = PROFILE, train_rows: int = TRAIN_ROWS) -> dict[str, np.ndarray]:
    """Profiles of all languages in `docs`, from the whole texts of `sample`'s documents."""
    return profiles_of(sample(docs, id_col, text_col, lang_col, train_rows), k)


def _shipped(profiles: dict[str, np.ndarray], k: int):
    """Profiles as plain bytes for the closure, turned into look-up tables once a worker."""
    packed = {lang: base64.b64encode(g.tobytes()) for lang, g in profiles.items()}
    cache: list[Profiles] = []

    def get() -> Profiles:
        if not cache:
            cache.append(Profiles({lang: np.frombuffer(base64.b64decode(g), np.uint64) for lang, g in packed.items()}, k))
        return cache[0]

    return get


def identify(docs: DataFrame, profiles: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text", k: int = PROFILE) -> DataFrame:
    """(id_col, lang_pred, score) for each row of `docs`; nothing but the text is looked at.

    Defined cases: a null text, one without a letter, or any text when no
    language was learned is `und` with score 0; of equally near languages the
    first by name wins; repeated rows are judged alike; a text of any length is
    judged whole, and its task holds its n-grams; ids are passed through, null
    or repeated; an empty table gives no rows.
    """
    models = _shipped(profiles, k)

    def run(batches):
        judge = models().judge
        for batch in batches:
            found = [judge(t.as_py()) for t in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], [id_col, "lang_pred", "score"])

    source = docs.select(F.col(id_col), F.col(text_col).alias("text"))
    kind = source.schema[0].dataType.simpleString()
    return source.mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double")


def least_score(texts: DataFrame, profiles: dict[str, np.ndarray], k: int = PROFILE) -> float:
    """The rejection threshold from the scores of the (lang, text) rows that `profiles` were learned from.

    Half the median score of the language where that is lowest, so that junk
    among the labelled documents does not move it and no language is lost as a
    whole; never above LEAST_SCORE, since the profile of a few documents fits
    them too well.
    """
    medians = identify(texts, profiles, "lang", "text", k).where(F.col("lang_pred") != UNDETERMINED).groupBy("lang").agg(F.median("score").alias("m"))
    return min([LEAST_SCORE, *(LEAST_SHARE * r.m for r in medians.collect())])


def keep_languages(docs: DataFrame, profiles: dict[str, np.ndarray], text_col: str = "text", wanted: set[str] | None = None, least_score: float = LEAST_SCORE, k: int = PROFILE) -> DataFrame:
    """The rows of `docs`, unchanged, whose language is determined, wanted (None: any learned one) and scores enough."""
    models = _shipped(profiles, k)

    def run(batches):
        judge = models().judge
        for batch in batches:
            keep = []
            for t in batch.column(batch.schema.get_field_index(text_col)):
                lang, score = judge(t.as_py())
                keep.append(lang != UNDETERMINED and score >= least_score and (wanted is None or lang in wanted))
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
