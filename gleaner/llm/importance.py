"""Target-distribution importance resampling on hashed n-grams, whose CRCs are composed from those of words.

Features of a text are all runs of 1 to 3 consecutive words joined by one
space; a feature's bucket is the CRC32 of its bytes modulo BUCKETS. CRC32 is
linear over GF(2): crc(A B) = M^len(B) crc(A) xor crc(B), where M is the 32 x 32
bit matrix that sends a checksum past one zero byte. So each word is read once,
and its CRC and length make the CRCs of every run that it ends; no run is ever
a string. A document's weight is the sum of its features' log ratios of target
to source, and adding Gumbel noise from a hash of its id makes the highest
scores a weighted sample without replacement.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm._arrow import steps
from gleaner.operators.ranking import global_rank
from gleaner.runtime import materialise, private

BUCKETS = 10_000
LONGEST = 3
SEED = 42
#: Bytes of one text handled in a step; a longer text is cut between words.
BLOCK = 1 << 20
#: Words up to so many bytes are read column by column; longer ones by themselves.
COLUMNS = 32
#: Length-shift matrices up to so many bytes are kept; longer shifts are products of powers.
SHIFTS = 64
_U = np.uint32
_ONES = _U(0xFFFFFFFF)
_WORD = np.zeros(256, bool)
_WORD[[*b"0123456789abcdefghijklmnopqrstuvwxyz"]] = True
_WORD[128:] = True


def _byte_table() -> np.ndarray:
    """The reflected CRC32 of each byte value, by the polynomial."""
    x = np.arange(256, dtype=_U)
    for _ in range(8):
        x = np.where(x & _U(1), (x >> _U(1)) ^ _U(0xEDB88320), x >> _U(1))
    return x


_BYTE = _byte_table()


def _zero_byte(x: np.ndarray) -> np.ndarray:
    return _BYTE[x & _U(255)] ^ (x >> _U(8))


def _lookup(columns: np.ndarray) -> np.ndarray:
    """A 32 x 32 bit matrix, given by the images of the unit vectors, as four tables of 256: one for each byte of a vector."""
    table = np.zeros((4, 256), _U)
    for bit in range(32):
        byte, at = divmod(bit, 8)
        table[byte, (np.arange(256) >> at) & 1 == 1] ^= columns[bit]
    return table


def _times(table: np.ndarray, x: np.ndarray) -> np.ndarray:
    return table[0][x & _U(255)] ^ table[1][(x >> _U(8)) & _U(255)] ^ table[2][(x >> _U(16)) & _U(255)] ^ table[3][x >> _U(24)]


def _matrices() -> tuple[np.ndarray, list[np.ndarray]]:
    """The shifts by 0 to SHIFTS - 1 bytes, and those by SHIFTS, 2 SHIFTS, 4 SHIFTS ... bytes."""
    unit = _U(1) << np.arange(32, dtype=_U)
    small, columns = [], unit
    for _ in range(SHIFTS):
        small.append(_lookup(columns))
        columns = _zero_byte(columns)
    powers = []
    for _ in range(32):
        powers.append(_lookup(columns))
        columns = _times(powers[-1], columns)  # the square
    return np.stack(small), powers


_SMALL, _POWERS = _matrices()
_FLAT = [np.ascontiguousarray(_SMALL[:, byte, :]).reshape(-1) for byte in range(4)]


def shift(crc: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The checksums `crc` moved past so many bytes, each by its own length-shift matrix."""
    at = (lengths & (SHIFTS - 1)) << 8
    out = _FLAT[0][at + (crc & _U(255))] ^ _FLAT[1][at + ((crc >> _U(8)) & _U(255))] ^ _FLAT[2][at + ((crc >> _U(16)) & _U(255))] ^ _FLAT[3][at + (crc >> _U(24))]
    more = np.flatnonzero(lengths >= SHIFTS)
    if len(more):
        blocks, x = lengths[more] // SHIFTS, out[more]
        for bit in range(int(blocks.max()).bit_length()):
            x = np.where((blocks >> bit) & 1, _times(_POWERS[bit], x), x)
        out[more] = x
    return out


def with_space(crc: np.ndarray) -> np.ndarray:
    """The checksums after one more byte, a space."""
    x = crc ^ _ONES
    return _BYTE[(x ^ _U(32)) & _U(255)] ^ (x >> _U(8)) ^ _ONES


def word_crcs(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The CRC32 of each word `raw[start:start + length]`; every byte of a word is read once."""
    order = np.argsort(-lengths, kind="stable")
    begin, size = starts[order], lengths[order]
    x = np.full(len(order), _ONES)
    short = int(np.searchsorted(-size, -COLUMNS))  # of falling sizes, those above COLUMNS come first
    for j in range(min(COLUMNS, int(size[short]) if short < len(size) else 0)):
        n = int(np.searchsorted(-size, -j))
        x[short:n] = _BYTE[(x[short:n] ^ raw[begin[short:n] + j]) & _U(255)] ^ (x[short:n] >> _U(8))
    x ^= _ONES
    for i in range(short):
        x[i] = zlib.crc32(raw[begin[i] : begin[i] + size[i]])
    out = np.empty_like(x)
    out[order] = x
    return out


def _words(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = np.concatenate(([False], _WORD[raw], [False]))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    return edge[0::2], edge[1::2] - edge[0::2]


def _cuts(text: bytes, limit: int) -> Iterator[tuple[int, int, int]]:
    """(begin, own end, end) of parts of a long text: cut between words, each with the next LONGEST - 1 words behind its own."""
    raw, begin = np.frombuffer(text, np.uint8), 0
    after = lambda at, wanted: next((at + i + int(hit[0]) for i in range(0, len(raw) - at, 4096) if len(hit := np.flatnonzero(_WORD[raw[at + i : at + i + 4096]] == wanted))), len(raw))
    while begin < len(raw):
        own = end = after(min(begin + limit, len(raw)), False)
        for _ in range(LONGEST - 1):
            end = after(after(end, True), False)
        yield begin, own, end
        begin = own


def _runs(texts: list[bytes], limit: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """(first row, raw bytes, where each text begins, bytes whose words count) of steps over lower-cased texts."""
    held: list[bytes] = []
    for row, text in enumerate(texts):
        if len(text) <= limit:
            held.append(text)
            continue
        if held:
            yield row - len(held), *_together(held)
            held = []
        for begin, own, end in _cuts(text, limit):
            yield row, np.frombuffer(text[begin:end], np.uint8), np.array([0, end - begin]), own - begin
    if held:
        yield len(texts) - len(held), *_together(held)


def _together(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, int]:
    joined = b" ".join(parts) + b" "
    return np.frombuffer(joined, np.uint8), np.cumsum([0, *(len(p) + 1 for p in parts)]), len(joined)


def buckets(texts: list[str | None], limit: int = BLOCK) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[np.ndarray]]]:
    """(first row, where each text's words begin, words left in the text from each one, buckets of the runs of 1, 2, 3 words at each).

    A run at a word is one of the text's features where as many words are left.
    """
    for first, raw, begins, own in _runs([(t or "").encode("utf-8", "replace").lower() for t in texts], limit):
        starts, lengths = _words(raw)
        at = np.searchsorted(starts, begins)
        left = np.repeat(at[1:], np.diff(at)) - np.arange(len(starts))
        crc = word_crcs(raw, starts, lengths)
        grams, run = [crc], crc
        for k in range(1, LONGEST):
            run = shift(with_space(run[:-1]), lengths[k:]) ^ crc[k:] if len(run) else run
            grams.append(np.concatenate((run, np.zeros(len(crc) - len(run), _U))))
        n = int(np.searchsorted(starts, own))
        yield first, np.minimum(at, n), left[:n], [(g[:n] % _U(BUCKETS)).astype(np.int64) for g in grams]


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        column = batch.column(0)
        for a, b in steps(column):
            for _, _, left, grams in buckets(column.slice(a, b - a).to_pylist()):
                for k, g in enumerate(grams):
                    total += np.bincount(g[left > k], minlength=BUCKETS)
    some = np.flatnonzero(total)
    yield pa.record_batch([pa.array(some.astype(np.int32)), pa.array(total[some])], ["bucket", "n"])


def bucket_counts(rows: DataFrame, text_col: str = "text") -> np.ndarray:
    """How many features of all texts fall in each bucket; a task sends at most BUCKETS rows, and so does the result."""
    counted = rows.select(text_col).mapInArrow(_count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(BUCKETS, np.int64)
    for r in counted.collect():
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the smoothed target share over the source share) of each bucket, in doubles."""
    s_all, t_all = int(source.sum()), int(target.sum())
    ratio = lambda s, t: float((t + 1) * (s_all + BUCKETS)) / float((s + 1) * (t_all + BUCKETS))
    return np.array([math.floor(1000 * math.log(ratio(s, t))) for s, t in zip(source.tolist(), target.tolist())], np.int64)


def noise(doc_id: object, seed: int) -> int:
    """floor of 1000 times a standard Gumbel draw from the hash of the id; a null id counts as the empty text."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _weigh(gain: np.ndarray, seed: int, names: list[str]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, column = batch.column(0), batch.column(1)
            n, words, weight = batch.num_rows, np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for a, b in steps(column):
                for first, at, left, grams in buckets(column.slice(a, b - a).to_pylist()):
                    value = np.zeros(len(left) + 1, np.int64)
                    for k, g in enumerate(grams):
                        value[1:] += np.where(left > k, gain[g], 0)
                    total, rows = np.cumsum(value), a + first + np.arange(len(at) - 1)
                    np.add.at(weight, rows, total[at[1:]] - total[at[:-1]])
                    np.add.at(words, rows, np.diff(at))
            features = sum(np.maximum(words - k, 0) for k in range(LONGEST))
            score = weight + np.array([noise(i, seed) for i in ids.to_pylist()], np.int64).reshape(n)
            yield pa.record_batch([ids, *map(pa.array, (words, features, weight, score))], names)

    return run


def weigh(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", seed: int = SEED) -> DataFrame:
    """(id_col, n_words, n_features, weight, score), all long, of every row of `docs`.

    Two scans of the texts, nothing of them shuffled: counts of BUCKETS buckets,
    then weights. Texts that are null or without a word have weight 0; a null id
    draws its noise as the empty text, and rows that repeat an id draw the same.
    Without targets, or without source texts, counts are 0 and smoothing decides.
    Long texts are read in blocks of BLOCK bytes; other columns take no part.
    """
    gain = gains(bucket_counts(docs, text_col), bucket_counts(target, target_col))
    names = [id_col, "n_words", "n_features", "weight", "score"]
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(_weigh(gain, seed, names), f"`{id_col}` {kind}, n_words long, n_features long, weight long, score long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", seed: int = SEED) -> DataFrame:
    """`weigh` with `rank`: 1, 2, 3 ... of the documents drawn by falling score, null for others.

    Of the N documents with at least `least_words` words, floor(percent N / 100)
    are drawn; ties go to the smaller id, null ids last, and repeated rows
    get ranks of their own. Ranks come from range partitions and their counts, so no
    task holds all documents. An empty table gives an empty result.
    """
    fits, place = private(docs.select(id_col), "fits", "place")
    rows = weigh(docs, target, id_col, text_col, target_col, seed).withColumn(fits, F.col("n_words") >= least_words)
    order = [F.desc(fits), F.desc("score"), F.asc_nulls_last(f"`{id_col}`")]
    placed = materialise(global_rank(rows, order, out=place), "placed")
    drawn = percent * placed.where(fits).count() // 100
    return placed.withColumn("rank", F.when(F.col(fits) & (F.col(place) <= drawn), F.col(place))).drop(fits, place)
