"""Bloom filters built by tasks and merged by segments: a key's bits lie in one 64-bit word.

A filter is an array of words. `once` has the keys seen at all and `twice` those
seen more than once; both are unions over tasks, where a key that two tasks saw
once each is in the meet of their `once`. So no repeat is ever missed, and
what is in `twice` for other reasons is left to an exact check.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.runtime import discard, materialise

_U = np.uint64
BITS_PER_KEY = 12
#: 64 MB: what a task holds of each filter, and what is broadcast. With more keys than that the filters let more through.
MOST_WORDS = 1 << 23
SEGMENT = 1 << 14
FAN_IN = 64
_SCHEMA = "segment int, source int, once binary, twice binary"


def words_for(keys: int) -> int:
    """The words of a filter for so many keys: a power of two, bounded."""
    return min(MOST_WORDS, max(SEGMENT, 1 << max(0, (keys * BITS_PER_KEY // 64)).bit_length()))


def _place(keys: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    mask = np.zeros(len(keys), np.uint64)
    for i in range(4):
        mask |= _U(1) << ((keys >> _U(6 * i)) & _U(63))
    return ((keys >> _U(24)) % _U(words)).astype(np.int64), mask


def holds(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which 64-bit keys may be in a filter; never false for one that is."""
    at, mask = _place(keys, len(bits))
    return (bits[at] & mask) == mask


def add(once: np.ndarray, twice: np.ndarray, keys: np.ndarray) -> None:
    """Add keys, of which repeats count as seen again."""
    values, counts = np.unique(keys, return_counts=True)
    at, mask = _place(values, len(once))
    again = ((once[at] & mask) == mask) | (counts > 1)
    np.bitwise_or.at(twice, at[again], mask[again])
    np.bitwise_or.at(once, at, mask)


def _rows(source: int, once: np.ndarray, twice: np.ndarray) -> Iterator[pa.RecordBatch]:
    for s in range(0, len(once), SEGMENT):
        part, again = once[s : s + SEGMENT], twice[s : s + SEGMENT]
        if part.any():
            packed = [[zlib.compress(x.tobytes(), 1)] for x in (part, again)]
            kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary())
            yield pa.record_batch([pa.array(v, k) for v, k in zip(([s // SEGMENT], [source], *packed), kinds)], ["segment", "source", "once", "twice"])


def _builder(keys_of: Callable[[pa.RecordBatch], Iterator[np.ndarray]], words: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        once, twice = np.zeros(words, np.uint64), np.zeros(words, np.uint64)
        for batch in batches:
            for keys in keys_of(batch):
                add(once, twice, keys)
        yield from _rows(TaskContext.get().partitionId(), once, twice)

    return run


def _unpack(packed: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(packed), np.uint64).copy()


def _merger(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (segment, source) to one row of each: a segment of each filter is held at a time."""
    key = once = twice = None

    def done() -> pa.RecordBatch:
        values = ([key[0]], [key[1]], [zlib.compress(once.tobytes(), 1)], [zlib.compress(twice.tobytes(), 1)])
        return pa.record_batch([pa.array(v, k) for v, k in zip(values, (pa.int32(), pa.int32(), pa.binary(), pa.binary()))], ["segment", "source", "once", "twice"])

    for batch in batches:
        for i in range(batch.num_rows):
            own = (batch.column(0)[i].as_py(), batch.column(1)[i].as_py())
            a, b = _unpack(batch.column(2)[i].as_py()), _unpack(batch.column(3)[i].as_py())
            if own != key:
                if key is not None:
                    yield done()
                key, once, twice = own, a, b
            else:
                twice |= b | (once & a)
                once |= a
    if key is not None:
        yield done()


def build(rows: DataFrame, keys_of: Callable[[pa.RecordBatch], Iterator[np.ndarray]], words: int, repeats: bool = True) -> np.ndarray:
    """The filter of all keys that the tasks find in `rows`; with `repeats`, of those found more than once.

    Each task sends the segments of its filters that have a bit, packed; segments
    are merged by at most FAN_IN sources a task, in rounds, so that no merge grows with
    the number of tasks. The result, at most MOST_WORDS words, is read by the driver.
    """
    parts = materialise(rows.mapInArrow(_builder(keys_of, words), _SCHEMA), "filters")
    sources = (parts.agg(F.max("source")).first()[0] or 0) + 1
    while sources > 1:
        sources = -(-sources // FAN_IN)
        dealt = parts.withColumn("source", F.pmod("source", F.lit(sources))).repartition("segment", "source").sortWithinPartitions("segment", "source")
        merged = materialise(dealt.mapInArrow(_merger, _SCHEMA), "filters")
        discard(parts)
        parts = merged
    out = np.zeros(words, np.uint64)
    for r in parts.select("segment", F.col("twice" if repeats else "once").alias("bits")).toLocalIterator():
        out[r.segment * SEGMENT : (r.segment + 1) * SEGMENT] = _unpack(bytes(r.bits))
    discard(parts)
    return out
