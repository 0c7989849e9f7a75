"""Line dedup by two Bloom filters: of lines seen once and seen twice; only suspected repeats are shuffled.

A line's key is the line without blanks at its ends and with A-Z lower-cased. A
first scan fills both filters; a second sends a digest of each key that the
filter of repeats holds, counted exactly; a third drops lines in every document,
or in all but the first that has them.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm import _bloom
from gleaner.llm._arrow import steps
from gleaner.runtime import discard, materialise, private, with_row_ids

BLANK = b" \t\n\x0b\x0c\r"
#: Digests of repeated lines that are sent to every task; more are joined by shuffles.
MOST_SENT = 500_000
#: Batches whose digests are counted together before they are sent.
COUNTED = 200_000


def key_of(line: bytes) -> bytes:
    return line.strip(BLANK).lower()


def _keys(text: bytes, least: int) -> dict[bytes, int]:
    """The distinct keys of a text's lines of at least `least` code points, and each one's first line."""
    out: dict[bytes, int] = {}
    for i, line in enumerate(text.split(b"\n")):
        key = key_of(line)
        if len(key) >= least and (least <= 1 or len(key.decode("utf-8")) >= least):
            out.setdefault(key, i)
    return out


def digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def _hashes(keys: Iterable[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64)


def _texts(column: pa.Array) -> Iterator[bytes]:
    for value in column.cast(pa.binary()):
        yield value.as_py() or b""


def _hashed(least: int):
    def keys_of(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        column = batch.column(0)
        for a, b in steps(column):
            yield _hashes(k for t in _texts(column.slice(a, b - a)) for k in _keys(t, least))

    return keys_of


def _suspects(repeats, least: int, first: bool):
    """(key, n, first) for each key that may repeat: how many documents of the task's run of rows have it, and their smallest id."""
    names = ["key", "n", "first"]

    def out(counts: Counter, firsts: dict) -> pa.RecordBatch:
        keys = list(counts)
        ids = pa.array([firsts.get(k) for k in keys], pa.int64())
        return pa.record_batch([pa.array(keys, pa.binary()), pa.array([counts[k] for k in keys], pa.int64()), ids], names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, counts, firsts = repeats.value, Counter(), {}
        for batch in batches:
            ids = batch.column(1).to_pylist() if first else None
            for row, text in enumerate(_texts(batch.column(0))):
                keys = list(_keys(text, least))
                for i in np.flatnonzero(_bloom.holds(bits, _hashes(keys))).tolist():
                    d = digest(keys[i])
                    counts[d] += 1
                    if first:
                        firsts[d] = min(firsts.get(d, ids[row]), ids[row])
                if len(counts) >= COUNTED:
                    yield out(counts, firsts)
                    counts, firsts = Counter(), {}
        if counts:
            yield out(counts, firsts)

    return run


def _strip(text: bytes, least: int, gone, uid: int | None) -> tuple[int, int, bytes]:
    """(lines, lines dropped, what stays): `gone` maps a digest to the id of the document that keeps the line's first place."""
    lines, kept, seen = text.split(b"\n"), [], set()
    for line in lines:
        key = key_of(line)
        drop = False
        if key and (len(key) >= least and (least <= 1 or len(key.decode("utf-8")) >= least)) and (d := digest(key)) in gone:
            drop = gone[d] is None or gone[d] != uid or d in seen
            seen.add(d)
        if not drop:
            kept.append(line)
    return len(lines), len(lines) - len(kept), b"\n".join(kept)


def _dropper(repeats, sent, least: int, names: list[str]):
    """Rows (text, uid, own?, ...) to (..., text, n_lines, n_dropped); `own` are the keys of the row where they are not sent to all."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, everywhere = repeats.value, None if sent is None else sent.value
        for batch in batches:
            uids = batch.column(1).to_pylist()
            own = batch.column(2).to_pylist() if sent is None else None
            texts, n_lines, n_dropped = [], [], []
            for row, text in enumerate(_texts(batch.column(0))):
                gone = everywhere if sent is not None else {x["key"]: x["first"] for x in own[row] or ()}
                if gone and (sent is None or bool(_bloom.holds(bits, _hashes(_keys(text, least))).any())):
                    n, k, text = _strip(text, least, gone, uids[row])
                else:
                    n, k = text.count(b"\n") + 1, 0
                n_lines.append(n)
                n_dropped.append(k)
                texts.append(text)
            rest = batch.columns[2 if sent is not None else 3 :]
            made = [pa.array(texts, pa.binary()).cast(pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())]
            yield pa.record_batch([*rest, *made], names)

    return run


def _flat(batches: Iterable[pa.RecordBatch], repeats, least: int) -> Iterator[pa.RecordBatch]:
    """(uid, key) of each row's distinct keys that may repeat."""
    for batch in batches:
        uids = batch.column(1).to_pylist()
        for row, text in enumerate(_texts(batch.column(0))):
            keys = list(_keys(text, least))
            found = [digest(keys[i]) for i in np.flatnonzero(_bloom.holds(repeats.value, _hashes(keys))).tolist()]
            yield pa.record_batch([pa.array([uids[row]] * len(found), pa.int64()), pa.array(found, pa.binary())], ["uid", "key"])


def drop_repeated_lines(
    docs: DataFrame, least_docs: int = 10, least_length: int = 1, keep_first: bool = False, id_col: str = "doc_id", text_col: str = "text", most_sent: int = MOST_SENT,
) -> DataFrame:
    """`docs` with the lines dropped whose key at least `least_docs` rows have, and with `n_lines` and `n_dropped` (long).

    A null or empty text is one empty line, and comes back empty. Keys below
    `least_length` code points (at least 1) never go. Each row counts as a document,
    repeated rows and null ids too, and a key counts once in it. With
    `keep_first` the first place of a line stays: in the row of the smallest
    id, or the first row of the table where ids are null, repeated or no integers. Columns
    named `n_lines` or `n_dropped` are replaced; others pass through. Keys are told
    apart by digests of 128 bits. A text is handled whole, in memory of a few times its size.

    At most `most_sent` digests of repeated lines are sent to every task;
    where there are more, they are joined to the suspected lines of each row and then to the rows.
    """
    if least_length < 1 or least_docs < 1:
        raise ValueError("least_length and least_docs are at least 1")
    spark = docs.sparkSession
    others = [c for c in docs.columns if c.lower() not in (text_col.lower(), "n_lines", "n_dropped")]
    uid, own = private(docs, "uid", "own")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias(text_col)
    lines = docs.agg(F.sum(F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"))) + 1)).first()[0] or 0
    bits = _bloom.build(docs.select(text), _hashed(least_length), _bloom.words_for(lines), repeats=least_docs > 1)
    repeats = spark.sparkContext.broadcast(bits)
    ided = with_row_ids(docs, id_col, uid) if keep_first else docs.withColumn(uid, F.lit(None).cast("long"))
    suspects = ided.select(text, uid).mapInArrow(_suspects(repeats, least_length, keep_first), "key binary, n long, first long")
    counted = suspects.groupBy("key").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    gone = materialise(counted.where(F.col("n") >= least_docs).select("key", "first"), "repeated")
    names = [*others, text_col, "n_lines", "n_dropped"]
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in others), f"`{text_col}` string", "n_lines long", "n_dropped long"])
    rest = [F.col(f"`{c}`") for c in others]
    if gone.count() <= most_sent:
        sent = spark.sparkContext.broadcast({bytes(r.key): r.first for r in gone.collect()})
        discard(gone)
        return ided.select(text, uid, *rest).mapInArrow(_dropper(repeats, sent, least_length, names), schema).select(*(f"`{c}`" for c in _order(docs, names)))
    ided = ided if keep_first else with_row_ids(docs, id_col, uid)
    flat = ided.select(text, uid).mapInArrow(lambda b: _flat(b, repeats, least_length), "uid long, key binary")
    # Without keep_first every place goes, so `first` is null.
    lists = flat.join(gone, "key").groupBy("uid").agg(F.collect_list(F.struct("key", "first")).alias(own)).withColumnRenamed("uid", f"{uid}_")
    joined = ided.join(lists, F.col(uid) == F.col(f"{uid}_"), "left")
    return joined.select(text, uid, own, *rest).mapInArrow(_dropper(repeats, None, least_length, names), schema).select(*(f"`{c}`" for c in _order(docs, names)))


def _order(docs: DataFrame, names: list[str]) -> list[str]:
    """The columns as `docs` has them, then the new ones."""
    return [c for c in docs.columns if c in names and c not in ("n_lines", "n_dropped")] + ["n_lines", "n_dropped"]
