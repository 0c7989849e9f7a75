"""Phrase collocation mining over dictionary-encoded words.

Texts are encoded in blocks, each with a vocabulary of its own, so no task
needs the words of the whole corpus. Block vocabularies meet the dictionary of
frequent words in a join, and blocks get ids in which every other word is a
break. Runs of ids are packed into keys of 16 bytes, big-endian, sorted by radix
and counted by run lengths in the block, then dealt by key range, sorted, and counted
by run lengths again. Pairs come first: longer runs are counted only where a
Bloom filter may hold all their pairs, which loses no frequent one.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm import _bloom
from gleaner.llm._shingles import mix
from gleaner.operators.ranking import global_rank
from gleaner.runtime import checked_join, discard, materialise

LONGEST = 4
LEAST = 30
COVERED = 80
MOST = 2000
SCALE = 2_000_000
#: Words of a block, and bytes of one text that are split at a time.
BLOCK_WORDS = 1 << 20
SLICE = 1 << 20
WIDTH = 4 * LONGEST
_BREAKS = b".,;:!?\n\x0b\x0c\r"
_TO_BREAK = bytes(ord(".") if b in _BREAKS else b for b in range(256))
_BETWEEN = re.compile(rb"[ \t.,;:!?\n\x0b\x0c\r]")
_BLOCK = "block long, lang string, carry int, vocab array<string>, counts array<long>, codes binary"


def _pack(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(values.tobytes())


def _unpack(packed: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), kind)


class _Block:
    """Codes of the words of one language: 0 is a break, and others are places in the block's vocabulary.

    A text that goes on in another block leaves there its last words, whose runs are counted here.
    """

    def __init__(self, tail: list[bytes]):
        self.vocab: defaultdict[bytes, int] = defaultdict()
        self.vocab.default_factory = self.vocab.__len__
        self.vocab[b"."]
        self.parts, self.size, self.carry, self.tail = [], 0, len(tail), []
        self.add(tail)

    def add(self, tokens: list[bytes]) -> None:
        self.parts.append(np.fromiter(map(self.vocab.__getitem__, tokens), np.int32, len(tokens)))
        self.size += len(tokens)
        self.tail = (self.tail + tokens[1 - LONGEST :])[1 - LONGEST :]

    def end(self) -> None:
        self.add([b"."])
        self.tail = []

    def row(self, block: int, lang: str) -> pa.RecordBatch:
        codes = np.concatenate(self.parts)
        counts = np.bincount(codes[self.carry :], minlength=len(self.vocab))[1:]
        vocab = pa.array(list(self.vocab)[1:], pa.binary()).cast(pa.string())
        lists = [pa.ListArray.from_arrays(pa.array([0, len(vocab)], pa.int32()), v) for v in (vocab, pa.array(counts.astype(np.int64)))]
        scalars = [pa.array([block], pa.int64()), pa.array([lang], pa.string()), pa.array([self.carry], pa.int32())]
        return pa.record_batch([*scalars, *lists, pa.array([_pack(codes)], pa.binary())], ["block", "lang", "carry", "vocab", "counts", "codes"])


def _slices(text: bytes) -> Iterator[bytes]:
    """A text in parts that begin at a break or blank, so that no word is cut."""
    begin = 0
    while begin < len(text):
        hit = _BETWEEN.search(text, begin + SLICE)
        end = hit.start() if hit else len(text)
        yield text[begin:end]
        begin = end


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    made, held = TaskContext.get().partitionId() << 32, {}
    total = 0
    for batch in batches:
        langs, column = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())
        for lang, value in zip(langs, column):
            block = held.setdefault(lang, None) or _Block([])
            held[lang] = block
            for part in _slices(value.as_py().lower()):
                tokens = part.translate(_TO_BREAK).replace(b".", b" . ").split()
                if block.size >= BLOCK_WORDS:
                    yield block.row(made, lang)
                    total -= block.size
                    made, block = made + 1, _Block(block.tail if b"." not in block.tail else block.tail[len(block.tail) - block.tail[::-1].index(b".") :])
                    held[lang], total = block, total + block.size
                block.add(tokens)
                total += len(tokens)
            block.end()
            total += 1
            if total >= 2 * BLOCK_WORDS:
                for name, one in held.items():
                    yield one.row(made, name)
                    made += 1
                held, total = {}, 0
    for name, one in held.items():
        yield one.row(made, name)
        made += 1


def _translate(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(carry, codes, places, ids) to (carry, ids): the ids of a block's words in order, 0 for breaks and words not frequent."""
    for batch in batches:
        carry, codes, places, ids = batch.columns
        for i in range(batch.num_rows):
            own, at, to = (_unpack(codes[i].as_py(), "<i4"), *(c[i].values.to_numpy(zero_copy_only=False) for c in (places, ids)))
            table = np.zeros(int(max(own.max(initial=0), at.max(initial=0))) + 1, np.uint32)
            table[at] = to
            yield pa.record_batch([carry.slice(i, 1), pa.array([_pack(table[own])], pa.binary())], ["carry", "ids"])


def radix_order(columns: list[np.ndarray]) -> np.ndarray:
    """The order of rows of 32-bit ids by all columns: a stable radix sort by 16 bits at a time, lowest first."""
    order = np.arange(len(columns[0]))
    for column in reversed(columns):
        for low in (0, 16):
            digit = ((column >> np.uint32(low)) & np.uint32(0xFFFF)).astype(np.uint16)
            if len(digit) and digit.min() != digit.max():
                order = order[np.argsort(digit[order], kind="stable")]
    return order


def _keys(columns: list[np.ndarray]) -> pa.RecordBatch:
    """(key, n) of the distinct rows of `columns`, in order: ids big-endian, padded with zeros to WIDTH bytes."""
    order = radix_order(columns)
    table = np.zeros((len(order), LONGEST), ">u4")
    for j, c in enumerate(columns):
        table[:, j] = c[order]
    first = np.ones(len(table), bool)
    first[1:] = (table[1:] != table[:-1]).any(axis=1)
    starts = np.flatnonzero(first)
    keys = pa.FixedSizeBinaryArray.from_buffers(pa.binary(WIDTH), len(starts), [None, pa.py_buffer(table[starts].tobytes())])
    return pa.record_batch([keys.cast(pa.binary()), pa.array(np.diff(np.append(starts, len(table))))], ["key", "n"])


def _pairs(ids: np.ndarray) -> np.ndarray:
    return mix((ids[:-1].astype(np.uint64) << np.uint64(32)) | ids[1:].astype(np.uint64))


def _runs(pairs):
    """Keys of the pairs of each block; or, with a filter of frequent pairs, of its runs of three and four."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                carry, ids = batch.column(0)[i].as_py(), _unpack(batch.column(1)[i].as_py(), "<u4")
                ok = (ids[1:] != 0) & (ids[:-1] != 0)
                if pairs is not None and len(ok):
                    ok = ok & _bloom.holds(pairs.value, _pairs(ids))
                for size in (2,) if pairs is None else range(3, LONGEST + 1):
                    n = len(ids) - size + 1
                    if n <= 0:
                        continue
                    whole = np.logical_and.reduce([ok[j : j + n] for j in range(size - 1)])
                    whole[: max(carry - size + 1, 0)] = False
                    at = np.flatnonzero(whole)
                    if len(at):
                        yield _keys([ids[at + j] for j in range(size)])

    return run


def _table(column: pa.Array) -> np.ndarray:
    column = column.cast(pa.binary())
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].reshape(-1, WIDTH)


def _run_lengths(least: int):
    """(key, a) of the keys that occur at least `least` times, from rows in key order."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            table = np.ascontiguousarray(_table(batch.column(0))).view(">u8")
            starts = np.flatnonzero(np.concatenate(([True], (table[1:] != table[:-1]).any(axis=1))))
            totals = np.add.reduceat(batch.column(1).to_numpy(zero_copy_only=False), starts)
            keys = [table[i].tobytes() for i in (starts[0], starts[-1])]
            if keys[0] == last:
                totals[0] += seen
            elif last is not None and seen >= least:
                yield pa.record_batch([pa.array([last], pa.binary()), pa.array([seen], pa.int64())], ["key", "a"])
            # The last run of a batch may go on in the next.
            last, seen = keys[1], int(totals[-1])
            some = np.flatnonzero(totals[:-1] >= least)
            if len(some):
                found = pa.FixedSizeBinaryArray.from_buffers(pa.binary(WIDTH), len(some), [None, pa.py_buffer(table[starts[some]].tobytes())])
                yield pa.record_batch([found.cast(pa.binary()), pa.array(totals[some])], ["key", "a"])
        if last is not None and seen >= least:
            yield pa.record_batch([pa.array([last], pa.binary()), pa.array([seen], pa.int64())], ["key", "a"])

    return run


def _counted(encoded: DataFrame, pairs, least: int, name: str) -> DataFrame:
    keys = encoded.mapInArrow(_runs(pairs), "key binary, n long")
    dealt = keys.repartitionByRange("key").sortWithinPartitions("key")
    return materialise(dealt.mapInArrow(_run_lengths(least), "key binary, a long"), name)


def _pair_hashes(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    if batch.num_rows:
        yield mix(np.ascontiguousarray(_table(batch.column(0))[:, :8]).view(">u8").ravel().astype(np.uint64))


def encode(docs: DataFrame, least: int, lang_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(carry, ids) of the blocks; the dictionary (id, lang, word, f) of words that occur `least` times; (lang, n) of all words."""
    rows = docs.where(F.col(text_col) != "").select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")), F.col(text_col))
    blocks = materialise(rows.mapInArrow(_blocks, _BLOCK), "blocks")
    totals = materialise(blocks.groupBy("lang").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda s, x: s + x)).alias("n")), "totals")
    words = blocks.select("block", "lang", F.posexplode(F.arrays_zip("vocab", "counts")).alias("place", "x")).select("block", "lang", (F.col("place") + 1).alias("place"), "x.vocab", "x.counts")
    frequent = words.groupBy("lang", F.col("vocab").alias("word")).agg(F.sum("counts").alias("f")).where(F.col("f") >= least)
    dictionary = materialise(global_rank(frequent, [F.asc("lang"), F.asc("word")], out="id"), "dictionary")
    if dictionary.count() >= 1 << 32:
        raise ValueError("more frequent words than ids of 32 bits")
    known = dictionary.select(F.col("lang").alias("_lang"), F.col("word").alias("_word"), "id")
    met = checked_join(words, known, (F.col("lang") == F.col("_lang")) & (F.col("vocab") == F.col("_word")))
    lists = met.groupBy("block").agg(F.collect_list(F.struct("place", "id")).alias("to"))
    joined = blocks.select("block", "carry", "codes").join(lists, "block").select("carry", "codes", F.col("to.place").alias("place"), F.col("to.id").alias("id"))
    encoded = materialise(joined.mapInArrow(_translate, "carry int, ids binary"), "encoded")
    discard(blocks)
    return encoded, dictionary, totals


def _part(begin: str, size: str) -> str:
    """The key of a part of a key."""
    return f"rpad(substring(key, 4 * ({begin}) + 1, 4 * ({size})), {WIDTH}, X'00')"


def scored(phrases: DataFrame, dictionary: DataFrame) -> DataFrame:
    """`phrases` (key, size, a) with their language and the lowest-scoring cut: l, r, score (floored; ties to the shortest first part)."""
    own = dictionary.select(F.expr(f"rpad(unhex(lpad(hex(id), 8, '0')), {WIDTH}, X'00')").alias("part"), F.col("f"), "lang")
    counts = materialise(own.unionByName(phrases.select(F.col("key").alias("part"), F.col("a").alias("f"), F.lit(None).cast("string").alias("lang"))), "counts")
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.select("key", "a", "k", F.expr(_part("0", "k")).alias("head"), F.expr(_part("k", "size - k")).alias("rest"))
    head = counts.select(F.col("part").alias("head"), F.col("f").alias("l"), "lang")
    rest = counts.select(F.col("part").alias("rest"), F.col("f").alias("r"))
    both = cuts.join(head, "head").join(rest, "rest")
    # Exact: the product may pass 64 bits.
    score = F.expr(f"cast(cast(a as decimal(20,0)) * cast({SCALE} as decimal(7,0)) div cast(l + r as decimal(20,0)) as bigint)")
    best = both.groupBy("key", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("x"), F.max("lang").alias("lang"))
    return best.select("key", "a", "lang", "x.l", "x.r", "x.score")


def not_covered(phrases: DataFrame, rows: DataFrame, covered: int) -> DataFrame:
    """`rows` whose words stand in no longer phrase that has `covered` percent of their occurrences."""
    inside = [(size, begin, n) for size in range(3, LONGEST + 1) for n in range(2, size) for begin in range(size - n + 1)]
    parts = F.array(*(F.when(F.col("size") == size, F.expr(_part(str(begin), str(n)))) for size, begin, n in inside))
    longer = phrases.where("size > 2").select(F.explode(parts).alias("part"), F.col("a").alias("longer")).where("part IS NOT NULL")
    most = longer.groupBy("part").agg(F.max("longer").alias("longer"))
    found = rows.join(most, F.col("key") == F.col("part"), "left")
    return found.where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * covered)).drop("part", "longer")


def spelled(rows: DataFrame, dictionary: DataFrame) -> DataFrame:
    """`rows` with `phrase`, the words of their keys joined by spaces."""
    id_at = lambda j: F.conv(F.hex(F.substring("key", 4 * j + 1, 4)), 16, 10).cast("long")
    places = rows.select("key", F.posexplode(F.array(*map(id_at, range(LONGEST)))).alias("place", "id")).where("id > 0")
    words = places.join(dictionary.select("id", "word"), "id").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("place", "word"))).alias("w"))
    return rows.join(words.select("key", F.array_join("w.word", " ").alias("phrase")), "key")


def collocations(docs: DataFrame, least: int = LEAST, covered: int = COVERED, most: int | None = MOST, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best phrases of 2 to 4 words of each language; all of them with `most` None.

    Texts are lower-cased in A-Z only, split into pieces at `.,;:!?`, line feed to
    carriage return, and pieces into words at spaces and tabs. A null language is
    `und`; null and empty texts hold nothing; rows that repeat count each. A phrase
    occurs `a` >= `least` times in its language, its parts `l` and `r` times at the cut that
    scores lowest, floor(2000000 a / (l + r)), and it stands in no longer one with
    `covered` percent of its occurrences. Ranks fall by score and a and rise by phrase
    in bytes. Long texts are read in slices and go on from block to block.
    Other columns take no part; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    encoded, dictionary, totals = encode(docs, least, lang_col, text_col)
    pairs = _counted(encoded, None, least, "pairs")
    bits = _bloom.build(pairs.select("key"), _pair_hashes, _bloom.words_for(pairs.count()), repeats=False)
    longer = _counted(encoded, spark.sparkContext.broadcast(bits), least, "longer")
    discard(encoded)
    size = F.when(F.substring("key", 9, 4) == F.lit(bytes(4)), 2).when(F.substring("key", 13, 4) == F.lit(bytes(4)), 3).otherwise(4)
    phrases = materialise(pairs.unionByName(longer).withColumn("size", size), "phrases")
    discard(pairs, longer)
    kept = materialise(not_covered(phrases, scored(phrases, dictionary), covered), "kept")
    ranks = global_rank(spelled(kept, dictionary), [F.desc("score"), F.desc("a"), F.asc("phrase")], by=("lang",))
    best = ranks.where(F.col("rank") <= most) if most is not None else ranks
    named = totals.withColumnRenamed("lang", "_lang")
    return checked_join(best, named, F.col("lang") == F.col("_lang")).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
