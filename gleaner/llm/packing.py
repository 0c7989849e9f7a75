"""Operator 4: hierarchical multi-length packing of tokenised documents.

Documents are cut into full windows of the longest context; what is left of
each is routed to the tier (2048, 1024, 512, 256) whose upper half holds its
length. Tiers are packed from the longest down: a piece opens a window of its
tier, the gap is filled with the longest pieces of shorter tiers that fit, and
the last gap by cutting one. Windows are full powers of two, so nothing is
padded. The few tokens of a block that fill no window go into the next block;
a partition's last ones go into ever smaller powers of two. Sequences of all
tiers are dealt to step groups of equal tokens, each to the lightest so far.

Packing works on blocks of consecutive documents within an input partition, as
they stream by. Nothing is shuffled, a task holds one block, and a lost task
is made again from its own split alone.
"""

from __future__ import annotations

import heapq
import re
from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "byte_bpe_50k"
TIERS = (2048, 1024, 512, 256)
#: Tokens after which a block of documents is packed.
BLOCK_TOKENS = 1 << 21
#: Tokens of a step group.
STEP_TOKENS = 1 << 16
END_ID = 1

Piece = tuple[int, int, int]
#: A run of white space that the split pattern need not walk through: all of it but its last character is one word.
_LONG_BLANK = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{1000,}")

_tokenizers: dict[str, object] = {}


def tokenizer(vocabulary: str = VOCABULARY):
    """A function from text to uint32 ids of a public byte-level vocabulary.

    Ids are those of the `tokenizers` library on `<vocabulary>.json` without
    added special tokens at the ends. The merges run in `tiktoken` from
    `<vocabulary>.tiktoken`, which holds the same ids and is several times as
    fast. What the library does before it splits is done here for every text:
    the vocabulary's added tokens are matched first, wherever they stand, and a
    long run of white space is a word by itself, without its last character if
    a word follows.
    """
    if vocabulary not in _tokenizers:
        import base64
        import json

        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        with open(public_tokenizers.path(f"{vocabulary}.json"), encoding="utf-8") as file:
            tokens = json.load(file)["added_tokens"]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in tokens):
            raise ValueError(f"{vocabulary}: an added token is not matched literally")
        added = {t["content"]: t["id"] for t in tokens}
        special = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None

        def plain(text: str) -> list[int]:
            out, at = [], 0
            for m in _LONG_BLANK.finditer(text):
                end = m.end() - (m.end() < len(text))
                out += fast.encode_ordinary(text[at : m.start()])
                out += fast._encode_single_piece(text[m.start() : end])
                at = end
            return out + fast.encode_ordinary(text[at:]) if at else fast.encode_ordinary(text)

        def encode(text: str) -> np.ndarray:
            out, at = [], 0
            for m in special.finditer(text) if special else ():
                out += plain(text[at : m.start()])
                out.append(added[m[0]])
                at = m.end()
            return np.array(out + plain(text[at:]) if at else plain(text), np.uint32)

        _tokenizers[vocabulary] = encode
    return _tokenizers[vocabulary]


class _Pool:
    """Pieces by length; the longest of at most some length is found by the bits of one integer."""

    def __init__(self) -> None:
        self.of: dict[int, deque[tuple[int, int]]] = {}
        self.bits = 0

    def put(self, length: int, doc: int, start: int) -> None:
        self.of.setdefault(length, deque()).append((doc, start))
        self.bits |= 1 << length

    def longest(self, most: int) -> int:
        """The greatest length of a piece that is no longer than `most`; 0 if there is none."""
        return max(0, (self.bits & ((1 << (most + 1)) - 1)).bit_length() - 1)

    def shortest(self) -> int:
        return (self.bits & -self.bits).bit_length() - 1 if self.bits else 0

    def take(self, length: int) -> Piece:
        """The piece of this length that came first, as (document, start, length)."""
        own = self.of[length]
        doc, start = own.popleft()
        if not own:
            self.bits ^= 1 << length
        return doc, start, length


def pack_lengths(
    lengths: list[int], tiers: tuple[int, ...] = TIERS
) -> tuple[list[tuple[int, list[Piece]]], list[Piece]]:
    """Sequences (context size, pieces) of documents of these lengths, and the pieces that fill no window.

    A piece is (document, start, length). Each token is in one piece, and each
    sequence is filled to its tier's size.
    """
    longest = tiers[0]
    out: list[tuple[int, list[Piece]]] = []
    pool = _Pool()
    for doc, n in enumerate(lengths):
        whole = n - n % longest
        out += [(longest, [(doc, at, longest)]) for at in range(0, whole, longest)]
        if n > whole:
            pool.put(n - whole, doc, whole)
    for tier, below in zip(tiers, (*tiers[1:], 0)):
        while (n := pool.longest(tier)) > below:
            pieces = [pool.take(n)]
            gap = tier - n
            while gap and pool.bits:
                # Pieces of shorter tiers go first; the shortest tier fills itself.
                n = pool.longest(min(gap, below or gap))
                if n:
                    pieces.append(pool.take(n))
                    gap -= n
                    continue
                short = pool.shortest()
                doc, start, n = pool.take(short if short <= (below or tier) else pool.longest(tier))
                pieces.append((doc, start, gap))
                pool.put(n - gap, doc, start + gap)
                gap = 0
            if gap:
                return out, pieces
            out.append((tier, pieces))
    return out, []


def powers(pieces: list[Piece]) -> list[tuple[int, list[Piece]]]:
    """Pieces as sequences of decreasing powers of two."""
    out, left = [], sum(n for _, _, n in pieces)
    pieces = pieces[::-1]
    while left:
        size = 1 << (left.bit_length() - 1)
        left -= size
        own, room = [], size
        while room:
            d, s, n = pieces.pop()
            take = min(n, room)
            own.append((d, s, take))
            room -= take
            if n > take:
                pieces.append((d, s + take, n - take))
        out.append((size, own))
    return out


def step_groups(sequences: list[tuple[int, list[Piece]]], tokens: int = STEP_TOKENS) -> list[int]:
    """A step group for each sequence: as few as hold `tokens` each, of equal tokens and then equal attention cost.

    Sequences go by falling size and cost to the group that has the fewest
    tokens so far, so loads differ by no more than the longest sequence.
    """
    out = [0] * len(sequences)
    cost = [sum(n * n for _, _, n in pieces) for _, pieces in sequences]
    n = -(-sum(size for size, _ in sequences) // tokens)
    load = [(0, 0, g) for g in range(n)]
    for i in sorted(range(len(sequences)), key=lambda i: (-sequences[i][0], -cost[i], i)):
        size, spent, g = load[0]
        out[i] = g
        heapq.heapreplace(load, (size + sequences[i][0], spent + cost[i], g))
    return out


_COLUMNS = "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, context_size int, step_group long"


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY,
    tiers: tuple[int, ...] = TIERS, end_id: int = END_ID,
) -> DataFrame:
    """Pieces of packed sequences: (id_col, start, length, ids, doc_tokens, sequence_id, offset, context_size, step_group).

    `ids` are little-endian uint32. Each document's ids are followed by
    `end_id`. Defined cases: a null or empty text is that one id; a null id is
    kept; a repeated row is packed again; a text of any length is tokenised
    whole and in time proportional to it, and its task holds it and its ids; an
    empty table gives no rows; other columns are not looked at.
    """
    source = docs.select(F.col(id_col), F.col(text_col).alias("text"))
    names = [id_col, "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "context_size", "step_group"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(vocabulary)
        base = group = TaskContext.get().partitionId() << 40
        # Documents that wait: their ids, those ids' place in the whole document, and its number of ids.
        keys: list = []
        held: list[np.ndarray] = []
        first: list[int] = []
        total: list[int] = []
        size = 0

        def packed(last: bool) -> pa.RecordBatch | None:
            nonlocal base, group, keys, held, first, total, size
            sequences, rest = pack_lengths([len(t) for t in held], tiers)
            if last:
                sequences, rest = sequences + powers(rest), []
            steps = step_groups(sequences)
            doc, start, length, raw, seq, offset, context, step = [], [], [], [], [], [], [], []
            for i, (n, pieces) in enumerate(sequences):
                at = 0
                for d, s, m in pieces:
                    doc.append(d)
                    start.append(first[d] + s)
                    length.append(m)
                    raw.append(held[d][s : s + m].astype("<u4", copy=False).tobytes())
                    seq.append(base + i)
                    offset.append(at)
                    context.append(n)
                    step.append(group + steps[i])
                    at += m
            long = lambda x: pa.array(x, pa.int64())
            columns = [
                pa.array(keys, id_type).take(long(doc)), long(start), long(length), pa.array(raw, pa.binary()),
                long([total[d] for d in doc]), long(seq), long(offset), pa.array(context, pa.int32()), long(step),
            ]
            base += len(sequences)
            group += max(steps, default=-1) + 1
            # What filled no window waits for the next block.
            keys, total, size = [keys[d] for d, _, _ in rest], [total[d] for d, _, _ in rest], sum(n for _, _, n in rest)
            held, first = [held[d][s : s + n] for d, s, n in rest], [first[d] + s for d, s, _ in rest]
            return pa.record_batch(columns, names)

        id_type = None
        for batch in batches:
            id_type = batch.column(0).type
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                tokens = np.append(encode(text.as_py() or ""), np.uint32(end_id))
                keys.append(key)
                held.append(tokens)
                first.append(0)
                total.append(len(tokens))
                size += len(tokens)
                if size >= BLOCK_TOKENS:
                    yield packed(False)
        if held:
            yield packed(True)

    kind = source.schema[0].dataType.simpleString()
    return source.mapInArrow(run, f"`{id_col}` {kind}, {_COLUMNS}")
